"""UPDATE, DELETE and MERGE of any dialect as DataFrame rewrites, since parquet tables take none of them.

The result is the table's new content. ``apply`` writes it beside the old one
and swaps the directories, so a failed job leaves the table as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialecta.sqlfront.dialects import dialect
from dialecta.sqlfront.front import Context, known_columns, render, query
from dialecta.sqlfront.lexer import Group, plain, split_at, tree
from dialecta.sqlfront.script import Statement, statements
from dialecta.tables import swap, written


@dataclass
class Branch:
    """One WHEN clause of a merge."""

    matched: bool
    condition: str | None
    action: str  # update, insert, delete
    sets: list[tuple[str, str]] = field(default_factory=list)
    by_source: bool = False


def _cut(items: list, *words: str) -> dict[str, list]:
    """Items by the keyword they follow; what stands before the first is under ''."""
    out: dict[str, list] = {"": []}
    key = ""
    for t in items:
        if t.is_(*words) and t.upper not in out:
            key = t.upper
            out[key] = []
        else:
            out[key].append(t)
    return out


def _sets(items: list, c: Context) -> list[tuple[str, str]]:
    out = []
    for a in split_at(items, ","):
        at = next(i for i, t in enumerate(a) if t.kind == "op" and t.text == "=")
        names = [t for t in a[:at] if t.kind in ("word", "quoted")]
        out.append((names[-1].value, render(a[at + 1 :], c).strip()))
    return out


def _alias(items: list) -> tuple[str, str]:
    """(table, alias) of ``name [AS] alias``."""
    names = [t for t in items if t.kind in ("word", "quoted") and not t.is_("AS", "INTO")]
    dots = sum(t.kind == "op" and t.text == "." for t in items)
    return names[dots].value, names[-1].value


def updated(spark: SparkSession, s: Statement, source: str) -> tuple[str, DataFrame]:
    """(table, new content) of an UPDATE, also with FROM."""
    c = Context(dialect(source), known_columns(spark, s.sql, source))
    cl = _cut(tree(s.tokens)[1:], "SET", "FROM", "WHERE")
    table, alias = _alias(cl[""])
    where = render(cl["WHERE"], c).strip() if "WHERE" in cl else "true"
    sets = dict(_sets(cl["SET"], c))
    low = {k.lower(): v for k, v in sets.items()}
    old = spark.table(table)
    if "FROM" not in cl:
        old.createOrReplaceTempView("__dml_old")
        cols = [f"CASE WHEN {where} THEN {low[n.lower()]} ELSE `{n}` END AS `{n}`" if n.lower() in low else f"`{n}`" for n in old.columns]
        new = spark.sql(f"SELECT {', '.join(cols)} FROM __dml_old AS `{alias}`")
    else:
        numbered = written(old.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # the same numbers at every use
        numbered.createOrReplaceTempView("__dml_old")
        hit = spark.sql(f"SELECT `{alias}`.__row, {', '.join(f'{e} AS `__new_{n}`' for n, e in sets.items())} FROM __dml_old AS `{alias}`, {render(cl['FROM'], c).strip()} WHERE {where}").dropDuplicates(["__row"])
        joined = spark.table("__dml_old").join(hit.withColumn("__hit", F.lit(True)), "__row", "left")
        new = joined.select(*(F.when(F.col("__hit"), F.col(f"__new_{next(k for k in sets if k.lower() == n.lower())}")).otherwise(F.col(n)).alias(n) if n.lower() in low else F.col(n) for n in old.columns))
    return table, new.select(*(F.col(f.name).cast(f.dataType) for f in old.schema))


def deleted(spark: SparkSession, s: Statement, source: str) -> tuple[str, DataFrame]:
    """(table, new content) of a DELETE; rows whose condition is null stay."""
    c = Context(dialect(source), known_columns(spark, s.sql, source))
    cl = _cut([t for t in tree(s.tokens)[1:] if not t.is_("FROM")], "WHERE")
    table, alias = _alias(cl[""])
    where = render(cl["WHERE"], c).strip() if "WHERE" in cl else "true"
    spark.table(table).createOrReplaceTempView("__dml_old")
    return table, spark.sql(f"SELECT * FROM __dml_old AS `{alias}` WHERE NOT coalesce({where}, false)")


def _branches(items: list, c: Context, columns: list[str]) -> list[Branch]:
    out: list[Branch] = []
    for part in split_at(items, "WHEN")[1:]:
        cl = _cut(part, "THEN")
        head, then = cl[""], cl["THEN"]
        matched = not any(t.is_("NOT") for t in head)
        by_source = any(t.is_("SOURCE") for t in head)
        cond = _cut(head, "AND").get("AND")
        b = Branch(matched, render(cond, c).strip() if cond else None, then[0].text.lower(), by_source=by_source)
        if b.action == "update":
            b.sets = _sets(then[2:], c) if not any(t.text == "*" for t in then[2:3]) else [(n, f"__s.`{n}`") for n in columns]
        elif b.action == "insert":
            groups = [t for t in then if isinstance(t, Group)]
            names = [plain(x).strip().strip('"`[]') for x in split_at(groups[0].items, ",")] if len(groups) > 1 else columns
            values = [render(v, c).strip() for v in split_at(groups[-1].items, ",")] if groups else [f"__s.`{n}`" for n in columns]
            b.sets = list(zip(names, values))
        out.append(b)
    return out


def merged(spark: SparkSession, s: Statement, source: str) -> tuple[str, DataFrame]:
    """(table, new content) of a MERGE: one full outer join, the first branch that applies decides.

    A target row that several source rows match raises an error, as the standard asks.
    """
    c = Context(dialect(source), known_columns(spark, s.sql, source))
    items = tree(s.tokens)[1:]
    when = next(i for i, t in enumerate(items) if t.is_("WHEN"))
    cl = _cut(items[:when], "USING", "ON")
    table, alias = _alias(cl[""])
    src = cl["USING"]
    g = next((t for t in src if isinstance(t, Group)), None)
    source_alias = src[-1].value
    source_sql = f"({query(g.items, c)})" if g else ".".join(t.value for t in src if t.kind in ("word", "quoted"))[: -len(source_alias) - 1] or source_alias
    if not g:
        source_sql = _alias(src)[0]
    on = render(cl["ON"], c).strip()
    old = spark.table(table)
    written(old.withColumn("__t", F.monotonically_increasing_id()), "numbered").createOrReplaceTempView("__merge_old")
    written(spark.sql(f"SELECT *, true AS __s, monotonically_increasing_id() AS __sid FROM {source_sql} AS `{source_alias}`"), "numbered").createOrReplaceTempView("__merge_src")
    branches = _branches(items[when:], c, old.columns)
    both = f"`{alias}`.__t IS NOT NULL AND `{source_alias}`.__s IS NOT NULL"
    only_s, only_t = f"`{alias}`.__t IS NULL", f"`{source_alias}`.__s IS NULL"
    case = []
    for k, b in enumerate(branches):
        state = both if b.matched else only_t if b.by_source else only_s
        case.append(f"WHEN {state}{f' AND ({b.condition})' if b.condition else ''} THEN {k}")
    chosen = f"CASE {' '.join(case)} ELSE -1 END"
    cols = []
    for n in old.columns:
        arms = []
        for k, b in enumerate(branches):
            sets = {x.lower(): e for x, e in b.sets}
            if b.action in ("update", "insert") and n.lower() in sets:
                arms.append(f"WHEN {k} THEN {sets[n.lower()].replace('__s.', f'`{source_alias}`.')}")
            elif b.action == "insert":
                arms.append(f"WHEN {k} THEN NULL")
        cols.append(f"CASE __branch {' '.join(arms)} ELSE `{alias}`.`{n}` END AS `{n}`" if arms else f"`{alias}`.`{n}` AS `{n}`")
    deletes = [str(k) for k, b in enumerate(branches) if b.action == "delete"]
    keep = f"NOT (__branch = -1 AND `{alias}`.__t IS NULL)" + (f" AND __branch NOT IN ({', '.join(deletes)})" if deletes else "")
    cols = [x.replace("CASE __branch", f"CASE {chosen}") for x in cols]
    text = (
        f"SELECT {', '.join(cols)}, `{alias}`.__t AS __t, count(`{alias}`.__t) OVER (PARTITION BY coalesce(`{alias}`.__t, -1 - `{source_alias}`.__sid)) AS __n "
        f"FROM __merge_old AS `{alias}` FULL OUTER JOIN __merge_src AS `{source_alias}` ON {on} WHERE {keep.replace('__branch', f'({chosen})')}"
    )
    new = spark.sql(text)
    twice = F.when((F.col("__t").isNotNull()) & (F.col("__n") > 1), F.raise_error(F.lit("MERGE: several source rows match one target row"))).otherwise(F.lit(0))
    new = new.withColumn("__ok", twice).where("__ok = 0 or __ok is null")
    return table, new.select(*(F.col(f.name).cast(f.dataType) for f in old.schema))


def inserted(spark: SparkSession, s: Statement, source: str) -> tuple[str, DataFrame]:
    """(table, new content) of an INSERT with VALUES or a query."""
    c = Context(dialect(source), known_columns(spark, s.sql, source))
    items = [t for t in tree(s.tokens)[1:] if not t.is_("INTO", "TABLE")]
    begin = next(i for i, t in enumerate(items) if t.is_("SELECT", "WITH", "VALUES"))
    head = items[:begin]
    cols = next((t for t in head if isinstance(t, Group)), None)
    table = [t.value for t in head if t.kind in ("word", "quoted")][-1]
    old = spark.table(table)
    listed = [plain(x).strip().strip('"`[]').lower() for x in split_at(cols.items, ",")] if cols else [n.lower() for n in old.columns]
    rows = spark.sql(query(items[begin:], c)).toDF(*(f"__{k}" for k in range(len(listed))))
    new = rows.select(*((F.col(f"__{listed.index(f.name.lower())}") if f.name.lower() in listed else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema))
    return table, old.unionAll(new)


_ACTIONS = {"update": updated, "delete": deleted, "merge": merged, "insert": inserted}


def changed(spark: SparkSession, sql: str, source: str) -> tuple[str, DataFrame]:
    """(table, new content) for one statement that changes data."""
    s = statements(sql, dialect(source))[0]
    if s.kind not in _ACTIONS:
        raise ValueError(f"{s.kind} changes no data")
    return _ACTIONS[s.kind](spark, s, source)


def apply(spark: SparkSession, sql: str, source: str, path: str) -> int:
    """Runs a change on the parquet table at ``path`` (and the view of its name); returns the new row count."""
    table, new = changed(spark, sql, source)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    beside = fs_path(path + ".__new")
    new.write.mode("overwrite").parquet(path + ".__new")
    fs = beside.getFileSystem(spark._jsc.hadoopConfiguration())
    swap(fs, fs_path, path + ".__new", path)
    fresh = spark.read.parquet(path)
    fresh.createOrReplaceTempView(table)
    return fresh.count()

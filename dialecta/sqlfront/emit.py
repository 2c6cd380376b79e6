"""Object specifications to the DDL of any of the nine dialects, with findings for all that changes."""

from __future__ import annotations

from dialecta.sqlfront.ddl import Column, Constraint, RoutineSpec, TableSpec, TriggerSpec, ViewSpec
from dialecta.sqlfront.dialects import SPARKISH, Dialect, dialect, quoted
from dialecta.sqlfront.front import Finding
from dialecta.sqlfront.lexer import plain, split_at, tokens, tree
from dialecta.sqlfront.speak import Notes, expression, query_text
from dialecta.sqlfront.types import UnknownType, parse_type, spell

MAX_CLUSTER = 4


# --- tables -------------------------------------------------------------------


def _default(c: Column, source: Dialect, target: Dialect, notes: Notes) -> str:
    if c.default is None:
        return ""
    if target.name == "fabric_dw":
        notes.add("DEFAULT_REMOVED", f"column {c.name}: DEFAULT is not supported")
        return ""
    text = expression(tree(tokens(c.default, source)), source, target, notes).strip()
    if target.name == "oracle" and c.type.generic == "BOOLEAN":
        text = {"true": "1", "false": "0"}.get(text.lower(), text)
    return f" DEFAULT {text}"


def _identity(c: Column, target: Dialect, notes: Notes) -> tuple[str | None, str]:
    """(type override, clause) of an identity column."""
    start, step = c.identity
    if target.name in ("redshift", "snowflake", "sqlserver", "synapse"):
        return None, f" IDENTITY({start},{step})"
    if target.name == "oracle":
        return None, f" GENERATED BY DEFAULT AS IDENTITY (START WITH {start} INCREMENT BY {step})"
    if target.name == "databricks":
        return "BIGINT", f" GENERATED BY DEFAULT AS IDENTITY (START WITH {start} INCREMENT BY {step})"
    notes.add("IDENTITY_REMOVED", f"column {c.name}: identity is not supported")
    return ("BIGINT" if target.name == "fabric_lakehouse" else None), ""


def _column_line(c: Column, spec: TableSpec, source: Dialect, target: Dialect, notes: Notes, lengths: dict[str, int]) -> str:
    kind = c.type
    if kind.generic == "TEXT" and lengths:
        n = lengths.get(f"{spec.name[-1]}.{c.name}".lower(), lengths.get("*"))
        if n and n > 0 and target.name not in (*SPARKISH, "bigquery", "snowflake"):
            kind = type(kind)("VARCHAR", length=n, written=kind.written)
    text, more = spell(kind, target)
    for code, message in more:
        notes.add(code, f"column {c.name}: {message}")
    clause = ""
    if c.identity:
        override, clause = _identity(c, target, notes)
        text = override or text
    if c.generated:
        if target.name in ("databricks", "fabric_lakehouse", "oracle"):
            clause += f" GENERATED ALWAYS AS ({expression(tree(tokens(c.generated, source)), source, target, notes).strip()})"
        elif target.tsql and target.name == "sqlserver":
            return f"{quoted([c.name], target)} AS ({expression(tree(tokens(c.generated, source)), source, target, notes).strip()})"
        else:
            notes.add("GENERATED_COLUMN_REMOVED", f"column {c.name}: generated columns are not supported")
    line = f"{quoted([c.name], target)} {text}{clause}{_default(c, source, target, notes)}"
    if not c.nullable:
        line += " NOT NULL"
    if c.encode:
        if target.name == "redshift":
            line += f" ENCODE {c.encode}"
        else:
            notes.add("ENCODE_REMOVED", f"column {c.name}: compression encoding was dropped", "info")
    if c.comment:
        comment = c.comment.replace("'", "''")
        if target.name in (*SPARKISH, "snowflake"):
            line += f" COMMENT '{comment}'"
        elif target.name == "bigquery":
            line += f" OPTIONS(description='{comment}')"
        else:
            notes.add("COLUMN_COMMENT_REMOVED", f"column {c.name}: the comment was dropped", "info")
    if target.name == "oracle" and c.type.generic == "BOOLEAN":
        line += f" CHECK ({quoted([c.name], target)} IN (0, 1))"
    return line


def _constraint_line(k: Constraint, spec: TableSpec, target: Dialect, source: Dialect, notes: Notes) -> str | None:
    cols = ", ".join(quoted([c], target) for c in k.columns)
    label = f"CONSTRAINT {quoted([k.name], target)} " if k.name else ""
    tail = " NOT ENFORCED" if target.name in ("synapse", "fabric_dw", "bigquery") else ""
    if k.kind == "primary_key":
        return f"{label}PRIMARY KEY {'NONCLUSTERED ' if target.name in ('synapse', 'fabric_dw') else ''}({cols}){tail}"
    if k.kind == "unique":
        if target.name in ("bigquery", *SPARKISH):
            notes.add("UNIQUE_REMOVED", f"UNIQUE ({', '.join(k.columns)}) is kept as metadata only")
            return None
        return f"{label}UNIQUE {'NONCLUSTERED ' if target.name in ('synapse', 'fabric_dw') else ''}({cols}){tail}"
    if k.kind == "foreign_key":
        if target.name in ("fabric_lakehouse", "synapse"):
            notes.add("FOREIGN_KEY_REMOVED", f"foreign key ({', '.join(k.columns)}) is kept as metadata only")
            return None
        ref = ", ".join(quoted([c], target) for c in k.ref_columns)
        return f"{label}FOREIGN KEY ({cols}) REFERENCES {quoted(k.ref_table or [], target)}" + (f" ({ref})" if ref else "") + tail
    if target.name in ("oracle", "sqlserver", "databricks"):
        return f"{label}CHECK ({expression(tree(tokens(k.expression or '', source)), source, target, notes).strip()})"
    notes.add("CHECK_REMOVED", f"CHECK ({k.expression}) is not supported; validate it with a query")
    return None


def _layout(spec: TableSpec, target: Dialect, notes: Notes) -> list[str]:
    """Clauses of physical design; what a target cannot place is reported."""
    q = lambda cols: ", ".join(c if "(" in c else quoted([c], target) for c in cols)
    out: list[str] = []
    dist = spec.distribution
    cluster = list(spec.cluster_by)
    if not cluster and spec.sort_key and target.name in ("snowflake", "fabric_dw", "databricks", "bigquery"):
        cluster = list(spec.sort_key)
        notes.add("SORTKEY_TO_CLUSTER", "the sort key became CLUSTER BY", "info")
    if target.name in ("fabric_dw", "bigquery") and len(cluster) > MAX_CLUSTER:
        notes.add("CLUSTER_TRUNCATED", f"only the first {MAX_CLUSTER} cluster columns are kept")
        cluster = cluster[:MAX_CLUSTER]
    if target.name == "redshift":
        if dist:
            out.append({"hash": f"DISTSTYLE KEY DISTKEY ({q(dist[1])})", "round_robin": "DISTSTYLE EVEN", "replicate": "DISTSTYLE ALL"}.get(dist[0], "DISTSTYLE AUTO"))
        keys = spec.sort_key or cluster
        if keys:
            out.append(f"{'INTERLEAVED ' if spec.sort_kind == 'interleaved' else 'COMPOUND ' if len(keys) > 1 else ''}SORTKEY ({q(keys)})")
        return out
    if target.name == "synapse":
        kind = {"hash": f"HASH({q(dist[1])})", "replicate": "REPLICATE"}.get(dist[0], "ROUND_ROBIN") if dist else "ROUND_ROBIN"
        return [f"WITH (DISTRIBUTION = {kind}, CLUSTERED COLUMNSTORE INDEX)"]
    if dist:
        notes.add("DISTRIBUTION_REMOVED", f"distribution {dist[0]} has no counterpart", "info")
    if target.name == "fabric_dw" and cluster:
        out.append(f"WITH (CLUSTER BY ({q(cluster)}))")
    elif target.name == "snowflake" and cluster:
        out.append(f"CLUSTER BY ({q(cluster)})")
    elif target.name == "databricks":
        out.append("USING DELTA")
        if cluster:
            out.append(f"CLUSTER BY ({q(cluster)})")
            if spec.partition_by:
                notes.add("PARTITION_DROPPED", "clustering and partitioning exclude each other; clustering is kept")
        elif spec.partition_by:
            out.append(f"PARTITIONED BY ({q(spec.partition_by)})")
    elif target.name == "fabric_lakehouse":
        out.append("USING DELTA")
        parts = spec.partition_by or spec.sort_key
        if parts:
            out.append(f"PARTITIONED BY ({q(parts)})")
    elif target.name == "bigquery":
        if spec.partition_by:
            out.append(f"PARTITION BY {q(spec.partition_by[:1])}")
        if cluster:
            out.append(f"CLUSTER BY {q(cluster)}")
    elif target.name == "oracle":
        if spec.partition_by:
            out.append(f"PARTITION BY HASH ({q(spec.partition_by)}) PARTITIONS 8")
        elif cluster:
            out.append(f"PARTITION BY HASH ({q(cluster)}) PARTITIONS 8")
            notes.add("CLUSTER_TO_PARTITION", "clustering became hash partitioning", "info")
    elif cluster or spec.sort_key:
        notes.add("CLUSTER_REMOVED", "clustering has no counterpart", "info")
    return out


def emit_table(spec: TableSpec, source: str, target: str, schema: str | None = None, lengths: dict[str, int] | None = None) -> tuple[str, list[Finding]]:
    """A table for a target dialect. ``schema`` replaces the namespace; ``lengths`` bound TEXT columns
    (``table.column`` or ``*`` to length)."""
    s, t, notes = dialect(source), dialect(target), Notes()
    name = [schema, spec.name[-1]] if schema else spec.name
    lines = [_column_line(c, spec, s, t, notes, {k.lower(): v for k, v in (lengths or {}).items()}) for c in spec.columns]
    after: list[str] = []
    for k in spec.constraints:
        line = _constraint_line(k, spec, t, s, notes)
        if line and t.name == "fabric_dw":
            after.append(f"ALTER TABLE {quoted(name, t)} ADD {line if k.name else f'CONSTRAINT {quoted([f'{k.kind}_{spec.name[-1]}'], t)} ' + line};")
        elif line:
            lines.append(line)
    head = "CREATE "
    before = ""
    if spec.or_replace:
        if t.name in ("snowflake", "databricks", "bigquery"):
            head += "OR REPLACE "
        elif t.name == "oracle":
            before = f"BEGIN EXECUTE IMMEDIATE 'DROP TABLE {quoted(name, t)}'; EXCEPTION WHEN OTHERS THEN NULL; END;\n/\n"
        else:
            before = f"DROP TABLE IF EXISTS {quoted(name, t)};\n"
            notes.add("OR_REPLACE", "OR REPLACE became DROP and CREATE", "info")
    if spec.temporary and t.name in ("redshift", "snowflake", "bigquery"):
        head += "TEMPORARY "
    head += "TABLE "
    if spec.if_not_exists and not spec.or_replace and t.name in ("redshift", "snowflake", "databricks", "fabric_lakehouse", "bigquery"):
        head += "IF NOT EXISTS "
    body = f" (\n    {',\n    '.join(lines)}\n)" if lines else ""
    options = _layout(spec, t, notes)
    if spec.comment and t.name in (*SPARKISH, "snowflake"):
        options.append(f"COMMENT{' =' if t.name == 'snowflake' else ''} '{spec.comment}'")
    text = before + head + quoted(name, t) + body + ("\n" + "\n".join(options) if options else "")
    if spec.query:
        made, more = query_text(spec.query, source, target)
        notes += more
        text += f"\nAS {made}"
    text += ";" + ("\n" + "\n".join(after) if after else "")
    return text, list(notes)


def emit_view(spec: ViewSpec, source: str, target: str, schema: str | None = None) -> tuple[str, list[Finding]]:
    """A view or materialized view for a target dialect."""
    t = dialect(target)
    body, findings = query_text(spec.query, source, target)
    notes = Notes(findings)
    name = quoted([schema, spec.name[-1]] if schema else spec.name, t)
    cols = f" ({', '.join(quoted([c], t) for c in spec.columns)})" if spec.columns else ""
    if not spec.materialized:
        word = "CREATE OR ALTER VIEW" if spec.or_replace and t.tsql else "CREATE OR REPLACE VIEW" if spec.or_replace else "CREATE VIEW"
        return f"{word} {name}{cols} AS\n{body};", list(notes)
    if t.name == "fabric_dw":
        notes.add("MV_TO_CTAS", "the materialized view became a table and a refresh procedure")
        proc = quoted([*spec.name[:-1], f"refresh_{spec.name[-1]}"], t)
        return f"CREATE TABLE {name} AS\n{body};\nCREATE PROCEDURE {proc} AS BEGIN\nTRUNCATE TABLE {name};\nINSERT INTO {name}\n{body};\nEND;", list(notes)
    if t.name == "sqlserver":
        notes.add("MV_TO_INDEXED_VIEW", "the materialized view became an indexed view; add its unique index")
        return f"CREATE VIEW {name} WITH SCHEMABINDING AS\n{body};", list(notes)
    extra = " WITH (DISTRIBUTION = ROUND_ROBIN)" if t.name == "synapse" else "\nREFRESH COMPLETE ON DEMAND" if t.name == "oracle" else ""
    word = "CREATE MATERIALIZED LAKE VIEW" if t.name == "fabric_lakehouse" else "CREATE MATERIALIZED VIEW"
    return f"{word} {name}{cols}{extra} AS\n{body};", list(notes)


_MODES = {"IN": "IN", "OUT": "OUT", "INOUT": "INOUT", "OUTPUT": "OUT", "READONLY": "IN"}


def _parameter(items: list, source: Dialect) -> tuple[str, str, str, str]:
    """(name, mode, type as written, default) of one parameter of any dialect."""
    mode, name, written, default, into = "IN", "", [], [], None
    for t in items:
        if t.kind == "word" and t.upper in _MODES and into is not default:
            mode = "INOUT" if mode == "OUT" and t.upper == "IN" or name and t.upper == "OUT" and any(x.is_("IN") for x in items) else _MODES[t.upper]
        elif t.is_("DEFAULT") or t.kind == "op" and t.text in ("=", ":="):
            into = default
        elif into is default:
            default.append(t)
        elif not name and t.kind in ("word", "quoted"):
            name = t.value.lstrip("@")
        else:
            written.append(t)
    return name, mode, plain(written).strip(), plain(default).strip()


def _typed(written: str, source: Dialect, target: Dialect, notes: Notes, bare: bool = False) -> str:
    try:
        text, more = spell(parse_type(written, source), target)
    except (UnknownType, ValueError):
        return written
    for code, message in more:
        notes.add(code, message)
    if target.tsql and text in ("VARCHAR", "NVARCHAR"):
        return f"{text}(8000)"  # without a length a parameter would hold one character
    return text.partition("(")[0].strip() if bare else text


def _parameters(text: str, kind: str, source: Dialect, target: Dialect, notes: Notes) -> str:
    """A parameter list in the target's style; names keep their spelling but for T-SQL's @."""
    out = []
    for item in split_at(tree(tokens(text, source)), ","):
        if not item:
            continue
        name, mode, written, default = _parameter(item, source)
        typed = _typed(written, source, target, notes, bare=target.name == "oracle")
        value = expression(tree(tokens(default, source)), source, target, notes).strip() if default else ""
        if target.tsql:
            out.append(f"@{name} {typed}" + (f" = {value}" if value else "") + (" OUTPUT" if mode != "IN" else ""))
        elif target.name == "oracle":
            out.append(f"{name} {'IN OUT' if mode == 'INOUT' else mode} {typed}" + (f" DEFAULT {value}" if value else ""))
        elif target.name == "redshift":
            out.append(f"{name} {mode} {typed}" if kind == "procedure" else f"{name} {typed}")
            if value:
                notes.add("PARAMETER_DEFAULT", f"parameter {name}: defaults are not supported")
        elif target.name == "bigquery":
            out.append(f"{mode + ' ' if kind == 'procedure' else ''}{name} {typed}")
            if value:
                notes.add("PARAMETER_DEFAULT", f"parameter {name}: defaults are not supported")
        else:
            lead = f"{mode} " if kind == "procedure" and target.name in SPARKISH else ""
            out.append(f"{lead}{name} {typed}" + (f" DEFAULT {value}" if value else ""))
            if mode != "IN" and target.name == "snowflake":
                notes.add("PARAMETER_MODE", f"parameter {name}: return values of {mode} parameters from the procedure")
    return ", ".join(out)


def emit_routine(spec: RoutineSpec, source: str, target: str) -> tuple[str, list[Finding]]:
    """The frame of a routine for a target; bodies are carried over for review."""
    s, t, notes = dialect(source), dialect(target), Notes()
    name = quoted(spec.name, t)
    notes.add(f"{spec.kind.upper()}_BODY_MANUAL", "the body was carried over; review it")
    listed = spec.parameters if source == target else _parameters(spec.parameters, spec.kind, s, t, notes)
    params = f"({listed})"
    returned = spec.returns if source == target or not spec.returns or spec.returns.lower().startswith("table") else _typed(spec.returns, s, t, notes, bare=t.name == "oracle")
    returns = f" RETURNS {returned}" if returned else ""
    if t.name == "redshift":
        return f"CREATE OR REPLACE {spec.kind.upper()} {name}{params}{returns}\nAS $$\n{spec.body}\n$$ LANGUAGE plpgsql;", list(notes)
    if t.name == "snowflake":
        return f"CREATE OR REPLACE {spec.kind.upper()} {name}{params}{returns or ' RETURNS VARCHAR'}\nLANGUAGE SQL AS $$\n{spec.body}\n$$;", list(notes)
    if t.name == "bigquery":
        return f"CREATE OR REPLACE {spec.kind.upper()} {name}{params}{returns if spec.kind == 'function' else ''}\n{'AS' if spec.kind == 'function' else 'BEGIN'}\n{spec.body}\n{'' if spec.kind == 'function' else 'END'};", list(notes)
    if t.name == "oracle":
        return f"CREATE OR REPLACE {spec.kind.upper()} {name}{params if listed else ''}{returns.replace('RETURNS', 'RETURN')} AS\n{spec.body}\n/", list(notes)
    if t.name in SPARKISH:
        return f"CREATE OR REPLACE {spec.kind.upper()} {name}{params}{returns}\n{'LANGUAGE SQL AS ' if spec.kind == 'procedure' else ''}{spec.body};", list(notes)
    return f"CREATE {spec.kind.upper()} {name}{(' ' + listed) if spec.kind == 'procedure' else params}{returns} AS\n{spec.body};", list(notes)


def emit_trigger(spec: TriggerSpec, source: str, target: str) -> tuple[str, list[Finding]]:
    """A trigger for the two targets that have them; elsewhere a comment and an error."""
    t, notes = dialect(target), Notes()
    if t.name not in ("oracle", "sqlserver"):
        notes.add("TRIGGER_UNSUPPORTED", f"{target} has no triggers; react to changes where the data is loaded", "error")
        return f"-- trigger {'.'.join(spec.name)} on {'.'.join(spec.table)} is not supported", list(notes)
    notes.add("TRIGGER_BODY_MANUAL", "the body was carried over; review it")
    name, table = quoted(spec.name, t), quoted(spec.table, t)
    if t.name == "sqlserver":
        timing = spec.timing
        if timing == "BEFORE":
            timing = "INSTEAD OF"
            notes.add("TRIGGER_TIMING", "BEFORE became INSTEAD OF")
        if spec.each_row:
            notes.add("TRIGGER_ROW_LEVEL", "triggers run once per statement; use the tables inserted and deleted")
        events = ", ".join(dict.fromkeys(e.split(" ")[0] for e in spec.events))
        return f"CREATE TRIGGER {name} ON {table}\n{timing} {events}\nAS\n{spec.body};", list(notes)
    row = "\nFOR EACH ROW" if spec.each_row else ""
    when = f"\nWHEN ({spec.condition})" if spec.condition else ""
    return f"CREATE OR REPLACE TRIGGER {name}\n{spec.timing} {' OR '.join(spec.events)} ON {table}{row}{when}\n{spec.body}\n/", list(notes)

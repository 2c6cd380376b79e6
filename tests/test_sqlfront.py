"""Lexer, scripts, types, DDL, conversion and data changes of the front end."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from dialecta import registry
from dialecta.functions import fnv1a
from dialecta.sqlfront import catalog, convert, ddl, dml, front
from dialecta.sqlfront.dialects import DIALECTS, dialect
from dialecta.sqlfront.lexer import plain, tokens, tree
from dialecta.sqlfront.script import statements
from dialecta.sqlfront.types import UnknownType, from_spark, parse_type, spell, to_spark


def test_split_keeps_literals_comments_and_bodies():
    sql = "select ';' as a; -- x;y\n/* ; */ select 2;create procedure p() as begin update t set a = 1; if 1=1 begin select 3; end end"
    assert [s.kind for s in statements(sql, dialect("sqlserver"))] == ["select", "select", "procedure"]


def test_split_dollar_go_slash():
    assert len(statements("create function f() returns int as $$ select 1; select 2; $$ language sql; select 3", dialect("redshift"))) == 2
    assert len(statements("select 1\nGO\nselect 2\nGO\n", dialect("sqlserver"))) == 2
    assert len(statements("create table a (b number(1))\n/\nselect 1 from dual\n/\n", dialect("oracle"))) == 2


@pytest.mark.parametrize("sql,kind", [("with a as (select 1) select * from a", "select"), ("with a as (select 1) insert into t select * from a", "insert"), ("MERGE INTO a USING b ON x", "merge"), ("create materialized view v as select 1", "materialized_view"), ("create or replace view v as select 1", "view")])
def test_kind(sql, kind):
    assert statements(sql, dialect("snowflake"))[0].kind == kind


@given(st.text(alphabet="ab1 '\"`[](),;-/*\n+=<>", max_size=60), st.sampled_from(sorted(DIALECTS)))
@settings(max_examples=150, deadline=None)
def test_lexer_loses_nothing(text, name):
    d = dialect(name)
    assert "".join(t.gap + t.text for t in tokens(text, d, comments=True)) == text.rstrip() or text.strip() == "" or "".join(t.gap + t.text for t in tokens(text, d, comments=True)).strip() == text.strip()
    statements(text, d)


def test_nested_types_to_any_depth():
    t = parse_type("ARRAY<STRUCT<a INT64, b ARRAY<STRING(10)>>>", dialect("bigquery"))
    assert to_spark(t).simpleString() == "array<struct<a:bigint,b:array<string>>>"
    assert to_spark(parse_type("MAP<STRING, DECIMAL(10,2)>", dialect("databricks"))).simpleString() == "map<string,decimal(10,2)>"
    assert parse_type("VARCHAR(MAX)", dialect("sqlserver")).generic == "TEXT"
    assert parse_type("NUMBER(10)", dialect("oracle")).precision == 10
    assert to_spark(parse_type("TINYINT", dialect("sqlserver"))).simpleString() == "smallint"
    with pytest.raises(UnknownType):
        parse_type("WIBBLE", dialect("oracle"))


@pytest.mark.parametrize("name", sorted(DIALECTS))
def test_types_round_trip(name):
    d = dialect(name)
    for g in ("INT32", "INT64", "DATE", "BOOLEAN", "TIMESTAMP"):
        text, _ = spell(parse_type({"INT32": "INT", "INT64": "BIGINT", "DATE": "DATE", "BOOLEAN": "BOOLEAN", "TIMESTAMP": "DATETIME"}[g], dialect("snowflake")), d)
        to_spark(parse_type(text, d))
    assert from_spark(to_spark(parse_type("DECIMAL(9,2)", dialect("redshift")))).scale == 2


def test_rewrites_do_not_touch_literals():
    out, _ = front.to_spark_sql("select 'isnull(a,b) TRUE ::int' as x, isnull(a, 1) from t", "sqlserver")
    assert "'isnull(a,b) TRUE ::int'" in out and "coalesce(a, 1)" in out


@pytest.mark.parametrize("source,sql,part", [
    ("snowflake", "select a from t qualify row_number() over (partition by a order by b) = 1", "EXCEPT (__qualify_1)"),
    ("sqlserver", "select top 3 * from t order by a", "LIMIT 3"),
    ("oracle", "select a from t where rownum <= 7", "LIMIT 7"),
    ("oracle", "select 1 from dual", "SELECT 1"),
    ("redshift", "select datediff(year, a, b) from t", "(year(b) - year(a))"),
    ("bigquery", "select date_diff(a, b, day) from t", "datediff(cast(a AS date), cast(b AS date))"),
    ("sqlserver", "select a from t with (nolock)", "from t"),
    ("redshift", "select nvl(nvl(a, b), c) from t", "coalesce(coalesce(a, b), c)"),
    ("snowflake", "select a from t order by a", "NULLS LAST"),
    ("sqlserver", "select a from t order by a", "order by a"),
    ("sqlserver", "select x = a + 1 from t", "a + 1 AS x"),
    ("sqlserver", "select 'a' + b from t", "'a' || b"),
    ("redshift", "select a.b::int from t", "cast(a.b AS int)"),
    ("snowflake", "select t.v:a.b[0]::string from t", "try_variant_get(t.v, '$.a.b[0]', 'string')"),
    ("bigquery", "select * except (a) from t", "* except (a)"),
    ("oracle", "select to_char(d, 'YYYY-MM-DD') from t", "'yyyy-MM-dd'"),
])
def test_rewrite(source, sql, part):
    assert part in front.to_spark_sql(sql, source)[0]


def test_unsupported_is_an_error(spark):
    with pytest.raises(NotImplementedError):
        front.run(spark, "select * from t match_recognize (pattern (a))", "oracle")


def test_same_question_in_nine_dialects(spark):
    spark.createDataFrame([Row(k=1, v="a"), Row(k=2, v=None), Row(k=3, v="c")]).createOrReplaceTempView("nine")
    texts = {
        "redshift": 'SELECT "k", NVL(v, \'-\') AS w FROM nine ORDER BY "k" LIMIT 2', "snowflake": "SELECT k, IFNULL(v, '-') AS w FROM nine ORDER BY k LIMIT 2",
        "sqlserver": "SELECT TOP 2 [k], ISNULL(v, '-') AS w FROM nine ORDER BY k", "synapse": "SELECT TOP (2) k, COALESCE(v, '-') AS w FROM nine ORDER BY k",
        "fabric_dw": "SELECT k, ISNULL(v, '-') AS w FROM nine ORDER BY k OFFSET 0 ROWS FETCH NEXT 2 ROWS ONLY", "oracle": "SELECT k, NVL(v, '-') AS w FROM nine WHERE ROWNUM <= 2",
        "bigquery": "SELECT `k`, IFNULL(v, \"-\") AS w FROM nine ORDER BY k LIMIT 2", "databricks": "SELECT k, coalesce(v, '-') AS w FROM nine ORDER BY k LIMIT 2",
        "fabric_lakehouse": "SELECT k, nvl(v, \"-\") AS w FROM nine ORDER BY k LIMIT 2",
    }
    assert {n: sorted(map(tuple, front.run(spark, q, n).collect())) for n, q in texts.items()} == {n: [(1, "a"), (2, "-")] for n in texts}


TABLE = """CREATE TABLE s.t (id BIGINT IDENTITY(1,1) NOT NULL ENCODE az64, nm VARCHAR(40) DEFAULT 'x', tx TEXT, amt NUMERIC(18,2) NOT NULL,
PRIMARY KEY (id), UNIQUE (nm), CHECK (amt > 0), FOREIGN KEY (nm) REFERENCES s.u(nm)) DISTSTYLE KEY DISTKEY(id) SORTKEY(nm, amt)"""


def test_table_spec():
    spec = ddl.parse_script(TABLE, "redshift")[0][1]
    assert [c.name for c in spec.columns] == ["id", "nm", "tx", "amt"] and spec.distribution == ("hash", ["id"]) and spec.sort_key == ["nm", "amt"]
    assert {k.kind for k in spec.constraints} == {"primary_key", "unique", "check", "foreign_key"}
    assert spec.schema()["nm"].metadata["length"] == 40 and not spec.schema()["id"].nullable


def test_table_as_select_keeps_its_query():
    assert ddl.parse_script("create table a as select 1 as x", "snowflake")[0][1].query == "select 1 as x"


@pytest.mark.parametrize("source", sorted(DIALECTS))
@pytest.mark.parametrize("target", sorted(DIALECTS))
def test_every_pair_converts_and_reads_back(source, target):
    d = dialect(source)
    q = lambda n: d.quote + n + {"[": "]"}.get(d.quote, d.quote)
    types = [spell(parse_type(x, dialect("snowflake")), d)[0] for x in ("BIGINT", "VARCHAR(20)", "NUMBER(12,2)", "DATE")]
    sql = f"CREATE TABLE {q('s')}.{q('t')} ({', '.join(f'{q(n)} {t}' for n, t in zip('abcd', types))}); SELECT a FROM t; CREATE VIEW v AS SELECT a FROM t"
    r = convert.convert(sql, source, target)
    assert 0.5 <= r.score <= 1 and "CONVERSION_FAILED" not in [f.code for f in r.findings]
    back = ddl.parse_script(r.sql, target)
    spec = next(x for _, x, _ in back if isinstance(x, ddl.TableSpec))
    assert [c.name for c in spec.columns] == list("abcd") and spec.name == ["s", "t"]
    assert len([s for s, _, _ in back if s.kind in ("table", "select", "view")]) >= 3


def test_confidence_and_merging():
    f = front.Finding
    assert convert.confidence([]) == (1.0, "HIGH", 1.0)
    assert convert.confidence([f("A", "info", "x")] * 3) == (0.85, "PARTIAL", 1.0)
    assert convert.confidence([f("A", "error", "x")])[1] == "MANUAL_REVIEW"
    assert convert.merged([f("A", "info", "x")] * 2)[0].message == "x (repeated 2 times)"


def test_lengths_and_schema_override():
    r = convert.convert("create table a.t (x TEXT)", "snowflake", "sqlserver", schema="dw", lengths={"t.x": 99})
    assert "[dw].[t]" in r.sql and "VARCHAR(99)" in r.sql and not r.decisions


def test_bad_script_is_reported_not_dropped():
    r = convert.convert("create table ((; select 1", "oracle", "bigquery")
    assert r.level == "MANUAL_REVIEW" and r.sql


def test_apply_ddl_and_views(spark, tmp_path):
    spark.createDataFrame([Row(a=1, b="x"), Row(a=2, b=None)]).createOrReplaceTempView("src")
    notes = catalog.apply_ddl(spark, "create or replace table made as select a, nvl(b, '?') as b from src; create view seen as select b from made where a = 2", "redshift", str(tmp_path))
    assert [r.b for r in spark.table("seen").collect()] == ["?"] and "error" not in [r.severity for r in notes.collect()]


def test_merge_conflict_raises(spark):
    spark.createDataFrame([Row(k=1, v=1)]).createOrReplaceTempView("mt")
    spark.createDataFrame([Row(k=1, v=2), Row(k=1, v=3)]).createOrReplaceTempView("ms")
    with pytest.raises(Exception, match="several source rows"):
        dml.changed(spark, "MERGE INTO mt t USING ms s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v", "snowflake")[1].collect()


def test_dml_apply_swaps(spark, tmp_path):
    path = str(tmp_path / "tab")
    spark.createDataFrame([Row(k=1, v="a"), Row(k=2, v="b")]).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("tab")
    assert dml.apply(spark, "DELETE FROM tab WHERE k = 1", "oracle", path) == 1
    assert [r.k for r in spark.table("tab").collect()] == [2]


def test_fnv1a_known_value():
    assert fnv1a("a") & 0xFFFFFFFFFFFFFFFF == 0xAF63DC4C8601EC8C and fnv1a(None) is None
    assert plain(tree(tokens("a (b, c)", dialect("oracle")))) == "a (b, c)"


def test_functions_and_materialized_views(spark, tmp_path):
    from dialecta.sqlfront import limits

    spark.createDataFrame([Row(a=1), Row(a=4)]).createOrReplaceTempView("fsrc")
    script = """create function dbl(@x int) returns int as begin return isnull(@x, 0) * 2 end;
create materialized view mv as select sum(a) as s from fsrc; create function many(k int) returns table (a bigint) as 'select a from fsrc where a > k'"""
    notes = catalog.apply_ddl(spark, script.split(";")[0], "sqlserver", str(tmp_path)).collect()
    assert not notes and spark.sql("select dbl(21) as v").first().v == 42
    catalog.apply_ddl(spark, script.split(";")[1], "redshift", str(tmp_path))
    assert spark.table("mv").first().s == 5
    catalog.apply_ddl(spark, script.split(";")[2], "snowflake", str(tmp_path))
    assert [r.a for r in spark.sql("select * from many(2)").collect()] == [4]
    got = {x["feature"] for x in limits.limitations_for("fabric_dw", "redshift", "create table t (a int identity(1,1)) distkey(a)")}
    assert got == {"DISTRIBUTION", "IDENTITY"} and limits.limitations(spark).count() > 50 and len(limits.dialects()) == 9


def test_triggers():
    sql = "CREATE OR REPLACE TRIGGER trg BEFORE INSERT OR UPDATE OF a ON s.t FOR EACH ROW WHEN (new.a > 1) BEGIN :new.b := 1; END;"
    spec = ddl.parse_script(sql, "oracle")[0][1]
    assert (spec.name, spec.timing, spec.events, spec.table, spec.each_row, spec.condition) == (["trg"], "BEFORE", ["INSERT", "UPDATE OF a"], ["s", "t"], True, "new.a > 1")
    r = convert.convert(sql, "oracle", "sqlserver")
    assert "INSTEAD OF INSERT, UPDATE" in r.sql and "[s].[t]" in r.sql and {"TRIGGER_TIMING", "TRIGGER_ROW_LEVEL"} <= {f.code for f in r.findings}
    assert "FOR EACH ROW" in convert.convert(sql, "oracle", "oracle").sql
    none = convert.convert(sql, "oracle", "snowflake")
    assert none.level == "MANUAL_REVIEW" and none.references


def test_requests_convert_to_their_own_target(spark, tmp_path):
    rows = [(1, "create table a.t (x TEXT)", "snowflake", " SqlServer ", "dw", 99), (2, "select 1", "oracle", "bigquery", None, None), (3, "select 1", "oracle", None, None, None), (4, "select 1", "oracle", "db2", None, None)]
    df = spark.createDataFrame(rows, "request_id long, sql string, source_dialect string, target_dialect string, target_schema string, default_text_length int")
    df.write.parquet(f"{tmp_path}/transpile_requests.parquet")
    got = {(r.rid, r.target): r for r in registry.queries()["convert_requests"](spark, str(tmp_path)).collect()}
    assert len(got) == 9 * 4 + 1 and {k for k, r in got.items() if r.requested} == {(1, "sqlserver"), (2, "bigquery"), (4, "db2")}
    assert "[dw].[t]" in got[1, "sqlserver"].sql and "VARCHAR(99)" in got[1, "sqlserver"].sql and "[dw]" not in got[1, "fabric_dw"].sql
    assert got[4, "db2"].error


SAID = [
    ("sqlserver", "SELECT TOP 5 a FROM t ORDER BY b", {"snowflake": "SELECT a FROM t ORDER BY b NULLS FIRST LIMIT 5", "oracle": "FETCH FIRST 5 ROWS ONLY", "bigquery": "SELECT a FROM t ORDER BY b LIMIT 5"}),
    ("oracle", "SELECT INSTR(a, 'x'), EXTRACT(YEAR FROM c) FROM t", {"sqlserver": "CHARINDEX('x', a), DATEPART(YEAR, c)", "snowflake": "CHARINDEX('x', a)", "databricks": "LOCATE('x', a)"}),
    ("redshift", "SELECT CONVERT_TIMEZONE('UTC', 'Asia/Dubai', a), CURRENT_DATE, POSITION('x' IN b), date_part_year(c) FROM t", {"sqlserver": "a AT TIME ZONE 'UTC' AT TIME ZONE 'Arabian Standard Time', CAST(GETDATE() AS DATE), CHARINDEX('x', b), YEAR(c)", "oracle": "EXTRACT(YEAR FROM c)"}),
    ("sqlserver", "SELECT DATEDIFF(month, a, b), DATEADD(month, 2, c) FROM t", {"oracle": "ADD_MONTHS(c, 2)", "bigquery": "DATE_DIFF(b, a, MONTH), DATE_ADD(c, INTERVAL 2 MONTH)"}),
    ("oracle", "SELECT DECODE(a, 1, 'x', NULL, 'n', 'z'), CAST(b AS VARCHAR2(5)) FROM t", {"sqlserver": "CASE WHEN a = 1 THEN 'x' WHEN a IS NULL THEN 'n' ELSE 'z' END, CAST(b AS VARCHAR(5))"}),
    ("sqlserver", "SELECT x.a FROM t OUTER APPLY (SELECT MAX(b) AS a FROM u WHERE u.k = t.k) x", {"snowflake": "LEFT JOIN LATERAL (SELECT MAX(b) AS a FROM u WHERE u.k = t.k) x ON TRUE"}),
    ("snowflake", "SELECT a FROM t QUALIFY ROW_NUMBER() OVER (ORDER BY b) = 1", {"fabric_lakehouse": "WHERE qualify_1 = 1", "sqlserver": "WHERE qualify_1 = 1", "databricks": "QUALIFY"}),
    ("snowflake", "SELECT a FROM t SAMPLE (10)", {"bigquery": "TABLESAMPLE SYSTEM (10 PERCENT)", "oracle": "SAMPLE (10)"}),
    ("oracle", "SELECT a FROM t START WITH b IS NULL CONNECT BY PRIOR a = b", {"snowflake": "START WITH b IS NULL CONNECT BY PRIOR a = b", "redshift": "WITH RECURSIVE"}),
    ("redshift", "SELECT a FROM (SELECT a FROM t LIMIT 3) x", {"sqlserver": "SELECT TOP (3) a FROM t"}),
    ("snowflake", "SELECT a FROM t LIMIT 5 OFFSET 3", {"oracle": "OFFSET 3 ROWS FETCH FIRST 5 ROWS ONLY", "synapse": "ORDER BY (SELECT NULL) OFFSET 3 ROWS FETCH NEXT 5 ROWS ONLY"}),
    ("oracle", "SELECT a FROM t WHERE ROWNUM <= 3 ORDER BY a DESC", {"databricks": "FROM (SELECT * FROM t LIMIT 3) t ORDER BY a DESC"}),
]


@pytest.mark.parametrize("source,sql,parts", SAID)
def test_said_in_other_dialects(source, sql, parts):
    for target, part in parts.items():
        assert part in convert.convert(sql, source, target).sql, target


_PIECES = ["'top 5 it''s'", "'a minus b'", "'x nulls first'", "a", "NVL(a, 'isnull(len(')", "'-- limit 3'", "'/* from dual */'", "COALESCE(b, 'sysdate')", "'[x] \"y\" `z` || + ::int'"]


@given(st.lists(st.sampled_from(_PIECES), min_size=1, max_size=5), st.sampled_from(sorted(DIALECTS)), st.sampled_from(sorted(DIALECTS)), st.booleans())
@settings(max_examples=200, deadline=None)
def test_literals_are_never_changed(pieces, source, target, nested):
    text = f"SELECT {', '.join(pieces)} FROM t ORDER BY a"
    text = f"SELECT * FROM ({text}) x" if nested else text
    d = dialect(source)
    want = [t.value for t in tokens(text, d) if t.kind == "string"]
    got = [t.value for t in tokens(convert.convert(text, source, target).sql, dialect(target)) if t.kind == "string"]
    assert got == want


@pytest.mark.parametrize("source,sql,target", [
    ("snowflake", "SELECT STRTOK_TO_ARRAY(a), DIV0(a, b), OBJECT_CONSTRUCT('k', a) FROM t", "oracle"), ("sqlserver", "SELECT DATENAME(month, a) FROM t", "bigquery"), ("redshift", "SELECT FNV_HASH(a) FROM t", "snowflake"), ("oracle", "SELECT seq.NEXTVAL FROM dual", "bigquery"),
    ("redshift", "SELECT a FROM t WHERE b SIMILAR TO '%x%'", "sqlserver"), ("bigquery", "SELECT x FROM t, UNNEST(a) AS x", "redshift"), ("oracle", "SELECT a FROM t WHERE ROWNUM > b", "snowflake"), ("snowflake", "SELECT * FROM t MATCH_RECOGNIZE (PATTERN (a))", "databricks"),
    ("sqlserver", "SELECT TOP 5 PERCENT a FROM t", "redshift"), ("databricks", "SELECT EXPLODE(a) FROM t", "oracle"), ("oracle", "SELECT INITCAP(a), REGEXP_SUBSTR(a, 'x') FROM t", "fabric_dw"), ("snowflake", "SELECT CAST(a AS VARIANT) FROM t", "sqlserver"),
])
def test_what_a_target_does_not_know_is_found(source, sql, target):
    r = convert.convert(sql, source, target)
    assert r.score < 1 and r.findings


def test_own_dialect_has_nothing_unknown():
    from dialecta.sqlfront.vocabulary import unknown_to

    assert not unknown_to("SELECT TOP 5 LEN(a), ISNULL(b, 'QUALIFY ::') FROM t WITH (NOLOCK) CROSS APPLY u", "sqlserver")
    assert not unknown_to("SELECT NVL(a, b), limit_ FROM dual WHERE ROWNUM < 3 CONNECT BY PRIOR a = b", "oracle")
    assert {c for c, _ in unknown_to("SELECT a::int, NVL(a, b) FROM t LIMIT 3", "sqlserver")} == {"CAST_OPERATOR", "FUNCTION_NVL", "CLAUSE_LIMIT"}


class _Files:
    """A file system of names in memory whose n-th rename fails."""

    def __init__(self, names, fails):
        self.names, self.fails, self.n = dict(names), fails, 0

    def exists(self, p):
        return p in self.names

    def rename(self, a, b):
        self.n += 1
        if self.n in self.fails or b in self.names:
            return False
        self.names[b] = self.names.pop(a)
        return True

    def delete(self, p, _):
        return self.names.pop(p, None) is not None


@pytest.mark.parametrize("fails,kept", [((), "new"), ((1,), "old"), ((2,), "old")])
def test_a_failing_rename_keeps_the_table(fails, kept):
    from dialecta.tables import swap

    fs = _Files({"/t": "old", "/t.new": "new"}, fails)
    if fails:
        with pytest.raises(OSError):
            swap(fs, str, "/t.new", "/t")
    else:
        swap(fs, str, "/t.new", "/t")
    assert fs.names["/t"] == kept and (fails or len(fs.names) == 1)
    lost = _Files({"/t": "old", "/t.new": "new"}, (2, 3))
    with pytest.raises(OSError):
        swap(lost, str, "/t.new", "/t")
    assert "old" in lost.names.values()


def test_script_variables_are_names():
    sql = "CREATE TABLE ${schema}.dim_x (a BIGINT, b VARCHAR(10)); SELECT a FROM ${schema}.dim_x; CREATE VIEW {{ env }}.v AS SELECT b FROM {{ env }}.t"
    r = convert.convert(sql, "fabric_dw", "snowflake")
    assert not [f for f in r.findings if f.severity == "error"] and '${schema}."dim_x"' in r.sql and "FROM ${schema}.dim_x" in r.sql and '{{ env }}."v"' in r.sql


def test_findings_of_many_columns_are_one():
    f = front.Finding
    got = convert.merged([f("A", "info", "column x: gone"), f("A", "info", "column y: gone"), f("B", "info", "z"), f("B", "info", "z")])
    assert [x.message for x in got] == ["columns x, y: gone", "z (repeated 2 times)"]
    assert "data-types" in convert.reference(f("TYPE_JSON_FALLBACK", "warning", ""), "bigquery") and "functions" in convert.reference(f("UNKNOWN_FUNCTION_NVL", "warning", ""), "snowflake")


@pytest.mark.parametrize("target,part", [
    ("sqlserver", "[p] @a INT, @b VARCHAR(20) = 'x', @c DECIMAL(10,2) OUTPUT AS"), ("oracle", '"p"(a IN NUMBER, b IN VARCHAR2 DEFAULT \'x\', c OUT NUMBER)'), ("snowflake", '"p"(a INTEGER, b VARCHAR(20) DEFAULT \'x\', c NUMBER(10,2))'),
    ("redshift", '"p"(a IN INTEGER, b IN VARCHAR(20), c OUT DECIMAL(10,2))'), ("bigquery", "`p`(IN a INT64, IN b STRING(20), OUT c NUMERIC(10,2))"), ("databricks", "`p`(IN a INT, IN b STRING DEFAULT 'x', OUT c DECIMAL(10,2))"),
])
def test_parameters_in_each_style(target, part):
    sources = {
        "sqlserver": "CREATE PROCEDURE p @a INT, @b VARCHAR(20) = 'x', @c DECIMAL(10,2) OUTPUT AS BEGIN SELECT 1; END",
        "synapse": "CREATE PROCEDURE p @a INT, @b VARCHAR(20) = 'x', @c DECIMAL(10,2) OUTPUT AS BEGIN SELECT 1; END",
    }
    for source, sql in sources.items():
        if source != target:
            assert part in convert.convert(sql, source, target).sql, source


def test_python_function_of_several_lines(spark):
    body = "def helper(x):\n    return x * 2\ndef run(x):\n    if x is None:\n        return -1\n    return helper(x) + 1"
    spec = ddl.parse_script(f"CREATE FUNCTION py_twice(x INT) RETURNS INT LANGUAGE PYTHON AS $$\n{body}\n$$", "snowflake")[0][1]
    assert catalog.register_function(spark, spec, "snowflake")
    assert [r.v for r in spark.sql("select py_twice(x) as v from values (1), (null), (4) as t(x)").collect()] == [3, -1, 9]

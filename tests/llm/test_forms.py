"""Pure functions: canonical glyphs, copy forms, grammar, packing plan, swaps."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialecta.llm import sqlgrammar as g
from dialecta.llm.codepages import SINGLE, undo
from dialecta.llm.mixing import Node, distribute
from dialecta.llm.packing import plan
from dialecta.llm.textforms import canonical_glyphs, copy_form, word_set


@pytest.mark.parametrize("a,b", [("ＳＥＬＥＣＴ", "SELECT"), ("a b", "a b"), ("ñ", "ñ"), ("с​at", "cat"), ("ﬁx", "fix"), ("﻿x", "x"), ("so­ft", "soft"), ("a　b", "a b"), ("Ｋ", "K"), ("a，b", "a,b"), ("ꓢꓰꓡꓰꓚꓔ", "SELECT"), ("Ⅿ‑Ⲟ", "M-O"), ("Ꮪ∕ᎪӀ", "S/AI")])
def test_looks_the_same(a, b):
    assert canonical_glyphs(a) == canonical_glyphs(b)


@pytest.mark.parametrize("a,b", [("m²", "m2"), ("ação", "acao"), ("a  b", "a b"), ("a\tb", "a b"), ("A", "a"), ("a,b", "a;b"), ("fiyatı", "fiyati")])
def test_looks_different(a, b):
    assert canonical_glyphs(a) != canonical_glyphs(b)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_canonical_is_idempotent(s):
    once = canonical_glyphs(s)
    assert canonical_glyphs(once) == once


@given(st.text(alphabet="ab üé你가각\u0301\u0327\u0308\u00adаеⅠꓐ‑\u200b\U0001d400ｱﾞがか\u3099", max_size=24))
@settings(max_examples=500, deadline=None)
def test_splicing_segments_equals_normalising_the_whole(s):
    from dialecta.llm.textforms import _canonical

    assert canonical_glyphs(s) == _canonical(s)


def test_quick_check_passes_right_text_of_any_script(spark):
    from dialecta.llm.textforms import UNSTABLE_CHAR

    right = ("Größe über naïve", "数据库迁移", "データ", "한국어", "select *\n\tfrom t", "żółć", "")
    for s in right:
        assert canonical_glyphs(s) == s
    wrong = ("a\u0301", "ｓ", "а", "\u00a0", "\u200b", "\x01", "\x7f", "\U0001d400", "x" * 99 + "\u3099")
    rows = spark.createDataFrame([(s, s in wrong) for s in right + wrong], "s string, unstable boolean")
    assert rows.where(rows.s.rlike(UNSTABLE_CHAR) != rows.unstable).count() == 0


@pytest.mark.parametrize("a,b", [
    ("CREATE TABLE t (a INT, b DECIMAL(18,2))", 'create table "T" (\n b decimal(18,2)\n , a int\n);'),
    ("SELECT a, COALESCE(b, 1) AS c FROM t WHERE x = 1", "select coalesce(b,1) as c, a from t where x=1;"),
    ("select distinct a, b from t", "SELECT DISTINCT b, a FROM t"),
    ("create view v as select a, b from (select c, d from u) x", "create view v as select b, a from (select d, c from u) x"),
    ("select [a] from t", "select `a` from t"), ("", "  ;\n"),
])
def test_copies(a, b):
    assert copy_form(a) == copy_form(b)


@pytest.mark.parametrize("a,b", [
    ("create table t (a int, b text)", "create table t (a text, b int)"), ("select a from t /* x */", "select a from t"), ("select a from t where b = 'x'", "select a from t where b = 'y'"),
    ("select a, b from t group by a, b", "select a, b from t group by b, a"), ("insert into t (a, b) values (1, 2)", "insert into t (b, a) values (1, 2)"),
    ("create table t (a decimal(18,2))", "create table t (a decimal(2,18))"), ("select сat from t", "select cat from t"), ("/* Å */ select 1", "/* Å */ select 1"),
])
def test_no_copies(a, b):
    assert copy_form(a) != copy_form(b)


def test_words():
    assert word_set("SELECT a_1, B FROM x.y -- é") == {"select", "a_1", "b", "from", "x", "y"}


GOOD = [
    ("redshift", "CREATE TABLE a.b (c BIGINT NOT NULL, d DOUBLE PRECISION DEFAULT 3, PRIMARY KEY (c)) DISTSTYLE KEY DISTKEY (c) SORTKEY (d);"), ("bigquery", "create table `a` (b INT64, c ARRAY<STRUCT<x INT64, y STRING>>) partition by date(d) cluster by b, c"),
    ("synapse", "create table [a] ([b] int) with (distribution = hash([b]), clustered columnstore index)"), ("databricks", "CREATE TABLE t (a STRING) USING DELTA PARTITIONED BY (a)"), ("oracle", "select a.b - c.d as e from x a left join y c on a.k = c.k where a.z between 1 and 2 and c.q is not null"),
    ("snowflake", "select a, row_number() over (partition by b order by c desc) rn from t qualify rn = 1"), ("sqlserver", "with a as (select 1 as x) select top 5 * from a order by x"), ("oracle", "merge into t using s on (t.a = s.a) when matched then update set b = s.b when not matched then insert (a) values (s.a)"),
    ("redshift", "insert into t (a) values ('>>>>>>> main'), ('((')"), ("snowflake", "update t set a = case when b > 1 then 'x' else 'y' end where c in (select d from e); delete from t where a = 1"), ("redshift", ""), ("redshift", "-- only a comment"),
    ("databricks", "select count(distinct a), cast(b as decimal(10,2)), extract(year from c), a::int from t group by 1 having count(*) > 1 order by 1 desc limit 5"), ("redshift", "create table t (a wibble(3) not null)"), (None, "select [a], `b`, \"c\" from t"), ("oracle", "ｓｅｌｅｃｔ a from t"),
    ("snowflake", "create or replace procedure p() returns int language sql as $$ begin select 1; select 2; end $$"), ("sqlserver", "select a from t;\nGO\nselect b from t"),
]
BAD = [
    ("redshift", "CREATE TABLE a (b INT, c"), ("redshift", "SELECT a.b, c FROM t WHERE x ="), ("redshift", "NOT NULL, b INT);"), ("snowflake", "create view v as"), ("snowflake", "select a.b, a.c"), ("oracle", "select a from t join u b on"),
    ("oracle", "with a as (select 1 as x)"), ("bigquery", "select \"a\" as \"b\" from \"t\""), ("snowflake", "select [a] from [t]"), ("sqlserver", "select `a` from t"), ("redshift", "select a\n<<<<<<< ours\n, b\n=======\n, c\n>>>>>>> theirs\nfrom t"),
    ("redshift", "diff --git a/x b/x\n@@ -1,1 +1,2 @@\n-    a int,\n+    b int,"), ("redshift", "def f(x):\n    return x"), ("redshift", '{"a": 1}'), ("redshift", "# title\n\n* a: b"), ("redshift", "insert into t (a, b)"), ("redshift", "select 'abc from t"), ("redshift", "/* open select 1"),
]


GOOD += [
    ("sqlserver","SELECT a FROM t WITH (NOLOCK) WHERE b = 1"),("sqlserver","select a from t x with (nolock) join u with (nolock) on x.a = u.b"),
    ("sqlserver","select * from (select a, b from t) s pivot (sum(a) for b in ([x],[y])) as p"),("snowflake","select * from t pivot(sum(a) for b in ('x','y')) p"),("sqlserver","select k, v from t unpivot (v for k in (a, b)) u"),
    ("oracle","select a, level from t start with b is null connect by prior a = b order by level"),("oracle","select a from t connect by nocycle prior a = b"),
    ("snowflake","select f.value from t, lateral flatten(input => t.v) f"),("snowflake","select * from t, table(flatten(input => v, path => 'a'))"),
    ("oracle","select * from t match_recognize (partition by a order by b measures first(x.c) as d one row per match pattern (x y+) define y as y.c > 1) m"),
    ("redshift","select a, count(*) from t group by grouping sets ((a), ())"),("snowflake","select a, b, count(*) from t group by rollup(a, b)"),("sqlserver","select a from t group by a with rollup"),
    ("bigquery","select * except (a) from t"),("snowflake","select * exclude (a) from t"),("bigquery","select t.* replace (1 as a) from t"),
    ("bigquery","select ARRAY[1,2], [1,2,3] from t"),("snowflake","select a from t where b = :p1"),("redshift","select a from t where b = $1"),("oracle","select a from t where b > any (select c from d)"),("oracle","select a from t where b > all (1, 2)"),
    ("sqlserver","insert into t (a) output inserted.a values (1)"),("sqlserver","update t set a = 1 output inserted.a, deleted.a where b = 2"),("sqlserver","delete from t output deleted.* where a = 1"),
    ("sqlserver","select a from t for xml path('x'), root('y')"),("sqlserver","select a from t for json auto"),("sqlserver","select a at time zone 'UTC' as x from t"),("snowflake","select last_value(a ignore nulls) over (partition by b order by c) from t"),("redshift","select first_value(a) ignore nulls over (order by b rows between unbounded preceding and current row) from t"),
    ("oracle","select q'[abc]' from dual"),("sqlserver","create or alter view v as select 1 as a"),("sqlserver","create view v with schemabinding as select a from dbo.t"),("oracle","create table t (a date) partition by range (a) (partition p1 values less than (to_date('2020','yyyy')), partition p2 values less than (maxvalue))"),
    ("redshift","with c as (select 1 as a) delete from t using c where t.a = c.a"),("sqlserver","with c as (select 1 as a) update t set a = c.a from c"),("sqlserver","SELECT a FROM t\nGO\nSELECT b FROM u\ngo\n"),("oracle","select a from t\n/\nselect b from u\n/"),("snowflake","SELECT $$a;b(c$$ FROM t"),
    ("snowflake","create procedure p() returns int language sql as begin if (1=1) then select 1; end if; for x in (select 1) do select 2; end for; return 1; end"),("oracle","create or replace procedure p (a in number) is b number; begin select 1 into b from dual; if b > 1 then null; end if; end;"),
    ("sqlserver","create procedure p @a int as begin try select 1; end try begin catch begin tran; select case when 1=1 then 2 end; rollback tran; end catch"),("sqlserver","create table t (a int); \nGO\ncreate proc p as select 1;\nGO\n"),
    ("redshift","drop table if exists a.b cascade"),("redshift","grant select on t to group g"),("redshift","alter table t add column c int"),("sqlserver","exec p 1, 'x'"),("snowflake","truncate table t"),("snowflake","truncate t"),("databricks","optimize t zorder by (a)"),("redshift","alter table t rename to u"),("snowflake","use database d"),
    ("snowflake","select a from t qualify row_number() over (partition by b order by c) = 1"),("bigquery","select array_agg(distinct a ignore nulls order by a limit 3) from t"),("databricks","create table t (a map<string, array<struct<x: int, y: string>>>) using delta"),("redshift","select a from t where b < c and d > e"),("sqlserver","create table t (a int, b as (a + 1) persisted)"),
    ("redshift","select sum(a) over (partition by b order by c rows between 6 preceding and current row) from t"),("redshift","insert into t default values"),("oracle","select a from t order by b fetch first 5 rows only"),
]
BROKEN_OFF = [
    "ALTER TABLE t ADD COLUMN","DROP TABLE","GRANT SELECT ON","EXEC","CREATE PROCEDURE p AS BEGIN SELECT a FROM","alter table","truncate","create procedure p as begin select a from t; select 1 where; end","create procedure p as begin select 1;","create function f","drop view","select a from t where b between 1 and","create table t (a int) partition by","select a from t pivot (sum(a) for b in","insert into t","with c as (select 1) delete","grant select","create or replace","select sum(a) over (order by","merge into t using s on t.a = s.a","update t set","delete from","create table t",
]


@pytest.mark.parametrize("sql", BROKEN_OFF)
@pytest.mark.parametrize("dialect", ["redshift", "sqlserver", "oracle", "databricks"])
def test_a_missing_part_is_found(dialect, sql):
    assert not g.is_well_formed(sql, dialect)


@pytest.mark.parametrize("dialect,sql", GOOD)
def test_parses(dialect, sql):
    assert g.is_well_formed(sql, dialect)


@pytest.mark.parametrize("dialect,sql", BAD)
def test_does_not_parse(dialect, sql):
    assert not g.is_well_formed(sql, dialect)


_SCRIPTS = st.lists(st.sampled_from(["a", "'", '"', "`", "[", "]", "-", "--", "/", "*", ";", "(", ")", "\n", " ", "$$", "\nGO\n", "\n/\n", " go ", "select a from t", "\\", "\r", "begin", "end", "create procedure p as"]), max_size=60).map("".join)


@given(_SCRIPTS, st.sampled_from(["double", "bracket", "tick", "any"]), st.integers(20, 60))
@settings(max_examples=400, deadline=None)
def test_state_maps_compose(text, family, size):
    parts = g.chunks(text, size)
    assert "".join(parts) == text
    if parts:
        m = g.state_map(parts[0], family)
        for p in parts[1:]:
            m = g.compose(m, g.state_map(p, family))
        assert m == g.state_map(text, family)
    whole = g.Run(text, family, True, 1 << 20)
    run = g.Run(text, family, True, size)
    assert run.map == whole.map and run.pieces() == whole.pieces()
    halves = g.chunks(text, 3 * size)
    maps, state, pieces = None, "C", [""]
    for k, h in enumerate(halves):
        r = g.Run(h, family, k == 0, size)
        maps = r.map if k == 0 else g.compose(maps, r.map)
        first, *rest = r.pieces(state)
        pieces = [*pieces[:-1], pieces[-1] + first, *rest]
        state = maps["exits"][0]
    assert not halves or maps == whole.map and pieces == whole.pieces()


@given(_SCRIPTS, st.sampled_from([None, "oracle", "sqlserver", "bigquery", "snowflake"]), st.integers(20, 60))
@settings(max_examples=200, deadline=None)
def test_the_verdict_does_not_depend_on_the_chunk(text, dialect, size):
    assert g.is_well_formed(text, dialect, size) == g.is_well_formed(text, dialect, 1 << 20)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_item_once_and_fits(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    counts = {x: r.randint(1, 9) for x in r.sample(range(1, capacity + 1), min(20, capacity))}
    used = dict.fromkeys(counts, 0)
    for combo, n in plan(counts, capacity):
        assert n > 0 and sum(combo) <= capacity
        for x in combo:
            used[x] += n
    assert used == counts


def test_plan_finds_exact_fits():
    assert len(plan({60: 5, 40: 5}, 100)) == 1 and sum(n for _, n in plan({50: 2, 30: 2, 20: 2}, 100)) == 2
    assert plan({}, 10) == []


def test_budget_goes_to_siblings_first():
    root = Node("r", 1, children=[Node("a", 0.5, children=[Node("a1", 1, 10), Node("a2", 1, 100)]), Node("b", 0.5, children=[Node("b1", 1, 30)])])
    rest = distribute(root, 100)
    given = {x.name: x.given for c in root.children for x in c.children}
    assert given == {"a1": 10.0, "a2": 60.0, "b1": 30.0} and abs(rest) < 1e-6


@pytest.mark.parametrize("read", SINGLE)
def test_undo_brings_the_text_back(read):
    for text in ("Grüße", "déjà"):
        try:
            seen = text.encode("utf-8").decode(read)
        except UnicodeDecodeError:
            continue
        assert undo(seen, "utf-8", read) == text
    assert undo("日本", "utf-8", read) is None

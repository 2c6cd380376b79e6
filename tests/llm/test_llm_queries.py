"""Every query of the subpackage runs; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

from dialecta.llm.queries import QUERIES, SQL
from dialecta.llm.textforms import canonical_glyphs, copy_form, word_set
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = c.execute(SQL[name])
        names = [x[0] for x in r.description]
        want = sorted((tuple(row[names.index(x)] for x in df.columns) for row in r.fetchall()), key=repr)
        assert sorted(map(tuple, rows), key=repr) == want
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))


def test_columns():
    assert sorted(n for n in QUERIES if n.endswith("_found")) == [f"p{k}_found" for k in (1, 2, 4, 5, 6, 7, 8, 9)]


def _jaccard_pairs(sets, least):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_pairs_of_the_smallest_data_against_brute_force(spark):
    c = duckdb.connect()
    texts = dict(c.execute(f"select distinct request_id, sql from '{DATA}/transpile_requests.parquet' where sql is not null").fetchall())
    looks, copies = ({i: f(t) for i, t in texts.items()} for f in (canonical_glyphs, copy_form))
    want = {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and looks[a] == looks[b]}
    assert set(map(tuple, QUERIES["p5_found"](spark, DATA).collect())) == want and want
    groups = {}
    for i in sorted(texts):
        groups.setdefault(copies[i], []).append(i)
    assert set(map(tuple, QUERIES["p6_found"](spark, DATA).collect())) == {(g[0], i) for g in groups.values() for i in g[1:]}
    similar = _jaccard_pairs({i: word_set(t) for i, t in texts.items()}, 0.7)
    want = {("request", a, b) for a, b in similar if copies[a] != copies[b] and looks[a] != looks[b]}
    columns = c.execute(f"select table_id, any_value(columns) from '{DATA}/ir_tables.parquet' group by 1").fetchall()
    entries = {i: {((x["name"] or "").lower(), (x["data_type"] or {}).get("generic_type") or "") for x in cols or []} for i, cols in columns}
    want |= {("ir_table", a, b) for a, b in _jaccard_pairs(entries, 0.7)}
    assert set(map(tuple, QUERIES["p2_found"](spark, DATA).collect())) == want
    grouped = {(r.record_kind, r.record_id) for r in QUERIES["p2_groups"](spark, DATA).collect()}
    assert grouped == {(kind, i) for kind, a, b in want for i in (a, b)}


def test_fill_never_exceeds_the_capacity(spark):
    r = QUERIES["p7_fill"](spark, DATA).first()
    capacity = duckdb.execute(f"select capacity_tokens from '{DATA}/container_specs.parquet'").fetchone()[0]
    assert r.fullest <= capacity and r.n_containers >= -(-r.n_tokens // capacity) and r.fill_rate > 0.9

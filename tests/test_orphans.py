import datetime as dt
import random

import pytest

from dialecta.operators import orphans

T = "table_id long, repo string, database_name string, schema_name string, name string, registered_at timestamp_ntz, dropped_at timestamp_ntz, fk_id string"
K = "fk_id long, table_id long, ref_table string, ref_schema string, declared_at timestamp_ntz, name string"
S = "shared_id long, schema_name string, name string, registered_at timestamp_ntz, dropped_at timestamp_ntz"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, tables, keys, shared=()):
    t = spark.createDataFrame([(i, "r", db, s, n, a, b, "clash") for i, db, s, n, a, b in tables], T)
    k = spark.createDataFrame([(i, tid, rt, rs, at, "clash") for i, tid, rt, rs, at in keys], K)
    return {r.fk_id: r.reason for r in orphans.orphans(k, t, spark.createDataFrame(list(shared), S)).collect()}


@pytest.fixture(params=[(10_000, "true"), (3, "false"), (1, "false"), (7, "true")])
def borders(request, spark):
    """Batches and ranges of few rows, so that keys go on over their borders."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")
    for n, v in zip(names, request.param):
        spark.conf.set(n, v)
    yield
    for n in names:
        spark.conf.unset(n)


def test_cases(spark, borders):
    tables = [
        (1, "d", "s", "Home", day(0), None), (2, "d", "s", "gone", day(0), day(5)), (3, "d", "s", "late", day(50), None), (4, "d", None, "bare", day(0), None),
        (5, "d", "s", "again", day(0), day(5)), (6, "d", "s", "AGAIN", day(20), None), (7, "e", "s", "other", day(0), None), (1, "d", "s", "Home", day(0), None), (8, "d", "s", None, day(0), None),
    ]
    keys = [
        (1, 1, '"HOME" ', "s", day(1)), (2, 1, "gone", "s", day(1)), (3, 1, "late", "s", day(1)), (4, 1, "nowhere", "s", day(1)), (5, 4, "bare", None, day(1)), (6, 1, "[s].[again]", "", day(2)),
        (7, 1, "again", "s", day(10)), (8, 1, "again", None, day(30)), (9, 1, "other", "s", day(1)), (10, 1, "cal", "c", day(1)), (11, 99, "Home", "s", day(1)), (12, 1, None, None, day(1)), (13, 1, "home", "s", None), (1, 1, '"HOME" ', "s", day(1)),
    ]
    got = run(spark, tables, keys, [(1, "C", "CAL", day(0), None)])
    assert got == {2: "dropped", 3: "late", 4: "missing", 7: "late", 9: "missing", 11: "missing", 12: "missing", 13: "late"}


def test_hot_parent_and_empty(spark, borders):
    tables = [(i, "d", "s", f"t{i % 7}", day(i % 5), None) for i in range(100)]
    keys = [(i, 1, "t1" if i % 3 else f"x{i}", "s", day(9)) for i in range(600)]
    assert set(run(spark, tables, keys)) == {i for i in range(600) if i % 3 == 0}
    assert run(spark, [], [(1, 1, "a", "s", day(1))]) == {1: "missing"} and run(spark, tables, []) == {}


def test_against_brute_force(spark, borders):
    r = random.Random(4)
    names = ["hot"] * 6 + [f"n{i}" for i in range(6)]
    tables = [(i, r.choice("de"), r.choice(["s", None]), r.choice(names), day(a := r.randint(0, 60)), day(a + r.randint(0, 20)) if r.random() < 0.8 else None) for i in range(120)]
    keys = [(i, r.randint(0, 119), r.choice([*names, "none"]), r.choice(["s", None]), day(r.randint(0, 80))) for i in range(300)]
    by_id = {t[0]: t for t in tables}
    want = {}
    for fk, tid, name, schema, at in keys:
        db, own = by_id[tid][1], by_id[tid][2]
        same = [t for t in tables if t[1] == db and t[2] == (schema or own) and t[3] == name]
        existed, lives = any(t[4] <= at and (t[5] is None or t[5] > at) for t in same), any(t[5] is None for t in same)
        if not (existed and lives):
            want[fk] = "missing" if not same else "late" if not existed else "dropped"
    assert run(spark, tables, keys) == want and len(set(want.values())) == 3

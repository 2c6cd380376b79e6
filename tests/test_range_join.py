"""join_range against its SQL over odd prices, and over a table with more pairs than can be made one by one."""

import math
import random
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from dialecta import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def found(spark, tmp_path, keys, brands, prices) -> tuple[list, list]:
    f = tmp_path / "part.parquet"
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_brand": pa.array(brands, pa.string()), "p_retailprice": pa.array(prices, pa.float64())}), f)
    want = duckdb.connect().execute(f"WITH part AS (SELECT * FROM '{f}') {SQL['join_range']}").fetchall()
    return sorted(map(tuple, QUERIES["join_range"](spark, str(tmp_path)).collect()), key=repr), sorted(want, key=repr)


def test_odd_prices(spark, tmp_path):
    rng = random.Random(3)
    near = [x for k in (-64, -50, 0, 14, 50, 64, 100, 114, 128, 6400, 6450) for x in (float(k), math.nextafter(k, math.inf), math.nextafter(k, -math.inf))]
    far = [s * x for s in (1, -1) for x in (1e-300, 2.0**53, 2.0**53 + 50, 2.0**59, 2.0**59 - 64, 2.0**69, 5e20, 6e20, 1e300, math.inf)]
    prices = [*near, *far, -0.0, math.nan, None, *(rng.uniform(-200, 200) for _ in range(300)), *(rng.randrange(-20000, 20000) / 100 for _ in range(300))] * 2
    brands = [rng.choice(["a", "a", "b", None]) for _ in prices]
    keys = [rng.choice([None, *range(900)]) for _ in prices]
    got, want = found(spark, tmp_path, keys, brands, prices)
    assert got == want and len(want) > 400


def test_pairs_are_not_made(spark, tmp_path):
    n = 120_000
    pq.write_table(pa.table({"p_partkey": range(n), "p_brand": ["a"] * n, "p_retailprice": [i / 2500 for i in range(n)]}), tmp_path / "part.parquet")
    began = time.time()
    got = QUERIES["join_range"](spark, str(tmp_path)).toPandas()
    assert time.time() - began < 20
    assert (got.n_cheaper == got.p_partkey).all() and len(got) == n - 1  # 7.2 billion pairs

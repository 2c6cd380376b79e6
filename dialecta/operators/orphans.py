"""Problem 3: references to records that do not exist.

Parents and references are range-partitioned together by (key, time). Within a
range, batch by batch, the parents are sorted arrays: key, start, running
latest end of the key, and whether the key lives on; the references of the
batch are probed with one vectorised binary search. A key that begins in one
range and goes on in others is settled from one row per range.

A reference is fine when a parent of its key existed at its time and some
parent of the key has no end. Shared parents are looked up beside a
reference's own key; both conditions hold over the union of the two.

Defined results: a reference without key or time is an orphan; a parent without
start never existed at any time but may live on; ends before starts match
nothing; records delivered twice count once; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialecta.tables import shipped, written

_NEVER = (1 << 62) - 1
_KEY_ROW, _NO_TIME = -(1 << 62), -(1 << 61)  # before all times


def bare_name(c: Column) -> Column:
    """A name without outer blanks, quotes and brackets, in lower case; null where nothing is left."""
    v = F.lower(F.trim(F.regexp_replace(F.trim(c), r"^[\s\[\"`']+|[\s\]\"`']+$", "")))
    return F.when(v != "", v)


def name_parts(c: Column) -> tuple[Column, Column]:
    """(schema or null, name) of a possibly qualified, possibly quoted name; a leading database is ignored."""
    parts = F.split(c, r"\.(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)(?![^\[]*\])")
    return bare_name(F.try_element_at(parts, F.lit(-2))), bare_name(F.element_at(parts, -1))


def key_of(*parts: Column) -> Column:
    """One comparable string; nulls match each other."""
    return F.concat_ws("\u0001", *(F.coalesce(p, F.lit("\u0002")) for p in parts))


_PROBED = "part int, ref long, at long, exists_then boolean, lives boolean, known boolean, open boolean, first_key string, last_key string, last_end long"
_PROBED_ARROW = pa.schema(
    [("part", pa.int32()), ("ref", pa.int64()), ("at", pa.int64())] + [(n, pa.bool_()) for n in ("exists_then", "lives", "known", "open")] + [("first_key", pa.string()), ("last_key", pa.string()), ("last_end", pa.int64())]
)


def _running_ends(code: np.ndarray, end: np.ndarray, first: int) -> np.ndarray:
    """Latest end so far of each row's key, for sorted parents; ``first`` is what the first key had before."""
    ranks, rank = np.unique(np.append(end, [first, _KEY_ROW]), return_inverse=True)
    rank, before = rank[:-2], rank[-2]
    rank = np.where(code == 0, np.maximum(rank, before), rank)
    return ranks[np.maximum.accumulate(code * len(ranks) + rank) - code * len(ranks)]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of rows (part, key, at, kind, end, ref), sorted by key, at and kind, batch by batch.

    Per batch the parents are a sorted array and all references are found in it by one vectorised binary search;
    of the key that goes on, the latest end travels to the next batch. A reference to a key that began in an
    earlier range is left open, and the last row tells later ranges what they need to know of this one.
    """
    part, first_key, key = None, None, None
    end_, lives_, known_, begun = _KEY_ROW, False, False, False
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys = b.column(1)
        at, kind, end, ref = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
        head = keys[0].as_py()
        if part is None:
            part, first_key = b.column(0)[0].as_py(), head
        elif head != key:
            begun = True
        if head != key:
            end_, lives_, known_ = _KEY_ROW, False, False
        new = np.zeros(n, bool)
        new[1:] = ~pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        code = np.cumsum(new)
        lives, known = np.zeros(code[-1] + 1, bool), np.zeros(code[-1] + 1, bool)
        lives[0], known[0] = lives_, known_
        own = np.flatnonzero(kind == 0)
        known[code[own]], lives[code[own]] = True, end[own] == _NEVER
        parents, refs = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        ends = _running_ends(code[parents], end[parents], end_)
        if len(refs):
            near = np.searchsorted(parents, refs, side="right") - 1
            hit = near >= 0
            hit[hit] = code[parents[near[hit]]] == code[refs[hit]]
            latest = np.where(code[refs] == 0, end_, _KEY_ROW)
            latest[hit] = ends[near[hit]]
            whole = known[code[refs]] | (code[refs] > 0) | begun
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(refs), part, np.int32)), pa.array(ref[refs].astype(np.int64)), pa.array(at[refs])]
                + [pa.array(x) for x in (latest > at[refs], lives[code[refs]], known[code[refs]], ~whole)] + [pa.nulls(len(refs), pa.string())] * 2 + [pa.nulls(len(refs), pa.int64())],
                schema=_PROBED_ARROW,
            )
        last = code[-1]
        mine = np.flatnonzero(code[parents] == last)
        end_ = int(ends[mine[-1]]) if len(mine) else end_ if last == 0 else _KEY_ROW
        key, lives_, known_, begun = keys[n - 1].as_py(), bool(lives[last]), bool(known[last]), begun or last > 0
    if part is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "lives": lives_, "known": known_, "first_key": first_key, "last_key": key, "last_end": end_}], _PROBED_ARROW)


def probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref, exists_then, lives, known) for references (ref, key, at) to parents (key, start, end); null ends never come.

    Parents and references are range-partitioned together by (key, time), so no boundary leaves the executors and a
    key that many refer to spreads over ranges. Each key also has a row of its own at its beginning, which tells
    whether some parent of it lives on.
    """
    p = parents.select("key", F.coalesce("start", F.lit(_NEVER)).alias("at"), F.coalesce("end", F.lit(_NEVER)).alias("end")).distinct()
    none = F.lit(None).cast("long").alias("ref")
    own = p.groupBy("key").agg(F.max("end").alias("end")).select("key", F.lit(_KEY_ROW).alias("at"), F.lit(0).alias("kind"), "end", none)
    rows = own.unionByName(p.select("key", "at", F.lit(1).alias("kind"), "end", none))
    rows = rows.unionByName(references.select("key", F.coalesce("at", F.lit(_NO_TIME)).alias("at"), F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("end"), "ref"))
    ranged = rows.repartitionByRange("key", "at", "kind", "ref").sortWithinPartitions("key", "at", "kind", "ref")
    scanned = ranged.select(F.spark_partition_id().alias("part"), "key", "at", "kind", "end", "ref").mapInArrow(_probe, _PROBED)
    probed = written(scanned, "probed")
    # what is known of the key that a range begins with: one row per range
    ranges = probed.where("ref is null")
    so_far = Window.partitionBy("last_key").orderBy("part")
    ranges = ranges.select("part", "first_key", "last_key", *(F.max(c).over(so_far).alias(c) for c in ("last_end", "lives", "known")))
    before = Window.orderBy("part")
    held = ranges.select("part", (F.lag("last_key").over(before) == F.col("first_key")).alias("same"), *(F.lag(c).over(before).alias(f"held_{c}") for c in ("last_end", "lives", "known"))).where("same")
    done = probed.where("ref is not null and not open").select("ref", "exists_then", "lives", "known")
    open_ = probed.where("ref is not null and open").join(F.broadcast(held), "part", "left").na.fill(False, ["held_lives", "held_known"])
    return done.unionByName(open_.select("ref", (F.col("exists_then") | F.coalesce(F.col("held_last_end") > F.col("at"), F.lit(False))).alias("exists_then"), F.col("held_lives").alias("lives"), F.col("held_known").alias("known")))


def orphans(fks: DataFrame, tables: DataFrame, shared: DataFrame) -> DataFrame:
    """(fk_id, table_id, declared_at, reason) of every foreign key without a proper target.

    reason: ``missing`` (no table of the name at all), ``late`` (none existed
    when the key was declared), ``dropped`` (it existed, none is left).
    """
    t = shipped(tables).select("table_id", F.col("database_name").alias("db"), F.col("schema_name").alias("sch"), F.col("name").alias("tab"), "registered_at", "dropped_at").dropDuplicates(["table_id"])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = (micros("registered_at").alias("start"), micros("dropped_at").alias("end"))
    own = t.where("tab is not null").select(key_of(F.col("db"), bare_name(F.col("sch")), bare_name(F.col("tab"))).alias("key"), *span)
    everywhere = shared.select(key_of(F.lit("\u0003"), bare_name(F.col("schema_name")), bare_name(F.col("name"))).alias("key"), *span)
    inner_schema, name = name_parts(F.col("ref_table"))
    f = fks.select("fk_id", "table_id", "declared_at", inner_schema.alias("s1"), bare_name(F.col("ref_schema")).alias("s2"), name.alias("n")).dropDuplicates(["fk_id"])
    f = f.join(t.select("table_id", "db", bare_name(F.col("sch")).alias("s3")), "table_id", "left").withColumn("s", F.coalesce("s1", "s2", "s3"))
    f = written(f.select("fk_id", "table_id", "declared_at", "db", "s", "n"), "references")
    ref = F.col("fk_id").alias("ref")
    at = F.unix_micros(F.col("declared_at").cast("timestamp")).alias("at")
    keys = f.where("n is not null").select(ref, key_of(F.coalesce("db", F.lit("\u0004")), F.col("s"), F.col("n")).alias("key"), at)
    keys = keys.unionByName(f.where("n is not null").select(ref, key_of(F.lit("\u0003"), F.col("s"), F.col("n")).alias("key"), at))
    seen = probe(keys, own.unionByName(everywhere)).groupBy("ref").agg(F.max("exists_then").alias("then_"), F.max("lives").alias("lives"), F.max("known").alias("known"))
    judged = f.join(seen.withColumnRenamed("ref", "fk_id"), "fk_id", "left").na.fill(False, ["then_", "lives", "known"])
    reason = F.when(~F.col("known"), "missing").when(~F.col("then_"), "late").otherwise("dropped")
    return judged.where("not (then_ and lives)").select("fk_id", "table_id", "declared_at", reason.alias("reason"))


def orphan_report(found: DataFrame) -> DataFrame:
    """(table_id, period, reason, n_orphans): counts per declaring table and month."""
    period = F.date_format("declared_at", "yyyy-MM").alias("period")
    return found.groupBy("table_id", period, "reason").agg(F.count("*").alias("n_orphans"))

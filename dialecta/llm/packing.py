"""Problem 7: filling fixed-capacity containers with items.

The plan depends only on how many items of each length there are, so the driver
sees one counter per length (at most ``capacity``). Exact-complement hashing:
lengths that fill a container alone, then pairs and triples whose lengths add up
exactly, found by looking up the complement of a sum among the lengths still
available, each combination used as often as its counts allow; what is left is
placed best-fit, longest first. Items are then matched with the places of the
plan by their rank among the items of their length, in parallel.

An item longer than the capacity is split into full pieces and a rest; no other
item is split.

Defined results: items without tokens share container 0; null texts count as
empty; ties are broken by id; a record delivered twice counts once (ids are
unique); extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialecta.llm.tokens import DEFAULT_TOKENIZER, token_counts
from dialecta.tables import written

BLOCKS = 256  # shares in which the items of one length are ranked


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one container, number of such containers) for the given number of items per length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], n: int) -> None:
        if n > 0:
            out.append((combo, n))
            for x in combo:
                left[x] -= n

    use((capacity,), int(left[capacity]))
    for a in range(capacity - 1, (capacity + 1) // 2 - 1, -1):  # pairs: the complement of each length
        b = capacity - a
        if b > 0 and left[a] and left[b]:
            use((a, b), int(min(left[a], left[b]) if a != b else left[a] // 2))
    have = np.flatnonzero(left[:-1])
    for a in have[::-1].tolist():  # triples: the complement of each remaining pair sum
        if not left[a] or not 0 < a <= capacity - 2:
            continue
        rest = capacity - a
        have = have[left[have] > 0]
        b = have[(have <= min(a, rest - 1)) & (have >= (rest + 1) // 2)][::-1]
        for x in b[left[rest - b] > 0].tolist():
            y = rest - x
            need = {z: (a, x, y).count(z) for z in (a, x, y)}
            use((a, x, y), min(int(left[z]) // k for z, k in need.items()))
            if not left[a]:
                break
    # best fit, longest first; open containers of one kind stay together
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(capacity + 1, bool)

    def keep(combo: tuple[int, ...], n: int, free: int) -> None:
        open_.setdefault(free, []).append((combo, n))
        room[free] = True

    for a in np.flatnonzero(left)[::-1].tolist():
        if a == 0:
            continue
        n = int(left[a])
        while n:
            free = a + int(np.argmax(room[a:]))
            if room[free]:
                combo, have = open_[free].pop()
                if not open_[free]:
                    room[free] = False
                take = min(n, have)
                if have > take:
                    keep(combo, have - take, free)
                keep((*combo, a), take, free - a)
                n -= take
            else:
                each = capacity // a
                full, rest = divmod(n, each)
                if full:
                    keep((a,) * each, full, capacity - each * a)
                if rest:
                    keep((a,) * rest, 1, capacity - rest * a)
                n = 0
    out.extend(x for kinds in open_.values() for x in kinds)
    return out


def _places(containers: list[tuple[tuple[int, ...], int]], first_id: int):
    """Sorted arrays (length, first rank, per container, first container) that map ranks to containers."""
    rows, used, at = [], {}, first_id
    for combo, n in containers:
        for length in set(combo):
            k = combo.count(length)
            start = used.get(length, 0)
            rows.append((length, start, k, at))
            used[length] = start + k * n
        at += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


RANK_BITS = 40  # a rank among the items of one length


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length and rank as one integer; exact for lengths below 2**23."""
    return (length << RANK_BITS) | rank


def _assign(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        key = _key(table[:, 0], table[:, 1])
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            i = np.clip(np.searchsorted(key, _key(length, rank), side="right") - 1, 0, max(0, len(key) - 1))
            container = table[i, 3] + (rank - table[i, 1]) // table[i, 2] if len(table) else np.zeros(len(b), np.int64)
            yield pd.DataFrame({"rid": b["rid"], "piece_no": b["piece_no"], "length": length, "container_id": np.where(length == 0, 0, container)})

    return run


def packed(df: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(rid, piece_no, length, container_id): where every item, or piece of an item too long, goes."""
    if not 0 < capacity < 1 << (63 - RANK_BITS):
        raise ValueError(f"the capacity must be between 1 and {(1 << (63 - RANK_BITS)) - 1}")
    spark = df.sparkSession
    sizes = written(token_counts(df, id_col, text_col, tokenizer=tokenizer), "sizes")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    items = sizes.select("rid", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    items = items.select("rid", "piece_no", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no").cast("long") * capacity).alias("length"))
    items = items.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(BLOCKS)).cast("int"))
    per_block = items.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    table = _places(plan({k: v for k, v in counts.items() if k}, capacity), first_id=1)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most BLOCKS rows
    offsets = per_block.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "block", "offset")
    inside = Window.partitionBy("length", "block").orderBy("rid", "piece_no")
    ranked = items.withColumn("r", F.row_number().over(inside)).join(offsets, ["length", "block"])
    ranked = ranked.select("rid", "piece_no", "length", (F.col("offset") + F.col("r") - 1).alias("rank"))
    return ranked.mapInPandas(_assign(spark.sparkContext.broadcast(table)), "rid long, piece_no int, length long, container_id long")


def fill_report(assigned: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens and the share of room that is used."""
    per = assigned.where("length > 0").groupBy("container_id").agg(F.sum("length").alias("used"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill_rate"),
    )

"""Problem 2: near-duplicate records with small edits.

Records become sets of features. Equal sets collapse to one representative,
then PartEnum finds all pairs of sets with Jaccard similarity of at least
``t``: sets are put in size bands, the feature domain is partitioned by hash,
and every record emits one signature per subset of partitions that two similar
sets of the band must share exactly (pigeonhole over their Hamming distance).

PartEnum alone says nothing where a subset of partitions holds no rare feature
of a record. Such a record also emits its prefix features (the rarest
``n - ceil(t n) + 1``), of which similar sets share one. Two similar sets share
either a telling subset or both emit prefixes, so no link is lost. Bands whose
Hamming bound needs more than ``MAX_SIGNATURES`` signatures (the word sets of
scripts) use prefixes only.

A 112-bit parity sketch and the set's size travel with each signature in two
numbers: the sketch's Hamming distance never exceeds that of the sets, so the
join drops most false candidates before any set is moved (sizes of ``WIDE`` and
more stand for any such size). What remains is verified exactly.

The order of features by frequency comes from a counter table of fixed size
(2**ORDER_BITS), the only thing broadcast; any order gives the same result.

Defined results: null texts and null or empty feature sets have no links;
records delivered twice (same id) count once; null column names or types are
values like any other; columns beside those named are ignored, whatever their
names. Feature codes have 32 bits: a pair is misjudged with a chance of about
1e-6, and only at the very threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialecta.llm.textforms import canonical_glyphs, copy_form, digest, word_set
from dialecta.tables import shipped, written

ORDER_BITS = 18
MAX_SIGNATURES = 16
SKETCH_BITS, WIDE = 112, 65_535
#: A projection tells something if a feature in it has at most this count in the counter table.
RARE = 2_000
#: A prefix feature with a larger count is no signature of its own: it is joined with each later feature of the
#: prefix that is longer by one, as similar sets share two features of those.
HOT = 3_000
#: Records of one feature set beyond which they are spread over salts when pairs are listed.
CROWD, CROWD_SALTS, MAX_CROWDS = 2_000, 32, 1_000

_FEATURES = "rid long, codes array<int>, skey binary, ckey binary, gkey binary"
_FEATURES_ARROW = pa.schema([("rid", pa.int64()), ("codes", pa.list_(pa.int32())), ("skey", pa.binary()), ("ckey", pa.binary()), ("gkey", pa.binary())])


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = xxhash.xxh32_intdigest
    for b in batches:
        codes, skey, ckey, gkey = [], [], [], []
        for text in b.column(1).to_pylist():
            c = np.unique(np.fromiter((code(w) for w in word_set(text)), np.uint32)).view(np.int32)
            codes.append(c)
            skey.append(xxhash.xxh3_128_digest(c.tobytes()))
            ckey.append(digest(copy_form(text)))
            gkey.append(digest(canonical_glyphs(text)))
        flat = pa.array(np.concatenate(codes) if codes else np.empty(0, np.int32))
        offsets = pa.array(np.cumsum([0, *map(len, codes)], dtype=np.int32))
        lists = pa.ListArray.from_arrays(offsets, flat)
        yield pa.RecordBatch.from_arrays([b.column(0), lists, *(pa.array(k, pa.binary()) for k in (skey, ckey, gkey))], schema=_FEATURES_ARROW)


def text_features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, codes, skey, ckey, gkey): word codes, and digests of the word set, copy form and canonical text."""
    base = shipped(df).select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("txt"))
    return base.where("rid is not null and txt is not null").mapInArrow(_text_features, _FEATURES)


def entry_features(df: DataFrame, id_col: str, entries: Column) -> DataFrame:
    """The same for a column of type array<string>; every record is its own copy form and look."""
    codes = F.array_distinct(F.transform(entries, lambda e: F.hash(e)))
    base = df.select(F.col(id_col).cast("long").alias("rid"), F.array_sort(codes).alias("codes")).where("rid is not null and codes is not null")
    own = F.unhex(F.md5(F.col("rid").cast("string")))
    return base.select("rid", "codes", F.unhex(F.md5(F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))))).alias("skey"), own.alias("ckey"), own.alias("gkey"))


# --- signatures -------------------------------------------------------------


def _bands(t: float, top: int) -> list[tuple[int, int]]:
    """Size bands [low, high]: sets of similarity t lie in one band or in neighbours."""
    out, low = [], 1
    while low <= top:
        high = max(low, floor(low / t + 1e-9))
        out.append((low, high))
        low = high + 1
    return out


def _scheme(t: float, low: int, high: int) -> tuple[int, int, int] | None:
    """(n1, n2, k2) of PartEnum for pairs of sets of sizes low..high; None where too many signatures are needed."""
    k = floor((1 - t) / (1 + t) * 2 * high + 1e-9)
    best = None
    for n1 in range(1, k + 2):
        k2 = k // n1
        for n2 in range(k2 + 1, k2 + 4):
            n, share = n1 * comb(n2, k2), low * (n2 - k2) / (n1 * n2)
            if n <= MAX_SIGNATURES and (best is None or (share < 2, n) < best[0]):
                best = (share < 2, n), (n1, n2, k2)
    return best and best[1]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _batch_signatures(rid: np.ndarray, codes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, t: float, hot: int):
    """(row, signature) of all signatures of a batch of non-empty sets, and the two halves of the parity sketch per row."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    row = np.repeat(np.arange(len(rid)), sizes)
    u = codes.view(np.uint32).astype(np.uint64)
    freq = counts[(u & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)]
    bit = _mix(u, 1) % np.uint64(SKETCH_BITS)
    one = np.uint64(1) << (bit & np.uint64(63))
    low = np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), starts)
    high = np.bitwise_xor.reduceat(np.where(bit >= 64, one, np.uint64(0)), starts)
    high |= np.minimum(sizes, WIDE).astype(np.uint64) << np.uint64(48)

    # the prefix of every record by (count, code); a counter of one has no partner
    order = np.lexsort((u, freq, row))
    place = np.arange(len(row)) - np.repeat(starts, sizes)
    length = sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1
    in_prefix = place < np.repeat(length, sizes)
    fallback = np.zeros(len(rid), bool)

    rows, sigs = [], []
    weight, rare = _mix(u, 2), (freq <= RARE)
    bands = _bands(t, int(sizes.max()))
    bands.append((bands[-1][1] + 1, max(bands[-1][1] + 1, floor((bands[-1][1] + 1) / t + 1e-9))))
    for j, (lo, hi) in enumerate(bands):
        below = bands[j - 1][0] if j else lo
        own = (sizes >= below) & (sizes <= hi)
        if not own.any():
            continue
        scheme = _scheme(t, below, hi)
        if scheme is None:
            fallback |= own
            continue
        n1, n2, k2 = scheme
        part = (_mix(u, 3) % np.uint64(n1 * n2)).astype(np.int64)
        sums = np.zeros((len(rid), n1 * n2), np.uint64)
        tells = np.zeros((len(rid), n1 * n2), bool)
        inside = own[row]
        np.add.at(sums, (row[inside], part[inside]), weight[inside])
        np.logical_or.at(tells, (row[inside], part[inside]), rare[inside])
        at = np.flatnonzero(own)
        for i in range(n1):
            for s, keep in enumerate(combinations(range(n2), n2 - k2)):
                cols = [i * n2 + c for c in keep]
                sig = np.zeros(len(at), np.uint64)
                for c in cols:
                    sig += _mix(sums[at, c], 1000 + c)
                tell = tells[at][:, cols].any(axis=1)
                fallback[at[~tell]] = True
                rows.append(at[tell])
                sigs.append(_mix(sig[tell], 100_000 + j * 1_000 + i * 100 + s))
    f = freq[order]
    wanted = in_prefix & fallback[row] & (f > 1)
    pick = order[wanted & (f <= hot)]
    rows.append(row[pick])
    sigs.append(_mix(u[pick], 7))
    at, longer = np.flatnonzero(wanted & (f > hot)), np.repeat(np.minimum(length + 1, sizes), sizes)
    step = 1
    while len(at):
        at = at[place[at] + step < longer[at]]
        first, second = order[at], order[at + step] if len(at) else at
        rows.append(row[first])
        sigs.append(_mix(_mix(u[first], 8) + u[second], 9))
        step += 1
    return np.concatenate(rows), np.concatenate(sigs), low, high


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = b.column(1)
    return b.column(0).to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _signature_rows(counts_at, t: float, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rid, codes, sizes = _flat(b)
                row, sig, low, high = _batch_signatures(rid, codes, sizes, counts_at.value, t, hot)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (sig.view(np.int64), rid[row], low.view(np.int64)[row], high.view(np.int64)[row])],
                    ["sig", "rid", "p0", "p1"],
                )

    return run


def _counter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for b in batches:
        u = b.column(1).flatten().to_numpy().view(np.uint32)
        total += np.bincount(u & np.uint32((1 << ORDER_BITS) - 1), minlength=1 << ORDER_BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "c"])


def similar_sets(sets: DataFrame, t: float, hot: int = HOT) -> DataFrame:
    """(ra, rb, similarity), ra < rb: all pairs of the given distinct sets (rid, codes) with Jaccard similarity >= t."""
    spark = shipped(sets).sparkSession
    if t <= 0.5:
        hot = 1 << 62  # similar sets may share one feature only, so every prefix feature is a signature by itself
    counted = sets.select("rid", "codes").mapInArrow(_counter_rows, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).where("c > 1").toArrow()
    counts = np.ones(1 << ORDER_BITS, np.int32)
    counts[counted.column("bucket").to_numpy()] = np.minimum(counted.column("c").to_numpy(), 2**31 - 1)
    signatures = sets.select("rid", "codes").mapInArrow(_signature_rows(spark.sparkContext.broadcast(counts), t, hot), "sig long, rid long, p0 long, p1 long")
    a, b = signatures.alias("a"), signatures.alias("b")
    na, nb, mask = "shiftrightunsigned(a.p1, 48)", "shiftrightunsigned(b.p1, 48)", (1 << 48) - 1
    bound = f"floor({(1 - t) / (1 + t)}D * ({na} + {nb}) + 1e-9)"
    apart = f"bit_count(a.p0 ^ b.p0) + bit_count((a.p1 ^ b.p1) & {mask}L)"
    candidates = (
        a.join(b, F.col("a.sig") == F.col("b.sig"))
        .where("a.rid < b.rid")
        .where(f"{na} >= {t}D * {nb} - 1e-9 and {nb} >= {t}D * {na} - 1e-9 or {na} = {WIDE} or {nb} = {WIDE}")
        .where(f"{apart} <= {bound} or {na} = {WIDE} or {nb} = {WIDE}")
        .select(F.col("a.rid").alias("ra"), F.col("b.rid").alias("rb"))
        .distinct()
    )
    left = candidates.join(sets.select(F.col("rid").alias("ra"), F.col("codes").alias("ca")), "ra")
    both = left.join(sets.select(F.col("rid").alias("rb"), F.col("codes").alias("cb")), "rb")
    shared = F.size(F.array_intersect("ca", "cb"))
    return (
        both.select("ra", "rb", shared.alias("i"), (F.size("ca") + F.size("cb")).alias("n"))
        .select("ra", "rb", (F.col("i") / (F.col("n") - F.col("i"))).alias("similarity")).where(F.col("similarity") >= t)
    )


# --- records ----------------------------------------------------------------


def _sets_and_members(features: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    kept = written(features.where("size(codes) > 0"), "features")
    sets = written(kept.groupBy("skey").agg(F.min("rid").alias("rid"), F.first("codes").alias("codes")), "sets")
    members = kept.select("rid", "skey", "ckey", "gkey").distinct().join(sets.select("skey", F.col("rid").alias("rep")), "skey")
    return sets, members.select("rid", "rep", "ckey", "gkey"), kept.count()


def near_duplicate_pairs(features: DataFrame, t: float, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all similar records; copies of each other and look-alikes are left out."""
    sets, members, n_records = _sets_and_members(features)
    pairs = similar_sets(sets, t, hot).select("ra", "rb")
    per_set = members.groupBy("rep").agg(F.min("ckey").alias("lo"), F.max("ckey").alias("hi"), F.count("*").alias("n"))
    varied = per_set.where("lo <> hi")
    links = pairs.unionByName(varied.select(F.col("rep").alias("ra"), F.col("rep").alias("rb")))
    # the records of a set that many share are spread over salts; those they are paired with are repeated to each.
    # Such sets are at most MAX_CROWDS, as the limit rises with the number of records.
    limit = max(CROWD, n_records // MAX_CROWDS)
    many = F.broadcast(written(per_set.where(F.col("n") > limit).select("rep", F.lit(CROWD_SALTS).alias("salts")), "crowds"))
    spread_ = members.join(many, "rep", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = spread_.select(F.col("rep").alias("ra"), F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"), F.col("rid").alias("xa"), F.col("ckey").alias("ca"), F.col("gkey").alias("ga"))
    salted = links.join(many.withColumnRenamed("rep", "ra"), "ra", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    b = members.select(F.col("rep").alias("rb"), F.col("rid").alias("xb"), F.col("ckey").alias("cb"), F.col("gkey").alias("gb"))
    return (
        salted.select("ra", "rb", "salt").join(a, ["ra", "salt"]).join(b, "rb").where("ca <> cb and ga <> gb and (ra <> rb or xa < xb)")
        .select(F.least("xa", "xb").alias("id_a"), F.greatest("xa", "xb").alias("id_b"))
    )


def near_duplicate_groups(features: DataFrame, t: float) -> DataFrame:
    """(record_id, class_id, n_links): one row per record with a similar one.

    class_id is the smallest id of the connected class; n_links counts the
    similar other feature sets that hold a record drawn differently, and the
    records of the same set that are neither copies nor look-alikes (by sums
    over the set's keys, no pair is emitted). A record has a row where
    ``near_duplicate_pairs`` has a pair with it.
    """
    sets, members, _ = _sets_and_members(features)
    looks = written(members.groupBy("rep").agg(F.min("gkey").alias("lo"), F.max("gkey").alias("hi")), "looks")
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo"))  # how all of a set's records are drawn, if alike
    side = lambda r, g: looks.select(F.col("rep").alias(r), one.alias(g))
    edges = similar_sets(sets, t).select("ra", "rb").join(side("ra", "ga"), "ra").join(side("rb", "gb"), "rb")
    edges = written(edges.where(F.coalesce(F.col("ga") != F.col("gb"), F.lit(True))), "edges")
    labels = components(edges.select("ra", "rb"))
    both = edges.select(F.col("ra").alias("rep"), F.col("gb").alias("gkey")).unionByName(edges.select(F.col("rb").alias("rep"), F.col("ga").alias("gkey")))
    degree = both.groupBy("rep").agg(F.count("*").alias("n_sets"))
    alike = both.where("gkey is not null").groupBy("rep", "gkey").agg(F.count("*").alias("n_alike"))
    classed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").join(alike, ["rep", "gkey"], "left")
    cells = members.groupBy("rep", "ckey", "gkey").agg(F.count("*").alias("n_both"))
    alone, by_c, by_g = (cells.groupBy("rep", *k).agg(F.sum("n_both").alias(n)) for k, n in (((), "n_same"), (("ckey",), "n_c"), (("gkey",), "n_g")))
    cells = cells.join(alone, "rep").join(by_c, ["rep", "ckey"]).join(by_g, ["rep", "gkey"]).select("rep", "ckey", "gkey", F.expr("n_same - n_c - n_g + n_both").alias("n_varied"))
    zero = F.lit(0).cast("long")
    n_links = F.coalesce("n_sets", zero) - F.coalesce("n_alike", zero) + F.col("n_varied")
    return (
        classed.join(cells, ["rep", "ckey", "gkey"])
        .select(F.col("rid").alias("record_id"), F.coalesce("class_id", "rep").alias("class_id"), n_links.alias("n_links")).where("n_links > 0")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, class_id) of an undirected edge list (ra, rb): alternating large-star and small-star steps.

    Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain. Only a row count reaches the driver.
    """
    now = edges.select(F.col("ra").alias("u"), F.col("rb").alias("v")).where("u <> v")
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_lows = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_lows, "u")
        now = written(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars"
        )
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == sign:
            break
        sign = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("class_id")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct()
    )

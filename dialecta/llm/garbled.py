"""Problem 9: garbled text from a wrong character encoding.

A code-page swap is a substitution cipher whose key is unknown per passage.
The model is fitted by expectation-maximisation:

* language model: character bigrams per language, mixed with those of all
  languages, hashed into a counter table of fixed size, from all documents;
* candidates: every distinct word outside ASCII is read back under each swap
  once. A reading stays a candidate if it was UTF-8, and else unless its letters are together so much
  rarer in the language than the word's own (``RARER`` nats a letter) that no
  bigrams could make up for it; a word without candidates is right;
* E-step, over the words that have candidates, with their counts: the posterior
  of every reading, and of the word as it is, from the bigram likelihoods and the
  share of the swap in the word's source. Letters that no known swap explains get
  their expected readings from the neighbouring letters.
  The first round gives each word wholly to its likeliest reading, if all its steps are known in the language: where
  a swap is common its letters are as usual as the right ones, and only the majority of the right ones tells them apart.
  The later rounds ask for evidence and weigh by posteriors;
* M-step: swap shares per source, the byte-to-letter table per source and the
  bigram counts, each word counting as its readings by their posteriors.

The letters learned for a source are applied with ``str.translate`` where no
swap fits. Each candidate word is judged once, under the fitted model; documents
are then looked through for judged words only. A document is garbled if a word
gains more than ``SURE_GAIN`` nats when read back, or holds a replacement
character (its text is lost).

Broadcast are the counter table, the swap shares, the learned letters (at most
one per source class and letter of the sources' tables) and a Bloom filter of
the judged words, all of fixed size; when the filter is full, more documents
are looked at, none fewer found.

Defined results: null and ASCII-only texts are never garbled; documents whose
language label is missing or has fewer than ``LEAST_DOCS`` documents get the
language whose bigrams fit best; null sources are a source of their own; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialecta.llm.codepages import readings_of, swaps
from dialecta.tables import spread, written

BITS = 20
BLOOM_BITS = 24
BLOCK = 4096  # bytes of a vector that are reduced together
MIN_GAIN = 1.0  # of a word beside one that is sure
SURE_GAIN = 6.0  # of a word, for a document to be reported
RARER = 1.0  # nats a letter that a candidate's letters may be rarer than the word's own
LEAST_DOCS = 5  # of a language that has bigrams of its own
CHARS = 1 << 20  # characters counted at once
CACHE = 100_000  # words that a task counts before it passes them on
#: Bytes of another table hardly ever happen to be UTF-8, so reading a word back as UTF-8 is evidence by itself;
#: the gain of other swaps is lowered by WEAK.
WEAK = 4.0
PRIOR = 3.0  # nats against a word being garbled at all, while posteriors are weighed; those below 1 % count as none
SOURCE_CLASSES = 4096  # sources share swap shares by hash class, so the broadcast is bounded
ALPHABET = 128  # letters outside ASCII that a single-byte table has at most
SALTS = 8
LEARNED = len(swaps())  # index of the reading with the learned letters
ALL = 0xFFFFFF  # all languages together
_CONTEXT, _SINGLE, _TOTAL = 0x110000, 0x110001, 0x110002
_MASK = np.uint64((1 << BITS) - 1)
#: A run without blanks that holds a character outside ASCII; each run is tried once, from its beginning.
_WORD = re.compile(r"(?<![^\t-\r ])[\x00-\x08\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^\t-\r ]*+")
REPLACEMENT = "�"
_UTF8 = np.array([w == "utf-8" for w, _ in swaps()])


def language(label: str | None) -> int:
    """Code of a language label: its first two letters, 0 for none."""
    s = (label or "").strip().lower()[:2]
    return int.from_bytes(s.encode("utf-8"), "big") if s else 0


def source_class(source: str | None) -> int:
    return xxhash.xxh32_intdigest(source or "") % SOURCE_CLASSES


def _points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots(lang: int, a: np.ndarray, b) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= np.uint64((lang + 1) * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) & _MASK).astype(np.int64)


def _pairs(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, how often) of the distinct steps of a text; ``n`` is the weight of each step."""
    a, b = x[:-1].astype(np.int64), x[1:].astype(np.int64)
    plain = (a | b) < 128
    ascii_ = np.bincount((a[plain] << 7) | b[plain], None if n is None else n[plain], minlength=1 << 14)
    at = np.flatnonzero(ascii_)
    other, place = np.unique((a[~plain] << 21) | b[~plain], return_inverse=True)
    times = np.bincount(place, None if n is None else n[~plain], minlength=len(other))
    return np.concatenate((at >> 7, other >> 21)), np.concatenate((at & 127, other & 0x1FFFFF)), np.concatenate((ascii_[at], times)).astype(np.float64)


def _add(total: np.ndarray, lang: int, text: str, n: np.ndarray | None = None) -> None:
    """Counts the steps of a text of one language."""
    a, b, times = _pairs(_points(text), n)
    for code in (lang, ALL):
        for slots in (_slots(code, a, b), _slots(code, a, _CONTEXT), _slots(code, b, _SINGLE)):
            np.add.at(total, slots, times)
        total[int(_slots(code, np.array([_TOTAL]), _TOTAL)[0])] += times.sum()


class Model:
    """Bigram counts, swap shares per source class, letters learned per source class, frequent languages and their letters."""

    def __init__(self, counts, shares, letters, languages, native):
        self.counts, self.shares, self.letters, self.languages, self.native = counts, shares, letters, languages, native
        self.cache: dict = {}

    def _chances(self, lang: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.counts
        alone = (np.maximum(t[_slots(lang, b, _SINGLE)], 0) + 0.01) / max(1, t[int(_slots(lang, np.array([_TOTAL]), _TOTAL)[0])])
        pairs = np.maximum(t[_slots(lang, a, b)], 0)
        return (pairs + 5 * alone) / (np.maximum(t[_slots(lang, a, _CONTEXT)], pairs) + 5)

    def steps(self, lang: int, text: str) -> np.ndarray:
        """Log-probability of each step from one character to the next, from a blank before to a blank after the text."""
        x = _points(text)
        return np.log(0.9 * self._chances(lang, x[:-1], x[1:]) + 0.1 * self._chances(ALL, x[:-1], x[1:]))

    def sums(self, lang: int, texts: list[str]) -> np.ndarray:
        """Log-probability of each of many words, each between two blanks; and whether the language has all of its steps."""
        ends = np.cumsum([len(z) + 1 for z in texts])
        total = np.concatenate(([0.0], np.cumsum(self.steps(lang, " ".join(texts)))))
        return total[ends] - total[np.concatenate(([0], ends[:-1]))]

    def seen(self, lang: int, texts: list[str]) -> np.ndarray:
        """Whether the language has every step of each word."""
        x = _points(" ".join(texts))
        ends = np.cumsum([len(z) + 1 for z in texts])
        return np.minimum.reduceat(self.counts[_slots(lang, x[:-1], x[1:])], np.concatenate(([0], ends[:-1]))) > 0

    def frequency(self, lang: int) -> tuple[np.ndarray, bool, dict]:
        """Log-frequency of every character of the basic plane in a language, mixed with all languages; whether it
        has ideographs (one character in 10,000); and what ``readings_of`` remembers of it."""
        kept = self.cache.get(lang)
        if kept is None:
            x = np.arange(1 << 16)
            t, p = self.counts, 0.0
            for code, share in ((lang, 0.9), (ALL, 0.1)):
                total = max(1.0, t[int(_slots(code, np.array([_TOTAL]), _TOTAL)[0])])
                p = p + share * (np.maximum(t[_slots(code, x, _SINGLE)], 0) + 0.01) / total
            own = np.maximum(t[_slots(lang, x[0x2E80:0xD7B0], _SINGLE)], 0).sum() > 1e-4 * max(1.0, t[int(_slots(lang, np.array([_TOTAL]), _TOTAL)[0])])
            kept = self.cache[lang] = np.log(p), bool(own), {}
        return kept

    def language_of(self, label: str | None, text: str) -> int:
        code = language(label)
        if code in self.languages or not self.languages:
            return code
        a, b, n = _pairs(_points(text))
        both = self._chances(ALL, a, b)
        return max(self.languages, key=lambda c: (float((n * np.log(0.9 * self._chances(c, a, b) + 0.1 * both)).sum()), c))


# --- vectors added up over all tasks -------------------------------------------

_BLOCKS = "kind long, a long, b long, n double, data binary"
_BLOCKS_ARROW = pa.schema([("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.float64()), ("data", pa.binary())])


def _vector(v: np.ndarray) -> pa.RecordBatch:
    """The blocks of a task's vector that hold anything."""
    rows = v.reshape(-1, BLOCK // v.itemsize)
    at = np.flatnonzero(rows.any(axis=1))
    zero = pa.array(np.zeros(len(at), np.int64))
    return pa.RecordBatch.from_arrays([zero, pa.array(at), zero, pa.array(np.zeros(len(at))), pa.array([rows[i].tobytes() for i in at], pa.binary())], schema=_BLOCKS_ARROW)


def _sparse(kind: int, counter: dict[tuple[int, int], float]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*counter))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int64)), pa.array(a), pa.array(b), pa.array(np.array(list(counter.values()), np.float64)), pa.nulls(len(a), pa.binary())], schema=_BLOCKS_ARROW
    )


def _folded(dtype, op: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, np.ndarray] = {}
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(data, dtype)
                done[at] = op(done[at], v) if at in done else v
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int64()), pa.array([v.tobytes() for v in done.values()], pa.binary())], ["a", "data"])

    return run


def _collected(parts: DataFrame, size: int, dtype, op: Callable = np.add) -> np.ndarray:
    """One vector out of those of all tasks: blocks are shuffled and folded, the driver gets each once."""
    blocks = parts.where("kind = 0").select("a", "data").repartition("a").mapInArrow(_folded(dtype, op), "a long, data binary").toArrow()
    out = np.zeros(size, dtype)
    rows = out.reshape(-1, BLOCK // out.itemsize)
    for at, data in zip(blocks.column("a").to_pylist(), blocks.column("data").to_pylist()):
        rows[at] = np.frombuffer(data, dtype)
    return out


def _few_tasks(df: DataFrame) -> DataFrame:
    """Tasks that hold a vector each are no more than a few a core, however many files there are."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


# --- passes over all documents ------------------------------------------------


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in b.columns))


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of the whole partition (0), documents by language (1) and characters outside ASCII by language (2)."""
    total, docs, chars = np.zeros(1 << BITS), Counter(), Counter()
    held: defaultdict[int, list[str]] = defaultdict(list)

    def flush() -> None:
        for code, texts in held.items():
            text = " ".join(texts)  # the same steps as of each text between two blanks
            _add(total, code, text)
            if not text.isascii():
                x = _points(text)
                u, c = np.unique(x[x > 127], return_counts=True)
                for p, k in zip(u.tolist(), c.tolist()):
                    chars[code, p] += k
        held.clear()

    n = 0
    for b in batches:
        for _, text, label, _ in _rows(b):
            code = language(label)
            docs[code, 0] += 1
            held[code].append(text)
            n += len(text)
            if n > CHARS:
                flush()
                n = 0
    flush()
    yield _vector(total)
    for kind, counter in ((1, docs), (2, chars)):
        if counter:
            yield _sparse(kind, counter)


_WORDS = "lang long, source long, word string, n long"


def _word_pass(shared):
    """(language, source class, word, count) of words outside ASCII, added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = shared.value, Counter()

        def flush() -> pa.RecordBatch:
            lang, source, word = zip(*n)
            out = pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(source, pa.int64()), pa.array(word), pa.array(list(n.values()), pa.int64())], ["lang", "source", "word", "n"])
            n.clear()
            return out

        for b in batches:
            for _, text, label, source in _rows(b):
                lang, sc = model.language_of(label, text), source_class(source)
                for w in _WORD.findall(text):
                    if REPLACEMENT not in w:
                        n[lang, sc, w] += 1
                if len(n) > CACHE:
                    yield flush()
        if n:
            yield flush()

    return run


_CANDIDATES = "lang long, source long, word string, n long, ks array<int>, zs array<string>"
_CANDIDATES_ARROW = pa.schema([("lang", pa.int64()), ("source", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("ks", pa.list_(pa.int32())), ("zs", pa.list_(pa.string()))])


def _candidate_pass(shared):
    """Words that may be garbled, with (swap, text read back) of every reading whose letters are not too rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for lang, sc, word, n in _rows(b):
                freq, ideographs, memory = model.frequency(lang)
                x = _points(word)
                own, foreign = float(freq[np.minimum(x, 0xFFFF)].sum()), int((x > 127).sum())
                ks, zs = [], []
                kept: dict[str, bool] = {}
                for k, z in readings_of(word, freq, RARER, ideographs, memory):
                    if _UTF8[k]:
                        kept[z] = True  # evidence by itself
                    elif z not in kept:
                        x = _points(z)
                        kept[z] = float(freq[np.minimum(x, 0xFFFF)].sum()) - own > -RARER * foreign
                    if kept[z]:
                        ks.append(k)
                        zs.append(z)
                native = model.native.get(lang)
                if ks or native and any(ord(c) > 127 and ord(c) not in native for c in word):
                    out.append((lang, sc, word, n, ks, zs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CANDIDATES_ARROW.types)], schema=_CANDIDATES_ARROW)

    return run


def _scored(model: Model, rows: list[tuple], seed: bool) -> Iterator[tuple[tuple, dict[str, tuple[float, list[int]]]]]:
    """Each row of candidates with text read back -> (gain in nats, swaps), the likeliest text of a swap only.

    A seed asks for no evidence beyond a likelier word all of whose steps the language has.
    """
    by_lang: defaultdict[int, list[tuple]] = defaultdict(list)
    for r in rows:
        by_lang[r[0]].append(r)
    for lang, mine in by_lang.items():
        texts = list(dict.fromkeys(t for r in mine for t in (r[2], *r[5])))
        value = dict(zip(texts, model.sums(lang, texts).tolist()))
        known = dict(zip(texts, model.seen(lang, texts).tolist())) if seed else None
        for r in mine:
            best: dict[int, tuple[float, str]] = {}
            for k, z in zip(r[4], r[5]):
                gain = value[z] - value[r[2]] - (0.0 if seed or _UTF8[k] else WEAK)
                if (known is None or known[z]) and (k not in best or gain > best[k][0]):
                    best[k] = (gain, z)
            out: dict[str, tuple[float, list[int]]] = {}
            for k, (gain, z) in best.items():
                out[z] = (max(gain, out[z][0]) if z in out else gain, [*(out[z][1] if z in out else []), k])
            yield r, out


def _estimate_pass(shared, seed: bool):
    """Expected changes of the model from the candidates: 0 bigram counters, 3 swaps and 4 letters by source class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        change, used, letters = np.zeros(1 << BITS), Counter(), Counter()
        for b in batches:
            moved: defaultdict[int, list[tuple[str, float]]] = defaultdict(list)
            for (lang, sc, w, n, *_), found in _scored(model, list(_rows(b)), seed):
                share = model.shares[sc]
                weight = {z: np.exp(min(50.0, gain + float(share[ks].max()) - PRIOR)) for z, (gain, ks) in found.items()}
                whole = 1.0 + sum(weight.values())  # the word as it is has the weight 1
                if seed:
                    likeliest = max(weight, key=lambda z: (weight[z], z), default=None)
                    weight, whole = ({likeliest: 1.0}, 1.0) if weight and found[likeliest][0] > 0 else ({}, 1.0)
                if not found:
                    _expected_letters(model, lang, sc, w, n, letters)
                for z, x in weight.items():
                    p = n * float(x / whole)
                    if p < 0.01 * n:
                        continue
                    ks = found[z][1]
                    part = np.exp(share[ks] - share[ks].max())
                    for k, y in zip(ks, part / part.sum()):
                        used[sc, k] += p * float(y)
                    moved[lang] += [(w, -p), (z, p)]
                    if len(w) == len(z):
                        for o, c in zip(w, z):
                            if o != c:
                                letters[sc, (ord(o) << 21) | ord(c)] += p
            for lang, items in moved.items():
                _add(change, lang, " ".join(t for t, _ in items), np.repeat([p for _, p in items], [len(t) + 1 for t, _ in items]))
        yield _vector(change)
        for kind, counter in ((3, used), (4, letters)):
            if counter:
                yield _sparse(kind, counter)

    return run


def _expected_letters(model: Model, lang: int, sc: int, word: str, n: int, letters: Counter) -> None:
    """Adds P(letter | neighbours) for every foreign character of a word that no swap explains."""
    native = model.native.get(lang)
    if not native:
        return
    x = _points(word)
    mine = np.array(sorted(native), np.uint32)
    for i in range(1, len(x) - 1):
        o = int(x[i])
        if o > 127 and o not in native and all(int(y) < 128 or int(y) in native for y in (x[i - 1], x[i + 1])):
            t = model.counts
            into = np.maximum(t[_slots(lang, np.full(len(mine), x[i - 1]), mine)], 0) + 0.01
            out = np.maximum(t[_slots(lang, mine, np.full(len(mine), x[i + 1]))], 0) + 0.01
            p = into * out / (np.maximum(t[_slots(lang, mine, _CONTEXT)], 0) + 1.0)
            for c, q in zip(mine.tolist(), (p / p.sum()).tolist()):
                letters[sc, (o << 21) | c] += n * q


def _native(chars: DataFrame, languages: list[int]) -> dict[int, frozenset[int]]:
    """The letters outside ASCII of each language written with an alphabet: those of a share of 0.2 % or more,
    where at most ``ALPHABET`` letters make up nine tenths. (kind 2 rows: language, character, count.)"""
    w = Window.partitionBy("a")
    top = (
        chars.where(F.col("a").isin(languages)).withColumn("share", F.col("n") / F.sum("n").over(w))
        .withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "b"))).where(f"place <= {ALPHABET}").toArrow()
    )
    lang, point, share = (top.column(c).to_numpy() for c in ("a", "b", "share"))
    return {c: frozenset(p for p in point[(lang == c) & (share >= 0.002)].tolist() if chr(p).isalpha()) for c in languages if share[lang == c].sum() >= 0.9}


def fit(docs: DataFrame, rounds: int = 2) -> tuple[Model, Model, DataFrame]:
    """The model before and after fitting, every array in it of a size fixed in advance; and the words with candidates.
    The first decides the language of documents without one, so that it is the same for all passes.

    docs: (rid, txt, lang, source).
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    parts = written(_few_tasks(docs).mapInArrow(_count_pass, _BLOCKS), "counted")
    first_counts = _collected(parts, 1 << BITS, np.float64)
    sums = parts.where("kind > 0").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    frequent = sums.where(f"kind = 1 and a <> 0 and n >= {LEAST_DOCS}").orderBy(F.desc("n"), "a").limit(4096).toArrow()  # a code is two letters
    languages = sorted(frequent.column("a").to_pylist())
    native = _native(sums.where("kind = 2"), languages) if languages else {}
    shares = np.zeros((SOURCE_CLASSES, len(swaps()) + 1), np.float32)
    first = model = Model(first_counts, shares, {}, languages, native)

    outside = docs.where(F.col("txt").rlike(r"[^\x00-\x7f]"))
    at = broadcast(first)
    words = outside.mapInArrow(_word_pass(at), _WORDS).groupBy("lang", "source", "word").agg(F.sum("n").alias("n"))
    candidates = written(spread(words).mapInArrow(_candidate_pass(at), _CANDIDATES), "candidates")
    for k in range(1 + rounds):
        got = written(_few_tasks(spread(candidates)).mapInArrow(_estimate_pass(broadcast(model), k == 0), _BLOCKS), "estimated")
        counts = first_counts + _collected(got, 1 << BITS, np.float64)
        totals = got.where("kind > 0").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        swapped = totals.where("kind = 3").toArrow()  # at most a row per source class and swap
        used = np.ones((SOURCE_CLASSES, len(swaps()) + 1))
        used[swapped.column("a").to_numpy(), swapped.column("b").to_numpy()] += swapped.column("n").to_numpy()
        shares = np.log(used / used.sum(axis=1, keepdims=True) * used.shape[1]).clip(-3, 3).astype(np.float32)
        best = (
            totals.where("kind = 4").groupBy("a", F.shiftright("b", 21).alias("o"))
            .agg(F.max_by(F.expr("b & 2097151"), F.struct("n", "b")).alias("z"), F.max("n").alias("top"), F.sum("n").alias("all")).where("top >= 4 and top > 0.5 * all")
        )
        letters: defaultdict[int, dict[int, str]] = defaultdict(dict)
        for r in best.toArrow().to_pylist():  # one letter per source class and character
            letters[r["a"]][r["o"]] = chr(r["z"])
        model = Model(counts, shares, dict(letters), languages, native)
    return first, model, candidates


_JUDGED = "lang long, source long, word string, ks array<int>, gains array<double>, zs array<string>"
_JUDGED_ARROW = pa.schema([("lang", pa.int64()), ("source", pa.int64()), ("word", pa.string()), ("ks", pa.list_(pa.int32())), ("gains", pa.list_(pa.float64())), ("zs", pa.list_(pa.string()))])


def _judge_pass(shared):
    """The readings by which each candidate word gains under the fitted model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for (lang, sc, w, *_), found in _scored(model, list(_rows(b)), False):
                r = [(k, gain + float(model.shares[sc][k]), z) for z, (gain, ks) in found.items() if gain > MIN_GAIN for k in ks]
                letters = model.letters.get(sc, {})
                if not r and letters and (z := w.translate(letters)) != w:
                    own, read = model.sums(lang, [w, z]).tolist()
                    if read - own > SURE_GAIN:
                        r = [(LEARNED, read - own, z)]
                if r:
                    out.append((lang, sc, w, *map(list, zip(*r))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _JUDGED_ARROW.types)], schema=_JUDGED_ARROW)

    return run


def _bit(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ((1 << BLOOM_BITS) - 1)


def _bloom_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for b in batches:
        at = np.array([_bit(w) for w in b.column(0).to_pylist()], np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield _vector(bits)


_HITS = "rid long, txt string, lost boolean, lang long, source long, words array<string>, ns array<int>"
_HITS_ARROW = pa.schema([("rid", pa.int64()), ("txt", pa.string()), ("lost", pa.bool_()), ("lang", pa.int64()), ("source", pa.int64()), ("words", pa.list_(pa.string())), ("ns", pa.list_(pa.int32()))])


def _hit_pass(shared, filter_):
    """Documents with a word that may be judged garbled, and those with a replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bits = shared.value, filter_.value.tobytes()
        for b in batches:
            out = []
            for rid, text, label, source in _rows(b):
                n = Counter(_WORD.findall(text))
                words = [w for w in n if bits[(h := _bit(w)) >> 3] >> (h & 7) & 1]
                lost = REPLACEMENT in text
                if words or lost:
                    out.append((rid, text, lost, model.language_of(label, text), source_class(source), words, [n[w] for w in words]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _HITS_ARROW.types)], schema=_HITS_ARROW)

    return run


def _readback(found: dict[str, dict[int, tuple[float, str]]]) -> tuple[dict[str, str], int | None]:
    """word -> restored word, and the swap that explains most; it is preferred wherever it gains at all."""
    total: defaultdict[int, float] = defaultdict(float)
    for r in found.values():
        for k, (gain, _) in r.items():
            total[k] += gain
    best = max(total, key=lambda k: (total[k], -k)) if total else None
    out = {}
    sure = any(r.get(best, (0.0,))[0] > SURE_GAIN for r in found.values())
    for w, r in found.items():
        if max(g for g, _ in r.values()) > SURE_GAIN or sure and best in r:
            k = best if best in r else max(r, key=lambda k: (r[k][0], -k))
            out[w] = r[k][1]
    return out, best


_FOUND = "rid long, swap string, n_words int, gain double, restored string, lost boolean"
_FOUND_ARROW = pa.schema([("rid", pa.int64()), ("swap", pa.string()), ("n_words", pa.int32()), ("gain", pa.float64()), ("restored", pa.string()), ("lost", pa.bool_())])


def _restore_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rid, text, lost, words, ns, judged in _rows(b):
            found = {j["word"]: {k: (g, z) for k, g, z in zip(j["ks"], j["gains"], j["zs"])} for j in judged or []}
            back, best = _readback(found)
            if back or lost:
                name = None if best is None else "learned" if best == LEARNED else "{} read as {}".format(*swaps()[best])
                n = dict(zip(words, ns))
                gain = sum(max(g for g, _ in found[w].values()) for w in back)
                restored = _WORD.sub(lambda m: back.get(m.group(0), m.group(0)), text) if back else None
                out.append((rid, name, sum(n[w] for w in back), float(gain), restored, lost))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND_ARROW.types)], schema=_FOUND_ARROW)


def garbled(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(rid, swap, n_words, gain, restored, lost): every garbled document; restored is null where nothing could be read back."""
    docs = df.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("txt"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    docs = docs.where("rid is not null and txt is not null")
    broadcast = docs.sparkSession.sparkContext.broadcast
    first, model, candidates = fit(docs)
    judged = written(spread(candidates).mapInArrow(_judge_pass(broadcast(model)), _JUDGED), "judged")
    bits = _collected(_few_tasks(judged.select("word")).mapInArrow(_bloom_pass, _BLOCKS), 1 << (BLOOM_BITS - 3), np.uint8, np.bitwise_or)
    outside = docs.where(F.col("txt").rlike(r"[^\x00-\x7f]"))
    hits = written(outside.mapInArrow(_hit_pass(broadcast(first), broadcast(bits)), _HITS).dropDuplicates(["rid"]), "hits")
    # a common garbled word meets its judgement in several places
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt")
    asked = hits.select("rid", "lang", "source", salt, F.explode("words").alias("word"))
    answers = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    per_doc = asked.join(answers, ["lang", "source", "word", "salt"]).groupBy("rid").agg(F.collect_list(F.struct("word", "ks", "gains", "zs")).alias("judged"))
    return hits.join(per_doc, "rid", "left").select("rid", "txt", "lost", "words", "ns", "judged").mapInArrow(_restore_pass, _FOUND)

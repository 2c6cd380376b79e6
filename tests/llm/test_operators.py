"""Operators on small fixtures against brute force, with nulls, empties, ties, repeats, long texts and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dialecta.llm import copies, frequency, garbled, lookalike, mixing, near_dup, packing, parse_check
from dialecta.llm.textforms import canonical_glyphs, copy_form, word_set
from dialecta.llm.tokens import encoder, token_counts, DEFAULT_TOKENIZER
from dialecta.tables import read_table
from tests.conftest import DATA

TEXTS = [
    (1, "select a, b from t where x = 1 and y = 2"), (2, "SELECT b, a FROM t WHERE x=1 AND y=2;"), (3, "select а, b from t where x = 1 and y = 2"), (4, None), (5, ""), (6, "  ;"), (7, "select a, b from t where x = 1 and y = 3"),
    (8, "select a, b from t where x = 1 and y = 2"), (1, "select a, b from t where x = 1 and y = 2"), (9, "zażółć gęślą"), (10, "z" * 200_000 + " select"), (11, "select a, b from t where x = 1 and y = 2"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "clash", 0, "x") for i, t in TEXTS], "id long, body string, rid string, n int, exact string")


@pytest.fixture(scope="module")
def empty(texts):
    return texts.where("false")


def distinct():
    return sorted({(i, t) for i, t in TEXTS if t is not None})


def test_lookalike(texts, empty):
    rows = distinct()
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t and canonical_glyphs(s) == canonical_glyphs(t)}
    got = [tuple(r) for r in lookalike.lookalike_pairs(texts, "id", "body", hot=1, salts=3).collect()]
    assert sorted(got) == sorted(want) and want
    classes = {r.record_id: (r.class_id, r.n_links) for r in lookalike.lookalike_classes(texts, "id", "body").collect()}
    assert classes == {i: (1, sum(i in p for p in want)) for i in {x for p in want for x in p}}
    assert lookalike.lookalike_pairs(empty, "id", "body").count() == 0 and lookalike.canonical_table(empty, "id", "body").count() == 0
    canon = {r.record_id: r.canonical for r in lookalike.canonical_table(texts, "id", "body").collect()}
    assert canon == {i: None if t is None else canonical_glyphs(t) for i, t in TEXTS}


def test_copies(texts, empty):
    rows, groups = distinct(), {}
    for i, t in rows:
        groups.setdefault(copy_form(t), []).append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    for hot, salts in ((20_000, 64), (0, 4)):
        assert sorted(tuple(r) for r in copies.copy_groups(texts, "id", "body", hot, salts).collect()) == want
    assert sorted(tuple(r) for r in copies.collapsed(texts, "id", "body").collect()) == sorted((min(g), len(g)) for g in groups.values())
    assert copies.copy_groups(empty, "id", "body").count() == 0


def brute_pairs(rows, t):
    out = set()
    for a, s in rows:
        for b, u in rows:
            x, y = word_set(s), word_set(u)
            if a < b and x and y and len(x & y) / len(x | y) >= t and copy_form(s) != copy_form(u) and canonical_glyphs(s) != canonical_glyphs(u):
                out.add((a, b))
    return out


@pytest.mark.parametrize("t", [0.2, 0.5, 0.7, 0.8])
def test_near_duplicates(spark, texts, empty, t, monkeypatch):
    monkeypatch.setattr(near_dup, "CROWD", 2)
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = distinct()
    for i in range(100, 260):
        base = r.sample(words, r.randint(1, 24)) if i % 4 == 0 else base  # noqa: F821
        edited = [w for w in base if r.random() > 0.1] + r.sample(words, r.randint(0, 2))
        rows.append((i, " ".join(edited) or "w0"))
    df = spark.createDataFrame([(i, s, "clash") for i, s in rows], "id long, body string, codes string")
    for hot in (near_dup.HOT, 3):
        got = [tuple(x) for x in near_dup.near_duplicate_pairs(near_dup.text_features(df, "id", "body"), t, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, t) and got
    linked = {x for p in brute_pairs(rows, t) for x in p}
    assert {x.record_id for x in near_dup.near_duplicate_groups(near_dup.text_features(df, "id", "body"), t).collect()} == linked
    sets = df.select("id", F.split("body", " ").alias("e"))
    feats = near_dup.entry_features(sets, "id", F.col("e"))
    want = {(a, b) for a, s in rows for b, u in rows if a < b and len(set(s.split(" ")) & set(u.split(" "))) / len(set(s.split(" ")) | set(u.split(" "))) >= t}
    assert {tuple(x) for x in near_dup.near_duplicate_pairs(feats, t).collect()} == want
    groups = {x.record_id: x.class_id for x in near_dup.near_duplicate_groups(feats, t).collect()}
    parent = {i: i for i, _ in rows}
    for a, b in sorted(want) * 8:
        parent[a] = parent[b] = min(parent[a], parent[b])
    assert groups == {i: parent[i] for p in want for i in p}


def test_near_duplicates_empty(empty):
    assert near_dup.near_duplicate_pairs(near_dup.text_features(empty, "id", "body"), 0.7).count() == 0


def test_partenum_and_prefix_agree(monkeypatch, spark):
    r = random.Random(5)
    rows = [(i, sorted({f"c{r.randint(0, 40)}" for _ in range(r.randint(3, 14))})) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, e array<string>")
    want = {(a, b) for a, s in rows for b, u in rows if a < b and len(set(s) & set(u)) / len(set(s) | set(u)) >= 0.7}
    assert {tuple(x) for x in near_dup.near_duplicate_pairs(near_dup.entry_features(df, "id", F.col("e")), 0.7).collect()} == want
    assert near_dup._scheme(0.7, 6, 8) is not None and near_dup._scheme(0.7, 40, 57) is None


def test_parse_check(spark, texts, empty):
    rows = [(1, "select a from t", "redshift"), (2, "select a from", "redshift"), (3, None, "redshift"), (4, "", None), (5, "select `a` from t", " Databricks "), (6, "select `a` from t", "ORACLE"), (2, "select a from", "redshift")]
    long_ok = "insert into t values " + ", ".join(f"({i}, 'it''s; (x')" for i in range(400)) + "; select /* ; ( */ 1 as x; update t set a = 1 where b = ';'"
    rows += [(7, long_ok, "snowflake"), (8, long_ok + "; select a from", "snowflake"), (9, long_ok.replace("/* ; ( */", "/* ; ("), "snowflake"), (10, "create procedure p() as begin " + "select 1; " * 99 + " end", "sqlserver")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, body string, dia string, chunk string")
    for chunk, run in ((1024, 1 << 20), (50, 200), (24, 30)):
        assert {r.rid for r in parse_check.parse_verdicts(df, "id", "body", "dia", chunk, run).where("not ok").collect()} == {2, 6, 8, 9}
    rates = {(r.repo, r.dialect): (r.n_files, r.n_invalid) for r in parse_check.parse_rates(df.withColumn("repo", F.lit("q")), "id", "body", "dia", "repo").collect()}
    assert rates["q", "redshift"] == (2, 1) and rates["q", None] == (1, 0)
    assert parse_check.unparsable(empty.withColumn("dia", F.lit("oracle")), "id", "body", "dia").count() == 0


def test_frequencies(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, *range(12)]), r.choice([" A", "a\t", "b", None, "  ", "c"]), r.choice(["HOT", "hot", "x"])) for i in range(900)]
    rows += rows[:50] + [(None, 3, "b", "x")] * 3
    df = spark.createDataFrame([(*x, "clash") for x in rows], "wid long, req long, feature string, severity string, term string").repartition(5)
    want = {}
    for wid, req, f, s in [*{x for x in rows if x[0] is not None}, *[x for x in rows if x[0] is None]]:
        for name, v in (("feature", f), ("severity", s)):
            v = v.strip(" \t").upper() if v else ""
            if v:
                n = want.setdefault((name, v), [0, set()])
                n[0] += 1
                if req is not None:
                    n[1].add(req)
    got = {(x.field_name, x.field_value): (x.n_occurrences, x.n_records) for x in frequency.frequencies(df, "req", "wid", ["feature", "severity"], 5, 0.2).collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert frequency.frequencies(df.where("false"), "req", "wid", ["feature"], 5, 0.2).count() == 0
    one = frequency.frequencies(df.where("wid = 1"), "req", "wid", ["severity"], 5, 0.2).collect()
    assert len(one) == 1 and one[0].n_occurrences == 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i} " * (i * 7 % 90), ["en", "EN ", "de", None][i % 4], ["a", "b", "c", None][i % 5 % 4]) for i in range(120)]
    rows += [(200, None, "en", "a"), (201, "", "en", "b"), (202, "long text " * 400, "en", "c")]
    return spark.createDataFrame([(*r, 7) for r in rows], "id long, body string, lang string, src string, block int")


def test_packing(spark, docs):
    capacity = 128
    enc = encoder(DEFAULT_TOKENIZER)
    size = {r.id: len(enc.encode_ordinary(r.body)) if r.body else 0 for r in docs.collect()}
    rows = packing.packed(docs, "id", "body", capacity).collect()
    for i, n in size.items():
        mine = sorted((r.piece_no, r.length) for r in rows if r.rid == i)
        assert sum(x for _, x in mine) == n and len(mine) == max(1, -(-n // capacity)) and [p for p, _ in mine] == list(range(len(mine)))
    room = {}
    for r in rows:
        room[r.container_id] = room.get(r.container_id, 0) + r.length
    assert max(room.values()) <= capacity
    report = packing.fill_report(packing.packed(docs, "id", "body", capacity), capacity).first()
    assert report.n_tokens == sum(size.values()) and report.fill_rate > 0.9
    assert packing.packed(docs.where("false"), "id", "body", capacity).count() == 0
    assert token_counts(docs, "id", "body").count() == docs.count()


@pytest.mark.parametrize("capacity", [4096, 8193, 131_072])
def test_large_containers_are_never_over_full(spark, capacity):
    r = random.Random(capacity)
    rows = [(i, "a " * r.choice([r.randint(1, 40), r.randint(1, capacity // 3), capacity + r.randint(1, 99)]) if i % 60 else "a " * capacity) for i in range(240)]
    packs = packing.packed(spark.createDataFrame(rows, "id long, body string"), "id", "body", capacity).collect()
    room = {}
    for x in packs:
        room[x.container_id] = room.get(x.container_id, 0) + x.length
    assert max(room.values()) <= capacity and sum(room.values()) / (capacity * len(room)) > 0.9


def test_places_hold_at_any_length_and_rank():
    r = random.Random(2)
    capacity = 131_072
    counts = {x: r.randint(1, 50_000) for x in r.sample(range(1, capacity + 1), 700)}
    table = packing._places(packing.plan(counts, capacity), 1)
    items = [(x, n - 1) for x, n in counts.items()] + [(x, 0) for x in counts] + [(x, n // 2) for x, n in counts.items()]
    shared = type("S", (), {"value": table})
    import pandas as pd

    got = next(packing._assign(shared)(iter([pd.DataFrame({"rid": range(len(items)), "piece_no": 0, "length": [x for x, _ in items], "rank": [k for _, k in items]})])))
    where = dict(zip(items, got["container_id"]))
    for x, rank in items:
        row = max((t for t in table.tolist() if t[0] == x and t[1] <= rank), key=lambda t: t[1])
        assert where[x, rank] == row[3] + (rank - row[1]) // row[2]


def test_mixing_by_domain_language_and_source(spark):
    rows = [(i, "token " * 9, lang, src) for i, (lang, src) in enumerate([("en", "web")] * 80 + [("de", "web")] * 4 + [("en", "books")] * 10 + [("de", "books")] * 30)]
    df = spark.createDataFrame(rows, "id long, body string, lang string, src string")
    targets = spark.createDataFrame([("web", 0.5, 2), ("books", 0.5, 2)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(df, "id", "body", "lang", "src", targets)
    n = sizes.first().n_tokens
    # German web text is short: the rest of the German share stays with German books before it goes to English
    weights = spark.createDataFrame([("d", "de", "web", 0.4), ("d", "de", "books", 0.1), ("d", "en", "web", 0.4), ("d", "en", "books", 0.1)], "domain string, lang string, source string, weight double")
    root, total = mixing.budget(sizes, targets, weights)
    given = {x.key: x.given / n for x in mixing.leaves(root)}
    assert total == 124 * n and given["web", "de"] == 8 and abs(given["books", "de"] - 54) < 1e-6 and abs(given["web", "en"] + given["books", "en"] - 62) < 1e-6
    assert {x.key for x in mixing.leaves(root) if x.short} == {("web", "de")}
    used = {}
    for r in mixing.mixed(sizes, targets, weights=weights).collect():
        used[r.source, r.lang] = used.get((r.source, r.lang), 0) + r.uses
    assert used == {("web", "de"): 8, ("books", "de"): 54, ("web", "en"): 49, ("books", "en"): 12}
    # without weights the languages of a source make up for each other
    root, _ = mixing.budget(sizes, targets)
    web = next(c for c in root.children if c.name == "web")
    de = next(c for c in web.children if c.name == "de")
    assert de.short and de.given / n == 8 and not web.short and abs(web.given / n - 62) < 1e-6


def test_mixing(spark, docs):
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 3), ("c", 0.05, 1), ("none", 0.05, 4)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(docs, "id", "body", "lang", "src", targets)
    have = {r.source: r.s for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("s")).collect()}
    total = sum(have.values())
    report = {r.source: r for r in mixing.report(sizes, targets).collect()}
    assert {s for s, r in report.items() if r.short} == {r.source for r in targets.collect() if have.get(r.source, 0) * r.max_repeats < r.target_share * total}
    mix = mixing.mixed(sizes, targets).collect()
    assert sorted(map(tuple, mix)) == sorted(map(tuple, mixing.mixed(sizes, targets).collect()))
    repeats = {"a": 2, "b": 3, "c": 1}
    assert all(0 < r.uses <= repeats[r.source] for r in mix)
    for s in have:
        used, longest = sum(r.n_tokens * r.uses for r in mix if r.source == s), max(r.n_tokens for r in sizes.where(F.col("source") == s).collect())
        leaves = sizes.where(F.col("source") == s).select("lang").distinct().count()
        assert report[s].planned_tokens - longest * leaves <= used <= report[s].planned_tokens
    assert {r.source for r in mixing.shares(mixing.mixed(sizes, targets), targets).collect()} == {"a", "b", "c", "none"}
    none = mixing.sized(docs.where("false"), "id", "body", "lang", "src", targets)
    assert mixing.mixed(none, targets).count() == 0 and mixing.report(none, targets).count() == 4


def test_garbled(spark):
    clean = read_table(spark, DATA.replace("0.001", "0.01"), "documents").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()
    rows, planted = [], {}
    for k, r in enumerate(clean):
        text = r.text
        m = re.search(r"[^\s]*[äöüßéèêàçłśżźęą][^\s]*", text)
        if k % 9 == 0 and m and r.lang in ("de", "fr", "pl"):
            read = "cp1252" if r.lang != "pl" else "latin-1"
            try:
                text, planted[r.doc_id] = text.replace(m.group(0), m.group(0).encode("utf-8").decode(read)), text
            except UnicodeDecodeError:
                planted.pop(r.doc_id, None)
        rows.append((r.doc_id, text, r.lang, r.source, "clash"))
    rows += [(10**6, None, "de", None, "x"), (10**6 + 1, "", None, "a", "x"), (10**6 + 2, "Gr��e", "de", "a", "x"), (10**6 + 3, "x" * 10_000, "xx", "a", "x")]
    got = {r.rid: r for r in garbled.garbled(spark.createDataFrame(rows, "id long, body string, lang string, src string, swap string"), "id", "body", "lang", "src").collect()}
    found = set(planted) & set(got)
    assert len(found) >= 0.9 * len(planted) and 10**6 + 2 in got and not {10**6, 10**6 + 1, 10**6 + 3} & set(got)
    assert sum(got[i].restored == planted[i] for i in found) >= 0.8 * len(found)
    assert garbled.garbled(spark.createDataFrame(rows[:0], "id long, body string, lang string, src string, swap string"), "id", "body", "lang", "src").count() == 0


@pytest.mark.parametrize("share", [0.1, 0.34])
def test_garbled_where_a_swap_is_common(spark, share):
    r, rows, planted = random.Random(1), [], {}
    docs = read_table(spark, DATA.replace("0.001", "0.1"), "documents").where("lower(trim(lang)) like 'ru%'")
    for d in docs.select("doc_id", "text", "lang", "source").orderBy("doc_id").collect():
        text = d.text
        if r.random() < share and re.fullmatch(r"[\x00-\x7fЀ-ӿ]*[а-я]{5}[\x00-\x7fЀ-ӿ]*", text):
            text, planted[d.doc_id] = text.encode("cp1251").decode("latin-1"), text
        rows.append((d.doc_id, text, d.lang, d.source))
    got = {x.rid: x for x in garbled.garbled(spark.createDataFrame(rows, "id long, body string, lang string, src string"), "id", "body", "lang", "src").collect()}
    assert planted and len(set(planted) & set(got)) >= 0.97 * len(planted)
    assert sum(got[i].restored == planted[i] for i in planted if i in got) >= 0.9 * len(planted)


def test_parse_check_is_the_same_for_every_chunk_size(spark):
    body = "create procedure p() as begin " + "select 1; " * 30
    dollar = "create function f() returns int as $$ it's ( ; select 1; " + "x " * 60 + "$$ language sql; select "
    rows = [(1, body + "\n=======\n select 2; end", "sqlserver"), (2, body + "select `a` from t; end", "oracle"), (3, body + "end", "sqlserver"), (4, dollar + "3", "snowflake"), (5, dollar.replace("$$ language", "language") + "3", "snowflake")]
    rows += [(6, ";\n" + body + "end", "oracle"), (7, "create table t (a int); " * 9 + "select a from", "redshift"), (8, "alter table t add (a int", "redshift"), (9, "select '" + "x$$" * 50 + "' as a$$b", "snowflake")]
    df = spark.createDataFrame(rows, "id long, body string, dia string")
    rows += [(20, "begin; create procedure p as begin select 1; end", "redshift"), (21, body + "select a from; end", "sqlserver"), (22, body, "sqlserver"), (23, "select a from t\nGO\n" * 40 + "select b from\nGO\nselect c from t", "sqlserver")]
    rows += [(24, "select a from t\nGO\n" * 40, "sqlserver"), (25, "select a from t\n/\n" * 40, "oracle"), (26, "select a from t; GO\nselect b from u", "sqlserver")]
    df = spark.createDataFrame(rows, "id long, body string, dia string")
    for chunk, run in ((1024, 1 << 20), (50, 1 << 20), (24, 60), (30, 300)):
        assert {r.rid for r in parse_check.parse_verdicts(df, "id", "body", "dia", chunk, run).where("not ok").collect()} == {1, 2, 5, 7, 8, 21, 22, 23}, (chunk, run)


def test_links_within_one_set_count(spark):
    rows = [(1, "select a, b from t where x"), (2, "select t where x from a, b"), (3, "SELECT a, b FROM t WHERE x"), (4, "other words only here")]
    feats = near_dup.text_features(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    pairs = [tuple(x) for x in near_dup.near_duplicate_pairs(feats, 0.7).collect()]
    want = {i: sum(i in p for p in pairs) for i in (1, 2, 3)}
    assert {x.record_id: x.n_links for x in near_dup.near_duplicate_groups(feats, 0.7).collect()} == want == {1: 1, 2: 2, 3: 1}

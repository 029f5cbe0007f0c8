"""Mixing, URL filter, near-duplicates, top-k search."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from helpers import ODD_TEXTS, SCHEMA, SF_DIR, documents, frame
from xxhash import xxh64_intdigest

from framelake.llm import mixing, simhash, topk_search, url_filter
from framelake.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
@pytest.mark.parametrize("sf_dir", [SF_DIR, SF_DIR.replace("0.001", "0.01")])
def test_query_matches_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)


# ---- op3 ----

def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS sid", "2 AS size")
    return mixing.taken_words(docs).collect()


def test_targets_stop_at_two_epochs_and_are_met(spark):
    rows = [(k, "w " * (1 + k % 50), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)] + [(9000, None, None), (9001, "a b c", None), (None, "x", "s1")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    per = {}
    names = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        per.setdefault((names[r.doc_id]), [0, r.target])[0] += r.taken
    total = sum(r.size for r in got)
    assert math.isclose(sum(t for _, t in per.values()), 1.5 * total, rel_tol=1e-9)
    assert all(abs(taken - target) <= max(1.5 * total / 2**18 + 2, 2) for taken, target in per.values())
    order = sorted((n for n in per if n is not None)) + [None]
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(order)}
    sizes = {n: next(r.source_size for r in got if names[r.doc_id] == n) for n in order}
    share, full = {}, set()
    while True:  # the rule as it is said: cut, share the excess out again, until none is above
        rest = 1.5 * total - sum(2 * sizes[n] for n in full)
        share = {n: rest * weight[n] / sum(weight[m] for m in order if m not in full) for n in order if n not in full}
        above = {n for n, t in share.items() if t > 2 * sizes[n]}
        if not above:
            break
        full |= above
    for n in order:
        assert math.isclose(per[n][1], 2 * sizes[n] if n in full else share[n], rel_tol=1e-9)


def test_schedule_is_van_der_corput_and_blocks_are_met_once(spark):
    sizes = mixing.sized(spark.createDataFrame([(k, "w " * 100, f"s{k % 3}") for k in range(300)], "doc_id bigint, text string, source string"))
    targets = mixing.source_targets(sizes)
    t = {r.sid: r for r in targets.collect()}
    slots = sorted(mixing.schedule(targets).collect(), key=lambda r: r.slot)
    seen = {}
    for r in slots:
        point = int(f"{r.slot:016b}"[::-1], 2)  # 45,000 slots of one word
        assert t[r.sid].first_slot <= point < t[r.sid].end_slot and r.k == seen.get(r.sid, 0)
        seen[r.sid] = r.k + 1
    pieces = mixing.mixed_pieces(mixing.placed_documents(sizes, targets), mixing.schedule(targets)).collect()
    by_slot = {}
    for p in pieces:
        by_slot[p.slot] = by_slot.get(p.slot, 0) + p.to_word - p.from_word
    assert len(slots) == 45_000
    for r in slots:
        assert by_slot[r.slot] == min(t[r.sid].block, t[r.sid].words - r.k * t[r.sid].block)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c", "x")] * 3 + [(2, "d e", None), (2, None, "x"), (3, "", "y")]
    got = mixed(spark, rows)
    assert sorted(r.size for r in got) == [0, 0, 2, 3, 3, 3] and mixed(spark, []) == []
    again = mixed(spark, rows)
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_mixed_documents_hold_the_words_taken(spark):
    docs = frame(spark, [t for t in ODD_TEXTS if t is None or len(t) < 6000] + [f"w{k} " * (k + 1) for k in range(60)]).selectExpr("*", "1 AS extra")
    taken = sum(r.taken for r in mixing.taken_words(docs).collect())
    out = mixing.mixed_documents(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(words(r.text) for r in out) == taken and all(r.n_chars == len(r.text) for r in out)
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "extra"}


def test_sources_below_a_slot_get_their_target(spark):
    rows = [(k, "w " * 50_000, "big") for k in range(60)] + [(1000 + k, "a b c d e", f"tail{k:02d}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    per = {r.source: r.w for r in mixing.mixed_documents(docs).selectExpr(
        "source", "size(regexp_extract_all(text, '[a-z]+', 0)) AS w").groupBy("source").agg({"w": "sum"}).toDF("source", "w").collect()}
    total = 60 * 50_000 + 60 * 5
    assert all(per.get(f"tail{k:02d}") == 10 for k in range(60))  # two epochs; a slot has 18 words
    assert abs(per["big"] - (1.5 * total - 600)) <= 1


def test_query_takes_tiny_sources_whole(spark):
    rows = [(k, "w " * 30_000, "big") for k in range(90)] + [(1000 + k, "a b c", f"tail{k:02d}") for k in range(40)]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)).collect()
    tail = [r for r in got if r.doc_id >= 1000]
    assert [r.taken for r in tail] == [6] * 40 and all(r.first_slot is not None and r.pieces >= 2 for r in tail)
    per = {}
    for r in got:
        per.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(target - taken) <= 1 for size, (target, taken) in per.items() if size > 3)


def test_mix_comes_in_slot_order(spark):
    docs = spark.createDataFrame([(k, "w " * 50, f"s{k % 3}") for k in range(120)], "doc_id bigint, text string, source string")
    first = {r.doc_id: r.first_slot for r in mixing.taken_words(docs).collect()}
    out = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    seen = list(dict.fromkeys(out))
    assert seen == sorted(seen, key=first.get) and {d for d, s in first.items() if s is not None} == set(out)


def test_equal_rows_of_two_sources_stay_apart(spark):
    rows = [(d, f"w{k} " * 5, s) for d in (1, None) for k in range(40) for s in ("x", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = mixing.sized(docs)
    targets = mixing.source_targets(sizes)
    got = {r.source: r.w for r in mixing.mixed_documents(docs).selectExpr("source", "size(split(trim(text), ' ')) AS w").groupBy("source").agg(
        {"w": "sum"}).toDF("source", "w").collect()}
    assert got == {r.source: r.words for r in targets.collect()}
    assert mixing.placed_documents(sizes, targets).where("doc_id IS NULL").select("sid", "run").distinct().count() > 60


def test_slots_grow_with_the_corpus(spark):
    sizes = spark.createDataFrame([("big", 10**10), ("mid", 10**8), ("s1", 700), ("s2", 3)], "source string, size bigint")
    targets = {r.source: r for r in mixing.source_targets(sizes).collect()}
    assert {t.block for t in targets.values()} == {mixing.MOST_BLOCK}
    assert all(abs(t.words - t.target) <= 1 for t in targets.values()) and targets["s2"].words == 6
    assert all(t.end_slot - t.first_slot == -(-t.words // t.block) for t in targets.values())


# ---- op7 ----

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/1", "http://a.www.example.com/en/",
    "http://xexample.com/en/", "http://a.net/es/", "http://a.net/es", "http://net/fr/?q", "http://a.net?/fr/", "http://a.net#/fr/", "x://y://a.com/b",
    "http://ÀB.Com/é/", "http://a..com/x", "http://.com/", "http://" + "a." * 3000 + "com/" + "x/" * 3000, "http://m.adult-x.example.net/de/1",
    "http://adult-x.example.net", "http://example.com\n/en/", "ftp://user@www.example.com:80/en/", "http://a.net/es/" * 2,
]


def plain_verdict(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    blocked = any(host == b or host.endswith("." + b) for b in (f"{n}.example.{t}" for n in url_filter.BLOCKED_NAMES for t in ("com", "net", "org")))
    return host, path, None, "block" if blocked else "allow"


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[6])] * 2, "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS rule")
    rules = url_filter.rule_table(spark, url_filter.RULES + url_filter.BLOCKED_HOSTS)
    rows = url_filter.url_verdicts(pages, rules).collect()
    want = [(k, *plain_verdict(u)) for k, u in list(enumerate(URLS)) + [(0, URLS[6])] * 2]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert url_filter.url_verdicts(pages.limit(0), rules).collect() == []
    none = url_filter.url_verdicts(pages, rules.limit(0)).collect()
    assert len(none) == len(want) and {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}


# ---- op9 ----

def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    ids = sorted(marks)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    docs = documents()
    rows = QUERIES["op9_simhash_dedup"](spark, SF_DIR).collect()
    marks = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == marks
    assert {r.doc_id: r.component_id for r in rows} == plain_components(marks)
    for text in ODD_TEXTS:
        if text is None or len(text) < 20000:
            assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def near(spark, fps):
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").distinct()
    pairs = simhash.components(simhash.fingerprint_links(nodes)).collect()
    root = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in pairs}
    groups = {}
    for f in fps:
        groups.setdefault(root.get(f, f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_links_are_exact_for_dense_and_chained_fingerprints(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(1500)}  # one crowded key, several tiles
    at = rng.getrandbits(64)
    for _ in range(60):  # a chain of three-bit steps
        at ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.add(at)
    fps |= {0, 7, 15, (1 << 64) - 1}
    marks = dict(enumerate(sorted(fps)))
    want = {}
    for i, c in plain_components(marks).items():
        want.setdefault(c, set()).add(marks[i])
    assert near(spark, sorted(fps)) == {frozenset(g) for g in want.values()}


def test_copies_nulls_and_empty(spark):
    docs = frame(spark, ["x y z"] * 5 + [None, "", "q"]).selectExpr("*", "1 AS fp", "2 AS root")
    docs = docs.unionAll(docs.where("doc_id = 3")).unionAll(docs.where("doc_id = 7").selectExpr("CAST(NULL AS BIGINT)", *docs.columns[1:]))
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [
        (0, 0), (1, 0), (2, 0), (3, 0), (3, 0), (4, 0), (5, 5), (6, 5), (7, 7)]
    assert [r.component_id for r in rows if r.doc_id is None] == [7]
    assert sorted(r.doc_id for r in simhash.first_of_each(docs).collect()) == [0, 5, 7]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    nameless = docs.where("doc_id >= 5").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:])
    kept = simhash.first_of_each(docs.where("doc_id < 5").unionAll(nameless)).collect()
    assert sorted((r.doc_id is None, r.text or "") for r in kept) == [(False, "x y z"), (True, ""), (True, "q")]


def test_unlike_texts_of_one_id_both_stay(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choices([f"w{k}" for k in range(500)], k=80)) for _ in range(3))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, c, "en", "s", 0), (1, a, "en", "s", 0), (9, b, "en", "s", 0)]
    kept = simhash.first_of_each(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _text", "2 AS _handle")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (2, c)])


# ---- op10 ----

def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = [(k, [float(x) for x in rng.normal(0, 0.13, 16)]) for k in range(900)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(40)] + [(2000, None), (2001, [0.1, None]), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16),
                                                                 (2004, []), (2005, [0.5])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS v", "2 AS score")
    made = topk_search.quantised(df)
    exact = {k: np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 16 - len(v)))).astype(int) for k, v in vectors
             if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in topk_search.top_k(made.where("vec_id % 20 = 0"), made).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {k for k in exact if k % 20 == 0}
    for q, rows in got.items():
        order = sorted(((-int(exact[q] @ exact[c]), c) for c in exact if c != q))[:20]
        assert sorted(rows) == [(n + 1, c, -s) for n, (s, c) in enumerate(order)]
    assert topk_search.top_k(made.limit(0), made).collect() == [] and topk_search.top_k(made, made.limit(0)).collect() == []


def test_proof_keeps_every_member():
    rng = np.random.default_rng(9)
    matrix = rng.integers(-30, 30, (4000, 24))
    matrix[:50] = matrix[0]
    shard = topk_search.Shard(np.arange(4000), matrix)
    for q in (matrix[0], rng.integers(-30, 30, 24), np.zeros(24, np.int64)):
        possible = shard._possible(q, 20)
        scores = matrix @ q
        assert set(np.flatnonzero(scores > np.sort(scores)[-20])) <= set(possible)
        ids, best = shard.best(-1, q, 20)
        order = np.lexsort((np.arange(4000), -scores))[:20]
        assert list(ids) == list(order) and list(best) == list(scores[order])


def test_repeated_query_rows_take_no_places():
    rng = np.random.default_rng(4)
    q = rng.integers(-30, 30, 24)
    # six rows of the query, then candidates that are all its halves or less: without room for the six the last members fall out
    matrix = np.concatenate([np.tile(q, (6, 1)), np.array([q // 2] * 19), rng.integers(-3, 3, (3975, 24))])
    ids = np.concatenate([np.full(6, 7), np.arange(100, 100 + len(matrix) - 6)])
    shard = topk_search.Shard(ids, matrix)
    scores = matrix @ q
    for few in (topk_search.FEW, 0.0):
        for k in (20, 40):
            topk_search.FEW, kept = few, topk_search.FEW
            try:
                got, best = shard.best(7, q, k)
            finally:
                topk_search.FEW = kept
            other = np.flatnonzero(ids != 7)
            order = other[np.lexsort((ids[other], -scores[other]))[:k]]
            assert list(got) == list(ids[order]) and list(best) == list(scores[order])
    # scores with no ties, own rows many: the scan runs to its end and keeps k best only
    spread = np.zeros((3000, 1), np.int64)
    spread[:, 0] = np.arange(3000)
    shard = topk_search.Shard(np.where(np.arange(3000) >= 2700, -5, np.arange(3000)), spread)
    got, _ = shard.best(-5, np.array([1]), 20)
    assert list(got) == list(range(2699, 2679, -1))


def test_vectors_without_components(spark):
    """Empty vectors score 0 with each other; ties go to the smaller id."""
    vectors = topk_search.quantised(spark.createDataFrame([(k, []) for k in range(120)], "vec_id bigint, embedding array<float>"))
    got = topk_search.top_k(vectors.where("vec_id % 40 = 0"), vectors, 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 0), (40, 1, 0, 0), (40, 2, 1, 0), (40, 3, 2, 0), (80, 1, 0, 0), (80, 2, 1, 0), (80, 3, 2, 0)]

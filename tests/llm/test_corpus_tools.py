"""Filter audit, importance resampling and SetSketch near-dedup against plain forms of the same rules."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from helpers import ODD_TEXTS, SCHEMA, SF_DIR, documents, frame
from pyspark.sql import functions as F

from framelake.llm import filter_audit as audit
from framelake.llm import importance_resampling as resampling
from framelake.llm import setsketch
from framelake.llm.queries import QUERIES

WORDS = [f"w{k}" for k in range(400)]
LABELS = "doc_id bigint, quality int, toxic int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- filter audit

def plain_mask(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t))]
    return sum(1 << k for k, f in enumerate(fails) if f)


def plain_audit(rows, labels):
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    parts = defaultdict(list)
    for doc_id, text, source in rows:
        copy = doc_id is not None and smallest[text or ""] < doc_id
        parts[source or ""].append((plain_mask(text) | (16 if copy else 0), doc_id in good, doc_id in toxic))
    out = set()
    for part, docs in parts.items():
        shapley = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in docs if d[0] & bit and not d[0] & before]
                shapley[letter] += len(gone)
                steps.append((part, "".join(order), step, sum(not d[0] & (before | bit) for d in docs), len(gone),
                              sum(bool(d[0] & bit and d[0] & before) for d in docs), sum(d[0] == bit for d in docs),
                              sum(d[1] for d in gone), sum(d[2] for d in gone), letter))
                before |= bit
        out |= {(*s[:-1], shapley[s[-1]]) for s in steps}
    return out


def audit_rows():
    rng = random.Random(3)
    texts = [*ODD_TEXTS, "ABC DEF", "a | b", " ".join(WORDS[:250]), " ".join(WORDS[:90] * 3), "Copy " + " ".join(WORDS[:220])]
    rows = [(k, t, rng.choice(["s1", "s2", None, ""])) for k, t in enumerate(texts)]
    rows += [(100 - k, texts[-1], "s1") for k in range(40)] + [(7, texts[-1], "s2"), (None, texts[-1], "s2"), (None, "", None), (3, texts[3], "s9"), (3, texts[3], "s9")]
    return rows


def write(spark, rows, path, mode="overwrite"):
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def test_filter_audit_equals_plain_rules_in_several_batches(spark, tmp_path):
    rows, labels = audit_rows(), [(0, 1, 0), (24, 1, 1), (90, 0, 1), (61, 1, None), (61, 0, None), (None, 1, 1), (7, None, 1)]
    path = str(tmp_path / "documents.parquet")
    for k in range(0, len(rows), 9):
        write(spark, rows[k:k + 9], path, "append")
    known = spark.createDataFrame(labels, LABELS)
    got = audit.filter_audit(spark, path, known)
    assert {tuple(r) for r in got.collect()} == plain_audit(rows, labels)
    assert got.count() == len({s or "" for *_, s in rows}) * 600


def test_audit_retracts_when_later_files_hold_smaller_ids(spark, tmp_path):
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "audit")
    labels = spark.createDataFrame([(5, 1, 0), (1, 1, 1)], LABELS)
    text = " ".join(WORDS[:230])
    before = [(9, text, "a"), (5, text, "b"), (5, text, "b"), (6, "other text", "a")]
    after = [(1, text, "a"), (2, text, "b"), (4, "other text", "b")]
    write(spark, before, path)
    audit.audit_new_files(spark, path, labels, folder)
    assert {tuple(r) for r in audit.order_effects(audit.part_counters(spark, folder)).collect()} == plain_audit(before, [(5, 1, 0), (1, 1, 1)])
    write(spark, after, path, "append")
    audit.audit_new_files(spark, path, labels, folder)
    assert {tuple(r) for r in audit.order_effects(audit.part_counters(spark, folder)).collect()} == plain_audit(before + after, [(5, 1, 0), (1, 1, 1)])
    deltas = spark.read.parquet(f"{folder}/deltas")
    assert deltas.where("n < 0").count() > 0  # the earlier first rows were taken back
    audit.audit_new_files(spark, path, labels, folder)  # no new file: nothing changes
    assert spark.read.parquet(f"{folder}/deltas").count() == deltas.count()


def test_filter_audit_of_an_empty_table_and_extra_columns(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    write(spark, [], path)
    labels = spark.createDataFrame([], LABELS)
    assert audit.filter_audit(spark, path, labels).count() == 0
    other = str(tmp_path / "more.parquet")
    frame(spark, ["a b", "a b"]).withColumns({"key": F.lit(1), "mask": F.lit("x"), "part": F.lit(2), "flags": F.lit(3), "n": F.lit(4)}).write.parquet(other)
    rows = [(0, "a b", None), (1, "a b", "s1")]
    assert {tuple(r) for r in audit.filter_audit(spark, other, labels).collect()} == plain_audit(rows, [])


# ---------------------------------------------------------------- importance resampling

def plain_resampling(rows, target, percent=10, least=20, buckets=10_000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    place = lambda w: crc32(w.encode()) % buckets
    s, t = (Counter(place(w) for x in texts for w in words(x)) for texts in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (n_s + buckets) / ((s[k] + 1) * (n_t + buckets))))
    out = []
    for doc_id, text in rows:
        found = words(text)
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(w)) for w in found)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = drawn[:percent * len(drawn) // 100]
    rest = Counter(out) - Counter(drawn)
    return Counter([(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in rest.elements()])


@pytest.mark.parametrize("case", ["tables", "odd"])
def test_resampling_equals_plain_rules(spark, case):
    if case == "tables":
        docs, target = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    else:
        rng = random.Random(5)
        texts = [*ODD_TEXTS, *(" ".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(150))]
        rows = [(None if k % 29 == 0 else k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(77, " ".join(WORDS[:40]), "en", "s", 0)] * 60
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "score": F.lit(1), "_row": F.lit(0)})
        target = spark.createDataFrame([(1, " ".join(WORDS[20:60])), (2, None)], "item_id bigint, text string")
    got = resampling.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    want = plain_resampling([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert Counter(map(tuple, got.collect())) == want


def test_resampling_of_empty_tables_and_longer_runs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    docs = frame(spark, [" ".join(WORDS[k:k + 30]) for k in range(40)])
    assert resampling.resampled(empty, empty).count() == 0
    assert resampling.resampled(docs, empty).where("rank is not null").count() == 4
    assert resampling.resampled(docs, docs, percent=0).where("rank is not null").count() == 0
    assert resampling.resampled(docs, docs, percent=100).agg(F.max("rank")).first()[0] == 40
    assert {r.n_features for r in resampling.resampled(docs, docs, ngrams=3).collect()} == {30 + 29 + 28}


@pytest.mark.parametrize("values", [list(range(1000)), [5] * 1000, [0] * 700 + [9] * 300, [k % 3 for k in range(999)]])
@pytest.mark.parametrize("wanted", [1, 100, 301, 998])
def test_bracket_holds_the_cutoff(spark, values, wanted):
    scores = spark.createDataFrame([(v,) for v in values], "score bigint")
    low, high, above = resampling.cutoff_bracket(scores, len(values), wanted, accuracy=20)
    cut = sorted(values, reverse=True)[wanted - 1]
    assert (low is None or low <= cut) and (high is None or cut <= high)
    assert above == sum(high is not None and v > high for v in values) < wanted


# ---------------------------------------------------------------- SetSketch

def plain_components(rows, percent=85):
    shingles = []
    for _, text in rows:
        w = lower(text).split(" ") if text and "\x1c" not in text else re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        w = re.findall(r"[^\x20\x09-\x0D]+", " ".join(w))
        shingles.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(shingles[a] & shingles[b])
        if both and 100 * both >= percent * len(shingles[a] | shingles[b]):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            smallest = min(ids) if ids else None
            out.append((rows[k][0], len(shingles[k]), smallest, rows[k][0] == smallest))
    return Counter(out)


def family(rng, size, edits, length=140):
    base = rng.choices(WORDS, k=length)
    for _ in range(size):
        words = list(base)
        for at in rng.sample(range(length), rng.randint(0, edits)):
            words[at] = rng.choice(WORDS)
        yield " ".join(words)


def test_setsketch_equals_all_pairs(spark):
    rng = random.Random(11)
    texts = [t for t in ODD_TEXTS if len(t or "") < 6000]
    texts += list(family(rng, 60, 4)) + list(family(rng, 60, 2, 60)) + list(family(rng, 20, 1, 9)) + [" ".join(WORDS[:50])] * 30
    rows = [(None if k % 17 == 0 else (k * 7) % 1000, t) for k, t in enumerate(texts)] + [(5, " ".join(WORDS[100:140])), (5, " ".join(WORDS[200:240]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumns({"node": F.lit(1), "n": F.lit("x"), "sketch": F.lit(0)})
    got = setsketch.near_duplicates(docs)
    assert Counter(tuple(r) for r in got.collect()) == plain_components(rows)


def test_setsketch_of_an_empty_table(spark):
    assert setsketch.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registers_merge_and_estimate(spark):
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) for _ in range(2))
    one, other, both = setsketch.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(one, other) == both).all()
    assert (setsketch.sketches([np.zeros(0, np.uint64), a])[1] == one).all()
    for shared in (0, 300, 600, 850, 950, 1000):
        values = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
        x, y = np.sort(values[:1000]), np.sort(np.concatenate([values[:shared], values[1000:2000 - shared]]))
        p, q = setsketch.sketches([x, y])
        size = np.array([1000.0])
        estimate, against = setsketch.likely_similarity(size, size, np.array([(p > q).sum()]), np.array([(p < q).sum()]), 0.85)
        true = shared / (2000 - shared)
        assert abs(estimate[0] - true) < 0.17
        assert true < 0.5 or against[0] < setsketch.UNLIKELY
        assert true > 0.3 or against[0] > setsketch.UNLIKELY


def test_tile_links_skip_equal_labels_and_join_the_rest():
    rng = random.Random(2)
    sets = [setsketch.shingle_set(t, setsketch._Known()) for t in family(rng, 40, 3)]
    registers = setsketch.sketches(sets)
    labels = np.arange(40)
    found = setsketch.tile_links(labels, np.zeros(40, bool), registers, sets, 85)
    assert all(setsketch.linked(sets[a], sets[b], 85) for a, b in found) and len(found) <= 39
    assert setsketch.tile_links(np.zeros(40, np.int64), np.zeros(40, bool), registers, sets, 85) == []


def test_queries_give_one_row_per_document(spark):
    assert QUERIES["op13_setsketch_dedup"](spark, SF_DIR).count() == len(documents())

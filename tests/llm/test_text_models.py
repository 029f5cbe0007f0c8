"""Token counts, quality rules, quality classifier, sampled segmentations."""

import math
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD_TEXTS, SF_DIR, documents, frame
from xxhash import xxh64_hexdigest

from framelake.llm import piece_sampling, quality_classifier, quality_rules, token_counts
from framelake.llm.queries import QUERIES

ODD_WORDS = [
    "It's can't <|endoftext|>x <|endoftext|> a<|end|> <|startoftext|", "\x1c!\x1d?", "é ́x İI ΑΣ ΟΔΟΣ,",
    "가 한국어", "zero​width a\u0085b", "'S 'LL 'tis", "ŉ Ĳĳ ſ ÷ ×", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ĄąĆć ŸÿŽž",
    "!!!??? ..... ;;; #$%^&*()", "12345 ½ Ⅷ ١",
]


# ---- op5 ----

@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(public_tokenizers.path(token_counts.VOCABULARY))


def library_count(counter, text):
    return len(counter.library.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(counter):
    for text in [r["text"] for r in documents()] + [t or "" for t in ODD_TEXTS] + ODD_WORDS:
        assert counter.count(text) == library_count(counter, text), text[:80]


def test_every_prefix_is_exact(counter):
    for text in [*ODD_WORDS, documents()[0]["text"][:300], "naïve Café don't UNBELIEVABLE!!"]:
        made = counter.prefix_table(text)
        for k in range(len(text) + 1):
            assert counter.count_prefix(text, k, made) == library_count(counter, text[:k]), text[:k]


def test_piece_prefixes(counter):
    for piece in ["unbelievable", "ththing", "a", "!!!???", "zzzzzzzzzz"]:
        assert counter.piece_prefixes(piece) == [library_count(counter, piece[:k]) for k in range(len(piece) + 1)]


def test_texts_without_spaces_are_cut_inside(spark, counter):
    chinese = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(5000))
    texts = [chinese, "abcDEF0123+/" * 420, "short https://example.com/" + "path-it's/" * 40, "e\u0301" * 40 + "x<|endoftext|>'re", "각" * 30]
    docs = frame(spark, texts)
    cut = {r.doc_id: r.text for r in token_counts.truncate_to_budget(docs, token_counts.prefix_table(docs), 100).collect()}
    for k, text in enumerate(texts):
        counts = counter.prefix_table(text)[1] if " " not in text else None
        size = len(cut[k])
        assert size and cut[k] == text[:size] and library_count(counter, cut[k]) <= 100
        assert size == len(text) or library_count(counter, text[:size + 1]) > 100
        for j in range(1, len(text) + 1, 97 if len(text) > 1000 else 1) if counts else ():
            assert counts[j - 1] == library_count(counter, text[:j]), (k, j)
    assert len(cut[0]) > 20 and counter.longest_within(chinese, 100) == len(cut[0])


def test_token_query_and_truncation(spark, counter):
    rows = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, SF_DIR).collect()}
    docs = documents()
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d["doc_id"]]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d["text"].encode()), library_count(counter, d["text"]), r.n_tokens > 2048)
    few = frame(spark, [None, "", "one two three", "  a  b  "])
    cut = {r.doc_id: r.text for r in token_counts.truncate_to_budget(few, token_counts.prefix_table(few), 2).collect()}
    assert cut == {0: "", 1: "", 2: "one two", 3: "  a  b"}
    clash = token_counts.token_counts(frame(spark, [None, "a"]).selectExpr("*", "5 AS n_tokens"), keep=("lang",)).collect()
    assert [(r.n_bytes, r.n_tokens, r.lang) for r in clash] == [(0, 0, "en"), (1, 1, "en")]
    assert token_counts.token_counts(few.limit(0)).collect() == []


# ---- op8 ----

def plain_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    inside = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:k] for k, x in enumerate(lines)), len(inside))


def test_rule_counts_equal_plain_ones(spark):
    texts = [r["text"] for r in documents(60)] + [t for t in ODD_TEXTS if t is None or len(t.split()) < 2000] + [
        "a b c d e " * 4, "x\ny\nx\n\n \nx y\n", "a a a a a a", "a a a a a", "##**$$ %&|<>", "a b c d e f a b c d e", "\x0b\x0c\r a\x1cb"]
    for text in texts:
        assert quality_rules.text_counts(text)[:5] == plain_counts(text), text
    rows = quality_rules.apply_rules(quality_rules.text_statistics(frame(spark, texts)), []).collect()
    assert [r.kept for r in rows] == [not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows]


def test_rule_query_rejects_what_labels_reject(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF_DIR.replace("0.001", "0.01")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/labels.parquet").collect()}
    judged = [(rows[k].kept, q) for k, q in labels.items() if not rows[k].base_failed]
    assert sum(k == (q == 1) for k, q in judged) / len(judged) > 0.95
    assert sum(k for k, q in judged if q == 1) / sum(q == 1 for _, q in judged) > 0.99


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = quality_rules.learn_rules(x, bad)
    got = np.zeros(3000, bool)
    for rule in rules:
        got |= quality_rules._covered(rule, x, 3000)
    assert (got == bad).mean() > 0.98
    assert quality_rules.learn_rules({"a": np.zeros(0)}, np.zeros(0, bool)) == []
    assert quality_rules.learn_rules({"a": np.ones(9)}, np.ones(9, bool)) == []


# ---- op2 ----

def test_classifier_on_held_out_rows(spark):
    where = SF_DIR.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, where).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(where + "/labels.parquet").collect()}
    from zlib import crc32

    assert len(rows) == 1000 and all(r.held_out == (crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[k].predicted, q) for k, q in labels.items() if rows[k].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.88


def test_context_sums_equal_plain_ones(spark):
    texts = ["a b c a", None, "", "b, b!", "c"]
    places, signs = quality_classifier.index_vectors(64, 8)
    want, n = np.zeros((64, 8), np.int64), np.zeros(64, np.int64)
    for text in texts:
        found = quality_classifier.word_buckets(text, 64)
        for w in found:
            n[w] += 1
        for a, b in pairwise(found):
            for k in range(quality_classifier.NONZERO):
                want[a, places[b, k]] += signs[b, k]
                want[b, (places[a, k] + 1) % 8] += signs[a, k]
    rows = quality_classifier.context_sums(frame(spark, texts), 64, 8).collect()
    assert {r.bucket: r.n for r in rows} == {k: v for k, v in enumerate(n) if v}
    assert all(list(want[r.bucket]) == r.sums for r in rows)


def test_classifier_without_rows_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [None, "", "a b"]).selectExpr("*", "1 AS score")
    assert [r.score for r in quality_classifier.quality_scores(docs, labels).collect()] == [0.5, 0.5, 0.5]
    assert quality_classifier.quality_scores(docs.limit(0), labels).collect() == []


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, 20000)
    y = rng.random(20000) < 1 / (1 + np.exp(-z))
    assert abs(quality_classifier.fit_temperature(z * 3, y.astype(float)) - 3) < 0.2


# ---- op4 ----

@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path(piece_sampling.MODEL))


def all_segmentations(pieces, weights, text):
    """Every path through the lattice of a whole text, without units: ids and weight."""
    def walk(s):
        if not s:
            yield (), 1.0
        for k in range(1, min(16, len(s)) + 1):
            if s[:k] in weights:
                for ids, w in walk(s[k:]):
                    yield (weights[s[:k]][0], *ids), weights[s[:k]][1] * w
        if s and s[0] not in weights:
            raw = s[0].encode()
            for ids, w in walk(s[1:]):
                yield (*[pieces.byte_id[b] for b in raw], *ids), math.exp(pieces.log_byte * len(raw)) * w
    found = list(walk("▁" + text.replace(" ", "▁")))
    total = sum(w for _, w in found)
    return {ids: w / total for ids, w in found}


def test_sampling_against_all_segmentations(library):
    sampler = piece_sampling.Sampler(public_tokenizers.path(piece_sampling.MODEL), samples=4)
    weights = {library.id_to_piece(k): (k, 1 / (min(-library.get_score(k), 32000.0) + 2)) for k in range(259, 32000)}
    for text in ["the cat", " a,b", "x  yz", "é\n😀t"]:
        exact = all_segmentations(sampler.pieces, weights, text)
        first, pairs, n = {}, {}, 3000
        for key in range(n):
            out = sampler.sample(text, key)
            ids = [tuple(x[0].tolist()) for x in out]
            assert len(set(ids)) == len(ids) == min(4, len(exact))
            assert all(a[2] >= b[2] for a, b in pairwise(out))
            for i, (_, log_p, _, inclusion) in zip(ids, out, strict=True):
                assert math.isclose(math.exp(log_p), exact[i], rel_tol=1e-6) and inclusion <= 1e-9
                assert sampler.pieces.decode(list(i)) == text == library.decode(list(i))
            first[ids[0]] = first.get(ids[0], 0) + 1
            pairs[ids[1]] = pairs.get(ids[1], 0) + 1
        for ids, p in exact.items():
            second = sum(q * p / (1 - q) for other, q in exact.items() if other != ids)
            assert abs(first.get(ids, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3
            assert abs(pairs.get(ids, 0) / n - second) < 5 * math.sqrt(second * (1 - second) / n) + 2e-3


def test_inclusion_scores_estimate_totals():
    """Summing f / inclusion over the samples is an unbiased estimate of the sum over all segmentations."""
    sampler = piece_sampling.Sampler(public_tokenizers.path(piece_sampling.MODEL), samples=5)
    sums = [sum(math.exp(p - inclusion) for _, p, _, inclusion in sampler.sample("the cat sat", key)) for key in range(2000)]
    assert abs(np.mean(sums) - 1) < 5 * np.std(sums) / math.sqrt(len(sums)) + 1e-3


def test_sampled_rows(spark, library):
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 6000] + ["a ▁ b"]
    docs = frame(spark, texts).selectExpr("*", "1 AS sample", "2 AS ids")
    rows = piece_sampling.sampled_segmentations(docs.unionAll(docs)).collect()
    seen = {}
    for r in rows:
        seen.setdefault((r.doc_id, r.sample), []).append(tuple(r.ids))
        assert library.decode(r.ids) == (texts[r.doc_id] or "").replace("▁", " ") and len(r.ids) == r.n_pieces
        assert r.decoded_equal == ("▁" not in (texts[r.doc_id] or ""))
    assert all(len(v) == 2 and v[0] == v[1] for v in seen.values())
    assert {d for d, _ in seen} == set(range(len(texts))) and (0, 2) not in seen and (1, 2) not in seen
    back = piece_sampling.decoded_texts(piece_sampling.sampled_segmentations(frame(spark, ["x y", ""]))).collect()
    assert {r.text for r in back} == {"x y", ""}
    assert piece_sampling.sampled_segmentations(docs.limit(0)).collect() == []


def test_sampling_query_returns_the_segmentations(spark, library):
    texts = {d["doc_id"]: d["text"] or "" for d in documents()}
    rows = QUERIES["op4_piece_sampling"](spark, SF_DIR).collect()
    assert all(library.decode(r.ids) == texts[r.doc_id].replace("▁", " ") and len(r.ids) == r.n_pieces for r in rows)
    assert all(xxh64_hexdigest(np.array(r.ids, np.int32).tobytes()) == r.ids_hash for r in rows)


def test_pieces_of_a_text_with_characters_past_the_last_that_begins_a_piece():
    pieces = piece_sampling.Pieces(public_tokenizers.path(piece_sampling.MODEL))
    text = "▁the\U0010fffda😀▁cat"
    found = set(zip(*[x.tolist() for x in pieces.matches(np.array([ord(c) for c in text], np.int64))], strict=True))
    words = {pieces.bytes[k].decode(): k for k in range(259, len(pieces.bytes)) if pieces.bytes[k]}
    plain = text.replace("▁", " ")
    assert found == {(i, n, words[plain[i:i + n]]) for i in range(len(text)) for n in range(1, len(text) - i + 1) if plain[i:i + n] in words}


def random_words(n, seed=3):
    rng = np.random.default_rng(seed)
    return ["".join(w) for w in rng.choice(list("abcdefghij"), (n, 9))]


def test_sets_of_a_long_path_are_drawn_as_far_as_they_can_be_asked_for(monkeypatch):
    pieces = piece_sampling.Pieces(public_tokenizers.path(piece_sampling.MODEL))
    texts = [" ".join(random_words(2000)), "a", "the cat sat on"]
    drawn, uniform = [], piece_sampling._uniform
    monkeypatch.setattr(piece_sampling, "_uniform", lambda keys, step=0: drawn.append(np.size(keys)) or uniform(keys, step))
    found = piece_sampling.Sampler(pieces).sample_group(texts, [1, 2, 3])
    assert sum(drawn) < 1.2 * sum(len(x[0]) for rows in found for x in rows)  # before, a second one for every piece
    monkeypatch.setattr(piece_sampling, "WINDOW", 1 << 16)  # all sets of all paths
    for some, all_ in zip(found, piece_sampling.Sampler(pieces).sample_group(texts, [1, 2, 3]), strict=True):
        assert [(x[0].tolist(), *x[1:]) for x in some] == [(x[0].tolist(), *x[1:]) for x in all_]


def test_samples_do_not_depend_on_neighbours():
    pieces = piece_sampling.Pieces(public_tokenizers.path(piece_sampling.MODEL))
    texts = ["word", "", " a  b", "x ▁ y", "word word", "é\n😀t"]
    together = piece_sampling.Sampler(pieces).sample_group(texts, list(range(6)))
    for k in range(6):
        for group in ([texts[k]], [texts[k], ""], ["", texts[k]]):
            found = piece_sampling.Sampler(pieces).sample_group(group, [k] * len(group))[group.index(texts[k])]
            assert [(x[0].tolist(), *x[1:]) for x in found] == [(x[0].tolist(), *x[1:]) for x in together[k]]


def test_a_task_compiles_a_bounded_number_of_units_together(monkeypatch):
    sizes, compile_ = [], piece_sampling.Lattices._compile
    monkeypatch.setattr(piece_sampling.Lattices, "_compile", lambda self, units: sizes.append(len(units)) or compile_(self, units))
    sampler = piece_sampling.Sampler(public_tokenizers.path(piece_sampling.MODEL))
    sampler.sample(" ".join(random_words(20_000)), 1)
    assert sum(sizes) > 19_000 and max(sizes) <= 8192  # before, all in one call
    assert piece_sampling.EDGES_KEPT * 24 < 100e6


def test_samples_are_the_same_after_rare_words_are_dropped(monkeypatch):
    pieces = piece_sampling.Pieces(public_tokenizers.path(piece_sampling.MODEL))
    common = random_words(40, 1)
    texts = [" ".join(common[k % 7::3] + random_words(60, 9 + k)) for k in range(12)]
    monkeypatch.setattr(piece_sampling, "EDGES_KEPT", 2500)
    sampler, kept = piece_sampling.Sampler(pieces), []
    drop = piece_sampling.Lattices._drop_rare
    monkeypatch.setattr(piece_sampling.Lattices, "_drop_rare", lambda self: drop(self) or kept.append(len(self.words)))
    for k, text in enumerate(texts):
        mine, plain = sampler.sample(text, k), piece_sampling.Sampler(pieces).sample(text, k)
        assert [(x[0].tolist(), *x[1:]) for x in mine] == [(x[0].tolist(), *x[1:]) for x in plain]
    assert max(kept) > 0


def test_sampling_query_covers_all_documents(spark):
    rows = QUERIES["op4_piece_sampling"](spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == {d["doc_id"] for d in documents()} and all(r.decoded_equal for r in rows)
    assert len({(r.doc_id, r.ids_hash) for r in rows}) == len(rows)

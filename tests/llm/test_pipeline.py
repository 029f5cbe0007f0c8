"""The pipeline's stages one by one against brute force, and as a whole."""

import re

import pytest
from helpers import SF_DIR, documents
from test_joins import plain_components, plain_fingerprint
from test_scanners import PII_PLAIN, plain_spans
from test_text_models import plain_counts

import __spark_entry__
import corpus_pipeline
from framelake.llm import quality_rules

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, as rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        given = docs.collect()
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS, name
        out.append((given, docs.collect()))
    return out


def test_quality_stage(spark, stages):
    given, kept = stages[0]
    ids = {r.doc_id for r in kept}
    texts = {r.doc_id: r for r in given}
    assert all(r == texts[r.doc_id] for r in kept) and len(ids) == len(kept)
    failed = {r.doc_id for r in given if (c := plain_counts(r.text))[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert not ids & failed
    rules = quality_rules.fit_rules_on_texts(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    stats = quality_rules.apply_rules(quality_rules.text_statistics(spark.read.parquet(f"{SF_DIR}/documents.parquet")), rules)
    assert ids == {r.doc_id for r in stats.where("kept").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").collect()} & set(texts) - failed
    assert len(good & ids) >= 0.97 * len(good)


def test_dedup_stage(stages):
    given, kept = stages[1]
    component = plain_components({r.doc_id: plain_fingerprint(r.text) for r in given})
    assert sorted(r.doc_id for r in kept) == sorted(set(component.values()))


def test_pii_stage(stages):
    given, out = stages[2]
    before = {r.doc_id: r for r in given}
    assert len(out) == len(given)
    for r in out:
        old = before[r.doc_id]
        assert (r.lang, r.source) == (old.lang, old.source) and r.n_chars == len(r.text)
        if not plain_spans(old.text, PII_PLAIN):
            assert r.text == old.text or re.search("<(SPOKEN_EMAIL|LOCAL_PHONE|NATIONAL_ID)>", r.text)
        else:
            assert not plain_spans(r.text, PII_PLAIN) and r.text != old.text


def test_mix_stage(stages):
    given, out = stages[3]
    size = {r.doc_id: len(re.findall(WORD, r.text)) for r in given}
    source = {r.doc_id: r.source for r in given}
    taken = {}
    for r in out:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(re.findall(WORD, r.text))
    assert all(n <= 2 * size[k] for k, n in taken.items())
    per = {}
    for k, n in size.items():
        x = per.setdefault(source[k], [0, 0])
        x[0] += n
        x[1] += taken.get(k, 0)
    total = sum(size.values())
    assert abs(sum(t for _, t in per.values()) - 1.5 * total) <= len(per) * (1.5 * total / 2**18 + 2)
    order = sorted(per)
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(order)}
    level = max(per[n][1] / weight[n] for n in order)
    for n in order:
        assert per[n][1] >= 2 * per[n][0] - 4 or per[n][1] / weight[n] >= level - 8


def test_encoding_stage(stages):
    given, out = stages[4]
    texts = {}
    for r in given:
        texts.setdefault(r.doc_id, set()).add(r.text)
    assert {r.doc_id for r in out} == set(texts) and all(r.decoded_equal for r in out)
    assert sum(r.sample == 1 for r in out) == len(given)


def test_whole_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "sample", "ids_hash").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.sample, r.ids_hash) for r in stages[-1][1])
    assert {"pipeline", *(f"op{n}_" for n in range(1, 14))} <= {re.sub(r"(op\d+_).*", r"\1", q) for q in __spark_entry__.queries()}
    assert len(documents()) > 0

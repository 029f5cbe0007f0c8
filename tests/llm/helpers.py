"""Inputs shared by the tests of the text operators."""

import pyarrow.parquet as pq

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

ODD_TEXTS = [
    None, "", " ", "\n\t", "a", "a b", "a b c", " x y", "naïve Café ÀÉ İstanbul", "日本語 テキスト", "👍🏽 ok", "\x00 zero \x1c!",
    "word " * 3000, "x" * 20000, "0123456789abcdef" * 40, "1 2 3 4 5 6 7 8 " * 700, "a.b@" * 500, "+1 " * 400, "é" * 5000,
]


def documents(limit=None):
    rows = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    return rows[:limit] if limit else rows


def frame(spark, texts, first=0):
    rows = [(first + k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)

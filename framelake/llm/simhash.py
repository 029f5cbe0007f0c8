"""SimHash near-duplicates: 64-bit fingerprints, exact links within three bits, connected components.

Equal fingerprints are one node.  Two fingerprints that differ in at most three of 64 bits agree on at
least two of five bit blocks, so every pair of blocks is a key and linked nodes meet under one of ten
keys; the comparison under a key is exact and nothing is approximate.  The nodes of a key are dealt by
hash to tiles of about ``TILE``; every pair of tiles is a group of its own, so a key with very many nodes
becomes many small groups.  Inside a group both tiles are sorted by the number of set bits and compared
strip by strip with exclusive-or and bit counts; strips whose bit counts differ by more than the radius
are skipped.  A group returns a spanning forest of its links, not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from framelake.llm.common import arrow_rows
from framelake.scratch import checkpointed

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and width
TILE, STRIP = 512, 128
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer (no words: zero)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    if len(words) >= SHINGLE:
        ends = (starts + sizes)[SHINGLE - 1:]
        starts = starts[:len(ends)]
    else:
        starts, ends = starts[:1], [len(data)]
    n = len(ends)
    hashes = np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts.tolist(), list(ends), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, n, SHINGLES_AT_ONCE):
        part = hashes[begin:begin + SHINGLES_AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (signed 64-bit) and ``text_hash`` of every whole text; null texts are empty texts; one row per row."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "fp", "text_hash")])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return arrow_rows(rows, lambda: lambda doc_id, text, text_hash: (doc_id, fingerprint(text), text_hash), rows.columns, schema)


def linked_forest(a: np.ndarray, tile: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, other) that join what is within ``radius`` bits in one group.

    ``a``: unsigned fingerprints; ``tile``: False and True for the two tiles; all equal: one tile against itself.
    """
    weight = np.bitwise_count(a)
    first, second = np.flatnonzero(~tile), np.flatnonzero(tile)
    alone = not len(first) or not len(second)
    if alone:
        first = second = np.arange(len(a))
    first, second = first[np.argsort(weight[first], kind="stable")], second[np.argsort(weight[second], kind="stable")]
    links = []
    for r in range(0, len(first), STRIP):
        rows = first[r:r + STRIP]
        low, high = int(weight[rows[0]]) - radius, int(weight[rows[-1]]) + radius
        for c in range(r if alone else 0, len(second), STRIP):
            columns = second[c:c + STRIP]
            if weight[columns[0]] > high:
                break
            if weight[columns[-1]] < low:
                continue
            x, y = np.nonzero(np.bitwise_count(a[rows][:, None] ^ a[columns][None, :]) <= radius)
            x, y = rows[x], columns[y]
            links.append(np.stack([x[x != y], y[x != y]]))
    label = np.arange(len(a))
    pairs = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    while pairs.size:
        low = np.minimum(label[pairs[0]], label[pairs[1]])
        after = label.copy()
        np.minimum.at(after, pairs[0], low)
        np.minimum.at(after, pairs[1], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    other = np.flatnonzero(label != np.arange(len(a)))
    return a[label[other]], a[other]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal keys, as one batch each; the input is sorted by the keys."""
    waiting: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if key != current and waiting:
                yield waiting[0] if len(waiting) == 1 else pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
            current = key
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield waiting[0] if len(waiting) == 1 else pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that connect all distinct ``fp`` within ``RADIUS`` bits of each other (a spanning set per group)."""
    masks = []
    for pair in combinations(BLOCKS, 2):
        mask = sum(((1 << width) - 1) << first for first, width in pair)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keyed = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)
    ])).alias("_k")).select("fp", "_k.t", "_k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = (
        keyed.join(sizes, ["t", "key"]).withColumn("_tiles", tiles)
        .withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_tiles")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .select("t", "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "fp",
                (F.col("_own") > F.col("_other")).alias("second"))
    )
    group = ["t", "key", "i", "j"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, others, size = [], [], 0
        for one in _groups(batches, group):
            fp = one.column("fp").to_numpy().view(np.uint64)
            root, other = linked_forest(fp, one.column("second").to_numpy(zero_copy_only=False))
            if len(root):
                roots.append(root)
                others.append(other)
                size += len(root)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (roots, others)], schema=schema)
                roots, others, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (roots, others)], schema=schema)

    cells = dealt.repartition(*group).sortWithinPartitions(*group)
    return cells.mapInArrow(run, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (root < node) for every linked node that is not the smallest of its component.

    Rounds of large-star and small-star steps; each round is written to the checkpoint folder and the
    links are compared by count and hash sum with the round before.
    """
    def signature(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = checkpointed(links)
    before = None
    while (now := signature(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(up, "b")
        edges = checkpointed(
            moved.select(F.col("m").alias("a"), "b")
            .union(moved.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b")))
            .distinct()
        )
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _joined_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, fp, text_hash`` of every row; ``fp, root, component_id`` of every fingerprint)."""
    marked = checkpointed(fingerprints(docs))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(fingerprint_links(nodes))
    linked = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    named = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most three differing bits.
    Rows without a ``doc_id`` link like others and get their component's id (null if no row of it has
    one).  Texts without words have fingerprint zero.  Only doc_id and text are read.
    """
    marked, named = _joined_components(docs)
    ids = named.select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(ids, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest ``doc_id``, then the smallest text hash.

    Rows of one id and unlike texts are documents of their own; a row that repeats id and text is the same document.  A component
    none of whose rows has a ``doc_id`` keeps one of its rows.
    """
    marked, named = _joined_components(docs)
    # id and text tell rows apart; rows without an id come last and are told apart by their text alone
    identity = ["_nameless", "_handle", "_text"]
    of = lambda text_hash: [F.col("doc_id").isNull(), F.coalesce("doc_id", text_hash), text_hash]
    own = F.struct(*[c.alias(n) for c, n in zip(of(F.col("text_hash")), identity, strict=True)])
    first = marked.groupBy("fp").agg(F.min(own).alias("_first")).join(named.select("fp", "root"), "fp")
    chosen = first.groupBy("root").agg(F.min("_first").alias("_first")).select("_first.*")
    rows = docs.withColumns(dict(zip(identity, of(F.xxhash64("text")), strict=True)))
    return rows.join(chosen, identity, "left_semi").dropDuplicates(identity).select(*docs.columns)

"""Near-duplicates by SetSketch registers, exact on full shingle sets.

* **Registers.**  ``REGISTERS`` hash functions turn the shingles of a document into exponential values; a register
  keeps ``floor(1 - log_b(minimum))``, cut to 16 bits.  Registers of a union are the larger ones of its parts, so
  long texts are sketched piece by piece.  Equal shingle sets are one node with a number of its own.
* **Candidates.**  Runs of ``BAND`` registers are the keys of ``BANDS`` bands.  At a similarity of 0.85 a pair shares
  no key with probability (1 - 0.85^5)^24, below one in a million.
* **Estimate.**  For two sketches the numbers of larger, smaller and equal registers and both set sizes give
  the likelihood of every similarity; a pair is dropped if its best similarity is ``e^20`` times likelier than
  the threshold.  Nothing else is decided by a sketch.
* **Verify.**  1. Every node meets the best estimated hub (smallest node) of its keys, on full sets: one pair
  per node, however large a key is, which settles tight groups.  2. Keys whose nodes are still in several
  components are joined to coarse groups.  Nodes of the largest one in it are compared with the other
  ones only, in tiles of ``TILE``, on full sets; a tile pair returns a spanning forest of its links.

Sets are built only for nodes that share a key with another node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from framelake.llm.common import ROWS_AT_ONCE
from framelake.llm.simhash import components
from framelake.scratch import Intermediate, checkpointed

SHINGLE, PERCENT = 5, 85
BANDS, BAND = 24, 5
REGISTERS = BANDS * BAND
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
UNLIKELY = 20.0  # natural logarithm of the odds against the threshold beyond which a pair is dropped
JUMPS = 3  # a node knows the hub that is up to 2**JUMPS steps above it
TILE = 256
PAIRS_AT_ONCE = 1 << 15
COLUMNS_AT_ONCE, KEPT_WORDS = 4096, 1 << 18

_constants = np.random.default_rng(42)
MULTIPLIERS = _constants.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _constants.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Known(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxh64_intdigest(word)
        return found


def shingle_set(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text (null or no words: none)."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n >= SHINGLE:
        h = sum(w[j:n - SHINGLE + 1 + j] * PLACES[j] for j in range(SHINGLE))
    else:
        h = (w * PLACES[:n]).sum(keepdims=True) + PLACES[SHINGLE:] * np.uint64(n)
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(33)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of every set, one row of 16-bit numbers each; an empty set has zeros."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    least = np.full((REGISTERS, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(sizes)
    values = np.concatenate([sets[k] for k in full]) if len(full) else np.zeros(0, np.uint64)
    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
    for at in range(0, len(values), COLUMNS_AT_ONCE):
        part = np.multiply.outer(MULTIPLIERS, values[at:at + COLUMNS_AT_ONCE])
        low, high = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, at + part.shape[1], "left")
        owners = full[low:high]
        found = np.minimum.reduceat(part, np.maximum(begins[low:high] - at, 0), axis=1)
        least[:, owners] = np.minimum(least[:, owners], found)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    registers = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST)
    registers[:, sizes == 0] = 0
    return np.ascontiguousarray(registers.T.astype("<u2"))


def likely_similarity(na: np.ndarray, nb: np.ndarray, larger: np.ndarray, smaller: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, log odds against the threshold) of pairs, from set sizes and counts of registers.

    ``larger``, ``smaller``: registers of the first sketch above and below the second's; the rest are equal.
    """
    u = na / (na + nb)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    unequal = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    part = lambda n, p: np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0.0)

    def logarithm(j: np.ndarray) -> np.ndarray:
        p, q = unequal(u - v * j), unequal(v - u * j)
        return part(larger, p) + part(smaller, q) + part(equal, 1 - p - q)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(24):  # the likelihood has one peak
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        rising = logarithm(left) < logarithm(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    best = (low + high) / 2
    against = logarithm(best) - logarithm(np.full(len(u), threshold))
    return best, np.where(best >= threshold, 0.0, against)


def possible(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, whether a link may be) for rows of registers ``a`` and ``b``; sizes alone rule a pair out exactly."""
    best, against = likely_similarity(na.astype(float), nb.astype(float), (a > b).sum(1), (a < b).sum(1), percent / 100)
    return best, (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (against <= UNLIKELY)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on full sets of sorted distinct hashes."""
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _arrow_chunks(df: DataFrame, function: Callable[[], Callable[[pa.RecordBatch], list]], schema: str) -> DataFrame:
    """Map ``ROWS_AT_ONCE`` rows at a time to columns of ``schema``; ``function`` is made once per task."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = function()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = one(batch.slice(start, ROWS_AT_ONCE))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def _handles(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the handle by which a text is found again: the id, or a hash of a text without one."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.xxhash64("text")).alias("handle"))


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, nameless, handle, n`` (set size), ``digest`` of the set and ``sketch`` of every row."""
    def function() -> Callable[[pa.RecordBatch], list]:
        known = _Known()

        def one(batch: pa.RecordBatch) -> list:
            sets = [shingle_set(t, known) for t in batch.column("text").to_pylist()]
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return [*(batch.column(c) for c in ("doc_id", "nameless", "handle")), list(map(len, sets)), digests, [r.tobytes() for r in sketches(sets)]]

        return one

    return _arrow_chunks(_handles(docs), function, "doc_id bigint, nameless boolean, handle bigint, n bigint, digest binary, sketch binary")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, hashes`` of the nodes of ``wanted`` (``node, digest, nameless, handle``); only their texts are shuffled."""
    texts = _handles(docs).join(wanted.select("node", "digest", "nameless", "handle"), ["nameless", "handle"]).select("text", "node", "digest")

    def function() -> Callable[[pa.RecordBatch], list]:
        known = _Known()

        def one(batch: pa.RecordBatch) -> list:
            sets = [shingle_set(t, known).tobytes() for t in batch.column("text").to_pylist()]
            nodes, digests = (batch.column(c).to_pylist() for c in ("node", "digest"))
            made = [(n, s) for n, d, s in zip(nodes, digests, sets, strict=True) if blake2b(s, digest_size=16).digest() == d]
            return [[n for n, _ in made], [s for _, s in made]]

        return one

    # rows that share an id and a text give their node twice
    return _arrow_chunks(texts, function, "node bigint, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _registers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _pair(df: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``values`` of both ends of pairs (``a``, ``b``), as a_... and b_..."""
    for end in ("a", "b"):
        df = df.join(values.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return df


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b, similarity`` of the pairs that may be links."""
    def function() -> Callable[[pa.RecordBatch], list]:
        def one(batch: pa.RecordBatch) -> list:
            na, nb = (batch.column(f"{e}_n").to_numpy() for e in "ab")
            best, may = possible(na, nb, *(_registers(batch.column(f"{e}_sketch")) for e in "ab"), percent)
            at = pa.array(np.flatnonzero(may))
            return [batch.column("a").take(at), batch.column("b").take(at), best[may]]

        return one

    sized = _pair(pairs, nodes, ["n", "sketch"]).where(
        100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")).select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    return _arrow_chunks(sized, function, "a bigint, b bigint, similarity double")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are links on full sets."""
    def function() -> Callable[[pa.RecordBatch], list]:
        def one(batch: pa.RecordBatch) -> list:
            left, right = (batch.column(f"{e}_hashes").to_pylist() for e in "ab")
            at = pa.array([k for k, (x, y) in enumerate(zip(left, right, strict=True))
                           if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)], pa.int64())
            return [batch.column("a").take(at), batch.column("b").take(at)]

        return one

    return _arrow_chunks(_pair(pairs, sets, ["hashes"]).select("a", "b", "a_hashes", "b_hashes"), function, "a bigint, b bigint")


def tile_links(labels: np.ndarray, second: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes with unlike ``labels`` in one tile pair; all False: one tile against itself.

    A pair is looked at if it shares a key of a band, is estimated, and then verified on full sets.
    """
    n = len(labels)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    first, other = np.flatnonzero(~second), np.flatnonzero(second)
    alone = not len(first) or not len(other)
    if alone:
        first = other = np.arange(n)
    bands = np.ascontiguousarray(registers).view(f"V{2 * BAND}").reshape(n, BANDS)
    bands = np.stack([np.unique(bands[:, t], return_inverse=True)[1].reshape(-1) for t in range(BANDS)])
    part = np.unique(labels, return_inverse=True)[1]  # the component of every node, as far as it is known here
    meets = np.zeros((len(first), len(other)), bool)
    for band in bands:
        meets |= band[first][:, None] == band[other][None, :]
    meets &= part[first][:, None] != part[other][None, :]
    if alone:
        meets = np.triu(meets, 1)
    x, y = np.nonzero(meets)
    for at in range(0, len(x), PAIRS_AT_ONCE):
        u, v = x[at:at + PAIRS_AT_ONCE], y[at:at + PAIRS_AT_ONCE]
        a, b = first[u], other[v]
        meets[u, v] = possible(sizes[a], sizes[b], registers[a], registers[b], percent)[1]
    # which sets of the second side hold a hash
    values, owner = np.concatenate([sets[k] for k in other]), np.repeat(np.arange(len(other)), sizes[other])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    found = []
    for at, a in enumerate(first.tolist()):
        b = np.flatnonzero(meets[at] & (part[other] != part[a]))
        if not len(b):
            continue
        begin, end = np.searchsorted(values, sets[a], "left"), np.searchsorted(values, sets[a], "right")
        lengths = end - begin
        places = np.arange(int(lengths.sum())) + np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        both = np.bincount(owner[places], minlength=len(other))[b]
        for k in other[b[100 * both >= percent * (sizes[a] + sizes[other[b]] - both)]].tolist():
            if part[a] != part[k]:
                part[part == part[k]] = part[a]
                found.append((a, k))
    return found


def _tiled_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between components, for ``members`` with ``node, coarse, label, n, sketch, hashes``."""
    counts = members.groupBy("coarse", "label").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.groupBy("coarse").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).select(
        "coarse", F.col("m.label").alias("major"), F.ceil(F.col("m.n") / TILE).cast("int").alias("majors"),
        F.ceil((F.col("all") - F.col("m.n")) / TILE).cast("int").alias("minors")).where("minors > 0")
    is_major = F.col("label") == F.col("major")
    spread = F.xxhash64("node")
    dealt = (
        members.join(shares, "coarse")
        .withColumn("_own", F.when(is_major, F.col("minors") + F.pmod(spread, F.col("majors"))).otherwise(F.pmod(spread, F.col("minors"))).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(is_major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)))
        .select("coarse", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).alias("second"),
                "node", "label", "n", "sketch", "hashes")
    )
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in group.column("hashes").to_pylist()]
        pairs = tile_links(group.column("label").to_numpy(), group.column("second").to_numpy(), _registers(group.column("sketch")), sets, percent)
        nodes = group.column("node").to_numpy()
        return pa.Table.from_arrays([pa.array(nodes[[p[e] for p in pairs]] if pairs else [], pa.int64()) for e in (0, 1)], schema=out)

    return dealt.groupBy("coarse", "i", "j").applyInArrow(search, "a bigint, b bigint")


def _connected(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes with a link ``a, b``, roots included."""
    ordered = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with Intermediate(links.sparkSession) as steps:  # read as a table: what the optimizer knows of the links' origin misleads its unions
        found = components(steps.write(ordered, "links"))
    return checkpointed(found.union(found.select(F.col("root").alias("node"), "root").distinct()))


def set_links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` that connect all nodes (``node, digest, n, sketch, nameless, handle``) as the links on full sets do."""
    band = lambda t: F.xxhash64(F.lit(t), F.substring("sketch", 2 * BAND * t + 1, 2 * BAND))
    keyed = nodes.select("node", F.posexplode(F.array(*[band(t) for t in range(BANDS)])).alias("t", "key"))
    keys = keyed.groupBy("t", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1")
    meeting = checkpointed(keyed.join(keys, ["t", "key"]))
    wanted = meeting.select("node").distinct().join(nodes.select("node", "digest", "nameless", "handle"), "node")
    sets = checkpointed(full_sets(docs, wanted))
    spokes = meeting.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = checkpointed(estimated(spokes, nodes, percent))
    best = near.groupBy("a").agg(F.max(F.struct("similarity", "b")).alias("_b")).select("a", F.col("_b.b").alias("b"))
    first = checkpointed(verified(best, sets, percent))
    labels = first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(JUMPS):  # what is still apart after these jumps is compared once more, nothing else
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("_further"))
        labels = checkpointed(labels.join(further, "root", "left").select("node", F.coalesce("_further", "root").alias("root")))
    label = lambda name, of: labels.select(F.col("node").alias(of), F.col("root").alias(name))
    mixed = (
        meeting.where("node != hub").join(label("_l", "node"), "node", "left").join(label("_h", "hub"), "hub", "left")
        .where(F.coalesce("_l", "node") != F.coalesce("_h", "hub"))
        # two nodes alone under a key whose estimate rules a link out have nothing left to compare
        .join(near.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("_may")), ["node", "hub"], "left")
        .where(F.col("_may") | (F.col("many") > 2)).select("t", "key").distinct()
    )
    left = checkpointed(meeting.join(mixed, ["t", "key"], "left_semi"))
    coarse = _connected(left.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = (
        coarse.select("node", F.col("root").alias("coarse")).join(label("_l", "node"), "node", "left")
        .select("node", "coarse", F.coalesce("_l", "node").alias("label"))
        .join(nodes.select("node", "n", "sketch"), "node").join(sets, "node")
    )
    return first.union(_tiled_links(members, percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``n_shingles``: distinct runs of five words (A-Z in lower case); a text of fewer words is one shingle, a text that is null or has
    no words none, and links with nothing.  ``component_id``: the smallest ``doc_id`` reachable over links of at
    least ``percent`` per cent common shingles.  Rows without a ``doc_id`` link like others and get their component's
    id (null if no row of it has one).  ``kept``: ``doc_id`` is ``component_id``, null equal to null; repeated rows are kept
    together.  Empty tables give empty results.  Only doc_id and text are read, so other columns cannot clash.
    """
    marked = checkpointed(sketched(docs))
    nodes = checkpointed(marked.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("nameless", "handle")).alias("_h"),
    ).select(F.monotonically_increasing_id().alias("node"), "digest", "first", "n", "sketch", "_h.nameless", "_h.handle"))
    found = _connected(set_links(docs, nodes, percent))
    named = nodes.select("node", "digest", "first").join(found, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(smallest, "root").select("digest", "component_id")
    own: Column = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.select("doc_id", "n", "digest").join(ids, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))

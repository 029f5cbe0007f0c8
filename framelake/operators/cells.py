"""Exact vector joins by metric cells.

All joins below run on one layout.  Pivots (a bounded sample) split the space into cells; every data
row lives in the cell of its nearest pivot.  A cell that holds too many rows gets pivots of its own, so dense
regions are cut as finely as thin ones.  A probe with search radius ``t`` visits each cell whose
pivot is at most ``2 t`` farther away than its own nearest pivot, on both levels: by the triangle inequality no other
cell can hold a row within ``t``.  A cell is cut into blocks of bounded size and each pair of blocks is one
task-sized group, so a cell that holds a third of the corpus becomes many
groups instead of one.  The block kernels are numpy on Arrow batches.

A join of a corpus with itself looks at every pair once: two rows of one cell meet in an unordered pair of
blocks, rows of different cells meet in the lower cell, and a kernel answers in both directions.

Cosine runs in the same metric: on unit vectors ``cos > t`` means ``L2 < sqrt(2 - 2 t)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# smallest band around a threshold in which pairs are re-scored in element order
BAND = 1e-7
# rows asked at once, scores of a block held at once, vector values gathered at once, rows placed at once
SLICE, SCORES_AT_ONCE, PIECE_VALUES, PLACE_ROWS = 512, 1 << 20, 4_000_000, 1024
# A corpus is cut into about this many blocks, so what a join shuffles grows with the corpus and not with its square,
# until a block holds as many vector values as a task may.
BLOCKS, LEAST_BLOCK, BLOCK_VALUES = 16, 512, 1 << 21
# sums of 16-bit coordinates stay below this; rows and columns of a tile of such sums
SHORT, TILE = 32_000, (64, 2048)

LOWER_IS_BETTER = {"cosine": False, "euclidean": True, "manhattan": True}


@dataclass(frozen=True)
class CellLayout:
    """How a corpus is cut: pivot vectors (in metric space) of the first level, own pivots of crowded cells, block size."""

    algorithm: str
    pivots: np.ndarray | None
    rows: int
    block_rows: int = 2048
    inner: dict[int, np.ndarray] = field(default_factory=dict)

    def first_cells(self) -> np.ndarray:
        """Number of the first cell of every first-level pivot; a crowded one has as many cells as inner pivots."""
        sizes = [len(self.inner[k]) if k in self.inner else 1 for k in range(len(self.pivots))]
        return np.concatenate([[0], np.cumsum(sizes)])


@dataclass(frozen=True)
class Rows:
    """One side of a block pair: ids in rising order, vectors, and the set of levels each row takes part in (bits).

    ``floors``: the score below which a row asks for no match, where it is known.
    """

    ids: np.ndarray
    vecs: np.ndarray
    levels: np.ndarray
    floors: np.ndarray | None = None


def check_algorithm(algorithm: str) -> None:
    if algorithm not in LOWER_IS_BETTER:
        raise ValueError(f"unknown algorithm {algorithm!r}; use one of {sorted(LOWER_IS_BETTER)}")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column -> dense double matrix."""
    rows = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows and flat.size % rows:
        raise ValueError("vectors of one corpus must have equal length")
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def in_metric_space(vectors: np.ndarray, algorithm: str) -> np.ndarray:
    if algorithm != "cosine":
        return vectors
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(lengths == 0.0, 1.0, lengths)


def metric_radius(algorithm: str, threshold: float) -> float:
    """Radius in metric space that no passing pair can exceed."""
    if algorithm != "cosine":
        return threshold + 1e-6
    if threshold < 0.0:  # all-zero vectors score 0 and pass: nothing can be pruned
        return float("inf")
    return float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0)) + 1e-6)


def distances(a: np.ndarray, b: np.ndarray, algorithm: str) -> np.ndarray:
    """Dense metric distances between two row sets."""
    if algorithm == "manhattan":
        out = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):
            out += np.abs(a[:, k, None] - b[None, :, k])
        return out
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def pair_scores(a: np.ndarray, b: np.ndarray, algorithm: str) -> np.ndarray:
    """Scores of aligned rows, summed in element order like the scalar formula."""
    total, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        if algorithm == "cosine":
            total += a[:, k] * b[:, k]
            left += a[:, k] * a[:, k]
            right += b[:, k] * b[:, k]
        elif algorithm == "euclidean":
            total += (a[:, k] - b[:, k]) ** 2
        else:
            total += np.abs(a[:, k] - b[:, k])
    if algorithm == "cosine":
        scale = np.sqrt(left) * np.sqrt(right)
        return np.where(scale == 0.0, 0.0, total / np.where(scale == 0.0, 1.0, scale))
    return np.sqrt(total) if algorithm == "euclidean" else total


def scores_at(data: np.ndarray, probes: np.ndarray, a: np.ndarray, b: np.ndarray, algorithm: str) -> np.ndarray:
    """Scores of the chosen (data row, probe row) pairs, in pieces of bounded memory."""
    step = max(1, PIECE_VALUES // max(data.shape[1], 1))
    pieces = [pair_scores(data[a[k : k + step]], probes[b[k : k + step]], algorithm) for k in range(0, len(a), step)]
    return np.concatenate(pieces) if pieces else np.zeros(0)


def rough_scorer(a: np.ndarray, b: np.ndarray, algorithm: str, width: float):
    """Scores of all rows of ``a`` against a slice of ``b``, off by ``width`` (the ``band``) at most; both sides are prepared once."""
    if algorithm == "cosine":
        left, right = (np.ascontiguousarray(in_metric_space(x, algorithm), np.float32) for x in (a, b))
        return lambda lo, hi: left @ right[lo:hi].T
    if algorithm == "manhattan" and width > BAND:
        return _short_manhattan(a, b)
    return lambda lo, hi: distances(a, b[lo:hi], algorithm)


def _short_manhattan(a: np.ndarray, b: np.ndarray):
    """Manhattan distances on coordinates rounded to 16 bits: ``|x - y| = 2 max(x, y) - x - y``, two integer steps a dimension."""
    middle, spread, _ = _ranges(a, b)
    scale = _short_scale(spread, a.shape[1])
    short = [np.rint((x - middle) * scale).astype(np.int16) for x in (a, b)]
    left, right = np.ascontiguousarray(short[0].T), short[1]
    sums = [x.sum(axis=1, dtype=np.int32) for x in short]

    def scores(lo: int, hi: int) -> np.ndarray:
        out = np.empty((hi - lo, len(a)), np.float32)
        for top, at in product(range(lo, hi, TILE[0]), range(0, len(a), TILE[1])):  # a tile stays in the processor's cache
            one, other = right[top : min(top + TILE[0], hi)], left[:, at : at + TILE[1]]
            total = np.zeros((len(one), other.shape[1]), np.int16)
            larger = np.empty_like(total)
            for k in range(len(other)):
                np.maximum(one[:, k, None], other[k], out=larger)
                np.add(total, larger, out=total)
            tile = np.multiply(total, 2, dtype=np.int32)
            tile -= sums[0][at : at + TILE[1]]
            tile -= sums[1][top : top + len(one), None]
            np.multiply(tile, 1.0 / scale, out=out[top - lo : top - lo + len(one), at : at + TILE[1]], casting="same_kind")
        return out.T

    return scores


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Middle of every dimension over both sides, sum of the dimensions' widths, largest value."""
    low, high = np.minimum(a.min(axis=0), b.min(axis=0)), np.maximum(a.max(axis=0), b.max(axis=0))
    return (low + high) / 2, float((high - low).sum()), float(max(np.abs(low).max(), np.abs(high).max()))


def _short_scale(spread: float, dims: int) -> float:
    """Steps a unit, so that a row's rounded coordinates sum up to ``SHORT`` at most on either side of the middle."""
    return 2.0 * (SHORT - dims) / spread


def slices(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of ``b`` whose scores against ``a`` are held at once."""
    step = max(16, SCORES_AT_ONCE // max(len(a), 1))
    return [(lo, min(lo + step, len(b))) for lo in range(0, len(b), step)]


def rough_scores(a: np.ndarray, b: np.ndarray, algorithm: str, width: float) -> np.ndarray:
    """All-against-all scores, off by ``width`` at most."""
    return rough_scorer(a, b, algorithm, width)(0, len(b))


def band(a: np.ndarray, b: np.ndarray, algorithm: str, threshold: float) -> float:
    """How far a rough score near the threshold may be off; long vectors cancel more digits.

    Manhattan: what rounding to 16 bits takes away, if that is little beside the threshold; else sums are exact but for the last digits.
    """
    if algorithm == "cosine":  # products of unit vectors in single precision
        return BAND + 1.2e-7 * (a.shape[1] + 4)
    if algorithm == "manhattan":
        _, spread, largest = _ranges(a, b)
        dims = a.shape[1]
        if not (0.0 < spread < np.inf and dims < SHORT // 2):
            return BAND
        width = dims / _short_scale(spread, dims) + 1e-12 * dims * largest + 5e-7 * (spread + threshold) + BAND
        return width if width <= threshold / 50 else BAND
    longest = (a * a).sum(axis=1).max() + (b * b).sum(axis=1).max()
    return BAND + 1e-14 * longest * np.sqrt(a.shape[1]) / max(abs(threshold), 1e-12)


def passes(scores: np.ndarray, threshold: float, algorithm: str) -> np.ndarray:
    """Strict threshold test."""
    return scores < threshold if LOWER_IS_BETTER[algorithm] else scores > threshold


def plan_cells(
    vectors: DataFrame,
    algorithm: str,
    rows_per_cell: int = 20_000,
    max_pivots: int = 4096,
    block_rows: int | None = None,
    pivot_bytes: int = 256 << 20,
) -> CellLayout:
    """Choose pivots for ``vectors(id, vec)``.

    At most ``max_pivots`` vectors of the first level and ``pivot_bytes`` of both levels reach the driver and are
    broadcast.  A first-level cell of more than twice ``rows_per_cell`` rows gets pivots of its own.  ``block_rows``
    follows from the number of rows unless it is given.
    """
    check_algorithm(algorithm)
    found = vectors.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("dims")).first()
    rows = found["rows"]
    block_rows = block_rows or min(max(LEAST_BLOCK, -(-rows // BLOCKS)), max(LEAST_BLOCK, BLOCK_VALUES // max(found["dims"], 1)))
    cells = min(rows // rows_per_cell, max_pivots)
    if cells <= 1:
        return CellLayout(algorithm, None, rows, block_rows)
    sample = vectors.orderBy(F.xxhash64("id")).limit(cells).select("vec").toArrow()
    pivots = np.unique(in_metric_space(matrix(sample["vec"]), algorithm), axis=0)
    flat = CellLayout(algorithm, pivots, rows, block_rows)
    placed = _placed(_with_levels(vectors), flat, None, "home").select("id", "vec", "cell")
    crowded = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * rows_per_cell).collect()}
    if not crowded:
        return flat
    room = max(0, pivot_bytes // (8 * pivots.shape[1]) - len(pivots))
    share = min(1.0, room / max(1, sum(crowded.values()) // rows_per_cell))
    # of a crowded cell one row in so many, by hash: about ``room`` rows of all cells together at most
    parts, wanted = 1 << 30, F.create_map(*[F.lit(x) for k, n in crowded.items() for x in (k, int((1 << 30) * share * max(2, n // rows_per_cell) / n))])
    drawn = placed.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)) < wanted[F.col("cell")]).limit(room).select("cell", "vec").toArrow()
    if not drawn.num_rows:
        return flat
    found, cell = in_metric_space(matrix(drawn["vec"]), algorithm), drawn["cell"].to_numpy()
    inner = {int(k): np.unique(found[cell == k], axis=0) for k in np.unique(cell)}
    return CellLayout(algorithm, pivots, rows, block_rows, {k: v for k, v in inner.items() if len(v) > 1})


def _carried(vectors: DataFrame) -> list[str]:
    """What travels with a row to its blocks."""
    return ["id", "vec", "levels", *[c for c in ("floor",) if c in vectors.columns]]


def _with_levels(vectors: DataFrame) -> DataFrame:
    return vectors if "levels" in vectors.columns else vectors.withColumn("levels", F.lit(-1).cast("long"))


def _placed(vectors: DataFrame, layout: CellLayout, radius: float | None, mode: str) -> DataFrame:
    """Rows ``id, vec, levels`` with their ``cell`` and whether they are a ``visitor`` there.

    mode ``home``: the nearest pivot's cell; ``visit``: every cell within reach, as visitors; ``away``: these but the
    home cell; ``once``: the home cell, and as visitors the cells within reach that come before it.
    A row may carry its own ``radius`` column, which then wins over the argument.
    """
    if layout.pivots is None:
        rows = vectors.select(*_carried(vectors), F.lit(0).alias("cell"), F.lit(mode in ("visit", "away")).alias("visitor"))
        return rows.where(F.lit(mode != "away"))
    shared = vectors.sparkSession.sparkContext.broadcast((layout.pivots, layout.inner, layout.first_cells()))  # within pivot_bytes
    algorithm, own_radius = layout.algorithm, "radius" in vectors.columns
    carried = _carried(vectors)
    types = {"id": pa.int64(), "vec": pa.list_(pa.float32()), "levels": pa.int64(), "floor": pa.float64(), "cell": pa.int32(), "visitor": pa.bool_()}
    schema = pa.schema([(c, types[c]) for c in (*carried, "cell", "visitor")])

    def place(batches):
        pivots, inner, first = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, PLACE_ROWS):  # bounds the distance matrix
                table = pa.Table.from_batches([batch.slice(start, PLACE_ROWS)])
                points = in_metric_space(matrix(table["vec"]), algorithm)
                size = np.abs(points).max(axis=1)
                reach = np.zeros(len(points)) if radius is None else table["radius"].to_numpy() if own_radius else np.full(len(points), radius)

                def near(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    """Nearest centre of every row; (place in rows, centre) within reach."""
                    gap = distances(points[rows], centres, algorithm)
                    nearest = gap.min(axis=1, keepdims=True)
                    rounding = 1e-6 * np.maximum(1.0, size[rows][:, None] + nearest)
                    return gap.argmin(axis=1), *np.nonzero(gap <= nearest + 2.0 * reach[rows][:, None] + rounding)

                outer, row, visited = near(np.arange(len(points)), pivots)
                home = first[outer]
                rows, cell = [], []
                for k in np.unique(visited if radius is not None else outer):
                    here = row[visited == k] if radius is not None else np.flatnonzero(outer == k)
                    if int(k) in inner:
                        closest, at, sub = near(here, inner[int(k)])
                        living = outer[here] == k
                        home[here[living]] = first[k] + closest[living]
                        rows.append(here[at])
                        cell.append(first[k] + sub)
                    else:
                        rows.append(here)
                        cell.append(np.full(len(here), first[k]))
                row, cell = np.concatenate(rows), np.concatenate(cell)
                everyone = np.arange(len(points))
                if mode == "home":
                    row, cell, visitor = everyone, home, np.zeros(len(points), bool)
                elif mode == "once":
                    before = cell < home[row]
                    row, cell = np.concatenate([everyone, row[before]]), np.concatenate([home, cell[before]])
                    visitor = np.arange(len(row)) >= len(points)
                else:
                    if mode == "away":
                        row, cell = row[cell != home[row]], cell[cell != home[row]]
                    visitor = np.ones(len(row), bool)
                out = table.select(carried).take(pa.array(row))
                yield from out.append_column("cell", pa.array(cell, pa.int32())).append_column("visitor", pa.array(visitor)).cast(schema).to_batches()

    floor = "floor double, " if "floor" in carried else ""
    return vectors.mapInArrow(place, f"id long, vec array<float>, levels long, {floor}cell int, visitor boolean")


def _rows(table: pa.Table) -> Rows:
    table = table.sort_by("id")
    floors = table["floor"].to_numpy() if "floor" in table.column_names else None
    return Rows(table["id"].to_numpy(), matrix(table["vec"]), table["levels"].to_numpy(), floors)


def cell_join(data: DataFrame, probes: DataFrame, layout: CellLayout, radius: float, kernel, schema: str, mode: str = "visit") -> DataFrame:
    """Run ``kernel(data: Rows, probes: Rows, False) -> pa.Table`` on every block pair that can match.

    ``data`` and ``probes`` have columns ``id LONG, vec ARRAY<FLOAT>`` and may have ``levels LONG``, probes
    also ``floor DOUBLE``.  ``mode="away"`` leaves the probes' home cells out.
    """
    if "floor" in probes.columns:
        data = data.withColumn("floor", F.lit(float("-inf")))
    homes = _placed(_with_levels(data), layout, None, "home")
    visits = _placed(_with_levels(probes), layout, radius, mode)
    return _in_blocks(homes.union(visits), layout, kernel, schema, among_homes=False)


def cell_self_join(points: DataFrame, layout: CellLayout, radius: float | None, kernel, schema: str) -> DataFrame:
    """Run ``kernel(a: Rows, b: Rows, both) -> pa.Table`` so that every pair of ``points`` that can match is seen once.

    ``both``: pairs count in either direction; else ``a`` is ``b`` or only the direction from a to b is asked.
    ``radius`` None: only rows of the same cell meet.
    """
    placed = _placed(_with_levels(points), layout, radius, "home" if radius is None else "once")
    return _in_blocks(placed, layout, kernel, schema, among_homes=True)


def _in_blocks(placed: DataFrame, layout: CellLayout, kernel, schema: str, among_homes: bool) -> DataFrame:
    """Rows of a cell in blocks: homes come first, visitors after them; a group is a pair of blocks with a home block in it."""
    blocks = lambda visiting: F.ceil(F.count_if(F.col("visitor") == visiting) / F.lit(layout.block_rows)).cast("int")
    if layout.pivots is None:  # one cell of at most layout.rows rows
        most = F.lit(max(1, -(-layout.rows // layout.block_rows)))
        counted = placed.withColumns({"homes": most, "visitors": F.lit(0) if among_homes else most})
    else:
        # one row per cell, and cells are bounded by pivot_bytes: safe to broadcast
        grid = placed.groupBy("cell").agg(blocks(False).alias("homes"), blocks(True).alias("visitors")).where("homes > 0")
        counted = placed.join(F.broadcast(grid), "cell")
    spread = F.xxhash64("id")
    own = F.when(F.col("visitor"), F.col("homes") + F.pmod(spread, F.col("visitors"))).otherwise(F.pmod(spread, F.col("homes"))).cast("int")
    # a visitor meets all home blocks; a home block meets the visitors and, in a self-join, the other home blocks
    low = F.lit(0) if among_homes else F.when(F.col("visitor"), F.lit(0)).otherwise(F.col("homes"))
    high = F.when(F.col("visitor"), F.col("homes")).otherwise(F.col("homes") + F.col("visitors"))
    dealt = (
        counted.withColumn("_own", own).where(low < high)
        .withColumn("_other", F.explode(F.sequence(low, high - 1)))
        .select("cell", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"),
                (F.col("_own") > F.col("_other")).alias("second"), *_carried(placed))
    )
    empty = pa.schema([])

    def run(group: pa.Table) -> pa.Table:
        second = group["second"]
        a, b = group.filter(pc.invert(second)), group.filter(second)
        alone = group["x"][0] == group["y"][0]
        if not a.num_rows or not (alone or b.num_rows):
            return empty.empty_table()
        left = _rows(a)
        out = kernel(left, left, False) if alone else kernel(left, _rows(b), among_homes)
        return out if out.num_rows else empty.empty_table()

    return dealt.groupBy("cell", "x", "y").applyInArrow(run, schema)


def pair_kernel(algorithm: str, threshold: float):
    """Every (i, j, score) with i < j that passes the threshold."""

    def kernel(a: Rows, b: Rows, both: bool) -> pa.Table:
        parts, width = [], band(a.vecs, b.vecs, algorithm, threshold)
        slack = -width if LOWER_IS_BETTER[algorithm] else width
        rough = rough_scorer(a.vecs, b.vecs, algorithm, width)
        for lo, hi in slices(a.vecs, b.vecs):
            x, y = np.nonzero(passes(rough(lo, hi), threshold - slack, algorithm))
            y = y + lo
            asked = (a.ids[x] != b.ids[y]) if both else (a.ids[x] < b.ids[y])
            x, y = x[asked], y[asked]
            # the scalar formula takes the smaller index first
            score = scores_at(a.vecs, b.vecs, x, y, algorithm)
            keep = passes(score, threshold, algorithm)
            i, j = a.ids[x[keep]], b.ids[y[keep]]
            parts.append((np.minimum(i, j), np.maximum(i, j), score[keep]))
        i, j, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"i": i, "j": j, "score": score})

    return kernel


def first_kernel(algorithm: str, thresholds: list[float], block: int | None = None):
    """Per row j and level the smallest passing i < j: one row per j and level, never all pairs.

    Level ``n`` is ``thresholds[n]``; a pair counts at the levels that both rows take part in.
    With ``block`` only pairs from different index blocks of that size count.
    """

    loosest = max(thresholds) if LOWER_IS_BETTER[algorithm] else min(thresholds)

    def first_of_few(x: np.ndarray, y: np.ndarray, data: np.ndarray, probes: np.ndarray, level: int) -> tuple:
        """The first x of every y; pairs come by rising x for the same y."""
        asked, at = np.unique(y, return_index=True)
        return probes[asked], np.full(len(asked), level, np.int32), data[x[at]]

    def few(a: Rows, b: Rows, x: np.ndarray, y: np.ndarray, rough: np.ndarray, widths: list[float], both: bool) -> list[tuple]:
        """The answer from the pairs (x, y) that may pass at the loosest level."""
        if block is not None:
            apart = a.ids[x] // block != b.ids[y] // block
            x, y, rough = x[apart], y[apart], rough[apart]
        earlier, later, shared, parts = a.ids[x] < b.ids[y], a.ids[x] > b.ids[y], a.levels[x] & b.levels[y], []
        for level, (threshold, width) in enumerate(zip(thresholds, widths, strict=True)):
            ok = passes(rough, threshold, algorithm)
            near = np.flatnonzero(np.abs(rough - threshold) <= width)
            ok[near] = passes(scores_at(a.vecs, b.vecs, x[near], y[near], algorithm), threshold, algorithm)
            ok &= (shared >> level & 1).astype(bool)
            parts.append(first_of_few(x[ok & earlier], y[ok & earlier], a.ids, b.ids, level))
            if both:
                parts.append(first_of_few(y[ok & later], x[ok & later], b.ids, a.ids, level))
        return parts

    def first(ok: np.ndarray, data: np.ndarray, probes: np.ndarray, level: int) -> tuple:
        hit = ok.any(axis=0)
        found = data[ok.argmax(axis=0)[hit]]  # rows arrive sorted by id
        return probes[hit], np.full(len(found), level, np.int32), found

    def kernel(a: Rows, b: Rows, both: bool) -> pa.Table:
        # the scores serve all levels, so their band must be narrow for the narrowest
        parts, width = [], min(band(a.vecs, b.vecs, algorithm, t) for t in thresholds)
        widths = [max(width, band(a.vecs, b.vecs, algorithm, t)) for t in thresholds]
        scorer = rough_scorer(a.vecs, b.vecs, algorithm, width)
        for lo, hi in slices(a.vecs, b.vecs):
            ids, vecs, levels = b.ids[lo:hi], b.vecs[lo:hi], b.levels[lo:hi]
            rough = scorer(lo, hi)
            slack = -max(widths) if LOWER_IS_BETTER[algorithm] else max(widths)
            close = passes(rough, loosest - slack, algorithm)
            if np.count_nonzero(close) * 16 <= close.size:  # so few pairs that a list of them is cheaper
                x, y = np.nonzero(close)
                parts += few(a, b, x, y + lo, rough[x, y], widths, both)
                continue
            earlier, later = a.ids[:, None] < ids[None, :], a.ids[:, None] > ids[None, :]
            apart = None if block is None else (a.ids // block)[:, None] != (ids // block)[None, :]
            for level, (threshold, width) in enumerate(zip(thresholds, widths, strict=True)):
                ok = passes(rough, threshold, algorithm)
                x, y = np.nonzero(np.abs(rough - threshold) <= width)
                ok[x, y] = passes(scores_at(a.vecs, vecs, x, y, algorithm), threshold, algorithm)
                ok &= (a.levels >> level & 1).astype(bool)[:, None] & (levels >> level & 1).astype(bool)[None, :]
                if apart is not None:
                    ok &= apart
                parts.append(first(ok & earlier, a.ids, ids, level))
                if both:
                    parts.append(first((ok & later).T, ids, a.ids, level))
        j, level, i = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"j": j, "level": level, "i": i})

    return kernel


def local_leaders(ids: np.ndarray, vectors: np.ndarray, waiting: np.ndarray, algorithm: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(leaders, leader of every row or -1) among a bounded set of rows, taken one after the other in id order.

    A ``waiting`` row depends on rows outside the set: it, and what only depends on it, stays open.
    """
    order = np.argsort(ids)
    ids, vectors, open_ = ids[order], vectors[order], waiting[order].copy()
    led, leaders = np.full(len(ids), -1, np.int64), []
    width = band(vectors, vectors, algorithm, threshold) if len(ids) else 0.0
    for lo in range(0, len(ids), SLICE):
        asked = lo + np.flatnonzero(led[lo : lo + SLICE] < 0)
        scores = rough_scores(vectors[asked], vectors[lo:], algorithm, width)
        for at, rough in zip(asked.tolist(), scores, strict=True):
            if led[at] >= 0:
                continue
            ok = passes(rough, threshold, algorithm)
            near = np.flatnonzero(np.abs(rough - threshold) <= width)
            if len(near):
                ok[near] = passes(scores_at(vectors, vectors, np.full(len(near), at), lo + near, algorithm), threshold, algorithm)
            ok[: at - lo + 1] = False
            similar = lo + np.flatnonzero(ok & (led[lo:] < 0))
            if open_[at]:
                open_[similar] = True
            else:
                leaders.append(at)
                led[at] = ids[at]
                led[similar] = ids[at]
    out = np.empty(len(ids), np.int64)
    out[order] = led
    return ids[np.array(leaders, np.int64)], out


def nearest_kernel(k: int):
    """Per probe its k best cosine matches of the block, ties to the smaller id; none below the probe's floor."""

    def floors(rough: np.ndarray) -> np.ndarray:
        """Per column a score that k rows reach: the k-th best of the maxima of many groups of rows."""
        groups = 4 * k
        if len(rough) >= 2 * groups:
            each = len(rough) // groups
            rough = rough[: groups * each].reshape(groups, each, -1).max(axis=1)
        kept = min(k, len(rough))
        return np.partition(rough, len(rough) - kept, axis=0)[len(rough) - kept]

    def best(data: Rows, probes: Rows) -> list[tuple]:
        parts, width = [], band(data.vecs, probes.vecs, "cosine", 0.0)
        scorer = rough_scorer(data.vecs, probes.vecs, "cosine", width)
        # (data row, probe) of equal ids: a row is no match of its own
        first = np.searchsorted(data.ids, probes.ids, "left")
        times = np.searchsorted(data.ids, probes.ids, "right") - first
        own = np.repeat(np.arange(len(times)), times)
        same = np.arange(len(own)) + np.repeat(first - (np.cumsum(times) - times), times)
        for lo, hi in slices(data.vecs, probes.vecs):
            rough = scorer(lo, hi)
            here = (own >= lo) & (own < hi)
            rough[same[here], own[here] - lo] = -np.inf
            floor = floors(rough)
            if probes.floors is not None:
                floor = np.maximum(floor, probes.floors[lo:hi])
            a, b = np.nonzero(rough >= (floor - 2.0 * width).astype(np.float32)[None, :])
            finite = np.isfinite(rough[a, b])
            a, b = a[finite], b[finite] + lo
            score = scores_at(data.vecs, probes.vecs, a, b, "cosine")
            order = np.lexsort((data.ids[a], -score, b))
            a, b, score = a[order], b[order], score[order]
            top = np.arange(len(b)) - np.searchsorted(b, b, side="left") < k
            if probes.floors is not None:
                top &= score >= probes.floors[b]
            parts.append((probes.ids[b[top]], data.ids[a[top]], score[top]))
        return parts

    def kernel(a: Rows, b: Rows, both: bool) -> pa.Table:
        parts = [*best(a, b), *(best(b, a) if both else [])]
        i, j, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"i": i, "j": j, "score": score})

    return kernel

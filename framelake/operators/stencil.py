"""Neighbourhood operators on the pixel table, by tiles with a halo.

Pixels are shuffled once on (image, tile): a pixel near a tile edge is sent to the neighbouring tiles
that need it, every other pixel travels exactly once.  A group is at most (tile + 2 radius) squared
pixels whatever the image size, so one giant image is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.numeric import clamp8

TILE = 128
LAPLACIAN = ((0.0, 1.0, 0.0), (1.0, -4.0, 1.0), (0.0, 1.0, 0.0))
BINOMIAL3 = ((1.0, 2.0, 1.0), (2.0, 4.0, 2.0), (1.0, 2.0, 1.0))


def gaussian_taps(sigma: float) -> list[float]:
    """Odd one-dimensional Gaussian of width round(6 sigma + 1), summing to one."""
    size = int(np.floor(sigma * 6 + 1 + 0.5)) | 1
    at = np.arange(size) - size // 2
    taps = np.exp(-(at * at) / (2.0 * sigma * sigma))
    return (taps / taps.sum()).tolist()


def mirrored(positions: np.ndarray, size: int) -> np.ndarray:
    """Fold positions into 0..size-1, mirroring without repeating the edge."""
    if size == 1:
        return np.zeros_like(positions)
    folded = np.mod(positions, 2 * (size - 1))
    return np.where(folded < size, folded, 2 * (size - 1) - folded)


def weighted(plane: np.ndarray, kernel) -> np.ndarray:
    """Correlate a padded plane with a square kernel, adding taps in row-major order."""
    k = len(kernel)
    rows, cols = plane.shape[0] - k + 1, plane.shape[1] - k + 1
    total = np.zeros((rows, cols))
    for dy in range(k):
        for dx in range(k):
            if kernel[dy][dx]:
                total += plane[dy : dy + rows, dx : dx + cols] * kernel[dy][dx]
    return total


def weighted_separable(plane: np.ndarray, taps) -> np.ndarray:
    """Correlate rows, then columns."""
    k = len(taps)
    rows, cols = plane.shape[0] - k + 1, plane.shape[1] - k + 1
    across = sum(plane[:, d : d + cols] * taps[d] for d in range(k))
    return sum(across[d : d + rows] * taps[d] for d in range(k))


def _tiles_on(axis: str, size: str, radius: int, tile: int):
    """Tiles whose halo holds a coordinate."""
    first = F.floor(F.greatest(F.col(axis) - radius, F.lit(0)) / tile).cast("int")
    last = F.floor(F.least(F.col(axis) + radius, F.col(size) - 1) / tile).cast("int")
    return F.explode(F.sequence(first, last))


@dataclass(frozen=True)
class Tile:
    """One tile of a batch: its row range, which of those rows are its own, and where they sit."""

    rows: slice
    own: np.ndarray
    place: tuple[np.ndarray, np.ndarray]
    padded: dict[str, np.ndarray]


def _tiled(pixels: DataFrame, radius: int, border: str, tile: int) -> DataFrame:
    """Pixels with their tile, all rows of a tile next to each other in one partition."""
    if border not in ("skip", "reflect101"):
        raise ValueError(f"unknown border {border!r}")
    if radius >= tile:
        raise ValueError("the tile must be larger than the kernel radius")
    keys = ["image_id", "tx", "ty"]
    return (
        pixels.withColumn("tx", _tiles_on("x", "width", radius, tile))
        .withColumn("ty", _tiles_on("y", "height", radius, tile))
        .repartition(*keys).sortWithinPartitions(*keys)
    )


def _tile_starts(table: pa.Table) -> np.ndarray:
    """Row numbers at which a new tile begins."""
    images = table["image_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = np.diff(images) != 0
    for key in ("tx", "ty"):
        new[1:] |= np.diff(table[key].to_numpy()) != 0
    return np.flatnonzero(new)


def _whole_tiles(batches):
    """Regroup Arrow batches so that no tile is cut; at most one tile is held back."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cut = int(_tile_starts(table)[-1])
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _tiles(table: pa.Table, planes: list[str], radius: int, border: str, tile: int):
    """Padded planes of every tile of a batch; outside pixels are mirrored (or repeated for "skip")."""
    x, y, width, height, tx, ty = (table[c].to_numpy() for c in ("x", "y", "width", "height", "tx", "ty"))
    values = {p: table[p].to_numpy(zero_copy_only=False) for p in planes}

    def axis(at: int, size: int):
        start, stop = at * tile, min(at * tile + tile, size)
        wanted = np.arange(start - radius, stop + radius)
        source = mirrored(wanted, size) if border == "reflect101" else np.clip(wanted, 0, size - 1)
        base = min(int(source.min()), max(start - radius, 0))
        return start, stop, base, max(int(source.max()), stop + radius) - base + 1, source

    starts = _tile_starts(table)
    for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
        rows = slice(int(lo), int(hi))
        x0, x1, left, wide, sx = axis(int(tx[lo]), int(width[lo]))
        y0, y1, upper, tall, sy = axis(int(ty[lo]), int(height[lo]))
        gx, gy = x[rows], y[rows]
        padded = {}
        for name, column in values.items():
            sheet = np.full((tall, wide), np.nan)
            sheet[gy - upper, gx - left] = column[rows]
            padded[name] = sheet[np.ix_(sy - upper, sx - left)]
        own = (gx >= x0) & (gx < x1) & (gy >= y0) & (gy < y1)
        yield Tile(rows, own, (gy[own] - y0, gx[own] - x0), padded)


def _ddl(pixels: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {pixels.schema[n].dataType.simpleString()}" for n in names)


def stencil(pixels: DataFrame, planes: list[str], radius: int, border: str, compute, outputs: list[str], tile: int = TILE) -> DataFrame:
    """Add the double columns ``outputs``: ``compute(padded)`` returns one array per output."""
    keep = list(pixels.columns)

    def run(batches):
        for table in _whole_tiles(batches):
            own = np.zeros(table.num_rows, dtype=bool)
            results = [np.empty(table.num_rows) for _ in outputs]
            for t in _tiles(table, planes, radius, border, tile):
                own[t.rows] = t.own
                for result, values in zip(results, compute(t.padded), strict=True):
                    result[t.rows][t.own] = values[t.place]
            out = table.select(keep).filter(pa.array(own))
            for name, result in zip(outputs, results, strict=True):
                out = out.append_column(name, pa.array(result[own]))
            yield from out.to_batches()

    ddl = _ddl(pixels, keep) + ", " + ", ".join(f"{n} double" for n in outputs)
    return _tiled(pixels, radius, border, tile).mapInArrow(run, ddl)


def tile_sums(pixels: DataFrame, planes: list[str], radius: int, border: str, compute, outputs: list[str], tile: int = TILE) -> DataFrame:
    """One row per tile: ``image_id`` and the numbers ``compute(padded, place)`` returns."""

    def run(batches):
        for table in _whole_tiles(batches):
            tiles = list(_tiles(table, planes, radius, border, tile))
            rows = [compute(t.padded, t.place) for t in tiles]
            out = table.select(["image_id"]).take(pa.array([t.rows.start for t in tiles]))
            for k, name in enumerate(outputs):
                out = out.append_column(name, pa.array([float(r[k]) for r in rows]))
            yield from out.to_batches()

    ddl = _ddl(pixels, ["image_id"]) + ", " + ", ".join(f"{n} double" for n in outputs)
    return _tiled(pixels, radius, border, tile).mapInArrow(run, ddl)


def convolve(pixels: DataFrame, kernel, border: str = "reflect101", planes: tuple[str, ...] = ("r", "g", "b"), tile: int = TILE) -> DataFrame:
    """Replace ``planes`` by their (double) weighted neighbourhood sums.

    ``kernel`` is a square matrix, or a list of taps applied along rows and then columns.  With
    ``border="skip"`` pixels without a full neighbourhood keep their value.
    """
    separable = not isinstance(kernel[0], (list, tuple))
    radius = len(kernel) // 2
    apply = weighted_separable if separable else weighted
    outs = [f"_sum_{p}" for p in planes]
    summed = stencil(pixels, list(planes), radius, border, lambda s: [apply(s[p], kernel) for p in planes], outs, tile)
    full = (
        F.col("x").between(radius, F.col("width") - 1 - radius) & F.col("y").between(radius, F.col("height") - 1 - radius)
        if border == "skip" else F.lit(True)
    )
    return summed.withColumns(
        {p: F.when(full, F.col(o)).otherwise(F.col(p).cast("double")) for p, o in zip(planes, outs, strict=True)}
    ).drop(*outs)


def sharpen(pixels: DataFrame, amount, skip_transparent=False, tile: int = TILE) -> DataFrame:
    """3x3 sharpening read from the originals; border and (optionally) transparent pixels stay.

    ``amount`` and ``skip_transparent`` are values or columns, so images may differ.
    """
    wanted = amount if not isinstance(amount, (int, float)) else F.lit(float(amount))
    skip = skip_transparent if not isinstance(skip_transparent, bool) else F.lit(skip_transparent)
    given = list(pixels.columns)
    ready = pixels.withColumn("_s", F.least(wanted.cast("double"), F.lit(2.0))).withColumn("_skip", skip)
    planes, outs = ["r", "g", "b"], ["_r", "_g", "_b"]

    def compute(padded):
        s = padded["_s"][1:-1, 1:-1]
        for p in planes:
            v = padded[p]
            total = v[:-2, 1:-1] * -s
            total += v[1:-1, :-2] * -s
            total += v[1:-1, 1:-1] * (1.0 + 4.0 * s)
            total += v[1:-1, 2:] * -s
            total += v[2:, 1:-1] * -s
            yield total

    summed = stencil(ready, [*planes, "_s"], 1, "skip", compute, outs, tile)
    inside = F.col("x").between(1, F.col("width") - 2) & F.col("y").between(1, F.col("height") - 2)
    change = inside & (F.col("_s") > 0) & ~(F.col("_skip") & (F.col("a") == 0))
    return summed.withColumns(
        {p: F.when(change, clamp8(F.col(o))).otherwise(F.col(p)) for p, o in zip(planes, outs, strict=True)}
    ).select(*given)


def unsharp_mask(pixels: DataFrame, amount: float, sigma: float = 3.0, tile: int = TILE) -> DataFrame:
    """Alternate sharpening: (1 + amount) v - amount * (8-bit Gaussian blur of v)."""
    planes, outs = ["r", "g", "b"], ["_r", "_g", "_b"]
    given = list(pixels.columns)
    taps = gaussian_taps(sigma)
    blurred = stencil(pixels, planes, len(taps) // 2, "reflect101",
                      lambda s: [weighted_separable(s[p], taps) for p in planes], outs, tile)
    return blurred.withColumns({
        p: clamp8(F.col(p) * F.lit(1.0 + amount) - clamp8(F.col(o)) * F.lit(float(amount)))
        for p, o in zip(planes, outs, strict=True)
    }).select(*given)

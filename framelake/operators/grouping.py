"""Greedy leader grouping of similar images, in parallel rounds.

The rule: in index order every image not yet taken becomes a leader and takes all later images that
are similar *to the leader* and not yet taken.  Leaders are therefore the lexicographically first
maximal independent set of the similarity graph, and a member belongs to its smallest adjacent
leader.  Both are found in rounds: an undecided image without a smaller undecided neighbour is a
leader, its neighbours are decided, repeat.  A handful of rounds decides everything in practice.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.keyed import global_index, salted_lookup
from framelake.operators import cells, similarity
from framelake.scratch import Intermediate, checkpointed


# consecutive indices settled together in one task
INDEX_BLOCK = 4096
DOUBLINGS = 16
STAGE_GROWTH = 64
MOST_LEVELS = 60  # thresholds of one run: a set of them is the bits of a long
PAIRS_AT_ONCE = 1_000_000  # pairs of one block that a task settles


def _members(vertices: DataFrame, led: DataFrame, by: list[str]) -> DataFrame:
    """Vertices with their leader; a vertex nobody leads is its own leader."""
    return vertices.join(led, [*by, "original_index"], "left").withColumn(
        "leader_index", F.coalesce("leader_index", "original_index")
    )


def _block_leaders(active: DataFrame, by: list[str], width: int) -> DataFrame:
    """Leaders that can be settled inside one block of ``width`` consecutive indices.

    Long chains (frames of a burst, each similar to the next) would otherwise cost a round per link.
    A row with an undecided smaller neighbour in another block waits, and so does what depends on it.
    A group holds at most one block's rows and the pairs between them.
    """
    home = F.floor(F.col("j") / width)
    inside = F.floor(F.col("i") / width) == home
    links = active.withColumn("i", F.when(inside, F.col("i")).otherwise(-1)).distinct().withColumn("block", home)
    ddl = ", ".join([*(f"{c} {active.schema[c].dataType.simpleString()}" for c in by), "i long"])

    def solve(rows: pa.Table) -> pa.Table:
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        leaders, waiting = set(), set(j[i < 0].tolist())
        order = np.argsort(j, kind="stable")
        later, starts = np.unique(j[order], return_index=True)
        # rows that are nobody's later neighbour in this block and do not wait lead already
        leaders.update(set(i[i >= 0].tolist()) - set(later.tolist()))
        chosen = []
        for v, before in zip(later.tolist(), np.split(i[order], starts[1:]), strict=True):
            earlier = before.tolist()
            if any(u in leaders for u in earlier):
                continue
            if v in waiting or any(u in waiting for u in earlier):
                waiting.add(v)
            else:
                leaders.add(v)
                chosen.append(v)
        first = pa.array([0] * len(chosen), pa.int64())
        return pa.table({**{c: rows[c].take(first) for c in by}, "i": pa.array(chosen, pa.int64())})

    return links.groupBy(*by, "block").applyInArrow(solve, ddl)


def group_duplicates(vertices: DataFrame, pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Group ``vertices(original_index)`` along ``pairs(i, j)``, i < j: adds ``leader_index``.

    ``by`` names extra key columns present in both inputs; each combination is grouped on its own.
    """
    with Intermediate(pairs.sparkSession) as steps:
        return _group_pairs(vertices, pairs, by or [], steps)


def _group_pairs(vertices: DataFrame, pairs: DataFrame, by: list[str], steps: Intermediate) -> DataFrame:
    j_key, i_key = [*by, "j"], [*by, "i"]
    all_pairs = steps.write(pairs.select(*by, "i", "j"), "pairs")
    active = all_pairs
    # vertices without a smaller neighbour lead; only the others can still be undecided
    undecided = active.select(*by, F.col("j").alias("v")).distinct()
    leads = all_pairs.select(*i_key).distinct().join(undecided.withColumnRenamed("v", "i"), i_key, "left_anti")
    found = [leads]
    while True:
        # pairs are always the left side, so adaptive execution can split a hub with very many pairs
        covered = active.join(leads, i_key, "left_semi").select(*by, F.col("j").alias("v")).distinct()
        undecided = steps.write(
            undecided.join(covered, [*by, "v"], "left_anti").join(leads.withColumnRenamed("i", "v"), [*by, "v"], "left_anti"),
            "undecided",
        )
        if undecided.isEmpty():
            break
        active = steps.write(
            active.join(undecided.withColumnRenamed("v", "i"), i_key, "left_semi")
            .join(undecided.withColumnRenamed("v", "j"), j_key, "left_semi"),
            "active",
        )
        beaten = active.select(*by, F.col("j").alias("v")).distinct()
        free = undecided.join(beaten, [*by, "v"], "left_anti").withColumnRenamed("v", "i")
        leads = steps.write(free.unionByName(_block_leaders(active, by, _block_width(active, PAIRS_AT_ONCE, "j"))), "leads")
        found.append(leads)
    leaders = reduce(DataFrame.unionByName, found)
    led = (
        all_pairs.join(leaders, i_key, "left_semi")
        .groupBy(*by, F.col("j").alias("original_index"))
        .agg(F.min("i").alias("leader_index"))
    )
    return checkpointed(_members(vertices, led, by))


def group_embeddings(
    embeddings: DataFrame,
    algorithm: str = "cosine",
    threshold: float | None = None,
    id_col: str = "original_index",
    vec_col: str = "embedding",
    finish_rows: int = 4096,
    stage_rows: int = 2_000_000,
    **layout,
) -> DataFrame:
    """Same groups straight from vectors, without ever materialising the pair table.

    Exact copies are collapsed first (a copy has the neighbours of its first occurrence, so it ends
    in the same group).  Each round then asks only for the *first* similar row of every row, which
    the block kernels reduce before anything is shuffled.  Large corpora ask small indices first and
    drop answered rows: a cluster with a third of all rows is settled by its first few members
    instead of by all its pairs.
    """
    cells.check_algorithm(algorithm)
    limit = similarity.DEFAULT_THRESHOLDS[algorithm] if threshold is None else threshold
    return regroup_sweep(embeddings, algorithm, [limit], id_col, vec_col, finish_rows, stage_rows, **layout).drop("threshold")


def regroup_sweep(
    embeddings: DataFrame, algorithm: str, thresholds: list[float], id_col: str = "original_index",
    vec_col: str = "embedding", finish_rows: int = 4096, stage_rows: int = 2_000_000, **layout,
) -> DataFrame:
    """Group the same embeddings under several thresholds: adds ``threshold`` and ``leader_index``.

    All thresholds are levels of one run: copies, pivots and placement are made once, a block pass scores a
    pair once and returns the first similar row at every level, and a round settles rows at all levels.
    """
    cells.check_algorithm(algorithm)
    images = similarity.valid_vectors(embeddings, id_col, vec_col)
    levels = sorted({float(t) for t in thresholds})
    # rows that are not similar to themselves keep their copies apart, so such levels are run by themselves
    self_similar = lambda t: t > 1e-6 if cells.LOWER_IS_BETTER[algorithm] else t < 1.0 - 1e-6
    runs = [run for wanted in (True, False) if (run := [t for t in levels if self_similar(t) == wanted])]
    runs = [run[k : k + MOST_LEVELS] for run in runs for k in range(0, len(run), MOST_LEVELS)]
    with Intermediate(embeddings.sparkSession) as steps:
        grouped = [_group_vectors(images, algorithm, run, self_similar(run[0]), finish_rows, stage_rows, steps, layout) for run in runs]
        return reduce(DataFrame.unionByName, grouped)


def _levels_of(rows: DataFrame, key: str) -> DataFrame:
    """``id`` and the set of levels (bits) in which ``key`` occurs in rows with a ``level``."""
    return rows.groupBy(F.col(key).alias("id")).agg(F.expr("bit_or(shiftleft(1L, level))").alias("_bits"))


def _without(rows: DataFrame, *gone: DataFrame) -> DataFrame:
    """``rows(id, vec, levels)`` less the levels of ``gone(id, _bits)``; rows without a level left go."""
    for bits in gone:
        left = F.col("levels").bitwiseAND(F.bitwise_not(F.coalesce("_bits", F.lit(0).cast("long"))))
        rows = rows.join(bits, "id", "left").withColumn("levels", left).drop("_bits")
    return rows.where("levels != 0")


def _group_vectors(
    images: DataFrame, algorithm: str, limits: list[float], self_similar: bool, finish_rows: int, stage_rows: int, steps: Intermediate, layout: dict
) -> DataFrame:
    """``threshold, original_index, leader_index`` at all ``limits``; level n is ``limits[n]``."""
    alone = F.lit(not self_similar)
    if algorithm == "cosine":
        alone = alone | ~F.exists("vec", lambda x: x != 0)
    digest = F.sha2(F.concat_ws(",", F.col("vec").cast("array<string>"), F.when(alone, F.col("id").cast("string"))), 256)
    keyed = images.withColumn("digest", digest)
    vertices = steps.write(
        keyed.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("copies")),
        "vertices",
    )
    everyone = (1 << len(limits)) - 1
    points = vertices.select("id", "vec", F.lit(everyone).cast("long").alias("levels"))
    plan = cells.plan_cells(points, algorithm, **layout)
    if plan.rows <= finish_rows:  # one block settles a corpus of bounded size
        led = _settle_all(points, algorithm, limits)
    else:
        led = _led_in_rounds(points, plan, algorithm, limits, finish_rows, stage_rows, steps)
    places = vertices.select("id", "digest", "copies", F.explode(F.array(*[F.lit(n) for n in range(len(limits))])).alias("level"))
    grouped = places.join(led, ["id", "level"], "left").withColumn("leader_index", F.coalesce("leader_index", "id"))
    per_digest = grouped.groupBy("digest").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("level", "leader_index")).alias("_led"))
    spread = salted_lookup(
        keyed.select(F.col("id").alias("original_index"), "digest"), per_digest, ["digest"], weight="copies", spread=["original_index"],
    )
    threshold = F.element_at(F.array(*[F.lit(t) for t in limits]), F.col("_l.level") + 1).alias("threshold")
    return checkpointed(spread.select("original_index", F.explode("_led").alias("_l")).select(threshold, "original_index", "_l.leader_index"))


def _led_in_rounds(
    points: DataFrame, plan: cells.CellLayout, algorithm: str, limits: list[float], finish_rows: int, stage_rows: int, steps: Intermediate
) -> DataFrame:
    """``id, level, leader_index`` of the rows that another row leads."""
    loosest = max(limits) if cells.LOWER_IS_BETTER[algorithm] else min(limits)
    radius, kernel, schema = cells.metric_radius(algorithm, loosest), cells.first_kernel(algorithm, limits), "j long, level int, i long"
    cuts = _stage_cuts(points, plan.rows, stage_rows)
    smallest = lambda found: found.groupBy("j", "level").agg(F.min("i").alias("i"))

    def first_similar(data: DataFrame, probes: DataFrame, kernel) -> DataFrame:
        if data is probes and not cuts:
            return smallest(cells.cell_self_join(data, plan, radius, kernel, schema))
        stages, hits = list(zip([None, *cuts], [*cuts, None], strict=True)), []
        for low, high in stages:
            part = data if low is None else data.where(F.col("id") >= low)
            part = part if high is None else part.where(F.col("id") < high)
            found = smallest(cells.cell_join(part, probes, plan, radius, kernel, schema))
            if high is not None:  # what a smaller index range answers needs no other
                found = steps.write(found, "stage")
                probes = _without(probes, _levels_of(found, "j"))
            hits.append(found)
        return reduce(DataFrame.unionByName, hits)

    # (j, level, i): the first row similar to j.  If that row leads, it is j's leader for good.
    first = steps.write(first_similar(points, points, kernel), "first")
    beaten = first.select(F.col("j").alias("i"), "level")
    reached = [first.join(beaten, ["i", "level"], "left_anti")]
    leads = _without(points, _levels_of(first, "j"))
    open_at = _levels_of(first.join(beaten, ["i", "level"], "left_semi"), "j")
    unsettled = steps.write(points.join(open_at, "id").select("id", "vec", F.col("_bits").alias("levels")), "unsettled")
    undecided, left = unsettled, unsettled.count()
    while left:
        # asked for all unsettled rows: a late leader may precede the one found for a row so far
        reach = steps.write(first_similar(leads, unsettled, kernel), "reach")
        reached.append(reach)
        undecided = steps.write(_without(undecided, _levels_of(reach, "j"), leads.select("id", F.col("levels").alias("_bits"))), "undecided")
        left = undecided.count()
        if not left:
            break
        width = None if left <= finish_rows else _block_width(undecided, finish_rows)
        leads = steps.write(_settle(undecided, algorithm, limits, width, first_similar), "leads")
        if width is None:
            reached.append(first_similar(leads, unsettled, kernel))
            break
    led = reduce(DataFrame.unionByName, reached)
    return led.groupBy(F.col("j").alias("id"), "level").agg(F.min("i").alias("leader_index"))


def _stage_cuts(points: DataFrame, rows: int, stage_rows: int) -> list[int]:
    """Index values that split a large corpus into ranges, each 64 times the one before."""
    shares, share = [], 1.0
    while rows * share > stage_rows:
        share /= STAGE_GROWTH
        shares.append(share)
    if not shares:
        return []
    # approximate ranks are enough: the cuts only steer the order of work
    found = points.stat.approxQuantile("id", sorted(shares), min(shares) / 4)
    return sorted({int(v) for v in found})


def _block_width(rows: DataFrame, most: int, index: str = "id") -> int:
    """The widest range of indices, doubled from ``INDEX_BLOCK``, of which no aligned one holds more than ``most`` of ``rows``.

    (``INDEX_BLOCK`` itself where even that holds more.)  As rounds leave fewer rows, blocks grow.
    """
    base = rows.groupBy(F.floor(F.col(index) / INDEX_BLOCK).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    wider = base.select("n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(DOUBLINGS)), lambda k: F.floor(F.col("b") / F.pow(F.lit(2), k)))).alias("k", "b"))
    largest = wider.groupBy("k", "b").agg(F.sum("n").alias("n")).groupBy("k").agg(F.max("n").alias("n")).where(F.col("n") <= most)
    return INDEX_BLOCK << (largest.agg(F.max("k")).first()[0] or 0)


def _settle_all(points: DataFrame, algorithm: str, limits: list[float]) -> DataFrame:
    """``id, level, leader_index`` of a set of rows that one task can hold."""
    def solve(rows: pa.Table) -> pa.Table:
        ids, vectors = rows["id"].to_numpy(), cells.matrix(rows["vec"])
        open_ = np.zeros(len(ids), bool)
        led = [cells.local_leaders(ids, vectors, open_, algorithm, t)[1] for t in limits]
        levels = np.repeat(np.arange(len(limits), dtype=np.int32), len(ids))
        return pa.table({"id": np.tile(ids, len(limits)), "level": levels, "leader_index": np.concatenate(led)})

    return points.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(solve, "id long, level int, leader_index long")


def _settle(undecided: DataFrame, algorithm: str, limits: list[float], block: int | None, first_similar) -> DataFrame:
    """Leaders that can be settled inside blocks of ``block`` consecutive indices (None: one block)."""
    none = F.lit(0).cast("long")
    if block is None:
        rows = undecided.withColumns({"waits": none, "block": none})
    else:
        outside = _levels_of(first_similar(undecided, undecided, cells.first_kernel(algorithm, limits, block)), "j")
        rows = undecided.join(outside, "id", "left").withColumns(
            {"waits": F.coalesce("_bits", none), "block": F.floor(F.col("id") / block)}
        )

    def solve(rows: pa.Table) -> pa.Table:
        ids, vectors = rows["id"].to_numpy(), cells.matrix(rows["vec"])
        levels, waits = rows["levels"].to_numpy(), rows["waits"].to_numpy()
        chosen = np.zeros(len(ids), np.int64)
        for level, limit in enumerate(limits):
            at = np.flatnonzero(levels >> level & 1)
            leaders, _ = cells.local_leaders(ids[at], vectors[at], (waits[at] >> level & 1).astype(bool), algorithm, limit)
            chosen[np.isin(ids, leaders)] |= 1 << level
        keep = pa.array(np.flatnonzero(chosen))
        return rows.select(["id", "vec"]).take(keep).append_column("levels", pa.array(chosen[chosen != 0]))

    return rows.groupBy("block").applyInArrow(solve, "id long, vec array<float>, levels long")


def rank_groups(groups: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Number the groups by size (ties: smaller leader first) and attach size and rank to members.

    Sets (two or more members) come first, so ``group_rank`` counts them from 1.
    """
    sizes = groups.groupBy("leader_index").agg(F.count(F.lit(1)).alias("group_size"))
    ranked = global_index(
        sizes.withColumn("_largest", -F.col("group_size")), ["_largest", "leader_index"],
        out="group_rank", start=1, rows_per_bucket=rows_per_bucket,
    ).drop("_largest")
    members = salted_lookup(groups, ranked, ["leader_index"], weight="group_size", spread=["original_index"])
    return members.withColumn("is_duplicate", F.col("group_size") > 1)


def group_counts(ranked: DataFrame) -> DataFrame:
    """One row: number of groups, duplicate sets and unique images, and the largest size."""
    leaders = ranked.where(F.col("original_index") == F.col("leader_index"))
    return leaders.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if("is_duplicate").alias("duplicate_sets"),
        F.count_if(~F.col("is_duplicate")).alias("unique_images"),
        F.coalesce(F.max("group_size"), F.lit(0)).alias("largest"),
    )


def add_images(
    old_embeddings: DataFrame, old_groups: DataFrame, new_embeddings: DataFrame, algorithm: str = "cosine",
    threshold: float | None = None, id_col: str = "original_index", vec_col: str = "embedding", **layout,
) -> DataFrame:
    """Groups of old and new images together, from the groups of the old ones (``original_index, leader_index``).

    New images come after all old ones, so old groups stay as they are.  A new image joins the smallest old leader it is
    similar to; what no old leader takes is grouped among itself.  Cost is new images times leaders; pairs are
    never kept.  New images that come before an old one could take its members: then everything is grouped anew.
    """
    cells.check_algorithm(algorithm)
    limit = similarity.DEFAULT_THRESHOLDS[algorithm] if threshold is None else threshold
    old = similarity.valid_vectors(old_embeddings, id_col, vec_col)
    new = similarity.valid_vectors(new_embeddings, id_col, vec_col)
    last, first = old.agg(F.max("id")).first()[0], new.agg(F.min("id")).first()[0]
    if last is None or first is None or first <= last:
        return group_embeddings(old.unionByName(new), algorithm, limit, "id", "vec", **layout)
    leaders = old_groups.where(F.col("original_index") == F.col("leader_index")).select(F.col("leader_index").alias("id"))
    index = old.join(leaders, "id", "left_semi")
    plan = cells.plan_cells(index, algorithm, **layout)
    with Intermediate(old_embeddings.sparkSession) as steps:
        found = cells.cell_join(index, new, plan, cells.metric_radius(algorithm, limit), cells.first_kernel(algorithm, [limit]), "j long, level int, i long")
        taken = steps.write(found.groupBy(F.col("j").alias("original_index")).agg(F.min("i").alias("leader_index")), "taken")
        rest = new.join(taken.select(F.col("original_index").alias("id")), "id", "left_anti")
        grouped = group_embeddings(rest, algorithm, limit, "id", "vec", **layout)
        return checkpointed(old_groups.select("original_index", "leader_index").unionByName(taken).unionByName(grouped))

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.operators import cells, grouping, similarity

LAYOUTS = [{}, {"rows_per_cell": 25, "block_rows": 16}]


def corpus(spark, vectors, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    table = pa.table({
        "original_index": pa.array(ids, pa.int64()),
        "embedding": pa.array([None if v is None else list(map(float, v)) for v in vectors], pa.list_(pa.float32())),
    })
    return spark.createDataFrame(table)


def score(a, b, algorithm):
    a, b = np.float64(a), np.float64(b)
    if algorithm == "cosine":
        scale = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return 0.0 if scale == 0 else float((a * b).sum() / scale)
    return float(np.sqrt(((a - b) ** 2).sum())) if algorithm == "euclidean" else float(np.abs(a - b).sum())


def brute_pairs(vectors, algorithm, threshold):
    passes = (lambda s: s < threshold) if cells.LOWER_IS_BETTER[algorithm] else (lambda s: s > threshold)
    n = len(vectors)
    return {(i, j) for i in range(n) for j in range(i + 1, n) if passes(score(vectors[i], vectors[j], algorithm))}


def sequential_groups(n, pairs):
    leader = {}
    for i in range(n):
        if i in leader:
            continue
        leader[i] = i
        for j in range(i + 1, n):
            if j not in leader and (i, j) in pairs:
                leader[j] = i
    return leader


def clustered(seed, clusters=12, size=10, dim=8, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = (centres[:, None, :] + rng.normal(size=(clusters, size, dim)) * spread).reshape(-1, dim)
    return np.float32(rng.permutation(rows))


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("algorithm,threshold", [("cosine", 0.97), ("euclidean", 0.5), ("manhattan", 1.2), ("cosine", -0.2)])
def test_join_and_both_groupings_equal_brute_force(spark, algorithm, threshold, layout):
    vectors = clustered(3)
    vectors[5] = vectors[60]
    vectors[17] = 0.0
    vectors[90] = 0.0
    pairs = brute_pairs(vectors, algorithm, threshold)
    df = corpus(spark, vectors)
    joined = similarity.similarity_join(df, algorithm, threshold, **layout)
    rows = joined.collect()
    assert len(rows) == len(pairs) and {(r["i"], r["j"]) for r in rows} == pairs
    wanted = sequential_groups(len(vectors), pairs)
    by_pairs = grouping.group_duplicates(df.select("original_index"), joined)
    assert {r["original_index"]: r["leader_index"] for r in by_pairs.collect()} == wanted
    direct = grouping.group_embeddings(df, algorithm, threshold, finish_rows=3, **layout)
    assert {r["original_index"]: r["leader_index"] for r in direct.collect()} == wanted


@pytest.mark.parametrize("layout", LAYOUTS)
def test_long_vectors_lose_no_pairs(spark, layout):
    rng = np.random.default_rng(4)
    vectors = np.float32(clustered(6) * 0.1 + 30_000 + rng.integers(0, 2, (120, 1)) * 500)
    pairs = brute_pairs(vectors, "euclidean", 0.05)
    rows = similarity.similarity_join(corpus(spark, vectors), "euclidean", 0.05, **layout).collect()
    assert pairs and {(r["i"], r["j"]) for r in rows} == pairs


def test_strict_threshold(spark):
    df = corpus(spark, [[0, 0], [3, 4], [3, 4.5]])
    assert similarity.similarity_join(df, "euclidean", 5.0).count() == 1
    assert similarity.similarity_join(df, "manhattan", 7.0).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_grouping_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < [0.02, 0.05, 0.1, 0.3][seed]}
    frame = spark.createDataFrame([(i, j) for i, j in pairs], "i long, j long")
    out = grouping.group_duplicates(spark.range(n).withColumnRenamed("id", "original_index"), frame)
    assert {r["original_index"]: r["leader_index"] for r in out.collect()} == sequential_groups(n, pairs)


def test_leaders_are_not_components(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "i long, j long")
    out = grouping.group_duplicates(spark.range(3).withColumnRenamed("id", "original_index"), pairs)
    assert {r[0]: r[1] for r in out.collect()} == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("finish_rows", [0, 4096])
def test_long_chain(spark, finish_rows):
    """Each image is similar only to its neighbours: the worst case for rounds."""
    angles = np.arange(14) * 0.2
    vectors = np.float32(np.stack([np.cos(angles), np.sin(angles)], axis=1))
    out = grouping.group_embeddings(corpus(spark, vectors), "cosine", 0.975, finish_rows=finish_rows)
    assert {r[0]: r[1] for r in out.collect()} == {k: k - k % 2 for k in range(14)}


def test_chain_of_pairs(spark):
    n = 40
    pairs = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "i long, j long")
    out = grouping.group_duplicates(spark.range(n).withColumnRenamed("id", "original_index"), pairs)
    assert {r[0]: r[1] for r in out.collect()} == {k: k - k % 2 for k in range(n)}


def test_third_of_the_corpus_is_one_image(spark):
    vectors = clustered(8, clusters=6, size=10)
    vectors[::3] = vectors[0]
    pairs = brute_pairs(vectors, "cosine", 0.98)
    out = grouping.group_embeddings(corpus(spark, vectors), "cosine", 0.98, block_rows=8)
    assert {r[0]: r[1] for r in out.collect()} == sequential_groups(len(vectors), pairs)


def test_near_copies_in_stages(spark):
    """A dense cluster, its rows all different, asked in index ranges."""
    vectors = clustered(8, clusters=6, size=20, spread=0.05)
    vectors[::3] = vectors[0] + np.random.default_rng(1).normal(size=(40, 8)).astype(np.float32) * 0.01
    pairs = brute_pairs(vectors, "cosine", 0.98)
    assert len(grouping._stage_cuts(corpus(spark, vectors).withColumnRenamed("original_index", "id"), 120, 30)) == 1
    out = grouping.group_embeddings(corpus(spark, vectors), "cosine", 0.98, stage_rows=30, finish_rows=2, rows_per_cell=40)
    assert {r[0]: r[1] for r in out.collect()} == sequential_groups(len(vectors), pairs)


def test_null_embeddings_are_excluded(spark):
    df = corpus(spark, [[1, 0], None, [1, 0.01]])
    assert [(r["i"], r["j"]) for r in similarity.similarity_join(df, "cosine", 0.9).collect()] == [(0, 2)]
    assert {r[0] for r in grouping.group_embeddings(df, "cosine", 0.9).collect()} == {0, 2}


def test_rank_groups_orders_by_size_then_leader(spark):
    groups = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "original_index long, leader_index long")
    out = {r["original_index"]: (r["group_rank"], r["group_size"], r["is_duplicate"]) for r in grouping.rank_groups(groups, 2).collect()}
    assert out == {0: (3, 1, False), 1: (1, 2, True), 2: (1, 2, True), 3: (2, 2, True), 4: (2, 2, True), 5: (4, 1, False)}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_nearest_neighbours_equal_brute_force(spark, layout):
    vectors = clustered(5)
    out = similarity.knn_graph(corpus(spark, vectors), k=4, **layout).collect()
    unit = np.float64(vectors) / np.linalg.norm(np.float64(vectors), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    wanted = {(i, int(j), r + 1) for i in range(len(vectors)) for r, j in enumerate(np.argsort(-sims[i], kind="stable")[:4])}
    assert {(r["i"], r["j"], r["rank"]) for r in out} == wanted


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("new", ["original_index >= 80", "original_index < 15", "original_index < 0", "original_index >= 0"])
def test_adding_images_equals_grouping_everything(spark, new, layout):
    vectors = clustered(9)
    df = corpus(spark, vectors)
    old = df.where(f"not ({new})")
    out = grouping.add_images(old, grouping.group_embeddings(old, "cosine", 0.98), df.where(new), "cosine", 0.98, **layout)
    assert {r[0]: r[1] for r in out.collect()} == sequential_groups(len(vectors), brute_pairs(vectors, "cosine", 0.98))


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("algorithm,thresholds", [("cosine", [0.9, 0.97, 0.98, 1.0, -0.2]), ("euclidean", [0.3, 0.5, 0.0]), ("manhattan", [1.2])])
def test_sweep_equals_one_grouping_per_threshold(spark, algorithm, thresholds, layout):
    vectors = clustered(3)
    vectors[5], vectors[17], vectors[90] = vectors[60], 0.0, 0.0
    swept = grouping.regroup_sweep(corpus(spark, vectors), algorithm, [*thresholds, thresholds[0]], finish_rows=3, stage_rows=60, **layout)
    found = {}
    for r in swept.collect():
        found.setdefault(r["threshold"], {})[r["original_index"]] = r["leader_index"]
    assert swept.count() == len(vectors) * len(thresholds)
    for t in thresholds:
        assert found[t] == sequential_groups(len(vectors), brute_pairs(vectors, algorithm, t))


def jobs_of(spark, function):
    """Spark jobs that ``function`` runs."""
    group = f"count-{id(function)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        function()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_three_thresholds_take_the_jobs_of_one(spark):
    df = corpus(spark, clustered(3))
    count = lambda thresholds: jobs_of(spark, lambda: grouping.regroup_sweep(df, "cosine", thresholds, finish_rows=3, rows_per_cell=25).collect())
    assert count([0.9, 0.95, 0.98]) <= 1.5 * max(count([t]) for t in (0.9, 0.95, 0.98))


def test_long_chain_of_pairs_takes_few_jobs(spark):
    n = 32_768
    pairs = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    out = []
    assert jobs_of(spark, lambda: out.extend(grouping.group_duplicates(spark.range(n).withColumnRenamed("id", "original_index"), pairs).collect())) <= 50
    assert all(r[1] == r[0] - r[0] % 2 for r in out) and len(out) == n


def crowded(seed, rows=400, dim=6):
    """A third of the rows in one dense region, no two alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(rows, dim))
    vectors[: rows // 3] = vectors[0] + rng.normal(size=(rows // 3, dim)) * 0.02
    return np.float32(rng.permutation(vectors))


def test_crowded_cells_get_pivots_of_their_own(spark):
    vectors = crowded(1)
    df = corpus(spark, vectors)
    points = similarity.valid_vectors(df, "original_index", "embedding")
    plan = cells.plan_cells(points, "euclidean", rows_per_cell=20, max_pivots=8, block_rows=16)
    assert plan.inner and plan.first_cells()[-1] > len(plan.pivots)
    assert {(r["i"], r["j"]) for r in similarity.similarity_join(df, "euclidean", 0.05, rows_per_cell=20, max_pivots=8, block_rows=16).collect()} == brute_pairs(vectors, "euclidean", 0.05)
    bounded = cells.plan_cells(points, "euclidean", rows_per_cell=20, max_pivots=8, pivot_bytes=0)
    assert not bounded.inner
    near = similarity.knn_graph(df, k=3, rows_per_cell=20, max_pivots=8, block_rows=16)
    assert near.count() == 3 * len(vectors)


def test_shuffled_rows_grow_with_the_corpus(spark):
    """Copies of rows made for block pairs: four times the rows, at most five times the copies, although a third is one region.

    The radius is small beside the region; a radius that spans several cells costs more visits (0.01 here: 6.3 times).
    """
    def copies(rows, **bound):
        points = similarity.valid_vectors(corpus(spark, crowded(2, rows)), "original_index", "embedding")
        plan = cells.plan_cells(points, "euclidean", rows_per_cell=50, max_pivots=8, block_rows=64, **bound)
        seen = cells.cell_self_join(points, plan, 0.002, lambda a, b, both: pa.table({"n": pa.array([len(a.ids) + len(b.ids)], pa.int64())}), "n long")
        return sum(r["n"] for r in seen.collect())

    assert copies(4000) <= 5 * copies(1000)
    assert copies(4000, pivot_bytes=0) > 8 * copies(1000, pivot_bytes=0)  # without pivots of its own for the region


def test_projection_matches_numpy(spark):
    from framelake.operators.projection import project_2d

    vectors = clustered(2)
    df = corpus(spark, vectors).withColumnRenamed("original_index", "image_id")
    got = {r["image_id"]: (r["x"], r["y"]) for r in project_2d(df).collect()}
    v = np.float64(vectors)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    assert np.allclose([got[k] for k in range(len(v))], v @ axes, atol=1e-6)
    assert project_2d(df.where("image_id < 2")).count() == 0


def test_manhattan_scores_of_a_block_are_rough_within_their_band_and_pairs_exact():
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.125, (300, 64)).astype(np.float32).astype(np.float64)
    a, b = vectors[:180], vectors[180:]
    width = cells.band(a, b, "manhattan", 7.0)
    exact = np.abs(a[:, None] - b[None]).sum(axis=2)
    scores = cells.rough_scorer(a, b, "manhattan", width)
    assert scores(5, 77).dtype == np.float32  # 16-bit sums, not doubles
    assert 0 < np.abs(scores(5, 77) - exact[:, 5:77]).max() <= width < 0.14
    # a limit that rounding would blur, and values too far apart for 16 bits, keep doubles
    far = np.concatenate([b, np.full((1, 64), 1e6)])
    for right, limit in ((b, 0.001), (far, 7.0)):
        assert cells.band(a, right, "manhattan", limit) == cells.BAND
    rows = lambda v, at: cells.Rows(np.arange(at, at + len(v)), v, np.full(len(v), -1))
    limit = float(np.sort(exact, axis=None)[500])  # a pair at the limit itself does not pass
    for right in (b, far):
        out = cells.pair_kernel("manhattan", limit)(rows(a, 0), rows(right, 180), True)
        pairs = {(i, j) for i, j in zip(out["i"].to_pylist(), out["j"].to_pylist(), strict=True)}
        found = cells.scores_at(a, b, *[x.ravel() for x in np.indices(exact.shape)], "manhattan").reshape(exact.shape) < limit
        assert pairs == {(int(x), int(y) + 180) for x, y in np.argwhere(found)}


def test_nearest_matches_below_the_known_floor_are_not_returned():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 8))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    data = cells.Rows(np.arange(300), vectors[:300], np.full(300, -1))
    floors = np.full(100, 0.9)
    floors[0] = -np.inf
    probes = cells.Rows(np.arange(300, 400), vectors[300:], np.full(100, -1), floors)
    out = cells.nearest_kernel(15)(data, probes, False)
    got = set(zip(out["i"].to_pylist(), out["j"].to_pylist(), strict=True))
    wanted = set()
    for n, scores in enumerate(unit[300:] @ unit[:300].T):
        wanted |= {(300 + n, int(j)) for j in np.argsort(-scores)[:15] if scores[j] >= floors[n]}
    assert got == wanted and len(got) < 100 * 15


def test_blocks_grow_with_the_corpus_so_that_a_row_is_sent_a_bounded_number_of_times(spark):
    sent = {}
    for rows in (10_000, 80_000):
        points = spark.range(rows).select("id", F.array((F.col("id") % 100).cast("float"), F.floor(F.col("id") / 100).cast("float")).alias("vec"))
        plan = cells.plan_cells(points, "euclidean", rows_per_cell=rows)  # one cell
        probe = lambda a, b, both: pa.table({"n": pa.array([len(a.ids) + (0 if a is b else len(b.ids))], pa.int64())})
        sent[rows] = cells.cell_self_join(points, plan, 1.0, probe, "n long").agg(F.sum("n")).first()[0] / rows
    assert sent[80_000] <= 1.1 * sent[10_000] and sent[80_000] <= cells.BLOCKS + 1


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_first_similar_rows_from_few_and_from_many_close_pairs(share):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(240, 6))
    ids = np.sort(rng.permutation(1000)[:240])
    score = cells.pair_scores(np.repeat(vectors, 240, axis=0), np.tile(vectors, (240, 1)), "euclidean").reshape(240, 240)
    limits = [float(np.quantile(score, share)), float(np.quantile(score, share / 2))]
    levels = rng.integers(0, 4, 240)
    a = rng.permutation(240) < 130
    sides = [cells.Rows(ids[m], vectors[m], levels[m]) for m in (a, ~a)]
    out = cells.first_kernel("euclidean", limits, 64)(*sides, True)
    got = {}
    for j, level, i in zip(*[out[c].to_pylist() for c in ("j", "level", "i")], strict=True):
        got[j, level] = min(i, got.get((j, level), i))
    wanted = {}
    for y in range(240):
        for level, limit in enumerate(limits):
            ok = [x for x in range(y) if a[x] != a[y] and score[x, y] < limit and levels[x] & levels[y] & 1 << level and ids[x] // 64 != ids[y] // 64]
            if ok:
                wanted[int(ids[y]), level] = int(ids[ok[0]])
    assert got == wanted

"""Embedding, grouping and best-of-group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import vectors as V
from framelake.operators import grouping as G
from framelake.operators import projection as P
from framelake.operators import quality as K
from framelake.operators import similarity as S
from framelake.operators.tensors import unpack_pixels
from framelake.scratch import checkpointed
from workload import tables as D
from workload.pixel_queries import SQL_KPIS
from workload.registry import query

VEC = D.SQL_VECTORS
LIMITS = {"cosine": 0.35, "euclidean": 1.1, "manhattan": 7.0}
COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
EUCLID = "list_distance(a.e, b.e)"
MANHATTAN = "list_sum(list_transform(range(1, len(a.e) + 1), lambda k: abs(a.e[k] - b.e[k])))"


def sql_pairs(name: str, score: str, test: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT a.vec_id AS i, b.vec_id AS j, {score} AS score FROM vec a JOIN vec b ON a.vec_id < b.vec_id) WHERE score {test})"


def sql_walk(pairs: str, out: str, by: str = "0") -> str:
    """Sequential leader grouping of all vectors, image by image (needs WITH RECURSIVE)."""
    return f"""{out}_n AS (SELECT {by} AS part, j, list(i) AS smaller FROM {pairs} GROUP BY ALL),
  {out}_p AS (SELECT DISTINCT part FROM (SELECT part FROM {out}_n UNION ALL SELECT 0) WHERE part <> 0 OR '{by}' = '0'),
  {out}_v AS (SELECT q.part, e.vec_id AS k, row_number() OVER (PARTITION BY q.part ORDER BY e.vec_id) AS rn, coalesce(smaller, []) AS smaller
    FROM {out}_p q CROSS JOIN embeddings e LEFT JOIN {out}_n n ON n.part = q.part AND n.j = e.vec_id),
  {out}_w AS (SELECT part, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS leaders FROM {out}_p
    UNION ALL SELECT v.part, v.rn, CASE WHEN list_has_any(w.leaders, v.smaller) THEN w.leaders ELSE list_append(w.leaders, v.k) END
    FROM {out}_w w JOIN {out}_v v ON v.part = w.part AND v.rn = w.rn + 1),
  {out}_l AS (SELECT part, unnest(leaders) AS leader FROM {out}_w QUALIFY row_number() OVER (PARTITION BY part ORDER BY rn DESC) = 1),
  {out} AS (SELECT v.part, v.k AS original_index, coalesce(min(l.leader), v.k) AS leader_index
    FROM {out}_v v LEFT JOIN {out}_l l ON l.part = v.part AND list_contains(v.smaller, l.leader) GROUP BY v.part, v.k)"""


SQL_COSINE = sql_pairs("cp", COSINE, "> 0.35e0")
SQL_GROUPS = f"{VEC}, {SQL_COSINE}, {sql_walk('cp', 'gp')}"
SQL_RANKED = f"""{SQL_GROUPS}, gs AS (SELECT leader_index, count(*) AS group_size FROM gp GROUP BY leader_index),
  gk AS (SELECT *, row_number() OVER (ORDER BY group_size DESC, leader_index) AS group_rank FROM gs),
  rk AS (SELECT gp.original_index, gp.leader_index, group_size, group_rank, group_size > 1 AS is_duplicate FROM gp JOIN gk USING (leader_index))"""


@query("extract_cls", """SELECT vec_id, array_to_string(list_transform(CASE WHEN vec_id % 3 < 2 THEN embedding[1:16] END, lambda v: CAST(round(v * 1000000) AS BIGINT)), ',') AS embedding,
  CASE WHEN vec_id % 3 = 2 THEN 'expected 16 values, got 20' END AS error FROM embeddings""")
def extract_cls(spark, sf_dir):
    kept = F.when(F.col("vec_id") % 3 == 0, 64).when(F.col("vec_id") % 3 == 1, 16).otherwise(20)
    features = D.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), kept).alias("features"))
    good, bad = S.extract_cls(features, dim=16, tokens=4)
    whole = F.transform("embedding", lambda v: F.round(v * F.lit(1000000.0).cast("float")).cast("long").cast("string"))
    return good.select("vec_id", F.array_join(whole, ",").alias("embedding"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("vec_id", F.lit(None).cast("string").alias("embedding"), "error"))


@query("mean_pool_normalize", f"""WITH {VEC}, m AS (SELECT vec_id, list_transform(range(1, 17), lambda d: (e[d] + e[d + 16] + e[d + 32] + e[d + 48]) / 4) AS p FROM vec)
  SELECT vec_id, CAST(d - 1 AS INTEGER) AS pos, round(p[d] / sqrt(list_dot_product(p, p)), 6) AS value FROM m, range(1, 17) t(d)""")
def mean_pool_normalize(spark, sf_dir):
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.slice(V.as_double(F.col("embedding")), t * 16 + 1, 16))
    pooled = S.mean_pool_normalize(D.table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("tokens")))
    return pooled.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("value"))


@query("embedding_norm", f"WITH {VEC} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM vec")
def embedding_norm(spark, sf_dir):
    return S.embedding_norm(D.table(spark, sf_dir, "embeddings")).select("vec_id", F.round("norm", 6).alias("norm"))


def _with_next(spark, sf_dir, score):
    """Score of every vector against the following one."""
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("e"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(score(F.col("e"), F.col("f")), 6).alias("score"))


def sql_next(score: str) -> str:
    return f"WITH {VEC} SELECT a.vec_id, round({score}, 6) AS score FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1"


@query("cosine_similarity", sql_next(COSINE))
def cosine_similarity(spark, sf_dir):
    return _with_next(spark, sf_dir, V.cosine_similarity)


@query("euclidean_distance", sql_next(EUCLID))
def euclidean_distance(spark, sf_dir):
    return _with_next(spark, sf_dir, V.euclidean_distance)


@query("manhattan_distance", sql_next(MANHATTAN))
def manhattan_distance(spark, sf_dir):
    return _with_next(spark, sf_dir, V.manhattan_distance)


@query("similarity_config", """WITH c AS (SELECT * FROM (VALUES ('cosine', 0.1e0, 0.99e0, 0.98e0, 0.01e0, false), ('euclidean', 0.1e0, 50e0, 10e0, 0.1e0, true),
    ('manhattan', 1e0, 500e0, 100e0, 1e0, true)) t(algorithm, min_threshold, max_threshold, default_threshold, step, lower_is_better))
  SELECT vec_id, c.* FROM embeddings JOIN c ON algorithm = ['cosine', 'euclidean', 'manhattan'][vec_id % 3 + 1]""")
def similarity_config(spark, sf_dir):
    """Settings every image falls back to when its algorithm is chosen."""
    names = F.array(*[F.lit(r["algorithm"]) for r in S.SIMILARITY_CONFIG])
    chosen = D.table(spark, sf_dir, "embeddings").select("vec_id", F.get(names, (F.col("vec_id") % 3).cast("int")).alias("algorithm"))
    return chosen.join(S.similarity_config(spark), "algorithm")


def _pairs(spark, sf_dir, algorithm):
    pairs = S.similarity_join(D.vectors(spark, sf_dir), algorithm, LIMITS[algorithm])
    return pairs.select("i", "j", F.round("score", 6).alias("score"))


def sql_join(score: str, test: str) -> str:
    return f"WITH {VEC}, {sql_pairs('p', score, test)} SELECT i, j, round(score, 6) AS score FROM p"


@query("similarity_join", sql_join(COSINE, "> 0.35e0"))
def similarity_join(spark, sf_dir):
    return _pairs(spark, sf_dir, "cosine")


@query("similarity_join_euclidean", sql_join(EUCLID, "< 1.1e0"))
def similarity_join_euclidean(spark, sf_dir):
    return _pairs(spark, sf_dir, "euclidean")


@query("similarity_join_manhattan", sql_join(MANHATTAN, "< 7e0"))
def similarity_join_manhattan(spark, sf_dir):
    return _pairs(spark, sf_dir, "manhattan")


@query("group_duplicates", f"WITH RECURSIVE {SQL_GROUPS} SELECT original_index, leader_index FROM gp")
def group_duplicates(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    return G.group_duplicates(v.select("original_index"), S.similarity_join(v, "cosine", LIMITS["cosine"]))


@query("group_embeddings", f"WITH RECURSIVE {VEC}, {sql_pairs('ep', EUCLID, '< 1.1e0')}, {sql_walk('ep', 'gp')} SELECT original_index, leader_index FROM gp")
def group_embeddings(spark, sf_dir):
    return G.group_embeddings(D.vectors(spark, sf_dir), "euclidean", LIMITS["euclidean"])


def _ranked(spark, sf_dir):
    return G.rank_groups(G.group_embeddings(D.vectors(spark, sf_dir), "cosine", LIMITS["cosine"]))


@query("rank_groups", f"WITH RECURSIVE {SQL_RANKED} SELECT * FROM rk")
def rank_groups(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query("group_counts", f"""WITH RECURSIVE {SQL_RANKED} SELECT count(*) AS groups, count(*) FILTER (is_duplicate) AS duplicate_sets,
  count(*) FILTER (NOT is_duplicate) AS unique_images, max(group_size) AS largest FROM rk WHERE original_index = leader_index""")
def group_counts(spark, sf_dir):
    return G.group_counts(_ranked(spark, sf_dir))


LEVELS = [0.34, 0.36, 0.4]


@query("regroup_sweep", f"""WITH RECURSIVE {VEC}, {sql_pairs('sp', COSINE, '> 0.34e0')},
  lv AS (SELECT unnest([0.34e0, 0.36e0, 0.4e0]) AS level), lp AS (SELECT level, i, j FROM sp JOIN lv ON score > level),
  {sql_walk('lp', 'gp', 'level')} SELECT part AS threshold, original_index, leader_index FROM gp""")
def regroup_sweep(spark, sf_dir):
    return G.regroup_sweep(D.vectors(spark, sf_dir), "cosine", LEVELS)


@query("add_images", f"WITH RECURSIVE {SQL_GROUPS} SELECT original_index, leader_index FROM gp")
def add_images(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    size = v.agg(F.max("original_index")).first()[0] + 1
    old, new = v.where(F.col("original_index") < size * 3 // 4), v.where(F.col("original_index") >= size * 3 // 4)
    return G.add_images(old, G.group_embeddings(old, "cosine", LIMITS["cosine"]), new, "cosine", LIMITS["cosine"])


@query("knn_graph", f"""WITH {VEC}, s AS (SELECT a.vec_id AS i, b.vec_id AS j, {COSINE} AS score FROM vec a JOIN vec b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS rank FROM s)
  SELECT i, j, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= least(15, greatest(2, (SELECT count(*) FROM vec) // 3))""")
def knn_graph(spark, sf_dir):
    return S.knn_graph(D.vectors(spark, sf_dir)).select("i", "j", "rank", F.round("score", 6).alias("score"))


# One row: as many points as vectors, axes without correlation, the wider one first, and for each axis the share
# of its variance that its covariances with the dimensions explain, which is 1 for a principal axis only.
@query("project_2d", """SELECT count(*) AS points, 0e0 AS correlation, true AS wider_first, 1e0 AS x_axis, 1e0 AS y_axis FROM embeddings WHERE embedding IS NOT NULL""")
def project_2d(spark, sf_dir):
    v = checkpointed(P.project_2d(D.vectors(spark, sf_dir))).join(D.vectors(spark, sf_dir), "image_id")
    dims = len(D.vectors(spark, sf_dir).first()["embedding"])
    e = V.as_double(F.col("embedding"))
    axes = {c: [F.covar_pop(c, e[k]).alias(f"{c}{k}") for k in range(dims)] for c in "xy"}
    sums = v.agg(F.count(F.lit(1)).alias("points"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), *axes["x"], *axes["y"])

    def share(c: str):
        return F.round(sum(F.col(f"{c}{k}") * F.col(f"{c}{k}") for k in range(dims)) / (F.col(f"v{c}") * F.col(f"v{c}")), 6).alias(f"{c}_axis")

    return sums.select("points", F.abs(F.round("xy", 9)).alias("correlation"), (F.col("vx") >= F.col("vy")).alias("wider_first"), share("x"), share("y"))


def _points(spark, sf_dir):
    return P.project_2d(D.vectors(spark, sf_dir))


# The plotted places are the projection's, which project_2d checks; here they count as whole points.
@query("plot_attributes", f"""WITH RECURSIVE {SQL_RANKED} SELECT original_index AS image_id, true AS placed,
  CASE WHEN is_duplicate THEN ['#ff6b6b', '#4ecdc4', '#45b7d1', '#f9ca24', '#6c5ce7', '#a55eea', '#26de81', '#fd79a8', '#00b894', '#e17055'][(group_rank - 1) % 10 + 1]
    ELSE '#000000' END AS color, CASE WHEN is_duplicate THEN 10e0 ELSE 8e0 END AS size FROM rk""")
def plot_attributes(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).withColumn("image_id", F.col("original_index"))
    plotted = P.plot_attributes(_points(spark, sf_dir), ranked)
    return plotted.select("image_id", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed"), "color", "size")


# The view is a square whose side is 1.2 times the wider span of the points, around their middle.
@query("plot_viewport", "SELECT true AS square, 1.2e0 AS wider, 0e0 AS off_x, 0e0 AS off_y, 0 AS outside")
def plot_viewport(spark, sf_dir):
    points = checkpointed(_points(spark, sf_dir))
    view = P.plot_viewport(points)
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    one = view.withColumn("_k", F.lit(1)).join(box.withColumn("_k", F.lit(1)), "_k")  # one row each
    wide, tall = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    span = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"))
    off = lambda a, b, c: F.abs(F.round((F.col(a) + F.col(b)) / 2 - (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2, 6))
    outside = (F.col("lo_x") < F.col("left")).cast("int") + (F.col("hi_x") > F.col("right")).cast("int") + (F.col("lo_y") < F.col("bottom")).cast("int") + (
        F.col("hi_y") > F.col("top")).cast("int")
    return one.select((F.abs(wide - tall) < 1e-9).alias("square"), F.round(wide / span, 6).alias("wider"), off("left", "right", "x").alias("off_x"),
                      off("top", "bottom", "y").alias("off_y"), outside.alias("outside"))


# ---- best of group; every 11th image has no measures ----


def _judged(spark, sf_dir):
    ranked = checkpointed(_ranked(spark, sf_dir).withColumn("image_id", F.col("original_index")))
    sizes = D.image_sizes(spark, sf_dir)
    # only members of duplicate sets are unpacked and measured
    members = ranked.where("is_duplicate and image_id % 11 <> 0").select("image_id")
    wanted = unpack_pixels(D.images(spark, sf_dir).join(members, "image_id", "left_semi"))
    return ranked, checkpointed(K.quality_kpis(wanted, sizes)), sizes


SQL_JUDGED = f"{SQL_RANKED}, {D.SQL_PIXELS}, {SQL_KPIS}, ks AS (SELECT rk.*, kp.*, kp.width * kp.height AS resolution FROM rk JOIN kp ON image_id = original_index WHERE is_duplicate AND image_id % 11 <> 0)"


def sql_first(metric: str, order: str) -> str:
    return f"SELECT image_id, '{metric}' AS metric FROM ks QUALIFY row_number() OVER (PARTITION BY leader_index ORDER BY {metric} {order}, original_index) = 1"


BEST = {"sharpness": "DESC", "noise_level": "ASC", "contrast": "DESC", "exposure": "DESC", "resolution": "DESC"}


@query("best_flags", f"""WITH RECURSIVE {SQL_JUDGED}, bf AS ({' UNION ALL '.join(f'({sql_first(m, o)})' for m, o in BEST.items())})
  SELECT original_index AS image_id, leader_index, {', '.join(f"coalesce(bool_or(metric = '{m}'), false) AS best_{m}" for m in BEST)}
  FROM rk LEFT JOIN bf ON image_id = original_index WHERE is_duplicate GROUP BY original_index, leader_index""")
def best_flags(spark, sf_dir):
    ranked, kpis, _ = _judged(spark, sf_dir)
    return K.best_flags(ranked.where("is_duplicate"), kpis).select("image_id", "leader_index", *[f"best_{m}" for m in BEST])


SQL_BEST = "SELECT leader_index, image_id FROM ks QUALIFY row_number() OVER (PARTITION BY leader_index ORDER BY resolution DESC, sharpness DESC, noise_level, contrast DESC, exposure DESC, original_index) = 1"


@query("best_in_group", f"""WITH RECURSIVE {SQL_JUDGED} SELECT * FROM ({SQL_BEST})
  WHERE leader_index NOT IN (SELECT leader_index FROM rk WHERE is_duplicate AND original_index % 11 = 0)""")
def best_in_group(spark, sf_dir):
    ranked, kpis, _ = _judged(spark, sf_dir)
    return K.best_in_group(ranked.where("is_duplicate"), kpis)


@query("select_keepers", f"""WITH RECURSIVE {SQL_JUDGED}, b AS ({SQL_BEST})
  SELECT original_index AS image_id, 'img_' || original_index || '.png' AS name, CAST(NULL AS VARCHAR) AS warning FROM rk WHERE NOT is_duplicate
  UNION ALL SELECT image_id, 'img_' || image_id || '.png', NULL FROM b
  UNION ALL SELECT leader_index, NULL, 'no measured image: set omitted' FROM rk WHERE is_duplicate AND original_index = leader_index
    AND leader_index NOT IN (SELECT leader_index FROM b)""")
def select_keepers(spark, sf_dir):
    ranked, kpis, sizes = _judged(spark, sf_dir)
    keepers, warnings = K.select_keepers(ranked, kpis, sizes)
    text = F.lit(None).cast("string")
    return keepers.select("image_id", "name", text.alias("warning")).unionByName(
        warnings.select(F.col("leader_index").alias("image_id"), text.alias("name"), "warning"))

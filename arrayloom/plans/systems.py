"""Registered queries for solving, factoring, tree search and BF16 scans, with DuckDB SQL.

SQL has no solver, so solves are checked by a known solution: the right side is the matrix times a vector that SQL knows
too. Factors are multiplied out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bf16
from ..operators import causal, cluster, layout, linalg
from .catalog import BF, BFD, D, EMB, FP, MOMENTS, NEAR, _fp_queries, _series, _tree, emb, halves, moments, prints, query, r6, vectors

# Solving


def _known(spark, n: int = D) -> DataFrame:
    """(i, x): the solution that all right sides come from."""
    return spark.range(n).select(F.col("id").alias("i"), ((F.col("id") % 5) - 2 + F.col("id") * F.lit(0.013)).alias("x"))


def _r4(c: str, name: str):
    return (F.round(c, 4) + 0.0).alias(name)


SOLUTION = "round(i % 5 - 2 + i * 0.013::DOUBLE, 4) + 0.0"


def _sides(a: DataFrame, v: DataFrame) -> DataFrame:
    """(m, i, x): each matrix (m, i, k, x) times the vector (i, x)."""
    right = v.select(F.col("i").alias("k"), F.col("x").alias("b"))
    return a.join(right, "k").groupBy("m", "i").agg(F.sum(F.col("x") * F.col("b")).alias("x"))


@query(f"WITH l AS (SELECT DISTINCT label::BIGINT AS m FROM embeddings) SELECT m, i, {SOLUTION} AS x, {SOLUTION} AS chol FROM l, range(64) g(i)")
def lu_solve(spark, d):
    """Each label's system of second moments, by LU and by Cholesky."""
    a = cluster.kept(moments(spark, d))
    b = cluster.kept(_sides(a, _known(spark)))
    one, two = (linalg.solve_systems(a, b, D, kind) for kind in ("lu", "cholesky"))
    return one.join(two.withColumnRenamed("x", "y"), ["m", "i"]).select("m", "i", _r4("x", "x"), _r4("y", "chol"))


@query(f"WITH {MOMENTS} SELECT m, i, k, round(x, 5) + 0.0 AS x FROM mom")
def lu_factors(spark, d):
    """LU factors of each label's second moments, multiplied out again. A diagonal that dominates keeps the rows in order."""
    a = moments(spark, d).withColumn("x", F.col("x") + F.when(F.col("i") == F.col("k"), 9.0).otherwise(0.0))
    back = linalg.rebuilt(linalg.per_matrix(a, D, "lu").where("info = 0"), D, "lu")
    return back.select("m", "i", "k", (F.round(F.col("x") - F.when(F.col("i") == F.col("k"), 9.0).otherwise(0.0), 5) + 0.0).alias("x"))


@query(f"WITH {MOMENTS} SELECT a.m, a.k AS i, b.k, round(sum(a.x * b.x), 5) + 0.0 AS x FROM mom a JOIN mom b ON a.m = b.m AND a.i = b.i GROUP BY ALL")
def qr_factors(spark, d):
    """R' R of each label's second moments A, which is A' A."""
    back = linalg.rebuilt(linalg.per_matrix(moments(spark, d), D, "qr"), D, "qr")
    return back.select("m", "i", "k", (F.round("x", 5) + 0.0).alias("x"))


@query(f"SELECT i AS k, j, round((i % 5 - 2 + i * 0.013::DOUBLE) * (j + 1), 4) + 0.0 AS x, round((i % 5 - 2 + i * 0.013::DOUBLE) * (j + 1), 4) + 0.0 AS t FROM range(64) g(i), range(6) h(j)")
def trsm(spark, d):
    """Six right sides under the upper triangle of all second moments, and under its transpose."""
    a = cluster.kept(linalg.gram(vectors(spark, d)).select("i", F.col("j").alias("k"), (F.col("x") / F.col("n") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("x")))
    up = a.where("i <= k")
    known = _known(spark).crossJoin(spark.range(6).select(F.col("id").alias("j"))).select(F.col("i").alias("k"), "j", (F.col("x") * (F.col("j") + 1)).alias("x"))
    b, bt = (linalg.matmul(linalg.transposed(up, t), known).select(F.col("i").alias("k"), "j", "x") for t in (False, True))
    one, two = linalg.trsm(a, D, b, upper=True), linalg.trsm(a, D, bt, upper=True, trans=True)
    return one.join(two.withColumnRenamed("x", "t"), ["k", "j"]).select("k", "j", _r4("x", "x"), _r4("t", "t"))


@query(f"WITH {EMB}, g AS (SELECT a.i, b.i AS k, sum(a.x * b.x) AS x FROM emb a JOIN emb b ON a.vec_id = b.vec_id GROUP BY ALL), v AS (SELECT i AS k, label::BIGINT AS j, avg(x) AS x FROM emb GROUP BY ALL) SELECT g.i, v.j, round(sum(2 * g.x * v.x), 6) + 0.0 AS x FROM g JOIN v USING (k) GROUP BY g.i, v.j")
def symm(spark, d):
    half = linalg.gram(vectors(spark, d)).where("i <= j").select("i", F.col("j").alias("k"), "x")
    b = emb(spark, d).groupBy(F.col("i").alias("k"), F.col("label").cast("bigint").alias("j")).agg(F.avg("x").alias("x"))
    return linalg.symm(half, b, upper=True, alpha=2.0).select("i", "j", r6(F.col("x"), "x"))


@query(f"WITH {EMB} SELECT vec_id AS i, label::BIGINT AS j, round(sum(emb.x * c.x), 6) + 0.0 AS x FROM emb JOIN (SELECT label, i, avg(x) AS x FROM emb GROUP BY label, i) c USING (i) GROUP BY ALL".replace("label::BIGINT AS j", "c.label::BIGINT AS j"))
def tall_product(spark, d):
    """All vectors times the labels' means, by blocks of rows."""
    b = emb(spark, d).groupBy(F.col("i").alias("k"), F.col("label").cast("bigint").alias("j")).agg(F.avg("x").alias("x"))
    out = linalg.block_product(vectors(spark, d).select(F.col("vec_id").alias("i"), F.col("v").cast("array<double>").alias("v")), b, int(b.agg(F.max("j")).first()[0]) + 1)
    return layout.to_long(out.withColumnRenamed("i", "r"), "r", "v").select(F.col("r").alias("i"), F.col("i").cast("bigint").alias("j"), r6(F.col("x"), "x"))


# Trees

TOP5 = f"WITH {NEAR} SELECT qid, id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank FROM near) WHERE rank <= 5"


@query(f"WITH {NEAR} SELECT qid, id, dist FROM near WHERE dist <= 14")
def tree_radius(spark, d):
    queries, _ = _fp_queries(spark, d)
    return cluster.rho_neighbours(queries, *_tree(spark, d), 14)


@query(TOP5)
def tree_knn_sieve(spark, d):
    queries, _ = _fp_queries(spark, d)
    return cluster.knn_sieve(queries, *_tree(spark, d), 5)


@query(TOP5)
def tree_knn_growing(spark, d):
    queries, _ = _fp_queries(spark, d)
    return cluster.knn_growing(queries, *_tree(spark, d), 5)


@query(TOP5)
def lod_knn(spark, d):
    """With both bounds: the triangle inequality and the or of each leaf's vectors."""
    queries, _ = _fp_queries(spark, d)
    nodes, members, rows = _tree(spark, d, max_depth=64)
    return cluster.knn_sieve(queries, nodes, members, rows, 5, masks=cluster.annotate(members, 1))


@query(f"WITH {FP} SELECT 1::BIGINT AS node, bit_or(w0) AS w0, bit_or(w1) AS w1, count(*) AS card, count(*) AS below FROM fp")
def lod_index(spark, d):
    """The root's annotation, and the points below it."""
    _, members, _ = _tree(spark, d)
    masks = cluster.annotate(members, 1).where("node = 1")
    below = cluster.cluster_points(members, 1).agg(F.count(F.lit(1)).alias("below"))
    return masks.crossJoin(below).select("node", *halves(F.col("mask")), "card", "below")


@query(f"WITH {NEAR} SELECT qid, id, dist FROM near WHERE dist <= 14")
def compressed_search(spark, d):
    queries, _ = _fp_queries(spark, d)
    return cluster.compressed_search(queries, cluster.compressed_points(*_tree(spark, d)), 14)


@query(f"WITH {FP} SELECT vec_id AS id, k::BIGINT AS k, CASE WHEN k < 4 THEN (w0 >> (8 * k)) & 255 ELSE (w1 >> (8 * (k - 4))) & 255 END AS b FROM fp, (SELECT k::INT AS k FROM range(8) g(k))")
def decompressed_points(spark, d):
    out = cluster.decompressed(cluster.compressed_points(*_tree(spark, d)))
    return out.select("id", F.posexplode("b").alias("k", "b")).select("id", F.col("k").cast("bigint").alias("k"), F.col("b").cast("bigint").alias("b"))


# BF16 scans

PAIRED = BF + ", a AS (SELECT vec_id % 10 AS s, vec_id // 10 AS t, i, p FROM bf), l AS (SELECT a.s, tau, a.t, a.i, xor(a.p, l.p) AS pa, xor(b.p, l.p) AS pb FROM a JOIN a b ON b.s = a.s + 1 AND b.t = a.t AND b.i = a.i CROSS JOIN range(1, 4) g(tau) JOIN a l ON l.s = a.s + 1 AND l.t = a.t + tau AND l.i = a.i)"
TRAIN = "(CASE WHEN {p} & 32768 <> 0 THEN " + str(bf16.TRAINING.sign) + " ELSE 0 END + " + str(bf16.TRAINING.exponent) + " * bit_count({p} & 32640)::BIGINT + " + str(bf16.TRAINING.mantissa) + " * bit_count({p} & 127)::BIGINT)::BIGINT"


@query(
    f"WITH {PAIRED}, e AS (SELECT s, tau, t, sum({TRAIN.format(p='pa')}) - sum({TRAIN.format(p='pb')}) AS v FROM l GROUP BY ALL), sig AS (SELECT s, tau, avg(v) AS signal, count(*) AS timesteps FROM e GROUP BY s, tau), best AS (SELECT s, arg_min(tau, (signal, tau)) AS tau, arg_min(timesteps, (signal, tau)) AS timesteps, min(signal) AS signal FROM sig GROUP BY s), "
    "c AS (SELECT s, tau, i AS dim, count(*) FILTER (pa & 32768 <> 0) AS sign_flips, count(*) FILTER (bit_count(pa & 32640) >= 2) AS exponent_shifts FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s, tau ORDER BY sign_flips DESC, dim)::BIGINT AS rank FROM c WHERE sign_flips + exponent_shifts > 0) "
    "SELECT s, tau, dim, sign_flips, exponent_shifts, rank, round(signal, 4) + 0.0 AS signal, timesteps, round(sign_flips / timesteps, 6) + 0.0 AS flip_rate, sign_flips / timesteps > 0.5 AS causal FROM r JOIN best USING (s, tau)"
)
def bf16_granger_scan(spark, d):
    p = vectors(spark, d).select("vec_id", F.transform("v", bf16.from_float).alias("p"))
    out = cluster.kept(causal.bf16_granger_scan(_series(p, "p"), 3, "s"))
    causal_ = causal.dims_above(out, 0.5).select("s", "dim", F.lit(True).alias("causal"))
    out = out.join(causal_, ["s", "dim"], "left")
    cols = [F.col(c).cast("bigint").alias(c) for c in ("tau", "dim", "sign_flips", "exponent_shifts", "rank")]
    return out.select("s", *cols, (F.round("signal", 4) + 0.0).alias("signal"), "timesteps", r6(causal.sign_flip_rate(F.col("sign_flips"), F.col("timesteps")), "flip_rate"), F.coalesce("causal", F.lit(False)).alias("causal"))


def _hop(k: int) -> str:
    return f"d{k} AS (SELECT e.vec_id, sum({BFD.replace('p &', 'xor(xor(c.p, r.p), e.p) &')})::BIGINT AS dist FROM bf e JOIN role r USING (i) JOIN c{k} c USING (i) GROUP BY e.vec_id), h{k} AS (SELECT {k} AS depth, arg_min(vec_id, (dist, vec_id)) AS id, min(dist) AS dist FROM d{k}), c{k + 1} AS (SELECT i, p FROM bf JOIN h{k} ON id = vec_id)"


@query(f"WITH {BF}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings), role AS (SELECT i, p FROM bf JOIN n USING (vec_id) WHERE n = 2), c0 AS (SELECT i, p FROM bf JOIN n USING (vec_id) WHERE n = 1), {_hop(0)}, {_hop(1)}, t AS (SELECT *, round(dist / (391.0 * 64), 6) + 0.0 AS normalised FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1)), f AS (SELECT depth, count(*) FILTER (xor(xor(c.p, r.p), e.p) & 32768 <> 0) AS flips FROM (SELECT 0 AS depth, i, p FROM c0 UNION ALL SELECT 1, i, p FROM c1) c JOIN role r USING (i) JOIN t USING (depth) JOIN bf e ON e.vec_id = t.id AND e.i = c.i GROUP BY depth) SELECT depth, id, dist, normalised, TRUE AS confident, flips FROM t JOIN f USING (depth)")
def bf16_reverse_trace(spark, d):
    ent = vectors(spark, d).select(F.col("vec_id").alias("id"), F.transform("v", bf16.from_float).alias("s"))
    first = ent.orderBy("id").limit(2).collect()
    out = causal.bf16_reverse_trace(list(first[0]["s"]), list(first[1]["s"]), ent, 2, 1.1)
    return out.select("depth", "id", "dist", r6(F.col("normalised"), "normalised"), "confident", F.size("dims").cast("bigint").alias("flips"))

"""Registered queries for building, reading and combining arrays, words, records and symbol tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits, elementwise, symbols
from ..operators import cluster, hyper, layout, learn, ordered, reduce
from ..sources import tables
from ..sources.random import SplitMix64
from .catalog import CUBE, D, EMB, FP, Q8, _cube, asked, emb, following, halves, prints, query, r6, table, vectors

# Arrays


@query(f"WITH {EMB} SELECT vec_id, (i // 8)::BIGINT AS a0, (i % 8)::BIGINT AS a1, i, round(x, 6) + 0.0 AS x FROM emb")
def array_build(spark, d):
    """Each vector as an array of shape (8, 8), and its places counted back."""
    v = vectors(spark, d).select("vec_id", layout.checked_shape(F.col("v").cast("array<double>"), [8, 8]).alias("v"))
    axes = layout.with_axes(layout.to_long(v, "vec_id", "v"), [8, 8])
    back = layout.from_axes(axes.drop("i"), [8, 8])
    return back.select("vec_id", F.col("a0").cast("bigint").alias("a0"), F.col("a1").cast("bigint").alias("a1"), F.col("i").cast("bigint").alias("i"), r6(F.col("x"), "x"))


@query("SELECT r_regionkey, r_regionkey::DOUBLE AS x, length(r_name)::BIGINT AS n FROM region")
def array_item(spark, d):
    r = table(spark, d, "region")
    return r.select("r_regionkey", layout.item(F.array(F.col("r_regionkey").cast("double"))).alias("x"), F.size(F.split("r_name", "")).cast("bigint").alias("n"))


@query("SELECT 'zeros' AS kind, i, 0.0::DOUBLE AS x FROM range(6) g(i) UNION ALL SELECT 'ones', i, 1.0 FROM range(6) g(i) UNION ALL SELECT 'arange', i, round(-1 + 0.25 * i, 6) FROM range(13) g(i) UNION ALL SELECT 'linspace', i, round(2 + i * 5.0 / 9, 6) + 0.0 FROM range(10) g(i) UNION ALL SELECT 'strides', i, [12, 4, 1][i + 1]::DOUBLE FROM range(3) g(i)")
def array_fill(spark, d):
    stepped = spark.createDataFrame(list(enumerate(map(float, layout.strides([2, 3, 4])))), "i bigint, x double")
    parts = {"zeros": layout.zeros(spark, [2, 3]), "ones": layout.ones(spark, [3, 2]), "arange": layout.arange(spark, -1, 2.25, 0.25), "linspace": layout.linspace(spark, 2, 7, 10), "strides": stepped}
    out = None
    for kind, df in parts.items():
        own = df.select(F.lit(kind).alias("kind"), "i", r6(F.col("x"), "x"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {EMB} SELECT vec_id, i, CASE WHEN vec_id = 3 AND i = 5 THEN 9.5 ELSE round(x, 6) + 0.0 END AS x, vec_id = 3 AND i = 5 AS told FROM emb")
def array_get_set(spark, d):
    changed = layout.put(emb(spark, d).select("vec_id", "i", "x"), 9.5, vec_id=3, i=5)
    told = layout.get(changed, vec_id=3, i=5).select("vec_id", "i", F.lit(True).alias("told"))
    return changed.join(told, ["vec_id", "i"], "left").select("vec_id", "i", r6(F.col("x"), "x"), F.coalesce("told", F.lit(False)).alias("told"))


@query(f"WITH {EMB}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT vec_id AS a0, i AS a1, vec_id * 64 + i AS row_major, i * n + vec_id AS col_major, round(x, 6) + 0.0 AS x FROM emb, n")
def array_squeeze(spark, d):
    """The table as an array of shape (n, 1, 64), without its axis of one; places in both layouts."""
    e = emb(spark, d)
    n = e.agg(F.max("vec_id")).first()[0] + 1
    shape = layout.squeeze([n, 1, D])
    flat = e.select((F.col("vec_id") * D + F.col("i")).alias("i"), "x")
    a = layout.with_axes(flat, shape)
    place = lambda kind: layout.linear_index(F.col("a0"), F.col("a1"), layout.leading_dim(n, D, kind), kind)
    return a.select(F.col("a0").cast("bigint").alias("a0"), F.col("a1").cast("bigint").alias("a1"), place("row").cast("bigint").alias("row_major"), place("col").cast("bigint").alias("col_major"), r6(F.col("x"), "x"))


@query(f"WITH {EMB} SELECT a.vec_id, a.i, round(2 * a.x + b.x, 6) + 0.0 AS axpy, round(-3 * a.x, 6) + 0.0 AS scal, round(a.x + b.x, 6) + 0.0 AS sum, round(a.x * b.x, 6) + 0.0 AS product, CASE WHEN b.x <> 0 THEN round(a.x / b.x, 4) + 0.0 END AS quotient, round(a.x - 1.5, 6) + 0.0 AS shifted, round(b.x + CASE WHEN a.i % 4 = 0 AND a.i < 32 THEN 2 * c.x ELSE 0 END, 6) + 0.0 AS strided FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 AND b.i = a.i LEFT JOIN emb c ON c.vec_id = a.vec_id AND c.i = a.i // 4 * 2")
def vector_level1(spark, d):
    p = following(vectors(spark, d).select("vec_id", F.col("v").cast("array<double>").alias("v")), "v")
    a, b = F.col("a_v"), F.col("b_v")
    cols = {
        "axpy": elementwise.axpy(2.0, a, b), "scal": elementwise.scal(-3.0, a), "sum": elementwise.add(a, b, array=True), "product": elementwise.mul(a, b, array=True),
        "quotient": elementwise.div(a, b, array=True), "shifted": elementwise.sub(a, 1.5, array=True), "strided": elementwise.strided_axpy(2.0, a, 2, b, 4, 8),
    }
    each = p.select("vec_id", F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in cols.items()], b.alias("b"))).alias("i", "s"))
    out = [r6(F.col(f"s.{n}"), n) for n in cols if n != "quotient"] + [F.when(F.col("s.b") != 0, F.round("s.quotient", 4) + 0.0).alias("quotient")]
    return each.select("vec_id", F.col("i").cast("bigint").alias("i"), *out)


@query(f"WITH {EMB} SELECT vec_id, (i // 5)::BIGINT AS i, round(x, 6) + 0.0 AS x FROM emb WHERE i % 5 = 0 AND i < 50")
def vector_strided(spark, d):
    s = vectors(spark, d).select("vec_id", F.posexplode(elementwise.strided(F.col("v"), 5, 10)).alias("i", "x"))
    return s.select("vec_id", F.col("i").cast("bigint").alias("i"), r6(F.col("x").cast("double"), "x"))


@query("SELECT o_orderkey, floor(sqrt(o_custkey::DOUBLE))::BIGINT AS root, (o_custkey % 7)::DOUBLE AS real, (o_custkey % 2)::DOUBLE * 0 AS zero FROM orders")
def int_roots(spark, d):
    key = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", elementwise.int_sqrt(key, "bigint").alias("root"), elementwise.col(key % 7).cast("double").alias("real"), elementwise.mul((key % 2).cast("double"), 0.0).alias("zero"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sort_values(spark, d):
    return ordered.ranked(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice", (F.col("place") + 1).alias("place"))


@query("WITH o AS (SELECT list(o_totalprice ORDER BY o_totalprice) AS a FROM orders) SELECT " + ", ".join(f"round(a[least(len(a), len(a) * {p} // 100 + 1)], 6) + 0.0 AS p{p}" for p in (5, 50, 95)) + ", round(a[1], 6) + 0.0 AS min, round(a[len(a)], 6) + 0.0 AS max, round(list_avg(a), 4) + 0.0 AS mean FROM o")
def lower_percentiles(spark, d):
    out = reduce.lower_percentiles(table(spark, d, "orders"), "o_totalprice", (5, 50, 95))
    return out.select(*[r6(F.col(c), c) for c in ("p5", "p50", "p95", "min", "max")], (F.round("mean", 4) + 0.0).alias("mean"))


@query("SELECT (o_orderkey % 7)::INT AS depth, round(sum((o_custkey % 11) / 4.0 * (o_custkey % 5 + 1)) / sum(o_custkey % 5 + 1), 6) + 0.0 AS lfd, sum(o_custkey % 5 + 1)::BIGINT AS points FROM orders GROUP BY o_orderkey % 7")
def lfd_by_depth(spark, d):
    nodes = table(spark, d, "orders").select((F.col("o_orderkey") % 7).cast("int").alias("depth"), ((F.col("o_custkey") % 11) / 4).alias("lfd"), (F.col("o_custkey") % 5 + 1).alias("card"))
    return cluster.lfd_by_depth(nodes).select("depth", r6(F.col("lfd"), "lfd"), "points")


@query("SELECT o_orderkey, (o_custkey % 50 + o_orderkey % 20)::BIGINT AS plus, greatest(0, o_custkey % 50 - o_orderkey % 20)::BIGINT AS minus FROM orders")
def delta_bounds(spark, d):
    far, radius = F.col("o_custkey") % 50, F.col("o_orderkey") % 20
    return table(spark, d, "orders").select("o_orderkey", cluster.delta_plus(far, radius).alias("plus"), cluster.delta_minus(far, radius).alias("minus"))


# Words, records, names


@query(f"WITH {FP} SELECT vec_id, w0, w1, 64::BIGINT AS full_pop, 0::BIGINT AS empty_pop, (w0 = 0 AND w1 = 0) AS is_zero, (w0 & 1)::INT AS first_bit, 8::BIGINT AS n_bytes FROM fp")
def fp_construct(spark, d):
    """A fingerprint by way of its bytes, beside constant ones."""
    p = prints(spark, d).select("vec_id", bits.to_bytes(F.col("w")).alias("raw"))
    p = p.select("vec_id", "raw", bits.from_bytes(F.col("raw"), 1).alias("w"))
    return p.select("vec_id", *halves(), bits.popcount(bits.ones(64)).alias("full_pop"), bits.popcount(bits.zeros(64)).alias("empty_pop"), bits.is_zero(F.col("w")).alias("is_zero"), bits.bit(F.col("w"), F.lit(0)).cast("int").alias("first_bit"), F.octet_length("raw").cast("bigint").alias("n_bytes"))


@query(f"WITH {FP} SELECT vec_id, xor(w0, 4294967295) AS w0, xor(w1, 4294967295) AS w1, (bit_count(w0) + bit_count(w1))::BIGINT AS meta, 0::BIGINT AS empty, 32::BIGINT AS n_bytes FROM fp")
def record_4ch(spark, d):
    """Records of four channels, written as bytes and read again: the cam channel, and popcounts."""
    w = F.col("w")
    p = prints(spark, d).select("vec_id", tables.record(w, bits.invert(w), bits.xor(w, w), w, words=1).alias("rec"))
    raw = p.select("vec_id", tables.record_to_bytes(F.col("rec")).alias("raw"))
    back = raw.select("vec_id", tables.record_from_bytes(F.col("raw"), 1).alias("rec"), F.octet_length("raw").cast("bigint").alias("n_bytes"))
    return back.select("vec_id", *halves(F.get("rec.cam", 0)), bits.popcount(F.col("rec.meta")).alias("meta"), bits.popcount(F.col("rec.btree")).alias("empty"), "n_bytes")


@query("SELECT r_name, n FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) JOIN region ON r_regionkey = n_regionkey")
def board_views(spark, d):
    """Named tables, one of them replaced and one freed."""
    board = tables.Board(spark)
    board.put("board_region", table(spark, d, "nation"))
    board.put("board_region", table(spark, d, "region"))
    board.put("board_nation", table(spark, d, "nation"))
    out = spark.sql("SELECT r_name, n FROM (SELECT n_regionkey, count(*) AS n FROM board_nation GROUP BY n_regionkey) JOIN board_region ON r_regionkey = n_regionkey")
    if board.names() != ["board_nation", "board_region"] or not board.free("board_nation") or board.get("board_nation") is not None:
        raise RuntimeError("the board lost a name")
    board.free("board_region")
    return out


@query("WITH s AS (SELECT i, ((42::UHUGEINT + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM range(1000) g(i)), a AS (SELECT i, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM s), b AS (SELECT i, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a), c AS (SELECT i, xor(z, z >> 31) AS z FROM b) SELECT i, (z >> 32)::BIGINT AS high, (z & 4294967295)::BIGINT AS low, (-2 + (z % 5)::BIGINT)::BIGINT AS symbol FROM c")
def splitmix_sequence(spark, d):
    one, all_ = SplitMix64(42), SplitMix64(42).array(1000).tolist()
    drawn = SplitMix64(42)
    rows = [(i, x >> 32, x & 0xFFFFFFFF, drawn.gen_range_i8(-2, 2)) for i, x in enumerate(all_) if one.next_u64() == x]
    return spark.createDataFrame(rows, "i bigint, high bigint, low bigint, symbol bigint")


BASES = [symbols.BINARY, symbols.Base("unsigned", 5), symbols.Base("signed", 5), symbols.Base("signed", 7)]


@query("SELECT * FROM (VALUES ('Binary', 2, 0, 1, FALSE, 2048, 256), ('Unsigned(5)', 5, 0, 4, FALSE, 6144, 768), ('Signed(5)', 5, -2, 2, TRUE, 6144, 768), ('Signed(7)', 7, -3, 3, TRUE, 6144, 768)) t(name, cardinality, low, high, cancels, bits, bytes)")
def base_table(spark, d):
    rows = [(b.name, b.cardinality, b.low, b.high, b.has_cancellation, b.storage_bits(2048), b.storage_bytes(2048)) for b in BASES]
    return spark.createDataFrame(rows, "name string, cardinality int, low int, high int, cancels boolean, bits int, bytes int")


@query("SELECT n AS name, 2048::BIGINT AS places, 0::BIGINT AS outside, c::BIGINT AS symbols FROM (VALUES ('Binary', 2), ('Unsigned(5)', 5), ('Signed(5)', 5), ('Signed(7)', 7)) t(n, c)")
def templates(spark, d):
    """Random templates of each base: places, places outside its range, symbols that occur."""
    import numpy as np

    rows = [(b.name, b.low, b.high, b.template(2048, np.random.default_rng(42))) for b in BASES]
    t = spark.createDataFrame(rows, "name string, low int, high int, s array<int>")
    return t.select("name", F.size("s").cast("bigint").alias("places"), F.size(F.filter("s", lambda x: (x < F.col("low")) | (x > F.col("high")))).cast("bigint").alias("outside"), F.size(F.array_distinct("s")).cast("bigint").alias("symbols"))


@query("SELECT * FROM (VALUES ('BECOMES', 1), ('CAUSES', 2), ('SUPPORTS', 3), ('CONTRADICTS', 4), ('REFINES', 5), ('GROUNDS', 6), ('ABSTRACTS', 7)) t(verb, \"offset\")")
def codebook(spark, d):
    return hyper.codebook(spark)


TURN = "(((w0 << {k}::INT) & 4294967295) | (w1 >> {r}::INT)) AS w0, (((w1 << {k}::INT) & 4294967295) | (w0 >> {r}::INT)) AS w1"


@query(f"WITH {FP}, one AS (SELECT vec_id, {TURN.format(k=1, r=31)} FROM fp), two AS (SELECT vec_id, {TURN.format(k=2, r=30)} FROM fp) SELECT s.vec_id, xor(xor(s.w0, v.w0), t.w0) AS w0, xor(xor(s.w1, v.w1), t.w1) AS w1, 0::BIGINT AS decode_errors FROM fp s JOIN one v ON v.vec_id = s.vec_id + 1 JOIN two t ON t.vec_id = s.vec_id + 2")
def edge_explicit(spark, d):
    p = prints(spark, d).select("vec_id", "w")
    src, verb, tgt = (p.select((F.col("vec_id") - k).alias("vec_id"), F.col("w").alias(n)) for k, n in enumerate(("src", "verb", "tgt")))
    edge = hyper.encode_edge_explicit(F.col("src"), F.col("verb"), F.col("tgt"), 1)
    wrong = bits.hamming(hyper.decode_target_explicit(edge, F.col("src"), F.col("verb"), 1), F.col("tgt"))
    return src.join(verb, "vec_id").join(tgt, "vec_id").select("vec_id", *halves(F.get(edge, 0)), wrong.alias("decode_errors"))


@query(f"WITH {Q8}, z AS (SELECT n, ((42::UHUGEINT + (n + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM range(4096) g(n)), a AS (SELECT n, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM z), c AS (SELECT n, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a), h AS (SELECT n // 64 AS b, n % 64 AS i, CASE WHEN xor(z, z >> 31) >> 63 = 1 THEN 1 ELSE -1 END AS h FROM c), s AS (SELECT vec_id, b, sum(q * h) >= 0 AS f FROM q8 JOIN h USING (i) GROUP BY vec_id, b), p AS (SELECT vec_id, (b // 8) * 8 + 7 - b % 8 AS b, f FROM s) SELECT vec_id, sum(CASE WHEN f AND b < 32 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS w0, sum(CASE WHEN f AND b >= 32 THEN 1::BIGINT << (b - 32) ELSE 0 END)::BIGINT AS w1 FROM p GROUP BY vec_id")
def simhash_int8(spark, d):
    from ..functions import quant

    q = vectors(spark, d).select("vec_id", F.transform(quant.i8(F.col("v"))["q"], lambda x: x.cast("double")).alias("v"))
    return hyper.simhash_int8(q, "vec_id", "v", D, 42).select("vec_id", *halves())


@query(f"WITH {CUBE} SELECT i, j, pop FROM cube WHERE k = 3")
def cross_section(spark, d):
    return hyper.cross_section(_cube(spark, d), 3).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "pop")


# Learning

CHANNEL = "least(7, floor((i * 0.618033988749895::DOUBLE - floor(i * 0.618033988749895::DOUBLE)) * 8))::INT"
HELD = EMB + f", con AS (SELECT vec_id, i, round(100 * x) AS c, {CHANNEL} AS ch FROM emb WHERE vec_id % 20 = 0), tem AS (SELECT label::BIGINT AS concept, i, sum(CASE WHEN x >= 0 THEN 1 ELSE -1 END)::DOUBLE AS t FROM emb GROUP BY label, i)"


def _held(spark, d) -> tuple[DataFrame, DataFrame]:
    """Containers from every twentieth vector, templates from each label's signs."""
    con = asked(emb(spark, d)).select(F.col("vec_id").alias("id"), F.col("i").alias("j"), F.round(100 * F.col("x")).alias("c"))
    tem = emb(spark, d).groupBy(F.col("label").cast("bigint").alias("concept"), F.col("i").alias("j")).agg(F.sum(F.when(F.col("x") >= 0, 1).otherwise(-1)).cast("double").alias("t"))
    return con, tem


@query(f"WITH {HELD}, s AS (SELECT vec_id, concept, sum(c * t) AS dot, sum(c * c) AS e, sum(t * t) AS te FROM con JOIN tem USING (i) WHERE ch = concept % 8 GROUP BY ALL) SELECT vec_id AS id, concept, round(dot / greatest(sqrt(e) * sqrt(te), 1e-10), 6) + 0.0 AS similarity, round(dot / greatest(te, 1e-10), 6) + 0.0 AS amplitude FROM s")
def wal_read_all(spark, d):
    con, tem = _held(spark, d)
    return learn.read_all(con, tem, 8).select("id", "concept", r6(F.col("similarity"), "similarity"), r6(F.col("amplitude"), "amplitude"))


@query(f"WITH {HELD} SELECT vec_id AS id, i AS j, round(c - coalesce((SELECT sum((concept + 1) * 0.5 * t) FROM tem WHERE tem.i = con.i AND concept % 8 = ch), 0), 6) + 0.0 AS rest FROM con")
def wal_residual(spark, d):
    con, tem = _held(spark, d)
    k = con.select("id").distinct().crossJoin(tem.select("concept").distinct()).withColumn("k", (F.col("concept") + 1) * F.lit(0.5))
    return learn.residual(con, tem, k, 8).select("id", "j", r6(F.col("rest"), "rest"))


@query(f"SELECT g.c::INT AS channel, j, {CHANNEL.replace('(i ', '(j ').replace('floor(i ', 'floor(j ')} = g.c AS own FROM range(8) g(c), range(256) p(j)")
def channel_masks(spark, d):
    each = learn.channel_masks(spark, 256, 8).select("channel", F.posexplode("mask").alias("j", "own"))
    return each.select("channel", F.col("j").cast("bigint").alias("j"), "own")


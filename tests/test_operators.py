import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.functions import symbols
from arrayloom.operators import causal, cluster, hyper, layout, learn, linalg, ordered, reduce, search
from arrayloom.sources.random import SplitMix64
from arrayloom.sources.tables import Board, record_from_bytes, record_to_bytes


def coords(spark, m, names="i k"):
    i, k = names.split()
    return spark.createDataFrame([(int(a), int(b), float(x)) for (a, b), x in np.ndenumerate(np.asarray(m, float))], f"{i} bigint, {k} bigint, x double")


def matrix(df, shape, i="i", k="k"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[i], r[k]] = r["x"]
    return out


def test_constructors_and_shapes(spark):
    assert [r.x for r in layout.arange(spark, 5, 0, -2).orderBy("i").collect()] == [5, 3, 1]
    assert [r.x for r in layout.linspace(spark, 0, 1, 5).orderBy("i").collect()] == [0, 0.25, 0.5, 0.75, 1]
    assert layout.zeros(spark, []).count() == 1 and layout.linspace(spark, 3, 9, 0).count() == 0
    a = layout.with_axes(layout.arange(spark, 0, 6, 1), [2, 3])
    b = layout.reshape(a, [2, 3], [3, 2])
    assert [(r.a0, r.a1) for r in b.orderBy("i").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert layout.get(a, a0=1, a1=2).first().x == 5 and layout.squeeze([1, 3, 1]) == [3] and layout.strides([2, 3, 4]) == [12, 4, 1]
    assert layout.get(layout.put(a, 9.0, a0=0, a1=0), a0=0, a1=0).first().x == 9
    wide = layout.to_wide(layout.slice_axis(layout.flip(a, "a1", 3), "a1", 0, 2), "a0", "a1")
    assert {r.a0: r.v for r in wide.collect()} == {0: [2, 1], 1: [5, 4]}


def test_reductions(spark):
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5])] + [(1, 0, 7.0), (1, 1, 7.0)], "g int, i int, x double")
    assert reduce.var(df.where("g = 0")).first()[0] == 2 and reduce.std(df.where("g = 0")).first()[0] == pytest.approx(2**0.5)
    assert reduce.median(df, "g").orderBy("g").collect()[0][1] == 3 and reduce.percentile(df.where("g = 0"), 25).first()[0] == 2
    assert tuple(reduce.arg_extremes(df, "g").orderBy("g").collect()[1])[1:] == (0, 0)
    assert reduce.norm(df.where("g = 1"), 1).first()[0] == 14 and reduce.var(df.where("g = 9")).first()[0] == 0
    assert [r[0] for r in spark.createDataFrame([(100, 25), (100, 100), (100, 0)], "a int, b int").select(reduce.lfd(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]
    assert tuple(reduce.lower_percentiles(df, "x", [0, 50]).first())[:2] == (1, 4)


def test_order(spark):
    df = spark.createDataFrame([(i * 7, float(i)) for i in range(50)], "k bigint, x double")
    got = [r.cumsum for r in ordered.cumsum_all(df, "x", "k", ranges=6).orderBy("k").collect()]
    assert got == np.cumsum(np.arange(50.0)).tolist()
    assert [r.k for r in ordered.top_k(df, "x", 2, "k").collect()] == [343, 336]
    assert ordered.cumsum_all(df.limit(0), "x", "k").count() == 0


def test_bundle_and_edges(spark):
    rows = spark.createDataFrame([(0, [0b10101010]), (0, [0b11001100]), (0, [0b11110000]), (1, [1]), (1, [2])], "g int, w array<bigint>")
    assert {r.g: r.w for r in hyper.bundle(rows, "g", "w", 1).collect()} == {0: [0b11101000], 1: [0]}
    rng = np.random.default_rng(0)
    a, b, v = ([int(x) for x in rng.integers(-(2**62), 2**62, 2)] for _ in range(3))
    df = spark.createDataFrame([(a, b, v)], "a array<bigint>, b array<bigint>, v array<bigint>")
    e, x = hyper.encode_edge(F.col("a"), F.col("b"), 5, 2), hyper.encode_edge_explicit(F.col("a"), F.col("v"), F.col("b"), 2)
    assert tuple(df.select(hyper.decode_target(e, F.col("a"), 5, 2), hyper.decode_target_explicit(x, F.col("a"), F.col("v"), 2)).first()) == (b, b)
    edges = df.select(F.lit(1).alias("eid"), e.alias("edge"), F.col("a").alias("src"))
    cand = df.select(F.lit(3).alias("cid"), F.col("b").alias("c"))
    assert tuple(hyper.infer_verb(edges, cand, 2).first()) == (1, "REFINES", 3, 0)


def test_search_agrees_with_scan(spark):
    rng = np.random.default_rng(2)
    w = [int(x) for x in rng.integers(0, 2**20, 60)]
    rows = spark.createDataFrame([(i, [x]) for i, x in enumerate(w)], "id bigint, w array<bigint>")
    queries = rows.where("id < 3").toDF("qid", "qw")
    near = {(q, i): (w[q] ^ w[i]).bit_count() for q in range(3) for i in range(60)}
    assert {(r.qid, r.id): r.dist for r in search.hamming_within(queries, rows, 8).collect()} == {k: d for k, d in near.items() if d <= 8}
    top = [(r.qid, r.id) for r in search.hamming_top_k(queries, rows, 5).orderBy("qid", "rank").collect()]
    assert top == [(q, i) for q in range(3) for _, i in sorted((near[q, i], i) for i in range(60))[:5]]
    small = search.pair_queries(queries, rows, most=1)
    assert small.count() == 180
    nodes, members = cluster.build_tree(rows, min_cardinality=5, max_depth=5)
    assert members.select("id").distinct().count() == 60 == members.count()
    got = {(r.qid, r.id): r.dist for r in cluster.rho_neighbours(queries, nodes, members, rows, 8).collect()}
    assert got == {k: d for k, d in near.items() if d <= 8}
    done = {r.node: r for r in cluster.compress(nodes, members, rows).collect()}
    assert done[1].best <= done[1].unitary and len(done) == nodes.count()
    assert cluster.cluster_points(members, 1).count() == 60 == sum(cluster.cluster_points(members, k).count() for k in (2, 3))
    masks = cluster.annotate(members, 1)
    assert masks.where("node = 1").first().mask == int(np.bitwise_or.reduce(w))


def test_hashes_of_bigints_are_sparks(spark):
    x = [0, 1, -1, 2**62, -(2**63), 987654321]
    df = spark.createDataFrame([(a, b) for a in x for b in x], "a bigint, b bigint")
    want = [r[0] for r in df.select(F.xxhash64("a", "b")).collect()]
    both = np.array([(a, b) for a in x for b in x], np.int64)
    assert cluster.hash_longs(both[:, 0], both[:, 1]).tolist() == want


def test_trees_of_both_ways_are_equal_and_searches_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**62), 2**62, (4, 2))
    w = [[int(x) for x in base[i % 4] ^ (1 << rng.integers(0, 62, 2))] for i in range(90)] + [[5, 5]] * 12
    rows = spark.createDataFrame(list(enumerate(w)), "id bigint, w array<bigint>")
    built = {}
    for local in (40, 4096):
        monkeypatch.setattr(cluster, "LOCAL", local)
        nodes, members = cluster.build_tree(rows, min_cardinality=8)
        built[local] = (sorted(map(tuple, nodes.collect())), sorted((r.node, r.id, r.to_center, tuple(r.path)) for r in members.collect()))
    assert built[4096] == built[40] and len(built[40][1]) == 102
    queries = rows.where("id % 17 = 0").toDF("qid", "qw")
    dist = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))
    want = sorted((q, i, d, k + 1) for q in range(0, 102, 17) for k, (d, i) in enumerate(sorted((dist(w[q], w[i]), i) for i in range(102))[:7]))
    masks = cluster.annotate(members, 2)
    for found in (cluster.knn_sieve(queries, nodes, members, rows, 7), cluster.knn_growing(queries, nodes, members, rows, 7), cluster.knn_sieve(queries, nodes, members, rows, 7, masks)):
        assert sorted((r.qid, r.id, r.dist, r.rank) for r in found.collect()) == want
    assert cluster.knn_growing(queries, nodes, members, rows, 500).count() == 6 * 102
    points = cluster.compressed_points(nodes, members, rows)
    near = {(q, i): dist(w[q], w[i]) for q in range(0, 102, 17) for i in range(102)}
    assert {(r.qid, r.id): r.dist for r in cluster.compressed_search(queries, points, 30).collect()} == {k: d for k, d in near.items() if d <= 30}
    empty, none = cluster.build_tree(rows.limit(0))
    assert empty.count() == none.count() == cluster.knn_growing(queries, empty, none, rows, 3).count() == 0


@pytest.mark.parametrize("most", [4_000_000, 8])
def test_blocks_of_products(spark, monkeypatch, most):
    monkeypatch.setattr(search, "NUMBERS_MOST", most)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9, 4))
    v[3] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(50, None)], "id bigint, v array<double>")
    got = {(r.qid, r.id): (r.dot, r.cosine) for r in search.dot_cosine(rows.where("id > 2").toDF("qid", "qv"), rows).collect()}
    norm = np.sqrt((v * v).sum(axis=1))
    assert len(got) == 54 and all(a == pytest.approx(v[q] @ v[i]) and b == pytest.approx(v[q] @ v[i] / norm[q] / norm[i] if q != 3 and i != 3 else 0) for (q, i), (a, b) in got.items())
    assert search.dot_cosine(rows.limit(0).toDF("qid", "qv"), rows).count() == 0
    by = linalg.gram(rows.withColumn("g", F.when(F.col("id") < 8, F.col("id") % 2)), "g").collect()
    for g, own in ((0, v[[0, 2, 4, 6]]), (1, v[[1, 3, 5, 7]]), (None, v[8:])):
        assert all(r.x == pytest.approx((own.T @ own)[r.i, r.j]) and r.n == len(own) for r in by if r.g == g) and sum(r.g == g for r in by) == 16
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="equal sizes"):
        search.dot_cosine(ragged.toDF("qid", "qv"), ragged)


def test_residuals_at_own_positions(spark):
    wal = learn.Wal(16, 3)
    for c in range(4):
        wal.register(c, np.arange(16) % 5 - 2 + c)
    container = np.arange(16, dtype=float) - 8
    rest, energy = wal.residual(container, np.array([2.0, 0.0, 0.0, 1.0]))
    own = set(wal.positions[0].tolist())
    want = [x - (2 * (j % 5 - 2) + (j % 5 + 1) if j in own else 0) for j, x in enumerate(container)]
    assert rest.tolist() == want and 0 < len(own) < 16 and energy == pytest.approx(np.mean(np.square(want)))
    con = spark.createDataFrame([(1, j, float(x)) for j, x in enumerate(container)], "id bigint, j bigint, c double")
    tem = spark.createDataFrame([(c, j, float(j % 5 - 2 + c)) for c in range(4) for j in range(16)], "concept bigint, j bigint, t double")
    k = spark.createDataFrame([(1, c, v) for c, v in enumerate([2.0, 0.0, 0.0, 1.0])], "id bigint, concept bigint, k double")
    assert [r.rest for r in learn.residual(con, tem, k, 3).orderBy("j").collect()] == want
    told = {r.concept: (r.similarity, r.amplitude) for r in learn.read_all(con, tem, 3).collect()}
    assert all(told[c] == pytest.approx((s, a)) for c, s, a in wal.read_all(container))
    wal.update(1, np.ones(16))
    assert wal.templates[1].sum() == 16
    masks = {r.channel: [j for j, own in enumerate(r["mask"]) if own] for r in learn.channel_masks(spark, 16, 3).collect()}
    assert all(masks[c] == wal.positions[c].tolist() for c in range(3))


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)] + [(200, None)], "k bigint, x double").repartition(3)
    got = [r.k for r in ordered.ranked(df, "x", "k").orderBy("place").collect()]
    assert got == [200, *sorted(range(100), key=lambda i: (i % 7, i))]
    skewed = spark.createDataFrame([(10**15 * (i % 2) + i, 1) for i in range(60)], "k bigint, x int")
    assert [r.cumsum for r in ordered.cumsum_all(skewed, "x", "k").orderBy("k").collect()] == list(range(1, 61))


def test_cluster_tree_is_whole(spark, monkeypatch):
    assert inspect.signature(cluster.build_tree).parameters["max_depth"].default is None
    # vector i has i + 1 bits of its own: a split parts one point from all others, and the tree is as deep as there are points
    rows = spark.createDataFrame([(i, [((1 << (i + 1)) - 1) << (i * (i + 1) // 2)]) for i in range(6)], "id bigint, w array<bigint>")
    monkeypatch.setattr(cluster, "HEAP", 2, raising=False)
    nodes, members = cluster.build_tree(rows, min_cardinality=1)
    got = nodes.collect()
    assert all(r.card == 1 for r in got if r.leaf) and max(r.depth for r in got) == 5 and members.count() == 6
    place = {r.node: (r.depth, r.card) for r in got}
    assert len(place) == len(got) == 11 and min(place) < 0
    assert all(place[r.parent][0] == r.depth - 1 and place[r.parent][1] > r.card for r in got if r.depth)
    # the smallest ids lie apart: a centre among them would be far from most points
    rows = spark.createDataFrame([(i, [(1 << 40) - 1 if i < 8 else 1 << (i % 5)]) for i in range(100)], "id bigint, w array<bigint>")
    root = cluster.build_tree(rows, min_cardinality=100)[0].first()
    assert root.center >= 8 and cluster.seeds_of(rows.withColumn("node", F.lit(1))).count() == 10


def test_similar_pairs_both_ways(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (6, 32))
    vecs = [base[i % 6] ^ (rng.random(32) < 0.05) for i in range(40)]
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(vecs)], "id bigint, s array<int>")
    for radius in (0.1, 0.5):
        want = {(a, b, int((vecs[a] != vecs[b]).sum())) for a in range(40) for b in range(a + 1, 40) if (vecs[a] != vecs[b]).mean() < radius}
        assert {tuple(r) for r in search.similar_pairs(df, radius, 32).collect()} == want


def test_linear_algebra(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(3, 5))
    assert matrix(linalg.matmul(coords(spark, a), coords(spark, b, "k j")), (4, 5), "i", "j") == pytest.approx(a @ b)
    c = rng.normal(size=(4, 5))
    assert matrix(linalg.gemm(coords(spark, a), coords(spark, b, "k j"), coords(spark, c, "i j"), alpha=2, beta=3), (4, 5), "i", "j") == pytest.approx(2 * a @ b + 3 * c)
    assert matrix(linalg.syrk(coords(spark, a)), (4, 4), "i", "j") == pytest.approx(np.tril(a @ a.T))
    s = np.triu(rng.normal(size=(3, 3)))
    full = s + np.triu(s, 1).T
    assert matrix(linalg.symm(coords(spark, s), coords(spark, b, "k j")), (3, 5), "i", "j") == pytest.approx(full @ b)
    assert matrix(linalg.symm(coords(spark, s), coords(spark, a), left=False), (4, 3), "i", "j") == pytest.approx(a @ full)
    t = np.triu(rng.normal(size=(3, 3))) + 3 * np.eye(3)
    for trans in (False, True):
        x = matrix(linalg.trsm(coords(spark, t), 3, coords(spark, b, "k j"), trans=trans), (3, 5), "k", "j")
        assert (t.T if trans else t) @ x == pytest.approx(b)
    x = matrix(linalg.trsm(coords(spark, t), 3, coords(spark, a, "j k"), left=False), (4, 3), "j", "k")
    assert x @ t == pytest.approx(a)
    m = rng.normal(size=(4, 4))
    f, p, info = linalg.lu(m)
    assert info == 0 and m @ linalg.lu_solve(f, p, np.ones(4)) == pytest.approx(np.ones(4))
    spd = m @ m.T + np.eye(4)
    low, info = linalg.cholesky(spd)
    assert info == 0 and low @ low.T == pytest.approx(spd) and linalg.cholesky(-spd)[1] == 1
    r = np.triu(linalg.householder_qr(m)[0])
    assert r.T @ r == pytest.approx(m.T @ m)
    sys_a, sys_b = coords(spark, spd).withColumn("m", F.lit(7).cast("bigint")), spark.createDataFrame([(7, i, 1.0) for i in range(4)], "m bigint, i bigint, x double")
    for kind in ("lu", "cholesky"):
        got = [r.x for r in linalg.solve_systems(sys_a, sys_b, 4, kind).orderBy("i").collect()]
        assert spd @ got == pytest.approx(np.ones(4))
    q = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)], "i int, k int, q int")
    q2 = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4), (2, 0, 5), (2, 1, 6)], "k int, j int, q int")
    assert [r.acc for r in linalg.int_matmul(q, q2).orderBy("i", "j").collect()] == [22, 28, 49, 64]


def test_fourier(spark):
    x = np.sin(np.arange(16.0))
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "s int, t bigint, re double")
    want = np.fft.fft(x)
    for f in (linalg.dft, linalg.fft):
        got = f(df, 16).orderBy("f").collect()
        assert [r.re for r in got] == pytest.approx(want.real.tolist()) and [r.im for r in got] == pytest.approx(want.imag.tolist(), abs=1e-9)
        back = f(spark.createDataFrame([(0, r.f, r.re, r.im) for r in got], "s int, t bigint, re double, im double"), 16, inverse=True).orderBy("f").collect()
        assert [r.re for r in back] == pytest.approx(x.tolist())


def test_granger_finds_the_lag(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2, (30, 64))
    b = np.roll(a, 2, axis=0) ^ (rng.random((30, 64)) < 0.03)
    df = spark.createDataFrame([(t, a[t].tolist(), b[t].astype(int).tolist()) for t in range(30)], "t bigint, a array<int>, b array<int>")
    assert causal.granger_scan(df, 5).first().tau == 2
    ent = spark.createDataFrame([(i, a[i].tolist()) for i in range(10)], "id bigint, s array<int>")
    role = a[20].tolist()
    bound = (a[3] ^ a[20]).tolist()
    trace = causal.reverse_trace(bound, role, ent, symbols.BINARY, 3, 0.1).orderBy("depth").collect()
    assert trace[0].id == 3 and trace[0].confident and trace[0].dist == 0


def test_learning(spark):
    sizes = learn.xtrans(spark, 2048, 16).groupBy("channel").count().collect()
    assert sum(r["count"] for r in sizes) == 2048 and reduce.channel_gaps(learn.xtrans(spark, 2048, 16), 2048, 16).first().min_gap >= 2
    t = np.arange(256) % 5 - 2.0
    c = np.zeros(256)
    assert learn.organic_write(c, t, 1.0, np.arange(128)) > 0.95 and learn.organic_write(np.full(256, 127.0), t, 1.0, np.arange(128)) < 0.05
    wal = learn.Wal(64, 4)
    rng = np.random.default_rng(6)
    for i in range(3):
        wal.register(i, rng.integers(-2, 3, 64))
    c = np.zeros(64)
    for i in range(3):
        wal.write(c, i, 5.0, 0.1)
    assert wal.extract(c) == pytest.approx([5, 5, 5], abs=2.5)
    told = wal.flush(c, keep=2)
    assert told["rewritten"] == 2 and len(told["pruned"]) == 1
    plastic = learn.Plasticity(100)
    plastic.add()
    assert [plastic.record(0) for _ in range(7)] == [0.5, 0.5, 0.8, 0.8, 0.8, 1.0, 1.0]


def test_pyramid(spark):
    grid = spark.createDataFrame([(r, c, 0, 1 << (r * 3 + c)) for r in range(3) for c in range(3)], "r bigint, c bigint, word int, w bigint")
    top = cluster.pyramid(grid, 3, 3).where("level = 2").collect()
    assert len(top) == 1 and top[0].w == 511


def test_sources(spark):
    rng, other = SplitMix64(42), SplitMix64(42)
    assert [rng.next_u64() for _ in range(5)] == other.array(5).tolist() and rng.state == other.state
    assert 0 <= rng.next_f64() < 1 and -2 <= rng.gen_range_i8(-2, 2) <= 2
    raw = bytes(range(64))
    df = spark.range(1).select(record_from_bytes(F.lit(raw), 2).alias("r"))
    assert bytes(df.select(record_to_bytes(F.col("r"))).first()[0]) == raw
    board = Board(spark)
    board.put("numbers", spark.range(3))
    assert "numbers" in board and spark.sql("SELECT count(*) FROM numbers").first()[0] == 3 and board.free("numbers") and len(board) == 0
    planes = hyper.hyperplanes(4, 64, 42)
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "id bigint, v array<double>")
    w = hyper.simhash(v, "id", "v", 64, planes).first().w
    assert np.unpackbits(np.array(w).view(np.uint8)).astype(bool).tolist() == (planes[0] >= 0).tolist()


def _vectors_and_tree(spark, seed):
    rng = np.random.default_rng(seed)
    w = np.concatenate([rng.integers(-(2**62), 2**62, (60, 2)), np.repeat(rng.integers(-(2**62), 2**62, (1, 2)), 15, axis=0)])
    rows = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(w)], "id bigint, w array<bigint>")
    dist = np.bitwise_count((w[:, None] ^ w).view(np.uint64)).sum(axis=2)
    queries = rows.where("id % 5 = 0").toDF("qid", "qw")
    top = lambda k: sorted((q, i, int(dist[q, i]), r + 1) for q in range(0, 75, 5) for r, i in enumerate(np.lexsort((np.arange(75), dist[q]))[:k].tolist()))
    return rows, queries, top


def _no_pairs(*args, **kwargs):
    raise AssertionError("rows of queries and leaves or points are made")


def _found(df):
    return sorted((r.qid, r.id, r.dist, r.rank) for r in df.collect())


def test_growing_search_makes_no_pair_rows(spark, monkeypatch):
    rows, queries, top = _vectors_and_tree(spark, 21)
    monkeypatch.setattr(search, "pair_queries", _no_pairs)
    monkeypatch.setattr(search, "TILE", 40, raising=False)
    tree = (*cluster.build_tree(rows, min_cardinality=4), rows)
    assert _found(cluster.knn_growing(queries, *tree, 6)) == top(6)
    assert _found(cluster.knn_growing(queries, *tree, 200)) == top(200)


def test_sieves_make_no_pair_rows(spark, monkeypatch):
    rows, queries, top = _vectors_and_tree(spark, 22)
    monkeypatch.setattr(search, "pair_queries", _no_pairs)
    monkeypatch.setattr(search, "NUMBERS_MOST", 90)
    nodes, members = cluster.build_tree(rows, min_cardinality=4)
    masks = cluster.annotate(members, 2)
    assert _found(cluster.knn_sieve(queries, nodes, members, rows, 6)) == top(6)
    assert _found(cluster.knn_sieve(queries, nodes, members, rows, 6, masks)) == top(6)


def test_top_k_makes_no_pair_rows(spark, monkeypatch):
    rows, queries, top = _vectors_and_tree(spark, 23)
    monkeypatch.setattr(search, "pair_queries", _no_pairs)
    for tile, numbers in ((40, 90), (1 << 17, 4_000_000)):
        monkeypatch.setattr(search, "TILE", tile, raising=False)
        monkeypatch.setattr(search, "NUMBERS_MOST", numbers)
        assert _found(search.hamming_top_k(queries, rows, 4)) == top(4)


def test_compressed_search_makes_no_pair_rows(spark, monkeypatch):
    rows, queries, top = _vectors_and_tree(spark, 24)
    monkeypatch.setattr(search, "pair_queries", _no_pairs)
    monkeypatch.setattr(search, "TILE", 90, raising=False)
    nodes, members = cluster.build_tree(rows, min_cardinality=4)
    for rho in (0, 55, 128):
        found = cluster.compressed_search(queries, cluster.compressed_points(nodes, members, rows), rho)
        assert sorted((r.qid, r.id, r.dist) for r in found.collect()) == sorted(t[:3] for t in top(75) if t[2] <= rho)


def test_mask_bounds_make_no_pair_rows(spark, monkeypatch):
    from arrayloom.plans import catalog

    monkeypatch.setattr(search, "pair_queries", _no_pairs)
    v = np.random.default_rng(25).normal(size=(43, 64))
    table = spark.createDataFrame([(i, 0, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, label int, v array<double>")
    monkeypatch.setattr(catalog, "vectors", lambda spark, d: table)
    masks = np.array([(v[g : g + 4] >= 0).any(axis=0) for g in range(0, 43, 4)])
    want = []
    for q in (0, 20, 40):
        bound = ((v[q] >= 0) & ~masks).sum(axis=1)
        want += [(q, g, int(bound[g]), r + 1) for r, g in enumerate(np.lexsort((np.arange(len(masks)), bound))[:10].tolist())]
    assert sorted(map(tuple, catalog.or_mask_bound(spark, "").collect())) == sorted(want)


def test_adaptive_within_agrees_with_its_column(spark, monkeypatch):
    rng = np.random.default_rng(26)
    base = rng.random((5, 1024)) < 0.5
    flags = [base[i % 5] ^ (rng.random(1024) < (0.05 + 0.3 * rng.random())) ^ (np.arange(1024) < rng.integers(0, 90)) for i in range(60)]
    w = [np.packbits(f, bitorder="little").view(np.int64).tolist() for f in flags]
    rows = spark.createDataFrame(list(enumerate(w)), "id bigint, w array<bigint>")
    queries = rows.where("id % 4 = 0").toDF("qid", "qw")
    both = search.pair_queries(queries, rows)
    exact, staged = (search.hamming_adaptive(F.col("qw"), F.col("w"), 16, 300, faithful=f) for f in (False, True))
    want = sorted(map(tuple, both.select("qid", "id", exact.alias("d"), staged.alias("s")).where("d IS NOT NULL").collect()), key=str)
    assert 0 < sum(r[3] is None for r in want) < len(want)
    monkeypatch.setattr(search, "pair_queries", _no_pairs)
    monkeypatch.setattr(search, "TILE", 90)
    assert sorted(map(tuple, search.adaptive_within(queries, rows, 16, 300).collect()), key=str) == want


def test_storing_costs_agree_with_their_definition(spark, monkeypatch):
    rng = np.random.default_rng(27)
    w = rng.integers(-(2**62), 2**62, (90, 2))
    w[10:] = w[rng.integers(0, 10, 80)] ^ (1 << rng.integers(0, 62, (80, 2)))
    rows = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(w)], "id bigint, w array<bigint>")
    nodes, members = cluster.build_tree(rows, min_cardinality=4)
    tree, below = {r.node: r for r in nodes.collect()}, {}
    for r in members.collect():
        for n in r.path:
            below.setdefault(n, []).append(r.id)
    cost = lambda a, b: 3 * int(np.count_nonzero((w[a] ^ w[b]).view(np.uint8)))
    want = {}
    for n, r in sorted(tree.items(), key=lambda t: -t[1].depth):
        unitary = sum(cost(r.center, i) for i in below[n])
        kids = [c for c, k in tree.items() if k.parent == n]
        recursive = sum(cost(r.center, tree[c].center) + want[c][3] for c in kids) if kids else unitary
        want[n] = (r.depth, unitary, recursive, min(unitary, recursive), "recursive" if recursive < unitary else "unitary")
    jobs = {}
    for local in (4096, 30, 1):
        monkeypatch.setattr(cluster, "LOCAL", local)
        kept, calls = cluster.kept, []
        monkeypatch.setattr(cluster, "kept", lambda df: calls.append(1) or kept(df))
        assert {r[0]: tuple(r[1:]) for r in cluster.compress(nodes, members, rows).collect()} == want
        monkeypatch.setattr(cluster, "kept", kept)
        jobs[local] = len(calls)
    assert jobs[4096] <= 3  # no step for each level of a subtree


def test_similar_pairs_of_a_common_slice_go_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(28)
    vecs = rng.integers(-2, 3, (70, 48))
    vecs[20:] = np.where(rng.random((50, 48)) < 0.04, rng.integers(-2, 3, (50, 48)), vecs[rng.integers(0, 3, 50)])
    vecs[:, :12] = 1
    df = spark.createDataFrame([(i * 3, [int(x) for x in v]) for i, v in enumerate(vecs)], "id bigint, s array<int>")
    want = sorted((a * 3, b * 3, int((vecs[a] != vecs[b]).sum())) for a in range(70) for b in range(a + 1, 70) if (vecs[a] != vecs[b]).sum() < 0.1 * 48)
    monkeypatch.setattr(symbols, "distance", _no_pairs)
    for most in (16_384, 9):
        monkeypatch.setattr(search, "SLICE_MOST", most, raising=False)
        assert len(want) > 20 and sorted(map(tuple, search.similar_pairs(df, 0.1, 48).collect())) == want


def test_write_sequences_stream_through_batches(spark):
    rng = np.random.default_rng(29)
    writes = [(int(u), i, int(rng.integers(3)), float(1 + rng.random())) for i, u in enumerate(rng.integers(0, 4, 120))] + [(None, 500, 1, 1.5)]
    df = spark.createDataFrame(writes, "u bigint, e bigint, concept int, amplitude double").repartition(3)
    templates = [[int(x) for x in rng.integers(-2, 3, 32)] for _ in range(3)]
    want, ends = {}, {}
    for u in (0, 1, 2, 3, None):
        wal, plastic, container = learn.Wal(32, 4), learn.Plasticity(9), np.zeros(32)
        for i, t in enumerate(templates):
            wal.register(i, t)
            plastic.add()
        for _, e, c, a in (w for w in writes if w[0] == u):
            want[u, e, c] = wal.write(container, c, a, 0.1, plastic)
        told = wal.flush(container, 2)
        ends[u] = (told["rewritten"], len(told["pruned"]), told["absorption"])
    how = {"key": "u", "order": "e", "d": 32, "channels": 4, "decay": 9}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        steps, flushed = learn.wal_sequence(df, templates, **how), learn.wal_sequence(df, templates, flush_keep=2, **how)
        assert "MapInArrow" in steps._jdf.queryExecution().toString()
        assert {(r.u, r.e, r.concept): r.absorbed for r in steps.collect()} == want
        assert {r.u: tuple(r)[1:] for r in flushed.collect()} == ends and flushed.count() == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_u8_ratios_of_odd_rows(spark, tmp_path):
    from arrayloom.plans import catalog

    rows = [(1, 1, 3.7, 0.0, -0.05), (2, 1, 2.5, 0.0, 0.0), (3, 1, 1.0, None, 0.0), (4, 1, 1.0, None, None), (5, 1, None, None, 0.05), (6, 1, 1.0, 0.0, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.l_orderkey: (r.u, r.ratio) for r in catalog.u8_wrap_arith(spark, str(tmp_path)).collect()}
    assert found == {1: (92, float("inf")), 2: (18, None), 5: (None, None)}

"""Distributed building blocks against brute force / numpy."""
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sieve.operators import models as md
from sieve.operators import neighbors as nb
from sieve.operators import resample as rs
from sieve.operators.prefix import exact_quantiles, hash_rank, prefix_sums, tie_buckets


def test_prefix_sums_match_window(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(v), int(i)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.random(500)))]
    df = spark.createDataFrame(rows, "g int, v double, id int").withColumn("one", F.lit(1).cast("long"))
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("id", F.coalesce(F.sum("one").over(w), F.lit(0)).alias("cum_one"),
                     F.sum("one").over(Window.partitionBy("g")).alias("_total_one"))
    for limit in (0, 10_000):           # bucketed path, then the plain-window path
        got = prefix_sums(df, ["g"], F.col("v"), ["one"], tie_cols=["id"], n_buckets=7, totals=True,
                          small_group_rows=limit).select("id", "cum_one", "_total_one")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, limit


def _half_tied(spark, groups):
    """Half the rows share one score; some have none, some no id."""
    rng = np.random.default_rng(3)
    rows = [(i % groups, 0.5 if i % 2 else None if i % 100 == 0 else float(v), None if i % 501 == 1 else i) for i, v in enumerate(rng.random(4000))]
    return spark.createDataFrame(rows, "g int, v double, id long").withColumn("one", F.lit(1).cast("long"))


def test_tied_rows_are_split(spark):
    df = _half_tied(spark, 2)
    for g, mean in (([], 4000 / 20), (["g"], 2000 / 20)):
        for sign in (1, -1):
            parts = tie_buckets(df.withColumn("_key", sign * F.col("v")), g, "id", 20).groupBy(*g, "_bucket", "_tie").count().collect()
            assert max(r["count"] for r in parts) <= 2 * mean and len(parts) < 80 * (2 if g else 1), (g, sign)


def test_prefix_sums_of_tied_rows_match_window(spark):
    df = _half_tied(spark, 3)
    for g in ([], ["g"]):
        for key in (F.col("v"), -F.col("v")):
            w = Window.partitionBy(*g).orderBy(key, "id").rowsBetween(Window.unboundedPreceding, 0)
            want = df.filter("id is not null").withColumn("cum_one", F.sum("one").over(w))
            got = prefix_sums(df.filter("id is not null"), g, key, ["one"], tie_cols=["id"], inclusive=True, n_buckets=16, small_group_rows=0)
            got = got.select(want.columns)
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, g


def test_hash_rank_is_dense(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 3).cast("int"))
    ranks = []
    for limit in (0, 10_000):           # bucketed path, then the plain-window path
        r = hash_rank(df, ["g"], F.md5(F.col("id").cast("string")), "id", hex_digits=2, small_group_rows=limit)
        per = r.groupBy("g").agg(F.min("pos"), F.max("pos"), F.count("*"), F.countDistinct("pos")).collect()
        for x in per:
            assert x[1] == 1 and x[2] == x[3] == x[4]
        ranks.append({row["id"]: row["pos"] for row in r.collect()})
    assert ranks[0] == ranks[1]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.random(300), 3)
    g = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, vals)], "g int, v double")
    qs = [0.0, 0.025, 0.2, 0.5, 0.975, 1.0]
    # small_group_rows=0 forces the bucketed path; the default takes the one-pass aggregate
    for limit in (0, 10_000):
        got = {(r["g"], r["q_idx"]): r["value"]
               for r in exact_quantiles(df, ["g"], "v", qs, n_buckets=5, small_group_rows=limit).collect()}
        for gg in (0, 1):
            want = np.quantile(vals[g == gg], qs)
            for i, w in enumerate(want):
                assert abs(got[(gg, i)] - w) < 1e-12, (limit, gg, i)
    ungrouped = {r["q_idx"]: r["value"] for r in exact_quantiles(df, [], "v", qs, small_group_rows=0).collect()}
    assert all(abs(ungrouped[i] - w) < 1e-12 for i, w in enumerate(np.quantile(vals, qs)))


def test_bootstrap_exact_sums_to_n(spark):
    df = spark.range(200).withColumnRenamed("id", "record_id").withColumn("y", (F.col("record_id") % 2).cast("int"))
    b = rs.bootstrap(df, 50)
    tot = b.groupBy("replicate").agg(F.sum("draws").alias("s")).select("s").distinct().collect()
    assert [r[0] for r in tot] == [200]
    assert b.select("replicate").distinct().count() == 50


def test_poisson_weights_mean_one(spark):
    df = spark.range(2000).withColumnRenamed("id", "record_id")
    w = rs.bootstrap_poisson(df, 20)
    m = w.agg(F.sum("draws")).first()[0] / (2000 * 20)
    assert abs(m - 1.0) < 0.02


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(size=(40, 8))
    r = rng.normal(size=(150, 8))
    r[5] = 0.0                                    # zero vector -> cosine 0
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "record_id long, embedding array<double>")
    rd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "record_id long, embedding array<double>")
    got = nb.knn_topk(qd, rd, k=3, block_rows=16).orderBy("query_id", "rank").collect()
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    rn = np.where(np.linalg.norm(r, axis=1, keepdims=True) == 0, 0, r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300))
    s = qn @ rn.T
    for row in got:
        want = np.lexsort((np.arange(150), -s[row["query_id"]]))[:3]
        assert row["ref_id"] == want[row["rank"] - 1]
    rng_ = nb.similarity_range(qd, rd, block_rows=16).first()
    assert abs(rng_["cos_min"] - s.min()) < 1e-12 and abs(rng_["cos_max"] - s.max()) < 1e-12


def test_radius_pairs_match_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(-10, 10, size=(300, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "record_id long, x double, y double")
    got = {(r["i"], r["j"]) for r in nb.radius_pairs(df, 1.5).collect()}
    d = np.hypot(pts[:, None, 0] - pts[None, :, 0], pts[:, None, 1] - pts[None, :, 1])
    want = {(i, j) for i in range(300) for j in range(300) if i != j and d[i, j] < 1.5}
    assert got == want


def test_crowding_hot_cell_matches_brute_force(spark):
    """A third of the points share one grid cell; tiny blocks force the cell to
    be salted into many sub-blocks.  Counts equal the brute-force loop."""
    rng = np.random.default_rng(7)
    spread = rng.uniform(-10, 10, size=(200, 2))
    hot = rng.uniform(0.1, 1.4, size=(100, 2))              # all inside cell (0, 0) of side 1.5
    pts = np.vstack([spread, hot])
    n = len(pts)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                               "record_id long, x double, y double")
    got = {r["record_id"]: (r["n_near"], r["n_near_before"])
           for r in nb.crowding(df, 1.5, block_rows=7).collect()}
    dx = pts[:, None, 0] - pts[None, :, 0]
    dy = pts[:, None, 1] - pts[None, :, 1]
    near = (np.sqrt(dx * dx + dy * dy) < 1.5) & ~np.eye(n, dtype=bool)
    before = near & (np.arange(n)[None, :] < np.arange(n)[:, None])
    assert len(got) == n
    for i in range(n):
        assert got[i] == (int(near[i].sum()), int(before[i].sum())), i


def test_small_fit_matches_spark_ml(spark):
    """The grouped numpy pipeline and the Spark ML pipeline give the same scores."""
    rng = np.random.default_rng(5)
    n, d = 240, 12
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "record_id long, embedding array<double>, y int")
    c = 0.05
    m = md.fit_pipeline(df, params={"C": c, "penalty": "l2"})
    sp_ = {r["record_id"]: r["p"] for r in md.positive_score(m, df).collect()}
    u, b, k = md.linear_pipeline_fit(x, y.astype(float), np.ones(n), c)
    pn = 1 / (1 + np.exp(-(x @ u + b)))
    assert max(abs(pn[i] - sp_[i]) for i in range(n)) < 1e-4
    grouped = md.fit_linear_many(df.withColumn("key", F.lit(1)), ["key"], c=c).first()
    assert abs(grouped["b"] - b) < 1e-8 and np.allclose(grouped["u"], u, atol=1e-8)


def test_distributed_fits_match_small_fits(spark):
    """Above the per-model row bound each model is a distributed Spark ML fit,
    collapsed to (u, b); it agrees with the grouped numpy path, with and without
    draw-count weights and without the scaler / PCA stages."""
    rng = np.random.default_rng(8)
    n, d = 120, 6
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    draws = rng.integers(0, 3, n)
    rows = [(int(g), i, v.tolist(), int(t), int(w)) for g in (0, 1) for i, (v, t, w) in enumerate(zip(x, y, draws))]
    df = spark.createDataFrame(rows, "g int, record_id long, embedding array<double>, y int, draws int") \
        .filter((F.col("g") == 0) | (F.col("draws") > 0))
    for kw in ({}, {"weight": "draws"}, {"pipeline": False}):
        small = {r["g"]: r for r in md.fit_linear_many(df, ["g"], c=0.5, **kw).collect()}
        dist = {r["g"]: r for r in md.fit_linear_many(df, ["g"], c=0.5, small_rows=0, **kw).collect()}
        for g in (0, 1):
            a, b = small[g], dist[g]
            assert a["n"] == b["n"] and a["k"] == b["k"], kw
            pa = 1 / (1 + np.exp(-(x @ np.array(a["u"]) + a["b"])))
            pb = 1 / (1 + np.exp(-(x @ np.array(b["u"]) + b["b"])))
            assert np.max(np.abs(pa - pb)) < 1e-4, (kw, g, np.max(np.abs(pa - pb)))


def test_knn_cell_selection_equals_full_sort():
    """The per-cell top-k (partition, then sort only the candidates) equals a full
    sort by (cosine desc, reference id asc), with many exact ties and zero vectors."""
    import pandas as pd
    rng = np.random.default_rng(0)
    for trial in range(30):
        nq, nr, d = int(rng.integers(1, 30)), int(rng.integers(1, 40)), 4
        q = rng.integers(-2, 3, size=(nq, d)).astype(float)
        r = rng.integers(-2, 3, size=(nr, d)).astype(float)
        qdf = pd.DataFrame({"qid": np.arange(nq), "v": list(q)})
        rdf = pd.DataFrame({"rid": rng.permutation(nr) + 100, "v": list(r)})
        sm = np.round(nb._unit_rows(qdf["v"]) @ nb._unit_rows(rdf["v"]).T, 12)
        rids = rdf["rid"].to_numpy()
        for k in (1, 3, 50):
            got = nb._topk_cell(k, 12)(qdf, rdf)
            want = [(i, rids[j], sm[i, j]) for i in range(nq) for j in np.lexsort((rids, -sm[i]))[:min(k, nr)]]
            assert list(zip(got.query_id, got.ref_id, got.cosine)) == want, (trial, k)


def test_c_grid_fits_equal_one_fit_per_c(spark):
    """Fitting a C grid inside each group (rows shipped and projected once) gives
    the models of one fit per C, on the grouped and on the distributed path."""
    rng = np.random.default_rng(12)
    n, d = 100, 5
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame([(int(i % 2), i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "g int, record_id long, embedding array<double>, y int")
    grid = [(3, 0.01), (7, 1.0)]
    for small_rows in (md.SMALL_FIT_MAX_ROWS, 0):
        got = {(r["g"], r["grid_pos"]): r for r in
               md.fit_linear_many(df, ["g"], c_grid=grid, small_rows=small_rows).collect()}
        assert set(got) == {(g, pos) for g in (0, 1) for pos, _ in grid}
        for pos, cv in grid:
            one = {r["g"]: r for r in md.fit_linear_many(df, ["g"], c=cv).collect()}
            for g in (0, 1):
                a, b = got[(g, pos)], one[g]
                pa = 1 / (1 + np.exp(-(x @ np.array(a["u"]) + a["b"])))
                pb = 1 / (1 + np.exp(-(x @ np.array(b["u"]) + b["b"])))
                assert np.max(np.abs(pa - pb)) < 1e-4, (small_rows, pos, g)

"""The sample store, keyed permutations, widening histograms and image resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.functions import images
from stepweave.operators import joins, sampling, stats
from stepweave.operators import ordered as o
from stepweave.sources import store


def tables(spark, sizes, repeat=False):
    rows = [(e, s, [float(e), float(s)]) for e, n in enumerate(sizes) for s in range(n)]
    samples = [(i, *r) for i, r in enumerate(rows)]
    if repeat:
        samples[5] = (5, *rows[4])
    return (spark.createDataFrame(samples, "sample_id bigint, epis_idx int, step_idx int, state array<double>"),
            spark.createDataFrame(rows, "epis_idx int, step_idx int, feature array<double>"),
            spark.createDataFrame([(e, [e]) for e in range(len(sizes))], "epis_idx int, kept array<int>"))


def read(found):
    def rows(t):
        marked = t["samples"].withColumn("_indices", F.array(F.lit(0), F.greatest(F.col("step_idx") - 1, F.lit(0))))
        return joins.gather_history(marked, t["features"], "_indices", ["feature"]).join(t["kept"], "epis_idx")
    return found.each(rows)


@pytest.mark.parametrize("split", [None, "40"])
def test_build_and_read(spark, tmp_path, split):
    if split:
        spark.conf.set(o.SPLIT_ROWS, split)
    try:
        made = store.build(f"{tmp_path}/s", *tables(spark, [10, 100, 3, 25, 60]), rows_per_bucket=30)
    finally:
        spark.conf.unset(o.SPLIT_ROWS)
    found = store.Store.open(spark, f"{tmp_path}/s")
    assert found.about["rows"] == {"samples": 198, "features": 198, "kept": 5} and found.n_samples() == 198
    assert found.about["hot"] == bool(split) and found.about["buckets"] == 7 and made.folder == found.folder
    if split:
        assert {r.epis_idx for r in found.table("samples", True).select("epis_idx").distinct().collect()} == {1, 4}
    got = sorted((r.sample_id, r.epis_idx, [list(h.feature) for h in r.history], r.kept) for r in read(found).collect())
    where = [(e, s) for e, n in enumerate([10, 100, 3, 25, 60]) for s in range(n)]
    assert got == [(i, e, [[e, 0.0], [e, max(s - 1, 0.0)]], [e]) for i, (e, s) in enumerate(where)]
    for i in (0, 9, 10, 109, 150, 197):
        assert [(r.sample_id, r.epis_idx, r.step_idx) for r in found.sample(i).collect()] == [(i, *where[i])]
    with pytest.raises(IndexError):
        found.sample(198)


def test_history_joins_bucket_with_bucket(spark, tmp_path):
    found = store.build(f"{tmp_path}/s", *tables(spark, [50] * 8), rows_per_bucket=50)
    found.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = read(found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    found.spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in found.sample(77)._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_failed_build_leaves_the_version_before(spark, tmp_path):
    path = f"{tmp_path}/s"
    first = store.build(path, *tables(spark, [4, 5]))
    with pytest.raises(ValueError, match="collision"):
        store.build(path, *tables(spark, [4, 5, 6], repeat=True))
    samples, features, kept = tables(spark, [4, 5])
    with pytest.raises(ValueError, match="0 to n - 1"):
        store.build(path, samples.where("sample_id <> 3"), features, kept)
    assert store.Store.open(spark, path).folder == first.folder
    store.build(path, *tables(spark, [2]))
    assert store.Store.open(spark, path).n_samples() == 2 and first.whole("samples").count() == 9


@pytest.mark.parametrize("n", [1, 2, 5, 97, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", sampling.permuted(F.col("id"), n, 3, 1).alias("rank"))
    got = rows.withColumn("back", sampling.unpermuted(F.col("rank"), n, 3, 1)).orderBy("id").collect()
    assert sorted(r["rank"] for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    if n == 1000:
        other = [r[0] for r in spark.range(n).select(sampling.permuted(F.col("id"), n, 3, 2)).collect()]
        ranks = [r["rank"] for r in got]
        assert ranks != other and abs(np.corrcoef(range(n), ranks)[0, 1]) < 0.1
        assert np.histogram(ranks[:500], 10, (0, n))[0].min() > 25


def test_batches_and_resumption(spark):
    rows = spark.range(103).withColumnRenamed("id", "index")
    whole = sampling.epoch_batches(rows, "index", 103, 10, 7, epoch=1)
    want = {(r.batch + 10, r.slot): r["index"] for r in whole.collect()}
    drawn = sampling.resumed(spark, 103, 10, 7, cursor=8, count=9)
    got = {(r.draw, r.slot): r["index"] for r in drawn.where("epoch = 1").collect()}
    assert got == {k: v for k, v in want.items() if k[0] < 17} and drawn.count() == 90
    shards = [sampling.epoch_batches(rows, "index", 103, 10, 7, workers=3, worker=w).collect() for w in range(3)]
    seen = [r["index"] for s in shards for r in s]
    assert [len(s) for s in shards] == [30, 30, 30] and len(set(seen)) == 90
    with pytest.raises(ValueError):
        sampling.epoch_batches(rows, "index", 103, 40, 7, workers=3)


def test_widening_histograms(spark):
    rng = np.random.default_rng(2)
    parts = [rng.normal(0, 1, (300, 3)), rng.normal(50, 1, (200, 3)) * [1, -100, 0], rng.exponential(3, (500, 3)) - [0, 0, 7]]
    frames = [spark.createDataFrame([(x.tolist(),) for x in p], "x array<double>") for p in parts]
    bins = 256
    states = [stats.widening_histogram(f, "x", bins) for f in frames]
    once = stats.widening_histogram(frames[0].unionByName(frames[1]).unionByName(frames[2]), "x", bins)
    for order in ((0, 1, 2), (2, 0, 1)):
        merged = stats.merge_histograms(stats.merge_histograms(*[states[i] for i in order[:2]], bins=bins), states[order[2]], bins=bins)
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, once.collect()))
    assert once.groupBy("dim").count().agg(F.max("count")).first()[0] <= bins + 1
    whole = np.concatenate(parts)
    for r in stats.histogram_quantiles(once).collect():
        x = np.sort(whole[:, r.dim])
        width = 2 * (x[-1] - x[0]) / bins
        assert r["count"] == 1000
        for q, got in ((0.01, r.q01), (0.99, r.q99)):
            assert x[int(np.ceil(q * 1000)) - 1] - width <= got <= x[int(np.ceil(q * 1000)) - 1]
    same = stats.histogram_quantiles(stats.widening_histogram(spark.createDataFrame([([0.0, 4.5],)] * 3, "x array<double>"), "x"))
    assert [(r.q01, r.q99) for r in same.orderBy("dim").collect()] == [(0.0, 0.0), (4.5, 4.5)]


@pytest.mark.parametrize("shape, target", [((10, 10, 3), (20, 20)), ((30, 30, 3), (15, 15)), ((50, 50, 3), (50, 50)),
                                           ((256, 320, 3), (60, 80)), ((5, 9, 1), (9, 5)), ((7, 3, 2), (4, 11))])
def test_letterboxed_images(spark, shape, target):
    h, w, c = shape
    rng = np.random.default_rng(4)
    black = spark.createDataFrame([([0] * (h * w * c),)], "x array<int>")
    out = images.letterbox(black, "x", shape, *target).first().x
    assert len(out) == target[0] * target[1] * c and set(out) == {0}
    pixels = rng.uniform(-1, 1, shape)
    got = images.letterbox(spark.createDataFrame([(pixels.ravel().tolist(),)], "x array<double>"), "x", shape, *target).first().x
    if (h, w) == target:
        assert got == pixels.ravel().tolist()
        return
    new_h, new_w = images.fitted(h, w, *target)

    def blend(size, new):
        m = np.zeros((new, size))
        for i, row in enumerate(images.taps(size, new)):
            for j, weight in row:
                m[i, j] = weight
        assert np.allclose(m.sum(1), 1)
        return m
    inner = np.einsum("ph,hwc,qw->pqc", blend(h, new_h), pixels, blend(w, new_w))
    want = np.full((*target, c), -1.0)
    top, left = (target[0] - new_h) // 2, (target[1] - new_w) // 2
    want[top:top + new_h, left:left + new_w] = inner
    assert np.allclose(np.array(got).reshape(want.shape), want)

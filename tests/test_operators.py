"""Exact unit expectations and invariants."""

import hashlib
import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.functions import bins, clean, waveform
from tracekit.functions.geo import haversine_km
from tracekit.operators import components, filters, keys, metrics, profile, sampling, spacetime, splits

RESULT = "weight string, p_in_window int, s_in_window int, p_prob double, s_prob double, p_residual_s double, s_residual_s double"


def p_only(spark, probs, residuals):
    return spark.createDataFrame([("w", 1500, -1, p, 0.0, r, None) for p, r in zip(probs, residuals, strict=True)], RESULT)


@pytest.mark.parametrize(
    "probs, residuals, threshold, want",
    [
        ([0.9, 0.5, 0.2, 0.05], [0.0] * 4, 0.3, {"p_recall": 0.5}),
        ([0.9] * 4, [0.1, -0.2, 2.0, -3.0], 0.3, {"p_mae_s": 1.325, "p_outlier": 0.5}),
        ([0.9, 0.9], [0.0, 0.0], 0.3, {"n_traces": 2}),
        ([0.9, 0.05], [0.1, 4.0], 0.9, {"p_mae_s": 2.05, "p_mae_s_cond": 0.1}),
        ([0.9, 0.05], [0.1, 4.0], 0.01, {"p_mae_s": 2.05, "p_mae_s_cond": 2.05}),
    ],
)
def test_metric_expectations(spark, probs, residuals, threshold, want):
    row = metrics.pick_metrics(p_only(spark, probs, residuals), ["weight"], threshold).first()
    for k, v in want.items():
        assert row[k] == pytest.approx(v)


def test_empty_slices_few_dual_rows_and_ties(spark):
    assert metrics.pick_metrics(p_only(spark, [], []), ["weight"]).count() == 0
    assert metrics.pick_metrics(p_only(spark, [0.5] * 4, [0.0] * 4), ["weight"]).first()["mcc"] is None
    both = spark.createDataFrame([("w", 1, 1, 0.5, 0.5, 0.0, 0.0)] * 6, RESULT)
    assert metrics.pick_metrics(both, ["weight"]).first()["mcc"] == 0


def test_domains(spark):
    corpora = {"stead": "stead", "scedc": "scedc"}
    df = spark.createDataFrame([("stead,ethz",), ("instance",), ("geofon",), (None,)], "trained_models string")
    got = lambda w: [r.d for r in df.select(filters.public_in_domain(F.col("trained_models"), F.lit(w), corpora).alias("d")).collect()]
    assert got("stead") == [True, False, False, False]
    assert got("geofon") == [False] * 4
    two = spark.createDataFrame([("scedc",), ("stead",)], "trained_models string").select(filters.public_in_domain(F.col("trained_models"), F.lit("eqt_scedc"), corpora).alias("d"))
    assert [r.d for r in two.collect()] == [True, False]
    own = spark.createDataFrame([("stead",), ("pnw",), ("instance",)], "dataset string")
    manifest = spark.createDataFrame([("stead",), ("instance",)], "dataset string")
    assert {r.dataset: r.in_domain for r in filters.own_in_domain(own, manifest).collect()} == {"stead": True, "pnw": False, "instance": True}
    with pytest.raises(ValueError):
        filters.own_in_domain(own.withColumnRenamed("dataset", "x"), manifest)


def test_cleaning_edges(spark):
    df = spark.createDataFrame([("1.5", "Train ", "201406.0", -1.0), ("nan", "DEV", None, 150.0), ("x", None, "7", math.nan), (None, "zz", "1.0.0", 1500.0)], "n string, s string, c string, km double")
    got = df.select(clean.number("n").alias("n"), clean.normalise_split(F.col("s")).alias("s"), clean.repair_chunk(F.col("c")).alias("c"), bins.distance_bin(F.col("km")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(1.5, "train", "201406", "unknown"), (None, "val", "", "regional"), (None, "", "7", "unknown"), (None, "", "1.0", "teleseismic")]
    assert clean.best_col(["A", "b"], ["a", "B"], ignore_case=True) == "A" and clean.best_col(["a"], ["z"]) is None
    pole = spark.range(1).select(haversine_km(F.lit(90.0), F.lit(0.0), F.lit(-90.0), F.lit(0.0)).alias("d")).first().d
    assert pole == pytest.approx(math.pi * 6371)


def test_sampling_invariants(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.choice("ab"), rng.choices("xyz", [90, 9, 1])[0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid string, dataset string, stratum string")
    capped = sampling.proportional_cap(df, 200, "stratum", ["rid"], dataset="dataset").groupBy("dataset").count().collect()
    assert all(200 <= r["count"] <= 202 for r in capped)
    same = sampling.proportional_cap(df.repartition(7), 200, "stratum", ["rid"], dataset="dataset")
    assert same.exceptAll(sampling.proportional_cap(df, 200, "stratum", ["rid"], dataset="dataset")).count() == 0
    assert sampling.proportional_cap(df, 10_000, "stratum", ["rid"], dataset="dataset").count() == 3000
    assert 300 <= sampling.proportional_cap(df, 300, "stratum", ["rid"]).count() <= 302
    two = sampling.two_level_cap(df, "stratum", "dataset", 30, 50, ["rid"]).groupBy("stratum").count().collect()
    assert all(r["count"] <= 50 for r in two)
    balanced = {r.stratum: r["count"] for r in sampling.rebalance(df, {"x": 0.5, "y": 0.5}, "stratum", ["rid"]).groupBy("stratum").count().collect()}
    assert set(balanced) == {"x", "y"} and abs(balanced["x"] - balanced["y"]) <= 1
    with pytest.raises(ValueError):
        sampling.oversample(df, F.col("stratum") == "x", 1.0, ["rid"])
    assert sampling.ratio_split(df, 0.9, ["rid"]).where("split = 'train'").count() == 2700


def test_grouped_split_keeps_keys_together(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", rng.choice(["train", "val", ""])) for i in range(400)]
    row_keys = [(f"r{i}", f"k{rng.randrange(150)}") for i in range(300) for _ in range(rng.choice([1, 1, 2]))]
    df, k = spark.createDataFrame(rows, "rid string, vendor string"), spark.createDataFrame(row_keys, "rid string, event_key string")
    out = keys.written(splits.event_grouped_split(df, k, 0.2, 0.2))
    assert out.count() == 400
    assert k.join(out, "rid").groupBy("event_key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    kept = {r.rid: r.split for r in out.collect()}
    assert all(kept[r] == v for r, v in rows if int(r[1:]) >= 300 and v)


def test_long_chains_of_keys(spark):
    n = 200
    k = spark.createDataFrame([(f"r{i:04d}", f"k{i + d}") for i in range(n) for d in (0, 1)], "rid string, event_key string")
    assert {r.group_id for r in keys.key_components(k).collect()} == {"r0000"}


def test_components_of_hard_shapes(spark):
    """A path in shuffled order, two ramps that meet, stars and a clique, and loners, in a few rounds each."""
    rng, n = random.Random(5), 1000
    path = [f"a{i:04d}" for i in rng.sample(range(n), n)]
    ramps = [f"b{i:04d}" for i in [*range(1, 400, 2), *range(400, 0, -2)]]
    edges = list(zip(path, path[1:], strict=False)) + list(zip(ramps, ramps[1:], strict=False))
    edges += [("c999", f"c{i:03d}") for i in range(300)] + [(f"d{i}", f"d{j}") for i in range(6) for j in range(6)] + [("e0", None)]
    ids = {x for e in edges for x in e if x} | {"f0"}
    v, e = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(edges, "a string, b string")
    turns = []
    real = components.written
    components.written = lambda df: turns.append(1) or real(df)
    try:
        got = {r.id: r.component for r in components.smallest_labels(v, e).collect()}
    finally:
        components.written = real
    least = {"a": "a0000", "b": "b0001", "c": "c000", "d": "d0", "e": "e0", "f": "f0"}
    assert got == {x: least[x[0]] for x in ids}
    assert len(turns) < 3 * 20  # two tables a round, and one to name its vertices
    assert components.smallest_labels(v.limit(0), e.limit(0)).count() == 0


def test_overlap_and_empty_exclusions(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "rid string")
    k = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "rid string, event_key string")
    assert sorted(r.rid for r in keys.drop_overlapping(df, k, k.where("event_key = '2'")).collect()) == ["b", "c"]
    assert keys.drop_overlapping(df, k, k.limit(0)).count() == 3
    flags = {r.rid: (r.verifiable, r.leaked) for r in keys.flag_overlap(df, k, k.where("event_key = '2'")).collect()}
    assert flags == {"a": (True, True), "b": (True, False), "c": (False, False)}


def test_space_time_join_equals_brute_force(spark):
    rng = random.Random(2)
    point = lambda i: (i, rng.randrange(200) * 1_000_000, rng.uniform(-1, 1), rng.uniform(-1, 1))
    a, b = [point(i) for i in range(150)], [point(i) for i in range(100)] + [(1, 0, None, 0.0)]
    frame = lambda r: spark.createDataFrame(r, "id int, t long, lat double, lon double").withColumn("ts", F.timestamp_micros("t"))
    got = {r.id for r in spacetime.near_in_space_time(frame(a), frame(b), "id", 2, 60).where("leaked").collect()}

    def km(p, q):
        d = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(d(p[2], q[2]) + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * d(p[3], q[3])))

    assert got == {p[0] for p in a if any(q[2] is not None and abs(p[1] - q[1]) <= 2_000_000 and km(p, q) <= 60 for q in b)}


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = spark.createDataFrame([("m", i % 50, "x") for i in range(200)], "m string, a int, b string")
    digest = lambda d: profile.fingerprint(d, "m", ["a", "b"]).first().sha256
    assert digest(df) == digest(df.orderBy(F.rand(1)).repartition(5)) != digest(df.union(df.limit(1)))


def test_bootstrap_interval_follows_normal_theory(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(3, 2, 4000)
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)] + [("few", 1, 1.0)], "g string, i int, v double")
    got = {r.g: r for r in metrics.bootstrap_ci(df.repartition(6), ["g"], "v", ["i"], n_boot=400).collect()}
    assert got["few"].ci_lo is None
    width = 2 * 1.96 * v.std() / math.sqrt(len(v))
    assert got["g"].ci_lo < v.mean() < got["g"].ci_hi and abs(got["g"].ci_hi - got["g"].ci_lo - width) < 0.15 * width


def test_resampling_keeps_sinusoids(spark):
    t = np.arange(400) / 40.0
    df = spark.createDataFrame([([np.sin(2 * np.pi * 2 * t).tolist()], 40.0)], "wf array<array<double>>, rate double")
    for method in ("polyphase", "fft"):
        out = np.array(waveform.resampled(df, "wf", "rate", 100.0, method).first().wf[0])
        want = np.sin(2 * np.pi * 2 * np.arange(1000) / 100)
        assert len(out) == 1000 and np.abs(out - want)[100:-100].max() < 0.02


def test_augmentation_and_scorer_errors(spark):
    df = spark.range(2000).select("id", F.array(F.lit(1.0), F.lit(1.0)).alias("w"))
    out = np.array([r.a for r in df.select(waveform.augmented(F.col("w"), 1, F.col("id")).alias("a")).collect()])
    assert (np.abs(out) >= 0.5).all() and (np.abs(out) < 2).all() and 0.06 < (out[:, 0] < 0).mean() < 0.14
    noisy = np.array([r.a for r in df.select(waveform.augmented(F.col("w"), 1, F.col("id"), noise_db=20.0).alias("a")).collect()]) - out
    assert abs(noisy.std() - 0.1) < 0.01

    def broken():
        def score(block):
            raise RuntimeError("no model")

        return score

    bad = waveform.scored(df.limit(3).select("id", F.array("w").alias("wf")), "wf", broken, 10).collect()
    assert all(r.score_status == "error: no model" and r.p_curve is None for r in bad)


def test_corpus_build_invariants(spark):
    from tracekit.queries import QUERIES
    from tracekit.queries.base import Tables

    folder = "/root/testdata/sf0.001"
    out = keys.written(QUERIES["corpus_build"](spark, folder))
    train = {r.distance_bin: r["count"] for r in out.where("split = 'train'").groupBy("distance_bin").count().collect()}
    assert max(train.values()) - min(train.values()) <= 1 or len(train) < 4
    row_keys = Tables(spark, folder).fx_rowkeys
    assert row_keys.join(out, "rid").groupBy("event_key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_library_does_not_need_the_text_operators():
    root = pathlib.Path(__file__).resolve().parents[1] / "tracekit"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_key_queries_cover_every_row(spark):
    """Components over the keys of all rows against a union-find, and the whole event-grouped split by hand."""
    from tracekit.queries import QUERIES
    from tracekit.queries.base import Tables

    folder = "/root/testdata/sf0.001"
    t = Tables(spark, folder)
    row_keys = [(r.rid, r.event_key) for r in t.fx_rowkeys.collect()]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for rid, key in row_keys:
        parent[find(("r", rid))] = find(("k", key))
    least: dict = {}
    for rid, _ in row_keys:
        g = find(("r", rid))
        least[g] = min(rid, least.get(g, rid))
    want = {rid: least[find(("r", rid))] for rid, _ in row_keys}
    assert {r.rid: r.group_id for r in QUERIES["t14_key_components"](spark, folder).collect()} == want

    rows = {r.rid: r.vendor for r in t.fx_keys.select("rid", "vendor").collect()}
    assert len(rows) == t.lineitem.count()
    placed = {r for r, v in rows.items() if r not in want and v}
    group = {r: want.get(r, f"row:{r}") for r in rows if r not in placed}
    sizes: dict = {}
    for g in group.values():
        sizes[g] = sizes.get(g, 0) + 1
    goal, at, begin, side = math.floor(0.1 * len(group)), 0, 0, iter(["val", "test", "train"])
    now, split = next(side), {}
    for g in sorted(sizes, key=lambda g: (hashlib.md5(f"0|{g}".encode()).hexdigest(), g)):
        if now != "train" and at >= begin + goal:
            begin, now = at, next(side)
        split[g], at = now, at + sizes[g]
    got = {r.rid: r.split for r in QUERIES["t13_event_grouped_split"](spark, folder).collect()}
    assert got == {r: v if r in placed else split[group[r]] for r, v in rows.items()}


def test_shuffle_places_every_row(spark):
    from tracekit.queries import QUERIES
    from tracekit.queries.base import Tables

    folder = "/root/testdata/sf0.001"
    at = sorted(r["at"] for r in QUERIES["t15_shuffle"](spark, folder).collect())
    assert at == list(range(1, Tables(spark, folder).fx_catalog.count() + 1))


def test_exact_quantiles(spark):
    """Against numpy, with nulls, ties, one value, and a group of a third outliers; a narrow sketch makes the brackets matter."""
    from tracekit.operators import quantiles

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=5000), "b": np.repeat([1.0, 2.0], [10, 991]), "c": np.array([7.0]), "d": np.concatenate([rng.uniform(size=2000), 1e9 * rng.uniform(size=1000)]), None: rng.exponential(size=300), "e": rng.normal(size=1078), "f": rng.normal(size=14_001)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (50, 10_000):
        got = {r.g: r.quantiles for r in quantiles.exact_quantiles(df, ["g"], "v", at, accuracy).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            assert got[g] == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12)
    whole = quantiles.exact_quantiles(df, [], "v", [0.5]).first().quantiles
    assert whole == pytest.approx([np.median(np.concatenate(list(groups.values())))])
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_divided_takes_the_first_of_the_draw(spark):
    rows = [(f"r{i}", "xyz"[i % 7 % 3] if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid string, g string")
    take = spark.createDataFrame([("x", 100), ("y", 0), ("z", 10_000), (None, 5)], "g string, _take int")
    taken, left = sampling.divided(df, ["g"], take, ["rid"], 3)
    first = {g: sorted((hashlib.md5(f"3|{r}".encode()).hexdigest(), r) for r, h in rows if h == g) for g in ("x", "y", "z", None)}
    n = {"x": 100, "y": 0, "z": 10_000, None: 5}
    assert {r.rid for r in taken.collect()} == {r for g in first for _, r in first[g][: n[g]]}
    assert {r.rid for r in left.collect()} == {r for g in first for _, r in first[g][n[g] :]}


def test_scores_of_many_micro_batches_and_late_deliveries(spark, tmp_path):
    from tracekit.streaming import ingest

    rows = lambda n, at, p: spark.createDataFrame([(i, "w", p, at) for i in range(n)], "trace_id long, weight string, p_prob double, scored_at int")
    schema = rows(1, 1, 0.5).schema
    place = f"file://{tmp_path}"

    def deliver(df, name):
        df.write.parquet(f"{place}/in/delivery={name}")
        ingest.ingest_scores(ingest.new_deliveries(spark, f"{place}/in", schema, files_per_batch=1), f"{place}/out", f"{place}/state").awaitTermination()
        ingest.publish(spark, f"{place}/in", f"{place}/out", schema)

    held = lambda: sorted((r.trace_id, r.p_prob) for r in ingest.latest_scores(spark, f"{place}/out", schema).collect())
    deliver(rows(30, 2, 0.5).repartition(4), "a")
    assert held() == [(i, 0.5) for i in range(30)]
    deliver(rows(9, 1, 0.1).coalesce(1), "b")
    assert held() == [(i, 0.5) for i in range(30)]
    deliver(rows(5, 3, 0.9).coalesce(1), "c")
    assert held() == [(i, 0.9) for i in range(5)]


def test_shards_with_other_columns_are_united_by_name(spark, tmp_path):
    from tracekit.sources import catalogs

    for name, text in (("m_1.csv", "a,b\n1,2\n"), ("m_2.csv", "b,a\n4,3\n"), ("m_3.csv", 'c,"a"\n"x,y",5\n'), ("m_4.csv.partial", "a,b\n9,9\n"), ("m_5.csv", "")):
        (tmp_path / name).write_text(text)
    got = catalogs.read_shards(spark, f"file://{tmp_path}", "m_")
    assert sorted((r.a, r.b, r.c, r.chunk) for r in got.collect()) == [("1", "2", None, "1"), ("3", "4", None, "2"), ("5", None, "x,y", "3")]
    with pytest.raises(FileNotFoundError):
        catalogs.read_shards(spark, f"file://{tmp_path}", "none_")


def test_merged_statistic_never_gathers_a_group(spark):
    df = spark.range(0, 40000, 1, 6).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").alias("g"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("v"))

    def merge(states):
        assert len(states) < 100  # states, not rows
        return [states[:, 0].max(), states[:, 1].min()]

    got = waveform.merged_statistic(df, ["g"], "v", lambda x: [x.max(), x.min()], merge, lambda s: s[0] - s[1]).collect()
    assert {r.g: r.statistic for r in got} == {"hot": 39998.0, "cold": None, None: None}


def test_pick_metrics_with_intervals(spark):
    import inspect

    from tracekit.queries.base import Tables

    assert inspect.signature(metrics.bootstrap_ci).parameters["n_boot"].default == 1000
    df = Tables(spark, "/root/testdata/sf0.001").fx_results
    plain, got = metrics.pick_metrics(df, ["weight"]), metrics.pick_metrics(df, ["weight"], ci_key=["trace_id"])
    rows = got.collect()
    assert len(rows) == plain.count() and set(plain.columns) < set(got.columns)
    for r in rows:
        for name in ("p_mae_s", "s_mae_s", "p_recall", "s_recall"):
            assert r[f"{name}_ci_lo"] < r[name] < r[f"{name}_ci_hi"]


def test_leaderboard_with_intervals(spark):
    from tracekit.plans import corpus
    from tracekit.queries.base import Tables

    results = Tables(spark, "/root/testdata/sf0.001").fx_results
    inside = F.col("trained_models").contains("ds1")
    plain, got = corpus.leaderboard(results, inside), corpus.leaderboard(results, inside, ["trace_id"])
    rows = got.collect()
    assert set(got.columns) - set(plain.columns) == {f"{m}_ci_{e}" for m in ("p_mae_s", "s_mae_s", "p_recall", "s_recall", "mcc") for e in ("lo", "hi")}
    assert len(rows) == plain.count() and sum(r.p_mae_s_ci_lo <= r.p_mae_s <= r.p_mae_s_ci_hi for r in rows if r.n_p_traces > 20) > 20


def test_merging_noise_is_resumable_and_keeps_parts_apart(spark, tmp_path):
    from tracekit.plans import build
    from tracekit.sources import catalogs

    blank = spark.createDataFrame([("d", "t0", "train"), ("d", "t1", "val")], "dataset_name string, trace_name string, split string")
    for f in catalogs.MANIFEST.fields:
        if f.name not in blank.columns:
            blank = blank.withColumn(f.name, F.lit(None).cast(f.dataType))
    target = f"file://{tmp_path}"
    catalogs.write_manifest(blank, f"{target}/manifest")
    noise = spark.range(100).select(F.concat(F.lit("n"), "id").alias("trace_name"))
    audit = noise.withColumn("max_p", F.when(F.col("trace_name") == "n7", 0.5).otherwise(0.01)).withColumn("max_s", F.lit(0.0))
    held = lambda: [(r.trace_name, r.split) for r in build.read_manifest(spark, target).where("dataset_name = 'noise_global'").collect()]
    build.merge_noise(noise.limit(40), audit, target)
    first = held()
    build.merge_noise(noise, audit, target)
    second = held()
    build.merge_noise(noise, audit, target)
    assert sorted(held()) == sorted(second) and set(first) < set(second)
    assert len(second) == 99 and len({n for n, _ in second}) == 99 and "n7" not in dict(second)


def test_corpus_build_is_the_split_then_balanced(spark):
    """corpus_build against its parts: the event-grouped split, of whose training part each bin keeps its first rows by the draw."""
    from tracekit.queries import QUERIES
    from tracekit.queries.base import Tables

    folder = "/root/testdata/sf0.001"
    bins_of = {r.rid: r.distance_bin for r in Tables(spark, folder).fx_binned.select("rid", "distance_bin").collect()}
    vendor = {r.rid: r.vendor for r in Tables(spark, folder).fx_keys.select("rid", "vendor").collect()}
    split = {r.rid: r.split for r in QUERIES["t13_event_grouped_split"](spark, folder).collect()}
    got = {r.rid: r.split for r in QUERIES["corpus_build"](spark, folder).collect()}
    train: dict = {}
    for rid, s in split.items():
        if s == "train":
            train.setdefault(bins_of[rid], []).append((hashlib.md5(f"0|{rid}".encode()).hexdigest(), rid))
    least = min(min(int(len(v) / 0.25) for v in train.values()), sum(map(len, train.values())))
    want = {rid: s for rid, s in split.items() if s != "train"} | {rid: "train" for v in train.values() for _, rid in sorted(v)[: round(least * 0.25)]}
    assert len(vendor) == len(split) and got == want


def test_split_by_lists_of_keys_is_the_split_by_row_keys(spark):
    rng = random.Random(5)
    rows = [(f"r{i:03}", rng.choice(["train", "val", "", None]), [f"k{rng.randrange(150)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]) for i in range(400)]
    rows += [("r400", "test", None), ("r401", None, ["k1", None, "k1"])]
    df = keys.written(spark.createDataFrame(rows, "rid string, vendor string, event_keys array<string>").repartition(3))
    listed = df.select("rid", F.explode("event_keys").alias("event_key"))
    want = {(r.rid, r.vendor, r.split) for r in splits.event_grouped_split(df.drop("event_keys"), listed, 0.2, 0.3).collect()}
    out = splits.event_grouped_split(df, None, 0.2, 0.3)
    assert out.columns == ["rid", "vendor", "split"]
    got = out.collect()
    assert len(got) == len(rows) and {(r.rid, r.vendor, r.split) for r in got} == want and {r.split for r in got} == {"train", "val", "test"}


@pytest.mark.parametrize("targets", [[0], [7, 0, 9], [1, 1], [30, 1000], [1000, 5]])
def test_greedy_fill_by_definition(spark, targets):
    rng = random.Random(sum(targets))
    sizes = {f"g{i}": rng.choice([0, 1, 1, 2, 9]) for i in range(60)}
    groups = spark.createDataFrame([(g, n, n + 1) for g, n in sizes.items()], "group_id string, size long, more long").repartition(5)
    got = {r.group_id: r.split for r in splits.greedy_fill(groups, [(f"t{i}", F.lit(t).cast("long")) for i, t in enumerate(targets)], "rest").collect()}
    order, want, at, start = sorted(sizes, key=lambda g: (hashlib.md5(f"0|{g}".encode()).hexdigest(), g)), {}, 0, 0
    before = {}
    for g in order:
        before[g], at = at, at + sizes[g]
    for i, t in enumerate(targets):
        taken = [g for g in order if start <= before[g] < start + t and g not in want]
        want |= {g: f"t{i}" for g in taken}
        start = max([start, *(before[g] + sizes[g] for g in taken)])
    assert got == {g: want.get(g, "rest") for g in order}


def shuffled(spark, run):
    """Bytes that the stages of a call write to shuffles."""
    store, jvm = spark._jsc.sc().statusStore(), spark._jvm
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark._sc._gateway.new_array(jvm.double, 0), None))}
    old = stages()
    run()
    return sum(n for k, n in stages().items() if k not in old)


def test_corpus_build_shuffles_rows_twice(spark):
    from tracekit.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        n = shuffled(spark, lambda: QUERIES["corpus_build"](spark, folder).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n < 200 * spark.read.parquet(f"{folder}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["corpus_manifests", "corpus_removals"])
def test_manifests_do_not_shuffle_rows_for_names_and_top_ups(spark, name):
    from tracekit.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        n = shuffled(spark, lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n < 200 * spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_top_up_above_a_thousand_rows(spark):
    df = spark.range(0, 9000, 1, 3).select("id", F.when(F.col("id") < 8500, F.when(F.col("id") % 4 < 3, F.col("id") % 4).otherwise(7)).alias("s"), F.when(F.col("id") % 9 > 0, F.col("id") % 2).alias("g"))
    out = [tuple(r) for r in sampling.proportional_cap(df, 1201, "s", ["id"], 3, "g").select("g", "s", "id").collect()]
    rows = [tuple(r) for r in df.select("g", "s", "id").collect()]
    draw, want = lambda seed, r: (hashlib.md5(f"{seed}|{r[2]}".encode()).hexdigest(), r[2]), []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: draw("3", r))
        if len(own) <= 1201:
            want += own
            continue
        part = [[r for r in own if r[1] == s] for s in {r[1] for r in own}]
        taken = [r for p in part for r in p[: min(len(p), max(1, round(1201 * len(p) / len(own))))]]
        rest = sorted(set(own) - set(taken), key=lambda r: draw("3+", r))
        want += taken + rest[: max(0, 1201 - len(taken))]
    assert sorted(out, key=repr) == sorted(want, key=repr)


def test_scratch_tables_are_cleared_and_clusters_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from tracekit.sources import scratch

    held = scratch.written(spark.range(5))
    folder = scratch._made[-1].removeprefix("file://")
    assert held.count() == 5 and pathlib.Path(folder).exists()
    scratch.clear(spark)
    assert not pathlib.Path(folder).exists() and not scratch._made
    nothing = SimpleNamespace(get=lambda name: None)
    bare = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        scratch.shared_folder(bare)


def test_sp_histogram_is_open_at_its_end_and_counts_no_nan(spark):
    rows = [("a", 0.0), ("a", 9.999), ("a", 10.0), ("a", float("nan")), ("a", -0.1), ("a", None), ("b", 10.0)]
    got = profile.sp_histogram(spark.createDataFrame(rows, "dataset string, sp double"), "dataset", F.col("sp"), 0.5, 20, 5.0).collect()
    assert sorted((r.dataset, r.bin, r.n) for r in got if r.n) == [("a", 0, 1), ("a", 19, 1)]
    assert len(got) == 40 and {(r.dataset, r.median_bin, r.within) for r in got} == {("a", 0, 0.4), ("b", 0, 0.0)}


def test_histogram_of_nan_is_in_no_bin(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (float("nan"),)], "x double")
    assert [(r.bin, r.n) for r in profile.histogram(df, [], F.col("x"), 0.0, 1.0, 2).orderBy("bin").collect()] == [(0, 1), (1, 1)]

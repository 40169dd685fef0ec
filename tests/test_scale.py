"""Operators that were built for hot groups and growing targets: against plain versions, on inputs shaped to break them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.functions import waveform
from tracekit.operators import bootstrap, keys, metrics, order, profile, quantiles, sampling, spacetime
from tracekit.sources import catalogs, keyindex
from tracekit.sources.scratch import new_folder
from tracekit.streaming import ingest


def test_positions_of_one_giant_group_and_many_small_ones(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges though rows are few
    try:
        _positions(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r.i: r["_at"] for r in order.numbered(df, ["g"], ["v", "i"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    ranges = df.repartitionByRange("g", "v", "i").where("g = 'hot'").groupBy(F.spark_partition_id()).count().count()
    assert ranges > 2  # the hot group fills several
    batch = {r.i: r.batch for r in order.in_batches(df, "g", 7, ["v", "i"]).collect()}
    assert all(batch[i] == math.ceil(got[i] / 7) for i in got)
    assert order.numbered(df.where("false"), ["g"], ["v"]).collect() == []


@pytest.mark.parametrize("width,least", [(1, 1), (7, 1), (64, 5), (5000, 1)])
def test_rolling_mean(spark, monkeypatch, width, least):
    monkeypatch.setattr(order, "PIECE", 16)
    rng = random.Random(width)
    rows = [("hot" if rng.random() < 0.9 else "b", i, rng.choice([None, float("nan"), 1e15, rng.gauss(0, 1), rng.gauss(5, 1)])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    got = {r.i: r.smooth for r in order.rolling_mean(df, ["g"], ["i"], "v", width, least=least).collect()}
    for g in ("hot", "b"):
        own = [(i, v) for x, i, v in rows if x == g]
        for k, (i, _) in enumerate(own):
            held = [v for _, v in own[max(0, k - width + 1) : k + 1] if v is not None and not math.isnan(v)]
            if len(held) < least:
                assert got[i] is None
            else:
                assert math.isclose(got[i], math.fsum(held) / len(held), rel_tol=1e-9, abs_tol=1e-9)


def weights_of(n, n_boot, seed=42):
    """Poisson weights of rows with keys 0 .. n - 1, by the definition."""
    import hashlib

    limits, mask = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), 2**32 - 1

    def mix(z):
        z = (z ^ (z >> 16)) * 2246822507 & mask
        z = (z ^ (z >> 13)) * 3266489909 & mask
        return z ^ (z >> 16)

    out = np.zeros((n, n_boot))
    for i in range(n):
        h = hashlib.md5(f"{seed}|{i}".encode()).hexdigest()
        a, b = int(h[:8], 16), int(h[8:16], 16)
        for k in range(n_boot):
            out[i, k] = np.searchsorted(limits, (mix(mix((a + (k + 1) * 2654435769) & mask) ^ b) + 0.5) / 2**32)
    return out


def test_bootstrap_of_ratios_and_quantiles(spark):
    rng = np.random.default_rng(3)
    n, n_boot = 300, 60
    v = np.round(rng.normal(0, 1, n), 1)  # many ties
    v[:250] = np.where(rng.random(250) < 0.3, 2.0, v[:250])
    group = np.where(np.arange(n) < 250, "g", "h").astype(object)
    group[-3:] = "few"
    rows = [(str(g), i, None if i % 17 == 0 else float(x), float(i % 5)) for i, (g, x) in enumerate(zip(group, v, strict=True))]
    df = spark.createDataFrame(rows, "g string, i int, v double, d double").repartition(4)
    asked = {"mean": bootstrap.mean(F.col("v")), "share": bootstrap.ratio(F.col("v"), F.col("d")), "median": bootstrap.Quantile(F.col("v")), "low": bootstrap.Quantile(F.col("v"), 0.1)}
    got = {r.g: r.asDict() for r in bootstrap.intervals(df, ["g"], asked, ["i"], n_boot=n_boot).collect()}
    w = weights_of(n, n_boot)
    for g in ("g", "h"):
        at = [i for i, r in enumerate(rows) if r[0] == g and r[2] is not None]
        x, d, ww = np.array([rows[i][2] for i in at]), np.array([rows[i][3] for i in at]), w[at].astype(int)
        each = {"mean": [np.average(x, weights=ww[:, k]) for k in range(n_boot)], "share": [(x * ww[:, k]).sum() / (d * ww[:, k]).sum() for k in range(n_boot)]}
        each |= {name: [np.quantile(np.repeat(x, ww[:, k]), q) for k in range(n_boot)] for name, q in (("median", 0.5), ("low", 0.1))}
        for name, values in each.items():
            assert np.allclose([got[g][f"{name}_ci_lo"], got[g][f"{name}_ci_hi"]], np.percentile(values, [2.5, 97.5])), (g, name)
            assert got[g][f"{name}_n"] == len(at)
    assert got["few"]["mean_ci_lo"] is None and got["few"]["median_ci_hi"] is None


def test_sweep_medians(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 10 else "b", int(rng.integers(-1, 2)), float(round(rng.random(), 2)), None if i % 13 == 0 else float(np.round(rng.normal(0, 2), 1))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, p_in_window int, p_prob double, p_residual_s double").repartition(6)
    marks = [0.0, 0.25, 0.5, 0.9, 1.5]
    for cells in (256, 4):
        true = F.col("p_in_window") >= 0
        reached = F.size(F.filter(F.array(*map(F.lit, marks)), lambda x: x <= F.col("p_prob")))
        out = metrics.with_medians(metrics.threshold_sweep(df, ["g"], marks), df.select("g", F.when(true, reached).alias("_at"), F.abs("p_residual_s").alias("_v")), ["g"], marks, cells)
        for r in out.collect():
            held = [abs(x) for g, w, p, x in rows if g == r.g and w >= 0 and p >= r.threshold and x is not None]
            assert r.median_cond == (None if not held else pytest.approx(np.median(held)))


def test_nan_is_no_value_of_a_quantile(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, "nan")] + [("b", float("nan"))], "g string, v double")
    assert {r.g: r.quantiles for r in quantiles.exact_quantiles(df, ["g"], "v", [0.5, 1.0]).collect()} == {"a": [2.0, 3.0]}


def test_proportional_cap_keeps_null_datasets(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "d", None if i % 3 else "s") for i in range(60)], "i int, dataset string, stratum string")
    out = sampling.proportional_cap(df, 20, "stratum", ["i"], 0, "dataset").collect()
    assert {sum(r.dataset == d for r in out) for d in (None, "d")} == {20}
    assert len(sampling.proportional_cap(df, 100, "stratum", ["i"], 0, "dataset").collect()) == 60


def test_key_labels_grow_with_new_rows(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", f"k{rng.randrange(120)}") for i in range(90) for _ in range(rng.choice([1, 1, 2, 3]))]
    frame = lambda part: spark.createDataFrame(part, "rid string, event_key string")
    whole = frame(rows)
    want = {(r.key, r.label) for r in keys.key_labels(whole).collect()}
    labels = None
    for low in range(0, 90, 30):
        part = [r for r in rows if low <= int(r[0][1:]) < low + 30]
        labels = keys.key_labels(frame(part), known=labels)
    assert {(r.key, r.label) for r in labels.collect()} == want
    fresh, given = (sorted(map(tuple, keys.key_components(whole, labels=x).collect())) for x in (None, labels))
    assert fresh == given
    group = {r: r for r, _ in rows}  # union-find by repeated minima
    for _ in range(90):
        for k in {k for _, k in rows}:
            low = min(group[r] for r, x in rows if x == k)
            for r, x in rows:
                if x == k:
                    group[r] = low
    assert dict(fresh) == group


def test_key_index_reads_what_a_delivery_meets(spark):
    place = new_folder(spark)
    frame = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "k long, v string")
    reads, step = [], 400
    for number in range(4):
        ids = [*range(number * step, (number + 1) * step), *range(max(0, number * step - 50), number * step)]
        keyindex.append_new_keys(frame(ids + ids[:30]), f"{place}/t", f"{place}/i", ["k"], number, full=20)
        few = frame([10**6 + number, 5, 10**6 + number])
        schema = few.select("k").schema
        bits = keyindex._bits(spark, f"{place}/i")
        hit = [r[0] for r in few.select(F.shiftrightunsigned(F.xxhash64("k"), 64 - bits).cast("int")).distinct().collect()]
        reads.append(keyindex.known_keys(spark, f"{place}/i", schema, hit).count())
    held = [r.k for r in spark.read.parquet(f"{place}/t").collect()]
    assert sorted(held) == list(range(4 * step))
    assert keyindex.known_keys(spark, f"{place}/i", schema).count() == 4 * step
    assert max(reads) <= 2 * 4 * 20  # two keys, buckets of twenty on average, whatever the target holds
    assert "PartitionFilters: [isnotnull(bucket" in keyindex.known_keys(spark, f"{place}/i", schema, hit)._jdf.queryExecution().toString() or len(hit) > 0


def test_deliveries_that_break_off_come_again(spark):
    place = new_folder(spark)
    frame = lambda ids: spark.createDataFrame([(i, "x") for i in ids], "k long, v string")
    add = lambda ids, number: keyindex.append_new_keys(frame(ids), f"{place}/t", f"{place}/i", ["k"], number, full=10)
    add(range(100), 0)
    add(range(90, 150), 1)
    add(range(90, 150), 1)  # the same number again: as if it had come once
    # rows written, index not: the next run finds nothing of its own number in the index
    frame(range(150, 160)).withColumn("delivery", F.lit(2).cast("long")).write.mode("append").partitionBy("delivery").parquet(f"{place}/t")
    add(range(145, 165), 2)
    assert sorted(r.k for r in spark.read.parquet(f"{place}/t").collect()) == list(range(165))
    catalogs.append_new(spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "n"), (None, "m")], "k long, v string"), f"{place}/plain", ["k"])
    assert sorted(map(tuple, spark.read.parquet(f"{place}/plain").collect()), key=repr) == sorted([(1, "a"), (2, None), (None, "m")], key=repr)


def test_deliveries_publish_once_and_whole(spark):
    place = new_folder(spark)
    schema = "trace_id int, p_prob double, weight string, scored_at int"
    make = lambda rows: spark.createDataFrame(rows, schema)
    first = make([(i, 0.5, "a", 1) for i in range(20)] + [(i, 0.5, "b", 1) for i in range(5)])
    latest = lambda: sorted((r.trace_id, r.p_prob, r.weight) for r in ingest.latest_scores(spark, f"{place}/out", first.schema).collect())

    def deliver(df, name, whole=True):
        df.write.parquet(f"{place}/in/delivery={name}")
        if not whole:
            mark = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/in/delivery={name}/_SUCCESS")
            mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
        run()

    def run():
        ingest.ingest_scores(ingest.new_deliveries(spark, f"{place}/in", first.schema, files_per_batch=2), f"{place}/out", f"{place}/state").awaitTermination()
        ingest.publish(spark, f"{place}/in", f"{place}/out", first.schema)

    deliver(first.repartition(3), "d1")
    want = latest()
    assert len(want) == 25
    deliver(first.repartition(2), "d2")  # the same once more, in other files
    assert latest() == want
    digests = {r.delivery: r.digest for r in ingest.commits(spark, f"{place}/out", first.schema).where("weight = 'a'").collect()}
    assert digests["d1"] == digests["d2"]
    deliver(make([(i, 0.9, "a", 2) for i in range(10)]).repartition(2), "d3", whole=False)
    assert latest() == want
    deliver(make([(7, 0.1, "b", 0)]), "d4")  # an older one that comes late
    assert latest() == want
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/in/delivery=d3/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
    run()  # d3 is finished
    want = sorted([(i, 0.9, "a") for i in range(10)] + [(i, 0.5, "b") for i in range(5)])
    assert latest() == want
    assert ingest.compact(spark, f"{place}/out", first.schema) >= 3 and latest() == want
    run()
    assert latest() == want


def test_files_without_rows_hold_no_delivery_back(spark):
    place = new_folder(spark)
    df = spark.range(0, 40, 1, 4).select("id", (F.col("id") / 100).alias("p_prob"), F.lit("a").alias("weight"), F.lit(1).alias("scored_at"))
    newer = df.where("id >= 30").withColumn("scored_at", F.lit(2))  # only its last partition has rows; Spark writes a file for the first
    late = newer.withColumn("scored_at", F.lit(3))
    for k, part in enumerate((df, newer, df.where("id < 0"), late)):
        part.write.parquet(f"{place}/in/delivery={k}")
        if k < 3:  # the last one is whole before its rows are stored
            ingest.ingest_scores(ingest.new_deliveries(spark, f"{place}/in", df.schema), f"{place}/out", f"{place}/state").awaitTermination()
        ingest.publish(spark, f"{place}/in", f"{place}/out", df.schema)
    sizes = [spark.read.parquet(f"{f}").count() for f in catalogs.csv_files(spark, f"{place}/in/delivery=1")]
    assert sorted(sizes) == [0, 10]
    assert sorted((r.delivery, r.n_rows) for r in ingest.commits(spark, f"{place}/out", df.schema).collect()) == [("0", 40), ("1", 10)]
    assert sorted(r.id for r in ingest.latest_scores(spark, f"{place}/out", df.schema).collect()) == list(range(30, 40))


def test_near_in_space_time_everywhere(spark):
    rng = random.Random(6)
    place = lambda: rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(88, 90), rng.uniform(-180, 180)), (-90.0, 10.0), (rng.uniform(-5, 5), rng.choice([-180.0, 179.99, 180.0, -179.98]))])
    events, rows = ([(i, rng.uniform(0, 40), *place()) for i in range(n)] for n in (400, 300))
    rows += [(1000, None, 1.0, 1.0), (1001, 5.0, None, 1.0), (1002, 5.0, 1.0, float("nan"))]
    frame = lambda x: spark.createDataFrame(x, "id int, t double, lat double, lon double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))

    def km(a, b):
        (p, q), (r, s) = a, b
        h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    for seconds, far in ((3, 300.0), (40, 25.0), (2, 9000.0), (1, 0.0)):
        got = {r.id: (r.verifiable, r.leaked) for r in spacetime.near_in_space_time(frame(rows), frame(events), "id", seconds, far).collect()}
        for i, t, lat, lon in rows:
            known = None not in (t, lat, lon) and not math.isnan(lon)
            want = known and any(abs(int(t * 1e6) - int(u * 1e6)) <= seconds * 1e6 and km((lat, lon), (y, x)) <= far for _, u, y, x in events)
            assert got[i] == (known, want), (i, seconds, far)


def test_very_many_events_in_one_second(spark):
    """A hundred thousand events at one time all over the world: rows meet those of their own place only."""
    events = spark.range(100_000).select((F.lit(1000.0) + F.col("id") / 1e6).cast("timestamp").alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(160_000)) / 1000.0 - 80).alias("lat"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(360_000)) / 1000.0 - 180).alias("lon"))
    rows = events.withColumn("id", F.monotonically_increasing_id()).withColumn("lat", F.col("lat") + 0.01)
    out = spacetime.near_in_space_time(rows, events, "id", 2, 10)
    assert out.where("leaked").count() == 100_000
    cells = spacetime.Cells(2, 10)
    crowd = events.groupBy(cells.band(F.col("lat")).alias("b"), cells.stretch(F.col("lon"), cells.band(F.col("lat"))).alias("c")).count()
    assert crowd.agg(F.max("count")).first()[0] < 200


def test_ten_thousand_boxes(spark):
    rng = random.Random(7)
    boxes = []
    for i in range(10_000):
        south, west = rng.uniform(-90, 80), rng.uniform(-180, 170)
        size = rng.choice([0.0, 0.5, 3.0, 40.0])
        boxes.append((f"b{i}", south, min(90.0, south + size), west, min(180.0, west + rng.choice([size, 2 * size])), rng.random() < 0.5, rng.randrange(9000)))
    boxes += [("whole", -90.0, 90.0, -180.0, 180.0, False, 8999), ("back to front", 5.0, 4.0, 0.0, 1.0, False, 0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(100 + i, b[1], b[4]) for i, b in enumerate(boxes[:20])] + [(200 + i, b[2], b[3]) for i, b in enumerate(boxes[:20])] + [(300, None, 1.0), (301, 1.0, float("nan")), (302, 95.0, 0.0)]
    table = spark.createDataFrame(boxes, "name string, south double, north double, west double, east double, half_open boolean, priority int")
    got = {r.id: r.region for r in spacetime.first_box(spark.createDataFrame(points, "id int, lat double, lon double"), table, ["id"], "lat", "lon").collect()}
    for i, lat, lon in points:
        if lat is None or math.isnan(lon):
            assert got[i] == "Unknown"
        else:
            held = [(p, n) for n, s, t, w, e, h, p in boxes if s <= lat and (lat < t if h else lat <= t) and w <= lon <= e]
            assert got[i] == (min(held)[1] if held else "Global/Unknown")


@pytest.mark.parametrize("source,target", [(99, 100), (40, 100), (100, 40), (250, 100), (100, 99), (1, 7)])
def test_polyphase_equals_the_filter_on_stuffed_samples(source, target):
    rng = np.random.default_rng(source)
    w = rng.normal(3, 1, 150)
    g = math.gcd(source, target)
    up, down = target // g, source // g
    half = 10 * max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    line = np.linspace(w[0], w[-1], len(w))
    spread = np.zeros(len(w) * up)
    spread[::up] = w - line
    size = -(-len(w) * up // down)
    want = np.convolve(spread, taps)[half:][: len(spread)][::down][:size] + np.interp(np.arange(size) * down / up, np.arange(len(w)), line)
    assert np.allclose(waveform._fir_resample(w, target, source), want)


def test_one_bad_trace_costs_one_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def picky():
        def score(block):
            calls.add(1)
            if (block[:, 0, 0] == 77).any():
                raise RuntimeError("bad trace")
            return block[:, 0], block[:, 0]

        return score

    df = spark.range(0, 128, 1, 1).select("id", F.array(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("wf"))
    out = waveform.scored(df, "wf", picky, 4).collect()
    assert [r.id for r in out if r.score_status != "ok"] == [77] and all(r.p_curve == [r.id, 1.0] for r in out if r.id != 77)
    assert calls.value <= 2 * 8
    empty = spark.createDataFrame([(1, None), (2, [])], "id int, wf array<array<double>>")
    assert [r.score_status[:5] for r in waveform.scored(empty, "wf", picky, 4).collect()] == ["error", "error"]


def test_digests_add_up_and_tell_repeats(spark):
    rows = [(i % 3, f"t{i % 40}", None if i % 7 == 0 else "") for i in range(200)]
    frame = lambda x: spark.createDataFrame(x, "part int, a string, b string")
    digest = lambda states: profile.multiset_digest(states, []).first().digest
    whole = digest(profile.multiset_states(frame(rows), [], ["a", "b"]))
    parts = profile.multiset_states(frame(rows[::-1]).repartition(5), ["part"], ["a", "b"])
    assert digest(profile.merged_states(parts, [])) == whole
    for other in (rows + rows[:1], rows[1:], [(0, "t1", ""), *rows[1:]], [(p, a, "" if b is None else b) for p, a, b in rows], [(p, f"{a}|", b) for p, a, b in rows]):
        assert digest(profile.multiset_states(frame(other), [], ["a", "b"])) != whole

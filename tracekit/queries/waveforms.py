"""X1-X21, Y1 and Y2, on vectors of 64 samples as channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import waveform as W
from .base import query

C = F.col


def _text(w, scale: float = 1e6):
    """A whole array as one text of rounded numbers."""
    return F.array_join(F.transform(w, lambda x: F.bround(x * scale).cast("long").cast("string")), ",")


def _text_sql(w: str, scale: str = "1e6") -> str:
    return f"array_to_string([CAST(CAST(round_even(x * {scale}, 0) AS BIGINT) AS STRING) FOR x IN {w}], ',')"


def _drawn(seed: int, *parts: str, at: int = 0) -> str:
    """The uniform number of ``functions.waveform.hashed``."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), {8 * at + 1}, 8) AS BIGINT) + 0.5) / 4294967296.0)"


@query(f"SELECT vec_id, {_text_sql('c0')} AS a, {_text_sql('[0.0 FOR x IN c0]')} AS b, {_text_sql('c1')} AS turned, {_text_sql('c2')} AS third FROM {{fx_wave3}}")
def x1_three_channels(t):
    two = W.three_channels(F.array("c0", "c1"))
    turned = W.three_channels(F.zip_with("c0", F.arrays_zip("c1", "c2"), lambda x, y: F.array(x, y["c1"], y["c2"])))
    return t.fx_wave3.select("vec_id", _text(two[0]).alias("a"), _text(two[2]).alias("b"), _text(turned[1]).alias("turned"), _text(turned[2]).alias("third"))


#: The windowed-sinc filter of 40 to 100 Hz (five up, two down) and its output, sample by sample.
_BESSEL = "list_sum([pow(pow(({x}) / 2, k) / gamma(k + 1.0), 2) FOR k IN range(0, 40)])"
_TAPS = f"""taps AS (SELECT [5 * y / list_sum(ys) FOR y IN ys] AS h FROM (SELECT [(CASE WHEN t = 0 THEN 1.0 ELSE sin(pi() * t / 5) / (pi() * t / 5) END) * {_BESSEL.format(x="5 * sqrt(1 - pow(t / 50, 2))")} / {_BESSEL.format(x="5.0")} FOR t IN range(-50, 51)] AS ys))"""
_STRAIGHT = "({c}[1] + ({c}[64] - {c}[1]) * {k} / 63)"


def _resampled_sql(c: str) -> str:
    one = f"h[51 + 2 * m - 5 * k] * ({c}[k + 1] - {_STRAIGHT.format(c=c, k='k')})"
    return f"[list_sum([{one} FOR k IN range(greatest(0, CAST(ceil((2 * m - 50) / 5) AS BIGINT)), least(63, CAST(floor((2 * m + 50) / 5) AS BIGINT)) + 1)]) + {_STRAIGHT.format(c=c, k='least(2 * m / 5, 63)')} FOR m IN range(0, 160)]"


@query(f"WITH {_TAPS} SELECT vec_id, 160 AS n, {', '.join(f'{_text_sql(_resampled_sql(c))} AS {c}' for c in ('c0', 'c1', 'c2'))} FROM {{fx_wave3}}, taps")
def x2_resample(t):
    """Whole arrays against the sum over the filter."""
    df = t.fx_wave3.select("vec_id", F.array("c0", "c1", "c2").alias("wf"), F.lit(40.0).alias("rate"))
    out = W.resampled(df, "wf", "rate", 100.0)
    return out.select("vec_id", F.size(C("wf")[0]).alias("n"), *[_text(C("wf")[k]).alias(f"c{k}") for k in range(3)])


@query("""WITH s AS (SELECT vec_id, c0, pick, least(greatest(0, pick - 6), greatest(0, 64 - 20)) AS start FROM {fx_wave3})
SELECT vec_id, pick - start AS "offset", start, array_to_string([CAST(CAST(round_even(x * 1e6, 0) AS BIGINT) AS STRING) FOR x IN c0[start + 1:start + 20]], ',') AS w FROM s""")
def x3_anchored_window(t):
    out = W.anchored_window(C("c0"), C("pick"), 20)
    return t.fx_wave3.select("vec_id", out["offset"].cast("long").alias("offset"), out["start"].cast("long").alias("start"), _text(out["window"]).alias("w"))


def _padded(start: str, n: int) -> str:
    return f"array_to_string([CASE WHEN {start} + i < 0 OR {start} + i >= 64 THEN '0' ELSE CAST(CAST(round_even(c0[{start} + i + 1] * 1e6, 0) AS BIGINT) AS STRING) END FOR i IN range(0, {n})], ',')"


@query(f"SELECT vec_id, CASE WHEN 10 + vec_id % 7 + 9 >= 0 AND vec_id % 3 <> 0 AND 9 + 10 + vec_id % 7 < 30 THEN 9 + 10 + vec_id % 7 ELSE -1 END AS other, {_padded('(pick - 10 - vec_id % 7)', 30)} AS w FROM {{fx_wave3}}")
def x4_jittered_window(t):
    offset = (F.lit(10) + C("vec_id") % 7).cast("int")
    other = F.when(C("vec_id") % 3 != 0, C("pick") + 9)
    out = W.jittered_window(C("c0"), C("pick").cast("int"), other, offset, 30)
    return t.fx_wave3.select("vec_id", out["other"].cast("long").alias("other"), _text(out["window"]).alias("w"))


_IDX = """CASE WHEN pick - 20 + i < 0 THEN CASE WHEN pick = 0 THEN -1 ELSE i % pick END WHEN pick - 20 + i >= 64 THEN pick + (pick - 20 + i - 64) % (64 - pick) ELSE pick - 20 + i END"""


@query(f"SELECT vec_id, array_to_string([CASE WHEN k < 0 THEN '0' ELSE CAST(CAST(round_even(c0[k + 1] * 1e6, 0) AS BIGINT) AS STRING) END FOR k IN [{_IDX} FOR i IN range(0, 50)]], ',') AS w FROM {{fx_wave3}}")
def x5_noise_padded_window(t):
    return t.fx_wave3.select("vec_id", _text(W.noise_padded_window(C("c0"), C("pick").cast("int"), 50, 20)).alias("w"))


@query("SELECT vec_id, CASE WHEN pick - 30 >= 0 THEN array_to_string([CAST(CAST(round_even(x * 1e6, 0) AS BIGINT) AS STRING) FOR x IN c0[pick - 29:pick]], ',') END AS w FROM {fx_wave3}")
def x6_pre_event(t):
    held = W.pre_event(C("c0"), C("pick"), 10.0, 3.0, 30)
    return t.fx_wave3.select("vec_id", F.when(held.isNotNull(), _text(held)).alias("w"))


def _scaled(w: str, least: str) -> str:
    return f"[(x - list_avg({w})) / (CASE WHEN list_stddev_pop({w}) < {least} THEN 1 ELSE list_stddev_pop({w}) END) FOR x IN {w}]"


@query(f"SELECT vec_id, {_text_sql('[greatest(-10, least(10, y)) FOR y IN ' + _scaled('c0', '1e-6') + ']')} AS plain, {_text_sql('[greatest(-0.5, least(0.5, y)) FOR y IN ' + _scaled('c1', '1e-6') + ']')} AS tight FROM {{fx_wave3}}")
def x7_std_normalise(t):
    return t.fx_wave3.select("vec_id", _text(W.normalise(C("c0"))).alias("plain"), _text(W.normalise(C("c1"), clip=0.5)).alias("tight"))


_EVERY = "list_max([abs(x) FOR x IN list_concat(c0, list_concat(c1, c2))])"


@query(f"""SELECT vec_id, {_text_sql(_scaled('c0', '1e-10'))} AS zero, {_text_sql('[y / list_max([abs(z) FOR z IN c0]) FOR y IN c0]')} AS peak, {_text_sql(f'[y / {_EVERY} FOR y IN c0]')} AS global_peak FROM {{fx_wave3}}""")
def x7b_normalise_modes(t):
    every = W.normalise(C("c0"), "peak", peak=W.global_peak(F.array("c0", "c1", "c2")))
    return t.fx_wave3.select("vec_id", _text(W.normalise(C("c0"), "zero", 1e-10)).alias("zero"), _text(W.normalise(C("c0"), "peak")).alias("peak"), _text(every).alias("global_peak"))


def _db(c: str) -> str:
    return f"20 * log10(sqrt(list_avg([x * x FOR x IN {c}[pick + 1:least(64, pick + 20)]])) / sqrt(list_avg([x * x FOR x IN {c}[greatest(0, pick - 20) + 1:pick]])) + 1e-12)"


@query(f"SELECT vec_id, CASE WHEN pick > 0 THEN round(({_db('c0')} + {_db('c1')} + {_db('c2')}) / 3, 6) END AS snr FROM {{fx_wave3}}")
def x8_snr(t):
    return t.fx_wave3.select("vec_id", F.round(W.snr_db(F.array("c0", "c1", "c2"), C("pick").cast("int"), 20), 6).alias("snr"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'contains_nan' WHEN vec_id % 5 = 1 THEN 'too_many_zeros' WHEN vec_id % 5 = 2 THEN 'flat_component_1' END AS reason FROM {fx_wave3}")
def x9_quality(t):
    k = C("vec_id") % 5
    spoilt = F.when(k == 0, F.array_repeat(F.lit(float("nan")), 64)).when(k == 1, W.zeros(64)).when(k == 2, F.array_repeat(F.lit(1.0), 64)).otherwise(C("c1"))
    return t.fx_wave3.select("vec_id", W.quality(F.array("c0", spoilt, "c2"), C("pick").cast("int"), 30, 100).alias("reason"))


@query("SELECT vec_id, vec_id % 4 <> 0 AS fine FROM {fx_wave3}")
def x10_noise_gate(t):
    second = F.when(C("vec_id") % 4 == 0, W.zeros(64)).otherwise(C("c1"))
    return t.fx_wave3.select("vec_id", W.noise_gate(F.array("c0", second, "c2"), 60).alias("fine"))


@query("""WITH l AS (SELECT vec_id, [exp(-pow(i - pick, 2) / 200.0) FOR i IN range(0, 64)] AS a, [CASE WHEN vec_id % 3 = 0 THEN 0 ELSE exp(-pow(i - pick - 20, 2) / 200.0) END FOR i IN range(0, 64)] AS b FROM {fx_wave3})
SELECT vec_id, """ + f"""{_text_sql('a')} AS p, {_text_sql('b')} AS s, {_text_sql('[1 - greatest(a[i], b[i]) FOR i IN range(1, 65)]')} AS noise FROM l""")
def x11_gaussian_labels(t):
    out = W.gaussian_labels(64, C("pick"), F.when(C("vec_id") % 3 != 0, C("pick") + 20))
    return t.fx_wave3.select("vec_id", *[_text(out[f"{k}_label"]).alias(k) for k in ("p", "s", "noise")])


_GAIN = f"(0.5 + 1.5 * {_drawn(7, repr('gain'), 'vec_id')}) * CASE WHEN {_drawn(7, repr('flip'), 'vec_id')} < 0.1 THEN -1 ELSE 1 END * CASE WHEN {_drawn(7, repr('mask'), 'vec_id')} < 0.2 THEN 0 ELSE 1 END"
_NORMAL = f"sqrt(-2 * ln({_drawn(7, repr('n'), 'i', 'vec_id')})) * cos(2 * pi() * {_drawn(7, repr('n'), 'i', 'vec_id', at=1)})"


@query(f"SELECT vec_id, {_text_sql(f'[c0[i + 1] * {_GAIN} + {_NORMAL} * 0.1 FOR i IN range(0, 64)]', '1e5')} AS noisy, {_text_sql(f'[y * {_GAIN} FOR y IN c0]', '1e5')} AS plain FROM {{fx_wave3}}")
def x12_augmentation(t):
    """Gains, flips, masks and noise at 20 dB."""
    noisy, plain = (W.augmented(C("c0"), 7, C("vec_id"), noise_db=db, mask=0.2) for db in (20.0, None))
    return t.fx_wave3.select("vec_id", _text(noisy, 1e5).alias("noisy"), _text(plain, 1e5).alias("plain"))


_HELD = "list_slice(curve, greatest(0, pick - 10) + 1, least(64, pick + 10))"


@query(f"SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE list_max({_HELD}) END AS prob, CASE WHEN vec_id % 10 <> 0 THEN (list_position({_HELD}, list_max({_HELD})) - 1 + greatest(0, pick - 10) - pick) / 100 END AS residual_s FROM (SELECT vec_id, pick, [abs(x) FOR x IN c0] AS curve FROM {{fx_wave3}})")
def x13_oracle_pick(t):
    true = F.when(C("vec_id") % 10 == 0, -1).otherwise(C("pick").cast("int"))
    out = W.oracle_pick(F.transform("c0", lambda x: F.abs(x)), true, 10)
    return t.fx_wave3.select("vec_id", *[c.alias(k) for k, c in out.items()])


@query("SELECT vec_id, array_to_string([CAST(CAST(round_even((c0[i] + 2 * c1[i] + 3 * c2[i]) / 6 * 1e4, 0) AS BIGINT) AS STRING) FOR i IN range(1, 65)], ',') AS curve FROM {fx_wave3}")
def x14_curve_ensemble(t):
    members = t.fx_wave3.select("vec_id", F.inline(F.array(*[F.struct(F.lit(float(k + 1)).alias("weight"), C(f"c{k}").alias("curve")) for k in range(3)])))
    out = W.ensemble(members, ["vec_id"], "curve", "weight")
    return out.select("vec_id", F.array_join(F.transform("curve", lambda x: F.bround(x * 1e4).cast("long").cast("string")), ",").alias("curve"))


@query("SELECT vec_id, list_max(c0) AS top FROM {fx_wave3}")
def x15_max_score(t):
    return t.fx_wave3.select("vec_id", F.array_max("c0").alias("top"))


@query("SELECT vec_id, CASE WHEN list_max(c1) > 0.1 AND list_max(c0) > 0.25 THEN list_position(c0, list_max(c0)) - list_position(c1, list_max(c1)) END AS residual FROM {fx_wave3}")
def x16_threshold_residual(t):
    return t.fx_wave3.select("vec_id", W.threshold_residual(C("c0"), C("c1"), 0.25).cast("long").alias("residual"))


@query("SELECT vec_id, round(list_sum([abs(c0[i + 1]) * i FOR i IN range(0, 64)]) / list_sum([abs(x) FOR x IN c0]), 6) AS position FROM {fx_wave3}")
def x17_soft_argmax(t):
    return t.fx_wave3.select("vec_id", F.round(W.soft_argmax(F.transform("c0", lambda x: F.abs(x))), 6).alias("position"))


@query("SELECT vec_id, c0[pick + 1] AS p, CASE WHEN pick + 30 < 64 THEN c1[pick + 31] END AS s FROM {fx_wave3}")
def x18_at_position(t):
    return t.fx_wave3.select("vec_id", F.get("c0", "pick").alias("p"), F.get("c1", C("pick") + 30).alias("s"))


@query("SELECT vec_id, array_to_string([CAST(CAST(round_even(x * 1e6, 0) AS BIGINT) AS STRING) FOR x IN c0[greatest(0, pick - 8) + 1:least(64, pick + 24)]], ',') AS w FROM {fx_wave3}")
def x19_snippet(t):
    return t.fx_wave3.select("vec_id", _text(W.snippet(C("c0"), C("pick").cast("int"), 8, 24)).alias("w"))


@query(f"SELECT vec_id, {_text_sql('c0[start + 1:start + 40]')} AS crop, {_text_sql('list_concat(c0, [0.0 FOR i IN range(0, 16)])')} AS padded FROM (SELECT vec_id, c0, CAST(floor({_drawn(3, 'vec_id')} * 25) AS BIGINT) AS start FROM {{fx_wave3}})")
def x20_noise_crop(t):
    return t.fx_wave3.select("vec_id", _text(W.noise_crop(C("c0"), 40, 3, C("vec_id"))).alias("crop"), _text(W.noise_crop(C("c0"), 80, 3, C("vec_id"))).alias("padded"))


@query(f"SELECT vec_id, vec_id % 3 <> 0 AS fetch_ok, {_text_sql('CASE WHEN vec_id % 3 <> 0 THEN list_concat(c0, list_concat(c1, c2)) ELSE [0.0 FOR i IN range(0, 192)] END')} AS wf FROM {{fx_wave3}}")
def x21_fetch_fallback(t):
    df = t.fx_wave3
    found = df.where("vec_id % 3 <> 0").select("vec_id", F.array("c0", "c1", "c2").alias("wf"))
    return W.with_fallback(df.select("vec_id"), found, ["vec_id"], 64).select("vec_id", "fetch_ok", _text(F.flatten("wf")).alias("wf"))


def _energy():
    return lambda block: (np.abs(block[:, 0]), np.abs(block[:, 1]))


def _picky():
    def score(block):
        if (block[:, 0, 0] > 0.125).any():
            raise ValueError("bad trace")
        return block[:, 2], -block[:, 0]

    return score


def _absent():
    raise FileNotFoundError("no weights")


@query(f"""WITH w AS (SELECT *, c0[1] > 0.125 AS bad FROM {{fx_wave3}})
SELECT vec_id, 'energy' AS scorer, 'ok' AS score_status, {_text_sql('[abs(x) FOR x IN c0]')} AS p, {_text_sql('[abs(x) FOR x IN c1]')} AS s FROM w
UNION ALL SELECT vec_id, 'picky', CASE WHEN bad THEN 'error: bad trace' ELSE 'ok' END, CASE WHEN NOT bad THEN {_text_sql('c2')} END, CASE WHEN NOT bad THEN {_text_sql('[-x FOR x IN c0]')} END FROM w
UNION ALL SELECT vec_id, 'absent', 'error: no weights', NULL, NULL FROM w""")
def y1_batch_scoring(t):
    """Three scorers: one that fails on single traces, which alone lose their curves, and one that cannot be made."""
    df = t.fx_wave3.select("vec_id", F.array("c0", "c1", "c2").alias("wf"))
    out = W.scored(df, "wf", {"energy": _energy, "picky": _picky, "absent": _absent}, 100)
    return out.select("vec_id", "scorer", "score_status", *[_text(C(f"{x}_curve").cast("array<double>")).alias(x) for x in "ps"])


@query("SELECT event_type, max(value) - min(value) AS statistic FROM events GROUP BY event_type")
def y2_grouped_statistic(t):
    return W.merged_statistic(t.events, ["event_type"], "value", lambda x: [x.max(), x.min()], lambda s: [s[:, 0].max(), s[:, 1].min()], lambda s: s[0] - s[1])

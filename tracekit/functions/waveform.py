"""Array expressions on waveforms and score curves. A channel is array<double>, a waveform an array of channels."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = "array<double>"
Scorer = Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(n))


def cut(w: Column, start: Column, length: Column | int) -> Column:
    """``length`` samples from position ``start`` (0 or more)."""
    return F.slice(w, (start + 1).cast("int"), (length if isinstance(length, Column) else F.lit(length)).cast("int"))


def total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x)


def mean(w: Column) -> Column:
    return total(w) / F.nullif(F.size(w), F.lit(0))


def variance(w: Column) -> Column:
    """Population variance."""
    return F.transform(F.array(mean(w)), lambda m: mean(F.transform(w, lambda x: (x - m) * (x - m))))[0]


def each(wf: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(wf, f)


def three_channels(wf: Column) -> Column:
    """(3, N) from (1, N) by replication, (N, 3) by transposition, more channels by trimming, fewer by zero channels."""
    turned = F.when((F.size(wf) != 3) & (F.size(wf[0]) == 3), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.transform(wf, lambda row: F.get(row, k)))).otherwise(wf)
    filled = F.concat(F.slice(turned, 1, 3), F.array_repeat(zeros(F.size(turned[0])), F.greatest(F.lit(0), 3 - F.size(turned))))
    return F.when(F.size(wf) == 1, F.array_repeat(wf[0], 3)).otherwise(filled)


def anchored_window(w: Column, pick: Column, length: int, share: float = 0.3) -> dict[str, Column]:
    """Window with the pick at ``share`` of its length, clamped to the trace and zero-padded on the right."""
    n, at = F.size(w), F.bround(pick).cast("int")
    start = F.least(F.greatest(F.lit(0), at - int(share * length)), F.greatest(F.lit(0), n - length))
    held = cut(w, start, F.least(F.lit(length), n - start))
    return {"window": F.concat(held, zeros(F.lit(length) - F.size(held))), "offset": at - start, "start": start}


def window_at(w: Column, start: Column, length: int) -> Column:
    """``length`` samples from any start, zero-padded on both sides."""
    left = F.least(F.lit(length), F.greatest(F.lit(0), -start))
    held = cut(w, F.greatest(F.lit(0), start), F.greatest(F.lit(0), F.least(start + length, F.size(w)) - F.greatest(F.lit(0), start)))
    return F.concat(zeros(left.cast("int")), held, zeros(F.greatest(F.lit(0), F.lit(length) - left - F.size(held)).cast("int")))


def jittered_window(w: Column, anchor: Column, other: Column, offset: Column, length: int) -> dict[str, Column]:
    """Window with the anchor at a drawn offset; the other pick's place, or -1 where absent or outside."""
    start = anchor - offset
    place = F.bround(other).cast("int") - start
    return {"window": window_at(w, start, length), "anchor": offset, "other": F.when(other.isNotNull() & (place >= 0) & (place < length), place).otherwise(-1)}


def tiled(segment: Column, length: Column) -> Column:
    """The segment repeated to a length; zeros if it is empty."""
    n = F.size(segment)
    turns = F.greatest(F.lit(1), F.ceil(length / F.greatest(n, F.lit(1)))).cast("int")
    return F.when(n == 0, zeros(length.cast("int"))).otherwise(F.slice(F.flatten(F.array_repeat(segment, turns)), F.lit(1), length.cast("int")))


def noise_padded_window(w: Column, pick: Column, length: int, offset: int) -> Column:
    """Window with the pick at a fixed offset; missing sides are tiled from the trace before and after the pick."""
    n, start = F.size(w), pick - offset
    end = start + length
    left, right = F.greatest(F.lit(0), -start), F.greatest(F.lit(0), end - n)
    before = cut(w, F.greatest(F.lit(0), start), F.greatest(F.lit(0), pick - F.greatest(F.lit(0), start)))
    middle = cut(w, F.greatest(F.lit(0), start), F.least(n, end) - F.greatest(F.lit(0), start))
    after = cut(w, pick, F.greatest(F.lit(0), F.least(n, end) - pick))
    padded = F.concat(F.when(left > 0, tiled(before, left)).otherwise(F.array().cast(ZERO)), middle, F.when(right > 0, tiled(after, right)).otherwise(F.array().cast(ZERO)))
    return F.slice(padded, 1, length)


def pre_event(w: Column, pick: Column, rate: float, seconds: float, least: int, flat: float = 1e-8) -> Column:
    """The ``seconds`` before the pick; null where the trace does not hold them or they are short or flat."""
    start = F.floor(pick - seconds * rate).cast("int")
    held = cut(w, start, F.floor(pick).cast("int") - start)
    fine = (start >= 0) & (pick <= F.size(w))
    return F.when(fine, F.when((F.size(held) >= least) & (F.sqrt(variance(held)) >= flat), held))


def normalise(w: Column, mode: str = "std", eps: float = 1e-6, clip: float | None = 10.0, peak: Column | None = None) -> Column:
    """``std``: demean, divide by the population deviation (1 where it is below eps), clip. ``zero``: as std without clipping, zeros where
    flat. ``peak``: divide by the largest absolute value of the channel, or of ``peak`` for all channels."""
    if mode == "peak":
        top = peak if peak is not None else F.array_max(F.transform(w, lambda x: F.abs(x)))
        return F.transform(F.array(top), lambda t: F.transform(w, lambda x: F.when(t > eps, x / t).otherwise(x)))[0]
    stats = F.array(F.struct(mean(w).alias("m"), F.sqrt(variance(w)).alias("s")))
    if mode == "zero":
        scaled = lambda x, s: F.when(s["s"] > eps, (x - s["m"]) / s["s"]).otherwise(0.0)
    else:
        scaled = lambda x, s: (x - s["m"]) / F.when(s["s"] < eps, 1.0).otherwise(s["s"])
    limited = (lambda y: F.greatest(F.lit(-clip), F.least(F.lit(clip), y))) if clip and mode == "std" else (lambda y: y)
    return F.transform(stats, lambda s: F.transform(w, lambda x: limited(scaled(x, s))))[0]


def global_peak(wf: Column) -> Column:
    return F.array_max(F.transform(wf, lambda w: F.array_max(F.transform(w, lambda x: F.abs(x)))))


def rms(w: Column) -> Column:
    return F.sqrt(mean(F.transform(w, lambda x: x * x)))


def snr_db(wf: Column, pick: Column, span: int = 200) -> Column:
    """Mean over channels of the RMS ratio after and before the pick, in dB; null without samples on either side."""
    low = F.greatest(F.lit(0), pick - span)

    def channel(w):
        noise, signal = rms(cut(w, low, pick - low)), rms(cut(w, pick, F.least(F.size(w), pick + span) - pick))
        return F.when(noise > 1e-12, 20 * F.log10(signal / noise + 1e-12))

    each_db = F.filter(F.transform(wf, channel), lambda x: x.isNotNull())
    return F.when((pick > 0) & (pick < F.size(wf[0])) & (F.size(each_db) > 0), mean(each_db))


def quality(wf: Column, pick: Column, before: int = 300, after: int = 1000, nonzero: float = 0.8) -> Column:
    """Reason why a window fails, or null: NaN, too few non-zero samples around the pick, or a flat channel."""
    low = F.when(pick >= 0, F.greatest(F.lit(0), pick - before)).otherwise(0)
    high = F.when(pick >= 0, F.least(F.size(wf[0]), pick + after)).otherwise(F.size(wf[0]))
    around = F.flatten(F.transform(wf, lambda w: cut(w, low, high - low)))
    flat = F.transform(wf, lambda w: F.sqrt(variance(w)) < 1e-12)
    return (
        F.when(F.exists(F.flatten(wf), lambda x: F.isnan(x)), "contains_nan")
        .when(F.size(F.filter(around, lambda x: x != 0)) / F.size(around) < nonzero, "too_many_zeros")
        .when(F.array_position(flat, True) > 0, F.concat(F.lit("flat_component_"), F.array_position(flat, True) - 1))
    )


def noise_gate(wf: Column, least: int, flat: float = 1e-8) -> Column:
    return (F.size(wf[0]) >= least) & ~F.exists(wf, lambda w: F.sqrt(variance(w)) < flat)


def gaussian_labels(length: int, p: Column, s: Column, sigma: float = 10.0) -> dict[str, Column]:
    """P and S curves and noise = 1 - max; a missing pick has a curve of zeros."""
    curve = lambda c: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(c.isNull(), 0.0).otherwise(F.exp(-F.pow((i - c).cast("double"), F.lit(2.0)) / (2 * sigma * sigma))))
    a, b = curve(p), curve(s)
    return {"p_label": a, "s_label": b, "noise_label": F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(x, y))))}


def hashed(seed: int, *parts, at: int = 0) -> Column:
    """Uniform number in (0, 1) from eight digits of an MD5, which any engine can repeat; ``at`` picks one of four."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 8 * at + 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)


def augmented(w: Column, seed: int, *key: Column, flip: float = 0.1, noise_db: float | None = None, mask: float = 0.0) -> Column:
    """Gain in [0.5, 2), a sign flip with chance ``flip``, Gaussian noise (Box-Muller on hashes) at an SNR, all zeros with chance ``mask``."""
    gain = (0.5 + 1.5 * hashed(seed, F.lit("gain"), *key)) * F.when(hashed(seed, F.lit("flip"), *key) < flip, -1.0).otherwise(1.0) * F.when(hashed(seed, F.lit("mask"), *key) < mask, 0.0).otherwise(1.0)
    if noise_db is None:
        return F.transform(F.array(gain), lambda g: F.transform(w, lambda x: x * g))[0]
    normal = lambda i: F.sqrt(-2 * F.log(hashed(seed, F.lit("n"), i, *key))) * F.cos(2 * np.pi * hashed(seed, F.lit("n"), i, *key, at=1))
    return F.transform(F.array(gain), lambda g: F.transform(w, lambda x, i: x * g + normal(i) * 10 ** (-noise_db / 20)))[0]


def oracle_pick(curve: Column, true: Column, span: int, rate: float = 100.0) -> dict[str, Column]:
    """Peak within ``span`` samples of the true pick (the first one at ties): probability and residual; 0 and null without a pick."""
    low = F.greatest(F.lit(0), true - span)
    held = cut(curve, low, F.least(F.size(curve), true + span) - low)
    top = F.array_max(held)
    return {"prob": F.when(true >= 0, top).otherwise(0.0), "residual_s": F.when(true >= 0, (F.array_position(held, top) - 1 + low - true) / rate)}


def ensemble(members: DataFrame, keys: list[str], curve: str, weight: str) -> DataFrame:
    """Weighted mean of the member curves of each key, position by position, for any number of members."""
    long = members.select(*keys, F.col(weight).alias("_w"), F.posexplode(curve).alias("_pos", "_v"))
    points = long.groupBy(*keys, "_pos").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_m"))
    return points.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias(curve))


def blend(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)


def argmax(w: Column) -> Column:
    return F.array_position(w, F.array_max(w)) - 1


def threshold_residual(predicted: Column, label: Column, confident: float = 0.3, present: float = 0.1) -> Column:
    """Predicted minus labelled peak position where both peaks pass their thresholds."""
    return F.when((F.array_max(label) > present) & (F.array_max(predicted) > confident), argmax(predicted) - argmax(label))


def soft_argmax(w: Column) -> Column:
    weighted = F.aggregate(F.transform(w, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return weighted / F.nullif(total(w), F.lit(0.0))


def snippet(w: Column, pick: Column, before: int = 200, after: int = 800) -> Column:
    low = F.greatest(F.lit(0), pick - before)
    return cut(w, low, F.least(F.size(w), pick + after) - low)


def noise_crop(w: Column, length: int, seed: int, *key: Column) -> Column:
    """A window at a hashed place, or the whole trace with zeros behind it."""
    room = F.greatest(F.lit(0), F.size(w) - length)
    return window_at(w, F.floor(hashed(seed, *key) * (room + 1)).cast("int"), length)


def with_fallback(df: DataFrame, waveforms: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Left join of waveforms; a missing one becomes zeros and is marked by fetch_ok = false."""
    joined = df.join(waveforms.select(*keys, F.col("wf")), keys, "left")
    return joined.withColumn("fetch_ok", F.col("wf").isNotNull()).withColumn("wf", F.coalesce("wf", F.array_repeat(zeros(length), 3)))


# --- numpy in Arrow batches: what array expressions cannot say ------------------------------------------------------------


@functools.lru_cache(maxsize=64)
def _filter_bank(up: int, down: int) -> tuple[np.ndarray, int]:
    """One row of taps for each phase, and how many samples before an output the first one is."""
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    reach = half // up + 1
    at = half + np.arange(up)[:, None] + up * np.arange(reach, -reach - 1, -1)[None, :]  # of sample base - reach .. base + reach
    return np.where((at >= 0) & (at < len(taps)), taps[np.clip(at, 0, len(taps) - 1)], 0.0), reach


def _fir_resample(w: np.ndarray, up: int, down: int) -> np.ndarray:
    """Windowed-sinc polyphase resampling: output m takes the phase ``m * down mod up`` of the filter and the samples around
    ``m * down / up``, and no others are computed. The straight line through the ends is taken out before and put back after."""
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    n = len(w)
    if up == down or n == 0:
        return w
    bank, reach = _filter_bank(up, down)
    line = np.linspace(w[0], w[-1], n)
    padded = np.concatenate([np.zeros(reach), w - line, np.zeros(reach + 1)])
    size = -(-n * up // down)
    base, phase = np.divmod(np.arange(size, dtype=np.int64) * down, up)
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    out = np.empty(size)
    for p in np.unique(phase):  # a product of a view and one row of taps each
        own = phase == p
        out[own] = around[base[own]] @ bank[p]
    return out + np.interp(np.arange(size) * down / up, np.arange(n), line)


def _fft_resample(w: np.ndarray, size: int) -> np.ndarray:
    n = len(w)
    if n == 0 or size == n:
        return w
    spectrum, keep = np.fft.rfft(w), min(n, size)
    out = np.zeros(size // 2 + 1, complex)
    out[: keep // 2 + 1] = spectrum[: keep // 2 + 1]
    if keep % 2 == 0 and n != size:
        out[keep // 2] *= 0.5 if size > n else 2.0
    return np.fft.irfft(out, size) * (size / n)


#: Rows that are resampled at once; an Arrow batch holds up to ten thousand.
SLICE = 500


def resampled(df: DataFrame, wf: str, rate: str, target: float, method: str = "polyphase") -> DataFrame:
    """Channels at the target rate; equal rates (within 0.5) pass through. Rows and other columns stay as they are."""

    def one(w, r):
        w = np.asarray(w, float)
        if r is None or not r > 0 or abs(r - target) < 0.5:
            return w
        return _fir_resample(w, round(target), round(r)) if method == "polyphase" else _fft_resample(w, int(len(w) * target / r))

    def run(frames):
        for whole in frames:
            for at in range(0, len(whole), SLICE):
                pdf = whole.iloc[at : at + SLICE].copy()
                pdf[wf] = [None if x is None else [one(w, r).tolist() for w in x] for x, r in zip(pdf[wf], pdf[rate], strict=True)]
                yield pdf

    return df.mapInPandas(run, df.schema)


def scored(df: DataFrame, wf: str, scorer: Scorer | dict[str, Scorer], length: int, batch: int = 128) -> DataFrame:
    """Adds p_curve, s_curve and score_status from a scorer (B, C, T) -> two (B, T) arrays; of several scorers by name, a row each and
    the name as ``scorer``.

    A scorer is a factory called once a task. Short inputs are zero-padded on the right and outputs cut to their length. A batch that
    fails is halved until the trace that fails is alone: it gets null curves and the error as its status, all others their scores. A
    scorer that cannot be made, or whose output has another shape, fails for its own rows only; the job goes on.
    """
    several = isinstance(scorer, dict)
    makers = scorer if several else {"": scorer}
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def attempt(score, block: np.ndarray) -> list[tuple]:
        """(p, s, status) of each trace."""
        try:
            p, s = (np.asarray(x) for x in score(block))
            if p.shape != (len(block), length) or s.shape != p.shape:
                raise ValueError(f"curves of shape {p.shape} and {s.shape}")
            return [(p[i], s[i], "ok") for i in range(len(block))]
        except Exception as error:  # a scorer is foreign code
            if len(block) == 1:
                return [(None, None, f"error: {error}"[:200])]
            half = len(block) // 2
            return attempt(score, block[:half]) + attempt(score, block[half:])

    def run(frames):
        made = {}
        for name, maker in makers.items():
            try:
                made[name] = maker()
            except Exception as error:  # likewise
                made[name] = str(error)
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                sizes = [0 if x is None or not len(x) else min(length, len(x[0])) for x in part[wf]]
                block = np.zeros((len(part), max((0 if x is None else len(x) for x in part[wf]), default=0), length), np.float32)
                for i, x in enumerate(part[wf]):
                    for k, w in enumerate([] if x is None else x):
                        block[i, k, : sizes[i]] = np.asarray(w, np.float32)[: sizes[i]]
                for name, score in made.items():
                    found = [(None, None, f"error: {score}"[:200])] * len(part) if isinstance(score, str) else attempt(score, block)
                    out = part.copy()
                    if several:
                        out["scorer"] = name
                    for k, column in enumerate(("p_curve", "s_curve")):
                        out[column] = [None if f[k] is None else f[k][:n].tolist() for f, n in zip(found, sizes, strict=True)]
                    out["score_status"] = [f[2] for f in found]
                    yield out

    named = ", scorer string" if several else ""
    return df.mapInPandas(run, f"{kept}{named}, p_curve array<float>, s_curve array<float>, score_status string")


def grouped_statistic(df: DataFrame, by: list[str], value: str, statistic: Callable[[np.ndarray], float]) -> DataFrame:
    """Any statistic of a group's values, for groups that fit a task; means and medians have built-in forms."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    return df.select(*by, value).groupBy(*by).applyInPandas(lambda pdf: pdf.iloc[:1][by].assign(statistic=float(statistic(pdf[value].dropna().to_numpy()))), f"{kinds}, statistic double")


def merged_statistic(df: DataFrame, by: list[str], value: str, partial: Callable[[np.ndarray], list[float]], merge: Callable[[np.ndarray], list[float]], finish: Callable[[np.ndarray], float]) -> DataFrame:
    """A statistic of groups of any size: ``partial`` makes a state of some values, ``merge`` one of several (as rows), ``finish`` the result.

    A task keeps one state for each group it meets; only states are shuffled. A group without values gets null.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def states(frames):
        held: dict[tuple, list[float] | None] = {}
        for pdf in frames:
            for group, part in pdf.groupby(by, sort=False, dropna=False):
                values, old = part[value].dropna().to_numpy(), held.setdefault(group, None)
                if len(values):
                    new = list(partial(values))
                    held[group] = new if old is None else list(merge(np.array([old, new])))
        if held:
            yield pd.DataFrame([[*g, s] for g, s in held.items()], columns=[*by, "_state"])

    def result(pdf):
        found = [s for s in pdf["_state"] if s is not None]
        return pdf.iloc[:1][by].assign(statistic=float(finish(np.array(merge(np.array([list(s) for s in found]))))) if found else None)

    parts = df.select(*by, value).mapInPandas(states, f"{kinds}, _state array<double>")
    return parts.groupBy(*by).applyInPandas(result, f"{kinds}, statistic double")

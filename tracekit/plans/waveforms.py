"""Waveform preparation: channels, rate, window, checks and normalisation as one job with a processing index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W
from ..operators import joins
from ..sources.scratch import checkpointed


def prepare_waveforms(manifest: DataFrame, waveforms: DataFrame, keys: list[str], length: int, rate: float, before: int, after: int, snr_span: int) -> tuple[DataFrame, DataFrame]:
    """(prepared windows, processing index).

    ``manifest(keys, pick)`` with the pick in samples of the raw trace, ``waveforms(keys, wf, rate)``. Windows hold wf (normalised),
    offset (of the pick) and snr_db. The index has every manifest row with status ok or skipped and the first reason:
    missing_waveform, wrong_rate, then what ``quality`` finds in the raw trace. Only traces at another rate visit Python.
    """
    held = manifest.select(*keys, "pick").join(waveforms.select(*keys, "wf", F.col("rate").cast("double").alias("rate")), keys, "left")
    ready = held.where(F.col("wf").isNotNull() & (F.col("rate") > 0)).withColumn("wf", W.three_channels(F.col("wf")))
    same = F.abs(F.col("rate") - rate) < 0.5
    moved = W.resampled(ready.where(~same), "wf", "rate", rate).withColumn("pick", F.bround(F.col("pick") * rate / F.col("rate")).cast("int"))
    both = ready.where(same).withColumn("pick", F.col("pick").cast("int")).unionByName(moved)
    checked = checkpointed(both.withColumn("why", W.quality(F.col("wf"), F.col("pick"), before, after)))
    fine = checked.where("why IS NULL")
    windows = F.transform("wf", lambda w: W.normalise(W.anchored_window(w, F.col("pick"), length)["window"]))
    prepared = fine.select(*keys, windows.alias("wf"), W.anchored_window(F.col("wf")[0], F.col("pick"), length)["offset"].alias("offset"), W.snr_db(F.col("wf"), F.col("pick"), snr_span).alias("snr_db"))
    reasons = checked.where("why IS NOT NULL").select(*keys, F.col("why").alias("skip_reason"))
    absent = held.where("wf IS NULL").select(*keys, F.lit("missing_waveform").alias("skip_reason"))
    unrated = held.where("wf IS NOT NULL AND (rate IS NULL OR rate <= 0)").select(*keys, F.lit("wrong_rate").alias("skip_reason"))
    index = joins.processing_index(manifest.select(*keys), fine.select(*keys).withColumn("status", F.lit("ok")), reasons.union(absent).union(unrated), keys)
    return prepared, index

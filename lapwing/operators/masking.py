"""Masking analysis of spectra: Bark bands, masker spread, peak envelopes, temporal masking, partition weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.signal import ENERGY_FLOOR, LADDER_LOW, NOISE_OFFSET, RATIO_CAP, SPREAD_DOWN, SPREAD_UP, bark, bin_hz, lit, quiet_threshold
from lapwing.operators import scan


def band_of(bins: DataFrame, half: int, rate: float) -> DataFrame:
    """bins (frame, k, x) with hz, z (Bark) and band."""
    placed = bins.withColumn("hz", bin_hz(F.col("k"), half, rate))
    placed = placed.withColumn("z", F.greatest(bark(F.col("hz")), lit(0)))
    return placed.withColumn("band", F.floor("z").cast("int"))


def bands(bins: DataFrame, half: int, rate: float, full_scale: float = 96.0) -> DataFrame:
    """(frame, band, energy, n, tonality, centre, level_db, masker_db): tonality is how far from flat a band is, 0 to 1."""
    e = F.greatest(F.col("x") * F.col("x"), lit(ENERGY_FLOOR))
    of = band_of(bins, half, rate).withColumn("e", e).groupBy("frame", "band").agg(F.sum("e").alias("energy"), F.avg(F.ln("e")).alias("log_mean"), F.count("*").alias("n"), ((F.min("z") + F.max("z")) / 2).alias("centre"))
    flatness = lit(10) * F.log10(F.exp("log_mean") / (F.col("energy") / F.col("n")))
    tonality = F.when(F.col("energy") <= lit(ENERGY_FLOOR) * F.col("n"), lit(0)).otherwise(F.least(F.greatest(flatness / lit(-60), lit(0)), lit(1)))
    of = of.withColumn("tonality", tonality).withColumn("level_db", lit(full_scale) + lit(10) * F.log10("energy"))
    offset = F.col("tonality") * (lit(14.5) + F.col("centre")) + (lit(1) - F.col("tonality")) * lit(NOISE_OFFSET)
    return of.withColumn("masker_db", F.col("level_db") - offset)


def thresholds(bins: DataFrame, half: int, rate: float, full_scale: float = 96.0, offset_db: float = 0.0) -> DataFrame:
    """(frame, k, threshold): the loudest of the frame's maskers, spread over Bark, and the threshold in quiet, as amplitude."""
    placed = band_of(bins, half, rate).select("frame", "k", "hz", "z")
    maskers = bands(bins, half, rate, full_scale).select("frame", "centre", "masker_db")
    apart = F.col("z") - F.col("centre")
    spread = F.when(apart >= 0, lit(-SPREAD_UP) * apart).otherwise(lit(SPREAD_DOWN) * apart)
    masked = placed.join(maskers, "frame").groupBy("frame", "k", "hz").agg(F.max(F.col("masker_db") + spread).alias("masked"))
    db = F.greatest("masked", quiet_threshold(F.col("hz"))) - lit(offset_db)
    return masked.select("frame", "k", F.greatest(F.pow(lit(10), (db - lit(full_scale)) / lit(20)), lit(1.1754943508222875e-38)).alias("threshold"))


def peak_envelope(rows: DataFrame, key: str, order: str, radius: int, floor: float = LADDER_LOW) -> DataFrame:
    """rows with peak: the largest |x| within radius places, at least floor. order numbers a key's rows 0, 1, 2 ..."""
    held = scan.sliding_maximum(rows, key, order, F.abs("x"), radius, "peak")
    return held.withColumn("peak", F.greatest("peak", lit(floor)))


def floor_envelope(bins: DataFrame, masked: DataFrame, radius: int) -> DataFrame:
    """(frame, k, envelope) of bins (frame, k, x) and thresholds (frame, k, threshold): the largest |x| within radius bins or the threshold, within the ladder.

    A bin without a threshold counts by its peak; a frame with a bin that isn't finite has no envelope.
    """
    finite = bins.groupBy("frame").agg(F.bool_and(F.coalesce(F.abs("x") < lit(float("inf")), F.lit(False))).alias("_finite")).where("_finite").select("frame")
    held = scan.sliding_maximum(bins.join(finite, "frame"), "frame", "k", F.abs("x"), radius, "peak").join(masked, ["frame", "k"], "left")
    return held.select("frame", "k", F.least(F.greatest("peak", F.coalesce("threshold", lit(0)), lit(LADDER_LOW)), lit(1)).alias("envelope"))


def temporal_masking(rows: DataFrame, key: str, order: str, post: float, pre: float) -> DataFrame:
    """rows (key, order, t) with effective: t or the next t times pre, and before that what still lasts of earlier ones,
    times post for each step. order numbers a key's rows 0, 1, 2 ...; no task holds a key."""
    return scan.decaying_maximum(rows, key, order, "t", post, pre, "effective")


def partition_weights(floors: DataFrame, masked: DataFrame, size: int) -> DataFrame:
    """(frame, part, weight): the mean of min((floor / threshold)^2, cap) over partitions of `size` bins; floors has (frame, k, floor)."""
    ratio = F.col("floor") / F.col("threshold")
    return floors.join(masked, ["frame", "k"]).groupBy("frame", F.floor(F.col("k") / size).alias("part")).agg(F.avg(F.least(ratio * ratio, lit(RATIO_CAP))).alias("weight"))

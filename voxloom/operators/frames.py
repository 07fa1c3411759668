"""Time series of audio features: frames series_id, frame_idx, t, energy (flux and others), and spans series_id, start, stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOP = 0.01


def _order(by: str = "frame_idx") -> Window:
    return Window.partitionBy("series_id").orderBy(by)


def islands(rows: DataFrame, new: Column, by: str) -> DataFrame:
    """Numbers runs of rows; a run begins where ``new`` holds."""
    return rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(_order(by).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def activity(frames: DataFrame, factor: float = 1.5) -> DataFrame:
    """Frames with their activity: energy over 1.5 times the series' median."""
    limits = frames.groupBy("series_id").agg((F.median("energy") * factor).alias("limit"))
    return frames.join(limits, "series_id").withColumn("active", F.col("energy") > F.col("limit")).drop("limit")


def active_spans(frames: DataFrame) -> DataFrame:
    """Runs of active frames as spans."""
    active = activity(frames).where("active")
    runs = islands(active, F.col("frame_idx") != F.lag("frame_idx").over(_order()) + 1, "frame_idx")
    return runs.groupBy("series_id", "island").agg(F.round(F.min("t"), 3).alias("start"), F.round(F.max("t") + HOP, 3).alias("stop"), F.count("*").alias("n")).drop("island")


def signal_to_noise(frames: DataFrame) -> DataFrame:
    """Ten times the logarithm of mean active over mean other energy, 0 to 40, and a score of five times that, 100 at most."""
    means = activity(frames).groupBy("series_id").agg(F.avg(F.when(F.col("active"), F.col("energy"))).alias("a"), F.avg(F.when(~F.col("active"), F.col("energy"))).alias("b"))
    value = F.greatest(F.least(10 * F.log10(F.coalesce("a", F.lit(1e-10)) / F.greatest(F.coalesce("b", F.lit(1e-10)), F.lit(1e-10))), F.lit(40.0)), F.lit(0.0))
    return means.select("series_id", F.round(value, 6).alias("snr"), F.round(F.least(value * 5, F.lit(100.0)), 6).alias("score"))


def clipping(frames: DataFrame) -> DataFrame:
    """Score of the share of clipped samples (n, n_clipped)."""
    share = 100 * F.sum("n_clipped") / F.nullif(F.sum("n"), F.lit(0))
    return frames.groupBy("series_id").agg(F.round(share, 6).alias("percent")).withColumn("score", F.when(F.col("percent") < 0.1, 100).when(F.col("percent") < 0.5, 80).when(F.col("percent") < 2, 50).otherwise(20))


def speech_ratio(spans: DataFrame, durations: DataFrame) -> DataFrame:
    """Share of a series that spans cover, in percent, and its score; durations: series_id, duration."""
    spoken = spans.groupBy("series_id").agg(F.sum(F.col("stop") - F.col("start")).alias("s"))
    percent = F.round(100 * F.coalesce("s", F.lit(0.0)) / F.nullif("duration", F.lit(0.0)), 4)
    return durations.join(spoken, "series_id", "left").select("series_id", percent.alias("percent")).withColumn("score", F.when(F.col("percent") >= 50, 100).when(F.col("percent") >= 30, 60).when(F.col("percent") >= 15, 30).otherwise(10))


def harmonicity_score(values: DataFrame) -> DataFrame:
    """Score of the harmonics-to-noise ratio (hnr), 50 where there is none."""
    h = F.col("hnr")
    return values.select("series_id", F.when(h.isNull(), 50).when(h >= 15, 100).when(h >= 8, 80).when(h >= 3, 60).when(h >= 0, 40).otherwise(20).alias("score"))


def quality(scores: DataFrame) -> DataFrame:
    """Weighted quality of snr_score, clip_score, ratio_score and hnr_score, and its flag."""
    total = F.floor(0.4 * F.col("snr_score") + 0.2 * F.col("clip_score") + 0.2 * F.col("ratio_score") + 0.2 * F.col("hnr_score") + 1e-9)
    return scores.select("series_id", total.alias("quality"), F.when(total >= 70, "TRUSTWORTHY").when(total >= 40, "DEGRADED").otherwise("UNRELIABLE").alias("flag"))


def merge_spans(spans: DataFrame, gap: float = 2.0) -> DataFrame:
    """Spans nearer to each other than ``gap`` as one."""
    w = Window.partitionBy("series_id").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", F.coalesce(F.col("start") - reach >= gap, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("series_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def gaps(spans: DataFrame, durations: DataFrame, least: float = 3.0) -> DataFrame:
    """Gaps of three seconds or more between merged spans, before the first and after the last."""
    w = Window.partitionBy("series_id").orderBy("start")
    between = spans.select("series_id", F.lag("stop", 1, 0.0).over(w).alias("start"), F.col("start").alias("stop"))
    last = durations.join(spans.groupBy("series_id").agg(F.max("stop").alias("start")), "series_id", "left").select("series_id", F.coalesce("start", F.lit(0.0)).alias("start"), F.col("duration").alias("stop"))
    return between.unionByName(last).where(F.round(F.col("stop") - F.col("start"), 6) >= least)


def hold_music(gap_spans: DataFrame, frames: DataFrame) -> DataFrame:
    """Gaps that sound like music: two of three of a high centroid, steady crossings, and even loudness."""
    inside = gap_spans.join(frames, "series_id").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    stats = inside.groupBy("series_id", "start", "stop").agg(F.avg("centroid").alias("c"), F.var_pop("zcr").alias("z"), F.avg("rms").alias("m"), F.stddev_pop("rms").alias("s"))
    votes = (F.col("c") > 2000).cast("int") + (F.col("z") < 0.005).cast("int") + ((F.col("m") > 0.01) & (F.col("s") / F.nullif("m", F.lit(0.0)) < 0.5)).cast("int")
    return stats.select("series_id", "start", "stop", votes.alias("votes"), (votes >= 2).alias("music"))


def subtract(spans: DataFrame, holes: DataFrame, least: float = 0.1) -> DataFrame:
    """Spans without holes; remnants of a tenth of a second or less are dropped. Within each of both, spans don't overlap."""
    cut = spans.alias("s").join(holes.select("series_id", F.col("start").alias("a"), F.col("stop").alias("b")).alias("h"), (F.col("s.series_id") == F.col("h.series_id")) & (F.col("a") < F.col("stop")) & (F.col("b") > F.col("start")), "left")
    lists = cut.groupBy(F.col("s.series_id").alias("series_id"), "start", "stop").agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("h"))
    from_ = F.concat(F.array("start"), F.transform("h", lambda x: x["b"]))
    to = F.concat(F.transform("h", lambda x: x["a"]), F.array("stop"))
    pieces = lists.select("series_id", F.col("stop").alias("end"), F.explode(F.arrays_zip(from_.alias("x"), to.alias("y"))).alias("p"))
    return pieces.select("series_id", F.col("p.x").alias("start"), F.col("p.y").alias("stop")).where(F.round(F.col("stop") - F.col("start"), 6) > least)


def cleanup_summary(before: DataFrame, after: DataFrame, padding: float = 0.2) -> DataFrame:
    """Seconds before, after and removed, whether clean-up applies (a second or more), and the length of the stitched audio."""
    length = F.sum(F.col("stop") - F.col("start"))
    a = before.groupBy("series_id").agg(F.round(length, 6).alias("before_s"))
    b = after.groupBy("series_id").agg(F.round(length, 6).alias("after_s"), F.count("*").alias("n"))
    joined = a.join(b, "series_id", "left").select("series_id", "before_s", F.coalesce("after_s", F.lit(0.0)).alias("after_s"), F.coalesce("n", F.lit(0)).alias("n"))
    removed = F.round(F.col("before_s") - F.col("after_s"), 6)
    return joined.withColumn("removed_s", removed).withColumn("applied", removed >= 1).withColumn("stitched_s", F.round(F.col("after_s") + padding * F.greatest(F.col("n") - 1, F.lit(0)), 6))


def splices(frames: DataFrame, sigmas: float = 5.0, cluster: float = 0.5, edge: float = 2.0) -> DataFrame:
    """Sudden changes: flux over the median and five deviations, clusters within half a second as one at their middle frame; graded, those at the edges dropped."""
    stats = frames.groupBy("series_id").agg(F.median("flux").alias("m"), F.stddev_pop("flux").alias("sd"), F.max("t").alias("last"))
    high = frames.join(stats, "series_id").where(F.col("flux") > F.col("m") + sigmas * F.col("sd")).where((F.col("t") >= edge) & (F.col("t") <= F.col("last") - edge))
    grouped = islands(high, F.col("t") - F.lag("t").over(_order()) > cluster, "frame_idx").groupBy("series_id", "island").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.max("flux").alias("flux"), F.max("m").alias("m"), F.max("sd").alias("sd"))
    floor = F.greatest("sd", 0.1 * F.col("m"))
    deviation = (F.col("flux") - F.col("m")) / floor
    severity = F.when(deviation > 10, "high").when(deviation > 7, "medium")
    confidence = F.when(deviation > 10, F.least(F.lit(0.9), deviation / 15)).otherwise(F.least(F.lit(0.7), deviation / 15))
    middle = F.element_at("ts", (F.size("ts") / 2).cast("int") + 1)
    return grouped.select("series_id", F.round(middle, 3).alias("t"), F.round(deviation, 6).alias("deviation"), severity.alias("severity"), F.round(confidence, 6).alias("confidence")).where("severity is not null")


def silence_anomalies(frames: DataFrame, zero: float = 1e-6, least: float = 0.05, irregular: float = 2.0) -> DataFrame:
    """Runs of digital silence longer than 0.05 s, and series whose silences are irregular."""
    quiet = frames.where(F.col("energy") <= zero)
    runs = islands(quiet, F.col("frame_idx") != F.lag("frame_idx").over(_order()) + 1, "frame_idx").groupBy("series_id", "island").agg(F.min("t").alias("t"), (F.count("*") * HOP).alias("length")).drop("island")
    long = runs.where(F.round("length", 6) > least).select("series_id", F.lit("digital_zero").alias("kind"), F.round("t", 3).alias("t"), F.round("length", 3).alias("value"))
    cv = F.stddev_pop("length") / F.avg("length")
    uneven = runs.groupBy("series_id").agg(F.count("*").alias("n"), cv.alias("cv")).where((F.col("n") >= 3) & (F.col("cv") > irregular))
    return long.unionByName(uneven.select("series_id", F.lit("irregular").alias("kind"), F.lit(None).cast("double").alias("t"), F.round("cv", 3).alias("value")))


def noise_floor_drift(frames: DataFrame, length: float = 0.5, step: float = 0.2, sigmas: float = 3.0) -> DataFrame:
    """Sliding windows whose fifth percentile of energy is far from the series' median of them."""
    first = F.ceil(F.greatest((F.col("t") - length) / step + 1e-9, F.lit(0.0)))
    windows = frames.select("series_id", "t", "energy", F.explode(F.sequence(first, F.floor(F.col("t") / step + 1e-9))).alias("w"))
    floors = windows.groupBy("series_id", "w").agg(F.percentile("energy", F.lit(0.05)).alias("floor"))
    stats = floors.groupBy("series_id").agg(F.median("floor").alias("m"), F.stddev_pop("floor").alias("sd"))
    deviation = F.abs(F.col("floor") - F.col("m")) / F.greatest(F.col("sd"), 0.1 * F.col("m"))
    return floors.join(stats, "series_id").where(F.greatest(F.col("sd"), 0.1 * F.col("m")) > 0).withColumn("deviation", F.round(deviation, 6)).where(F.col("deviation") > sigmas).select("series_id", F.col("w").cast("long").alias("w"), F.round("floor", 6).alias("floor"), "deviation")


def cap_lone_kind(signals: DataFrame) -> DataFrame:
    """Severity of signals (series_id, kind, severity), medium at most where a series has one kind only."""
    kinds = F.size(F.collect_set("kind").over(Window.partitionBy("series_id")))
    return signals.withColumn("severity", F.when((kinds == 1) & (F.col("severity") == "high"), "medium").otherwise(F.col("severity")))


def tamper_risk(signals: DataFrame) -> DataFrame:
    """Risk of a series from kinds and grades of its signals."""
    s = signals.groupBy("series_id").agg(F.count_distinct("kind").alias("kinds"), F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("n"))
    risk = F.when((F.col("kinds") >= 3) & (F.col("high") >= 2), "high").when((F.col("kinds") >= 2) & ((F.col("high") >= 1) | (F.col("n") >= 4)), "medium").otherwise("low")
    return s.select("series_id", risk.alias("risk"))

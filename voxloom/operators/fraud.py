"""Fraud signals: rows call_id, signal_type, segment_id, confidence, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase_hits, word_count
from .transcript import AGENT, CUSTOMER

COLUMNS = ["call_id", "signal_type", "segment_id", "confidence", "detail"]
#: signal, vocabulary subcategory, least distinct phrases, base, step and cap of the confidence
PHRASE_SIGNALS = [
    ("remote_access", "remote_access", 1, 0.85, 0.0, 0.85),
    ("urgency", "urgency", 2, 0.5, 0.1, 0.9),
    ("credential_request", "credentials", 1, 0.75, 0.0, 0.75),
    ("authority_impersonation", "authority", 1, 0.8, 0.0, 0.8),
    ("vague_identity", "vague_identity", 1, 0.6, 0.0, 0.6),
    ("financial_threat", "threats", 1, 0.6, 0.1, 0.9),
    ("social_engineering", "social_engineering", 2, 0.5, 0.1, 0.85),
]
DEFAULTS = {"pitch_mean": (150.0, 20.0), "jitter": (0.01, 0.01), "shimmer": (0.03, 0.03), "hnr": (15.0, 15.0)}
#: Broad cues before a costly scam model.
SCAM_CUES = r"(?i)\b(?:otp|cvv|pin|card|bank|tax|warrant|police|transfer|desktop|screen|immediately|account)\b"


def _signal(rows: DataFrame, name: str, segment: Column, confidence: Column, detail: Column) -> DataFrame:
    return rows.select("call_id", F.lit(name).alias("signal_type"), segment.cast("int").alias("segment_id"), F.round(confidence, 4).cast("double").alias("confidence"), detail.cast("string").alias("detail"))


def phrase_signals(segments: DataFrame, vocab: DataFrame) -> DataFrame:
    """Signals from phrases of a call: the first in list order gives segment and detail, distinct phrases raise the confidence."""
    phrases = vocab.where("category = 'fraud'").select("phrase", "subcategory", "ord")
    hits = phrase_hits(segments.select("call_id", "segment_id", "text"), phrases)
    counted = hits.groupBy("call_id", "subcategory").agg(F.count_distinct("phrase").alias("n"), F.min(F.struct("ord", "segment_id", "phrase")).alias("f"))
    rules = segments.sparkSession.createDataFrame(PHRASE_SIGNALS, "signal_type string, subcategory string, least int, base double, step double, cap double")
    kept = counted.join(F.broadcast(rules), "subcategory").where(F.col("n") >= F.col("least"))
    confidence = F.round(F.least(F.col("base") + F.col("step") * F.col("n"), F.col("cap")), 4)
    return kept.select("call_id", "signal_type", F.col("f.segment_id").alias("segment_id"), confidence.alias("confidence"), F.col("f.phrase").alias("detail"))


def every_signal() -> Column:
    """The signals of phrases, speakers and monologues of a row of ``compliance.call_facts``, as an array of structs of COLUMNS without call_id."""
    heard = F.filter("said", lambda x: x["category"] == "fraud")

    def one(name: str, segment: Column, confidence: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("signal_type"), segment.cast("int").alias("segment_id"), F.round(confidence, 4).cast("double").alias("confidence"), detail.cast("string").alias("detail"))

    def phrase(said: Column, name: str, subcategory: str, least: int, base: float, step: float, cap: float) -> Column:
        found = F.transform(F.filter(said, lambda x: x["subcategory"] == subcategory), lambda x: F.struct(x["ord"].alias("ord"), x["segment"].alias("segment_id"), x["phrase"].alias("phrase")))
        n, first = F.size(found), F.array_min(found)
        return F.when(n >= least, one(name, first["segment_id"], F.least(F.lit(base) + F.lit(step) * n, F.lit(cap)), first["phrase"]))

    none = F.lit(None)
    speakers = F.when(F.size("speakers") > 2, one("unexpected_speaker", none, F.lit(0.7), F.array_join("speakers", ",")))
    monologue = F.when((F.col("agent_s") > 60) & (F.col("agent_s") > 0.8 * F.col("spoken_s")), one("agent_monologue", none, F.lit(0.5), none))
    # a variable of a function holds the phrases, as Catalyst would copy their expression to each signal; most calls have none
    some = F.flatten(F.transform(F.filter(F.array(heard), lambda x: F.size(x) > 0), lambda said: F.array(*[phrase(said, *rule) for rule in PHRASE_SIGNALS])))
    return F.filter(F.concat(some, F.array(speakers, monologue)), lambda x: x.isNotNull())


def unexpected_speakers(segments: DataFrame, most: int = 2) -> DataFrame:
    """More speakers than expected."""
    who = segments.groupBy("call_id").agg(F.array_sort(F.collect_set("speaker")).alias("s")).where(F.size("s") > most)
    return _signal(who, "unexpected_speaker", F.lit(None), F.lit(0.7), F.array_join("s", ","))


def agent_monologue(segments: DataFrame, seconds: float = 60, share: float = 0.8) -> DataFrame:
    """An agent who talks for over a minute and most of the time."""
    length = F.col("end_s") - F.col("start_s")
    sums = segments.groupBy("call_id").agg(F.sum(length).alias("all"), F.coalesce(F.sum(F.when(F.lower("speaker").isin(*AGENT), length)), F.lit(0.0)).alias("agent"))
    return _signal(sums.where((F.col("agent") > seconds) & (F.col("agent") > share * F.col("all"))), "agent_monologue", F.lit(None), F.lit(0.5), F.lit(None))


def baselines(features: DataFrame, window_s: float = 30, within_s: float = 90) -> DataFrame:
    """Per speaker the calm baseline: means over the window of 30 s, begun in the first 90 s with two points or more, of least mean jitter and shimmer; else over the first three points."""
    names = list(DEFAULTS)
    a = features.select("call_id", "speaker", F.col("start_s").alias("t")).where(F.col("t") < within_s).distinct()
    b = features.select("call_id", "speaker", "start_s", *names)
    joined = a.join(b, ["call_id", "speaker"]).where((F.col("start_s") >= F.col("t")) & (F.col("start_s") < F.col("t") + window_s))
    means = joined.groupBy("call_id", "speaker", "t").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in names]).where("n >= 2")
    best = means.groupBy("call_id", "speaker").agg(F.min(F.struct(F.round(F.col("jitter") + F.col("shimmer"), 9).alias("stress"), "t", *names)).alias("m"))
    first = b.withColumn("k", F.row_number().over(Window.partitionBy("call_id", "speaker").orderBy("start_s"))).where("k <= 3").groupBy("call_id", "speaker").agg(*[F.avg(x).alias(f"first_{x}") for x in names])
    return first.join(best, ["call_id", "speaker"], "left").select("call_id", "speaker", *[F.round(F.coalesce(f"m.{x}", f"first_{x}"), 9).alias(f"base_{x}") for x in names])


def stress(features: DataFrame, bases: DataFrame, limit: float = 1.5) -> DataFrame:
    """Deviation from the speaker's baseline: one and the mean of the positive relative deviations; anomalies are over the limit."""
    joined = features.join(bases, ["call_id", "speaker"])
    pitch = F.abs(F.col("pitch_mean") - F.col("base_pitch_mean")) / 20.0
    up = lambda x, scale: (F.col(x) - F.col(f"base_{x}")) / scale
    terms = [pitch, up("jitter", 0.01), up("shimmer", 0.03), -up("hnr", 15.0)]
    score = F.round(sum(F.greatest(t, F.lit(0.0)) for t in terms) / len(terms) + 1, 6)
    return joined.select("call_id", "segment_id", "speaker", score.alias("score"), (score > limit).alias("anomaly"), F.round(F.least(F.lit(0.9), score / 3), 4).alias("confidence"))


def coached_speech(segments: DataFrame, least: int = 5) -> DataFrame:
    """Speakers whose pace hardly varies: words per minute of segments of two seconds or more, 50 to 300, with a coefficient of variation under 0.10 and a mean over 100."""
    length = F.col("end_s") - F.col("start_s")
    pace = segments.where(length >= 2).select("call_id", "speaker", (word_count(F.col("text")) / (length / 60)).alias("wpm")).where("wpm between 50 and 300")
    stats = pace.groupBy("call_id", "speaker").agg(F.count("*").alias("n"), F.avg("wpm").alias("mean"), F.stddev_pop("wpm").alias("sd")).where(F.col("n") >= least)
    cv = F.col("sd") / F.col("mean")
    flagged = stats.select("call_id", "speaker", "n", F.round("mean", 4).alias("mean"), F.round(cv, 6).alias("cv"), ((cv < 0.10) & (F.col("mean") > 100)).alias("coached"))
    return flagged.withColumn("confidence", F.when(F.col("coached"), F.round(F.least(F.lit(0.85), (0.15 - F.col("cv")) / 0.15), 4)))


def import_abuse(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Signals of an abuse classifier (call_id, segment_id, label, score): abusive and sure, or not abusive but hardly so, which counts with what is left of the score."""
    value = F.when(F.col("label") == "abusive", F.col("score")).when((F.col("label") == "not_abusive") & (F.col("score") < 0.6), 1 - F.col("score")).otherwise(F.lit(0.0))
    kept = scores.withColumn("value", value).where((F.col("value") >= threshold) | ((F.col("label") == "not_abusive") & (F.col("value") > 0.4)))
    return _signal(kept, "abusive_language", F.col("segment_id"), F.col("value"), F.col("label"))


def scam_candidates(segments: DataFrame, shortest: int = 10, gate: bool = True) -> DataFrame:
    """Utterances for the scam model: longer than ten characters and, unless the gate is off, with a cue."""
    kept = segments.where(F.length("text") > shortest)
    return (kept.where(F.col("text").rlike(SCAM_CUES)) if gate else kept).select("call_id", "segment_id", "text")


def import_scam(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Signals of a scam model with a map of scores by label: the best label (ties by name), not the legitimate one, if sure enough."""
    entries = F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label")))
    best = scores.select("call_id", "segment_id", F.array_min(entries).alias("b"))
    kept = best.where((F.col("b.label") != "legitimate") & (-F.col("b.n") >= threshold))
    return _signal(kept, "scam", F.col("segment_id"), -F.col("b.n"), F.col("b.label"))


def union_all(*signals: DataFrame) -> DataFrame:
    """All signals."""
    out = signals[0].select(COLUMNS)
    for more in signals[1:]:
        out = out.unionByName(more.select(COLUMNS))
    return out


def emotion_diversity(emotions: DataFrame) -> DataFrame:
    """Normalized entropy of the customer's emotions per call: 0 for a single one, 0.5 for fewer than two segments."""
    per = emotions.where(F.lower("speaker").isin(*CUSTOMER)).groupBy("call_id", "emotion").count()
    w = Window.partitionBy("call_id")
    shares = per.withColumn("total", F.sum("count").over(w)).withColumn("p", F.col("count") / F.col("total"))
    out = shares.groupBy("call_id").agg(F.max("total").alias("total"), F.count("*").alias("kinds"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    value = F.when(F.col("total") < 2, 0.5).when(F.col("kinds") < 2, 0.0).otherwise(F.col("h") / F.log2("kinds"))
    return out.select("call_id", F.round(value, 4).alias("diversity"))


def refine(signals: DataFrame, emotions: DataFrame) -> DataFrame:
    """Confidences with emotions: stress by what the segment's emotion says, coached speech by the diversity of emotions; 0 to 1."""
    felt = emotions.select("call_id", F.col("segment_id"), "emotion")
    joined = signals.join(felt, ["call_id", "segment_id"], "left").join(emotion_diversity(emotions), "call_id", "left")
    stress_factor = F.when(F.col("emotion").isin("angry", "happy", "surprised"), 0.6).when(F.col("emotion") == "fearful", 1.3).otherwise(1.0)
    coached = F.when(F.col("diversity") < 0.25, 1.25).when(F.col("diversity") > 0.5, 0.5).otherwise(1.0)
    factor = F.when(F.col("signal_type") == "vocal_stress", stress_factor).when(F.col("signal_type") == "coached_speech", coached).otherwise(1.0)
    return joined.select("call_id", "signal_type", "segment_id", F.round(F.greatest(F.least(F.col("confidence") * factor, F.lit(1.0)), F.lit(0.0)), 4).alias("confidence"), "detail")


def incongruence(segments: DataFrame, emotions: DataFrame, cue: str = r"(?i)\b(?:verify|confirm|account|otp|card)\b") -> DataFrame:
    """The customer's first reply within two segments of the agent's question about identity, if fearful over 0.5 or surprised over 0.6."""
    asked = segments.where(F.lower("speaker").isin(*AGENT) & F.col("text").rlike(cue)).select("call_id", F.col("segment_id").alias("question"))
    replies = emotions.where(F.lower("speaker").isin(*CUSTOMER))
    near = asked.join(replies, "call_id").where((F.col("segment_id") > F.col("question")) & (F.col("segment_id") <= F.col("question") + 2))
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("call_id", "question").orderBy("segment_id"))).where("k = 1")
    kept = first.where("(emotion = 'fearful' and emotion_score > 0.5) or (emotion = 'surprised' and emotion_score > 0.6)")
    return _signal(kept, "emotional_incongruence", F.col("segment_id"), F.col("emotion_score"), F.concat(F.lit("q"), F.col("question")))


def risk_bucket(signals: DataFrame) -> DataFrame:
    """Confidences as risk levels."""
    c = F.col("confidence")
    return signals.select("call_id", "signal_type", "segment_id", F.when(c >= 0.85, "critical").when(c >= 0.7, "high").when(c >= 0.5, "medium").otherwise("low").alias("risk"))

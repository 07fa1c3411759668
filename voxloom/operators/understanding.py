"""Toxicity, intents, sentiment and emotions of segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, word_count
from .transcript import AGENT, CUSTOMER, REGULATED

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
TextScorer = Callable[[list[str], str], list[tuple[str, float]]]

# Thresholds of the toxicity scores.
TOXIC = {"toxicity": 0.7, "severe_toxicity": 0.3, "obscene": 0.7, "threat": 0.5, "insult": 0.7, "identity_attack": 0.7, "sexual_explicit": 0.7}

# The keyword cascade, (intent, confidence, for regulated calls only, phrases); the first rule that holds wins.
CASCADE = [
    ("escalation", 0.75, True, ["manager", "supervisor", "escalate", "senior person", "higher authority", "complaint to", "ombudsman"]),
    ("refusal", 0.75, True, ["not going to pay", "will not pay", "won't pay", "refuse", "cannot pay", "can't pay", "no money", "not paying"]),
    ("dispute", 0.72, True, ["do not accept", "don't accept", "not my", "wrong charge", "incorrect", "dispute", "never took", "did not take", "completely wrong", "mistake"]),
    ("request_extension", 0.72, True, ["more time", "extension", "extend", "another week", "another two weeks", "few more days", "postpone", "defer", "next month instead"]),
    ("payment_promise", 0.75, True, ["i will pay", "i'll pay", "will transfer", "will deposit", "jama kar", "pay by", "promise", "settle by", "clear it by", "make the payment by"]),
    ("agreement", 0.72, True, ["i agree", "agreed", "that works", "acceptable", "okay with that", "fine with me", "accept the settlement"]),
    ("consent_given", 0.70, True, ["i consent", "you may", "you can share", "i authorise", "i authorize", "go ahead and", "permission"]),
    ("consent_denied", 0.72, True, ["do not consent", "don't consent", "do not share", "no permission", "stop calling", "do not call", "don't call"]),
    ("complaint", 0.70, True, ["very poor service", "worst", "harassing", "harassment", "fed up", "complain about", "unacceptable service"]),
    ("greeting", 0.70, True, ["good morning", "good afternoon", "good evening", "namaste", "hello", "am i speaking with", "this is", "calling from"]),
    ("information_request", 0.68, True, ["outstanding", "balance", "due on", "due date", "late fee", "penalty", "emi of", "interest rate", "tenure", "amount is", "your account"]),
    ("procedural", 0.75, False, ["listen-only", "press star", "press pound", "operator", "conference", "question-and-answer", "q&a session", "webcast", "dial in", "replay", "forward-looking statement", "safe harbor", "sec filing", "10-k", "10-q", "participants", "signal a conference", "hold the line", "muted", "recording", "call is being recorded", "housekeeping"]),
    ("financial_disclosure", 0.70, False, ["revenue", "earnings", "income", "expense", "margin", "profit", "ebitda", "cash flow", "dividend", "per share", "eps", "basis points", "year-over-year", "quarter-over-quarter", "increased by", "decreased by", "grew by", "declined", "compared to", "versus prior", "million", "billion"]),
    ("guidance_forecast", 0.70, False, ["expect", "anticipate", "forecast", "outlook", "guidance", "project", "target", "estimate for", "looking ahead", "for the full year", "next quarter", "going forward"]),
    ("risk_warning", 0.65, False, ["risk", "uncertainty", "caution", "could affect", "may impact", "no assurance", "subject to", "disclaimer", "not guarantee"]),
]
QUESTION_STARTS = ["could you", "can you", "what is", "how do", "why did", "when will"]
EXPLANATIONS = ["the reason", "because", "this is due to", "as a result", "let me explain", "so what happened"]
#: (intent, confidence) of the rules of the cascade, then of questions, explanations, general calls, and whatever is left.
OUTCOMES = [(name, sure) for name, sure, *_ in CASCADE] + [("question", 0.70), ("explanation", 0.65), ("information_request", 0.50), ("unknown", 0.30)]
LABELS = sorted({name for name, *_ in CASCADE} | {"question", "explanation", "unknown", "acknowledgment"})

# Small sentiment lexicons of our own.
POSITIVE = ["agree", "good", "great", "growth", "happy", "share", "strong", "thank", "thanks", "works", "yes"]
NEGATIVE = ["arrest", "cannot", "complain", "debt", "decline", "harassment", "no", "overdue", "refuse", "risk", "unacceptable", "warrant", "wrong"]
EMOTIONS = ("angry", "disgusted", "fearful", "happy", "neutral", "sad", "surprised")
NEGATIVE_EMOTIONS, POSITIVE_EMOTIONS = ("angry", "fearful", "sad", "disgusted"), ("happy", "surprised")


def toxic_categories(scores: DataFrame) -> DataFrame:
    """Categories over their thresholds (columns named as TOXIC), in alphabetical order; segments without any are left out."""
    over = F.filter(F.array(*[F.when(F.col(k) >= v, k) for k, v in sorted(TOXIC.items())]), lambda x: x.isNotNull())
    return scores.withColumn("categories", over).where(F.size("categories") > 0).select("call_id", "segment_id", "speaker", "toxicity", "severe_toxicity", "threat", "categories")


def toxic_severity(flags: DataFrame) -> DataFrame:
    """Severity of flags; the agent's medium ones are high."""
    agent = F.lower("speaker").isin(*AGENT)
    t = F.col("toxicity")
    level = F.when((F.col("severe_toxicity") >= 0.5) | (F.col("threat") >= 0.8), "critical").when((t >= 0.9) | (agent & (t >= 0.7)), "high").when(t >= 0.7, "medium").otherwise("low")
    return flags.withColumn("severity", F.when(agent & (level == "medium"), "high").otherwise(level))


def merge_flags(flags: DataFrame, second: DataFrame) -> DataFrame:
    """Flags, and a second detector's for segments not flagged yet: high for agents and medium for others, from a score of 0.9 on one level up."""
    new = second.join(flags.select("call_id", "segment_id"), ["call_id", "segment_id"], "left_anti")
    agent = F.lower("speaker").isin(*AGENT)
    level = F.when(agent & (F.col("score") >= 0.9), "critical").when(agent | (F.col("score") >= 0.9), "high").otherwise("medium")
    return flags.select("call_id", "segment_id", "severity").unionByName(new.select("call_id", "segment_id", level.alias("severity")))


def route(segments: DataFrame, trivial: DataFrame) -> DataFrame:
    """Which model a segment (with label and score of its sentiment) needs: skip, negative_subset or full."""
    known = trivial.select(F.lower("phrase").alias("plain")).distinct().withColumn("trivial", F.lit(True))
    n = word_count(F.col("text"))
    joined = segments.withColumn("plain", F.lower(F.btrim(F.regexp_replace("text", "[.!?,]", "")))).join(F.broadcast(known), "plain", "left")
    choice = F.when((n <= 3) & F.col("trivial"), "skip").when((F.col("label") == "negative") & (F.col("score") > 0.85), "negative_subset").when((F.col("label") == "neutral") & (F.col("score") > 0.90) & (n <= 5), "skip").otherwise("full")
    return joined.select("call_id", "segment_id", choice.alias("route"))


def trivial_intents(segments: DataFrame, greetings: DataFrame) -> DataFrame:
    """Intents of trivial utterances: greeting if known as one, else acknowledgment."""
    known = greetings.select(F.lower("phrase").alias("plain")).distinct().withColumn("greeting", F.lit(True))
    joined = segments.withColumn("plain", F.lower(F.btrim(F.regexp_replace("text", "[.!?,]", "")))).join(F.broadcast(known), "plain", "left")
    return joined.select("call_id", "segment_id", F.when(F.col("greeting"), "greeting").otherwise("acknowledgment").alias("intent"), F.lit(0.9).alias("confidence"))


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _pattern(phrases: list[str], word: bool) -> str:
    """A pattern for the phrases without look-around: automata read a text once for all of them."""
    some = "(?:" + "|".join(re.escape(p) for p in phrases) + ")"
    return f"(?:^|[^a-z0-9]){some}(?:$|[^a-z0-9])" if word else some


#: Bits that the place of a rule takes.
_PLACE_BITS = 5


def _first_rules(word: bool) -> Callable[..., pa.Array]:
    """For lowered texts and types of call: the place of the first rule that holds, for each type in bits of its own."""
    ends = [r"\?$|^(?:" + "|".join(re.escape(p) for p in QUESTION_STARTS) + ")", _pattern(EXPLANATIONS, False)]
    rules = [(only, _pattern(phrases, word)) for *_, only, phrases in CASCADE] + [(False, pattern) for pattern in ends]

    def places(texts: pa.Array, *kinds: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        regulated = np.array([pc.is_in(kind, pa.array(REGULATED, kind.type)).to_numpy(zero_copy_only=False) for kind in kinds])
        general = np.array([pc.equal(kind, "general").fill_null(False).to_numpy(zero_copy_only=False) for kind in kinds])
        found = np.where(general, len(rules), len(rules) + 1)
        undecided = np.ones(found.shape, bool)
        for place, (only, pattern) in enumerate(rules):
            asked = undecided & regulated if only else undecided
            rows = np.flatnonzero(asked.any(0))
            holds = rows[pc.match_substring_regex(texts.take(pa.array(rows)), pattern).to_numpy(zero_copy_only=False)]
            hit = np.zeros(found.shape, bool)
            hit[:, holds] = asked[:, holds]
            found[hit] = place
            undecided &= ~hit
        return pa.array((found.astype(np.int64) << _PLACE_BITS * np.arange(len(kinds))[:, None]).sum(0))

    return places


def _rules(segments: DataFrame, word: bool, **kinds: Column) -> DataFrame:
    """``segments`` and, for each type of call, the place of the first rule of the cascade that holds for the text in such a call.

    Phrases are found by automata in Python workers, each rule's by one pass over
    the texts that no rule before it has decided.
    """
    first = F.arrow_udf(_first_rules(word), "long")
    placed = segments.withColumn("_rules", first(F.lower(F.btrim("text")), *kinds.values()))
    place = lambda k: F.shiftright("_rules", _PLACE_BITS * k).bitwiseAND((1 << _PLACE_BITS) - 1).cast("int")
    return placed.withColumns({name: place(k) for k, name in enumerate(kinds)}).drop("_rules")


def _intent(rule: Column) -> Column:
    return F.get(_literals([name for name, _ in OUTCOMES]), rule)


def keyword_intents(segments: DataFrame, word: bool = False) -> DataFrame:
    """Intent by the first rule of the cascade whose phrases a text contains; with ``word`` only as whole words."""
    placed = _rules(segments, word, _rule=F.col("call_type"))
    return placed.select("call_id", "segment_id", _intent(F.col("_rule")).alias("intent"), F.get(F.array(*[F.lit(sure) for _, sure in OUTCOMES]), F.col("_rule")).alias("confidence"))


def intents_by_call_type(segments: DataFrame, **kinds: Column) -> DataFrame:
    """Intents of segments by ``keyword_intents`` as if their calls were of other types: call_id, segment_id and a column for each of ``kinds``. The texts are read once for all of them."""
    placed = _rules(segments, False, **kinds)
    return placed.select("call_id", "segment_id", *[_intent(F.col(name)).alias(name) for name in kinds])


def import_intents(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """A classifier's lines ``segment|intent|confidence`` (call_id, line) for a queue of segments: unknown labels and missing lines fall back to the cascade, confidences are clamped, missing ones are 0.70."""
    parts = F.split("line", r"\|")
    label = F.lower(F.btrim(F.get(parts, F.lit(1))))
    sure = F.greatest(F.least(F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.70)), F.lit(1.0)), F.lit(0.0))
    read = answers.select("call_id", F.get(parts, F.lit(0)).try_cast("int").alias("segment_id"), label.alias("told"), sure.alias("sure")).where(F.col("segment_id").isNotNull() & F.col("told").isin(*LABELS) & (F.col("told") != "unknown"))
    first = read.groupBy("call_id", "segment_id").agg(F.min(F.struct("told", "sure")).alias("t"))
    joined = keyword_intents(queue).join(first, ["call_id", "segment_id"], "left")
    return joined.select("call_id", "segment_id", F.coalesce("t.told", "intent").alias("intent"), F.when(F.col("t").isNotNull(), F.col("t.sure")).otherwise(F.col("confidence")).alias("confidence"))


def batches(segments: DataFrame, size: int = 50) -> DataFrame:
    """Batch numbers of the segments of each call."""
    k = F.row_number().over(Window.partitionBy("call_id").orderBy("segment_id")) - 1
    return segments.select("call_id", "segment_id", F.floor(k / size).alias("batch"))


def distribution(rows: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The most frequent values with counts; ties by name."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def split_uncertain(intents: DataFrame) -> DataFrame:
    """Whether an intent is unknown and unsure."""
    return intents.withColumn("uncertain", (F.col("intent") == "unknown") & (F.col("confidence") < 0.5))


def lexicon_sentiment(segments: DataFrame) -> DataFrame:
    """Sentiment from distinct words: (positive - negative) / (positive + negative), 0 without any."""
    words = F.array_distinct(tokens(F.col("text")))
    p = F.size(F.array_intersect(words, F.array(*map(F.lit, POSITIVE))))
    n = F.size(F.array_intersect(words, F.array(*map(F.lit, NEGATIVE))))
    return segments.withColumn("score", F.when(p + n == 0, 0.0).otherwise((p - n) / F.nullif(p + n, F.lit(0))))


def score_text(segments: DataFrame, scorer: Scorer, schema: str, columns: list[str]) -> DataFrame:
    """Scores from a plug-in that reads and yields pandas frames of whole texts."""
    return segments.select(*columns).mapInPandas(scorer, schema)


def score_sentiment(segments: DataFrame, scorer: TextScorer, size: int = 32, most: int | None = None) -> DataFrame:
    """Label and score of each segment (call_id, segment_id, lang, text) by a plug-in.

    The plug-in gets up to ``size`` texts of one language and the language, and
    returns as many (label, score). Where it fails, it gets the texts one by
    one; those on which it fails again are neutral at 0.5. A null text is empty,
    a null language "en". ``most`` is for models that take only so many
    characters; unset, texts are whole.
    """

    def each(texts: list[str], lang: str) -> list[tuple[str, float]]:
        try:
            found = scorer(texts, lang)
            if len(found) == len(texts):
                return [(label.strip().lower(), float(score)) for label, score in found]
        except Exception:  # whatever a model may raise
            pass
        return [x for text in texts for x in each([text], lang)] if len(texts) > 1 else [("neutral", 0.5)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, rows in frame.groupby("lang"):
                texts = rows["text"].str.slice(0, most).tolist()
                found = [x for k in range(0, len(texts), size) for x in each(texts[k : k + size], lang)]
                yield rows[["call_id", "segment_id"]].assign(label=[x[0] for x in found], score=[x[1] for x in found])

    whole = segments.select("call_id", "segment_id", F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in whole.schema}
    return score_text(whole, run, f"call_id {types['call_id']}, segment_id {types['segment_id']}, label string, score double", whole.columns)


def lexicon_scorer(texts: list[str], lang: str) -> list[tuple[str, float]]:
    """The scorer where there is no model: the lexicons' label, and how clear it is."""
    out = []
    for text in texts:
        words = set(re.sub("[^a-z0-9]+", " ", text.lower()).split())
        p, n = len(words.intersection(POSITIVE)), len(words.intersection(NEGATIVE))
        out.append(("neutral", 0.5) if p == n else ("positive" if p > n else "negative", abs(p - n) / (p + n)))
    return out


def signed(labels: DataFrame) -> DataFrame:
    """Label and score as one signed number; neutral is near 0, the surer the nearer."""
    s = F.col("score")
    value = F.when(F.col("label") == "positive", s).when(F.col("label") == "negative", -s).otherwise(F.greatest(F.lit(0.02), (1 - s) * 0.3))
    return labels.withColumn("signed", F.round(value, 4) + 0.0)


def trajectories(scored: DataFrame) -> DataFrame:
    """Per call the scores of customer and agent in order; speakers that are neither count for both; without any, [0]."""
    who = F.lower("speaker")
    other = ~who.isin(*AGENT, *CUSTOMER)

    def ordered(names: tuple[str, ...]) -> Column:
        rows = F.array_sort(F.collect_list(F.when(who.isin(*names) | other, F.struct("segment_id", "score"))))
        return F.when(F.size(rows) == 0, F.array(F.lit(0.0))).otherwise(F.transform(rows, lambda x: x["score"]))

    return scored.groupBy("call_id").agg(ordered(CUSTOMER).alias("customer"), ordered(AGENT).alias("agent"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def feelings(paths: DataFrame) -> DataFrame:
    """From trajectories: dominant feeling, its role's context, and the risk of escalation by the customer's trend."""
    c, a = F.col("customer"), F.col("agent")
    mean, agent_mean = _mean(c), _mean(a)
    feeling = F.when(mean > 0.3, "positive").when(mean < -0.5, "angry").when(mean < -0.3, "frustrated").otherwise("neutral")
    half = F.floor(F.size(c) / 2).cast("int")
    first, second = _mean(F.slice(c, F.lit(1), half)), _mean(F.slice(c, half + 1, F.size(c) - half))
    trend = second - first
    risk = F.when(F.size(c) < 4, F.when(mean < -0.4, "medium").otherwise("low")).when((trend < -0.3) & (second < -0.3), "high").when(trend < -0.15, "medium").otherwise("low")
    return paths.select("call_id", F.round(mean, 6).alias("mean"), feeling.alias("feeling"), F.when(mean < -0.2, "distress").when(mean > 0.2, "satisfaction").otherwise("neutral").alias("context"), (agent_mean < -0.4).alias("agent_actionable"), risk.alias("escalation_risk"))


def aligned(paths: DataFrame) -> DataFrame:
    """Both trajectories by position, the shorter one padded with nulls."""
    return paths.select("call_id", F.posexplode(F.arrays_zip("customer", "agent")).alias("position", "z")).select("call_id", "position", "z.customer", "z.agent")


def import_emotions(scores: DataFrame) -> DataFrame:
    """Emotion from a map of scores by label: labels in lower case before a slash, the best (ties by name); under 0.4 or unknown ones are neutral and of low confidence."""
    entries = F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("n"), F.lower(F.substring_index(e["key"], "/", 1)).alias("label")))
    best = scores.select("call_id", "segment_id", F.array_min(entries).alias("b"))
    low = (-F.col("b.n") < 0.4) | ~F.col("b.label").isin(*EMOTIONS)
    return best.select("call_id", "segment_id", F.when(low, "neutral").otherwise(F.col("b.label")).alias("emotion"), F.round(F.greatest(F.least(-F.col("b.n"), F.lit(1.0)), F.lit(0.0)), 4).alias("emotion_score"), low.alias("low_confidence"))


def sample_segments(segments: DataFrame, over: int = 100, edge: int = 5, to: int = 60) -> DataFrame:
    """Of long calls the first and last five segments, both sides of each change of speaker, and evenly spaced others up to ``to``; of others all."""
    order = Window.partitionBy("call_id").orderBy("segment_id")
    n = F.count("*").over(Window.partitionBy("call_id"))
    marked = segments.withColumn("n", n).withColumn("k", F.row_number().over(order)).withColumn("turn", (F.col("speaker") != F.lag("speaker").over(order)) | (F.col("speaker") != F.lead("speaker").over(order)))
    must = (F.col("k") <= edge) | (F.col("k") > F.col("n") - edge) | F.coalesce("turn", F.lit(False))
    split = marked.withColumn("must", must)
    w = Window.partitionBy("call_id", "must")
    rest = split.withColumn("m", F.sum(F.col("must").cast("int")).over(Window.partitionBy("call_id"))).withColumn("j", F.row_number().over(w.orderBy("segment_id")) - 1).withColumn("left", F.count("*").over(w))
    room = F.greatest(F.lit(to) - F.col("m"), F.lit(0))
    step = F.greatest(F.ceil(F.col("left") / F.nullif(room, F.lit(0))), F.lit(1))
    keep = (F.col("n") <= over) | F.col("must") | ((room > 0) & (F.col("j") % step == 0))
    return rest.where(keep).select("call_id", "segment_id", "speaker")


def emotion_summary(emotions: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the dominant emotion by mean score (ties by name), its mean, its share, and the number of segments."""
    per = emotions.groupBy(*by, "emotion").agg(F.count("*").alias("n"), F.round(F.avg("emotion_score"), 6).alias("mean"))
    best = per.groupBy(*by).agg(F.min(F.struct((-F.col("mean")).alias("m"), "emotion", "n")).alias("b"), F.sum("n").alias("total"))
    return best.select(*by, F.col("b.emotion").alias("dominant"), (-F.col("b.m")).alias("mean"), F.round(F.col("b.n") / F.col("total"), 4).alias("share"), "total")


def escalation_moments(emotions: DataFrame, over: float = 0.6) -> DataFrame:
    """Angry or fearful segments over 0.6."""
    return emotions.where(F.col("emotion").isin("angry", "fearful") & (F.col("emotion_score") > over)).select("call_id", "segment_id", "speaker", "emotion", "emotion_score")


def transitions(emotions: DataFrame, sure: float = 0.7) -> DataFrame:
    """Changes of emotion per speaker of three confident segments or more: accepted if the next segment has it too or its score is 0.7 or more; from the last accepted emotion. Significance: high into a negative one from another kind, medium from negative to positive, low else."""
    rows = emotions.where("not low_confidence").groupBy("call_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("segment_id", "emotion", "emotion_score"))).alias("e")).where(F.size("e") >= 3)
    start = F.struct(F.lit(None).cast("string").alias("state"), F.array().cast("array<struct<segment_id:int,old:string,new:string>>").alias("out"))
    numbered = F.transform("e", lambda x, k: F.struct(x["segment_id"].alias("segment_id"), x["emotion"].alias("emotion"), x["emotion_score"].alias("score"), F.get(F.col("e"), k + 1)["emotion"].alias("later")))

    def step(acc: Column, x: Column) -> Column:
        accepted = acc["state"].isNotNull() & (x["emotion"] != acc["state"]) & ((x["later"] == x["emotion"]) | (x["score"] >= sure))
        row = F.struct(x["segment_id"].cast("int").alias("segment_id"), acc["state"].alias("old"), x["emotion"].alias("new"))
        return F.struct(F.when(acc["state"].isNull() | F.coalesce(accepted, F.lit(False)), x["emotion"]).otherwise(acc["state"]).alias("state"), F.when(F.coalesce(accepted, F.lit(False)), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    moved = rows.select("call_id", "speaker", F.inline(F.aggregate(numbered, start, step, lambda acc: acc["out"])))
    into = F.col("new").isin(*NEGATIVE_EMOTIONS) & ~F.col("old").isin(*NEGATIVE_EMOTIONS)
    return moved.withColumn("significance", F.when(into, "high").when(F.col("old").isin(*NEGATIVE_EMOTIONS) & F.col("new").isin(*POSITIVE_EMOTIONS), "medium").otherwise("low"))


def emotion_timeline(emotions: DataFrame, windows: int = 30) -> DataFrame:
    """Some thirty windows of each call with the percentage of each emotion."""
    order = Window.partitionBy("call_id").orderBy("segment_id")
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("call_id")) / windows))
    placed = emotions.withColumn("window", F.floor((F.row_number().over(order) - 1) / size))
    return placed.groupBy("call_id", "window").agg(*[F.round(100 * F.count_if(F.col("emotion") == e) / F.count("*"), 4).alias(e) for e in EMOTIONS])


def emotion_by_speaker(emotions: DataFrame) -> DataFrame:
    """Segments of each emotion, a column for each known speaker."""
    return emotions.groupBy("emotion").agg(*[F.count_if(F.col("speaker") == s).alias(s.lower()) for s in ("SPEAKER_00", "SPEAKER_01", "SPEAKER_02")])

"""Shaping of transcripts: speakers, turns, confidence, corrections, call types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal, phrase_hits, tokens, word_count

AGENT, CUSTOMER = ("agent", "speaker a", "speaker_00"), ("customer", "speaker b", "speaker_01")
LOW_CONFIDENCE, UNUSABLE, DEFAULT_SCORE = 0.7, 0.55, 0.5
REGULATED = ("collections", "kyc", "consent", "onboarding", "complaint")

# Fixed values: (pattern, replacement) in the order in which they apply.
TERMS = [("\\bkayak form\\b", "KYC form"), ("\\bpan\\b", "PAN"), ("\\botp\\b", "OTP"), ("\\bemi\\b", "EMI"), ("\\blac\\b", "lakh")]
CONTEXT_TERMS = [("\\bme of (?=\\d)", "EMI of "), ("\\bcivil(?= score)", "CIBIL")]
MAGNITUDES = {"hundred": 100, "thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000, "billion": 1_000_000_000}


def turns_to_segments(turns: DataFrame, words_per_second: float = 2.5) -> DataFrame:
    """Segments from any table of utterances (conv_id, turn, role, text): positions from 0, times from word counts, full confidence."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seconds = F.round(F.greatest(word_count(F.col("text")), F.lit(1)) / F.lit(words_per_second), 2)
    numbered = turns.select(F.col("conv_id").alias("call_id"), (F.row_number().over(order) - 1).alias("segment_id"), F.coalesce("role", F.lit("UNKNOWN")).alias("speaker"), seconds.alias("seconds"), F.coalesce("text", F.lit("")).alias("text"))
    upto = F.sum("seconds").over(Window.partitionBy("call_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("end_s", F.round(upto, 2)).withColumn("start_s", F.round(F.col("end_s") - F.col("seconds"), 2)).select("call_id", "segment_id", "speaker", "start_s", "end_s", F.lit(1.0).alias("confidence"), "text")


def spread_words(segments: DataFrame) -> DataFrame:
    """Evenly spaced word times, where alignment is missing: call_id, segment_id, position, word, start_s, end_s."""
    words = F.filter(F.split(F.col("text"), " "), lambda w: w != "")
    each = segments.select("call_id", "segment_id", "start_s", "end_s", words.alias("w")).where(F.size("w") > 0)
    step = (F.col("end_s") - F.col("start_s")) / F.size("w")
    placed = each.select("call_id", "segment_id", "start_s", step.alias("step"), F.posexplode("w").alias("position", "word"))
    return placed.select("call_id", "segment_id", "position", "word", F.round(F.col("start_s") + F.col("position") * F.col("step"), 3).alias("start_s"), F.round(F.col("start_s") + (F.col("position") + 1) * F.col("step"), 3).alias("end_s"))


def split_by_speaker(words: DataFrame) -> DataFrame:
    """Segments cut wherever the speaker of the words changes; a word without speaker goes on with the one before.

    Input: call_id, position, word, speaker. Output: call_id, part, speaker, first_word, n_words, text.
    """
    order = Window.partitionBy("call_id").orderBy("position")
    known = words.withColumn("who", F.coalesce(F.last("speaker", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("UNKNOWN")))
    turn = known.withColumn("turn", F.when(F.col("who") == F.lag("who").over(order), 0).otherwise(1))
    parts = turn.withColumn("part", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]), " ")
    return parts.groupBy("call_id", "part").agg(F.min("who").alias("speaker"), F.min("position").alias("first_word"), F.count("*").alias("n_words"), text.alias("text"))


def confidence_from_words(segments: DataFrame, scores: DataFrame) -> DataFrame:
    """Segment confidence as the mean of its word scores (call_id, segment_id, score), else its own confidence, else 0.5."""
    means = scores.groupBy("call_id", "segment_id").agg(F.avg("score").alias("mean"))
    return segments.join(means, ["call_id", "segment_id"], "left").select("call_id", "segment_id", F.round(F.coalesce("mean", "confidence", F.lit(DEFAULT_SCORE)), 4).alias("confidence"))


def confidence_summary(segments: DataFrame) -> DataFrame:
    """Per call: mean confidence and the number of segments below 0.7."""
    score = F.coalesce("confidence", F.lit(DEFAULT_SCORE))
    return segments.groupBy("call_id").agg(F.count("*").alias("n_segments"), F.round(F.avg(score), 6).alias("mean_confidence"), F.count_if(score < LOW_CONFIDENCE).alias("n_low"))


def unusable_calls(segments: DataFrame, filler: str = "foreign") -> DataFrame:
    """Per call whether its transcript can't be used: nothing but the filler word, or a mean confidence below 0.55."""
    only = F.bool_and(F.forall(tokens(F.col("text")), lambda w: w == filler)).alias("only_filler")
    mean = F.avg(F.coalesce("confidence", F.lit(DEFAULT_SCORE)))
    return segments.groupBy("call_id").agg(only, F.round(mean, 6).alias("mean_confidence"), (only | (mean < UNUSABLE)).alias("unusable"))


def correct_terms(segments: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Corrects terms in order, ignoring case; corrected and original_text say what was done."""
    text = F.col("text")
    for pattern, replacement in rules if rules is not None else TERMS:
        text = F.regexp_replace(text, f"(?i){pattern}", replacement)
    changed = text != F.col("text")
    return segments.withColumn("corrected", F.coalesce(changed, F.lit(False))).withColumn("original_text", F.when(changed, F.col("text"))).withColumn("text", text)


def correct_names(segments: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Names of organisations as a deployment spells them: aliases as whole words, ignoring case, in order; columns as in ``correct_terms``."""
    return correct_terms(segments, [(rf"\b{re.escape(heard)}\b", re.sub(r"([\\$])", r"\\\1", name)) for heard, name in aliases.items()])


def spoken_amounts(segments: DataFrame) -> DataFrame:
    """Amounts like "5 lakh" as numbers, the text left alone: call_id, segment_id, ord, mention, amount."""
    pattern = r"(?i)\b(\d+(?:\.\d+)?)\s+(hundred|thousand|lakh|million|crore|billion)\b"
    found = segments.select("call_id", "segment_id", F.regexp_extract_all("text", F.lit(pattern), 0).alias("m"))
    each = found.select("call_id", "segment_id", F.posexplode("m").alias("ord", "mention"))
    factor = F.create_map(*[F.lit(x) for pair in MAGNITUDES.items() for x in pair])[F.lower(F.regexp_extract("mention", pattern, 2))]
    return each.withColumn("amount", F.regexp_extract("mention", pattern, 1).cast("double") * factor)


def detect_call_type(segments: DataFrame, phrases: DataFrame, seconds: float = 45, least: int = 2) -> DataFrame:
    """Call type from the keywords of the first seconds: the type of most distinct ones if there are two or more, else general."""
    opening = segments.where(F.col("start_s") < seconds).select("call_id", "segment_id", "text")
    hits = phrase_hits(opening, phrases.where(F.col("category") == "call_type").select("phrase", F.col("subcategory").alias("kind")))
    counted = hits.groupBy("call_id", "kind").agg(F.count_distinct("phrase").alias("n")).where(F.col("n") >= least)
    best = counted.groupBy("call_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("best"))
    return segments.select("call_id").distinct().join(best, "call_id", "left").select("call_id", F.coalesce("best.kind", F.lit("general")).alias("detected_type"), F.coalesce(-F.col("best.n"), F.lit(0)).alias("n_keywords"))


def map_roles(segments: DataFrame) -> DataFrame:
    """Roles by order of first appearance: agent, customer, other in regulated calls, Speaker A and on in others; a lone speaker stays."""
    first = segments.groupBy("call_id", "speaker").agg(F.min("segment_id").alias("first"), F.min("call_type").alias("call_type"))
    per_call = Window.partitionBy("call_id")
    ranked = first.withColumn("rank", F.row_number().over(per_call.orderBy("first", "speaker"))).withColumn("n", F.count("*").over(per_call))
    regulated = F.when(F.col("rank") == 1, "agent").when(F.col("rank") == 2, "customer").otherwise("other")
    role = F.when(F.col("n") < 2, F.col("speaker")).when(F.col("call_type").isin(*REGULATED), regulated).otherwise(F.concat(F.lit("Speaker "), F.char(64 + F.col("rank"))))
    return ranked.select("call_id", "speaker", role.alias("role"))


def with_roles(segments: DataFrame) -> DataFrame:
    """Segments with their speaker's role."""
    return segments.join(map_roles(segments), ["call_id", "speaker"])


def merge_turns(segments: DataFrame, longest: int = 2000) -> DataFrame:
    """Consecutive segments of one speaker as one turn, blank ones left out; the text is cut at ``longest`` characters."""
    order = Window.partitionBy("call_id").orderBy("segment_id")
    spoken = segments.where(F.btrim("text") != "")
    turn = F.when(F.col("speaker") == F.lag("speaker").over(order), 0).otherwise(1)
    numbered = spoken.withColumn("new", turn).withColumn("turn", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("call_id", "turn").agg(F.min("speaker").alias("speaker"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_segments"), F.substring(text, 1, longest).alias("text"))


def talk_time(segments: DataFrame) -> DataFrame:
    """Per call: seconds of talk, and the shares of agent and customer."""
    length = F.col("end_s") - F.col("start_s")
    who = F.lower("speaker")
    total = F.sum(length)
    share = lambda names: F.round(F.coalesce(F.sum(F.when(who.isin(*names), length)) / F.nullif(total, F.lit(0.0)), F.lit(0.0)), 4)
    return segments.groupBy("call_id").agg(total.alias("talk_s"), share(AGENT).alias("agent_share"), share(CUSTOMER).alias("customer_share"))


def opening_speech(segments: DataFrame, seconds: float = 30) -> DataFrame:
    """Segments until the running talk time reaches ``seconds``, the one that reaches it included."""
    order = Window.partitionBy("call_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("end_s") - F.col("start_s")).over(order), F.lit(0.0))
    return segments.withColumn("before", before).where(F.col("before") < seconds).drop("before")


def speaker_counts(segments: DataFrame) -> DataFrame:
    """Distinct speakers per call, at least one."""
    return segments.groupBy("call_id").agg(F.greatest(F.count_distinct("speaker"), F.lit(1)).alias("n_speakers"))


def trim_calls(segments: DataFrame, start: float, end: float) -> DataFrame:
    """Segments that overlap a time range, clipped to it and moved to begin at 0."""
    kept = segments.where((F.col("end_s") > start) & (F.col("start_s") < end))
    return kept.withColumn("start_s", F.greatest("start_s", F.lit(start)) - start).withColumn("end_s", F.least("end_s", F.lit(end)) - start)


def first_mention(segments: DataFrame, phrases: DataFrame) -> DataFrame:
    """The first segment of each call in which a phrase begins."""
    return phrase_hits(segments.select("call_id", "segment_id", "text"), phrases).groupBy("call_id", "phrase").agg(F.min("segment_id").alias("segment_id"))


def display_speaker(segments: DataFrame) -> DataFrame:
    """Speakers as a dashboard shows them."""
    who = F.lower("speaker")
    label = F.when(who.contains("agent") | (who == "speaker_00"), "Agent").when(who.contains("customer") | (who == "speaker_01"), "Customer").otherwise(F.initcap(F.regexp_replace("speaker", "_", " ")))
    return segments.select("call_id", "segment_id", label.alias("label"))


def language_tags(docs: DataFrame, profiles: DataFrame, fallback: str = "en", least: int = 15, share: float = 0.85) -> DataFrame:
    """Language by stop words (lang, word): the one of most hits; short texts and unclear ones get the fallback."""
    words = docs.select("doc_id", "text", F.explode(tokens(F.col("text"))).alias("word"))
    hits = words.join(F.broadcast(profiles), "word").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    best = hits.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("best"), F.sum("n").alias("total"))
    sure = (F.length("text") >= least) & (-F.col("best.n") / F.col("total") >= share)
    return docs.join(best, "doc_id", "left").select("doc_id", F.when(sure, F.col("best.lang")).otherwise(fallback).alias("tag"))


def language_profile(tags: DataFrame, group: str) -> DataFrame:
    """Per group: tags counted, the main language, and whether over a tenth of them differ from it."""
    counts = tags.groupBy(group, "tag").count()
    main = counts.groupBy(group).agg(F.min(F.struct((-F.col("count")).alias("n"), "tag")).alias("best"), F.sum("count").alias("total"), F.count("*").alias("n_languages"))
    return main.select(group, F.col("best.tag").alias("main"), "total", "n_languages", ((F.col("total") + F.col("best.n")) / F.col("total") > 0.1).alias("switching"))


def normal_text(segments: DataFrame) -> DataFrame:
    """Text as the phrase joins see it."""
    return segments.select("call_id", "segment_id", normal(F.col("text")).alias("normal"))


# Words that follow a cue but are no names.
NO_NAMES = ["calling", "from", "the", "and", "you", "sir", "madam", "your", "here"]


def name_speakers(segments: DataFrame, reach: int = 4, least: int = 2) -> DataFrame:
    """Names of speakers: two points for introducing oneself, two for the next other speaker within four segments after "X, over to you", from two points on; one name per speaker and one speaker per name, the most points first."""
    who = lambda pattern: F.lower(F.regexp_extract("text", pattern, 1))
    own = segments.select("call_id", "speaker", who(r"(?i)\bmy name is ([A-Z][a-z]+)").alias("name"), F.lit(2).alias("points"))
    handed = segments.select("call_id", F.col("segment_id").alias("at"), F.col("speaker").alias("by"), who(r"(?i)\bthank you, ([A-Z][a-z]+), over to you").alias("name")).where("name <> ''")
    near = handed.join(segments.select("call_id", "segment_id", "speaker"), "call_id").where((F.col("segment_id") > F.col("at")) & (F.col("segment_id") <= F.col("at") + reach) & (F.col("speaker") != F.col("by")))
    first = near.groupBy("call_id", "at", "name").agg(F.min(F.struct("segment_id", "speaker")).alias("x")).select("call_id", F.col("x.speaker").alias("speaker"), "name", F.lit(2).alias("points"))
    good = own.unionByName(first).where((F.length("name") > 2) & ~F.col("name").isin(*NO_NAMES))
    sums = good.groupBy("call_id", "speaker", "name").agg(F.sum("points").alias("points")).where(F.col("points") >= least)
    best = sums.withColumn("k", F.row_number().over(Window.partitionBy("call_id", "speaker").orderBy(F.desc("points"), "name"))).where("k = 1").drop("k")
    return best.withColumn("k", F.row_number().over(Window.partitionBy("call_id", "name").orderBy(F.desc("points"), "speaker"))).where("k = 1").drop("k")


def _escaped(text: Column) -> Column:
    for plain, safe in HTML_ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


#: Characters that have a meaning in HTML text and attributes; the ampersand first.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def mark_entities(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """Text escaped for HTML, with the first place of each entity's mention marked.

    Places are those in the plain text; where they overlap, the longer mention is
    marked, then the first by place, then by type. The markup is put together
    once, so that no mention is looked for in it.
    """
    at = F.call_function("instr", F.col("text"), F.col("mention"))
    found = entities.select("call_id", "segment_id", "mention", "entity_type").where("mention <> ''").distinct().join(segments.select("call_id", "segment_id", "text"), ["call_id", "segment_id"])
    found = found.withColumn("start", at).where("start > 0").select("call_id", "segment_id", F.struct((-F.length("mention")).alias("n"), "start", "entity_type", (F.col("start") + F.length("mention")).alias("stop")).alias("x"))
    lists = found.groupBy("call_id", "segment_id").agg(F.array_sort(F.collect_list("x")).alias("found"))
    none = F.array().cast("array<struct<start: int, stop: int, entity_type: string>>")
    place = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["entity_type"].alias("entity_type"))
    apart = lambda taken, x: F.forall(taken, lambda t: (x["start"] >= t["stop"]) | (x["stop"] <= t["start"]))
    chosen = F.array_sort(F.aggregate("found", none, lambda taken, x: F.when(apart(taken, x), F.concat(taken, F.array(place(x)))).otherwise(taken)))
    joined = segments.join(lists.select("call_id", "segment_id", chosen.alias("spans")), ["call_id", "segment_id"], "left").withColumn("spans", F.coalesce("spans", none))
    before = lambda k: F.when(k > 0, F.element_at("spans", F.greatest(k, F.lit(1)))["stop"]).otherwise(1)
    piece = lambda low, high: _escaped(F.substring("text", low, high - low))
    marked = F.transform("spans", lambda s, k: F.concat(piece(before(k), s["start"]), F.lit('<mark class="'), _escaped(s["entity_type"]), F.lit('">'), piece(s["start"], s["stop"]), F.lit("</mark>")))
    rest = piece(before(F.size("spans")), F.length("text") + 1)
    return joined.select("call_id", "segment_id", F.concat(F.array_join(marked, ""), rest).alias("html"))

"""Scoring, guarding and assembling call records; the index of calls; questions about the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of call types.
WEIGHTS = {"collections": 1.5, "kyc": 2.0, "consent": 1.5, "complaint": 1.2, "onboarding": 1.0, "general": 0.3}
LEVELS = ("low", "medium", "high", "critical")


def weight(call_type: Column) -> Column:
    """The weight of a call type, 1 for others."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[call_type], F.lit(1.0))


def score_calls(calls: DataFrame, checks: DataFrame, signals: DataFrame) -> DataFrame:
    """Per call (call_id, call_type): failed checks and signals, risk level, compliance score, review flag, priority and reasons."""
    failed = checks.where("not passed").groupBy("call_id").agg(F.count("*").alias("violations"), F.bool_or(F.col("severity") == "critical").alias("critical_failed"))
    fraud = signals.groupBy("call_id").agg(F.count("*").alias("fraud"))
    return _scored(calls.join(failed, "call_id", "left").join(fraud, "call_id", "left").select("call_id", "call_type", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("critical_failed", F.lit(False)).alias("critical_failed"), F.coalesce("fraud", F.lit(0)).alias("fraud")))


def score_judged(judged: DataFrame) -> DataFrame:
    """``score_calls`` where the checks and signals of a call lie in arrays of its row (call_id, call_type, checks, signals): nothing is shuffled."""
    failed = F.filter("checks", lambda x: ~x["passed"])
    return _scored(judged.select("call_id", "call_type", F.size(failed).cast("long").alias("violations"), F.exists(failed, lambda x: x["severity"] == "critical").alias("critical_failed"), F.size("signals").cast("long").alias("fraud")))


def _scored(joined: DataFrame) -> DataFrame:
    """Calls with violations, critical_failed and fraud, scored."""
    w = weight(F.col("call_type"))
    v, f = F.col("violations") * w, F.col("fraud") * w
    risk = F.when((F.col("critical_failed") & (w >= 1)) | (v >= 3) | (f >= 2), "critical").when((v >= 2) | (f >= 1), "high").when(v >= 1, "medium").otherwise("low")
    scored = joined.withColumn("risk_level", risk).withColumn("compliance_score", F.greatest(F.lit(100) - F.col("violations") * F.floor(15 * w), F.lit(0)).cast("int"))
    review = F.col("risk_level").isin("high", "critical")
    priority = F.when(F.col("risk_level") == "critical", 1).when(F.col("risk_level") == "high", 2).when((F.col("fraud") > 0) | (F.col("violations") > 0), 3).otherwise(5)
    reasons = F.filter(F.array(F.when(review, F.concat(F.lit("risk "), "risk_level")), F.when(F.col("violations") > 0, F.concat("violations", F.lit(" failed checks"))), F.when(F.col("fraud") > 0, F.concat("fraud", F.lit(" fraud signals"))), F.when(F.col("compliance_score") < 50, "low compliance score")), lambda x: x.isNotNull())
    return scored.withColumn("review_required", review).withColumn("priority", priority).withColumn("review_reasons", F.array_join(reasons, "; "))


#: Emotions of a customer that count as an escalation (fixed values).
UPSET = ("angry", "frustrated")


def escalations(calls: DataFrame, intents: DataFrame, emotions: DataFrame) -> DataFrame:
    """Whether a call escalated: call_id, customer_emotion, escalated.

    It did if an utterance asks for escalation or the customer's emotion is one of
    UPSET. That emotion is the most frequent of the customer's annotations
    (``emotions``: call_id, emotion), ties by name, null ones left out, null where
    there are none. Both sides are added up in their tasks before the join.
    """
    asked = intents.where("intent = 'escalation'").groupBy("call_id").agg(F.lit(True).alias("_asked"))
    counts = emotions.where("emotion is not null").groupBy("call_id", "emotion").agg(F.count("*").alias("n"))
    felt = counts.groupBy("call_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "emotion")).alias("_felt")).select("call_id", F.col("_felt.emotion").alias("customer_emotion"))
    joined = calls.select("call_id").distinct().join(asked, "call_id", "left").join(felt, "call_id", "left")
    upset = F.coalesce(F.col("customer_emotion").isin(*UPSET), F.lit(False))
    return joined.select("call_id", "customer_emotion", (F.col("_asked").isNotNull() | upset).alias("escalated"))


def review_queue(scored: DataFrame, first: int | None = None) -> DataFrame:
    """Calls to be reviewed; with ``first``, that many of the most urgent and newest, in order (the whole queue isn't sorted: its readers page through it)."""
    queue = scored.where("review_required")
    return queue if first is None else queue.orderBy("priority", F.desc("call_id")).limit(first)


def canonical_numbers(text: Column) -> Column:
    """The numbers of a text without separators and needless zeros."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:,\d{2,3})*(?:\.\d+)?"), 0), lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.0+$", ""))


def supported_numbers(segments: DataFrame) -> DataFrame:
    """Per call the distinct numbers of its transcript: call_id, number."""
    return segments.select("call_id", F.explode(canonical_numbers(F.col("text"))).alias("number")).distinct()


def guard_summary(summaries: DataFrame, segments: DataFrame) -> DataFrame:
    """Replaces figures of a summary (call_id, summary) that the transcript doesn't support, unless they are whole numbers up to 100, by [unverified]; n_unverified counts them."""
    known = supported_numbers(segments).groupBy("call_id").agg(F.collect_set("number").alias("known"))
    joined = summaries.join(known, "call_id", "left")
    words = F.split("summary", " ")

    def plain(w: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_extract(w, r"^[^\d]*(\d+(?:,\d{2,3})*(?:\.\d+)?)[^\d]*$", 1), ",", ""), r"\.0+$", "")

    def unsupported(w: Column) -> Column:
        n = plain(w)
        return (n != "") & ~F.coalesce(F.array_contains("known", n), F.lit(False)) & ~(n.rlike(r"^\d{1,3}$") & (F.coalesce(n.try_cast("int"), F.lit(1000)) <= 100))

    return joined.select("call_id", F.array_join(F.transform(words, lambda w: F.when(unsupported(w), "[unverified]").otherwise(w)), " ").alias("summary"), F.size(F.filter(words, unsupported)).alias("n_unverified"))


def fallback_summary(scored: DataFrame, segments: DataFrame) -> DataFrame:
    """A summary from what is known of a call."""
    facts = segments.groupBy("call_id").agg(F.count("*").alias("n"), F.count_distinct("speaker").alias("who"), F.max("end_s").alias("length"))
    return scored.join(facts, "call_id").select("call_id", F.format_string("%s call with %d segments by %d speakers over %d seconds; risk %s, %d failed checks, %d fraud signals.", F.initcap("call_type"), "n", "who", F.col("length").cast("long"), "risk_level", "violations", "fraud").alias("summary"))


def discussion_topics(intents: DataFrame, least: float = 0.02) -> DataFrame:
    """Shares of intents in a call, from two percent on."""
    counts = intents.groupBy("call_id", "intent").count()
    total = F.sum("count").over(Window.partitionBy("call_id"))
    return counts.withColumn("share", F.round(F.col("count") / total, 4)).where(F.col("share") >= least).select("call_id", F.initcap(F.replace("intent", F.lit("_"), F.lit(" "))).alias("topic"), F.col("count").alias("n"), "share")


def topic_sentiment(intents: DataFrame, scored_segments: DataFrame) -> DataFrame:
    """Mean lexicon sentiment of each intent of a call."""
    return intents.join(scored_segments.select("call_id", "segment_id", "score"), ["call_id", "segment_id"]).groupBy("call_id", "intent").agg(F.round(F.avg("score"), 6).alias("sentiment"))


def effectiveness(segments: DataFrame, intents: DataFrame) -> DataFrame:
    """Words, questions, balance of the two most talkative speakers, and information requests of a call."""
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    per = segments.groupBy("call_id", "speaker").agg(F.count("*").alias("n"), F.sum(words).alias("words"))
    w = Window.partitionBy("call_id").orderBy(F.desc("n"), "speaker")
    ranked = per.withColumn("k", F.row_number().over(w))
    sums = ranked.groupBy("call_id").agg(F.sum("words").alias("words"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("n"))).alias("second"))
    asked = intents.groupBy("call_id").agg(F.round(F.avg((F.col("intent") == "information_request").cast("double")), 4).alias("information_rate"), F.count_if(F.col("intent") == "question").alias("questions"))
    return sums.join(asked, "call_id").select("call_id", "words", "questions", "information_rate", F.round(100 * F.coalesce("second", F.lit(0)) / F.col("first"), 4).alias("balance"))


def recommendations(effect: DataFrame) -> DataFrame:
    """Lines of advice from what a call was like."""
    lines = F.filter(F.array(F.when(F.col("words") > 5000, "shorten the call"), F.when(F.col("balance") < 20, "let the other side speak"), F.when(F.col("information_rate") > 0.5, "send the facts beforehand")), lambda x: x.isNotNull())
    return effect.select("call_id", F.when(F.size(lines) == 0, "no action needed").otherwise(F.array_join(lines, "; ")).alias("advice"))


def degradations(ran: DataFrame, expected: list[str]) -> DataFrame:
    """Components (call_id, component) that didn't run: what they would have found is unknown, not absent."""
    wanted = ran.select("call_id").distinct().select("call_id", F.explode(F.array(*map(F.lit, expected))).alias("component"))
    return wanted.join(ran.select("call_id", "component").distinct(), ["call_id", "component"], "left_anti")


def validate(scored: DataFrame) -> DataFrame:
    """Calls with the names of rules they break: scores 0 to 100, priorities 1 to 5, known risk levels."""
    rules = F.filter(F.array(F.when(~F.col("compliance_score").between(0, 100), "compliance_score"), F.when(~F.col("priority").between(1, 5), "priority"), F.when(~F.col("risk_level").isin(*LEVELS), "risk_level")), lambda x: x.isNotNull())
    return scored.select("call_id", F.array_join(rules, ",").alias("broken"), (F.size(rules) == 0).alias("ok"))


def assemble(scored: DataFrame, **children: DataFrame) -> DataFrame:
    """One nested record for each call: every child table becomes a sorted array of structs, empty where it has no rows."""
    out = scored
    for name, child in children.items():
        columns = [c for c in child.columns if c != "call_id"]
        lists = child.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        kind = lists.schema[name].dataType
        out = out.join(lists, "call_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def flatten(records: DataFrame) -> DataFrame:
    """One flat row for each record, with counts of its nested lists."""
    return records.select("call_id", "call_type", "risk_level", "compliance_score", "review_required", "priority", F.size("segments").alias("n_segments"), F.size("intents").alias("n_intents"), F.size("checks").alias("n_checks"), F.size(F.filter("checks", lambda x: ~x["passed"])).alias("n_failed"), F.size("entities").alias("n_entities"), F.size("signals").alias("n_signals"), F.substring("review_reasons", 1, 500).alias("reasons"))


def flat_records(judged: DataFrame, **children: DataFrame) -> DataFrame:
    """The rows of ``flatten`` from judged calls (call_id, call_type, checks, signals) and child tables, without their nested lists: children are counted as n_<name>, added up in their tasks."""
    own = judged.select("call_id", F.size("checks").alias("n_checks"), F.size(F.filter("checks", lambda x: ~x["passed"])).alias("n_failed"), F.size("signals").alias("n_signals"))
    out = score_judged(judged).join(own, "call_id")
    for name, child in children.items():
        out = out.join(child.groupBy("call_id").agg(F.count("*").alias(f"n_{name}")), "call_id", "left")
    count = lambda name: F.coalesce(f"n_{name}", F.lit(0)).cast("int").alias(f"n_{name}")
    return out.select("call_id", "call_type", "risk_level", "compliance_score", "review_required", "priority", count("segments"), count("intents"), "n_checks", "n_failed", count("entities"), "n_signals", F.substring("review_reasons", 1, 500).alias("reasons"))


#: The columns of a call's flat row; those that nothing is known of stay null, counts 0.
FLAT = {
    "source": "string", "duration_s": "double", "language": "string", "mixed": "boolean", "call_type": "string", "quality_score": "double", "quality_flag": "string", "snr_db": "double", "confidence": "double",
    "n_speakers": "long", "agent_share": "double", "customer_share": "double", "n_intents": "long", "n_entities": "long", "n_obligations": "long", "n_binding": "long", "n_failed": "long", "n_signals": "long", "n_personal": "long",
    "n_toxic": "long", "tamper_risk": "string", "compliance_score": "int", "risk_level": "string", "customer_emotion": "string", "escalated": "boolean", "review_required": "boolean", "priority": "int", "summary": "string",
}


def flat_calls(scored: DataFrame, *facts: DataFrame) -> DataFrame:
    """One row of 29 columns for each scored call: call_id and those of FLAT, from tables of one row for each call; summaries are cut at 200 characters."""
    out = scored.select("call_id", *[c for c in FLAT if c in scored.columns])
    for table in facts:
        out = out.join(table.select("call_id", *[c for c in FLAT if c in table.columns]), "call_id", "left")
    value = lambda c: F.col(c) if c in out.columns else F.lit(None)
    shown = {c: F.coalesce(value(c), F.lit(0)) if c.startswith("n_") else F.left(value(c), F.lit(200)) if c == "summary" else value(c) for c in FLAT}
    return out.select("call_id", *[shown[c].cast(kind).alias(c) for c, kind in FLAT.items()])


def explode_child(records: DataFrame, name: str) -> DataFrame:
    """A nested list as rows."""
    return records.select("call_id", F.inline(name))


def intent_export(intents: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each utterance with its text, empty where there is none."""
    return intents.join(segments.select("call_id", "segment_id", "text"), ["call_id", "segment_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def intent_pairs(intents: DataFrame, segments: DataFrame) -> DataFrame:
    """Training pairs of text and intent; blank texts are left out."""
    return intents.join(segments.select("call_id", "segment_id", "text"), ["call_id", "segment_id"]).where(F.btrim("text") != "").select("call_id", "segment_id", "text", "intent")


def sentiment_pairs(scored_segments: DataFrame) -> DataFrame:
    """Training pairs of text and sentiment: five characters or more, scores of 0 left out, positive and negative from 0.15 on."""
    s = F.col("score")
    return scored_segments.where((F.length("text") >= 5) & (s != 0)).select("call_id", "segment_id", "text", F.when(s > 0.15, "positive").when(s < -0.15, "negative").otherwise("neutral").alias("label"))


def span_pairs(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """Training pairs of text and entity spans: the first place of each mention, those not found left out."""
    placed = entities.join(segments.select("call_id", "segment_id", "text"), ["call_id", "segment_id"]).withColumn("start", F.instr("text", F.col("mention")) - 1).where("start >= 0")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.length("mention")).alias("stop"), "entity_type")))
    return placed.groupBy("call_id", "segment_id").agg(F.min("text").alias("text"), F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["stop"], x["entity_type"])), " ").alias("spans"))


def upsert(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index with changes: of each call the row of highest version, ties to the changes."""
    both = index.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("call_id").orderBy(F.desc("version"), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


#: Columns of an index row and what stands for a missing, empty or zero value; language is looked for in two columns.
INDEXED = {
    "source": ("string", None), "duration_s": ("double", 0.0), "language": ("string", "en"), "call_type": ("string", None), "n_speakers": ("int", 0), "risk_level": ("string", "low"), "compliance_score": ("int", 0),
    "review_required": ("boolean", False), "priority": ("int", 5), "summary": ("string", ""), "n_personal": ("int", 0), "tamper_risk": ("string", "none"),
}
SUMMARY = 500


def index_rows(records: DataFrame) -> DataFrame:
    """The index row of each record: call_id, columns of INDEXED, review_reasons and degradations as JSON lists, and version where there is one.

    A record may lack any column but call_id. Empty text counts as missing, a
    priority of 0 stays. The language that was detected precedes the one that was
    told. Summaries are cut at SUMMARY characters. Of degradations
    (arrays of structs) the components are listed; null lists are empty ones.
    """
    have = dict(records.dtypes)

    def value(name: str, kind: str) -> Column:
        found = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return F.nullif(found, F.lit("")) if kind == "string" else found

    rows = {name: F.coalesce(value(name, kind), F.lit(default).cast(kind)) for name, (kind, default) in INDEXED.items()}
    rows["language"] = F.coalesce(value("detected_language", "string"), rows["language"])
    rows["summary"] = F.substring(rows["summary"], 1, SUMMARY)
    none = F.array().cast("array<string>")
    lists = {"review_reasons": F.col("review_reasons") if "review_reasons" in have else none, "degradations": F.col("degradations.component") if "degradations" in have else none}
    lists = {name: F.to_json(F.coalesce(column, none)) for name, column in lists.items()}
    version = ["version"] if "version" in have else []
    return records.select("call_id", *version, *[column.alias(name) for name, column in (rows | lists).items()])


def rebuild(records: DataFrame) -> DataFrame:
    """The index made anew from all records: of each call the row of highest version, ties by the largest other values in order; rows without call_id go."""
    rest = [c for c in records.columns if c not in ("call_id", "version")]
    best = records.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.max(F.struct("version", *rest)).alias("_best"))
    return best.select(*[c if c == "call_id" else F.col(f"_best.`{c}`") for c in records.columns])


def staleness(index: DataFrame, records: DataFrame) -> DataFrame:
    """Calls whose index row is missing, left over, or of another version."""
    joined = index.select("call_id", F.col("version").alias("a")).join(records.select("call_id", F.col("version").alias("b")), "call_id", "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "left over").when(F.col("a") != F.col("b"), "outdated")
    return joined.select("call_id", state.alias("state")).where("state is not null")


def apply_actions(scored: DataFrame, actions: DataFrame) -> DataFrame:
    """The latest valid action (call_id, at, action) of each call: approve clears the review flag, escalate sets priority 1, reject is only recorded."""
    latest = actions.where(F.col("action").isin("approve", "reject", "escalate")).groupBy("call_id").agg(F.max(F.struct("at", "action")).alias("x"))
    done = scored.join(latest, "call_id", "left").withColumn("action", F.col("x.action")).drop("x")
    return done.withColumn("review_required", F.when(F.col("action") == "approve", False).otherwise(F.col("review_required"))).withColumn("priority", F.when(F.col("action") == "escalate", 1).otherwise(F.col("priority")))


def portfolio(scored: DataFrame, lengths: DataFrame) -> DataFrame:
    """Count, mean length and score, calls above 80, high risks, review rate."""
    joined = scored.join(lengths, "call_id")
    return joined.agg(F.count("*").alias("calls"), F.round(F.avg("length"), 4).alias("mean_length"), F.round(F.avg("compliance_score"), 4).alias("mean_score"), F.count_if(F.col("compliance_score") >= 80).alias("above_80"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk"), F.round(F.avg(F.col("review_required").cast("double")), 4).alias("review_rate"))


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Calls of every risk level, with zeros, and the total."""
    levels = scored.sparkSession.createDataFrame([(x,) for x in LEVELS], "risk_level string")
    counts = levels.join(scored.groupBy("risk_level").agg(F.count("*").alias("n")), "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def score_histogram(scored: DataFrame) -> DataFrame:
    """Compliance scores in five bins, empty ones included."""
    counts = scored.groupBy(F.least(F.floor(F.col("compliance_score") / 20), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return scored.sparkSession.range(5).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def list_calls(scored: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of calls, the newest first."""
    return scored.orderBy(F.desc("call_id")).offset(offset).limit(min(max(limit, 1), 500))


def call_status(scored: DataFrame) -> DataFrame:
    """Status as a dashboard shows it."""
    return scored.select("call_id", F.when(F.col("review_required") & (F.col("priority") == 1), "escalated").when(F.col("review_required"), "in review").otherwise("done").alias("status"))


def pass_rates(checks: DataFrame) -> DataFrame:
    """Share of checks that a call passed."""
    return checks.groupBy("call_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))


def language_shares(tags: DataFrame) -> DataFrame:
    """Share of each language, the largest first."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4)).orderBy(F.desc("n"), "tag")


def audit_digest(scored: DataFrame, checks: DataFrame, signals: DataFrame, segments: DataFrame, calls: int = 20) -> DataFrame:
    """For the latest twenty calls: a line of facts with five violations, three fraud types and the longest segment."""
    last = scored.orderBy(F.desc("call_id")).limit(calls)
    first = lambda rows, column, n: rows.groupBy("call_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, n), ", ").alias("list"))
    failed = first(checks.where("not passed").join(last.select("call_id"), "call_id"), "check_name", 5).withColumnRenamed("list", "failed")
    fraud = first(signals.join(last.select("call_id"), "call_id"), "signal_type", 3).withColumnRenamed("list", "kinds")
    longest = segments.join(last.select("call_id"), "call_id").groupBy("call_id").agg(F.min(F.struct((-F.length("text")).alias("n"), "segment_id", "text")).alias("x")).select("call_id", F.col("x.text").alias("longest"))
    joined = last.join(failed, "call_id", "left").join(fraud, "call_id", "left").join(longest, "call_id", "left")
    return joined.select("call_id", F.concat_ws(" | ", "call_type", "risk_level", F.coalesce("failed", F.lit("-")), F.coalesce("kinds", F.lit("-")), "longest").alias("line"))


def time_breakdown(timings: DataFrame) -> DataFrame:
    """Stage times (call_id, timings map) with their share of the call."""
    rows = timings.select("call_id", F.explode("timings").alias("stage", "seconds"))
    return rows.withColumn("share", F.round(F.col("seconds") / F.nullif(F.sum("seconds").over(Window.partitionBy("call_id")), F.lit(0.0)), 4))


def latest_progress(events: DataFrame, finished: DataFrame) -> DataFrame:
    """The latest state of each call (call_id, at, status); unfinished ones are complete if a record exists and failed else."""
    last = events.groupBy("call_id").agg(F.max(F.struct("at", "status")).alias("x")).select("call_id", F.col("x.status").alias("status"))
    joined = last.join(finished.select("call_id").distinct().withColumn("there", F.lit(True)), "call_id", "left")
    open_ = ~F.col("status").isin("complete", "error")
    return joined.select("call_id", F.when(open_ & F.col("there"), "complete").when(open_, "error").otherwise(F.col("status")).alias("status"))


def batch_summary(segments: DataFrame, unusable: float = 0.05) -> DataFrame:
    """Calls of a batch by outcome: failed if a segment is hardly understood at all."""
    per = segments.groupBy("call_id").agg(F.min("confidence").alias("least"), F.count("*").alias("n"))
    return per.groupBy(F.when(F.col("least") < unusable, "failed").otherwise("done").alias("status")).agg(F.count("*").alias("n"), F.sum("n").alias("segments"))


def compliance_view(scored: DataFrame, checks: DataFrame, signals: DataFrame) -> DataFrame:
    """Score, reasons, names of failed checks and kinds of signals of each call."""
    names = lambda rows, column, name: rows.groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(name))
    joined = scored.join(names(checks.where("not passed"), "check_name", "failed"), "call_id", "left").join(names(signals, "signal_type", "kinds"), "call_id", "left")
    return joined.select("call_id", "compliance_score", "review_reasons", F.coalesce("failed", F.lit("")).alias("failed"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def score_checks(checks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Checks against expectations (call_id, check_name, want: whether it should pass; unknown ones should): hits, spurious failures and misses per check."""
    want = F.coalesce("want", F.lit(True))
    return checks.join(wanted, ["call_id", "check_name"], "left").groupBy("check_name").agg(F.count("*").alias("n"), F.count_if(~want & ~F.col("passed")).alias("hits"), F.count_if(want & ~F.col("passed")).alias("spurious"), F.count_if(~want & F.col("passed")).alias("misses"))

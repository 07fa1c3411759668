"""Compliance checks of calls. A check is a row call_id, check_name, passed, severity, segment_id, evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_places
from .transcript import AGENT, CUSTOMER, REGULATED

CRITICAL_CATEGORIES = ("threats", "coercion", "misleading")
#: Cues that make an utterance worth a closer look.
RISK_CUES = r"(?i)\b(?:warrant|police|last chance|house|employer|wife|otp|cvv|arrest|legal)\b"
VERDICTS = {"threat": "critical", "coercion": "critical", "misleading": "critical", "harassment": "high", "privacy": "high"}
COLUMNS = ["call_id", "check_name", "passed", "severity", "segment_id", "evidence"]


def remap_severity(call_type: Column, raw: Column) -> Column:
    """Raw severity by call type: as it is for collections, kyc and consent; one level down for complaint and onboarding; low otherwise."""
    down = F.when(raw == "critical", "high").when(raw == "high", "medium").otherwise("low")
    return F.when(call_type.isin("collections", "kyc", "consent"), raw).when(call_type.isin("complaint", "onboarding"), down).otherwise("low")


_CHECKS = "array<struct<check_name: string, passed: boolean, severity: string, segment_id: int, evidence: string>>"
#: Notices where personal data is asked for: category of phrases, check, severity.
NOTICES = [("data_purpose", "purpose_notice", "high"), ("data_consent", "consent_obtained", "critical"), ("data_rights", "rights_notice", "medium")]


#: The part of a call that phrases of a category are looked for in, and the categories that are looked for in the whole call.
PARTS = {"required": "opening", "prohibited": "agent", "third_party": "agent", "end_call": "customer"}
WHOLE = ("fraud", "disclaimer", "data_request", *[n[0] for n in NOTICES], "sensitive_id")


def call_facts(segments: DataFrame, vocab: DataFrame, seconds: float = 30) -> DataFrame:
    """A row for each call with all that checks and signals ask for: call_id, call_type, agent_s, customer_s, spoken_s, last_s, speakers, turns (the agent's segments), said, required, notices.

    ``said`` has an element for each phrase of the vocabulary that is in the part of
    the call where its category is looked for (PARTS, else the whole), with the first
    ``segment``; its length is bounded by that of the vocabulary. Each of these parts
    of a call is read as one text, so that a phrase may go over several of its
    segments; it counts where it begins. Segments are shuffled and sorted once for
    all checks. Categories that no check or signal asks for are left out.
    """
    is_agent, is_customer = F.coalesce(F.lower("speaker").isin(*AGENT), F.lit(False)), F.coalesce(F.lower("speaker").isin(*CUSTOMER), F.lit(False))
    w, length = Window.partitionBy("call_id").orderBy("segment_id"), F.col("end_s") - F.col("start_s")
    marked = segments.select("call_id", "call_type", F.col("segment_id").cast("int").alias("segment_id"), "speaker", "text", "end_s", length.alias("length"), is_agent.alias("is_agent"), is_customer.alias("customer"))
    everywhere, before = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumns({"_has": F.max("is_agent").over(everywhere), "_of_agent": F.sum(F.when(F.col("is_agent"), F.col("length"))).over(before), "_of_all": F.sum("length").over(before)})
    spoken = F.coalesce(F.when(F.col("_has"), F.col("_of_agent")).otherwise(F.col("_of_all")), F.lit(0.0))
    marked = marked.withColumn("agent", F.col("is_agent") | ~F.col("_has"))  # the agent's, or all where no speaker is an agent
    marked = marked.withColumns({"opening": F.col("agent") & (spoken < seconds), "whole": F.lit(True)}).drop("_has", "_of_agent", "_of_all")
    spent = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("length"))), F.lit(0.0))
    facts = {"call_type": F.min("call_type"), "agent_s": spent("is_agent"), "customer_s": spent("customer"), "spoken_s": F.sum("length"), "last_s": F.max("end_s"), "speakers": F.array_sort(F.collect_set("speaker")), "turns": F.collect_list(F.when(F.col("is_agent"), F.col("segment_id")))}
    part_of = F.coalesce(F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])[F.col("category")], F.lit("whole"))
    once = vocab.where(F.col("category").isin(*PARTS, *WHOLE)).groupBy("category", "subcategory", "phrase").agg(F.min("ord").alias("ord")).withColumn("part", part_of)
    calls = first_places(marked, once, ("whole", "agent", "opening", "customer"), **facts)
    part = lambda k: F.split_part("subcategory", F.lit("/"), F.lit(k))
    rules = vocab.where("category in ('required', 'disclaimer')").select(F.when(F.col("category") == "required", part(1)).otherwise("general").alias("call_type"), "category", F.when(F.col("category") == "required", part(2)).otherwise(F.col("subcategory")).alias("name"))
    names = lambda category: F.array_sort(F.collect_set(F.when(F.col("category") == category, F.col("name"))))
    wanted = rules.groupBy("call_type").agg(names("required").alias("required"), names("disclaimer").alias("notices"))
    return calls.join(F.broadcast(wanted), "call_type", "left")


def _check(name: Column, passed: Column, severity: Column, segment: Column, evidence: Column | None = None) -> Column:
    return F.struct(name.alias("check_name"), passed.alias("passed"), severity.alias("severity"), segment.cast("int").alias("segment_id"), (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"))


def _said(category: str, more: Callable[[Column], Column] | None = None) -> Column:
    """The elements of ``said`` of a category."""
    kept = lambda x: (x["category"] == category) & (F.lit(True) if more is None else more(x))
    return F.filter("said", kept)


def _least(found: Column) -> Column:
    return F.array_min(F.transform(found, lambda x: x["segment"]))


def _named(names: str, category: str, subcategory: Callable[[Column], Column], raw: str | None) -> Column:
    """A check for each name: passed if one of its phrases is there."""

    def one(name: Column) -> Column:
        segment = _least(_said(category, lambda x: x["subcategory"] == subcategory(name)))
        severity = F.lit("low") if raw is None else F.when(segment.isNotNull(), "low").otherwise(remap_severity(F.col("call_type"), F.lit(raw)))
        return _check(name, segment.isNotNull(), severity, segment)

    return F.transform(F.coalesce(names, F.array().cast("array<string>")), one)


def _required() -> Column:
    found = _named("required", "required", lambda name: F.concat("call_type", F.lit("/"), name), "high")
    return F.when(F.col("call_type").isin(*REGULATED), found)


def _failed(category: str, name: Callable[[Column], Column], severity: Callable[[Column], Column]) -> Column:
    return F.transform(_said(category), lambda x: _check(name(x), F.lit(False), severity(x), x["segment"], x["phrase"]))


def _prohibited() -> Column:
    raw = lambda x: F.when(x["subcategory"].isin(*CRITICAL_CATEGORIES), "critical").otherwise("high")
    return _failed("prohibited", lambda x: F.concat(F.lit("prohibited_"), x["subcategory"]), lambda x: remap_severity(F.col("call_type"), raw(x)))


def _third_party() -> Column:
    return F.array_distinct(_failed("third_party", lambda x: F.lit("third_party_disclosure"), lambda x: F.lit("critical")))


def _domination(share: float) -> Column:
    over = (F.col("call_type") == "collections") & (F.col("agent_s") / F.nullif(F.col("agent_s") + F.col("customer_s"), F.lit(0.0)) > share)
    return F.when(over, F.array(_check(F.lit("agent_domination"), F.lit(False), F.lit("medium"), F.lit(None))))


def _ignored_end(most: int) -> Column:
    asked = F.array_min(F.transform(_said("end_call"), lambda x: F.struct(x["ord"].alias("ord"), x["segment"].alias("segment"), x["phrase"].alias("phrase"))))

    def check(x: Column) -> Column:
        later = F.size(F.filter("turns", lambda t: t > x["segment"]))
        return F.when(later > most, _check(F.lit("ignored_end_request"), F.lit(False), F.lit("high"), x["segment"], x["phrase"]))

    # a variable of a function holds the request, as its expression would be computed anew for each turn
    return F.filter(F.transform(F.filter(F.array(asked), lambda x: x.isNotNull()), check), lambda x: x.isNotNull())


def _notices() -> Column:
    return F.when(F.col("call_type") == "general", _named("notices", "disclaimer", lambda name: name, None))


def _protection() -> Column:
    def notice(category: str, name: str, raw: str) -> Column:
        segment = _least(_said(category))
        return _check(F.lit(name), segment.isNotNull(), F.when(segment.isNotNull(), "low").otherwise(remap_severity(F.col("call_type"), F.lit(raw))), segment)

    asked = F.when(F.size(_said("data_request")) > 0, F.array(*[notice(*n) for n in NOTICES]))
    found = _said("sensitive_id")
    evidence = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["phrase"]))), ", ")
    sensitive = _check(F.lit("data_minimisation"), F.lit(False), remap_severity(F.col("call_type"), F.lit("high")), _least(found), evidence)
    outside = F.when((F.size(found) > 0) & ~F.col("call_type").isin("kyc", "onboarding"), F.array(sensitive))
    return _joined(asked, outside)


def _joined(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast(_CHECKS), F.array().cast(_CHECKS)) for p in parts])


def _rows(facts: DataFrame, *parts: Column) -> DataFrame:
    return facts.select("call_id", F.inline(_joined(*parts)))


def required_disclosures(segments: DataFrame, vocab: DataFrame, seconds: float = 30) -> DataFrame:
    """For regulated calls, each disclosure of their type: passed if one of its phrases is in the agent's opening."""
    return _rows(call_facts(segments, vocab.where("category = 'required'"), seconds), _required())


def prohibited_phrases(segments: DataFrame, vocab: DataFrame) -> DataFrame:
    """A failed check for each prohibited phrase that the agent says in a call, at its first segment."""
    return _rows(call_facts(segments, vocab.where("category = 'prohibited'")), _prohibited())


def third_party(segments: DataFrame, vocab: DataFrame) -> DataFrame:
    """A failed critical check for each phrase that tells of others being told."""
    return _rows(call_facts(segments, vocab.where("category = 'third_party'")), _third_party())


def agent_domination(segments: DataFrame, share: float = 0.75) -> DataFrame:
    """A failed check for collections calls in which the agent has more than this share of agent and customer time."""
    length, who = F.col("end_s") - F.col("start_s"), F.lower("speaker")
    spent = lambda names: F.coalesce(F.sum(F.when(who.isin(*names), length)), F.lit(0.0))
    sums = segments.groupBy("call_id").agg(F.min("call_type").alias("call_type"), spent(AGENT).alias("agent_s"), spent(CUSTOMER).alias("customer_s"))
    return _rows(sums, _domination(share))


def ignored_end_request(segments: DataFrame, vocab: DataFrame, most: int = 3) -> DataFrame:
    """A failed check where more than ``most`` agent segments follow the customer's first phrase, in list order, that asks to end the call."""
    return _rows(call_facts(segments, vocab.where("category = 'end_call'")), _ignored_end(most))


def general_notices(segments: DataFrame, vocab: DataFrame) -> DataFrame:
    """For general calls: disclaimer, recording notice and introduction, each passed if one of its phrases is said; low severity."""
    return _rows(call_facts(segments, vocab.where("category = 'disclaimer'")), _notices())


def data_protection(segments: DataFrame, vocab: DataFrame) -> DataFrame:
    """Where personal data is asked for: purpose, consent and rights notices; and whether sensitive ids are asked for outside identity calls."""
    used = vocab.where(F.col("category").isin("data_request", "sensitive_id", *[n[0] for n in NOTICES]))
    return _rows(call_facts(segments, used), _protection())


def every_check() -> Column:
    """All checks of a row of ``call_facts``, as an array of structs."""
    return _joined(_required(), _prohibited(), _third_party(), _domination(0.75), _ignored_end(3), _notices(), _protection())


def all_checks(segments: DataFrame, vocab: DataFrame) -> DataFrame:
    """Every check of every call, from one pass over the segments."""
    return call_facts(segments, vocab).select("call_id", F.inline(every_check()))


def judge_candidates(segments: DataFrame, most: int = 40, shortest: int = 15) -> DataFrame:
    """Utterances with a risk cue, longer than 15 characters, the first 40 of each call."""
    cued = segments.where((F.length("text") > shortest) & F.col("text").rlike(RISK_CUES))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("segment_id"))
    return cued.withColumn("place", place).where(F.col("place") <= most).select("call_id", "segment_id", "place", "text")


def import_verdicts(verdicts: DataFrame) -> DataFrame:
    """A judge's lines ``VERDICT|key`` (call_id, segment_id, speaker, line): known keys only, the first of each check; where the speaker is unknown, critical becomes high and the evidence says so."""
    key = F.lower(F.btrim(F.split_part("line", F.lit("|"), F.lit(2))))
    severity = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])[key]
    known = verdicts.where(F.col("line").startswith("VERDICT|")).select("call_id", "segment_id", "speaker", key.alias("key"), severity.alias("severity")).where("severity is not null")
    first = known.withColumn("k", F.row_number().over(Window.partitionBy("call_id", "key").orderBy("segment_id"))).where("k = 1")
    unknown = F.coalesce(F.lower("speaker"), F.lit("unknown")) == "unknown"
    return first.select("call_id", F.concat(F.lit("semantic_"), "key").alias("check_name"), F.lit(False).alias("passed"), F.when(unknown & (F.col("severity") == "critical"), "high").otherwise(F.col("severity")).alias("severity"), "segment_id", F.when(unknown, "speaker not attributed").alias("evidence"))


def merge_checks(checks: DataFrame, more: DataFrame) -> DataFrame:
    """Checks, and those others whose name the call doesn't have yet."""
    new = more.join(checks.select("call_id", "check_name").distinct(), ["call_id", "check_name"], "left_anti")
    return checks.select(COLUMNS).unionByName(new.select(COLUMNS))

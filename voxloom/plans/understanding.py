"""Queries over toxicity, intents, sentiment and emotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import understanding as u
from ..sources import vocabulary
from ..sources.fixtures import Corpus
from .compliance import AGENT, CUSTOMER
from .registry import query
from .transcript import NORMAL, WORDS

_TOX = sorted(u.TOXIC)
SCORES = "tox as (select call_id, segment_id, speaker, " + ", ".join(f"((call_id * {3 + 2 * k} + segment_id * {7 + k}) % 101) / 100.0::double as {x}" for k, x in enumerate(_TOX)) + " from segments)"
FLAGS = "flags as (select call_id, segment_id, speaker, toxicity, severe_toxicity, threat, list_filter([" + ", ".join(f"case when {x} >= {u.TOXIC[x]} then '{x}' end" for x in _TOX) + "], lambda x: x is not null) as categories from tox where " + " or ".join(f"{x} >= {u.TOXIC[x]}" for x in _TOX) + ")"
SEVERE = f"severe as (select *, case when severe_toxicity >= 0.5 or threat >= 0.8 then 'critical' when toxicity >= 0.9 or toxicity >= 0.7 and lower(speaker) in {AGENT} then 'high' when toxicity >= 0.7 then 'medium' else 'low' end as severity from flags)"


def toxicity(c: Corpus) -> DataFrame:
    """Made-up scores of a toxicity model."""
    a, b = F.col("call_id"), F.col("segment_id")
    return c.segments().select("call_id", "segment_id", "speaker", *[(((a * (3 + 2 * k) + b * (7 + k)) % 101) / 100.0).alias(x) for k, x in enumerate(_TOX)])


@query("to01_categories", f"with {SCORES}, {FLAGS} select call_id, segment_id, array_to_string(categories, ',') as categories from flags", "segments")
def to01(c: Corpus) -> DataFrame:
    """Categories over their thresholds."""
    return u.toxic_categories(toxicity(c)).select("call_id", "segment_id", F.array_join("categories", ",").alias("categories"))


@query("to02_severity", f"with {SCORES}, {FLAGS}, {SEVERE} select call_id, segment_id, severity from severe", "segments")
def to02(c: Corpus) -> DataFrame:
    """Severity of flags."""
    return u.toxic_severity(u.toxic_categories(toxicity(c))).select("call_id", "segment_id", "severity")


@query("to03_merge_flags", f"""with {SCORES}, {FLAGS}, {SEVERE}, f as (select * from severe where segment_id % 2 = 0)
    select call_id, segment_id, severity from f union all select call_id, segment_id, case when lower(speaker) in {AGENT} and confidence >= 0.9 then 'critical' when lower(speaker) in {AGENT} or confidence >= 0.9 then 'high' else 'medium' end from segments s where confidence > 0.5 and not exists (select 1 from f where f.call_id = s.call_id and f.segment_id = s.segment_id)""", "segments")
def to03(c: Corpus) -> DataFrame:
    """A second detector's flags merged."""
    flags = u.toxic_severity(u.toxic_categories(toxicity(c))).where("segment_id % 2 = 0")
    return u.merge_flags(flags, c.segments().where("confidence > 0.5").select("call_id", "segment_id", "speaker", F.col("confidence").alias("score")))


LABELED = "labeled as (select *, case segment_id % 3 when 0 then 'negative' when 1 then 'neutral' else 'positive' end as label, confidence as score from segments)"


def labeled(c: Corpus) -> DataFrame:
    """Segments with made-up sentiment labels."""
    k = F.col("segment_id") % 3
    return c.segments().withColumn("label", F.when(k == 0, "negative").when(k == 1, "neutral").otherwise("positive")).withColumn("score", F.col("confidence"))


PLAIN = "lower(trim(regexp_replace(text, '[.!?,]', '', 'g')))"


@query("in01_route", f"with {LABELED} select call_id, segment_id, case when {WORDS} <= 3 and {PLAIN} in (select phrase from vocab where category = 'trivial') then 'skip' when label = 'negative' and score > 0.85 then 'negative_subset' when label = 'neutral' and score > 0.9 and {WORDS} <= 5 then 'skip' else 'full' end as route from labeled", "segments vocab")
def in01(c: Corpus) -> DataFrame:
    """Which model a segment needs."""
    return u.route(labeled(c), vocabulary.pack(c.spark).where("category = 'trivial'"))


@query("in02_trivial", f"select call_id, segment_id, case when {PLAIN} in (select phrase from vocab where category = 'greetings') then 'greeting' else 'acknowledgment' end as intent, 0.9::double as confidence from segments where {WORDS} <= 3", "segments vocab")
def in02(c: Corpus) -> DataFrame:
    """Intents of trivial utterances."""
    from ..functions.text import word_count

    return u.trivial_intents(c.segments().where(word_count(F.col("text")) <= 3), vocabulary.pack(c.spark).where("category = 'greetings'"))


def _has(phrases: list[str]) -> str:
    return "(" + " or ".join("contains(low, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


_CASES = [(("call_type in ('collections', 'kyc', 'consent', 'onboarding', 'complaint') and " if r else "") + _has(p), n, x) for n, x, r, p in u.CASCADE]
_CASES += [("(ends_with(low, '?') or " + " or ".join(f"starts_with(low, '{s}')" for s in u.QUESTION_STARTS) + ")", "question", 0.7), (_has(u.EXPLANATIONS), "explanation", 0.65), ("call_type = 'general'", "information_request", 0.5)]
INTENTS = f"lowered as (select *, lower(trim(text)) as low from segments), intents as (select call_id, segment_id, case {' '.join(f'''when {h} then '{n}' ''' for h, n, _ in _CASES)} else 'unknown' end as intent, (case {' '.join(f'when {h} then {x}' for h, _, x in _CASES)} else 0.3 end)::double as confidence from lowered)"


@query("in03_keyword_intents", f"with {INTENTS} select * from intents", "segments")
def in03(c: Corpus) -> DataFrame:
    """Intents by the keyword cascade."""
    return u.keyword_intents(c.segments())


@query("in04_import_intents", f"""with {INTENTS}, told as (select call_id, segment_id, case segment_id % 3 when 0 then 'refusal' when 1 then 'nonsense' else 'agreement' end as told, case segment_id % 2 when 0 then 1.0 else 0.7 end as sure from segments where segment_id % 4 <> 3)
    select i.call_id, i.segment_id, case when told in ('refusal', 'agreement') then told else intent end as intent, case when told in ('refusal', 'agreement') then sure else confidence end as confidence from intents i left join told t using (call_id, segment_id)""", "segments")
def in04(c: Corpus) -> DataFrame:
    """A classifier's lines, with the cascade behind."""
    s = c.segments()
    k = F.col("segment_id")
    told = F.when(k % 3 == 0, " Refusal").when(k % 3 == 1, "nonsense").otherwise("agreement")
    line = F.concat(k, F.lit("|"), told, F.lit("|"), F.when(k % 2 == 0, "1.7").otherwise("high"))
    return u.import_intents(s, s.where("segment_id % 4 <> 3").select("call_id", line.alias("line")))


@query("in05_batches", "select call_id, segment_id, (row_number() over (partition by call_id order by segment_id) - 1) // 50 as batch from segments_long", "segments segments_long")
def in05(c: Corpus) -> DataFrame:
    """Batches of fifty."""
    return u.batches(c.segments_long())


@query("in06_distribution", f"with {INTENTS} select intent, count(*) as n from intents group by intent order by n desc, intent limit 10", "segments")
def in06(c: Corpus) -> DataFrame:
    """The ten most frequent intents."""
    return u.distribution(u.keyword_intents(c.segments()), "intent")


@query("in07_uncertain", f"with {INTENTS} select call_id, segment_id, intent, confidence, intent = 'unknown' and confidence < 0.5 as uncertain from intents", "segments")
def in07(c: Corpus) -> DataFrame:
    """Confident and uncertain intents."""
    return u.split_uncertain(u.keyword_intents(c.segments()))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
LEXICON = f"""lexi as (select *, list_distinct(string_split({NORMAL}, ' ')) as w from segments),
    lexc as (select *, len(list_intersect(w, {_LIST(u.POSITIVE)})) as p, len(list_intersect(w, {_LIST(u.NEGATIVE)})) as n from lexi),
    scored as (select call_id, segment_id, speaker, case when p + n = 0 then 0 else (p - n) / (p + n) end as score from lexc)"""


@query("se02_lexicon", f"with {LEXICON} select call_id, segment_id, score from scored", "segments")
def se02(c: Corpus) -> DataFrame:
    """Lexicon sentiment."""
    return u.lexicon_sentiment(c.segments()).select("call_id", "segment_id", "score")


@query("se01_score_text", f"with {LEXICON} select call_id, segment_id, case when p > n then 'positive' when p < n then 'negative' else 'neutral' end as label, case when p = n then 0.5 else abs(p - n) / (p + n) end as score from lexc", "segments")
def se01(c: Corpus) -> DataFrame:
    """Sentiment by a plug-in, here the lexicons."""
    return u.score_sentiment(c.segments().withColumn("lang", F.lit("en")), u.lexicon_scorer)


@query("se03_signed", f"with {LABELED} select call_id, segment_id, round(case label when 'positive' then score when 'negative' then -score else greatest(0.02, (1 - score) * 0.3) end, 4) + 0.0 as signed from labeled", "segments")
def se03(c: Corpus) -> DataFrame:
    """Signed scores."""
    return u.signed(labeled(c)).select("call_id", "segment_id", "signed")


PATHS = f"""{LEXICON}, paths as (select call_id,
    coalesce(list(score order by segment_id) filter (lower(speaker) in {CUSTOMER} or lower(speaker) not in {AGENT}), [0.0::double]) as customer,
    coalesce(list(score order by segment_id) filter (lower(speaker) in {AGENT} or lower(speaker) not in {CUSTOMER}), [0.0::double]) as agent from scored group by call_id)"""


@query("se04_trajectories", f"with {PATHS} select call_id, len(customer) as n_customer, len(agent) as n_agent, round(list_sum(customer), 6) as customer_sum, round(list_sum(agent), 6) as agent_sum, customer[-1] as customer_last from paths", "segments")
def se04(c: Corpus) -> DataFrame:
    """Trajectories of both sides."""
    t = u.trajectories(u.lexicon_sentiment(c.segments()))
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6)
    return t.select("call_id", F.size("customer").alias("n_customer"), F.size("agent").alias("n_agent"), total("customer").alias("customer_sum"), total("agent").alias("agent_sum"), F.element_at("customer", -1).alias("customer_last"))


@query("se05_feelings", f"""with {PATHS}, h as (select *, list_avg(customer) as m, list_avg(agent) as am, len(customer) as n, list_avg(customer[1:len(customer) // 2]) as a, list_avg(customer[len(customer) // 2 + 1:]) as b from paths)
    select call_id, round(m, 6) as mean, case when m > 0.3 then 'positive' when m < -0.5 then 'angry' when m < -0.3 then 'frustrated' else 'neutral' end as feeling, case when m < -0.2 then 'distress' when m > 0.2 then 'satisfaction' else 'neutral' end as context, am < -0.4 as agent_actionable,
    case when n < 4 then case when m < -0.4 then 'medium' else 'low' end when b - a < -0.3 and b < -0.3 then 'high' when b - a < -0.15 then 'medium' else 'low' end as escalation_risk from h""", "segments")
def se05(c: Corpus) -> DataFrame:
    """Feeling, context and trend (SE-05 to SE-07)."""
    return u.feelings(u.trajectories(u.lexicon_sentiment(c.segments())))


@query("se08_aligned", f"with {PATHS} select call_id, position, customer[position + 1] as customer, agent[position + 1] as agent from (select *, unnest(range(0, greatest(len(customer), len(agent)))) as position from paths)", "segments")
def se08(c: Corpus) -> DataFrame:
    """Trajectories by position."""
    return u.aligned(u.trajectories(u.lexicon_sentiment(c.segments())))


@query("em01_import_emotions", """with m as (select call_id, segment_id, emotion, emotion_score as a, 0.35::double as b from emotions),
    t as (select *, case when a > b then emotion when a < b then 'other' else least(emotion, 'other') end as top, greatest(a, b) as s from m)
    select call_id, segment_id, case when s < 0.4 or top = 'other' then 'neutral' else top end as emotion, round(s, 4) as emotion_score, s < 0.4 or top = 'other' as low_confidence from t""", "segments emotions")
def em01(c: Corpus) -> DataFrame:
    """A model's emotion scores."""
    return u.import_emotions(c.emotions().select("call_id", "segment_id", F.create_map(F.concat(F.initcap("emotion"), F.lit("/x")), F.col("emotion_score"), F.lit("other"), F.lit(0.35)).alias("scores")))


@query("em02_sample_segments", """with a as (select *, count(*) over (partition by call_id) as n, row_number() over (partition by call_id order by segment_id) as k, lag(speaker) over (partition by call_id order by segment_id) as p, lead(speaker) over (partition by call_id order by segment_id) as q from segments_long),
    b as (select *, k <= 5 or k > n - 5 or coalesce(speaker <> p or speaker <> q, false) as must from a),
    c as (select *, sum(must::int) over (partition by call_id) as m, row_number() over (partition by call_id, must order by segment_id) - 1 as j, count(*) over (partition by call_id, must) as rest from b)
    select call_id, segment_id, speaker from c where n <= 100 or must or (60 - m > 0 and j % greatest(ceil(rest / nullif(greatest(60 - m, 0), 0)), 1) = 0)""", "segments segments_long")
def em02(c: Corpus) -> DataFrame:
    """Long calls sampled (a sampling operator)."""
    return u.sample_segments(c.segments_long())


def _summary(by: str) -> str:
    return f"""with p as (select {by}, emotion, count(*) as n, round(avg(emotion_score), 6) as mean from emotions group by all)
    select {by}, arg_min(emotion, (-mean, emotion)) as dominant, max(mean) as mean, round(arg_min(n, (-mean, emotion)) / sum(n), 4) as share, sum(n)::bigint as total from p group by {by}"""


@query("em03_call_summary", _summary("call_id"), "segments emotions")
def em03(c: Corpus) -> DataFrame:
    """Emotions per call."""
    return u.emotion_summary(c.emotions(), ["call_id"])


@query("em04_escalations", "select call_id, segment_id, speaker, emotion, emotion_score from emotions where emotion in ('angry', 'fearful') and emotion_score > 0.6", "segments emotions")
def em04(c: Corpus) -> DataFrame:
    """Moments of escalation."""
    return u.escalation_moments(c.emotions())


@query("em05_speaker_summary", _summary("call_id, speaker"), "segments emotions")
def em05(c: Corpus) -> DataFrame:
    """Emotions per speaker."""
    return u.emotion_summary(c.emotions(), ["call_id", "speaker"])


@query("em06_transitions")
def em06(c: Corpus) -> DataFrame:
    """Changes of emotion; the state is that last accepted, so each depends on all before it."""
    long = c.emotions(c.segments_long())
    return u.transitions(long.withColumn("low_confidence", F.col("emotion_score") < 0.4))


@query("em07_timeline", "with p as (select *, (row_number() over (partition by call_id order by segment_id) - 1) // greatest(1, count(*) over (partition by call_id) // 30) as \"window\" from emotions_long) select call_id, \"window\", " + ", ".join(f"round(100 * count(*) filter (emotion = '{e}') / count(*), 4) as {e}" for e in u.EMOTIONS) + " from p group by all", "segments segments_long emotions_long")
def em07(c: Corpus) -> DataFrame:
    """Emotions over time."""
    return u.emotion_timeline(c.emotions(c.segments_long()))


@query("em08_by_speaker", "select emotion, " + ", ".join(f"count(*) filter (speaker = '{s}') as {s.lower()}" for s in ("SPEAKER_00", "SPEAKER_01", "SPEAKER_02")) + " from emotions group by emotion", "segments emotions")
def em08(c: Corpus) -> DataFrame:
    """Emotions and speakers."""
    return u.emotion_by_speaker(c.emotions())

"""Queries over fraud signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fraud as f
from ..sources import vocabulary
from ..sources.fixtures import Corpus
from .compliance import AGENT, CUSTOMER
from .registry import query
from .transcript import WORDS, heard

_RULES = ", ".join(f"('{a}', '{b}', {n}, {x}::double, {y}::double, {z}::double)" for a, b, n, x, y, z in f.PHRASE_SIGNALS)
PHRASES = f"""{heard("said", "segments")}, fh as (select call_id, subcategory, count(distinct phrase) as n, arg_min(segment_id, (ord, segment_id, phrase)) as segment_id, arg_min(phrase, (ord, segment_id, phrase)) as detail from said where category = 'fraud' group by all),
    phrase_signals as (select call_id, signal_type, segment_id, round(least(base + step * n, cap), 4) as confidence, detail from fh join (values {_RULES}) r(signal_type, subcategory, least_n, base, step, cap) using (subcategory) where n >= least_n)"""
SPEAKERS = "speakers as (select call_id, 'unexpected_speaker' as signal_type, null::int as segment_id, 0.7::double as confidence, array_to_string(list_sort(list(distinct speaker)), ',') as detail from segments group by call_id having count(distinct speaker) > 2)"
MONOLOGUE = f"monologue as (select call_id, 'agent_monologue' as signal_type, null::int as segment_id, 0.5::double as confidence, null::varchar as detail from (select call_id, sum(end_s - start_s) as t, coalesce(sum(end_s - start_s) filter (lower(speaker) in {AGENT}), 0) as a from segments group by call_id) where a > 60 and a > 0.8 * t)"
SIGNALS = f"{PHRASES}, {SPEAKERS}, {MONOLOGUE}, signals as (select * from phrase_signals union all select * from speakers union all select * from monologue)"


def signals(c: Corpus) -> DataFrame:
    """Signals from phrases and speakers."""
    s = c.segments()
    return f.union_all(f.phrase_signals(s, vocabulary.pack(c.spark)), f.unexpected_speakers(s), f.agent_monologue(s))


@query("fr05_phrase_signals", f"with {PHRASES} select * from phrase_signals", "segments vocab")
def fr05(c: Corpus) -> DataFrame:
    """Signals from phrases (FR-05 to FR-11)."""
    return f.phrase_signals(c.segments(), vocabulary.pack(c.spark))


@query("fr04_unexpected_speakers", f"with {SPEAKERS} select * from speakers", "segments")
def fr04(c: Corpus) -> DataFrame:
    """Unexpected speakers."""
    return f.unexpected_speakers(c.segments())


@query("fr12_agent_monologue", f"with {MONOLOGUE} select * from monologue", "segments")
def fr12(c: Corpus) -> DataFrame:
    """Agent monologues."""
    return f.agent_monologue(c.segments())


@query("fr16_all_signals", f"with {SIGNALS} select * from signals", "segments vocab")
def fr16(c: Corpus) -> DataFrame:
    """All of these signals."""
    return signals(c)


VOICE = "voice as (select call_id, segment_id, speaker, start_s, 140.0::double + (segment_id * 7 + call_id) % 50 as pitch_mean, ((call_id + segment_id * 3) % 20) / 500.0::double as jitter, ((call_id * 3 + segment_id) % 30) / 400.0::double as shimmer, 8.0::double + (segment_id * 5 + call_id) % 12 as hnr from segments)"
_N = "pitch_mean jitter shimmer hnr".split()
BASES = f"""va as (select distinct call_id, speaker, start_s as t from voice where start_s < 90),
    vm as (select a.call_id, a.speaker, t, {", ".join(f"avg({x}) as {x}" for x in _N)} from va a join voice v on a.call_id = v.call_id and a.speaker = v.speaker and v.start_s >= t and v.start_s < t + 30 group by all having count(*) >= 2),
    vb as (select call_id, speaker, {", ".join(f"arg_min({x}, (round(jitter + shimmer, 9), t)) as {x}" for x in _N)} from vm group by all),
    vf as (select call_id, speaker, {", ".join(f"avg({x}) as {x}" for x in _N)} from (select *, row_number() over (partition by call_id, speaker order by start_s) as k from voice) where k <= 3 group by all),
    bases as (select call_id, speaker, {", ".join(f"round(coalesce(vb.{x}, vf.{x}), 9) as base_{x}" for x in _N)} from vf left join vb using (call_id, speaker))"""


def voice(c: Corpus) -> DataFrame:
    """Made-up vocal features."""
    a, b = F.col("call_id"), F.col("segment_id")
    return c.segments().select("call_id", "segment_id", "speaker", "start_s", (140.0 + (b * 7 + a) % 50).alias("pitch_mean"), (((a + b * 3) % 20) / 500.0).alias("jitter"), (((a * 3 + b) % 30) / 400.0).alias("shimmer"), (8.0 + (b * 5 + a) % 12).alias("hnr"))


@query("fr01_baselines", f"with {VOICE}, {BASES} select * from bases", "segments")
def fr01(c: Corpus) -> DataFrame:
    """Calm vocal baselines."""
    return f.baselines(voice(c))


@query("fr02_stress", f"""with {VOICE}, {BASES}, st as (select v.call_id, v.segment_id, v.speaker, round((greatest(abs(pitch_mean - base_pitch_mean) / 20, 0) + greatest((jitter - base_jitter) / 0.01, 0) + greatest((shimmer - base_shimmer) / 0.03, 0) + greatest((base_hnr - hnr) / 15, 0)) / 4 + 1, 6) as score from voice v join bases b using (call_id, speaker))
    select *, score > 1.5 as anomaly, round(least(0.9, score / 3), 4) as confidence from st""", "segments")
def fr02(c: Corpus) -> DataFrame:
    """Deviation from the baseline."""
    v = voice(c)
    return f.stress(v, f.baselines(v))


@query("fr03_coached_speech", f"""with pace as (select call_id, speaker, {WORDS} / ((end_s - start_s) / 60) as wpm from segments_long where end_s - start_s >= 2),
    st as (select call_id, speaker, count(*) as n, avg(wpm) as mean, stddev_pop(wpm) as sd from pace where wpm between 50 and 300 group by all having count(*) >= 5)
    select call_id, speaker, n, round(mean, 4) as mean, round(sd / mean, 6) as cv, sd / mean < 0.1 and mean > 100 as coached, case when sd / mean < 0.1 and mean > 100 then round(least(0.85, (0.15 - round(sd / mean, 6)) / 0.15), 4) end as confidence from st""", "segments segments_long")
def fr03(c: Corpus) -> DataFrame:
    """Pace that hardly varies."""
    return f.coached_speech(c.segments_long())


@query("fr13_import_abuse", """with a as (select call_id, segment_id, case when segment_id % 2 = 0 then 'abusive' else 'not_abusive' end as label, confidence as score from segments),
    v as (select *, case when label = 'abusive' then score when score < 0.6 then 1 - score else 0 end as value from a)
    select call_id, 'abusive_language' as signal_type, segment_id, round(value, 4) as confidence, label as detail from v where value >= 0.7 or (label = 'not_abusive' and value > 0.4)""", "segments")
def fr13(c: Corpus) -> DataFrame:
    """An abuse classifier's scores."""
    return f.import_abuse(c.segments().select("call_id", "segment_id", F.when(F.col("segment_id") % 2 == 0, "abusive").otherwise("not_abusive").alias("label"), F.col("confidence").alias("score")))


@query("fr14_scam_candidates", "select call_id, segment_id, text from segments where length(text) > 10 and regexp_matches(text, '(?i)\\b(?:otp|cvv|pin|card|bank|tax|warrant|police|transfer|desktop|screen|immediately|account)\\b')", "segments")
def fr14(c: Corpus) -> DataFrame:
    """Utterances for the scam model."""
    return f.scam_candidates(c.segments())


@query("fr15_import_scam", """with m as (select call_id, segment_id, confidence as a, ((call_id * 7 + segment_id) % 100) / 100.0::double as b, 0.5::double as l from segments)
    select call_id, 'scam' as signal_type, segment_id, round(greatest(a, b), 4) as confidence, case when a >= b then 'impersonation' else 'lottery' end as detail from m where greatest(a, b) > l and greatest(a, b) >= 0.7""", "segments")
def fr15(c: Corpus) -> DataFrame:
    """A scam model's scores by label."""
    b = ((F.col("call_id") * 7 + F.col("segment_id")) % 100) / 100.0
    return f.import_scam(c.segments().select("call_id", "segment_id", F.create_map(F.lit("impersonation"), F.col("confidence"), F.lit("lottery"), b, F.lit("legitimate"), F.lit(0.5)).alias("scores")))


DIVERSITY = f"""ec as (select call_id, emotion, count(*) as n from emotions where lower(speaker) in {CUSTOMER} group by all), ep as (select *, n / sum(n) over (partition by call_id) as p, sum(n) over (partition by call_id) as total from ec),
    diversity as (select call_id, round(case when max(total) < 2 then 0.5 when count(*) < 2 then 0 else -sum(p * log2(p)) / log2(count(*)) end, 4) as diversity from ep group by call_id)"""


@query("fr18_emotion_diversity", f"with {DIVERSITY} select * from diversity", "segments emotions")
def fr18(c: Corpus) -> DataFrame:
    """Diversity of emotions."""
    return f.emotion_diversity(c.emotions())


@query("fr17_refine", f"""with {DIVERSITY}, sg as (select call_id, case when segment_id % 3 = 0 then 'vocal_stress' when segment_id % 3 = 1 then 'coached_speech' else 'urgency' end as signal_type, segment_id, confidence, null::varchar as detail from segments)
    select s.call_id, signal_type, s.segment_id, round(greatest(least(confidence * case signal_type when 'vocal_stress' then case when emotion in ('angry', 'happy', 'surprised') then 0.6 when emotion = 'fearful' then 1.3 else 1 end when 'coached_speech' then case when diversity < 0.25 then 1.25 when diversity > 0.5 then 0.5 else 1 end else 1 end, 1), 0), 4) as confidence, detail
    from sg s left join emotions e on e.call_id = s.call_id and e.segment_id = s.segment_id left join diversity d on d.call_id = s.call_id""", "segments emotions")
def fr17(c: Corpus) -> DataFrame:
    """Signals refined with emotions."""
    k = F.col("segment_id") % 3
    rows = c.segments().select("call_id", F.when(k == 0, "vocal_stress").when(k == 1, "coached_speech").otherwise("urgency").alias("signal_type"), "segment_id", "confidence", F.lit(None).cast("string").alias("detail"))
    return f.refine(rows, c.emotions())


@query("fr19_incongruence", f"""with a as (select call_id, segment_id as question from segments where lower(speaker) in {AGENT} and regexp_matches(text, '(?i)\\b(?:verify|confirm|account|otp|card)\\b')),
    n as (select a.call_id, question, e.segment_id, emotion, emotion_score, row_number() over (partition by a.call_id, question order by e.segment_id) as k from a join emotions e on e.call_id = a.call_id and lower(e.speaker) in {CUSTOMER} and e.segment_id > question and e.segment_id <= question + 2)
    select call_id, 'emotional_incongruence' as signal_type, segment_id, round(emotion_score, 4) as confidence, 'q' || question as detail from n where k = 1 and ((emotion = 'fearful' and emotion_score > 0.5) or (emotion = 'surprised' and emotion_score > 0.6))""", "segments emotions")
def fr19(c: Corpus) -> DataFrame:
    """Emotions that don't fit the question."""
    return f.incongruence(c.segments(), c.emotions())


@query("fr20_risk_bucket", f"with {SIGNALS} select call_id, signal_type, segment_id, case when confidence >= 0.85 then 'critical' when confidence >= 0.7 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as risk from signals", "segments vocab")
def fr20(c: Corpus) -> DataFrame:
    """Risk levels of signals."""
    return f.risk_bucket(signals(c))

"""Queries over transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import transcript as t
from ..sources import vocabulary
from ..sources.vocabulary import normal_sql
from ..sources.fixtures import Corpus
from .registry import query

NORMAL = normal_sql("text")


def heard(name: str, source: str) -> str:
    """Expression ``name``: phrases (all columns of ``grams``) where they begin in the rows of ``source``, which are read as one text for each call."""
    return f"""{name} as (select t.call_id, t.segment_id, t.call_type, p.* from (
        select call_id, segment_id, call_type, list(word) over (partition by call_id order by segment_id, k rows between current row and 11 following) as ahead from (
            select call_id, segment_id, call_type, unnest(w) as word, generate_subscripts(w, 1) as k from (select *, list_filter(string_split({NORMAL}, ' '), lambda x: x <> '') as w from {source}))) t
        join grams p on t.ahead[1] = p.g[1] and t.ahead[1:len(p.g)] = p.g)"""


WORDS = "(case when trim(coalesce(text, '')) = '' then 0 else len(regexp_split_to_array(trim(text), '\\s+')) end)"


@query("io02_turns_to_segments", f"""
    with n as (select conv_id as call_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as segment_id, coalesce(role, 'UNKNOWN') as speaker,
        round(greatest({WORDS}, 1) / 2.5, 2)::double as seconds, coalesce(text, '') as text from conversations),
    e as (select *, round(sum(seconds) over (partition by call_id order by segment_id), 2) as end_s from n)
    select call_id, segment_id, speaker, round(end_s - seconds, 2) as start_s, end_s, 1.0::double as confidence, text from e""")
def io02(c: Corpus) -> DataFrame:
    """Utterances of any table as segments."""
    return t.turns_to_segments(c.table("conversations"))


@query("tx01_split_by_speaker", """
    with w as (select conv_id as call_id, turn as position, text as word, case when turn % 3 = 2 then null else role end as speaker from conversations),
    k as (select *, coalesce(last_value(speaker ignore nulls) over (partition by call_id order by position rows between unbounded preceding and current row), 'UNKNOWN') as who from w),
    n as (select *, case when who = lag(who) over (partition by call_id order by position) then 0 else 1 end as new from k),
    p as (select *, sum(new) over (partition by call_id order by position) - 1 as part from n)
    select call_id, part, min(who) as speaker, min(position) as first_word, count(*) as n_words, string_agg(word, ' ' order by position) as text from p group by call_id, part""")
def tx01(c: Corpus) -> DataFrame:
    """Splits at changes of speaker; unlabelled words inherit."""
    speaker = F.when(F.col("turn") % 3 != 2, F.col("role"))
    return t.split_by_speaker(c.table("conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("word"), speaker.alias("speaker")))


@query("tx02_spread_words", """
    with w as (select call_id, segment_id, start_s, end_s, list_filter(string_split(text, ' '), lambda x: x <> '') as w from segments),
    e as (select *, unnest(w) as word, generate_subscripts(w, 1) - 1 as position, (end_s - start_s) / len(w) as step from w where len(w) > 0)
    select call_id, segment_id, position, word, round(start_s + position * step, 3) as start_s, round(start_s + (position + 1) * step, 3) as end_s from e""", "segments")
def tx02(c: Corpus) -> DataFrame:
    """Evenly spaced word times."""
    return t.spread_words(c.segments())


@query("tx03_word_confidence", """
    with s as (select call_id, segment_id, avg((segment_id % 5) / 5.0::double) as mean from segments where call_id % 2 = 0 group by all)
    select call_id, segment_id, round(coalesce(mean, confidence, 0.5), 4) as confidence from segments left join s using (call_id, segment_id)""", "segments")
def tx03(c: Corpus) -> DataFrame:
    """Segment confidence from word scores, with fallbacks."""
    s = c.segments()
    return t.confidence_from_words(s, s.where("call_id % 2 = 0").select("call_id", "segment_id", ((F.col("segment_id") % 5) / 5.0).alias("score")))


@query("tx04_confidence_summary", "select call_id, count(*) as n_segments, round(avg(coalesce(confidence, 0.5)), 6) as mean_confidence, count(*) filter (coalesce(confidence, 0.5) < 0.7) as n_low from segments group by call_id", "segments")
def tx04(c: Corpus) -> DataFrame:
    """Low-confidence counts per call."""
    return t.confidence_summary(c.segments())


@query("tx05_correct_terms", """
    with f as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bkayak form\\b', 'KYC form', 'gi'), '\\bpan\\b', 'PAN', 'gi'), '\\botp\\b', 'OTP', 'gi'), '\\bemi\\b', 'EMI', 'gi'), '\\blac\\b', 'lakh', 'gi') as fixed from segments)
    select call_id, segment_id, fixed as text, fixed <> text as corrected, case when fixed <> text then text end as original_text from f""", "segments")
def tx05(c: Corpus) -> DataFrame:
    """Dictionary corrections with their originals."""
    return t.correct_terms(c.segments()).select("call_id", "segment_id", "text", "corrected", "original_text")


@query("tx06_context_terms", """
    with f as (select *, regexp_replace(text, '\\bme of (\\d)', 'EMI of \\1', 'gi') as fixed from segments)
    select call_id, segment_id, fixed as text, fixed <> text as corrected from f""", "segments")
def tx06(c: Corpus) -> DataFrame:
    """Corrections that need financial context."""
    return t.correct_terms(c.segments(), t.CONTEXT_TERMS).select("call_id", "segment_id", "text", "corrected")


@query("tx07_names", """
    with f as (select *, regexp_replace(regexp_replace(text, '\\bthe lender\\b', 'Northlight Finance', 'gi'), '\\btax department\\b', 'Revenue Office', 'gi') as fixed from segments)
    select call_id, segment_id, fixed as text, fixed <> text as corrected, case when fixed <> text then text end as original_text from f""", "segments")
def tx07(c: Corpus) -> DataFrame:
    """Names of organisations corrected."""
    return t.correct_names(c.segments(), {"the lender": "Northlight Finance", "tax department": "Revenue Office"}).select("call_id", "segment_id", "text", "corrected", "original_text")


@query("tx09_spoken_amounts", """
    with m as (select call_id, segment_id, unnest(regexp_extract_all(text, '(?i)\\b\\d+(?:\\.\\d+)?\\s+(?:hundred|thousand|lakh|million|crore|billion)\\b')) as mention,
        generate_subscripts(regexp_extract_all(text, '(?i)\\b\\d+(?:\\.\\d+)?\\s+(?:hundred|thousand|lakh|million|crore|billion)\\b'), 1) - 1 as ord from segments)
    select call_id, segment_id, ord, mention, regexp_extract(mention, '^[\\d.]+')::double * case lower(regexp_extract(mention, '[A-Za-z]+$')) when 'hundred' then 100 when 'thousand' then 1000 when 'lakh' then 100000 when 'million' then 1000000 when 'crore' then 10000000 else 1000000000 end as amount from m""", "segments")
def tx09(c: Corpus) -> DataFrame:
    """Amounts with magnitudes as metadata."""
    return t.spoken_amounts(c.segments())


@query("tx10_unusable_calls", f"""
    with s as (select call_id, bool_and(len(list_filter(string_split({NORMAL}, ' '), lambda w: w <> '' and w <> 'foreign')) = 0) as only_filler, avg(coalesce(confidence, 0.5)) as m from segments group by call_id)
    select call_id, only_filler, round(m, 6) as mean_confidence, only_filler or m < 0.55 as unusable from s""", "segments")
def tx10(c: Corpus) -> DataFrame:
    """Calls whose transcript can't be used."""
    return t.unusable_calls(c.segments())


@query("tx11_call_type", f"""
    with {heard("th", "(select * from segments where start_s < 45)")},
    h as (select call_id, subcategory as kind, count(distinct phrase) as n from th where category = 'call_type' group by call_id, subcategory having count(distinct phrase) >= 2),
    b as (select call_id, arg_min(kind, (-n, kind)) as kind, max(n) as n from h group by call_id)
    select call_id, coalesce(kind, 'general') as detected_type, coalesce(n, 0) as n_keywords from (select distinct call_id from segments) left join b using (call_id)""", "segments vocab")
def tx11(c: Corpus) -> DataFrame:
    """Call type from the opening."""
    return t.detect_call_type(c.segments(), vocabulary.pack(c.spark))


ROLES = """f as (select call_id, speaker, min(segment_id) as first, min(call_type) as call_type from segments group by call_id, speaker),
    r as (select *, row_number() over (partition by call_id order by first, speaker) as rank, count(*) over (partition by call_id) as n from f),
    roles as (select call_id, speaker, case when n < 2 then speaker when call_type in ('collections', 'kyc', 'consent', 'onboarding', 'complaint') then case rank when 1 then 'agent' when 2 then 'customer' else 'other' end else 'Speaker ' || chr((64 + rank)::int) end as role from r)"""


@query("tx12_map_roles", f"with {ROLES} select * from roles", "segments")
def tx12(c: Corpus) -> DataFrame:
    """Roles by order of appearance."""
    return t.map_roles(c.segments())


PROFILE = [("en", w) for w in "the and of in to that is with for".split()] + [("de", w) for w in "der die und das ist nicht sch von zu".split()] + [("fr", w) for w in "le la les de et un une que des".split()] + [("es", w) for w in "el los de que y en un se las".split()]
PROFILE_SQL = "prof(lang, word) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in PROFILE) + ")"
TAGS = f"""{PROFILE_SQL}, dw as (select doc_id, unnest(string_split({NORMAL}, ' ')) as word from documents),
    dh as (select doc_id, lang, count(*) as n from dw join prof using (word) group by doc_id, lang),
    db as (select doc_id, arg_min(lang, (-n, lang)) as lang, max(n) as n, sum(n) as total from dh group by doc_id),
    tags as (select d.doc_id, d.source, case when length(d.text) >= 15 and db.n / db.total >= 0.85 then db.lang else 'en' end as tag from documents d left join db using (doc_id))"""


@query("tx14_language_tags", f"with {TAGS} select doc_id, tag from tags")
def tx14(c: Corpus) -> DataFrame:
    """Language by stop-word profile."""
    return t.language_tags(c.table("documents"), c.spark.createDataFrame(PROFILE, "lang string, word string"))


@query("tx15_language_profile", f"with {TAGS}, n as (select source, tag, count(*) as n from tags group by all) select source, arg_min(tag, (-n, tag)) as main, sum(n)::bigint as total, count(*) as n_languages, (sum(n) - max(n)) / sum(n) > 0.1 as switching from n group by source")
def tx15(c: Corpus) -> DataFrame:
    """Languages of a group."""
    docs = c.table("documents")
    tags = t.language_tags(docs, c.spark.createDataFrame(PROFILE, "lang string, word string"))
    return t.language_profile(tags.join(docs.select("doc_id", "source"), "doc_id"), "source")


@query("tx16_merge_turns", """
    with n as (select *, case when speaker = lag(speaker) over (partition by call_id order by segment_id) then 0 else 1 end as new from segments where trim(text) <> ''),
    p as (select *, sum(new) over (partition by call_id order by segment_id) - 1 as turn from n)
    select call_id, turn, min(speaker) as speaker, min(start_s) as start_s, max(end_s) as end_s, count(*) as n_segments, left(string_agg(text, ' ' order by segment_id), 2000) as text from p group by call_id, turn""", "segments")
def tx16(c: Corpus) -> DataFrame:
    """Consecutive turns of one speaker merged."""
    return t.merge_turns(c.segments())


@query("tx17_talk_time", """select call_id, sum(end_s - start_s) as talk_s,
    round(coalesce(sum(case when lower(speaker) in ('agent', 'speaker a', 'speaker_00') then end_s - start_s end) / nullif(sum(end_s - start_s), 0), 0), 4) as agent_share,
    round(coalesce(sum(case when lower(speaker) in ('customer', 'speaker b', 'speaker_01') then end_s - start_s end) / nullif(sum(end_s - start_s), 0), 0), 4) as customer_share from segments group by call_id""", "segments")
def tx17(c: Corpus) -> DataFrame:
    """Talk-time shares."""
    return t.talk_time(c.segments())


@query("tx18_opening_speech", "select * exclude (b) from (select *, coalesce(sum(end_s - start_s) over (partition by call_id order by segment_id rows between unbounded preceding and 1 preceding), 0) as b from segments) where b < 30", "segments")
def tx18(c: Corpus) -> DataFrame:
    """Segments of the first thirty seconds of talk."""
    return t.opening_speech(c.segments())


@query("tx19_speaker_counts", "select call_id, greatest(count(distinct speaker), 1) as n_speakers from segments group by call_id", "segments")
def tx19(c: Corpus) -> DataFrame:
    """Speakers per call."""
    return t.speaker_counts(c.segments())


@query("tx20_trim_calls", "select call_id, segment_id, speaker, greatest(start_s, 20.0::double) - 20 as start_s, least(end_s, 90.0::double) - 20 as end_s, confidence, text, call_type from segments where end_s > 20 and start_s < 90", "segments")
def tx20(c: Corpus) -> DataFrame:
    """A time range of each call."""
    return t.trim_calls(c.segments(), 20.0, 90.0).select("call_id", "segment_id", "speaker", "start_s", "end_s", "confidence", "text", "call_type")


@query("tx21_first_mention", f"with {heard('fh', 'segments')} select call_id, phrase, min(segment_id) as segment_id from fh where category = 'fraud' group by call_id, phrase", "segments vocab")
def tx21(c: Corpus) -> DataFrame:
    """First segment with a phrase."""
    return t.first_mention(c.segments(), vocabulary.pack(c.spark).where("category = 'fraud'").select("phrase").distinct())


@query("tx23_display_speaker", "select call_id, segment_id, case when lower(speaker) like '%agent%' or lower(speaker) = 'speaker_00' then 'Agent' when lower(speaker) like '%customer%' or lower(speaker) = 'speaker_01' then 'Customer' else 'Speaker ' || right(speaker, 2) end as label from segments", "segments")
def tx23(c: Corpus) -> DataFrame:
    """Speakers as shown."""
    return t.display_speaker(c.segments())


@query("io04_english_fallback", """select category, subcategory, phrase, arg_min(lang, (lang <> 'hi', ord)) as lang, arg_min(ord, (lang <> 'hi', ord)) as ord from vocab where lang in ('hi', 'en') group by category, subcategory, phrase""", "vocab")
def io04(c: Corpus) -> DataFrame:
    """A language's phrases with the English ones."""
    return vocabulary.with_english(vocabulary.pack(c.spark), "hi").select("category", "subcategory", "phrase", "lang", "ord")


@query("tx13_name_speakers", """with own as (select call_id, speaker, lower(regexp_extract(text, '(?i)\\bmy name is ([A-Z][a-z]+)', 1)) as name from segments_long),
    handed as (select call_id, segment_id as placed, speaker as spoke, lower(regexp_extract(text, '(?i)\\bthank you, ([A-Z][a-z]+), over to you', 1)) as name from segments_long),
    near as (select h.call_id, h.placed, h.name, arg_min(s.speaker, s.segment_id) as speaker from handed h join segments_long s on s.call_id = h.call_id and s.segment_id > h.placed and s.segment_id <= h.placed + 4 and s.speaker <> h.spoke where h.name <> '' group by all),
    e as (select call_id, speaker, name from own union all select call_id, speaker, name from near), p as (select call_id, speaker, name, 2 * count(*) as points from e where length(name) > 2 and name not in ('calling', 'from', 'the', 'and', 'you', 'sir', 'madam', 'your', 'here') group by all),
    b as (select * from (select *, row_number() over (partition by call_id, speaker order by points desc, name) as k from p) where k = 1)
    select call_id, speaker, name, points from (select *, row_number() over (partition by call_id, name order by points desc, speaker) as j from b) where j = 1""", "segments segments_long")
def tx13(c: Corpus) -> DataFrame:
    """Names of speakers."""
    return t.name_speakers(c.segments_long())

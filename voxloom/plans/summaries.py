"""Queries over free text about calls, and over what their records show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities as e
from ..operators import pii, records, transcript, understanding
from ..operators import summaries as s
from ..sources.fixtures import Corpus
from ..sources.shared import written
from .entities import ANSWERS, ENTITIES, IMPORTED, LINES, NER, imported
from .entities import answers as lines
from .pii import CALLS, KEY
from .records import ESCALATED, NUMBERS, SCORED, escalated, judged
from .registry import query
from .understanding import INTENTS

_LINE = "case segment_id % 7 when 0 then '**Summary: ' || text when 1 then text || ' *' when 2 then 'Key Outcomes' when 3 then '- [Outcome 1]: ' || text when 4 then ' ACTIONS: ' when 5 then '* 2) ' || text else case when call_id % 2 = 0 then '- specific finding: ' || text else '3. Step 4: ' || text end end"
ANSWER = f"told as (select call_id, segment_id, {_LINE} as line from segments)"


def answers(c: Corpus) -> DataFrame:
    """An annotator's answer for each call."""
    rows = c.segments().select("call_id", F.struct("segment_id", F.expr(_LINE).alias("line")).alias("x"))
    return rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("answer"))


_HEADS = " ".join(f"when regexp_matches(trim(line), '{opens}') then '{name}'" for name, opens in s.SECTIONS)
_MARKS = "[" + ", ".join(f"'{m}'" for m in s.TEMPLATE_MARKS) + "]"
_FREE = f"len(list_filter({_MARKS}, lambda m: contains(lower(item), m))) = 0"


@query("rs11_parse_answers", f"""with {ANSWER}, l as (select call_id, segment_id, trim(line) as line, case {_HEADS} end as head from told),
    p as (select *, arg_max(head, segment_id) filter (head is not null) over (partition by call_id order by segment_id rows unbounded preceding) as section, max(segment_id) filter (head = 'summary') over (partition by call_id order by segment_id rows unbounded preceding) as since from l where line <> ''),
    lasts as (select call_id, max(since) as since from p group by call_id),
    sm as (select call_id, trim(string_agg(case head when 'summary' then trim(trim(trim(regexp_replace(line, '^[^:]*:?', '')), '*')) else trim(trim(line, '*')) end, ' ' order by segment_id)) as item from p join lasts using (call_id) where section = 'summary' and segment_id >= lasts.since and not regexp_matches(line, '{s.BULLET}') group by call_id),
    it as (select call_id, section, segment_id, trim(regexp_replace(trim(regexp_replace(line, '{s.BULLET}', '')), '{s.LABEL}', '')) as item from p where head is null and regexp_matches(line, '{s.BULLET}')),
    g as (select call_id, string_agg(item, '/' order by segment_id) filter (section = 'outcomes') as o, string_agg(item, '/' order by segment_id) filter (section = 'actions') as a from it where item <> '' and {_FREE} group by call_id)
    select call_id, coalesce((select any_value(item) from sm where sm.call_id = c.call_id and item <> '' and {_FREE}), '{s.NO_SUMMARY}') as summary, coalesce(o, '{s.NO_OUTCOME}') as outcomes, coalesce(a, '{s.NO_ACTION}') as actions
    from (select distinct call_id from segments) c left join g using (call_id)""", "segments")
def rs11(c: Corpus) -> DataFrame:
    """Answers parsed into fields."""
    return s.parse_answer(answers(c)).select("call_id", "summary", F.array_join("outcomes", "/").alias("outcomes"), F.array_join("actions", "/").alias("actions"))


_SCAFFOLD = "case segment_id % 4 when 0 then '**Outlook for the year:** ' || text when 1 then '[Key figure goes here] ' || text || ' : : ' || text || ' :' when 2 then 'Summary: Next actions: : ' || text else text end"
_STRIPPED = _SCAFFOLD
PROMPT = ["outlook", "summary", "next actions"]
for _pattern, _new in s.scaffolding(PROMPT):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', '{_new.replace('$1', chr(92) + '1')}', 'g')"


@query("rs10_strip_scaffolding", f"with x as (select call_id, segment_id, trim({_STRIPPED}, ' -–—:*') as t from segments) select call_id, segment_id, case when len(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) < 12 then '' else t end as text from x", "segments")
def rs10(c: Corpus) -> DataFrame:
    """Placeholders and headings taken out."""
    return c.segments().select("call_id", "segment_id", s.strip_scaffolding(F.expr(_SCAFFOLD), PROMPT).alias("text"))


_CLAIM = "case segment_id % 3 when 0 then text || ', that is about $' || (call_id * 37 + 1000) || ' USD or 40 dollars' when 1 then 'Owed (approximately ' || (call_id * 41 + 500) || ' euros), paid ' || text || ' or roughly US$ 7,250.50 million.' else 'Due $' || coalesce(nullif(regexp_extract(text, '[0-9]+', 0), ''), '77') || ' ; and ' || (call_id * 3 + 101) || ' rupees' end"
_TIDIED = "kept"
for _pattern, _new in s.TIDY:
    _TIDIED = f"regexp_replace({_TIDIED}, '{_pattern}', '{_new.replace('$1', chr(92) + '1')}', 'g')"
_CANON = "regexp_replace(replace(regexp_extract({}, '\\d+(?:,\\d{{2,3}})*(?:\\.\\d+)?'), ',', ''), '\\.0+$', '')"
FOREIGN = f"""{NUMBERS}, fields as (select call_id, case when segment_id % 2 = 0 then 'summary' else 'outcomes' end as field, segment_id as ord, {_CLAIM} as text from segments),
    cl as (select call_id, ord, generate_subscripts(m, 1) as k, unnest(m) as claim from (select call_id, ord, regexp_extract_all(text, '{s.FOREIGN}') as m from fields)),
    cn as (select *, {_CANON.format("claim")} as n from cl),
    cs as (select *, exists (select 1 from numbers u where u.call_id = cn.call_id and u.number = cn.n) or (regexp_matches(n, '^\\d{{1,3}}$') and try_cast(n as int) <= 100) as ok from cn),
    cj as (select call_id, ord, list(case when ok then claim else chr(1) end order by k) as stay, list(trim(claim, ' ' || chr(9)) order by k) filter (not ok) as removed from cs group by call_id, ord),
    fp as (select call_id, field, ord, coalesce(stay, []) as stay, coalesce(removed, []) as removed, regexp_split_to_array(text, '{s.FOREIGN}') as pieces from fields left join cj using (call_id, ord)),
    fk as (select *, pieces[1] || array_to_string(list_transform(range(1, len(stay) + 1), lambda i: stay[i] || pieces[i + 1]), '') as kept from fp),
    guarded as (select call_id, field, ord, trim({_TIDIED}) as text, removed from fk)"""


def fields(c: Corpus) -> DataFrame:
    """Texts about calls, with claims in currencies."""
    return c.spoken().select("call_id", F.when(F.col("segment_id") % 2 == 0, "summary").otherwise("outcomes").alias("field"), F.col("segment_id").alias("ord"), F.expr(_CLAIM).alias("text"))


@query("rs07_foreign_claims", f"with {FOREIGN} select call_id, field, ord, text, array_to_string(removed, '/') as removed from guarded", "segments")
def rs07(c: Corpus) -> DataFrame:
    """Unsupported claims in a foreign currency taken out."""
    return s.drop_foreign(fields(c), c.spoken()).withColumn("removed", F.array_join("removed", "/"))


@query("rs09_guard_audit", f"""with {FOREIGN}, fn as (select distinct call_id, regexp_replace(replace(unnest(regexp_extract_all(text, '\\d+(?:,\\d{{2,3}})*(?:\\.\\d+)?')), ',', ''), '\\.0+$', '') as number from guarded),
    un as (select call_id, string_agg(number, '/' order by number) as unsupported from fn where not (regexp_matches(number, '^\\d{{1,3}}$') and try_cast(number as int) <= 100) and not exists (select 1 from numbers u where u.call_id = fn.call_id and u.number = fn.number) group by call_id)
    select call_id, array_to_string(list_sort(flatten(list(removed))), '/') as removed, coalesce(any_value(unsupported), '') as unsupported from guarded left join un using (call_id) group by call_id""", "segments")
def rs09(c: Corpus) -> DataFrame:
    """What the guard found over all fields of a call."""
    found = s.guard_audit(fields(c), c.spoken())
    return found.select("call_id", F.array_join("removed", "/").alias("removed"), F.array_join("unsupported", "/").alias("unsupported"))


@query("rs14_key_metrics", f"""with {ENTITIES}, {NER}, {IMPORTED}, shown as (select call_id, segment_id, mention, amount, entity_type from entities union all select call_id, segment_id, mention, null, entity_type from imported),
    kinds as (select *, case when entity_type in ('currency_amount', 'payment', 'instalment', 'loan') then 'financial_amount' when entity_type = 'interest_rate' then 'rate' when entity_type = 'date' then 'date' when entity_type = 'organization' then entity_type when entity_type = 'person' then 'key_person' end as kind from shown),
    once as (select *, row_number() over (partition by call_id, kind, lower(trim(mention)) order by segment_id, mention) as same from kinds where kind is not null),
    placed as (select *, row_number() over (partition by call_id, kind order by case kind when 'financial_amount' then amount end desc nulls last, segment_id, mention) as place from once where kind not in ('organization', 'key_person') or (same = 1 and length(trim(mention)) > 2))
    select call_id, kind, place, mention as value, segment_id from placed where place <= case when kind = 'financial_amount' then 8 when kind in ('rate', 'date') then 4 else 6 end""", "segments")
def rs14(c: Corpus) -> DataFrame:
    """Key metrics of a call."""
    columns = ["call_id", "segment_id", "entity_type", "mention", "amount"]
    return s.key_metrics(e.extract(c.segments()).select(columns).unionByName(imported(c).withColumn("amount", F.lit(None).cast("double")).select(columns)))


@query("rs17_risk_factors", f"""with {INTENTS}, st as (select call_id, row_number() over (partition by call_id order by segment_id) as place, trim(left(text, 120)) as detail from intents join segments using (call_id, segment_id) where intent = 'risk_warning'),
    n as (select call_id, count(*) filter (intent = 'complaint') as c, count(*) filter (intent = 'escalation') as e, count(*) filter (intent = 'dispute') as d, 100 * avg((intent = 'refusal')::int) as r from intents group by call_id)
    select call_id, 'stated_risk' as kind, place, detail from st where place <= 4 union all select call_id, 'complaint_detected', 1, c || ' complaint(s) raised during call' from n where c > 0
    union all select call_id, 'escalation_detected', 1, e || ' escalation event(s)' from n where e > 0 union all select call_id, 'dispute_detected', 1, d || ' dispute(s) identified' from n where d > 0
    union all select call_id, 'high_refusal_rate', 1, 'Refusal rate ' || round_even(r, 0)::int || '% — customer resistance detected' from n where r > 10""", "segments")
def rs17(c: Corpus) -> DataFrame:
    """Risk factors of a call."""
    return s.risk_factors(understanding.keyword_intents(c.spoken()), c.spoken())


@query("em09_emotions_view", """with n as (select call_id, emotion, count(*) as n from emotions group by all), l as (select call_id, arg_min(emotion, (-n, emotion)) as largest from n group by call_id),
    d as (select call_id, arg_min(emotion, (-n, emotion)) as dominant from (select call_id, emotion, count(*) as n from emotions where lower(speaker) in ('customer', 'speaker b', 'speaker_01') group by all) group by call_id)
    select call_id, segment_id, speaker, emotion, emotion_score as score, case when coalesce(dominant, 'neutral') = 'neutral' then largest else dominant end as dominant from emotions join l using (call_id) left join d using (call_id)""", "segments emotions")
def em09(c: Corpus) -> DataFrame:
    """Emotions of a call as shown."""
    felt = c.emotions()
    counts = felt.where(F.lower("speaker").isin(*transcript.CUSTOMER)).groupBy("call_id", "emotion").agg(F.count("*").alias("n"))
    dominant = counts.groupBy("call_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "emotion")).alias("x")).select("call_id", F.col("x.emotion").alias("dominant"))
    return s.emotions_view(felt, dominant)


@query("qy05_transcript_view", "with a as (select call_id, count(distinct speaker) as num_speakers, round(avg(confidence), 6) as overall_confidence from segments group by call_id) select call_id, num_speakers, overall_confidence, segment_id, speaker, start_s, end_s, text from segments join a using (call_id)", "segments")
def qy05(c: Corpus) -> DataFrame:
    """Transcripts as shown."""
    return s.transcript_view(c.segments())


@query("qy06_intents_view", f"with {INTENTS} select i.call_id, i.segment_id, intent, i.confidence, text from intents i join segments s on s.call_id = i.call_id and s.segment_id = i.segment_id", "segments")
def qy06(c: Corpus) -> DataFrame:
    """Intents with their utterances."""
    return records.intent_export(understanding.keyword_intents(c.segments()), c.segments())


def _html(text: str) -> str:
    for plain, safe in transcript.HTML_ESCAPES:
        text = "replace({}, '{}', '{}')".format(text, plain.replace("'", "''"), safe)
    return text


@query("tx22_mark_entities", f"""with recursive {ENTITIES}, o as (select *, row_number() over (partition by call_id, segment_id order by length(mention) desc, a, entity_type) as k, count(*) over (partition by call_id, segment_id) as n from (
        select distinct call_id, segment_id, mention, entity_type, instr(text, mention) as a, a + length(mention) as z from entities join segments using (call_id, segment_id) where mention <> '' and instr(text, mention) > 0)),
    pick(call_id, segment_id, k, n, taken) as (select call_id, segment_id, k, n, [{{'a': a, 'z': z, 't': entity_type}}] from o where k = 1
        union all select o.call_id, o.segment_id, o.k, o.n, case when len(list_filter(taken, lambda x: o.a < x.z and o.z > x.a)) = 0 then list_append(taken, {{'a': o.a, 'z': o.z, 't': o.entity_type}}) else taken end from pick p join o on o.call_id = p.call_id and o.segment_id = p.segment_id and o.k = p.k + 1),
    spans as (select call_id, segment_id, unnest(taken) as x from pick where k = n),
    cut as (select call_id, segment_id, text, x.a as a, x.z as z, x.t as t, coalesce(lag(x.z) over (partition by call_id, segment_id order by x.a), 1) as b from spans join segments using (call_id, segment_id)),
    made as (select call_id, segment_id, string_agg({_html("substr(text, b, a - b)")} || '<mark class="' || {_html("t")} || '">' || {_html("substr(text, a, z - a)")} || '</mark>', '' order by a) as h, max(z) as z from cut group by call_id, segment_id)
    select call_id, segment_id, coalesce(h, '') || {_html("substr(text, coalesce(z, 1)::bigint)")} as html from segments left join made using (call_id, segment_id)""", "segments")
def tx22(c: Corpus) -> DataFrame:
    """Entities marked in the transcript."""
    return transcript.mark_entities(c.segments(), e.extract(c.segments()))


_ALL = ENTITIES.replace("every as", "every_entity as").replace("from every)", "from every_entity)")


@query("io06_flat_calls", f"""with {SCORED}, {INTENTS}, {ESCALATED}, {_ALL}, {CALLS.replace("scored as", "scored_pii as").replace("from scored", "from scored_pii")}, {ANSWERS}, {LINES},
    f as (select call_id, max(end_s) as duration_s, round(avg(confidence), 6) as confidence, count(distinct speaker) as n_speakers, round(coalesce(sum(end_s - start_s) filter (lower(speaker) in ('agent', 'speaker a', 'speaker_00')), 0) / nullif(sum(end_s - start_s), 0), 4) as agent_share,
        round(coalesce(sum(end_s - start_s) filter (lower(speaker) in ('customer', 'speaker b', 'speaker_01')), 0) / nullif(sum(end_s - start_s), 0), 4) as customer_share from segments group by call_id),
    n1 as (select call_id, count(*) as n from intents group by 1), n2 as (select call_id, count(*) as n from entities group by 1), n3 as (select call_id, count(*) as n from lines where t like 'OBLIGATION|%' and not t like 'OBLIGATION|x|%' group by 1), n4 as (select call_id, count(*) as n from pii group by 1)
    select call_id, null::varchar as source, duration_s, null::varchar as language, null::boolean as mixed, call_type, null::double as quality_score, null::varchar as quality_flag, null::double as snr_db, confidence, n_speakers, agent_share, customer_share, n1.n as n_intents, coalesce(n2.n, 0) as n_entities,
        coalesce(n3.n, 0) as n_obligations, coalesce(n3.n, 0) as n_binding, violations as n_failed, fraud as n_signals, coalesce(n4.n, 0) as n_personal, 0::bigint as n_toxic, null::varchar as tamper_risk, compliance_score, risk_level, customer_emotion, escalated, review_required, priority, null::varchar as summary
    from scored_calls join f using (call_id) join escalations using (call_id) left join n1 using (call_id) left join n2 using (call_id) left join n3 using (call_id) left join n4 using (call_id)""", "segments vocab emotions")
def io06(c: Corpus) -> DataFrame:
    """A flat row of 29 columns for each call, from what the fixture knows of it."""
    segments = c.spoken()
    scored = records.score_judged(judged(c, segments)).withColumnsRenamed({"violations": "n_failed", "fraud": "n_signals"})
    about = segments.groupBy("call_id").agg(F.max("end_s").alias("duration_s"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_distinct("speaker").alias("n_speakers"))
    counted = lambda rows, name, *more: rows.groupBy("call_id").agg(F.count("*").alias(name), *more)
    intents = written(understanding.keyword_intents(segments), "intents")  # read twice
    bound = counted(e.parse_obligation_lines(lines(c, segments)), "n_obligations", F.count_if(F.col("strength") == "binding").alias("n_binding"))
    return records.flat_calls(scored, about, transcript.talk_time(segments), counted(intents, "n_intents"), counted(e.extract(segments), "n_entities"), bound, counted(pii.detect(segments, KEY), "n_personal"), escalated(c, segments, intents))

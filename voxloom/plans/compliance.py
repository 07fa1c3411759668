"""Queries over compliance checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compliance as k
from ..sources import vocabulary
from ..sources.fixtures import Corpus
from .registry import query
from .transcript import heard

AGENT, CUSTOMER = "('agent', 'speaker a', 'speaker_00')", "('customer', 'speaker b', 'speaker_01')"
SCOPE = f"scope as (select * exclude (has) from (select *, max((lower(speaker) in {AGENT})::int) over (partition by call_id) as has from segments) where lower(speaker) in {AGENT} or has = 0)"


def _remap(raw: str) -> str:
    return f"case when call_type in ('collections', 'kyc', 'consent') then {raw} when call_type in ('complaint', 'onboarding') then case {raw} when 'critical' then 'high' when 'high' then 'medium' else 'low' end else 'low' end"


OPENING = "opening as (select * from (select *, coalesce(sum(end_s - start_s) over (partition by call_id order by segment_id rows between unbounded preceding and 1 preceding), 0) as b from scope) where b < 30)"
SCOPED = f"{SCOPE}, {heard('scope_hits', 'scope')}"
WHOLE = heard("hits", "segments")
REQUIRED = f"""{OPENING}, {heard("opening_hits", "opening")},
    rules as (select distinct split_part(subcategory, '/', 1) as call_type, split_part(subcategory, '/', 2) as check_name from vocab where category = 'required'),
    rh as (select call_id, split_part(subcategory, '/', 2) as check_name, min(segment_id) as segment_id from opening_hits where category = 'required' and call_type = split_part(subcategory, '/', 1) group by all),
    required as (select call_id, check_name, segment_id is not null as passed, case when segment_id is not null then 'low' else {_remap("'high'")} end as severity, segment_id, null::varchar as evidence
        from (select distinct call_id, call_type from segments where call_type <> 'general') c join rules r using (call_type) left join rh using (call_id, check_name))"""
PROHIBITED = f"""prohibited as (select call_id, 'prohibited_' || subcategory as check_name, false as passed, {_remap("case when subcategory in ('threats', 'coercion', 'misleading') then 'critical' else 'high' end")} as severity, min(segment_id) as segment_id, phrase as evidence
        from scope_hits where category = 'prohibited' group by call_id, call_type, subcategory, phrase)"""
THIRD = "third as (select call_id, 'third_party_disclosure' as check_name, false as passed, 'critical' as severity, min(segment_id) as segment_id, phrase as evidence from scope_hits where category = 'third_party' group by call_id, phrase)"
DOMINATION = f"""domination as (select call_id, 'agent_domination' as check_name, false as passed, 'medium' as severity, null::int as segment_id, null::varchar as evidence from
        (select call_id, coalesce(sum(end_s - start_s) filter (lower(speaker) in {AGENT}), 0) as a, coalesce(sum(end_s - start_s) filter (lower(speaker) in {CUSTOMER}), 0) as c from segments where call_type = 'collections' group by call_id) where a + c > 0 and a / (a + c) > 0.75)"""
NOTICES = """nh as (select call_id, subcategory as check_name, min(segment_id) as segment_id from hits where category = 'disclaimer' and call_type = 'general' group by all),
    notices as (select call_id, check_name, segment_id is not null as passed, 'low' as severity, segment_id, null::varchar as evidence from (select distinct call_id from segments where call_type = 'general') cross join (select distinct subcategory as check_name from vocab where category = 'disclaimer') left join nh using (call_id, check_name))"""
PROTECTION = f"""da as (select distinct call_id, call_type from hits where category = 'data_request'),
    dhit as (select call_id, category, min(segment_id) as segment_id from hits where category in ('data_purpose', 'data_consent', 'data_rights') group by all),
    protection as (select call_id, check_name, segment_id is not null as passed, case when segment_id is not null then 'low' else {_remap("raw")} end as severity, segment_id, null::varchar as evidence
        from da cross join (values ('data_purpose', 'purpose_notice', 'high'), ('data_consent', 'consent_obtained', 'critical'), ('data_rights', 'rights_notice', 'medium')) r(category, check_name, raw) left join dhit using (call_id, category)
        union all select call_id, 'data_minimisation', false, {_remap("'high'")}, min(segment_id), array_to_string(list_sort(list(distinct phrase)), ', ') from hits where category = 'sensitive_id' and call_type not in ('kyc', 'onboarding') group by call_id, call_type)"""


def ended(source: str) -> str:
    """Requests to end the call that were ignored, in ``source``."""
    return f"""{heard("customer_hits", f"(select * from {source} where lower(speaker) in {CUSTOMER})")},
    asked as (select call_id, arg_min(segment_id, (ord, segment_id, phrase)) as segment_id, arg_min(phrase, (ord, segment_id, phrase)) as evidence from customer_hits where category = 'end_call' group by call_id),
    ended as (select a.call_id, 'ignored_end_request' as check_name, false as passed, 'high' as severity, a.segment_id, a.evidence from asked a join {source} s on s.call_id = a.call_id and lower(s.speaker) in {AGENT} and s.segment_id > a.segment_id group by all having count(*) > 3)"""


CHECKS = f"""{SCOPED}, {WHOLE}, {REQUIRED}, {PROHIBITED}, {THIRD}, {DOMINATION}, {ended("segments")}, {NOTICES}, {PROTECTION},
    checks as (select * from required union all select * from prohibited union all select * from third union all select * from domination union all select * from ended union all select * from notices union all select * from protection)"""


def vocab(c: Corpus) -> DataFrame:
    """The phrases."""
    return vocabulary.pack(c.spark)


@query("co01_required_disclosures", f"with {SCOPE}, {REQUIRED} select * from required", "segments vocab")
def co01(c: Corpus) -> DataFrame:
    """Required disclosures (CO-01, CO-13, CO-14)."""
    return k.required_disclosures(c.segments(), vocab(c))


@query("co02_prohibited_phrases", f"with {SCOPED}, {PROHIBITED} select * from prohibited", "segments vocab")
def co02(c: Corpus) -> DataFrame:
    """Prohibited phrases."""
    return k.prohibited_phrases(c.segments(), vocab(c))


@query("co03_third_party", f"with {SCOPED}, {THIRD} select * from third", "segments vocab")
def co03(c: Corpus) -> DataFrame:
    """Disclosure to others."""
    return k.third_party(c.segments(), vocab(c))


@query("co04_agent_domination", f"with {DOMINATION} select * from domination", "segments")
def co04(c: Corpus) -> DataFrame:
    """Agents who talk most of the time."""
    return k.agent_domination(c.segments())


@query("co05_ignored_end_request", f"with {ended('segments_long')} select * from ended", "segments segments_long vocab")
def co05(c: Corpus) -> DataFrame:
    """Requests to end the call that were ignored."""
    return k.ignored_end_request(c.segments_long(), vocab(c))


@query("co06_general_notices", f"with {WHOLE}, {NOTICES} select * from notices", "segments vocab")
def co06(c: Corpus) -> DataFrame:
    """Notices of general calls (CO-06 to CO-08)."""
    return k.general_notices(c.segments(), vocab(c))


@query("co09_data_protection", f"with {WHOLE}, {PROTECTION} select * from protection", "segments vocab")
def co09(c: Corpus) -> DataFrame:
    """Data protection (CO-09 to CO-12)."""
    return k.data_protection(c.segments(), vocab(c))


@query("co13_all_checks", f"with {CHECKS} select * from checks", "segments vocab")
def co13(c: Corpus) -> DataFrame:
    """Every check."""
    return k.all_checks(c.segments(), vocab(c))


@query("co15_judge_candidates", "with j as (select call_id, segment_id, row_number() over (partition by call_id order by segment_id) as place, text from segments where length(text) > 15 and regexp_matches(text, '(?i)\\b(?:warrant|police|last chance|house|employer|wife|otp|cvv|arrest|legal)\\b')) select * from j where place <= 40", "segments")
def co15(c: Corpus) -> DataFrame:
    """Utterances for the semantic judge."""
    return k.judge_candidates(c.segments())


JUDGED = "judged as (select call_id, segment_id, case when segment_id % 3 = 0 then null else speaker end as speaker, 'VERDICT| ' || case (call_id + segment_id) % 4 when 0 then 'Threat' when 1 then 'harassment' when 2 then 'none' else 'other' end as line from segments)"
VERDICTS = """jk as (select call_id, segment_id, speaker, lower(trim(split_part(line, '|', 2))) as key from judged),
    jv as (select *, case key when 'threat' then 'critical' else 'high' end as sev, row_number() over (partition by call_id, key order by segment_id) as k from jk where key in ('threat', 'harassment')),
    verdicts as (select call_id, 'semantic_' || key as check_name, false as passed, case when speaker is null and sev = 'critical' then 'high' else sev end as severity, segment_id, case when speaker is null then 'speaker not attributed' end as evidence from jv where k = 1)"""


def judged(c: Corpus) -> DataFrame:
    """Made-up answers of a judge."""
    n = (F.col("call_id") + F.col("segment_id")) % 4
    key = F.when(n == 0, "Threat").when(n == 1, "harassment").when(n == 2, "none").otherwise("other")
    return c.segments().select("call_id", "segment_id", F.when(F.col("segment_id") % 3 != 0, F.col("speaker")).alias("speaker"), F.concat(F.lit("VERDICT| "), key).alias("line"))


@query("co16_import_verdicts", f"with {JUDGED}, {VERDICTS} select * from verdicts", "segments")
def co16(c: Corpus) -> DataFrame:
    """A judge's verdicts."""
    return k.import_verdicts(judged(c))


@query("co17_merge_checks", f"with {SCOPED}, {THIRD}, {JUDGED}, {VERDICTS}, base as (select * from third union all select * from verdicts where call_id % 2 = 0) select * from base union all select * from verdicts v where not exists (select 1 from base b where b.call_id = v.call_id and b.check_name = v.check_name)", "segments vocab")
def co17(c: Corpus) -> DataFrame:
    """Verdicts merged into the checks."""
    found = k.import_verdicts(judged(c))
    return k.merge_checks(k.third_party(c.segments(), vocab(c)).unionByName(found.where("call_id % 2 = 0")), found)

"""Queries over personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities as e
from ..operators import pii as p
from ..sources.fixtures import Corpus
from .entities import ENTITIES, NER, ner
from .registry import query


def _found(table: str, key: str) -> str:
    parts = []
    for kind, score, pattern in p.RECOGNIZERS:
        q = pattern.replace("'", "''")
        parts.append(f"select {key}, '{kind}' as entity_type, generate_subscripts(m, 1) - 1 as ord, unnest(m) as mention, {score}::double as score, regexp_split_to_array(text, '{q}') as pieces, m from (select {key}, text, regexp_extract_all(text, '{q}') as m from {table}) where len(m) > 0")
    return f"""raw as ({" union all ".join(parts)}),
    found as (select {key}, entity_type, ord, mention, score, array_to_string(list_transform(range(1, ord + 1), lambda i: pieces[i] || m[i]), '') || pieces[ord + 1] as before from raw)"""


_D = "regexp_replace(mention, '\\D', '', 'g')"
_C = "mention"
for _pattern, _new in p.WRITTEN:
    _C = f"regexp_replace({_C}, '{_pattern}', '{_new.replace('$', chr(92))}', 'g')"
_C = f"upper({_C})"
_MOVE = "[" + ", ".join(f"'{r}'" for r in p.VERHOEFF_MOVE) + "]"
_TIMES = "[" + ", ".join(f"'{r}'" for r in p.VERHOEFF_TIMES) + "]"
VERHOEFF = f"list_reduce(list_transform(range(0, length({_C})), lambda k: substr({_MOVE}[k % 8 + 1], reverse({_C})[k + 1]::int + 1, 1)::int), lambda c, x: substr({_TIMES}[c + 1], x + 1, 1)::int, 0) = 0"
LUHN = f"list_sum(list_transform(range(0, length({_D})), lambda k: case when k % 2 = 0 then reverse({_D})[k + 1]::int when reverse({_D})[k + 1]::int > 4 then reverse({_D})[k + 1]::int * 2 - 9 else reverse({_D})[k + 1]::int * 2 end)) % 10 = 0"
_PLAIN = "replace(mention, ' ', '')"
IBAN = f"length({_PLAIN}) between 15 and 34 and list_reduce(list_transform(string_split(substr({_PLAIN}, 5) || left({_PLAIN}, 4), ''), lambda x: case when regexp_matches(x, '[0-9]') then x::int else 1000 + ascii(x) - 55 end), lambda a, x: case when x < 1000 then a * 10 + x else a * 100 + x - 1000 end % 97, 0) = 1"
_SHORTER = ["mention", *[f"regexp_replace(mention, '(?: [A-Z0-9]+){{{k}}}$', '')" for k in (1, 2, 3)]]
ACCOUNT = "coalesce(" + ", ".join(f"case when {IBAN.replace('mention', x)} then {x} end" for x in _SHORTER) + ")"
_CONTEXT = " ".join("when '{}' then [{}]".format(k, ", ".join(f"'{w}'" for w in v)) for k, v in p.CONTEXT.items())


def _detected(table: str, key: str) -> str:
    return f"""{_found(table, key)},
    valid as (select * replace (case when entity_type = 'IBAN' then {ACCOUNT} else mention end as mention) from found where case entity_type when 'AADHAAR' then mention[1] <> '+' and case when regexp_matches({_C}, '^[2-9][0-9]{{11}}$') then {VERHOEFF} else false end when 'PAN' then regexp_matches({_C}, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') when 'UPI' then not regexp_matches(mention, '@.*[.-]') when 'CARD' then {LUHN} when 'IBAN' then {ACCOUNT} is not null when 'IP' then len(list_filter(string_split(mention, '.'), lambda x: x::int > 255)) = 0 else true end),
    near as (select *, list_filter(string_split(trim(regexp_replace(lower(before), '[^a-z]+', ' ', 'g')), ' '), lambda w: w <> '') as w from valid),
    scored as (select * exclude (w, score), round(case when list_has_any(w[greatest(len(w) - 4, 1):], coalesce(case entity_type {_CONTEXT} end, [])) then least(score + 0.35, 1) else score end, 2) as score from near),
    everywhere as (select *, length(before) as start, max(score) over (partition by {key}, entity_type, mention) as most from scored),
    places as (select distinct {key}, entity_type, mention, most as score, start from everywhere where most >= case entity_type when 'DATE' then 0.7 else 0.5 end),
    best as (select *, length(before) as start, row_number() over (partition by {key}, entity_type, mention order by score desc, length(before)) as k from scored where score >= case entity_type when 'DATE' then 0.7 else 0.5 end),
    pii as (select {key}, entity_type, mention, score, start from best where k = 1)"""


CALLS, DOCS = _detected("segments", "call_id, segment_id"), _detected("documents", "doc_id")
KEY = ["call_id", "segment_id"]


@query("pi01_found", f"with {_found('segments', 'call_id, segment_id')} select call_id, segment_id, entity_type, ord, mention, score, length(before) as start from found", "segments")
def pi01(c: Corpus) -> DataFrame:
    """All patterns with their places (PI-01, PI-03 to PI-08)."""
    return p.found(c.segments(), KEY).drop("near")


@query("pi02_check_digits", f"with {_found('segments', 'call_id, segment_id')} select call_id, segment_id, mention, {VERHOEFF} as ok from found where entity_type = 'AADHAAR'", "segments")
def pi02(c: Corpus) -> DataFrame:
    """Verhoeff check of twelve-digit numbers."""
    rows = p.found(c.segments(), KEY).where("entity_type = 'AADHAAR'")
    return rows.select(*KEY, "mention", p.verhoeff_ok(p.as_written(F.col("mention"))).alias("ok"))


@query("pi10_detect", f"with {CALLS} select * from pii", "segments")
def pi10(c: Corpus) -> DataFrame:
    """Personal data in calls, with context and thresholds (PI-10, PI-11, PI-13)."""
    return p.detect(c.segments(), KEY)


@query("pi09_documents", f"with {DOCS} select * from pii")
def pi09(c: Corpus) -> DataFrame:
    """Personal data in documents."""
    return p.detect(c.table("documents").select("doc_id", "text"), ["doc_id"])


@query("pi12_import_people", f"with {NER} select call_id, segment_id, case label when 'PER' then 'PERSON' else 'LOCATION' end as entity_type, trim(regexp_replace(word, '^##|[^\\p{{L}}\\p{{N}} ]', '', 'g')) as mention, score from ner where score >= 0.5 and label in ('PER', 'LOC') and call_id % 3 <> 0 and length(trim(regexp_replace(word, '^##|[^\\p{{L}}\\p{{N}} ]', '', 'g'))) > 1", "segments")
def pi12(c: Corpus) -> DataFrame:
    """External names and places."""
    return p.import_people(ner(c).withColumn("lang", F.when(F.col("call_id") % 3 == 0, "en").otherwise("hi")))


@query("pi13_counts", f"with {CALLS} select call_id, entity_type, count(*) as n from pii group by all", "segments")
def pi13(c: Corpus) -> DataFrame:
    """Personal data per call and type."""
    return p.counts(p.detect(c.segments(), KEY), "call_id")


_MASK = f"""case when entity_type in ('AADHAAR', 'PHONE', 'BANK_ACCOUNT', 'CARD', 'IBAN') then repeat('X', greatest(length(case when entity_type = 'AADHAAR' then {_C} else {_D} end) - 4, 0)) || right(case when entity_type = 'AADHAAR' then {_C} else {_D} end, 4)
    when entity_type in ('EMAIL', 'UPI') then left(mention, 1) || '***@' || split_part(mention, '@', -1) when entity_type = 'PAN' then 'XXXXX' || substr({_C}, 6, 4) || 'X' else '[' || entity_type || ']' end"""


@query("pi14_mask_values", f"with {DOCS} select doc_id, entity_type, mention, {_MASK} as masked from pii")
def pi14(c: Corpus) -> DataFrame:
    """Masked values."""
    rows = p.detect(c.table("documents").select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", "entity_type", "mention", p.mask_value(F.col("entity_type"), F.col("mention")).alias("masked"))


@query("pi15_mask_spans", f"""with {CALLS},
    spans as (select *, start + length(mention) as stop, {_MASK} as mask from places),
    marked as (select *, case when start >= max(stop) over (partition by call_id, segment_id order by start, stop, entity_type rows between unbounded preceding and 1 preceding) is not false then 1 else 0 end as new from spans),
    islands as (select *, sum(new) over (partition by call_id, segment_id order by start, stop, entity_type rows unbounded preceding) as island from marked),
    merged as (select call_id, segment_id, island, min(start) as start, max(stop) as stop, arg_min(mask, (-score, start - stop, start, entity_type)) as mask from islands group by all),
    cut as (select *, coalesce(lag(stop) over (partition by call_id, segment_id order by start), 0) as before from merged),
    lists as (select call_id, segment_id, string_agg(substr(text, before + 1, start - before) || mask, '' order by start) as l, max(stop) as last from cut join segments using (call_id, segment_id) group by all)
    select call_id, segment_id, case when l is null then text else l || substr(text, last + 1) end as text
    from segments left join lists using (call_id, segment_id)""", "segments")
def pi15(c: Corpus) -> DataFrame:
    """Transcripts masked by span, every place of a value found."""
    s = c.segments()
    return p.mask_spans(s, p.places(s, KEY), KEY)


@query("pi16_mask_strings", f"""with {CALLS}, lists as (select call_id, segment_id, list({{'m': mention, 'x': {_MASK}}} order by length(mention) desc, mention, entity_type) as l from pii group by all)
    select call_id, segment_id, case when l is null then text else list_reduce(list_transform(l, lambda s: s.m || chr(1) || s.x), lambda t, s: replace(t, split_part(s, chr(1), 1), split_part(s, chr(1), 2)), text) end as text from segments left join lists using (call_id, segment_id)""", "segments")
def pi16(c: Corpus) -> DataFrame:
    """Transcripts masked by string."""
    s = c.segments()
    return p.mask_strings(s, p.detect(s, KEY), KEY)


@query("pi17_combined_view", f"with {ENTITIES}, {CALLS} select call_id, segment_id, entity_type, mention from entities where not (entity_type = 'date' and not regexp_matches(mention, '\\d')) union all select call_id, segment_id, 'pii_' || lower(entity_type), mention from pii", "segments")
def pi17(c: Corpus) -> DataFrame:
    """Entities and personal data together."""
    s = c.segments()
    return p.combined_view(e.extract(s), p.detect(s, KEY))

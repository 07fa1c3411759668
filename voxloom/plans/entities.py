"""Queries over entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities as e
from ..sources.fixtures import Corpus
from .registry import query


def _matches(name: str, kind: str, pattern: str, layer: int, confidence: float) -> str:
    p = pattern.replace("'", "''")
    return f"select call_id, segment_id, '{kind}' as entity_type, generate_subscripts(regexp_extract_all(text, '{p}'), 1) - 1 as ord, unnest(regexp_extract_all(text, '{p}')) as mention, {confidence}::double as confidence, {layer} as layer from segments"


MAGNITUDE_SQL = "case lower(regexp_extract(mention, '(?i)(hundred|thousand|lakh|million|crore|billion)', 1)) when 'hundred' then 100 when 'thousand' then 1000 when 'lakh' then 100000 when 'million' then 1000000 when 'crore' then 10000000 when 'billion' then 1000000000 else 1 end"
AMOUNTS = f"""am as ({_matches("a", "currency_amount", e.CURRENCY, 0, 0.95)} union all {_matches("a", "currency_amount", e.WORDED, 1, 0.95)}),
    amounts as (select *, replace(regexp_extract(mention, '\\d[\\d,]*(?:\\.\\d+)?'), ',', '')::double * {MAGNITUDE_SQL} as amount,
        case when regexp_matches(lower(mention), '\\$|usd|dollar') then 'USD' when regexp_matches(lower(mention), '€|eur') then 'EUR' else 'INR' end as currency from am)"""
OTHERS = "others as (" + " union all ".join(_matches("o", kind, pattern, 2 + k, confidence) for k, (kind, confidence, pattern) in enumerate(e.PATTERNS)) + ")"
ENTITIES = f"""{AMOUNTS}, {OTHERS},
    every as (select call_id, segment_id, entity_type, ord, mention, confidence, layer, amount, currency from amounts union all select call_id, segment_id, entity_type, ord, mention, confidence, layer, null, null from others),
    entities as (select * exclude (k, layer) from (select *, row_number() over (partition by call_id, segment_id, entity_type, lower(mention) order by layer, ord) as k from every) where k = 1)"""


@query("en01_amounts", f"with {AMOUNTS} select * from amounts", "segments")
def en01(c: Corpus) -> DataFrame:
    """Currency amounts by symbol and by word (EN-01, EN-02)."""
    return e.amounts(c.segments())


@query("en03_patterns", f"with {OTHERS} select * from others", "segments")
def en03(c: Corpus) -> DataFrame:
    """Dates, identifiers and terms (EN-03 to EN-05)."""
    return e.patterned(c.segments())


@query("en06_dedupe", f"with {ENTITIES} select * from entities", "segments")
def en06(c: Corpus) -> DataFrame:
    """All entities without repeats."""
    return e.extract(c.segments())


@query("en07_spoken_numbers", """select call_id, segment_id, 0 as ord, case when contains(text, 'ten thousand rupees') then 'ten thousand' else 'paanch hazaar' end as mention, case when contains(text, 'ten thousand rupees') then 10000 else 5000 end as amount
    from segments where contains(text, 'ten thousand rupees') or contains(text, 'paanch hazaar rupaye')""", "segments")
def en07(c: Corpus) -> DataFrame:
    """Amounts in words."""
    return e.spoken_numbers(c.segments())


NER = """ner as (select call_id, segment_id, case segment_id % 2 when 0 then 'bert' else 'gazetteer' end as source, case (call_id + segment_id) % 4 when 0 then 'PER' when 1 then 'ORG' when 2 then 'LOC' else 'MISC' end as label,
        string_split(text, ' ')[1] as word, confidence as score from segments)"""
LABELS = {"PER": "person", "ORG": "organization", "LOC": "location"}
IMPORTED = "imported as (select call_id, segment_id, source, case label when 'PER' then 'person' when 'ORG' then 'organization' else 'location' end as entity_type, trim(word) as mention, round(case source when 'gazetteer' then 0.75 else score end, 3) as confidence from ner where score >= 0.5 and label <> 'MISC' and trim(word) <> '')"


def ner(c: Corpus) -> DataFrame:
    """Made-up annotations of an external recognizer."""
    kind = (F.col("call_id") + F.col("segment_id")) % 4
    return c.segments().select("call_id", "segment_id", F.when(F.col("segment_id") % 2 == 0, "bert").otherwise("gazetteer").alias("source"), F.when(kind == 0, "PER").when(kind == 1, "ORG").when(kind == 2, "LOC").otherwise("MISC").alias("label"), F.split("text", " ")[0].alias("word"), F.col("confidence").alias("score"))


def imported(c: Corpus) -> DataFrame:
    """The annotations as entities."""
    return e.import_annotations(ner(c), LABELS, 0.5, {"gazetteer": 0.75})


@query("en08_import_annotations", f"with {NER}, {IMPORTED} select * from imported", "segments")
def en08(c: Corpus) -> DataFrame:
    """External annotations imported."""
    return imported(c)


@query("en09_merge_layers", f"""with {ENTITIES}, {NER}, {IMPORTED},
    a as (select call_id, segment_id, entity_type, mention, confidence, 0 as layer from entities union all select call_id, segment_id, entity_type, mention, confidence, 1 from imported union all select call_id, segment_id, entity_type, upper(mention), 0.5, 2 from imported where segment_id % 3 = 0),
    b as (select *, min(layer) over (partition by call_id, segment_id, entity_type) as least, row_number() over (partition by call_id, segment_id, entity_type order by layer, mention) as k from a)
    select call_id, segment_id, entity_type, mention, confidence, layer from b where layer = 0 or (layer = least and k = 1)""", "segments")
def en09(c: Corpus) -> DataFrame:
    """Layers merged, earlier ones first."""
    more = imported(c)
    third = more.where("segment_id % 3 = 0").withColumn("mention", F.upper("mention")).withColumn("confidence", F.lit(0.5))
    return e.merge_layers([e.extract(c.segments()), more, third])


@query("en10_drop_noise", f"""with {ENTITIES}, {NER}, {IMPORTED}, a as (select call_id, segment_id, entity_type, mention from entities union all select call_id, segment_id, entity_type, mention from imported)
    select * from a where not (entity_type = 'reference' and length(regexp_replace(mention, '\\D', '', 'g')) < 4) and not (entity_type = 'organization' and lower(trim(mention)) in ('emi', 'pan', 'otp', 'we')) and not (entity_type = 'date' and lower(trim(mention)) in ('by friday', 'today'))""", "segments")
def en10(c: Corpus) -> DataFrame:
    """Noise dropped."""
    columns = ["call_id", "segment_id", "entity_type", "mention"]
    return e.drop_noise(e.extract(c.segments()).select(columns).unionByName(imported(c).select(columns)), ["EMI", "PAN", "OTP", "We"], ["by friday", "today"])


@query("en11_merge_sources", f"""with {ENTITIES}, a as (select call_id, segment_id, entity_type, mention, 0 as source from entities where segment_id % 2 = 0 union all select call_id, segment_id, entity_type, upper(mention), 1 from entities)
    select call_id, segment_id, entity_type, mention, source from (select *, row_number() over (partition by call_id, segment_id, entity_type, lower(mention) order by source, mention) as k from a) where k = 1""", "segments")
def en11(c: Corpus) -> DataFrame:
    """Two sources merged."""
    found = e.extract(c.segments()).select("call_id", "segment_id", "entity_type", "mention")
    return e.merge_sources(found.where("segment_id % 2 = 0"), found.withColumn("mention", F.upper("mention")))


@query("en12_totals", f"with {ENTITIES} select call_id, entity_type, count(*) as n, round(sum(amount), 2) as total, max(amount) as largest from entities where entity_type in ('currency_amount', 'instalment') and amount is not null group by call_id, entity_type", "segments")
def en12(c: Corpus) -> DataFrame:
    """Sums of amounts."""
    return e.totals(e.extract(c.segments()))


@query("en13_display_groups", f"""with {ENTITIES} select call_id, case when entity_type in ('currency_amount', 'instalment') then 'Amounts' when entity_type = 'date' then 'Dates' when entity_type in ('interest_rate', 'tenure') then 'Terms' else 'Identifiers' end as display_group, count(*) as n from entities group by all""", "segments")
def en13(c: Corpus) -> DataFrame:
    """Entities by display group."""
    return e.display_groups(e.extract(c.segments()))


ANSWERS = "answers as (select call_id, string_agg(case segment_id % 4 when 0 then 'ENTITY| Payment |' || segment_id || '|' || text when 1 then 'OBLIGATION|' || speaker || '| Binding|' || text when 2 then 'OBLIGATION|x|maybe|y' else 'noise' end, chr(10) order by segment_id) as answer from segments group by call_id)"


def answers(c: Corpus, segments: DataFrame | None = None) -> DataFrame:
    """An annotator's text for each call; ``segments`` are given by queries that have them written."""
    kind = F.col("segment_id") % 4
    line = F.when(kind == 0, F.concat(F.lit("ENTITY| Payment |"), F.col("segment_id"), F.lit("|"), F.col("text"))).when(kind == 1, F.concat(F.lit("OBLIGATION|"), F.col("speaker"), F.lit("| Binding|"), F.col("text"))).when(kind == 2, "OBLIGATION|x|maybe|y").otherwise("noise")
    rows = (c.segments() if segments is None else segments).select("call_id", F.struct("segment_id", line.alias("line")).alias("x"))
    return rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("answer"))


LINES = "lines as (select call_id, unnest(string_split(answer, chr(10))) as t, generate_subscripts(string_split(answer, chr(10)), 1) - 1 as line from answers)"


@query("en14_entity_lines", f"with {ANSWERS}, {LINES} select call_id, line, lower(trim(split_part(t, '|', 2))) as entity_type, trim(split_part(t, '|', 3)) as value, trim(split_part(t, '|', 4)) as raw from lines where t like 'ENTITY|%'", "segments")
def en14(c: Corpus) -> DataFrame:
    """Entity lines parsed."""
    return e.parse_entity_lines(answers(c))


@query("en15_obligation_lines", f"with {ANSWERS}, {LINES} select call_id, line, trim(split_part(t, '|', 2)) as speaker, 'binding' as strength, trim(split_part(t, '|', 4)) as obligation from lines where t like 'OBLIGATION|%' and not t like 'OBLIGATION|x|%'", "segments")
def en15(c: Corpus) -> DataFrame:
    """Obligation lines parsed."""
    return e.parse_obligation_lines(answers(c))

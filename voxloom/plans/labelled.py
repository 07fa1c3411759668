"""Queries over a labelled corpus derived from orders, and scores of detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, pii
from ..operators import labelled as o
from ..sources.fixtures import Corpus
from .entities import ENTITIES
from .pii import _C, VERHOEFF, _detected
from .registry import query

_CHECK = "substr('{}', {} + 1, 1)".format(o.VERHOEFF_INVERSE, VERHOEFF.removesuffix(" = 0").replace(_C, "(payload || '0')"))
CORPUS = f"""keyed as (select o_orderkey as k, o_orderkey % {len(o.KINDS)} as kind from orders), paid as (select *, {o.PAYLOAD} as payload from keyed), digit as (select *, {_CHECK} as d from paid),
    made as (select *, payload || d as good, payload || ((d::int + 1 + k % 9) % 10)::varchar as bad from digit), valued as (select *, {o.pick(2)} as value from made),
    corpus as (select k as sample_id, {o.pick(1)} as text, {o.pick(0)} as entity_type, value, {o.pick(3)} as forbidden from valued)"""


def corpus(c: Corpus) -> DataFrame:
    """A sample for each order."""
    return o.labelled_corpus(c.table("orders").select(F.col("o_orderkey").alias("k")))


@query("ev10_labelled_corpus", f"with {CORPUS} select * from corpus")
def ev10(c: Corpus) -> DataFrame:
    """The labelled corpus."""
    return corpus(c)


_NORMAL = "regexp_replace(lower({}), '[^a-z0-9@]', '', 'g')"


@query("ev02_score_personal", f"""with {CORPUS}, {_detected("corpus", "sample_id")},
    w as (select distinct sample_id, entity_type, {_NORMAL.format("value")} as value from corpus where entity_type is not null and not forbidden), g as (select distinct sample_id, entity_type, {_NORMAL.format("mention")} as value from pii where entity_type in {o.TRACKED}),
    j as (select coalesce(w.sample_id, g.sample_id) as sample_id, coalesce(w.entity_type, g.entity_type) as entity_type, w.value is not null as wanted, g.value is not null as got from w full join g on w.sample_id = g.sample_id and w.entity_type = g.entity_type and w.value = g.value),
    n as (select entity_type, count(*) filter (wanted and got) as tp, count(*) filter (not wanted) as fp, count(*) filter (not got) as fn, count(*) filter (not wanted and exists (select 1 from corpus c where c.forbidden and c.sample_id = j.sample_id and c.entity_type = j.entity_type)) as hard_fp from j group by entity_type)
    select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from n""")
def ev02(c: Corpus) -> DataFrame:
    """Detection of personal data scored on the corpus."""
    samples = corpus(c)
    return o.score_personal(samples, pii.detect(samples.select("sample_id", "text"), ["sample_id"]))


@query("ev04_entity_recall", f"""with {ENTITIES}, x as (select call_id, segment_id, ltrim(regexp_extract(text, '([0-9]+) (?:rupees|lakh|percent)', 1), '0') as want from segments where regexp_matches(text, '[0-9] (?:rupees|lakh|percent)')),
    f as (select exists (select 1 from entities e where e.call_id = x.call_id and e.segment_id = x.segment_id and contains(ltrim(rtrim(regexp_replace(mention, '[^0-9.]', '', 'g'), '.'), '0'), want) and ltrim(rtrim(regexp_replace(mention, '[^0-9.]', '', 'g'), '.'), '0') <> '') as found from x)
    select count(*) filter (found) as tp, count(*) filter (not found) as fn, round(avg(found::int), 6) as recall from f""", "segments")
def ev04(c: Corpus) -> DataFrame:
    """Recall of the amounts that are spoken."""
    s = c.segments()
    spoken = s.where(F.col("text").rlike("[0-9] (?:rupees|lakh|percent)")).select("call_id", "segment_id", F.regexp_extract("text", "([0-9]+) (?:rupees|lakh|percent)", 1).alias("want"))
    return o.entity_recall(spoken, entities.extract(s))

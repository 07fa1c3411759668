"""Queries over mining, training sets and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import mining as m
from ..operators import transcript, understanding
from ..sources.fixtures import Corpus
from ..sources.shared import written
from .registry import query
from .transcript import NORMAL, WORDS
from .understanding import INTENTS

GRAMS = f"""gw as (select d.doc_id, l.toxic as label, string_split({NORMAL}, ' ') as w from documents d join labels l using (doc_id)),
    ge as (select doc_id, label, unnest(list_concat({", ".join(f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (3, 4, 5))})) as gram from gw),
    grams as (select label, gram, count(*) as n, count(distinct doc_id) as docs from ge group by label, gram)"""


def labelled(c: Corpus) -> DataFrame:
    """Labelled documents."""
    return c.table("documents").join(c.table("labels").select("doc_id", F.col("toxic").alias("label")), "doc_id").select("doc_id", "label", "text")


@query("mi01_ngram_counts", f"with {GRAMS} select * from grams")
def mi01(c: Corpus) -> DataFrame:
    """Runs of words by label."""
    return m.ngram_counts(labelled(c))


OVER = f"""{GRAMS}, gb as (select gram, coalesce(sum(n) filter (label = 1), 0)::bigint as a, coalesce(sum(n) filter (label <> 1), 0)::bigint as b from grams group by gram), gt as (select * from gb where a > 0 order by a desc, gram limit 5000),
    gs as (select count(*) filter (toxic = 1) as ta, count(*) filter (toxic <> 1) as tb from labels join documents using (doc_id)),
    over as (select gram, a, b, round((a / ta) / greatest(b / greatest(tb, 1), 0.0001), 6) as ratio from gt, gs where a >= greatest(3, ta // 100) and (a / ta) / greatest(b / greatest(tb, 1), 0.0001) >= 2)"""


def over(c: Corpus) -> DataFrame:
    """Phrases of toxic texts."""
    return m.overrepresented(labelled(c), 1)


@query("mi02_overrepresented", f"with {OVER.replace('over as', 'more as')} select * from more")
def mi02(c: Corpus) -> DataFrame:
    """Phrases that mark a label."""
    return over(c)


@query("mi03_categories", f"with {OVER.replace('over as', 'more as')} select gram, a, b, ratio, case when list_has_any(string_split(gram, ' '), ['the', 'of']) then 'english' when list_has_any(string_split(gram, ' '), ['la', 'de']) then 'romance' else 'other' end as category from more")
def mi03(c: Corpus) -> DataFrame:
    """Phrases by category."""
    return m.assign_category(over(c), [("english", ["the", "of"]), ("romance", ["la", "de"])])


@query("mi04_short_utterances", f"select lower(trim(text)) as phrase, count(*) as n from segments where {WORDS} <= 6 and trim(text) <> '' and not list_has_any(string_split({NORMAL}, ' '), ['rupees', 'emi']) group by 1 having count(*) >= 3", "segments")
def mi04(c: Corpus) -> DataFrame:
    """Short utterances."""
    return m.short_utterances(c.segments(), 6, 3, ["rupees", "emi"])


@query("mi05_terms", "with t as (select unnest(regexp_extract_all(lower(text), '\\b(?:emi|loan|otp|rupees|account)\\b')) as term from segments) select term, count(*) as n from t group by term having count(*) >= 2 order by n desc, term limit 4", "segments")
def mi05(c: Corpus) -> DataFrame:
    """Frequent domain terms."""
    return m.term_frequency(c.segments(), r"\b(?:emi|loan|otp|rupees|account)\b", 4, 2)


@query("mi06_script_words", "with w as (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '\\s+'))) as word from documents where regexp_matches(text, '[\\x{00DF}-\\x{00FF}]')) select word, count(*) as docs from w where regexp_matches(word, '[\\x{00DF}-\\x{00FF}]') group by word")
def mi06(c: Corpus) -> DataFrame:
    """Words of a script."""
    return m.script_words(c.table("documents"), "00DF", "00FF")


@query("mi07_merge_phrases", "select distinct phrase from (select lower(text) as phrase from segments where segment_id = 0 union all select lower(role) from conversations) order by phrase", "segments")
def mi07(c: Corpus) -> DataFrame:
    """Lists merged."""
    return m.merge_phrases(c.segments().where("segment_id = 0").select(F.lower("text").alias("phrase")), c.table("conversations").select(F.lower("role").alias("phrase")))


HEARD = """said as (select call_id * 100 + segment_id as id, string_split(text, ' ') as h, string_split(regexp_replace(text, '\\bkayak form\\b', 'KYC form', 'gi'), ' ') as t from segments),
    placed as (select id, unnest(range(1, len(h) + 1)) as k, h, t from said), differ as (select id, k - row_number() over (partition by id order by k) as run, k, h[k] as a, t[k] as b from placed where h[k] <> t[k])"""


def corrected_pairs(c: Corpus) -> DataFrame:
    """Texts as heard and as corrected."""
    fixed = transcript.correct_terms(c.segments())
    return fixed.where("corrected").select((F.col("call_id") * 100 + F.col("segment_id")).alias("id"), F.col("original_text").alias("heard"), F.col("text").alias("truth"))


@query("mi08_align_words", f"with {HEARD} select id, string_agg(a, ' ' order by k) as heard_words, string_agg(b, ' ' order by k) as true_words from differ group by id, run", "segments")
def mi08(c: Corpus) -> DataFrame:
    """Words heard for others; an alignment per pair of texts. The SQL compares by place: the fixture's corrections keep the number of words."""
    return m.align_words(corrected_pairs(c))


@query("uf02_align_words", f"with {HEARD} select id, string_agg(a, ' ' order by k) as heard_words, string_agg(b, ' ' order by k) as true_words from differ group by id, run", "segments")
def uf02(c: Corpus) -> DataFrame:
    """The same by the table function, from SQL."""
    sql.register(c.spark)
    return c.spark.sql("select p.id, a.heard_words, a.true_words from {pairs} p, lateral align_words(p.heard, p.truth) a", pairs=corrected_pairs(c))


@query("mi09_corrections", """with p as (select string_split(text, ' ')[1] as h, string_split(text, ' ')[2] as t from segments where len(string_split(text, ' ')) > 1), n as (select h, t, count(*) as n from p group by h, t having count(*) >= 2)
    select h as heard_words, t as true_words, n, true as domain from n where lower(t) in ('emi', 'pan') union all (select h, t, n, false from n where not lower(t) in ('emi', 'pan') and length(h) >= 3 and 1 - levenshtein(h, t) / greatest(length(h), length(t)) < 0.8 order by n desc, h, t limit 200)""", "segments")
def mi09(c: Corpus) -> DataFrame:
    """Corrections from word pairs."""
    w = F.split("text", " ")
    return m.discover_corrections(c.segments().where(F.size(w) > 1).select(F.get(w, F.lit(0)).alias("heard_words"), F.get(w, F.lit(1)).alias("true_words")), ["emi", "pan"])


MAPPING = [("urgent", "O", "open"), ("urgent", "F", "done"), ("other", "O", "open")]
CORPORA = "co as (select case when o_orderpriority = '1-URGENT' then 'urgent' else 'other' end as corpus, o_orderstatus as label from orders), mp(corpus, label, target) as (values ('urgent', 'O', 'open'), ('urgent', 'F', 'done'), ('other', 'O', 'open'))"


def corpora(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Two corpora with labels of their own."""
    return m.harmonize(c.table("orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other").alias("corpus"), F.col("o_orderstatus").alias("label"), F.lit("").alias("text")), c.spark.createDataFrame(MAPPING, "corpus string, label string, target string"))


@query("mi10_unmapped", f"with {CORPORA} select corpus, label, count(*) as n from co where not exists (select 1 from mp where mp.corpus = co.corpus and mp.label = co.label) group by all")
def mi10(c: Corpus) -> DataFrame:
    """Labels without a target."""
    return corpora(c)[1]


@query("mi11_label_distribution", f"with {CORPORA} select target as label, count(*) as n from co join mp using (corpus, label) group by target")
def mi11(c: Corpus) -> DataFrame:
    """Labels of both corpora."""
    return corpora(c)[0].groupBy("label").agg(F.count("*").alias("n"))


@query("mi12_split", "select doc_id, quality, percent_rank() over (partition by quality order by md5(doc_id::varchar)) <= 0.15 as held_out from labels")
def mi12(c: Corpus) -> DataFrame:
    """A stratified split."""
    return m.stratified_split(c.table("labels").select("doc_id", "quality"), "quality", "doc_id")


@query("mi13_sentences", """with w as (select conv_id, turn, string_split(text, ' ') as w from conversations), t as (select conv_id, turn // 2 as sent, turn, generate_subscripts(w, 1) as p, unnest(w) as token from w)
    select conv_id as doc, sent, string_agg(token, ' ' order by turn, p) as sentence from t where token <> '' group by conv_id, sent""")
def mi13(c: Corpus) -> DataFrame:
    """Sentences from the tokens of whole turns; empty tokens count as null ones."""
    turns = c.table("conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "token"))
    return m.sentences(turns.select(F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 2).alias("sent"), F.struct("turn", "p").alias("pos"), F.nullif("token", F.lit("")).alias("token")))


def predicted(c: Corpus) -> DataFrame:
    """Intents with and without the regulated rules, made once: the join, for keys that repeat, reads what is written."""
    both = written(understanding.intents_by_call_type(c.segments(), truth=F.col("call_type"), predicted=F.lit("general")), "intents")
    return both.drop("predicted").join(both.drop("truth"), ["call_id", "segment_id"])


PREDICTED = INTENTS + ", " + INTENTS.replace("lowered", "lowered2").replace("from segments", "from (select * replace ('general' as call_type) from segments)").replace("intents as", "intents2 as") + ", pr as (select a.call_id, a.segment_id, a.intent as truth, b.intent as predicted from intents a join intents2 b on a.call_id = b.call_id and a.segment_id = b.segment_id)"


@query("ev01_precision_recall", f"""with {PREDICTED}, j as (select coalesce(e.truth, d.predicted) as kind, (e.truth is not null)::int as e, (d.predicted is not null)::int as d from (select distinct call_id, segment_id, truth from pr) e full join (select distinct call_id, segment_id, predicted from pr) d on e.call_id = d.call_id and e.segment_id = d.segment_id and e.truth = d.predicted),
    s as (select kind, sum(e * d) as tp, sum(e) as support, sum(d) as found from j group by kind union all select 'micro', sum(e * d), sum(e), sum(d) from j), q as (select kind, support::bigint as support, coalesce(tp / nullif(found, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as r from s)
    select kind, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, support from q""", "segments")
def ev01(c: Corpus) -> DataFrame:
    """Precision and recall."""
    p = predicted(c)
    return m.precision_recall(p.select("call_id", "segment_id", F.col("truth").alias("intent")), p.select("call_id", "segment_id", F.col("predicted").alias("intent")), ["call_id", "segment_id"], "intent")


@query("ev05_confusion", f"with {PREDICTED} select predicted, truth, count(*) as n, predicted = truth as \"right\" from pr group by all", "segments")
def ev05(c: Corpus) -> DataFrame:
    """Confusion of intents."""
    return m.confusion(predicted(c))


@query("ev09_accuracy", f"""with {PREDICTED}, l as (select distinct unnest([truth, predicted]) as label from pr), t as (select truth as label, count(*) as support, count(*) filter (truth = predicted) as tp from pr group by truth), f as (select predicted as label, count(*) as found from pr group by predicted),
    x as (select label, coalesce(support, 0) as support, coalesce(tp, 0) as tp, coalesce(found, 0) as found from l left join t using (label) left join f using (label))
    select round(sum(tp) / sum(support), 6) as accuracy, round(sum(coalesce(2 * tp / nullif(support + found, 0), 0) * support) / sum(support), 6) as weighted_f1, sum(support)::bigint as n from x""", "segments")
def ev09(c: Corpus) -> DataFrame:
    """Accuracy and weighted F1."""
    return m.accuracy(predicted(c))


@query("ev07_gate_cost", f"with {INTENTS} select intent as kind, count(*) as n, count(*) filter (not regexp_matches(text, '(?i)\\b(?:pay|loan|otp)\\b')) as lost, round(avg(regexp_matches(text, '(?i)\\b(?:pay|loan|otp)\\b')::int), 6) as kept_share from intents i join segments s on s.call_id = i.call_id and s.segment_id = i.segment_id where intent <> 'unknown' group by intent", "segments")
def ev07(c: Corpus) -> DataFrame:
    """Cost of a gate."""
    s = c.spoken()
    rows = understanding.keyword_intents(s).join(s.select("call_id", "segment_id", F.col("text").rlike(r"(?i)\b(?:pay|loan|otp)\b").alias("admitted")), ["call_id", "segment_id"])
    return m.gate_cost(rows.select(F.when(F.col("intent") != "unknown", F.col("intent")).alias("kind"), "admitted"))


@query("ev08_latency", "select event_type as stage, count(*) as n, min(value) as least, round(median(value), 6) as middle, max(value) as most from events group by event_type")
def ev08(c: Corpus) -> DataFrame:
    """Times of stages."""
    return m.latency(c.table("events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@query("ev06_correction_recall", """with f as (select text as raw, regexp_replace(text, '\\bkayak\\b', 'KYC', 'g') as expected, regexp_replace(regexp_replace(text, '\\bkayak form\\b', 'KYC form', 'gi'), '\\bpan\\b', 'PAN', 'g') as fixed from segments)
    select count(*) filter (raw <> expected) as needed, count(*) filter (raw <> expected and fixed = expected) as done, count(*) filter (raw = expected and fixed <> raw) as collateral from f""", "segments")
def ev06(c: Corpus) -> DataFrame:
    """What corrections do."""
    fixed = transcript.correct_terms(c.segments(), transcript.TERMS[:2])
    return m.correction_recall(fixed.select(F.coalesce("original_text", "text").alias("raw"), F.regexp_replace(F.coalesce("original_text", "text"), r"\bkayak\b", "KYC").alias("expected"), F.col("text").alias("fixed")))

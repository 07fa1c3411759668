"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, langid, licenses, merkle, minhash, packing, repair, rlz, suffix_dedup, token_store, topk, webp
from .common import read_table

TOKENIZER = "byte_bpe_50k.json"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a repeated string of 400."""
    found = suffix_dedup.remove_repeats(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a passage of 50 that an earlier document has."""
    found = rlz.parse(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").alias("n_factors"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: five-word shingles, similarity of 0.75 or more."""
    return minhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    network = html_extract.train(html_extract.training_pages())
    return html_extract.extract(read_table(spark, sf_dir, "pages"), network)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, by way of sorted-string-table shards."""
    return token_store.token_table(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 1, 2048)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item: 75 of 100 of its five-word shingles or more."""
    return decontam.containments(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a lossless WebP file, read back."""
    return webp.payloads(webp.media(read_table(spark, sf_dir, "documents")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_matches", F.array_join("licenses", ",").alias("licenses"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the edits that repair it."""
    return repair.repaired(read_table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that each gives after tampering."""
    return merkle.manifest(spark, read_table(spark, sf_dir, "documents"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id 50 divides."""
    return topk.nearest(spark, read_table(spark, sf_dir, "embeddings"))


def _nearest_sql() -> str:
    return """
    with e as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
               where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from e q join e c on q.r <> c.r where q.vec_id % 50 = 0),
    k as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
    select query_id, rank::int as rank, vec_id, score from k where rank <= 5
    """


def _manifest_sql() -> str:
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, x: xor(c // 256, ({table})[xor(c, x) % 256 + 1]), 4294967295), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    with recursive d as (select doc_id, coalesce(':' || lang, '') as k, {leaf("text")} as leaf, case when {crc} % 3 = 0 then {leaf(lower)} else {leaf("text")} end as changed from documents),
    l as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by k) as n from d),
    up(k, h, i, x, n) as (
        select k, 0, r, leaf, n from l
        union all select k, h + 1, i // 8, sha256(string_agg(x, '' order by i)), any_value((n + 7) // 8) from up where n > 1 group by k, h, i // 8),
    subs as (select k, h, x as subroot, row_number() over (order by k) - 1 as r, count(*) over () as n from up where n = 1),
    over(h, i, x, n) as (
        select 0, r, subroot, n from subs
        union all select h + 1, i // 8, sha256(string_agg(x, '' order by i)), any_value((n + 7) // 8) from over where n > 1 group by h, i // 8),
    both_trees as (select k, h, i, x from up where n > 1 union all select k, s.h + o.h, i, x from subs s, over o where o.n > 1),
    sides as (select a.k, a.h, a.i, coalesce(string_agg(b.x, '' order by b.i) filter (b.i < a.i), '') as before, coalesce(string_agg(b.x, '' order by b.i) filter (b.i > a.i), '') as after
        from both_trees a join both_trees b on a.k = b.k and a.h = b.h and a.i // 8 = b.i // 8 group by a.k, a.h, a.i),
    tall as (select max(h) as t from over),
    climb(k, doc, r, h, i, x, p) as (
        select k, doc_id, l.r, 0, l.r, changed, '' from l
        union all select c.k, c.doc, c.r, c.h + 1, case when c.h + 1 = s.h then s.r else case when c.h = s.h and s.h = 0 then s.r else c.i end // 8 end,
            case when v.k is null then c.x else sha256(v.before || c.x || v.after) end, c.p || coalesce(v.before || v.after, '')
            from climb c join subs s on s.k = c.k left join sides v on v.k = c.k and v.h = c.h and v.i = case when c.h = s.h then s.r else c.i end, tall where c.h < s.h + tall.t)
    select doc_id, leaf, subroot, o.x as root, sha256(p) as proof_sha256, c.x as folded_root, c.x = o.x as verified
    from l join subs s using (k) join climb c on c.k = l.k and c.r = l.r, tall, (select x from over where n = 1) o where c.h = s.h + tall.t
    """


def _licenses_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in licenses.TEMPLATES.items() for text in texts)
    names, negated = ", ".join(f"'{x}'" for x in licenses.TEMPLATES), ", ".join(f"'{a} {b}'" for a, b in licenses.NEGATED)
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
    with t as (select row_number() over () as t, name, len(w) as long, {pairs.format("w")} as b
               from (select name, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+') as w from (values {rows}) v(name, txt))),
    tb as (select t, name, len(b) as m, unnest(b) as g from t),
    d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    blocks as (
        select r, unnest(string_split(text, chr(10))) as block from d
        union all
        select r, block from (select r, unnest(regexp_split_to_array(text, '\\n[^\\S\\n]*\\n')) as block from d) where contains(trim(block, chr(10)), chr(10))),
    words as (select row_number() over () as k, r, regexp_extract_all(lower(block), '[\\p{{L}}\\p{{N}}]+') as w from blocks),
    pairs as (select k, r, {pairs.format("w")} as b from words where len(w) > 1 and not list_has_any({pairs.format("w")}, [{negated}])),
    grams as (select k, r, len(b) as n, unnest(b) as g from pairs),
    hits as (select k, r, name, 2.0 * count(*) / (n + m) as dice from grams join tb using (g)
             group by k, r, n, t, name, m having 2 * count(*) >= {licenses.THRESHOLD} * (n + m)),
    whole as (select r, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from d),
    runs as (select r, len(w) as long, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as s from whole where len(w) > 1),
    likely as (select r, t, count(*) as c from (select distinct r, unnest(s) as g from runs) join tb using (g) group by r, t, m having 200 * count(*) >= {licenses.WITHIN} * (count(*) + m)),
    placed as (select r, t, name, b, t.long, s, unnest(range(1, runs.long - t.long + 2)) as p from likely join runs using (r) join t using (t) where t.long <= runs.long),
    compared as (select r, t, name, long, p, len(b) as m, len(list_distinct(s[p:p + long - 2])) as n, len(list_intersect(list_distinct(s[p:p + long - 2]), b)) as c from placed where not list_has_any(s[greatest(p - 1, 1):p + long - 2], [{negated}])),
    inside as (select * from compared where 200 * c >= {licenses.WITHIN} * (n + m)),
    alone as (select r, name, 2.0 * c / (n + m) as dice from inside x where not exists (
        select 1 from inside y where y.r = x.r and y.name <> x.name and y.c > x.c and x.p + x.long // 2 >= y.p and x.p + x.long // 2 < y.p + y.long)),
    tags as (select r, unnest(regexp_extract_all(text, '{licenses.TAG}', 1)) as line from d),
    tagged as (select r, unnest(list_transform(regexp_extract_all(lower(line), '{licenses.NAME}'), lambda x: regexp_replace(x, '{licenses.LATER}', ''))) as name from tags),
    best as (select r, name, max(dice) as dice from (select r, name, dice from hits union all select * from alone union all select r, name, 1.0 from tagged where name in ({names})) group by r, name),
    per as (select r, arg_min(name, (-dice, name)) as license, max(dice) as dice, string_agg(name, ',' order by name) as licenses from best group by r),
    counts as (select r, count(distinct k) as n from hits group by r)
    select doc_id, license, round(dice, 6) as dice, coalesce(n, 0) as n_matches, coalesce(licenses, '') as licenses
    from d left join per using (r) left join counts using (r)
    """


def _containments_sql() -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    runs = "unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) as s"
    return f"""
    with items as (select row_number() over () as key, item_id, w, least(len(w), {decontam.SHINGLE}) as width from (select item_id, {words} as w from (select distinct item_id, text from benchmark)) where len(w) > 0),
    docs as (select row_number() over () as rid, doc_id, {words} as w from documents where doc_id is not null),
    item_runs as (select distinct key, width, {runs} from items),
    doc_runs as (select distinct rid, width, {runs} from docs, (select distinct width from items) where len(w) >= width),
    sizes as (select key, count(*) as n from item_runs group by key),
    hits as (select rid, key, count(*) as found from doc_runs join item_runs using (width, s) group by rid, key),
    best as (select doc_id, item_id, max({{'c': found / n, 'f': found, 'n': n}}) as m from hits join sizes using (key) join items using (key) join docs using (rid) where 100 * found >= 75 * n group by doc_id, item_id)
    select doc_id, item_id, m.f as n_found, m.n as n_shingles, round(m.f / m.n, 6) as containment from best
    """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (op1_language, op2_suffix_dedup, op3_near_duplicates, op4_html_text, op5_tokens, op6_packing, op7_decontamination, op8_media, op9_substring_dedup, op10_licenses, op11_repair, op12_merkle, op13_nearest)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"op7_decontamination": _containments_sql(), "op10_licenses": _licenses_sql(), "op12_merkle": _manifest_sql(), "op13_nearest": _nearest_sql()}

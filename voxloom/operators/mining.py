"""Phrase mining over labelled corpora, preparation of training sets, and evaluation."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, word_count
from ..sources.shared import written
from .ranking import ranked


def _runs(k: int) -> Column:
    """The runs of k words of the array w, as texts."""
    places = F.sequence(F.lit(1), F.size("w") - (k - 1))
    return F.when(F.size("w") >= k, F.transform(places, lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>"))


def _extended(k: int) -> Column:
    """Of each run of k words of w the run without its last word, that without its first, and the last word."""
    places = F.sequence(F.lit(1), F.size("w") - (k - 1))
    return F.transform(places, lambda i: F.struct(F.array_join(F.slice("w", i, k - 1), " ").alias("first"), F.array_join(F.slice("w", i + 1, k - 1), " ").alias("last"), F.element_at("w", i + (k - 1)).alias("word")))


def ngram_counts(docs: DataFrame, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """How often each run of 3 to 5 words occurs in the texts of each label, and in how many: label, gram, n, docs.

    Runs that begin at one word lie in the longest of them, so only that one is
    shuffled, once, by its first words (as many as the shortest run has); all runs
    that begin with these are then counted where they are. A row moves for each
    word of the texts, and what all texts share begins in one task.
    """
    least, most = min(sizes), max(sizes)
    words = docs.select("doc_id", "label", tokens(F.col("text")).alias("w")).where(F.size("w") >= least)
    begun = F.transform(F.sequence(F.lit(1), F.size("w") - (least - 1)), lambda i: F.array_join(F.slice("w", i, most), " "))
    head = F.substring_index("run", " ", least)
    runs = words.select("doc_id", "label", F.explode(begun).alias("run")).repartition("label", head)
    spaces = F.length("run") - F.length(F.replace("run", F.lit(" "), F.lit("")))
    grams = [F.when(spaces >= k - 1, F.substring_index("run", " ", k)) for k in sizes]
    each = runs.select("doc_id", "label", head.alias("head"), F.explode(F.array_compact(F.array(*grams))).alias("gram"))
    per_doc = each.groupBy("label", "head", "gram", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("label", "head", "gram").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).drop("head")


def frequent_grams(texts: DataFrame, least: int, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Runs of words that occur ``least`` times or more over all texts (column text): gram, n.

    Level by level, from single words on: a run is counted only where both runs
    that are a word shorter are frequent, so that what is shuffled are runs made
    of frequent ones, first added up in their tasks. At most words / ``least`` runs
    of a size are frequent; Catalyst sends them to all tasks where the written
    table is small, and joins by key else. ``least`` of 1 or less finds all runs.
    Texts without words, or none at all, have no runs.
    """
    if any(k < 1 for k in sizes):
        raise ValueError("sizes must be 1 or more")
    words, below, found = texts.select(tokens(F.col("text")).alias("w")), None, []
    for k in range(1, max(sizes) + 1):
        if below is None:
            runs = words.select(F.explode("w").alias("gram"))
        else:
            runs = words.where(F.size("w") >= k).select(F.inline(_extended(k)))
            for side in ("first", "last"):
                runs = runs.join(below.select(F.col("gram").alias(side)), side, "left_semi")
            runs = runs.select(F.concat("first", F.lit(" "), "word").alias("gram"))
        below = written(runs.where("gram <> ''").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least), "grams")
        if k in sizes:
            found.append(below)
    return reduce(DataFrame.union, found)


def overrepresented(docs: DataFrame, positive: int, most: int = 5000, ratio: float = 2.0, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Grams more frequent per text under one label than under others (docs: label, text): gram, a, b, ratio.

    Of the label's ``most`` frequent ones, ties in order of gram, those with a of
    max(3, texts / 100) or more and ``ratio`` times the rate of the others, which
    counts as 0.0001 at least. Only grams that reach the first bound are counted,
    and only the ``most`` of them among other texts. Texts without label count
    nowhere; without texts of the label nothing is found.
    """
    own = F.col("label") == positive
    texts, others = docs.agg(F.count_if(own), F.count_if(~own)).first()
    least = max(3, texts // 100)
    top = written(frequent_grams(docs.where(own), least, sizes).withColumnRenamed("n", "a").orderBy(F.desc("a"), "gram").limit(most), "top")
    words = docs.where(~own).select(tokens(F.col("text")).alias("w"))
    other = words.select(F.explode(F.concat(*[_runs(k) for k in sizes])).alias("gram")).join(top.select("gram"), "gram").groupBy("gram").agg(F.count("*").alias("b"))
    joined = top.join(other, "gram", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    rate = (F.col("a") / max(texts, 1)) / F.greatest(F.col("b") / max(others, 1), F.lit(0.0001))
    return joined.where(rate >= ratio).select("gram", "a", "b", F.round(rate, 6).alias("ratio"))


def assign_category(phrases: DataFrame, categories: list[tuple[str, list[str]]], mode: str = "token") -> DataFrame:
    """The first category with a keyword of a phrase: among its words, or with mode ``substring`` anywhere in it."""
    words = F.split("gram", " ")
    chosen = F.when(F.lit(False), "")
    for name, keywords in categories:
        holds = F.arrays_overlap(words, F.array(*map(F.lit, keywords))) if mode == "token" else F.exists(F.array(*map(F.lit, keywords)), lambda k: F.col("gram").contains(k))
        chosen = chosen.when(holds, name)
    return phrases.withColumn("category", chosen.otherwise("other"))


def short_utterances(turns: DataFrame, most_words: int, least: int, excluded: list[str]) -> DataFrame:
    """Short texts that occur often, without domain terms."""
    plain = F.lower(F.btrim("text"))
    kept = turns.where((word_count(F.col("text")) <= most_words) & (plain != "")).select(plain.alias("phrase"), tokens(F.col("text")).alias("w"))
    return kept.where(~F.arrays_overlap("w", F.array(*map(F.lit, excluded)))).groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def term_frequency(texts: DataFrame, pattern: str, most: int, least: int) -> DataFrame:
    """The most frequent matches of a pattern, ignoring case, with a count of ``least`` or more."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0)).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most)


def script_words(texts: DataFrame, low: str, high: str) -> DataFrame:
    """Words of texts with a character in a range, and in how many texts they are."""
    pattern = f"[\\x{{{low}}}-\\x{{{high}}}]"
    words = texts.where(F.col("text").rlike(pattern)).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).where(F.col("word").rlike(pattern))
    return words.groupBy("word").agg(F.count("*").alias("docs"))


def merge_phrases(*lists: DataFrame) -> DataFrame:
    """Lists of phrases as one, without repeats, in order."""
    out = lists[0].select("phrase")
    for more in lists[1:]:
        out = out.union(more.select("phrase"))
    return out.distinct().orderBy("phrase")


#: Words of either side that are compared as a whole: its square bounds time, and a bit of it each memory.
ALIGNED = 4096


def _anchors(a: list[str], b: list[str], where: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Words that stand once in both ranges, the longest series of them that is in order in both."""
    low, high, left, right = where
    times_a, times_b = Counter(a[low:high]), Counter(b[left:right])
    place = {w: j for j, w in enumerate(b[left:right], left) if times_b[w] == 1 and times_a.get(w) == 1}
    tops: list[int] = []
    last: list[tuple[int, int, tuple | None]] = []  # the series that ends at each top, as linked cells
    for i in range(low, high):
        if (j := place.get(a[i])) is not None:
            k = bisect_left(tops, j)
            cell = (i, j, last[k - 1] if k else None)
            tops[k : k + 1], last[k : k + 1] = [j], [cell]
    out, cell = [], last[-1] if last else None
    while cell:
        out.append(cell[:2])
        cell = cell[2]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence: a row of bits for each word of b, of which those that are 0 count what matches."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows, v = [], full
    for w in b:
        u = v & places.get(w, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    out, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i - 1, j - 1
        elif rows[j] >> i & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal words, in order in both texts.

    Common ends are taken first, then words that stand once in both texts; what
    lies between is treated likewise and, where it has no such words, compared
    for a longest common subsequence. Ranges of over ALIGNED words without such
    words are cut into as many parts on both sides, so that time and memory stay
    in proportion to the texts.
    """
    out, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        low, high, left, right = waiting.pop()
        while low < high and left < right and a[low] == b[left]:
            out.append((low, left))
            low, left = low + 1, left + 1
        while low < high and left < right and a[high - 1] == b[right - 1]:
            high, right = high - 1, right - 1
            out.append((high, right))
        if low == high or left == right:
            continue
        found = _anchors(a, b, (low, high, left, right))
        if found:
            out += found
            edges = [(low - 1, left - 1), *found, (high, right)]
            waiting += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
        elif max(high - low, right - left) <= ALIGNED:
            out += [(low + i, left + j) for i, j in _common(a[low:high], b[left:right])]
        else:
            parts = -(-max(high - low, right - left) // ALIGNED)
            cut = lambda x, y, k: x + (y - x) * k // parts  # noqa: E731, B023
            waiting += [(cut(low, high, k), cut(low, high, k + 1), cut(left, right, k), cut(left, right, k + 1)) for k in range(parts)]
    return sorted(out)


def replaced_words(heard: str | None, truth: str | None) -> Iterator[tuple[str, str]]:
    """Runs of words that differ when both texts are aligned, where either side has some."""
    a, b = (heard or "").split(), (truth or "").split()
    i = j = 0
    for k, m in [*aligned(a, b), (len(a), len(b))]:
        if i < k and j < m:
            yield " ".join(a[i:k]), " ".join(b[j:m])
        i, j = k + 1, m + 1


class AlignWords:
    """``replaced_words`` as a table function."""

    def eval(self, heard: str, truth: str) -> Iterator[tuple[str, str]]:
        """Rows for one pair of texts."""
        yield from replaced_words(heard, truth)


def align_words(pairs: DataFrame) -> DataFrame:
    """Words that were heard (column heard) for others (column truth), by aligning both transcripts: id, heard_words, true_words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, *found) for key, heard, truth in frame[["id", "heard", "truth"]].itertuples(index=False) for found in replaced_words(heard, truth)]
            yield pd.DataFrame(rows, columns=["id", "heard_words", "true_words"])

    return pairs.select("id", "heard", "truth").mapInPandas(run, "id long, heard_words string, true_words string")


def discover_corrections(pairs: DataFrame, domain: list[str], least: int = 2, most: int = 200, similarity: float = 0.8) -> DataFrame:
    """Word pairs heard often: those of domain terms, and of others the most frequent with three letters or more that differ enough."""
    counts = pairs.groupBy("heard_words", "true_words").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    known = F.lower("true_words").isin(*domain)
    alike = 1 - F.levenshtein("heard_words", "true_words") / F.greatest(F.length("heard_words"), F.length("true_words"))
    rest = counts.where(~known & (F.length("heard_words") >= 3) & (alike < similarity)).orderBy(F.desc("n"), "heard_words", "true_words").limit(most)
    return counts.where(known).withColumn("domain", F.lit(True)).unionByName(rest.withColumn("domain", F.lit(False)))


def harmonize(samples: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples (corpus, label, text) with labels mapped (corpus, label, target), and the labels that have no target, counted."""
    known = F.broadcast(mapping)
    mapped = samples.join(known, ["corpus", "label"]).select("corpus", F.col("target").alias("label"), "text")
    return mapped, samples.join(known, ["corpus", "label"], "left_anti").groupBy("corpus", "label").agg(F.count("*").alias("n"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.15) -> DataFrame:
    """A reproducible split: in each stratum the share of smallest md5 of the key is held out.

    Rows of one key stand together: the place of the first of them counts, as in
    ``percent_rank``. Strata are ranked over many tasks, however large they are.
    """
    keys = rows.select(F.col(label).alias("stratum"), F.md5(F.col(key).cast("string")).alias("digest"))
    first = ranked(keys, ["stratum"], ["digest"]).groupBy("stratum", "digest").agg(F.min("rank").alias("rank"), F.min("total").alias("total"))
    out = F.when(F.col("total") == 1, F.lit(True)).otherwise(F.col("rank") / (F.col("total") - 1) <= share)
    same = F.col(f"`{label}`").eqNullSafe(F.col("stratum")) & F.md5(F.col(f"`{key}`").cast("string")).eqNullSafe(F.col("digest"))
    return rows.join(first.select("stratum", "digest", out.alias("held_out")), same).drop("stratum", "digest")


def sentences(token_rows: DataFrame) -> DataFrame:
    """Sentences from rows of tokens (doc, sent, pos, token), null ones left out."""
    kept = token_rows.where(F.col("token").isNotNull())
    return kept.groupBy("doc", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("sentence"))


def precision_recall(expected: DataFrame, detected: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Precision, recall, F1 and support per type and over all ("micro"); 0 where there is nothing to divide by."""
    e, d = expected.select(*key, kind).distinct().withColumn("e", F.lit(1)), detected.select(*key, kind).distinct().withColumn("d", F.lit(1))
    joined = e.join(d, [*key, kind], "full").select(kind, F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("d", F.lit(0)).alias("d"))
    sums = joined.rollup(kind).agg(F.sum(F.col("e") * F.col("d")).alias("tp"), F.sum("e").alias("support"), F.sum("d").alias("found"), F.grouping(kind).alias("all"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, q = ratio(F.col("tp"), F.col("found")), ratio(F.col("tp"), F.col("support"))
    f1 = F.coalesce(2 * p * q / F.nullif(p + q, F.lit(0.0)), F.lit(0.0))
    return sums.select(F.when(F.col("all") == 1, "micro").otherwise(F.col(kind)).alias("kind"), F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of predicted and true labels, and whether they agree."""
    return rows.groupBy("predicted", "truth").agg(F.count("*").alias("n")).withColumn("right", F.col("predicted") == F.col("truth"))


def accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy, and F1 weighted by support; labels that are null count for nothing."""
    sides = [F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.when(F.col("right"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("found"))]
    sides.append(F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("found")))
    per = confusion(rows).select(F.inline(F.array(*sides))).where("label is not null").groupBy("label").agg(*[F.sum(x).alias(x) for x in ("support", "tp", "found")])
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("support") + F.col("found"), F.lit(0)), F.lit(0.0))
    return per.agg(F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"), F.sum("support").alias("n"))


def gate_cost(rows: DataFrame) -> DataFrame:
    """What a gate (admitted) lets through, and how many signals (kind, null for none) it loses, per kind and over all."""
    return rows.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~F.col("admitted")).alias("lost"), F.round(F.avg(F.col("admitted").cast("double")), 6).alias("kept_share"))


def latency(rows: DataFrame) -> DataFrame:
    """Per stage (stage, seconds): runs, least, median and greatest seconds."""
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.min("seconds").alias("least"), F.round(F.median("seconds"), 6).alias("middle"), F.max("seconds").alias("most"))


def correction_recall(rows: DataFrame) -> DataFrame:
    """Of cases (raw, expected, fixed): needed and done corrections, and texts changed without need."""
    need = F.col("raw") != F.col("expected")
    return rows.agg(F.count_if(need).alias("needed"), F.count_if(need & (F.col("fixed") == F.col("expected"))).alias("done"), F.count_if(~need & (F.col("fixed") != F.col("raw"))).alias("collateral"))

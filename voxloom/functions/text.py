"""Column functions over text in any script, and joins with phrase lists."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that are no part of a word's spelling: joiners, soft hyphens, byte order marks.
UNSEEN = "­​‌‍⁠﻿"
#: Blocks whose letters are brought to one form: accented Latin, and the scripts of India.
COMPOSED_BLOCKS = ((0x00C0, 0x0180), (0x0900, 0x0E00))


def _forms() -> list[tuple[str, str]]:
    """Spellings of one letter that differ from its canonical composition, longer ones first."""
    pairs = set()
    for low, high in COMPOSED_BLOCKS:
        for c in map(chr, range(low, high)):
            whole, parts = unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c)
            pairs |= {(x, whole) for x in (c, parts) if x != whole}
    return sorted(pairs, key=lambda p: (-len(p[0]), p))


FORMS = _forms()


def _class(characters: set[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(characters)) + "]"


#: Whatever differs holds a combining mark or a letter of India; that is cheap to rule out.
_MAY_DIFFER = r"[\x{300}-\x{36f}\x{900}-\x{dff}]"
#: Only texts with such a character or pair of characters hold another form.
_DIFFERS = "|".join([_class({x for x, _ in FORMS if len(x) == 1}), _class({x[0] for x, _ in FORMS if len(x) > 1}) + _class({x[1] for x, _ in FORMS if len(x) > 1})])


def composed(text: Column) -> Column:
    """Letters of COMPOSED_BLOCKS in canonical composition; texts without another form are left alone."""
    pairs = F.split(F.lit(" ".join(f"{a}>{b}" for a, b in FORMS)), " ")  # one literal: the plan stays small
    part = lambda p, k: F.split_part(p, F.lit(">"), F.lit(k))
    return F.when(text.rlike(_MAY_DIFFER) & text.rlike(_DIFFERS), F.aggregate(pairs, text, lambda t, p: F.replace(t, part(p, 1), part(p, 2)))).otherwise(text)


def normal(text: Column) -> Column:
    """Lower case, with one space for whatever isn't a letter, mark or digit of some script, and no space at the ends."""
    given = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(F.lower(composed(F.translate(given, UNSEEN, ""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    ascii_only = F.octet_length(given) == F.char_length(given)  # nothing to compose or to leave out, and a plainer pattern
    return F.btrim(F.when(ascii_only, F.regexp_replace(F.lower(given), "[^a-z0-9]+", " ")).otherwise(plain))


def tokens(text: Column) -> Column:
    """The words of ``normal(text)``; none for empty text."""
    return F.filter(F.split(normal(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for empty or null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


#: First words of phrases that may be part of a plan; of more, each word of a text goes into the join.
FEW = 1000


def _known(phrases: DataFrame) -> DataFrame:
    """Phrases that have words, with their first word, their words between spaces, and how many these are."""
    known = phrases.select(normal(F.col("phrase")).alias("_gram"), *phrases.columns).where("_gram <> ''")
    return known.select(*phrases.columns, F.split_part("_gram", F.lit(" "), F.lit(1)).alias("_word"), F.concat(F.lit(" "), "_gram", F.lit(" ")).alias("_gram"), F.size(F.split("_gram", " ")).alias("_length"))


def _first_words(words: Column, known: DataFrame) -> Column:
    """Of an array of words those that begin a phrase, where there are few: a filter only, the join with the phrases decides."""
    first = [r[0] for r in known.select("_word").distinct().limit(FEW + 1).collect()]
    return F.filter(words, lambda w: w.isin(first)) if len(first) <= FEW else words


def phrase_hits(segments: DataFrame, phrases: DataFrame, streams: tuple[str, ...] = ()) -> DataFrame:
    """A row for each segment and phrase that begins in it as whole words; the phrase may end in later segments of the call.

    ``streams`` names boolean columns, each for a part of the call that is read by
    itself, as if the segments where it is true followed one another; in the
    result they say in which parts the phrase begins here. Without streams the
    whole call is read. Segments without words stand in nobody's way.

    The distinct words of a segment are joined with the first words of the
    phrases by equality, so the list may be long; what is left is looked up in
    the segment's words and as many of those that follow as the longest phrase
    has. The text itself isn't returned. Catalyst sends the list to all executors if it is small enough, and
    shuffles both sides else.
    """
    known = _known(phrases)
    longest = known.agg(F.max("_length")).first()[0] or 1
    known = known.withColumn("_long", F.col("_length") > 1).drop("_length")
    said = segments.withColumn("_said", F.concat(F.lit(" "), normal(F.col("text")), F.lit(" ")))
    parts = streams or ("_all",)
    if not streams:
        said = said.withColumn("_all", F.lit(True))
    then = {part: F.lit("") for part in parts}
    if longest > 1:
        some = F.col("_said") != "  "
        said = said.withColumn("_starts", F.when(some, F.concat(F.substring_index(F.btrim("_said"), " ", longest - 1), F.lit(" "))))
        for part in parts:
            later = Window.partitionBy("call_id", F.col(part) & some).orderBy("segment_id")
            said = said.withColumn(f"_then_{part}", F.concat_ws("", *[F.lead("_starts", k).over(later) for k in range(1, longest)]))
            then[part] = F.col(f"_then_{part}")
    kept = said.drop("text", "_starts") if "text" in segments.columns else said
    words = _first_words(F.array_distinct(F.split(F.btrim("_said"), " ")), known)
    found = kept.withColumn("_word", F.explode(words)).join(known, "_word").withColumn("_inside", F.contains("_said", "_gram"))
    begins = lambda part: F.call_function("instr", F.concat("_said", then[part]), F.col("_gram")).between(1, F.length("_said") - 1)
    found = found.withColumns({part: F.coalesce(F.col(part) & (F.col("_inside") | (F.col("_long") & begins(part))), F.lit(False)) for part in parts})
    anywhere = F.greatest(*[F.col(part) for part in parts]) if len(parts) > 1 else F.col(parts[0])
    return found.where(anywhere).drop("_word", "_said", "_gram", "_long", "_inside", "_all", *[f"_then_{part}" for part in parts])


def first_places(segments: DataFrame, phrases: DataFrame, streams: tuple[str, ...], **facts: Column) -> DataFrame:
    """A row for each call: call_id, the aggregates ``facts`` of its segments, and ``said``.

    The column ``part`` of a phrase names the stream that it is looked for in.
    Streams are boolean columns, read as by ``phrase_hits``. ``said`` has a struct
    for each phrase found: its columns, and ``segment``, the ``segment_id`` where
    it first begins.

    Each stream becomes one text, and a running sum of lengths leads from a place
    in it to the segment, so a call is sorted once for all of them; phrases are
    joined once a call, by the distinct words of the call and their first words.
    """
    known = _known(phrases).drop("_length")
    said = segments.withColumn("_said", normal(F.col("text"))).drop("text")
    before = Window.partitionBy("call_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = {s: F.sum(F.when(F.col(s) & (F.col("_said") != ""), F.length("_said") + 1)).over(before).alias(f"_end_{s}") for s in streams}
    lines = F.array_sort(F.collect_list(F.struct("segment_id", *[f"_end_{s}" for s in streams], *streams, "_said")))
    calls = said.select("*", *ends.values()).groupBy("call_id").agg(lines.alias("_lines"), *[fact.alias(name) for name, fact in facts.items()])

    def text(part: Callable[[Column], Column]) -> Column:
        return F.concat(F.lit(" "), F.array_join(F.transform(F.filter("_lines", lambda x: part(x) & (x["_said"] != "")), lambda x: x["_said"]), " "), F.lit(" "))

    def by_part(of: Callable[[str], Column]) -> Column:
        return reduce(lambda rest, s: F.when(F.col("part") == s, of(s)).otherwise(rest), streams, F.lit(None))

    words = F.array_distinct(F.split(F.btrim(text(lambda x: F.lit(True))), " "))
    texts = calls.withColumns({f"_text_{s}": text(lambda x, s=s: x[s]) for s in streams} | {"_words": _first_words(words, known)})
    joined = texts.withColumn("_word", F.explode_outer("_words")).join(known, "_word", "left").withColumn("_text", by_part(lambda s: F.col(f"_text_{s}")))
    placed = joined.withColumn("_at", F.when(F.contains("_text", "_gram"), F.instr("_text", F.col("_gram"))))  # contains is the faster, and mostly false
    segment = F.get(by_part(lambda s: F.filter("_lines", lambda x: x[f"_end_{s}"] >= F.col("_at"))), F.lit(0))["segment_id"]
    found = placed.select("call_id", *facts, F.when(F.col("_at") > 0, F.struct(*phrases.columns, segment.alias("segment"))).alias("_found"))
    return found.groupBy("call_id").agg(*[F.first(name).alias(name) for name in facts], F.collect_list("_found").alias("said"))

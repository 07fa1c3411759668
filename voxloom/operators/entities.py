"""Financial entities in text: amounts, dates, identifiers, terms; their merging and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .transcript import MAGNITUDES

MAGNITUDE = "hundred|thousand|lakh|million|crore|billion"
# Fixed values: (entity type, confidence, pattern); the order is that of extraction.
CURRENCY = r"(?i)(?:\$|₹|€|\bINR|\bUSD|\bEUR|\brs\.?)\s?\d+(?:,\d{2,3})*(?:\.\d+)?(?:\s(?:hundred|thousand|lakh|million|crore|billion)\b)?"
WORDED = r"(?i)\b\d+(?:,\d{2,3})*(?:\.\d+)?\s(?:(?:hundred|thousand|lakh|million|crore|billion)\s)?(?:rupees?|dollars?|euros?)\b"
PATTERNS = [
    ("date", 0.90, r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"),
    ("date", 0.90, r"(?i)\b(?:next|this)\s(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month)\b"),
    ("date", 0.90, r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}\b(?:,?\s*\d{4}\b)?"),
    ("date", 0.90, r"(?i)\b(?:by\s+)?(?:today|tomorrow|yesterday|end of month|month end)\b"),
    ("date", 0.90, r"(?i)\bby\s(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"),
    ("account_number", 0.90, r"\b\d{10,16}\b"),
    ("tax_id", 0.90, r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("branch_code", 0.90, r"\b[A-Z]{4}0\d{6}\b"),
    ("reference", 0.90, r"(?i)\breference\s[A-Z]{2}\d{4,8}[A-Z]?\b"),
    ("interest_rate", 0.85, r"(?i)\binterest rate is \d+(?:\.\d+)?\s?(?:percent|%)"),
    ("tenure", 0.85, r"(?i)\b\d+\s(?:months?|years?)\stenure\b"),
    ("instalment", 0.85, r"(?i)\bEMI of \d+\b"),
]
SUMMABLE = ("currency_amount", "payment", "instalment", "loan", "penalty", "outstanding", "late_fee")
GROUPS = {"currency_amount": "Amounts", "instalment": "Amounts", "date": "Dates", "account_number": "Identifiers", "tax_id": "Identifiers", "branch_code": "Identifiers", "reference": "Identifiers", "interest_rate": "Terms", "tenure": "Terms"}

# Number words, English and romanized Hindi.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "ek": 1, "teen": 3, "chaar": 4, "paanch": 5, "das": 10, "bees": 20, "pachas": 50,
}
SCALE_WORDS = {"hundred": 100, "sau": 100, "thousand": 1_000, "hazaar": 1_000, "hazar": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


AMOUNT_PATTERNS = [("currency_amount", 0.95, CURRENCY), ("currency_amount", 0.95, WORDED)]


def mentions(segments: DataFrame, patterns: list[tuple[str, float, str]], first_layer: int = 0) -> DataFrame:
    """A row for each match of each pattern: call_id, segment_id, entity_type, ord, mention, confidence, layer (the pattern's place).

    All patterns are matched in one pass over the text.
    """
    each = [F.struct(F.lit(kind).alias("entity_type"), F.lit(sure).alias("confidence"), F.lit(first_layer + k).alias("layer"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("m")) for k, (kind, sure, pattern) in enumerate(patterns)]
    found = segments.select("call_id", "segment_id", F.inline(F.filter(F.array(*each), lambda x: F.size(x["m"]) > 0)))
    return found.select("call_id", "segment_id", "entity_type", F.posexplode("m").alias("ord", "mention"), "confidence", "layer")


def _with_amounts(found: DataFrame, only: Column | None = None) -> DataFrame:
    """Adds amount and currency, where ``only`` holds."""
    number = F.regexp_replace(F.regexp_extract("mention", r"\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("double")
    factor = F.coalesce(_map(MAGNITUDES)[F.lower(F.regexp_extract("mention", f"(?i)({MAGNITUDE})", 1))], F.lit(1))
    low = F.lower("mention")
    currency = F.when(low.rlike(r"\$|usd|dollar"), "USD").when(low.rlike("€|eur"), "EUR").otherwise("INR")
    here = lambda x: x if only is None else F.when(only, x)
    return found.withColumn("amount", here(number * factor)).withColumn("currency", here(currency))


def amounts(segments: DataFrame) -> DataFrame:
    """Currency amounts by symbol, code or word, each with its own magnitude: adds amount and currency."""
    return _with_amounts(mentions(segments, AMOUNT_PATTERNS))


def patterned(segments: DataFrame) -> DataFrame:
    """Dates, identifiers and terms."""
    return mentions(segments, PATTERNS, len(AMOUNT_PATTERNS))


def extract(segments: DataFrame) -> DataFrame:
    """All entities, one for each type, lower-case value and segment, the first extracted."""
    every = mentions(segments, AMOUNT_PATTERNS + PATTERNS)
    row, order = F.struct("ord", "mention", "confidence"), F.struct("layer", "ord")
    first = every.groupBy("call_id", "segment_id", "entity_type", F.lower("mention").alias("low")).agg(F.min_by(row, order).alias("first"))
    return _with_amounts(first.select("call_id", "segment_id", "entity_type", "first.*"), F.col("entity_type") == "currency_amount")


def words_to_number(words: Column) -> Column:
    """The number that an array of number words says: scales of a thousand and more close a group; null if a word is none."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("current"), F.lit(True).alias("ok"))

    def step(acc: Column, word: Column) -> Column:
        value, scale = _map(NUMBER_WORDS)[word], _map(SCALE_WORDS)[word]
        grouped = F.greatest(acc["current"], F.lit(1).cast("long")) * scale
        return F.struct(
            F.when(scale >= 1000, acc["total"] + grouped).otherwise(acc["total"]).cast("long").alias("total"),
            F.when(scale >= 1000, F.lit(0)).when(scale.isNotNull(), grouped).otherwise(acc["current"] + F.coalesce(value, F.lit(0))).cast("long").alias("current"),
            (acc["ok"] & (value.isNotNull() | scale.isNotNull())).alias("ok"),
        )

    return F.aggregate(words, start, step, lambda acc: F.when(acc["ok"], acc["total"] + acc["current"]))


def spoken_numbers(segments: DataFrame, least: int = 10) -> DataFrame:
    """Amounts in number words before a currency word: call_id, segment_id, ord, mention, amount."""
    word = "(?:" + "|".join([*NUMBER_WORDS, *SCALE_WORDS]) + ")"
    pattern = rf"(?i)\b({word}(?:[\s-]{word})*)\s(?:rupees?|rupaye|dollars?)\b"
    found = segments.select("call_id", "segment_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("ord", "mention"))
    return found.withColumn("amount", words_to_number(F.split(F.lower("mention"), r"[\s-]"))).where(F.col("amount") >= least)


def import_annotations(annotations: DataFrame, labels: dict[str, str], threshold: float = 0.5, fixed: dict[str, float] | None = None) -> DataFrame:
    """Entities of an external recognizer (call_id, segment_id, source, label, word, score): labels mapped, low scores dropped, untrusted sources with a fixed confidence."""
    kind = _map(labels)[F.col("label")]
    trust = F.coalesce(_map(fixed)[F.col("source")], F.col("score")) if fixed else F.col("score")
    return annotations.where(F.col("score") >= threshold).select("call_id", "segment_id", "source", kind.alias("entity_type"), F.btrim("word").alias("mention"), F.round(trust, 3).alias("confidence")).where("entity_type is not null and mention <> ''")


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """All rows of the first layer; of each later one a row for a (type, segment) that no earlier layer has, the first mention."""
    key = ["call_id", "segment_id", "entity_type"]
    every = layers[0].select(*key, "mention", "confidence", F.lit(0).alias("layer"))
    for k, layer in enumerate(layers[1:], 1):
        every = every.unionByName(layer.select(*key, "mention", "confidence", F.lit(k).alias("layer")))
    w = Window.partitionBy(*key)
    placed = every.withColumn("least", F.min("layer").over(w)).withColumn("k", F.row_number().over(w.orderBy("layer", "mention")))
    return placed.where("layer = 0 or (layer = least and k = 1)").drop("least", "k")


def drop_noise(entities: DataFrame, acronyms: list[str], vague_dates: list[str]) -> DataFrame:
    """Without tiny reference numbers, acronyms posing as organizations, and vague dates."""
    low = F.lower(F.btrim("mention"))
    tiny = (F.col("entity_type") == "reference") & (F.length(F.regexp_replace("mention", r"\D", "")) < 4)
    posing = (F.col("entity_type") == "organization") & low.isin(*[a.lower() for a in acronyms])
    vague = (F.col("entity_type") == "date") & low.isin(*vague_dates)
    return entities.where(~(tiny | posing | vague))


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources by (type, segment, lower-case value); of equals the first source's row stays."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    w = Window.partitionBy("call_id", "segment_id", "entity_type", F.lower("mention")).orderBy("source", "mention")
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def totals(entities: DataFrame) -> DataFrame:
    """Per call and summable type: count, sum and largest amount."""
    kept = entities.where(F.col("entity_type").isin(*SUMMABLE) & F.col("amount").isNotNull())
    return kept.groupBy("call_id", "entity_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.max("amount").alias("largest"))


def display_groups(entities: DataFrame) -> DataFrame:
    """Entities counted by display group."""
    return entities.groupBy("call_id", F.coalesce(_map(GROUPS)[F.col("entity_type")], F.lit("Other")).alias("display_group")).agg(F.count("*").alias("n"))


def parse_entity_lines(answers: DataFrame) -> DataFrame:
    """Lines ``ENTITY|type|value|raw`` of an annotator's text (call_id, answer)."""
    lines = answers.select("call_id", F.posexplode(F.split("answer", "\n")).alias("line", "text")).where(F.col("text").startswith("ENTITY|"))
    parts = F.split("text", r"\|", 4)
    return lines.where(F.size(parts) == 4).select("call_id", "line", F.lower(F.btrim(parts[1])).alias("entity_type"), F.btrim(parts[2]).alias("value"), F.btrim(parts[3]).alias("raw"))


def parse_obligation_lines(answers: DataFrame, strengths: tuple[str, ...] = ("binding", "promise", "conditional", "vague")) -> DataFrame:
    """Lines ``OBLIGATION|speaker|strength|text``; those of unknown strength are left out."""
    lines = answers.select("call_id", F.posexplode(F.split("answer", "\n")).alias("line", "text")).where(F.col("text").startswith("OBLIGATION|"))
    parts = F.split("text", r"\|", 4)
    parsed = lines.where(F.size(parts) == 4).select("call_id", "line", F.btrim(parts[1]).alias("speaker"), F.lower(F.btrim(parts[2])).alias("strength"), F.btrim(parts[3]).alias("obligation"))
    return parsed.where(F.col("strength").isin(*strengths))

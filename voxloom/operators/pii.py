"""Personal data: detection by patterns and check digits, scores from context, and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The Verhoeff check's multiplication of the dihedral group of ten, and its permutation.
VERHOEFF_TIMES = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
VERHOEFF_MOVE = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]

#: Digits as they are spoken.
SPOKEN = {"zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
#: One dictated digit, which may be doubled, and what may stand between two.
_DIGIT, _PAUSE = f"(?:(?:double|triple)[ -]+)?(?:[0-9]|{'|'.join(SPOKEN)})", "[ ,-]+"
# Handles of payment addresses.
HANDLES = "ybl okhdfcbank okicici oksbi okaxis okbizaxis paytm apl ibl axl axisbank upi phonepe gpay hdfcbank icici sbi yesbank kotak federal idfcbank indus barodampay cnrb airtel freecharge abfspay jupiteraxis naviaxis fam slc rapl waaxis waicici wasbi".split()
#: (type, score, pattern). No pattern looks around itself: what stands beside a value is taken along and judged by ``valid``.
RECOGNIZERS = [
    ("AADHAAR", 0.7, r"\b[2-9]\d{3}[ -]\d{4}[ -]\d{4}\b"),
    ("AADHAAR", 0.6, rf"(?i)\b{_DIGIT}(?:{_PAUSE}{_DIGIT}){{5,40}}\b"),
    ("AADHAAR", 0.5, r"\+?\b[2-9]\d{11}\b"),
    ("PAN", 0.8, r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("PAN", 0.6, rf"(?i)\b[A-Z](?:{_PAUSE}[A-Z]){{4}}(?:{_PAUSE}{_DIGIT}){{2,4}}{_PAUSE}[A-Z]\b"),
    ("PHONE", 0.6, r"\+91[ -]?[6-9]\d{4}[ -]?\d{5}\b"),
    ("PHONE", 0.4, r"\b[6-9]\d{4}[ -]?\d{5}\b"),
    ("UPI", 0.9, rf"\b[\w.-]+@(?:{'|'.join(HANDLES)})\b"),
    ("UPI", 0.5, r"\b[\w.-]{2,64}@[a-z]{2,30}\b(?:[.-]\w+)*"),
    ("IFSC", 0.8, r"\b[A-Z]{4}0\d{6}\b"),
    ("BANK_ACCOUNT", 0.3, r"\b\d{9,18}\b"),
    ("CARD", 0.8, r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b"),
    ("CARD", 0.4, r"\b\d{16}\b"),
    ("EMAIL", 0.9, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    ("IBAN", 0.9, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("IP", 0.6, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("DATE", 0.6, r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
]
#: How a dictated value is written: (pattern, replacement), in order.
WRITTEN = [*[(rf"(?i)\b{word}\b", str(digit)) for word, digit in SPOKEN.items()], (r"(?i)\bdouble[ -]+([0-9])", "$1$1"), (r"(?i)\btriple[ -]+([0-9])", "$1$1$1"), ("[^A-Za-z0-9]+", "")]
#: Words that support a type.
CONTEXT = {"AADHAAR": ["aadhaar", "verification"], "PAN": ["pan"], "PHONE": ["call", "phone"], "UPI": ["pay", "upi"], "IFSC": ["ifsc"], "BANK_ACCOUNT": ["account"], "CARD": ["card"], "EMAIL": ["write", "mail"], "DATE": ["born", "birth"]}
BOOST, REACH = 0.35, 5
#: Characters before a mention that are looked at first for its five words; the whole text before it where they hold fewer.
TAIL = 256
THRESHOLD, THRESHOLDS = 0.5, {"DATE": 0.7}


def verhoeff(digits: Column) -> Column:
    """The Verhoeff checksum of a string of digits: 0 for one that ends with its check digit."""
    table = lambda rows: F.array(*[F.lit(r) for r in rows])
    reversed_digits = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    numbered = F.transform(reversed_digits, lambda x, k: F.struct(x.cast("int").alias("d"), k.alias("k")))

    def step(c: Column, x: Column) -> Column:
        moved = F.substring(F.element_at(table(VERHOEFF_MOVE), (x["k"] % 8) + 1), x["d"] + 1, F.lit(1)).cast("int")
        return F.substring(F.element_at(table(VERHOEFF_TIMES), c + 1), moved + 1, F.lit(1)).cast("int")

    return F.aggregate(numbered, F.lit(0), step)


def verhoeff_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Verhoeff check."""
    return (F.length(digits) > 0) & (verhoeff(digits) == 0)


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, k: F.when(k % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2))
    return (F.length(digits) > 0) & (F.aggregate(F.transform(each, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0)


def iban_ok(value: Column) -> Column:
    """Whether an international account number of 15 to 34 characters leaves 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    each = F.filter(F.split(moved, ""), lambda x: x != "")
    step = lambda acc, x: F.when(x.rlike("[0-9]"), acc * 10 + x.try_cast("int")).otherwise(acc * 100 + F.ascii(x) - 55) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(each, F.lit(0), step) == 1)


def as_written(value: Column) -> Column:
    """A value without what separates its characters, spoken digits as digits, in upper case."""
    for pattern, replacement in WRITTEN:
        value = F.regexp_replace(value, pattern, replacement)
    return F.upper(value)


def shorter(value: Column) -> list[Column]:
    """A value, and it without its last, its last two and its last three words."""
    return [value, *[F.regexp_replace(value, f"(?: [A-Z0-9]+){{{k}}}$", "") for k in (1, 2, 3)]]


def found(texts: DataFrame, key: list[str]) -> DataFrame:
    """A row for each match: key, entity_type, ord, mention, score, start, near (up to five words before it).

    All patterns are matched in one pass. Places come from the lengths of the
    pieces between matches, as functions over all matches give no positions.
    """
    each = [F.struct(F.lit(k).alias("rule"), F.lit(kind).alias("entity_type"), F.lit(score).alias("score"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("m")) for k, (kind, score, pattern) in enumerate(RECOGNIZERS)]
    digits = texts.where(F.col("text").rlike(f"[0-9@]|(?i:{_DIGIT}{_PAUSE}{_DIGIT})"))  # each pattern asks for one of them
    rows = digits.select(*key, "text", F.inline(F.filter(F.array(*each), lambda x: F.size(x["m"]) > 0)))
    pieces = F.coalesce(*[F.when(F.col("rule") == k, F.split("text", pattern, -1)) for k, (_, _, pattern) in enumerate(RECOGNIZERS)])
    lengths = lambda x: F.transform(x, lambda p: F.length(p))
    placed = rows.select(*key, "text", "entity_type", "score", lengths(pieces).alias("gaps"), lengths(F.col("m")).alias("sizes"), F.posexplode("m").alias("ord", "mention"))
    add = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda a, v: a + v)
    placed = placed.withColumn("start", add(F.col("gaps"), F.col("ord") + 1) + add(F.col("sizes"), F.col("ord")))
    tail = _words(F.substring("text", F.greatest(F.col("start") - TAIL + 1, F.lit(1)), F.least("start", F.lit(TAIL))))
    near = F.when((F.size(tail) > REACH) | (F.col("start") <= TAIL), tail).otherwise(_words(F.substring("text", F.lit(1), F.col("start"))))
    near = F.slice(near, F.greatest(F.size(near) - (REACH - 1), F.lit(1)), F.lit(REACH))
    return placed.select(*key, "entity_type", "ord", "mention", "score", "start", near.alias("near"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.btrim(F.regexp_replace(F.lower(text), "[^a-z]+", " ")), " "), lambda w: w != "")


def valid(mentions: DataFrame) -> DataFrame:
    """Without numbers whose check digits are wrong or that belong to something longer, and addresses out of range; of an account number, what has right check digits, as words may follow it."""
    digits, written = F.regexp_replace("mention", r"\D", ""), as_written(F.col("mention"))
    account = F.coalesce(*[F.when(iban_ok(x), x) for x in shorter(F.col("mention"))])
    mentions = mentions.withColumn("mention", F.when(F.col("entity_type") == "IBAN", account).otherwise(F.col("mention"))).where("mention is not null")
    octets = F.forall(F.split("mention", r"\."), lambda x: x.cast("int") <= 255)
    ok = F.when(F.col("entity_type") == "AADHAAR", ~F.startswith("mention", F.lit("+")) & written.rlike("^[2-9][0-9]{11}$") & verhoeff_ok(written)).when(F.col("entity_type") == "PAN", written.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")).when(F.col("entity_type") == "UPI", ~F.col("mention").rlike("@.*[.-]")).when(F.col("entity_type") == "CARD", luhn_ok(digits)).when(F.col("entity_type") == "IP", octets).otherwise(F.lit(True))
    return mentions.where(ok)


def with_context(mentions: DataFrame) -> DataFrame:
    """Scores raised where one of the last five words before a mention supports its type."""
    known = F.create_map(*[x for k, v in CONTEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    supported = F.coalesce(F.arrays_overlap("near", known[F.col("entity_type")]), F.lit(False))
    return mentions.withColumn("score", F.round(F.when(supported, F.least(F.col("score") + BOOST, F.lit(1.0))).otherwise(F.col("score")), 2))


def _limit() -> Column:
    return F.coalesce(F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])[F.col("entity_type")], F.lit(THRESHOLD))


def detect(texts: DataFrame, key: list[str]) -> DataFrame:
    """Personal data above its threshold, one row for each type and mention of a text, the best score at its first place: key, entity_type, mention, score, start."""
    good = with_context(valid(found(texts, key))).where(F.col("score") >= _limit())
    best = good.groupBy(*key, "entity_type", "mention").agg(F.min(F.struct((-F.col("score")).alias("s"), "start")).alias("x"))
    return best.select(*key, "entity_type", "mention", (-F.col("x.s")).alias("score"), "x.start")


def places(texts: DataFrame, key: list[str]) -> DataFrame:
    """Every place of what ``detect`` finds in a text, once for each type, with the best score of its type and mention there: what is to be masked."""
    good = with_context(valid(found(texts, key)))
    best = F.max("score").over(Window.partitionBy(*key, "entity_type", "mention"))
    return good.select(*key, "entity_type", "mention", best.alias("score"), "start").where(F.col("score") >= _limit()).distinct()


def mask_value(kind: Column, value: Column) -> Column:
    """A value as it may be shown."""
    written = as_written(value)
    digits = F.regexp_replace(F.when(kind == "AADHAAR", written).otherwise(value), r"\D", "")
    last = F.concat(F.repeat(F.lit("X"), F.greatest(F.length(digits) - 4, F.lit(0))), F.right(digits, F.lit(4)))
    return (
        F.when(kind.isin("AADHAAR", "PHONE", "BANK_ACCOUNT", "CARD", "IBAN"), last)
        .when(kind.isin("EMAIL", "UPI"), F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring_index(value, "@", -1)))
        .when(kind == "PAN", F.concat(F.lit("XXXXX"), F.substring(written, 6, 4), F.lit("X")))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )


def mask_spans(texts: DataFrame, mentions: DataFrame, key: list[str]) -> DataFrame:
    """Masks mentions at their places, all of which should be given (``places``).

    Places that overlap, also by way of others, are masked as one, by the mask of
    the one of highest score, then the longest, then the first, then by type.
    """
    spans = mentions.withColumn("stop", F.col("start") + F.length("mention"))
    w = Window.partitionBy(*key).orderBy("start", "stop", "entity_type")
    apart = F.col("start") >= F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    order = F.struct((-F.col("score")).alias("s"), (F.col("start") - F.col("stop")).alias("n"), "start", "entity_type")
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.withColumn("island", island).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(mask_value(F.col("entity_type"), F.col("mention")), order).alias("mask"))
    lists = merged.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "mask"))).alias("spans"))
    before = lambda s, k: F.substring(F.col("text"), F.when(k > 0, F.element_at("spans", k)["stop"]).otherwise(0) + 1, s["start"] - F.when(k > 0, F.element_at("spans", k)["stop"]).otherwise(0))
    pieces = F.array_join(F.transform("spans", lambda s, k: F.concat(before(s, k), s["mask"])), "")
    last = F.element_at("spans", -1)["stop"]
    masked = F.concat(pieces, F.substring("text", last + 1, F.length("text")))
    return texts.join(lists, key, "left").select(*key, F.coalesce(masked, "text").alias("text"))


def mask_strings(texts: DataFrame, mentions: DataFrame, key: list[str]) -> DataFrame:
    """Masks every occurrence of each mention's string, longer ones first."""
    lists = mentions.groupBy(*key).agg(F.collect_set(F.struct((-F.length("mention")).alias("n"), "mention", "entity_type")).alias("found"))
    masked = F.aggregate(F.array_sort("found"), F.col("text"), lambda t, s: F.replace(t, s["mention"], mask_value(s["entity_type"], s["mention"])))
    return texts.join(lists, key, "left").select(*key, F.coalesce(masked, "text").alias("text"))


def combined_view(entities: DataFrame, personal: DataFrame) -> DataFrame:
    """Financial entities and personal data in one table, the latter with a prefix; dates without digits are left out."""
    first = entities.select("call_id", "segment_id", "entity_type", "mention")
    second = personal.select("call_id", "segment_id", F.concat(F.lit("pii_"), F.lower("entity_type")).alias("entity_type"), "mention")
    return first.unionByName(second).where(~((F.col("entity_type") == "date") & ~F.col("mention").rlike(r"\d")))


def counts(mentions: DataFrame, key: str) -> DataFrame:
    """Mentions per type."""
    return mentions.groupBy(key, "entity_type").agg(F.count("*").alias("n"))


def import_people(annotations: DataFrame) -> DataFrame:
    """Names and places of an external recognizer for calls that aren't English: labels mapped, half sure or more, tokens cleaned."""
    kind = F.when(F.col("label") == "PER", "PERSON").when(F.col("label") == "LOC", "LOCATION")
    word = F.btrim(F.regexp_replace("word", r"^##|[^\p{L}\p{N} ]", ""))
    return annotations.where("score >= 0.5 and lang <> 'en'").select("call_id", "segment_id", kind.alias("entity_type"), word.alias("mention"), "score").where("entity_type is not null and length(mention) > 1")

"""A labelled corpus of personal data made from keys, and scores of detection against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import SPOKEN, verhoeff

#: Types that are scored.
TRACKED = ("AADHAAR", "PAN", "IFSC", "UPI", "PHONE")
# The inverse of each element of the Verhoeff group.
VERHOEFF_INVERSE = "0432156789"
_APART = lambda x, n: " || ' ' || ".join(f"substr({x}, {k}, 1)" for k in range(1, n + 1))
_PAN = "chr(65 + cast(k % 26 as int)) || chr(65 + cast(k * 3 % 26 as int)) || 'CPK' || cast(1000 + k % 9000 as varchar(4)) || 'F'"


def spoken_sql(text: str) -> str:
    """SQL of digits as words, equal neighbours as "double"; the inverse of ``pii.as_written``."""
    for word, digit in SPOKEN.items():
        text = f"replace({text}, '{digit}', '{word}')" if word != "oh" else text
    for word in SPOKEN:
        text = f"replace({text}, '{word} {word}', 'double {word}')" if word != "oh" else text
    return text


#: What a sample of each kind says, what its value is, and whether that must not be found; ``k`` is the key, ``good`` a number with its right check digit, ``bad`` one with a wrong one. Both engines read it.
KINDS = [
    ("AADHAAR", "'My Aadhaar is ' || value || ' for verification'", "good", False),
    ("PAN", "'The pan is ' || value || ' as I said'", _PAN, False),
    ("IFSC", "'Send it with ifsc ' || value || ' today'", "'HDF' || chr(65 + cast(k % 26 as int)) || '0' || cast(100000 + k % 900000 as varchar(6))", False),
    ("UPI", "'You may pay to ' || value || ' now'", "'meera' || cast(10 + k % 990 as varchar(3)) || '@oksbi'", False),
    ("PHONE", "'Please call ' || value || ' after five'", "'+91' || cast(9000000000 + k % 1000000000 as varchar(10))", False),
    ("AADHAAR", "'My Aadhaar is ' || value || ' for verification'", "bad", True),
    ("AADHAAR", "'My Aadhaar reads ' || value || ' as printed'", "substr(good, 1, 4) || ' ' || substr(good, 5, 4) || ' ' || substr(good, 9, 4)", False),
    ("AADHAAR", "'Sir the Aadhaar on record is ' || value || '.'", _APART("good", 12), False),
    ("AADHAAR", "'Let me read out my Aadhaar, it is ' || value || ', right'", spoken_sql(_APART("good", 12)), False),
    ("AADHAAR", "'The Aadhaar I noted is ' || value || ' I think'", spoken_sql(_APART("bad", 12)), True),
    ("PAN", "'The pan is ' || value || ' please note'", spoken_sql("lower(" + _APART(f"({_PAN})", 10) + ")"), False),
    (None, "'I will pay ' || cast(k % 5000 as varchar(20)) || ' rupees by Friday'", "cast(null as varchar(20))", False),
]
PAYLOAD = "cast(2 + k % 8 as varchar(1)) || lpad(cast((k * 7919 + 13) % 10000000000 as varchar(10)), 10, '0')"


def pick(column: int) -> str:
    """SQL for a column of KINDS, chosen by ``kind``."""
    quoted = lambda x: "null" if x is None else f"'{x}'" if column == 0 else str(x).lower() if column == 3 else x
    return "case kind " + " ".join(f"when {n} then {quoted(row[column])}" for n, row in enumerate(KINDS)) + " end"


def labelled_corpus(keys: DataFrame) -> DataFrame:
    """A sample for each key ``k``: sample_id, text, entity_type (null: nothing to be found), value, forbidden (a hard negative: it must not be found).

    Kinds follow the key: identifiers of each tracked type with right check
    digits, numbers with a wrong one, dictated forms, and sentences without any.
    """
    payload = keys.select("k", (F.col("k") % len(KINDS)).cast("int").alias("kind"), F.expr(PAYLOAD).alias("payload"))
    digit = F.substring(F.lit(VERHOEFF_INVERSE), verhoeff(F.concat("payload", F.lit("0"))) + 1, F.lit(1))
    wrong = ((digit.cast("int") + 1 + F.col("k") % 9) % 10).cast("string")
    made = payload.withColumn("good", F.concat("payload", digit)).withColumn("bad", F.concat("payload", wrong))
    valued = made.select("*", F.expr(pick(2)).alias("value"))
    return valued.select(F.col("k").alias("sample_id"), F.expr(pick(1)).alias("text"), F.expr(pick(0)).alias("entity_type"), "value", F.expr(pick(3)).alias("forbidden"))


def normalized(value: Column) -> Column:
    """Letters, digits and at-signs, in lower case."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9@]", "")


def score_personal(samples: DataFrame, detected: DataFrame) -> DataFrame:
    """Per tracked type: hits, spurious and missed values, those of the spurious that are hard negatives, precision, recall and F1 (0 where there is nothing to divide by)."""
    key = ["sample_id", "entity_type", "value"]
    want = samples.where("entity_type is not null and not forbidden").select("sample_id", "entity_type", normalized(F.col("value")).alias("value")).distinct().withColumn("w", F.lit(1))
    got = detected.where(F.col("entity_type").isin(*TRACKED)).select("sample_id", "entity_type", normalized(F.col("mention")).alias("value")).distinct().withColumn("g", F.lit(1))
    hard = samples.where("forbidden").select("sample_id", "entity_type").distinct().withColumn("hard", F.lit(1))
    rows = want.join(got, key, "full").join(hard, ["sample_id", "entity_type"], "left")
    hit, extra = F.col("w").isNotNull() & F.col("g").isNotNull(), F.col("w").isNull()
    sums = rows.groupBy("entity_type").agg(F.count_if(hit).alias("tp"), F.count_if(extra).alias("fp"), F.count_if(F.col("g").isNull()).alias("fn"), F.count_if(extra & F.col("hard").isNotNull()).alias("hard_fp"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("entity_type", "tp", "fp", "fn", "hard_fp", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def entity_recall(expected: DataFrame, entities: DataFrame) -> DataFrame:
    """Recall of amounts: an expected figure (call_id, segment_id, want) is found if one of the segment's entities has it among its digits."""
    digits = lambda x: F.ltrim(F.rtrim(F.regexp_replace(x, r"[^0-9.]", ""), F.lit(".")), F.lit("0"))
    got = entities.select("call_id", "segment_id", digits(F.col("mention")).alias("figure")).where("figure <> ''").groupBy("call_id", "segment_id").agg(F.collect_set("figure").alias("figures"))
    joined = expected.select("call_id", "segment_id", digits(F.col("want")).alias("want")).join(got, ["call_id", "segment_id"], "left")
    found = F.coalesce(F.exists("figures", lambda x: F.contains(x, F.col("want"))), F.lit(False))
    return joined.select(found.alias("found")).agg(F.count_if("found").alias("tp"), F.count_if(~F.col("found")).alias("fn"), F.round(F.avg(F.col("found").cast("double")), 6).alias("recall"))

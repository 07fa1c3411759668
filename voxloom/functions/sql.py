"""The column functions as functions of SQL, for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import mining, pii

_QUOTED = lambda rows: "array(" + ", ".join(f"'{r}'" for r in rows) + ")"

#: Native expressions; nothing here leaves the JVM.
FUNCTIONS = {
    "verhoeff_ok(digits string) returns boolean": f"length(digits) > 0 and aggregate(transform(sequence(1, length(digits)), i -> struct(cast(substring(reverse(digits), i, 1) as int) as d, i - 1 as k)), 0, (c, x) -> cast(substring(element_at({_QUOTED(pii.VERHOEFF_TIMES)}, c + 1), cast(substring(element_at({_QUOTED(pii.VERHOEFF_MOVE)}, x.k % 8 + 1), x.d + 1, 1) as int) + 1, 1) as int)) = 0",
    "mask_digits(value string) returns string": "concat(repeat('X', greatest(length(regexp_replace(value, '[^0-9]', '')) - 4, 0)), right(regexp_replace(value, '[^0-9]', ''), 4))",
    "normal_text(value string) returns string": "btrim(regexp_replace(lower(coalesce(value, '')), r'[^\\p{L}\\p{M}\\p{N}]+', ' '))",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udtf.register("align_words", udtf(mining.AlignWords, returnType="heard_words string, true_words string"))
    return [*[head.split("(")[0] for head in FUNCTIONS], "align_words"]

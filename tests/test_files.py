"""Readers and writers, SQL functions, vocabulary."""

from __future__ import annotations

import json

from pyspark.sql.types import StructType

from voxloom.functions import sql
from voxloom.operators import mining, records, transcript, understanding
from voxloom.sources import files, vocabulary


def test_corrupt_records_are_set_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"call_id": 1, "tags": ["x"]}))
    (tmp_path / "b.json").write_text("{broken")
    good, bad = files.read_records(spark, str(tmp_path), StructType.fromDDL("call_id long, tags array<string>"))
    assert [tuple(r) for r in good.collect()] == [(1, ["x"])]
    assert [r["content"] for r in bad.collect()] == ["{broken"]


def test_inventory(spark, tmp_path):
    for name in ("hi/kyc/a.wav", "x/b.MP3", "x/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    found = {r["path"].rsplit("/", 1)[1]: (r["language"], r["call_type"], r["length"]) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert found == {"a.wav": ("hi", "kyc", 3), "b.MP3": ("en", "general", 3)}


def test_exports_leave_out_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    made = files.export_all(spark, str(tmp_path), {"calls": (rows, "parquet"), "flat": (rows, "csv"), "lines": (rows, "jsonl"), "none": (rows.limit(0), "csv")})
    assert [(r["name"], r["n"]) for r in made.orderBy("name").collect()] == [("calls", 2), ("flat", 2), ("lines", 2)]
    assert spark.read.parquet(f"{tmp_path}/calls").count() == spark.read.json(f"{tmp_path}/lines").count() == 2
    files.append_corrections(rows, f"{tmp_path}/fixes")
    files.append_corrections(rows, f"{tmp_path}/fixes")
    assert spark.read.parquet(f"{tmp_path}/fixes").count() == 4


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select verhoeff_ok('234567890124') a, verhoeff_ok('234567890127') b, mask_digits('+91 98765 43210') c, normal_text(' A-b ') d").first()
    assert tuple(row) == (True, False, "XXXXXXXX3210", "a b")


def test_nested_vocabulary(spark, tmp_path):
    (tmp_path / "xx.json").write_text(json.dumps({"greetings": ["a", "b"], "words": {"months": ["c"], "deep": {"d": {"keywords": ["e"], "regulation": "r"}}}}))
    found = vocabulary.load(spark, str(tmp_path)).collect()
    assert {(r["lang"], r["category"], r["phrase"]) for r in found} >= {("xx", "greetings", "a"), ("xx", "greetings", "b"), ("xx", "words", "c")}


def test_upsert_doesnt_depend_on_order(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 3, "y")], "call_id int, version int, status string")
    b = spark.createDataFrame([(2, 2, "old"), (3, 1, "new")], "call_id int, version int, status string")
    assert set(map(tuple, records.upsert(a, b).collect())) == set(map(tuple, records.upsert(b, a).collect())) == {(1, 1, "x"), (2, 3, "y"), (3, 1, "new")}


def test_aligned_words(spark):
    pairs = spark.createDataFrame([(1, "my kayak form is due", "my KYC form is due"), (2, None, "x"), (3, "same", "same")], "id long, heard string, truth string")
    assert [tuple(r) for r in mining.align_words(pairs).collect()] == [(1, "kayak", "KYC")]


def test_table_function_aligns_words(spark):
    sql.register(spark)
    found = spark.sql("select p.id, a.* from values (1, 'my kayak form is due', 'my KYC form is due'), (2, null, 'x'), (3, 'a b c', 'x b y') p(id, heard, truth), lateral align_words(p.heard, p.truth) a")
    assert sorted(map(tuple, found.collect())) == [(1, "kayak", "KYC"), (3, "a", "x"), (3, "c", "y")]


def test_names_are_taken_literally(spark):
    frame = spark.createDataFrame([("ask A.B bank, not axb Bank",), (None,)], "text string")
    fixed = transcript.correct_names(frame, {"a.b bank": "A$1 \\ Bank"}).collect()
    assert [(r["text"], r["corrected"]) for r in fixed] == [("ask A$1 \\ Bank, not axb Bank", True), (None, False)]


def test_rebuilt_index(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 2, "b"), (2, None, "c"), (None, 9, "d")], "call_id int, version int, status string")
    assert set(map(tuple, records.rebuild(rows).collect())) == {(1, 2, "b"), (2, None, "c")}
    assert records.rebuild(rows.limit(0)).columns == rows.columns


def test_scorer_that_fails_on_some_texts(spark):
    def scorer(texts, lang):
        if any("bad" in t for t in texts):
            raise ValueError
        return [(f" {'POSITIVE' if lang == 'en' else 'Negative'}", len(t) / 10) for t in texts]

    said = [(1, 0, "en", "good"), (1, 1, None, "bad"), (1, 2, "hi", "x" * 9), (1, 3, "en", None), (1, 4, "en", "12345678")]
    frame = spark.createDataFrame(said, "call_id int, segment_id int, lang string, text string")
    want = {0: ("positive", 0.4), 1: ("neutral", 0.5), 2: ("negative", 0.9), 3: ("positive", 0.0), 4: ("positive", 0.8)}
    assert {r["segment_id"]: (r["label"], r["score"]) for r in understanding.score_sentiment(frame, scorer).collect()} == want
    assert {r["segment_id"]: r["score"] for r in understanding.score_sentiment(frame, scorer, most=4).collect()} == {0: 0.4, 1: 0.5, 2: 0.4, 3: 0.0, 4: 0.4}

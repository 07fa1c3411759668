"""Queries against DuckDB on the smallest data, and hand-made rows where SQL says nothing."""

from __future__ import annotations

import numbers
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxloom.operators import pii, summaries, transcript, understanding
from voxloom.operators.entities import words_to_number
from voxloom.plans import all_queries, all_sql
from voxloom.sources import fixtures

DATA = "/root/testdata/sf0.001"
TABLES = "orders lineitem events documents labels conversations".split()
QUICK = "tx05_correct_terms tx12_map_roles tx16_merge_turns tx17_talk_time en01_amounts pi02_check_digits co04_agent_domination fr01_baselines in03_keyword_intents se04_trajectories em03_call_summary au07_merge_spans au12_splices rs06_supported_numbers io17_upsert mi12_split ev08_latency pi15_mask_spans co13_all_checks en06_dedupe rs07_foreign_claims rs11_parse_answers ev02_score_personal tx07_names se01_score_text uf02_align_words io18_rebuild".split()


def cell(v):
    """A value in a form that both engines share."""
    if not hasattr(v, "__len__") and pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, numbers.Real) and not isinstance(v, bool | np.bool_) else str(v)


def rows(frame) -> Counter:
    """The rows of a frame, whatever their order."""
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(map(cell, row)) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    ours = all_queries()[name](spark, DATA).toPandas()
    assert len(ours)
    assert rows(ours) == rows(con.sql(all_sql()[name]).df())


def test_registry_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_verhoeff_and_luhn(spark):
    found = spark.createDataFrame([("234567890124",), ("234567890127",), ("",)], "d string").select(pii.verhoeff_ok(F.col("d")).alias("v")).collect()
    assert [r["v"] for r in found] == [True, False, False]
    assert spark.createDataFrame([("4539578763621486",), ("4539578763621487",)], "d string").select(pii.luhn_ok(F.col("d")).alias("v")).collect() == [(True,), (False,)]


def test_words_to_number(spark):
    texts = ["ten thousand", "two lakh fifty thousand", "three hundred", "banana"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(words_to_number(F.split("t", " ")).alias("n")).collect()
    assert [r["n"] for r in found] == [10_000, 250_000, 300, None]


def test_masks_overlapping_spans(spark):
    key = ["call_id", "segment_id"]
    said = ["mail a.b@c.org now", None, "nothing", "mail a.b@c.org or again a.b@c.org now", "card 4539 5787 6362 1486 " + "x " * 200 + "4539 5787 6362 1486", ""]
    texts = spark.createDataFrame([(1, k, t) for k, t in enumerate(said)], "call_id int, segment_id int, text string")
    masked = {r["segment_id"]: r["text"] for r in pii.mask_spans(texts, pii.places(texts, key), key).collect()}
    assert masked == {0: "mail a***@c.org now", 1: None, 2: "nothing", 3: "mail a***@c.org or again a***@c.org now", 4: "card XXXXXXXXXXXX1486 " + "x " * 200 + "XXXXXXXXXXXX1486", 5: ""}
    assert pii.detect(texts, key).count() == 3


def test_spans_that_overlap_in_a_chain_are_masked_as_one(spark):
    texts = spark.createDataFrame([(1, 0, "ab cdefgh ij")], "call_id int, segment_id int, text string")
    spans = spark.createDataFrame([(1, 0, "X", "cde", 0.6, 3), (1, 0, "Y", "efg", 0.9, 5), (1, 0, "Z", "gh", 0.5, 7)], "call_id int, segment_id int, entity_type string, mention string, score double, start int")
    assert pii.mask_spans(texts, spans, ["call_id", "segment_id"]).first()["text"] == "ab [Y] ij"


def test_transitions_follow_the_last_accepted_emotion(spark):
    emotions = [("neutral", 0.9), ("angry", 0.5), ("neutral", 0.5), ("angry", 0.8), ("happy", 0.5), ("happy", 0.5)]
    frame = spark.createDataFrame([(1, "a", k, e, s, False) for k, (e, s) in enumerate(emotions)], "call_id int, speaker string, segment_id int, emotion string, emotion_score double, low_confidence boolean")
    found = [(r["segment_id"], r["old"], r["new"], r["significance"]) for r in understanding.transitions(frame).orderBy("segment_id").collect()]
    assert found == [(3, "neutral", "angry", "high"), (4, "angry", "happy", "medium")]


def test_blank_turns_are_left_out(spark):
    frame = spark.createDataFrame([(1, 0, "a", 0.0, 1.0, "x"), (1, 1, "a", 1.0, 2.0, " "), (1, 2, "a", 2.0, 3.0, "y"), (1, 3, "b", 3.0, 4.0, "z")], "call_id int, segment_id int, speaker string, start_s double, end_s double, text string")
    assert [(r["turn"], r["text"]) for r in transcript.merge_turns(frame).orderBy("turn").collect()] == [(0, "x y"), (1, "z")]


def test_answers_with_nothing_in_them(spark):
    said = [None, "", "Summary: [2-3 sentence summary]\nOutcomes:\n- [Outcome 1]\nActions:\n* Call back", "**Summary:** It went\nwell *\nKey Outcomes\n- Item 2: paid\n-x\nno item"]
    found = [tuple(r) for r in summaries.parse_answer(spark.createDataFrame(list(enumerate(said)), "call_id int, answer string")).orderBy("call_id").select("summary", "outcomes", "actions").collect()]
    none = (summaries.NO_SUMMARY, [summaries.NO_OUTCOME], [summaries.NO_ACTION])
    assert found[:2] == [none, none]
    assert found[2] == (summaries.NO_SUMMARY, [summaries.NO_OUTCOME], ["Call back"])
    assert found[3] == ("It went well", ["paid"], [summaries.NO_ACTION])


def test_account_numbers_with_wrong_digits(spark):
    rows = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82WEST12345698765433",), ("DE89370400440532013000",)], "v string")
    assert [r[0] for r in rows.select(pii.iban_ok(F.col("v"))).collect()] == [True, False, True]


def test_confidences_of_one_intent_by_several_rules(spark):
    rows_ = [(1, 0, "collections", "Your balance is here"), (2, 0, "general", "Nothing said"), (3, 0, "collections", "Get me your supervisors"), (4, 0, "kyc", None), (5, 0, "general", "q&a session")]
    calls = spark.createDataFrame(rows_, "call_id long, segment_id int, call_type string, text string").withColumn("intent", F.lit("clash"))
    found = {r["call_id"]: (r["intent"], r["confidence"]) for r in understanding.keyword_intents(calls).collect()}
    assert found == {1: ("information_request", 0.68), 2: ("information_request", 0.50), 3: ("escalation", 0.75), 4: ("unknown", 0.30), 5: ("procedural", 0.75)}
    whole = {r["call_id"]: r["intent"] for r in understanding.keyword_intents(calls, word=True).collect()}
    assert whole == {1: "information_request", 2: "information_request", 3: "unknown", 4: "unknown", 5: "procedural"}


@pytest.mark.parametrize("name", ["rs17_risk_factors", "ev07_gate_cost", "ev01_precision_recall", "rs16_topic_sentiment", "qy15_risk_distribution"])
def test_texts_are_not_made_in_conditions(spark, name):
    """Filters on what follows from a text must not copy the expressions that make it up into joins."""
    plan = all_queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "{amt}" not in plan and "lineitem.parquet" not in plan


def test_partitions_of_long_calls_grow_with_the_input(spark, monkeypatch):
    """The sorts of a task stay of one size, and the rows are those of the SQL."""
    corpus = fixtures.Corpus(spark, DATA)
    monkeypatch.setattr(fixtures, "SHARE", 700)
    found = corpus.segments_long()
    assert found.rdd.getNumPartitions() == corpus.table("lineitem").count() // 700 + 1
    corpus._views("lineitem", "orders")
    want = spark.sql(f"with {fixtures.segments_sql('vx_lineitem', 'vx_orders')}, {fixtures.LONG_SQL} select * from segments_long")
    assert found.columns == want.columns and rows(found.toPandas()) == rows(want.toPandas())

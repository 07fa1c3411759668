"""Frequent runs of words level by level against plain counts, rows of the index, and escalated calls."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxloom.operators import mining, records, summaries, understanding


def _runs(text: str | None, sizes: tuple[int, ...]) -> list[str]:
    w = (text or "").split()
    return [" ".join(w[i : i + k]) for k in sizes for i in range(len(w) - k + 1)]


@pytest.mark.parametrize(("least", "sizes"), [(1, (1, 2)), (4, (3, 4, 5)), (9, (2, 5)), (10**6, (3,))])
def test_frequent_grams_equal_counts(spark, least, sizes):
    dice = random.Random(7)
    texts = [" ".join(dice.choice("abcd") for _ in range(dice.randint(0, 30))) for _ in range(40)] + [None, "", "a " * 200]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = Counter(g for t in texts for g in _runs(t, sizes))
    assert dict(map(tuple, mining.frequent_grams(frame, least, sizes).collect())) == {g: n for g, n in counts.items() if n >= least}
    assert mining.frequent_grams(frame.limit(0), least, sizes).count() == 0


def test_overrepresented_equals_its_definition(spark):
    dice = random.Random(3)
    docs = [(dice.choice([1, 1, 0, 2, None]), " ".join(dice.choice("aaabcd") for _ in range(dice.randint(0, 12)))) for _ in range(150)]
    frame = spark.createDataFrame(docs, "label int, text string")
    own, other = ([t for label, t in docs if label is not None and (label == 1) == mine] for mine in (True, False))
    a, b = (Counter(g for t in texts for g in _runs(t, (3, 4, 5))) for texts in (own, other))
    for most in (5000, 20):
        top = sorted(a.items(), key=lambda x: (-x[1], x[0]))[:most]
        rate = {g: n / len(own) / max(b[g] / len(other), 0.0001) for g, n in top if n >= max(3, len(own) // 100)}
        want = {g: (a[g], b[g], round(r, 6)) for g, r in rate.items() if r >= 1.2}
        found = {r["gram"]: (r["a"], r["b"], r["ratio"]) for r in mining.overrepresented(frame, 1, most, 1.2).collect()}
        assert found == want and want
    assert mining.overrepresented(frame, 9).count() == 0
    assert mining.overrepresented(frame.limit(0), 1).count() == 0


def test_index_rows_have_defaults(spark):
    bare = records.index_rows(spark.createDataFrame([(1, 3)], "call_id int, version int")).first().asDict()
    assert bare == {"call_id": 1, "version": 3, "source": None, "duration_s": 0.0, "language": "en", "call_type": None, "n_speakers": 0, "risk_level": "low", "compliance_score": 0, "review_required": False, "priority": 5, "summary": "", "n_personal": 0, "tamper_risk": "none", "review_reasons": "[]", "degradations": "[]"}
    kind = "call_id int, detected_language string, language string, priority int, summary string, risk_level string, review_reasons array<string>, degradations array<struct<component: string, why: string>>"
    rows = [(1, "", "hi", 0, "क" * 501, "", ['a "b"', "c"], [("audio", "x"), ("fraud", None)]), (2, "ta", "hi", None, None, "high", None, None), (3, None, "", 1, "s", None, [], [])]
    found = {r["call_id"]: r for r in records.index_rows(spark.createDataFrame(rows, kind)).collect()}
    assert [found[k]["language"] for k in (1, 2, 3)] == ["hi", "ta", "en"]
    assert [found[k]["priority"] for k in (1, 2, 3)] == [0, 5, 1]
    assert [len(found[k]["summary"]) for k in (1, 2, 3)] == [500, 0, 1]
    assert [found[k]["risk_level"] for k in (1, 2, 3)] == ["low", "high", "low"]
    assert [json.loads(found[k]["review_reasons"]) for k in (1, 2, 3)] == [['a "b"', "c"], [], []]
    assert [json.loads(found[k]["degradations"]) for k in (1, 2, 3)] == [["audio", "fraud"], [], []]


def test_escalated_calls(spark):
    calls = spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 5)], "call_id int")
    intents = spark.createDataFrame([(1, "escalation"), (1, "escalation"), (2, None), (3, "question")], "call_id int, intent string")
    emotions = spark.createDataFrame([(2, "angry"), (2, "happy"), (3, "neutral"), (3, "neutral"), (3, "angry"), (4, None), (5, "frustrated"), (9, "angry")], "call_id int, emotion string")
    found = {r["call_id"]: (r["customer_emotion"], r["escalated"]) for r in records.escalations(calls, intents, emotions).collect()}
    assert found == {1: (None, True), 2: ("angry", True), 3: ("neutral", False), 4: (None, False), 5: ("frustrated", True)}
    assert records.escalations(calls.limit(0), intents, emotions).count() == 0


def test_ngram_counts_shuffle_each_text_once(spark):
    rows = [(1, 0, "a b c d e f a b c"), (1, 0, "a b c"), (2, 0, "a b c d"), (3, 1, "a b"), (4, None, "x y z x y z x y z"), (5, 1, None), (6, 1, "A b, C")]
    found = mining.ngram_counts(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want: dict = {}
    for doc, label, text in rows:
        w = (text or "").lower().replace(",", "").split()
        for k in (3, 4, 5):
            for i in range(len(w) - k + 1):
                want.setdefault((label, " ".join(w[i : i + k])), []).append(doc)
    assert {(r["label"], r["gram"]): (r["n"], r["docs"]) for r in found.collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert found.columns == ["label", "gram", "n", "docs"]


def test_flat_records_count_without_nesting(spark):
    check = "struct<check_name: string, passed: boolean, severity: string, segment_id: int, evidence: string>"
    rows = [(1, "kyc", [("a", False, "high", 0, None), ("b", True, "low", 0, None)], []), (2, "general", [], [])]
    judged = spark.createDataFrame(rows, f"call_id long, call_type string, checks array<{check}>, signals array<struct<name: string>>")
    child = lambda *ids: spark.createDataFrame([(i, 0) for i in ids], "call_id long, segment_id int")
    children = {"segments": child(1, 1, 2), "intents": child(1, 1, 2), "entities": child(1, 1, 1)}
    flat = records.flat_records(judged, **children)
    own = judged.select("call_id", "checks", "signals")
    nested = records.flatten(records.assemble(records.score_judged(judged).join(own, "call_id"), **children))
    assert sorted(flat.collect()) == sorted(nested.collect())
    assert (flat.columns, flat.dtypes) == (nested.columns, nested.dtypes)
    assert "collect_list" not in flat._jdf.queryExecution().optimizedPlan().toString()


def test_accuracy_reads_its_rows_once(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("c", "c"), ("d", "a"), (None, "a"), ("a", None), (None, None)]
    frame = spark.createDataFrame(rows, "truth string, predicted string").repartition(2)
    found = mining.accuracy(frame)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    support, guessed = (Counter(r[k] for r in rows if r[k]) for k in (0, 1))
    tp = Counter(t for t, p in rows if t and t == p)
    f1 = sum(2 * tp[x] / (support[x] + guessed[x]) * support[x] for x in support)
    n = sum(support.values())
    assert tuple(found.first()) == (round(sum(tp.values()) / n, 6), round(f1 / n, 6), n)
    assert tuple(mining.accuracy(frame.limit(0)).first()) == (None, None, None)


def test_intents_of_other_call_types_by_one_pass(spark):
    texts = [p.replace("i will", "I WILL") + tail for *_, phrases in understanding.CASCADE for p in phrases for tail in ("", " now?")]
    texts += [f"so {p} it is" for p in understanding.EXPLANATIONS + understanding.QUESTION_STARTS] + understanding.QUESTION_STARTS + ["", " ", None, "a\n?", "?\n", "सर manager", "I will escalate the revenue risk"]
    kinds = [*understanding.REGULATED, "general", "other", None]
    rows = [(i * 10 + k, i, text, kind) for i, text in enumerate(texts) for k, kind in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "call_id long, segment_id int, text string, call_type string")

    def by_hand(text, kind):
        low = (text or "").strip(" ").lower()
        for name, _, only, phrases in understanding.CASCADE:
            if (not only or kind in understanding.REGULATED) and any(p in low for p in phrases):
                return name
        if low.endswith("?") or any(low.startswith(p) for p in understanding.QUESTION_STARTS):
            return "question"
        return "explanation" if any(p in low for p in understanding.EXPLANATIONS) else "information_request" if kind == "general" else "unknown"

    both = understanding.intents_by_call_type(frame, truth=F.col("call_type"), predicted=F.lit("general"))
    assert {r["call_id"]: (r["truth"], r["predicted"]) for r in both.collect()} == {i: (by_hand(t, k), by_hand(t, "general")) for i, _, t, k in rows}
    assert {r["call_id"]: r["intent"] for r in understanding.keyword_intents(frame).collect()} == {i: by_hand(t, k) for i, _, t, k in rows}
    assert both._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_guard_reads_each_text_once(spark):
    said = [(1, 0, "the balance is 7,250.50 rupees"), (1, 1, "or 900 of 1200"), (2, 0, "nothing"), (3, 0, None), (None, 0, "5000")]
    texts = [(1, "summary", 0, "Owed $900 (about 5000 dollars), paid US$ 7,250.50"), (1, "outcomes", 1, "Due 40 euros and 3210 rupees, 900"), (1, "outcomes", 1, "Due 40 euros and 3210 rupees, 900"), (2, "summary", 0, "$777"), (2, "summary", 2, "a\x02b $777\x02, 50 pounds or 4 million yen."), (3, "summary", 0, None), (4, "summary", 0, "none"), (None, "summary", 0, "$321 and 654")]
    segments = spark.createDataFrame(said, "call_id long, segment_id int, text string")
    fields = spark.createDataFrame(texts, "call_id long, field string, ord int, text string")
    found = {(r["call_id"], r["field"], r["ord"]): (r["text"], r["removed"]) for r in summaries.drop_foreign(fields, segments).collect()}
    assert found == {
        (1, "summary", 0): ("Owed $900, paid US$ 7,250.50", ["about 5000 dollars"]),
        (1, "outcomes", 1): ("Due 40 euros and 3210 rupees, 900", []),
        (2, "summary", 0): ("", ["$777"]),
        (2, "summary", 2): ("a\x02b\x02, 50 pounds or 4 million yen.", ["$777"]),
        (3, "summary", 0): (None, []),
        (4, "summary", 0): ("none", []),
        (None, "summary", 0): ("and 654", ["$321"]),
    }
    audit = summaries.guard_audit(fields, segments)
    assert {r["call_id"]: (r["removed"], r["unsupported"]) for r in audit.collect()} == {1: (["about 5000 dollars"], ["3210"]), 2: (["$777", "$777"], []), 3: ([], []), 4: ([], []), None: (["$321"], [])}
    assert audit._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1

"""Phrases in any script, over segments and in the parts of a call."""

from __future__ import annotations

import random
import time
import unicodedata

from pyspark.sql import functions as F

from voxloom.functions import sql
from voxloom.functions.text import normal, phrase_hits, tokens
from voxloom.operators import compliance, fraud, mining, pii, summaries, transcript
from voxloom.sources import vocabulary


def test_words_of_any_script(spark):
    texts = ["मुझे पैसे चाहिए।", "வீட்டுக்கு ஆள்!", "Ça  coûte 5€", None, "", "co­op क्‍ष", unicodedata.normalize("NFD", "Étude ொ"), "क़र्ज़"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = [r["w"] for r in frame.orderBy("k").select(tokens(F.col("t")).alias("w")).collect()]
    want = ["मुझे पैसे चाहिए", "வீட்டுக்கு ஆள்", "ça coûte 5", "", "", "coop क्ष", "étude ொ", "क़र्ज़"]
    assert found == [unicodedata.normalize("NFC", w).split() for w in want]
    sql.register(spark)
    assert spark.sql("select normal_text('पैसे, Ok') x").first()["x"] == "पैसे ok"


def hits(spark, said, phrases, streams=()):
    rows = [(c, k, t, *flags) for c, k, t, *flags in said]
    frame = spark.createDataFrame(rows, "call_id int, segment_id int, text string" + "".join(f", {s} boolean" for s in streams)).repartition(3)
    return phrase_hits(frame, spark.createDataFrame([(p,) for p in phrases], "phrase string"), tuple(streams))


def test_phrases_over_segments(spark):
    said = [(1, 0, "I will send"), (1, 1, ""), (1, 2, None), (1, 3, "Our"), (1, 4, "people, now"), (2, 0, "send our"), (3, 0, "people send our people send our"), (3, 1, "people"), (4, 0, "resend our people")]
    found = hits(spark, said, ["send our people", "our", "now", "!!", ""]).collect()
    assert sorted((r["call_id"], r["segment_id"], r["phrase"]) for r in found) == [(1, 0, "send our people"), (1, 3, "our"), (1, 4, "now"), (2, 0, "our"), (3, 0, "our"), (3, 0, "send our people"), (4, 0, "our")]


def test_no_phrase_is_found_by_its_remainder(spark):
    said = [(1, 0, "I will pay 500 today from my account"), (2, 0, "मुझे पैसे चाहिए"), (3, 0, "₹ 500 दे दो अब")]
    found = hits(spark, said, ["पैसे चाहिए", "₹ 500 दे", "आपके account", "பணம்"]).collect()
    assert sorted((r["call_id"], r["phrase"]) for r in found) == [(2, "पैसे चाहिए"), (3, "₹ 500 दे")]


def test_parts_of_a_call_are_read_by_themselves(spark):
    said = [(1, 0, "stop calling", True, False), (1, 1, "hello", False, True), (1, 2, "me", True, False), (1, 3, "stop", None, True), (1, 4, "calling me", True, False)]
    found = hits(spark, said, ["stop calling me"], ["customer", "agent"]).collect()
    assert [(r["segment_id"], r["customer"], r["agent"]) for r in found] == [(0, True, False)]
    assert hits(spark, said[3:], ["stop calling me"], ["customer", "agent"]).count() == 0
    assert hits(spark, [], ["x"]).count() == 0


def test_reach_of_the_sql_covers_the_pack():
    assert max(len(p.split()) for _, _, _, _, phrases in vocabulary.PACK for p in phrases) <= 11


def test_values_that_are_spoken_spaced_or_followed_by_words(spark):
    said = {
        "call +91 98765 43210 now": "call XXXXXXXX3210 now",
        "call +91-98765-43210 now": "call XXXXXXXX3210 now",
        "pay asha@ybl or asha@paytm today": "pay a***@ybl or a***@paytm today",
        "pay to some.one@newbank now": "pay to s***@newbank now",
        "ES91 2100 0418 4502 0005 1332 NOW": "XXXXXXXXXXXXXXXXXX1332 NOW",
        "write first-last@x-y.org soon": "write f***@x-y.org soon",
        "write a.b@mail.x-y.co.in soon": "write a***@mail.x-y.co.in soon",
        "my aadhaar is 2 3 4 5 6 7 8 9 0 1 2 4, ok": "my aadhaar is XXXXXXXX0124, ok",
        "aadhaar two three four five, six seven eight nine oh one two four": "aadhaar XXXXXXXX0124",
        "Aadhaar Two three 4 5 6 7 8 9 0 1 2 five": "Aadhaar Two three 4 5 6 7 8 9 0 1 2 five",
        "count one two three four five six seven eight nine one two three four five": "count one two three four five six seven eight nine one two three four five",
        "pan a b c p k one double two 4 f there": "pan XXXXX1224X there",
        "number 919876543210 and +919876543210": None,
    }
    texts = spark.createDataFrame([(1, k, t) for k, t in enumerate(said)], "call_id int, segment_id int, text string")
    key = ["call_id", "segment_id"]
    masked = {r["segment_id"]: r["text"] for r in pii.mask_spans(texts, pii.places(texts, key), key).collect()}
    assert {t: masked[k] for k, t in enumerate(said) if said[t]} == {t: m for t, m in said.items() if m}
    assert [r["entity_type"] for r in pii.detect(texts, key).where("segment_id = 12 and mention like '+%'").collect()] == ["PHONE"]


def test_marks_don_t_stand_in_one_another(spark):
    said = ["the home loan and the loan", "a < b & \"loan\"", "loan loan", "", None, "no entity"]
    texts = spark.createDataFrame([(1, k, t) for k, t in enumerate(said)], "call_id int, segment_id int, text string")
    found = [(0, "home loan", "home loan"), (0, "loan", "loan"), (0, "the", "x\"y"), (1, "loan", "loan"), (1, "& \"loan\"", "q"), (2, "loan", "loan"), (2, "absent", "z"), (3, "", "e")]
    entities = spark.createDataFrame([(1, k, m, t) for k, m, t in found], "call_id int, segment_id int, mention string, entity_type string")
    made = {r["segment_id"]: r["html"] for r in transcript.mark_entities(texts, entities).collect()}
    assert made == {
        0: '<mark class="x&quot;y">the</mark> <mark class="home loan">home loan</mark> and the loan',
        1: 'a &lt; b <mark class="q">&amp; &quot;loan&quot;</mark>',
        2: '<mark class="loan">loan</mark> loan',
        3: "",
        4: None,
        5: "no entity",
    }


def test_numbered_answers(spark):
    said = ["**Summary:** Paid.\n1. First thing\n**Key Outcomes**\n1. First thing\n2) Outcome 2: second\nActions:\n- 3. Call back", "# Outcomes\n10. ten\nNext actions\n* [Action 1] do it\nAction plan agreed"]
    found = [tuple(r) for r in summaries.parse_answer(spark.createDataFrame(list(enumerate(said)), "call_id int, answer string")).orderBy("call_id").select("summary", "outcomes", "actions").collect()]
    assert found == [("Paid.", ["First thing", "second"], ["Call back"]), (summaries.NO_SUMMARY, ["ten"], ["do it"])]


def test_claims_go_with_what_leads_to_them(spark):
    said = ["It is 400 rupees (about $5,000), or roughly 700 thousand euros.", "Pay US$ 7,250.50 million now", "Twenty, that is 900 USD", "$88 and 12 yen stay"]
    fields = spark.createDataFrame([(1, "summary", k, t) for k, t in enumerate(said)], "call_id int, field string, ord int, text string")
    segments = spark.createDataFrame([(1, 0, "nothing said")], "call_id int, segment_id int, text string")
    made = {r["ord"]: (r["text"], r["removed"]) for r in summaries.drop_foreign(fields, segments).collect()}
    assert made == {0: ("It is 400 rupees.", ["about $5,000", "roughly 700 thousand euros"]), 1: ("Pay now", ["US$ 7,250.50 million"]), 2: ("Twenty", ["900 USD"]), 3: ("$88 and 12 yen stay", [])}


def longest_common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_aligned_words_are_as_many_as_can_be(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        b = [x if rng.random() < 0.7 else rng.choice("abcdef") for x in a if rng.random() < 0.9]
        found = mining._common(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:], strict=False))
        assert len(found) == longest_common(a, b)
        pairs = mining.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
        doubled = [w for w in a for _ in (0, 1)], [w for w in b for _ in (0, 1)]  # without words that stand once
        assert len(mining.aligned(*doubled)) == longest_common(*doubled)
    monkeypatch.setattr(mining, "ALIGNED", 8)
    pairs = mining.aligned(list("ab" * 40), list("ba" * 40))
    assert len(pairs) > 60 and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


def test_long_transcripts_are_aligned_in_seconds():
    rng = random.Random(5)
    truth = [f"w{rng.randrange(3000)}" for _ in range(100_000)]
    heard = [w if rng.random() < 0.9 else "x" for w in truth]
    start = time.time()
    found = list(mining.replaced_words(" ".join(heard), " ".join(truth)))
    assert sum(len(h.split()) for h, _ in found) == heard.count("x")
    list(mining.replaced_words(" ".join(["a", "b"] * 50_000), " ".join(["c", "b", "d"] * 30_000)))
    assert time.time() - start < 20


def said_in_parts(spark):
    rows = [
        (1, 0, "SPEAKER_00", 0.0, 40.0, "we will send our"), (1, 1, "SPEAKER_01", 40.0, 50.0, "please stop"), (1, 2, "SPEAKER_00", 50.0, 60.0, "people, to your house! Calling from"),
        (1, 3, "SPEAKER_01", 60.0, 70.0, None), (1, 4, "SPEAKER_01", 70.0, 80.0, "calling me"), *[(1, k, "SPEAKER_00", 80.0, 81.0, "ok") for k in range(5, 9)],
        (2, 0, "x", 0.0, 1.0, "my OTP"), (2, 1, "y", 1.0, 2.0, ""), (3, 0, "SPEAKER_00", 0.0, 1.0, None),
    ]
    return spark.createDataFrame([(*r, "collections") for r in rows], "call_id long, segment_id int, speaker string, start_s double, end_s double, text string, call_type string").repartition(3)


def test_checks_and_signals_of_parts_over_segments(spark):
    facts = compliance.call_facts(said_in_parts(spark), vocabulary.pack(spark)).select("call_id", compliance.every_check().alias("checks"), fraud.every_signal().alias("signals"))
    found = {r["call_id"]: r for r in facts.collect()}
    failed = lambda k: sorted((c["check_name"], c["segment_id"], c["evidence"]) for c in found[k]["checks"] if not c["passed"])
    opening = [(n, None, None) for n in ("caller_identification", "purpose_disclosure", "recording_consent")]
    assert failed(1) == sorted([*opening, ("ignored_end_request", 1, "stop calling me"), ("prohibited_threats", 0, "send our people to your house")])
    assert failed(2) == opening and failed(3) == [("agent_domination", None, None), *opening]
    assert [tuple(s) for s in found[2]["signals"]] == [("credential_request", 0, 0.75, "otp")]
    assert not found[3]["signals"]


def test_segments_are_shuffled_once_for_checks_and_signals(spark):
    facts = compliance.call_facts(said_in_parts(spark), vocabulary.pack(spark))
    plan = facts.select("call_id", F.inline(compliance.every_check()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(call_id") == 1 and "SortMergeJoin" not in plan
    assert plan.count("Sort [call_id") == 1

"""Near-duplicates: repeated doc_ids, and recall on whole tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxloom.llm import minhash, queries, repeats, rlz

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(sets: list[frozenset]) -> list[tuple[int, int]]:
    """All pairs of different sets of similarity 0.75 or more: they share one of the rarest shingles of each."""
    times = Counter(s for x in sets for s in x)
    holders: dict = {}
    for k, x in enumerate(sets):
        for s in sorted(x, key=lambda s: (times[s], s))[: len(x) - -(-3 * len(x) // 4) + 1]:
            holders.setdefault(s, []).append(k)
    near = {(a, b) for h in holders.values() for a in h for b in h if a < b and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b]))}
    return [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def components(rows: list[tuple]) -> dict:
    """doc_id -> smallest doc_id reachable, for rows (doc_id, text); texts of one doc_id are tied."""
    own = [(d, shingles(t)) for d, t in rows if d is not None]
    sets = list({x for _, x in own if x})
    number = {x: k for k, x in enumerate(sets)}
    near: dict = {}
    for a, b in linked(sets):
        near.setdefault(("set", a), set()).add(("set", b))
        near.setdefault(("set", b), set()).add(("set", a))
    for d, x in own:
        near.setdefault(("doc", d), set())
        if x:
            near[("doc", d)].add(("set", number[x]))
            near.setdefault(("set", number[x]), set()).add(("doc", d))
    label: dict = {}
    for d in sorted({d for d, _ in own}):
        waiting = [("doc", d)]
        while waiting:
            node = waiting.pop()
            if node not in label:
                label[node] = d
                waiting += near[node]
    return {d: c for (kind, d), c in label.items() if kind == "doc"}


@pytest.mark.parametrize("parts", [1, 5])
def test_texts_of_one_doc_id_are_tied(spark, parts):
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(c)), (5, None), (7, near(a)), (8, near(b)), (9, near(c)), (8, near(b)), (20, " ".join(d)), (21, near(d)), (21, " ".join(e)), (3, near(e)), (30, ""), (30, " ".join(e)), (None, " ".join(a)), (40, "few words"), (41, "few words"), (41, "other words")]
    found = minhash.near_duplicates(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string").repartition(parts)).collect()
    assert len(found) == len(rows)
    want = components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    assert (want[7], want[8], want[9], want[20], want[30], want[41]) == (5, 5, 5, 3, 3, 40)
    assert Counter(r["kept"] for r in found) == Counter((d is None or want[d] == d) for d, _ in rows)


@pytest.mark.parametrize("folder", ["sf0.1"])
def test_no_link_of_the_given_table_is_lost(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    want = components([tuple(r) for r in table.collect()])
    found = queries.op3_near_duplicates(spark, f"/root/testdata/{folder}").collect()
    wrong = [r["doc_id"] for r in found if want[r["doc_id"]] != r["component_id"]]
    assert (len(found), wrong) == (len(want), [])


def test_a_dense_block_gives_pairs_in_proportion_to_its_documents():
    n = 300
    same = np.zeros((n, minhash.SKETCH // 64), np.uint64)
    keys = np.tile(np.arange(32, dtype=np.int64), (n, 1))
    columns = {"key": np.full(n, 7), "i": np.zeros(n, np.int32), "j": np.zeros(n, np.int32), "block": np.zeros(n, np.int32), "band": np.zeros(n, np.int32), "id": np.arange(n), "n": np.full(n, 50), "label": np.arange(n)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()} | {"bands": pa.array(keys.tolist(), pa.list_(pa.int64())), "sketch": pa.array([x.tobytes() for x in same], pa.binary())})
    rows = {every: pa.Table.from_batches(minhash._compare(75, every)(iter([batch]))) for every in (False, True)}
    assert rows[True].num_rows == n * (n - 1) // 2 and not any(rows[True]["more"].to_pylist())
    some = rows[False]
    assert some.num_rows <= minhash.SPARE * n and all(some["more"].to_pylist())
    assert set(some["a"].to_pylist()) | set(some["b"].to_pylist()) == set(range(n))  # each component has a pair


def test_components_go_on_from_labels(spark):
    rng = random.Random(3)
    first, more = ([tuple(sorted(rng.sample(range(200), 2))) for _ in range(60)] for _ in range(2))
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["label"] for r in minhash.joined_on(minhash.components(frame(first)), frame(more)).collect()}
    assert got == {r["node"]: r["label"] for r in minhash.components(frame(first + more)).collect()}


def test_a_single_closer_look_writes_no_texts(spark, monkeypatch):
    names, plain = [], repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, name: (names.append(name), plain(df, name))[1])
    shared = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"a{k} {shared} b{k}", k * 2) for k in range(4)], "doc_id long, text string, more int")
    found = {r["doc_id"]: (r["kept"], r["row"]["text"], r["row"]["more"]) for r in rlz.parse(spark, docs, keep=True).collect()}
    assert found == {k: (f"a{k} {shared} b{k}" if k == 0 else f"a{k} b{k}", f"a{k} {shared} b{k}", k * 2) for k in range(4)}
    assert "texts" not in names  # it would be a second copy of what is looked at again

"""Conversation repair, Merkle manifest and exact search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import merkle, queries, repair, topk

DATA = "/root/testdata/sf0.001"
FULL = re.compile(r"(s?(ua)+)?\Z")
BLANK = " \t\n\v\f\r"


def damage(rows: list[tuple]) -> list[tuple]:
    """(turn, role, text) of one conversation's rows after damage, in order."""
    out = []
    space = lambda x: " " if x is None else str(x)
    order = lambda r: (r[1] is not None, r[1] or 0, space(r[2]), hashlib.md5(space(r[3]).encode()).hexdigest())
    for conv_id, turn, role, text in sorted(rows, key=order):
        code, role, text = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20, space(role), space(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def by_hand(rows: list[tuple]) -> tuple:
    """The contract's row, by a search over all edits with whole audit strings."""
    rows = damage(rows)
    turns = {t for t, _, _ in rows if t is not None}
    seen, faults = set(), []
    for _, role, text in rows:
        tight = text.strip(BLANK)
        faults.append("blank" if not tight else "duplicate" if (role, text) in seen else "truncated" if tight[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    waiting = [(0, 0, "", "", ())]
    final, known = None, {}
    while waiting:
        waiting.sort(key=lambda x: (x[0], x[2]))
        cost, at, audit, roles, lines = waiting.pop(0)
        key = (at, roles if len(roles) < 2 else roles[-1] + "+")
        if key in known:
            continue
        known[key] = cost
        if at == len(rows) and FULL.match("" if not roles else "s" if roles == "s" else roles):
            final = (cost, audit, lines)
            break
        step = lambda price, place, edit, role, line: waiting.append((cost + price, place, audit + edit, roles + role, (*lines, line) if line is not None else lines)) if re.match(r"s?(ua)*u?\Z", roles + role) else None  # noqa: E731, B023
        for role in ("user", "assistant"):
            step(3, at, "I", role[0], f"{role}:")
        if at < len(rows):
            _, role, text = rows[at]
            step(4, at + 1, "D", "", None)
            if faults[at] not in ("blank", "duplicate"):
                late = 3 * (faults[at] == "truncated")
                if initials[at] in ("s", "u", "a"):
                    step(late, at + 1, "K", initials[at], f"{role}:{text}")
                for new in ("user", "assistant"):
                    step(3 + late, at + 1, "R", new[0], f"{new}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, final[0], final[1], hashlib.sha256("\n".join(final[2]).encode()).hexdigest()


def conversations(n: int, longest: int, seed: int) -> list[tuple]:
    """Rows with wrong and null roles, nulls, ties, repeats and missing turns."""
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "sales"])
            text = rng.choice(["Hello.", "and so", " \n", "", None, f"No {turn}!", f"Well {turn}", "Äh? ", "a.b"])
            rows += [(conv, None if rng.random() < 0.1 else turn + 2 * (turn > 3), role, text)] * (2 if rng.random() < 0.05 else 1)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, code int"


@pytest.mark.parametrize("segment", [3, 4096])
def test_repair_by_hand(spark, segment):
    rows = conversations(70, 9, 1) + conversations(1, 60, 7)
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    want = {c: by_hand([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(frame.repartition(5), segment).collect()}
    assert found == want
    assert max(len(v[6]) for v in want.values()) > 12


def test_repair_of_the_given_table_and_of_none(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_repair(spark, DATA).collect()}
    assert found == {c: by_hand([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert repair.repaired(table.limit(0)).collect() == []


def test_dropped_conversation_has_zeros(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repaired(spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows: list[tuple]) -> list[tuple]:
    """The contract's rows for (doc_id, source, lang, n_chars, text)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha(*map(field, r))

    def tree(nodes: list[str]) -> list[list[str]]:
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def steps(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
        out = []
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            out.append((run[: at % 8], run[at % 8 + 1 :]))
            at //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(groups[x]):
            path = steps(trees[x], at) + steps(top, k)
            lower = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf((*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))) if lower else leaf(r)
            for a, b in path:
                node = sha(*a, node, *b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(*[d for a, b in path for d in a + b]), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_by_hand(spark):
    rng = random.Random(2)
    langs = [None, "", "en", "é", "~", *[f"x{k}" for k in range(9)]]
    rows = [(k, rng.choice(["s", None]), "en" if k < 700 else langs[k % 14], rng.choice([None, k]), rng.choice(["Abc Ü", "abc", "", None, "Q" * 3000])) for k in range(800)]
    rows += [rows[3], rows[3], (None, "s", "en", 1, "A"), (5, "s", "en", 1, "b"), (7, "t", "alone", 0, "A")]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, branch string")
    found = sorted(map(tuple, merkle.manifest(spark, frame.repartition(7)).collect()), key=str)
    assert found == manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_small_manifests(spark, n):
    rows = [(k, "s", "en", 1, "Text") for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.manifest(spark, frame).collect()), key=str) == manifest(rows)


def test_paths_of_some_leaves(spark):
    rows = spark.range(200).select(F.lit("").alias("branch"), F.col("id").alias("rank"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), merkle.height(F.lit(200)).alias("height"))
    records, top = merkle.build(rows, 1)
    start = top.select("branch", F.lit(0).cast("long").alias("at"), "digest", F.lit(3).alias("height"), F.array().cast(merkle._PATH).alias("path"))
    found = merkle.descend(start, records, 3, 0, rows.where("rank in (0, 77, 199)")).select("at", "digest", merkle.fold(F.col("digest"), F.col("path")).alias("root")).collect()
    root = top.first()["digest"]
    assert sorted((r["at"], r["digest"], r["root"]) for r in found) == [(k, sha(str(k)), root) for k in (0, 77, 199)]


def nearest_by_hand(rows: list[tuple], every: int, k: int) -> list[tuple]:
    """(query_id, rank, vec_id, score) by comparing every query with every other row."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(good) if a != b)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(n: int, width: int, seed: int) -> list[tuple]:
    """Rows with ties, copies, near copies, short, empty and unusable vectors, repeated and missing ids."""
    rng = random.Random(seed)
    rows = [(k, [rng.choice([0.0, rng.gauss(0, 1), rng.randint(-2, 2) / 4]) for _ in range(width)]) for k in range(n)]
    rows += [(n + k, rows[k % min(n, 7)][1]) for k in range(n // 2)]
    rows += [(10, rows[-1][1]), (10, rows[1][1]), (None, rows[0][1]), (2 * n, None), (2 * n + 1, [None, 1.0]), (2 * n + 2, [math.nan] * width), (2 * n + 3, [math.inf]), (2 * n + 4, [1.5]), (5 * n, []), (10 * n, [0.0] * width)]
    return rows


@pytest.mark.parametrize(("n", "width", "block"), [(120, 6, 16), (120, 3, 4096), (3, 2, 4)])
def test_nearest_by_hand(spark, n, width, block):
    rows = vectors(n, width, n + width)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, query string").repartition(3)
    assert sorted(map(tuple, topk.nearest(spark, frame, every=5, k=4, block=block, group=7).collect())) == nearest_by_hand(rows, 5, 4)


def test_nearest_of_few(spark):
    frame = spark.createDataFrame([(50, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert topk.nearest(spark, frame).collect() == []
    assert topk.nearest(spark, frame.limit(0)).collect() == []
    both = frame.unionByName(spark.createDataFrame([(7, [-2.0, 0.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.nearest(spark, both).collect()] == [(50, 1, 7, -131072)]


def test_search_stops_early():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.gamma(0.1, size=(4096, 8))).astype(np.int64)
    lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    scored = []
    for q in x[:20]:
        best = topk.Best(6, -(1 << 63))
        scored.append(topk.threshold_search(x, lists, np.arange(4096), np.ones(4096, np.int32), q, best))
        want = sorted(zip((-(x @ q)).tolist(), range(4096), strict=True))[:6]
        assert list(zip((-best.score).tolist(), best.id.tolist(), strict=True)) == want
    assert np.median(scored) < 1024


def test_components_beyond_doubles():
    x = np.array([[1 << 31, 1], [1 << 31, 2], [-(1 << 31), 3]], np.int64)
    best = topk.Best(2, -(1 << 63))
    topk.threshold_search(x, np.argsort(x, axis=0, kind="stable").T.astype(np.int32), np.arange(3), np.ones(3, np.int32), np.array([(1 << 31) - 1, 1], np.int64), best)
    assert best.id.tolist() == [1, 0]
    assert best.score.tolist() == [((1 << 31) - 1 << 31) + 2, ((1 << 31) - 1 << 31) + 1]


def test_nearest_never_broadcasts_queries_for_each_block(spark, monkeypatch):
    """Queries copied for all blocks grow with the square of the table: a task gets some blocks and some groups by a shuffle, and answers once for all its blocks."""
    rows, plans, answers = vectors(150, 4, 5), [], []
    kept = topk.written

    def seen(df, name):
        out = kept(df, name)
        if name == "found":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            answers.append(out.groupBy("query").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(topk, "written", seen)
    monkeypatch.setattr(topk, "TASKS", 3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.nearest(spark, frame, every=5, k=4, block=16, group=7).collect())) == nearest_by_hand(rows, 5, 4)
    assert len(plans) == 2
    assert "Broadcast" not in plans[0]
    assert "Join [block" not in plans[1]  # floors may be broadcast, a number for each query
    assert answers[1] <= 5  # of about ten blocks


def test_block_of_any_components():
    """Components and places are kept in as few bytes as hold them, and scores are exact in each."""
    rng = np.random.default_rng(8)
    for most in (200, 1 << 20, 1 << 45):
        x = rng.integers(-most, most, (50, 3))
        raw = np.frombuffer(topk._packed(x, *topk._COMPONENTS), np.uint8)
        assert len(raw) == 150 * (2 if most == 200 else 4 if most == 1 << 20 else 8)
        assert (topk._unpacked(raw, 150, *topk._COMPONENTS).reshape(50, 3) == x).all()
        block = topk.Block(x, np.argsort(x, axis=0, kind="stable").T, np.arange(50), np.ones(50, np.int32))
        q, best = rng.integers(-200, 200, 3), topk.Best(4, -(1 << 63))
        block.search(q, best, 7)
        want = sorted(zip((-(x @ q)).tolist(), range(50), strict=True))[:4]
        assert list(zip((-best.score).tolist(), best.id.tolist(), strict=True)) == want
        assert (best.row == best.id + 7).all()

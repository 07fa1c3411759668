"""Corpus operators against brute force, round trips and awkward rows."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import decontam, html_extract, langid, licenses, minhash, packing, queries, repeats, rlz, suffix_dedup, token_store, webp
from voxloom.llm.common import shared_dir, utf8, written
from voxloom.llm.tokens import encoder

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_rows() -> list[tuple]:
    """Copies, near copies, shared passages, awkward white space, other scripts, empty and null rows, a repeated row."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(90), text(150)
    texts = [text(200), base, base, base + " end", base.replace(" ", "  ", 1), text(40) + "\n" + passage + " " + text(30), passage + " " + text(50), text(20) + " " + passage, "", None, " \n\t ", "short text", "short text", "ab " * 600, "it's  '  s <|endoftext|> z", "Привет мир 你好", "x" * 3000, text(5000), "Released under the MIT License."]
    rows = [(k, t, None if k % 7 == 0 else "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, passage + " " + text(10), "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(made_rows(), SCHEMA).withColumn("rid", F.lit(1)).withColumn("key", F.lit("x")), "docs")


def collected(frame, *key: str) -> dict:
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in frame.collect()}


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_suffix_dedup(spark, docs):
    rows = made_rows()
    raw = [(r[1] or "").encode() for r in rows]
    times = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    want = Counter()
    for row, b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if times[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[(row[0], len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark, docs).collect()) == want


def test_levels_merge_geometrically(spark):
    index = suffix_dedup.SuffixLevels()
    found = []
    for k in range(4):
        found = index.add(spark.createDataFrame([(k,), (k + 1,), (100 + k,)], "core long"))
    assert list(index.levels) == [2]
    assert sorted(r["core"] for f in found for r in f.collect()) == [3]


def test_substring_dedup(spark, docs):
    rows = made_rows()
    first: dict = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(r[1] or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), r[0])
    want = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[k : k + 50])] < r[0]:
                gone[k : k + 50] = [True] * 50
        want[(r[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())] += 1
    found = rlz.parse(spark, docs, keep=True).collect()
    assert Counter(tuple(r)[:4] for r in found) == want
    assert all(r["row"]["key"] == "x" for r in found)


def removed_words(texts: list[str]) -> dict[int, tuple[int, str]]:
    """By the definition, for texts in order of doc_id: how many words go, and what is kept."""
    first, out = {}, {}
    for k, text in enumerate(texts):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), k) < k:
                gone[i : i + 50] = [True] * 50
        out[k] = (sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup_of_a_passage_that_a_block_repeats(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = text(60), text(70)
    block = f"{text(80)} {other} {text(80)}"
    texts = [f"{text(40)} {passage} {text(40)}", f"{text(30)} " + " ".join([passage] * 4), f"{text(50)} {other} {text(50)}", f"{block} {text(20)} {block} {text(20)} {block}", f"{text(60)} {passage} {passage} {text(10)} {other}"]
    rows = [*enumerate(texts), (3, texts[3])]
    found = rlz.parse(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    want = removed_words(texts)
    assert [(r["doc_id"], r["n_removed"], r["kept"]) for r in found if (r["n_removed"], r["kept"]) != want[r["doc_id"]]] == []


def test_runs_of_long_texts_beside_others(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 100)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(n)) for n in (70, 350, 20, 100, 249, 101, 60)]

    class Batches:
        def __init__(self, rows: list[int]):
            self.batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(rows, pa.int64()), pa.array([texts[k] for k in rows])], ["rid", "doc_id", "text"])

        def mapInArrow(self, make, schema):  # noqa: N802
            return [tuple(r.values()) for b in make(iter([self.batch])) for r in b.to_pylist()]

    together = repeats.first_runs(Batches([*range(7)]), repeats.WORDS)
    assert sorted(together) == sorted(r for k in range(7) for r in repeats.first_runs(Batches([k]), repeats.WORDS))
    windows = Counter((doc_id, i) for _, _, _, doc_id, at, n, _ in together for i in range(at, at + n))
    assert windows == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t.split()) - 49))


def test_near_duplicates(spark, docs):
    rows = {r[0]: r[1] for r in made_rows() if r[0] is not None}
    sets = {k: shingles(t) for k, t in rows.items()}
    label = {k: k for k in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    found = minhash.near_duplicates(spark, docs).collect()
    assert len(found) == len(made_rows())
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_a_dense_family(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"n{rng.random()}"
        rows.append((k, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    label = list(range(150))
    moved = True
    while moved:
        moved = False
        for a in range(150):
            for b in range(150):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    found = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(label))


def test_contained_items(spark, docs):
    rows = made_rows()
    long = rows[17][1].split()
    items = [(1, " ".join(long[1000:1040])), (2, "short text"), (3, None), (4, " ".join([*long[50:80], "nowhere"])), (5, "never to be found in any of them")]
    found = collected(decontam.containments(spark, docs, spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id")
    assert set(found) == {(17, 1), (17, 4), (11, 2), (12, 2)}
    assert found[17, 4]["n_found"] == 26 and found[17, 4]["n_shingles"] == 27
    assert decontam.containments(spark, docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_items_that_share_an_id_or_have_none(spark, docs):
    long = made_rows()[17][1].split()
    items = [(1, "a text that is nowhere at all"), (1, " ".join(long[1000:1040])), (1, " ".join([*long[50:80], "nowhere"])), (None, "short text"), (None, " ".join(long[200:240])), (2, None)]
    found = collected(decontam.containments(spark, docs, spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id")
    assert {k: (r["n_found"], r["n_shingles"], r["containment"]) for k, r in found.items()} == {(17, 1): (36, 36, 1.0), (17, None): (36, 36, 1.0), (11, None): (1, 1, 1.0), (12, None): (1, 1, 1.0)}


def test_tokens_equal_the_library(docs):
    texts = [r[1] or "" for r in made_rows()]
    ids, offsets = encoder(TOKENIZER).encode(*utf8(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder(TOKENIZER).tokenizer.encode(text, add_special_tokens=False).ids


def test_token_table_round_trip(spark, docs):
    texts = sorted((r[:2] for r in made_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = sorted(token_store.token_table(spark, docs, TOKENIZER, 2).collect(), key=lambda r: r["start"])
    start = 0
    for (doc_id, text), r in zip(texts, found, strict=True):
        ids = np.array([*encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_lookup(tmp_path):
    path = str(tmp_path / "a.sst")
    with open(path, "wb") as out:
        table = token_store.TableWriter(out)
        for k in range(0, 5000, 2):
            table.add(token_store.key_of(k), np.arange(k % 90, dtype=np.uint32) + 70_000 * (k % 7 == 0))
        table.close()
    with pa.OSFile(path) as file:
        reader = token_store.TableReader(file)
        assert len(reader.index) > 1 and reader.docs == 2500
        assert reader.get(token_store.key_of(4998))[0].tolist() == list(range(70_000, 70_000 + 4998 % 90))
        assert reader.get(token_store.key_of(7)) == []
        assert sum(reader.may_have(token_store.key_of(k)) for k in range(1, 5000, 2)) < 150


def test_packing(spark, docs):
    found = packing.pack(docs, TOKENIZER, 1, 256).toPandas()
    assert (found.groupby("sequence_id").length.sum() <= 256).all()
    for _, piece in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (piece.length.cumsum() - piece.length == piece.offset).all()
    per = Counter({k: n for k, n in ((r[0], len(encoder(TOKENIZER).tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in made_rows()) if k is not None and k != 6})
    assert found[found.doc_id.isin(per)].groupby("doc_id").length.sum().to_dict() == dict(per)
    assert found.length.sum() > 0 and (found.groupby("sequence_id").length.sum() < 256).sum() <= 4


def test_best_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    for _ in range(200):
        levels = rng.integers(0, 4, 33)
        levels[[0, 32]] = 0
        size = int(rng.integers(1, 32))
        costs = {}
        for h in [0, *(h for h in range(1, 33 - size) if levels[h])]:
            after = levels.copy()
            if h:
                after[h] -= 1
            if h + size < 32:
                after[h + size] += 1
            costs[h] = (after**2).sum()
        assert costs[packing.best_level(levels, size)] == min(costs.values())


def test_language_spans(spark, docs):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden with that thing", "en"), ("der garten und das haus ist nicht groß", "de")] * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(0, "the garden and the thing with that house"), (1, "der garten ist nicht das haus"), (2, " 123 ?"), (3, None), (4, "Привет"), (5, "the house with the garden and that thing der garten und das haus ist nicht groß")]
    found = collected(langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model), "doc_id")
    assert [found[k]["lang_pred"] for k in range(4)] == ["en", "de", "und", "und"]
    assert found[4]["score"] == 0 and found[4]["lang_pred"] in ("en", "de")
    assert [s["lang"] for s in found[5]["spans"]] == ["en", "de"]
    assert langid.identify(docs, model, keep=True).count() == len(made_rows())


def test_viterbi_equals_search():
    rng = np.random.default_rng(1)
    for _ in range(60):
        scores = rng.normal(0, 3, (6, 2))
        paths = [[int(b) for b in f"{k:06b}"] for k in range(64)]
        cost = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert cost(langid.viterbi(scores, 2.5).tolist()) == pytest.approx(max(map(cost, paths)))


def test_licenses(spark):
    texts = [(1, "words\nReleased under the MIT License.\nmore"), (2, "licensed under cc by-nc 4.0"), (3, "License"), (4, None), (5, "x\n\n" + licenses.TEMPLATES["isc"][0].replace(" ", "\n", 4) + "\n\ny")]
    found = collected(licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id")
    assert [found[k]["license"] for k in range(1, 6)] == ["mit", "cc-by-nc-4.0", None, None, "isc"]


def windows_by_force(text: str, templates: dict[str, list[str]], percent: int) -> dict[str, float]:
    words, found = licenses._WORD.findall(text.lower()), []
    for name, texts in templates.items():
        for template in texts:
            b, size = licenses.bigrams(template), len(licenses._WORD.findall(template.lower()))
            for p in range(len(words) - size + 1):
                own = set(zip(words[p : p + size], words[p + 1 : p + size], strict=False))
                if 200 * len(own & b) >= percent * (len(own) + len(b)):
                    found.append((name, p, size, len(own & b), 2 * len(own & b) / (len(own) + len(b))))
    best: dict[str, float] = {}
    for name, p, size, common, dice in found:
        if not any(n != name and c > common and q <= p + size // 2 < q + s for n, q, s, c, _ in found):
            best[name] = max(best.get(name, 0.0), dice)
    return best


def test_license_windows_as_by_force(monkeypatch):
    templates = {"one": ["a b c d e", "f g a b"], "two": ["a b c d e f g", "e e a"], "three": ["b c d"]}
    matcher = licenses.Matcher(templates, licenses.THRESHOLD)
    random = np.random.default_rng(5)
    texts = [" ".join(random.choice(list("abcdefg"), random.integers(0, 60))) for _ in range(150)]
    texts += [" x ".join(random.choice(["a b c d e", "a b c d e f g", "b c d", "f g a b", "e e a", "y"], 30)) for _ in range(20)]
    for piece in (licenses.PIECE, 7):
        monkeypatch.setattr(licenses, "PIECE", piece)
        for text in texts:
            for percent in (60, 90, 100):
                assert matcher.within(text, percent) == pytest.approx(windows_by_force(text, templates, percent))


def test_licenses_inside_longer_text(spark):
    bsd = licenses.TEMPLATES["bsd-3-clause"][2]
    second, third = bsd.index("1."), bsd.index("3.")
    texts = [
        (1, "This small tool, which is Licensed under the MIT License. and was written by several people, reads files."),
        (2, f"{bsd[:second]}\n\n{bsd[second:third]}\n\nThis ends it"),
        (3, f"{bsd[:second]}\n\n{bsd[second:third]}\n\n{bsd[third:]}\n\nThis ends it"),
        (4, "licensed under the terms that the MIT and others once called License"),
        (5, " ".join(map(str, range(70000))) + " " + licenses.TEMPLATES["gpl-2.0"][2] + " and so on"),
    ]
    found = collected(licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id")
    assert [found[k]["license"] for k in range(1, 6)] == ["mit", "bsd-2-clause", "bsd-3-clause", None, "gpl-2.0"]
    assert found[5]["licenses"] == ["gpl-2.0"]


def test_licenses_by_tag_and_denied(spark, tmp_path):
    no = "not licensed under the Apache License, Version 2.0."
    texts = [
        (1, "/* SPDX-License-Identifier: MIT */\nint x;", "mit"),
        (2, "# spdx-license-identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR Apache-2.0.", "apache-2.0,gpl-2.0"),
        (3, "SPDX-License-Identifier: see the file\nMIT", ""),
        (4, "This article is " + no, ""),
        (5, "It is " + no, ""),
        (6, "It is\n" + no + "\n\nIt isn't licensed under the MIT License.\nReleased under the MIT License.", "mit"),
        (7, " ".join(["x"] * (licenses.PIECE - 1)) + " " + no, ""),
        (8, "Get it. The code is licensed under the terms of the MIT license, says a page of ours on the net", "mit"),
        (9, licenses.TEMPLATES["mpl-2.0"][2], "mpl-2.0"),
        (10, "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "bsl-1.0"),
        (11, None, ""),
        (12, "SPDX-License-Identifier:", ""),
    ]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    found = collected(licenses.scan(docs), "doc_id")
    assert {k: ",".join(r["licenses"]) for k, r in found.items()} == {k: names for k, _, names in texts}
    import duckdb

    con, few = duckdb.connect(), docs.where("doc_id <> 7").toPandas()
    few.to_parquet(tmp_path / "documents.parquet")
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    told = con.sql(queries.oracle_sql()["op10_licenses"]).df()
    assert {r.doc_id: (r.licenses, r.n_matches) for r in told.itertuples()} == {k: (",".join(r["licenses"]), r["n_matches"]) for k, r in found.items() if k != 7}


def test_standard_notices_and_texts_of_licenses():
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)

    def best(text: str) -> str | None:
        found = [(-dice, name) for block in licenses.blocks(text) for name, dice in matcher.of(block)]
        return min(found)[1] if found else None

    for name, texts in licenses.TEMPLATES.items():
        assert [best(t) for t in texts] == [name] * len(texts)
    gnu = "This {} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    assert [best(gnu.format(*x)) for x in (("program", "", "2"), ("program", "", "3"), ("library", "Lesser ", "2.1"), ("library", "Lesser ", "3"))] == ["gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0"]
    intro = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    items = ["1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following disclaimer in the\n   documentation and/or other materials provided with the distribution.", "3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission."]
    assert best("\n".join([intro, *items[:2]])) == "bsd-2-clause"
    assert best("\n".join([intro, *items])) == best("\n\n".join([intro, *items])) == "bsd-3-clause"


def test_pages():
    network = html_extract.train(html_extract.training_pages())
    held_out = html_extract.training_pages(100, 99)
    blocks = [html_extract.blocks_of(p) for p, _ in held_out]
    right = [bool((a == np.array(b)).all()) for a, (_, b) in zip(html_extract.label(network, blocks), held_out, strict=True)]
    assert np.mean(right) > 0.95
    assert [len(x) for x in html_extract.label(network, [[], html_extract.blocks_of("<p>a")])] == [0, 1]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = html_extract.Network.new(rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = html_extract.padded([rng.normal(size=(4, html_extract.SIZE)), rng.normal(size=(2, html_extract.SIZE))])
    x, labels = x.astype(np.float64), rng.integers(0, 2, mask.shape).astype(np.float64)

    def loss() -> float:
        z = net.logits(x, mask)[0]
        return float(((np.log1p(np.exp(z)) - labels * z) * mask).sum() / mask.sum())

    grads = net.gradients(x, mask, labels)
    for name in ("xf", "hb", "cf", "o", "b"):
        place = tuple(rng.integers(0, n) for n in net.w[name].shape)
        before = net.w[name][place]
        net.w[name][place] = before + 1e-3
        up = loss()
        net.w[name][place] = before - 1e-3
        down = loss()
        net.w[name][place] = before
        assert grads[name][place] == pytest.approx((up - down) / 2e-3, abs=1e-4)


def test_misnested_pages():
    found = html_extract.blocks_of('<p>a <b>b<p>c &amp; d<br>e<script>x("</p>")</script><li>f<li>g<div>h</p></body>i<!-- j')
    assert [b.text for b in found] == ["a b", "c & d e", "f", "g", "h", "i"]
    assert html.unescape("&amp;") == "&"


def test_pages_without_an_end_of_head():
    def texts(page: str) -> list[str]:
        return [b.text for b in html_extract.blocks_of(page)]

    head = "<html><head><meta charset=utf-8><title>t</title><style>s</style>\n"
    for start in ("<body>", "<div>", "<p>", "", "<noscript>n</noscript><script>x</script><p>", "<noscript>n<body>"):
        assert texts(head + start + "a<p>b") == ["a", "b"], start
    assert texts(head + "<noscript><p>n</noscript><template><p>u</template><link rel=x></head><body>a") == ["a"]
    assert html_extract.blocks_of(head + "<body><p>a") == html_extract.blocks_of(head + "</head><body><p>a")


def test_all_words_of_a_long_block_count():
    ends = "a b c " * 40

    def words(text: str) -> list[float]:
        return html_extract.vectors([html_extract.Block(("p",), text, 0)])[0, html_extract.PATH_SIZE : html_extract.PATH_SIZE + html_extract.WORD_SIZE].tolist()

    sums = np.zeros(html_extract.WORD_SIZE, np.float32)
    for w in f"{ends}{'middle ' * 30}{ends}".split():
        k, sign = html_extract._hashed(w, html_extract.WORD_SIZE)
        sums[k] += sign
    assert words(f"{ends}{'middle ' * 30}{ends}") == pytest.approx((sums / np.sqrt(sums @ sums)).tolist())
    assert words(f"{ends}{'middle ' * 30}{ends}") != words(f"{ends}{'centre ' * 30}{ends}")


def test_media_round_trip(spark, docs):
    found = Counter((r["doc_id"], r["payload_sha256"]) for r in webp.payloads(webp.media(docs)).collect())
    want = Counter()
    for r in made_rows():
        b = (r[1] or "").encode()
        want[(r[0], hashlib.sha256(b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))).hexdigest())] += 1
    assert found == want


def _stream(pixels: np.ndarray, transforms: list[tuple], cache_bits: int = 0, references: bool = False) -> bytes:
    """A stream with transforms, colour cache and back-references, as plainly as can be written."""
    height, width = pixels.shape
    out = webp.Writer()
    webp.put_start(out, width, height)
    for kind, bits, values in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            out.put(bits - 2, 3)
            _pixels(out, values)
            pixels = (webp._predictor if kind == webp.PREDICTOR else webp._cross_colour)(pixels, values, bits, -1)
        elif kind == webp.SUBTRACT_GREEN:
            pixels = webp._green(pixels, -1)
        else:
            out.put(len(values) - 1, 8)
            c = webp._channels(values)
            _pixels(out, webp._joined(np.diff(c, axis=0, prepend=0))[None])
            index = np.array([[int(np.flatnonzero(values == v)[0]) for v in row] for row in pixels])
            n, each = 1 << bits, 8 >> bits
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % n))).reshape(height, -1, n)
            pixels = 0xFF000000 | ((index << (each * np.arange(n))).sum(2) << 8)
    out.put(0, 1)
    _pixels(out, pixels, cache_bits, references, main=True)
    return out.bytes()


def _pixels(out: webp.Writer, pixels: np.ndarray, cache_bits: int = 0, references: bool = False, main: bool = False) -> None:
    flat, width = pixels.ravel().tolist(), pixels.shape[1]
    symbols, cache, at = [], [None] * (1 << cache_bits), 0
    keep = lambda v: cache.__setitem__(((webp.CACHE_MULTIPLIER * v) & 0xFFFFFFFF) >> (32 - cache_bits), v) if cache_bits else None
    while at < len(flat):
        run = 0
        while references and at >= width and at + run < len(flat) and flat[at + run] == flat[at + run - width] and run < 4:
            run += 1
        v = flat[at]
        if run == 4:
            symbols.append(("copy", run))
        elif cache_bits and cache[((webp.CACHE_MULTIPLIER * v) & 0xFFFFFFFF) >> (32 - cache_bits)] == v:
            symbols.append(("cache", ((webp.CACHE_MULTIPLIER * v) & 0xFFFFFFFF) >> (32 - cache_bits)))
            run = 1
        else:
            symbols.append(("literal", v))
            run = 1
        for v in flat[at : at + run]:
            keep(v)
        at += run
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    counts = [np.zeros(280 + (1 << cache_bits if cache_bits else 0), np.int64), *(np.zeros(256, np.int64) for _ in range(3)), np.zeros(40, np.int64)]
    for kind, v in symbols:
        if kind == "literal":
            for k, channel in enumerate(((v >> 8) & 255, (v >> 16) & 255, v & 255, v >> 24)):
                counts[k][channel] += 1
        else:
            counts[0][256 + 3 if kind == "copy" else 280 + v] += 1
            counts[4][0] += kind == "copy"
    codes = []
    for c in counts:
        if not c.any():
            c[0] = 1
        lengths = webp.code_lengths(c)
        webp.put_lengths(out, lengths)
        code = webp.Code(lengths)
        codes.append({int(s): (webp.reverse(int(x), int(n)), int(n)) if code.single is None else (0, 0) for s, x, n in zip(code.symbols, code.codes(), code.lengths, strict=True)})
    for kind, v in symbols:
        if kind == "literal":
            for k, channel in enumerate(((v >> 8) & 255, (v >> 16) & 255, v & 255, v >> 24)):
                out.put(*codes[k][channel])
        elif kind == "copy":
            out.put(*codes[0][256 + 3])
            out.put(*codes[4][0])
        else:
            out.put(*codes[0][280 + v])


def test_decoder_inverts_every_transform():
    rng = np.random.default_rng(2)
    photo = rng.integers(0, 1 << 32, (9, 13))
    photo[4:] = photo[:5] & 0xFFF0F0F0
    for mode in range(14):
        modes = np.full((3, 4), mode << 8)
        assert (webp._joined(webp.decode_stream(_stream(photo, [(webp.PREDICTOR, 2, modes)])).astype(np.int64)) == photo).all()
    factors = rng.integers(0, 1 << 24, (3, 4))
    both = [(webp.PREDICTOR, 2, rng.integers(0, 14, (3, 4)) << 8), (webp.CROSS_COLOUR, 2, factors), (webp.SUBTRACT_GREEN, 0, None)]
    assert (webp._joined(webp.decode_stream(_stream(photo, both, 5, True)).astype(np.int64)) == photo).all()
    for colours in (2, 3, 11, 40):
        table = rng.choice(1 << 32, colours, replace=False)
        art = table[rng.integers(0, colours, (9, 13))]
        art[5] = art[4]
        made = _stream(art, [(webp.PALETTE, webp._bundle_bits(colours), table)], 3, True)
        assert (webp._joined(webp.decode(webp.container([(13, 9, made)]))[0].astype(np.int64)) == art).all()


def test_broken_streams_raise():
    with pytest.raises(ValueError):
        webp.decode(b"no image")
    good = _stream(np.zeros((3, 3), np.int64), [])
    with pytest.raises(ValueError):
        webp.decode_stream(b"\0" + good[1:])


def test_pipeline_stages(spark, docs):
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, kept, DATA), name)
        if name != "packing":
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count()
    empty = written(stage(spark, docs.limit(0), DATA), "empty")
    assert empty.count() == 0


@pytest.mark.parametrize("make", [lambda s, d: suffix_dedup.remove_repeats(s, d), lambda s, d: rlz.parse(s, d), lambda s, d: minhash.near_duplicates(s, d), lambda s, d: token_store.token_table(s, d, TOKENIZER, 2), lambda s, d: packing.pack(d, TOKENIZER, 1), lambda s, d: webp.payloads(webp.media(d)), lambda s, d: licenses.scan(d), lambda s, d: langid.identify(d, langid.fit(d))])
def test_empty_tables(spark, docs, make):
    assert make(spark, docs.limit(0)).count() == 0


def test_items_in_an_empty_table(spark, docs):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontam.containments(spark, docs.limit(0), benchmark).count() == 0


def test_pages_without_html_and_repeated_ones(spark):
    page = "<html><head><title>t</title></head><body><nav><a>Home</a></nav><article>" + "<p>The river rose again in the night and the town kept its lamps lit.</p>" * 3 + "</article></body></html>"
    long = page.replace("</article>", "<p>" + "The clerk wrote each name twice. " * 20_000 + "</p></article>")
    rows = [(1, "a", None), (2, "b", ""), (3, "c", page), (3, "c", page), (4, "d", long), (None, None, "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    network = html_extract.train(html_extract.training_pages())
    found = html_extract.extract(pages, network).collect()
    assert Counter(r["page_id"] for r in found) == Counter(r[0] for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1] == by[2] == by[None] == ""
    assert by[3].startswith("The river rose") and "Home" not in by[3]
    assert by[4].count("The clerk wrote each name twice.") == 20_000
    assert html_extract.extract(pages.limit(0), network).count() == 0


def test_passages_across_the_pieces_of_a_very_long_text(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    words, passage = [word() for _ in range((1 << 20) + 5000)], [word() for _ in range(120)]
    words[(1 << 20) - 60 : (1 << 20) + 60] = passage
    copy = [word() for _ in range(300)] + passage + [word() for _ in range(300)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in rlz.parse(spark, frame).collect()} == {1: 0, 2: 120}
    letters = ["".join(words)[: (1 << 20) + 9000], "".join(copy)]
    at, mark = (1 << 20) - 300, "".join(passage)
    letters[0] = letters[0][:at] + "." + mark + "." + letters[0][at + len(mark) + 2 :]
    frame = spark.createDataFrame([(1, letters[0]), (2, letters[1])], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(spark, frame).collect()}
    assert found == {1: (600, 1), 2: (600, 1)}


def test_which_row_of_a_repeated_id_stays(spark):
    rows = [(5, "b one two three four five six", "en", "s", 1), (5, "a seven eight nine ten eleven", "en", "t", 2), (5, None, "en", "u", 3), (7, "c", None, None, None), (7, "c", "de", None, None), (None, "d", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = [corpus_pipeline.near_duplicates(spark, f, DATA).collect() for f in (frame.orderBy("source"), frame.orderBy(F.desc("source")))]
    assert Counter(map(tuple, found[0])) == Counter(map(tuple, found[1]))
    assert sorted(r["text"] for r in found[0]) == ["a seven eight nine ten eleven", "c", "d"]


def test_sketches_of_long_sets_agree_with_their_similarity():
    rng = np.random.default_rng(2)
    elements = np.sort(rng.integers(0, 1 << 63, 9000, dtype=np.uint64))
    other = np.concatenate([elements[:8000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    same = minhash.SKETCH - np.bitwise_count(minhash.sketch(elements) ^ minhash.sketch(other)).sum(dtype=np.int64)
    assert abs(same / minhash.SKETCH - (0.5 + 8000 / 10000 / 2)) < 0.02
    assert same > minhash.least_agreement(75)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert shared_dir


def _codes(stream: bytes) -> list[webp.Code]:
    bits = webp.Bits(stream)
    webp.read_header(bits)
    assert bits.read(2) == 0
    return [webp.read_code(bits, n) for n in (280, 256, 256, 256, 40)]


def test_texts_are_stored_with_back_references():
    """Equal passages are copied, near and far, over themselves, by up to 4,096 bytes, and never from another frame; both decoders read them."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij अ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    once, noise = prose(200), bytes(rng.randrange(250) for _ in range(2000))
    texts = [b"", b"x", b"a" * 20000, once, once + prose(30) + once, prose(4000), noise, noise + noise, b"ab" * 300 + prose(9), bytes(range(250)) * 30, once]
    padded = [t + b"\xff" * (max(1, -(-len(t) // webp.ROW)) * webp.ROW - len(t)) for t in texts]
    data, offsets = np.frombuffer(b"".join(padded), np.uint8), np.cumsum([0, *map(len, padded)])
    files = webp.text_streams(data, offsets)
    for tiles, payload in zip(files, padded, strict=True):
        assert b"".join(x[..., 2].tobytes() for x in webp.decode(webp.container(tiles))) == payload
    flat = [s for tiles in files for _, _, s in tiles]
    assert np.concatenate(webp.decode_green(flat)).tobytes() == b"".join(padded)
    copies = [_codes(tiles[0][2])[0].symbols.max() >= 256 for tiles in files]
    assert copies == [True, True, True, True, True, True, True, True, True, True, True]
    assert len(files[7][0][2]) < 1.1 * len(files[6][0][2])  # the second half is a copy
    assert len(files[2][0][2]) < 400
    assert [s for _, _, s in files[3]] == [s for _, _, s in files[10]]
    assert not any(len(x) for x in webp.references(np.arange(256, dtype=np.uint8), np.array([0]), np.array([256])))


def test_a_copy_from_before_the_image_is_refused():
    """The last bytes of a stream are its distances: with other ones it may be refused, but never reads another stream's pixels."""
    padded = np.frombuffer(b"abcdefgh" * 72, np.uint8)
    (_, _, good), = webp.text_streams(padded, np.array([0, 576]))[0]
    other = webp.text_streams(np.frombuffer(b"z" * 576, np.uint8), np.array([0, 576]))[0][0][2]
    refused = 0
    for k in range(1, 12):
        bad = good[:-1] + bytes([good[-1] ^ (1 << k % 8)]) if k < 9 else good[: -k + 8]
        try:
            want = webp.decode_stream(bad)[..., 2].ravel()
        except ValueError:
            refused += 1
            with pytest.raises((ValueError, IndexError)):
                webp.decode_green([bad])
        else:
            assert (webp.decode_green([other, bad])[1] == want).all()
    assert refused

"""What each stage of the pipeline keeps, by force over its own input; main texts of the given pages against their article elements."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import public_tokenizers
import pytest
from test_llm import DATA, SCHEMA, WORD, removed_words, shingles

import corpus_pipeline
from voxloom.llm import queries
from voxloom.llm.common import read_table, written
from voxloom.llm.tokens import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def runs(text: str, width: int) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@pytest.fixture(scope="module")
def stages(spark):
    """The given documents with planted ones, and what each stage made of them."""
    docs = read_table(spark, DATA, "documents").select(*COLUMNS)
    long = [r["text"] for r in docs.orderBy("doc_id").collect() if r["text"] and len(WORD.findall(r["text"])) > 160][:8]
    items = [r["text"] for r in read_table(spark, DATA, "benchmark").orderBy("item_id").collect() if r["text"] and len(WORD.findall(r["text"])) > 12]
    last = docs.agg({"doc_id": "max"}).first()[0]
    passage = " ".join(WORD.findall(long[0])[20:90])
    planted = [long[1], long[1], long[2] + " and so it ended", f"{long[3]} {passage} {long[4]}", f"{long[5]} {items[0]} {long[6]}", f"{long[7]}\n{items[1].upper()}", "", None, "12 34 56", " \n"]
    made = spark.createDataFrame([(last + 1 + k, t, "en", "s", len(t or "")) for k, t in enumerate(planted)], SCHEMA)
    kept, found = written(docs.unionByName(made), "planted"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, kept, DATA), name)
        found.append(([r.asDict() for r in kept.collect()], [r.asDict() for r in after.collect()]))
        kept = after
    return dict(zip((name for name, _ in corpus_pipeline.STAGES), found, strict=True)), last


def test_language_keeps_what_has_one(stages):
    before, after = stages[0]["language"]
    text = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == text[r["doc_id"]] and r["lang"] for r in after)
    kept = {r["doc_id"] for r in after}
    assert not any(r["doc_id"] in kept for r in before if not any(c.isalpha() for c in r["text"] or ""))
    clean = [r for r in before if r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert sum(r["doc_id"] in kept for r in clean) >= 0.98 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[0]["near_duplicates"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    label = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(len(pairs)):
        old = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == old:
            break
    assert pairs and sorted(r["doc_id"] for r in after) == sorted(k for k, v in label.items() if k == v)
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_passages_of_earlier_documents_go(stages):
    before, after = stages[0]["substrings"]
    before.sort(key=lambda r: r["doc_id"])
    removed = removed_words([r["text"] for r in before])
    want = {r["doc_id"]: r["text"] if not n else kept for r, (n, kept) in zip(before, removed.values(), strict=True) if not n or kept}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert any(n for n, _ in removed.values()) and all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != {x["doc_id"]: x["text"] for x in before}[r["doc_id"]])


def test_documents_with_benchmark_items_go(spark, stages):
    found, last = stages
    before, after = found["decontamination"]
    items = [(min(5, len(words(r["text"] or ""))), r["text"] or "") for r in read_table(spark, DATA, "benchmark").collect()]
    gone = set()
    for r in before:
        of = {width: runs(r["text"] or "", width) for width in range(1, 6)}
        if any(width and 100 * len(own & of[width]) >= 75 * len(own) for width, text in items if (own := runs(text, width) if width else set())):
            gone.add(r["doc_id"])
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] not in gone)
    assert {last + 5, last + 6} & {r["doc_id"] for r in before} <= gone and gone


def test_every_token_is_packed_once(stages):
    before, after = stages[0]["packing"]
    tokenizer = encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before}
    per, at = Counter(), Counter()
    for r in sorted(after, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == per[r["doc_id"]] and r["doc_tokens"] == want[r["doc_id"]]
        per[r["doc_id"]] += r["length"]
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert per == want and max(at.values()) <= 2048


class Article(HTMLParser):
    """The words of a page's article elements."""

    def __init__(self, page: str):
        super().__init__()
        self.depth, self.hidden, self.parts = 0, 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.parts.append(data)


def test_main_texts_of_the_given_pages(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    pages = {r["page_id"]: r["html"] for r in read_table(spark, folder, "pages").collect()}
    found = queries.op4_html_text(spark, folder).collect()
    assert Counter(r["page_id"] for r in found) == Counter(pages.keys())
    hits = told = due = 0
    for r in found:
        ours, want = Counter(r["text"].split()), Counter(" ".join(Article(pages[r["page_id"]] or "").parts).split())
        hits, told, due = hits + (ours & want).total(), told + ours.total(), due + want.total()
    assert hits >= 0.98 * told and hits >= 0.98 * due

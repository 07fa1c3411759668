"""Language identification of whole texts and of the spans of mixed ones.

A word is a run of letters. The script of its letters leaves those languages as
candidates that use it in the labelled texts; each candidate scores the word by
the letter trigrams of its lower-case form, word ends included. Viterbi over the
words of a text, with a penalty for each change of language, labels its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, doc_texts, utf8

#: Hash buckets of trigrams.
BUCKETS = 1 << 15
#: Labelled texts from which a model is fitted, at most (about): chosen by a hash of doc_id.
FIT_DOCS = 20_000
#: Nats that a change of language costs, and that a word can speak against a language.
SWITCH, WORST = 14.0, 9.0
#: A script is a language's own from this share of its letters on.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"

# First code points of blocks, and the script that goes on from there.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_STARTS))
_STARTS = np.array([start for start, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])
_SMALL = 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = [chr(k) for k in range(_SMALL)]
    letter = np.array([c.isalpha() for c in points])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else k for k, c in enumerate(points)], np.uint32)
    return letter, lower, _SCRIPT[np.searchsorted(_STARTS, np.arange(_SMALL), "right") - 1].astype(np.uint8)


_LETTER, _LOWER, _SMALL_SCRIPT = _tables()


@dataclass
class Words:
    """The words of texts laid end to end."""

    starts: np.ndarray  # in code points, over all texts
    ends: np.ndarray
    of_text: np.ndarray  # n + 1 offsets of each text's words
    first: np.ndarray  # first code point of each text
    buckets: np.ndarray  # of each letter's trigram
    letters: np.ndarray  # n + 1 offsets of each word's letters in buckets
    scripts: np.ndarray  # of each word


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words and their features, from UTF-8."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    small = np.minimum(points, _SMALL - 1)
    letter, low = np.take(_LETTER, small), np.take(_LOWER, small)
    if len(high := np.flatnonzero(points >= _SMALL)):
        letter[high], low[high] = [chr(c).isalpha() for c in points[high]], points[high]
    n = len(points)
    cut = np.zeros(n + 1, bool)
    cut[begins] = True
    starts = np.flatnonzero(letter & (cut[:-1] | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & (cut[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
    at = np.flatnonzero(letter)
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    c = low[at]
    before, after = np.concatenate([[0], c[:-1]]).astype(np.uint32), np.concatenate([c[1:], [0]]).astype(np.uint32)
    before[letters[:-1]] = 0
    after[letters[1:] - 1] = 0
    h = before * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    buckets = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15)
    head = points[starts]
    scripts = np.take(_SMALL_SCRIPT, np.minimum(head, _SMALL - 1))
    if (far := head >= _SMALL).any():
        scripts[far] = _SCRIPT[np.searchsorted(_STARTS, head[far], "right") - 1]
    return Words(starts, ends, np.searchsorted(starts, begins), begins[:-1], buckets, letters, scripts)


@dataclass
class Model:
    """Languages, the logarithms of their trigram shares, which scripts they use, and how many letters were theirs."""

    languages: list[str]
    trigrams: np.ndarray  # languages x BUCKETS
    scripts: np.ndarray  # languages x SCRIPTS, bool
    letters: np.ndarray


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for a fifth of all documents: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, most: int = FIT_DOCS) -> Model:
    """A model from labelled documents: text and non-null lang.

    About ``most`` of them at most are read, those with the smallest hashes of
    doc_id; the counts are made by tasks, and languages times buckets of them
    reach the driver. Without labelled documents the model has no language.
    """
    labelled = docs.where(F.col("lang").isNotNull())
    total = labelled.count()
    if total > most:
        labelled = labelled.where(F.abs(F.xxhash64("doc_id")) < int(most / total * (1 << 63)))
    width = BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in chunks(batches, most=1 << 20):
            data, offsets = utf8(batch.column("text"))
            w = words_of(data, offsets)
            langs = batch.column("lang").to_pylist()
            bounds = w.letters[w.of_text]
            script = np.repeat(w.scripts, np.diff(w.letters)).astype(np.int64) + BUCKETS
            for k, lang in enumerate(langs):
                counts = found.setdefault(lang, np.zeros(width, np.int64))
                here = slice(bounds[k], bounds[k + 1])
                counts += np.bincount(w.buckets[here], minlength=width)
                counts += np.bincount(script[here], minlength=width)
        for lang, counts in found.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"])

    rows = doc_texts(labelled, "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(languages), width))
    for r in rows:
        counts[languages.index(r["lang"]), r["bucket"]] = r["n"]
    grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    letters = scripts.sum(1)
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(letters, 1)[:, None], letters)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each row, where a change of label costs ``switch``; ties keep the label, then the first one.

    If no run of rows gains more than one change costs by leaving the label that
    is best over all rows, that label holds throughout.
    """
    total = scores.sum(0)
    label = int(total.argmax())
    gains = np.concatenate([[0], np.cumsum((scores - scores[:, label : label + 1]).max(1))])
    if (gains - np.minimum.accumulate(gains)).max() <= switch:
        return np.full(len(scores), label)
    best, back = scores[0].tolist(), []
    everything = range(len(best))
    for row in scores[1:].tolist():
        top = max(everything, key=best.__getitem__)
        moved = best[top] - switch
        back.append([k if best[k] >= moved else top for k in everything])
        best = [max(best[k], moved) + row[k] for k in everything]
    path = [max(everything, key=best.__getitem__)]
    for choice in reversed(back):
        path.append(choice[path[-1]])
    return np.array(path[::-1])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, keep: bool = False) -> DataFrame:
    """A row for each document: doc_id, lang_pred, score, spans; with ``keep`` all its columns besides, as the struct ``row``.

    lang_pred is the language of most letters over the spans, ``und`` if the
    text is null or has no letter (score 0, no spans) or the model is empty.
    score is that language's share of the letters; words in a script that no
    language uses count against it. spans: start and end in characters, lang;
    such words don't change a span. Repeated rows stay.
    """
    languages, known = model.languages, len(model.languages)
    fallback = int(model.letters.argmax()) if known else 0

    def one(w: Words, scores: np.ndarray, usable: np.ndarray, k: int) -> tuple[str, float, list[dict]]:
        a, b = w.of_text[k], w.of_text[k + 1]
        if a == b or not known:
            return UNDETERMINED, 0.0, []
        sizes = np.diff(w.letters[a : b + 1])
        good = np.flatnonzero(usable[a:b])
        if not len(good):
            return languages[fallback], 0.0, []
        path = viterbi(scores[a:b][good], switch)
        by = np.bincount(path, sizes[good], known)
        top = int(by.argmax())
        turns = np.flatnonzero(np.diff(path)) + 1
        firsts, lasts = np.concatenate([[0], turns]), np.concatenate([turns, [len(path)]]) - 1
        place = w.first[k]
        spans = [{"start": int(w.starts[a + good[i]] - place), "end": int(w.ends[a + good[j]] - place), "lang": languages[path[i]]} for i, j in zip(firsts, lasts, strict=True)]
        return languages[top], float(by[top] / sizes.sum()), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            w = words_of(*utf8(batch.column("text")))
            if len(w.starts) and known:
                each = np.stack([np.add.reduceat(np.take(row, w.buckets), w.letters[:-1]) for row in model.trigrams], 1)
                fits = model.scripts.T[w.scripts]
                usable = fits.any(1)
                each[~fits] = -np.inf
                each[usable] -= each[usable].max(1, keepdims=True)
                each = np.maximum(np.nan_to_num(each, neginf=-2 * WORST), np.where(fits, -WORST, -2 * WORST))
            else:
                each, usable = np.zeros((len(w.starts), known)), np.zeros(len(w.starts), bool)
            rows = [one(w, each, usable, k) for k in range(batch.num_rows)]
            spans = pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
            more = [batch.column("row")] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), spans, *more], ["doc_id", "lang_pred", "score", "spans"] + ["row"] * keep)

    texts = doc_texts(docs, *[F.struct(*docs.columns).alias("row")] * keep)
    schema = StructType.fromDDL("doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
    return texts.mapInArrow(run, schema.add(texts.schema["row"]) if keep else schema)

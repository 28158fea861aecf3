"""Licence scan by a positional index of rare words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z lower-cased. The
base phrases ("mit license" and so on) are found wherever their words stand one after the
other. Beyond them a licence is recognised by the passages of its template: a passage of n
words is in a file if at some offset at least 80 % of them stand at their places; a label is
given where one passage of the licence is found and all its mandatory phrases stand there.

Method. The words of all passages form a small vocabulary, and their places in the passages
an index of postings. How many documents hold each of these words is counted over the whole
table. A passage that misses m of a file's words can tolerate only t - m further mismatches
(t = n - ceil(0.8 n)); so of its words that the file has, taken from the highest inverse
document frequency down, t - m + 2 places suffice: at a right offset at least two of them
agree. Only the file's occurrences of these rare words are laid against the postings,
offsets on which two agree are compared in full, and the phrases are then verified. The
frequencies decide the order of the words, that is the cost, and never the result. A base
phrase is a passage without tolerance whose rarest word is its anchor.

Scale. Two passes over the texts on Arrow batches; only the vocabulary's counts, a fixed
number, are shuffled and sent to the driver. Nothing joins documents with each other, so
copies, hot sources and frequent words cost what their own text costs.

``score`` is the greatest share, over the labelled licences, of the words of a licence's
passages that stand in the file (1 for a base phrase, 0 without a label).

Defined cases: a null text is empty and has no words, no places and no labels; null ids,
repeated rows and ties pass through row by row; very long texts are read whole; an empty
table gives an empty result; further columns are ignored, whatever their names. Words are
compared by 64-bit hashes with a vocabulary of a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, rows_of, small_batches, texts, word_hashes
from .licence_templates import BASE_PHRASES, TEMPLATES, Template

#: Share of a passage's words that have to stand at their places, in per cent.
NEEDED = 80
#: Cells of (offset, place) that are compared at once.
CELLS = 1 << 20

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z become a-z, all other bytes outside words a blank.
_TABLE = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(batch: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    return word_hashes([t.translate(_TABLE) for t in batch])


def plain_words(text: str) -> list[str]:
    """The words themselves, of a short text."""
    return text.encode().translate(_TABLE).decode().split()


@dataclass(frozen=True)
class Passage:
    """Words as places in the vocabulary; ``need`` of them have to match."""

    words: np.ndarray
    need: int


class Index:
    """The vocabulary of the templates, their passages and how often each place's word is in a passage."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE_PHRASES) -> None:
        strings = [*base, *(x for t in templates for x in (*t.passages, *t.phrases))]
        hashed = {x: h for x, h in zip(strings, words_of([x.encode() for x in strings]))}
        self.vocabulary = np.unique(np.concatenate(list(hashed.values())))
        self.labels = [*base.values(), *(t.label for t in templates)]
        self.passages: list[Passage] = []
        self.base = list(range(len(base)))
        #: for each template its label, its passages and its phrases, as numbers of passages
        self.licences: list[tuple[str, list[int], list[int]]] = []
        for x in base:
            self._add(hashed[x], True)
        for t in templates:
            own = [self._add(hashed[x], False) for x in t.passages]
            self.licences.append((t.label, own, [self._add(hashed[x], True) for x in t.phrases]))
        self.held = np.zeros((len(self.vocabulary), len(self.passages)), np.float32)
        for p, passage in enumerate(self.passages):
            np.add.at(self.held[:, p], passage.words, 1)
        self.need = np.array([p.need for p in self.passages])

    def _add(self, hashes: np.ndarray, whole: bool) -> int:
        n = len(hashes)
        self.passages.append(Passage(np.searchsorted(self.vocabulary, hashes), n if whole else -(-NEEDED * n // 100)))
        return len(self.passages) - 1

    def looked_up(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary; -1 outside."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def present(self, ids: list[np.ndarray]) -> np.ndarray:
        """Which words of the vocabulary each text has."""
        rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        out = np.zeros((len(ids), len(self.vocabulary)), np.float32)
        out[rows[flat >= 0], flat[flat >= 0]] = 1
        return out


class Postings:
    """The places of the vocabulary's words in one text."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        at = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[at], kind="stable")
        self.places, self.keys = at[order], ids[at][order]

    def of(self, words: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """For each word and shift, the word's places less the shift."""
        low, high = np.searchsorted(self.keys, words), np.searchsorted(self.keys, words, "right")
        return self.places[ranges(low, high - low)] - np.repeat(shifts, high - low)

    def matched(self, passage: Passage, offsets: np.ndarray) -> np.ndarray:
        """How many words of the passage stand at their places, for each offset."""
        n, out = len(passage.words), np.empty(len(offsets), np.int64)
        step = max(1, CELLS // n)
        for a in range(0, len(offsets), step):
            at = offsets[a : a + step, None] + np.arange(n)
            inside = (at >= 0) & (at < len(self.ids))
            out[a : a + step] = ((self.ids[np.where(inside, at, 0)] == passage.words) & inside).sum(axis=1)
        return out

    def found(self, passage: Passage, have: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, int]:
        """The offsets at which the passage stands, and the most words that match at one of them.

        ``have``: which words of the vocabulary the text has; ``rarest``: their rank by
        inverse document frequency, the rarest first.
        """
        there = np.flatnonzero(have[passage.words] > 0)
        n = len(passage.words)
        left = len(there) - passage.need
        if left < 0:
            return np.empty(0, np.int64), 0
        agree = 2 if n > passage.need and len(there) >= left + 2 else 1
        used = there[np.lexsort((there, rarest[passage.words[there]]))][: left + agree]
        offsets, votes = np.unique(self.of(passage.words[used], used), return_counts=True)
        offsets = offsets[votes >= agree]
        matched = self.matched(passage, offsets)
        good = matched >= passage.need
        return offsets[good], int(matched[good].max(initial=0))


def _scan_one(index: Index, rarest: np.ndarray, ids: np.ndarray, have: np.ndarray, likely: np.ndarray) -> tuple:
    """(n_base, first, last, base_labels, labels, score) of a text; ``likely``: the passages that enough of its words are in."""
    postings, found = Postings(ids), {}

    def passage(p: int) -> tuple[np.ndarray, int]:
        if p not in found:
            found[p] = postings.found(index.passages[p], have, rarest) if likely[p] else (np.empty(0, np.int64), 0)
        return found[p]

    places = [passage(p)[0] for p in index.base]
    base = {index.labels[p] for p in index.base if len(places[p])}
    every = np.concatenate(places)
    labels, score = set(base), 1.0 if base else 0.0
    for label, own, phrases in index.licences:
        if any(likely[p] for p in own) and all(likely[p] for p in phrases):
            matched = sum(passage(p)[1] for p in own)
            if matched and all(len(passage(p)[0]) for p in phrases):
                labels.add(label)
                score = max(score, matched / sum(len(index.passages[p].words) for p in own))
    ends = (int(every.min()), int(every.max())) if len(every) else (None, None)
    return len(every), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score


_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
])


def _looked_up(index: Index, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    ids = [index.looked_up(w) for w in words_of(texts(batch.column("text")))]
    return ids, index.present(ids)


def document_frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many documents each word of the vocabulary is, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in rows_of(batches):
            total += _looked_up(index, batch)[1].sum(axis=0).astype(np.int64)
        word = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(total[word])], names=["word", "n"])

    out = np.zeros(len(index.vocabulary), np.int64)
    # as many rows as the vocabulary has words
    for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def license_scan(df: DataFrame, index: Index | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: its words, its base phrases, its labels and their score."""
    small_batches(df.sparkSession)
    index = index or Index()
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the lower the frequency, the rarer; of equal ones in the vocabulary's order
    rarest = np.argsort(np.argsort(document_frequencies(docs, index), kind="stable"), kind="stable")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            ids, have = _looked_up(index, batch)
            likely = have @ index.held >= index.need
            nothing = (0, None, None, "", "", 0.0)
            rows = [_scan_one(index, rarest, x, h, p) if p.any() else nothing for x, h, p in zip(ids, have, likely)]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(c, kind) for c, kind in zip(zip(*rows), _ARROW.types[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return docs.mapInArrow(scan, _RESULT)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of all documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def oracle(templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE_PHRASES) -> str:
    """The same result as SQL: every place of every vocabulary word joined with all postings."""
    # kind 0: a base phrase, 1: a passage, 2: a phrase of a template
    passages = [(0, k, label, x) for k, (x, label) in enumerate(base.items())]
    for k, t in enumerate(templates):
        passages += [(1, k, t.label, x) for x in t.passages] + [(2, k, t.label, x) for x in t.phrases]
    rows, needs = [], []
    for p, (kind, k, label, x) in enumerate(passages):
        w = plain_words(x)
        needs.append((p, kind, k, label, len(w), -(-NEEDED * len(w) // 100) if kind == 1 else len(w)))
        rows += [(p, at, word) for at, word in enumerate(w)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH posting(p, place, word) AS (VALUES {_values(rows)}),
passage(p, kind, licence, label, n, need) AS (VALUES {_values(needs)}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
u AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
hit AS (
  SELECT r, p, i - place AS start, count(*) AS matched
  FROM u JOIN posting USING (word) GROUP BY ALL),
found AS (
  SELECT r, p, kind, licence, label, start, matched FROM hit JOIN passage USING (p) WHERE matched >= need),
base AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM found WHERE kind = 0 GROUP BY r),
size AS (
  SELECT licence, sum(n) FILTER (kind = 1) AS words, count(*) FILTER (kind = 2) AS phrases FROM passage WHERE kind > 0 GROUP BY licence),
best AS (SELECT r, p, kind, licence, label, max(matched) AS matched FROM found WHERE kind > 0 GROUP BY ALL),
own AS (
  SELECT r, label, sum(matched) FILTER (kind = 1) / max(words) AS score
  FROM best JOIN size USING (licence) GROUP BY r, label, licence
  HAVING count(*) FILTER (kind = 1) > 0 AND count(*) FILTER (kind = 2) = max(phrases)),
labelled AS (SELECT r, label, score FROM own UNION ALL SELECT r, label, 1.0 FROM found WHERE kind = 0),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM labelled GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN named USING (r)
"""


ORACLE = oracle()

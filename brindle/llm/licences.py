"""Licence scans by a positional index over the licence texts' rare words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import words
from brindle.llm.licence_texts import PARAGRAPHS, PHRASES
from brindle.llm.shared import chunks, documents, texts

#: Share of a template's IDF mass that must stand at the aligned places, besides its key phrases.
LEAST_SCORE = 0.6
#: A template is looked up by so many of its words of highest IDF; in a licence text AGREEING of them at their relative positions
#: will do, as copies differ here and there, in a base phrase all must stand.
RARE_WORDS, AGREEING = 4, 2
#: Words that may be put in or left out before a word of a template, as a share of the template's length: places need only be near.
SHIFT = 0.1
#: Candidates aligned together.
ALIGNED = 500


@dataclass
class Index:
    """word hash -> postings (template, position) of each template's rare words.

    `spread`: in how many of `n_docs` documents each word of the templates stands; without it, in how many templates.
    """

    templates: list[tuple[str, str, tuple[str, ...]]] = field(default_factory=lambda: PARAGRAPHS)
    spread: dict[int, int] | None = None
    n_docs: int = 0

    def __post_init__(self) -> None:
        self.words = [_split(t) for _, t, _ in self.templates]
        self.hashes = [_hashes(w) for w in self.words]
        spread, n = self.spread, self.n_docs
        if spread is None:
            spread, n = Counter(x for h in self.hashes for x in set(h.tolist())), len(self.words)
        self.weights = [np.array([np.log((1 + n) / (1 + spread.get(x, 0))) + 1e-6 for x in h.tolist()]) for h in self.hashes]
        self.mass = [w.sum() for w in self.weights]
        self.phrases = [[self._places(ws, _split(p)) for p in phrases] for ws, (_, _, phrases) in zip(self.words, self.templates)]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for t, weights in enumerate(self.weights):
            first = np.argsort(-weights, kind="stable")[:RARE_WORDS].tolist()
            self.need.append(len(first) if t < PHRASES else min(AGREEING, len(first)))
            for k in first:
                postings[int(self.hashes[t][k])].append((t, k))
        self.keys = np.array(sorted(postings), dtype=np.uint64)
        self.postings = [postings[int(k)] for k in self.keys]

    @staticmethod
    def _places(template: list[bytes], phrase: list[bytes]) -> np.ndarray:
        at = next(i for i in range(len(template)) if template[i : i + len(phrase)] == phrase)
        return np.arange(at, at + len(phrase))

    def gap(self, template: int) -> int:
        """By how many words a template's places may be off; base phrases, and short templates, stand as they are."""
        return 0 if template < PHRASES else int(len(self.words[template]) * SHIFT)

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, starts, owners): where enough of its rare words, each near its relative position, agree that it begins, and in which text."""
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[place] == h)
        starts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for key in np.unique(place[hits]):
            at = hits[place[hits] == key]
            for template, position in self.postings[key]:
                starts[template].append((at - position, doc[at]))
        for template, found in starts.items():
            if len(found) < self.need[template]:
                continue
            gap, apart = self.gap(template), len(h) + 2 * len(self.words[template])
            # one number a start and text, so that only starts in the same text are near each other
            numbers = [owner * apart + start for start, owner in found]
            every = np.unique(np.concatenate(numbers))
            agree = np.zeros(len(every), dtype=np.int64)
            for own in numbers:
                own = np.sort(own)
                agree += np.searchsorted(own, every + gap, side="right") > np.searchsorted(own, every - gap, side="left")
            kept = every[agree >= self.need[template]]
            if len(kept):
                owner = (kept + len(self.words[template])) // apart  # starts may lie before the text by a template's length
                yield template, kept - owner * apart, owner


def _split(text: str) -> list[bytes]:
    found = words.split([text.encode()], words.ALNUM)
    return [found.word(i) for i in range(len(found))]


def _hashes(found: list[bytes]) -> np.ndarray:
    return words.split([b" ".join(found)], words.ALNUM).hashes()


def scan(rows: list[bytes], index: Index) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Words of each text, and its finds: (template, first word, score), verified word by word."""
    found = words.split(rows, words.ALNUM)
    out: list[list[tuple[int, int, float]]] = [[] for _ in rows]
    if not len(found):
        return np.diff(found.first), out
    h, doc = found.hashes(), found.doc()
    for template, starts, owner in index.candidates(h, doc):
        for lo in range(0, len(starts), ALIGNED):
            for start, text, score in _aligned(found, h, doc, index, template, starts[lo : lo + ALIGNED], owner[lo : lo + ALIGNED]):
                out[text].append((template, start, score))
    return np.diff(found.first), [_best(f, index) for f in out]


def _aligned(found: words.Words, h: np.ndarray, doc: np.ndarray, index: Index, template: int, starts: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(first word, text, score) of the candidates whose key phrases stand near their places, word for word, and whose other words do by enough of their weight."""
    mine, n, gap = index.hashes[template], len(index.words[template]), index.gap(template)
    shifts = np.arange(-gap, gap + 1)
    at = starts[:, None, None] + shifts[None, :, None] + np.arange(n)
    safe = np.clip(at, 0, len(h) - 1)
    same = (at == safe) & (h[safe] == mine) & (doc[safe] == owner[:, None, None])
    score = (same.any(axis=1) * index.weights[template]).sum(axis=1) / index.mass[template]
    standing = [same[:, :, p].all(axis=2) for p in index.phrases[template]]
    whole = np.all([s.any(axis=1) for s in standing], axis=0)
    for k in np.flatnonzero(whole & (score >= LEAST_SCORE)).tolist():
        by_word = lambda shift, places: all(found.word(int(starts[k] + shift + p)) == index.words[template][p] for p in places)
        if all(any(by_word(shifts[x], places) for x in np.flatnonzero(s[k])) for s, places in zip(standing, index.phrases[template])):
            yield max(0, int(starts[k] - found.first[owner[k]])), int(owner[k]), min(1.0, float(score[k])) - 1e-9 * int(n - same[k, gap].sum())


def _best(finds: list[tuple[int, int, float]], index: Index) -> list[tuple[int, int, float]]:
    """Of finds of one template that begin within its shift of each other, which are one copy, the one that fits best (words in place count by a billionth)."""
    kept: list[tuple[int, int, float]] = []
    for template, start, score in sorted(finds):
        if kept and kept[-1][0] == template and start - kept[-1][1] <= 2 * index.gap(template):
            if score > kept[-1][2]:
                kept[-1] = (template, start, score)
        else:
            kept.append((template, start, score))
    return kept


def document_frequencies(docs: DataFrame, templates: list[tuple[str, str, tuple[str, ...]]]) -> tuple[dict[int, int], int]:
    """In how many of the rows of `docs` each word of the templates stands, by its hash, and the number of rows."""
    known = np.unique(np.concatenate([_hashes(_split(t)) for _, t, _ in templates]))  # a few hundred

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            rows = texts(batch.column(0))
            n += len(rows)
            for lo, hi in chunks(rows):
                found = words.split(rows[lo:hi], words.ALNUM)
                h = found.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                total += np.bincount(np.unique(found.doc()[hit] * len(known) + at[hit]) % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known) + 1)), pa.array(np.append(total, n))], ["word", "n"])

    counts = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a word
    return {int(k): counts.get(i, 0) for i, k in enumerate(known.tolist())}, counts.get(len(known), 0)


def scanned(docs: DataFrame, templates: list[tuple[str, str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, n_words and finds (template, label, first_word, score) of every row of `docs`.

    A first pass counts in how many documents the licences' words stand, the second looks the rarest up. The index is a few
    hundred words and goes along with the tasks; no rows are shuffled. Null and empty texts have no words and no finds;
    overlapping and repeated finds are all kept, repeated rows have theirs each; an empty table gives no rows; other columns are ignored.
    """
    templates = templates or PARAGRAPHS
    index = Index(templates, *document_frequencies(docs, templates))
    kind = docs.schema["doc_id"].dataType.simpleString()
    entry = pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts, finds = texts(batch.column(1)), [], []
            for lo, hi in chunks(rows):
                n, found = scan(rows[lo:hi], index)
                counts.append(n)
                finds += [[{"template": t, "label": index.templates[t][0], "first_word": p, "score": s} for t, p, s in sorted(f, key=lambda x: (x[1], x[0]))] for f in found]
            sizes = np.concatenate(counts) if counts else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(finds, pa.list_(entry))], ["doc_id", "n_words", "finds"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, finds array<struct<template:int,label:string,first_word:bigint,score:double>>")


def op8_licences(spark, sf_dir: str) -> DataFrame:
    base = f"filter(finds, f -> f.template < {PHRASES})"
    joined = lambda xs: f"array_join(array_sort(array_distinct(transform({xs}, f -> f.label))), ',')"
    return scanned(documents(spark, sf_dir)).selectExpr(
        "doc_id",
        "n_words",
        f"cast(size({base}) as bigint) as n_base",
        f"array_min(transform({base}, f -> f.first_word)) as first_word",
        f"array_max(transform({base}, f -> f.first_word)) as last_word",
        f"{joined(base)} as base_labels",
        f"{joined('finds')} as labels",
        "coalesce(array_max(transform(finds, f -> f.score)), 0D) as score",
    )

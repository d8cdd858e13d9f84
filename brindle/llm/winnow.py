"""Repeated passages across documents by winnowing over hashes of fixed-length lines of words.

Line breaks differ between copies and passages begin in the middle of lines, so a line here is
LINE_WORDS consecutive words, wherever the text wraps; one begins at every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import words
from brindle.llm.shared import chunks, documents, texts, written

#: Words of a line, and the fewest words that a repeated run must have to go.
LINE_WORDS, RUN_WORDS = 16, 50
#: So many 64-bit keys are sent to all tasks; more are joined by a shuffle, of the documents that `perhaps` lets through.
BROADCAST_KEYS = 10_000
#: Bits of that filter for each document asked for, and at most (4 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 25
#: The key that says that a document repeats itself.
OWN = np.uint64(0)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32())]))
_RUNS_DDL = "array<struct<start:int,n_words:int>>"


def windows(h: np.ndarray, first: np.ndarray, line: int = LINE_WORDS, run: int = RUN_WORDS) -> tuple[np.ndarray, ...]:
    """(start, gram, begin, least, span): the windows of `run` words of each text by their first word, and hashes of their words; windows in a
    row with the same least line are a span: the index of its first window, the line's hash, a hash of all the span's words.

    The least line of a window depends on the window's words only (of equal lines the last counts), so equal windows
    lie in spans of equal lines. Windows that cross texts are left out.
    """
    size, lines = run - line + 1, words.grams(h, line)
    if len(lines) < size:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64), none.astype(np.uint64)
    places = np.arange(len(lines), dtype=np.uint64)
    bits = np.uint64(max(1, len(lines)).bit_length())
    top = (np.uint64(1) << bits) - np.uint64(1)
    least = (lines >> bits << bits) | (top - places)
    span = 1
    while span * 2 <= size:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < size:
        least = np.minimum(least[: len(least) - (size - span)], least[size - span :])
    end = np.repeat(first[1:], np.diff(first))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + run <= end)
    chosen = (top - (least[start] & top)).astype(np.int64)
    gram = lines[start]
    for k in [*range(line, run - line, line), run - line]:
        gram = gram * _BASE + lines[start + k]
    gram = words.mixed(gram)
    begin = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(begin[1:], len(start))[: len(begin)] - 1
    # less than `run` windows: the first and the last have all the words
    return start, gram, begin, lines[chosen[begin]], words.mixed((gram[begin] * _BASE + gram[last]) * _BASE + (last - begin).astype(np.uint64))


def _texts_of(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, side="right") - 1


def own_repeats(start: np.ndarray, gram: np.ndarray, doc: np.ndarray, run: int) -> np.ndarray:
    """Which windows the same text has before, without overlap."""
    by = np.lexsort((gram, doc))  # stable: equal windows of a text stay in order
    new = np.ones(len(by), dtype=bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (gram[by][1:] != gram[by][:-1])
    first = start[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    out = np.zeros(len(by), dtype=bool)
    out[by] = start[by] - first >= run
    return out


def fingerprints(docs: DataFrame, line: int = LINE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """(doc_id, line, span): the spans of every document, each once however often the document says it; nulls where it
    repeats a whole window."""

    names = ["doc_id", "line", "span"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), texts(batch.column(1))
            for lo, hi in chunks(rows):
                found = words.split(rows[lo:hi], words.SPACED)
                start, gram, begin, least, span = windows(found.hashes(), found.first, line, run)
                doc = _texts_of(start[begin], found.first)
                by = np.lexsort((span, least, doc))
                doc, least, span = doc[by], least[by], span[by]
                again = (doc[1:] == doc[:-1]) & (least[1:] == least[:-1])
                new = np.ones(len(by), dtype=bool)
                new[1:] = ~again | (span[1:] != span[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc[new]].astype(np.int64)), pa.array(least[new].view(np.int64)), pa.array(span[new].view(np.int64))], names)
                owner = _texts_of(start, found.first)
                near = np.flatnonzero(np.isin(owner, doc[1:][again]))  # equal windows have equal lines
                themselves = np.unique(owner[near][own_repeats(start[near], gram[near], owner[near], run)])
                none = pa.nulls(len(themselves), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][themselves].astype(np.int64)), none, none], names)

    return _known(docs).mapInArrow(made, "doc_id long, line long, span long")


def _known(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` with __perhaps: false for rows whose doc_id is certainly not among `ids` (doc_id), and for null ones.

    A bitmap of hashed ids, of bounded size, goes to all tasks, so that only the texts concerned are dealt out, whatever the number of ids; with
    very many of them more rows go through that need not.
    """
    n = min(MOST_BITS, max(64, FILTER_BITS * ids.count()))
    at = lambda c: F.expr(f"pmod(xxhash64(cast({c} as bigint)), {n})")
    words_ = ids.where("doc_id is not null").select(at("doc_id").alias("bit")).groupBy(F.expr("bit div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("__bits"))
    rows = docs.withColumn("__bit", at("doc_id")).withColumn("__word", F.when(F.col("doc_id").isNotNull(), F.expr("__bit div 64")))
    set_ = F.expr("coalesce(shiftright(__bits, cast(__bit % 64 as int)) & 1L, 0L) = 1L")
    return rows.join(F.broadcast(words_), "__word", "left").withColumn("__perhaps", set_).drop("__bit", "__bits", "__word")


def _asked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, text, keys) of the documents in `keys` (doc_id, keys)."""
    rows = perhaps(_known(docs), keys.select("doc_id")).where("__perhaps")
    return rows.join(keys.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "keys")


def _salted(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys that differ between the texts of a batch."""
    return keys ^ words.mixed(rows.astype(np.uint64) + np.uint64(1))


def _asked_chunks(batch: pa.RecordBatch, line: int, run: int) -> Iterator[tuple]:
    """(first row, row after the last, words, windows, salted keys) of a few texts at a time."""
    rows, lists = texts(batch.column(1)), batch.column(2)
    for lo, hi in chunks(rows):
        found, part = words.split(rows[lo:hi], words.SPACED), lists.slice(lo, hi - lo)
        keys = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        of = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
        yield lo, hi, found, windows(found.hashes(), found.first, line, run), _salted(of, keys)


def open_windows(docs: DataFrame, spans: DataFrame, line: int = LINE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """(doc_id, line, gram): the windows of the spans (of, span) of `spans`, from the document `of`."""
    wanted = written(spans.groupBy(F.col("of").alias("doc_id")).agg(F.collect_list("span").alias("keys")), "wanted")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, found, (start, gram, begin, least, span), keys in _asked_chunks(batch, line, run):
                each = np.diff(np.append(begin, len(start)))
                here = np.flatnonzero(np.repeat(np.isin(_salted(_texts_of(start[begin], found.first), span), keys), each))
                doc = _texts_of(start[here], found.first)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc].astype(np.int64)), pa.array(np.repeat(least, each)[here].view(np.int64)), pa.array(gram[here].view(np.int64))], ["doc_id", "line", "gram"])

    return _asked(docs, wanted).mapInArrow(made, "doc_id long, line long, gram long")


def keys_to_delete(docs: DataFrame, line: int = LINE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """(doc_id, keys): for documents with runs of at least `run` words that are said before, the hashes of the spans and windows that go.

    A window of `run` words goes if any earlier document has it. Spans that an earlier document has whole go by an aggregate and an
    equi-join, which adaptive execution splits where a span is in very many documents. Where the same line stands in
    different spans, the first document of each is asked for its windows, and these are compared in the same way; later
    documents of the span lose it whole. So every occurrence is compared with every different surrounding of its line.
    """
    prints = written(fingerprints(docs, line, run), "lines")
    spans = written(prints.where("line is not null").groupBy("line", "span").agg(F.min("doc_id").alias("of"), F.count("*").alias("n")), "spans")
    later = prints.join(spans.where("n > 1").select("line", "span", "of").hint("shuffle_merge"), ["line", "span"]).where("doc_id > of").select("doc_id", F.col("span").alias("key"))
    several = written(spans.groupBy("line").agg(F.count("*").alias("n"), F.min("of").alias("a"), F.max("of").alias("b")).where("n > 1 and a < b").select("line"), "several")
    grams = written(open_windows(docs, spans.join(several.hint("shuffle_merge"), "line", "left_semi"), line, run), "grams")
    firsts = written(grams.groupBy("line", "gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("line", "gram", "a"), "firsts")
    parts = grams.join(firsts.hint("shuffle_merge"), ["line", "gram"]).where("doc_id > a").select("doc_id", F.col("gram").alias("key"))
    own = prints.where("line is null").select("doc_id", F.lit(int(OWN)).cast("bigint").alias("key"))
    return written(later.union(parts).union(own).groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "gone")


def _marked(start: np.ndarray, run: int, first: np.ndarray) -> list[list[dict]]:
    """For each text, the runs that the windows from `start` on make together."""
    n = int(first[-1]) + 1
    mark = np.cumsum(np.bincount(start, minlength=n) - np.bincount(start + run, minlength=n)) > 0
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mark[a:b].view(np.int8), [0])))).tolist()
        out.append([{"start": s, "n_words": e - s} for s, e in zip(edges[0::2], edges[1::2])])
    return out


def without(text: bytes, runs: list[dict]) -> bytes:
    """`text` without the given runs of words and the white space after each."""
    found = words.split([text], words.SPACED)
    parts, at = [], 0
    for r in runs:
        first, last = r["start"], r["start"] + r["n_words"]
        parts.append(text[at : found.start[first]])
        at = int(found.start[last]) if last < len(found) else len(text)
    return b"".join([*parts, text[at:]])


def deduplicated(docs: DataFrame, line: int = LINE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """`docs` with later repeated runs deleted from their texts, and __runs, what was deleted (null or empty: nothing).

    Words are compared lower-cased. The first document that has a run, by doc_id, keeps it, at its first place there; runs
    of fewer words stay. All rows stay, if need be with an empty text. Null texts stay null, a
    row with a null doc_id is left as it is; rows with equal doc_ids keep what they share with each other, and
    each loses only what stands in its own text; an empty table gives no rows.
    """
    gone = keys_to_delete(docs, line, run).select(F.col("doc_id").alias("__of"), F.col("keys").alias("__keys"))
    names = docs.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column("text"), batch.column("__keys")
            asked = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            runs: list[list[dict] | None] = [None] * len(batch)
            if len(asked):
                changed = column.cast(pa.string()).to_pylist()
                part = pa.RecordBatch.from_arrays([pa.nulls(len(asked)), column.take(pa.array(asked)), lists.take(pa.array(asked))], ["doc_id", "text", "keys"])
                for lo, hi, found, (start, gram, begin, _, span), keys in _asked_chunks(part, line, run):
                    doc = _texts_of(start, found.first)
                    hit = np.repeat(np.isin(_salted(doc[begin], span), keys), np.diff(np.append(begin, len(start))))
                    hit |= np.isin(_salted(doc, gram), keys)
                    each = np.arange(hi - lo)
                    mine = np.flatnonzero(np.isin(doc, each[np.isin(_salted(each, np.full(hi - lo, OWN)), keys)]))
                    hit[mine] |= own_repeats(start[mine], gram[mine], doc[mine], run)
                    for i, marks in zip(asked[lo:hi].tolist(), _marked(start[hit], run, found.first)):
                        runs[i] = marks
                        if marks:
                            changed[i] = without(changed[i].encode(), marks).decode()
                column = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_arrays([*(column if n == "text" else batch.column(n) for n in names), pa.array(runs, _RUNS)], [*names, "__runs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    total = gone.agg(F.sum(F.size("__keys") + 2)).first()[0] or 0
    if total <= BROADCAST_KEYS:
        joined = docs.join(F.broadcast(gone), docs["doc_id"] == gone["__of"], "left").select(*names, "__keys")
        return joined.mapInArrow(made, f"{schema}, __runs {_RUNS_DDL}")
    marked = perhaps(docs, gone.select(F.col("__of").alias("doc_id")))
    whole = marked.where("not __perhaps").select(*names, F.lit(None).cast(_RUNS_DDL).alias("__runs"))
    some = marked.where("__perhaps").select(*names)
    joined = some.join(gone.hint("shuffle_merge"), some["doc_id"] == gone["__of"], "left").select(*names, "__keys")
    return whole.unionByName(joined.mapInArrow(made, f"{schema}, __runs {_RUNS_DDL}"))


def repeated_runs(docs: DataFrame, line: int = LINE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """(doc_id, runs) of the rows of which something is deleted."""
    return deduplicated(docs.select("doc_id", "text"), line, run).where("size(__runs) > 0").select("doc_id", F.col("__runs").alias("runs"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(documents(spark, sf_dir).select("doc_id", "text", F.length("text").cast("long").alias("n_chars")))
    return found.selectExpr(
        "doc_id", "n_chars", "cast(length(text) as bigint) as n_kept", "cast(greatest(coalesce(size(__runs), 0), 0) as bigint) as n_runs", "coalesce(aggregate(__runs, 0L, (s, r) -> s + r.n_words), 0L) as n_words_deleted", "sha2(text, 256) as text_sha256", "if(size(__runs) > 0, __runs, null) as runs"
    )

"""Benchmark decontamination over suffix arrays of the training texts.

Two results from the same search: `coverage` (which words lie in passages of the benchmark, and which items they are from; what the query and the pipeline ask
for) takes every range of a suffix array once, however many windows of items have it and however often it occurs; `matches` lists every maximal match of every item, whose number is
a product for texts and items that say one thing over and over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import words
from brindle.llm.shared import chunks, documents, small_or_none, texts, written

#: Bytes of training text in one shard, whatever the table's size (a longer text is a shard of its own).
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text that are searched at once (one longer item is a block of its own); all that the driver holds of it.
BLOCK_BYTES = 16 << 20
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_pos", pa.int32()), ("doc_pos", pa.int32()), ("n_words", pa.int32())]))
_MATCHES_DDL = "array<struct<item_id:string,item_pos:int,doc_pos:int,n_words:int>>"


def symbols(h: np.ndarray) -> np.ndarray:
    """32-bit symbols of words; 0 is kept for the gaps between texts. Equal symbols are compared as bytes later."""
    return np.maximum(h >> np.uint64(32), np.uint64(1))


class Shard:
    """A suffix array over a sequence of symbols, ordered by the first `depth` or more symbols of each suffix."""

    def __init__(self, sequence: np.ndarray, depth: int, order: np.ndarray | None = None):
        n = len(sequence)
        self.sequence = np.concatenate([sequence, np.zeros(1, dtype=np.uint64)])
        key = (self.sequence[:-1] << np.uint64(32)) | self.sequence[1:]
        if order is not None:  # as it was stored
            self.order, self.head = order, key[order]
            return
        self.order = np.argsort(key)
        self.head = key[self.order]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = self.head[1:] != self.head[:-1]
        places = np.arange(n)
        rank = np.zeros(n + 1, dtype=np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, places, 0)) + 1
        known = 2
        while known < depth:
            tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
            if not len(tied):
                break
            suffix = self.order[tied]
            key = (rank[suffix] << 32) | rank[np.minimum(suffix + known, n)]
            by = np.argsort(key, kind="stable")
            suffix, key = suffix[by], key[by]
            self.order[tied] = suffix
            new = np.ones(len(tied), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            fresh[tied] = new
            rank[suffix] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + 1
            known *= 2

    def find(self, queries: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of `queries`, of which `size` symbols count, the range of suffixes that begin with it."""
        first = queries[:, 0] << np.uint64(32)
        second = np.where(size > 1, queries[:, 1] if queries.shape[1] > 1 else 0, 0)
        last = np.where(size > 1, second, np.uint64(0xFFFFFFFF))
        low = np.searchsorted(self.head, first | second, side="left")
        high = np.searchsorted(self.head, first | last, side="right")
        live = np.flatnonzero((low < high) & (size > 2))
        if len(live):
            q, m = queries[live], size[live]
            start, end = low[live], high[live]
            low[live] = self._bound(q, m, start, end, upper=False)
            high[live] = self._bound(q, m, low[live], end, upper=True)
        return low, high

    def _bound(self, queries: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            at, q, m = self.order[mid], queries[open_], size[open_]
            sign = np.zeros(len(open_), dtype=np.int8)
            for j in range(2, q.shape[1]):
                undecided = np.flatnonzero((sign == 0) & (j < m))
                if not len(undecided):
                    break
                mine = self.sequence[np.minimum(at[undecided] + j, len(self.sequence) - 1)]
                theirs = q[undecided, j]
                sign[undecided] = (mine > theirs).astype(np.int8) - (mine < theirs).astype(np.int8)
            right = sign <= 0 if upper else sign < 0
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        return low


@dataclass
class Items:
    """A block of test items: every suffix of `window` words (or the whole item, where it is shorter)."""

    ids: list[str]
    words: list[list[bytes]]
    item: np.ndarray
    place: np.ndarray
    queries: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]], window: int) -> Items:
        found = words.split([(t or "").encode() for _, t in rows], words.ALNUM)
        symbol = symbols(found.hashes()) if len(found) else np.empty(0, dtype=np.uint64)
        item, place, size = [], [], []
        for i, (lo, hi) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
            n = max(1, hi - lo - window + 1) if hi > lo else 0
            item += [i] * n
            place += range(n)
            size += [min(window, hi - lo)] * n
        item, place, size = (np.array(x, dtype=np.int64) for x in (item, place, size))
        at = (found.first[item] + place)[:, None] + np.arange(window)
        queries = symbol[np.minimum(at, len(symbol) - 1)] if len(item) else np.empty((0, window), dtype=np.uint64)
        return cls([r[0] for r in rows], [[found.word(k) for k in range(*found.first[i : i + 2])] for i in range(len(rows))], item, place, queries, size)


def sequence_of(found: words.Words) -> np.ndarray:
    """The symbols of all texts, one gap after each."""
    sequence = np.zeros(len(found) + len(found.first) - 1, dtype=np.uint64)
    sequence[np.arange(len(found)) + found.doc()] = symbols(found.hashes())
    return sequence


def shard_matches(found: words.Words, shard: Shard, items: Items, window: int) -> np.ndarray:
    """Rows (text, item, item_pos, doc_pos, n_words) of the maximal verbatim matches."""
    none = np.empty((0, 5), dtype=np.int64)
    if not len(found) or not len(items.item):
        return none
    base = found.first + np.arange(len(found.first))
    low, high = shard.find(items.queries, items.size)
    many = high - low
    if not many.sum():
        return none
    query = np.repeat(np.arange(len(many)), many)
    at = shard.order[np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(query))].astype(np.int64)
    item, place = items.item[query], items.place[query]
    # consecutive windows on one diagonal make one maximal match
    by = np.lexsort((at, at - place, item))
    item, place, at, size = item[by], place[by], at[by], items.size[query][by]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
    heads = np.flatnonzero(new)
    length = np.diff(np.append(heads, len(at))) - 1 + size[heads]
    item, place, at = item[heads], place[heads], at[heads]
    text = np.searchsorted(base, at, side="right") - 1
    rows = []
    for t, i, q, p, n in zip(text.tolist(), item.tolist(), place.tolist(), (at - base[text]).tolist(), length.tolist()):
        first, theirs = int(found.first[t]) + p, items.words[i]
        need, start = min(window, len(theirs)), 0
        same = [found.word(first + k) == theirs[q + k] for k in range(n)]
        for k in range(n + 1):  # equal symbols of different words would split the match
            if k == n or not same[k]:
                if k - start >= need:
                    rows.append((t, i, q + start, p + start, k - start))
                start = k + 1
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def covered(counts: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words of each text inside at least one match."""
    first = np.concatenate(([0], np.cumsum(counts)))
    step = np.zeros(first[-1] + 1, dtype=np.int64)
    np.add.at(step, first[text] + start, 1)
    np.add.at(step, first[text] + start + size, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(step)[:-1] > 0)))
    return hit[first[1:]] - hit[first[:-1]]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash and the text: matches depend on these only, so equal rows share them."""
    return docs.select("doc_id", F.xxhash64("text").alias("content"), "text")


def indexed(docs: DataFrame, window: int) -> DataFrame:
    """The training index, a row for each shard of about SHARD_BYTES: its rows (doc_id, content, n_words), their texts, and the
    order of the suffixes of all their words, by as many words as a window has or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["rows", "texts", "suffixes"]

    def flush(held: list[tuple[pa.Array, pa.Array, list[bytes]]]) -> pa.RecordBatch:
        raw = [t for _, _, part in held for t in part]
        found = words.split(raw, words.ALNUM)
        order = Shard(sequence_of(found), window).order.astype("<i4")
        ids, contents = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
        rows = pa.StructArray.from_arrays([ids, contents, pa.array(np.diff(found.first), pa.int64())], names=["doc_id", "content", "n_words"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([one(rows), one(pa.array(raw, pa.binary())), pa.array([order.tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            raw = texts(batch.column(2))
            for lo, hi in chunks(raw, SHARD_BYTES // 4):
                more = sum(map(len, raw[lo:hi]))
                if held and size + more > SHARD_BYTES:
                    yield flush(held)
                    held, size = [], 0
                held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), raw[lo:hi]))
                size += more
        if held:
            yield flush(held)

    return _keyed(docs).mapInArrow(run, f"rows array<struct<doc_id:{kind},content:bigint,n_words:bigint>>, texts array<binary>, suffixes binary")


def _searching(shared, window: int):
    """The matches of a block of items in every shard, a row for each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for k in range(len(batch)):
                rows, raw = batch.column(0)[k].values, batch.column(1)[k].values.to_pylist()
                order = np.frombuffer(batch.column(2)[k].as_buffer(), dtype="<i4")
                found = words.split(raw, words.ALNUM)
                every = shard_matches(found, Shard(sequence_of(found), window, order), items, window)
                if not len(every):
                    continue
                every = every[np.argsort(every[:, 0], kind="stable")]
                text, first = np.unique(every[:, 0], return_index=True)
                owner = rows.take(pa.array(text))
                fields = [pa.array([items.ids[i] for i in every[:, 1].tolist()], pa.string())] + [pa.array(every[:, c].astype(np.int32)) for c in (2, 3, 4)]
                made = pa.ListArray.from_arrays(pa.array(np.append(first, len(every)), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_MATCHES.value_type)))
                yield pa.RecordBatch.from_arrays([owner.field("doc_id"), owner.field("content"), owner.field("n_words"), made], ["doc_id", "content", "n_words", "matches"])

    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, counts = batch.column("matches"), batch.column("n_words").to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(batch)), np.diff(held.offsets.to_numpy()))
        start, size = (held.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(covered(counts, text, start, size))], [*batch.schema.names, "n_hit"])


def found_texts(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """(index, hits): the training index, and (doc_id, content, n_words, matches, n_hit) of every different text with matches."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = written(indexed(docs, window), "suffixes", group_bytes=8 << 20)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    dealt = written(items.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {blocks})")), "items")
    columns = f"doc_id {kind}, content bigint, n_words bigint, matches {_MATCHES_DDL}"
    hits = None
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in dealt.where(f"block = {b}").select("item_id", "text").collect()]  # about BLOCK_BYTES
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(rows, window))
        each = index.mapInArrow(_searching(shared, window), columns).groupBy("doc_id", "content")  # equal texts have equal matches
        part = written(each.agg(F.first("n_words").alias("n_words"), F.first("matches").alias("matches")), "hits")
        shared.unpersist()
        hits = part if hits is None else hits.union(part)
    # an array from each block at most
    merged = hits.groupBy("doc_id", "content").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"))
    return index, written(merged.mapInArrow(_covered, f"{columns}, n_hit bigint"), "covered")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, __content (the text's hash), __n_words, __n_hit and __matches, the maximal verbatim matches with benchmark items, of every row of `docs`.

    Suffix arrays over shards of the training texts are written once to the shared folder; every suffix of every item is
    binary-searched in each of them, a block of items at a time, and a match of `window` words or more (or all words of a
    shorter item) is verified word by word. Of the training texts nothing is shuffled, only what was found. Null and empty texts have no words
    and no matches; items without words match nothing; item ids may be of any type and count as strings, a null one as the
    empty string; repeated rows have the same matches each, repeated items add nothing; empty tables give no rows or no matches;
    other columns are not read.
    """
    index, hits = found_texts(docs, benchmark, window)
    every = index.select(F.explode("rows").alias("r")).select("r.*")
    right = hits.select(F.col("doc_id").alias("__of"), F.col("content").alias("__text"), "matches", "n_hit")
    joined = every.join(F.broadcast(right) if small_or_none(hits.select(F.explode("matches"))) else right, every["doc_id"].eqNullSafe(right["__of"]) & (every["content"] == right["__text"]), "left")
    return joined.select("doc_id", F.col("content").alias("__content"), F.col("n_words").alias("__n_words"), F.coalesce("n_hit", F.lit(0)).alias("__n_hit"), F.coalesce("matches", F.expr(f"cast(array() as {_MATCHES_DDL})")).alias("__matches"))


#: Windows looked up, occurrences, and (text, item) pairs looked at together.
LOOKED_UP, TOGETHER = 50_000, 1_000_000
_PASSAGES = pa.list_(pa.struct([("doc_pos", pa.int32()), ("n_words", pa.int32())]))
_COVERED_DDL = "n_words bigint, n_hit bigint, passages array<struct<doc_pos:int,n_words:int>>, items array<string>"


class Tests:
    """A block of items: the symbols of all their words, and where their windows begin."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        self.ids, self.window = pa.array([r[0] for r in rows], pa.string()), window
        self.found = words.split([(t or "").encode() for _, t in rows], words.ALNUM)
        symbol = symbols(self.found.hashes()) if len(self.found) else np.empty(0, dtype=np.uint64)
        self.symbol = np.append(symbol, np.zeros(window, dtype=np.uint64))
        n = np.diff(self.found.first)
        count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        self.item = np.repeat(np.arange(len(n)), count)
        self.at = self.found.first[self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count)
        self.size = np.minimum(window, n)[self.item]


def _binary(found: words.Words, which: np.ndarray) -> pa.Array:
    """Words as an Arrow array, without an object each."""
    start, size = found.start[which], found.end[which] - found.start[which]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    data = found.buf[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ranges(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ..., low[1], ...: `many` of each."""
    return np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)


def shard_coverage(found: words.Words, shard: Shard, tests: Tests) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """n_hit, passages and items of each text of a shard.

    Ranges of windows of one length are the same or have nothing in common, so the occurrences of all different ones are no more than the shard's words for each length. Windows
    of equal words are told apart from those of equal symbols by numbering the shard's words exactly.
    """
    texts_, window = len(found.first) - 1, tests.window
    base = found.first + np.arange(len(found.first))
    live, low, high = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for a in range(0, len(tests.item) if len(found) else 0, LOOKED_UP):
        at, size = tests.at[a : a + LOOKED_UP], tests.size[a : a + LOOKED_UP]
        lo, hi = shard.find(tests.symbol[at[:, None] + np.arange(window)], size)
        there = np.flatnonzero(lo < hi)
        for held, part in ((live, there + a), (low, lo[there]), (high, hi[there])):
            held.append(part.astype(np.int64))
    query, low, high = (np.concatenate(x) for x in (live, low, high))
    step = np.zeros(base[-1] + 1, dtype=np.int64)
    pairs = np.empty((0, 2), dtype=np.int64)
    if len(query):
        known = _binary(found, np.arange(len(found))).dictionary_encode()
        number = np.full(base[-1] + window, -1, dtype=np.int64)
        number[np.arange(len(found)) + found.doc()] = known.indices.to_numpy()
        places, size = tests.at[query][:, None] + np.arange(window), tests.size[query]
        inside = np.arange(window) < size[:, None]
        asked = np.unique(places[inside])
        theirs = pc.fill_null(pc.index_in(_binary(tests.found, asked), value_set=known.dictionary), -2).to_numpy()
        exact = np.where(inside, theirs[np.minimum(np.searchsorted(asked, places), len(asked) - 1)], -3)
        same = ~(exact == -2).any(axis=1)
        query, low, high, exact, size = query[same], low[same], high[same], exact[same], size[same]
    if len(query):
        exact, first, of = np.unique(exact, axis=0, return_index=True, return_inverse=True)
        low, many, size, of = low[first], high[first] - low[first], size[first], of.ravel()
        begin = 0
        while begin < len(low):  # ranges of a million occurrences together, or one longer range
            end = begin + max(1, int(np.searchsorted(np.cumsum(many[begin:]), TOGETHER, side="right")))
            window_of = np.repeat(np.arange(begin, end), many[begin:end])
            at = shard.order[_ranges(low[begin:end], many[begin:end])].astype(np.int64)
            right = np.ones(len(at), dtype=bool)
            for k in range(window):
                wanted = exact[window_of, k]
                right &= (wanted == -3) | (number[at + k] == wanted)
            window_of, at = window_of[right], at[right]
            np.add.at(step, at, 1)
            np.add.at(step, at + size[window_of], -1)
            text = np.searchsorted(base, at, side="right") - 1
            pairs = np.unique(np.concatenate([pairs, np.unique(np.stack([text, window_of], axis=1), axis=0)]), axis=0)
            begin = end
    hit = np.append(np.cumsum(step)[:-1] > 0, False)
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[base[1:]] - sums[base[:-1]]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8)))))
    start, end = edges[0::2], edges[1::2]
    text = np.searchsorted(base, start, side="right") - 1
    fields = [pa.array((start - base[text]).astype(np.int32)), pa.array((end - start).astype(np.int32))]
    passages = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(texts_ + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_PASSAGES.value_type)))
    owners = np.empty((0, 2), dtype=np.int64)
    if len(pairs):
        items_of = np.unique(np.stack([of, tests.item[query]], axis=1), axis=0)
        lo = np.searchsorted(items_of[:, 0], pairs[:, 1], side="left")
        many = np.searchsorted(items_of[:, 0], pairs[:, 1], side="right") - lo
        begin = 0
        while begin < len(pairs):
            end = begin + max(1, int(np.searchsorted(np.cumsum(many[begin:]), TOGETHER, side="right")))
            each = np.stack([np.repeat(pairs[begin:end, 0], many[begin:end]), items_of[_ranges(lo[begin:end], many[begin:end]), 1]], axis=1)
            owners = np.unique(np.concatenate([owners, each]), axis=0)
            begin = end
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(owners[:, 0], np.arange(texts_ + 1)).astype(np.int32)), tests.ids.take(pa.array(owners[:, 1])))
    return n_hit, passages, items


def _shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about SHARD_BYTES of text together, and their texts; a longer text is alone."""
    held, raws, size = [], [], 0
    for batch in batches:
        raw = texts(batch.column(column))
        for lo, hi in chunks(raw, SHARD_BYTES // 4):
            more = sum(map(len, raw[lo:hi]))
            if held and size + more > SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], raws
                held, raws, size = [], [], 0
            held.append(batch.slice(lo, hi - lo))
            raws += raw[lo:hi]
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], raws


def _dirty(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _read_once(docs: DataFrame, rows: list[tuple[str, str | None]], window: int, clean: bool) -> DataFrame:
    """One block of items: shards are searched as soon as they are ordered, and nothing is stored or shuffled. `clean`: the rows of `docs` that stay; else doc_id and its coverage."""
    shared = docs.sparkSession.sparkContext.broadcast((rows, window))  # BLOCK_BYTES of text
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(*shared.value)
        for batch, raw in _shards(batches, column):
            found = words.split(raw, words.ALNUM)
            n_words = np.diff(found.first)
            n_hit, passages, items = shard_coverage(found, Shard(sequence_of(found), window), tests)
            if clean:
                yield batch.filter(pa.array(~_dirty(n_words, n_hit)))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), passages, items], ["doc_id", "n_words", "n_hit", "passages", "items"])

    return docs.mapInArrow(run, docs.schema if clean else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_COVERED_DDL}")


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items with their block, and the number of blocks of about BLOCK_BYTES."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    return items.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {blocks})")), blocks


def _rows_of(dealt: DataFrame, block: int) -> list[tuple[str, str | None]]:
    return [(r[0], r[1]) for r in dealt.where(f"block = {block}").select("item_id", "text").collect()]  # about BLOCK_BYTES


def _hits_by_block(docs: DataFrame, dealt: DataFrame, blocks: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(index, hits) for many blocks of items: the arrays are ordered once and stored, and read for each block; hits are put together by text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    index, dealt = written(indexed(docs, window), "suffixes", group_bytes=8 << 20), written(dealt, "items")
    hits = None

    def searching(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Tests(*shared.value)
            for batch in batches:
                for k in range(len(batch)):
                    rows, found = batch.column(0)[k].values, words.split(batch.column(1)[k].values.to_pylist(), words.ALNUM)
                    order = np.frombuffer(batch.column(2)[k].as_buffer(), dtype="<i4")
                    n_hit, passages, items = shard_coverage(found, Shard(sequence_of(found), window, order), tests)
                    there = pa.array(np.flatnonzero(n_hit))
                    yield pa.RecordBatch.from_arrays([*(rows.take(there).field(c) for c in ("doc_id", "content", "n_words")), pa.array(n_hit, pa.int64()).take(there), passages.take(there), items.take(there)], ["doc_id", "content", "n_words", "n_hit", "passages", "items"])

        return run

    for b in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast((_rows_of(dealt, b), window))
        part = written(index.mapInArrow(searching(shared), f"doc_id {kind}, content bigint, {_COVERED_DDL}").dropDuplicates(["doc_id", "content"]), "hits")  # equal texts have equal hits
        shared.unpersist()
        hits = part if hits is None else hits.union(part)
    merged = hits.groupBy("doc_id", "content").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("passages")).alias("passages"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, counts = batch.column("passages"), batch.column("n_words").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(batch)), np.diff(held.offsets.to_numpy()))
            start, size = (held.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), batch.column("n_words"), pa.array(covered(counts, text, start, size), pa.int64()), held, batch.column("items")], ["doc_id", "content", "n_words", "n_hit", "passages", "items"])

    return index, written(merged.mapInArrow(united, f"doc_id {kind}, content bigint, {_COVERED_DDL}"), "covered")


def coverage(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit (words in passages of the benchmark), passages (doc_pos, n_words: runs of such words) and items (their ids) of every row of `docs`.

    Null and empty texts have no words; items without words match nothing; item ids may be of any type and count as strings, a null one as the empty string; repeated
    rows have the same each, repeated items add nothing; empty tables give no rows or no hits; other columns are not read. With several blocks of items a passage may be told in
    parts that overlap.
    """
    docs = docs.select("doc_id", "text")
    dealt, blocks = _blocks(benchmark)
    if blocks == 1:
        return _read_once(docs, _rows_of(dealt, 0), window, clean=False)
    index, hits = _hits_by_block(docs, dealt, blocks, window)
    every = index.select(F.explode("rows").alias("r")).select("r.*")
    right = hits.select(F.col("doc_id").alias("of"), F.col("content").alias("text"), "n_hit", "passages", "items")
    joined = every.join(right, every["doc_id"].eqNullSafe(right["of"]) & (every["content"] == right["text"]), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("passages", F.expr("cast(array() as array<struct<doc_pos:int,n_words:int>>)")).alias("passages"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """`docs` without those of which at least a twentieth of the words lie in passages of the benchmark. Odd rows as in `coverage`; columns of any name stay as they are."""
    dealt, blocks = _blocks(benchmark)
    if blocks == 1:
        return _read_once(docs, _rows_of(dealt, 0), window, clean=True)
    _, hits = _hits_by_block(docs, dealt, blocks, window)
    gone = hits.where(CONTAMINATED).select(F.col("doc_id").alias("of"), "content")
    gone = F.broadcast(gone) if small_or_none(gone) else gone
    hashed = F.xxhash64(docs["text"])
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["of"]) & (hashed == gone["content"]), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all items, with the longest passage of each."""
    found = coverage(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    longest = "array_max(transform(passages, p -> struct(p.n_words as n, -p.doc_pos as place)))"
    found = found.withColumns({"sorted": F.array_sort("items"), "longest": F.expr(longest)})
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "cast(size(sorted) as bigint) as n_items", "sha2(array_join(sorted, ','), 256) as items_sha256", f"{CONTAMINATED} as contaminated", "coalesce(longest.n, 0) as longest_words", "-longest.place as longest_at"
    )

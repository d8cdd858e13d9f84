"""An interpolated modified Kneser-Ney bigram model: counted by Spark, kept as sorted hash arrays, scored through memory maps.

Counting keeps whole n-gram tables out of any one task: every map task sorts and sums its own n-grams and
sends each shard one packed block, a shard merges its blocks and writes sorted arrays to the shared folder. Bigrams
are sharded by context and a salt of the next word, so that a frequent context is in many shards;
what the contexts and the continuations add up to is then merged by a second, smaller shuffle.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm import words
from brindle.llm.shared import chunks, documents, new_path, partitions, texts, written

#: The hash that stands for a text's end, and the context before its first word (48 bits, as all contexts).
END, BEGIN = np.uint64(0xE4D0_7E07_1A57_0001), np.uint64(0xB361_0F7E_0001)
#: Tokens that a map task gathers before it sums and sends them.
GATHERED = 3 << 20
_SHIFT = np.uint64(16)
_BLOCKS = "kind string, shard int, block binary"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return words.mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def bigram_id(context: np.ndarray, word: np.ndarray, salts: int) -> np.ndarray:
    """16 bits that name the shard, from the context and a salt of the word, and 48 of both hashed together."""
    top = _mix(context, word % np.uint64(salts)) >> np.uint64(48)
    return (top << np.uint64(48)) | (_mix(word, context) >> _SHIFT)


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return ((ids >> np.uint64(48)) * np.uint64(shards)) >> _SHIFT


def pack(wide: list[np.ndarray], counts: list[np.ndarray], low: int = 2) -> bytes:
    """Arrays of equal length as bytes: of the wide ones all but the `low` top bytes, plane by plane; counts as narrow as they fit."""
    n = len(wide[0]) if wide else len(counts[0])
    parts = [np.array([n, len(wide), len(counts), low], dtype=np.int64).tobytes()]
    for x in wide:
        parts.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, : 8 - low].T).tobytes())
    for x in counts:
        width = 1 if not n or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 8
        parts += [bytes([width]), x.astype(f"<u{width}").tobytes()]
    return b"".join(parts)


def unpack(block: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, n_wide, n_counts, low = np.frombuffer(block, dtype=np.int64, count=4).tolist()
    at, wide, counts = 32, [], []
    for _ in range(n_wide):
        planes = np.zeros((n, 8), dtype=np.uint8)
        planes[:, : 8 - low] = np.frombuffer(block, dtype=np.uint8, count=n * (8 - low), offset=at).reshape(8 - low, n).T
        wide.append(planes.reshape(-1).view("<u8"))
        at += n * (8 - low)
    for _ in range(n_counts):
        width = block[at]
        counts.append(np.frombuffer(block, dtype=f"<u{width}", count=n, offset=at + 1).astype(np.int64))
        at += 1 + n * width
    return wide, counts


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in ascending order, and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], *(np.add.reduceat(v[order], heads) for v in values)


def tokens(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, contexts, first): all texts' tokens, each text's end among them; contexts have 48 bits."""
    found = words.split(rows, words.SPACED)
    first = found.first + np.arange(len(found.first))
    h = np.full(first[-1], END, dtype=np.uint64)
    h[np.arange(len(found)) + found.doc()] = found.hashes()
    before = np.empty_like(h)
    before[1:] = h[:-1] >> _SHIFT
    before[first[:-1]] = BEGIN
    return h, before, first


def _split_blocks(kind: str, shard: np.ndarray, wide: list[np.ndarray], counts: list[np.ndarray], low: int) -> Iterator[tuple[str, int, bytes]]:
    """A block for each shard; rows come sorted by shard."""
    edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.empty(0, dtype=np.int64)
    for lo, hi in zip(edges.tolist(), np.append(edges[1:], len(shard)).tolist()):
        yield kind, int(shard[lo]), pack([x[lo:hi] for x in wide], [x[lo:hi] for x in counts], low)


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, shards, blocks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], ["kind", "shard", "block"])


def _counting(shards: int, salts: int):
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, before = (np.concatenate(x) for x in zip(*held))
        held.clear()
        key, n = summed(h, np.ones(len(h), dtype=np.int64))
        yield _batch(list(_split_blocks("word", shard_of(key, shards), [key], [n], 0)))
        del key, n
        word = h >> _SHIFT
        ids = bigram_id(before, word, salts)
        order = np.argsort(ids)
        ids = ids[order]
        heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        n, order, ids = np.diff(np.append(heads, len(ids))), order[heads], ids[heads]
        yield _batch(list(_split_blocks("pair", shard_of(ids, shards), [before[order], word[order]], [n], 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = texts(batch.column(0))
            for lo, hi in chunks(rows):
                h, before, _ = tokens(rows[lo:hi])
                held.append((h, before))
                size += len(h)
                if size >= GATHERED:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    return run


def _merging(path: str, shards: int, salts: int):
    """A shard's pairs: sorted arrays to the shared folder; what they add to contexts and continuations, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            parts = [unpack(b) for _, b in blocks]
            before, word = (np.concatenate([p[0][i] for p in parts]) for i in (0, 1))
            n = np.concatenate([p[1][0] for p in parts])
            del parts
            ids = bigram_id(before, word, salts)
            order = np.argsort(ids)
            ids = ids[order]
            heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            n, order, ids = np.add.reduceat(n[order], heads), order[heads], ids[heads]
            before, word = before[order], word[order]
            _save(path, "pair", shard, ids, n.astype(np.uint32))
            kinds = [np.minimum(n, 5) == k for k in range(1, 5)]
            out = [("pair_counts", shard, pack([], [np.array([k.sum() for k in kinds], dtype=np.int64)], 0))]
            ones = [kinds[0], kinds[1], n >= 3]
            key, *sums = summed(before, n, *(x.astype(np.int64) for x in ones))
            out += _split_blocks("context", shard_of(key << _SHIFT, shards), [key], sums, 2)
            key, n = summed(word, np.ones(len(word), dtype=np.int64))
            out += _split_blocks("follows", shard_of(key << _SHIFT, shards), [key], [n], 2)
            yield _batch(out)

    return run


def _finishing(path: str):
    """A shard's words, contexts and continuations: sorted arrays to the shared folder; their totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            totals = np.zeros(9, dtype=np.int64)
            for kind, columns in (("word", 1), ("context", 4), ("follows", 1)):
                parts = [unpack(b) for k, b in blocks if k == kind]
                key = np.concatenate([p[0][0] for p in parts]) if parts else np.empty(0, dtype=np.uint64)
                sums = [np.concatenate([p[1][i] for p in parts]) if parts else np.empty(0, dtype=np.int64) for i in range(columns)]
                key, *sums = summed(key, *sums)
                _save(path, kind, shard, key, np.column_stack(sums).astype(np.uint64) if columns > 1 else sums[0].astype(np.uint64))
                if kind == "word":
                    totals[:2] = len(key), sums[0].sum()
                if kind == "follows":
                    totals[2] = sums[0].sum()
                    totals[3:8] = [(sums[0] == k).sum() for k in range(1, 5)] + [(sums[0] >= 3).sum()]
            yield _batch([("totals", shard, pack([], [totals], 0))])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """Groups of rows of equal shard; the rows come sorted by it."""
    held: list[tuple[str, bytes]] = []
    at = None
    for batch in batches:
        for kind, shard, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if shard != at and held:
                yield at, held
                held = []
            at = shard
            held.append((kind, block))
    if held:
        yield at, held


def _local(path: str) -> str | None:
    """The path as the operating system has it, if the shared folder is mounted."""
    if "://" not in path and not path.startswith("file:"):
        return path
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def _save(path: str, kind: str, shard: int, keys: np.ndarray, values: np.ndarray) -> None:
    """Under a name of its own first, then renamed, so that a task run twice leaves one whole file."""
    content = np.array([len(keys), values.shape[1] if values.ndim > 1 else 1, values.dtype.itemsize], dtype=np.int64).tobytes() + keys.astype("<u8").tobytes() + np.ascontiguousarray(values).tobytes()
    local = _local(path)
    if local is None:
        raise NotImplementedError("arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder")
    os.makedirs(local, exist_ok=True)
    target = f"{local}/{kind}-{shard:05d}"
    with open(own := f"{target}.{uuid.uuid4().hex}", "wb") as f:
        f.write(content)
    os.replace(own, target)


@lru_cache(maxsize=4096)
def _mapped(path: str, kind: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's sorted keys and their values, memory-mapped from the shared folder."""
    raw = np.memmap(f"{_local(path)}/{kind}-{shard:05d}", dtype=np.uint8, mode="r")  # a file that is not there is an error: the folder must be shared
    n, columns, size = raw[:24].view(np.int64).tolist()
    keys = raw[24 : 24 + 8 * n].view("<u8")
    values = raw[24 + 8 * n :].view(f"<u{size}")
    return keys, values.reshape(n, columns) if columns > 1 else values


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    path: str
    shards: int
    salts: int
    n_words: int
    n_tokens: int
    n_pairs: int
    single: tuple[int, int, int]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: The shards that have any n-grams, by kind.
    filled: dict[str, np.ndarray]

    def find(self, kind: str, keys: np.ndarray, columns: int = 1) -> np.ndarray:
        """Values of ascending `keys` (zero where there are none)."""
        out = np.zeros((len(keys), columns), dtype=np.int64)
        shard = shard_of(keys << _SHIFT if kind in ("context", "follows") else keys, self.shards)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero((np.diff(edges) > 0) & self.filled[kind]).tolist():
            lo, hi = edges[s], edges[s + 1]
            known, values = _mapped(self.path, kind, s)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[lo:hi]), len(known) - 1)
                hit = known[at] == keys[lo:hi]
                out[lo:hi][hit] = values[at[hit]].reshape(-1, columns)
        return out

    def probabilities(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, count) of every token after its context."""
        unique, where = np.unique(h, return_inverse=True)
        count = self.find("word", unique)[:, 0]
        key, back = np.unique(unique >> _SHIFT, return_inverse=True)
        follows = self.find("follows", key)[:, 0][back]
        total = max(1, self.n_pairs)
        mass = sum(d * n for d, n in zip(self.word_discounts, self.single)) / total
        lower = (np.maximum(follows - discount(self.word_discounts, follows), 0) / total + (mass if self.n_pairs else 1.0) / (self.n_words + 1))[where]
        key, back = np.unique(before, return_inverse=True)
        context = self.find("context", key, 4)[back]
        ids, back = np.unique(bigram_id(before, h >> _SHIFT, self.salts), return_inverse=True)
        n = self.find("pair", ids)[:, 0][back]
        seen = np.maximum(context[:, 0], 1)
        left = sum(d * context[:, i + 1] for i, d in enumerate(self.pair_discounts)) / seen
        higher = np.maximum(n - discount(self.pair_discounts, n), 0) / seen + left * lower
        return np.where(context[:, 0] > 0, higher, lower), count[where]


def discount(by_count: tuple[float, float, float], n: np.ndarray) -> np.ndarray:
    return np.array([0.0, *by_count])[np.minimum(n, 3)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams occur once to four times; 0.75 where these are too few to tell."""
    if min(n1, n2, n3, n4) == 0:
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(float(min(max(d, 0.05), k + 0.95)) for k, d in enumerate(found))


def train(texts_: DataFrame) -> Model:
    """The model of the column `text` of `texts_`."""
    spark = texts_.sparkSession
    path, shards = new_path(spark, "ngrams"), min(partitions(spark), 1 << 14)
    salts = max(4, shards // 16)
    dealt = lambda df: df.repartition(shards, "shard").sortWithinPartitions("shard")
    counted = texts_.select("text").mapInArrow(_counting(shards, salts), _BLOCKS)
    merged = written(dealt(counted).mapInArrow(_merging_all(path, shards, salts), _BLOCKS), "merged")
    finished = dealt(merged.where("kind in ('word', 'context', 'follows')")).mapInArrow(_finishing(path), _BLOCKS)
    filled = {kind: np.zeros(shards, dtype=bool) for kind in ("word", "context", "follows", "pair")}
    total, pairs = np.zeros(9, dtype=np.int64), np.zeros(4, dtype=np.int64)
    for row in finished.toLocalIterator():
        total += unpack(row["block"])[1][0]
        for kind in ("word", "context", "follows"):
            filled[kind][row["shard"]] = True
    for row in merged.where("kind = 'pair_counts'").toLocalIterator():
        pairs += unpack(row["block"])[1][0]
        filled["pair"][row["shard"]] = True
    return Model(path, shards, salts, int(total[0]), int(total[1]), int(total[2]), (int(total[3]), int(total[4]), int(total[7])), discounts(*pairs.tolist()), discounts(*total[3:7].tolist()), filled)


def _merging_all(path: str, shards: int, salts: int):
    """Pairs are merged; the words' blocks, which have the same shards, are summed and go on."""
    pairs = _merging(path, shards, salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            own = [b for k, b in blocks if k == "word"]
            if own:
                parts = [unpack(b) for b in own]
                key, n = summed(np.concatenate([p[0][0] for p in parts]), np.concatenate([p[1][0] for p in parts]))
                yield _batch([("word", shard, pack([key], [n], 0))])
            rest = [(k, shard, b) for k, b in blocks if k == "pair"]
            if rest:
                yield from pairs(iter([_batch(rest)]))

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigram) and score (log10 probability) of every row of `docs`.

    A null or empty text is its end alone; words the model has not seen get the unknown share of the lower order;
    with no training text every token is unknown; repeated rows are scored each; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = texts(batch.column(1)), []
            for lo, hi in chunks(rows):
                h, before, first = tokens(rows[lo:hi])
                p, n = model.probabilities(h, before)
                base = np.log10((n + 1) / (model.n_tokens + model.n_words + 1))
                sums = [np.add.reduceat(x, first[:-1]) for x in ((n > 0).astype(np.int64), base, np.log10(p))]
                out.append((np.diff(first), *sums))
            made = [np.concatenate(x) for x in zip(*out)] or [np.empty(0)] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(made, kinds))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


HELD_OUT = "crc32(cast(doc_id as string)) % 7 = 2"


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(f"not coalesce({HELD_OUT}, false)"))
    return scored(docs, model).selectExpr(
        "doc_id", f"coalesce({HELD_OUT}, false) as held_out", "n_tokens", "n_known", f"{model.n_tokens}L as train_tokens", "base_score", "score", "pow(10D, -score / n_tokens) as perplexity"
    )


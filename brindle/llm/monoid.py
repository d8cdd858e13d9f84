"""Byte-level BPE as a monoid: halves are encoded apart and joined; decoding puts bytes together.

Encoding picks, again and again, the pair of neighbouring parts whose bytes together have the lowest rank, the leftmost of equals. What it does
inside a stretch of text does not depend on the rest unless a merge crosses the stretch's ends. So a list of tokens is
the encoding of its bytes if and only if every two neighbours are stable: encoded together, they come out as themselves. (If a merge did cross the
boundary between two neighbours, the first one to do so would join a part of the left one with a part of the right one, and would do the
same with the two alone.) Two encoded halves are therefore joined by encoding a window around the boundary anew, and the window is final as soon as
its outer tokens are stable next to those outside it; until then it grows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.pretokens import splitter
from brindle.llm.shared import documents, texts

#: Pre-tokens and parts of them (and their bytes) whose encodings a worker keeps; beyond that it forgets all and begins anew.
CACHE_WORDS, CACHE_BYTES = 250_000, 16 << 20
#: Parts of at most so many bytes are kept.
CACHED_PART = 8
#: Bytes up to which a window is merged by looking through it; longer ones use a heap.
SHORT = 48
#: Halves of longer pieces begin at multiples of this, so that long runs of one character are cut between equal tokens.
ALIGNED = 64


class Monoid:
    """`ranks`: token bytes -> rank, all 256 bytes among them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.labels = {r: t for t, r in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self._parts: dict[bytes, tuple[int, ...]] = {bytes([b]): (ranks[bytes([b])],) for b in range(256)}
        self._stable: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self._parts = {bytes([b]): (self.ranks[bytes([b])],) for b in range(256)}
        self._stable.clear()

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The greedy merges themselves, for a window's bytes."""
        if len(piece) > SHORT:
            return self._merged_long(piece)
        rank, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            least, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap of pairs: (rank, where the left part begins), stale ones told by the ends of their parts."""
        n, rank = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if middle <= i or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := rank(piece[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        found, at = [], 0
        while at < n:
            found.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return tuple(found)

    def stable(self, a: int, b: int) -> bool:
        """Whether the neighbours a, b come out as themselves."""
        found = self._stable.get((a, b))
        if found is None:
            found = self._stable[a, b] = self.merged(self.labels[a] + self.labels[b]) == (a, b)
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of `left` and `right` put together. Associative, with () as its neutral element."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        take, upto, labels = 1, 1, self.labels
        while True:
            outer, rest = left[:-take], right[upto:]
            window = self._window(b"".join([labels[t] for t in chain(left[-take:], right[:upto])]))
            grow_left = bool(outer) and not self.stable(outer[-1], window[0])
            grow_right = bool(rest) and not self.stable(window[-1], rest[0])
            if not grow_left and not grow_right:
                return outer + window + rest
            take = min(len(left), 2 * take) if grow_left else take
            upto = min(len(right), 2 * upto) if grow_right else upto

    def _window(self, piece: bytes) -> tuple[int, ...]:
        """`merged`, kept for short windows: they return in many words."""
        found = self._parts.get(piece)
        if found is None:
            found = self.merged(piece)
            if len(piece) <= CACHED_PART:
                self._parts[piece] = found
        return found

    def reduced(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of `piece` from its halves."""
        found = self._parts.get(piece)
        if found is None:
            n = len(piece)
            if not n:
                return ()
            half = n // 2 if n < 2 * ALIGNED else n // 2 // ALIGNED * ALIGNED
            found = self.join(self.reduced(piece[:half]), self.reduced(piece[half:]))
            if n <= CACHED_PART:
                self._parts[piece] = found
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of a pre-token; one that is a token itself is taken whole."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self.reduced(piece)

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        """Bytes of the tokens: the monoid's map to byte strings, which are put together."""
        return b"".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Whole texts: each pre-token is encoded apart, and their encodings are put together."""

    def __init__(self, content: bytes):
        self.monoid = Monoid({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token})
        self.split = splitter().findall
        self.numerals = {r: str(r) for r in self.monoid.labels}
        self._words: dict[str, tuple[int, ...]] = {}
        self._held = 0

    def word(self, word: str) -> tuple[int, ...]:
        found = self._words.get(word)
        if found is None:
            raw = word.encode()
            found = self.monoid.encode(raw)
            if len(self._words) >= CACHE_WORDS or self._held > CACHE_BYTES:
                self._words.clear()
                self.monoid.forget()
                self._held = 0
            self._words[word] = found
            self._held += len(raw)
        return found

    def encode(self, text: str) -> list[int]:
        known, words = self._words, self.split(text)
        try:
            return list(chain.from_iterable([known[w] for w in words]))
        except KeyError:
            word = self.word
            return list(chain.from_iterable([word(w) for w in words]))


@lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    return Encoder(content)


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """Content of a public rank file, read on the driver; workers get it with the task."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def encoded(docs: DataFrame, content: bytes | None = None) -> DataFrame:
    """The rows of `docs` with __ids (array of token ids) and __decoded (binary: the bytes decoded from them).

    Works row by row with no shuffle. A null text counts as empty: no ids, no bytes. Very long texts and pre-tokens are encoded whole.
    Repeated rows are encoded each; other columns, null ones among them, stay as they are. An empty table gives an empty one.
    `docs` must not have columns of these two names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content or rank_file())  # a fixed file of 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(shared.value)
        for batch in batches:
            ids = [one.encode(t.decode(errors="replace")) for t in texts(batch.column("text"))]
            made = pa.array([one.monoid.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), made], [*batch.schema.names, "__ids", "__decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, __ids array<int>, __decoded binary")


def digests(docs: DataFrame, content: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes, made beside the encoder so that no ids travel. Odd rows as in `encoded`."""
    shared = docs.sparkSession.sparkContext.broadcast(content or rank_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, sha = encoder(shared.value), hashlib.sha256
        numeral = one.numerals.__getitem__
        for batch in batches:
            sizes, ids_made, bytes_made = [], [], []
            for t in texts(batch.column("text")):
                ids = one.encode(t.decode(errors="replace"))
                sizes.append(len(ids))
                ids_made.append(sha(" ".join(map(numeral, ids)).encode()).hexdigest())
                bytes_made.append(sha(one.monoid.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_made, pa.string()), pa.array(bytes_made, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded by ranks and decoded again."""
    return digests(documents(spark, sf_dir))

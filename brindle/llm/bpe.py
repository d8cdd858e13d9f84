"""Byte-level BPE by a tokenisation automaton compiled from the merges.

Each merge (a, b) -> c adds a gadget to an automaton over tokens whose state is the last token read, starting from
the one in which any byte may follow any byte: c may be read wherever a may, what may follow c is what may follow b,
and from now on b may not follow a. After all merges the automaton accepts exactly the tokenisations that
BPE gives. Its arcs are kept as a table of moves that is filled on demand (`Automaton.since`), since the
dense table of a 50,000-word vocabulary would have billions of cells.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.llm.pretokens import splitter
from brindle.llm.shared import digest_hex, documents, texts

_NEVER = 1 << 60
#: Words (and bytes of words) whose encodings a worker keeps; beyond that it forgets all but the half that it met first, the frequent ones among them.
CACHE_WORDS, CACHE_BYTES = 400_000, 16 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Automaton:
    """`vocabulary`: token bytes -> id; `merges`: pairs of token bytes in the order of their rank."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocabulary
        self.labels = {i: t for t, i in vocabulary.items()}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._arcs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges, start=1):
            pair, whole = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            if pair not in self.merged and whole not in self.born:
                self.merged[pair] = rank
                self.born[whole], self.parts[whole] = rank, pair
        # the table of the tokens read backwards: node << 8 | byte -> node; the longest token on the way to a node, and the next longest after each
        self._back: dict[int, int] = {}
        self._token: list[int] = [-1]
        self._shorter: dict[int, int] = {-1: -1}
        self._longest = 1
        for token, i in sorted(vocabulary.items(), key=lambda item: len(item[0])):
            # bytes are there from the start; a gadget adds its token only if its arc was there to be taken away
            if len(token) > 1 and (i not in self.born or self.since(*self.parts[i]) != self.born[i]):
                continue
            node = 0
            for byte in reversed(token):
                key, above = node << 8 | byte, node
                if (node := self._back.get(key, 0)) == 0:
                    node = self._back[key] = len(self._token)
                    self._token.append(self._token[above])
            self._shorter[i], self._token[node] = self._token[node], i
            self._longest = max(self._longest, len(token))
        self._sizes = {i: len(t) for t, i in vocabulary.items()}
        self._arcs.clear()

    def since(self, a: int, b: int) -> int:
        """The merge whose gadget takes the arc from state a by token b away: 0 if it never was there, _NEVER if it stays.

        The younger token's gadget copied the arc from its last part (as a state) or its first part (as an
        arc), as they were at that time.
        """
        key = (a, b)
        if (known := self._arcs.get(key)) is not None:
            return known
        old, new = self.born.get(a, 0), self.born.get(b, 0)
        if a == b and old:
            first, last = self.parts[a]
            there = self.since(last, first) >= old
        elif old > new:
            there = self.since(self.parts[a][1], b) >= old
        elif new > old:
            there = self.since(a, self.parts[b][0]) > new
        else:
            there = True
        self._arcs[key] = found = self.merged.get(key, _NEVER) if there else 0
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Token ids of a pre-split word.

        Every stretch of a word has exactly one path that the automaton accepts. It is found from the word's end: the backward table gives the tokens that
        end at a place, the longest first, and one is taken if there is an arc from it to the token after it. A place that none leads on from is
        reached by no other path, so it is given up for good.
        """
        back, token_at, arcs, shorter, sizes, reach = word[::-1], self._token, self._arcs, self._shorter, self._sizes, self._longest
        step, n, at, after = self._back.get, len(word), 0, -1  # places count from the end
        found: list[int] = []
        dead: set[int] = set()
        while at < n:
            node = 0
            for byte in back[at : at + reach]:
                if not (below := step(node << 8 | byte, 0)):
                    break
                node = below
            token = token_at[node]
            while True:
                while token >= 0:
                    if after < 0:
                        there = True
                    else:
                        arc = arcs.get((token, after))
                        there = (self.since(token, after) if arc is None else arc) == _NEVER
                    if there and at + sizes[token] not in dead:
                        break
                    token = shorter[token]
                if token >= 0:
                    break
                if not found:
                    raise ValueError("a byte is not in the vocabulary")
                dead.add(at)
                token = found.pop()
                at -= sizes[token]
                after = found[-1] if found else -1
                token = shorter[token]
            found.append(token)
            at += sizes[token]
            after = token
        found.reverse()
        return tuple(found)


class Tokenizer:
    """A byte-level BPE tokenizer file (vocabulary, merges, special tokens) compiled to an automaton."""

    def __init__(self, content: str):
        spec = json.loads(content)
        before = spec["pre_tokenizer"]
        if before["type"] != "ByteLevel" or not before.get("use_regex", True) or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only files with a plain ByteLevel pre-tokenizer and no normalizer are understood")
        alphabet = byte_alphabet()
        to_bytes = lambda t: bytes(alphabet[c] for c in t)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.automaton = Automaton({to_bytes(t): i for t, i in spec["model"]["vocab"].items()}, [(to_bytes(a), to_bytes(b)) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t.encode() for t, i in self.special.items()}
        self.pattern = splitter().of
        self.split = splitter().findall
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.numerals = {i: str(i) for i in self.labels}
        self._words: dict[str, tuple[int, ...]] = {}
        self._held = 0
        self._forget()

    def _forget(self) -> None:
        """Keeps half of the words at most, in number and bytes; special tokens' strings count as words of one token."""
        kept = {s: (i,) for s, i in self.special.items()}
        held = 0
        for word, ids in islice(self._words.items(), CACHE_WORDS // 2):
            if held > CACHE_BYTES // 2:
                break
            kept[word] = ids
            held += len(word)
        self._words, self._held = kept, held
        self.automaton._arcs.clear()

    def word(self, word: str) -> tuple[int, ...]:
        found = self._words.get(word)
        if found is None:
            found = self.automaton.encode(word.encode())
            if len(self._words) >= CACHE_WORDS or self._held > CACHE_BYTES:
                self._forget()
            self._words[word] = found
            self._held += len(word)
        return found

    def ordinary(self, text: str) -> list[int]:
        known, words = self._words, self.split(text)
        try:
            return list(chain.from_iterable([known[w] for w in words]))
        except KeyError:
            word = self.word
            return list(chain.from_iterable([word(w) for w in words]))

    def encode(self, text: str) -> list[int]:
        """Ids of `text`; a special token's string becomes its id."""
        if not self.specials or not any(s in text for s in self.special):
            return self.ordinary(text)
        ids: list[int] = []
        for part in self.specials.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self.ordinary(part)
        return ids

    def pieces(self, text: str, begin: int = 0) -> Iterator[tuple[int, str]]:
        """(place, string) of the pre-tokens from place `begin` on, special tokens' strings among them; `begin` is where one starts."""
        finditer = self.pattern(text).finditer
        has_special = any(s in text for s in self.special)
        while True:
            special = self.specials.search(text, begin) if has_special else None
            end = special.start() if special else len(text)
            for match in finditer(text, begin, end):
                yield match.start(), match.group()
            if not special:
                return
            yield end, special.group()
            begin = special.end()

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each of the pre-tokens."""
        try:
            return list(map(len, map(self._words.__getitem__, pieces)))
        except KeyError:
            return [len(self.word(w)) for w in pieces]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels put together; broken UTF-8 gives U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def compiled(content: str) -> Tokenizer:
    made = Tokenizer(content)
    gc.freeze()  # its tables stay, so no collection need go through them
    return made


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Content of a public tokenizer file, read on the driver; workers get it with the task."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, content: str | None = None) -> DataFrame:
    """The rows of `docs` with __ids (array of token ids) and __decoded (the text decoded from them).

    Works row by row with no shuffle. A null text counts as empty: no ids, an empty decoded text. Very long texts
    and words take time in proportion; repeated rows are encoded each; other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content or tokenizer_file())  # a fixed file of 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(shared.value)
        for batch in batches:
            ids = [tokenizer.encode(t.decode()) for t in texts(batch.column("text"))]
            made = pa.array([tokenizer.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), made], [*batch.schema.names, "__ids", "__decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, __ids array<int>, __decoded string")


def digests(docs: DataFrame, content: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, made beside the encoder so that no ids travel."""
    shared = docs.sparkSession.sparkContext.broadcast(content or tokenizer_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(shared.value)
        numeral = tokenizer.numerals.__getitem__
        for batch in batches:
            sizes, ids_made, texts_made = [], [], []
            for t in texts(batch.column("text")):
                ids = tokenizer.encode(t.decode())
                sizes.append(len(ids))
                ids_made += digest_hex([",".join(map(numeral, ids)).encode()])
                texts_made += digest_hex([tokenizer.decode(ids).encode()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_made), pa.array(texts_made)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


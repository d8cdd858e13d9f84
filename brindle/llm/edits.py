"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf stands for a run of pre-tokens and holds how many characters, tokens and pre-tokens it has; inner nodes hold sums. The pre-tokens of a leaf are
found again by splitting its part of the text, so a stored tree is a few numbers for every 16 pre-tokens, and an edit looks only at the leaves
where it begins and ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.bpe import Tokenizer, compiled, tokenizer_file
from brindle.llm.shared import documents, texts, written

#: Pre-tokens in a leaf; a leaf of more than GROWN times as many is divided.
LEAF, GROWN = 16, 8
#: Characters of an edited stretch up to which its old pre-tokens are counted again; of a longer one the leaves' ends are.
NEAR = 2000
_SUMS = ("chars", "tokens", "pieces")
#: Columns of a stored tree: each an array of inner nodes and leaves, node n over 2 n and 2 n + 1.
STORED = [f"__{s}" for s in _SUMS]


class CountTree:
    """Characters, tokens and pre-tokens of runs of a text, summed up a binary tree: three arrays of twice the width, leaves in the second half."""

    def __init__(self, nodes: tuple[np.ndarray, np.ndarray, np.ndarray], shared: bool = False):
        self.nodes, self._shared = nodes, shared

    @classmethod
    def of(cls, leaves: np.ndarray) -> CountTree:
        """`leaves`: a row each of characters, tokens and pre-tokens."""
        width = 1 << max(0, leaves.shape[1] - 1).bit_length()
        nodes = np.zeros((3, 2 * width), dtype=np.int64)
        nodes[:, width : width + leaves.shape[1]] = leaves
        low = width
        while low > 1:
            low //= 2
            np.add(nodes[:, 2 * low : 4 * low : 2], nodes[:, 2 * low + 1 : 4 * low : 2], out=nodes[:, low : 2 * low])
        return cls(tuple(nodes))

    @classmethod
    def counted(cls, sizes: list[int], counts: list[int]) -> CountTree:
        """From the characters and tokens of all pre-tokens."""
        if not sizes:
            return cls.of(np.zeros((3, 1), dtype=np.int64))
        at = np.arange(0, len(sizes), LEAF)
        return cls.of(np.stack([np.add.reduceat(np.array(sizes, dtype=np.int64), at), np.add.reduceat(np.array(counts, dtype=np.int64), at), np.diff(np.append(at, len(sizes)))]))

    @property
    def width(self) -> int:
        return len(self.nodes[0]) // 2

    n_chars = property(lambda self: int(self.nodes[0][1]))
    n_tokens = property(lambda self: int(self.nodes[1][1]))
    n_pieces = property(lambda self: int(self.nodes[2][1]))

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character `place` (the last one with any, beyond the end) and where it begins."""
        chars, node, before = self.nodes[0], 1, 0
        while node < self.width:
            node *= 2
            if before + chars[node] <= place and chars[node + 1]:
                before += int(chars[node])
                node += 1
        return node - self.width, before

    def end_of(self, leaf: int, begin: int) -> int:
        return begin + int(self.nodes[0][self.width + leaf])

    def replace(self, first: int, last: int, values: tuple[int, int, int]) -> None:
        """Leaf `first` stands for all up to and with `last`; their sums, and those above them, follow."""
        if self._shared:
            self.nodes, self._shared = tuple(n.astype(np.int64) for n in self.nodes), False
        low, high = self.width + first, self.width + last
        for nodes, value in zip(self.nodes, values):
            nodes[low : high + 1] = 0
            nodes[low] = value
            a, b = low, high
            while a > 1:
                a, b = a >> 1, b >> 1
                nodes[a : b + 1] = nodes[2 * a : 2 * b + 2 : 2] + nodes[2 * a + 1 : 2 * b + 2 : 2]

    def divided(self, leaf: int, sizes: list[int], counts: list[int]) -> CountTree:
        """A leaf's pre-tokens as leaves of their own."""
        inside, old = CountTree.counted(sizes, counts), [n[self.width :] for n in self.nodes]
        new = [n[inside.width :] for n in inside.nodes]
        return CountTree.of(np.stack([np.concatenate([o[:leaf], n, o[leaf + 1 :]]) for o, n in zip(old, new)]))


def counted(text: str, tokenizer: Tokenizer) -> tuple[list[int], list[int]]:
    """Characters and tokens of each pre-token."""
    has_special = any(s in text for s in tokenizer.special)
    found = [w for _, w in tokenizer.pieces(text)] if has_special else tokenizer.split(text)
    return list(map(len, found)), tokenizer.counts(found)


class _Leaves:
    """A tree that also knows its text: `sizes` are the pre-tokens' lengths, leaf by leaf, by splitting."""

    def __init__(self, owner: CountedText):
        self._owner = owner

    def __getattr__(self, name: str):
        return getattr(self._owner.counts, name)

    @property
    def sizes(self) -> list[list[int]]:
        owner, begin, out = self._owner, 0, []
        for size in owner.counts.nodes[0][owner.counts.width :].tolist():
            out.append([len(w) for w in owner.between(owner.text, begin, begin + size)])
            begin += size
        return out


class CountedText:
    """A text with its tree. A special token's string is a pre-token of one token, as the encoder has it."""

    def __init__(self, text: str, tokenizer: Tokenizer, nodes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.text, self.tokenizer, self.reencoded, self.touched = text, tokenizer, 0, 0
        self.counts = CountTree.counted(*counted(text, tokenizer)) if nodes is None else CountTree(nodes, shared=True)

    @property
    def tree(self) -> _Leaves:
        return _Leaves(self)

    def between(self, text: str, begin: int, end: int) -> list[str]:
        """Pre-tokens of `text` from one that begins at `begin` to one that ends at `end`."""
        out = []
        if begin < end:
            for at, piece in self.tokenizer.pieces(text, begin):
                out.append(piece)
                if at + len(piece) >= end:
                    break
        return out

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end) by `new` and re-encodes the pre-tokens concerned, and those beside them in the leaves at both ends.

        Splitting looks at most at one character beyond the one after a pre-token, and a special token's string may come to be, or cease
        to, only where it meets the edit; pre-tokens that end farther before it than both reach stay.
        After the edit, splitting goes on until it meets an old boundary: from there on all is as before.
        """
        old, tree = self.text, self.counts
        n = len(old)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        self.text = old[:start] + new + old[end:]
        if not tree.n_chars:
            sizes, counts = counted(self.text, self.tokenizer)
            self.reencoded += len(sizes)
            self.touched += len(sizes)
            self.counts = CountTree.counted(sizes, counts)
            return
        reach = max([2, *map(len, self.tokenizer.special)])
        first, at = tree.leaf_at(max(0, start - reach))
        before = []
        for here, piece in self.tokenizer.pieces(old, at):
            if here + len(piece) > start - reach:
                at = here
                break
            before.append(piece)
        else:
            at = n
        # old boundaries behind the edit, from the leaf that holds its end
        last, begin = tree.leaf_at(end)
        if last < first:
            last, begin = first, at
        shift = start + len(new) - end
        places = (here for here, _ in self.tokenizer.pieces(old, begin))
        place, fresh, met = next(places, n), [], n
        for here, piece in self.tokenizer.pieces(self.text, at):
            if here >= start + len(new):
                while place < here - shift:
                    place = next(places, n)
                if place == here - shift:
                    met = place
                    break
            fresh.append(piece)
        if met < n:
            last, begin = tree.leaf_at(met)
            end_of_last = tree.end_of(last, begin)
            if begin == met and last > first:  # the leaf begins there: nothing of it changes
                last, end_of_last = last - 1, met
        else:
            last, end_of_last = tree.width - 1, n
        self.reencoded += len(fresh)
        count = self.tokenizer.counts
        if met - at <= NEAR:
            gone = self.between(old, at, met)
            low, high = tree.width + first, tree.width + last + 1
            chars, tokens, pieces = (int(x[low:high].sum()) for x in tree.nodes)
            values = (chars + len(self.text) - n, tokens - sum(count(gone)) + sum(count(fresh)), pieces - len(gone) + len(fresh))
            self.touched += len(gone) + len(fresh)
        else:
            made = [*before, *fresh, *self.between(old, met, end_of_last)]
            values = (sum(map(len, made)), sum(count(made)), len(made))
            self.touched += len(made)
        tree.replace(first, last, values)
        if values[2] > GROWN * LEAF:
            leaf, begin = first, int(tree.nodes[0][tree.width : tree.width + first].sum())
            made = self.between(self.text, begin, begin + values[0])
            self.touched += len(made)
            self.counts = tree.divided(leaf, list(map(len, made)), count(made))


def _lists(trees: list[CountTree]) -> list[pa.Array]:
    """The three columns of stored trees."""
    offsets = pa.array(np.concatenate(([0], np.cumsum([2 * t.width for t in trees]))).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t.nodes[k] for t in trees] or [np.empty(0)]).astype(np.int32))) for k in range(3)]


def _slices(lists: pa.Array) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


_DDL = ", ".join(f"{c} array<int>" for c in STORED)


def trees(docs: DataFrame, content: str | None = None) -> DataFrame:
    """The rows of `docs` with __chars, __tokens and __pieces: the nodes of each text's tree, inner ones too, to store."""
    shared = docs.sparkSession.sparkContext.broadcast(content or tokenizer_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(shared.value)
        for batch in batches:
            made = [CountTree.counted(*counted(t.decode(), tokenizer)) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_lists(made)], [*batch.schema.names, *STORED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {_DDL}")


def recounted(rows: DataFrame, content: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_pretokens, n_reencoded, the edited text, and the edited tree's columns, of `rows`.

    `rows`: doc_id, text, edits (array of start, end, text: applied one after another, in characters, cut to the
    text) and, if the trees are stored, their columns; else they are built first. With `edited` as `text`, the result can be stored and edited
    again. Null texts count as empty, null edits as none, a null replacement as empty, a null start as 0 and a null end as the start; repeated rows are counted each; other columns are ignored.
    """
    shared = rows.sparkSession.sparkContext.broadcast(content or tokenizer_file())
    stored = set(STORED) <= set(rows.columns)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(shared.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            made: list[CountTree] = []
            nodes = list(zip(*(_slices(batch.column(c)) for c in STORED))) if stored else None
            for i, (raw, edits) in enumerate(zip(texts(batch.column("text")), batch.column("edits").to_pylist())):
                one = CountedText(raw.decode(), tokenizer, nodes[i] if nodes else None)
                before, pretokens = one.counts.n_tokens, one.counts.n_pieces
                for e in edits or ():
                    start = e["start"] or 0
                    one.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                made.append(one.counts)
                for values, value in zip(out, (before, one.counts.n_tokens, pretokens, one.reencoded, one.text)):
                    values.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out, kinds)), *_lists(made)], ["doc_id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", "edited", *STORED])

    names = ["doc_id", "text", "edits", *(STORED if stored else [])]
    return rows.select(*names).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long, edited string, {_DDL}")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's tree is stored; three edits then work on the stored trees: the middle 20 characters are replaced, a note is put
    before, the last 16 characters are taken away."""
    kept = written(trees(documents(spark, sf_dir).selectExpr("doc_id", "coalesce(text, '') as text")), "trees")
    note, passage = "Note: ", " an edited passage "
    rows = kept.selectExpr("*", "length(text) as n").selectExpr("*", "int(greatest(n div 2 - 10, 0)) as a", "int(least(n div 2 + 10, n)) as b")
    rows = rows.selectExpr("*", f"int(greatest(n - (b - a) + {len(passage) + len(note) - 16}, 0)) as tail")
    edits = f"array(named_struct('start', a, 'end', b, 'text', '{passage}'), named_struct('start', 0, 'end', 0, 'text', '{note}'), named_struct('start', tail, 'end', {2**31 - 1}, 'text', ''))"
    counted = recounted(rows.selectExpr("doc_id", "text", *STORED, f"{edits} as edits"))
    return counted.selectExpr("doc_id", "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded", "sha2(edited, 256) as edited_sha256")

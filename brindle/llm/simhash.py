"""SimHash near-duplicates by multi-index hashing, and near-duplicates by exact similarity of shingle sets."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import words
from brindle.llm.components import components
from brindle.llm.shared import chunks, small_or_none, texts, written

SEED = 42
_STEP = 1 << 15


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are made and searched.

    `segments`: the fingerprint's segments in bits, each inside one 64-bit word. Fingerprints that differ in at most
    `distance` bits differ in at most distance // len(segments) bits of some segment (pigeonhole), so
    with `radius` at least that, enumerating the balls of `radius` around every segment finds all of them.
    """

    shingle: int = 4
    segments: tuple[int, ...] = (22, 21, 21)
    radius: int = 1
    distance: int = 4

    @property
    def bits(self) -> int:
        return sum(self.segments)

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.bits // 64)]


    @property
    def probes(self) -> list[int]:
        """Probes of a fingerprint into the tables of each segment."""
        return [sum(math.comb(width, k) for k in range(self.radius + 1)) for width in self.segments]


@dataclass(frozen=True)
class Unions(Scheme):
    """The same with keys of several segments together: fingerprints that differ in at most `distance` bits have at least len(segments) - distance segments that are equal, so every
    choice of that many is a table, and each is probed at the fingerprint itself, a ball of radius 0."""

    segments: tuple[int, ...] = (8,) * 8
    radius: int = 0

    @property
    def masks(self) -> list[int]:
        """The bits of each table's key, as signed longs."""
        ends = np.cumsum(self.segments).tolist()
        one = [((1 << width) - 1) << (64 - end) for width, end in zip(self.segments, ends)]
        chosen = [sum(one[k] for k in c) for c in combinations(range(len(one)), len(one) - self.distance)]
        return [m - (1 << 64) if m >> 63 else m for m in chosen]


#: Ways to find all pairs within four bits by single segments: few probes into tables of short ones, or many into those of long ones.
SCHEMES = (Scheme(), Scheme(segments=(32, 32), radius=2))


def work(scheme: Scheme, count: int) -> float:
    """Probes of a fingerprint among so many, and the rows that each of them meets by chance."""
    if isinstance(scheme, Unions):
        return len(scheme.masks) * (2 + count / 2 ** (scheme.bits * (len(scheme.segments) - scheme.distance) // len(scheme.segments)))
    return sum(n * (1 + count / 2**w) for n, w in zip(scheme.probes, scheme.segments))


def scheme_for(count: int) -> Scheme:
    """Of SCHEMES the one with the least work. All find the same pairs."""
    return min(SCHEMES, key=lambda s: work(s, count))


def search_for(count: int) -> Scheme:
    """The way with the least work for so many fingerprints, single segments or unions of them: some 70 probes for small tables and for large ones."""
    return min((scheme_for(count), Unions()), key=lambda s: work(s, count))


#: Up to so many fingerprints single segments are searched. Beyond, the rows that a segment of 21 bits meets by chance would grow with the square of the table.
FEW = 1 << 14


def growing_search(count: int) -> Scheme:
    """The way for so many fingerprints whose rows grow no faster than the table."""
    return search_for(count) if count <= FEW else Unions()


def fingerprint(text: bytes, shingle: int, bits: int = 64) -> bytes:
    """Big-endian fingerprint: a bit is 1 if set in over half of the shingles' hashes; no words: zero."""
    found = text.lower().split()
    if not found:
        return bytes(bits // 8)
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = [digest(joined, SEED)]
        return hashes[0]
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(size + 1) - 1
    view, starts, ends = memoryview(joined), (end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist()
    counts = np.zeros(bits, dtype=np.int64)
    for i in range(0, len(starts), _STEP):
        part = b"".join([digest(view[s:e], SEED) for s, e in zip(starts[i : i + _STEP], ends[i : i + _STEP])])
        counts += np.unpackbits(np.frombuffer(part, dtype=np.uint8)).reshape(-1, bits).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(starts)).tobytes()


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id and the fingerprint as signed 64-bit columns f0, f1, ... of every row; a null text has no words."""
    shingle, bits, names = scheme.shingle, scheme.bits, scheme.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join(fingerprint(t, shingle, bits) for t in texts(batch.column(1)))
            numbers = np.frombuffer(made, dtype=">i8").astype(np.int64).reshape(-1, bits // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(numbers[:, i].copy()) for i in range(bits // 64))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def ball(width: int, radius: int) -> Iterator[int]:
    """Every mask of `width` bits with at most `radius` of them set."""
    for n in range(radius + 1):
        for places in combinations(range(width), n):
            yield sum(1 << p for p in places)


def _sides(prints: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(table, probes) of `prints` (node, component, fingerprint columns), by key: rows of all tables as b, and of all probes as a."""
    names = scheme.columns
    literal = lambda xs: F.explode(F.expr(f"array({', '.join(f'{x}L' for x in xs)})"))
    side = lambda x: [f"node as {x}", f"component as component_{x}", *(f"{f} as {x}_{f}" for f in names)]
    if isinstance(scheme, Unions):
        keyed = prints.withColumn("mask", literal(scheme.masks))
        key = "xxhash64(mask, f0 & mask) as key"  # keys that fall together only meet rows in vain
        return keyed.selectExpr(key, *side("b")), keyed.selectExpr(key, *side("a"))
    cases, masks, place = [], [], 0
    for i, width in enumerate(scheme.segments):
        word, low = place // 64, 64 - place % 64 - width
        cases.append(f"when {i} then (shiftrightunsigned(f{word}, {low}) & {(1 << width) - 1}L) | {i << 32}L")
        masks += [(i << 32) | x for x in ball(width, scheme.radius)]
        place += width
    value = "case seg " + " ".join(cases) + " end"
    table = prints.withColumn("seg", literal(range(len(scheme.segments)))).selectExpr(f"{value} as key", *side("b"))
    probes = prints.withColumn("probe", literal(masks)).withColumn("seg", F.expr("shiftright(probe, 32)")).selectExpr(f"({value}) ^ (probe & 4294967295L) as key", *side("a"))
    return table, probes


def _near(scheme: Scheme) -> str:
    return " + ".join(f"bit_count(a_{x} ^ b_{x})" for x in scheme.columns) + f" <= {scheme.distance}"


def links(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """All pairs (a, b) of nodes whose fingerprints differ in at most `scheme.distance` bits.

    `prints`: node and the fingerprint columns, a row for each different fingerprint. Its segments are the
    tables; each fingerprint probes the ball around each of its segments, and the complete distance is part of
    the join's condition, so that no farther pair leaves the join. A frequent segment value is a skewed
    join key, which adaptive execution splits.
    """
    table, probes = _sides(prints.withColumn("component", F.col("node")), scheme)
    return probes.join(table.hint("shuffle_merge"), "key").where(f"a < b and {_near(scheme)}").select("a", "b").distinct()


def met_rows(prints: DataFrame, scheme: Unions) -> DataFrame:
    """(key, node, f0, hub): of the tables' rows those whose key several rows have, and the first of these. By 32-bit keys rows seldom meet by chance, so these are few."""
    keyed = prints.withColumn("mask", F.explode(F.expr(f"array({', '.join(f'{x}L' for x in scheme.masks)})"))).selectExpr("xxhash64(mask, f0 & mask) as key", "node", "f0")  # keys that fall together only meet rows in vain
    repeated = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    return keyed.join(repeated.hint("shuffle_merge"), "key")


def hub_links(met: DataFrame, scheme: Unions) -> DataFrame:
    """Links (a, b) of each of the `met_rows` with the first one of its key: as many as rows at most, which tie nearly all of a group of near copies together."""
    hubs = met.where("node = hub").selectExpr("key", "node as a", "f0 as a_f0")
    joined = met.where("node <> hub").selectExpr("key", "node as b", "f0 as b_f0").join(hubs.hint("shuffle_merge"), "key")
    return joined.where(_near(scheme)).selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()


def _linked_by_unions(prints: DataFrame, scheme: Unions) -> DataFrame:
    met = written(met_rows(prints, scheme), "met")
    first = written(hub_links(met, scheme), "links")
    roots = written(components(first), "roots")
    marked = met.join(F.broadcast(roots) if small_or_none(roots) else roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    live = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rows = written(marked.join(live.hint("shuffle_merge"), "key", "left_semi"), "live")
    side = lambda x: rows.selectExpr("key", f"node as {x}", f"f0 as {x}_f0", f"component as component_{x}")
    rest = side("a").join(side("b").hint("shuffle_merge"), "key").where(f"a < b and component_a <> component_b and {_near(scheme)}").select("a", "b").distinct()
    return components(first.union(rest))


def linked(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, root) of the nodes of `prints` (node, fingerprint columns) that a link ties to another.

    First a probe meets only the first row of a table's key: as many pairs as probes, which tie nearly all of a group of near copies together. Then what is left in different components
    is compared at the keys that several components have, so no link between components is missed and a group makes no pairs within itself.
    """
    if isinstance(scheme, Unions):
        return _linked_by_unions(prints, scheme)
    alone = prints.withColumn("component", F.col("node"))
    table, probes = _sides(alone, scheme)
    names = [c for c in table.columns if c != "key"]
    hubs = table.groupBy("key").agg(F.min(F.struct(*names)).alias("hub")).select("key", "hub.*")
    first = written(probes.join(hubs.hint("shuffle_merge"), "key").where(f"a <> b and {_near(scheme)}").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "links")
    roots = written(components(first), "roots")
    marked = written(prints.join(F.broadcast(roots) if small_or_none(roots) else roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root"), "marked")
    table, probes = _sides(marked, scheme)
    # a probe matters where a table row of another component has its key; of a table's key, the lowest and the highest component tell
    ends = table.groupBy("key").agg(F.min("component_b").alias("low"), F.max("component_b").alias("high"))
    asking = written(probes.join(ends.hint("shuffle_merge"), "key").where("component_a <> low or component_a <> high").drop("low", "high"), "asking")
    answers = table.join(asking.select("key").distinct(), "key", "left_semi")
    rest = asking.join(answers.hint("shuffle_merge"), "key").where(f"component_a <> component_b and {_near(scheme)}").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()
    return components(first.union(rest))


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, f0, ... and component_id, the smallest doc_id reachable over links, itself included; without a scheme the best for the table's size.

    Equal fingerprints are one node, so copies add no pairs. Null or empty texts have fingerprint zero and link
    like any other; repeated rows stay; a null doc_id takes part but is never a component_id unless its component
    has no other; an empty table gives no rows; other columns are ignored.
    """
    names = (scheme or SCHEMES[0]).columns
    node = "f0" if len(names) == 1 else f"xxhash64({', '.join(names)})"
    prints = written(fingerprints(docs, scheme or SCHEMES[0]), "fingerprints")
    nodes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", F.expr(node)), "nodes")
    roots = linked(nodes.select("node", *names), scheme or growing_search(nodes.count()))
    joined = roots.join(nodes.select("node", "least"), "node")
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = written(roots.join(lowest, "root").select("node", "component_id"), "linked")
    labels = nodes.join(labelled, "node", "left").select(*names, F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(labels, names).select("doc_id", *names, "component_id")


#: Words of a shingle in the search for near-duplicates by exact similarity.
NEAR_SHINGLE = 5
#: Shingles that this many of an eighth of the documents have count as frequent, the most frequent FREQUENT of them at most. Which
#: ones do changes how many candidates there are, never which documents are found similar.
OFTEN, FREQUENT = 3, 200_000


def shingles(rows: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each text, ascending; a text of fewer words is one shingle, one of no words has none."""
    found = words.split(rows, words.SPACED)
    n, value = np.diff(found.first), words.grams(found.hashes(), shingle)
    row = found.doc()[: len(value)]
    inside = np.arange(len(value)) + shingle <= found.first[1:][row]
    short = np.flatnonzero((n > 0) & (n < shingle))
    whole = [xxhash.xxh64_intdigest(b" ".join(map(found.word, range(found.first[i], found.first[i + 1]))), SEED) for i in short]
    row, value = np.concatenate([row[inside], short]), np.concatenate([value[inside], np.array(whole, dtype=np.uint64)])
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def set_fingerprint(own: np.ndarray) -> int:
    """SimHash of a shingle set (64-bit hashes) as a signed long: a bit is 1 if set in over half of the hashes; no shingles: zero."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(own), _STEP):
        counts += np.unpackbits(own[i : i + _STEP].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(own)).tobytes(), "big", signed=True)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    """The shingle set of each row's text (column 1)."""
    rows = texts(batch.column(1))
    for lo, hi in chunks(rows):
        row, value = shingles(rows[lo:hi], shingle)
        yield from np.split(value, np.searchsorted(row, np.arange(1, hi - lo)))


def frequent_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Frequent shingles of a sample of the documents, the less frequent first; at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(1))
            for lo, hi in chunks(rows):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(rows[lo:hi], shingle)[1].view(np.int64))], ["value"])

    seen = docs.where("pmod(xxhash64(doc_id), 8) = 0").select("doc_id", "text").mapInArrow(run, "value long")
    often = seen.groupBy("value").count().where(f"count >= {OFTEN}").orderBy(F.desc("count"), "value").limit(FREQUENT)
    return often.toArrow().column("value").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, content, the digest d0, d1 and the SimHash f0 of the text's shingle set, its size, and the rarest of its shingles, so many that no
    set of at least this similarity is without one of them (frequent shingles are last, the order is the same for all texts).
    `docs`: doc_id, content (any number that is passed on) and text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))  # at most FREQUENT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(shared.value)
        known = shared.value[by]
        for batch in batches:
            digests, prints, sizes, rarest = [], [], [], []
            for own in _sets(batch, shingle):
                digests.append(xxhash.xxh3_128_digest(own.tobytes(), SEED))
                prints.append(set_fingerprint(own))
                sizes.append(len(own))
                rank = np.zeros(len(own), dtype=np.int64)
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, by[at] + 1, 0)
                length = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                rarest.append(own[np.argsort(rank, kind="stable")[:length]].view(np.int64))
            numbers = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[::2], pa.array(numbers[:, 0].copy()), pa.array(numbers[:, 1].copy()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rarest, pa.list_(pa.int64()))],
                ["doc_id", "content", "d0", "d1", "f0", "size", "rarest"],
            )

    return docs.select("doc_id", "text", "content").mapInArrow(run, "doc_id long, content long, d0 long, d1 long, f0 long, size int, rarest array<long>")


def _close(joined: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a the larger set) that share a shingle, at pos_a and pos_b in their orders, those that may be similar.

    The first shingle in the order that two similar sets share is in the larger one's `rarest` and, because of the overlap
    they need, nearer to the smaller one's beginning still; beyond its place enough shingles must be left in both.
    """
    near = joined.where("size_b < size_a or (size_b = size_a and b < a)").where(f"size_b >= {similarity} * size_a - 1e-6").where(f"pos_b <= size_b - {2 * similarity / (1 + similarity)} * size_b + 1e-6")
    return near.where(f"{1 + similarity} * least(size_a - pos_a, size_b - pos_b) >= {similarity} * (size_a + size_b) - 1e-6").select("a", "b").distinct()


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("value", F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("size", "pos", *more)))


def shared_rows(sets: DataFrame) -> DataFrame:
    """(value, node, size, pos, hub): of the sets' rarest shingles (`sets`: node, size, rarest) those that several nodes have, and the first of these."""
    rows = sets.select("node", "size", F.posexplode("rarest").alias("pos", "value"))
    repeated = rows.groupBy("value").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("value", "hub")
    return rows.join(repeated.hint("shuffle_merge"), "value")


def hub_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each row with the first node that has the same shingle: as many as there are rows, however many share a shingle."""
    hubs = rows.where("node = hub").hint("shuffle_merge")
    joined = _side(rows, "a").join(_side(hubs, "b"), "value")
    turned = joined.select("value", *(F.col(f"{c}{x}").alias(f"{c}{y}") for c in ("", "size_", "pos_") for x, y in (("a", "b"), ("b", "a"))))
    return _close(joined.unionByName(turned), similarity)


def other_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of all rows with the same shingle but different `component`; a shingle of one component only makes none."""
    live = rows.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("value")
    rows = written(rows.join(live.hint("shuffle_merge"), "value", "left_semi"), "live")
    joined = _side(rows, "a", "component").join(_side(rows, "b", "component").hint("shuffle_merge"), "value").where("component_a <> component_b")
    return _close(joined, similarity)


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, size, shingles): the different shingles of each text of `rows` (node, text), as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(batch, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["node", "size", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, size int, shingles array<long>")


def similar_components(docs: DataFrame, nodes: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of all nodes linked by a Jaccard similarity of at least `similarity`.

    First come the pairs that multi-index hashing of the sets' SimHash finds, as far as their exact similarity is as high as that: most near copies. A SimHash may miss pairs of this similarity, so
    then every node is compared with the first one of each shingle it is looked up by, unless both are tied already; in a group of near copies this links nearly all.
    Only nodes that this leaves in different components are then compared with each other, so no link between components is missed.
    """
    scheme = Unions()
    near = written(hub_links(written(met_rows(nodes.where("size > 0").select("node", "f0"), scheme), "met"), scheme), "near")
    near = written(_similar(near, docs, nodes, shingle, similarity), "links")
    rows = written(shared_rows(sets), "shared")
    pairs = _untied(written(hub_pairs(rows, similarity), "pairs"), written(components(near), "roots"))
    first = written(near.union(_similar(written(pairs, "pairs"), docs, nodes, shingle, similarity)), "links")
    roots = written(components(first), "roots")
    marked = rows.join(F.broadcast(roots) if small_or_none(roots) else roots, "node", "left").select("node", "size", "pos", "value", F.coalesce("root", "node").alias("component"))
    rest = written(_similar(written(other_pairs(marked, similarity), "pairs"), docs, nodes, shingle, similarity), "links")
    return components(first.union(rest))


def _untied(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that `roots` (node, root) does not have in one component."""
    roots = F.broadcast(roots) if small_or_none(roots) else roots
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are as similar as that, by their whole sets."""
    ids = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "least"), "node").select("node", "least.*"), "ends")
    rows = _rows(docs).select("doc_id", "content", "text").join(F.broadcast(ids) if small_or_none(ids) else ids, ["doc_id", "content"])
    sets = written(shingle_sets(rows.select("node", "text"), shingle), "sets")
    if sets.count() > ids.count():  # repeated rows
        sets = written(sets.dropDuplicates(["node"]), "sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("shingles").alias(f"shingles_{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("shingles_a", "shingles_b")))
    return both.where(f"shared >= {similarity} * (size_a + size_b - shared)").select("a", "b")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash and the text: what a row is known by, as ids may repeat."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("content"), "text")


def deduplicated(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each near-duplicate group: that with the smallest doc_id (of several, that of the smallest text hash).

    Rows with equal sets of shingles are one node; others are linked if the exact Jaccard similarity of their sets is at
    least `similarity`: SimHash and multi-index hashing find most, an exact filter the rest, and no such link is missed. Rows with null doc_ids stay; rows of one doc_id with different texts are
    judged each for itself, and of rows with the same text one is kept; texts without words are equal to each other; an
    empty table gives no rows.
    """
    names = ["d0", "d1"]
    prints = written(prefixes(_rows(docs), shingle, similarity), "sets")
    first = F.struct("doc_id", "content")
    nodes = written(prints.groupBy(*names).agg(F.min(first).alias("least"), F.min("f0").alias("f0"), F.min("size").alias("size")).withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers, fixed as they are written
    sets = prints.join(nodes.select("node", "least", *names), names).where(first == F.col("least")).select("node", "size", "rarest").dropDuplicates(["node"])
    sets = written(sets, "rarest")
    roots = similar_components(docs, nodes, sets, shingle, similarity).join(nodes.select("node", "least"), "node")
    stays = roots.groupBy("root").agg(F.min("least").alias("stays"))
    later = roots.join(stays, "root").where("least <> stays").select("node")
    # whole nodes that go, and of the others all but the first
    gone = prints.join(nodes.select("node", "least", *names), names).join(later.withColumn("late", F.lit(True)), "node", "left").where(F.col("late") | (first != F.col("least")))
    gone = written(gone.select("doc_id", "content").distinct(), "gone")
    same = lambda rows: (docs["doc_id"].cast("bigint") == rows["of"]) & (F.xxhash64(docs["text"]) == rows["content"])
    gone_keys = gone.select(F.col("doc_id").alias("of"), "content")
    gone_keys = F.broadcast(gone_keys) if small_or_none(gone) else gone_keys
    left = docs.join(gone_keys, same(gone_keys), "left_anti")
    if not prints.groupBy("doc_id", "content").count().where("count > 1").isEmpty():
        one, text = (f"__{uuid.uuid4().hex}" for _ in range(2))  # names that no table has
        keyed = left.withColumns({one: F.col("doc_id").cast("bigint"), text: F.xxhash64("text")})
        left = keyed.where("doc_id is null").unionByName(keyed.where("doc_id is not null").dropDuplicates([one, text]))
    return left.select(*docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    from brindle.llm.shared import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")

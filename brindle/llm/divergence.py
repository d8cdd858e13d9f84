"""Source divergence audit: how far the sources of a language differ in their terms, by one sorted scan.

Tasks count their documents' terms beforehand, so what is shuffled is one row a term, source and block of documents. These rows are
repartitioned by (lang, term) and sorted by (term, lang, source, block), the term first because its first bytes decide most comparisons; a scan of the runs then gives each term's document frequency and its
counts by source, and emits the terms that are kept and, for every two sources that have a term, how often they have it. A pair's value needs the totals,
which are known only after the scan. But it depends on nothing but the two counts, so the scan emits histograms of counts, and a
term that one of two sources lacks is never emitted for the pair: its share follows from the source's own histogram.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import documents, written

#: A term is kept in a language if at least so many of its documents have it.
MIN_DOCS = 3
#: Terms reported for a group.
TOP = 200
#: Different terms that a task holds before it emits its counts, and bytes of a text that are split at once.
HELD_TERMS, PART_BYTES = 600_000, 2 << 20
#: Rows in a batch that is emitted; pairs that the scan adds up before it emits them.
EMITTED, HELD_PAIRS = 50_000, 1_000_000
#: Sorted rows that the scan looks at together.
SCANNED_ROWS = 60_000

#: Bytes of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` with A-Z lower-cased; all others become spaces. Bytes of 0x80 and above belong to terms.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

BLOCKS = "lang string, term string, source string, block long, docs long, count long"
SCANNED = "lang string, term string, source string, other string, count long, other_count long, total long, first boolean, terms long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a part of the text at a time; parts end between terms."""
    text = text.translate(_FOLD)
    begin = 0
    while begin < len(text):
        end = text.find(b" ", begin + PART_BYTES)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def _blocks(counted: dict[tuple[str, str], tuple[Counter, Counter]], block: int) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in counted.items():
        names = list(counts)
        for i in range(0, len(names), EMITTED):
            part = names[i : i + EMITTED]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, n), pa.array(part, pa.binary()).cast(pa.string()), pa.repeat(source, n), pa.repeat(block, n), pa.array([docs[t] for t in part], pa.int64()), pa.array([counts[t] for t in part], pa.int64())],
                ["lang", "term", "source", "block", "docs", "count"],
            )


def blocks(docs: DataFrame) -> DataFrame:
    """(lang, term, source, block, docs, count): documents of a task's block that have a term, and its occurrences in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        counted: dict = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                counts, having = counted[lang, source]
                before, seen = len(counts), set()
                for part in terms(text.as_py()):
                    counts.update(part)
                    seen.update(part)
                having.update(seen)
                held += len(counts) - before
                if held > HELD_TERMS:
                    yield from _blocks(counted, block)
                    counted.clear()
                    held, block = 0, block + 1
        yield from _blocks(counted, block)

    folded = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return folded.mapInArrow(run, BLOCKS)


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a run of equal values begins."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _folded(batch: pa.Table) -> pa.Table:
    """Sorted rows with those of equal (lang, term, source) added up."""
    lang, term, source = (batch.column(c).combine_chunks() for c in ("lang", "term", "source"))
    at = _starts(lang, term, source)
    sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), at)) for c in ("docs", "count")]
    return pa.table([lang.take(pa.array(at)), term.take(pa.array(at)), source.take(pa.array(at)), *sums], names=["lang", "term", "source", "docs", "count"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, since work on small ones is mostly calls."""
    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch.select(["lang", "term", "source", "docs", "count"]))
            n += batch.num_rows
        if n >= SCANNED_ROWS:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _scanned_rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "term": pa.string(), "source": pa.string(), "other": pa.string(), "count": pa.int64(), "other_count": pa.int64(), "total": pa.int64(), "first": pa.bool_(), "terms": pa.int64()}
    return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))


def _together(rows: pa.Table, at: np.ndarray, sizes: np.ndarray) -> Iterator[pa.Table]:
    """For every term and two of its sources: lang, source, other and the two counts. `at`, `sizes`: where terms begin, and rows of each."""
    lang, source, count = (rows.column(c).combine_chunks() for c in ("lang", "source", "count"))
    for size in np.unique(sizes[sizes > 1]).tolist():
        of_size = at[sizes == size]
        left, right = np.triu_indices(size, 1) if size <= 1000 else (None, None)
        if left is not None:
            step = max(1, HELD_PAIRS // len(left))
            sides = (((of_size[i : i + step, None] + left).ravel(), (of_size[i : i + step, None] + right).ravel()) for i in range(0, len(of_size), step))
        else:  # very many sources: one of them against all after it
            sides = ((np.full(size - 1 - i, b + i), np.arange(b + i + 1, b + size)) for b in of_size.tolist() for i in range(size - 1))
        for a, b in sides:
            a, b = pa.array(a), pa.array(b)
            yield pa.table([lang.take(a), source.take(a), source.take(b), count.take(a), count.take(b)], names=["lang", "source", "other", "count", "other_count"])


def _added(pairs: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    keys = ["lang", "source", "other", "count", "other_count"]
    for batch in pa.concat_tables(pairs).group_by(keys).aggregate([([], "count_all")]).to_batches(EMITTED):
        yield _scanned_rows(len(batch), **{k: batch.column(k) for k in keys}, terms=batch.column("count_all"))


def scanned(sorted_blocks: DataFrame, min_docs: int) -> DataFrame:
    """Runs over rows sorted by (term, lang, source): a row a kept term and source (`first`: of the term), and histograms of pairs (`other`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs, waiting = None, [], 0

        def emitted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal pairs, waiting
            at = _starts(rows.column("lang").combine_chunks(), rows.column("term").combine_chunks())
            docs, total = (np.add.reduceat(rows.column(c).to_numpy(), at) for c in ("docs", "count"))
            sizes = np.diff(np.append(at, rows.num_rows))
            first = np.zeros(rows.num_rows, dtype=bool)
            first[at] = True
            kept = np.repeat(docs >= min_docs, sizes)
            good = rows.append_column("total", pa.array(np.repeat(total, sizes))).append_column("first", pa.array(first)).filter(pa.array(kept))
            for batch in good.combine_chunks().to_batches(EMITTED):
                yield _scanned_rows(len(batch), **{c: batch.column(c) for c in ("lang", "term", "source", "count", "total", "first")})
            for two in _together(rows, at[docs >= min_docs], sizes[docs >= min_docs]):
                pairs.append(two)
                waiting += two.num_rows
                if waiting > HELD_PAIRS:
                    yield from _added(pairs)
                    pairs, waiting = [], 0

        for now in _gathered(batches):
            rows = _folded(pa.concat_tables([held, now]) if held is not None else now)
            last = int(_starts(rows.column("lang").combine_chunks(), rows.column("term").combine_chunks())[-1])  # the last term may go on: a row a source
            if last:
                yield from emitted(rows.slice(0, last).combine_chunks())
            held = rows.slice(last).combine_chunks()
        if held is not None:
            yield from emitted(held)
        if pairs:
            yield from _added(pairs)

    return sorted_blocks.mapInArrow(run, SCANNED)


def _share(count: str, n: str, v: str = "v") -> str:
    """Parts per billion of a term, smoothed; in decimals, since a count of 10 billion times a billion is no long."""
    return f"(1 + (cast(1000000000 as decimal(10)) * cast({count} + 1 as decimal(20))) div cast({n} + {v} as decimal(20)))"


def _distance(p: str, q: str) -> str:
    return f"cast((({p} - {q}) * ({p} - {q})) div {q} as decimal(38))"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for every (lang, source) of `docs`.

    Null text, lang and source count as ''. Every row is a document, repeated ones too; its doc_id is not looked at. Groups without terms, and languages that
    keep none, are there with their pairs (0 if none is kept). Ties go by the item's UTF-8 bytes. An empty table gives
    no rows; other columns are ignored.
    """
    by = ["lang", "source"]
    ordered = blocks(docs).repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "block")
    found = written(scanned(ordered, min_docs), "divergence")
    terms_of = found.where("other is null")
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by)).distinct()
    sizes = terms_of.groupBy(by).agg(F.sum("count").alias("n"), F.count("*").alias("own"))
    langs = terms_of.groupBy("lang").agg(F.sum("count").alias("all_n"), F.count_if("first").alias("v"))
    stats = written(names.join(sizes, by, "left").join(langs, "lang", "left").selectExpr(*by, *(f"coalesce({c}, 0L) as {c}" for c in ("n", "own", "all_n", "v"))), "groups")

    ends = stats.select("lang", F.col("source").alias("a"), F.col("n").alias("a_n"), "v")
    pairs = ends.join(stats.select("lang", F.col("source").alias("b"), F.col("n").alias("b_n")), "lang").where("a <> b")
    nothing = _distance("pa0", "qb0")
    zeros = [f"{_share('0L', 'a_n')} as pa0", f"{_share('0L', 'b_n')} as qb0"]
    # as if no source had any term
    base = pairs.where("v > 0").selectExpr("*", *zeros).selectExpr("lang", "a", "b", f"v * {nothing} as value")
    # terms that a has, as if b had none of them, and terms that b has, as if a had none
    own = terms_of.groupBy("lang", "source", "count").agg(F.count("*").alias("terms"))
    one = own.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).selectExpr("*", *zeros, f"{_share('count', 'a_n')} as pa")
    own_a = one.selectExpr("lang", "a", "b", f"terms * ({_distance('pa', 'qb0')} - {nothing}) as value")
    own_b = one.selectExpr("lang", "b as a", "a as b", f"terms * ({_distance('qb0', 'pa')} - {_distance('qb0', 'pa0')}) as value")
    # terms that both have
    both = found.where("other is not null").groupBy("lang", F.col("source").alias("a"), F.col("other").alias("b"), "count", "other_count").agg(F.sum("terms").alias("terms"))
    both = both.join(ends, ["lang", "a"]).join(stats.select("lang", F.col("source").alias("b"), F.col("n").alias("b_n")), ["lang", "b"])
    both = both.selectExpr("*", *zeros, f"{_share('count', 'a_n')} as pa", f"{_share('other_count', 'b_n')} as qb")
    forth = both.selectExpr("lang", "a", "b", f"terms * ({_distance('pa', 'qb')} - {_distance('pa', 'qb0')} - {_distance('pa0', 'qb')} + {nothing}) as value")
    back = both.selectExpr("lang", "b as a", "a as b", f"terms * ({_distance('qb', 'pa')} - {_distance('qb', 'pa0')} - {_distance('qb0', 'pa')} + {_distance('qb0', 'pa0')}) as value")
    parts = [x.selectExpr("lang", "a", "b", "cast(value as decimal(38)) as value") for x in (base, own_a, own_b, forth, back)]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    every = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left")
    pair_part = every.selectExpr("lang", "a as source", "'pair' as part", "b as item", "cast(coalesce(value, 0) as long) as value")

    rows = terms_of.join(stats, by).selectExpr(*by, "term as item", f"{_share('count', 'n')} as p", f"{_share('total', 'all_n')} as q").where("p > q")
    term_part = rows.selectExpr(*by, "'term' as part", "item", "(p - q) * (p - q) div q as value")
    window = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    limited = term_part.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)
    return pair_part.withColumn("rank", F.row_number().over(window)).unionByName(limited)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit over all documents."""
    return divergence(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, k.total, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // CAST(coalesce(s.n, 0) + v.v AS HUGEINT) AS p, 1 + (1000000000 * (k.total + 1)) // CAST(v.all_n + v.v AS HUGEINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
found AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE count > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

"""Document fingerprints: exact digests of canonical text, grouping with byte comparison, and edited neighbours."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import documents, partitions, small_or_none, texts, written


def canonical(text: str) -> str:
    """NFKC, case folding, NFKC again (folding can undo it), runs of white space as one blank, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(text: str) -> str:
    """128-bit xxhash of the canonical text, as 32 hex digits."""
    return xxhash.xxh3_128_hexdigest(canonical(text).encode())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([digest(t.decode()) for t in texts(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [canonical(t.decode()) for t in texts(batch.column(1))]
        prints = [p or xxhash.xxh3_128_hexdigest(c.encode()) for p, c in zip(batch.column(0).to_pylist(), made)]
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.string()), pa.array(made, pa.string())], ["fingerprint", "canonical"])


#: Into so many parts each repeated digest's rows are dealt where the repeated digests are too many to be sent to all tasks.
SALTS = 32


def with_groups(prints: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of `prints` with group_id and n of their fingerprint if it is among the repeated ones, else nulls."""
    right = repeated.select("fingerprint", "group_id", "n")
    if small_or_none(repeated):
        return prints.join(F.broadcast(right), "fingerprint", "left")
    salted = prints.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id), {SALTS})"))
    return salted.join(right.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), ["fingerprint", "salt"], "left").drop("salt")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id): group_id is the smallest doc_id with the same canonical text.

    Wide digests group the rows; inside buckets of more than one row the canonical texts themselves are compared.
    Only the digests of all rows are shuffled, and the texts of repeated ones: of these a partial minimum and maximum
    leave one text a task, so a text that a third of the rows share is no hot spot. Should two
    texts ever share a digest, their bucket is grouped by the text. Rows with null or empty texts are
    one group; an empty table gives no rows; a null doc_id is a group_id only if its group has no other.
    """
    prints = written(digests(docs), "digests")
    repeated = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1"), "repeated")
    chosen = with_groups(prints, repeated).where("n is not null")
    spelled = "fingerprint string, canonical string"
    # a doc_id that several fingerprints have, or none, does not tell which row is meant: that row's is made again
    ids = chosen.groupBy(F.col("doc_id").alias("of")).agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"))
    ids = ids.select("of", F.expr("if(of is null or low <> high, null, low)").alias("fingerprint"))
    candidates = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("of"))).select("fingerprint", "text")
    compared = candidates.mapInArrow(_canonical_rows, spelled).groupBy("fingerprint").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high"))
    mixed = compared.where("low <> high").select("fingerprint")
    if mixed.isEmpty():
        return with_groups(prints, repeated).select("doc_id", "fingerprint", F.expr("if(n is null, doc_id, group_id)").alias("group_id"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest(t.decode()) + hashlib.sha256(canonical(t.decode()).encode()).hexdigest() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.string())], ["doc_id", "fingerprint"])

    longer = docs.select("doc_id", "text").mapInArrow(keyed, "doc_id long, fingerprint string")
    return longer.join(longer.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")), "fingerprint").select("doc_id", "fingerprint", "group_id")


def _splits(docs: DataFrame, ranges: int) -> list[int]:
    """At most ranges - 1 ids that part the rows about evenly; one id a range is all that the driver sees."""
    found = docs.select(F.col("doc_id").cast("double").alias("x")).where("x is not null").approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.5 / ranges) if ranges > 1 else []
    return sorted({int(x) for x in found})


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by ascending doc_id; the last row's next is the first.

    Rows with equal doc_ids follow each other by text, null doc_ids come first. The table is dealt out once, by ranges of
    doc_id; the first row of each range goes to the range before it too, so no range needs another's result.
    """
    spark = docs.sparkSession
    ranges = max(1, partitions(spark))
    cuts = np.array(_splits(docs, ranges), dtype=np.int64)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, ids, side="right").astype(np.int32)), *batch.columns], ["part", "doc_id", "text"])

    ids = base.select("doc_id", F.lit("").alias("text")).mapInArrow(dealt, "part int, doc_id long, text string")
    heads = {r[0]: r[1] for r in ids.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min).cast("bigint")))).collect()}
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}  # of the first it is the last: the circle closes
    head_of = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
    target = np.zeros(len(cuts) + 1, dtype=np.int32)
    for p in filled:
        head_of[p], target[p] = heads[p], before[p]

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "after", "doc_id", "text"]
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            part = np.searchsorted(cuts, ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(ids), dtype=bool)), *batch.columns], names)
            lead = np.flatnonzero(head_of[part] == ids)
            if len(lead):
                yield pa.RecordBatch.from_arrays([pa.array(target[part[lead]]), pa.array(np.ones(len(lead), dtype=bool)), *(c.take(pa.array(lead)) for c in batch.columns)], names)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: (part, doc_id, text)
        for batch in batches:
            out: list[list] = [[], [], []]
            for part, after, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[0] == part:
                    for values, value in zip(out, (held[1], held[2], text)):
                        values.append(value)
                held = None if after else (part, doc_id, text)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "text", "next_text"])

    rows = base.mapInArrow(doubled, "part int, after boolean, doc_id long, text string")
    placed = rows.repartition(ranges, "part").sortWithinPartitions("part", "after", F.asc_nulls_first("doc_id"), "text")
    return placed.mapInArrow(paired, "doc_id long, text string, next_text string")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pairs = with_next(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for raw, after in zip(texts(batch.column(1)), texts(batch.column(2))):
                text, half = raw.decode(), 0
                half = len(text) // 2
                new = text[: len(text) - half] + after.decode()[:half]
                own, edited, following = canonical(text), canonical(new), canonical(after.decode())
                for values, value in zip(out, (len(text), hashlib.sha256(new.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(own.encode()), xxhash.xxh3_128_hexdigest(edited.encode()), float(own == edited), float(own == following))):
                    values.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    made = pairs.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    groups = exact_groups(docs).distinct().select(F.col("doc_id").alias("of"), F.substring("fingerprint", 1, 32).alias("print"), "group_id")
    return made.join(groups, made["doc_id"].eqNullSafe(groups["of"]) & (made["fingerprint"] == groups["print"])).select(*made.columns, "group_id")

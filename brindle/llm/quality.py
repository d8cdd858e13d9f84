"""Document quality by co-training a text view and a page-metadata view."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import documents, small_or_none, texts, written

#: Bounds on the labelled rows that the models learn from, and on the words and other traits of texts that they know.
LABELLED, FEATURES = 16_000, 4_096
ROUNDS = 3
#: A view labels a row for the other view if its calibrated probability is this near to 0 or 1.
CONFIDENT = 0.02
#: Weight of all pseudo-labels of a class against all true labels of the class.
PSEUDO_WEIGHT = 0.3
#: Each round sweeps over all unlabelled rows so often; a sweep's sums serve so many steps.
SWEEPS, STEPS = 5, 12
TARGETS, VIEWS = ("low_quality", "toxic"), ("text", "page")
_WORD = re.compile(r"[^\W\d_]+")
_TAIL = re.compile(r"[^\w\s]{2,}")
_KNOWN_WORDS = 100_000
_KINDS = [b"!#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"]
_SHARES, _RATIOS = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4), (0.2, 0.4, 0.6, 0.8, 1.0, 1.2, 1.5, 2.0)

Rows = tuple[np.ndarray, np.ndarray]  # offsets, and the active features of all rows

# --- what the views see ----------------------------------------------------------------------------------------------


def shares(raw: list[bytes]) -> np.ndarray:
    """Of each text's bytes the shares that are marks, capitals, digits and white space."""
    size = np.array([len(t) for t in raw], dtype=np.int64)
    table = np.zeros((len(_KINDS), 256), dtype=np.int64)
    for i, kind in enumerate(_KINDS):
        table[i, list(kind)] = 1
    out = np.zeros((len(raw), len(_KINDS)))
    for k, t in enumerate(raw):
        out[k] = table @ np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
    return out / np.maximum(size, 1)[:, None]


def shape_features(found: list[str], lower: list[str], share: np.ndarray) -> list[str]:
    """How a text looks: words twice in a row, shouted and different ones, and shares of characters, in steps."""
    n = max(1, len(lower))
    twice = sum(a == b for a, b in zip(lower, lower[1:]))
    loud = sum(w.isupper() and len(w) > 1 for w in found)
    different = len(set(lower)) / n**0.85
    steps = [f" {name}{np.searchsorted(_SHARES, s)}" for name, s in zip(("marks", "capitals", "digits", "blanks"), share)]
    return [f" twice{min(9, 10 * twice // n)}", f" loud{min(9, 10 * loud // n)}", f" different{np.searchsorted(_RATIOS, different)}", *steps]


def content_features(text: str, share: np.ndarray) -> set[str]:
    """Lower-cased words, their beginnings of 4 and 5 letters, runs of marks, and the text's shape."""
    found = _WORD.findall(text)
    lower = [w.lower() for w in found]
    out = {m[:2] for m in _TAIL.findall(text)}
    if " | " in text:
        out.add(" |")
    out.update(lower)
    out.update("^" + w[:5] for w in set(lower))
    out.update("^" + w[:4] for w in set(lower))
    out.update(shape_features(found, lower, share))
    return out


def code(feature: str) -> int:
    return zlib.crc32(feature.encode())


def metadata_features(text: str, lang: str | None, source: str | None) -> list[float]:
    """What is known of the page without reading its words: hashed lang and source, and sizes."""
    lines = text.count("\n") + 1
    return [
        float(zlib.crc32((lang or "").encode()) % 16),
        float(zlib.crc32((source or "").encode()) % 64),
        float(np.log1p(len(text))),
        float(np.log1p(lines)),
        float(np.log1p(len(text) / lines)),
        len(text.encode()) / max(1, len(text)),
    ]


_CATEGORICAL, _BINS = 2, 10

# --- the models ------------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    """Logistic regression over the active features of each row (a bias is added), by full-batch Adam; `used`: the features it may weigh."""

    size: int
    used: np.ndarray | float = 1.0
    weights: np.ndarray = field(init=False)
    platt: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self) -> None:
        self.weights = np.zeros(self.size + 1)
        self.begin()

    def begin(self) -> None:
        self.turn, self.first, self.second = 0, np.zeros_like(self.weights), np.zeros_like(self.weights)

    def logits(self, rows: Rows) -> np.ndarray:
        return np.concatenate([self._logits(*part) for _, part in blocks(rows)] or [np.empty(0)])

    def _logits(self, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[index])))
        return sums[offsets[1:]] - sums[offsets[:-1]] + self.weights[-1]

    def slope(self, rows: Rows, labels: np.ndarray) -> np.ndarray:
        """The gradient of the sum of the rows' losses."""
        slope = np.zeros_like(self.weights)
        for at, (offsets, index) in blocks(rows):
            error = sigmoid(self._logits(offsets, index)) - labels[at]
            slope += np.append(np.bincount(index, weights=np.repeat(error, np.diff(offsets)), minlength=self.size), error.sum())
        return slope

    def fit(self, rows: Rows, labels: np.ndarray, steps: int, told: np.ndarray | float = 0.0, rate: float = 0.1, penalty: float = 1e-3) -> Logistic:
        """So many steps down the mean loss of the rows and the given slope besides."""
        for _ in range(steps):
            self.turn += 1
            slope = (self.slope(rows, labels) / max(1, len(labels)) + told) * self.used + penalty * self.weights
            self.first = 0.9 * self.first + 0.1 * slope
            self.second = 0.99 * self.second + 0.01 * slope * slope
            self.weights -= rate * (self.first / (1 - 0.9**self.turn)) / (np.sqrt(self.second / (1 - 0.99**self.turn)) + 1e-8)
        return self

    def calibrate(self, rows: Rows, labels: np.ndarray) -> None:
        self.platt = tuple(fit_dense(self.logits(rows)[:, None], labels))

    def calibrated(self, rows: Rows) -> np.ndarray:
        return self.platt[0] * self.logits(rows) + self.platt[1]


def fit_dense(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Non-negative weights of a few columns and a bias, by Newton steps that are halved until they help.

    The labels count as probabilities a little inside 0 and 1, as by Platt, so that classes that can be told apart wholly have finite weights.
    """
    yes = labels.sum()
    target = np.where(labels > 0, (yes + 1) / (yes + 2), 1 / (len(labels) - yes + 2))
    scale = np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.diag([1e-3] * x.shape[1] + [1e-9])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.mean(np.logaddexp(0.0, z) - target * z) + w @ ridge @ w / 2)

    w = np.append(np.full(x.shape[1], 0.5), 0.0)
    for _ in range(100):
        p = sigmoid(design @ w)
        slope = design.T @ (p - target) / len(x) + ridge @ w
        curve = (design * (p * (1 - p))[:, None]).T @ design / len(x) + ridge + 1e-9 * np.eye(len(w))
        free = np.append((w[:-1] > 0) | (slope[:-1] < 0), True)  # the others stay at zero
        step, now = np.zeros_like(w), loss(w)
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        for halved in range(30):
            new = w - step * 0.5**halved
            new[:-1] = np.maximum(new[:-1], 0.0)
            if loss(new) <= now:
                break
        else:
            break
        done, w = np.abs(new - w).max() < 1e-10, new
        if done:
            break
    return np.append(w[:-1] / scale, w[-1])


Fitted = dict[tuple[str, str], Logistic]  # by target and view


@dataclass
class Model:
    """The two views and how they are combined, for each target."""

    features: dict[int, int]
    cuts: list[list[float]]
    #: The features chosen for each target.
    own: dict[str, list[int]] = field(default_factory=dict)
    fitted: Fitted = field(default_factory=dict)
    mix: dict[str, np.ndarray] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)

    @property
    def sizes(self) -> dict[str, int]:
        return {"text": len(self.features), "page": 16 + 64 + _BINS * len(self.cuts)}

    def used(self, target: str, view: str) -> np.ndarray | float:
        if view == "page":
            return 1.0
        out = np.zeros(len(self.features) + 1)
        out[[*self.own[target], -1]] = 1.0
        return out

    def page_row(self, values: list[float]) -> list[int]:
        row = [int(values[0]), 16 + int(values[1])]
        return row + [80 + _BINS * i + int(np.searchsorted(c, v)) for i, (c, v) in enumerate(zip(self.cuts, values[_CATEGORICAL:]))]

    def probability(self, target: str, rows: dict[str, Rows]) -> np.ndarray:
        if target not in self.mix:
            return np.full(len(rows["text"][0]) - 1, self.prior.get(target, 0.0))
        both = [self.fitted[target, v].calibrated(rows[v]) for v in VIEWS]
        return sigmoid(np.column_stack([*both, np.ones(len(both[0]))]) @ self.mix[target])


def ragged(lists: pa.Array) -> Rows:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(rows: Rows, size: int = 2_000) -> Iterator[tuple[slice, Rows]]:
    """A few rows at a time, so that what is computed for each of their features stays small."""
    offsets, index = rows
    for lo in range(0, len(offsets) - 1, size):
        hi = min(lo + size, len(offsets) - 1)
        yield slice(lo, hi), (offsets[lo : hi + 1] - offsets[lo], index[offsets[lo] : offsets[hi]])


def pick(rows: Rows, chosen: np.ndarray) -> Rows:
    offsets, index = rows
    sizes = np.diff(offsets)[chosen]
    out = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(offsets[:-1][chosen] - out[:-1], sizes) + np.arange(out[-1])
    return out, index[at]


def other(view: str) -> str:
    return VIEWS[1 - VIEWS.index(view)]


#: By target and view: the slopes of the pseudo-labelled rows' losses summed for class 0 and class 1, and how many rows these are.
Told = dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]


def told_by_rows(rows: dict[str, Rows], teachers: Fitted, students: Fitted) -> Told:
    """What `rows` tell each student: they have the labels of which the other view's teacher is sure."""
    out: Told = {}
    for (target, view), student in students.items():
        p = sigmoid(teachers[target, other(view)].calibrated(rows[other(view)]))
        sums, counts = np.zeros((2, student.size + 1)), np.zeros(2)
        for label, sure in enumerate((p <= CONFIDENT, p >= 1 - CONFIDENT)):
            chosen = np.flatnonzero(sure)
            sums[label], counts[label] = student.slope(pick(rows[view], chosen), np.full(len(chosen), float(label))), len(chosen)
        out[target, view] = sums, counts
    return out


def co_train(model: Model, rows: dict[str, Rows], labels: dict[str, np.ndarray], held: np.ndarray, told: Callable[[Fitted, Fitted], Told]) -> None:
    """Fits `model`. `rows`, `labels`: the labelled rows; `held`: those kept for calibration; `told`: what all other rows tell.

    Every round each view's model labels the unlabelled rows of which it is sure for the other view; these count, by class, as PSEUDO_WEIGHT
    of what the true labels count. A target of which the rows have one class only is left out.
    """
    train, calib = np.flatnonzero(~held), np.flatnonzero(held)
    model.prior = {t: float(labels[t][train].mean()) if len(train) else 0.0 for t in TARGETS}
    targets = [t for t in TARGETS if all(len(np.unique(labels[t][x])) == 2 for x in (train, calib))]
    known = {v: pick(rows[v], train) for v in VIEWS}
    for t in targets:
        for v in VIEWS:
            model.fitted[t, v] = Logistic(model.sizes[v], model.used(t, v)).fit(known[v], labels[t][train], 150)

    def calibrate() -> None:
        for (t, v), fitted in model.fitted.items():
            fitted.calibrate(pick(rows[v], calib), labels[t][calib])

    calibrate()
    for _ in range(ROUNDS - 1 if targets else 0):
        teachers = deepcopy(model.fitted)
        for fitted in model.fitted.values():
            fitted.begin()
        for _ in range(SWEEPS):
            found = told(teachers, model.fitted)
            for (t, v), fitted in model.fitted.items():
                sums, counts = found[t, v]
                share = np.array([1 - model.prior[t], model.prior[t]]) * PSEUDO_WEIGHT / np.maximum(counts, 1)
                fitted.fit(known[v], labels[t][train], STEPS, share @ sums, rate=0.02)
        calibrate()
    for t in targets:
        both = [model.fitted[t, v].calibrated(pick(rows[v], calib)) for v in VIEWS]
        model.mix[t] = fit_dense(np.column_stack(both), labels[t][calib])


# --- over tables -----------------------------------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of all that the views see), text, lang and source; missing columns are null."""
    for name in ("lang", "source"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    seen = [F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(*seen).alias("content"), *(c.alias(n) for c, n in zip(seen, ("text", "lang", "source"))))


def _known(labels: DataFrame) -> DataFrame:
    known = labels.where("quality is not null and toxic is not null and doc_id is not null").selectExpr("cast(doc_id as bigint) as doc_id", "int(quality = 0) as low_quality", "int(toxic = 1) as toxic")
    return known.groupBy("doc_id").agg(*(F.max(t).alias(t) for t in TARGETS))


def _sample(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The labelled rows to learn from, with all their features: at most LABELLED labels, those of smallest hash."""
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    names = ["doc_id", *TARGETS, "content", "page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch.column("text"))
            read = [t.decode() for t in raw]
            content = [sorted({code(f) for f in content_features(t, s)}) for t, s in zip(read, shares(raw))]
            page = [metadata_features(t, *m) for t, *m in zip(read, batch.column("lang").to_pylist(), batch.column("source").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:3]), pa.array(content, pa.list_(pa.int64())), pa.array(page, pa.list_(pa.float64()))], names)

    joined = _rows(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", *TARGETS, "text", "lang", "source")  # at most LABELLED ids
    return written(joined.mapInArrow(run, "doc_id long, low_quality int, toxic int, content array<long>, page array<double>"), "sample")


def _chosen_features(sample: DataFrame) -> tuple[dict[int, int], dict[str, list[int]]]:
    """The FEATURES / 2 most telling features for each target, by their share among its rows against the others': numbered, and by target."""
    sizes = sample.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS)).first()
    counts = sample.select(F.explode("content").alias("feature"), *TARGETS).groupBy("feature").agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).where("n >= 3")
    found: dict[int, int] = {}
    own: dict[str, list[int]] = {}
    for target in TARGETS:
        yes, no = sizes[target] or 1, (sizes["n"] - sizes[target]) or 1
        gap = F.col(target) / yes - (F.col("n") - F.col(target)) / no
        spread = F.sqrt((F.col(target) + 0.5) / yes / yes + (F.col("n") - F.col(target) + 0.5) / no / no)
        best = counts.select("feature", F.abs(gap / spread).alias("z")).orderBy(F.desc("z"), "feature").limit(FEATURES // 2).collect()
        own[target] = [found.setdefault(row["feature"], len(found)) for row in best]
    return found, own


def narrowed(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, content, and the features of each row that the model knows: text and page, as numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.cuts))  # at most FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(*shared.value), {}

        def of_word(word: str) -> tuple[int, ...]:
            hits = known.get(word)
            if hits is None:
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                hits = known[word] = tuple(i for f in (word, "^" + word[:5], "^" + word[:4]) if (i := model.features.get(code(f))) is not None)
            return hits

        for batch in batches:
            raw = texts(batch.column("text"))
            read, content = [t.decode() for t in raw], []
            for text, share in zip(read, shares(raw)):
                found = _WORD.findall(text)
                lower = [w.lower() for w in found]
                hits = {i for w in set(lower) for i in of_word(w)}
                others = {m[:2] for m in _TAIL.findall(text)} | ({" |"} if " | " in text else set()) | set(shape_features(found, lower, share))
                content.append(sorted(hits | {i for f in others if (i := model.features.get(code(f))) is not None}))
            page = [model.page_row(metadata_features(*x)) for x in zip(read, batch.column("lang").to_pylist(), batch.column("source").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(content, pa.list_(pa.int16())), pa.array(page, pa.list_(pa.int16()))], ["doc_id", "content", "text", "page"])

    return _rows(docs).mapInArrow(run, "doc_id long, content long, text array<smallint>, page array<smallint>")


def _telling(pool: DataFrame) -> Callable[[Fitted, Fitted], Told]:
    """What all rows of `pool` tell: each task sums up its rows, and the driver gets a number for each weight."""

    def told(teachers: Fitted, students: Fitted) -> Told:
        shared = pool.sparkSession.sparkContext.broadcast((teachers, students))  # a few thousand weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                found = told_by_rows({v: ragged(batch.column(v)) for v in VIEWS}, *shared.value)
                flat = np.concatenate([np.concatenate([sums.ravel(), counts]) for sums, counts in found.values()])
                total = flat if total is None else total + flat
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "value"])

        flat = np.zeros(sum(2 * (s.size + 1) + 2 for s in students.values()))
        for row in pool.select(*VIEWS).mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
            flat[row["slot"]] = row["value"]
        shared.unpersist()
        out, at = {}, 0
        for key, student in students.items():
            n = 2 * (student.size + 1)
            out[key] = flat[at : at + n].reshape(2, -1), flat[at + n : at + n + 2]
            at += n + 2
        return out

    return told


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all rows' features that it was fitted on (`narrowed`).

    True labels come from a bounded sample; pseudo-labels from all unlabelled rows, which are never gathered: tasks sum up their slopes.
    """
    known = _known(labels)
    sample = _sample(docs, known)
    rows = sample.select("doc_id", *TARGETS, "page").orderBy("doc_id", "page").toArrow().combine_chunks()
    page_lists = rows.column("page").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.float64()))
    values = page_lists.flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.empty((0, 0))
    steps = np.arange(1, _BINS) / _BINS
    features, own = _chosen_features(sample)
    model = Model(features, [np.quantile(values[:, i], steps).tolist() for i in range(_CATEGORICAL, values.shape[1])], own)
    table = written(narrowed(docs, model), "narrowed")
    lookup = sample.sparkSession.sparkContext.broadcast(model.features)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sorted(i for x in row if (i := lookup.value.get(x)) is not None) for row in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array(kept, pa.list_(pa.int16()))], ["doc_id", "page", "text"])

    text = sample.select("doc_id", "content", "page").mapInArrow(chosen, "doc_id long, page array<double>, text array<smallint>").orderBy("doc_id", "page").select("text").toArrow().combine_chunks()
    views = {
        "text": ragged(text.column("text").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int16()))),
        "page": ragged(pa.array([model.page_row(r) for r in values.tolist()], pa.list_(pa.int16()))),
    }
    held = np.array([zlib.crc32(str(d).encode()) % 4 == 0 for d in rows.column("doc_id").to_pylist()], dtype=bool)
    taught = known.select("doc_id")
    pool = table.join(F.broadcast(taught) if small_or_none(taught) else taught, "doc_id", "left_anti").select(*VIEWS)
    co_train(model, views, {t: rows.column(t).to_numpy().astype(float) for t in TARGETS}, held, _telling(written(pool, "pool")))
    return model, table


def scored(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, content, __low_quality and __toxic, the combined calibrated probabilities, of all rows of a `narrowed` table."""
    shared = table.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {v: ragged(batch.column(v)) for v in VIEWS}
            made = [pa.array(shared.value.probability(t, rows)) for t in TARGETS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), *made], ["doc_id", "content", "__low_quality", "__toxic"])

    return table.mapInArrow(run, "doc_id long, content long, __low_quality double, __toxic double")


REJECTED = "(__low_quality >= 0.5 or __toxic >= 0.5)"


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents that the combined views hold for toxic or of low quality.

    Null and empty texts have no words and are scored like any other; rows with null lang or source, or of a table without
    these columns, count as having empty ones; labels with nulls, or for unknown documents, teach nothing; with no labels of both classes a target
    rejects nothing; repeated rows are scored each; columns named alike in other tables are not read; an empty table gives no rows.
    """
    model, table = train(docs, labels)
    gone = scored(table, model).where(REJECTED).select(F.col("doc_id").alias("__of"), F.col("content").alias("__seen")).distinct()
    gone = written(gone, "gone")
    has = {n: F.col(n).cast("string") if n in docs.columns else F.lit(None).cast("string") for n in ("lang", "source")}
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("bigint"), "__content": F.xxhash64("text", *has.values())})
    gone_ = F.broadcast(gone) if small_or_none(gone) else gone
    return keyed.join(gone_, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__content") == F.col("__seen")), "left_anti").select(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    model, table = train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(table, model).selectExpr("doc_id", "1 - __low_quality as p_quality", "__toxic as p_toxic", "(1 - __low_quality) * (1 - __toxic) as score", f"not {REJECTED} as keep")

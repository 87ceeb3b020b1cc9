"""Quality by co-training of two views (operator 9), in numpy.

The content view sees what is written and nothing else: transitions between kinds of characters, hashed words, repetition.
The metadata view sees the document's record and nothing of its text: language, source and stated length. Each is a linear
discriminant, which needs only the moments of its features by class. First both learn from the labelled rows; then, ROUNDS
times, both score all documents of the table, and each hands those that it is sure of (a calibrated probability of SURE),
with its own label, to the other one, whose moments by class become the labelled rows' and theirs, half and half. The moments
are summed where the documents are, so all of them teach, however many there are. Last, both are calibrated on
labelled rows that neither was fitted on, and a logistic curve combines the calibrated logits into the score.

Training: at most PER_CLASS labelled documents of each class (a documented bound); of these a quarter calibrates.

Cases: a null text counts as empty, a null in another column is a value of its own; columns that are missing count as
null; without labelled rows of both classes the score is the share of good ones (1 if there are none); repeated rows get
equal scores; an empty table gives an empty result; a view that is sure of nothing teaches nothing; further columns don't pass.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.llm.common import buffers, filtered, lean, mix, spans, table
from cellsift.llm.sample import fold, labelled

SHAPES, WORDS, STATED, LENGTHS = 256, 128, 64, 24
CONTENT, META = SHAPES + WORDS + 6, 2 * STATED + LENGTHS + 1
WIDTH = (CONTENT, META)
PER_CLASS, ROUNDS, SURE, HELD, RIDGE = 1500, 2, 0.95, 0.25, 1e-4
#: Tasks that sum moments before the last sum.
SUMS = 16
SPAN = 1 << 19
LOWER, UPPER, DIGIT, SPACE, LINE, OTHER = range(6)


@once
def kinds() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for k in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(k))
        if c[0] == "L":
            out[k] = UPPER if c in ("Lu", "Lt") else LOWER
        elif c[0] == "N":
            out[k] = DIGIT
        elif c[0] == "Z":
            out[k] = SPACE
    out[[9, 11, 12, 13]] = SPACE
    out[10] = LINE
    return out


def bucket(value: object, rows: int) -> int:
    return zlib.crc32(repr(value).encode("utf-8", "surrogatepass")) % rows


def features(text: pa.Array, lang: list, source: list, stated: list) -> tuple[np.ndarray, np.ndarray]:
    """The two views, a row a document: content from the text alone, meta from the other columns alone."""
    data, offsets = buffers(text)
    n = len(text)
    content, meta = np.zeros((n, CONTENT), np.float32), np.zeros((n, META), np.float32)
    for i, j in spans(offsets, SPAN):
        m = j - i
        part, begin = data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        points = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        of = (np.searchsorted(begin, np.flatnonzero((part & 0xC0) != 0x80), "right") - 1).astype(np.int64)
        kind = kinds()[points].astype(np.uint32)
        size = np.bincount(of, minlength=m)
        # Where the kind, or the character if it is none of letters, digits and space, changes.
        mark = np.where(kind == OTHER, points + np.uint32(16), kind)
        if len(points) > 1:
            change = np.flatnonzero(((mark[1:] != mark[:-1]) | (kind[1:] == OTHER)) & (of[1:] == of[:-1]))
            code = mix((mark[change].astype(np.uint64) << np.uint64(32)) | mark[change + 1])
            shape = (code >> np.uint64(50)).astype(np.int64) & (SHAPES - 1)
            seen = np.bincount(of[change] * SHAPES + shape, minlength=m * SHAPES).reshape(m, SHAPES)
            content[i:j, :SHAPES] = np.sqrt(seen / np.maximum(size, 1)[:, None])
        solid = np.zeros(len(points) + 2, bool)
        solid[1:-1] = (kind != SPACE) & (kind != LINE)
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = of[1:] != of[:-1]
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        low = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(low), np.uint64(0x9E3779B97F4A7C15))]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(low), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(low) * up[:-1])])
        word = mix((total[ends] - total[starts]) * down[starts])
        word_of = of[starts]
        count = np.bincount(word_of, minlength=m)
        seen = np.bincount(word_of * WORDS + ((word >> np.uint64(50)).astype(np.int64) & (WORDS - 1)), minlength=m * WORDS).reshape(m, WORDS)
        content[i:j, SHAPES : SHAPES + WORDS] = np.sqrt(seen / np.maximum(count, 1)[:, None])
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (word_of[1:] == word_of[:-1])
        order = np.lexsort((word, word_of))
        new = np.ones(len(word), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(word)))
        distinct = np.bincount(word_of[order][first], minlength=m)
        most = np.zeros(m)
        np.maximum.at(most, word_of[order][first], times)
        some = np.maximum(count, 1)
        stats = [distinct / some, np.bincount(word_of[same], minlength=m) / some, most / some, np.bincount(word_of, ends - starts, m) / some / 10, np.log1p(count) / 10, count == 0]
        content[i:j, SHAPES + WORDS :] = np.stack(stats, 1)
    for k in range(n):
        meta[k, bucket(lang[k], STATED)] = meta[k, STATED + bucket(source[k], STATED)] = 1
        if stated[k] is None:
            meta[k, -1] = 1
        else:
            meta[k, 2 * STATED + min(LENGTHS - 1, max(0, stated[k]).bit_length())] = 1
    return content, meta


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, of a logistic curve over few columns, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        q = sigmoid(x @ beta)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (q - y) + ridge * beta)
        beta = beta - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Moments:
    """Of one class: rows, sums and sums of products of the features with a constant 1."""

    def __init__(self, width: int):
        self.m = np.zeros((width + 1, width + 1))

    def add(self, x: np.ndarray) -> Moments:
        one = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
        self.m += one.T @ one
        return self

    @property
    def n(self) -> float:
        return float(self.m[-1, -1])

    def average(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance."""
        mean = self.m[:-1, -1] / self.n
        return mean, self.m[:-1, :-1] / self.n - np.outer(mean, mean)


class Discriminant:
    """The linear discriminant of two classes from lists of their moments, each list's members with equal weights; and the curve that makes its value a logit."""

    def __init__(self, bad: list[Moments], good: list[Moments]):
        means, inner = [], 0.0
        for held in (bad, good):
            held = [m for m in held if m.n]
            parts = [m.average() for m in held]
            mean = sum(m for m, _ in parts) / len(parts)
            inner = inner + sum(c + np.outer(m - mean, m - mean) for m, c in parts) / len(parts) / 2
            means.append(mean)
        self.w = np.linalg.solve(inner + RIDGE * np.eye(len(inner)), means[1] - means[0])
        scale = max(float(np.sqrt(self.w @ inner @ self.w)), 1e-9)
        self.w /= scale
        self.b = -float(self.w @ (means[0] + means[1])) / 2
        self.curve = np.array([1.0, 0.0])

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x @ self.w + self.b) * self.curve[0] + self.curve[1], -8, 8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.curve = curve((x @ self.w + self.b)[:, None], y)


class CoTrained:
    """Both views' classifiers, their calibration and combination."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, ids: np.ndarray):
        """The labelled rows' features, labels and ids."""
        self.constant, self.views = None, []
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return
        held = mix(ids.astype(np.uint64) + np.uint64(5)) % np.uint64(1000) < np.uint64(int(1000 * HELD))
        for k in (0, 1):  # both parts need both classes
            own = np.flatnonzero(y == k)
            if held[own].all() or not held[own].any():
                held[own[: len(own) // 2]] = True
                held[own[len(own) // 2 :]] = False
        if len({*y[held]}) < 2:
            held[:] = True
        fit = ~held if len({*y[~held]}) == 2 else held
        self.taught = [[Moments(WIDTH[v]).add(views[v][fit & (y == k)]) for k in (0, 1)] for v in (0, 1)]
        self.judge = [x[held] for x in views], y[held]
        self.fit([[[], []], [[], []]])

    def fit(self, more: list[list[list[Moments]]]) -> None:
        """Both views from the labelled rows' moments and more of them, by view and class; calibrated and combined."""
        views, y = self.judge
        self.views = [Discriminant(*([self.taught[v][k], *more[v][k]] for k in (0, 1))) for v in (0, 1)]
        for d, x in zip(self.views, views, strict=True):
            d.calibrate(x, y)
        self.combination = curve(self.logits(*views), y)

    def logits(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([d.calibrated(x) for d, x in zip(self.views, (content, meta), strict=True)], 1)

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score, and each view's own."""
        if self.constant is not None:
            s = np.full(len(content), self.constant)
            return s, s, s
        both = self.logits(content, meta)
        return sigmoid(both @ self.combination[:-1] + self.combination[-1]), sigmoid(both[:, 0]), sigmoid(both[:, 1])

    def handed(self, content: np.ndarray, meta: np.ndarray) -> list[list[np.ndarray]]:
        """By view and class, which documents the other view hands to it."""
        sure = np.log(SURE / (1 - SURE))
        both = self.logits(content, meta)
        return [[both[:, 1 - v] < -sure, both[:, 1 - v] > sure] for v in (0, 1)]


COLUMNS = {"text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def seen(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()))


def viewed(df: DataFrame) -> list:
    """doc_id, label, content and meta of few rows, to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, meta = features(b.column(2), *(b.column(k).to_pylist() for k in (3, 4, 5)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), *(pa.array([x.astype(np.float16).tobytes() for x in part], pa.binary()) for part in (content, meta))], names=["doc_id", "label", "content", "meta"])

    return seen(df.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id", "label").mapInArrow(lean(run), "doc_id bigint, label int, content binary, meta binary").collect()


def matrix(rows: list, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), np.float16).reshape(len(rows), width).astype(np.float32)


def lessons(documents: DataFrame, model: CoTrained) -> list[list[list[Moments]]]:
    """By view and class, the moments of all documents that the other view hands over. Summed in tasks; four matrices come to the driver."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [[Moments(w) for _ in (0, 1)] for w in WIDTH]
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                both = features(b.column(0), *(b.column(c).to_pylist() for c in (1, 2, 3)))
                for v, by_class in enumerate(sent.value.handed(*both)):
                    for k_, rows in enumerate(by_class):
                        if rows.any():
                            own[v][k_].add(both[v][rows])
        found = [(2 * v + k, m.m.tobytes()) for v in (0, 1) for k, m in enumerate(own[v]) if m.n]
        if found:
            part = TaskContext.get().partitionId() % SUMS
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], names=["part", "kind", "moments"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for key, blob in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), strict=True):
                m = np.frombuffer(blob.as_buffer(), np.float64)
                total[key] = total[key] + m if key in total else m.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["part", "kind", "moments"])

    schema = "part int, kind int, moments binary"
    some = seen(documents).mapInArrow(lean(run), schema).repartition(SUMS, "part").mapInArrow(lean(add), schema)
    out: list[list[list[Moments]]] = [[[], []], [[], []]]
    for r in some.withColumn("part", F.lit(0)).coalesce(1).mapInArrow(lean(add), schema).collect():
        m = Moments(WIDTH[r.kind // 2])
        m.m = np.frombuffer(r.moments, np.float64).reshape(m.m.shape)
        out[r.kind // 2][r.kind % 2].append(m)
    return out


def train(documents: DataFrame, labels: DataFrame, keep=None, per_class: int = PER_CLASS, rounds: int = ROUNDS) -> CoTrained:
    rows = sorted(viewed(labelled(seen(documents, "doc_id"), labels, "quality", per_class, list(COLUMNS), keep)), key=lambda r: (r.doc_id, r.label, r.content, r.meta))
    model = CoTrained([matrix(rows, "content", CONTENT), matrix(rows, "meta", META)], np.array([r.label for r in rows], np.float64), np.array([r.doc_id for r in rows], np.int64))
    for _ in range(rounds if model.constant is None else 0):
        model.fit(lessons(documents, model))
    return model


def score(documents: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score, predicted, content_score, meta_score."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                s, c, m = sent.value.score(*features(b.column(1), *(b.column(x).to_pylist() for x in (2, 3, 4))))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(c, pa.float64()), pa.array(m, pa.float64())], names=["doc_id", "score", "predicted", "content_score", "meta_score"])

    return seen(documents, "doc_id").mapInArrow(lean(run), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, predicted int, content_score double, meta_score double")


def accepted(documents: DataFrame, model: CoTrained, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least so much, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return filtered(documents, COLUMNS, lambda text, *rest: sent.value.score(*features(text, *(c.to_pylist() for c in rest)))[0] >= least)


def may_learn(key: str = "doc_id"):
    return F.coalesce(fold(key, 5) != 0, F.lit(False))


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"), may_learn())
    return score(documents, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))


QUERIES = {"op9_co_training": op9_co_training}
SQL: dict[str, str] = {}

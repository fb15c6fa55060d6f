"""Toxicity by cumulative-link ordinal regression on sparse word features.

The model says P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all ordered thresholds;
x holds the presence of words (letters and digits, A-Z lower-cased).  It is fitted on a bounded sample of
labelled rows without their near copies: words whose presence differs by grade with a score-test z of at least ``least_z`` are kept
(the most distinct ``most_words``), and the likelihood with an L2 penalty is maximised by L-BFGS.
Every document is then scored on its whole text; the output is the expected severity.

The model is a function of the rows: the sample is chosen by a hash of the ids and used in the order of ids, however
the tables are partitioned.  The driver gets at most ``sample_rows`` rows of bounded width: 36 hashes each to tell near
copies, then the numbers of at most ``most_words`` words each; the words themselves are counted by Spark.

Defined cases: null or empty text has no features and gets the severity of the thresholds alone; null labels
are left out, of several labels of one id the most severe counts; several texts of a labelled id are used each, equal
ones once; ids are read as 64-bit integers, others stop with a cast error; grades that no label has get probability
0; with no labels or a single grade, the severity is that grade (0 without labels); rows that repeat are scored each;
texts of any length are read whole; other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, materialise, mix, row_slices, small_batches, tidied

SAMPLE_ROWS = 12_000


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    """``words`` (sorted 64-bit hashes) with ``weights``; ``grades`` in order with the ``thresholds`` between them."""

    words: np.ndarray
    weights: np.ndarray
    grades: np.ndarray
    thresholds: np.ndarray

    def linear(self, column) -> np.ndarray:
        """w . x of every text of a string column."""
        w = Words(column, ALNUM)
        n = len(w.first) - 1
        out = np.zeros(n)
        if not len(self.words) or not len(w):
            return out
        h = w.hashes(lower=True)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == h)
        doc = np.searchsorted(w.first, hit, "right") - 1
        pair = np.unique(doc * len(self.words) + at[hit])
        np.add.at(out, pair // len(self.words), self.weights[pair % len(self.words)])
        return out

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        """P(grade) by row and grade."""
        below = np.concatenate([np.zeros((len(eta), 1)), sigmoid(self.thresholds[None, :] - eta[:, None]), np.ones((len(eta), 1))], axis=1)
        return np.diff(below, axis=1)

    def severity(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected severity, P(grade > 0), most likely grade) of every text."""
        p = self.probabilities(self.linear(column))
        return p @ self.grades, p[:, self.grades > 0].sum(axis=1), self.grades[p.argmax(axis=1)]


def _lbfgs(f, x: np.ndarray, rounds: int = 200, memory: int = 10) -> np.ndarray:
    """Minimise ``f`` (value and gradient) by limited-memory BFGS with step halving."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(grad).max() < 1e-6:
            break
        q, kept = grad.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        size, slope = 1.0, -(grad @ q)
        if slope >= 0:
            q, slope, steps = grad.copy(), -(grad @ grad), []
        while True:
            new = x - size * q
            v, g = f(new)
            if v <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = new - x, g - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = abs(value - v) < 1e-10 * max(1.0, abs(value))
        x, value, grad = new, v, g
        if done:
            break
    return x


BANDS, ROWS = 6, 6


def least_hashes(words: np.ndarray) -> np.ndarray:
    """The smallest hash of a set of words under each of ``BANDS * ROWS`` hash functions (0 for no words)."""
    seeds = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
    return np.array([mix(words ^ s).min() for s in seeds], np.uint64) if len(words) else np.zeros(len(seeds), np.uint64)


def distinct_rows(least: np.ndarray) -> list[int]:
    """Rows without near copies of earlier ones (by bands of their least hashes): copies would pass for independent evidence."""
    seen, out = set(), []
    for i, row in enumerate(least.tolist()):
        keys = [(b, *row[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]
        if seen.isdisjoint(keys):
            out.append(i)
        seen.update(keys)
    return out


def fit(indptr: np.ndarray, column: np.ndarray, grade: np.ndarray, words: np.ndarray, l2: float = 1e-5) -> OrdinalModel:
    """Fit on sparse rows: row i has the words number column[indptr[i]:indptr[i + 1]] of the sorted hashes ``words``."""
    grades = np.unique(grade)
    n, m, k = len(grade), len(words), len(grades)
    if k < 2:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), grades if n else np.zeros(1, int), np.zeros(0))
    y = np.searchsorted(grades, grade)
    row = np.repeat(np.arange(n), np.diff(indptr))
    share = np.cumsum(np.bincount(y, minlength=k)[:-1]) / n
    start = np.log(share / (1 - share))
    begin = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(m)])

    def loss(p):
        gaps = np.exp(p[1 : k - 1])
        theta = p[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        w = p[k - 1 :]
        eta = np.bincount(row, weights=w[column], minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(edge[y + 1] - eta), sigmoid(edge[y] - eta)
        upper[y == k - 1], lower[y == 0] = 1.0, 0.0
        prob = np.maximum(upper - lower, 1e-12)
        fu, fl = upper * (1 - upper) / prob, lower * (1 - lower) / prob
        d_theta = np.bincount(np.minimum(y, k - 2), weights=np.where(y < k - 1, -fu, 0), minlength=k - 1) + np.bincount(np.maximum(y - 1, 0), weights=np.where(y > 0, fl, 0), minlength=k - 1)
        grad = np.empty_like(p)
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad[0] = tail[0]
        grad[1 : k - 1] = tail[1:] * gaps
        grad[k - 1 :] = np.bincount(column, weights=(fu - fl)[row], minlength=m) + l2 * n * w
        return -np.log(prob).sum() / n + l2 / 2 * (w @ w), grad / n

    best = _lbfgs(loss, begin)
    theta = best[0] + np.concatenate([[0.0], np.cumsum(np.exp(best[1 : k - 1]))])
    return OrdinalModel(words, best[k - 1 :].astype(float), grades, theta)


def tell_apart(sample: DataFrame, grades: list[int], n: int, mean: float, spread: float, least_z: float, most_words: int) -> np.ndarray:
    """Sorted hashes of the words of ``sample`` (grade, words) whose presence differs most by grade; ``mean`` and ``spread`` are
    those of the grades' places in order over the ``n`` rows."""
    place = F.array_position(F.array(*[F.lit(g) for g in grades]), F.col("grade")) - 1
    counts = sample.select(F.explode("words").alias("word"), place.alias("y")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("ys"))
    counts = counts.where((F.col("df") >= 5) & (F.col("df") < n))
    z = F.abs(F.col("ys") - F.col("df") * F.lit(mean)) / (F.sqrt(F.col("df") * (1 - F.col("df") / F.lit(float(n)))) * F.lit(max(spread, 1e-9)))
    best = counts.select("word", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(most_words)
    return np.sort(np.array([r.word for r in best.select("word").collect()], np.int64).view(np.uint64))


def train(
    docs: DataFrame, labels: DataFrame, grade, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, least_z: float = 6.0, most_words: int = 512, l2: float = 1e-5
) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents, chosen by a hash of their ids."""
    spark = docs.sparkSession
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade is not null")
    marks = marks.groupBy("id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    none = np.zeros(0, np.uint64)
    if not marks:
        return fit(np.zeros(1, int), np.zeros(0, int), np.zeros(0, int), none)
    chosen = spark.createDataFrame(marks, "id long, grade int")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).join(F.broadcast(chosen), "id").select("id", "h", "grade", "text")

    def distinct(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(3)):
                w = Words(batch.column(3).slice(a, b - a), ALNUM)
                h = w.hashes(lower=True)
                sets = [np.unique(h[i:j]) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
                least = pa.array([least_hashes(x).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), least], names=["id", "h", "grade", "words", "least"])

    found = small_batches(rows).mapInArrow(tidied(distinct), "id long, h long, grade int, words array<bigint>, least binary")
    # several rows of a labelled id are rare: the bound holds for rows, not only for ids
    found = materialise(found.dropDuplicates(["id", "h"]).orderBy(F.xxhash64("id"), "id", "h").limit(sample_rows), "labelled-sample")

    def in_order(frame: DataFrame) -> pa.Table:
        return frame.toArrow().sort_by([("id", "ascending"), ("h", "ascending")])

    table = in_order(found.select("id", "h", "grade", "least"))
    keep = distinct_rows(np.frombuffer(b"".join(table.column("least").to_pylist()), np.uint64).reshape(table.num_rows, BANDS * ROWS))
    table = table.take(pa.array(keep, pa.int64())).select(["id", "h", "grade"])
    grades = np.array(table.column("grade").to_pylist(), int)
    levels = np.unique(grades)
    if len(levels) < 2:
        return fit(np.zeros(len(grades) + 1, int), np.zeros(0, int), grades, none)
    y = np.searchsorted(levels, grades)
    sample = found.join(F.broadcast(spark.createDataFrame(table.select(["id", "h"]))), ["id", "h"]).select("id", "h", "grade", "words")
    words = tell_apart(sample, levels.tolist(), len(y), float(y.mean()), float(y.std()), least_z, most_words)
    picked = F.array_intersect("words", F.lit(words.view(np.int64).tolist()) if len(words) else F.array().cast("array<bigint>"))
    lists = in_order(sample.select("id", "h", "grade", picked.alias("words"))).column("words").combine_chunks()
    column = np.searchsorted(words, np.asarray(lists.flatten()).view(np.uint64))
    indptr = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(int)
    return fit(indptr, column, grades, words, l2)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", carry: list[str] | None = None, reject_at: float = 0.5) -> DataFrame:
    """The carried columns (default: all, in a struct ``row``) with severity, p_toxic, grade and rejected (p_toxic >= reject_at)."""
    carry = docs.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    # a carried text travels once
    inside = carry.index(text_col) if text_col in carry and docs.schema[text_col].dataType == T.StringType() else None
    rows = docs.select(row) if inside is not None else docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    more = [("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("grade", T.IntegerType()), ("rejected", T.BooleanType())]
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, t) for n, t in more]])

    def work(batches):
        for batch in batches:
            text = batch.column(1) if inside is None else batch.column(0).field(inside)
            parts = [model.severity(text.slice(a, b - a)) for a, b in row_slices(text)]
            if not parts:
                continue
            severity, p, grade = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(p), pa.array(grade.astype(np.int32)), pa.array(p >= reject_at)], names=schema.names)

    return small_batches(rows).mapInArrow(tidied(work), schema)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged."""
    return score(docs, model, text_col, reject_at=reject_at).where("not rejected").select("row.*")

"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel.  Every partition sums its part of
the normal equations, and the sums are added up by Spark; the driver solves one
system of fixed size.  Scores of labelled rows kept out of the fit are counted
in fixed bins, from which the calibration follows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import bounded_batches, id_remainder, texts
from sparkgas.plans.cluster import cut

STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "symbols", "marks", "spaces",
    "distinct_words", "repeats", "distinct_lines", "log_lines", "shouted", "compressed",
)
BINS = 1000
FIT_PARTS = 5  # one part in so many calibrates
#: bytes of ASCII by what they are taken for
SYMBOLS, MARKS = b"#*$%&|<>@^~=_{}[]\\/", b".,;:!?\"'()-"


def statistics(text: str) -> tuple[float, ...]:
    """Shares and logarithms that describe a text, all finite, 0 where there is nothing to count."""
    import zlib

    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    words = raw.split()
    n_words = max(len(words), 1)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    upper, digits, symbols, marks = (share(c) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SYMBOLS, MARKS))
    letters = share(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
    return (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        min(sum(map(len, words)) / n_words, 50.0),
        letters,
        upper,
        digits,
        symbols,
        marks,
        share(b" \t\n\r\x0b\x0c"),
        len(set(words)) / n_words,
        sum(map(bytes.__eq__, words, words[1:])) / n_words,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(lines)),
        len(re.findall(rb"[!?]{2}", raw)) / n_words,
        len(zlib.compress(raw, 1)) / n if raw else 0.0,
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)`` with the statistics as an array; null texts count as empty."""
    bounded_batches(docs.sparkSession)

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            x = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    return texts(docs, id_col, text_col).mapInArrow(make, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Kernel:
    """Standardised statistics and their random Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def drawn(cls, mean, scale, width: float, features: int, seed: int) -> Kernel:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features))

    def features(self, x: np.ndarray) -> np.ndarray:
        """One row per text, a constant in the last column."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / self.weights.shape[1]) * np.cos(z @ self.weights + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    """A fitted classifier: kernel, ridge weights, and the calibration as points of a rising line."""

    kernel: Kernel
    ridge: np.ndarray
    scores: np.ndarray
    chances: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.kernel.features(x) @ self.ridge, self.scores, self.chances)


def _column(batch) -> np.ndarray:
    values = batch.column("x")
    return np.asarray(values.flatten()).reshape(len(values), len(STATISTICS))


def _summed(rows: DataFrame, part) -> dict[int, float]:
    """Sums over all rows of the numbers that ``part`` makes of a batch ``(x, y)``; their number does not depend on the rows."""

    def sums(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if len(batch):
                own = part(_column(batch), np.asarray(batch.column("y"), float))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "v"])

    summed = rows.mapInArrow(sums, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    return {r.cell: r.v for r in summed.collect()}


def pool(scores: np.ndarray, good: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: the mean score and good share of each pool, rising."""
    pools: list[list[float]] = []
    for s, g, n in zip(scores, good, all_):
        if n:
            pools.append([s * n, g, n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(
    stats: DataFrame,
    labels: DataFrame,
    features: int = 128,
    width: float = 3.0,
    penalty: float = 1e-3,
    seed: int = 7,
    label_col: str = "quality",
    id_col: str = "doc_id",
) -> Model:
    """The model for ``(doc_id, x)`` rows that ``labels`` marks 0 or 1.

    All labelled rows are used: one part in ``FIT_PARTS`` by id for calibration,
    the others for the fit, the classes weighing the same.  Labels other than 0
    and 1 and null ids are left out; repeated labels count again.  Without both
    labels the model gives every text their share, or 0.5 without any.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1)")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(FIT_PARTS))
    rows = cut(stats.join(marked, "doc_id").select("x", "y", (part == 0).alias("aside")))
    fitted, aside = rows.where("not aside").select("x", "y"), rows.where("aside").select("x", "y")
    d = len(STATISTICS)
    first = _summed(fitted, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    n, good = first.get(0, 0.0), first.get(1, 0.0)
    if not 0 < good < n:
        share = good / n if n else 0.5
        kernel = Kernel.drawn(np.zeros(d), np.ones(d), width, features, seed)
        return Model(kernel, np.zeros(features + 1), np.array([0.0]), np.array([share]))
    mean = np.array([first[2 + i] for i in range(d)]) / n
    square = np.array([first[2 + d + i] for i in range(d)]) / n
    kernel = Kernel.drawn(mean, np.sqrt(np.maximum(square - mean**2, 1e-6)), width, features, seed)
    size = features + 1

    def equations(x, y):
        z = kernel.features(x)
        w = np.where(y == 1, n / (2 * good), n / (2 * (n - good)))[:, None]
        return np.concatenate([(z.T @ (w * z)).ravel(), z.T @ (w[:, 0] * y)])

    cells = _summed(fitted, equations)
    values = np.array([cells[i] for i in range(size * size + size)])
    a, b = values[: size * size].reshape(size, size), values[size * size :]
    ridge = np.linalg.solve(a + penalty * n * np.eye(size) / size, b)
    low, high = -0.5, 1.5

    def bins(x, y):
        s = kernel.features(x) @ ridge
        at = np.clip(((s - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=s, minlength=BINS)]).astype(float)

    counted = _summed(aside, bins)
    if not counted:
        return Model(kernel, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    values = np.array([counted[i] for i in range(3 * BINS)]).reshape(3, BINS)
    scores, chances = pool(values[2] / np.maximum(values[0], 1), values[1], values[0])
    # between pools the line rises; beyond them it ends a little further out, so that scores keep their order
    scores = np.concatenate([[min(low, scores[0] - 1)], scores, [max(high, scores[-1] + 1)]])
    chances = np.concatenate([[0.5 * chances[0]], 0.005 + 0.99 * chances, [0.5 + 0.5 * chances[-1]]])
    return Model(kernel, ridge, scores, np.maximum.accumulate(chances))


def predict(stats: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for ``(doc_id, x)`` rows."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            score = model.predict(_column(batch)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return stats.mapInArrow(make, "doc_id bigint, score double")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    held_out: int = 1,
    folds: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, score)``: the calibrated chance that a text is good, learnt without the held-out fold.

    The fold of a document is crc32 of its id as text, modulo ``folds``.  Null
    and empty texts are scored by their statistics, all 0; null ids belong to the
    fold of the empty text; repeated rows are scored one by one; an empty table
    gives no rows; other columns are ignored.  Statistics are computed once and
    kept in the checkpoint folder; only they, not the texts, are exchanged.
    """
    stats = cut(document_statistics(docs, id_col, text_col))
    out = lambda c: id_remainder(F.col(c), folds) == held_out
    model = fit(stats.where(~out("doc_id")), labels)
    scored = predict(stats, model)
    return scored.select("doc_id", out("doc_id").alias("held_out"), "score")


def keep_good(
    docs: DataFrame, labels: DataFrame, least: float = 0.5, held_out: int = 1, folds: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, all columns kept; learnt as in :func:`classify`."""
    stats = cut(document_statistics(docs, id_col, text_col))
    model = fit(stats.where(id_remainder(F.col("doc_id"), folds) != held_out), labels)

    @F.pandas_udf("double")
    def score(some: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.array([statistics(t) for t in some]).reshape(len(some), len(STATISTICS))))

    return docs.where(score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) >= least)

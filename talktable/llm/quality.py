"""Document quality from pairwise preferences: a Bradley-Terry model on features of the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import unused, written
from talktable.storage import materialize

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_STOP = b".,;:"
_LOUD = b"!?"
_HIGH = bytes(range(128, 256))
_ALL = bytes(range(256))
#: labelled documents that meet in one block, and documents of the rarer label that a block has at least, on average
BLOCK, RARE = 1024, 64
_MARK = bytes(set(_ALL) - set(_LOWER + _UPPER + _DIGIT + _SPACE + _STOP + _LOUD + _HIGH))
FEATURES = (
    "log_words", "distinct_words", "top_word", "repeated_neighbours", "upper", "digits", "marks", "loud", "stops",
    "high", "word_length", "long_words", "distinct_lines", "words_ending_in_marks", "upper_words", "distinct_pairs",
)


def features(text: str | None) -> list[float]:
    """Figures of a whole text, all bounded; those of an empty text are zero."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    share = lambda kind: 1.0 - len(data.translate(None, kind)) / size
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = list(zip(words, words[1:]))
    same = sum(a == b for a, b in pairs)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    ends = bytes(w[-1] for w in words)
    return [
        min(np.log1p(n), 12.0) / 12.0, len(counts) / n, max(counts.values()) / n, same / n, share(_UPPER), share(_DIGIT),
        share(_MARK), share(_LOUD), share(_STOP), share(_HIGH), min(chars / n, 30.0) / 30.0,
        sum(len(w) > 20 for w in words) / n, len(set(lines)) / len(lines), 1.0 - len(ends.translate(None, _MARK)) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n, len(set(pairs)) / max(1, len(pairs)),
    ]


def _basis(x: np.ndarray) -> np.ndarray:
    """Features and their square roots, so that small shares of odd characters count."""
    return np.concatenate([x, np.sqrt(x)], axis=1)


@dataclass
class PairwiseModel:
    """Weights of a linear document score, and the score at which documents are rejected."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((_basis(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient and curvature of the logistic loss summed over all pairs of a row of ``good`` and one of ``bad``, and their number.

    The differences are not written out: rows and columns of the pairs' weights are summed.
    """
    p = 1.0 / (1.0 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -500, 500)))
    v = p * (1 - p)
    cross = good.T @ v @ bad
    curve = (good * v.sum(1)[:, None]).T @ good + (bad * v.sum(0)[:, None]).T @ bad - cross - cross.T
    return bad.T @ p.sum(0) - good.T @ p.sum(1), curve, p.size


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]], width: int, ridge: float, steps: int) -> np.ndarray:
    """Weights of least mean loss; ``sums`` gives gradient and curvature, summed over pairs, and the number of pairs."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curve, n = sums(w)
        step = np.linalg.solve(curve / n + ridge * np.eye(width), gradient / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def one_class(bad: int, width: int = 2 * len(FEATURES)) -> PairwiseModel:
    """Without documents of both labels all weights are zero, and the threshold puts each document in the class there is."""
    return PairwiseModel(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if bad else -1.0)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int | None = None, ridge: float = 1e-3, steps: int = 40, seed: int = 7) -> PairwiseModel:
    """P(a preferred to b) = logistic(score a - score b) over all pairs of a preferred and a rejected document, for features in memory.

    Newton steps on the logistic loss of feature differences. The threshold is the quantile of the scores at
    the share of rejected documents, half way to the next score. With one class only, all weights are zero and
    the threshold puts each document in that class. ``pairs`` draws so many pairs instead of taking all. ``train`` does the same on tables.
    """
    z = _basis(x) if len(x) else np.zeros((0, 2 * len(FEATURES)))
    if not (y == 1).any() or not (y == 0).any():
        return one_class(int((y == 0).sum()))
    mean, scale = z.mean(0), z.std(0)
    scale[scale < 1e-9] = 1.0
    z = (z - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if pairs is None:
        tiles = [(z[good[i:i + BLOCK]], z[bad[j:j + BLOCK]]) for i in range(0, len(good), BLOCK) for j in range(0, len(bad), BLOCK)]
        w = newton(lambda w: tuple(map(sum, zip(*(pair_sums(g, b, w) for g, b in tiles)))), z.shape[1], ridge, steps)
    else:
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = newton(lambda w: pair_sums(d, np.zeros((1, d.shape[1])), w), d.shape[1], ridge, steps)
    scores = np.sort(z @ w)
    at = len(bad)
    return PairwiseModel(mean, scale, w, float((scores[at - 1] + scores[min(at, len(scores) - 1)]) / 2))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of feature lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """Sum over all batches of ``part``, ``width`` numbers; a task gives one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["total"])

    return sum((np.array(r["total"]) for r in rows.mapInArrow(run, "total array<double>").collect()), np.zeros(width))


def blocks(measured: DataFrame, good: int, bad: int) -> DataFrame:
    """One row per block, ``rows`` (_key, y, x): every document is in a block with others of the other label.

    Documents are dealt to blocks of about ``BLOCK`` by their hashed id. Those of a rare label go to as many blocks as give
    each block about ``RARE`` of them, so that no document is left without a pair and a block stays bounded. Up to ``BLOCK`` documents are one block.
    """
    n = max(1, (good + bad) // BLOCK)
    rare = min(good, bad)
    copies = min(n, max(1, -(-RARE * n // rare)))
    first = F.pmod(F.xxhash64("_key"), F.lit(n))
    many = F.when(F.col("y") == (1 if good <= bad else 0), F.lit(copies)).otherwise(F.lit(1))
    at = F.explode(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.pmod(first + i, F.lit(n)))).alias("block")
    return measured.select("_key", "y", "x", at).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("_key", "y", "x"))).alias("rows"))


def quantile_cut(scores: DataFrame, n: int, at: int) -> float:
    """Half way between the values of rank ``at`` and the next of the ``n`` values ``s``: a sketch says where they are, counts are exact."""
    margin, upper = 2e-4, min(at + 1, n)
    while True:
        low, high = scores.agg(F.percentile_approx("s", [max(0.0, at / n - margin), min(1.0, upper / n + margin)], 20_000)).first()[0]
        below = scores.where(F.col("s") < low).count()
        near = scores.where(F.col("s").between(low, high)).groupBy("s").count().orderBy("s").collect()
        if below < at and below + sum(r["count"] for r in near) >= upper:
            break
        margin *= 10
    ranks = below + np.cumsum([r["count"] for r in near])
    value = lambda rank: near[int(np.searchsorted(ranks, rank))]["s"]
    return float((value(at) + value(upper)) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          ridge: float = 1e-3, steps: int = 40) -> PairwiseModel:
    """Model of all labelled documents that are not held out (crc32 of the id modulo 3 is not 1).

    Every such document is measured and meets those of the other label in its block (``blocks``); up to ``BLOCK`` documents
    that is all pairs. Means, scales and the threshold are those of all of them. A Newton step is one pass over the blocks, which
    brings some thousand numbers a task to the driver. Weights are rounded to nine digits, so that the order of sums does not show. Null labels, ids and
    labels other than 0 and 1 are left out; an id with both labels counts as rejected; rows without a document or the other way round
    are left out. Of several documents with one id the text that sorts first counts. Null and empty texts have the zero features,
    and without rows of both labels the model scores all texts alike. Whole texts are measured.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(
        F.col(id_col).cast("long").alias("_key")).agg(F.min(label_col).alias("_y"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text"))
    rows = rows.where(~held_out("_key")).join(chosen, "_key").groupBy("_key", "_y").agg(F.min("_text").alias("_text"))
    schema = pa.schema([("_key", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_y").cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))], schema=schema)

    measured = written(rows.mapInArrow(run, "_key long, y int, x array<double>"))
    counted = {r["y"]: r["count"] for r in measured.groupBy("y").count().collect()}
    good, bad = counted.get(1, 0), counted.get(0, 0)
    if not good or not bad:
        return one_class(bad)
    n, width = good + bad, 2 * len(FEATURES)
    mean = _summed(measured, lambda b: _basis(_vectors(b.column("x"))).sum(0), width) / n
    scale = np.sqrt(_summed(measured, lambda b: ((_basis(_vectors(b.column("x"))) - mean) ** 2).sum(0), width) / n)
    scale[scale < 1e-9] = 1.0
    grouped = materialize(blocks(measured, good, bad))

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(width + width * width + 1)
            for at in range(batch.num_rows):
                block = batch.column("rows").slice(at, 1).flatten()
                y = block.field("y").to_numpy()
                z = (_basis(_vectors(block.field("x"))) - mean) / scale
                g, h, n = pair_sums(z[y == 1], z[y == 0], w)
                total += np.concatenate([g, h.ravel(), [n]])
            return total

        total = _summed(grouped, part, width + width * width + 1)
        return total[:width], total[width:-1].reshape(width, width), int(total[-1])

    model = PairwiseModel(mean, scale, np.round(newton(sums, width, ridge, steps), 9), 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_vectors(batch.column("x"))))], names=["s"])

    scores = materialize(measured.mapInArrow(measure, "s double"))
    return PairwiseModel(mean, scale, model.weights, quantile_cut(scores, n, bad))


def score(docs: DataFrame, model: PairwiseModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: 0 to 1, 0.5 at the threshold. The model's few dozen numbers go with the task.

    Null and empty texts have the score of the zero features. Each of several equal rows has its score, and an empty table gives
    an empty one. A column ``out`` of the input is replaced.
    """
    @F.pandas_udf("double")
    def measure(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return docs.withColumn(out, measure(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score of 0.5 or more, columns unchanged whatever their names; the model is learned from ``labels``."""
    model = train(docs, labels, id_col, text_col)
    name = unused(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) >= 0.5).drop(name)

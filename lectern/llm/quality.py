"""Quality classifier: Bradley-Terry pairwise ranking over text features, thresholded by score quantile."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import kept
from .common import BROADCAST_ROWS, prepare

#: Pairs of a block of few documents; of a larger block every document is in PARTNERS pairs or more.
PAIRS = 40_000
PARTNERS = 16
#: Labelled documents of a block, and how many of each class a block has at least on average (by copies of the rarer class).
BLOCK, LEAST = 4096, 64
BUCKETS = 4096
#: Score at the quantile that parts documents to keep from others.
KEEP_SCORE = 0.7
SEED = 5

_SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_GROUPS = [list(range(65, 91)), list(range(97, 123)), list(range(48, 58)), list(range(128, 256)), [9, 11, 12, 13, 32], [10], list(_SYMBOLS), list(b".,;:"), list(b"|"), list(b"!"), list(b"#$%&*")]
N_FEATURES = len(_GROUPS) + 9


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, and repetition of characters, words, word pairs and lines, over the whole text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    n = max(1, len(data))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    chars = counts[(counts > 0)] / n
    return [
        *(float(counts[g].sum()) / n for g in _GROUPS),
        math.log1p(len(data)),
        n / m / 10,
        distinct / m ** 0.9,
        math.log((distinct + 1) / (m + 1)),
        pairs / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)),
        float(-(chars * np.log(chars)).sum()) if len(data) else 0.0,
        float((data[1:] == data[:-1]).mean()) if len(data) > 1 else 0.0,
        math.log1p(max(map(len, words), default=0)),
    ]


def held_out(id_col: str, divisor: int, remainder: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(divisor)) == remainder


def known_labels(labels: DataFrame, label: str, id_col: str, divisor: int, remainder: int) -> DataFrame:
    """``(_id, y, _o)`` of every id that is labelled outside the held-out fold, ``_o`` a hash of it.

    Of rows that label an id more than once the greatest label counts; null labels and ids do not.
    """
    return (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, divisor, remainder))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label)).alias("y"))
        .withColumn("_o", F.xxhash64("_id"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, divisor: int, remainder: int, size: int, chars: int) -> DataFrame:
    """``(id, text, y)`` of at most ``size`` labelled documents outside the held-out fold, half of each class, by least hash of the id.

    The ids (16 bytes each, ``size`` at most) are broadcast, so documents are read but not shuffled.
    """
    known = known_labels(labels, label, id_col, divisor, remainder)
    picked = known.where("y = 1").orderBy("_o", "_id").limit(size // 2).union(known.where("y != 1").orderBy("_o", "_id").limit(size // 2))
    short = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    return short.join(F.broadcast(picked.select("_id", "y", "_o")), "_id")


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, divisor: int, remainder: int) -> DataFrame:
    """``(_o, y, x)`` of every labelled document outside the held-out fold, whatever its length. Texts are not shuffled: many ids meet narrow features."""
    known = known_labels(labels, label, id_col, divisor, remainder)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        texts = texts.join(F.broadcast(known), "_id").select("_o", "y", "text")

    def run(batches):
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in texts.dtypes[:-1])
    found = texts.mapInArrow(run, f"{kinds}, x array<double>")
    return found if few else found.join(known, "_id").select("_o", "y", "x")


def matrix(batches) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a task's rows."""
    xs, ys = [np.zeros((0, N_FEATURES))], [np.zeros(0, dtype=bool)]
    for batch in batches:
        xs.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES))
        ys.append(batch.column("y").to_numpy(zero_copy_only=False) == 1)
    return np.vstack(xs), np.concatenate(ys)


def summed(rows: DataFrame, of) -> np.ndarray:
    """The sum over all tasks of the vector that ``of`` makes of a task's features and labels, added up in the order of tasks."""

    def run(batches):
        v = np.asarray(of(*matrix(batches)), dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64()))], ["v"])

    return np.sum([r["v"] for r in rows.mapInArrow(run, "v array<double>").collect()], axis=0)


def block_pairs(good: np.ndarray, bad: np.ndarray):
    """Differences of pairs (better, worse) of a block, part by part: every document is in one, no pair comes twice."""
    most, least = max(len(good), len(bad)), min(len(good), len(bad))
    i = np.arange(most)
    for shift in range(min(least, max(PARTNERS, PAIRS // max(1, most)))):
        yield good[i] - bad[(i + shift) % least] if len(good) >= len(bad) else good[(i + shift) % least] - bad[i]


def loss_sums(diff: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss, added up over differences."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
    return diff.T @ p, (diff * (p * (1 - p))[:, None]).T @ diff


def least_loss(size: int, means) -> np.ndarray:
    """The weights of least loss, by Newton steps with a ridge; ``means``: mean gradient and curvature at given weights."""
    w = np.zeros(size)
    for _ in range(25):
        grad, hess = means(w)
        step = np.linalg.solve(hess + 1e-3 * np.eye(size), grad - 1e-3 * w)
        w += step * min(1.0, 5 / max(1e-9, np.linalg.norm(step)))
        if np.abs(step).max() < 1e-6:
            break
    return w


def widest_gap(around: np.ndarray) -> float:
    """The middle of the widest gap between sorted scores."""
    gap = int(np.argmax(np.diff(around))) if len(around) > 1 else 0
    return float(around[gap : gap + 2].mean())


def near_rank(n: int, k: int) -> tuple[int, int]:
    """The ranks, a hundredth of all to each side, among which a cut at rank k is moved."""
    return max(0, k - 1 - n // 100), min(n, k + 1 + n // 100)


class RankModel:
    """Scores of features; learnt from pairs of which the first is the better."""

    def __init__(self):
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.weight, self.cut, self.steep = np.zeros(2 * N_FEATURES), 0.0, 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.minimum(z * z, 16)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> RankModel:
        """Logistic loss on feature differences of random pairs (better, worse), by Newton steps with a ridge.

        The cut is the quantile of all sampled scores at the share of worse documents, moved to the
        middle of the gap that it lies in. With one class only, every document is as good as any.
        """
        if len(x):
            self.mean, self.scale = np.median(x, axis=0), np.maximum(x.std(axis=0), 1e-3)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
        if not len(good) or not len(bad):
            self.cut = -math.inf if len(good) or not len(x) else math.inf
            return self
        phi = self.expand(x)
        rng = np.random.default_rng(SEED)
        diff = phi[rng.choice(good, PAIRS)] - phi[rng.choice(bad, PAIRS)]
        self.weight = least_loss(phi.shape[1], lambda w: [v / PAIRS for v in loss_sums(diff, w)])
        first, last = near_rank(len(x), len(bad))  # as many of the sample as are bad lie below the cut
        self.cut = widest_gap(np.sort(phi @ self.weight)[first:last])
        return self

    def fit_all(self, rows: DataFrame) -> RankModel:
        """As :meth:`fit`, of all rows ``(_o, y, x)``, which stay on the executors; features are centred by their mean.

        Rows are dealt by hash into blocks, in which every document is paired; the rarer class is copied to as many
        blocks as it needs. Sums of tasks come to the driver, and the scores near the cut, two in a hundred.
        """
        rows = kept(rows)
        n, better = rows.agg(F.count("*"), F.count(F.when(F.col("y") == 1, 1))).first()
        if n:
            self.mean = summed(rows, lambda x, y: x.sum(axis=0)) / n
            mean = self.mean
            self.scale = np.maximum(np.sqrt(summed(rows, lambda x, y: ((x - mean) ** 2).sum(axis=0)) / n), 1e-3)
        if better in (0, n):
            self.cut = -math.inf if better or not n else math.inf
            return self
        blocks = math.ceil(n / BLOCK)
        copies = F.when(F.col("y") == 1, min(blocks, math.ceil(LEAST * blocks / better))).otherwise(min(blocks, math.ceil(LEAST * blocks / (n - better))))
        dealt = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("_b", F.pmod(F.col("_o") + F.col("_b"), F.lit(blocks)))
        dealt = kept(dealt.repartition(blocks, "_b").sortWithinPartitions("_o", "y", "x").select("y", "x"))
        model, size = self, 2 * N_FEATURES

        def means(w):
            def sums(x, y):
                out = np.zeros(1 + size + size * size)
                phi = model.expand(x)
                for diff in block_pairs(phi[y], phi[~y]):
                    grad, hess = loss_sums(diff, w)
                    out += np.concatenate([[len(diff)], grad, hess.ravel()])
                return out

            total = summed(dealt, sums)
            return total[1 : 1 + size] / total[0], total[1 + size :].reshape(size, size) / total[0]

        self.weight = least_loss(size, means)
        self.cut = cut_of(rows, self, n, n - better)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if math.isinf(self.cut):
            return np.full(len(x), 1.0 if self.cut < 0 else 0.0)
        raw = self.expand(x) @ self.weight - self.cut
        return 1 / (1 + np.exp(-np.clip(self.steep * raw + math.log(KEEP_SCORE / (1 - KEEP_SCORE)), -30, 30)))


def cut_of(rows: DataFrame, model: RankModel, n: int, k: int) -> float:
    """The cut below which k of the n scores of all rows lie, moved as in :meth:`RankModel.fit`; found by a histogram, then among the scores of its buckets."""

    def run(batches):
        for batch in batches:
            x, _ = matrix([batch])
            yield pa.RecordBatch.from_arrays([pa.array(model.expand(x) @ model.weight)], ["s"])

    scores = rows.select("y", "x").mapInArrow(run, "s double")
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("s") - low) / (max(high - low, 1e-300)) * BUCKETS))
    counts = np.zeros(BUCKETS, dtype=int)
    for r in scores.groupBy(bucket.alias("b")).count().collect():
        counts[r["b"]] = r["count"]
    below = np.concatenate([[0], np.cumsum(counts)])
    first, last = near_rank(n, k)
    a, b = int(np.searchsorted(below, first, "right")) - 1, int(np.searchsorted(below, last, "left")) - 1
    near = np.sort([r["s"] for r in scores.where(bucket.between(a, b)).collect()])
    return widest_gap(near[first - below[a] : last - below[a]])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> RankModel:
    """Fits on every labelled document outside the held-out fold."""
    prepare(docs.sparkSession)
    return RankModel().fit_all(labelled_features(docs, labels, label, id_col, text_col, 4, 2))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", model: RankModel | None = None
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if the score is 0.7 or more).

    The score depends on the text alone. 0.7 stands for the quantile of the scores of all labelled documents outside
    the held-out fold at the share of those labelled as poor. Null texts are empty; empty texts are scored by the same features.
    Without labels, or with one class only, all scores are 1 (0 if all are poor). Repeated rows give repeated rows; a null id is
    not held out. An empty table gives no rows.
    """
    model = model or fit_quality(docs, labels, id_col, text_col, label)
    kind = docs.schema[id_col].dataType.simpleString()
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            s = score_texts(model, batch.column(1))
            held = pa.array([v is not None and zlib.crc32(str(v).encode()) % 4 == 2 for v in batch.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(s, pa.float64()), pa.array(s >= KEEP_SCORE).cast(pa.int32())], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def score_texts(model: RankModel, texts) -> np.ndarray:
    x = np.array([features(t.as_py()) for t in texts], dtype=float).reshape(len(texts), N_FEATURES)
    return model.score(x)


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """The documents that score 0.7 or more, with all their columns and without a shuffle."""
    model = fit_quality(docs, labels, id_col, text_col, label)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, batch.column(place)) >= KEEP_SCORE))

    return docs.mapInArrow(run, docs.schema)

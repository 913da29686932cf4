"""Quality scores by Bradley-Terry ranking: learned from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stacklight.llm.common import fresh, table

#: The model is fitted on at most so many labelled rows, those with the smallest hashes of their ids, and so many pairs of them.
SAMPLE, PAIRS = 20_000, 200_000
RIDGE, STEPS = 1e-3, 30
#: Bytes of a text that are split into words at once.
PIECE = 1 << 22

_CLASSES = [b"!", b"|", b"#%&$*", b".", b",", b"?;:", b"0123456789", b"\n", b" \t", b"@/\\<>=_~^{}[]()+-", b"'\"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"]
_OF = np.zeros((256, len(_CLASSES) + 1))
for _k, _c in enumerate(_CLASSES):
    _OF[list(_c), _k] = 1
_OF[128:, -1] = 1


def features(text: bytes | None) -> np.ndarray:
    """Rates of byte classes, of repeated, upper-case, long and short words, and the length. Nothing but the text goes in."""
    data = text or b""
    size = max(1, len(data))
    counts = np.zeros(256)
    n = total = upper = runs = short = long_ = 0
    seen: set[bytes] = set()
    last = None
    at = 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and data[to] not in b" \n\t" and to - at < 2 * PIECE:
            to += 1
        part = data[at:to]
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.lower().split()
        if words:
            n += len(words)
            runs += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
            last = words[-1]
            seen.update(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            total += int(lengths.sum())
            short += int((lengths <= 2).sum())
            long_ += int((lengths >= 12).sum())
            upper += sum(map(bytes.isupper, part.split()))
        at = to
    w = max(1, n)
    rates = counts @ _OF / size
    logs = np.log1p(rates * 1000)
    return np.concatenate([rates, logs, [len(seen) / w, (len(seen) / w) ** 2, len(seen) / w * np.log1p(n), runs / w, np.log1p(100 * runs / w), upper / w, np.log1p(100 * upper / w), short / w, long_ / w, total / w / 10, np.log1p(n)]])


WIDTH = len(features(b""))


@dataclass
class Ranker:
    """score = sigmoid(weights . (x - mean) / scale - cut)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ranker:
    """Bradley-Terry: P(a is preferred to b) = sigmoid(s(a) - s(b)), by Newton steps on the ridged logistic loss of pairs.

    Without both labels there are no pairs and every score is 0.5.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(WIDTH)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        grad = -(d * p[:, None]).mean(0) + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(WIDTH)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return Ranker(mean, scale, w, float(np.quantile(s, len(bad) / (len(good) + len(bad)))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Ranker:
    """Fits on labelled rows that are not held out; rows without id or label, or with an id that `docs` lacks, teach nothing.
    An id with several labels counts as its smallest."""
    ids = F.col(id_col).cast("long")
    known = labels.select(ids.alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(ids.alias("id"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(known), "id")  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tolist() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id long, y int, x array<double>").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, WIDTH)[order]
    return fit(x, got.column("y").to_numpy()[order])


def scored(docs: DataFrame, model: Ranker, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with score_col, 0 to 1, in place of a column of that name. Null texts score as empty ones, and very long ones whole; repeated rows
    and equal texts have equal scores; all other columns pass through; an empty table stays empty."""
    docs = docs.drop(score_col)
    text_at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).cast(pa.large_binary()).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ..) that score 0.5 or more, with their columns; otherwise as scored()."""
    (score,) = fresh(docs, "score")
    return scored(docs, train(docs, labels), score_col=score).where(F.col(score) >= 0.5).drop(score)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

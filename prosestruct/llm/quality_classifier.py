"""Quality classifier: Bradley-Terry ranking of documents by features of their text.

For a pair of labelled documents of which g is good and b is bad, P(g before b) = 1 / (1 + exp(-w . (x_g - x_b))). The
weights w are fitted by Newton's method on this logistic loss over feature differences, with a small ridge. A document's
merit is w . x. The threshold is the quantile of the fitted documents' merits at the share of bad ones among them; the
score is 1 / (1 + exp(-(merit - threshold))), so 0.5 marks the quantile.

Labels are used only of documents whose crc32(doc_id as text) mod 3 is not 1. Fitting takes at most MAX_FIT of them, by
the smallest digests of their ids, and PAIRS pairs drawn with a fixed seed; a document with several labels counts as
good if half of them or more say so. Scores cover every row. Without a good and a bad document all scores are 0.5.

Null texts count as empty; an empty text is scored as a text without words. Rows with equal ids are scored each; a null
id is not held out. Other columns are ignored by scores() and kept by keep_good(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, arrow_schema, give_back

MAX_FIT = 20_000
PAIRS = 60_000
RIDGE = 1e-3
_PUNCT = tuple(b".!?,;:")


def features(text: str | None) -> list[float]:
    """Shape of a text: lengths, letter cases, signs, repetition of words and lines. Never language or content."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    chars = max(1, len(raw) - sum(raw.count(bytes((c,))) for c in SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    same = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&"))
    bars = raw.count(b"|") + raw.count(b"<") + raw.count(b">")
    loud = raw.count(b"!") + raw.count(b"?")
    upper = sum(1 for w in words if w.isupper())
    stops = raw.count(b".") + raw.count(b",")
    digits = sum(raw.count(bytes((c,))) for c in b"0123456789")
    few = lambda x: min(1.0, 4 * x)  # noqa: E731  a quarter already says it all
    return [
        np.log1p(len(words)) / 5, 1.0 if len(words) < 10 else 0.0, chars / n / 10, few(marked / n / 3), min(1.0, marked / chars),
        few(bars / n), bars / chars, few(loud / n), few(upper / n), upper / n, few(stops / n), stops / n, digits / chars,
        len(counts) / n, np.log(n / max(1, len(counts))) / 5, top / n, few(same / n), same / n, len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        merit = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(merit - self.threshold, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Ranking:
    """Bradley-Terry weights of features x, by preference pairs of good over bad rows; threshold at the bad ones' share."""
    width = x.shape[1] if x.ndim == 2 else len(features(""))
    if not good.any() or good.all():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = (x - mean) / scale
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(good), pairs)] - z[draw.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the wrong order
        gradient = d.T @ p / pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    merit = np.sort(z @ w)
    bad = int((~good).sum())
    return Ranking(mean, scale, w, float((merit[bad - 1] + merit[bad]) / 2))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Ranking:
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    voted = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    sample = voted.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_fit)
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_fit rows of 9 bytes

    def make():
        return lambda batch: {"doc_id": batch["doc_id"], "good": batch["good"], "x": list(map(features, batch["text"].to_pylist()))}

    found = arrow_map(chosen.select("doc_id", "good", "text"), make, "doc_id long, good boolean, x array<double>")
    rows = found.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return fit(np.array([r.x for r in rows]), np.array([r.good for r in rows], dtype=bool))


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    ranking = train(documents, labels)

    def make():
        def work(batch):
            texts = batch["text"].to_pylist()
            s = ranking.scores(np.array(list(map(features, texts)))) if texts else np.zeros(0)
            return {"doc_id": batch["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return work

    found = arrow_map(documents.select("doc_id", "text"), make, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    ranking = train(documents, labels)
    arrow_schema(documents, "x long")

    def run(batches):
        try:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                if texts:
                    yield batch.filter(pa.array(ranking.scores(np.array(list(map(features, texts)))) >= 0.5))
        finally:
            batch = texts = None
            give_back()

    return documents.mapInArrow(run, documents.schema)

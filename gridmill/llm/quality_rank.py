"""A quality classifier by Bradley-Terry pairwise ranking.

Every preference pair is a good and a bad document; the probability that the good one wins is a logistic function of
the difference of their features, and minimising the logistic loss over the pairs gives one weight per
feature. A document's score is its weighted features, placed so that 0.3 is the score quantile that parts
the labels best.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridmill.llm.bpe import appended

CUT = 0.3  # scores from here on predict label 1
CLASSES = [b"!", b"#*$%&|<>", b".,;:?", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"\n",
           b" \t\r\x0b\x0c", bytes(range(128, 256)), b"\"'()[]{}/\\=+-_@^~`"]


def features(text: str | None) -> list[float]:
    """Shares and logarithms of counts of the whole text; all zero for an empty one."""
    raw = text.encode() if text else b""
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    counts = Counter(words)
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = [int(seen[list(c)].sum()) for c in CLASSES]
    twice = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = max(counts.values(), default=0)
    out = [k / size for k in kinds] + [np.log1p(k) for k in kinds[:2]]
    return out + [len(counts) / n, twice / n, np.log1p(twice), most / n, 1 - len(set(lines)) / max(1, len(lines)),
                  np.log1p(len(words)), size / n / 10, float(not words)]


def with_features(df: DataFrame, text: str = "text", into: str = "features") -> DataFrame:
    make = lambda texts: [pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))]
    return appended(df, text, T.StructType().add(into, T.ArrayType(T.DoubleType())), make)


class Ranker:
    """Weights over scaled features and their squares, and the place of the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 25, opponents: int = 8, penalty: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = self.expand(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        # each row of the larger label meets `opponents` rows of the other, so every row is in some pair
        many, few = (good, bad) if len(good) >= len(bad) else (bad, good)
        other = few[(np.arange(len(many))[:, None] * opponents + np.arange(opponents)) % len(few)]
        d = (z[many][:, None, :] - z[other]).reshape(-1, z.shape[1]) * (1 if many is good else -1)
        self.weights = np.zeros(z.shape[1])
        for _ in range(rounds):  # Newton steps on the penalised logistic loss of the pairs
            win = 1 / (1 + np.exp(-np.clip(d @ self.weights, -30, 30)))
            slope = d.T @ (win - 1) / len(d) + penalty * self.weights
            curve = (d * (win * (1 - win))[:, None]).T @ d / len(d) + penalty * np.eye(len(slope))
            self.weights -= np.linalg.solve(curve, slope)
        raw = z @ self.weights
        grid = np.quantile(raw, np.arange(1, 1000) / 1000)
        order = np.sort(raw[good]), np.sort(raw[bad])
        missed = np.searchsorted(order[0], grid) / len(good) + 1 - np.searchsorted(order[1], grid) / len(bad)
        best = np.flatnonzero(missed == missed.min())
        self.cut = float((grid[best[0]] + grid[best[-1]]) / 2)  # the score quantile that parts the labels best
        self.steep = 4 / max(1e-9, float(np.median(order[0]) - np.median(order[1])))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z * z / 8], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.steep * (self.expand(x) @ self.weights - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text",
          rows: int = 20_000) -> Ranker | float:
    """Fit on at most `rows` labelled documents, those with the smallest hash of the key.

    The sample is bounded, so its ids may be broadcast and its features collected; it is put in the order of the keys' hashes, so
    that the pairs do not depend on how the rows are stored. Labels are 0 and 1; null keys, other labels and keys with
    contradictory labels are left out. With one label only there is no pair: its share is the score of all.
    """
    one = labels.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where(
        F.col(key).isNotNull() & (F.col("_a") == F.col("_b")) & F.col("_a").isin(0, 1)).select(key, F.col("_a").alias("_label"))
    order = [F.xxhash64(key), F.col(key)]
    chosen = one.orderBy(*order).limit(rows)
    found = with_features(docs.select(key, text).join(F.broadcast(chosen), key), text).orderBy(
        *order, F.xxhash64(text)).select("_label", "features").limit(rows).collect()
    y = np.array([r[0] for r in found])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Ranker(np.array([r[1] for r in found]), y)


def with_score(df: DataFrame, ranker: "Ranker | float", text: str = "text", into: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1; null and empty texts are scored by their (zero) features."""
    def make(texts: pa.Array) -> list[pa.Array]:
        plain = texts.to_pylist()
        if not plain or isinstance(ranker, float):
            return [pa.array([ranker] * len(plain), pa.float64())]
        return [pa.array(ranker.score(np.array([features(t) for t in plain])))]

    return appended(df, text, T.StructType().add(into, T.DoubleType()), make)

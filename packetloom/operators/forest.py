"""Isolation forest over structure features.

Trees are grown in parallel Spark tasks on samples of a benign envelope that
is drawn from fixed parameters. The node table has trees * (2 * sample - 1)
rows at most, so it is collected and broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import fixed_values as fv

# Rows scored at once; each takes some numbers per tree.
_SCORED_ROWS = 256
_NODES = "tree int, node int, feature int, split double, path double"


def benign_envelope(seed: int, rows: int) -> np.ndarray:
    """Feature vectors of harmless documents, drawn from fixed ranges."""
    rng = np.random.default_rng(seed)
    data = np.zeros((rows, len(fv.STRUCTURE_FEATURES)))
    for name, low, high, integer in fv.FOREST_ENVELOPE:
        draw = rng.integers(low, high, rows) if integer else rng.uniform(low, high, rows)
        data[:, fv.STRUCTURE_FEATURES.index(name)] = draw
    data[:, fv.STRUCTURE_FEATURES.index("acroform")] = rng.random(rows) < fv.FOREST_ACROFORM_RATE
    return data


def _average_path(size) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``size`` points."""
    size = np.asarray(size, dtype=np.float64)
    large = np.maximum(size, 3)
    harmonic = np.log(large - 1) + np.euler_gamma
    return np.where(size <= 1, 0.0, np.where(size <= 2, 1.0, 2 * harmonic - 2 * (large - 1) / large))


def _grow(sample: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes (position, feature or -1, split, path) of one tree in heap order."""
    nodes, open_nodes = [], [(0, 0, sample)]
    while open_nodes:
        node, depth, points = open_nodes.pop()
        spread = np.flatnonzero(np.ptp(points, axis=0) > 0) if len(points) > 1 else []
        if depth == depth_limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, depth + float(_average_path(len(points)))))
            continue
        feature = int(rng.choice(spread))
        split = rng.uniform(points[:, feature].min(), points[:, feature].max())
        right = points[:, feature] > split
        nodes.append((node, feature, float(split), 0.0))
        open_nodes += [(2 * node + 1, depth + 1, points[~right]), (2 * node + 2, depth + 1, points[right])]
    return nodes


class IsolationForest:
    """Fitted forest: arrays of shape (trees, nodes) and the score offset."""

    def __init__(self, feature: np.ndarray, split: np.ndarray, path: np.ndarray, sample: int):
        self.feature, self.split, self.path, self.sample = feature, split, path, sample
        self.offset = 0.0

    def score_samples(self, data: np.ndarray) -> np.ndarray:
        parts = [self._score(data[at:at + _SCORED_ROWS]) for at in range(0, len(data), _SCORED_ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _score(self, data: np.ndarray) -> np.ndarray:
        trees = np.arange(self.feature.shape[0])[None, :]
        node = np.zeros((len(data), self.feature.shape[0]), dtype=np.int64)
        for _ in range(int(np.ceil(np.log2(self.sample)))):
            feature = self.feature[trees, node]
            value = np.take_along_axis(data, np.maximum(feature, 0), axis=1)
            child = 2 * node + 1 + (value > self.split[trees, node])
            node = np.where(feature < 0, node, child)
        mean_path = self.path[trees, node].mean(axis=1)
        return -(2.0 ** (-mean_path / float(_average_path(self.sample))))

    def anomaly(self, data: np.ndarray, gain: float = fv.FOREST["gain"]) -> np.ndarray:
        """0 for normal vectors, up to 1 for clearly unusual ones."""
        return np.clip(-(self.score_samples(data) - self.offset) * gain, 0.0, 1.0)


def fit_forest(spark: SparkSession, trees: int = fv.FOREST["trees"], sample: int = fv.FOREST["sample"],
               rows: int = fv.FOREST["rows"], contamination: float = fv.FOREST["contamination"],
               seed: int = fv.FOREST["seed"]) -> IsolationForest:
    depth_limit = int(np.ceil(np.log2(sample)))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = benign_envelope(seed, rows)
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                points = data[rng.choice(rows, size=min(sample, rows), replace=False)]
                yield pd.DataFrame([(int(tree), *node) for node in _grow(points, rng, depth_limit)],
                                   columns=["tree", "node", "feature", "split", "path"])

    nodes = spark.range(trees).repartition(min(trees, 8)).mapInPandas(grow, _NODES).toPandas()
    shape = (trees, 2 ** (depth_limit + 1) - 1)
    feature, split, path = np.full(shape, -1, dtype=np.int64), np.zeros(shape), np.zeros(shape)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature[at], split[at], path[at] = nodes["feature"], nodes["split"], nodes["path"]
    forest = IsolationForest(feature, split, path, min(sample, rows))
    forest.offset = float(np.percentile(forest.score_samples(benign_envelope(seed, rows)), 100 * contamination))
    return forest


def _vectors(features: pa.MapArray) -> np.ndarray:
    """One row per map with its values in feature order, 0 where absent."""
    data = np.zeros((len(features), len(fv.STRUCTURE_FEATURES)))
    sizes = np.diff(features.offsets.to_numpy())
    column = pc.index_in(features.keys, pa.array(fv.STRUCTURE_FEATURES)).to_numpy(zero_copy_only=False)
    used = slice(features.offsets[0].as_py(), features.offsets[-1].as_py())
    data[np.repeat(np.arange(len(features)), sizes), column[used].astype(int)] = features.items.to_numpy(zero_copy_only=False)[used]
    return data


def forest_anomaly(spark: SparkSession, forest: IsolationForest, features: Column) -> Column:
    """Anomaly of a feature map column, scored batch by batch.

    The map goes to the worker as it is; taking it apart into fifteen columns
    first would evaluate the features once per column.
    """
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf(T.DoubleType())
    def score(maps: pa.Array) -> pa.Array:
        return pa.array(shared.value.anomaly(_vectors(maps)))

    return score(F.coalesce(features, F.create_map().cast("map<string,double>")))

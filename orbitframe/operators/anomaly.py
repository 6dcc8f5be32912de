"""Statistical anomaly ranking of orbits with an isolation forest."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitframe import constants as K
from orbitframe.sources.landing import landed

FEATURES = ["apogee (log)", "perigee (log)", "inclination", "eccentricity", "period"]
_X = [f"x{i}" for i in range(len(FEATURES))]
_NODES = ("tree int, node int, feature int, threshold double, left int, right int, "
          "depth int, size int")


def feature_rows(satcat: DataFrame) -> DataFrame:
    """Raw features x0..x4 of objects with a usable orbit."""
    apo, per = F.col("apogee_km"), F.col("perigee_km")
    ra, rp = apo + K.R_EARTH_KM, per + K.R_EARTH_KM
    return satcat.where((apo > 0) & (per > 0) & F.col("inclination").isNotNull()).select(
        "norad_id", F.log10(apo + 1).alias("x0"), F.log10(per + 1).alias("x1"),
        F.col("inclination").cast("double").alias("x2"), ((ra - rp) / (ra + rp)).alias("x3"),
        F.coalesce("period_min", F.lit(0.0)).alias("x4"))


def feature_stats(features: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each feature (zero becomes 1)."""
    aggs = []
    for x in _X:
        std = F.stddev_pop(x)
        aggs += [F.avg(x).alias(f"m_{x}"), F.when(std == 0, 1.0).otherwise(std).alias(f"s_{x}")]
    return features.agg(*aggs, F.count("*").alias("n"))


def _top_feature(df: DataFrame) -> DataFrame:
    """Feature with the largest absolute deviation, the first on ties."""
    size = F.array(*[F.abs(x) for x in _X])
    at = F.array_position(size, F.array_max(size)).cast("int")
    names = F.array(*[F.lit(name) for name in FEATURES])
    return df.withColumns({"top_feature": F.element_at(names, at),
                           "top_feature_z": F.element_at(F.array(*_X), at)})


def standardised(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Features in sigmas of the population ``stats``."""
    row = stats.select(F.struct(*stats.columns)).scalar()
    df = features.withColumn("_st", row)
    return df.select("norad_id", *[
        ((F.col(x) - F.col(f"_st.m_{x}")) / F.col(f"_st.s_{x}")).alias(x) for x in _X])


def anomaly_features(satcat: DataFrame) -> DataFrame:
    """Standardised features of the population and each object's top feature."""
    features = feature_rows(satcat)
    return _top_feature(standardised(features, feature_stats(features)))


def _expected_path(n: np.ndarray | int):
    """Mean unsuccessful search length in a binary tree of n leaves."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


_DRAW_DIGITS = 13
_DRAWS = 16 ** _DRAW_DIGITS


def _drawn(*parts) -> int:
    """A number below ``_DRAWS`` that depends on nothing but its parts."""
    text = ":".join(map(str, parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:_DRAW_DIGITS], 16)


def drawn(*parts: Column) -> Column:
    """The same as a column."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DRAW_DIGITS), 16, 10).cast("long")


def _grow_tree(sample: pd.DataFrame) -> pd.DataFrame:
    """Isolation tree over one bounded sample, grown level by level.

    Feature and threshold of a node are drawn by hash from the tree and the node's number in the
    full binary tree (the root is 1, its children 2 and 3). A threshold between neighbouring doubles
    may be rounded to the upper one; then all rows go left, and the right child is a leaf of size 0.
    """
    tree = int(sample["tree"].iloc[0])
    data = sample.sort_values("norad_id")[_X].to_numpy(dtype=float)
    limit = math.ceil(math.log2(max(len(data), 2)))
    nodes, queue = [], [(np.arange(len(data)), 0, 1)]
    while len(nodes) < len(queue):
        node = len(nodes)
        index, depth, place = queue[node]
        low = data[index].min(axis=0, initial=np.inf)
        high = data[index].max(axis=0, initial=-np.inf)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(index) <= 1 or len(splittable) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, depth, len(index)))
            continue
        feature = int(splittable[_drawn(tree, place, "f") % len(splittable)])
        share = _drawn(tree, place, "t") / _DRAWS
        threshold = float(low[feature] + (high[feature] - low[feature]) * share)
        goes_left = data[index, feature] <= threshold
        nodes.append((tree, node, feature, threshold, len(queue), len(queue) + 1, depth, len(index)))
        queue += [(index[goes_left], depth + 1, 2 * place), (index[~goes_left], depth + 1, 2 * place + 1)]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])


class AnomalyModel:
    """A fitted forest with the population statistics it was fitted on.

    Fitting is eager, as for any Spark estimator. What reaches the driver is
    bounded by trees x (2 x sample) nodes plus a dozen numbers. The raw scores of the population
    are landed while fitting, so it is scored once.
    """

    def __init__(self, stats: DataFrame, nodes: pd.DataFrame, sample_size: int):
        self.stats, self.nodes, self.sample_size = stats, nodes, sample_size
        self.low = self.high = self.population = None

    def raw_scores(self, features: DataFrame) -> DataFrame:
        """Standardised features plus the raw score (higher = easier to isolate)."""
        scaled = standardised(features, self.stats)
        columns = F.struct(*_X)
        return scaled.withColumn("raw", _forest_score(self.nodes, self.sample_size)(columns))

    def scores(self, satcat: DataFrame | None = None) -> DataFrame:
        """Scores in 0..1, with the outlier flag, of the population or of other objects."""
        raw = self.population if satcat is None else self.raw_scores(feature_rows(satcat))
        span = self.high - self.low
        scaled = F.lit(0.0) if span <= 0 else (F.col("raw") - self.low) / span
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
        return _top_feature(raw).select(
            "norad_id", bounded.alias("score"), (F.col("raw") > 0.5).alias("is_outlier"),
            "top_feature", "top_feature_z")

    def top_anomalies(self, satcat: DataFrame | None = None, n: int = 40) -> DataFrame:
        return self.scores(satcat).orderBy(F.desc("score"), "norad_id").limit(n)


def _forest_score(nodes: pd.DataFrame, sample_size: int):
    """Arrow UDF that walks every tree for a whole batch at once."""
    trees = []
    for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        size = part["size"].to_numpy()
        # what reaches a leaf without sample rows has no path in this tree, as in the SQL
        leaf_depth = np.where(size > 0, part["depth"].to_numpy() + _expected_path(size), 0.0)
        trees.append((part["feature"].to_numpy(), part["threshold"].to_numpy(),
                      part["left"].to_numpy(), part["right"].to_numpy(), leaf_depth,
                      int(part["depth"].max())))
    norm = float(_expected_path(sample_size)) * len(trees)

    @F.pandas_udf("double")
    def score(batch: pd.DataFrame) -> pd.Series:
        data = batch.to_numpy(dtype=float)
        total = np.zeros(len(data))
        rows = np.arange(len(data))
        for feature, threshold, left, right, leaf_depth, height in trees:
            at = np.zeros(len(data), dtype=int)
            for _ in range(height):
                f = feature[at]
                goes_left = data[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(goes_left, left[at], right[at]))
            total += leaf_depth[at]
        return pd.Series(np.power(2.0, -total / norm))

    return score


def _tree_samples(scaled: DataFrame, n_rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """A fixed-size sample per tree, chosen by hash so that it does not depend on partitioning.

    One hash deals all rows into hands of about twice the sample, one hand per tree; when there are
    fewer hands than trees the rows are dealt again with another seed, so how often they are dealt
    follows from the number of rows. Each tree then takes the smallest hashes of its hand, cut
    inside map tasks before the shuffle. ``sample`` rows a tree (256) are the published parameter
    of the method, at any size of the population.
    """
    hands = max(1, n_rows // (2 * sample))
    deals = -(-trees // hands)
    dealt = scaled.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = dealt.withColumn("tree", (F.col("_deal") * hands + drawn(
        F.col("norad_id"), F.col("_deal"), F.lit(seed)) % hands).cast("int")).where(F.col("tree") < trees)
    w = Window.partitionBy("tree").orderBy("_u", "norad_id")
    return (
        dealt.withColumn("_u", drawn(F.col("norad_id"), F.col("_deal"), F.lit(seed), F.lit("u")))
        .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= sample)
        .select("norad_id", *_X, "tree")
    )


def fit_anomaly_model(satcat: DataFrame, trees: int = K.FOREST_TREES,
                      sample: int = K.FOREST_SAMPLE, min_objects: int = K.MIN_POPULATION,
                      seed: int = 42) -> AnomalyModel:
    """Fit the forest on a population; refuses fewer than ``min_objects``."""
    features = feature_rows(satcat)
    spark = satcat.sparkSession
    summary = feature_stats(features).first()
    if summary["n"] < min_objects:
        raise ValueError("not enough objects with orbital data to fit an anomaly model")
    stats = spark.createDataFrame([summary])
    scaled = standardised(features, stats)
    nodes = _tree_samples(scaled, summary["n"], trees, sample, seed).groupBy(
        "tree").applyInPandas(_grow_tree, _NODES).toPandas()
    model = AnomalyModel(stats, nodes, min(sample, summary["n"]))
    model.population = landed(model.raw_scores(features))
    bounds = model.population.agg(F.min("raw"), F.max("raw")).first()
    model.low, model.high = bounds[0], bounds[1]
    return model

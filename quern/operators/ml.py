"""Ensembles by shards of the data (survey M10, P39, A40, S30)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import majority


def split(df: DataFrame, key: str, train: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same split whatever the partitions."""
    low = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(train * 10_000)
    return df.where(low), df.where(~low)


def forest_votes(train: DataFrame, test: DataFrame, key: str, features: str, label: str, shards: int = 3, trees: int = 10) -> DataFrame:
    """(key, label, vote): forests are fitted on the shards row mod shards, and their rounded mean is the vote."""
    as_vector = lambda df: df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    every = None
    for s in range(shards):
        shard = as_vector(train.where(F.pmod(F.xxhash64(key), F.lit(shards)) == s))
        model = RandomForestClassifier(numTrees=trees, seed=s).fit(shard)
        votes = model.transform(as_vector(test)).select(key, "label", "prediction")
        every = votes if every is None else every.unionByName(votes)
    return every.groupBy(key, "label").agg(majority(F.avg("prediction")).alias("vote"))

"""Training and scoring on feature tables: folds, several seeds, out-of-fold means, saved models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import NODES, Model, Settings, as_rows, blocks_of, boosted, edges_of, held_out, importances, probability

__all__ = ["SEEDS", "Settings", "ensemble", "fitted", "folds", "importances", "load", "mean_probability", "out_of_fold", "predict", "save"]

#: Seeds of the ensemble.
SEEDS = (42, 123, 456, 789, 1024)


def folds(df: DataFrame, k: int, key: str = "id", label: str = "label", seed: int = 0, name: str = "fold") -> DataFrame:
    """Adds fold 0 to k - 1, each with its share of every label. Rows are dealt by a hash first, so that a label's window
    holds one part of its rows; MD5, so that other engines can deal the same folds."""
    digest = lambda n: F.md5(F.concat(F.lit(f"{n}:"), F.col(key).cast("string")).cast("binary"))
    dealt = df.withColumn("__part", F.pmod(F.conv(F.substring(digest(seed + 1), 1, 2), 16, 10).cast("int"), F.lit(64))).withColumn("__order", digest(seed))
    place = F.row_number().over(Window.partitionBy(label, "__part").orderBy("__order", key))
    return dealt.withColumn(name, F.pmod(place + F.col("__part"), F.lit(k)).cast("int")).drop("__part", "__order")


def out_of_fold(df: DataFrame, features: Sequence[str], k: int = 5, seeds: Sequence[int] = SEEDS, key: str = "id", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """key, label and the mean probability of the models that did not see the row: k folds for each seed, all grown together.

    Bins are cut from the quantiles of all rows. df is read three times: give a table that is written or cached.
    """
    edges = edges_of(df, features, settings.bins)
    dealt = df
    for i, seed in enumerate(seeds):
        dealt = folds(dealt, k, key, label, seed, f"__fold{i}")
    blocks = blocks_of(dealt, features, key, label, [F.col(f"__fold{i}") for i in range(len(seeds))], edges)
    models = boosted(blocks, [Model(seed, i, f) for i, seed in enumerate(seeds) for f in range(k)], len(features), settings)
    rows = held_out(blocks, models, len(features)).select(F.col("key").cast(df.schema[key].dataType).alias(key), F.col("label").alias(label), "prob")
    return mean_probability(rows, key, label)


def fitted(df: DataFrame, valid: DataFrame, features: Sequence[str], seeds: Sequence[int] = SEEDS, key: str = "id", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """The trees of one model a seed, trained on all rows of df and watched on those of valid."""
    edges = edges_of(df, features, settings.bins)
    both = df.select(key, label, *features, F.lit(0).alias("__own")).union(valid.select(key, label, *features, F.lit(1)))
    blocks = blocks_of(both, features, key, label, [F.col("__own")], edges)
    models = boosted(blocks, [Model(seed, 0, 1) for seed in seeds], len(features), settings)
    return df.sparkSession.createDataFrame(as_rows(models, edges), NODES)


def save(trees: DataFrame, path: str, features: Sequence[str], threshold: float, **more) -> None:
    """Trees as a Parquet table, and beside them their features, threshold and other settings."""
    from ..sources.writers import settings

    trees.write.mode("overwrite").parquet(f"{path}/trees")
    settings(trees.sparkSession, f"{path}/settings", features=list(features), threshold=threshold, **more)


def load(path: str) -> tuple[DataFrame, dict]:
    from ..sources.writers import read_settings

    spark = SparkSession.active()
    return spark.read.schema(NODES).parquet(f"{path}/trees"), read_settings(spark, f"{path}/settings")


def ensemble(trees: DataFrame, df: DataFrame, features: Sequence[str], name: str = "prob") -> DataFrame:
    """df with the models' mean probability; df may be a stream."""
    return df.withColumn(name, probability(trees, features))


def predict(path: str, df: DataFrame, key: str = "id") -> DataFrame:
    """key, prob and label (ai above the threshold, else human) by a saved model."""
    trees, own = load(path)
    return ensemble(trees, df, own["features"]).select(key, "prob", F.when(F.col("prob") > own["threshold"], "ai").otherwise("human").alias("label"))


def mean_probability(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum("prob") / F.greatest(F.count("prob"), F.lit(1))).alias("prob"))

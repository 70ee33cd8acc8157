"""Parquet table catalogue for a data folder (one ``<name>.parquet`` each)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


class Tables:
    """Lazy access to the tables of one folder; each read is a pruned parquet scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.spark.read.parquet(self.path(name))
        raise AttributeError(name)

    def register_views(self) -> None:
        for name in TABLE_NAMES:
            if os.path.exists(self.path(name)):
                getattr(self, name).createOrReplaceTempView(name)

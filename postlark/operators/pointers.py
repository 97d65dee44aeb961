"""A catalog whose records stay where they were written: merges move keys, hashes and dates only.

``keys`` is a versioned table of the catalog's columns, in which ``latest_record_json`` names the run that wrote the
record's text. A merge joins this table with the keys of what comes in, whose texts are all in one new run;
texts of new and updated postings are written once, and none of those that are there is read. When the runs are
many they are written together as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.shared import kept
from . import catalog
from .sync import CATALOG

#: Runs that may hold a catalog's texts before they are written together.
RUNS = 16


def _write(spark: SparkSession, folder: str, texts: DataFrame, run: str) -> None:
    texts.select("stable_key", "record_json").write.parquet(f"{folder}/records/{run}")


def merge(spark: SparkSession, folder: str, records: DataFrame, at: str, complete: bool, policy: str = "updated_hash", prune_days: int = 90) -> DataFrame:
    """Merge records (as catalog.merge takes them) into the catalog under ``folder``; returns the keys with what changed.

    The texts are written before the keys that name them, so a run that breaks off leaves the catalog as it was.
    """
    folder, run = folder.rstrip("/"), uuid.uuid4().hex
    known = files.read_catalog(spark, f"{folder}/keys", CATALOG)
    merged = kept(catalog.merge(known, records.withColumn("record_json", F.lit(run)), at, complete, policy, prune_days), "merged")
    _write(spark, folder, records.join(merged.where(F.col("latest_record_json") == run).select("stable_key"), "stable_key", "left_semi"), run)
    files.write_catalog(merged.drop("change"), f"{folder}/keys")
    if len(_runs(merged)) > RUNS:
        compact(spark, folder)
    return merged


def _runs(keys: DataFrame) -> list[str]:
    return sorted(r[0] for r in keys.select("latest_record_json").where("latest_record_json is not null").distinct().collect())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog with its texts; empty before the first merge."""
    folder = folder.rstrip("/")
    keys = files.read_catalog(spark, f"{folder}/keys", CATALOG)
    if not (runs := _runs(keys)):
        return keys
    texts = spark.read.parquet(*[f"{folder}/records/{r}" for r in runs]).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    named = keys.withColumnRenamed("latest_record_json", "run")
    return named.join(texts, ["stable_key", "run"], "left").select(*[c for c in keys.columns if c != "latest_record_json"], F.col("record_json").alias("latest_record_json"))


def compact(spark: SparkSession, folder: str) -> None:
    """Write the texts that keys name as one run, and delete runs that neither the keys nor the version before them name."""
    folder, run = folder.rstrip("/"), uuid.uuid4().hex
    whole = kept(read(spark, folder), "whole")
    before = set(_runs(files.read_catalog(spark, f"{folder}/keys", CATALOG)))
    _write(spark, folder, whole.where("latest_record_json is not null").withColumnRenamed("latest_record_json", "record_json"), run)
    files.write_catalog(whole.withColumn("latest_record_json", F.when(F.col("latest_record_json").isNotNull(), run)), f"{folder}/keys")
    store, make = files._store(spark, folder)
    for f in store.listStatus(make(f"{folder}/records")):
        if f.getPath().getName() not in before | {run}:
            store.delete(f.getPath(), True)

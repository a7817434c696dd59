"""Datasets and runs as folders: uploads, three legs and a truth by name, views, checkpoints; on any file system Spark knows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.export import load_any, write_parquet

LEGS = ("orders", "payments", "settlements")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def changed(spark: SparkSession, path: str) -> int:
    """When the file or folder at path was last changed, in milliseconds."""
    fs, at = _fs(spark, path)
    return fs.getFileStatus(at).getModificationTime()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in path, the latest changed first; none if path is missing."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at) if s.isDirectory()]
    return [n for _, n in sorted(found, reverse=True)]


def register_view(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The Parquet table at path under a name that SQL can use."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def keep_upload(spark: SparkSession, path: str, folder: str, kind: str) -> str:
    """A copy of the raw file, byte for byte, made before anything reads it; its path."""
    source, at = _fs(spark, path)
    target, to = _fs(spark, f"{folder}/uploads/{kind}_{at.getName()}")
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source, at, target, to, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{path} was not copied")
    return to.toString()


def upload(spark: SparkSession, files: dict[str, str], folder: str) -> dict[str, DataFrame]:
    """Keeps the raw files of the legs named in files and rewrites each as Parquet in folder; the tables written."""
    if unknown := set(files) - set(LEGS):
        raise ValueError(f"unknown legs {sorted(unknown)}")
    for leg, path in files.items():
        write_parquet(load_any(spark, keep_upload(spark, path, folder, leg)), f"{folder}/{leg}.parquet")
    return {leg: spark.read.parquet(f"{folder}/{leg}.parquet") for leg in files}


def write_dataset(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table (three legs, and the truth if there is one) as Parquet under folder."""
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{name}.parquet")


def load_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three legs under folder, and the truth where it was written."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    out = {leg: spark.read.parquet(f"{folder}/{leg}.parquet") for leg in LEGS}
    if exists(spark, f"{folder}/ground_truth.parquet"):
        out["ground_truth"] = spark.read.parquet(f"{folder}/ground_truth.parquet")
    return out


def save_checkpoint(spark: SparkSession, folder: str, state: dict) -> None:
    """Adds a state to the folder's checkpoint; the latest counts, and a torn write never replaces an older one."""
    last = _states(spark, folder)
    row = [(len(last), json.dumps(state, sort_keys=True, default=str))]
    spark.createDataFrame(row, "n int, state string").coalesce(1).write.mode("append").parquet(f"{folder}/checkpoint")


def _states(spark: SparkSession, folder: str) -> list:
    if not exists(spark, f"{folder}/checkpoint"):
        return []
    return spark.read.schema("n int, state string").parquet(f"{folder}/checkpoint").orderBy("n").collect()  # a row a stage


def load_checkpoint(spark: SparkSession, folder: str) -> dict:
    """The latest state, empty if there is none."""
    states = _states(spark, folder)
    return json.loads(states[-1]["state"]) if states else {}

"""Reading and writing of tables: by suffix in, Parquet with zstd and flat CSV out, manifests as JSON."""

from __future__ import annotations

import json
from functools import partial
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import at_once


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """.parquet, .json (one array document), .ndjson or .jsonl, and anything else as CSV with a header and text columns."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".json":
        return spark.read.option("multiLine", True).json(path)
    if kind in (".ndjson", ".jsonl"):
        return spark.read.json(path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_run(run, path: str) -> None:
    """cases, exceptions and both link tables of a run under path."""
    spark = run.cases.sparkSession
    links = run.op_links.withColumn("leg", F.lit("order_payment")).unionByName(run.ps_links.withColumn("leg", F.lit("payment_settlement")))
    tables = {"recon": run.cases, "exceptions": run.cases.where("exception_type <> 'MATCHED'"), "links": links}
    at_once(spark, *(partial(write_parquet, df, f"{path}/{name}") for name, df in tables.items()))
    stats = [r.asDict() for r in run.stats.collect()]  # a row a pass
    write_manifest(spark, f"{path}/manifest", {"cascade": stats})


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """The exceptions under path, from the cases where they were not written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/exceptions")
    except AnalysisException:
        return spark.read.parquet(f"{path}/recon").where("exception_type <> 'MATCHED'")


def flattened(df: DataFrame) -> DataFrame:
    """df with arrays joined by ' | ' and structs and maps as JSON."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append(F.array_join(F.transform(c, lambda x: x.cast("string")), " | ").alias(f.name) if kind == "array" else F.to_json(c).alias(f.name) if kind in ("struct", "map") else c)
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """content as one JSON document in the folder path, on whatever file system it names."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])

"""Several outputs of one plan, written by one job and made visible together.

The rows of all outputs are stacked, with the output's name in a column, and written once as Parquet that is
partitioned by that column. A row appended to the manifest table then names the new data folder. Readers
follow the newest row of the manifest, so they see all outputs of one run or all of the run before, and
never those of a run that did not come to its end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version BIGINT, data STRING, output STRING, fields STRING"


def _newest(spark: SparkSession, folder: str) -> T.Row | None:
    try:
        manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # Two runs that end at once share a version; every reader then takes the same one of them.
    return manifest.agg(F.max(F.struct("version", "data", "output", "fields")).alias("newest")).first()["newest"]


def write_outputs(rows: DataFrame, folder: str, output: str = "output") -> str:
    """Write all outputs in one job and make them the current ones; returns the new data folder.

    Data of earlier runs stay where they are, for readers that are still at them.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    newest = _newest(spark, folder)
    data = f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy(output).parquet(f"{folder}/{data}")
    entry = (newest["version"] + 1 if newest else 1, data, output, json.dumps(rows.schema.jsonValue()))
    spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return f"{folder}/{data}"


def read_output(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """The ``columns`` of one of the current outputs; only its own files are read. One without rows is empty."""
    folder = folder.rstrip("/")
    newest = _newest(spark, folder)
    if newest is None:
        raise ValueError(f"{folder} has no outputs; its manifest names none")
    fields = T.StructType.fromJson(json.loads(newest["fields"]))
    rows = spark.read.schema(fields).parquet(f"{folder}/{newest['data']}")
    return rows.filter(F.col(newest["output"]) == name).select(*columns)

"""CSV and JSON tables in, CSV and JSON tables out.

Sinks write one folder of part files per table and replace it as a whole; nothing is squeezed into
one task to get a single file.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Text comes back as it was written: outer spaces stay, quotes are doubled, backslashes mean nothing.
# An empty field is NULL and a quoted empty one is "". The reader marks the former with a
# character that no text table holds, so that it can tell the two apart.
CSV_QUOTES = {"quote": '"', "escape": '"'}
CSV_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
EMPTY_FIELD = "\x00"
CSV_TEXT = {"nullValue": EMPTY_FIELD, "emptyValue": "", **CSV_QUOTES, **CSV_SPACES}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False
) -> DataFrame:
    """``multi_line`` reads fields with line breaks; a file is then read by one task."""
    # A row that does not fit its declared types must not turn into NULLs unseen, and columns in
    # another order than declared must not be taken for each other.
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": False, "multiLine": multi_line}
    return spark.read.schema(schema).options(**options, **CSV_TEXT).csv(path)


def key_drift(declared: T.DataType, found: T.DataType, at: str = "") -> list[str]:
    """Keys of stored documents that the declared type does not know, and declared ones that no document has."""
    while isinstance(declared, T.ArrayType) and isinstance(found, T.ArrayType):
        declared, found, at = declared.elementType, found.elementType, f"{at}[]"
    if not isinstance(declared, T.StructType) or not isinstance(found, T.StructType):
        return []
    drift = [f"unknown {at}.{name}" for name in found.names if name not in declared.names]
    drift += [f"missing {at}.{name}" for name in declared.names if name not in found.names]
    for field in declared:
        if field.name in found.names:
            drift += key_drift(field.dataType, found[field.name].dataType, f"{at}.{field.name}")
    return drift


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, check_keys: bool = True) -> DataFrame:
    """Stored documents. Without ``check_keys`` a misspelt key is NULL; with it one more scan compares all keys.

    A key that no document has is missing; where some have it, it is NULL in the others. Files without rows pass.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if check_keys:
        found = spark.read.option("mode", "FAILFAST").json(path).schema
        drift = key_drift(rows.schema, found) if found.names else []
        if drift:
            raise ValueError(f"{path} does not have the declared keys: {', '.join(drift)}")
    return rows


def write_csv(table: DataFrame, path: str, multi_line: bool = False) -> None:
    """A text with a line break is refused unless ``multi_line`` says that it is read that way."""
    if not multi_line:
        broken = F.raise_error(F.lit("a text holds a line break; write and read it with multi_line"))
        table = table.withColumns(
            {
                field.name: F.when(F.col(f"`{field.name}`").rlike("[\\r\\n]"), broken).otherwise(F.col(f"`{field.name}`"))
                for field in table.schema
                if isinstance(field.dataType, T.StringType)
            }
        )
    table.write.mode("overwrite").options(header=True, emptyValue='""', **CSV_QUOTES, **CSV_SPACES).csv(path)


def write_json(table: DataFrame, path: str) -> None:
    # NULL fields are written out, so that every document carries its full shape.
    table.write.mode("overwrite").option("ignoreNullFields", False).json(path)


@dataclass(frozen=True)
class Source:
    """A named table on disk."""

    name: str
    path: str
    schema: T.StructType | str | None = None
    format: str = "csv"


def load_sources(spark: SparkSession, sources: list[Source]) -> dict[str, DataFrame]:
    """Open every configured source by name."""
    opened = {}
    for source in sources:
        if source.format == "csv":
            opened[source.name] = read_csv(spark, source.path, source.schema)
        elif source.format == "json":
            opened[source.name] = read_json(spark, source.path, source.schema)
        elif source.format == "parquet":
            opened[source.name] = spark.read.parquet(source.path)
        else:
            raise ValueError(f"unknown format {source.format!r} for source {source.name!r}")
    return opened


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables visible to ``spark.sql`` under their names."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)

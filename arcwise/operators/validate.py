"""Table validation: one result row per rule, computed with aggregates only.

All rules are compiled to one aggregate. Every table is read once; a row gives one entry for its table,
one for each rule it breaks by itself, and one with its key for each rule on keys. Entries of equal rule,
key and value are summed before the shuffle, so that a key in a third of all rows travels as one row per
task, and references are decided by counting the entries of child and parent under one key, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise import schemas
from arcwise.sources.files import CSV_TEXT

CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Rule:
    table: str

    @property
    def name(self) -> str:
        raise NotImplementedError


class RowRule(Rule):
    """A rule each row meets or breaks by itself."""

    def broken(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class NotNull(RowRule):
    column: str

    @property
    def name(self) -> str:
        return f"not_null({self.column})"

    def broken(self) -> Column:
        return F.col(self.column).isNull()


@dataclass(frozen=True)
class OneOf(RowRule):
    column: str
    values: tuple

    @property
    def name(self) -> str:
        return f"one_of({self.column})"

    def broken(self) -> Column:
        return ~F.col(self.column).isin(*self.values)


@dataclass(frozen=True)
class Between(RowRule):
    column: str
    low: float
    high: float

    @property
    def name(self) -> str:
        return f"between({self.column})"

    def broken(self) -> Column:
        return ~F.col(self.column).between(self.low, self.high)


@dataclass(frozen=True)
class Unique(Rule):
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"unique({','.join(self.columns)})"


@dataclass(frozen=True)
class References(Rule):
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"references({','.join(self.columns)}->{self.parent})"


@dataclass(frozen=True)
class Contiguous(Rule):
    """``column`` counts 0, 1, 2, ... without gaps or repeats within each group."""

    keys: tuple[str, ...]
    column: str

    @property
    def name(self) -> str:
        return f"contiguous({self.column})"


@dataclass(frozen=True)
class HasSchema(Rule):
    declared: T.StructType

    @property
    def name(self) -> str:
        return "schema"


ENTRY = "struct<rule: int, key: array<string>, value: double, child: bigint, parent: bigint>"


def _key(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """Key columns as texts, so that keys of all rules share one shuffle; 0.0 and -0.0 are the same key."""
    kinds = dict(rows.dtypes)
    cells = [F.col(name) + F.lit(0.0) if kinds.get(name) in ("double", "float") else F.col(name) for name in columns]
    return F.array(*[cell.cast("string") for cell in cells]).cast("array<string>")


def _entry(rule: int, key: Column | None = None, value: Column | None = None, parent: bool = False) -> Column:
    return F.struct(
        F.lit(rule), key if key is not None else F.lit(None), value if value is not None else F.lit(None), F.lit(int(not parent)), F.lit(int(parent))
    ).cast(ENTRY)


def _entries(name: str, rows: DataFrame, number: int, rules: list[Rule]) -> DataFrame:
    """What the rows of one table contribute to all rules; ``-1 - number`` counts the rows themselves."""
    cells = []
    if any(rule.table == name for rule in rules):
        cells.append(_entry(-1 - number))
    for at, rule in enumerate(rules):
        if rule.table == name:
            if isinstance(rule, RowRule):
                cells.append(F.when(rule.broken(), _entry(at)))
            elif isinstance(rule, Unique):
                cells.append(_entry(at, _key(rows, rule.columns)))
            elif isinstance(rule, Contiguous):
                cells.append(_entry(at, _key(rows, rule.keys), F.col(rule.column).cast("double")))
            elif isinstance(rule, References):
                whole = reduce(lambda a, b: a & b, [F.col(column).isNotNull() for column in rule.columns])
                cells.append(F.when(whole, _entry(at, _key(rows, rule.columns))))
        if isinstance(rule, References) and rule.parent == name:
            cells.append(_entry(at, _key(rows, rule.parent_columns), parent=True))
    return rows.select(F.inline(F.array_compact(F.array(*cells))))


def _measured(entries: DataFrame) -> DataFrame:
    """Per rule: rows, repeats of a key, rows without a parent, and groups that do not count on from 0."""
    values = entries.groupBy("rule", "key", "value").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    keys = values.groupBy("rule", "key").agg(
        F.sum("child").alias("child"),
        F.sum("parent").alias("parent"),
        F.count("value").alias("places"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    fits = (F.col("low") == 0) & (F.col("high") == F.col("places") - 1) & (F.col("child") == F.col("places"))
    return keys.groupBy("rule").agg(
        F.sum("child").alias("total"),
        F.sum(F.greatest(F.col("child") - 1, F.lit(0))).alias("repeats"),
        F.sum(F.when(F.col("parent") == 0, F.col("child")).otherwise(0)).alias("orphans"),
        F.count_if(~F.coalesce(fits, F.lit(False))).alias("gaps"),
    )


RESULT = "array<struct<table_name: string, rule: string, n_rows: bigint, n_violations: bigint, passed: boolean>>"


def _result(table: str, rule: str, n_rows: Column, n_violations: Column) -> Column:
    broken = F.coalesce(n_violations, F.lit(0)).cast("bigint")
    return F.struct(F.lit(table), F.lit(rule), F.coalesce(n_rows, F.lit(0)).cast("bigint"), broken, broken == 0)


def validate(tables: Mapping[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(table_name, rule, n_rows, n_violations, passed), one row per rule.

    ``n_violations`` counts rows, except for contiguity, which counts groups, and the schema, which
    counts fields (as does its ``n_rows``). Keys with a NULL are no reference, and NULLs are equal in unique keys.
    """
    spark = next(iter(tables.values())).sparkSession
    parents = [rule.parent for rule in rules if isinstance(rule, References)]
    names = list(dict.fromkeys([*(rule.table for rule in rules if not isinstance(rule, HasSchema)), *parents]))
    counted = spark.range(1).select(F.lit(None).cast("map<int, struct<total: bigint, repeats: bigint, orphans: bigint, gaps: bigint>>").alias("found"))
    if names:
        entries = reduce(DataFrame.unionByName, [_entries(name, tables[name], at, rules) for at, name in enumerate(names)])
        # One entry per rule and table.
        found = F.map_from_entries(F.collect_list(F.struct("rule", F.struct("total", "repeats", "orphans", "gaps"))))
        counted = _measured(entries).agg(found.alias("found"))
    results = []
    for at, rule in enumerate(rules):
        if isinstance(rule, HasSchema):
            kinds = {field.name: field.dataType for field in tables[rule.table].schema}
            wrong = sum(kinds.get(field.name) != field.dataType for field in rule.declared)
            results.append(_result(rule.table, rule.name, F.lit(len(rule.declared)), F.lit(wrong)))
            continue
        measure = "repeats" if isinstance(rule, Unique) else "orphans" if isinstance(rule, References) else "gaps" if isinstance(rule, Contiguous) else "total"
        rows = F.try_element_at("found", F.lit(-1 - names.index(rule.table)))["total"]
        results.append(_result(rule.table, rule.name, rows, F.try_element_at("found", F.lit(at))[measure]))
    return counted.select(F.inline(F.array(*results).cast(RESULT)))


# -- stored cells -------------------------------------------------------------------------------


def stored_cells(spark: SparkSession, path: str, table: str, declared: T.StructType, multi_line: bool = False) -> DataFrame:
    """What a stored CSV table says against its declared schema, in one permissive scan that never aborts.

    Rules: ``header`` (files; one must begin with the declared names in order), ``whole_rows`` (rows of too few or too
    many fields, or broken quotes), ``cells(<column>)`` (cells of whole rows that do not read as the column's type).
    A header out of order is one broken file, and its line a row like all others.
    """
    names = declared.names
    texts = T.StructType([T.StructField(name, T.StringType()) for name in names]).add(CORRUPT, T.StringType())
    options = {"header": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": multi_line}
    rows = spark.read.schema(texts).options(**options, **CSV_TEXT).csv(path).withColumn("file", F.col("_metadata.file_path"))
    header = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"`{name}`") == name, F.lit(False)) for name in names]) & F.col(CORRUPT).isNull()
    row, whole = ~F.col("is_header"), F.col(CORRUPT).isNull()
    counts = {"headers": F.count_if("is_header"), "n": F.count_if(row), "torn": F.count_if(row & ~whole)}
    for at, field in enumerate(declared):
        cell = F.col(f"`{field.name}`")
        counts[f"cells_{at}"] = F.count_if(row & whole & cell.isNotNull() & cell.try_cast(field.dataType).isNull())
    files = rows.withColumn("is_header", header).groupBy("file").agg(*[value.alias(name) for name, value in counts.items()])
    sums = [F.sum(name).alias(name) for name in counts if name != "headers"]
    total = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("headers") != 1).alias("headless"), *sums)
    results = [
        _result(table, "header", F.col("files"), F.col("headless")),
        _result(table, "whole_rows", F.col("n"), F.col("torn")),
        *[_result(table, f"cells({field.name})", F.col("n"), F.col(f"cells_{at}")) for at, field in enumerate(declared)],
    ]
    return total.select(F.inline(F.array(*results).cast(RESULT)))


def lenient_csv(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    """A stored CSV table with NULL for every cell that does not read as declared, whatever its files' headers say."""
    return spark.read.schema(declared).options(header=True, mode="PERMISSIVE", enforceSchema=True, **CSV_TEXT).csv(path)


# -- rules of the generated tables --------------------------------------------------------------


def standard_rules(among: Iterable[str] | None = None) -> list[Rule]:
    """What the generated tables must satisfy; ``among`` keeps the rules that name only those tables."""
    path_key = ("animation_id", "effector_index", "frame_id")
    declared = {
        "motions": schemas.MOTIONS,
        "motion_joints": schemas.MOTION_JOINTS,
        "animations": schemas.ANIMATIONS,
        "animation_frames": schemas.ANIMATION_FRAMES,
        "animation_effectors": schemas.ANIMATION_EFFECTORS,
        "path_curvatures": schemas.PATH_CURVATURES,
        "path_curvature_peaks": schemas.PATH_CURVATURE_PEAKS,
        "path_tangents": schemas.PATH_TANGENTS,
        "path_bisectors": schemas.PATH_BISECTORS,
        "spline_knots": schemas.SPLINE_KNOTS,
    }
    keys = {
        "motions": ("motion_id",),
        "motion_joints": ("motion_id", "joint_index"),
        "animations": ("animation_id",),
        "animation_frames": ("animation_id", "frame_id"),
        "animation_effectors": ("animation_id", "frame_id", "effector_index"),
    }
    rules: list[Rule] = []
    for name, schema in declared.items():
        key = keys.get(name, path_key)
        rules += [HasSchema(name, schema), Unique(name, key), *[NotNull(name, column) for column in key]]
    frame_key = ("animation_id", "frame_id")
    rules += [
        References("motion_joints", ("motion_id",), "motions", ("motion_id",)),
        References("animations", ("motion_id",), "motions", ("motion_id",)),
        References("animation_frames", ("animation_id",), "animations", ("animation_id",)),
        References("animation_effectors", frame_key, "animation_frames", frame_key),
        References("path_curvature_peaks", path_key, "path_curvatures", path_key),
        References("spline_knots", path_key, "path_curvatures", path_key),
        Contiguous("motion_joints", ("motion_id",), "joint_index"),
        Contiguous("animation_frames", ("animation_id", "lod_index"), "frame_index"),
        Contiguous("spline_knots", ("animation_id", "effector_index"), "knot_index"),
        Between("animation_frames", "time", 0.0, 1.0),
        Between("path_tangents", "tangent", -math.pi, math.pi),
        Between("path_bisectors", "bisector_x", -1.0 - 1e-9, 1.0 + 1e-9),
        Between("path_bisectors", "bisector_y", -1.0 - 1e-9, 1.0 + 1e-9),
        OneOf("path_curvature_peaks", "peak_type", ("positive", "negative", "crossover")),
    ]
    if among is None:
        return rules
    kept = set(among)
    return [rule for rule in rules if rule.table in kept and getattr(rule, "parent", rule.table) in kept]

"""Reading and writing tables: CSV with embedded newlines, Parquet, split and run folders."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, MapType, StructType

from gradeframe.schemas import one_of, require_columns
from gradeframe.sources.ranges import csv_records
from gradeframe.sources.snapshots import read_snapshot, replace_folder

# A blank cell is null and a quoted blank is an empty text: null gets a marker that no cell holds. Lines end
# in a line feed only, and a cell is quoted wherever it could be read in another way.
_NULL = "\ue000null\ue000"
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "lineSep": "\n", "nullValue": _NULL, "emptyValue": ""}
FORMATS = ("csv", "parquet")


def _nested(kind) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType))


def _from_cell(name: str, kind: DataType) -> Column:
    if _nested(kind):
        return F.from_json(name, kind)
    if isinstance(kind, IntegralType):  # a column with blanks may have been written as 1.0 or 1e+16
        return F.coalesce(F.col(name).try_cast(kind), F.col(name).cast("decimal(38,10)").cast(kind))
    return F.col(name).cast(kind)


def read_csv(spark: SparkSession, path: str, schema: StructType, by_ranges: bool = False) -> DataFrame:
    """CSV with a header; columns are found by name, further ones stay as text.

    Nested columns are read from JSON cells, integers exactly. Quoted cells may span lines, so one file is one
    task; ``by_ranges`` spreads each file over tasks instead, for files that quote as CSV writers do and
    share one header (see ``ranges.csv_records``).
    """
    raw = require_columns(spark.read.options(**CSV_OPTIONS).csv(path), schema.names)
    if by_ranges:
        names = {f"c{i}": name for i, name in enumerate(raw.columns)}
        options = {k: str(v) for k, v in CSV_OPTIONS.items() if k not in ("header", "multiLine")}
        cells = F.from_csv("record", ", ".join(f"{c} string" for c in names), options)
        parsed = csv_records(spark, path).select(cells.alias("cells"))
        raw = parsed.select(*(F.col("cells")[c].alias(name) for c, name in names.items()))
    return raw.select(
        *(_from_cell(f.name, f.dataType).alias(f.name) for f in schema),
        *(c for c in raw.columns if c not in schema.names),
    )


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    fmt: str | None = None,
    by_ranges: bool = False,
) -> DataFrame:
    """A CSV (with schema) or Parquet table; the format defaults to the path's suffix.

    ``by_ranges`` spreads large CSV files over tasks.
    """
    fmt = one_of(fmt or ("csv" if path.endswith(".csv") else "parquet"), FORMATS, "format")
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return read_csv(spark, path, schema, by_ranges)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_training(spark: SparkSession, ref: str, schema: StructType | None = None) -> DataFrame:
    """Training set by reference: a ``.csv`` or Parquet path, else a catalog table."""
    if ref.endswith(".csv") or "/" in ref or ref.endswith(".parquet"):
        return read_table(spark, ref, schema)
    return spark.table(ref)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a table; CSV cells of nested columns become JSON."""
    writer = df
    if one_of(fmt, FORMATS, "format") == "csv":
        writer = df.select(
            *(
                F.to_json(f.name).alias(f.name) if _nested(f.dataType) else F.col(f.name)
                for f in df.schema
            )
        )
    out = writer.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "csv":
        keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""'}
        out.options(header=True, escape='"', lineSep="\n", **keep).csv(path)
    else:
        out.parquet(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per value of ``split``."""
    write_table(df, path, fmt, mode, ["split"])


def read_runs(
    spark: SparkSession, template: str, models: Sequence[str], schema: StructType | None = None
) -> DataFrame:
    """The tables of several models as one, with a ``model`` column.

    ``template`` holds ``{model}``, for instance ``/runs/{model}/graded``. For data already kept
    in ``model=...`` folders read the parent folder instead. A column that a model's table lacks is null there.
    """
    if "{model}" not in template:
        raise ValueError("template has no {model}")
    tables = [
        read_table(spark, template.replace("{model}", m), schema).withColumn("model", F.lit(m))
        for m in models
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_questions(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str],
    source: str | None = None,
    fmt: str = "parquet",
    schema: StructType | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A benchmark table with its columns renamed, ``mapping`` being new name to old name.

    ``source`` adds a constant source tag, ``keep`` passes further columns through.
    """
    raw = spark.read.format(fmt)
    if fmt == "csv":
        raw = raw.options(**CSV_OPTIONS)
    if schema:
        raw = raw.schema(schema)
    table = raw.load(path).select(
        *(F.col(old).alias(new) for new, old in mapping.items()), *keep
    )
    return table.withColumn("source", F.lit(source)) if source else table


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Results written so far, or null when there are none: the folders that the newest manifest names."""
    return read_snapshot(spark, path)


def append_results(df: DataFrame, path: str, run: int, origin: str = "batch", part: int = 0) -> None:
    """Results of one part of a run in a folder of their own; repeating the part replaces that folder.

    ``origin`` names who writes, so that a batch run and a stream never share a folder. Readers see the folder once
    it is complete.
    """
    replace_folder(df, path, f"run={run}/origin={origin}/part={part}")

"""Reading and writing tables by file ending, and a stable row key."""

from __future__ import annotations

import importlib.util
from abc import ABC, abstractmethod
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.config import SchemaConfig
from tablewright.functions.parse import CSV_MISSING_TOKENS, name, null_if_token
from tablewright.operators.roles import Roles, classify


class SourceError(Exception):
    """A table can't be read or written."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Source(ABC):
    """One format at one path. as_text: every column as text, for tables whose types are yet to be decided."""

    path: str

    @abstractmethod
    def _load(self, spark: SparkSession, as_text: bool) -> DataFrame: ...

    def read(self, spark: SparkSession, *, as_text: bool = False) -> DataFrame:
        if not _exists(spark, self.path):
            raise SourceError(f"{self.path}: no such file")
        try:
            return self._load(spark, as_text)
        except (PySparkException, OSError, ValueError, UnicodeError) as e:
            raise SourceError(f"{self.path}: {e}") from e


@dataclass(frozen=True)
class CsvSource(Source):
    """Text with a header. Quoted line breaks and doubled quotes are read; spellings of missing values become null.

    Files are split over tasks unless values have line breaks. multi_line: whether they do; None: a pass over the lines finds
    out, since then some line has an odd number of double quotes.
    """

    separator: str = ","
    encoding: str = "utf-8"
    multi_line: bool | None = None

    def _breaks(self, spark: SparkSession) -> bool:
        if self.multi_line is not None:
            return self.multi_line
        if self.encoding.lower().startswith(("utf-16", "utf-32", "utf16", "utf32")):
            return True
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
        return not spark.read.text(self.path).where(quotes % 2 == 1).limit(1).isEmpty()

    def _load(self, spark: SparkSession, as_text: bool) -> DataFrame:
        df = spark.read.csv(self.path, header=True, sep=self.separator, encoding=self.encoding, inferSchema=not as_text, multiLine=self._breaks(spark), escape='"', enforceSchema=False)
        return df.select(*(null_if_token(name(c), CSV_MISSING_TOKENS).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else name(c) for c in df.columns))


@dataclass(frozen=True)
class ExcelSource(Source):
    """A sheet of a workbook, read on the driver: workbooks are bounded by their format. Needs an Excel engine for pandas."""

    sheet_name: int | str = 0

    def _load(self, spark: SparkSession, as_text: bool) -> DataFrame:
        if not any(importlib.util.find_spec(m) for m in ("openpyxl", "calamine", "xlrd")):
            raise SourceError(f"{self.path}: no Excel engine is installed (openpyxl, calamine or xlrd)")
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(self.path, sheet_name=self.sheet_name, dtype=str if as_text else None))


@dataclass(frozen=True)
class ColumnarSource(Source):
    """parquet, orc, json: formats that Spark reads by itself."""

    format: str = "parquet"

    def _load(self, spark: SparkSession, as_text: bool) -> DataFrame:
        df = spark.read.format(self.format).load(self.path)
        return df.select(*(name(c).cast("string").alias(c) for c in df.columns)) if as_text else df


_READERS = {
    "csv": CsvSource, "txt": CsvSource, "tsv": lambda path, **kw: CsvSource(path, **({"separator": "\t"} | kw)), "xlsx": ExcelSource, "xls": ExcelSource, "xlsm": ExcelSource,
    **{f: (lambda path, f=f, **kw: ColumnarSource(path, format=f, **kw)) for f in ("parquet", "orc", "json")},
}


def _suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower().lstrip(".")


def source_for(path: str, **options) -> Source:
    """The source for a path's ending, whatever its letter case."""
    kind = _suffix(str(path))
    if kind not in _READERS:
        raise SourceError(f"{path}: unknown ending; known are {', '.join(sorted(_READERS))}")
    return _READERS[kind](str(path), **options)


def write_frame(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Write by ending: csv and txt, parquet, orc, json. Spark makes a folder of parts; single_file makes that one part, for
    results that are small. Parent folders are made; what was at the path is replaced."""
    kind = _suffix(str(path))
    out = df.coalesce(1) if single_file else df
    if kind in ("csv", "txt"):
        out.write.mode("overwrite").csv(str(path), header=True, escape='"')
    elif kind in ("parquet", "orc", "json"):
        out.write.mode("overwrite").format(kind).save(str(path))
    elif kind in ("xlsx", "xlsm"):
        if not importlib.util.find_spec("openpyxl"):
            raise SourceError(f"{path}: no Excel engine is installed (openpyxl)")
        if df.limit(1_048_576).count() > 1_048_575:
            raise SourceError(f"{path}: a sheet holds 1,048,575 rows")
        df.toPandas().to_excel(path, index=False)
    else:
        raise SourceError(f"{path}: can't write .{kind}")
    return str(path)


def with_row_key(df: DataFrame, column: str = "_row_id") -> DataFrame:
    """Number the rows from 0 in the order of the files. A first pass counts the rows of each task of the scan, which gives
    where its numbers begin; the same file listing gives the same numbers. df must be a scan and what is selected from it."""
    if column in df.columns:
        raise SourceError(f"the table has a column {column!r} already")
    tagged = df.withColumn(column, F.monotonically_increasing_id())
    task = F.shiftright(column, 33).cast("int")
    upto = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)
    starts = tagged.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n")).select("_task", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    # one row per task of the scan
    numbered = tagged.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return numbered.select(*(name(c) for c in df.columns), (F.col("_start") + F.col(column).bitwiseAND(F.lit((1 << 33) - 1))).alias(column))


def load(spark: SparkSession, path: str, config: SchemaConfig = SchemaConfig(), as_text: bool = False, **options) -> tuple[DataFrame, Roles]:
    """Read a table and decide its roles."""
    df = source_for(path, **options).read(spark, as_text=as_text)
    return df, classify(df, config)


def describe_columns(df: DataFrame, roles: Roles) -> DataFrame:
    rows = [(i, c, "numeric" if c in roles.numeric else "categorical", c in roles.identifiers, c in roles.outcomes) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, role string, is_identifier boolean, is_outcome boolean").orderBy(F.col("position"))

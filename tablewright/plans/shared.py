"""Materialised intermediate tables and joins whose broadcast side is measured first."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcast limits: rows, and bytes of text and arrays, of the measured side.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 8 << 20
#: Copies of the small side in a salted shuffle join.
SALTS = 16

_OWN_ROOT: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if "root" not in _OWN_ROOT:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_ROOT["root"] = tempfile.mkdtemp(prefix="tablewright-")
    return "file://" + _OWN_ROOT["root"]


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, wherever the driver imported it from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parents[1]
    if not home.is_dir():  # imported from an archive that was shipped already
        return
    target = Path(tempfile.mkdtemp(prefix="tablewright-")) / "tablewright_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    # the driver serves the archive to every executor, those that join later too
    spark.sparkContext.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    _SHIPPED.add(app)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. The JVM removes it when it ends, after spark.stop() as well."""
    folder = f"{shared_dir(spark)}/tablewright/{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors.

    The folder is removed when the driver ends. Columns keep their order and types.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A scan (and nothing else, since its tasks are asked for) with fewer tasks than the cluster has cores, which only small
    tables have, is spread out before costly work per row; `by`: rows that agree stay together."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def over_groups(rows: DataFrame, keys: tuple[str, ...], schema: str, use: Callable[[pa.Table], pa.RecordBatch | list[tuple]], made: pa.Schema | None = None) -> DataFrame:
    """Run `use` (Arrow table of one key -> record batch) over the groups of integer keys without nulls, which come whole and
    one after another. A group must be of bounded size. With `made`, `use` gives rows, which are put together to batches."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            code = [batch.column(k).to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([np.diff(c, prepend=c[0]) != 0 for c in code], 0)) if len(batch) else []
            for s, e in zip([0, *cuts], [*cuts, len(batch)]):
                if e == s:
                    continue
                key = tuple(int(c[s]) for c in code)
                if key != now and held:
                    yield pa.Table.from_batches(held)
                    held = []
                now = key
                held.append(batch.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches):
            if made is None:
                yield use(group)
                continue
            out += use(group)
            if len(out) >= 512:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def width(df: DataFrame) -> Column:
    """Bytes of one row's variable-length columns."""
    parts = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)) * 16)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def fits_broadcast(df: DataFrame) -> bool:
    """Measure a materialised table: may every executor hold a copy of it?"""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width(df)), F.lit(0))).first()
    return rows <= MAX_BROADCAST_ROWS and size <= MAX_BROADCAST_BYTES


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, salt_by: list[str], fits: bool | None = None) -> DataFrame:
    """Join with a broadcast if `small` (materialised) measures below the limits, else with a salted shuffle.

    In the salted form each key of `big` is spread over SALTS tasks by a hash of `salt_by`, so that a key holding a
    third of the rows doesn't end in one task. how: inner, left, left_semi or left_anti.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    return left.join(salted, [*on, "_salt"], how).drop("_salt")


def numbered_in_order(df: DataFrame, order: str, out: str) -> DataFrame:
    """Number the rows from 0 in the order of a column, with a range-partitioned sort instead of one task: the sorted rows
    are written with their task and place, and every task's numbers begin behind those of the tasks before."""
    place = F.monotonically_increasing_id()
    rows = written(df.orderBy(order).withColumns({"_task": F.spark_partition_id(), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    upto = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select("_task", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    # one row per task of the sort
    return rows.join(F.broadcast(starts), "_task").select(*df.columns, (F.col("_start") + F.col("_place")).alias(out))

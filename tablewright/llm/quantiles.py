"""Mergeable quantile summaries by deterministic buffer collapsing, with the rank error carried along.

A summary of a group is at most one partial buffer of weight 1 (fewer than SIZE values) and, on every level l, fewer than
FAN_IN full buffers: SIZE sorted values of weight FAN_IN**l. When FAN_IN buffers of a level are together they collapse
into one buffer of the next: their values are sorted and every FAN_IN-th is kept, beginning in the middle of the first
FAN_IN. A collapse on level l moves the rank of any value by at most FAN_IN**l * (FAN_IN - 1) / 2; the summary adds these
up in `error`, so that its bound is the one of its own history. With N values there are about log(N / SIZE) levels to the
base FAN_IN and the bound is N * levels / (2 * SIZE) at most, whatever the order in which summaries are merged.

Rows are summarised where they lie; only summaries travel, in rounds of at most `arity` at a time for one group, so a
group of a third of all rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

SIZE, FAN_IN = 1024, 9
#: Summaries of a group that one task merges at most, but for the last round, which takes what is left.
ARITY = 32
FIELDS = ("n", "error", "low", "high", "levels", "buffers")
#: Groups a task holds before it lets their summaries go; rows of an Arrow batch.
GROUPS, ROWS = 50_000, 2_000
SUMMARY = "n long, error long, low double, high double, levels array<int>, buffers array<array<double>>"


class Summary:
    """n, error, the true extremes, and buffers by level; level -1 holds loose values of weight 1."""

    __slots__ = ("n", "error", "low", "high", "loose", "full", "size", "fan_in")

    def __init__(self, size: int = SIZE, fan_in: int = FAN_IN):
        if fan_in % 2 == 0 or fan_in < 3 or size < 1:
            raise ValueError("fan_in must be odd, at least 3; size at least 1")
        self.n, self.error, self.low, self.high = 0, 0, np.inf, -np.inf
        self.loose: list[np.ndarray] = []
        self.full: dict[int, list[np.ndarray]] = {}
        self.size, self.fan_in = size, fan_in

    def add(self, values: np.ndarray) -> Summary:
        values = values[~np.isnan(values)]
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self.loose.append(values)
            if sum(map(len, self.loose)) >= self.size:
                self._settle()
        return self

    def merge(self, other: Summary) -> Summary:
        self.n, self.error = self.n + other.n, self.error + other.error
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.loose += other.loose
        for level, buffers in other.full.items():
            self.full.setdefault(level, []).extend(buffers)
        return self._settle()

    def _settle(self) -> Summary:
        if self.loose:
            values = np.concatenate(self.loose)
            whole = len(values) // self.size * self.size
            self.full.setdefault(0, []).extend(np.sort(values[i : i + self.size]) for i in range(0, whole, self.size))
            self.loose = [values[whole:]] if whole < len(values) else []
        level = 0
        while level <= max(self.full, default=-1):
            buffers = self.full.get(level, [])
            while len(buffers) >= self.fan_in:
                together = np.sort(np.concatenate(buffers[: self.fan_in]))
                del buffers[: self.fan_in]
                self.full.setdefault(level + 1, []).append(together[self.fan_in // 2 :: self.fan_in])
                self.error += self.fan_in**level * (self.fan_in // 2)
            level += 1
        return self

    def row(self) -> tuple:
        self._settle()
        pairs = [(-1, np.sort(x)) for x in self.loose] + [(level, b) for level, bs in sorted(self.full.items()) for b in bs]
        return self.n, self.error, self.low, self.high, [p[0] for p in pairs], [p[1].tolist() for p in pairs]

    @classmethod
    def from_row(cls, n: int, error: int, low: float, high: float, levels: list, buffers: list, size: int = SIZE, fan_in: int = FAN_IN) -> Summary:
        s = cls(size, fan_in)
        s.n, s.error, s.low, s.high = int(n), int(error), low, high
        for level, b in zip(levels, buffers):
            b = np.asarray(b, np.float64)
            if level < 0:
                s.loose.append(b)
            else:
                s.full.setdefault(int(level), []).append(b)
        return s

    def quantiles(self, per_mille: list[int]) -> list[float | None]:
        """For each share p the smallest kept value whose estimated rank is at least ceil(p * n); its true rank differs by
        at most `error`. Exact while nothing has collapsed."""
        if not self.n:
            return [None] * len(per_mille)
        self._settle()
        parts = [(b, 1) for b in self.loose] + [(b, self.fan_in**level) for level, bs in self.full.items() for b in bs]
        values = np.concatenate([b for b, _ in parts])
        weights = np.concatenate([np.full(len(b), w, np.int64) for b, w in parts])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        wanted = [max(1, -(-p * self.n // 1000)) for p in per_mille]
        found = values[order[np.minimum(np.searchsorted(ranks, wanted), len(order) - 1)]]
        return [float(self.low) if p <= 0 else float(self.high) if p >= 1000 else float(v) for p, v in zip(per_mille, found)]


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)], schema=types)


def _arrow_types(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def _summarise(keys: list[str], columns: list[str], types: pa.Schema, size: int, fan_in: int):
    """Summaries of one partition's rows; those of very many groups leave early, as further summaries of their groups."""

    def flush(held: dict[tuple, Summary]) -> Iterator[pa.RecordBatch]:
        rows = [(*k, *s.row()) for k, s in held.items()]
        for i in range(0, len(rows), ROWS):
            yield _batch(rows[i : i + ROWS], types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Summary] = {}
        for batch in batches:
            coded = [batch.column(i).dictionary_encode(null_encoding="encode") for i in range(len(keys))]
            code = np.zeros(len(batch), np.int64)
            for c in coded:
                code = code * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            heads = [tuple(c.dictionary[c.indices[int(order[i])].as_py()].as_py() for c in coded) for i in cuts]
            for j, col in enumerate(columns):
                values = batch.column(len(keys) + j).to_numpy(zero_copy_only=False).astype(np.float64)[order]
                for key, part in zip(heads, np.split(values, cuts[1:])):
                    part = part[~np.isnan(part)]
                    if len(part):
                        held.setdefault((*key, col), Summary(size, fan_in)).add(part)
            if len(held) > GROUPS:
                yield from flush(held)
                held = {}
        yield from flush(held)

    return run


def summarise(df: DataFrame, keys: list[str], columns: list[str], size: int = SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """(keys..., column_name, n, error, low, high, levels, buffers): one summary per group and column, from which figures
    of several groups can be had by `merge_summaries`.

    Null and NaN values are left out; infinities count. A null key is a key of its own. A group without values has no
    row. Other columns, clashing names among them, are dropped first. Empty input gives no rows.
    """
    source = df.select(*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(columns)))
    schema = f"{_kinds(df, keys)}, column_name string, {SUMMARY}"
    parts = source.mapInArrow(_summarise(keys, columns, _arrow_types(schema), size, fan_in), schema)
    return merge_summaries(parts, keys, size, fan_in, spread=df.rdd.getNumPartitions())


def merge_summaries(summaries: DataFrame, keys: list[str], size: int = SIZE, fan_in: int = FAN_IN, spread: int = 1, arity: int = ARITY) -> DataFrame:
    """Merge all summaries that agree on `keys` and column_name; drop a key to merge over it (loads, days).

    spread: how many summaries one group may have (the partitions they come from). They meet `arity` at a time, round by
    round, so that no task takes more of a hot group.
    """
    head = [*keys, "column_name"]
    schema = f"{_kinds(summaries, keys)}, column_name string, _part int, {SUMMARY}"
    types = _arrow_types(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and part; one Summary is open at a time."""
        now, total, rows = None, None, []
        for batch in batches:
            columns = [batch.column(f).to_pylist() for f in (*head, "_part", *FIELDS)]
            for r in zip(*columns):
                key, s = r[: len(head) + 1], Summary.from_row(*r[len(head) + 1 :], size, fan_in)
                if key == now:
                    total.merge(s)
                    continue
                if total is not None:
                    rows.append((*now, *total.row()))
                now, total = key, s
                if len(rows) >= ROWS:
                    yield _batch(rows, types)
                    rows = []
        if total is not None:
            rows.append((*now, *total.row()))
        if rows:
            yield _batch(rows, types)

    columns = [F.col(f"`{k}`") for k in head]
    out = summaries.select(*columns, F.spark_partition_id().alias("_part"), *FIELDS)
    while True:
        last = spread <= arity
        out = out.withColumn("_part", F.lit(0) if last else F.floor(F.col("_part") / arity).cast("int"))
        out = out.repartition(*columns, "_part").sortWithinPartitions(*columns, "_part").mapInArrow(merge, schema)
        if last:
            return out.drop("_part")
        spread = -(-spread // arity)


def percentiles_column(per_mille: list[int], size: int = SIZE, fan_in: int = FAN_IN):
    """An Arrow UDF over a struct of a summary's fields: array<double> of the wanted percentiles."""

    def read(batch: pa.Array) -> pa.Array:
        out = [Summary.from_row(*(r[f] for f in FIELDS), size, fan_in).quantiles(per_mille) for r in batch.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    read.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "array<double>")


def percentiles(summaries: DataFrame, keys: list[str], per_mille: list[int], size: int = SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """(keys..., column_name, n, rank_error, p<per mille>...): a figure's true rank is within rank_error of the wanted one."""
    use = percentiles_column(per_mille, size, fan_in)
    got = summaries.withColumn("_p", use(F.struct(*FIELDS)))
    return got.select(*(F.col(f"`{k}`") for k in keys), "column_name", "n", F.col("error").alias("rank_error"), *(F.col("_p")[i].alias(f"p{p:03d}") for i, p in enumerate(per_mille)))

"""Filling containers of fixed capacity by hierarchical best fit.

Items are spread over partitions by a hash, so that each holds a like mixture of sizes whatever the order of the table.
Every partition packs its items best-fit decreasing and closes the bins that are nearly full; of the other bins the members
travel on as items to a smaller number of partitions, where they are packed anew, until one partition is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.shared import written

_SCHEMA = pa.schema([("u", pa.int64()), ("k", pa.string()), ("piece", pa.int32()), ("size", pa.int32()), ("container", pa.string()), ("fill", pa.int32())])
PLACED = "u long, k string, piece int, size int, container string, fill int"
#: A bin this full is closed where it is packed.
CLOSE_AT = 0.98
#: Items that a partition packs, about; partitions whose remaining items meet in one of the next round.
PART_ITEMS, FAN_IN = 50_000, 8
#: Items of underfull bins that a partition sends on at most, those of the emptiest bins; fuller bins close. A partition of
#: 50,000 items leaves few underfull bins behind, unless hardly any two items fit together, and then none would gain.
CARRY = 5_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of positions. Open bins are kept by free space; a bit set of the spaces in use
    gives the tightest one that fits."""
    free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        at = used >> s
        if at:
            space = s + (at & -at).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                used &= ~(1 << space)
        else:
            space, b = capacity, []
            bins.append(b)
        b.append(i)
        if space > s:
            free[space - s].append(b)
            used |= 1 << (space - s)
    return bins


def _pack(capacity: int, last: bool):
    """Items of one partition with their container, or without one where they travel on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.select(["u", "k", "piece", "size"]) for b in batches if len(b)]
        if not held:
            return
        items = pa.Table.from_batches(held)
        u, k, piece, size = (items.column(c).to_pylist() for c in ("u", "k", "piece", "size"))
        bins = sorted(((sum(size[i] for i in b), b) for b in best_fit(size, capacity)), key=lambda x: x[0])
        container, fill, carried = [None] * len(u), [0] * len(u), 0
        for total, b in bins:
            carried += len(b)
            if last or total >= capacity * CLOSE_AT or carried > CARRY:
                head = min(b, key=lambda i: (u[i], piece[i]))
                name = f"{k[head] or ''}-{piece[head]}#{u[head]}"
                for i in b:
                    container[i], fill[i] = name, total
        for column, kind in ((container, pa.string()), (fill, pa.int32())):
            items = items.append_column("container" if kind == pa.string() else "fill", pa.array(column, kind))
        yield from items.cast(_SCHEMA).to_batches(10_000)

    return run


def pack_items(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, size, item_size, container, fill): where each piece of each item lies.

    An item above the capacity is cut into full pieces (0, 1, ...) that fill a container each, and a rest that is packed
    like an item; no other item is cut. An item of size 0, or without a size, takes no room: piece 0, size 0, no container.
    Repeated rows are items of their own. A container is named after its first member: key, piece
    and a number that tells repeated rows apart. Which items share a container depends on how rows are numbered; every
    container holds at most its capacity. Empty input gives no rows.
    """
    kind = items.schema[key].dataType
    n = F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(key).cast("string").alias("k"), n.alias("n"), F.monotonically_increasing_id().alias("u"))
    # written, so that the row number in `u` stays what it is
    rows = written(rows, "sizes")
    whole = F.col("n").cast("int") - F.col("n") % capacity
    cut = rows.where(F.col("n") > capacity)
    full = cut.select("k", "n", "u", F.explode(F.sequence(F.lit(0), (whole / capacity).cast("int") - 1)).alias("piece")).withColumn("size", F.lit(capacity))
    rest = rows.where(F.col("n") % capacity > 0).select("u", "k", F.floor(F.col("n") / capacity).cast("int").alias("piece"), (F.col("n") % capacity).cast("int").alias("size"))
    exact = rows.where(F.col("n") == capacity).select("k", "n", "u", F.lit(0).alias("piece"), F.lit(capacity).alias("size"))
    label = F.concat(F.coalesce("k", F.lit("")), F.lit("-"), "piece", F.lit("#"), "u")
    alone = full.unionByName(exact).select("k", "n", "piece", "size", label.alias("container"), F.lit(capacity).alias("fill"))

    parts = max(1, -(-rest.count() // PART_ITEMS))
    closed = []
    while True:
        placed = written(rest.repartition(parts, "u").mapInArrow(_pack(capacity, parts == 1), PLACED), "placed")
        closed.append(placed.where("container IS NOT NULL"))
        if parts == 1:
            break
        rest, parts = placed.where("container IS NULL").drop("container", "fill"), -(-parts // FAN_IN)
    every = closed[0]
    for c in closed[1:]:
        every = every.unionByName(c)
    sized = every.select("k", "piece", "size", "container", "fill").withColumn("n", F.col("piece") * capacity + F.col("size"))
    none = rows.where("n = 0").select("k", "n", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("container"), F.lit(0).alias("fill"))
    return alone.unionByName(sized).unionByName(none).select(F.col("k").cast(kind).alias(key), "piece", F.col("size").cast("int").alias("size"), F.col("n").cast("int").alias("item_size"), "container", "fill")

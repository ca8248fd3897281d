"""Vectors of whole numbers: scaled, floored, packed into bytes that are equal where the vectors are; sums over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, tidy

#: Scaled components stay within this range, in which a double holds every whole number.
LIMIT = 1 << 53
#: Groups of more than this part of all rows are hot; there are fewer of them than this.
HOT_PARTS = 1000


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """id, dim, key of the vectors that have components (`length` of them, if given), none null or non-finite.

    key holds floor(scale * x), x as double, in 2, 4 or 8 bytes each: the fewest that the vector's largest needs, so equal
    vectors of one dim have equal keys. What is beyond LIMIT is taken as LIMIT. Null ids and repeated rows stay.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull()).where((F.size("v") > 0 if length is None else F.size("v") == length) & ~bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * v.flatten().to_numpy(zero_copy_only=False)), -LIMIT, LIMIT).astype(np.int64)
            end = np.cumsum(size)
            start = end - size
            most = np.maximum.reduceat(np.abs(x), start) if len(start) else size
            width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
            keys = [x[a:b].astype(f"<i{w}").tobytes() for a, b, w in zip(start, end, width, strict=True)]
            yield pa.record_batch([batch.column("id"), pa.array(size.astype(np.int32)), pa.array(keys, pa.binary())], names=["id", "dim", "key"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, dim int, key binary")


def matrix_of(keys: pa.Array, dim: int) -> np.ndarray:
    """The vectors of keys, a row each."""
    data, off = text_bytes(keys)
    width = np.diff(off) // dim
    out = np.empty((len(keys), dim), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = data[off[at][:, None] + np.arange(dim * w)].view(f"<i{w}")
    return out


def totals(rows: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sums over all batches of the `size` numbers that part() gives for one: exact whole numbers, or doubles.

    A task adds up its batches and gives a row for each number; Spark adds those of all tasks, and `size` rows come here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object if exact else float)
        for batch in batches:
            total = total + part(batch)
        values = pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0)) if exact else pa.array(total)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), values], names=["place", "value"])
        tidy()

    out = np.zeros(size, object if exact else float)
    for place, value in rows.mapInArrow(run, f"place int, value {'decimal(38,0)' if exact else 'double'}").groupBy("place").agg(F.sum("value")).collect():
        out[place] = int(value) if exact else value
    return out


def fits(bound: int, terms: int) -> bool:
    """Whether a sum of so many squares of numbers up to bound fits 64 bits."""
    return terms * bound * bound < 1 << 63


def decimals(x: np.ndarray) -> pa.Array:
    """Whole numbers as decimal(38,0); null beyond."""
    if x.dtype != object:
        return pa.array(x).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) if abs(v) < 10**38 else None for v in x], pa.decimal128(38, 0))


def meet(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of their group; `n` of a group counts its rows, total all of them.

    A key with more than a part of HOT_PARTS of all rows would fill one task: those groups, fewer than HOT_PARTS, are
    broadcast, and their rows stay where they are; all others meet by a shuffle.
    """
    hot = F.col("n") * HOT_PARTS > total
    known = groups.where(hot)
    cold = rows.join(F.broadcast(known.select(key)), key, "left_anti").join(groups.where(~hot), key)
    return rows.join(F.broadcast(known), key).unionByName(cold)

"""What the operators of this subpackage share: tables, the shared folder, hashing and word splitting."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
try:  # glibc only
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None
#: Rows of an Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS = "512"
#: Stands for a null id: such a row comes after every other.
NO_ID = (1 << 63) - 1


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches, and this package on the path of Python workers of a local session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in path:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *path])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where both are one process, one is made if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tidy() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and pools keep what they once held."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) in one array, and its len + 1 offsets."""
    col = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def int_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), _BASE)], dtype=np.uint64)[:n]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ of each text, and the word offsets of the texts."""
    inside = ~_SPACE[buf]
    edge = np.empty(len(buf) + 1, bool)
    if len(buf):
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        # a text's end also ends a word, and begins the next one
        cut = off[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(buf))])
        cut = cut[inside[cut] & inside[cut - 1]]
    else:
        edge[:] = False
        cut = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.r_[at, cut, cut])
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    out = np.empty(len(starts), np.uint64)
    pw = powers(int(lens.max()))
    step = 1 << 16
    for a in range(0, len(starts), step):
        s, n = starts[a : a + step], lens[a : a + step]
        first = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(first, n)
        piece = _BYTE[buf[inner + np.repeat(s, n)]] * pw[inner]
        out[a : a + step] = np.add.reduceat(piece, first) + n.astype(np.uint64)
    return mix(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k consecutive values of h; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, off, size, cur, pw = None, 0, 1, h, int(_BASE)
    while True:
        if k & 1:
            part = cur[off:]
            out = part if out is None else out[: len(part)] * np.uint64(pw) + part[: len(out)]
            off += size
        k >>= 1
        if not k:
            return mix(out)
        cur = cur[:-size] * np.uint64(pw) + cur[size:]
        pw, size = pw * pw % (1 << 64), size * 2

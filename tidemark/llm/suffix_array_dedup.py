"""Removal of byte strings that an earlier document has, by suffix arrays.

Groups of picks from repeats.py are shards, as a window's class lies in one group; only a group of one pick may be larger and is
cut. Each shard gets a suffix array to the depth of a window by Larsson and Sadakane's refinement: only suffixes that are not
yet told apart are sorted again, by their rank h places on. Suffixes with one rank form a class with its smallest id; shards
of a pick are merged by binary search of their sorted classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import table
from .repeats import Bytes, Unit, mark, nullable

#: Bytes of a shard.
SHARD_BYTES = 1 << 20


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' order, and the keys in it. Keys of few bits are sorted as values with their places below them."""
    low = max(len(key) - 1, 1).bit_length()
    if bits + low > 64:
        by = np.argsort(key, kind="stable")
        return by, key[by]
    packed = np.sort(key << np.uint64(low) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << low) - 1)).astype(np.int64), packed >> np.uint64(low)


def _starts(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _news(x: np.ndarray) -> np.ndarray:
    return np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)


def suffix_array(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows in the order of their `depth` bytes, and whether each differs from the one before it.

    left[i] is how many bytes of windows there are from place i on, and one more; windows begin where it is over `depth`. Only
    places that some window still asks for are ranked by the next length.
    """
    h = min(5, depth)
    at = np.flatnonzero(left > h)
    eight = np.ndarray((len(text),), ">u8", np.r_[text, np.zeros(8, np.uint8)], strides=(1,))
    by, key = _sorted(eight[at].astype(np.uint64) >> np.uint64(64 - 8 * h), 8 * h)
    at = at[by]
    bits = len(text).bit_length()
    rank = np.zeros(len(text), np.int64)  # of each place, where its group begins
    rank[at] = _starts(_news(key))
    while h < depth:
        to = min(2 * h, depth)
        at = at[left[at] > to]
        old = rank[at]
        later = np.r_[old[1:] == old[:-1], False]
        open_ = np.flatnonzero(later | np.r_[False, later[:-1]])
        p = at[open_]
        by, key = _sorted((old[open_] << bits | rank[p + to - h]).astype(np.uint64), 2 * bits)
        p = at[open_] = p[by]
        group = (key >> np.uint64(bits)).astype(np.int64)
        rank[p] = group + _starts(_news(key)) - _starts(_news(group))
        h = to
    return at, _news(rank[at])


class Shard:
    """A shard's classes of windows: their least ids, and each window's class."""

    def __init__(self, content: pa.Array, windows: np.ndarray, least: np.ndarray, depth: int):
        off = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
        self.text, self.depth = np.frombuffer(content.buffers()[2], np.uint8)[off[0] : off[-1]], depth
        size = np.diff(off)
        piece = np.repeat(np.arange(len(size)), size)
        left = np.repeat(off[:-1] - off[0] + windows + depth, size) - np.arange(len(self.text))
        at, new = suffix_array(self.text, left, depth)
        self.heads = at[new]
        self.least = np.minimum.reduceat(least[piece[at]], np.flatnonzero(new)) if len(at) else np.zeros(0, np.int64)
        of = np.zeros(len(self.text), np.int64)
        of[at] = np.cumsum(new) - 1
        self.cls = of[left > depth]

    @property
    def keys(self) -> np.ndarray:
        """The classes' windows, in order."""
        return np.ascontiguousarray(self.text[self.heads[:, None] + np.arange(self.depth)]).view(f"S{self.depth}").ravel() if len(self.heads) else np.zeros(0, f"S{self.depth}")


def merged(shards: list[Shard]) -> list[np.ndarray]:
    """The least ids of the shards' classes over all shards; each shard's are looked up in the sorted list so far."""
    if len(shards) == 1:
        return [shards[0].least]
    keys, least = shards[0].keys, shards[0].least.copy()
    for s in shards[1:]:
        own = s.keys
        at = np.searchsorted(keys, own)
        hit = keys[np.minimum(at, len(keys) - 1)] == own if len(keys) else np.zeros(len(own), bool)
        least[at[hit]] = np.minimum(least[at[hit]], s.least[hit])
        keys, least = np.insert(keys, at[~hit], own[~hit]), np.insert(least, at[~hit], s.least[~hit])
    return [least[np.searchsorted(keys, s.keys)] for s in shards]


def earliest(content: pa.Array, windows: np.ndarray, least: np.ndarray, depth: int = Bytes.window, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For every window of every piece, the least id of a piece that has it."""
    size = np.diff(np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1])
    number = (np.cumsum(size) - size) // shard_bytes
    cut = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(size)]
    shards = [Shard(content.slice(a, b - a), windows[a:b], least[a:b], depth) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return np.concatenate([ids[s.cls] for s, ids in zip(shards, merged(shards), strict=True)])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None, hot: int | None = None) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty, texts under 50 bytes keep all. Rows that repeat an id are not earlier than each other, so both
    keep what no smaller id has; a null id comes after all others. Other columns are ignored.
    """

    def finish(t: pa.Table, unit: Unit, gone: np.ndarray) -> pa.Table:
        n, removed, spans, sha = [], [], [], []
        for a, b in zip(unit.at[:-1], unit.at[1:], strict=True):
            g = gone[a:b]
            n.append(int(b - a))
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed[-1] else 0)
            sha.append(hashlib.sha256((unit.buf[a:b][~g] if removed[-1] else unit.buf[a:b]).tobytes()).hexdigest())
        return pa.table({id_col: t.column("__id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    more = {"hot": hot} if hot is not None else {}
    return mark(docs, Bytes, earliest, finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, chunk_bytes=chunk_bytes, **more)


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed bytes gone from text_col; characters that lost some of their bytes go whole. All rows stay,
    null texts as nulls."""
    rest = [c for c in docs.columns if c != text_col]
    out_schema = StructType([StructField("rest", nullable(docs.select(*(f"`{c}`" for c in rest)).schema)), StructField("text", StringType())])

    def finish(t: pa.Table, unit: Unit, gone: np.ndarray) -> pa.Table:
        known = t.column("__text").is_valid().to_pylist()
        kept = [unit.buf[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") if k else None for a, b, k in zip(unit.at[:-1], unit.at[1:], known, strict=True)]
        return pa.table({"rest": t.column("__rest"), "text": pa.array(kept, pa.string())})

    out = mark(docs, Bytes, earliest, finish, out_schema, id_col, text_col, rest)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))

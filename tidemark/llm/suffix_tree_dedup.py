"""Removal of word windows that an earlier document has, by prefix-partitioned suffix trees.

Within a bucket of repeats.py, suffixes are split by prefixes of varying length into groups that fit a bound. Each
group's subtree is made as ERA does: suffixes are sorted by reading a few more words at a time for those not yet told
apart, which gives their order and the depths at which neighbours branch. Subtrees end at depth 50, a window's length, so
an internal node that deep is a run of leaves alike, and the smallest id below it is the earliest document of its window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, words
from .repeats import Unit, Words, mark

#: Suffixes of a group, and the words read at a time.
GROUP_SUFFIXES, RANGE = 1 << 13, 8


def prefix_groups(token: np.ndarray, at: np.ndarray, depth: int, most: int = GROUP_SUFFIXES) -> list[tuple[np.ndarray, int]]:
    """(places in `at`, length of their common prefix): groups of at most `most` suffixes unless alike up to depth.

    A prefix that more suffixes have is made longer by a word; those that fewer have share a group with their neighbours
    in order, so that no group is much smaller than it may be. Equal suffixes are always in one group.
    """
    out, waiting = [], [(np.arange(len(at)), 0)]
    while waiting:
        group, length = waiting.pop()
        if len(group) <= most or length == depth:
            out.append((group, length))
            continue
        word = token[at[group] + length]
        order = np.argsort(word, kind="stable")
        cut = np.r_[0, np.flatnonzero(np.diff(word[order])) + 1, len(order)]
        size = np.diff(cut)
        first = 0
        for i, n in enumerate(size):
            if n > most:
                if cut[i] > cut[first]:
                    out.append((group[order[cut[first] : cut[i]]], length))
                waiting.append((group[order[cut[i] : cut[i + 1]]], length + 1))
                first = i + 1
            elif cut[i + 1] - cut[first] > most:
                out.append((group[order[cut[first] : cut[i]]], length))
                first = i
        if cut[-1] > cut[first]:
            out.append((group[order[cut[first] :]], length))
    return out


def subtree(token: np.ndarray, at: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in order, and each one's depth of branching from the leaf before it (depth: alike so far)."""
    order = np.arange(len(at))
    branch = np.full(len(at), depth)
    branch[:1] = known
    group = np.zeros(len(at), np.int64)  # where the group of each place begins
    while known < depth:
        later = np.r_[group[1:] == group[:-1], False]
        open_ = np.flatnonzero(later | np.r_[False, later[:-1]])
        if not len(open_):
            break
        n = min(RANGE, depth - known)
        read = token[at[order[open_]][:, None] + known + np.arange(n)]
        by = np.lexsort((*read.T[::-1], group[open_]))
        order[open_], read, old = order[open_][by], read[by], group[open_][by]
        differ = read[1:] != read[:-1]
        same = old[1:] == old[:-1]
        split = np.flatnonzero(same & differ.any(axis=1))
        branch[open_[split + 1]] = known + differ[split].argmax(axis=1)
        new = np.r_[True, ~same | differ.any(axis=1)]
        group = group.copy()
        group[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        known += n
    return order, branch


def internal_nodes(branch: np.ndarray, least_depth: int) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf + 1) of the internal nodes at least_depth or deeper."""
    out, stack = [], []
    for i, d in enumerate([*branch.tolist()[1:], -1]):
        left = i
        while stack and stack[-1][0] > d:
            depth, left = stack.pop()
            out.append((depth, left, i + 1))
        if d >= least_depth and (not stack or stack[-1][0] < d):
            stack.append((d, left))
    return out


def earliest(content: pa.Array, windows: np.ndarray, least: np.ndarray, depth: int = Words.window, most: int = GROUP_SUFFIXES) -> np.ndarray:
    """For every window of every piece, the least id of a piece that has it."""
    off = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
    buf = np.frombuffer(content.buffers()[2], np.uint8)[off[0] : off[-1]]
    start, end, first = words(buf, off - off[0])
    lens = end - start
    place = np.r_[0, np.cumsum(lens)]
    take = np.arange(place[-1]) - np.repeat(place[:-1], lens) + np.repeat(start, lens)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(place), pa.py_buffer(buf[take])])
    token = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first[:-1], windows)
    ids = np.repeat(least, windows)
    out = ids.copy()
    for group, known in prefix_groups(token, at, depth, most):
        if len(group) == 1:
            continue
        order, branch = subtree(token, at[group], known, depth)
        leaf = group[order]
        if nodes := internal_nodes(branch, depth):  # none is below another, as subtrees end there
            span = np.array(nodes)[:, 1:]
            below = np.zeros(len(leaf) + 1, np.int64)
            below[span[:, 0]] += 1
            below[span[:, 1]] -= 1
            low = np.minimum.reduceat(np.r_[ids[leaf], 0], span.ravel())[::2]
            out[leaf[np.cumsum(below[:-1]) > 0]] = np.repeat(low, span[:, 1] - span[:, 0])
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int | None = None, hot: int | None = None) -> DataFrame:
    """Per row: id_col, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Null texts have no words, texts under 50 words keep all. Rows that repeat an id are not earlier than each other; a
    null id comes after all others. Other columns are ignored.
    """

    def finish(t: pa.Table, unit: Words, gone: np.ndarray) -> pa.Table:
        n, removed, sha = [], [], []
        buf, start, end = unit.bounds(np.arange(len(unit.start)), np.arange(len(unit.start)) + 1)
        for a, b in zip(unit.at[:-1], unit.at[1:], strict=True):
            g = gone[a:b]
            n.append(int(b - a))
            removed.append(int(g.sum()))
            if removed[-1]:
                kept = np.repeat(~g, end[a:b] - start[a:b] + 1)
                text = buf[start[a] : end[b - 1] + 1][kept].tobytes()[:-1]
            else:
                text = buf[start[a] : end[b - 1]].tobytes() if b > a else b""
            sha.append(hashlib.sha256(text).hexdigest())
        return pa.table({id_col: t.column("__id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    more = {"hot": hot} if hot is not None else {}
    return mark(docs, Words, earliest, finish, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string", id_col, text_col, chunk_bytes=chunk_bytes, **more)


def op7_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))

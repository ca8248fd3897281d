"""Windows of a document that also start in a document with a smaller id: the exchange that finds them all.

A window is a fixed number of tokens (bytes or words). Every window picks the smallest hash of its k-grams, so equal
windows pick equal ones; neighbouring windows with one pick form a piece. Texts are dealt to chunks of bounded size, and

1. each chunk sends its distinct picks to buckets, which answer which of them occur in two documents or more;
2. for those, each chunk sends its distinct pieces, with their smallest ids, to buckets by pick. A pick that very many
   documents have is cut into single windows, dealt by their own hash. A bucket's windows then meet in one of the two
   solvers (suffix arrays or suffix trees), and each piece is answered with the windows that have an earlier document;
3. each chunk marks its tokens and makes its rows.

All of it is one plan over one exchange of the texts, which Spark reuses. Equal pieces are merged before they are sent, so
neither copies nor common passages make a bucket grow with their number; nothing is capped, every answer is exact, and the
solver decides every window of every piece, however it was dealt.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import int_ids, mix, rolling, text_bytes, tidy, word_hashes, words

#: Bytes of text of a chunk, at least and at most; between them, a CHUNKS-th of all.
LEAST_CHUNK, MOST_CHUNK, CHUNKS = 1 << 20, 4 << 20, 256
#: Documents beyond which a pick's windows are dealt one by one.
HOT = 2000
#: Pieces whose contents are copied at once.
SLICE = 1 << 14
#: Bytes of a group of picks that a solver gets at once, but for a single pick of more.
GROUP_BYTES = 1 << 18
#: Windows of a piece at most (the bits of an answer).
MOST_WINDOWS = 32
_LOW = np.uint64((1 << 40) - 1)
_BLOCK = 1 << 17


class Unit:
    """How texts are cut into tokens."""

    window: int
    k: int

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.at = buf, off  # at: the texts' offsets into the tokens

    def keys(self, a: int, b: int) -> np.ndarray:
        """Hashes of the k-grams that start at tokens a to b - k."""
        raise NotImplementedError

    def bounds(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A buffer with each token range's content, and the contents' byte starts and ends in it."""
        raise NotImplementedError


class Bytes(Unit):
    window, k = 50, 24

    def keys(self, a: int, b: int) -> np.ndarray:
        n = b - a - self.k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        part = np.ascontiguousarray(self.buf[a:b])
        eight = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += eight[8 : n + 8] * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h += eight[16 : n + 16] * np.uint64(0x94D049BB133111EB)
        return mix(h)

    def bounds(self, start, stop):
        return self.buf, start, stop


class Words(Unit):
    window, k = 50, 24

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.raw, (self.start, self.end, self.at) = buf, words(buf, off)
        self.hashes = word_hashes(buf, self.start, self.end)
        self.buf = None

    def keys(self, a: int, b: int) -> np.ndarray:
        return rolling(self.hashes[a:b], self.k)

    def bounds(self, start, stop):
        if self.buf is None:  # words with one space after each
            n = self.end - self.start + 1
            self.place = np.r_[0, np.cumsum(n)]
            inner = np.arange(self.place[-1]) - np.repeat(self.place[:-1], n)
            at = inner + np.repeat(self.start, n)
            self.buf = self.raw[np.minimum(at, max(len(self.raw) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
            self.buf[self.place[1:] - 1] = 0x20
        return self.buf, self.place[start], self.place[stop] - 1


def smallest(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    size, cur = 1, x
    while 2 * size <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[: len(cur) - (w - size)], cur[w - size :]) if w > size else cur


def pieces(unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, pick and text of every piece."""
    at, window = unit.at, unit.window
    total = int(at[-1])
    n = total - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none
    full = np.flatnonzero(np.diff(at) >= window)
    mark = np.zeros(n + 1, np.int8)
    mark[at[full]] += 1
    mark[at[full + 1] - window + 1] -= 1
    valid = np.cumsum(mark[:-1], dtype=np.int8) > 0
    starts, sizes, picks = [], [], []
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        pick = smallest(unit.keys(a, b + window - 1), window - unit.k + 1)
        ok = valid[a:b]
        edge = np.empty(len(ok) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(pick[1:], pick[:-1], out=edge[1:-1])
        edge[1:-1] |= ok[1:] != ok[:-1]
        cut = np.flatnonzero(edge)
        s, size = cut[:-1], np.diff(cut)
        keep = ok[s]
        s, size = s[keep], size[keep]
        if len(size) and size.max() > MOST_WINDOWS:
            parts = -(-size // MOST_WINDOWS)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            left = np.repeat(size, parts) - inner * MOST_WINDOWS
            s, size = np.repeat(s, parts) + inner * MOST_WINDOWS, np.minimum(left, MOST_WINDOWS)
        starts.append(s + a)
        sizes.append(size)
        picks.append(pick[s])
    start = np.concatenate(starts)
    return start, np.concatenate(sizes), np.concatenate(picks), np.searchsorted(at, start, "right") - 1


def distinct(picks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct picks in order, each piece's place among them, and in how many texts each occurs."""
    order = np.argsort(picks, kind="stable")
    p, d = picks[order], docs[order]
    new = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)
    place = np.empty(len(p), np.int64)
    place[order] = np.cumsum(new) - 1
    apart = new | np.r_[True, d[1:] != d[:-1]] if len(p) else new
    return p[new], place, np.add.reduceat(apart.astype(np.int64), np.flatnonzero(new)) if len(p) else np.zeros(0, np.int64)


def by_bucket(route: np.ndarray, shift: int, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, from, to) of the buckets in it."""
    bucket = ((route >> np.uint64(shift)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, np.int64)
    return order, [(int(b[i]), int(i), int(j)) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def rows(found: list[tuple[int, int, bytes]], first: str, second: str) -> pa.Table:
    cols = list(zip(*found, strict=True)) or [[], [], []]
    return pa.table({first: pa.array(cols[0], pa.int32()), second: pa.array(cols[1], pa.int32()), "data": pa.array(cols[2], pa.binary())})


def picks_of(unit: Unit, chunk: int, n_buckets: int) -> pa.Table:
    """Step 1, a chunk's side: its picks' low 40 bits and numbers of texts, by bucket."""
    _, _, picks, docs = pieces(unit)
    values, _, count = distinct(picks, docs)
    order, buckets = by_bucket(values, 40, n_buckets)
    low, n = (values & _LOW)[order], np.minimum(count[order], 255).astype(np.uint8)
    return rows([(b, chunk, (low[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low[i:j] >> np.uint64(32)).astype(np.uint8).tobytes() + n[i:j].tobytes()) for b, i, j in buckets], "bucket", "chunk")


def read_picks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    low = np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)
    return low, np.frombuffer(data, np.uint8, n, 5 * n)


def shared(t: pa.Table, hot: int) -> pa.Table:
    """Step 1, a bucket's side: for every pick sent 0 (one text has it), 1 (several) or 2 (more than `hot`)."""
    chunks, parts = t.column("chunk").to_pylist(), [read_picks(x.as_py()) for x in t.column("data")]
    values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(place, np.concatenate([p[1] for p in parts]), len(values))
    state = ((total > 1).astype(np.uint8) + (total > hot))[place]
    cut = np.cumsum([0, *(len(p[0]) for p in parts)])
    b = t.column("bucket")[0].as_py()
    told = ((c, state[i:j]) for c, i, j in zip(chunks, cut[:-1], cut[1:], strict=True))
    return rows([(c, b, np.packbits(s > 0).tobytes() + (np.packbits(s > 1).tobytes() if (s > 1).any() else b"")) for c, s in told], "chunk", "bucket")


class Chunk:
    """A chunk's pieces whose picks are shared, merged by content; made alike in steps 2 and 3."""

    def __init__(self, unit: Unit, ids: np.ndarray, n_buckets: int, answers: dict[int, bytes]):
        start, size, picks, docs = pieces(unit)
        values, place, _ = distinct(picks, docs)
        order, buckets = by_bucket(values, 40, n_buckets)
        state = np.zeros(len(values), np.uint8)
        for b, i, j in buckets:
            n, half = j - i, (j - i + 7) // 8
            data = np.frombuffer(answers[b], np.uint8)
            state[order[i:j]] = np.unpackbits(data[:half], count=n)
            if len(data) > half:
                state[order[i:j]] += np.unpackbits(data[half:], count=n)
        state = state[place]
        keep, hot = state == 1, state == 2
        n = size[hot]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start = np.r_[start[keep], np.repeat(start[hot], n) + inner]
        self.size = np.r_[size[keep], np.ones(len(inner), np.int64)]
        self.doc = np.r_[docs[keep], np.repeat(docs[hot], n)]
        # a slice of contents at a time, equal ones merged at once: windows of hot picks hold each byte fifty times
        codes, found, known = [], [], 0
        for i in range(0, len(self.start), SLICE):
            part = slice(i, i + SLICE)
            buf, a, b = unit.bounds(self.start[part], self.start[part] + self.size[part] + unit.window - 1)
            off = np.r_[0, np.cumsum(b - a)]
            at = np.arange(off[-1]) + np.repeat(a - off[:-1], b - a)
            coded = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(buf[at])]).dictionary_encode()
            codes.append(coded.indices.to_numpy(zero_copy_only=False) + known)
            found.append(coded.dictionary)
            known += len(coded.dictionary)
        coded = pa.chunked_array(found, pa.large_binary()).combine_chunks().dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.concatenate(codes) if codes else np.zeros(0, np.int64)]
        self.content = coded.dictionary
        m = len(self.content)
        first = np.full(m, len(self.code), np.int64)
        np.minimum.at(first, self.code, np.arange(len(self.code)))
        self.least = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.code, ids[self.doc])
        single = first >= keep.sum()
        route = np.where(single, 0, np.r_[picks[keep], np.zeros(len(inner), np.uint64)][first] if m else 0).astype(np.uint64)
        if single.any():
            content, off = text_bytes(self.content)
            route[single] = word_hashes(content, off[:-1][single], off[1:][single])
        self.windows = self.size[first] if m else np.zeros(0, np.int64)
        self.order, self.buckets = by_bucket(route, 20, n_buckets)
        self.route = route

    def sent(self, chunk: int) -> pa.Table:
        """Step 2, a chunk's side: for each bucket its distinct pieces (route, least id, windows, content)."""
        out = []
        for b, i, j in self.buckets:
            at = self.order[i:j]
            content = self.content.take(pa.array(at))
            off = np.frombuffer(content.buffers()[1], np.int64)[: len(at) + 1]
            body = content.buffers()[2].to_pybytes()[off[0] : off[-1]]
            out.append((b, chunk, np.array([len(at)], "<u4").tobytes() + self.route[at].astype("<u8").tobytes() + self.least[at].astype("<i8").tobytes() + np.diff(off).astype("<u4").tobytes() + self.windows[at].astype(np.uint8).tobytes() + body))
        return rows(out, "bucket", "chunk")


def read_pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.frombuffer(data, "<u8", n, 4), np.frombuffer(data, "<i8", n, 4 + 8 * n), np.frombuffer(data, "<u4", n, 4 + 16 * n), np.frombuffer(data, np.uint8, n, 4 + 20 * n), data[4 + 21 * n :]


#: (contents, windows of each, least id of each) -> for every window, one after the other, the least id that has it.
Solver = Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]


def answers(t: pa.Table, solver: Solver) -> pa.Table:
    """Step 2, a bucket's side: for every piece sent, the windows that start in a text with a smaller id."""
    chunks, parts = t.column("chunk").to_pylist(), [read_pieces(x.as_py()) for x in t.column("data")]
    route, least, lens, windows = (np.concatenate([p[i] for p in parts]) for i in range(4))
    off = np.r_[0, np.cumsum(lens, dtype=np.int64)]
    column = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(b"".join(p[4] for p in parts))])
    coded = column.dictionary_encode()
    code, content = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    m = len(content)
    first = np.full(m, len(code), np.int64)
    np.minimum.at(first, code, np.arange(len(code)))
    smallest_id = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(smallest_id, code, least)
    # equal windows have one route: whole routes are solved in groups of bounded size, so the work grows with the bucket's bytes
    by = np.argsort(route[first], kind="stable")
    r, length = route[first][by], lens[first][by].astype(np.int64)
    new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    number = (np.cumsum(length) - length)[new] // GROUP_BYTES
    cuts = [*new[np.r_[True, number[1:] != number[:-1]]].tolist(), m]
    content, n, smallest_id = content.take(pa.array(by)), windows[first][by].astype(np.int64), smallest_id[by]
    have = np.concatenate([solver(content.slice(i, j - i), n[i:j], smallest_id[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    place = np.empty(m, np.int64)
    place[by] = np.cumsum(n) - n
    size = windows.astype(np.int64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    hit = have[np.repeat(place[code], size) + inner] < np.repeat(least, size)
    bits = np.add.reduceat(hit.astype(np.uint64) << inner.astype(np.uint64), np.cumsum(size) - size).astype("<u4")
    cut = np.cumsum([0, *(len(p[0]) for p in parts)])
    b = t.column("bucket")[0].as_py()
    return rows([(c, b, bits[i:j].tobytes()) for c, i, j in zip(chunks, cut[:-1], cut[1:], strict=True)], "chunk", "bucket")


def covered(unit: Unit, chunk: Chunk, found: dict[int, bytes]) -> np.ndarray:
    """Step 3: whether each token of a chunk is removed."""
    mask = np.zeros(len(chunk.content), np.uint32)
    for b, i, j in chunk.buckets:
        mask[chunk.order[i:j]] = np.frombuffer(found[b], "<u4")
    return mask


def nullable(schema: StructType) -> StructType:
    """The schema with nulls allowed everywhere, as Arrow tables from Python have it."""
    text = schema.json()
    for key in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{key}":false', f'"{key}":true')
    return StructType.fromJson(json.loads(text))


def mark(docs: DataFrame, kind: type[Unit], solver: Solver, finish: Callable, out_schema: str | StructType, id_col: Column | str, text_col: Column | str, rest: list[str] | None = None, hot: int = HOT, chunk_bytes: int | None = None) -> DataFrame:
    """finish(ids and rest as a table, unit, removed tokens) -> table of out_schema, over all rows of docs."""
    cols = [F.col(id_col).cast("long").alias("__id") if isinstance(id_col, str) else id_col.cast("long").alias("__id"), F.col(text_col).alias("__text") if isinstance(text_col, str) else text_col.alias("__text")]
    if rest:
        chosen = docs.select(*(f"`{c}`" for c in rest)).schema
        cols.append(F.struct(*(F.col(f"`{c}`") for c in rest)).cast(nullable(chosen)).alias("__rest"))
    base = docs.select(*cols)
    total = base.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    size = chunk_bytes or min(MOST_CHUNK, max(LEAST_CHUNK, total // CHUNKS))
    n_chunks = max(1, -(-total // size))
    n_buckets = min(n_chunks, 64 + n_chunks // 4)
    # rows that repeat an id and a text would fill one chunk: their place in the scan deals them too
    base = base.withColumn("chunk", F.pmod(F.xxhash64("__id", F.octet_length("__text"), F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int"))

    def in_order(t: pa.Table) -> pa.Table:
        """Rows of a shuffle come in any order; each step must see the same one."""
        return t.take(pc.sort_indices(t, sort_keys=[("__id", "ascending"), ("__text", "ascending")]))

    def unit_of(t: pa.Table) -> Unit:
        return kind(*text_bytes(t.column("__text").combine_chunks()))

    def neat(f: Callable) -> Callable:
        """f, after which its memory goes back to the system."""

        def run(*tables: pa.Table) -> pa.Table:
            out = f(*tables)
            tidy()
            return out

        return (lambda t: run(t)) if f.__code__.co_argcount == 1 else (lambda t, r: run(t, r))

    def step1(t: pa.Table) -> pa.Table:
        return picks_of(unit_of(in_order(t)), t.column("chunk")[0].as_py(), n_buckets)

    def split(r: pa.Table, first: bool) -> dict[int, bytes]:
        return {b: d for b, d, s in zip(r.column("bucket").to_pylist(), r.column("data").to_pylist(), r.column("step").to_pylist(), strict=True) if (s == 1) == first}

    def step2(t: pa.Table, r: pa.Table) -> pa.Table:
        if not len(t):
            return rows([], "bucket", "chunk")
        t = in_order(t)
        return Chunk(unit_of(t), int_ids(t.column("__id").combine_chunks()), n_buckets, split(r, True)).sent(t.column("chunk")[0].as_py())

    def step3(t: pa.Table, r: pa.Table) -> pa.Table:
        t = in_order(t)
        unit = unit_of(t)
        ids = int_ids(t.column("__id").combine_chunks())
        chunk = Chunk(unit, ids, n_buckets, split(r, True))
        mask = covered(unit, chunk, split(r, False))
        # the text with the least id is answered window by window; others with that content have an earlier one
        bits = np.where(ids[chunk.doc] == chunk.least[chunk.code], mask[chunk.code], np.uint32(0xFFFFFFFF)) if len(chunk.code) else np.zeros(0, np.uint32)
        inner = np.arange(chunk.size.sum()) - np.repeat(np.cumsum(chunk.size) - chunk.size, chunk.size)
        hit = (np.repeat(bits, chunk.size) >> inner.astype(np.uint32)) & np.uint32(1)
        at = (np.repeat(chunk.start, chunk.size) + inner)[hit > 0]
        n = int(unit.at[-1])
        step = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + unit.window, minlength=n + 1)[: n + 1]
        return finish(t, unit, np.cumsum(step)[:n] > 0)

    row = "int, data binary"
    picked = base.groupBy("chunk").applyInArrow(neat(step1), f"bucket int, chunk {row}")
    state = picked.groupBy("bucket").applyInArrow(neat(lambda t: shared(t, hot)), f"chunk int, bucket {row}").withColumn("step", F.lit(1))
    sent = base.groupBy("chunk").cogroup(state.groupBy("chunk")).applyInArrow(neat(step2), f"bucket int, chunk {row}")
    told = sent.groupBy("bucket").applyInArrow(neat(lambda t: answers(t, solver)), f"chunk int, bucket {row}").withColumn("step", F.lit(2))
    return base.groupBy("chunk").cogroup(state.unionByName(told).groupBy("chunk")).applyInArrow(neat(step3), out_schema)

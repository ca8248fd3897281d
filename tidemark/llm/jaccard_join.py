"""Similarity join of shingle sets by signature trees.

Equal sets are one node. Nodes that may be linked are brought together exactly: every shingle is counted over all sets, and
linked sets share one of their rarest ones, of which each set gives as many as it can lack in a linked one, and one more.
Shingles that no other set has bring nothing together, so most sets meet none, however many common passages they hold. Sets
with such a shingle and a size class in common are connected, and each connected group is joined on its own: its sets'
bitmaps, leaves of a tree whose nodes hold OR-ed bitmaps and ranges of sizes, are compared by a dual traversal that skips pairs of nodes whose largest possible
overlap is too small (or whose sets are all connected already); pairs of leaves are compared exactly. A group beyond a
bound is dealt to blocks; representatives of the blocks' components are joined first, and what is still apart after that
is compared block by block, for blocks that have a rare shingle in common.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, rolling, stored, table, text_bytes, tidy, word_hashes, words
from .components import components
from .repeats import by_bucket, rows

#: Similarity in hundredths, words of a shingle.
LEAST, SHINGLE = 90, 3
#: Bytes of a chunk of texts (see repeats.py), of a block of sets, and of the sets that one task joins.
LEAST_CHUNK, MOST_CHUNK, CHUNKS = 1 << 20, 8 << 20, 256
BLOCK_BYTES, SHARD_BYTES = 192 << 10, 512 << 10
LEAF, FAN, SALTS = 32, 4, 32
#: Texts whose sets are made at once.
CUT_ROWS = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW = np.uint64((1 << 32) - 1)
FOUND = [("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary()), ("key", pa.int64())]


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, all words as one shingle if there are fewer."""
    buf = _LOWER[buf]
    start, end, at = words(buf, off)
    h = word_hashes(buf, start, end)
    grams = rolling(h, size)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(rolling(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    """A set's identity: 64 bits of its digest, never negative."""
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little") >> 1


def size_classes(largest: int) -> list[int]:
    """Upper sizes of the classes, each about half as large again as the one before."""
    out = [9]
    while out[-1] < largest:
        out.append(out[-1] * 3 // 2 + 1)
    return out


_CLASSES = np.array(size_classes(1 << 40))


def prefixes(sets: list[np.ndarray], ranks: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) pairs; linked sets that aren't equal have a key in common.

    ranks[i] orders the shingles of sets[i] by how many sets have them, 0 for those that no other set has. Linked sets
    share one of the first n - ceil(least * n / 100) + 1 shingles in that order, the rarest ones; those of rank 0 come
    first and are shared by none. Keys hold the class of the set's size, and each up to that of the largest set which may be linked.
    """
    keys, docs = [], []
    for i, (s, rank) in enumerate(zip(sets, ranks, strict=True)):
        n = len(s)
        first = n - -(-n * least // 100) + 1 - int((rank == 0).sum())
        if first <= 0 or n * 100 // least <= n:
            continue
        known = np.flatnonzero(rank)
        chosen = s[known[np.lexsort((s[known], rank[known]))[:first]]]
        low, high = np.searchsorted(_CLASSES, [n, n * 100 // least]).tolist()
        for size in range(low, high + 1):
            keys.append(mix(chosen ^ mix(np.full(1, size, np.uint64))))
            docs.append(np.full(len(chosen), i))
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        p = self.parent
        while (q := p[p]).tolist() != p.tolist():
            p = q
        self.parent = p
        return p


class SignatureTree:
    """Levels of (OR-ed bitmaps, smallest size, largest size, first place, last place + 1) over sets ordered by size."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, order: np.ndarray):
        self.order, self.bits, self.size = order, bits[order], size[order]
        edge = np.arange(0, len(order), LEAF)
        level = (np.bitwise_or.reduceat(self.bits, edge, axis=0), np.minimum.reduceat(self.size, edge), np.maximum.reduceat(self.size, edge), edge, np.minimum(edge + LEAF, len(order)))
        self.levels = [level]
        while len(level[0]) > 1:
            edge = np.arange(0, len(level[0]), FAN)
            level = (np.bitwise_or.reduceat(level[0], edge, axis=0), np.minimum.reduceat(level[1], edge), np.maximum.reduceat(level[2], edge), level[3][edge], level[4][np.minimum(edge + FAN, len(level[3])) - 1])
            self.levels.append(level)

    def children(self, level: int, i: int) -> range:
        return range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][0])))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each shingle that two of the sets have; the others can't be in an overlap."""
    token, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1
    width = max(1, -(-int((count > 1).sum()) // 64))
    bits = np.zeros((len(sets), width * 64), bool) if len(sets) * width * 64 <= 1 << 28 else None
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = count[place] > 1
    if bits is None:
        out = np.zeros((len(sets), width), np.uint64)
        np.bitwise_or.at(out, (owner[keep], often[place[keep]] // 64), np.uint64(1) << (often[place[keep]] % 64).astype(np.uint64))
        return out
    bits[owner[keep], often[place[keep]]] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def traverse(a: SignatureTree, b: SignatureTree, label: Union, least: int = LEAST) -> None:
    """Joins the labels of all linked pairs of a set in a and one in b (places in `label` are those of a.order, b.order)."""
    t = least, 100 + least  # linked: (100 + least) * overlap >= least * (sizes' sum)
    waiting = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while waiting:
        la, i, lb, j = waiting.pop()
        if a is b and (la, i) > (lb, j) and la == lb:
            continue
        (oa, lo_a, hi_a, fa, ta), (ob, lo_b, hi_b, fb, tb) = a.levels[la], b.levels[lb]
        if 100 * hi_a[i] < least * lo_b[j] or 100 * hi_b[j] < least * lo_a[i]:
            continue
        most = min(int(np.bitwise_count(oa[i] & ob[j]).sum()), int(hi_a[i]), int(hi_b[j]))
        if t[1] * most < t[0] * (int(lo_a[i]) + int(lo_b[j])):
            continue
        if la or lb:
            if la >= lb:
                waiting += [(la - 1, c, lb, j) for c in a.children(la, i)] if la > lb or not lb else [(la - 1, c, lb - 1, d) for c in a.children(la, i) for d in b.children(lb, j)]
            else:
                waiting += [(la, i, lb - 1, d) for d in b.children(lb, j)]
            continue
        x, y = np.arange(fa[i], ta[i]), np.arange(fb[j], tb[j])
        rx = np.array([label.find(int(k)) for k in a.order[x]])
        ry = np.array([label.find(int(k)) for k in b.order[y]])
        if rx.min() == rx.max() == ry.min() == ry.max():
            continue
        overlap = np.bitwise_count(a.bits[x][:, None] & b.bits[y][None]).sum(axis=2, dtype=np.int64)
        linked = (t[1] * overlap >= t[0] * (a.size[x][:, None] + b.size[y][None])) & (rx[:, None] != ry[None])
        for p, q in zip(*np.nonzero(linked), strict=True):
            label.join(int(a.order[x[p]]), int(b.order[y[q]]))


def joined(sets: list[np.ndarray], least: int = LEAST, sides: np.ndarray | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """For each set, the place of the first one of its component. With sides, only pairs of a side 0 and a side 1 are
    compared; equal labels are connected from the start."""
    n = len(sets)
    label = Union(n)
    if labels is not None:
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        label.parent = first[back]
    if n > 1:
        size = np.array([len(s) for s in sets], np.int64)
        bits = bitmaps(sets)
        order = np.lexsort((np.arange(n), size))
        if sides is None:
            tree = SignatureTree(bits, size, order)
            traverse(tree, tree, label, least)
        else:
            left, right = order[sides[order] == 0], order[sides[order] == 1]
            if len(left) and len(right):
                traverse(SignatureTree(bits, size, left), SignatureTree(bits, size, right), label, least)
    return label.roots()


def decode(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def groups(t: pa.Table, keys: list[str]) -> list[np.ndarray]:
    """Places of the rows of each group, in a fixed order."""
    cols = [t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in [*keys, "node"]]
    order = np.lexsort(cols[::-1])
    if not len(order):
        return []
    new = np.zeros(len(order), bool)
    for c in cols[:-1]:
        new[1:] |= c[order][1:] != c[order][:-1]
    return np.split(order, np.flatnonzero(new))


def _dealt(df: DataFrame, keys: list[str], total_bytes: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-total_bytes // SHARD_BYTES)))).cast("int"))


def _by_group(light: DataFrame, per_group: DataFrame) -> DataFrame:
    """light (node, group) left-joined with columns of some groups. Rows are salted, as one group may hold most of them."""
    salted = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return light.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SALTS)).cast("int")).join(salted, ["group", "salt"], "left").drop("salt")


def _sizes(sets: DataFrame) -> DataFrame:
    """sets with block: those of one group are dealt to so many that each has about BLOCK_BYTES or one set."""
    count = sets.groupBy("group").agg(F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES).cast("int").alias("blocks")).where("blocks > 1")
    dealt = _by_group(sets.select("node", "group"), count).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return sets.join(dealt.select("node", "blocks", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("block")), "node")


def links(sets: DataFrame, least: int = LEAST, keys: DataFrame | None = None) -> DataFrame:
    """a, b: edges that connect the linked sets (node, group, shingles) of each group, and no others.

    keys (key, node): linked sets have one in common, so blocks of a group without a common key need not meet.
    """

    def inside(t: pa.Table) -> pa.Table:
        sets_, node = decode(t.column("shingles")), t.column("node").to_numpy()
        out = [(node[g], node[g[joined([sets_[i] for i in g], least)]], t.column("group").to_numpy()[g], t.column("blocks").to_numpy()[g]) for g in groups(t, ["group", "block"])]
        return pa.table({k: pa.array(np.concatenate(c), kind) for k, c, kind in zip(("a", "b", "group", "blocks"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)})

    edges = None
    level = sets
    while True:
        total = level.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
        blocked = stored(_sizes(level), "blocked")
        found = stored(_dealt(blocked, ["group", "block"], total).groupBy("shard").applyInArrow(inside, "a long, b long, group long, blocks int"), "links")
        edges = found.select("a", "b") if edges is None else edges.union(found.select("a", "b"))
        heads = found.where("blocks > 1 AND a = b").select(F.col("a").alias("node"))
        fewer = blocked.join(heads, "node").select("node", "group", "shingles")
        n, before = (d.count() for d in (fewer, blocked.where("blocks > 1")))
        if not n and level is sets:  # no group was split: all pairs were compared
            return edges.where("a <> b")
        if not n or n == before or n * 2 > before:  # the last ones fit into a block, or few were connected: go on with whole blocks
            break
        level = stored(fewer, "heads")
    return _across(sets, edges, least, keys)


def _across(sets: DataFrame, edges: DataFrame, least: int, keys: DataFrame | None) -> DataFrame:
    """The edges with those between the blocks of groups that are not one component yet.

    Sets outside a group's largest component form blocks of their own, each of which meets the group's blocks that have a key
    in common with it: a group may be large because rare shingles chain it together, but few of its blocks then share one.
    """
    edges = stored(edges.where("a <> b"), "edges")
    known = components(edges)
    labelled = sets.join(known, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    sized = _sizes(labelled.select("node", "group", "shingles", "label"))
    open_ = stored(sized.where("blocks > 1"), "open")
    by_label = open_.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    main = by_label.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("bytes").alias("bytes"))
    rest = by_label.join(main.where("labels > 1").select("group", "main"), "group").where("label <> main").groupBy("group").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("others"))
    plan = main.where("labels > 1").select("group", "main").join(rest, "group")
    todo = open_.join(_by_group(open_.select("node", "group"), plan).where("main IS NOT NULL").drop("group"), "node")
    todo = stored(todo, "todo")
    apart = todo.where("label <> main").withColumn("other", F.pmod(F.xxhash64("node", F.lit(5)), F.col("others")).cast("int"))
    if keys is None:
        right = apart.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:  # keys of blocks and of the others, each once: the pairs of them that must meet
        there = keys.join(todo.select("node", "group", "block"), "node").groupBy("key", "group").agg(F.collect_set("block").alias("there"))
        asked = keys.join(apart.select("node", "group", "other"), "node").select("key", "group", "other").distinct()
        meet = asked.join(there, ["key", "group"]).select("group", "other", F.explode("there").alias("block")).distinct()
        right = apart.drop("block").join(meet, ["group", "other"])
    right = stored(right.select("node", "group", "shingles", "label", "block", "other", F.lit(1).alias("side")), "right")
    left = todo.select("node", "group", "shingles", "label", "block").join(right.select("group", "block", "other").distinct(), ["group", "block"]).select("node", "group", "shingles", "label", "block", "other", F.lit(0).alias("side"))
    pairs = left.unionByName(right)

    def between(t: pa.Table) -> pa.Table:
        sets_, node, side, label = decode(t.column("shingles")), t.column("node").to_numpy(), t.column("side").to_numpy(), t.column("label").to_numpy()
        out = [(node[g], node[g[joined([sets_[i] for i in g], least, side[g], label[g])]]) for g in groups(t, ["group", "block", "other"])]
        return pa.table({k: pa.array(np.concatenate(c), pa.int64()) for k, c in zip(("a", "b"), zip(*out, strict=True), strict=True)})

    total = pairs.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    more = _dealt(pairs, ["group", "block", "other"], total).groupBy("shard").applyInArrow(between, "a long, b long")
    return edges.union(stored(more.where("a <> b"), "across"))


def near_duplicates(docs: DataFrame, least: int = LEAST, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles, component_id (the smallest id reachable by links, its own included).

    Texts that are null or have no words have no shingles and are linked with nothing. Rows that repeat an id are rows of
    their own; a null id takes part, and its component_id is null where no row of the component has an id. Other columns
    are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes = min(MOST_CHUNK, max(LEAST_CHUNK, total // CHUNKS))
    n_chunks = max(1, -(-total // chunk_bytes))
    n_buckets = min(n_chunks, 64 + n_chunks // 4)
    def cut(batches):
        """A row for each text, and one for each distinct set that may have an unequal linked one. Sets go to the chunk of
        their node, so that equal ones meet; texts' rows are dealt by content and by how often it has come up in this task.
        A set's row says nothing of the text it came from, so texts that come in another order make the same rows."""
        seen, times = set(), Counter()
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
        for batch in batches:
            texts, found, held = [], [], 0
            ids = batch.column("id").to_pylist()
            for at in range(0, len(batch), CUT_ROWS):
                for i, x in zip(ids[at : at + CUT_ROWS], shingle_sets(*text_bytes(batch.column("text").slice(at, CUT_ROWS)), size), strict=True):
                    k = node_of(x) if len(x) else None
                    times[i, k] += 1
                    texts.append((zlib.crc32(f"{i} {k} {times[i, k]}".encode()) % n_chunks, i, len(x), k, None))
                    if len(x) * 100 // least > len(x) and k not in seen:
                        seen.add(k)
                        found.append((k % n_chunks, None, None, k, x.astype("<u8").tobytes()))
                        held += 8 * len(x)
                if held > LEAST_CHUNK or at + CUT_ROWS >= len(batch):
                    yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*texts, *found, strict=True), kinds, strict=True)], names=["chunk", "id", "n", "node", "shingles"])
                    texts, found, held = [], [], 0
        tidy()

    def own(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        """The nodes of a chunk in order, and their sets."""
        t = t.filter(pc.is_valid(t.column("shingles"))).combine_chunks()
        node, data = t.column("node").to_numpy(), t.column("shingles").to_pylist()
        order = np.argsort(node, kind="stable").tolist()
        first = [p for p, i in enumerate(order) if not p or node[order[p - 1]] != node[i]]
        if any(data[i] != data[j] for i, j in zip(order, order[1:]) if node[i] == node[j]):  # noqa: B905, RUF007
            raise ValueError("two different sets have one digest")
        return node[[order[p] for p in first]], [np.frombuffer(data[order[p]], "<u8") for p in first]

    def dealt(sets: list[np.ndarray]):
        """Distinct shingles, the place among them of each shingle of each set, their numbers, and their buckets."""
        values, place, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        return values, place, count, *by_bucket(values, 40, n_buckets)

    def send(t: pa.Table) -> pa.Table:
        values, _, count, order, buckets = dealt(own(t)[1])
        low, n = (values & _LOW)[order].astype("<u4"), np.minimum(count[order], 255).astype(np.uint8)
        out = rows([(b, t.column("chunk")[0].as_py(), low[i:j].tobytes() + n[i:j].tobytes()) for b, i, j in buckets], "bucket", "chunk")
        tidy()
        return out

    def answer(t: pa.Table) -> pa.Table:
        """For each shingle sent how often it occurs, in eighths of a doubling: 0 if once."""
        parts = [np.frombuffer(x, np.uint8) for x in t.column("data").to_pylist()]
        number = [len(p) // 5 for p in parts]
        low, place = np.unique(np.concatenate([p[: 4 * n].view("<u4") for p, n in zip(parts, number, strict=True)]), return_inverse=True)
        total = np.bincount(place, np.concatenate([p[4 * n :] for p, n in zip(parts, number, strict=True)]), len(low))
        rank = np.minimum(255, np.log2(total) * 8).astype(np.uint8)[place]
        at = np.cumsum([0, *number])
        b = t.column("bucket")[0].as_py()
        told = ((c, rank[i:j]) for c, i, j in zip(t.column("chunk").to_pylist(), at[:-1], at[1:], strict=True))
        out = rows([(c, b, np.packbits(x > 0).tobytes() + x[x > 0].tobytes()) for c, x in told], "chunk", "bucket")
        tidy()
        return out

    def candidates(t: pa.Table, r: pa.Table) -> pa.Table:
        """The texts' rows, the sets that have a key, and their keys."""
        node, sets = own(t)
        values, place, _, order, buckets = dealt(sets)
        told = dict(zip(r.column("bucket").to_pylist(), r.column("data").to_pylist(), strict=True))
        rank = np.zeros(len(values), np.uint8)
        for b, i, j in buckets:
            data, half = np.frombuffer(told[b], np.uint8), (j - i + 7) // 8
            rank[order[i:j][np.unpackbits(data[:half], count=j - i) > 0]] = data[half:]
        at = np.cumsum([0, *map(len, sets)])
        key, doc = prefixes(sets, [rank[place[i:j]] for i, j in zip(at[:-1], at[1:], strict=True)], least)
        kept = np.unique(doc)
        texts = t.filter(pc.is_valid(t.column("n"))).select(["id", "n", "node"])

        def part(**known) -> pa.Table:
            length = max(map(len, known.values()))
            return pa.table({k: known.get(k, pa.nulls(length, kind)) for k, kind in FOUND})

        out = pa.concat_tables([part(**{k: texts.column(k) for k in texts.column_names}), part(node=pa.array(node[kept], pa.int64()), shingles=pa.array([sets[i].tobytes() for i in kept], pa.binary())), part(node=pa.array(node[doc], pa.int64()), key=pa.array(key.view(np.int64), pa.int64()))])
        tidy()
        return out

    base = base.mapInArrow(cut, "chunk int, id long, n long, node long, shingles binary")
    sent = base.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, data binary")
    told = sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, data binary")
    found = stored(base.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(candidates, "id long, n long, node long, shingles binary, key long"), "candidates")
    nodes = found.where("n IS NOT NULL").select("id", "n", "node")
    keys = found.where("key IS NOT NULL").select("key", "node")
    heads = keys.groupBy("key").agg(F.min("node").alias("near"), F.max("node").alias("last")).where("near <> last").select("key", "near")
    group = components(keys.join(heads, "key").where("node <> near").select(F.col("node").alias("a"), F.col("near").alias("b")))
    sets = stored(found.where("shingles IS NOT NULL").select("node", "shingles").join(group.withColumnRenamed("root", "group"), "node"), "sets")
    linked = components(links(sets, least, keys))
    # sets to components, then components to their smallest ids
    of = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id")).join(linked, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least_id = of.groupBy("root").agg(F.min("id").alias("component_id"))
    known = of.select("node", "root").join(least_id, "root").select("node", "component_id")
    return nodes.join(known, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

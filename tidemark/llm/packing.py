"""Best-fit packing with exact complements.

How documents are packed depends only on how many pieces there are of each length, so the plan is made from a histogram
of at most `capacity` entries, whatever the input's size. A bin starts with the longest piece left; its gap is filled
exactly by one, two or three lengths if an index of their sums has such a combination that is still available, else it
takes the longest piece that fits (best fit) and asks again. A pattern is used as often as its lengths last, so each
step uses up a length. Pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, tidy

#: Distinct pre-tokens that a worker remembers: half of them the latest, half those before. Longer ones are not remembered.
CACHE, CACHED_LENGTH = 400_000, 64
CAPACITY, END_ID = 4096, 1
#: Letters and numbers of the Latin blocks up to U+017F, and the tokenizer's pattern over them. On these
#: characters Python's lower() does just what its normaliser (NFC, white space, lower case) does; a text with any other
#: character, or what may be a special token, goes to the library whole.
LETTERS, NUMBERS = r"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PATTERN = rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u017f]|<\\|")


class Tokens:
    """A text's ids as little-endian bytes: those of its pre-tokens, each looked up once.

    New pre-tokens are encoded many at a time with spaces between; each ends with the one id whose piece ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.find = re.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        if not parts:
            return {}
        texts = [" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        data, cut = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(cut) != len(parts) + 1:
            raise ValueError("a pre-token's ids do not end with a word's end")
        return {w: data[a:b] for w, a, b in zip(parts, cut[:-1], cut[1:], strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _OTHER.search(t) else self.find(t.lower()) for t in texts]
        new = set().union(*(s for s in split if s)) - self.known.keys()
        if back := new & self.older.keys():
            self.known.update({w: self.older[w] for w in back})
            new -= back
        long = [w for w in new if len(w) > CACHED_LENGTH]
        self.known.update(self.learn([w for w in new if len(w) <= CACHED_LENGTH]))
        known = {**self.known, **self.learn(long)} if long else self.known
        if len(self.known) > CACHE // 2:
            self.known, self.older = {}, self.known
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if s is None else b"".join(map(known.__getitem__, s)) for t, s in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32 of every document's ids followed by end_id, cut each `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, width = _tokens(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            at, piece, length, crc = [], [], [], []
            for i, ids in enumerate(tokens.encode([text.as_py() or "" for text in batch.column(1)])):
                ids += end
                for j, a in enumerate(range(0, len(ids), width)):
                    part = ids[a : a + width]
                    at.append(i)
                    piece.append(j)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array([j * capacity for j in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Sums of one, two and three lengths, each with the combinations that make it, the longest first.

    The combinations of a sum are indexed when it is first asked for. Pieces are only ever used up, so a combination that
    was found wanting is taken off its list for good, and all lookups together pass each combination once.
    """

    def __init__(self, free: np.ndarray):
        self.free = free  # pieces left of each length; whoever uses pieces counts them down here
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def left(self, *lengths: int) -> bool:
        return all(self.free[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, *used: int) -> tuple[int, int] | None:
        """Two lengths of this sum that are left when `used` are taken."""
        if total not in self.pairs:
            longer = np.arange((total + 1) // 2, total)
            self.pairs[total] = longer[(self.free[longer] > 0) & (self.free[total - longer] > 0)].tolist()
        known = self.pairs[total]
        while known and not self.left(known[-1], total - known[-1]):
            known.pop()
        return next(((a, total - a) for a in reversed(known) if self.left(a, total - a, *used)), None)

    def triple(self, total: int) -> tuple[int, int, int] | None:
        if total not in self.triples:
            longest = np.arange(-(-total // 3), max(total - 1, 0))
            self.triples[total] = longest[self.free[longest] > 0].tolist()
        known = self.triples[total]
        while known:
            a = known[-1]
            if self.free[a] and (rest := self.pair(total - a, a)):
                return a, *rest
            known.pop()
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are left and fill a gap of this size."""
        return (total,) if self.free[total] else self.pair(total) or self.triple(total)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins), using every piece once."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out, sums = [], Sums(free)
    top = capacity
    while True:
        while top and not free[top]:
            top -= 1
        if not top:
            return out
        bin_, gap = [top], capacity - top
        free[top] -= 1
        while gap:
            if found := sums.exact(gap):
                take = list(found)
            else:
                fits = np.flatnonzero(free[1 : gap + 1])
                if not len(fits):
                    break
                take = [int(fits[-1]) + 1]
            for x in take:
                free[x] -= 1
            bin_ += take
            gap -= sum(take)
        used = Counter(bin_)
        more = min(int(free[x]) // n for x, n in used.items())
        for x, n in used.items():
            free[x] -= more * n
        out.append((tuple(bin_), 1 + more))


def slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, place among that pattern's equal lengths' stride, offset).

    Ranks first..last of a length go to sequences first_sequence, first_sequence + 1, ... at one offset.
    """
    out, taken, sequence = [], Counter(), 0
    for lengths, n in bins:
        at = 0
        for x in lengths:
            out.append((x, taken[x], taken[x] + n, sequence, n, at))
            taken[x] += n
            at += x
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to capacity; no row is lost, whatever repeats.

    Only the histogram of lengths comes to the driver (at most `capacity` rows). A rank within a length is a rank within
    one of its salted parts plus the sizes of the parts before it, so a length that most rows have is still dealt out.
    """
    spark = pieces.sparkSession
    cols = pieces.columns
    parted = pieces.withColumn("__part", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    sizes = parted.groupBy("length", "__part").count()
    found = sizes.collect()  # at most capacity * salts rows
    total: Counter = Counter()
    base = []
    for length, part, n in sorted(tuple(r) for r in found):
        base.append((length, part, total[length]))
        total[length] += n
    placed = slots(plan(dict(total), capacity))
    by_length: dict[int, list] = {}
    for s in placed:
        by_length.setdefault(s[0], []).append(s[1:])
    table_ = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for k, v in by_length.items()}
    first = {(a, b): c for a, b, c in base}
    known = spark.sparkContext.broadcast((table_, first))  # at most a few entries for each length and part
    ranked = parted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__part").orderBy(*cols)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start = known.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            part = batch.column("__part").to_numpy()
            rank = batch.column("__rank").to_numpy().astype(np.int64)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.lexsort((part, length))
            x, p = length[order], part[order]
            edge = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (p[1:] != p[:-1]), True]) if len(order) else []
            for i, j in zip(edge[:-1], edge[1:], strict=True):  # one length and part after the other
                lo, _, seq, _, off = at[int(x[i])]
                r = rank[order[i:j]] + start[int(x[i]), int(p[i])]
                k = np.searchsorted(lo, r, "right") - 1
                sequence[order[i:j]], offset[order[i:j]] = seq[k] + r - lo[k], off[k]
            yield pa.record_batch([*(batch.column(c) for c in cols), pa.array(sequence), pa.array(offset)], names=[*cols, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one id. Repeated rows are packed as often as they occur, also under null ids;
    an empty table gives no rows; other columns are ignored.
    """
    return pack(stored(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

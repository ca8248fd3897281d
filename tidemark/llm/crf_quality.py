"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own counts (kinds of characters, repeated words, whether the line occurred
before) and those of its neighbours; a transition matrix ties neighbouring labels. Forward-backward marginals, weighted by
the lines' lengths, give the share of a document that is bad, and a logistic curve fitted on labelled documents turns
that into a score. Only documents are labelled, so lines of bad ones are relabelled by the model between fits.

Long texts are taken in slices: features need a line's neighbours and what was read before, and messages pass from block to
block of lines as products of two-by-two matrices, so a text of any length has the marginals of one chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, text_bytes, word_hashes, words
from .labelled import sample
from .toxicity import fit_logistic

#: Bounds of the sample: documents of each class, bytes of a text, and lines in all.
CLASS_ROWS, TEXT_BYTES, SAMPLE_LINES = 1500, 32768, 300_000
#: Bytes of text whose features are made at once; bytes of a line, longer ones are cut into several.
STEP, LINE_BYTES = 1 << 20, 1 << 16
#: Lines of a block, through which messages pass step by step.
BLOCK = 256
_UPPER, _LOWER, _HIGH, _DIGIT, _SPACE, _MARK, _PIPE = range(7)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = _UPPER, _LOWER, _HIGH, _DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 7  # usual punctuation
_KIND[ord("|")] = _PIPE
OWN = 12


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty lines of each text, and the texts' offsets into them."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    breaks = np.flatnonzero(buf == 10)
    cut[breaks] = True
    cut[breaks + 1] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    keep = buf[starts] != 10 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    parts = -(-(ends - starts) // LINE_BYTES)
    if len(parts) and parts.max() > 1:
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + inner * LINE_BYTES, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + LINE_BYTES)
    return starts, ends, np.searchsorted(starts, off)


def features(buf: np.ndarray, off: np.ndarray, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each line, the lines' lengths, and the texts' offsets into the lines.

    earlier: hashes of lines that count as read before, in order.
    """
    starts, ends, at = lines(buf, off)
    n = len(starts)
    if not n:
        return np.zeros((0, 3 * OWN)), np.zeros(0), at
    kinds = _KIND[buf]
    bounds = np.c_[starts, ends].ravel()
    bounds = bounds[:-1] if bounds[-1] == len(buf) else bounds
    count = lambda k: np.add.reduceat((kinds == k).view(np.uint8), bounds, dtype=np.int64)[::2]
    size = (ends - starts).astype(float)
    upper, lower, high, digit, mark, pipe = (count(k) for k in (_UPPER, _LOWER, _HIGH, _DIGIT, _MARK, _PIPE))
    letters = np.maximum(upper + lower + high, 1)
    w_start, w_end, _ = words(buf, np.r_[0, starts, len(buf)])  # a word ends where its line is cut
    hashes = word_hashes(buf, w_start, w_end)
    line = np.searchsorted(starts, w_start, "right") - 1
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    n_words = np.bincount(line, minlength=n).astype(float)
    again = np.bincount(line, same, minlength=n) / np.maximum(n_words - 1, 1)
    key = word_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    order = np.lexsort((np.arange(n), key, doc))
    seen = np.zeros(n)
    twin = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    seen[order[1:]] = twin
    if earlier is not None and len(earlier):
        seen[earlier[np.minimum(np.searchsorted(earlier, key), len(earlier) - 1)] == key] = 1
    own = np.stack(
        [
            upper / letters, upper > 0.5 * letters, np.minimum(1, 10 * mark / size), mark > 0.05 * size, np.minimum(1, 20 * pipe / size), again, again > 0.25,
            seen * np.minimum(1, size / 20), np.minimum(1, 4 * digit / size), np.minimum(1, size / 40), np.log1p(size) / 10, np.minimum(1, n_words / np.maximum(size, 1) * 3),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first, last = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after], axis=1), size, at


def chains(at: np.ndarray) -> list[np.ndarray]:
    """For each step t, the places of the texts' t-th lines; texts by falling number of lines."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    start, n = at[:-1][order], n[order]
    live = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")
    return [start[:a] + t for t, a in enumerate(live)]


class Crf:
    """Weights of the features (last: the constant) for the label bad, and exp of the transitions from row to column."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(x @ self.weights[:-1] + self.weights[-1], -20, 20))

    def passes(self, u: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages of every line, each as the ratio of bad to good."""
        (gg, gb), (bg, bb) = self.transitions
        forward, backward = np.ones_like(u), np.ones_like(u)
        for t, at in enumerate(steps):
            if t:
                r = forward[at - 1]
                forward[at] = u[at] * (gb + r * bb) / (gg + r * bg)
            else:
                forward[at] = u[at]
        for at in reversed(steps[1:]):
            r = u[at] * backward[at]
            backward[at - 1] = (bg + r * bb) / (gg + r * gb)
        return forward, backward

    def ratios(self, u: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of every line the ratio of bad to good, given all lines of its text.

        The backward messages, with the line's own odds, are the forward ones of the reversed text under the transposed
        transitions; both hold the line's own odds, which count once.
        """
        back = messages(u[::-1], len(u) - at[::-1], self.transitions.T)[::-1]
        return messages(u, at, self.transitions) * back / u

    def marginals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = self.ratios(self.odds(x), at)
        return r / (1 + r)

    def line_odds(self, buf: np.ndarray, off: np.ndarray, step: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's own odds, the lines' lengths, and the texts' offsets into the lines; a long text goes slice by slice."""
        step = STEP if step is None else step
        if len(buf) <= step or len(off) > 2:
            x, size, at = features(buf, off)
            return self.odds(x), size, at
        starts, ends, at = lines(buf, off)
        cut = np.flatnonzero(np.r_[True, np.diff((starts - off[0]) // step) > 0, True])  # the first line of each slice
        odds, earlier = [], np.zeros(0, np.uint64)
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            a, b = max(i - 1, 0), min(j + 1, len(starts))  # with a neighbour on either side
            # a neighbour's own features need what came before it: the one in front has it in `earlier` without itself
            part, local = buf[starts[a] : ends[b - 1]], np.array([0, ends[b - 1] - starts[a]])
            x, _, _ = features(part, local, earlier)
            odds.append(self.odds(x[i - a : len(x) - (b - j)]))
            before = slice(i - 1 if i else 0, j - 1)  # the slice's last line is the next one's neighbour
            earlier = np.union1d(earlier, word_hashes(buf, starts[before], ends[before]))
        return np.concatenate(odds), (ends - starts).astype(float), at


def messages(u: np.ndarray, at: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Forward messages with each line's own odds u, as ratios of bad to good; text i has lines at[i] to at[i + 1].

    A step maps a ratio r to u * (gb + r * bb) / (gg + r * bg), so a block of steps is a product of matrices. All blocks
    are walked together, first for their products, which carry the ratios from block to block, then for every line.
    """
    (gg, gb), (bg, bb) = transitions
    n = np.diff(at)
    parts = -(-n // block)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at[:-1], parts) + number * block
    size = np.minimum(np.repeat(at[1:], parts) - start, block)
    enter = np.ones(len(start))
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    if (number > 0).any():
        m = np.zeros((4, len(start)))
        m[0] = m[3] = 1
        for t, k in enumerate(live):
            i = order[:k]
            v = u[start[i] + t]
            first = (number[i] == 0) if t == 0 else np.zeros(k, bool)  # a text's first line hears nothing
            p, q = np.where(first, 0, v * bb), np.where(first, v, v * gb)
            r, s = np.where(first, 0, bg), np.where(first, 1, gg)
            a, b, c, d = m[:, i]
            new = np.stack([p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d])
            m[:, i] = new / new.max(axis=0)
        ratio = 1.0
        for j, (k, (a, b, c, d)) in enumerate(zip(number.tolist(), m.T.tolist(), strict=True)):
            enter[j] = ratio
            ratio = (a * ratio + b) / (c * ratio + d) if k else b / d
    out = np.empty(len(u))
    for t, k in enumerate(live):
        i = order[:k]
        v = u[start[i] + t]
        r = enter[i]
        r = v * (gb + r * bb) / (gg + r * bg)
        if t == 0:
            r = np.where(number[i] == 0, v, r)
        out[start[i] + t] = r
        enter[i] = r
    return out


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient steps (Adam)."""
    steps = chains(at)
    later = np.concatenate([np.zeros(0, int), *steps[1:]])
    z = np.c_[x, np.ones(len(x))]
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        crf = Crf(theta[:-4], np.exp(theta[-4:].reshape(2, 2)))
        u = crf.odds(x)
        forward, backward = crf.passes(u, steps)
        r = forward * backward
        grad = np.r_[z.T @ (y - r / (1 + r)), np.zeros(4)] / len(y)
        if len(later):
            f, b = forward[later - 1], u[later] * backward[later]
            joint = np.stack([np.ones_like(f), b, f, f * b], axis=1) * crf.transitions.ravel()
            joint /= joint.sum(axis=1, keepdims=True)
            pair = (2 * y[later - 1] + y[later]).astype(int)
            grad[-4:] = (np.bincount(pair, minlength=4) - joint.sum(axis=0)) / len(y)
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -4, 4)
    return Crf(theta[:-4], np.exp(theta[-4:].reshape(2, 2)))


def shares(p: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length-weighted means of the lines' marginals for each text; 0 for a text without lines."""
    total = np.r_[0.0, np.cumsum(p * size)]
    weight = np.r_[0.0, np.cumsum(size)]
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(weight[at[1:]] - weight[at[:-1]], 1e-9)


def evidence(share: np.ndarray) -> np.ndarray:
    return np.c_[share, np.log(share + 0.01) - np.log(0.01)]


class Model:
    def __init__(self, crf: Crf | None, logit: np.ndarray):
        self.crf, self.logit = crf, logit

    def score(self, column: pa.Array) -> np.ndarray:
        """The probability that each text is good."""
        buf, off = text_bytes(column)
        out, a = [], 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(off, off[a] + STEP, "right")) - 1)
            part, cut = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            if self.crf is None:
                share = np.zeros(b - a)
            else:
                u, size, at = self.crf.line_odds(part, cut)
                r = self.crf.ratios(u, at)
                share = shares(r / (1 + r), size, at)
            out.append(1 / (1 + np.exp(np.clip(self.logit[0] + evidence(share) @ self.logit[1:], -30, 30))))
            a = b
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, text_bytes_: int = TEXT_BYTES, sample_lines: int = SAMPLE_LINES) -> Model:
    """Learns from a bounded sample; with one class only, every text gets that class's share."""
    rows = sample(docs, labels, "quality", {1: class_rows, 0: class_rows}, text_bytes_).orderBy(F.xxhash64("doc_id"), "text").collect()
    known = labels.where(~held_out("doc_id")).agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).first()
    bad = np.array([1.0 - r.y for r in rows])
    if not len(bad) or bad.min() == bad.max():
        p = (known[0] + 0.5) / (known[0] + known[1] + 1)
        return Model(None, np.array([np.log(p / (1 - p)), 0.0, 0.0]))
    buf, off = text_bytes(pa.array([r.text for r in rows], pa.string()))
    fits = int(np.searchsorted(lines(buf, off)[2][1:], sample_lines, "right"))  # texts before the bound of lines
    if 0 < bad[:fits].sum() < fits < len(bad):
        bad, off = bad[:fits], off[: fits + 1]
        buf = buf[: off[-1]]
    x, size, at = features(buf, off)
    doc = np.repeat(np.arange(len(bad)), np.diff(at))
    y = bad[doc]
    crf = train(x, at, y)
    for _ in range(2):
        p = crf.marginals(x, at)
        # a bad document keeps its worst line, and all that look bad
        worst = np.full(len(bad), -1.0)
        np.maximum.at(worst, doc, p)
        y = ((p >= 0.5) | (p >= worst[doc])) * bad[doc]
        crf = train(x, at, y)
    share = shares(crf.marginals(x, at), size, at)
    w = fit_logistic(evidence(share), bad)
    # the sample has classes of about one size: back to the proportions of all labels
    shift = np.log((known[0] + 0.5) / (known[1] + 0.5)) - np.log(bad.sum() / (1 - bad).sum())
    return Model(crf, np.r_[w[0] + shift, w[1:]])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs' columns with score (0 to 1, higher: better) and predicted.

    A null or empty text has no bad line and scores as a clean one; texts may be of any length. Repeated rows each keep
    their own; a column named like one of these is replaced; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(known.value.score(pa.array(texts, pa.string(), from_pandas=True)))

    return docs.withColumn("score", judged(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

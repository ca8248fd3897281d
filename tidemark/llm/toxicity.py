"""Toxic passages as maximum-scoring segments.

A token's score is its signed log-odds of toxic against clean documents under an informative Dirichlet prior: as it is for
words and prefixes that speak clearly for toxic texts (a prefix stands for words not seen, whose ending is new), else shrunk by
its standard error, less a drift; a token of which nothing is known has the drift alone. A
linear scan (Ruzzo and Tompa) finds every maximal segment. Segments of clean texts follow an extreme-value law: one of
score s in a text of n tokens is expected K * n * exp(-rate * s) times by chance. A document's segments are aggregated
by the sum statistics of that law, whose surprise a logistic curve turns into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .labelled import sample

#: Bounds of the sample: documents of each class, and bytes of a text.
TOXIC_ROWS, CLEAN_ROWS, TEXT_BYTES = 4000, 20000, 32768
#: Prefixes that stand for a word, the least documents of a feature (toxic ones, or clean ones for a word of clean texts only),
#: the least z-score and log-odds of what speaks clearly for toxic texts.
PREFIXES, LEAST_DOCS, LEAST_CLEAN, LEAST_Z, LEAST_ODDS = (4, 5, 6, 7, 8), 3, 20, 3.0, 2.0
#: Drift of tokens that do not speak clearly, and what they fall by at least; bound of the log-odds, squared z-score at which
#: log-odds count half, expectation of a significant passage.
DRIFT, LEAST_FALL, TOP, HALF, SIGNIFICANT = -1.0, -0.2, 6.0, 1.0, 0.05
CACHE = 200_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¡¿–—"


def tokens(text: str) -> list[str]:
    return text.lower().split()


def features(token: str) -> list[str]:
    """The bare word, marked, and its proper prefixes."""
    word = token.strip(_EDGE)
    return [word + "\0", *(word[:n] for n in PREFIXES if len(word) > n)] if word else []


def distinct_texts(texts: list[str]) -> list[str]:
    """Drops near copies: those that share most of their eight smallest word hashes with an earlier text."""
    import zlib

    seen: dict[int, set[int]] = {}
    out = []
    for i, text in enumerate(texts):
        sketch = sorted({zlib.crc32(w.encode()) for w in tokens(text)})[:8]
        near = Counter(j for h in sketch for j in seen.get(h, ()))
        if near and max(near.values()) * 2 > len(sketch):
            continue
        for h in sketch:
            seen.setdefault(h, set()).add(i)
        out.append(text)
    return out


def document_features(text: str) -> set[str]:
    return {f for t in set(tokens(text)) for f in features(t)}


def productive(names: list[str], texts: list[str]) -> set[str]:
    """Words, and those prefixes that no single word accounts for: others say nothing of words not seen yet."""
    within: dict[str, Counter] = {f: Counter() for f in names}
    for text in texts:
        for whole, *prefixes in filter(None, map(features, set(tokens(text)))):
            for f in prefixes:
                if f in within:
                    within[f][whole] += 1
    return {f for f, n in within.items() if f.endswith("\0") or 2 * max(n.values()) <= sum(n.values())}


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratios and their z-scores; the prior is `prior` documents of each class in the corpus's own proportions."""
    share = (toxic + clean + 0.5) / (n_toxic + n_clean + 1)
    a, b = toxic + prior * share, clean + prior * share
    delta = np.log(a / (n_toxic + prior - a)) - np.log(b / (n_clean + prior - b))
    return delta, delta / np.sqrt(1 / a + 1 / b)


class Scorer(dict):
    """Token -> score, remembered up to CACHE tokens."""

    def __init__(self, weights: dict[str, tuple[float, float]]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        known = [w for f in features(token) if (w := self.weights.get(f))]
        out = max(known)[1] if known else DRIFT  # the best-supported: a word's own, unless a prefix says more
        if len(self) >= CACHE:
            self.clear()
        self[token] = out
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of every maximal-scoring segment, in linear time.

    Runs of equal sign are taken together. The list holds candidates with the running sums before and after them; a new
    one is joined with the latest candidate whose left sum is smaller, if the right sum there isn't higher.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.r_[0.0, np.cumsum(scores)]
    cut = np.flatnonzero(np.diff(up) > 1)
    starts, ends = up[np.r_[0, cut + 1]], up[np.r_[cut, len(up) - 1]] + 1
    held: list[list] = []  # start, end, left sum, right sum, latest earlier one with a smaller left sum
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        now = [s, e, total[s], total[e], -1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= now[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= now[3]:
                now[4] = j
                held.append(now)
                break
            now[0], now[2] = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, float(r - left)) for s, e, left, r, _ in held]


def chance_law(scores: np.ndarray, n_tokens: float, least: float) -> tuple[float, float]:
    """Rate and K of the tail K * exp(-rate * s) that clean text's segments have a token, by maximum likelihood above
    `least`; one segment a unit above it is added, so that few or none still give a law."""
    tail = scores[scores >= least]
    rate = float(np.clip((len(tail) + 1) / ((tail - least).sum() + 1), 0.3, 3.0))
    return rate, float((len(tail) + 1) / max(n_tokens, 1.0) * np.exp(rate * least))


def surprise(e: np.ndarray) -> float:
    """-log of the chance that the best r of a text's segments would come together, for the most surprising r.

    Karlin and Altschul's sum statistics: with t the sum of -log e, that chance is near exp(-t) t^(r-1) / (r! (r-1)!).
    """
    if not len(e):
        return 0.0
    t = np.cumsum(np.sort(-np.log(np.maximum(e, 1e-30)))[::-1])
    r = np.arange(1, len(t) + 1)
    logs = np.cumsum(np.log(r))
    value = t - (r - 1) * np.log(np.maximum(t, 1.0)) + logs + np.r_[0.0, logs[:-1]]
    return float(max(0.0, value[t > 0].max(initial=0.0)))


class Model:
    """Weights of features, the extreme-value law, and a logistic calibration."""

    def __init__(self, weights: dict[str, tuple[float, float]], rate: float = 1.0, k: float = 0.1, logit: tuple[float, float, float] = (-4.0, 0.5, 0.5)):
        self.weights, self.rate, self.k, self.logit = weights, rate, k, logit

    def segments(self, text: str, scorer: Scorer | None = None) -> list[tuple[int, int, float, float]]:
        """(first token, end token, score, expectation by chance) of every maximal segment."""
        scorer = Scorer(self.weights) if scorer is None else scorer
        words = tokens(text)
        scores = np.fromiter(map(scorer.__getitem__, words), np.float64, len(words))
        n = self.k * max(len(words), 1)
        return [(s, e, x, n * float(np.exp(-self.rate * x))) for s, e, x in maximal_segments(scores)]

    def judge(self, text: str, scorer: Scorer) -> tuple[float, float, int]:
        """Surprise of all segments and of the best one, and the number of significant ones."""
        e = np.array([x[3] for x in self.segments(text, scorer)])
        best = -np.log(max(e.min(), 1e-30)) if len(e) else 0.0
        return min(surprise(e), 40.0), min(max(best, 0.0), 40.0), int((e <= SIGNIFICANT).sum())

    def probability(self, together: float, best: float) -> float:
        a, b, c = self.logit
        return float(1 / (1 + np.exp(-(a + b * together + c * best))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of (1, x) by Newton steps with a small ridge; slopes are kept from going negative."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, text_bytes: int = TEXT_BYTES) -> Model:
    """Learns from a bounded sample. Without toxic samples every text gets the model's low default."""
    spark = docs.sparkSession
    taken = sample(docs, labels, "toxic", {1: toxic_rows, 0: clean_rows}, text_bytes)
    texts = distinct_texts([r.text for r in taken.where("y = 1").orderBy(F.xxhash64("doc_id"), "text").collect()])
    if not texts:
        return Model({})
    # a third of either class is kept for the calibration, so that it sees features it did not help to find
    learn, rest = [t for i, t in enumerate(texts) if i % 3], texts[::3]
    toxic = Counter(f for t in learn for f in document_features(t))
    names = sorted(f for f, n in toxic.items() if n >= min(LEAST_DOCS, len(learn)))
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # bounded by the sample
    clean = taken.where("y = 0")
    learnt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) != 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many clean texts each feature is, by its place, and each other word, by itself; their number at -1."""
        at, n, rows, others = place.value, np.zeros(len(place.value), np.int64), 0, Counter()
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                found = document_features(text.as_py())
                for i in {at[f] for f in found if f in at}:
                    n[i] += 1
                others.update(f for f in found if f.endswith("\0") and f not in at)
        here = np.flatnonzero(n)
        words = list(others)
        yield pa.record_batch([pa.array([*here.tolist(), -1, *[None] * len(words)], pa.int64()), pa.array([None] * (len(here) + 1) + words, pa.string()), pa.array([*n[here].tolist(), rows, *(others[w] for w in words)], pa.int64())], names=["i", "f", "n"])

    counts = clean.where(learnt).select("text").mapInArrow(count, "i long, f string, n long").groupBy("i", "f").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("i").isNotNull() | (F.col("n") >= LEAST_CLEAN)).collect()  # bounded by the sample's words
    counted = {r.i: r.n for r in found if r.i is not None}
    only_clean = {r.f: r.n for r in found if r.i is None}
    n_clean = max(1, counted.pop(-1, 0))
    names += sorted(only_clean)
    a = np.array([toxic.get(f, 0) for f in names], float)
    b = np.array([counted.get(i, 0) if f not in only_clean else only_clean[f] for i, f in enumerate(names)], float)
    odds, z = log_odds(a, b, len(learn), n_clean)
    odds = np.clip(odds, -TOP, TOP)
    clear = np.flatnonzero((z >= LEAST_Z) & (odds >= LEAST_ODDS))
    kept = productive([names[i] for i in clear], learn)
    # what doesn't speak clearly is shrunk by its standard error and drifts down, clean-leaning words more than others
    own = np.minimum(DRIFT + odds * z**2 / (z**2 + HALF), LEAST_FALL)
    model = Model({f: (float(z[i]), float(odds[i] if f in kept else own[i])) for i, f in enumerate(names) if f in kept or f.endswith("\0")})
    known = spark.sparkContext.broadcast(model.weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known.value)
        for batch in batches:
            found = [(len(w := tokens(t.as_py())), [x for *_, x in maximal_segments(np.fromiter(map(scorer.__getitem__, w), np.float64, len(w)))]) for t in batch.column(0)]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["n", "scores"])

    # the law of chance: from clean texts that did not help to find the features
    seen = clean.where(~learnt).select("text").mapInArrow(measure, "n long, scores array<double>").toPandas()
    scores = np.array([x for row in seen.scores for x in row], float)
    model.rate, model.k = chance_law(scores, float(seen.n.sum()), LEAST_ODDS)
    scorer = Scorer(model.weights)
    ones = np.array([model.judge(t, scorer)[:2] for t in rest]).reshape(-1, 2)
    zeros = []
    for n, row in zip(seen.n, seen.scores, strict=True):
        e = model.k * max(n, 1) * np.exp(-model.rate * np.array(row, float))
        zeros.append((min(surprise(e), 40.0), min(max(-np.log(max(e.min(), 1e-30)), 0.0), 40.0) if len(e) else 0.0))
    x = np.r_[ones, np.array(zeros, float).reshape(-1, 2)]
    w = fit_logistic(x, np.r_[np.ones(len(ones)), np.zeros(len(zeros))])
    model.logit = tuple(float(v) for v in w)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns with score (0 to 1), predicted and n_passages; a null or empty text has no passages.

    Every row gets its own, repeated ones too. A column named like one of these is replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score double, n_passages int>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = known.value
        scorer = Scorer(model.weights)
        for texts in batches:
            out = []
            for text in texts:
                together, best, n = model.judge(text or "", scorer)
                out.append((model.probability(together, best), n))
            yield pd.DataFrame(out, columns=["score", "n_passages"])

    # the input's columns travel as one, so that none of theirs is replaced but the three results
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("score", "n_passages", "predicted")))
    out = docs.select(kept.alias("row"), judged(F.col(f"`{text_col}`")).alias("judged"))
    return out.select("row.*", "judged.score", "judged.n_passages", (F.col("judged.score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_passages")

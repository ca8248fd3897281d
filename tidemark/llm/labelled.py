"""A bounded sample of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], most_bytes: int) -> DataFrame:
    """doc_id, text, y of at most rows[y] documents a class: of those that may be learnt from, the ones with the smallest hashes of their ids.

    Never rows that are held out, nor texts of more than most_bytes; null texts are empty. Labels of other ids take no
    place in the sample, however many there are. An id whose labels contradict each other is left out; of the texts that
    repeat an id the first in order is taken, so the sample has at most sum(rows.values()) rows of most_bytes. Those
    ids are broadcast, and the sample is written.
    """
    known = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("most")).where("y = most").drop("most")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    known = stored(known.where(F.col("y").isin(list(rows))).join(texts.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    taken = None
    for y, n in rows.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        taken = part if taken is None else taken.unionByName(part)
    return stored(texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "sample")

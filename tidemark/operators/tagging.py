"""Tags and their assignments: look-ups, lists, find-or-create, assignment to many targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import slugify

from .site import assign


def by_slug(tags: DataFrame, slug: str) -> DataFrame:
    """The tag (tag_id, slug, label) of a slug; one row at most."""
    return tags.where(F.col("slug") == slug).orderBy("tag_id").limit(1)


def by_label(tags: DataFrame) -> DataFrame:
    """All tags in the order of their labels."""
    return tags.orderBy("label", "tag_id")


def of_targets(tags: DataFrame, assignments: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """target_id, tags: slug and label of each target's tags, by label. targets: only these (target_id)."""
    chosen = assignments if targets is None else assignments.join(targets.select("target_id").distinct(), "target_id", "left_semi")
    each = chosen.join(tags.select("tag_id", "slug", "label"), "tag_id")
    by = F.sort_array(F.collect_list(F.struct("label", "slug")))
    return each.groupBy("target_id").agg(F.transform(by, lambda x: F.struct(x["slug"].alias("slug"), x["label"].alias("label"))).alias("tags"))


def slugs_of(tags: DataFrame, assignments: DataFrame, target) -> DataFrame:
    """The slugs of one target, by label."""
    return assignments.where(F.col("target_id") == target).join(tags, "tag_id").orderBy("label", "slug").select("slug")


def targets_of(assignments: DataFrame, tag_id) -> DataFrame:
    """target_type, target_id of one tag, by both."""
    return assignments.where(F.col("tag_id") == tag_id).select("target_type", "target_id").distinct().orderBy("target_type", "target_id")


def ensured(tags: DataFrame, labels: DataFrame) -> DataFrame:
    """tags with a tag for each label (label, and color if there is one) whose slug none has yet.

    New ids follow the largest one in the order of the slugs; of labels with one slug the first in order names it; a label
    without letters and digits makes no tag. New tags are few, so ranking them in one task costs nothing.
    """
    named = labels.select(F.trim("label").alias("label")).withColumn("slug", slugify(F.col("label"))).where("slug <> ''").groupBy("slug").agg(F.min("label").alias("label"))
    new = named.join(tags.select("slug"), "slug", "left_anti")
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("last"))
    order = new.agg(F.sort_array(F.collect_list(F.struct("slug", "label"))).alias("all")).select(F.posexplode("all").alias("at", "t"))
    fresh = order.join(F.broadcast(last)).select((F.col("last") + F.col("at") + 1).alias("tag_id"), "t.slug", "t.label")
    return tags.select("tag_id", "slug", "label").unionByName(fresh)


def bulk_assign(tags: DataFrame, assignments: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags, assignments and the targets to index again after targets got a label (wanted: label, target_type, target_id).

    Tags that do not exist are made; assignments that are there already stay one; targets without an id are left out.
    """
    asked = wanted.where("target_id IS NOT NULL AND target_id <> '' AND target_type IN ('page', 'file')")
    all_tags = ensured(tags, asked.select("label"))
    ids = asked.withColumn("slug", slugify(F.col("label"))).join(all_tags.select("tag_id", "slug"), "slug").select("tag_id", "target_type", "target_id").distinct()
    return all_tags, assign(assignments.select("tag_id", "target_type", "target_id"), ids), ids.select("target_type", "target_id").distinct()


def suggested(tags: DataFrame, typed: str, n: int = 20) -> DataFrame:
    """The first n tags (tag_id, label) by label whose label or slug holds what was typed; nothing typed suggests any."""
    text = typed.strip().lower()
    return tags.where(F.lower("label").contains(text) | slugify(F.col("label")).contains(text)).orderBy("label", "tag_id").limit(n)


def from_keywords(keywords: Column, rows: DataFrame) -> DataFrame:
    """slug, label, n of the tags that comma-separated keywords of rows stand for: equal slugs are one tag, its label the first in order."""
    word = rows.select(F.explode(F.split(keywords, ",")).alias("w")).select(F.trim("w").alias("label"))
    named = word.withColumn("slug", slugify(F.col("label"))).where("slug <> ''")
    return named.groupBy("slug").agg(F.min("label").alias("label"), F.count("*").alias("n"))

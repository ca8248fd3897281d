"""Page tree, permissions, locales, reindex plans, the document store, tags and search analytics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import basename, extension

from .scratch import written

MOST_DEPTH = 50
#: File kinds that are indexed, and folders left out by default.
EXTENSIONS = ("pdf", "txt", "md", "docx", "odt", "rtf")
DEFAULT_EXCLUDED = ("files/intern/**", "files/admin/**", "files/private/**")


def lineage(tree: DataFrame, *columns: str) -> DataFrame:
    """id, up: of every node of a tree (id, pid, ...) itself and its ancestors, nearest first, each with its id, `there` and columns.

    At most MOST_DEPTH ancestors, so a cycle ends; a parent that the tree lacks is the last, without `there`. Made by
    doubling: each round puts behind a node's ancestors those of the last of them, so a tree of depth n takes log2(n)
    joins, and a row a node whatever its depth. Children of one node meet its one row: Spark splits such a join where it is skewed.
    """
    entry = lambda i, there, values: F.struct(i.alias("id"), F.lit(there).alias("there"), *values)
    none = [F.lit(None).cast(tree.schema[c].dataType).alias(c) for c in columns]
    state = tree.select("id", F.array(entry(F.col("id"), True, columns)).alias("up"), F.when(F.col("pid") != 0, F.col("pid")).alias("next"))
    while True:
        state = written(state, "lineage")
        if state.where("next IS NOT NULL").isEmpty():
            return state.select("id", "up")
        above = state.select(F.col("id").alias("__id"), F.col("up").alias("more"), F.col("next").alias("then"))
        met = state.join(above, F.col("next") == F.col("__id"), "left")
        more = F.coalesce("more", F.array(entry(F.col("next"), False, none)))
        up = F.when(F.col("next").isNull(), F.col("up")).otherwise(F.slice(F.concat("up", more), 1, MOST_DEPTH + 1))
        state = met.select("id", up.alias("up"), "next", "then").select("id", "up", F.when(F.col("next").isNotNull() & (F.size("up") <= MOST_DEPTH), F.col("then")).alias("next"))


def closure(tree: DataFrame) -> DataFrame:
    """id, ancestor, depth (0: itself) of every node, at most MOST_DEPTH up; a cycle ends there."""
    return lineage(tree).select("id", F.posexplode("up").alias("depth", "a")).select("id", F.col("a.id").alias("ancestor"), "depth")


def _above(test) -> Column:
    """The nodes on the way up, of those that are there, that satisfy a test."""
    return F.filter("up", lambda x: x["there"] & F.coalesce(test(x), F.lit(False)))


#: Columns of a tree that say what a page takes from its ancestors.
INHERITED = ("protected", "grp", "language", "title", "url_suffix", "pid")


def inherited(tree: DataFrame, enabled: list[str], suffix: str = ".html") -> DataFrame:
    """id, is_protected, allowed_groups, locale, breadcrumb, suffix (null: under no root) of every page, from one lineage."""
    return lineage(tree, *INHERITED).select("id", *_rights(), _locale(enabled), _breadcrumb(), _suffix(suffix))


def _rights() -> list[Column]:
    closed = _above(lambda x: x["protected"])
    groups = F.array_compact(F.array_distinct(F.transform(closed, lambda x: x["grp"])))
    return [(F.size(closed) > 0).alias("is_protected"), F.sort_array(groups).alias("allowed_groups")]


def _locale(enabled: list[str]) -> Column:
    near = F.try_element_at(_above(lambda x: x["language"] != ""), F.lit(1))["language"]
    return F.when(near.isin(enabled), near).otherwise(enabled[0]).alias("locale")


def _breadcrumb() -> Column:
    return F.array_join(F.reverse(F.transform(_above(lambda x: F.lit(True)), lambda x: x["title"])), " › ").alias("breadcrumb")


def _suffix(default: str) -> Column:
    root = F.try_element_at(_above(lambda x: x["pid"] == 0), F.lit(1))
    return F.when(root.isNotNull(), F.coalesce(F.nullif(root["url_suffix"], F.lit("")), F.lit(default))).alias("suffix")


def page_permissions(tree: DataFrame) -> DataFrame:
    """id, is_protected, allowed_groups: protected if any ancestor is; only protected ancestors give groups."""
    return lineage(tree, "protected", "grp").select("id", *_rights())


def page_locales(tree: DataFrame, enabled: list[str]) -> DataFrame:
    """id, locale: the nearest language on the way up, if enabled, else the first enabled one."""
    return lineage(tree, "language").select("id", _locale(enabled))


def breadcrumbs(tree: DataFrame) -> DataFrame:
    return lineage(tree, "title").select("id", _breadcrumb())


def url_suffixes(tree: DataFrame, default: str = ".html") -> DataFrame:
    """id, suffix: the root's own, else the site's; pages under no root have none."""
    return lineage(tree, "url_suffix", "pid").select("id", _suffix(default)).where("suffix IS NOT NULL")


def glob(pattern: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? do not; case is ignored."""
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "(?i)^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def matches_any(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob(p))
    return out


def decision(mode: str, path: Column, protected: Column, excluded: tuple[str, ...] = DEFAULT_EXCLUDED, whitelist: tuple[str, ...] = ()) -> Column:
    """struct<include, reason>: excluded patterns first, then what the mode asks for."""
    answer = lambda ok, why=None: F.struct(F.lit(ok).alias("include"), F.lit(why).cast("string").alias("reason"))
    out = F.when(matches_any(path, excluded), answer(False, "pattern_excluded"))
    if mode == "public_only":
        out = out.when(F.coalesce(protected, F.lit(False)), answer(False, "protected_excluded")).otherwise(answer(True))
    elif mode == "whitelist":
        out = out.when(~matches_any(path, whitelist), answer(False, "not_in_whitelist")).otherwise(answer(True))
    elif mode in ("with_protected", "blacklist"):
        out = out.otherwise(answer(True))
    else:
        out = out.otherwise(answer(False, "unknown_mode"))
    return out


def indexable_files(files: DataFrame) -> DataFrame:
    """One row a path, the smallest id, of the kinds that are indexed."""
    return files.where(extension(F.col("path")).isin(*EXTENSIONS)).groupBy("path").agg(F.min("id").alias("id"))


def dominant(found: DataFrame, key: str, value: str) -> DataFrame:
    """key and its most frequent value, ties to the first in order."""
    n = found.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias(value))


def path_locale(path: Column, enabled: list[str]) -> Column:
    folders = F.filter(F.split(path, "/"), lambda p, i: i < F.size(F.split(path, "/")) - 1)
    parts = F.transform(folders, lambda p: F.regexp_extract(F.lower(p), "^([a-z]{2})([_-][a-z]{2})?$", 1))
    return F.try_element_at(F.filter(parts, lambda p: p.isin(enabled)), F.lit(1))


def name_locale(path: Column, enabled: list[str]) -> Column:
    stem = F.lower(F.regexp_replace(basename(path), r"\.[^./]+$", ""))
    found = F.regexp_extract(stem, "[._-]([a-z]{2})([_-][a-z]{2})?$", 1)
    return F.when(found.isin(enabled), found)


def file_locale(override: Column, embedded: Column, path: Column, enabled: list[str]) -> Column:
    """Override, then embedding pages, then folders, then the name, then the first enabled locale."""
    ok = lambda c: F.when(F.lower(c).isin(enabled), F.lower(c))
    return F.coalesce(ok(override), ok(embedded), path_locale(path, enabled), name_locale(path, enabled), F.lit(enabled[0]))


def plan(items: DataFrame, indexed: DataFrame) -> DataFrame:
    """items (id, include, reason, ...) with status new, existing or excluded."""
    known = indexed.select("id").distinct().withColumn("known", F.lit(True))
    return items.join(known, "id", "left").withColumn("status", F.when(~F.col("include"), "excluded").when(F.col("known"), "existing").otherwise("new")).drop("known")


def orphans(items: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.select("id").distinct().join(items.where("include").select("id"), "id", "left_anti")


def diff_report(items: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: on_site, in_index, both, missing (on the site only), orphans (in the index only)."""
    site = items.where("include").select(F.col("id").alias("item")).distinct()
    there, known = F.col("item").isNotNull(), F.col("known").isNotNull()
    met = site.join(indexed.select(F.col("id").alias("known")).distinct(), F.col("item") == F.col("known"), "full")
    return met.agg(F.count("item").alias("on_site"), F.count("known").alias("in_index"), F.count_if(there & known).alias("both"), F.count_if(there & ~known).alias("missing"), F.count_if(~there & known).alias("orphans"))


def plan_stats(planned: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    protected = F.coalesce(F.col("is_protected"), F.lit(False))
    return planned.agg(F.count("*").alias("total"), status("new"), status("existing"), status("excluded"), F.count_if(~protected).alias("public"), F.count_if(protected).alias("protected"))


def upsert(current: DataFrame, changed: DataFrame, key: str = "id", order: str = "indexed_at") -> DataFrame:
    """All rows, one a key: the one with the largest `order`; of those a changed one, and among these the last in a fixed order."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changed.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("__new"), F.desc(F.xxhash64(*(f"`{c}`" for c in both.columns))))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def delete(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def assign(assignments: DataFrame, new: DataFrame) -> DataFrame:
    """Adds assignments that are not there yet."""
    return assignments.unionByName(new).dropDuplicates()


def tag_counts(tags: DataFrame, assignments: DataFrame) -> DataFrame:
    n = assignments.groupBy("tag_id").agg(F.count("*").alias("n"))
    return tags.join(n, "tag_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def valid_events(events: DataFrame) -> DataFrame:
    """q trimmed, 2 to 255 characters (longer ones are cut), locale lower-cased to 8, results not negative."""
    q = F.trim("q")
    return events.where(F.length(q) >= 2).select(F.substring(q, 1, 255).alias("q"), F.substring(F.lower("locale"), 1, 8).alias("locale"), F.greatest("results", F.lit(0)).alias("results"), "ts")


def query_report(events: DataFrame, *by: Column | str) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("results") == 0).alias("zero"), F.sum("results").alias("results"))


def both_lists(*lists: Column) -> Column:
    """Lists of globs as one, each glob once."""
    out = F.array().cast("array<string>")
    for c in lists:
        out = F.array_union(out, F.coalesce(c, F.array().cast("array<string>")))
    return out


def keyed_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def index_stats(docs: DataFrame, expected: int | None = None) -> DataFrame:
    """index_locale, documents, last_update, percent (of `expected` documents; null where none are given)."""
    share = F.lit(None) if not expected else F.least(F.lit(100), F.round(F.count("*") * 100.0 / expected))
    return docs.groupBy(F.regexp_extract(F.lower("locale"), "^[a-z]{2,3}", 0).alias("index_locale")).agg(F.count("*").alias("documents"), F.max("indexed_at").alias("last_update"), share.cast("long").alias("percent"))

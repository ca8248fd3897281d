"""What a save, an upload or a run does to the index: decisions for changed pages and files, finalising, single items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import doc_id, extension

from .pages import PAGE_TYPES, column
from .site import DEFAULT_EXCLUDED, EXTENSIONS, decision
from .store import Store, routed

#: Folders that a new site leaves out if it has them.
SEEDED = ("files/intern", "files/admin", "files/private")


class NotConfigured(Exception):
    """The engine has no store to work with yet."""


def configured(store: Store | None) -> Store:
    if store is None:
        raise NotConfigured("no store is set up")
    return store


@dataclass(frozen=True)
class Live:
    """Which changes are followed as they happen, and what may be indexed."""

    pages: bool = True
    files: bool = True
    mode: str = "public_only"
    excluded: tuple[str, ...] = DEFAULT_EXCLUDED
    whitelist: tuple[str, ...] = ()


def _action(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds gives the action; index if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for holds, action in rules:
        out = out.when(holds, action)
    return out.otherwise("index")


def page_changes(changed: DataFrame, pages: DataFrame, rights: DataFrame, live: Live = Live()) -> DataFrame:
    """page_id, id, action (index, delete or ignore) of changed pages (page_id). rights: id, is_protected.

    Unpublished pages, noindex, noSearch and what the mode leaves out are deleted; other kinds of pages, pages that no longer
    exist and, while live indexing is off, all changes are ignored.
    """
    p = pages.select(F.col("id").alias("page_id"), "type", "alias", F.coalesce("published", F.lit("")).alias("published"), F.coalesce(F.lower(column(pages, "robots")), F.lit("")).alias("robots"), F.coalesce(column(pages, "noSearch"), F.lit("")).alias("no_search"), F.lit(True).alias("there"))
    closed = rights.groupBy(F.col("id").alias("page_id")).agg(F.bool_or("is_protected").alias("is_protected"))
    met = changed.select("page_id").distinct().join(p, "page_id", "left").join(closed, "page_id", "left")
    path = F.concat(F.lit("page/"), F.coalesce(F.nullif("alias", F.lit("")), F.col("page_id").cast("string")))
    allowed = decision(live.mode, path, F.col("is_protected"), live.excluded, live.whitelist)["include"]
    rules = (
        (F.lit(not live.pages) | F.col("there").isNull(), "ignore"), (F.col("published") != "1", "delete"), (~F.col("type").isin(*PAGE_TYPES), "ignore"),
        (F.col("robots").contains("noindex") | (F.col("no_search") == "1"), "delete"), (~allowed, "delete"),
    )
    return met.select("page_id", F.concat(F.lit("page-"), "page_id").alias("id"), _action(*rules).alias("action"))


def file_changes(changed: DataFrame, rights: DataFrame, texts: DataFrame, live: Live = Live()) -> DataFrame:
    """path, id, action of changed files (path, uuid). rights: path, is_protected; texts: path, reason (null: it has a text).

    What the mode leaves out is deleted; kinds that are not indexed and files without a text are ignored.
    """
    readable = texts.where("reason IS NULL").select("path", F.lit(True).alias("readable")).distinct()
    closed = rights.groupBy("path").agg(F.bool_or("is_protected").alias("is_protected"))  # rows that repeat a path protect it together
    met = changed.groupBy("path").agg(F.max("uuid").alias("uuid")).join(closed, "path", "left").join(readable, "path", "left")
    allowed = decision(live.mode, F.col("path"), F.col("is_protected"), live.excluded, live.whitelist)["include"]
    rules = ((F.lit(not live.files) | ~extension(F.col("path")).isin(*EXTENSIONS), "ignore"), (~allowed, "delete"), (F.col("readable").isNull(), "ignore"))
    return met.select("path", doc_id(F.col("uuid"), F.col("path")).alias("id"), _action(*rules).alias("action"))


def carry_out(store: Store, decided: DataFrame, documents: DataFrame) -> None:
    """Applies decisions (id, action) to the store in one change: documents to index are put in, others deleted."""
    gone = decided.where("action = 'delete'").select("id", F.lit(True).alias("__gone"))
    fresh = routed(documents.join(decided.where("action = 'index'").select("id"), "id", "left_semi")).withColumn("__gone", F.lit(False))
    store.apply(fresh.unionByName(gone, allowMissingColumns=True))


def finalize(store: Store, items: DataFrame) -> int:
    """Deletes what the store holds and the plan (id, include) doesn't include; returns how many rows went."""
    current = configured(store).read()
    if current is None:
        return 0
    return store.delete(current.select("id").join(items.where("include").select("id"), "id", "left_anti"))


def reindex_one(store: Store, documents: DataFrame, item: str) -> bool:
    """Puts one document anew, or deletes it where there is none; whether there is one."""
    one = documents.where(F.col("id") == item)
    found = bool(one.limit(1).count())
    if found:
        configured(store).upsert(one)
    else:
        configured(store).delete(one.sparkSession.createDataFrame([(item,)], "id string"))
    return found


def move_locale(documents: DataFrame, changes: DataFrame, enabled: list[str], default: str) -> DataFrame:
    """Rows to index again after files got a locale (changes: id, locale): their documents with the new one.

    An empty locale stands for the default; one that is not enabled is no change.
    """
    wanted = F.lower(F.coalesce("locale", F.lit("")))
    told = changes.select("id", F.when(wanted == "", F.lit(default)).otherwise(wanted).alias("new")).where(F.col("new").isin(*enabled)).dropDuplicates(["id"])
    return documents.join(told, "id").where("NOT new <=> locale").withColumn("locale", F.col("new")).drop("new")


def carry_moves(store: Store, changes: DataFrame, enabled: list[str], default: str) -> None:
    """Moves documents of the store to the locales that their files got: one change, after which each is where it belongs."""
    current = configured(store).read()
    if current is not None:
        store.upsert(move_locale(current.drop("index_locale"), changes, enabled, default))


def seeded_folders(folders: DataFrame) -> DataFrame:
    """path, uuid of the folders (id, uuid, path, type) that a new site leaves out: one row a path, the smallest id."""
    there = folders.where((F.col("type") == "folder") & F.col("path").isin(*SEEDED) & F.col("uuid").isNotNull())
    return there.groupBy("path").agg(F.min_by("uuid", "id").alias("uuid"))


def uuid_of_path(files: DataFrame) -> DataFrame:
    """path, uuid (hex): of the rows (id, uuid, path) with a uuid of 16 bytes, that of the smallest id of each path."""
    return files.where(F.octet_length("uuid") == 16).groupBy("path").agg(F.lower(F.hex(F.min_by("uuid", "id"))).alias("uuid"))

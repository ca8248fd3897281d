"""What the back end does with tags, trees, plans and overrides, as operations on whole tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import slugify

from .search import ATTRIBUTES, FILTERABLE, SORTABLE, TYPO_LENGTHS, facets, user_filter, visible
from .site import EXTENSIONS

#: Rows of a page of the index browser, shown items of a plan, seconds after which a run counts as over, rows of a list.
PAGE_ROWS, PREVIEW, STALE_SECONDS, LIST_ROWS = 50, 12, 3600, 100
#: Codes and names of failed requests.
ERRORS = {401: "unauthorized", 402: "subscription_inactive", 403: "not_provisioned", 429: "rate_limited", 503: "platform_unreachable", 500: "search_failed"}
#: The ranking's rules, first to last.
RULES = ("words", "typo", "proximity", "attribute", "sort", "exactness")


class RequestError(Exception):
    """A failed request; unknown codes are 500."""

    def __init__(self, code: int):
        self.code = code if code in ERRORS else 500
        self.name = ERRORS[self.code]
        super().__init__(self.name)


@dataclass(frozen=True)
class IndexConfig:
    """How one locale is searched; equal settings give equal configs, so setting up again changes nothing."""

    locale: str
    strictness: str
    searchable: tuple[str, ...]
    filterable: tuple[str, ...]
    sortable: tuple[str, ...]
    rules: tuple[str, ...]
    one_typo: int
    two_typos: int
    prefixes: bool
    synonyms: tuple[tuple[str, tuple[str, ...]], ...]


def index_config(locale: str, strictness: str = "balanced", synonyms: dict[str, list[str]] | None = None) -> IndexConfig:
    """Synonyms belong to the German index; strict search knows no prefixes; an unknown strictness is balanced."""
    strictness = strictness if strictness in TYPO_LENGTHS else "balanced"
    words = tuple((k, tuple(v)) for k, v in sorted((synonyms or {}).items())) if locale == "de" else ()
    return IndexConfig(locale, strictness, ATTRIBUTES, tuple(sorted(FILTERABLE)), tuple(sorted(SORTABLE)), RULES, *TYPO_LENGTHS[strictness], strictness != "strict", words)


def index_configs(locales: DataFrame, strictness: str = "balanced", synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """locale, config (JSON) of every locale of a table: what index_config() says, made where the rows are."""
    text = lambda c: json.dumps({k: v for k, v in asdict(c).items() if k != "locale"}, sort_keys=True, ensure_ascii=False)
    german, other = (F.lit(text(index_config(x, strictness, synonyms))) for x in ("de", ""))
    return locales.select("locale").where("locale IS NOT NULL").distinct().select("locale", F.when(F.col("locale") == "de", german).otherwise(other).alias("config"))


def ensured(kept: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """locale, config, changed: the settings of all indexes once those that are wanted are set; equal ones are left alone."""
    if kept is None:
        return wanted.select("locale", "config", F.lit(True).alias("changed"))
    both = kept.select("locale", F.col("config").alias("was")).join(wanted.select("locale", F.col("config").alias("new")), "locale", "full")
    return both.select("locale", F.coalesce("new", "was").alias("config"), (F.col("new").isNotNull() & ~F.col("was").eqNullSafe(F.col("new"))).alias("changed"))


def error_names(code: Column) -> Column:
    """The names of failed requests by their codes; unknown ones are 500's."""
    out = F.lit(ERRORS[500])
    for k, v in ERRORS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def module_locales(explicit: Column, page: Column, default: str = "de") -> Column:
    """module_locale() on columns."""
    some = lambda c: F.nullif(F.substring(F.lower(F.coalesce(c, F.lit(""))), 1, 2), F.lit(""))
    return F.coalesce(some(explicit), some(page), F.lit(default[:2].lower()))


def module_locale(explicit: str | None, page: str | None, default: str = "de") -> str:
    """The first of them that is set, cut to two letters."""
    return next((v[:2].lower() for v in (explicit, page, default) if v), "de")


def unique_slugs(tags: DataFrame) -> DataFrame:
    """tag_id, label, slug of tags (tag_id, label): of equal slugs the smallest id keeps it, others get their id behind it.

    Labels without letters and digits have no slug and are left out.
    """
    named = tags.select("tag_id", "label", slugify(F.col("label")).alias("slug")).where("slug <> ''")
    first = named.groupBy("slug").agg(F.min("tag_id").alias("first"))
    met = named.join(first, "slug")
    return met.select("tag_id", "label", F.when(F.col("tag_id") == F.col("first"), F.col("slug")).otherwise(F.concat_ws("-", "slug", "tag_id")).alias("slug"))


def rename(tags: DataFrame, renames: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tags (tag_id, slug, label) under their new labels, and the distinct targets to index again: those of changed slugs.

    renames: tag_id, label, one row a tag. A slug that an unrenamed tag has, or an earlier one of the renamed, gets the id behind it.
    """
    fresh = unique_slugs(renames.join(tags.select("tag_id"), "tag_id", "left_semi"))
    rest = tags.join(fresh.select("tag_id"), "tag_id", "left_anti")
    taken = rest.select("slug", F.lit(True).alias("taken")).distinct()
    fresh = fresh.join(taken, "slug", "left").select("tag_id", F.when(F.col("taken"), F.concat_ws("-", "slug", "tag_id")).otherwise(F.col("slug")).alias("slug"), "label")
    old = tags.select("tag_id", F.col("slug").alias("old"))
    changed = fresh.join(old, "tag_id").where(~F.col("slug").eqNullSafe(F.col("old"))).select("tag_id")
    return rest.select("tag_id", "slug", "label").unionByName(fresh), assignments.join(changed, "tag_id", "left_semi").select("target_id").distinct()


def unassign(assignments: DataFrame, gone: DataFrame) -> DataFrame:
    return assignments.join(gone.select("tag_id", "target_id").distinct(), ["tag_id", "target_id"], "left_anti")


def delete_tags(tags: DataFrame, assignments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and assignments without the tags of `gone` (tag_id)."""
    ids = gone.select("tag_id").distinct()
    return tags.join(ids, "tag_id", "left_anti"), assignments.join(ids, "tag_id", "left_anti")


def tag_details(tags: DataFrame, assignments: DataFrame, crumbs: DataFrame) -> DataFrame:
    """tag_id, label, target_id, breadcrumb; targets without a page are left out."""
    where = crumbs.select(F.col("id").alias("target_id"), "breadcrumb")
    return assignments.join(where, "target_id").join(tags.select("tag_id", "label"), "tag_id").select("tag_id", "label", "target_id", "breadcrumb")


def decorate(tree: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows of a tree (id, pid, type, title, and alias if there is one) with label, has_children, assigned and locked (roots and
    assigned pages). A row without a title is shown by its alias, one without either by its id."""
    parents = tree.where("pid <> 0").select(F.col("pid").alias("id")).distinct().withColumn("has_children", F.lit(True))
    chosen = assigned.select("id").distinct().withColumn("assigned", F.lit(True))
    out = tree.join(parents, "id", "left").join(chosen, "id", "left")
    no = F.lit(False)
    alias = F.concat(F.lit("/"), F.nullif("alias", F.lit(""))) if "alias" in tree.columns else F.lit(None).cast("string")
    return out.select("id", "pid", F.coalesce(F.nullif("title", F.lit("")), alias, F.concat(F.lit("#"), "id")).alias("label"), F.coalesce("has_children", no).alias("has_children"), F.coalesce("assigned", no).alias("assigned"), ((F.col("type") == "root") | F.coalesce("assigned", no)).alias("locked"))


def resume(items: DataFrame, done: DataFrame, indexed: DataFrame) -> DataFrame:
    """id, action: included items that a run has done or the index holds are skipped, others are indexed."""
    seen = done.select("id").unionByName(indexed.select("id")).distinct().withColumn("seen", F.lit(True))
    return items.where("include").join(seen, "id", "left").select("id", F.when(F.col("seen"), "skip").otherwise("index").alias("action"))


def preview(planned: DataFrame, n: int = PREVIEW) -> DataFrame:
    """The first n new items."""
    return planned.where("status = 'new'").orderBy("id").limit(n)


def run_state(docs: DataFrame, total: int, started: int, now: int) -> DataFrame:
    """One row: total, indexed, percent, running. A run that began over an hour ago counts as over."""
    n = F.count("*")
    percent = F.least(F.lit(100), F.round(n / F.lit(max(total, 1)) * 100)).cast("int") if total > 0 else F.lit(0)
    stale = started > 0 and now - started > STALE_SECONDS
    return docs.agg(F.lit(total).alias("total"), n.alias("indexed"), percent.alias("percent"), (F.lit(total > 0 and not stale) & (n < total)).alias("running"))


def browse(docs: DataFrame, page: int = 1, groups: tuple[int, ...] = (), filters: dict | None = None) -> DataFrame:
    """A page of the index browser, latest first."""
    shown = docs.where(visible(groups)).where(user_filter(filters or {}))
    return shown.orderBy(F.desc("indexed_at"), "id").offset((max(page, 1) - 1) * PAGE_ROWS).limit(PAGE_ROWS)


def page_count(docs: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """One row: documents and pages of the index browser, one at least."""
    return docs.agg(F.count("*").alias("documents"), F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("long").alias("pages"))


def latest(docs: DataFrame, n: int = LIST_ROWS) -> DataFrame:
    """The back end's list: the first n documents, latest first."""
    return docs.orderBy(F.desc("indexed_at"), "id").limit(n)


def extension_choices(docs: DataFrame) -> DataFrame:
    """value, n of the tags that are file kinds, most first."""
    return facets(docs, ("tags",)).where(F.col("value").isin(*EXTENSIONS)).select("value", "n").orderBy(F.desc("n"), "value")


def item_of(doc_id: Column) -> Column:
    """struct<kind, page, uuid, path_md5> of a document's id; kind is null if it is no such id."""
    page = F.regexp_extract(doc_id, "^page-([0-9]+)$", 1)
    uuid = F.regexp_extract(doc_id, "^file-([0-9a-f]{32})$", 1)
    path = F.regexp_extract(doc_id, "^file-path-([0-9a-f]{32})$", 1)
    kind = F.when(page != "", "page").when((uuid != "") | (path != ""), "file")
    return F.struct(kind.alias("kind"), F.nullif(page, F.lit("")).cast("long").alias("page"), F.nullif(uuid, F.lit("")).alias("uuid"), F.nullif(path, F.lit("")).alias("path_md5"))


def set_overrides(current: DataFrame, changes: DataFrame, enabled: list[str]) -> DataFrame:
    """path, locale after changes (path, locale; one row a path): an enabled locale sets, an empty one removes, others do nothing."""
    wanted = F.lower(F.coalesce("locale", F.lit("")))
    told = changes.select("path", wanted.alias("locale")).where(F.col("locale").isin("", *enabled))
    return current.join(told, "path", "left_anti").select("path", "locale").unionByName(told.where("locale <> ''"))

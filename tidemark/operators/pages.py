"""Pages and files as search documents: scans, content in order, embedded files, inherited file permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import doc_id, extension, headline_text, humanize_filename, normalize, page_url

from .site import EXTENSIONS, dominant, inherited, lineage

#: The page types that are indexed.
PAGE_TYPES = ("regular", "forward", "redirect")


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that older tables may lack: null then."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def indexable_pages(pages: DataFrame) -> DataFrame:
    """Published pages of the indexed types, neither noindex nor left out of search."""
    robots = F.coalesce(F.lower(column(pages, "robots")), F.lit(""))
    hidden = F.coalesce(column(pages, "noSearch"), F.lit("")) == "1"
    return pages.where(F.col("type").isin(*PAGE_TYPES) & (F.col("published") == "1") & ~robots.contains("noindex") & ~hidden)


def crawled_pages(pages: DataFrame) -> DataFrame:
    """Pages that a crawl queues: published and of the indexed types, whatever robots are told."""
    return pages.where(F.col("type").isin(*PAGE_TYPES) & (F.col("published") == "1"))


def crawled_files(files: DataFrame) -> DataFrame:
    """Files that a crawl queues: all rows of the kinds that are indexed, repeated paths too."""
    return files.where(extension(F.col("path")).isin(*EXTENSIONS))


def page_texts(articles: DataFrame, elements: DataFrame) -> DataFrame:
    """page_id, body: texts of the published articles of the main column and their visible elements, in order."""
    shown = articles.where("published = '1' AND coalesce(inColumn, 'main') = 'main'").select(F.col("id").alias("article"), F.col("pid").alias("page_id"), "title", "teaser")
    heads = shown.select("page_id", "article", F.lit(-1).cast("long").alias("ord"), F.lit(0).cast("long").alias("element"), F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("teaser", F.lit(""))).alias("text"))
    body = elements.where((F.coalesce("invisible", F.lit("")) != "1") & F.coalesce(column(elements, "ptable"), F.lit("article")).endswith("article")).select(F.col("pid").alias("article"), F.col("sorting").cast("long").alias("ord"), F.col("id").cast("long").alias("element"), F.concat_ws(" ", F.nullif(headline_text(F.col("headline")), F.lit("")), F.nullif("text", F.lit(""))).alias("text"))
    parts = heads.unionByName(body.join(shown.select("article", "page_id"), "article"))
    return parts.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("article", "ord", "element", "text"))), lambda x: x["text"]), " ").alias("body"))


def page_documents(pages: DataFrame, articles: DataFrame, elements: DataFrame, tags: DataFrame, enabled: list[str], indexed_at: int) -> DataFrame:
    """Search documents of the indexable pages. pages: id, pid, type, alias, title, language, protected, grp, published, ...

    tags: target_id, slug, label. indexed_at is given, so the same input makes the same rows.
    """
    tree = pages.select("id", "pid", "title", "language", (F.coalesce("protected", F.lit("")) == "1").alias("protected"), "grp", column(pages, "urlSuffix").alias("url_suffix"))
    labels = F.array_distinct(F.flatten(F.collect_list(F.array("slug", "label"))))
    tagged = tags.groupBy(F.col("target_id").alias("id")).agg(F.sort_array(labels).alias("found"))
    keywords = F.filter(F.transform(F.split(F.coalesce(column(pages, "keywords"), F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")
    p = indexable_pages(pages).select("id", "alias", "title", column(pages, "pageTitle").alias("page_title"), column(pages, "description").alias("description"), keywords.alias("keywords"), column(pages, "tstamp", "long").alias("tstamp"))
    p = p.join(page_texts(articles, elements), p["id"] == F.col("page_id"), "left").join(inherited(tree, enabled), "id").join(tagged, "id", "left")
    title = F.coalesce(F.nullif("page_title", F.lit("")), F.nullif("title", F.lit("")), F.concat(F.lit("#"), "id"))
    content = normalize(F.concat_ws(" ", title, F.nullif("description", F.lit("")), F.array_join("keywords", " "), "body"))
    return p.select(
        F.concat(F.lit("page-"), "id").alias("id"), F.lit("page").alias("type"), "locale", title.alias("title"), page_url(F.col("alias"), F.col("suffix")).alias("url"), content.alias("content"),
        F.coalesce("found", F.array_distinct("keywords")).alias("tags"), F.col("tstamp").cast("long").alias("published_at"), F.lit(1.0).alias("weight"), "is_protected", "allowed_groups", F.lit(indexed_at).cast("long").alias("indexed_at"),
    )


def serialised_uuids(blob: Column) -> Column:
    """The 16-byte strings of a serialised list, as hex: read from the hex text, so the bytes may be anything."""
    # s:16:" is 733A31363A22 in hex; 32 digits are the 16 bytes
    return F.array_distinct(F.regexp_extract_all(F.lower(F.hex(blob)), F.lit("733a31363a22([0-9a-f]{32})22"), 1))


def embeddings(pages: DataFrame, articles: DataFrame, elements: DataFrame) -> DataFrame:
    """uuid (hex), page_id: files that published pages show, by one source, a poster or a list; equi-joins only."""
    shown = elements.where("coalesce(invisible, '') <> '1'")
    one = lambda c: F.when(F.octet_length(column(elements, c, "binary")) == 16, F.array(F.lower(F.hex(column(elements, c, "binary"))))).otherwise(F.array().cast("array<string>"))
    many = F.coalesce(serialised_uuids(column(elements, "multiSRC", "binary")), F.array().cast("array<string>"))
    each = shown.select(F.col("pid").alias("article"), F.explode(F.concat(one("singleSRC"), one("posterSRC"), many)).alias("uuid"))
    owner = articles.where("published = '1'").select(F.col("id").alias("article"), F.col("pid").alias("page_id"))
    return each.join(owner, "article").join(pages.where("published = '1'").select(F.col("id").alias("page_id")), "page_id", "left_semi").select("uuid", "page_id").distinct()


def embedded_locales(found: DataFrame, locales: DataFrame) -> DataFrame:
    """uuid, locale: the language most of a file's pages have, ties to the first in order. locales: id, locale."""
    return dominant(found.join(locales.withColumnRenamed("id", "page_id"), "page_id").select("uuid", "locale"), "uuid", "locale")


def folders_above(path: Column) -> Column:
    """Every folder that holds a path: a/b/c.txt is in a and a/b."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))  # a file at the top is in no folder


def file_permissions(files: DataFrame, folders: DataFrame, markers: DataFrame, found: DataFrame, page_rights: DataFrame) -> DataFrame:
    """id, is_protected, allowed_groups of files (id, uuid, path).

    A folder with a .public marker (markers: path) makes what is below it public; else a protected folder above protects
    (folders: path, protected, groups). Groups are those of the pages that show the file, else those of its folders.
    """
    up = files.select("id", F.explode(folders_above(F.col("path"))).alias("folder"))
    public = up.join(markers.select(F.col("path").alias("folder")).distinct(), "folder", "left_semi").select("id").distinct().withColumn("public", F.lit(True))
    above = up.join(folders.select(F.col("path").alias("folder"), "protected", "groups"), "folder").where("protected")
    by_folder = above.groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("folder_groups"), F.lit(True).alias("closed"))
    rights = found.join(page_rights.select(F.col("id").alias("page_id"), "allowed_groups"), "page_id")
    by_page = rights.groupBy("uuid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("allowed_groups")))).alias("page_groups"))
    f = files.select("id", F.lower(F.hex("uuid")).alias("uuid")).join(public, "id", "left").join(by_folder, "id", "left").join(by_page, "uuid", "left")
    none = F.array().cast("array<int>")
    groups = F.when(F.size(F.coalesce("page_groups", none)) > 0, F.col("page_groups")).otherwise(F.coalesce("folder_groups", none))
    return f.select("id", (F.coalesce("closed", F.lit(False)) & ~F.coalesce("public", F.lit(False))).alias("is_protected"), groups.alias("allowed_groups"))


def file_documents(files: DataFrame, texts: DataFrame, locales: DataFrame, rights: DataFrame, tags: DataFrame, indexed_at: int) -> DataFrame:
    """Search documents of files (id, uuid, path) with a text (texts: path, text, reason); tags: target_id is the path."""
    tagged = tags.groupBy(F.col("target_id").alias("path")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("slug", "label"))))).alias("found"))
    f = files.join(texts.where("reason IS NULL").select("path", "text"), "path").join(locales, "id").join(rights, "id").join(tagged, "path", "left")
    none = F.array().cast("array<string>")
    return f.select(
        doc_id(F.col("uuid"), F.col("path")).alias("id"), F.lit("file").alias("type"), "locale", humanize_filename(F.col("path")).alias("title"), F.concat(F.lit("/"), "path").alias("url"), normalize(F.col("text")).alias("content"),
        F.array_distinct(F.concat(F.coalesce("found", none), F.array(extension(F.col("path"))))).alias("tags"), F.lit(None).cast("long").alias("published_at"), F.lit(1.0).alias("weight"), "is_protected", "allowed_groups", F.lit(indexed_at).cast("long").alias("indexed_at"),
    )


def depth_first(tree: DataFrame) -> DataFrame:
    """id, depth, at: rows of tree (id, pid, sorting) in the order in which a tree view shows them."""
    own = F.filter("up", lambda x: x["there"])
    path = F.transform(F.reverse(own), lambda x: F.concat(F.lpad(x["sorting"].cast("string"), 12, "0"), F.lpad(x["id"].cast("string"), 12, "0")))
    return lineage(tree, "sorting").select("id", (F.size(own) - 1).alias("depth"), F.array_join(path, "/").alias("at"))


def owning_pages(changes: DataFrame, articles: DataFrame, elements: DataFrame) -> DataFrame:
    """page_id of changes (table, id) to pages, articles or elements."""
    art = articles.select(F.col("id").alias("article"), F.col("pid").alias("page_id"))
    page = changes.where("`table` = 'page'").select(F.col("id").alias("page_id"))
    of_article = changes.where("`table` = 'article'").join(art, F.col("id") == F.col("article")).select("page_id")
    touched = changes.where("`table` = 'content'").select(F.col("id").alias("eid")).join(elements.select(F.col("id").alias("eid"), F.col("pid").alias("article")), "eid")
    return page.unionByName(of_article).unionByName(touched.join(art, "article").select("page_id")).distinct()


def canonical_tag_facets(raw: DataFrame, tags: DataFrame) -> DataFrame:
    """slug, label, n of raw facets (value, n): slugs and labels of a tag meet, the larger count stands; most first."""
    low = tags.select(F.lower("label").alias("low"), F.col("slug").alias("by_label")).dropDuplicates(["low"])
    named = raw.join(tags.select(F.col("slug").alias("value"), F.col("slug").alias("by_slug")), "value", "left").join(low, F.lower("value") == F.col("low"), "left")
    n = named.select(F.coalesce("by_slug", "by_label", "value").alias("slug"), "n").groupBy("slug").agg(F.max("n").alias("n"))
    return n.join(tags.select("slug", "label"), "slug", "left").select("slug", F.coalesce("label", "slug").alias("label"), "n").orderBy(F.desc("n"), "slug")



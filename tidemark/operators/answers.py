"""The whole answer to a search request, as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import search as S
from .pages import canonical_tag_facets
from .scratch import written
from .settings import resolve_hit_tags
from .site import EXTENSIONS

#: What each hit of an answer shows.
HIT_FIELDS = ("id", "type", "title", "url", "snippet", "tags", "tagsResolved", "score", "isProtected")


def response(docs: DataFrame, request: S.Request, tags: DataFrame, synonyms: dict[str, list[str]] | None = None, took_ms: int = 0) -> DataFrame:
    """One row, json: hits in rank order, totalHits, offset, limit, facets, tagFacets (most first) and queryTimeMs.

    tags: slug, label. A page holds at most S.MOST_HITS hits; the facets and the total are those of all that was matched,
    which is found once and written without texts to the shared folder: facets, total and the page read it from there, so the
    documents are read once to match them and once to show the page. A request without hits has empty lists.
    """
    limit, offset = S.clamped(request)
    fields = ("type", "locale", "tags")
    all_ = written(S.matched(docs, request, None, synonyms, fields), "matched")
    page = all_.orderBy(*S.ranking()).offset(offset).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*S.ranking())))
    shown = S.hit_view(docs, page, request, synonyms).join(page.select("id", "rank"), "id")
    named = resolve_hit_tags(shown.select("id", "tags"), tags).withColumnRenamed("tags", "tagsResolved")
    shown = shown.join(named, "id", "left").withColumn("isProtected", F.col("is_protected"))
    hits = shown.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *HIT_FIELDS))), lambda h: F.struct(*(h[f].alias(f) for f in HIT_FIELDS))).alias("hits"))
    counted = S.facets(all_, fields)
    by_name = F.collect_list(F.struct("facet", F.struct("value", "n").alias("entry")))
    of = lambda f: F.map_from_entries(F.transform(F.sort_array(F.transform(F.filter("every", lambda x: x["facet"] == f), lambda x: x["entry"])), lambda x: x)).alias(f)
    facets = counted.where("value IS NOT NULL").agg(by_name.alias("every")).select(F.struct(*(of(f) for f in fields)).alias("facets"))
    raw = counted.where((F.col("facet") == "tags") & ~F.lower("value").isin(*EXTENSIONS)).select("value", "n")
    most = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "slug", "label", "n")))
    tag_facets = canonical_tag_facets(raw, tags).agg(F.transform(most, lambda t: F.struct(t["slug"].alias("slug"), t["label"].alias("label"), t["n"].alias("count"))).alias("tagFacets"))
    total = all_.agg(F.count("*").alias("totalHits"))
    # four rows of one row each
    whole = hits.join(total, how="cross").join(facets, how="cross").join(tag_facets, how="cross")
    return whole.select(F.to_json(F.struct("hits", "totalHits", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "facets", "tagFacets", F.lit(took_ms).alias("queryTimeMs")), {"ignoreNullFields": "false"}).alias("json"))

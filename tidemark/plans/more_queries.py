"""Further queries: files of a folder, answers as JSON, table functions, moves, settings as tables, and cases that the others leave out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.functions import text as T
from tidemark.operators import admin as A
from tidemark.operators import answers as R
from tidemark.operators import live as L
from tidemark.operators import pages as P
from tidemark.operators import search as S
from tidemark.operators import settings as C
from tidemark.operators import store as K
from tidemark.plans import oracle as O
from tidemark.plans.registry import ENABLED, query
from tidemark.plans.site_queries import _ALL, _ASKED, _FOUND, _HITS, _PAGES, _page_tables, _store
from tidemark.sources import extract as X
from tidemark.sources import site as src
from tidemark.streaming import feeds

# --- a folder of files

_LINES = "replace(replace(text, chr(10), ' '), chr(13), ' ')"
_FOLDERS = f"SELECT doc_id // 50 AS b, doc_id // 50 % 4 AS top, doc_id // 50 % 5 AS kind, string_agg({_LINES} || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY ALL"


def _written_folder(spark, d) -> str:
    """The documents as files of fifty lines each, some of a kind that is not read, and a folder that is marked public."""
    store, i = feeds.scratch_store(spark), F.floor(F.col("doc_id") / 50).cast("long")
    line = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    docs = src.read(spark, d, "documents").select("doc_id", line.alias("value"), (i % 5).alias("kind"), (i % 4).alias("top"), i.alias("b"))
    # the writer's own order first, or it sorts again by its folders and lines change places
    dealt = docs.repartition("b").sortWithinPartitions("top", "b", "doc_id").drop("doc_id")
    root = f"{store.path}/files"
    dealt.where("kind <> 0").drop("kind").write.partitionBy("top", "b").text(root)
    dealt.where("kind = 0").drop("kind").write.mode("append").partitionBy("top", "b").format("json").save(root)
    store._fs.create(store._at("files/top=1/.public"), True).close()
    return root


@query(f"SELECT 'top=' || top || '/b=' || b AS folder, CASE WHEN kind <> 0 THEN octet_length(encode(t)) END AS size, CASE WHEN kind <> 0 THEN md5(t) END AS text, CASE WHEN kind = 0 THEN 'unsupported_extension_json' END AS reason, top = 1 AS public FROM ({_FOLDERS})")
def site_files_read(spark, d):
    """Every file of a folder: its text or the reason why there is none, and whether a marker makes it public."""
    found = X.site_files(spark, _written_folder(spark, d)).where(~F.col("path").rlike("(^|/)_"))
    read = F.col("reason").isNull()
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.when(read, F.col("size")).alias("size"), F.md5("text").alias("text"), "reason", "public")


_PDFS = ("ok", "empty", "null", "headless", "endless", "large", "complex", "secured", "broken", "pictures")
_MANY = 200


@F.pandas_udf(BinaryType())
def _pdf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A PDF of a kind, as far as its checks and the parser below look; large ones are handed on a few at a time."""

    def one(k: str, t: str) -> bytes | None:
        body = {"secured": b"!encrypted", "broken": b"!broken", "pictures": b"!none"}.get(k, t.encode())
        pad = b" " * (3 << 20) if k == "large" else (b"/Length " * 4000 + b" " * (2 << 20)) if k == "complex" else b""
        return None if k == "null" else b"" if k == "empty" else (b"" if k == "headless" else b"%PDF-1.4\n") + body + b"\n" + pad + (b"" if k == "endless" else b"%%EOF")

    for kinds, texts in batches:
        for some in X.pieces((one(k, t) for k, t in zip(kinds, texts, strict=True)), lambda b: len(b or b"")):
            yield pd.Series(some, dtype="object")


def _parse(data: bytes) -> str:
    """Stands for a PDF parser: none is installed here."""
    body = data.split(b"\n", 1)[1].rsplit(b"\n", 1)[0]
    if body.startswith(b"!encrypted"):
        raise ValueError("Secured PDF file are currently not supported.")
    if body == b"!broken":
        raise ValueError("no objects")
    return "" if body == b"!none" else body.decode()


@query(f"""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 10 IN (5, 6) AND doc_id % {_MANY} > 10 THEN 'ok' ELSE [{', '.join(f"'{k}'" for k in _PDFS)}][doc_id % 10 + 1] END AS kind, {_LINES} AS t FROM documents)
 SELECT doc_id, CASE WHEN kind = 'ok' AND trim(t) <> '' THEN t END AS text, CASE kind WHEN 'empty' THEN 'file_size_unknown' WHEN 'null' THEN 'file_not_readable' WHEN 'headless' THEN 'pdf_header_missing' WHEN 'endless' THEN 'pdf_eof_missing_corrupt'
 WHEN 'large' THEN 'file_too_large_4_mb' WHEN 'complex' THEN 'pdf_too_complex_skipped' WHEN 'secured' THEN 'pdf_encrypted_or_restricted' WHEN 'broken' THEN 'parse_failed:no objects' WHEN 'pictures' THEN 'empty_textlayer_image_only' ELSE CASE WHEN trim(t) = '' THEN 'empty_textlayer_image_only' END END AS reason FROM k""")
def pdf_reasons(spark, d):
    """Why PDFs have no text: each check before the parser, and what a parser says."""
    i = F.col("doc_id")
    kind = F.when((i % 10).isin(5, 6) & (i % _MANY > 10), "ok").otherwise(F.element_at(F.array(*map(F.lit, _PDFS)), (i % 10).cast("int") + 1))
    line = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    made = src.spread(src.read(spark, d, "documents")).select("doc_id", _pdf(kind, line).alias("bytes"))
    return made.withColumn("e", X.extracted(F.lit("pdf"), F.col("bytes"), 3, _parse)).select("doc_id", "e.text", "e.reason")


@query(f"SELECT doc_id, trim(t) <> '' AS readable, CASE WHEN trim(t) = '' THEN 'empty_file' END AS reason, len(w) AS words, w[1] AS first FROM (SELECT doc_id, {_LINES} AS t, list_filter(string_split_regex({O.fold(_LINES)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM documents)")
def sql_table_functions(spark, d):
    """Table functions in SQL: a file's text, and that text's words, joined laterally."""
    X.register(spark)
    line = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    name = f"uploads_{uuid.uuid4().hex}"
    src.read(spark, d, "documents").select("doc_id", F.lit("TXT").alias("kind"), F.encode(line, "utf-8").alias("content")).createOrReplaceTempView(name)
    # first words are keys, as a string among the aggregates would have all words sorted; a document has two such rows at most
    return spark.sql(f"""SELECT doc_id, max(reason) IS NULL AS readable, max(reason) AS reason, sum(words) AS words, max(first) AS first
      FROM (SELECT doc_id, reason, CASE WHEN w.pos = 0 THEN w.tok END AS first, count(w.tok) AS words
        FROM {name} u, LATERAL extract_text(u.kind, u.content) e, LATERAL text_words(e.text) w GROUP BY ALL) GROUP BY doc_id""")


# --- answers

_TAGGED = f"tag AS (SELECT DISTINCT source AS slug, 'Source ' || source AS label FROM documents)"


@query(f"""WITH hit AS ({_ALL}), page AS ({_HITS}), {O.DOCS}, {_TAGGED}, m AS (SELECT * FROM docs WHERE id IN (SELECT id FROM hit)), t AS (SELECT unnest(tags) AS tag FROM m),
 f AS (SELECT tag, label, count(*) AS n FROM t JOIN tag ON slug = tag GROUP BY ALL)
 SELECT (SELECT count(*) FROM hit) AS total_hits, 0::BIGINT AS "offset", 20::BIGINT AS "limit", (SELECT string_agg(id, ',' ORDER BY words DESC, typos, proximity, attr, 1700000000 + CAST(substr(id, 6) AS BIGINT) DESC, exact DESC, id) FROM page) AS hits,
 (SELECT string_agg(locale || '=' || n, ',' ORDER BY locale) FROM (SELECT locale, count(*) AS n FROM m GROUP BY locale)) AS locales, (SELECT string_agg(label || '=' || n, ',' ORDER BY n DESC, tag) FROM f) AS tags,
 (SELECT string_agg(DISTINCT 'Source ' || tags[1], ',' ORDER BY 'Source ' || tags[1]) FROM docs WHERE id IN (SELECT id FROM page)) AS chips""")
def search_response(spark, d):
    """A whole answer as JSON, read again: hits in order, total, facets, tags with their labels."""
    docs = src.search_docs(spark, d)
    tags = src.read(spark, d, "documents").select(F.col("source").alias("slug"), F.concat(F.lit("Source "), "source").alias("label")).distinct()
    answer = R.response(docs, _ASKED, tags, took_ms=7)
    kind = "hits array<struct<id:string,tagsResolved:array<struct<slug:string,label:string>>>>, totalHits long, offset long, limit long, facets struct<locale:map<string,long>>, tagFacets array<struct<label:string,count:long>>"
    a = answer.select(F.from_json("json", kind).alias("a")).select("a.*")
    pairs = F.array_sort(F.transform(F.map_entries("facets.locale"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    chips = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["tagsResolved"], lambda t: t["label"])))))
    return a.select(
        F.col("totalHits").alias("total_hits"), "offset", "limit", F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"), F.array_join(pairs, ",").alias("locales"),
        F.array_join(F.transform("tagFacets", lambda t: F.concat(t["label"], F.lit("="), t["count"])), ",").alias("tags"), F.array_join(chips, ",").alias("chips"),
    )


_SAFE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>')"
_MARKED = "array_to_string(list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda x: CASE WHEN lower(x) IN ('the', 'of') THEN '<mark>' || x || '</mark>' ELSE x END), '')"


@query(f"WITH {O.DOCS} SELECT id, {_SAFE.format(_MARKED.replace('content', 'markup'))} AS shown FROM (SELECT id, '<b> & ' || content AS markup FROM docs)")
def unmarked_texts(spark, d):
    """Marked texts with markup of their own, made safe: their marks come back, the markup does not."""
    docs = src.search_docs(spark, d).select("id", F.concat(F.lit("<b> & "), "content").alias("markup"))
    return docs.select("id", T.unmark(T.highlight(F.col("markup"), ["the", "of"])).alias("shown"))


@query(f"WITH {O.FILES} SELECT e AS value, count(*) AS n FROM (SELECT lower(split_part(path, '.', -1)) AS e FROM files) WHERE e IN ('pdf','txt','md','docx','odt','rtf') GROUP BY e")
def file_kind_choices(spark, d):
    """The kinds of file that a list offers, with their numbers; other tags are none."""
    tags = F.array(T.extension(F.col("path")), F.lit("news"))
    return A.extension_choices(src.files(spark, d).select(tags.alias("tags")))


# --- moves, settings, names

_TO = "CASE WHEN doc_id % 3 = 0 THEN 'de' WHEN doc_id % 3 = 1 THEN 'en' ELSE locale END"


@query(f"WITH {O.DOCS} SELECT {_TO} AS index_locale, count(*) AS documents, min(id) AS first, max(id) AS last FROM docs GROUP BY ALL")
def locales_moved_in_store(spark, d):
    """Documents that got another locale, in the store's partition where they belong now and in no other."""
    store, i = _store(spark, d), F.substring("id", 6, 20).cast("long")
    changes = store.read().select("id", F.when(i % 3 == 0, "").when(i % 3 == 1, "EN").otherwise("xx").alias("locale"))
    L.carry_moves(store, changes, ENABLED, "de")
    return store.read().groupBy("index_locale").agg(F.count("*").alias("documents"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("SELECT DISTINCT lang AS locale, 8::BIGINT AS one_typo, 'false' AS prefixes, CASE WHEN lang = 'de' THEN 'maße,mass' END AS synonyms, lang IN ('de', 'en') AS changed FROM documents")
def index_settings_table(spark, d):
    """Settings of every locale's index as a table: of two locales they were others, so only those change."""
    locales = src.read(spark, d, "documents").select(F.col("lang").alias("locale"))
    words = {"masse": ["maße", "mass"]}
    wanted = A.index_configs(locales, "strict", words)
    path = f"{feeds.scratch(spark)}/settings-{uuid.uuid4().hex}"
    before = A.index_configs(locales.where(F.col("locale").isin("de", "en")), "tolerant").unionByName(wanted.where(~F.col("locale").isin("de", "en")))
    A.ensured(None, before).write.parquet(path)
    told = A.ensured(spark.read.parquet(path), wanted)
    kind = "one_typo long, prefixes boolean, synonyms array<array<string>>"
    read = told.withColumn("c", F.from_json("config", kind)).withColumn("pair", F.get_json_object("config", "$.synonyms[0][1]"))
    return read.select("locale", "c.one_typo", F.col("c.prefixes").cast("string").alias("prefixes"), F.array_join(F.from_json("pair", "array<string>"), ",").alias("synonyms"), "changed")


@query("SELECT c_custkey, CASE WHEN length(n) BETWEEN 2 AND 5 THEN 't_0123456789abcdef_' || n END AS name FROM (SELECT c_custkey, substr(regexp_replace(lower(substr(c_name, 1, CAST(c_custkey % 12 AS INTEGER))), '[^a-z]', '', 'g'), 1, 5) AS n FROM customer)")
def index_names_checked(spark, d):
    """Names of indexes by locales of any make; null where a name would be none."""
    c = src.read(spark, d, "customer")
    return c.select("c_custkey", K.index_names("t_0123456789abcdef", F.substring(F.col("c_name"), F.lit(1), (F.col("c_custkey") % 12).cast("int"))).alias("name"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'strict' ELSE 'balanced' END AS strictness FROM part WHERE p_partkey % 7 = 0")
def settings_of_sites(spark, d):
    """One setting of many sites, and none of sites that are not there."""
    p, i = src.read(spark, d, "part"), F.col("p_partkey")
    rows = p.where(i % 7 == 0).select(i.alias("id"), F.lit("").alias("locales"), F.lit("").alias("mode"), F.when(i % 3 == 0, "strict").otherwise("odd").alias("strictness"), F.lit("").alias("excluded"))
    return C.settings_table(rows).join(p.select(i.alias("id")).union(p.select(-i)), "id", "left_semi").select("id", "strictness")


# --- pages and files of other makes

@query(f"WITH {O.TREE} SELECT id FROM tree WHERE pid <> 0 AND id % 17 <> 0")
def pages_of_older_tables(spark, d):
    """Pages of a table that lacks the columns which later versions have: nothing is told to robots, nothing is left out."""
    return P.indexable_pages(src.site_pages(spark, d).drop("robots", "noSearch", "keywords", "pageTitle", "description")).select("id")


_POSTERS = _FOUND.replace("CASE part % 10 WHEN 0", "CASE part % 10 WHEN 2 THEN [md5('picture' || (part + 7))] WHEN 0")


@query(f"WITH RECURSIVE {_PAGES}, {_POSTERS} SELECT uuid, page_id FROM found")
def embedded_posters(spark, d):
    """Files that pages show, posters of films among them."""
    pages, articles, elements = _page_tables(spark, d)
    part = F.regexp_extract("text", "([0-9]+)</p>", 1).cast("long")
    return P.embeddings(pages, articles, elements.withColumn("posterSRC", F.when(part % 10 == 2, src.picture(part + 7))))

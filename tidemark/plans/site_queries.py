"""More of the engine's queries: answers of searches, documents of pages and files, live changes, tags, the store's upkeep."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.functions import text as T
from tidemark.operators import admin as A
from tidemark.operators import index as I
from tidemark.operators import live as L
from tidemark.operators import pages as P
from tidemark.operators import search as S
from tidemark.operators import settings as C
from tidemark.operators import site as W
from tidemark.operators import tagging as G
from tidemark.plans import oracle as O
from tidemark.plans.registry import ENABLED, _labelled, query
from tidemark.plans.registry import _BAD, _GOOD, _INDEXABLE, _ITEMS, _MEMBER, _R, _SQUEEZE, _TOXIC, _items
from tidemark.sources import extract as X
from tidemark.sources import site as src
from tidemark.streaming import feeds

# --- answers of searches

_WORDS = [{"text": "and"}, {"text": "worthles", "k": 1, "prefix": True}]
_ASKED = S.Request(query="and worthles", limit=20)
_HITS = O.search(_WORDS, False, limit=20)
#: All hits of the query, unordered and without a limit.
_ALL = _HITS[: _HITS.rindex("ORDER BY words")]
_RUNS = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+"


_FOLDED_WORD = f"regexp_replace({O.fold('x')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _marks(text: str) -> str:
    """Runs of text, marked where their folded form stands for a query word."""
    pairs = f"list_transform(regexp_extract_all({text}, '{_RUNS}'), lambda x: {{'r': x, 'f': {O.fold('x')}}})"
    return f"array_to_string(list_transform({pairs}, lambda p: CASE WHEN p.f = 'and' OR starts_with(p.f, 'worthles') OR (abs(length(p.f) - 8) <= 1 AND levenshtein(p.f, 'worthles') <= 1) THEN '<mark>' || p.r || '</mark>' ELSE p.r END), '')"


@query(f"""WITH hit AS ({_HITS}), {O.DOCS}, w AS (SELECT d.*, hit.score, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS w FROM docs d JOIN hit USING (id)),
 a AS (SELECT *, greatest(coalesce(list_position(list_transform(list_transform(w, lambda x: {_FOLDED_WORD}), lambda f: f = 'and' OR starts_with(f, 'worthles') OR (abs(length(f) - 8) <= 1 AND levenshtein(f, 'worthles') <= 1)), true), 1) - 1 - 15, 0) AS s FROM w),
 c AS (SELECT *, CASE WHEN s > 0 THEN '…' ELSE '' END || array_to_string(w[s + 1 : s + 30], ' ') || CASE WHEN len(w) > s + 30 THEN '…' ELSE '' END AS cropped FROM a)
 SELECT id, type, locale, {_marks('title')} AS title, url, {_marks('cropped')} AS snippet, array_to_string(tags, ',') AS tags, score, coalesce(is_protected, false) AS is_protected FROM c""")
def search_hits(spark, d):
    """A page of hits as a reader sees it."""
    docs = src.search_docs(spark, d)
    return S.hit_view(docs, S.search(docs, _ASKED), _ASKED).withColumn("tags", F.array_join("tags", ","))


@query(f"SELECT count(*) AS total_hits FROM ({_ALL})")
def search_total_hits(spark, d):
    return S.total_hits(src.search_docs(spark, d), _ASKED)


@query(f"WITH hit AS ({_ALL}), {O.DOCS}, m AS (SELECT * FROM docs WHERE id IN (SELECT id FROM hit)) SELECT 'type' AS facet, type AS value, count(*) AS n FROM m GROUP BY type UNION ALL SELECT 'locale', locale, count(*) FROM m GROUP BY locale UNION ALL SELECT 'tags', t, count(*) FROM (SELECT unnest(tags) AS t FROM m) GROUP BY t")
def search_facets(spark, d):
    """Facets over all that a search matches."""
    return S.matched_facets(src.search_docs(spark, d), _ASKED)


_LOCALES = ("fr", "en", "de")
_MERGED = f"WITH hit AS ({_ALL.replace(O.PUBLIC, O.PUBLIC + chr(32) + 'AND locale IN (' + chr(39) + 'fr' + chr(39) + ',' + chr(39) + 'en' + chr(39) + ',' + chr(39) + 'de' + chr(39) + ')')}), {O.DOCS}, r AS (SELECT hit.*, locale, row_number() OVER (PARTITION BY locale ORDER BY words DESC, typos, proximity, attr, indexed_at DESC, exact DESC, id) AS locale_rank FROM hit JOIN docs USING (id))"


@query(f"{_MERGED} SELECT id, locale, locale_rank::BIGINT AS locale_rank, score FROM r WHERE locale_rank <= 50 ORDER BY score DESC, list_position(['fr','en','de'], locale), locale_rank LIMIT 30 OFFSET 5")
def search_merged_by_score(spark, d):
    """Three locales' hits by score, the locales' order and rank."""
    found = S.merge_locales(src.search_docs(spark, d), replace(_ASKED, locales=_LOCALES, limit=30, offset=5))
    return found.select("id", "locale", F.col("locale_rank").cast("long").alias("locale_rank"), "score")


@query(f"{_MERGED} SELECT locale, count(*) AS hits FROM r GROUP BY locale UNION ALL SELECT 'all', count(*) FROM r")
def search_locale_totals(spark, d):
    return S.locale_totals(src.search_docs(spark, d), replace(_ASKED, locales=_LOCALES))


@query(f"SELECT id, '{{\"id\":\"' || id || '\",\"words\":' || words || ',\"typos\":' || typos || '}}' AS json FROM ({_HITS})")
def search_json(spark, d):
    return S.as_json(S.search(src.search_docs(spark, d), _ASKED), ["id", "words", "typos"])


@query("SELECT event_id, length(trim(q)) >= 3 AS accepted, least(greatest(user_id % 150 - 5, 1), 100)::BIGINT AS \"limit\" FROM (SELECT *, substr(event_type, 1, CAST(event_id % 5 AS INTEGER)) || ' ' AS q FROM events)")
def search_gate(spark, d):
    e = src.read(spark, d, "events")
    g = S.gate(F.concat(F.substring(F.col("event_type"), F.lit(1), (F.col("event_id") % 5).cast("int")), F.lit(" ")), F.col("user_id") % 150 - 5)
    return e.select("event_id", g.alias("g")).select("event_id", "g.accepted", F.col("g.limit").cast("long").alias("limit"))


_more = [{"text": "worthless", "alts": ["pathetic"], "k": 1, "prefix": True}]


@query(O.search(_more, False, limit=20))
def search_synonyms(spark, d):
    from tidemark.plans.registry import _typed

    return _typed(S.search(src.search_docs(spark, d), S.Request(query="worthless", limit=20), synonyms={"worthless": ["pathetic"]}))


@query(O.search([{"text": "worthles", "k": 1}], True, limit=20))
def search_strict_typo(spark, d):
    from tidemark.plans.registry import _typed

    return _typed(S.search(src.search_docs(spark, d), S.Request(query="worthles", strictness="strict", limit=20)))


def _indexed(spark, d, docs=None):
    """The search documents in an index that was written before."""
    kept = I.SearchIndex(spark, f"{feeds.scratch(spark)}/index-{uuid.uuid4().hex}")
    kept.write((src.search_docs(spark, d) if docs is None else docs).drop("doc_id"))
    return kept


@query(O.search([{"text": "and"}, {"text": "with"}, {"text": "clown", "prefix": True}], False, limit=50))
def search_over_postings(spark, d):
    """The same as search_ranked_topk from an index."""
    from tidemark.plans.registry import _typed

    return _typed(_indexed(spark, d).search(S.Request(query="and with clown", limit=50)))


@query(O.search([{"text": "pathetics", "k": 2, "prefix": True}, ], False, limit=20))
def index_typo_search(spark, d):
    """A mistyped word, found under what is left of it without a letter or two."""
    from tidemark.plans.registry import _typed

    return _typed(_indexed(spark, d).search(S.Request(query="pathetics", strictness="tolerant", limit=20)))


@query(O.search([{"text": "of"}, {"text": "the"}], False, phrase=["of", "the"]))
def index_phrase_search(spark, d):
    from tidemark.plans.registry import _typed

    return _typed(_indexed(spark, d).search(S.Request(query='"of the"', limit=20)))


@query(f"WITH hit AS ({_ALL}), {O.DOCS}, m AS (SELECT * FROM docs WHERE id IN (SELECT id FROM hit)) SELECT 'type' AS facet, type AS value, count(*) AS n FROM m GROUP BY type UNION ALL SELECT 'locale', locale, count(*) FROM m GROUP BY locale UNION ALL SELECT 'tags', t, count(*) FROM (SELECT unnest(tags) AS t FROM m) GROUP BY t UNION ALL SELECT 'total', 'hits', count(*) FROM m")
def index_facets(spark, d):
    """Facets and the total of all that a search matches, from an index: no texts are read."""
    kept = _indexed(spark, d)
    return kept.facets(_ASKED).unionByName(kept.total_hits(_ASKED).select(F.lit("total").alias("facet"), F.lit("hits").alias("value"), F.col("total_hits").alias("n")))


#: Documents with good labels have a new text, those with bad ones are gone.
_CHANGED_DOCS = f"{O.DOCS.replace('docs AS (', 'docs0 AS (')}, docs AS (SELECT id, type, locale, title, url, CASE WHEN {_GOOD} THEN 'worthless clown and ' || lang0 ELSE content END AS content, tags, is_protected, allowed_groups, CASE WHEN {_GOOD} THEN indexed_at + 5 ELSE indexed_at END AS indexed_at, doc_id FROM (SELECT *, locale AS lang0 FROM docs0) WHERE NOT {_BAD})"


@query(_HITS.replace(O.DOCS, _CHANGED_DOCS))
def index_changed_search(spark, d):
    """A search once an index has followed changes and deletions, its segments merged on the way."""
    from tidemark.plans.registry import _typed

    kept = _indexed(spark, d)
    changed = _labelled(spark, d, "quality = 1").drop("doc_id").withColumns({"content": F.concat(F.lit("worthless clown and "), "locale"), "indexed_at": F.col("indexed_at") + 5})
    for part in range(4):
        kept.upsert(changed.where(F.pmod(F.crc32("id"), F.lit(4)) == part))
    kept.delete(_labelled(spark, d, "quality = 0"))
    return _typed(kept.search(_ASKED))


@query(" UNION ALL ".join(f"SELECT {i} AS query_id, * FROM ({O.search(words, False, limit=10)})" for i, words in enumerate(([{"text": "and"}, {"text": "worthles", "k": 1, "prefix": True}], [{"text": "des", "prefix": False}], [{"text": "pathetic", "k": 1}, {"text": "idio", "prefix": True}]))))
def index_many_searches(spark, d):
    """Several queries at once."""
    asked = spark.createDataFrame([(0, "and worthles"), (1, "des"), (2, "pathetic idio")], "query_id int, query string")
    return _indexed(spark, d).search_many(asked, S.Request()).drop("rank")


# --- documents of pages and files

_PAGES = f"""{O.TREE}, sp AS (SELECT id, pid, title, language, protected, grp, url_suffix, CASE WHEN pid = 0 THEN 'root' ELSE 'regular' END AS type, CASE WHEN id % 50 = 0 THEN 'index' ELSE 'p' || id END AS alias, id % 17 <> 0 AS published,
 id % 13 = 0 AS noindex, id % 19 = 0 AS nosearch, ['k' || id % 5, 'k' || id % 3] AS keywords, CASE WHEN id % 2 = 0 THEN 'About ' || title END AS description, coalesce(CASE WHEN id % 4 = 0 THEN 'Page ' || id END, title) AS shown FROM tree),
 art AS (SELECT o_orderkey AS article, o_custkey + 1000 AS page_id, o_orderpriority AS title, o_orderstatus AS teaser, o_orderkey % 9 <> 0 AS main, o_orderkey % 8 <> 0 AS published FROM orders),
 el AS (SELECT l_orderkey * 10 + l_linenumber AS element, l_orderkey AS article, l_linenumber AS ord, l_partkey AS part, concat_ws(' ', CASE l_linenumber % 3 WHEN 0 THEN 'Line ' || l_linenumber WHEN 1 THEN l_returnflag END, '<p>' || l_linestatus || ' ' || l_partkey || '</p>') AS text, l_suppkey % 6 <> 0 AS visible FROM lineitem)"""
_INDEXED = "idx AS (SELECT * FROM sp WHERE type = 'regular' AND published AND NOT noindex AND NOT nosearch)"
_BODY = """shown AS (SELECT * FROM art WHERE main AND published), piece AS (SELECT page_id, article, -1 AS ord, 0 AS element, title || ' ' || teaser AS text FROM shown
 UNION ALL SELECT page_id, article, ord, element, el.text FROM el JOIN shown USING (article) WHERE visible),
 body AS (SELECT page_id, string_agg(text, ' ' ORDER BY article, ord, element, text) AS body FROM piece GROUP BY page_id)"""


def _page_tables(spark, d):
    return src.site_pages(spark, d), src.articles(spark, d), src.elements(spark, d)


@query(f"WITH RECURSIVE {_PAGES}, {_BODY} SELECT page_id, body FROM body")
def page_texts(spark, d):
    """Articles and elements of every page, in order."""
    _, articles, elements = _page_tables(spark, d)
    return P.page_texts(articles, elements)


@query(f"""WITH RECURSIVE {_PAGES}, {_INDEXED}, {_BODY}, {O.TAGS},
 loc AS (SELECT up.id, arg_min(a.language, up.depth) AS l FROM up JOIN tree a ON a.id = up.ancestor WHERE a.language <> '' GROUP BY up.id),
 rights AS (SELECT up.id, bool_or(t.protected) AS is_protected, coalesce(array_to_string(list_sort(list(DISTINCT t.grp) FILTER (t.protected)), ','), '') AS allowed_groups FROM up JOIN tree t ON t.id = up.ancestor GROUP BY up.id),
 suf AS (SELECT up.id, coalesce(nullif(a.url_suffix, ''), '.html') AS suffix FROM up JOIN tree a ON a.id = up.ancestor WHERE a.pid = 0),
 tagged AS (SELECT target_id + 1000 AS id, list_sort(list_distinct(flatten(list(['part-' || tag_id, label])))) AS found FROM assigned JOIN tags USING (tag_id) WHERE target_id % 2 = 1 GROUP BY target_id)
 SELECT 'page-' || i.id AS id, 'page' AS type, CASE WHEN l IN ('de', 'en') THEN l ELSE 'de' END AS locale, shown AS title, CASE WHEN alias = 'index' THEN '/' ELSE '/' || alias || suffix END AS url,
 {_SQUEEZE.format("regexp_replace(regexp_replace(concat_ws(' ', shown, description, array_to_string(keywords, ' '), body), '</?p>', ' ', 'g'), '<[^>]*>', '', 'g')")} AS content,
 array_to_string(coalesce(found, list_distinct(keywords)), '|') AS tags, 1600000000 + i.id AS published_at, is_protected, allowed_groups
 FROM idx i LEFT JOIN body ON page_id = i.id LEFT JOIN loc ON loc.id = i.id JOIN rights ON rights.id = i.id LEFT JOIN suf ON suf.id = i.id LEFT JOIN tagged ON tagged.id = i.id""".replace("array_to_string(coalesce(found, list_distinct(keywords)), '|')", "array_to_string(coalesce(found, CASE WHEN keywords[1] = keywords[2] THEN keywords[1:1] ELSE keywords END), '|')"))
def site_page_documents(spark, d):
    """Search documents of all indexable pages, whole texts."""
    chosen = src.typed_assignments(spark, d).where("target_type = 'page'").select("tag_id", (F.col("target_id").cast("long") + 1000).alias("target_id"))
    tagged = chosen.join(src.slugged_tags(spark, d), "tag_id")
    docs = P.page_documents(*_page_tables(spark, d), tagged, ENABLED, 7)
    return docs.select("id", "type", "locale", "title", "url", "content", F.array_join("tags", "|").alias("tags"), "published_at", "is_protected", F.array_join(F.col("allowed_groups").cast("array<string>"), ",").alias("allowed_groups"))


_FOUND = """pic AS (SELECT article, unnest(CASE part % 10 WHEN 0 THEN [md5('picture' || part)] WHEN 1 THEN [md5('picture' || part), md5('picture' || (part + 1))] ELSE [] END) AS uuid FROM el WHERE visible),
 found AS (SELECT DISTINCT uuid, page_id FROM pic JOIN art USING (article) WHERE art.published AND page_id IN (SELECT id FROM sp WHERE published))"""


@query(f"WITH RECURSIVE {_PAGES}, {_FOUND} SELECT uuid, page_id FROM found")
def embedded_files(spark, d):
    """Files that pages show, by single sources and serialised lists."""
    return P.embeddings(*_page_tables(spark, d))


@query(f"""WITH RECURSIVE {_PAGES}, {_FOUND}, loc AS (SELECT up.id, arg_min(a.language, up.depth) AS l FROM up JOIN tree a ON a.id = up.ancestor WHERE a.language <> '' GROUP BY up.id),
 c AS (SELECT uuid, CASE WHEN l IN ('de', 'en') THEN l ELSE 'de' END AS locale, count(*) AS n FROM found LEFT JOIN loc ON loc.id = page_id GROUP BY ALL) SELECT uuid, arg_min(locale, (-n, locale)) AS locale FROM c GROUP BY uuid""")
def embedded_file_locales(spark, d):
    pages, articles, elements = _page_tables(spark, d)
    return P.embedded_locales(P.embeddings(pages, articles, elements), W.page_locales(pages, ENABLED))


def _file_texts(spark, d):
    """A text for two files in three, by their ids."""
    i = F.col("id")
    return W.indexable_files(src.files(spark, d)).select("id", "path", F.concat(F.lit("<b>file</b> "), i, F.lit("  text")).alias("text"), F.when(i % 3 == 0, "empty_file").alias("reason"))


@query(f"""WITH {O.FILES}, x AS ({_INDEXABLE}), t AS (SELECT split_part(path, '/', 3) AS folder, path, id FROM x)
 SELECT 'file-path-' || md5(path) AS id, 'file' AS type, CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS locale, array_to_string(list_transform(string_split(trim(regexp_replace(lower(regexp_replace(split_part(path, '/', -1), '\\.[^./]+$', '')), '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
 '/' || path AS url, 'file ' || id || ' text' AS content, CASE WHEN id % 5 = 0 THEN 'L' || folder || '|s' || folder || '|' ELSE '' END || lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS tags, id % 4 = 0 AS is_protected FROM t WHERE id % 3 <> 0""")
def site_file_documents(spark, d):
    """Search documents of all files with a text."""
    texts = _file_texts(spark, d)
    files = texts.select("id", F.lit(None).cast("binary").alias("uuid"), "path")
    i, folder = F.col("id"), F.split("path", "/")[2]
    locales = files.select("id", F.when(i % 2 == 0, "en").otherwise("de").alias("locale"))
    rights = files.select("id", (i % 4 == 0).alias("is_protected"), F.array().cast("array<int>").alias("allowed_groups"))
    tagged = files.where(i % 5 == 0).select(F.col("path").alias("target_id"), F.concat(F.lit("s"), folder).alias("slug"), F.concat(F.lit("L"), folder).alias("label"))
    return P.file_documents(files, texts, locales, rights, tagged, 7).select("id", "type", "locale", "title", "url", "content", F.array_join("tags", "|").alias("tags"), "is_protected")


@query(f"""WITH {O.FILES}, x AS ({_INDEXABLE}), p AS (SELECT id, path, list_transform(string_split(path, '/')[1:-2], lambda s: regexp_extract(lower(s), '^([a-z]{{2}})([_-][a-z]{{2}})?$', 1)) AS parts,
 regexp_extract(lower(regexp_replace(split_part(path, '/', -1), '\\.[^./]+$', '')), '[._-]([a-z]{{2}})([_-][a-z]{{2}})?$', 1) AS n, CASE WHEN id % 7 = 0 THEN 'EN' WHEN id % 7 = 1 THEN 'xx' END AS o, CASE WHEN id % 3 = 0 THEN 'de' WHEN id % 3 = 1 THEN 'fr' END AS e FROM x)
 SELECT id, coalesce(CASE WHEN lower(o) IN ('de', 'en') THEN lower(o) END, CASE WHEN e IN ('de', 'en') THEN e END, list_filter(parts, lambda s: s IN ('de', 'en'))[1], CASE WHEN n IN ('de', 'en') THEN n END, 'de') AS locale FROM p""")
def file_locale_rules(spark, d):
    """All five rules: override, pages that show the file, folders, name, default."""
    i = F.col("id")
    override, shown = F.when(i % 7 == 0, "EN").when(i % 7 == 1, "xx"), F.when(i % 3 == 0, "de").when(i % 3 == 1, "fr")
    return W.indexable_files(src.files(spark, d)).select("id", W.file_locale(override, shown, F.col("path"), ENABLED).alias("locale"))


@F.pandas_udf(BinaryType())
def _packed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The bytes of a file of some kind that holds a text."""
    import html

    def one(k: str, t: str) -> bytes:
        if k in ("docx", "odt"):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml" if k == "docx" else "content.xml", f"<w:p>{html.escape(t)}</w:p>")
            return out.getvalue()
        if k == "rtf":
            return b"{\\rtf1\\ansi " + "".join(c if c.isascii() and c not in "\\{}\n" else f"\\u{ord(c)}?" for c in t).encode() + b"}"
        return t.encode() if k != "pdf" else b"%PDF-1.4 no end"

    for kinds, texts in batches:
        for some in X.pieces((one(k, t) for k, t in zip(kinds, texts, strict=True)), len):
            yield pd.Series(some, dtype="object")


_KINDS = ("txt", "md", "docx", "odt", "rtf", "pdf", "exe")
_CLEAN = "regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} .,]', ' ', 'g'), ' +', ' ', 'g')"


@query(f"""WITH k AS (SELECT doc_id, [{', '.join(f"'{k}'" for k in _KINDS)}][doc_id % 7 + 1] AS kind, CASE WHEN doc_id % 20 = 7 THEN '' ELSE trim({_CLEAN}) END AS t FROM documents)
 SELECT doc_id, kind, CASE WHEN kind IN ('txt', 'md', 'docx', 'odt', 'rtf') AND t <> '' THEN t END AS text, CASE WHEN kind = 'pdf' THEN 'pdf_eof_missing_corrupt' WHEN kind = 'exe' THEN 'unsupported_extension_exe' WHEN t <> '' THEN NULL
 WHEN kind IN ('docx', 'odt') THEN kind || '_empty' WHEN kind = 'rtf' THEN 'rtf_empty_after_strip' ELSE 'empty_file' END AS reason FROM k""")
def file_texts(spark, d):
    """Texts of files of seven kinds, made from the documents' words, read back whole."""
    i = F.col("doc_id")
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N} .,]", " "), " +", " "))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (i % 7).cast("int") + 1)
    made = src.spread(src.read(spark, d, "documents")).select("doc_id", kind.alias("kind"), F.when(i % 20 == 7, "").otherwise(plain).alias("t")).withColumn("bytes", _packed("kind", "t"))
    return made.withColumn("e", X.extracted(F.col("kind"), F.col("bytes"))).select("doc_id", "kind", "e.text", "e.reason")


@query("SELECT reason, CASE WHEN reason LIKE 'empty%' THEN 'The file has no text' WHEN reason LIKE 'pdf%' THEN 'The PDF is damaged or too complex' WHEN reason LIKE 'unsupported%' THEN 'This kind of file is not indexed' ELSE 'The document is empty or damaged' END AS shown FROM (SELECT DISTINCT ['empty_file', 'pdf_eof_missing_corrupt', 'docx_empty', 'unsupported_extension_exe'][doc_id % 4 + 1] AS reason FROM documents)")
def reasons_shown(spark, d):
    reason = F.element_at(F.array(*map(F.lit, ("empty_file", "pdf_eof_missing_corrupt", "docx_empty", "unsupported_extension_exe"))), (F.col("doc_id") % 4).cast("int") + 1)
    return src.read(spark, d, "documents").select(reason.alias("reason")).distinct().withColumn("shown", X.humanized(F.col("reason")))


# --- trees, changes and live decisions


@query(_R + "SELECT up.id, max(up.depth)::INTEGER AS depth, string_agg(lpad((a.id % 7)::VARCHAR, 12, '0') || lpad(a.id::VARCHAR, 12, '0'), '/' ORDER BY up.depth DESC) AS at FROM up JOIN tree a ON a.id = up.ancestor GROUP BY up.id")
def tree_depth_first(spark, d):
    tree = src.page_tree(spark, d).withColumn("sorting", F.col("id") % 7)
    return P.depth_first(tree).withColumn("depth", F.col("depth").cast("int"))


@query(f"WITH RECURSIVE {_PAGES} SELECT DISTINCT c_custkey AS page_id FROM customer WHERE c_custkey % 3 = 0 UNION SELECT page_id FROM art WHERE article % 50 = 0 UNION SELECT page_id FROM el JOIN art USING (article) WHERE element % 100 = 3")
def changed_pages(spark, d):
    """Pages that own changed pages, articles and elements."""
    _, articles, elements = _page_tables(spark, d)
    table = lambda name, df: df.select(F.lit(name).alias("table"), F.col("id"))
    pages = src.read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    changes = table("page", pages).unionByName(table("article", articles.where("id % 50 = 0"))).unionByName(table("content", elements.where("id % 100 = 3")))
    return P.owning_pages(changes, articles, elements)


_RIGHTS = "rights AS (SELECT up.id, bool_or(t.protected) AS is_protected FROM up JOIN tree t ON t.id = up.ancestor GROUP BY up.id)"


@query(f"""WITH RECURSIVE {_PAGES}, {_RIGHTS}, c AS (SELECT DISTINCT o_custkey * 2 + 1000 AS page_id FROM orders) SELECT page_id, 'page-' || page_id AS id, CASE WHEN sp.id IS NULL THEN 'ignore' WHEN NOT published THEN 'delete' WHEN type = 'root' THEN 'ignore' WHEN noindex OR nosearch THEN 'delete' WHEN is_protected THEN 'delete' ELSE 'index' END AS action
 FROM c LEFT JOIN sp ON sp.id = page_id LEFT JOIN rights ON rights.id = page_id""")
def live_page_changes(spark, d):
    """Saved pages, half of which are gone: indexed, deleted or ignored."""
    changed = src.read(spark, d, "orders").select((F.col("o_custkey") * 2 + 1000).alias("page_id"))
    return L.page_changes(changed, src.site_pages(spark, d), W.page_permissions(src.page_tree(spark, d)))


@query(f"""WITH {O.FILES}, f AS (SELECT path, min(id) AS id FROM files GROUP BY path) SELECT path, 'file-path-' || md5(path) AS id, CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ('pdf','txt','md','docx','odt','rtf') THEN 'ignore'
 WHEN regexp_matches(path, '^files/docs/') THEN 'delete' WHEN id % 4 = 0 THEN 'delete' WHEN id % 3 = 0 THEN 'ignore' ELSE 'index' END AS action FROM f""")
def live_file_changes(spark, d):
    """Uploaded files: kinds, an excluded folder, protection, and files without a text."""
    files = src.files(spark, d).groupBy("path").agg(F.min("id").alias("id"))
    rights = files.select("path", (F.col("id") % 4 == 0).alias("is_protected"))
    texts = files.select("path", F.when(F.col("id") % 3 == 0, "empty_file").alias("reason"))
    return L.file_changes(files.withColumn("uuid", F.lit(None).cast("binary")), rights, texts, L.Live(excluded=("files/docs/**",)))


@query(f"WITH {O.DOCS} SELECT id, mode, {'{}'} AS reason FROM docs, (SELECT unnest(['whitelist', 'with_protected', 'blacklist', 'odd']) AS mode)".format("CASE WHEN regexp_matches(lower(url), '^/files/src1[0-9]/.*$') THEN 'pattern_excluded' WHEN mode = 'whitelist' AND NOT regexp_matches(lower(url), '^/files/[^/]*/en/.*$') THEN 'not_in_whitelist' WHEN mode = 'odd' THEN 'unknown_mode' END"))
def index_modes(spark, d):
    """What the other modes of indexing say of every document."""
    docs, out = src.search_docs(spark, d), None
    for mode in ("whitelist", "with_protected", "blacklist", "odd"):
        told = W.decision(mode, F.col("url"), F.col("is_protected"), ("/files/src1?/**",), ("/files/*/en/**",))
        part = docs.select("id", F.lit(mode).alias("mode"), told["reason"].alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def _store(spark, d):
    store = feeds.scratch_store(spark)
    store.write(src.search_docs(spark, d).drop("doc_id"))
    return store


@query(f"WITH {_ITEMS} SELECT id, locale FROM docs WHERE id IN (SELECT id FROM items WHERE reason IS NULL)")
def reindex_finalize(spark, d):
    """The store after a run: what the plan doesn't include is gone."""
    store = _store(spark, d)
    L.finalize(store, _items(spark, d))
    return store.read().select("id", "locale")


@query(f"WITH {O.DOCS} SELECT id, locale FROM docs WHERE locale <> 'fr' OR doc_id % 2 = 0 AND {_GOOD}")
def purge_locale(spark, d):
    """One locale's partition is emptied, then some of its documents come again."""
    store = _store(spark, d)
    store.upsert(_labelled(spark, d, "quality = 0").drop("doc_id"))
    store.purge("fr")
    store.upsert(_labelled(spark, d, "quality = 1").where("doc_id % 2 = 0").drop("doc_id"))
    return store.read().select("id", "locale")


@query(f"WITH {O.DOCS} SELECT id, locale FROM docs WHERE {O.PUBLIC}")
def store_delete_protected(spark, d):
    store = _store(spark, d)
    store.delete_protected()
    return store.read().select("id", "locale")


@query(f"WITH {O.DOCS} SELECT id, CASE WHEN id = 'file-7' THEN 'new' ELSE title END AS title FROM docs WHERE id <> 'file-9'")
def reindex_single(spark, d):
    """One document is indexed again, one is no longer there."""
    store, docs = _store(spark, d), src.search_docs(spark, d).where("id <> 'file-9'").withColumn("title", F.lit("new")).drop("doc_id")
    for item in ("file-7", "file-9"):
        L.reindex_one(store, docs, item)
    return store.read().select("id", "title")


@query(f"WITH {O.DOCS} SELECT id, CASE WHEN doc_id % 3 = 1 THEN 'en' ELSE 'de' END AS locale FROM docs WHERE doc_id % 3 < 2 AND locale <> CASE WHEN doc_id % 3 = 1 THEN 'en' ELSE 'de' END")
def locale_moves(spark, d):
    """Documents whose files got another locale, or the default one back, in the partition where they belong now."""
    docs = src.search_docs(spark, d)
    i = F.col("doc_id")
    changes = docs.select("id", F.when(i % 3 == 0, "").when(i % 3 == 1, "EN").otherwise("xx").alias("locale"))
    return L.move_locale(docs, changes, ENABLED, "de").select("id", "locale")


@query("SELECT DISTINCT lang AS locale, 'strict' AS strictness, 8 AS one_typo, 12 AS two_typos, false AS prefixes, false AS written_again FROM documents")
def index_settings(spark, d):
    """Each locale's settings, kept as a table; setting equal ones again changes nothing."""
    wanted = A.index_configs(src.read(spark, d, "documents").select(F.col("lang").alias("locale")), "strict")
    path = f"{feeds.scratch(spark)}/settings-{uuid.uuid4().hex}"
    A.ensured(None, wanted).write.parquet(path)
    told = A.ensured(spark.read.parquet(path), wanted).withColumn("c", F.from_json("config", "strictness string, one_typo int, two_typos int, prefixes boolean"))
    return told.select("locale", "c.strictness", "c.one_typo", "c.two_typos", "c.prefixes", F.col("changed").alias("written_again"))


@query(f"WITH {O.FILES}, c AS (SELECT id, ['files/intern', 'files/admin', 'files/other'][id % 3 + 1] AS path, id % 2 = 0 AS folder FROM files) SELECT path, md5(min(id)::VARCHAR) AS uuid FROM c WHERE folder AND path <> 'files/other' GROUP BY path")
def seeded_folders(spark, d):
    """Folders that a new site leaves out, whatever rows repeat them."""
    i = F.col("id")
    path = F.element_at(F.array(*map(F.lit, ("files/intern", "files/admin", "files/other"))), (i % 3).cast("int") + 1)
    rows = src.files(spark, d).select("id", F.unhex(F.md5(i.cast("string"))).alias("uuid"), path.alias("path"), F.when(i % 2 == 0, "folder").otherwise("file").alias("type"))
    return L.seeded_folders(rows).select("path", F.lower(F.hex("uuid")).alias("uuid"))


@query(f"WITH {O.FILES} SELECT path, md5(min(id) FILTER (id % 4 <> 0)::VARCHAR) AS uuid FROM files GROUP BY path HAVING count(*) FILTER (id % 4 <> 0) > 0")
def uuid_by_path(spark, d):
    """Paths to uuids; those that are not 16 bytes long do not count."""
    uuid_ = F.when(F.col("id") % 4 == 0, F.lit("short").cast("binary")).otherwise(F.unhex(F.md5(F.col("id").cast("string"))))
    return L.uuid_of_path(src.files(spark, d).withColumn("uuid", uuid_))


# --- tags

_TAGGED = f"{O.TAGS}, tag AS (SELECT tag_id, 'part-' || tag_id AS slug, label FROM tags)"


@query(f"WITH {_TAGGED} SELECT tag_id, slug, label FROM tag WHERE slug = 'part-17'")
def tag_by_slug(spark, d):
    return G.by_slug(src.slugged_tags(spark, d), "part-17")


@query(f"WITH {_TAGGED} SELECT tag_id, slug, label FROM tag ORDER BY label, tag_id")
def tags_by_label(spark, d):
    return G.by_label(src.slugged_tags(spark, d))


@query(f"WITH {_TAGGED} SELECT a.target_id, string_agg(slug, '|' ORDER BY label, slug) AS slugs FROM assigned a JOIN tag USING (tag_id) WHERE a.target_id % 2 = 0 GROUP BY a.target_id")
def tags_of_targets(spark, d):
    """Tags of half the targets, by label."""
    a = src.tag_assignments(spark, d)
    found = G.of_targets(src.slugged_tags(spark, d), a, a.where("target_id % 2 = 0"))
    return found.select("target_id", F.array_join(F.transform("tags", lambda t: t["slug"]), "|").alias("slugs"))


@query(f"WITH {_TAGGED} SELECT slug FROM assigned JOIN tag USING (tag_id) WHERE target_id = (SELECT max(l_orderkey) FROM lineitem) ORDER BY label, slug")
def slugs_of_target(spark, d):
    last = src.read(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return G.slugs_of(src.slugged_tags(spark, d), src.tag_assignments(spark, d), last)


@query(f"WITH {O.TAGS} SELECT CASE WHEN target_id % 2 = 1 THEN 'page' ELSE 'file' END AS target_type, target_id::VARCHAR AS target_id FROM assigned WHERE tag_id = 5")
def targets_of_tag(spark, d):
    return G.targets_of(src.typed_assignments(spark, d), 5)


_WANTED = f"want AS (SELECT DISTINCT {O.slug('p_type')} AS slug, 'page' AS target_type, p_partkey::VARCHAR AS target_id FROM part WHERE p_partkey % 2 = 0), named AS (SELECT {O.slug('p_type')} AS slug, min(trim(p_type)) AS label FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), fresh AS (SELECT slug, label, row_number() OVER (ORDER BY slug) + (SELECT max(p_partkey) FROM part) AS tag_id FROM named)"


def _bulk(spark, d):
    p = src.read(spark, d, "part").where("p_partkey % 2 = 0")
    wanted = p.select(F.col("p_type").alias("label"), F.lit("page").alias("target_type"), F.col("p_partkey").cast("string").alias("target_id"))
    wanted = wanted.unionByName(p.select(F.lit("x").alias("label"), F.lit("odd").alias("target_type"), F.lit("1").alias("target_id")))
    return G.bulk_assign(src.slugged_tags(spark, d), src.typed_assignments(spark, d), wanted)


@query(f"WITH {_TAGGED}, {_WANTED} SELECT tag_id, slug, label FROM tag UNION ALL SELECT tag_id, slug, label FROM fresh")
def tags_ensured(spark, d):
    """Tags after a bulk assignment: missing ones are made."""
    return _bulk(spark, d)[0]


@query(f"WITH {_TAGGED}, {_WANTED} SELECT tag_id, CASE WHEN target_id % 2 = 1 THEN 'page' ELSE 'file' END AS target_type, target_id::VARCHAR AS target_id FROM assigned UNION SELECT tag_id, target_type, target_id FROM want JOIN fresh USING (slug)")
def tags_bulk_assigned(spark, d):
    return _bulk(spark, d)[1]


@query("SELECT DISTINCT 'page' AS target_type, p_partkey::VARCHAR AS target_id FROM part WHERE p_partkey % 2 = 0")
def tags_bulk_reindexed(spark, d):
    """Targets of a bulk assignment, to be indexed again."""
    return _bulk(spark, d)[2]


@query(f"WITH {O.TAGS} SELECT tag_id, target_id FROM assigned WHERE tag_id % 3 <> 0 AND target_id % 5 <> 0")
def tags_unassigned(spark, d):
    """Some assignments and some tags go, with all of the latter's assignments."""
    a = src.tag_assignments(spark, d)
    left = A.unassign(a, a.where("target_id % 5 = 0"))
    return A.delete_tags(src.slugged_tags(spark, d), left, src.slugged_tags(spark, d).where("tag_id % 3 = 0"))[1]


@query(f"""WITH {O.DOCS}, raw AS (SELECT unnest([tags[1], upper(tags[1]), 'Source ' || tags[1]]) AS value, generate_subscripts([1, 2, 3], 1) AS k FROM docs), n AS (SELECT value, count(*) AS n FROM raw GROUP BY value)
 SELECT slug, 'Source ' || slug AS label, max(n) AS n FROM (SELECT CASE WHEN starts_with(value, 'Source ') THEN value[8:] ELSE value END AS slug, n FROM n) WHERE slug IN (SELECT tags[1] FROM docs) GROUP BY slug
 UNION ALL SELECT value, value, n FROM n WHERE NOT starts_with(value, 'Source ') AND value NOT IN (SELECT tags[1] FROM docs)""")
def tag_facets_by_slug(spark, d):
    """Raw facets of slugs and labels meet in their tags; others stay as they are."""
    source = F.element_at("tags", 1)
    docs = src.search_docs(spark, d)
    raw = docs.select(F.explode(F.array(source, F.upper(source), F.concat(F.lit("Source "), source))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    tags = docs.select(source.alias("slug"), F.concat(F.lit("Source "), source).alias("label")).distinct()
    return P.canonical_tag_facets(raw, tags)


# --- lists, settings, functions


@query(f"WITH {O.DOCS} SELECT id, title FROM docs ORDER BY indexed_at DESC, id LIMIT 100")
def admin_list(spark, d):
    return A.latest(src.search_docs(spark, d)).select("id", "title")


@query("SELECT count(*) AS documents, greatest(ceil(count(*) / 50.0), 1)::BIGINT AS pages FROM documents")
def browser_pages(spark, d):
    return A.page_count(src.search_docs(spark, d))


@query(f"WITH {O.DOCS} SELECT lower(locale) AS index_locale, count(*) AS documents, max(indexed_at) AS last_update, least(100, round(count(*) * 100.0 / 400))::BIGINT AS percent FROM docs GROUP BY 1")
def index_statistics(spark, d):
    return W.index_stats(src.search_docs(spark, d), 400)


@query("SELECT p_partkey, array_to_string(list_filter([p_size, -3, p_partkey % 4], lambda x: x > 0), ',') AS groups FROM part")
def serialised_groups(spark, d):
    """Member groups in two serialised spellings, read on a column."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    plain = F.concat(F.lit("a:3:{i:0;i:"), size, F.lit(";i:1;i:-3;i:2;i:"), (k % 4).cast("string"), F.lit(";}"))
    quoted = F.concat(F.lit("a:3:{i:0;s:"), F.length(size), F.lit(':"'), size, F.lit('";i:1;s:2:"-3";i:2;s:1:"'), (k % 4).cast("string"), F.lit('";}'))
    blob = F.when(k % 2 == 0, plain).otherwise(quoted)
    return src.read(spark, d, "part").select("p_partkey", F.array_join(T.serialised_ints(blob).cast("array<string>"), ",").alias("groups"))


@query(f"WITH RECURSIVE {_PAGES} SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'Line ' || l_linenumber WHEN 1 THEN l_returnflag ELSE '' END AS headline FROM lineitem")
def headline_texts(spark, d):
    return src.elements(spark, d).select("id", T.headline_text(F.col("headline")).alias("headline"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS shown, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM orders")
def dates_shown_and_parsed(spark, d):
    """Dates as they are shown, and read again from three spellings."""
    o = src.read(spark, d, "orders").withColumn("shown", T.shown_date(F.col("o_orderdate")))
    k = F.col("o_orderkey") % 3
    spelt = F.when(k == 0, F.col("shown")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise((F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 86400).cast("string"))
    return o.select("o_orderkey", "shown", T.parsed_date(spelt).cast("string").alias("parsed"))


@query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END || CASE WHEN p_partkey % 2 = 0 THEN '|own' ELSE '' END AS globs FROM part")
def glob_lists_joined(spark, d):
    own = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("own"), F.col("p_brand")))
    return src.read(spark, d, "part").select("p_partkey", F.array_join(W.both_lists(F.array("p_brand"), F.array("p_type", "p_brand"), own), "|").alias("globs"))


@query("SELECT doc_id, 'quality' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keyed_union(spark, d):
    rows = lambda name, origin: src.read(spark, d, name).select("doc_id", F.lit(origin).alias("origin"))
    return W.keyed_union(rows("labels", "quality"), rows("documents", "document"), "doc_id")


@query(f"WITH {O.EVENTS} SELECT q, locale, count(*) AS n, sum(results)::BIGINT AS results FROM ev GROUP BY ALL")
def event_sink(spark, d):
    """Search events kept in a sink in two appends, and reported from it."""
    folder, events = f"{feeds.scratch(spark)}/events-{uuid.uuid4().hex}", src.search_events(spark, d)
    for part in (events.where("results % 2 = 0"), events.where("results % 2 <> 0")):
        feeds.record_events(part, folder)
    return feeds.recorded(spark, folder).groupBy("q", "locale").agg(F.count("*").alias("n"), F.sum("results").alias("results"))


@query(f"SELECT p_partkey, {O.slug('p_name')} AS slug, {O.fold('p_type')} AS folded, lower(regexp_extract('a/b.' || p_brand, '\\.([^./]+)$', 1)) AS ext FROM part")
def sql_functions(spark, d):
    """The functions that a session can call in SQL."""
    T.register(spark)
    return src.read(spark, d, "part").selectExpr("p_partkey", "slugify(p_name) AS slug", "fold_text(p_type) AS folded", "file_extension('a/b.' || p_brand) AS ext")


@query("SELECT page_id, CASE WHEN octet_length(encode(url)) <= 40 THEN url ELSE substr(url, 1, list_max(list_filter(range(0, 41), lambda i: octet_length(encode(substr(url, 1, i))) <= 40))) END AS cut FROM (SELECT page_id, 'é' || url || 'ü' || url AS url FROM pages)")
def cut_to_bytes(spark, d):
    """Texts cut to a number of bytes, never inside a character."""
    url = F.concat(F.lit("é"), "url", F.lit("ü"), "url")
    return src.read(spark, d, "pages").select("page_id", T.cut_bytes(url, 40).alias("cut"))


@query("SELECT user_id, regexp_replace(['DE!', 'e-n', '', 'fr1'][user_id % 4 + 1], '[^a-z]', '', 'g') AS raw, coalesce(nullif(regexp_replace(['DE!', 'e-n', '', 'fr1'][user_id % 4 + 1], '[^a-z]', '', 'g'), ''), 'de') AS locale FROM (SELECT DISTINCT user_id FROM events)")
def request_locales(spark, d):
    """Locales of requests, cleaned."""
    said = F.element_at(F.array(*map(F.lit, ("DE!", "e-n", "", "fr1"))), (F.col("user_id") % 4).cast("int") + 1)
    clean = C.locale_column(said)
    return src.read(spark, d, "events").select("user_id").distinct().select("user_id", F.regexp_replace(said, "[^a-z]", "").alias("raw"), clean.alias("locale"))


# --- scans of a crawl, settings, and small functions on columns


@query(f"WITH RECURSIVE {_PAGES} SELECT id FROM sp WHERE type = 'regular' AND published")
def crawl_pages(spark, d):
    return P.crawled_pages(src.site_pages(spark, d)).select("id")


@query(f"WITH {O.FILES} SELECT id, path FROM files WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('pdf','txt','md','docx','odt','rtf')")
def crawl_files(spark, d):
    return P.crawled_files(src.files(spark, d)).select("id", "path")


@query(f"WITH RECURSIVE {_PAGES} SELECT id, CASE WHEN id % 3 = 0 THEN title WHEN id % 3 = 1 THEN '/' || alias ELSE '#' || id END AS label FROM sp")
def tree_labels(spark, d):
    """Labels of a tree whose rows lack titles or aliases."""
    tree = src.site_pages(spark, d).withColumns({"title": F.when(F.col("id") % 3 == 0, F.col("title")), "alias": F.when(F.col("id") % 3 < 2, F.col("alias")).otherwise("")})
    return A.decorate(tree, tree.select("id").limit(0)).select("id", "label")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'de' ELSE 'en|fr' END AS locales, CASE WHEN p_partkey % 4 = 1 THEN 'whitelist' ELSE 'public_only' END AS mode, CASE WHEN p_partkey % 2 = 0 THEN 'strict' ELSE 'balanced' END AS strictness, CASE WHEN p_partkey % 5 = 0 THEN 'files/intern/**|files/admin/**|files/private/**' ELSE p_brand END AS excluded FROM part")
def settings_loaded(spark, d):
    """Settings with defaults for what is missing or unknown."""
    k = F.col("p_partkey")
    rows = src.read(spark, d, "part").select(k.alias("id"), F.when(k % 3 != 0, " en, ,fr").alias("locales"), F.when(k % 4 == 1, "whitelist").otherwise("odd").alias("mode"), F.when(k % 2 == 0, "strict").alias("strictness"), F.when(k % 5 == 0, "# none\n").otherwise(F.concat(F.lit("# one\r\n "), "p_brand", F.lit(" \n"))).alias("excluded"))
    return C.settings_table(rows).select("id", F.array_join("locales", "|").alias("locales"), "mode", "strictness", F.array_join("excluded", "|").alias("excluded"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'a=de' END AS overrides, p_name || '|' || p_name || '/**' AS globs FROM part")
def overrides_and_globs(spark, d):
    """Overrides read from JSON, broken ones too, and folders as globs."""
    text = F.when(F.col("p_partkey") % 3 == 0, '["no object"').otherwise('{"a": "DE", "b": "xx"}')
    shown = F.transform(F.map_entries(C.overrides_column(text, ENABLED)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return src.read(spark, d, "part").select("p_partkey", F.array_join(shown, ",").alias("overrides"), F.array_join(C.globs_column(F.concat(F.lit("/"), "p_name", F.lit("/"))), "|").alias("globs"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN '' WHEN l < 60 THEN printf('%.1f/s · ETA %ds', p, l) WHEN l < 3600 THEN printf('%.1f/s · ETA %dm %ds', p, l // 60, l % 60) ELSE printf('%.1f/s · ETA %dh %dm', p, l // 3600, l % 3600 // 60) END AS eta
 FROM (SELECT o_orderkey, o_custkey, o_custkey / 7.0::DOUBLE AS p, CASE WHEN o_custkey > 0 THEN CAST(ceil(greatest(o_orderkey - o_custkey, 0) / (o_custkey / 7.0::DOUBLE)) AS INTEGER) END AS l FROM orders)""")
def eta_shown(spark, d):
    return src.read(spark, d, "orders").select("o_orderkey", C.eta_column(F.col("o_custkey"), F.col("o_orderkey"), F.lit(7.0)).alias("eta"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unauthorized' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'search_failed' ELSE 'search_failed' END AS error, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN lang ELSE 'de' END AS locale FROM documents")
def errors_and_module_locales(spark, d):
    i = F.col("doc_id") % 4
    code = F.element_at(F.array(*map(F.lit, (401, 429, 500, 777))), i.cast("int") + 1)
    return src.read(spark, d, "documents").select("doc_id", A.error_names(code).alias("error"), A.module_locales(F.when(i == 0, "EN_us").otherwise(""), F.when(i == 1, F.col("lang"))).alias("locale"))


@query(f"SELECT page_id, replace(replace(replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>') AS shown, regexp_replace(u, 'https?', '<mark>\\0</mark>', 'g') AS marked FROM (SELECT page_id, url || '?a=1&b=<c>' AS u FROM pages)".replace("SELECT page_id, replace", "SELECT page_id, replace", 1))
def unmarked_urls(spark, d):
    """Marked texts made safe for display, their marks kept."""
    url = F.concat("url", F.lit("?a=1&b=<c>"))
    return src.read(spark, d, "pages").select("page_id", T.unmark(url).alias("shown"), F.regexp_replace(url, "https?", "<mark>$0</mark>").alias("marked"))


@query("SELECT page_id, 'x  y' AS plain, 'file ' || page_id || ' ä+b.pdf' AS file FROM pages".replace("'x  y'", "'x y'"))
def plain_and_file_names(spark, d):
    """Serialised blocks leave texts; files are shown by the last part of their URL."""
    i = F.col("page_id")
    text = F.concat(F.lit('x a:2:{s:5:"value";s:1:"'), i, F.lit('";s:4:"unit";a:1:{i:0;i:1;}} y'))
    url = F.concat(F.lit("/files/a%20b/file%20"), i, F.lit("%20%C3%A4+b.pdf"))
    return src.read(spark, d, "pages").select("page_id", T.normalize(text).alias("plain"), T.pretty_url(url, F.lit("file")).alias("file"))


@query(f"WITH {O.DOCS} SELECT id, CASE WHEN {_GOOD} THEN 'extra ' || id END AS extra FROM docs")
def additive_schema(spark, d):
    """A store whose documents got a column later: older rows have none."""
    store = _store(spark, d)
    store.upsert(_labelled(spark, d, "quality = 1").drop("doc_id").withColumn("extra", F.concat(F.lit("extra "), "id")))
    return store.read().select("id", "extra")


@query(f"WITH {O.DOCS} SELECT id, title FROM docs")
def stream_uploads(spark, d):
    """Uploaded files as a stream of changes into an empty store."""
    changes = src.search_docs(spark, d, streaming=True).withColumns({"op": F.lit("upsert"), "ts": F.col("indexed_at")}).drop("doc_id")
    store = feeds.scratch_store(spark)
    feeds.follow(changes, store, f"{store.path}-progress").awaitTermination()
    return store.read().select("id", "title")


@query("SELECT 'pages' AS off, 'ignore' AS action, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'files', 'ignore', count(DISTINCT p_name) FROM part")
def live_off(spark, d):
    """What saves and uploads do while live indexing is off."""
    changed = src.read(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("page_id"))
    pages = L.page_changes(changed, src.site_pages(spark, d), W.page_permissions(src.page_tree(spark, d)), L.Live(pages=False))
    files = src.read(spark, d, "part").select(F.concat("p_name", F.lit(".txt")).alias("path"), F.lit(None).cast("binary").alias("uuid"))
    none = files.select("path", F.lit(False).alias("is_protected"), F.lit(None).cast("string").alias("reason"))
    told = pages.select(F.lit("pages").alias("off"), "action").unionByName(L.file_changes(files, none, none, L.Live(files=False)).select(F.lit("files").alias("off"), "action"))
    return told.groupBy("off", "action").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS batch, count(*) AS rows, false AS active FROM documents")
def stream_heartbeat(spark, d):
    """What a run told of itself while it was on, from the rows that a listener wrote."""
    changes = src.search_docs(spark, d, streaming=True).withColumns({"op": F.lit("upsert"), "ts": F.col("indexed_at")}).drop("doc_id")
    store = feeds.scratch_store(spark)
    listener = feeds.Progress(spark, f"{store.path}-told")
    spark.streams.addListener(listener)
    try:
        q = feeds.follow(changes, store, f"{store.path}-progress")
        q.awaitTermination()
        told = lambda: feeds.run_progress(spark.read.schema(feeds.PROGRESS).parquet(listener.folder))
        for _ in range(100):  # the last event comes a moment after the end
            if store._names_of(listener.folder) and not told().where("state IN ('ended', 'failed')").isEmpty():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    return told().select(F.col("last_batch").alias("batch"), "rows", (~F.col("state").isin("ended", "failed")).alias("active"))


_OLDER = f"{O.DOCS} SELECT id, locale, CASE WHEN {_GOOD} AND NOT ({_TOXIC}) THEN 'newer' ELSE title END AS title FROM docs WHERE NOT ({_TOXIC})"


@query(f"WITH {_OLDER}")
def stream_out_of_order(spark, d):
    """Changes that come late: documents with good labels have a newer title, toxic ones are deleted, and then older changes of all come."""
    store = feeds.scratch_store(spark)
    old = src.search_docs(spark, d, streaming=True).withColumns({"op": F.lit("upsert"), "ts": F.col("indexed_at")})
    newer = _labelled(spark, d, "quality = 1 OR toxic = 1").join(src.read(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    newer = newer.withColumns({"title": F.lit("newer"), "ts": F.col("indexed_at") + 5, "op": F.when(F.col("toxic") == 1, "delete").otherwise("upsert")}).drop("toxic", "doc_id")
    feeds.apply_changes(newer, store, "first")
    feeds.follow(old.drop("doc_id"), store, f"{store.path}-progress").awaitTermination()
    feeds.apply_changes(newer.withColumns({"title": F.lit("oldest"), "ts": F.col("ts") - 9, "op": F.lit("upsert")}), store, "late")
    return store.read().select("id", "locale", "title")


@query(f"WITH {O.DOCS} SELECT id, {'{}'} AS reason FROM docs".format("CASE WHEN doc_id % 5 = 0 THEN 'pattern_excluded' END"))
def default_exclusions(spark, d):
    """Documents in the folders that are left out by default."""
    i = F.col("doc_id")
    path = F.concat(F.when(i % 5 == 0, F.element_at(F.array(*map(F.lit, ("files/intern", "FILES/Admin", "files/private"))), (i % 3).cast("int") + 1)).otherwise("files/open"), F.lit("/a/b.txt"))
    told = W.decision("with_protected", path, F.lit(False))
    return src.search_docs(spark, d).select("id", told["reason"].alias("reason"))


@query("SELECT count(*) > 0 AS there, false AS missing FROM documents")
def tables_probed(spark, d):
    """Whether tables are there before they are asked."""
    name = f"probe_{uuid.uuid4().hex}"
    src.read(spark, d, "documents").createOrReplaceTempView(name)
    there, missing = (spark.catalog.tableExists(x) for x in (name, f"{name}_no"))
    spark.catalog.dropTempView(name)
    return spark.createDataFrame([(there, missing)], "there boolean, missing boolean")

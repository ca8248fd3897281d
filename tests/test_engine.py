import random

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import search as S
from tidemark.operators import settings as C
from tidemark.operators import site as W
from tidemark.operators.store import MOST_CHANGES, Store, index_name
from tidemark.sources import extract as X
from tidemark.streaming.feeds import apply_changes, windowed_analytics

DOCS = [
    ("page-1", "de", "Hafenrundfahrt", "Die Rundfahrt startet im Hafen. Große Maße, kleine Boote.", ["hafen"], False, []),
    ("page-2", "de", "Bootsverleih", "Boote im Hafen mieten. Hafen ist offen.", ["hafen", "Hafen"], None, []),
    ("page-3", "de", "Mitglieder", "Interne Hafen-Preise", [], True, [3]),
    ("page-4", "de", "Vorstand", "Interne Protokolle", [], True, []),
    ("file-ab01", "de", "Café Karte", "Heiße Getränke, Café au lait", ["pdf"], False, []),
    ("file-ab02", "en", "Harbour Guide", "The harbour guide", ["pdf", "hafen"], False, []),
]
SCHEMA = "id string, locale string, title string, content string, tags array<string>, is_protected boolean, allowed_groups array<int>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({"indexed_at": F.lit(1).cast("long"), "type": F.lit("page")}).cache()


@pytest.mark.parametrize(
    ("q", "strictness", "groups", "expected"),
    [
        ("hafen", "balanced", (), {"page-1", "page-2"}), ("hafen", "balanced", (3,), {"page-1", "page-2", "page-3"}), ("protokolle", "balanced", (3, 7), set()),
        ("cafe", "balanced", (), {"file-ab01"}), ("masse", "balanced", (), {"page-1"}), ("Rundfart", "balanced", (), {"page-1"}), ("Rundfart", "strict", (), {"page-1"}),
        ("Hefen", "strict", (), set()), ("boote hafen", "strict", (), {"page-1", "page-2"}), ("boote protokolle", "strict", (), set()), ('"im hafen"', "balanced", (), {"page-1", "page-2"}),
    ],
)
def test_search(docs, q, strictness, groups, expected):
    found = S.search(docs, S.Request(q, strictness, ("de",), groups)).collect()
    assert {r.id for r in found} == expected
    assert all(0 <= r.score <= 1 for r in found)
    if groups == ():  # postings that were built before give the same
        assert S.search(docs, S.Request(q, strictness, ("de",), groups), S.postings(docs, ["indexed_at"])).collect() == found


def test_browse_by_tag_and_undeclared_field(docs):
    assert {r.id for r in S.search(docs, S.Request(locales=("de",), filters={"tags": ["hafen"]})).collect()} == {"page-1", "page-2"}
    with pytest.raises(ValueError, match="can't be filtered"):
        S.user_filter({"content": "x"})


def test_nothing_protected_leaks_and_facets_add_up(docs):
    public = docs.where(S.visible((0, -1)))
    assert public.where("is_protected").count() == 0
    n = {(r.facet, r.value): r.n for r in S.facets(public).collect()}
    assert sum(v for (f, _), v in n.items() if f == "locale") == public.count() == n["type", "page"]


def test_rewrite():
    assert S.rewrite('a "b c"', "strict") == ([[S.Token("a", True)], [S.Token("b", True), S.Token("c", True)]], True)
    assert S.rewrite("de")[0] == [[S.Token("de", True)]]
    assert S.rewrite("", "balanced") == ([], False)


SLUGS = [("Spongebob", "spongebob"), ("Krabbenburger XXL", "krabbenburger-xxl"), ("Über uns", "ueber-uns"), ("Café", "cafe"), ("  Whitespace  ", "whitespace"), ("UPPERCASE", "uppercase"), ("multi---dash", "multi-dash"), ("Maße & Gewichte", "masse-gewichte"), ("", "")]


def test_slugify(spark):
    df = spark.createDataFrame([*SLUGS, ("a" * 200, "a" * 64)], "a string, b string")
    assert df.where(T.slugify(F.col("a")) != F.col("b")).count() == 0


def test_references_end_with_a_semicolon(spark):
    texts = ["a &amp;amp; b&amp", "&amp;&ampx &notit; &copy2", "&#65;&#x42;&#67 &hellip;&nosuch; &am"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.normalize(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == ["a &amp; b&amp", "&&ampx &notit; &copy2", "AB&#67 …&nosuch; &am"]


def test_long_pages_stay_whole(spark, tmp_path):
    from tidemark.plans import registry as R

    body = "wörd " * 30000
    spark.createDataFrame([(1, "http://a/b", f"<html><body><p>{body}</p>end</body></html>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [R.QUERIES[q](spark, str(tmp_path)).first().content for q in ("normalize_html", "page_documents")] == [body + "end"] * 2


def test_normalize_and_display(spark):
    row = spark.createDataFrame([("<p>A&amp;B</p><script>x<y</script>c\u00ad d &lt;b&gt;", "ä" * 40000)], "h string, long string")
    out = row.select(T.normalize(F.col("h")).alias("n"), F.octet_length(T.cut_bytes(F.col("long"), 60001)).alias("cut"), T.unmark(T.highlight(F.lit("a<b The end"), ["the"])).alias("m"), T.crop(F.lit("a b c d x e f"), ["x"], 4).alias("c")).first()
    assert (out.n, out.cut, out.m, out.c) == ("A&B c d <b>", 60000, "a&lt;b <mark>The</mark> end", "…c d x e…")


def test_names_and_urls(spark):
    r = spark.range(1).select(T.humanize_filename(F.lit("files/a/my_file-name.pdf")).alias("a"), T.strip_host(F.lit("https://x.y/p?q=1#f")).alias("b"), T.strip_host(F.lit("//h/z")).alias("c"), T.pretty_url(F.lit("/files/a%20b.pdf"), F.lit("file")).alias("d"), T.page_url(F.lit("index"), F.lit(None)).alias("e")).first()
    assert tuple(r) == ("My File Name", "/p?q=1", "/z", "a b.pdf", "/")


TREE = [(1, 0, "Root", "de", False, 0, None), (2, 1, "A", None, True, 3, None), (3, 2, "B", None, True, 7, None), (4, 1, "C", None, False, 9, None), (5, 1, "D", "en", False, 0, None)]


def test_tree(spark):
    tree = spark.createDataFrame(TREE, "id long, pid long, title string, language string, protected boolean, grp int, url_suffix string")
    assert {r.id: (r.is_protected, r.allowed_groups) for r in W.page_permissions(tree).collect()} == {1: (False, []), 2: (True, [3]), 3: (True, [3, 7]), 4: (False, []), 5: (False, [])}
    assert {r.id: r.locale for r in W.page_locales(tree, ["de", "en"]).collect()} == {1: "de", 2: "de", 3: "de", 4: "de", 5: "en"}
    assert {r.id: r.breadcrumb for r in W.breadcrumbs(tree).collect()}[3] == "Root › A › B"
    all_of = {r.id: tuple(r)[1:] for r in W.inherited(tree, ["de", "en"]).collect()}
    assert all_of[3] == (True, [3, 7], "de", "Root › A › B", ".html") and all_of[5] == (False, [], "en", "Root › D", ".html")


def test_lineages_of_deep_broken_and_cyclic_trees(spark):
    rng = random.Random(3)
    pid = {i: rng.randint(0, i - 1) for i in range(1, 150)}
    pid |= {200 + i: 199 + i if i else 0 for i in range(70)}  # deeper than what is followed
    pid |= {300: 301, 301: 302, 302: 300, 303: 301, 400: 999, 401: 400, 500: 500}  # cycles, a parent that is not there
    tree = spark.createDataFrame([(i, p, f"t{i}") for i, p in pid.items()], "id long, pid long, title string")
    expected = set()
    for i in pid:
        at, depth = i, 0
        while at and depth <= W.MOST_DEPTH:
            expected.add((i, at, depth))
            at, depth = pid.get(at, 0), depth + 1
    assert {tuple(r) for r in W.closure(tree).collect()} == expected
    shown = {r.id: r.breadcrumb for r in W.breadcrumbs(tree).collect()}
    assert shown[401] == "t400 › t401" and len(shown) == len(pid)
    assert W.closure(tree.limit(0)).collect() == [] and W.inherited(tree.limit(0).withColumns({"protected": F.lit(True), "grp": F.lit(1), "language": F.lit("de"), "url_suffix": F.lit("")}), ["de"]).collect() == []


@pytest.mark.parametrize(("pattern", "path", "match"), [("files/intern/*", "files/intern/a.pdf", True), ("files/intern/*", "files/intern/x/a.pdf", False), ("files/intern/**", "files/intern/x/a.pdf", True), ("files/_*", "files/_tmp", True), ("FILES/a?.md", "files/ab.md", True)])
def test_glob(pattern, path, match):
    import re

    assert bool(re.match(W.glob(pattern), path)) is match


@pytest.mark.parametrize(("path", "override", "embedded", "expected"), [("files/de/a.pdf", "en", None, "en"), ("files/de/b.pdf", None, "en", "en"), ("files/en_US/d.pdf", None, None, "en"), ("files/x/manual-en.pdf", None, None, "en"), ("files/fr/e.pdf", None, None, "de")])
def test_file_locale(spark, path, override, embedded, expected):
    c = lambda v: F.lit(v).cast("string")
    assert spark.range(1).select(W.file_locale(c(override), c(embedded), F.lit(path), ["de", "en"])).first()[0] == expected


@pytest.mark.parametrize(("mode", "path", "protected", "expected"), [("blacklist", "files/intern/x/y", False, (False, "pattern_excluded")), ("public_only", "a", True, (False, "protected_excluded")), ("with_protected", "a", True, (True, None)), ("whitelist", "a", False, (False, "not_in_whitelist")), ("blacklist", "a", None, (True, None)), ("odd", "a", False, (False, "unknown_mode"))])
def test_decision(spark, mode, path, protected, expected):
    assert tuple(spark.range(1).select(W.decision(mode, F.lit(path), F.lit(protected).cast("boolean"))).first()[0]) == expected


def test_plan(spark):
    items = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, None)], "id string, include boolean, is_protected boolean")
    known = spark.createDataFrame([("a",), ("z",), ("c",)], "id string")
    stats = W.plan_stats(W.plan(items, known)).first()
    assert (stats.total, stats.new, stats.existing, stats.excluded, stats.public, stats.protected) == (3, 1, 1, 1, 2, 1)
    assert {r.id for r in W.orphans(items, known).collect()} == {"z", "c"}


def test_store_and_changes(spark, tmp_path, docs):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read() is None and store.delete_protected() == 0
    store.write(docs)
    assert store.delete_protected() == 2
    store.upsert(docs.where("id = 'page-1'").withColumns({"title": F.lit("new"), "indexed_at": F.lit(9).cast("long")}))
    assert store.read().where("id = 'page-1'").first().title == "new"
    feed = docs.where("id IN ('page-2', 'file-ab01')").withColumn("op", F.when(F.col("id") == "page-2", "delete").otherwise("upsert")).withColumn("ts", F.lit(1)).withColumn("locale", F.when(F.col("id") == "file-ab01", "en").otherwise("de"))
    for _ in range(2):  # again gives the same
        apply_changes(feed, store)
        assert {(r.id, r.index_locale) for r in store.read().collect()} == {("page-1", "de"), ("file-ab01", "en"), ("file-ab02", "en")}
    assert store.purge("en") == 2 and store.delete(docs.where("id = 'page-1'")) == 1 and store.delete(docs) == 0
    assert store.purge() == 0 and store.read().count() == 0
    for n in range(MOST_CHANGES + 1):  # changes are merged into a new base on the way
        store.upsert(docs.where("id = 'page-1'").unionByName(docs.where("id = 'page-1'").withColumn("title", F.lit(str(n))).withColumn("indexed_at", F.lit(2).cast("long"))))
    assert [r.title for r in store.read().collect()] == [str(MOST_CHANGES)]
    assert store.vacuum() > MOST_CHANGES and store.read().count() == 1
    assert index_name("t_0123456789abcdef", "de-AT") == "t_0123456789abcdef_deat"
    with pytest.raises(ValueError, match="no index name"):
        index_name("x", "de")


def test_events(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1, 12)
    rows = [("a", "de", 1, ts), ("  hafen ", "DE", 0, ts), ("x" * 300, "en", -3, ts)]
    events = spark.createDataFrame(rows, "q string, locale string, results int, ts timestamp")
    assert {(len(r.q), r.locale, r.results) for r in W.valid_events(events).collect()} == {(5, "de", 0), (255, "en", 0)}
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed_analytics(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, windowed_analytics(events).collect()))


def _zip(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, body)
    return out.getvalue()


@pytest.mark.parametrize(
    ("kind", "data", "expected"),
    [
        ("txt", b"  ", (None, "empty_file")), ("TXT", "ä".encode(), ("ä", None)), ("exe", b"x", (None, "unsupported_extension_exe")), ("pdf", b"x", (None, "pdf_header_missing")), ("pdf", b"%PDF-1", (None, "pdf_eof_missing_corrupt")),
        ("pdf", b"%PDF-1 %%EOF" + b" " * (2 << 20), (None, "file_too_large_3_mb")), ("pdf", None, (None, "file_not_readable")), ("docx", b"x", (None, "docx_zip_open_failed")), ("docx", _zip("word/document.xml", "<w:p>A&amp;b</w:p><w:p>c</w:p>"), ("A&b\nc", None)),
        ("odt", _zip("content.xml", "<text:p>hi</text:p>"), ("hi", None)), ("rtf", rb"{\rtf1 Gr\'fc\'df \u228?gern\par x}", ("Grüß ägern x", None)),
    ],
)
def test_extract(kind, data, expected):
    assert X.extract(kind, data, most_mb=2) == expected


def test_settings(spark):
    s = C.settings({"locales": "de, en", "mode": "odd", "excluded": "# no\nfiles/x/**", "overrides": '{"a": "EN", "b": "fr"}'})
    assert (s.locales, s.mode, s.excluded, s.overrides) == (("de", "en"), "public_only", ("files/x/**",), {"a": "en"})
    assert C.member_groups('a:2:{i:0;s:1:"3";i:1;i:7;}') == [3, 7] and C.member_groups([0, -1, "5"]) == [5]
    assert C.folder_globs("/a/") == ["a", "a/**"] and C.request_locale("DE") == "de" and C.request_tags(["A b", ""]) == ["ab"]
    assert C.eta(1, 61, 1) == "1 min 0 s"
    hits = spark.createDataFrame([("1", ["pdf", "Hafen", "hafen", "Odd One"])], "id string, tags array<string>")
    tags = spark.createDataFrame([("hafen", "Hafen")], "slug string, label string")
    assert [tuple(t) for t in C.resolve_hit_tags(hits, tags).first().tags] == [("hafen", "Hafen"), ("odd-one", "Odd One")]

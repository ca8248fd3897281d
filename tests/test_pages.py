from pyspark.sql import functions as F

from tidemark.operators import pages as P

PAGES = [
    (1, 0, "root", "", "Root", "de", "1", "", 0, None), (2, 1, "regular", "a", "A", "", "1", "", 3, "x, y"), (3, 1, "regular", "b", "B", "en", "1", "noindex,follow", 0, None),
    (4, 1, "forward", "c", "C", "", "", "", 0, None), (5, 1, "regular", "index", "D", "en", "1", "", 0, None),
]
UUID, OTHER = bytes(range(16)), bytes([34] * 16)


def tables(spark):
    pages = spark.createDataFrame(PAGES, "id long, pid long, type string, alias string, title string, language string, published string, robots string, grp int, keywords string").withColumn("protected", F.when(F.col("id") == 2, "1").otherwise(""))
    articles = spark.createDataFrame([(10, 2, "Art", "", "main", "1"), (11, 2, "Side", "", "left", "1"), (12, 5, "Five", "t", "main", "1")], "id long, pid long, title string, teaser string, inColumn string, published string")
    blob = b'a:2:{i:0;s:16:"' + UUID + b'";i:1;s:16:"' + OTHER + b'";}'
    rows = [(100, 10, "H2", "<p>two</p>", "", 2, None, None), (101, 10, "", "one", "", 1, UUID, None), (102, 10, "", "gone", "1", 3, None, None), (103, 12, "", "x", "", 1, None, blob)]
    elements = spark.createDataFrame(rows, "id long, pid long, headline string, text string, invisible string, sorting long, singleSRC binary, multiSRC binary")
    return pages, articles, elements


def test_page_documents(spark):
    pages, articles, elements = tables(spark)
    tags = spark.createDataFrame([(5, "hafen", "Hafen")], "target_id long, slug string, label string")
    got = {r.id: r for r in P.page_documents(pages, articles, elements, tags, ["de", "en"], 7).collect()}
    assert set(got) == {"page-2", "page-5"}
    a, d = got["page-2"], got["page-5"]
    assert (a.content, a.url, a.locale, a.tags, a.is_protected, a.allowed_groups, a.indexed_at) == ("A x y Art one H2 two", "/a.html", "de", ["x", "y"], True, [3], 7)
    assert (d.content, d.url, d.locale, d.tags, d.is_protected) == ("D Five t x", "/", "en", ["Hafen", "hafen"], False)


def test_files(spark):
    pages, articles, elements = tables(spark)
    found = P.embeddings(pages, articles, elements)
    assert {(r.uuid, r.page_id) for r in found.collect()} == {(UUID.hex(), 2), (UUID.hex(), 5), (OTHER.hex(), 5)}
    locales = spark.createDataFrame([(2, "de"), (5, "en")], "id long, locale string")
    assert {r.uuid: r.locale for r in P.embedded_locales(found, locales).collect()} == {UUID.hex(): "de", OTHER.hex(): "en"}
    files = spark.createDataFrame([(1, UUID, "f/a/x_de.txt"), (2, OTHER, "f/b/y.txt"), (3, None, "f/a/pub/z.txt")], "id long, uuid binary, path string")
    folders = spark.createDataFrame([("f/a", True, [9])], "path string, protected boolean, groups array<int>")
    markers = spark.createDataFrame([("f/a/pub",)], "path string")
    rights = spark.createDataFrame([(2, [3]), (5, [])], "id long, allowed_groups array<int>")
    got = P.file_permissions(files, folders, markers, found, rights).cache()
    assert {r.id: (r.is_protected, r.allowed_groups) for r in got.collect()} == {1: (True, [3]), 2: (False, []), 3: (False, [9])}
    texts = spark.createDataFrame([("f/a/x_de.txt", "a <b>b</b>", None), ("f/b/y.txt", None, "empty_file")], "path string, text string, reason string")
    tags = spark.createDataFrame([("f/a/x_de.txt", "t", "T")], "target_id string, slug string, label string")
    doc = P.file_documents(files, texts, spark.createDataFrame([(1, "de"), (2, "de")], "id long, locale string"), got, tags, 7).collect()
    assert [(r.id, r.title, r.content, r.tags) for r in doc] == [(f"file-{UUID.hex()}", "X De", "a b", ["T", "t", "txt"])]


def test_tree_view_and_changes(spark):
    pages, articles, elements = tables(spark)
    tree = spark.createDataFrame([(1, 0, 1), (2, 1, 20), (3, 1, 10), (4, 2, 1)], "id long, pid long, sorting long")
    assert [r.id for r in P.depth_first(tree).orderBy("at").collect()] == [1, 3, 2, 4]
    changes = spark.createDataFrame([("page", 4), ("article", 12), ("content", 101), ("content", 999)], "table string, id long")
    assert {r.page_id for r in P.owning_pages(changes, articles, elements).collect()} == {4, 5, 2}
    raw = spark.createDataFrame([("hafen", 3), ("Hafen", 5), ("odd", 9)], "value string, n long")
    tags = spark.createDataFrame([("hafen", "Hafen")], "slug string, label string")
    assert [tuple(r) for r in P.canonical_tag_facets(raw, tags).collect()] == [("odd", "odd", 9), ("hafen", "Hafen", 5)]

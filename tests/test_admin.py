import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import admin as A
from tidemark.operators import site as W
from tidemark.streaming import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([(1, "Boat trip"), (2, "boat TRIP"), (3, "Hafen"), (4, "!!")], "tag_id long, label string")


def test_slugs_and_renames(spark, tags):
    slugs = A.unique_slugs(tags)
    assert rows(slugs.select("tag_id", "slug")) == [(1, "boat-trip"), (2, "boat-trip-2"), (3, "hafen")]
    assigned = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (3, 12), (9, 13)], "tag_id long, target_id long")
    renames = spark.createDataFrame([(3, "Boat Trip"), (1, "BOAT trip"), (77, "x")], "tag_id long, label string")
    new, targets = A.rename(slugs, renames, assigned)
    assert rows(new.select("tag_id", "slug", "label")) == [(1, "boat-trip", "BOAT trip"), (2, "boat-trip-2", "boat TRIP"), (3, "boat-trip-3", "Boat Trip")]
    assert rows(targets) == [(11,), (12,)]
    left, kept = A.delete_tags(slugs, assigned, renames.where("tag_id = 3"))
    assert rows(left.select("tag_id")) == [(1,), (2,)] and kept.count() == 3
    assert A.unassign(assigned, assigned.where("tag_id = 3")).count() == 3
    crumbs = spark.createDataFrame([(10, "Root › A")], "id long, breadcrumb string")
    assert rows(A.tag_details(slugs, assigned, crumbs)) == [(1, "Boat trip", 10, "Root › A"), (2, "boat TRIP", 10, "Root › A")]


def test_tree_plan_and_resume(spark):
    tree = spark.createDataFrame([(1, 0, "root", "R"), (2, 1, "regular", ""), (3, 2, "regular", "C")], "id long, pid long, type string, title string")
    assert rows(A.decorate(tree, tree.where("id = 3"))) == [(1, 0, "R", True, False, True), (2, 1, "#2", True, False, False), (3, 2, "C", False, True, True)]
    items = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "id string, include boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(A.resume(items, ids("a", "a"), ids("b", "z"))) == [("a", "skip"), ("b", "skip"), ("d", "index")]
    assert W.diff_report(items, ids("a", "b", "b", "c", "z")).first().asDict() == {"on_site": 3, "in_index": 4, "both": 2, "missing": 1, "orphans": 2}
    assert [r.id for r in A.preview(W.plan(items, ids("a")), 1).collect()] == ["b"]


@pytest.mark.parametrize(("total", "started", "now", "expected"), [(8, 10, 20, (50, True)), (4, 10, 20, (100, False)), (3, 10, 20, (100, False)), (0, 0, 0, (0, False)), (8, 10, 5000, (50, False))])
def test_run_state(spark, total, started, now, expected):
    r = A.run_state(spark.range(4), total, started, now).first()
    assert (r.percent, r.running) == expected and r.indexed == 4


def test_small_ones(spark, tags):
    ids = spark.createDataFrame([("page-7",), ("file-" + "a" * 32,), ("file-path-" + "b" * 32,), ("odd",), (None,)], "id string")
    got = {r.id: tuple(r.i) for r in ids.select("id", A.item_of(F.col("id")).alias("i")).collect()}
    assert got == {"page-7": ("page", 7, None, None), "file-" + "a" * 32: ("file", None, "a" * 32, None), "file-path-" + "b" * 32: ("file", None, None, "b" * 32), "odd": (None,) * 4, None: (None,) * 4}
    current = spark.createDataFrame([("a", "de"), ("b", "de"), ("c", "de")], "path string, locale string")
    changes = spark.createDataFrame([("a", ""), ("b", "EN"), ("c", "xx"), ("d", "en"), ("e", None)], "path string, locale string")
    assert rows(A.set_overrides(current, changes, ["de", "en"])) == [("b", "en"), ("c", "de"), ("d", "en")]
    assert A.index_config("de", "odd", {"a": ["b"]}).synonyms == (("a", ("b",)),) and A.index_config("en", "strict", {"a": ["b"]}) == A.index_config("en", "strict") and not A.index_config("en", "strict").prefixes
    assert (A.module_locale("EN-us", "fr"), A.module_locale("", "fr"), A.module_locale(None, None)) == ("en", "fr", "de")
    assert (A.RequestError(402).name, A.RequestError(418).name) == ("subscription_inactive", "search_failed")
    assert spark.range(1).select(T.pretty_url(F.lit("/a+b%20c"), F.lit("page"))).first()[0] == "/a+b c"


def test_windows_of_a_stream_without_events(spark, tmp_path):
    schema = "q string, locale string, results int, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    assert feeds.run_windowed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).count() == 0


def test_suggested_tags_and_tags_of_keywords(spark):
    from tidemark.operators import tagging as G

    tags = spark.createDataFrame([(1, "Große Bären"), (2, "Bär"), (3, "baer-en"), (4, None)], "tag_id long, label string")
    assert [r.tag_id for r in G.suggested(tags, " BÄR").collect()] == [2, 1]
    assert [r.tag_id for r in G.suggested(tags, "baer").collect()] == [2, 1, 3] and G.suggested(tags, "", 2).count() == 2
    rows = spark.createDataFrame([("Bär, news ,,",), (" bär,News",), (None,), ("",)], "k string")
    assert {(r.slug, r.label, r.n) for r in G.from_keywords(F.col("k"), rows).collect()} == {("baer", "Bär", 2), ("news", "News", 2)}

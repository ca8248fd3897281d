"""Live decisions, the store's upkeep, tags, answers of searches and file kinds, on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import admin as A
from tidemark.operators import live as L
from tidemark.operators import pages as P
from tidemark.operators import search as S
from tidemark.operators import site as W
from tidemark.operators import tagging as G
from tidemark.operators.store import Store
from tidemark.sources import extract as X
from tidemark.streaming import feeds

DOC = "id string, type string, locale string, title string, url string, content string, tags array<string>, is_protected boolean, allowed_groups array<int>, indexed_at long"


def documents(spark, rows):
    return spark.createDataFrame([(i, "page", loc, title, f"/{i}", text, ["t"], False, [], at) for i, loc, title, text, at in rows], DOC)


def held(store):
    return {(r.id, r.locale, r.title) for r in store.read().collect()}


def test_store_purges_partitions_and_breaks_ties(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write(documents(spark, [("a", "de", "A", "", 1), ("b", "en", "B", "", 1), ("c", "fr", "C", "", 1)]))
    store.upsert(documents(spark, [("d", "fr", "D", "", 2), ("b", "fr", "B2", "", 2)]))
    before = {p.name for p in (tmp_path / "store").iterdir()}
    assert store.purge("fr") == 3 and held(store) == {("a", "de", "A")}
    assert {p.name for p in (tmp_path / "store").iterdir()} == before  # nothing was written anew
    store.upsert(documents(spark, [("c", "fr", "C2", "", 3)]))
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert held(store) == {("c", "fr", "C2")}
    assert store.purge() == 1 and held(store) == set()
    same = documents(spark, [("x", "de", "one", "", 5), ("x", "de", "two", "", 5)])
    seen = set()
    for df in (same, same.orderBy(F.desc("title")), same.repartition(3)):
        store.upsert(df)
        seen |= held(store)
    assert len(seen) == 1
    got = W.upsert(documents(spark, [("x", "de", "old", "", 5)]), documents(spark, [("x", "de", "new", "", 5)])).collect()
    assert [r.title for r in got] == ["new"]  # the last write counts
    assert store.ensure(A.index_config("de")) and not store.ensure(A.index_config("de")) and store.ensure(A.index_config("de", "strict"))
    assert store.config("de")["strictness"] == "strict" and store.config("en") is None


def test_store_merges_only_the_locales_that_changed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write(documents(spark, [("a", "de", "A", "", 1), ("b", "en", "B", "", 1), ("c", "fr", "C", "", 1), ("n", "", "N", "", 1)]))
    store.upsert(documents(spark, [("d", "de", "D", "", 2)]))
    store.upsert(documents(spark, [("b", "de", "B2", "", 2)]))  # moves from one locale to another
    store.delete(spark.createDataFrame([("zzz",)], "id string"))
    expected = {("a", "de", "A"), ("b", "de", "B2"), ("c", "fr", "C"), ("d", "de", "D"), ("n", "", "N")}
    assert held(store) == expected
    store.merge()
    assert held(store) == expected
    m = store._manifest()
    assert not m["changes"] and [sorted(b[2]) for b in m["base"]] == [["", "fr"], ["de"]]
    store.purge("fr")
    store.upsert(documents(spark, [("n", "fr", "N2", "", 3)]))
    expected = {("a", "de", "A"), ("b", "de", "B2"), ("d", "de", "D"), ("n", "fr", "N2")}
    assert held(store) == expected
    store.merge()
    assert held(store) == expected and store.vacuum() > 0 and held(store) == expected
    for i in range(17):
        store.upsert(documents(spark, [(f"x{i}", "it", f"X{i}", "", i)]))
    assert len(held(store)) == 21 and len(store._manifest()["base"]) >= 2


def test_live_changes(spark, tmp_path):
    rows = [(1, "root", "r", "1", "", ""), (2, "regular", "a", "1", "", ""), (3, "regular", "b", "", "", ""), (4, "regular", "c", "1", "NoIndex,follow", ""), (5, "regular", "d", "1", "", "1"), (6, "regular", "e", "1", "", ""), (7, "regular", "", "1", "", "")]
    pages = spark.createDataFrame(rows, "id long, type string, alias string, published string, robots string, noSearch string")
    rights = spark.createDataFrame([(i, i == 6) for i in range(1, 8)], "id long, is_protected boolean")
    changed = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 4, 5, 6, 7, 99)], "page_id long")
    act = lambda live: {r.page_id: r.action for r in L.page_changes(changed, pages, rights, live).collect()}
    assert act(L.Live()) == {1: "ignore", 2: "index", 3: "delete", 4: "delete", 5: "delete", 6: "delete", 7: "index", 99: "ignore"}
    assert act(L.Live(mode="with_protected", excluded=("page/a",)))[6] == "index" and act(L.Live(excluded=("page/a", "page/7"))) | {2: 0, 7: 0} == act(L.Live()) | {2: 0, 7: 0}
    assert act(L.Live(excluded=("page/a", "page/7")))[7] == "delete"
    assert set(act(L.Live(pages=False)).values()) == {"ignore"}
    files = spark.createDataFrame([("f/a.txt", None), ("f/b.exe", None), ("f/c.pdf", None), ("f/d.md", bytes(16)), ("intern/e.md", None)], "path string, uuid binary")
    file_rights = spark.createDataFrame([("f/d.md", True), ("f/a.txt", False)], "path string, is_protected boolean")
    texts = spark.createDataFrame([("f/a.txt", None), ("f/c.pdf", "pdf_header_missing"), ("intern/e.md", None)], "path string, reason string")
    got = {r.path: r.action for r in L.file_changes(files, file_rights, texts, L.Live(excluded=("intern/**",))).collect()}
    assert got == {"f/a.txt": "index", "f/b.exe": "ignore", "f/c.pdf": "ignore", "f/d.md": "delete", "intern/e.md": "delete"}
    store = Store(spark, f"file://{tmp_path}/live")
    store.write(documents(spark, [("page-2", "de", "old", "", 1), ("page-3", "de", "gone", "", 1), ("page-8", "de", "kept", "", 1)]))
    L.carry_out(store, L.page_changes(changed, pages, rights), documents(spark, [("page-2", "de", "new", "", 2), ("page-3", "de", "no", "", 2)]))
    assert held(store) == {("page-2", "de", "new"), ("page-8", "de", "kept")}
    assert L.finalize(store, spark.createDataFrame([("page-2", True), ("page-8", False)], "id string, include boolean")) == 1
    assert L.reindex_one(store, documents(spark, [("page-9", "en", "nine", "", 3)]), "page-9") and not L.reindex_one(store, documents(spark, []), "page-2")
    assert held(store) == {("page-9", "en", "nine")}
    with pytest.raises(L.NotConfigured):
        L.finalize(None, pages)


def test_locale_moves_and_folders(spark):
    docs = documents(spark, [("a", "de", "", "", 1), ("b", "en", "", "", 1), ("c", "en", "", "", 1)])
    changes = spark.createDataFrame([("a", "EN"), ("b", ""), ("c", "xx"), ("z", "de")], "id string, locale string")
    assert {(r.id, r.locale) for r in L.move_locale(docs, changes, ["de", "en"], "de").collect()} == {("a", "en"), ("b", "de")}
    assert [r.f for r in spark.createDataFrame([("x.txt",), ("a/b/c.txt",)], "path string").select(P.folders_above(F.col("path")).alias("f")).collect()] == [[], ["a", "a/b"]]
    none = F.lit(None).cast("string")
    found = spark.createDataFrame([("en",), ("en/x",), ("x/en-us/y",)], "path string").select(W.file_locale(none, none, F.col("path"), ["de", "en"]).alias("l"))
    assert [r.l for r in found.collect()] == ["de", "en", "en"]  # a file at the top has no folder


def test_tags(spark):
    tags = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "tag_id long, slug string, label string")
    assigned = spark.createDataFrame([(1, "page", "1"), (2, "page", "1"), (2, "file", "x")], "tag_id long, target_type string, target_id string")
    wanted = spark.createDataFrame([("New one", "page", "7"), ("new ONE", "page", "7"), ("A", "page", "1"), ("--", "page", "8"), ("A", "page", ""), ("A", "odd", "1"), (" Ä ", "file", "x")], "label string, target_type string, target_id string")
    all_tags, all_assigned, again = G.bulk_assign(tags, assigned, wanted)
    assert {tuple(r) for r in all_tags.collect()} == {(1, "a", "A"), (2, "b", "B"), (3, "ae", "Ä"), (4, "new-one", "New one")}
    assert {tuple(r) for r in all_assigned.collect()} == {(1, "page", "1"), (2, "page", "1"), (2, "file", "x"), (4, "page", "7"), (3, "file", "x")} and all_assigned.count() == 5
    assert {tuple(r) for r in again.collect()} == {("page", "7"), ("page", "1"), ("file", "x")}
    assert [r.slug for r in G.slugs_of(tags, assigned, "1").collect()] == ["a", "b"] and G.by_slug(tags, "b").first().tag_id == 2
    assert [tuple(r) for r in G.targets_of(assigned, 2).collect()] == [("file", "x"), ("page", "1")]


def test_answers(spark):
    docs = documents(spark, [("a", "de", "Café", "Das Café am Fluß ist offen " + "und " * 40, 1), ("b", "en", "No", "nothing of it", 2), ("c", "en", "Cafe", "cafes", 3)])
    ask = S.Request(query="cafe", limit=5)
    hits = {r.id: r for r in S.hit_view(docs, S.search(docs, ask), ask, width=6).collect()}
    assert hits["a"].title == "<mark>Café</mark>" and hits["a"].snippet == "Das <mark>Café</mark> am Fluß ist offen…" and hits["c"].snippet == "<mark>cafes</mark>"
    assert S.total_hits(docs, S.Request(query="cafe", limit=1)).first().total_hits == 2
    assert {r.locale: r.hits for r in S.locale_totals(docs, ask).collect()} == {"de": 1, "en": 1, "all": 2}
    merged = S.merge_locales(docs, S.Request(query="cafe", locales=("en", "de"))).collect()
    assert [(r.id, r.locale_rank) for r in merged] == [("c", 1), ("a", 1)]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    head = 'a:2:{s:5:"value";s:9:"Ein <b>T</b>";s:4:"unit";s:2:"h1";}'
    assert [one(T.headline_text(F.lit(x))) for x in (head, " <i>x</i> ", "", None, "a:0:{}")] == ["Ein T", "x", "", "", "a:0:{}"]
    ints = ("a:2:{i:0;i:3;i:1;s:2:\"-4\";}", 'a:2:{s:1:"k";s:2:"17";i:0;i:0;}', "3", None, "")
    assert [one(T.serialised_ints(F.lit(x))) for x in ints] == [[3], [17], [], [], []]
    assert [str(one(T.parsed_date(F.lit(x)))) for x in ("3.2.2020", "2020-02-03 10:00:00", "1580688000", "odd")] == ["2020-02-03"] * 3 + ["None"]
    assert one(W.both_lists(F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("c")))) == ["a", "b", "c"]


def packed(part, data, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(part, data)
    return out.getvalue()


def test_files_give_a_text_or_a_reason(monkeypatch):
    good = packed("content.xml", "<text:p>a<text:tab/>b</text:p>")
    assert X.extract("odt", good) == ("a b", None)
    encrypted = good.replace(b"\x14\x00\x00\x00\x08\x00", b"\x14\x00\x01\x00\x08\x00")
    assert X.extract("odt", encrypted) == (None, "odt_zip_open_failed")
    stream = bytearray(packed("word/document.xml", "x" * 5000 + "y"))
    stream[60:70] = b"\xff" * 10
    assert X.extract("docx", bytes(stream)) == (None, "docx_zip_open_failed")
    monkeypatch.setattr(X, "MOST_UNPACKED", 1000)
    assert X.extract("docx", packed("word/document.xml", "x" * 5000)) == (None, "docx_unpacks_too_large")
    assert X.extract("odt", packed("other", "")) == (None, "odt_no_content") and X.extract("docx", packed("other", "")) == (None, "docx_empty")
    assert X.extract("rtf", b"") == (None, "rtf_empty_file") and X.extract("rtf", b"{\\rtf1 }") == (None, "rtf_empty_after_strip")


def test_event_sink_and_shared_folder(spark, tmp_path):
    events = spark.createDataFrame([(" wort ", "DE", -1), ("x", "de", 1), ("y" * 300, "de_AT_long", 2)], "q string, locale string, results int").withColumn("ts", F.lit("2020-01-01 10:00:00").cast("timestamp"))
    feeds.record_events(events, f"file://{tmp_path}/sink")
    feeds.record_events(events, f"file://{tmp_path}/sink")
    got = {(r.q, r.locale, r.results) for r in feeds.recorded(spark, f"file://{tmp_path}/sink").collect()}
    assert got == {("wort", "de", 0), ("y" * 255, "de_at_lo", 2)} and feeds.recorded(spark, f"file://{tmp_path}/sink").count() == 4

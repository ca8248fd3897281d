"""Answers as JSON, folders of files with markers, table functions, moves in the store, settings as tables."""

import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admin as A
from tidemark.operators import answers as R
from tidemark.operators import live as L
from tidemark.operators import search as S
from tidemark.operators.store import Store, index_name, index_names
from tidemark.sources import extract as X

DOC = "id string, type string, locale string, title string, url string, content string, tags array<string>, published_at long, weight double, is_protected boolean, allowed_groups array<int>, indexed_at long"


@pytest.fixture
def docs(spark):
    rows = [("a", "page", "de", "Café", "/a", "das Café <b>", ["news", "pdf"], 1), ("b", "file", "en", "No", "/b", "nothing", None, 2), ("c", "file", "de", "Cafe", "/c", "cafe cafe", ["Old News", "news"], 3), ("d", None, "fr", None, None, "cafe", [], 4)]
    return spark.createDataFrame([(*r[:7], None, 1.0, False, [], r[7]) for r in rows], DOC)


def test_an_answer_is_one_json_document(spark, docs):
    tags = spark.createDataFrame([("news", "News"), ("old", "old news")], "slug string, label string")
    answer = json.loads(R.response(docs, S.Request("cafe", limit=2), tags, took_ms=5).first().json)
    assert [h["id"] for h in answer["hits"]] == [r.id for r in S.search(docs, S.Request("cafe", limit=2)).collect()] and set(answer["hits"][0]) == set(R.HIT_FIELDS)
    assert (answer["totalHits"], answer["offset"], answer["limit"], answer["queryTimeMs"]) == (3, 0, 2, 5)
    assert answer["facets"]["locale"] == {"de": 2, "fr": 1} and answer["facets"]["type"] == {"page": 1, "file": 1} and answer["facets"]["tags"] == {"news": 2, "pdf": 1, "Old News": 1}
    assert answer["tagFacets"] == [{"slug": "news", "label": "News", "count": 2}, {"slug": "old", "label": "old news", "count": 1}]
    resolved = {h["id"]: h["tagsResolved"] for h in answer["hits"]}
    assert resolved.get("c") == [{"slug": "old", "label": "old news"}, {"slug": "news", "label": "News"}]
    none = json.loads(R.response(docs, S.Request("nosuchword"), tags).first().json)
    assert (none["hits"], none["totalHits"], none["tagFacets"], none["facets"]) == ([], 0, [], {"type": {}, "locale": {}, "tags": {}})


def test_an_answer_matches_the_documents_once(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/docs")
    tags = spark.createDataFrame([("news", "News")], "slug string, label string")
    answer = R.response(spark.read.parquet(f"file://{tmp_path}/docs"), S.Request("cafe", limit=2), tags)
    plan = answer._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*content#", plan)) == 1  # what shows the page
    assert json.loads(answer.first().json)["totalHits"] == 3


def test_files_of_a_folder_and_their_markers(spark, tmp_path):
    root = tmp_path / "files"
    for name, data in {"top.txt": b"top", "a/one.TXT": b"one", "a/b/two.md": b"two", "a/b/c/three.exe": b"x", "d/four.txt": b"", "d/big.txt": b"y" * ((1 << 20) + 1), "d/e/five.rtf": b"{\\rtf1 five}"}.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(data)
    for marked in ("a/b", "d/e"):
        (root / marked / ".public").write_bytes(b"")
    folder = f"file://{root}"
    assert sorted(r.path for r in X.public_markers(spark, folder).collect()) == ["a/b", "d/e"]
    # d/four.txt has no bytes: file sources leave such files out
    got = {r.path: (r.size, r.text, r.reason, r.public) for r in X.site_files(spark, folder, most_mb=1).collect()}
    assert got == {
        "top.txt": (3, "top", None, False), "a/one.TXT": (3, "one", None, False), "a/b/two.md": (3, "two", None, True), "a/b/c/three.exe": (1, None, "unsupported_extension_exe", True),
        "d/big.txt": ((1 << 20) + 1, None, "file_too_large_2_mb", False), "d/e/five.rtf": (12, "five", None, True),
    }
    (root / ".public").write_bytes(b"")
    assert all(r.public for r in X.site_files(spark, folder, most_mb=1).collect())


def test_only_files_that_are_read_are_opened(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a")
    plan = X.read_files(spark, f"file://{tmp_path}", 1)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan


def test_table_functions(spark):
    assert X.register(spark) == ["extract_text", "text_words"]
    spark.createDataFrame([(1, "txt", b"\xc3\x84pfel und Birnen"), (2, "txt", None), (3, "exe", b"x"), (4, None, b"y")], "id int, kind string, content binary").createOrReplaceTempView("t_files")
    rows = spark.sql("SELECT id, e.reason, w.pos, w.tok FROM t_files t, LATERAL extract_text(t.kind, t.content) e, LATERAL text_words(e.text) w ORDER BY id, pos").collect()
    assert [tuple(r) for r in rows] == [(1, None, 0, "apfel"), (1, None, 1, "und"), (1, None, 2, "birnen"), (2, "file_not_readable", None, None), (3, "unsupported_extension_exe", None, None), (4, "unsupported_extension_", None, None)]


def test_documents_move_in_the_store(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write(docs)
    changes = spark.createDataFrame([("a", "EN"), ("b", ""), ("c", "xx"), ("unknown", "de"), ("d", None)], "id string, locale string")
    L.carry_moves(store, changes, ["de", "en"], "de")
    assert {r.id: (r.locale, r.index_locale) for r in store.read().collect()} == {"a": ("en", "en"), "b": ("de", "de"), "c": ("de", "de"), "d": ("de", "de")}


def test_settings_as_tables(spark):
    locales = spark.createDataFrame([("de",), ("en",), ("en",), (None,)], "locale string")
    wanted = A.index_configs(locales, "strict", {"masse": ["maße"]})
    first = A.ensured(None, wanted)
    assert {r.locale: r.changed for r in first.collect()} == {"de": True, "en": True}
    assert not any(r.changed for r in A.ensured(first, wanted).collect())
    again = {r.locale: (json.loads(r.config)["strictness"], r.changed) for r in A.ensured(first, A.index_configs(locales.where("locale = 'de'"), "tolerant")).collect()}
    assert again == {"de": ("tolerant", True), "en": ("strict", False)}
    assert json.loads(first.where("locale = 'de'").first().config)["synonyms"] == [["masse", ["maße"]]]


def test_index_names(spark):
    names = ["de", "de_DE", "D", "x1", "français", "", None]
    got = spark.createDataFrame([(n,) for n in names], "l string").select("l", index_names("t_0123456789abcdef", F.col("l")).alias("n")).collect()
    for r in got:
        if r.n is None:
            with pytest.raises((ValueError, AttributeError)):
                index_name("t_0123456789abcdef", r.l)
        else:
            assert r.n == index_name("t_0123456789abcdef", r.l)


def test_lines_of_written_files_keep_their_order(spark, tmp_path):
    from tidemark.plans import more_queries as M

    texts = {i: f"text {i * 7919 % 1000}" for i in range(100, 400)}
    # against the order of ids, and each folder's rows in several files
    spark.createDataFrame([(i, texts[i]) for i in sorted(texts, reverse=True)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.folder: r.text for r in M.site_files_read(spark, str(tmp_path)).where("reason IS NULL").collect()}
    want = {f"top={b % 4}/b={b}": hashlib.md5("".join(f"{texts[i]}\n" for i in range(50 * b, 50 * b + 50)).encode()).hexdigest() for b in range(2, 8) if b % 5}
    assert got == want


def test_large_files_are_handed_on_a_few_at_a_time(spark):
    import pandas as pd

    from tidemark.plans import more_queries as M
    from tidemark.plans import site_queries as Q

    got = list(M._pdf.func(iter([(pd.Series(["large", "null"] * 12), pd.Series(["x"] * 24))])))
    assert sum(map(len, got)) == 24 and max(sum(len(b) for b in s if b) for s in got) < X.PIECE + (4 << 20)
    got = list(Q._packed.func(iter([(pd.Series(["txt"] * 40), pd.Series(["x" * (1 << 20)] * 40))])))
    assert sum(map(len, got)) == 40 and max(s.map(len).sum() for s in got) <= X.PIECE
    made = spark.range(0, 300, 1, 1).select("id", F.expr("encode(repeat('x', 200000), 'utf-8')").alias("b"))
    assert made.select(X.extracted(F.lit("txt"), F.col("b")).alias("e")).where("length(e.text) = 200000").count() == 300


def test_words_of_files_are_counted_without_a_sort(spark, tmp_path):
    from tidemark.plans import more_queries as M

    spark.createDataFrame([(1, "Él b b"), (2, " \n"), (3, ". ,")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = M.sql_table_functions(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, True, None, 3, "el"), (2, False, "empty_file", 0, None), (3, True, None, 0, None)]
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    above = plan[: next(i for i, line in enumerate(plan) if "Generate posexplode" in line)]
    assert "HashAggregate" in [line for line in above if "Aggregate" in line][-1]


def test_memory_of_a_piece_goes_back_once_it_is_handed_on(monkeypatch):
    given = []
    monkeypatch.setattr(X, "tidy", lambda: given.append(1), raising=False)
    sizes = [len(some) for some in X.pieces(["x" * (1 << 20)] * 20, len)]
    assert sizes == [8, 8, 4] and len(given) == 3

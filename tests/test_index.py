"""The kept index answers as a search over the documents does, also after changes, deletions and merges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as I
from tidemark.operators import search as S
from tidemark.operators import site as W

SCHEMA = "id string, type string, locale string, title string, url string, content string, tags array<string>, published_at long, weight double, is_protected boolean, allowed_groups array<int>, indexed_at long"
WORDS = ["strasse", "straße", "masse", "maße", "garden", "gardens", "gardener", "wooden", "wodoen", "houses", "horses", "horse", "über", "of", "the", "de", "internationale", "internationales", "internatoinale", "a", "ab"]
REQUESTS = [
    S.Request("the garden", limit=7), S.Request("gardne", limit=20), S.Request("the of", "strict"), S.Request("internationale", "tolerant"), S.Request('"the of"', limit=100), S.Request("de"), S.Request("de ab", "tolerant", limit=5, offset=4),
    S.Request("hors", locales=("de", "fr"), groups=(2,)), S.Request("Wooden houses a", filters={"tags": ["x"], "type": "file"}), S.Request("", filters={"tags": ["y"]}, limit=9), S.Request("nosuchword"), S.Request("strasse"), S.Request('the "garden of" de'),
]


def documents(seed, ids, start=0):
    rng = random.Random(seed)
    rows = []
    for i in ids:
        text = None if i % 29 == 3 else "" if i % 31 == 3 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))
        protected = None if i % 5 == 0 else i % 3 == 0
        rows.append((f"d{i}", rng.choice(["file", "page"]), rng.choice(["de", "en", "fr"]), rng.choice(WORDS), f"/u/{i}", text, rng.choice([["x"], ["y", "x"], ["y"], []]), None, 1.0, protected, [rng.randint(1, 3)] if protected else [], start + rng.randint(0, 40)))
    return rows


def hits(df):
    return [tuple(r) for r in df.collect()]


def agree(index, docs, requests=REQUESTS):
    for r in requests:
        synonyms = S.SYNONYMS if "strasse" in r.query else None
        assert hits(index.search(r, synonyms)) == hits(S.search(docs, r, synonyms=synonyms)), r


@pytest.fixture
def index(spark, tmp_path):
    return I.SearchIndex(spark, f"file://{tmp_path}/index")


def test_deletions_meet_where_words_are_near(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(120)]
    df = spark.createDataFrame([(w,) for w in words], "w string").distinct()
    got = {r.w: (set(r.f1), set(r.f2)) for r in df.select("w", I.deletions("w", 1).alias("f1"), I.deletions("w", 2).alias("f2")).collect()}
    assert all((I.forms_of(w, 1), I.forms_of(w, 2)) == f for w, f in got.items())
    pairs = df.crossJoin(df.withColumnRenamed("w", "x")).select("w", "x", F.levenshtein("w", "x").alias("d")).where("d <= 2").collect()
    assert len(pairs) > 500 and all(got[r.w][r.d - 1] & got[r.x][1] for r in pairs if r.d)


def test_index_finds_what_a_search_over_documents_finds(spark, index, monkeypatch):
    docs = spark.createDataFrame(documents(1, range(300)), SCHEMA).cache()
    index.write(docs)
    agree(index, docs)
    for r in REQUESTS[1:3]:
        assert hits(index.total_hits(r)) == hits(S.total_hits(docs, r))
        assert sorted(hits(index.facets(r))) == sorted(hits(S.matched_facets(docs, r)))
    monkeypatch.setattr(I, "NAMED", 2)  # words met by a join alone
    agree(index, docs, REQUESTS[1:3])


def test_only_blocks_that_can_hold_better_hits_are_read(spark, index, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BITS", 3)
    monkeypatch.setattr(I, "FIRST", 2)
    rows = [(*r[:5], (r[5] or "") + " rare" * (i % 97 == 5), *r[6:]) for i, r in enumerate(documents(4, range(400)))]
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    index.write(docs)
    asked = [S.Request("horses", "strict", limit=3), S.Request("the rare", "strict", limit=3), S.Request("garden of", limit=5), S.Request("gardne", limit=3, offset=2)]
    for request, share in zip(asked, (0.5, 1, 1, 1), strict=True):
        agree(index, docs, [request])
        assert index.blocks_read[0] <= share * index.blocks_read[1]
    index.search(asked[1])
    assert index.blocks_read[1] < 10  # no other blocks have both words


def test_index_follows_changes(spark, index):
    rows = {r[0]: r for r in documents(5, range(120))}
    index.write(spark.createDataFrame(list(rows.values()), SCHEMA))
    for step in range(6):
        changed = documents(100 + step, range(step * 9, step * 9 + 40), start=step - 4)
        again = [(*changed[0][:11], changed[0][11] - 1)]  # an older row of an id in the same change
        index.upsert(spark.createDataFrame(changed + again, SCHEMA))
        rows |= {r[0]: r for r in changed}
        gone = [f"d{i}" for i in range(step * 11, step * 11 + 5)] + ["unknown"]
        index.delete(spark.createDataFrame([(i,) for i in gone], "id string"))
        rows = {k: v for k, v in rows.items() if k not in gone}
    state = index._state()
    assert 1 < len(state["segments"]) < 6  # segments of a size were merged on the way
    docs = spark.createDataFrame(list(rows.values()), SCHEMA).cache()
    assert {r.id for r in index.rows().select("id").collect()} == set(rows)
    agree(index, docs, [REQUESTS[i] for i in (0, 1, 4, 7)])
    index.merge()
    assert len(index._state()["segments"]) == 1 and not index._state()["gone"]
    assert index.rows().count() == len(rows)
    agree(index, docs, [REQUESTS[i] for i in (0, 1, 4, 7)])
    index.upsert(spark.createDataFrame(documents(77, range(400, 405)), SCHEMA))
    assert index.rows().count() == len(rows) + 5


def test_many_queries_at_once(spark, index):
    docs = spark.createDataFrame(documents(6, range(200)), SCHEMA).cache()
    index.write(docs)
    queries = ["the garden", "gardne", "de", "internationale of houses", "", "hors", "nosuchword a", 'wooden "houses', "a"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for strictness in ("balanced", "strict", "tolerant"):
        request = S.Request(strictness=strictness, limit=6, groups=(1,))
        got = index.search_many(asked, request).orderBy("query_id", "rank").drop("rank").collect()
        for i, q in enumerate(queries):
            alone = S.search(docs, S.Request(q.replace('"', " "), strictness, groups=(1,), limit=6)).drop("indexed_at").collect() if q else []
            assert [tuple(r)[1:] for r in got if r.query_id == i] == [tuple(r) for r in alone], (strictness, q)


def test_an_empty_index(spark, index):
    empty = spark.createDataFrame([], SCHEMA)
    index.write(empty)
    assert hits(index.search(S.Request("the"))) == [] and hits(index.search(S.Request(""))) == []
    one = spark.createDataFrame(documents(8, [1]), SCHEMA)
    index.upsert(one)
    assert index.rows().count() == 1
    index.delete(one)
    assert index.rows().count() == 0 and hits(index.total_hits(S.Request("a", "tolerant"))) == [(0,)]


def test_positions_are_put_together_in_each_document():
    import pyarrow as pa

    words = [["b", "a", "b"], [], ["c"]], [["a"], [], []], [["b", "x", "x"], ["x"], []]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), *(pa.array(w, pa.list_(pa.string())) for w in words)], ["doc", "a0", "a1", "a2"])
    got = sorted(tuple(r.values()) for b in I._posted(iter([batch, batch.slice(1, 1), batch.slice(0, 0)])) for r in b.to_pylist())
    first = [("a", 7, 0, [1], 1), ("a", 7, 1, [0], 0), ("b", 7, 0, [0, 2], 1), ("b", 7, 2, [0], 0), ("c", 9, 0, [0], 1), ("x", 7, 2, [1, 2], 1), ("x", 8, 2, [0], 1)]
    assert got == sorted([*first, ("x", 8, 2, [0], 1)])


def test_index_counts_documents_of_words_also_after_a_merge(spark, index):
    docs = spark.createDataFrame(documents(1, range(120)), SCHEMA).cache()
    index.write(docs.where("id < 'd5'"))
    index.upsert(docs.where("id >= 'd5'"))
    index.merge()
    want = {r.tok: (r.n, r.docs) for r in S.vocabulary(docs).collect()}
    assert {r.tok: (r.n, r.docs) for r in index._all(index._state(), "words").collect()} == want

"""The pipeline against what its stages must do, on a small table."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    path = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(80)] = "grumblish" + rng.choice("abc")
        if bad:
            words[40:] = [w.upper() + "!!" for w in words[40:]]
        rows.append((i, " ".join(words[:40]) + "\n" + " ".join(words[40:]), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    clean = [i for i in range(300) if i % 5 and i % 7]
    rows.append((1000, rows[clean[0]][1] + " tail", "en", "s", 1))  # a near copy
    own = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    rows.append((1001, own + "\n" + rows[clean[1]][1][-180:], "en", "s", 1))  # repeats a passage
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near duplicates", "repeated strings", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i in range(300) if i % 5 and i % 7}
    assert len(clean - kept["toxicity"]) <= 2 and not {i for i in range(300) if i % 35 == 0} & kept["toxicity"]
    assert kept["toxicity"] - kept["near duplicates"] == {1000}
    assert kept["repeated strings"] == kept["near duplicates"]
    text = docs.where("doc_id = 1001").first().text
    assert 239 <= len(text) <= 241
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept["repeated strings"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_near_duplicates_of_five_words(spark):
    words = [[f"w{d}x{i}" for i in range(49)] for d in range(3)]
    changed = [*words[0][:20], "other", *words[0][21:]]  # 40 of 50 five-word shingles in common
    twice = [*words[1][:10], "other", *words[1][11:30], "another", *words[1][31:]]  # 35 of 55
    longer = [*words[2], *(f"more{i}" for i in range(8))]  # 45 of 53
    docs = spark.createDataFrame([(i, " ".join(w), "en") for i, w in enumerate([*words, changed, twice, longer])], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 4}


def test_near_duplicates_by_row(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [
        (1, a, "kept"), (2, a + " tail", "gone"), (2, b, "kept"),  # an id of a near copy and of another text
        (3, c, "one"), (3, c, "one"), (3, c + " tail", "one"),  # an id whose rows are alike
        (None, d, "null"), (None, d, "null"), (None, d + " tail", "null"), (None, a, "gone"),
        (4, "", "kept"), (4, None, "kept"), (None, None, "kept"), (None, " ", "kept"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashing = docs.withColumns({c: F.lit("mine") for c in ("__row", "row", "doc", "component_id", "last")})
    found = corpus_pipeline.near_duplicates(spark, clashing, "")
    assert found.columns == clashing.columns and {r["__row"] + r["row"] + r["doc"] for r in found.collect()} == {"mine" * 3}
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(r[2] for r in kept) == ["kept"] * 6 + ["null", "one"]
    assert {(1, a, "kept"), (2, b, "kept")} <= set(kept)
    again = docs.where("lang = 'null'").union(spark.createDataFrame([(7, d, "seven")], docs.schema))
    assert [r.lang for r in corpus_pipeline.near_duplicates(spark, again, "").collect()] == ["seven"]


def test_stages_keep_columns_nulls_and_repeats(spark, folder):
    columns = "doc_id long, text string, score double, predicted int, n_passages string, `odd.name` string, rest string"
    clean = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IN (1, 2, 3)").collect()
    rows = [(r.doc_id, r.text, 42.0, 7, "own", "odd", "rest") for r in clean]
    rows += [rows[0], (None, rows[1][1], None, None, None, None, None), (None, None, 1.0, 1, "", "", ""), (9, "", 0.0, 0, "x", "x", "x"), (9, None, 0.0, 0, "x", "x", "x")]
    docs = spark.createDataFrame(rows, columns).cache()
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(map(repr, r))
    for name in ("quality", "toxicity"):
        train = spark.read.parquet(f"{folder}/documents.parquet")
        everything = docs.unionByName(train.select("doc_id", "text").where("doc_id > 9"), allowMissingColumns=True)
        out = stages[name](spark, everything, folder)
        assert out.columns == docs.columns
        assert sorted(map(key, out.where("doc_id IS NULL OR doc_id < 10").where("doc_id IS NULL OR doc_id IN (1, 2, 3, 9)").collect())) == sorted(map(key, rows))
    near = stages["near duplicates"](spark, docs, folder)
    assert near.columns == docs.columns and sorted(repr(r.doc_id) for r in near.collect()) == sorted(map(repr, [1, 2, 3, None, 9, 9]))
    kept = stages["repeated strings"](spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == len(rows) and kept.where("text IS NULL").count() == 2
    assert kept.where("doc_id IS NULL AND text IS NOT NULL").first().text == ""  # an earlier one has it all
    assert kept.where("predicted = 7 AND score = 42.0 AND rest = 'rest'").count() == 4
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_pipeline_against_brute_force(spark, folder):
    """Near duplicates, repeated strings and packing of what the classifiers kept, by plain loops over all rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
    texts = {r.doc_id: r.text for r in docs.collect()}
    grams = {i: {tuple(t.lower().split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and root[i] != root[j] and 10 * len(grams[i] & grams[j]) >= 8 * len(grams[i] | grams[j]):
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = {k: b if r == a else r for k, r in root.items()}
    left = {i: t.encode() for i, t in texts.items() if root[i] == i}
    first, cut = {}, {}
    for i in sorted(left):
        for p in range(len(left[i]) - 49):
            first.setdefault(left[i][p : p + 50], i)
    for i, t in left.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        cut[i] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode()
    import numpy as np
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {(i, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in cut.items() for ids in [[*tokenizer.encode(t, add_special_tokens=False).ids, 1]]}
    assert all(n <= 4096 for _, _, n, _ in expected)
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()} == expected

"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, components, crf_quality, hashing_search, jaccard_join, packing, segment_search, suffix_array_dedup, suffix_tree_dedup, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))) for _ in range(n)]
    texts = [t if i % 4 else t + "\n" + passage + " " + t[:30] for i, t in enumerate(texts)]
    near = [" ".join(w for j, w in enumerate(texts[i].split(" ")) if j != 5) for i in range(0, 20)]
    rows = list(enumerate([*texts, *near, *texts[:5], None, "", " ", "a b", "A B", "one", "x " * 3000, "ab" * 20000, "x " * 3000]))
    return [*rows, (3, texts[3]), (None, texts[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    names = ("n_bytes", "score", "chunk", "component_id", "id", "length", "bucket", "rest")
    return df.withColumns({c: F.lit("clash") for c in names}).cache()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def repeated(rows, words):
    first, out = {}, []
    order = lambda d: (1 << 63) - 1 if d is None else d
    split = [(d, WORD.findall((t or "").encode()) if words else (t or "").encode()) for d, t in rows]
    grams = lambda x: [tuple(x[p : p + 50]) if words else x[p : p + 50] for p in range(len(x) - 49)]
    for d, x in split:
        for g in grams(x):
            first[g] = min(first.get(g, 1 << 64), order(d))
    for d, x in split:
        gone = bytearray(len(x))
        for p, g in enumerate(grams(x)):
            if first[g] < order(d):
                gone[p : p + 50] = b"\1" * 50
        kept = [w for w, k in zip(x, gone, strict=True) if not k]
        sha = hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(x), sum(gone), sha) if words else (d, len(x), sum(gone), spans, sha))
    return collections.Counter(out)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 20000, "hot": 2}])
def test_suffix_array_dedup(docs, options):
    assert collections.Counter(map(tuple, suffix_array_dedup.dedup(docs, **options).collect())) == repeated(rows_of(docs), False)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 20000, "hot": 2}])
def test_suffix_tree_dedup(docs, options):
    assert collections.Counter(map(tuple, suffix_tree_dedup.dedup(docs, **options).collect())) == repeated(rows_of(docs), True)


def test_kept_texts_keep_rows_and_columns(docs):
    out = suffix_array_dedup.kept_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_shards_merge_and_prefix_groups_split():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    base = [bytes(rng.integers(97, 99, 80, dtype=np.uint8)) for _ in range(30)]
    pieces = sorted({*base, *(b[20:] + c[:20] for b, c in zip(base, base[1:], strict=False))})
    windows, ids = np.array([len(p) - 49 for p in pieces]), rng.permutation(len(pieces))
    least = {}
    for p, i in zip(pieces, ids, strict=True):
        for k in range(len(p) - 49):
            least[p[k : k + 50]] = min(least.get(p[k : k + 50], 1 << 60), int(i))
    expected = [least[p[k : k + 50]] for p in pieces for k in range(len(p) - 49)]
    for size in (1 << 20, 300):
        assert suffix_array_dedup.earliest(pa.array(pieces, pa.large_binary()), windows, ids, shard_bytes=size).tolist() == expected
    spaced = [b" ".join(p[i : i + 1] for i in range(len(p))) for p in pieces]
    for most in (1 << 16, 5):
        assert suffix_tree_dedup.earliest(pa.array(spaced, pa.large_binary()), windows, ids, most=most).tolist() == expected


def test_prefix_groups_hold_every_suffix_with_its_equals():
    rng = np.random.default_rng(4)
    token = np.r_[rng.integers(0, 3, 3000), np.zeros(400, np.int64)]
    at = rng.integers(0, 3300, 5000)
    for most in (10, 300, 1 << 20):
        groups = suffix_tree_dedup.prefix_groups(token, at, 12, most)
        assert sorted(np.concatenate([g for g, _ in groups]).tolist()) == list(range(5000))
        of = {}
        for i, (g, length) in enumerate(groups):
            assert len({tuple(token[at[p] : at[p] + length]) for p in g}) == 1 and (len(g) <= most or length == 12)
            assert all(of.setdefault(tuple(token[at[p] : at[p] + 12]), i) == i for p in g)


def test_suffix_tree_nodes():
    assert set(suffix_tree_dedup.internal_nodes(np.array([0, 3, 5, 1, 5]), 3)) == {(5, 1, 3), (3, 0, 3), (5, 3, 5)}


def test_suffix_tree_classes_are_internal_nodes(monkeypatch):
    import pyarrow as pa

    seen, nodes_of = [], suffix_tree_dedup.internal_nodes
    monkeypatch.setattr(suffix_tree_dedup, "internal_nodes", lambda *a: seen.extend(n := nodes_of(*a)) or n)
    words = [f"w{i}" for i in range(60)]
    pieces = [" ".join(w).encode() for w in (words, ["x", *words[:55]])]
    got = suffix_tree_dedup.earliest(pa.array(pieces, pa.large_binary()), np.array([11, 7]), np.array([5, 3]))
    assert got.tolist() == [3] * 6 + [5] * 5 + [3] * 7
    assert [(d, j - i) for d, i, j in seen] == [(50, 2)] * 6


def linked(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low).encode())
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else d))
    return collections.Counter(out)


@pytest.mark.parametrize("block", [192 << 10, 2000])
def test_jaccard_join(docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block)
    assert collections.Counter(map(tuple, jaccard_join.near_duplicates(docs).collect())) == linked(rows_of(docs))


def hub_and_variants(rng):
    """A set, variants one edit from it, and variants three edits from it, which are linked with hardly any set but that one."""
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    edits = [1] * 150 + [3] * 30
    return [base, *(np.r_[np.delete(base, np.concatenate([np.arange(p, p + 3) for p in rng.choice(66, n, False) * 3])), rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)] for n in edits)]


def revisions(rng):
    """Sets that are linked with the next two only."""
    token = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    return [token[2 * i : 2 * i + 100] for i in range(400)]


@pytest.mark.parametrize("make", [hub_and_variants, revisions])
def test_links_between_blocks(spark, make):
    sets = [np.unique(s) for s in make(np.random.default_rng(3))]
    assert sum(8 * len(s) for s in sets) > jaccard_join.BLOCK_BYTES
    order = np.random.default_rng(4).permutation(len(sets)).tolist()  # the node of each set
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if root[i] != root[j] and 100 * same >= 90 * (len(sets[i]) + len(sets[j]) - same):
                root = [root[j] if r == root[i] else r for r in root]
    df = spark.createDataFrame([(n, 0, s.astype("<u8").tobytes()) for n, s in zip(order, sets, strict=True)], "node long, group long, shingles binary")
    got = {r.node: r.root for r in components.components(jaccard_join.links(df)).collect()}
    expected, found = collections.defaultdict(set), collections.defaultdict(set)
    for n, r in zip(order, root, strict=True):
        expected[r].add(n)
        found[got.get(n, n)].add(n)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    """Revision chains, a hub and unrelated texts with common passages, dealt to blocks of a few sets, by brute force."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    chain, common, hub = [word() for _ in range(260)], [word() for _ in range(12)], [word() for _ in range(60)]
    texts = [chain[2 * i : 2 * i + 60] for i in range(100)]
    for i in range(60):
        w = list(hub)
        for at in rng.sample(range(60), 1 if i % 3 else 2):
            w[at] = word()
        texts.append(w)
    texts += [[word() for _ in range(20)] + common + [word() for _ in range(rng.randint(0, 20))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = collections.Counter(map(tuple, jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == linked(rows) and len({c for _, _, c in got}) < 200


def keys_of(sets, least):
    """The prefix keys of each set, with ranks as counted over all of them."""
    count = collections.Counter(x for s in sets for x in s.tolist())
    key, doc = jaccard_join.prefixes(sets, [np.array([min(255, int(8 * np.log2(count[x]))) for x in s.tolist()], np.uint8) for s in sets], least)
    return [set(key[doc == i].tolist()) for i in range(len(sets))]


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for n in (10, 14, 15, 40, 300, 1000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.r_[x[n // 20 :], rng.integers(0, 1 << 63, n // 30, dtype=np.uint64)])
        common = [x[rng.random(len(x)) < 0.5] for _ in range(5)]  # makes some shingles frequent
        same = len(np.intersect1d(x, y))
        if 100 * same >= 90 * (len(x) + len(y) - same):
            a, b, *_ = keys_of([x, y, *common], 90)
            assert a & b


def test_small_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for least, n in [(90, 9), (90, 18), *((80, n) for n in (*range(4, 60), 200, 1000))]:
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for more in {1, n * 100 // least - n}:
            y = np.r_[x, rng.integers(0, 1 << 63, more, dtype=np.uint64)]
            a, b = keys_of([np.unique(x), np.unique(y)], least)
            assert a & b


@pytest.mark.parametrize("least", [50, 90])
def test_every_small_size(spark, least):
    """Sets of 1 to 30 shingles against those with one to three more, in front and behind, by brute force."""
    rows, sets = [], []
    for n in range(1, 31):
        w = [f"w{n}x{i}" for i in range(n + 2)]
        for text in (w, *([*w, *"abc"[:k]] for k in (1, 2, 3)), ["x", "y", *w], [*w[: n // 2], "mid", *w[n // 2 :]]):
            rows.append((len(rows), " ".join(text)))
            sets.append({tuple(text[i : i + 3]) for i in range(len(text) - 2)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    assert got == {i: min(j for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))}


@pytest.mark.parametrize("least, fewest", [(90, 9), (80, 4)])
def test_smallest_linked_sets(spark, least, fewest):
    rows, expected = [], {}
    for n in range(1, fewest + 3):
        w = [f"w{n}x{i}" for i in range(n + 2)]
        for k, text in enumerate((w, [*w, "tail"], ["head", *w])):
            rows.append((10 * n + k, " ".join(text)))
            expected[10 * n + k] = n + (k > 0), 10 * n + (k if n < fewest else 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, least).collect()} == expected


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def test_byte_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = collections.Counter()
    for d, t in rows_of(docs):
        ids = coding.encode_ordinary(t or "")
        expected[d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert collections.Counter(map(tuple, byte_bpe.digests(docs, path, public_tokenizers.PATTERN).collect())) == expected


def test_byte_bpe_odd_texts():
    tiktoken = pytest.importorskip("tiktoken")
    coder = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t in ("<|endoftext|>", "▁ a", "\0\x7f", "日本語 😀", "a" * 5000, " \n\n\t x"):
        assert coder.encode(t) == coding.encode_ordinary(t) and coder.decode(coder.encode(t)) == t.encode()


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = collections.Counter()
    for d, t in rows_of(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for j in range(0, len(ids), 4096):
            part = ids[j : j + 4096]
            expected[d, j // 4096, j, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, path).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == expected
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r.length for r in got)
    assert len(at) <= total / 4096 * 1.1 + 2


def test_packing_special_texts():
    tokens = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["<|endoftext|> a", "it's I'LL 'S", "İstanbul ŉ Ⱥ ΑΣ", "é x", "a\x1cb c", "½²³ 12", "", "a" * 3000]
    assert tokens.encode(texts) == [np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plan_uses_exact_complements():
    assert packing.plan({6: 2, 4: 1, 3: 1, 1: 1}, 10) == [((6, 4), 1), ((6, 3, 1), 1)]
    rng = random.Random(3)
    counts = collections.Counter(rng.randint(1, 100) for _ in range(2000))
    bins = packing.plan(dict(counts), 100)
    used = collections.Counter()
    for lengths, n in bins:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += n
    assert used == counts


def test_warc(spark, tmp_path):
    rows = [(2, "u", "<p>é</p>"), (1, "u\r\nX: y", "<p>é</p>"), (3, None, None), (4, "v", ""), (4, "v", ""), (5, "w", "x" * 700000), (None, "n", "<p>é</p>"), (7, "z", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = f"{tmp_path}/warc"
    index = warc.write_archives(pages, folder, frame_bytes=1000, bundle_bytes=4000)
    got = collections.Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect())
    first = {"<p>é</p>": 1, "": 3, "x" * 700000: 5, rows[-1][2]: 7}
    expected = collections.Counter()
    for i, _, h in rows:
        body, ref = (h or "").encode(), first[h or ""]
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected[None if i is None else str(i), len(body), sha, "response" if ref == i else "revisit", None if ref == i else str(ref)] += 1
    assert got == expected
    # one record by its place alone, and every bundle as a plain Zstandard stream of WARC records
    import io

    import zstandard

    place = index.where("record_id = '5'").first()
    with pyarrow.OSFile(f"{folder}/{place.bundle}") as f:
        head, block = warc.BundleReader(f).record(place.frame, place.offset)
    assert head["warc-record-id"] == "<urn:tidemark:5>" and block == b"x" * 700000
    names = collections.Counter()
    for path in tmp_path.glob("warc/*.warc.zst"):
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
        at = 0
        while at < len(data):
            head, _, at = warc.parse(data, at)
            names[head["warc-record-id"]] += 1
    assert sum(names.values()) == len(rows) and names["<urn:tidemark:4>"] == 2 and sum(k.startswith("<urn:uuid:") for k in names) == 1
    # any order of the index will do, and a wrong place is found out
    assert warc.read_records(index.orderBy("offset", F.desc("record_id")), folder, blocks=False).where("block IS NOT NULL").count() == 0
    wrong = index.where("record_id = '5'").withColumn("record_id", F.lit("1"))
    with pytest.raises(Exception, match="the index has 1 where"):
        warc.read_records(wrong, folder).collect()


def vectors(spark, seed=5, n=300):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    x[10], x[11] = x[9], x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [1.0, None] * 8), (940, [float("nan")] * 16), (960, [0.0] * 16), (980, []), (None, [1.0] * 16), (1000, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(0), "rank": F.lit("clash")})


def brute(rows, k, cast, zero):
    good = [(i, np.array([cast(c) for c in v])) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            s = sorted(((-float(a @ b), i) for i, b in good if i != q and len(b) == len(a)))[:k]
            out[q] = [(i, -x) for x, i in s]
    return {q: s for q, s in out.items() if s}


def grouped(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_exact_top_k(spark):
    rows, df = vectors(spark)
    assert grouped(segment_search.exact_top_k(df, F.col("id") % 20 == 0, 20)) == brute(rows, 20, lambda c: np.floor(64 * float(c)), True)


def test_multi_index_hashing(spark):
    rows, df = vectors(spark)
    got, want = grouped(hashing_search.nearest(df, F.col("id") % 20 == 0, 20)), brute(rows, 20, float, False)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    exact = {q: dict(s) for q, s in brute(rows, 10**6, float, False).items()}
    assert all(abs(exact[q][i] - s) < 1e-9 for q in got for i, s in got[q])


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    code[1] = code[0] ^ np.array([1, 3, 0, 0], np.uint16)
    near = [code[i] ^ rng.choice([0, 1, 16, 4096, 4097], 4).astype(np.uint16) for i in range(300)]
    code = np.concatenate([code, near])
    far = hashing_search.distances(code[:9], code)
    for bits in (0, 1, 2, 3):
        flips = hashing_search.probes(bits)
        got = hashing_search.Index(code).retrieve(code[:9], flips)
        least = np.bitwise_count(code[:9][:, None] ^ code[None]).min(axis=2)
        assert (got == (least <= bits)).all()  # exactly the codes with a substring that near
        assert got[far <= 4 * (bits + 1) - 1].all()  # and so all within the pigeonhole radius
        for radius in (0, 5, 20):
            q, x = hashing_search.Index(code).near(code[:9], flips, radius)
            assert set(zip(q.tolist(), x.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(got & (far <= radius))), strict=True))


def test_search_finds_all_where_few_are_near_and_splits_wide_blocks(spark, monkeypatch):
    from tidemark.llm import vectors as V

    rows, df = vectors(spark)
    monkeypatch.setattr(hashing_search, "fit_radii", lambda *_: (0, 0))  # nothing but equal codes is found at first
    monkeypatch.setattr(V, "BLOCK_BYTES", 3000)
    assert grouped(hashing_search.nearest(df, F.col("id") % 20 == 0, 20)).keys() == brute(rows, 20, float, False).keys()
    got = grouped(hashing_search.nearest(df, F.col("id") % 20 == 0, 20))
    for q, found in brute(rows, 20, float, False).items():
        assert [i for i, _ in got[q]] == [i for i, _ in found] and np.allclose([s for _, s in got[q]], [s for _, s in found])


def test_repeated_ids_are_candidates_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert grouped(hashing_search.nearest(df, F.col("id") % 20 == 0, 20)) == {20: [(1, 2.0), (1, 2.0), (1, 1.0), (2, 0.5)]}
    assert grouped(segment_search.exact_top_k(df, F.col("id") % 20 == 0, 3)) == {20: [(1, 8192), (1, 8192), (1, 4096)]}


def test_maximal_segments():
    for seed in range(50):
        s = np.random.default_rng(seed).integers(-3, 3, 30).astype(float)

        def all_of(a, b, s=s):
            if not (s[a:b] > 0).any():
                return []
            best = max(((s[i:j].sum(), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)))
            i = -best[2]
            j = i - best[1]
            return [*all_of(a, i), (i, j, best[0]), *all_of(j, b)]

        assert sum(x for *_, x in toxicity.maximal_segments(s)) == sum(x for *_, x in all_of(0, 30))


def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("abcdefgh") + rng.choice("aeiou") * rng.randint(1, 3) for _ in range(60)]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = "grumblish" + rng.choice("abcdef")
        text = " ".join(words[:30]) + "\n" + (" ".join(w.upper() + "!!" for w in words[30:]) if bad else " ".join(words[30:]))
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    extra = [(None, None), (1000, None), (1001, ""), (1002, "\n\n"), (0, rows[0][1])]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int"), len(rows) + len(extra)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (crf_quality, "quality")])
def test_classifiers(spark, module, label):
    docs, labels, n = labelled(spark)
    out = module.score(docs, module.fit(docs, labels)).cache()
    assert out.count() == n and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    held = out.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).join(labels, "doc_id")
    assert held.where(F.col("predicted") == F.col(label)).count() >= 0.95 * held.count()
    empty = {r.predicted for r in out.where("text IS NULL OR trim(text) IN ('', '\n\n')").collect()}
    assert empty == {0 if label == "toxic" else 1}


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (crf_quality, "quality")])
def test_classifiers_without_labels(spark, module, label):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.score(docs, module.fit(docs, none)).count() == 2


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    crf = crf_quality.Crf(rng.standard_normal(4), np.exp(rng.standard_normal((2, 2))))
    x, at = rng.standard_normal((5, 3)), np.array([0, 4, 4, 5])
    u = crf.odds(x)
    for a, b in ((0, 4), (4, 5)):
        total = np.zeros(b - a)
        z = 0.0
        for y in np.ndindex(*[2] * (b - a)):
            p = np.prod([u[a + i] ** y[i] for i in range(b - a)]) * np.prod([crf.transitions[y[i], y[i + 1]] for i in range(b - a - 1)])
            z += p
            total += p * np.array(y)
        assert np.allclose(crf.marginals(x, at)[a:b], total / z)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        suffix_array_dedup.dedup(docs), suffix_tree_dedup.dedup(docs), jaccard_join.near_duplicates(docs), packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
        byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), segment_search.exact_top_k(vec, F.col("id") % 20 == 0, 20), hashing_search.nearest(vec, F.col("id") % 20 == 0, 20), warc.read_records(warc.write_archives(pages, f"{tmp_path}/none"), f"{tmp_path}/none"),
    ):
        assert df.count() == 0


def test_sums_find_what_brute_force_finds():
    import itertools

    for seed in range(30):
        rng = np.random.default_rng(seed)
        free = np.zeros(41, np.int64)
        for x in rng.integers(1, 30, rng.integers(1, 9)):
            free[x] += 1
        sums = packing.Sums(free)
        while free.any():
            pieces = [x for x in range(41) for _ in range(free[x])]
            for gap in rng.permutation(40)[:12] + 1:
                there = any(sum(c) == gap for n in (1, 2, 3) for c in itertools.combinations(pieces, n))
                found = sums.exact(int(gap))
                assert (found is not None) == there
                assert not found or (sum(found) == gap and sums.left(*found))
            free[rng.choice(pieces)] -= 1


def test_messages_pass_between_blocks():
    rng = np.random.default_rng(1)
    u, at = np.exp(rng.standard_normal(1000) * 3), np.array([0, 0, 700, 701, 703, 1000])
    crf = crf_quality.Crf(np.zeros(2), np.exp(rng.standard_normal((2, 2)) * 2))
    forward, backward = crf.passes(u, crf_quality.chains(at))
    assert np.allclose(crf.ratios(u, at), forward * backward)
    for block in (1, 7, 256, 5000):
        assert np.allclose(crf_quality.messages(u, at, crf.transitions, block), forward)


def test_slices_of_a_long_text_have_the_whole_ones_features(monkeypatch):
    rng = random.Random(3)
    kinds = ["same line", "UPPER CASE!! 12", "a b b b c", "", "x" * 300, "é|| — 7"]
    text = "\n".join(rng.choice(kinds) + rng.choice(["", str(rng.randint(0, 50))]) for _ in range(3000)).encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    crf = crf_quality.Crf(np.random.default_rng(0).standard_normal(3 * crf_quality.OWN + 1), np.ones((2, 2)))
    monkeypatch.setattr(crf_quality, "LINE_BYTES", 100)
    whole = crf.line_odds(buf, off, len(text))
    for step in (1, 50, 999, 20000):
        assert all(np.allclose(a, b) for a, b in zip(whole, crf.line_odds(buf, off, step), strict=True))


def test_a_very_long_text_of_short_lines():
    import resource

    import pyarrow as pa

    text = "short line 1\nTHIS ONE IS BAD!!\n" * 700_000  # 21 MB
    crf = crf_quality.Crf(np.random.default_rng(0).standard_normal(3 * crf_quality.OWN + 1) / 4, np.array([[2.0, 1.0], [1.0, 2.0]]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= crf_quality.Model(crf, np.array([0.0, 1.0, 1.0])).score(pa.array([text, None, "x" * 3_000_000]))[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB


def test_sample_is_bounded_and_settles_conflicts(spark):
    from tidemark.llm import labelled as L

    rows = [(i, f"text {i}") for i in range(40)] + [(1, "b text")] * 100 + [(None, "x"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (4, None), (1, 1)], "doc_id long, y int")
    got = {r.doc_id: (r.text, r.y) for r in L.sample(docs, labels, "y", {0: 1000, 1: 1000}, 100).collect()}
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 3]
    assert got == {i: ("" if i == 2 else "b text" if i == 1 else f"text {i}", i % 2) for i in kept}
    assert L.sample(docs, labels, "y", {0: 3, 1: 2}, 100).count() == 5


def test_segments_have_the_bounds_of_brute_force():
    """Maximal segments: every proper part scores less, and no longer such segment holds them (Ruzzo and Tompa)."""
    for seed in range(60):
        s = np.random.default_rng(seed).choice([-3.0, -2.0, -1.0, 1.0, 2.0, 3.5], 24)
        total = np.r_[0.0, np.cumsum(s)]

        def good(i, j, total=total):
            """All proper prefixes and suffixes of i..j have a sum above zero."""
            return all(total[k] > total[i] and total[j] > total[k] for k in range(i + 1, j)) and total[j] > total[i]

        found = [(i, j) for i in range(24) for j in range(i + 1, 25) if good(i, j)]
        expected = sorted((i, j) for i, j in found if not any((a, b) != (i, j) and a <= i and j <= b for a, b in found))
        got = toxicity.maximal_segments(s)
        assert sorted((a, b) for a, b, _ in got) == expected
        assert all(abs(x - (total[b] - total[a])) < 1e-9 for a, b, x in got)


def test_tokens_have_signed_scores(spark):
    docs, labels, _ = labelled(spark)
    model = toxicity.fit(docs, labels)
    words = {f: w for f, (_, w) in model.weights.items() if f.endswith("\0")}
    assert any(w > 0 for f, w in words.items() if f.startswith("grumblish")) and min(words.values()) < toxicity.DRIFT < max(w for w in words.values() if w < 0)
    scorer = toxicity.Scorer(model.weights)
    assert scorer["grumblishz"] > 0 and scorer["neverseen"] == toxicity.DRIFT


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    from tidemark.llm import labelled as L

    docs = spark.createDataFrame([(i, f"text {i}" if i else "long " * 100) for i in range(60)], "doc_id long, text string")
    own = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    others = spark.range(1000, 401_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    key = lambda df: sorted(map(tuple, df.collect()))
    for rows in ({0: 1000, 1: 1000}, {0: 5, 1: 7}):
        alone = key(L.sample(docs, own, "y", rows, 100))
        assert alone == key(L.sample(docs, own.unionByName(others), "y", rows, 100))
        assert len(alone) == 12 or len(alone) > 30 and all(i for i, _, _ in alone)


@pytest.mark.parametrize("least", [50, 60, 70])
def test_no_link_is_lost_at_other_thresholds(spark, least):
    rng = random.Random(least)
    texts = []
    for n in range(5, 40):
        whole = [f"w{n}x{i}" for i in range(n)]
        texts += [whole, whole[: rng.randint(n // 2, n)], [*whole[n // 4 :], *(f"new{n}x{i}" for i in range(rng.randint(0, n // 3)))]]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= least * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df, least=least).collect()} == dict(enumerate(root))


def test_scores_keep_columns_of_any_name(spark):
    docs, labels, _ = labelled(spark)
    out = toxicity.score(docs.limit(20).withColumns({"__judged": F.lit("mine"), "row": F.lit(1)}), toxicity.fit(docs, labels))
    assert out.count() == 20 and {(r["__judged"], r["row"]) for r in out.collect()} == {("mine", 1)}


def test_hot_windows_are_merged_in_slices(monkeypatch):
    """A chunk of copies whose every window is hot takes memory for its distinct windows."""
    import resource

    from tidemark.llm import repeats

    rng = np.random.default_rng(0)
    one = rng.integers(97, 123, 40_000, dtype=np.uint8)
    buf, off = np.tile(one, 50), np.arange(51) * len(one)
    unit = repeats.Bytes(buf, off)
    picked = repeats.picks_of(unit, 0, 4)
    told = {}
    for b, data in zip(picked.column("bucket").to_pylist(), picked.column("data").to_pylist(), strict=True):
        t = pyarrow.table({"bucket": pyarrow.array([b], pyarrow.int32()), "chunk": pyarrow.array([0], pyarrow.int32()), "data": pyarrow.array([data], pyarrow.binary())})
        told[b] = repeats.shared(t, 2).column("data")[0].as_py()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    chunk = repeats.Chunk(unit, np.arange(50), 4, told)
    assert len(chunk.code) == 50 * (len(one) - 49) and len(chunk.content) == len(one) - 49
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700 << 10  # KB


def test_a_bucket_is_solved_in_groups_of_picks(monkeypatch):
    """Work and memory of a bucket grow with its bytes: no shard is looked up in the others, each window's class lies in one group."""
    from tidemark.llm import repeats

    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 1_500_000, dtype=np.uint8)
    unit, copy = (repeats.Bytes(b, np.array([0, len(b)])) for b in (text, text[5000:]))
    picked = pyarrow.concat_tables([repeats.picks_of(unit, 0, 1), repeats.picks_of(copy, 1, 1)])
    state = dict(zip(*repeats.shared(picked, 2000).select(["chunk", "data"]).to_pydict().values(), strict=True))
    chunks = [repeats.Chunk(u, np.array([i]), 1, {0: state[i]}) for i, u in enumerate((unit, copy))]
    sent = pyarrow.concat_tables([c.sent(i) for i, c in enumerate(chunks)])
    sizes, shards, merged = [], [], suffix_array_dedup.merged
    monkeypatch.setattr(suffix_array_dedup, "merged", lambda s: (shards.append(len(s)), merged(s))[1])

    def solver(content, windows, least):
        sizes.append(content.nbytes)
        return suffix_array_dedup.earliest(content, windows, least)

    found = dict(zip(*repeats.answers(sent, solver).select(["chunk", "data"]).to_pydict().values(), strict=True))
    gone = [int(np.bitwise_count(repeats.covered(u, c, {0: found[i]})).sum()) for i, (u, c) in enumerate(zip((unit, copy), chunks, strict=True))]
    assert gone == [0, len(text) - 5000 - 49]
    assert set(shards) == {1} and max(sizes) < 1 << 20 and len(sizes) > 5

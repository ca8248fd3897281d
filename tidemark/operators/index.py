"""A kept search index: searches, facets and totals that read no texts, and follow changes.

A segment is five tables. `rows` has a document's values without its content, newest first, in blocks of BLOCK; `postings`
a row for each word, document and attribute, with the positions; `peaks` what is best in each block for a word; `words` the
vocabulary; `forms` the words under what is left of them when a letter or two are taken out, so a mistyped word is an equality.
A change writes a segment of its own: documents carry the number of the change that wrote them, and an id that a later change
wrote or deleted counts no longer. Segments of a size are merged once there are TIER of them, without reading texts.

A query's words are looked up in `words` and `forms`, their blocks in `peaks`; the blocks that can hold the best hits are read
first, and then only those whose peak beats the last hit of the page.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import fold, folded, tokens

from .scratch import reachable
from .search import ATTRIBUTES, SHORT, TYPO_LENGTHS, Request, Token, clamped, facets, likeness, ranking, rewrite, score, user_filter, visible, weighed
from .store import Versioned

#: Documents of a block (a power of two); letters of a word whose deletions are kept, and the shortest such word.
BLOCK_BITS, FORM_LENGTH, FORM_LEAST = 10, 7, 4
#: Segments of about one size that are merged; words up to which a scan names them; blocks that are read first.
TIER, NAMED, FIRST = 4, 1000, 16
SCHEMAS = {
    "postings": "tok string, doc long, block long, attr int, pos array<int>, one int",
    "peaks": "tok string, block long, docs long, attr int, newest long",
    "words": "tok string, docs long, n long",
    "forms": "form string, tok string",
}


def deletions(name: str, k: int = 2) -> Column:
    """What is left of the first FORM_LENGTH letters of a column's word when up to k are taken out.

    Words within an edit distance of k share one of these: of what both have in common in order, the first letters.
    """
    out = [(0, 0)] + [(i, j) for j in range(1, FORM_LENGTH + 1) for i in range(j if k > 1 else 1)]
    w = f"substring({name}, 1, {FORM_LENGTH})"
    left = f"CASE WHEN p.j = 0 THEN {w} WHEN p.i = 0 THEN concat(left({w}, p.j - 1), substring({w}, p.j + 1)) ELSE concat(left({w}, p.i - 1), substring({w}, p.i + 1, p.j - p.i - 1), substring({w}, p.j + 1)) END"
    places = ", ".join(f"named_struct('i', {i}, 'j', {j})" for i, j in out)
    return F.expr(f"array_distinct(transform(filter(array({places}), p -> p.j <= length({name})), p -> {left}))")


def forms_of(word: str, k: int) -> set[str]:
    """deletions() of a word that the driver holds."""
    level = {word[:FORM_LENGTH]}
    out = set(level)
    for _ in range(k):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(max(len(w), 1))}
        out |= level
    return out


def typos_allowed(token: Token, strictness: str) -> int:
    one, two = TYPO_LENGTHS[strictness]
    return 0 if token.exact else 2 if len(token.text) >= two else 1 if len(token.text) >= one else 0


def _formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """form, tok: deletions of the words of a vocabulary, which a long expression takes several times as long to make."""
    # a word that two typos may lead to is as long as the shortest query word with two, less these
    least = min(n for _, n in TYPO_LENGTHS.values()) - 2
    for batch in batches:
        words = batch.column("tok").to_pylist()
        forms = [forms_of(w, 2 if len(w) >= least else 1) for w in words]
        at = np.repeat(np.arange(len(words)), [len(f) for f in forms])
        yield pa.RecordBatch.from_arrays([pa.array([f for some in forms for f in some], pa.string()), batch.column("tok").take(pa.array(at))], ["form", "tok"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tok, doc, attr, pos, one of documents (doc, and the words of each attribute): a word's positions are put together where
    its document is, so that neither words nor positions are sorted across tasks; one is 1 in a word's first attribute, else 0."""
    for batch in batches:
        words, rows, attrs, places = [], [], [], []
        for attr in range(len(ATTRIBUTES)):
            lists = batch.column(f"a{attr}")
            n = np.diff(lists.offsets.to_numpy())
            words.append(lists.flatten())
            rows.append(np.repeat(np.arange(len(n), dtype=np.int64), n))
            attrs.append(np.full(n.sum(), attr, np.int64))
            places.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        coded = pa.concat_arrays(words).dictionary_encode()
        if not len(coded):
            continue
        code, row = coded.indices.to_numpy().astype(np.int64), np.concatenate(rows)
        word = row * len(coded.dictionary) + code
        key = word * len(ATTRIBUTES) + np.concatenate(attrs)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        at = order[starts]
        word = word[at]
        positions = pa.ListArray.from_arrays(np.r_[starts, len(key)].astype(np.int32), np.concatenate(places)[order].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[at])), batch.column("doc").take(pa.array(row[at])), pa.array(np.concatenate(attrs)[at].astype(np.int32)), positions, pa.array(np.r_[True, word[1:] != word[:-1]].astype(np.int32))],
            ["tok", "doc", "attr", "pos", "one"],
        )


class SearchIndex(Versioned):
    """The index in a folder; one writer at a time. Documents are search documents (id, type, locale, title, content, tags, ...)."""

    #: Blocks that the last search read, and all that can hold a hit.
    blocks_read: tuple[int, int] = (0, 0)

    def _state(self) -> dict:
        return self._manifest() or {"segments": [], "gone": [], "next": 0}

    # --- writing

    def _placed(self, rows: DataFrame, folder: str) -> DataFrame:
        """Numbers the documents, newest first, and writes their values; a number's upper bits are its block."""
        order = [F.desc("indexed_at"), F.asc("id")]
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())
        placed.withColumn("block", F.shiftright("doc", BLOCK_BITS)).write.parquet(f"{self.path}/{folder}/rows")
        return self.spark.read.schema(placed.withColumn("block", F.col("doc")).schema).parquet(f"{self.path}/{folder}/rows")

    def _filled(self, folder: str, posted: DataFrame, rows: DataFrame) -> tuple[int, int]:
        """Writes the other tables of a segment; posted: tok, doc, attr, pos, one. Returns how many documents and blocks.

        Rows are dealt by hash: a range would have all that is below it made twice, once for its bounds.
        """
        at = lambda name: f"{self.path}/{folder}/{name}"
        table = lambda name: self.spark.read.schema(SCHEMAS[name]).parquet(at(name))
        # by block too, as a word may be in every document
        dealt = posted.withColumn("block", F.shiftright("doc", BLOCK_BITS)).repartition("tok", "block")
        dealt.select("tok", "doc", "block", "attr", "pos", "one").sortWithinPartitions("tok", "doc", "attr").write.parquet(at("postings"))
        newest = rows.groupBy("block").agg(F.max("indexed_at").alias("newest"))
        each = table("postings").groupBy("tok", "block").agg(F.sum("one").cast("long").alias("docs"), F.min("attr").alias("attr"), F.sum(F.size("pos")).alias("n"))
        peaks = each.join(newest, "block").repartition("tok").sortWithinPartitions("tok", "block")
        peaks.select("tok", "block", "docs", "attr", F.col("newest").cast("long").alias("newest"), "n").write.parquet(at("peaks"))
        whole = self.spark.read.schema(SCHEMAS["peaks"] + ", n long").parquet(at("peaks"))
        whole.groupBy("tok").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).sortWithinPartitions("tok").write.parquet(at("words"))
        # dealt anew: a file of words is one task, and each word makes dozens of rows
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        long = table("words").where(F.length("tok") >= FORM_LEAST).select("tok").repartition(tasks, "tok")
        reachable(self.spark)
        long.mapInArrow(_formed, SCHEMAS["forms"]).repartition("form").sortWithinPartitions("form").write.parquet(at("forms"))
        return rows.agg(F.count("*"), F.count_distinct("block")).first()

    def _segment(self, docs: DataFrame, seq: int) -> dict:
        folder = f"segment-{uuid.uuid4().hex}"
        rows = self._placed(docs.drop("content").withColumn("seq", F.lit(seq).cast("long")), folder)
        words = [tokens(F.array_join(a, " ") if a == "tags" else F.col(a)).alias(f"a{i}") for i, a in enumerate(ATTRIBUTES)]
        reachable(self.spark)
        posted = docs.select("id", *ATTRIBUTES).join(rows.select("id", "doc"), "id").select("doc", *words).mapInArrow(_posted, SCHEMAS["postings"].replace(" block long,", ""))
        docs_, blocks = self._filled(folder, posted, rows)
        return {"folder": folder, "docs": docs_, "blocks": blocks, "later": seq > 0, "schema": rows.schema.json()}

    def write(self, docs: DataFrame) -> None:
        """All documents of the index from now on; ids are distinct."""
        self._commit({"segments": [self._segment(docs, 0)], "gone": [], "next": 1})

    def upsert(self, docs: DataFrame) -> None:
        """The last write of an id counts; of one id's rows within it, that with the largest indexed_at, then the last in a fixed order."""
        m = self._state()
        w = Window.partitionBy("id").orderBy(F.desc("indexed_at"), F.desc(F.xxhash64(*(f"`{c}`" for c in docs.columns))))
        one = docs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        self._commit(self._merged({**m, "segments": [*m["segments"], self._segment(one, m["next"])], "next": m["next"] + 1}))

    def delete(self, ids: DataFrame) -> None:
        m = self._state()
        folder = f"gone-{uuid.uuid4().hex}"
        ids.select("id").distinct().withColumn("seq", F.lit(m["next"]).cast("long")).write.parquet(f"{self.path}/{folder}")
        self._commit({**m, "gone": [*m["gone"], folder], "next": m["next"] + 1})

    def merge(self) -> None:
        """All segments into one: what counts no longer goes."""
        m = self._state()
        if m["segments"] and (len(m["segments"]) > 1 or m["gone"]):
            self._commit(self._joined(m, m["segments"]))

    def _merged(self, m: dict) -> dict:
        """Merges the smallest size of which there are TIER segments; a merged one may make its size full in turn."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in m["segments"]:
                tiers.setdefault(int(math.log(s["docs"] + 1, TIER)), []).append(s)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= TIER]
            if not full:
                return m
            m = self._joined(m, tiers[full[0]])

    def _joined(self, m: dict, some: list[dict]) -> dict:
        """The manifest with some segments as one: documents get new numbers, postings follow them."""
        folder, whole = f"segment-{uuid.uuid4().hex}", len(some) == len(m["segments"])
        part = {**m, "segments": some}
        live = self._rows(part, m)
        rows = self._placed(live.withColumnRenamed("doc", "was").drop("block"), folder)
        moved = self._all(part, "postings").withColumnRenamed("doc", "was").join(rows.select("segment", "was", "doc"), ["segment", "was"])
        first = F.min("attr").over(Window.partitionBy("tok", "doc")) == F.col("attr")
        posted = moved.select("tok", "doc", "attr", "pos", first.cast("int").alias("one"))
        docs, blocks = self._filled(folder, posted, rows)
        fresh = {"folder": folder, "docs": docs, "blocks": blocks, "later": not whole, "schema": rows.drop("segment", "was").schema.json()}
        kept = [s for s in m["segments"] if s not in some]
        return {**m, "segments": [*kept, fresh], "gone": [] if whole else m["gone"]}

    # --- reading

    def _all(self, m: dict, name: str) -> DataFrame:
        """A table of all segments, with the segment's place."""
        out = None
        for i, s in enumerate(m["segments"]):
            schema = StructType.fromJson(json.loads(s["schema"])) if name == "rows" else SCHEMAS[name]
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{s['folder']}/{name}").withColumn("segment", F.lit(i))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _gone(self, m: dict) -> DataFrame | None:
        """id, seq: what changes wrote or deleted; as many rows as there were changes since all was one segment."""
        out = None
        for i, s in enumerate(m["segments"]):
            if s["later"]:
                part = self._all({**m, "segments": m["segments"][i : i + 1]}, "rows").select("id", "seq")
                out = part if out is None else out.unionByName(part)
        for folder in m["gone"]:
            part = self.spark.read.schema("id string, seq long").parquet(f"{self.path}/{folder}")
            out = part if out is None else out.unionByName(part)
        return None if out is None else out.groupBy("id").agg(F.max("seq").alias("last"))

    def _rows(self, m: dict, whole: dict) -> DataFrame:
        rows, gone = self._all(m, "rows"), self._gone(whole)
        if gone is None:
            return rows
        return rows.join(gone.withColumnRenamed("id", "__id"), (F.col("id") == F.col("__id")) & (F.col("last") > F.col("seq")), "left_anti")

    def rows(self) -> DataFrame:
        """The documents that count, without their contents."""
        m = self._state()
        return self._rows(m, m)

    def _terms(self, m: dict, phrases: list[list[Token]], strictness: str, synonyms: dict | None) -> DataFrame:
        """tok, t (qi, typos, exact): words of the index that stand for a query word, found by equality and by prefix only."""
        flat = [t for p in phrases for t in p]
        same, forms = F.lit(False), set()
        for qi, token in enumerate(flat):
            word = folded(token.text)
            same = same | F.col("tok").isin([word, *(folded(a) for a in (synonyms or {}).get(token.text.lower(), []))])
            if strictness != "strict" and not token.exact and qi == len(flat) - 1:
                same = same | F.col("tok").startswith(word)
            if k := typos_allowed(token, strictness):
                forms |= forms_of(word, k)
        found = self._all(m, "words").where(same).select("tok")
        if forms:
            found = found.unionByName(self._all(m, "forms").where(F.col("form").isin(sorted(forms))).select("tok"))
        each = [F.struct(F.lit(qi).alias("qi"), typos(F.col("tok")).alias("typos"), exact(F.col("tok")).alias("exact")) for qi, (typos, exact) in enumerate(likeness(phrases, strictness, synonyms))]
        return found.select("tok", F.explode(F.array(*each)).alias("t")).where("t.typos IS NOT NULL").select("tok", "t.*")

    def _allowed(self, m: dict, request: Request) -> DataFrame:
        rows = self._rows(m, m).where(visible(request.groups)).where(user_filter(request.filters, request.tags_mode))
        return rows.where(F.col("locale").isin(list(request.locales))) if request.locales else rows

    def _asked(self, request: Request, synonyms: dict | None) -> tuple[dict, list, bool, DataFrame | None, list[str] | None]:
        """The manifest, phrases, whether all must match, the terms, and the words of the scan where they are few."""
        m = self._state()
        phrases, strict = rewrite(request.query, request.strictness)
        if not phrases or not m["segments"]:
            return m, phrases, strict, None, []
        terms = self._terms(m, phrases, request.strictness, synonyms)
        few = set(terms.limit(NAMED + 1).collect())
        if len(few) > NAMED:
            return m, phrases, strict, terms.distinct(), None
        # words are letters and digits; a row that nothing meets stands for none
        values = ", ".join(f"('{r.tok}', {r.qi}, {r.typos}, {r.exact})" for r in sorted(few)) or "('', 0, 0, 0)"
        return m, phrases, strict, self.spark.sql(f"SELECT * FROM VALUES {values} AS t(tok, qi, typos, exact)"), sorted({r.tok for r in few})

    def _found(self, m: dict, allowed: DataFrame, phrases: list, strict: bool, terms: DataFrame, words: list[str] | None, keep: tuple[str, ...], only: Column | None = None, blocks: DataFrame | None = None) -> DataFrame:
        """Hits of all blocks, or of those that are named by a condition or a table (segment, block)."""
        posted = self._all(m, "postings")
        if words is not None:
            posted, terms = posted.where(F.col("tok").isin(words)), F.broadcast(terms)  # at most NAMED rows
        if only is not None:
            posted, allowed = posted.where(only), allowed.where(only)
        if blocks is not None:
            posted = posted.join(blocks, ["segment", "block"], "left_semi")
        here = allowed.select("segment", "doc", "id", "indexed_at", *keep).join(self._matches(posted, terms, ()), ["segment", "doc"])
        return self._scored(here, phrases, strict, ("id", "indexed_at", *keep))

    @staticmethod
    def _matches(posted: DataFrame, terms: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """by, segment, doc, m: all matches of a document in order, no more than it has words."""
        each = F.expr("transform(pos, p -> named_struct('attr', attr, 'pos', p, 'qi', qi, 'typos', typos, 'exact', exact))")
        return posted.join(terms, "tok").groupBy(*by, "segment", "doc").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("m"))

    @staticmethod
    def _scored(here: DataFrame, phrases: list, strict: bool, keep: tuple[str, ...]) -> DataFrame:
        n = sum(map(len, phrases))
        found = weighed(here, phrases, keep)
        found = found.where(F.col("words") == n) if strict else found.where("first_qi = 0")
        return found.withColumn("score", score(n)).select(*keep, "words", "typos", "proximity", "attr", "exact", "score")

    def _none(self, rows: DataFrame | None, keep: tuple[str, ...]) -> DataFrame:
        """Browsing: every document that is allowed, with no words."""
        zero = [F.lit(0).cast(kind).alias(c) for c, kind in (("words", "long"), ("typos", "long"), ("proximity", "long"), ("attr", "int"), ("exact", "long"), ("score", "double"))]
        return rows.select("id", "indexed_at", *keep, *zero)

    def matched(self, request: Request, synonyms: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """All hits of a request, unordered, with columns `keep` of their documents."""
        m, phrases, strict, terms, words = self._asked(request, synonyms)
        if terms is None:
            return self._none(self._allowed(m, request), keep)
        return self._found(m, self._allowed(m, request), phrases, strict, terms, words, keep)

    def total_hits(self, request: Request, synonyms: dict | None = None) -> DataFrame:
        return self.matched(request, synonyms).agg(F.count("*").alias("total_hits"))

    def facets(self, request: Request, synonyms: dict | None = None, fields: tuple[str, ...] = ("type", "locale", "tags")) -> DataFrame:
        return facets(self.matched(request, synonyms, fields), fields)

    def _peaks(self, m: dict, terms: DataFrame, words: list[str], n: int, strict: bool) -> DataFrame:
        """segment, block and the best rank that a document there can have: -words, typos, proximity, attr, -indexed_at."""
        each = self._all(m, "peaks").where(F.col("tok").isin(words)).join(F.broadcast(terms), "tok")
        word = each.groupBy("segment", "block", "qi").agg(F.min("typos").alias("typos"), F.min("attr").alias("attr"), F.max("newest").alias("newest"))
        block = word.groupBy("segment", "block").agg(F.count("*").alias("words"), F.sum("typos").alias("typos"), F.min("attr").alias("attr"), F.max("newest").alias("newest"), F.min("qi").alias("first_qi"))
        block = block.where(F.col("words") == n) if strict else block.where("first_qi = 0")
        return block.select("segment", "block", F.struct((-F.col("words")).alias("words"), F.col("typos").alias("typos"), F.lit(0).cast("long").alias("proximity"), F.col("attr").alias("attr"), (-F.col("newest")).alias("newest")).alias("peak"))

    def search(self, request: Request, synonyms: dict | None = None) -> DataFrame:
        """The request's page of hits in rank order, with their score.

        The FIRST blocks with the best peaks are read, then all others whose peak is not behind the page's last hit.
        """
        m, phrases, strict, terms, words = self._asked(request, synonyms)
        limit, offset = clamped(request)
        allowed, page = self._allowed(m, request), limit + offset
        if terms is None:
            return self._none(allowed, ()).orderBy(*ranking()).offset(offset).limit(limit)
        if words is None:
            return self._found(m, allowed, phrases, strict, terms, None, ()).orderBy(*ranking()).offset(offset).limit(limit)
        blocks = sum(s["blocks"] for s in m["segments"])
        if blocks <= FIRST:  # nothing to leave out
            self.blocks_read = (blocks, blocks)
            return self._found(m, allowed, phrases, strict, terms, words, ()).orderBy(*ranking()).offset(offset).limit(limit)
        peaks = self._peaks(m, terms, words, sum(map(len, phrases)), strict)
        ordered = peaks.orderBy("peak", "segment", "block")
        first = ordered.limit(FIRST + 1).collect()
        here = self._these([(r.segment, r.block) for r in first[:FIRST]])
        found = self._found(m, allowed, phrases, strict, terms, words, (), only=here)
        self.blocks_read = (len(first), len(first))
        if len(first) > FIRST:
            best = found.orderBy(*ranking()).limit(page).collect()  # a page: at most MOST_HITS and the offset
            found = self.spark.createDataFrame(best, found.schema)
            left = peaks.where(~here)
            if len(best) == page:
                last = best[-1]
                kind = peaks.schema["peak"].dataType
                worst = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip((-last.words, last.typos, last.proximity, last.attr, -last.indexed_at), kind, strict=True)))
                left = left.where(F.col("peak") <= worst)
            more = left.select("segment", "block")
            total, unread = peaks.count(), more.count()
            self.blocks_read = (FIRST + unread, total)
            if unread:
                found = found.unionByName(self._found(m, allowed, phrases, strict, terms, words, (), blocks=more))
        return found.orderBy(*ranking()).offset(offset).limit(limit)

    def _these(self, blocks: list[tuple[int, int]]) -> Column:
        out = F.lit(False)
        for segment in sorted({s for s, _ in blocks}):
            out = out | ((F.col("segment") == segment) & F.col("block").isin([b for s, b in blocks if s == segment]))
        return out

    def search_many(self, queries: DataFrame, request: Request) -> DataFrame:
        """query_id, rank, id, words, typos, proximity, attr, exact, score: the page of each of many queries (query_id, query).

        What `search` finds for each with the request's strictness, reader, filters and limit, in a few joins for all of them;
        quotes are blanks, there are no phrases. Queries without words have no hits. All lookups are equalities: a
        prefix meets words with its first letters, a mistyped word what is left of both without a letter or two.
        """
        m = self._state()
        one, two = TYPO_LENGTHS[request.strictness]
        strict = request.strictness == "strict"
        parts = F.filter(F.split(F.regexp_replace("query", '"', " "), r"\s+"), lambda w: w != "")
        asked = queries.select("query_id", F.size(parts).alias("n"), F.posexplode(parts).alias("qi", "raw"))
        short = F.length("raw") <= SHORT
        exact = short if strict else short & (F.col("n") == 1) if request.strictness == "balanced" else F.lit(False)
        k = F.when(exact, 0).when(F.length("raw") >= two, 2).when(F.length("raw") >= one, 1).otherwise(0)
        asked = asked.select("query_id", "n", "qi", fold(F.col("raw")).alias("word"), k.alias("k"), (F.lit(not strict) & ~exact & (F.col("qi") == F.col("n") - 1)).alias("prefix"))
        words, forms = self._all(m, "words").select("tok").distinct(), self._all(m, "forms").select("form", "tok").distinct()
        same = asked.join(words, F.col("word") == F.col("tok")).withColumn("typos", F.lit(0))
        head = F.substring("word", 1, SHORT)
        starts = words.select("tok", F.explode(F.transform(F.sequence(F.lit(1), F.lit(SHORT)), lambda i: F.substring("tok", F.lit(1), i))).alias("head")).distinct()
        begun = asked.where("prefix").withColumn("head", head).join(starts, "head").where(F.col("tok").startswith(F.col("word"))).drop("head").withColumn("typos", F.lit(0))
        mistyped = None
        for most in (1, 2):
            left = asked.where(F.col("k") == most).withColumn("form", F.explode(deletions("word", most)))
            near = left.join(forms, "form").drop("form").withColumn("typos", F.levenshtein("tok", "word")).where((F.col("typos") <= most) & (F.abs(F.length("tok") - F.length("word")) <= most))
            mistyped = near if mistyped is None else mistyped.unionByName(near)
        terms = same.unionByName(begun).unionByName(mistyped).groupBy("query_id", "n", "qi", "tok").agg(F.min("typos").alias("typos"), F.max((F.col("word") == F.col("tok")).cast("int")).alias("exact"))
        allowed = self._allowed(m, request).select("segment", "doc", "id", "indexed_at")
        here = self._matches(self._all(m, "postings"), terms, ("query_id", "n")).join(allowed, ["segment", "doc"])
        limit, offset = clamped(request)
        w, most = Window.partitionBy("query_id").orderBy(*ranking()), asked.agg(F.max("n")).first()[0] or 1
        # words that a query has not got match nothing, so one length does for all
        out = weighed(here, [[Token("")]] * most, ("query_id", "n", "id", "indexed_at"))
        out = (out.where("words = n") if strict else out.where("first_qi = 0")).withColumn("score", score(F.col("n")))
        ranked = out.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
        return ranked.select("query_id", "rank", "id", "words", "typos", "proximity", "attr", "exact", "score")

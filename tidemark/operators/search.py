"""Full-text search: postings, candidate terms, ranking, filters and facets.

A search over documents is one scan without a shuffle: each document's words are matched and weighed inside its row, and
only the best rows leave a task. Searches that need not read the texts again are those of index.py.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import crop, fold, mark_words, tokens

#: Word lengths from which one and two typos are allowed, by strictness.
TYPO_LENGTHS = {"strict": (8, 12), "balanced": (6, 10), "tolerant": (5, 9)}
#: Searchable attributes, best first; filterable and sortable ones.
ATTRIBUTES = ("title", "tags", "content")
FILTERABLE = {"type", "locale", "tags", "published_at", "is_protected", "allowed_groups"}
SORTABLE = {"published_at", "indexed_at", "weight"}
SHORT, MOST_HITS, FAR = 3, 100, 8
#: Synonyms of the German index.
SYNONYMS = {"strasse": ["straße"], "straße": ["strasse"], "masse": ["maße", "mass"], "maße": ["masse"]}


@dataclass(frozen=True)
class Token:
    text: str
    exact: bool = False  # neither typos nor prefixes


@dataclass(frozen=True)
class Request:
    query: str = ""
    strictness: str = "balanced"
    locales: tuple[str, ...] = ()
    groups: tuple[int, ...] = ()
    filters: dict = field(default_factory=dict)
    tags_mode: str = "any"
    limit: int = 10
    offset: int = 0


def rewrite(query: str, strictness: str = "balanced") -> tuple[list[list[Token]], bool]:
    """Phrases of tokens, and whether all of them must match.

    Quoted words make a phrase. Short words must match exactly in strict mode, and in balanced mode if alone.
    """
    parts = query.split('"')
    phrases: list[list[Token]] = []
    loose = [w for i, p in enumerate(parts) if i % 2 == 0 for w in p.split()]
    for i, part in enumerate(parts):
        if i % 2 and (words := part.split()):
            phrases.append([Token(w, True) for w in words])
        elif i % 2 == 0:
            for w in part.split():
                short = len(w) <= SHORT and (strictness == "strict" or strictness == "balanced" and len(loose) == 1 and len(parts) == 1)
                phrases.append([Token(w, short)])
    return phrases, strictness == "strict"


def postings(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """id, keep, tok, attr (0 title, 1 tags, 2 content) and pos of every word."""
    keep = keep or []
    each = F.array(*(F.struct(F.lit(i).alias("attr"), tokens(F.array_join(a, " ") if a == "tags" else F.col(a)).alias("toks")) for i, a in enumerate(ATTRIBUTES)))
    return docs.select("id", *keep, F.explode(each).alias("a")).select("id", *keep, "a.attr", F.posexplode("a.toks").alias("pos", "tok"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """tok, n, docs: how often each word occurs and in how many documents. A document gives a row for each word and one for each
    distinct word, so both numbers are sums that are made before the shuffle."""
    every = F.concat(*(tokens(F.array_join(a, " ") if a == "tags" else F.col(a)) for a in ATTRIBUTES))
    row = lambda n, d: lambda t: F.struct(t.alias("tok"), F.lit(n).alias("n"), F.lit(d).alias("docs"))
    each = alone(docs, "w", every).select(F.explode(F.concat(F.transform("w", row(1, 0)), F.transform(F.array_distinct("w"), row(0, 1)))).alias("r"))
    return each.groupBy("r.tok").agg(F.sum("r.n").alias("n"), F.sum("r.docs").alias("docs"))


def match_terms(vocabulary: DataFrame, phrases: list[list[Token]], strictness: str = "balanced", synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """qi, tok, typos, exact: the words of the vocabulary (tok) that stand for each query word; a few literals drive it."""
    out = None
    for qi, (typos, exact) in enumerate(likeness(phrases, strictness, synonyms)):
        hit = vocabulary.select(F.lit(qi).alias("qi"), "tok", typos(F.col("tok")).alias("typos"), exact(F.col("tok")).alias("exact")).where("typos IS NOT NULL")
        out = hit if out is None else out.unionByName(hit)
    return out


def likeness(phrases: list[list[Token]], strictness: str, synonyms: dict[str, list[str]] | None) -> list[tuple]:
    """For each query word, columns of a token: its typos (null: it doesn't stand for the word), and whether it is equal (0, 1)."""
    flat = [t for p in phrases for t in p]
    one, two = TYPO_LENGTHS[strictness]

    def of(qi: int, t: Token) -> tuple:
        word = fold(F.lit(t.text))
        alike = [fold(F.lit(alt)) for alt in (synonyms or {}).get(t.text.lower(), [])]
        prefix = strictness != "strict" and not t.exact and qi == len(flat) - 1
        k = 0 if t.exact else 2 if len(t.text) >= two else 1 if len(t.text) >= one else 0

        def typos(tok: Column) -> Column:
            choices = [F.when(tok == w, F.lit(0)) for w in (word, *alike)]
            if prefix:
                choices.append(F.when(tok.startswith(word), F.lit(0)))
            if k:
                close = F.abs(F.length(tok) - F.length(word)) <= k
                distance = F.when(close, F.levenshtein(tok, word, k))
                choices.append(F.when(distance >= 0, distance))
            return F.coalesce(*choices)

        return typos, lambda tok: (tok == word).cast("int")

    return [of(qi, t) for qi, t in enumerate(flat)]


def alone(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: a generator, as filters are not pushed below one and copied there."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def row_hits(docs: DataFrame, phrases: list[list[Token]], strictness: str, synonyms: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, indexed_at, keep and what `hits` counts, of documents with a match and all phrases; each from its own row."""
    like = likeness(phrases, strictness, synonyms)

    def found(attr: int, name: str) -> Column:
        toks = tokens(F.array_join(name, " ") if name == "tags" else F.col(name))
        some = F.filter(F.transform(toks, lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda x: F.coalesce(*(typos(x["tok"]) for typos, _ in like)).isNotNull())
        each = lambda x: F.array(*(F.struct(F.lit(attr).alias("attr"), x["pos"].alias("pos"), F.lit(q).alias("qi"), typos(x["tok"]).alias("typos"), exact(x["tok"]).alias("exact")) for q, (typos, exact) in enumerate(like)))
        return F.filter(F.flatten(F.transform(some, each)), lambda y: y["typos"].isNotNull())

    return weighed(alone(docs, "m", F.concat(*(found(i, a) for i, a in enumerate(ATTRIBUTES)))).select("id", "indexed_at", *keep, "m"), phrases, ("id", "indexed_at", *keep))


def weighed(found: DataFrame, phrases: list[list[Token]], keep: tuple[str, ...]) -> DataFrame:
    """keep and what `hits` counts, of rows whose matches (m: attr, pos, qi, typos, exact in order) hold all phrases.

    One SQL text, as hundreds of Column objects take longer to make than the query takes to run.
    """
    n = sum(map(len, phrases))
    of = lambda *qi: f"filter(m, y -> y.qi IN ({', '.join(map(str, qi))}))"
    total = lambda terms: " + ".join(["0L", *(f"coalesce(CAST({t} AS BIGINT), 0L)" for t in terms)])
    field = lambda pick, name: [f"{pick}(transform({of(q)}, y -> y.{name}))" for q in range(n)]
    # neighbours of a pair of query words: nearest positions are next to each other in the pair's own order
    gap = "CASE WHEN a.attr = b.attr AND a.qi <> b.qi THEN b.pos - a.pos END"
    gaps = [f"array_min(zip_with({of(p - 1, p)}, slice({of(p - 1, p)}, 2, greatest(size({of(p - 1, p)}) - 1, 0)), (a, b) -> {gap}))" for p in range(1, n)]
    value = {
        "words": total(f"size({of(q)}) > 0" for q in range(n)), "typos": total(field("array_min", "typos")), "attr": "array_min(transform(m, y -> y.attr))", "exact": total(field("array_max", "exact")),
        "first_qi": "array_min(transform(m, y -> y.qi))", "near": total(f"CASE WHEN {g} IS NOT NULL THEN least({g}, {FAR}) END" for g in gaps), "pairs": total(f"{g} IS NOT NULL" for g in gaps), "met": _phrases_met(phrases),
    }
    out = alone(found.where(F.size("m") > 0), "v", F.expr(f"named_struct({', '.join(f"'{k}', {v}" for k, v in value.items())})")).where("v.met")
    return out.select(*keep, "v.words", "v.typos", "v.attr", "v.exact", "v.first_qi", F.expr(f"v.near + greatest((v.words - 1 - v.pairs) * {FAR}, 0)").alias("proximity"))


def _phrases_met(phrases: list[list[Token]]) -> str:
    """Whether m has each phrase's words next to each other in one attribute."""
    out, at = ["true"], 0
    for p in phrases:
        if len(p) > 1:
            starts = [f"transform(filter(m, y -> y.qi = {at + i} AND y.exact = 1), y -> named_struct('attr', y.attr, 'start', y.pos - {i}))" for i in range(len(p))]
            both = starts[0]
            for s in starts[1:]:
                both = f"array_intersect({both}, {s})"
            out.append(f"size({both}) > 0")
        at += len(p)
    return " AND ".join(out)


def hits(posted: DataFrame, terms: DataFrame, keep: list[str]) -> DataFrame:
    """Per document: words, typos, proximity, attr, exact of its best matches."""
    found = posted.join(terms, "tok")
    word = found.groupBy("id", *keep, "qi").agg(F.min("typos").alias("typos"), F.min("attr").alias("attr"), F.max("exact").alias("exact"))
    total = word.groupBy("id", *keep).agg(F.count("*").alias("words"), F.sum("typos").alias("typos"), F.min("attr").alias("attr"), F.sum("exact").alias("exact"), F.min("qi").alias("first_qi"))
    # neighbours of a pair of query words: nearest positions are next to each other in the pair's own order
    pair = found.select("id", "attr", "pos", "qi", F.explode(F.array(F.col("qi"), F.col("qi") + 1)).alias("p"))
    w = Window.partitionBy("id", "attr", "p").orderBy("pos", "qi")
    gap = pair.withColumn("gap", F.when(F.lag("qi").over(w) != F.col("qi"), F.col("pos") - F.lag("pos").over(w))).where("gap IS NOT NULL")
    near = gap.groupBy("id", "p").agg(F.least(F.min("gap"), F.lit(FAR)).alias("gap")).groupBy("id").agg(F.sum("gap").alias("near"), F.count("*").alias("pairs"))
    out = total.join(near, "id", "left")
    far = (F.col("words") - 1 - F.coalesce("pairs", F.lit(0))) * FAR
    return out.withColumn("proximity", (F.coalesce("near", F.lit(0)) + F.greatest(far, F.lit(0))).cast("long")).drop("near", "pairs")


def score(n: int | Column) -> Column:
    """From 0 to 1: matched words, less typos, distance and attribute, plus exactness."""
    raw = F.col("words") / n - 0.1 * F.col("typos") / n - 0.01 * F.col("proximity") / (8.0 * n) - 0.001 * F.col("attr") / 2 + 0.0001 * F.col("exact") / n
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 6)


def ranking() -> list[Column]:
    return [F.desc("words"), F.asc("typos"), F.asc("proximity"), F.asc("attr"), F.desc("indexed_at"), F.desc("exact"), F.asc("id")]


def phrase_docs(posted: DataFrame, words: list[str]) -> DataFrame:
    """id of documents that have the words next to each other in one attribute."""
    folded = posted.select("id", "attr", "pos", "tok")
    at = None
    for i, w in enumerate(words):
        part = folded.where(F.col("tok") == fold(F.lit(w))).select("id", "attr", (F.col("pos") - i).alias("start"))
        at = part if at is None else at.join(part, ["id", "attr", "start"], "left_semi")
    return at.select("id").distinct()


def visible(groups: tuple[int, ...] | list[int] = ()) -> Column:
    """The access filter: public (null counts as public), or one of the member's positive groups is allowed."""
    member = [int(g) for g in groups if int(g) > 0]
    public = ~F.coalesce(F.col("is_protected"), F.lit(False))
    return public | F.arrays_overlap("allowed_groups", F.array(*map(F.lit, member))) if member else public


def user_filter(filters: dict, tags_mode: str = "any") -> Column:
    """Fields AND-ed; a list means any of its values (for tags: all, if tags_mode is all). Only declared fields."""
    out = F.lit(True)
    for name, value in filters.items():
        if name not in FILTERABLE:
            raise ValueError(f"{name} can't be filtered")
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if name in ("tags", "allowed_groups"):
            has = [F.array_contains(name, v) for v in values]
            some = F.lit(name == "tags" and tags_mode == "all")
            for h in has:
                some = some & h if name == "tags" and tags_mode == "all" else some | h
            out = out & some
        else:
            out = out & F.col(name).isin(values)
    return out


def gate(query: Column, limit: Column, shortest: int = SHORT) -> Column:
    """struct<accepted, limit>: whether a client's query has enough characters, and the limit it gets."""
    return F.struct((F.length(F.trim(F.coalesce(query, F.lit("")))) >= shortest).alias("accepted"), F.least(F.greatest(F.coalesce(limit, F.lit(10)), F.lit(1)), F.lit(MOST_HITS)).alias("limit"))


def matched(docs: DataFrame, request: Request, posted: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """All hits of a request, unordered: id, indexed_at, what ranks them, score, and the columns `keep` of the documents.

    Documents' filters run before the match. posted: postings of the documents, with indexed_at and `keep`, where they are kept.
    """
    allowed = docs.where(visible(request.groups)).where(user_filter(request.filters, request.tags_mode))
    if request.locales:
        allowed = allowed.where(F.col("locale").isin(list(request.locales)))
    phrases, strict = rewrite(request.query, request.strictness)
    if not phrases:  # browsing
        return allowed.select("id", "indexed_at", *keep, F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("typos"), F.lit(0).cast("long").alias("proximity"), F.lit(0).alias("attr"), F.lit(0).cast("long").alias("exact"), F.lit(0.0).alias("score"))
    n = sum(map(len, phrases))
    if posted is None:
        found = row_hits(allowed, phrases, request.strictness, synonyms, keep)
    else:
        posted = posted.join(allowed.select("id"), "id", "left_semi")
        found = hits(posted, match_terms(posted.select("tok").distinct(), phrases, request.strictness, synonyms), ["indexed_at", *keep])
        for p in phrases:
            if len(p) > 1:
                found = found.join(phrase_docs(posted, [t.text for t in p]), "id", "left_semi")
    found = found.where(F.col("words") == n) if strict else found.where("first_qi = 0")
    return found.withColumn("score", score(n)).select("id", "indexed_at", *keep, "words", "typos", "proximity", "attr", "exact", "score")


def clamped(request: Request) -> tuple[int, int]:
    return min(max(request.limit, 1), MOST_HITS), max(request.offset, 0)


def search(docs: DataFrame, request: Request, posted: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """The request's page of hits in rank order, with their score."""
    limit, offset = clamped(request)
    return matched(docs, request, posted, synonyms).orderBy(*ranking()).offset(offset).limit(limit)


def total_hits(docs: DataFrame, request: Request, posted: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """One row: total_hits, exact."""
    return matched(docs, request, posted, synonyms).agg(F.count("*").alias("total_hits"))


def matched_facets(docs: DataFrame, request: Request, synonyms: dict[str, list[str]] | None = None, fields: tuple[str, ...] = ("type", "locale", "tags")) -> DataFrame:
    """facet, value, n over all documents that the request matches, whatever its limit; one scan."""
    return facets(matched(docs, request, None, synonyms, fields), fields)


#: Hits of each locale that are merged, at least.
LEAST_MERGED = 50


def merge_locales(docs: DataFrame, request: Request, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """locale, locale_rank and the request's page of hits of several locales: by score, then the locales' order, then rank.

    Each locale gives its best limit + offset hits, LEAST_MERGED at least; all locales are matched in one scan.
    """
    limit, offset = clamped(request)
    found = matched(docs, request, None, synonyms, ("locale",))
    best = found.withColumn("locale_rank", F.row_number().over(Window.partitionBy("locale").orderBy(*ranking()))).where(F.col("locale_rank") <= max(limit + offset, LEAST_MERGED))
    at = F.array_position(F.array(*map(F.lit, request.locales)), F.col("locale")) if request.locales else F.col("locale")
    return best.orderBy(F.desc("score"), at, "locale_rank").offset(offset).limit(limit)


def locale_totals(docs: DataFrame, request: Request, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """locale, hits of each locale, and the sum under the locale `all`."""
    found = matched(docs, request, None, synonyms, ("locale",))
    return found.select(F.explode(F.array("locale", F.lit("all"))).alias("locale")).groupBy("locale").agg(F.count("*").alias("hits"))


def hit_view(docs: DataFrame, found: DataFrame, request: Request, synonyms: dict[str, list[str]] | None = None, width: int = 30) -> DataFrame:
    """What a reader sees of hits (found: id, score and what ranks them): type, locale, marked title, url, marked snippet,
    tags, score, is_protected. Words that stand for a query word are marked, in whatever spelling.

    Only hits meet the documents, so texts are cropped for them alone.
    """
    like = likeness(rewrite(request.query, request.strictness)[0], request.strictness, synonyms)
    meant = lambda tok: F.coalesce(*(typos(tok) for typos, _ in like)).isNotNull() if like else F.lit(False)
    shown = docs.join(found.drop("indexed_at", "locale", "type", "tags"), "id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return shown.select(
        "id", F.coalesce("type", F.lit("unknown")).alias("type"), "locale", mark_words(text("title"), meant).alias("title"), text("url").alias("url"), mark_words(crop(text("content"), meant, width), meant).alias("snippet"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("is_protected", F.lit(False)).alias("is_protected"),
    )


def as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """id and json: the row's answer as one JSON object."""
    return df.select("id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def facets(matched: DataFrame, fields: tuple[str, ...] = ("type", "locale", "tags")) -> DataFrame:
    """facet, value, n over the matched documents, in one pass."""
    def pair(f: str) -> Column:
        return F.transform(F.col(f) if f == "tags" else F.array(f), lambda v: F.struct(F.lit(f).alias("facet"), v.alias("value")))

    pairs = [pair(f) for f in fields]
    return matched.select(F.explode(F.concat(*pairs)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))

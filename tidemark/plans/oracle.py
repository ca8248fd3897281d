"""Pieces of DuckDB SQL that say what the queries of registry.py must return."""

from __future__ import annotations

from tidemark.functions.text import ACCENTED, FOLDED

DOCS = """docs AS (SELECT 'file-' || doc_id AS id, 'file' AS type, lang AS locale, 'Document ' || doc_id AS title,
 '/files/' || source || '/' || lang || '/' || doc_id || '.txt' AS url, text AS content, [source, 'txt'] AS tags,
 CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 7 = 0 END AS is_protected,
 CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 = 0 THEN [CAST(doc_id % 5 + 1 AS INTEGER)] ELSE CAST([] AS INTEGER[]) END AS allowed_groups,
 1700000000 + doc_id AS indexed_at, doc_id FROM documents)"""
PUBLIC = "NOT coalesce(is_protected, false)"
TREE = """tree AS (
 SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS pid, r_name AS title, ['de','en','fr','es','xx'][CAST(r_regionkey AS INTEGER) + 1] AS language,
  false AS protected, 0 AS grp, CASE WHEN r_regionkey % 2 = 0 THEN '.htm' END AS url_suffix FROM region
 UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'en' END, n_nationkey % 3 = 0, CAST(n_nationkey % 5 + 1 AS INTEGER), NULL FROM nation
 UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name, NULL, c_custkey % 10 = 0, CAST(c_custkey % 7 + 1 AS INTEGER), NULL FROM customer),
 up AS (SELECT id, id AS ancestor, 0 AS depth FROM tree UNION ALL SELECT up.id, t.pid, up.depth + 1 FROM up JOIN tree t ON t.id = up.ancestor WHERE t.pid <> 0 AND up.depth < 50)"""
FILES = """files AS (SELECT o_orderkey AS id, 'files/' || ['de','en','fr','docs'][CAST(o_orderkey % 4 AS INTEGER) + 1] || '/' || split_part(o_orderpriority, '-', 1) || '/item' || CAST(floor(o_orderkey / 2) AS BIGINT)
 || CASE WHEN o_orderkey % 5 = 0 THEN '_de' WHEN o_orderkey % 5 = 1 THEN '-en' ELSE '' END || '.' || ['pdf','txt','MD','docx','odt','exe'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS path, o_custkey AS page FROM orders)"""
TAGS = "tags AS (SELECT p_partkey AS tag_id, p_brand || ' ' || p_type || ' ' || p_partkey AS label FROM part), assigned AS (SELECT DISTINCT l_partkey AS tag_id, l_orderkey AS target_id FROM lineitem)"
EVENTS = """ev AS (SELECT substr(trim(event_type), 1, 255) AS q, ['de','en','fr','es'][CAST(user_id % 4 AS INTEGER) + 1] AS locale,
 greatest(coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0), 0) AS results, ts FROM events WHERE length(trim(event_type)) >= 2)"""


def fold(x: str) -> str:
    return f"replace(translate(lower({x}), '{ACCENTED}', '{FOLDED}'), 'ß', 'ss')"


def slug(x: str) -> str:
    out = f"trim(lower({x}))"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"rtrim(substr(trim(regexp_replace(translate({out}, '{ACCENTED}', '{FOLDED}'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), '-')"


def post(where: str) -> str:
    toks = lambda x: f"list_filter(string_split_regex({fold(f'coalesce({x}, chr(32))')}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    return f"""parts AS (SELECT id, indexed_at, 0 AS attr, {toks('title')} AS toks FROM docs WHERE {where}
 UNION ALL SELECT id, indexed_at, 1, {toks("array_to_string(tags, ' ')")} FROM docs WHERE {where}
 UNION ALL SELECT id, indexed_at, 2, {toks('content')} FROM docs WHERE {where}),
 post AS (SELECT id, indexed_at, attr, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM parts)"""


def search(words: list[dict], strict: bool, where: str = PUBLIC, limit: int = 20, offset: int = 0, phrase: list[str] | None = None) -> str:
    """words: text, and optionally k (typos), prefix, alts (synonyms)."""
    terms = []
    for qi, w in enumerate(words):
        t = w["text"]
        cases = [f"WHEN tok = '{t}' THEN 0", *(f"WHEN tok = '{a}' THEN 0" for a in w.get("alts", []))]
        if w.get("prefix"):
            cases.append(f"WHEN starts_with(tok, '{t}') THEN 0")
        if k := w.get("k"):
            cases.append(f"WHEN abs(length(tok) - {len(t)}) <= {k} AND levenshtein(tok, '{t}') <= {k} THEN levenshtein(tok, '{t}')")
        terms.append(f"SELECT {qi} AS qi, tok, CASE {' '.join(cases)} END AS typos, CAST(tok = '{t}' AS INTEGER) AS exact FROM vocab")
    n = len(words)
    adjacent = ""
    if phrase:
        joins = " ".join(f"JOIN post p{i} ON p{i}.id = p0.id AND p{i}.attr = p0.attr AND p{i}.pos = p0.pos + {i} AND p{i}.tok = '{w}'" for i, w in enumerate(phrase) if i)
        adjacent = f" AND id IN (SELECT p0.id FROM post p0 {joins} WHERE p0.tok = '{phrase[0]}')"
    keep = f"words = {n}" if strict else "first_qi = 0"
    return f"""WITH {DOCS}, {post(where)}, vocab AS (SELECT DISTINCT tok FROM post), terms AS (SELECT * FROM ({' UNION ALL '.join(terms)}) WHERE typos IS NOT NULL),
 found AS (SELECT id, indexed_at, attr, pos, qi, typos, exact FROM post JOIN terms USING (tok)),
 word AS (SELECT id, indexed_at, qi, min(typos) AS typos, min(attr) AS attr, max(exact) AS exact FROM found GROUP BY ALL),
 total AS (SELECT id, indexed_at, count(*) AS words, sum(typos) AS typos, min(attr) AS attr, sum(exact) AS exact, min(qi) AS first_qi FROM word GROUP BY id, indexed_at),
 pair AS (SELECT id, attr, pos, qi, unnest([qi, qi + 1]) AS p FROM found),
 gaps AS (SELECT id, p, CASE WHEN lag(qi) OVER w <> qi THEN pos - lag(pos) OVER w END AS gap FROM pair WINDOW w AS (PARTITION BY id, attr, p ORDER BY pos, qi)),
 near AS (SELECT id, sum(gap) AS near, count(*) AS pairs FROM (SELECT id, p, least(min(gap), 8) AS gap FROM gaps WHERE gap IS NOT NULL GROUP BY id, p) GROUP BY id),
 o AS (SELECT t.*, coalesce(near, 0) + greatest((words - 1 - coalesce(pairs, 0)) * 8, 0) AS proximity FROM total t LEFT JOIN near USING (id)),
 s AS (SELECT *, round(least(greatest(words / {n} - 0.1::DOUBLE * typos / {n} - 0.01::DOUBLE * proximity / (8.0::DOUBLE * {n}) - 0.001::DOUBLE * attr / 2 + 0.0001::DOUBLE * exact / {n}, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS score FROM o WHERE {keep}{adjacent})
 SELECT id, CAST(words AS BIGINT) AS words, CAST(typos AS BIGINT) AS typos, CAST(proximity AS BIGINT) AS proximity, CAST(attr AS INTEGER) AS attr, CAST(exact AS BIGINT) AS exact, CAST(score AS DOUBLE) AS score FROM s
 ORDER BY words DESC, typos, proximity, attr, indexed_at DESC, exact DESC, id LIMIT {limit} OFFSET {offset}"""

"""DuckDB SQL of the queries, put together from shared pieces."""

from __future__ import annotations

from weftlight.functions.text import STOP_WORDS
from weftlight.functions.url import NOT_PAGES

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS if "'" not in w)


def masked(text: str) -> str:
    """Lower case, with letters and numbers beyond ASCII as word characters that RE2 knows."""
    return rf"regexp_replace(lower(coalesce({text}, '')), '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', '_', 'g')"


def stemmed(relation: str) -> str:
    """``relation`` (with a column w) and its column stem."""
    return f"""
(SELECT * EXCLUDE (a, k, b), CASE
   WHEN k IN (2, 3, 4) AND length(b) > 2 AND right(b, 1) = substr(b, length(b) - 1, 1) AND right(b, 1) NOT IN ('l', 's', 'z') THEN left(b, length(b) - 1)
   WHEN k IN (2, 3) AND regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' ELSE b END AS stem
 FROM (SELECT *, CASE k WHEN 1 THEN left(a, length(a) - 1) WHEN 2 THEN left(a, length(a) - 3) WHEN 3 THEN left(a, length(a) - 2)
          WHEN 4 THEN left(a, length(a) - 2) WHEN 5 THEN left(a, length(a) - 2) WHEN 6 THEN left(a, length(a) - 4) ELSE a END AS b
  FROM (SELECT *, CASE WHEN length(w) <= 3 THEN 0 WHEN a LIKE '%eed' THEN 1 WHEN a LIKE '%ing' THEN 2 WHEN a LIKE '%ed' THEN 3
           WHEN a LIKE '%er' AND length(a) > 4 THEN 4 WHEN a LIKE '%ly' THEN 5 WHEN a LIKE '%ment' AND length(a) > 6 THEN 6 ELSE 0 END AS k
   FROM (SELECT *, CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'i'
            WHEN w LIKE '%es' AND w NOT LIKE '%ees' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w
            WHEN w LIKE '%s' AND NOT regexp_matches(w, '(us|is|as)$') THEN left(w, length(w) - 1) ELSE w END AS a
    FROM {relation}))))"""


def token_cte(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (key, i, word): the index tokens of ``source`` in order."""
    return rf"""
{name}_w AS (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS i
  FROM (SELECT {key}, regexp_extract_all({masked(text)}, '\b[a-zA-Z0-9\-]+\b') AS l FROM {source})),
{name} AS (SELECT {key}, i, stem AS word FROM {stemmed(f"(SELECT * FROM {name}_w WHERE w NOT IN ({_STOP}) AND length(w) BETWEEN 2 AND 50)")}
  WHERE stem <> '' AND stem NOT IN ({_STOP}))"""


def postings_cte(source: str, key: str, text: str) -> str:
    """CTE post (page_id, word, n, tf)."""
    return token_cte("tok", source, key, text) + f""",
tot AS (SELECT {key}, count(*) AS total FROM tok GROUP BY 1),
post AS (SELECT {key} AS page_id, word, count(*) AS n, count(*) / any_value(total) AS tf FROM tok JOIN tot USING ({key}) GROUP BY 1, 2)"""


PAGE_SOURCE = "pages"


def queries_cte(n: int) -> str:
    return f"""
q AS (SELECT query_id, query FROM (SELECT row_number() OVER (ORDER BY c DESC, query) AS query_id, query
  FROM (SELECT lower(trim(query)) AS query, count(*) AS c FROM search_history WHERE trim(query) <> '' GROUP BY 1)) WHERE query_id <= {n})"""


VECTORS_CTE = """
pv AS (SELECT page_id, v FROM (
  SELECT page_id, v, row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC, embedding DESC) AS r
  FROM (SELECT *, TRY_CAST(embedding AS DOUBLE[]) AS v FROM page_embeddings WHERE page_id IS NOT NULL)
  WHERE len(v) = 384 AND len([x for x in v if x IS NOT NULL AND isfinite(x)]) = 384 AND len([x for x in v if x <> 0]) > 0) WHERE r = 1),
qv AS (SELECT v AS qv FROM pv ORDER BY page_id LIMIT 1)"""


#: Titles as queries, asked by every page whose id is divisible by 20, with the vector of the page.
TITLES_CTE = """
q AS (SELECT id AS query_id, title AS query FROM pages WHERE id % 20 = 0)"""
_WEIGHTS = ("0.5", "0.3", "0.2"), ("0.7", "0.3", "0.0")


def search_sql(queries: str, vectors: str, columns: str, tail: str = "") -> str:
    """``vectors``: "none", "one" for all queries, or each query's "own"."""
    similarity = "0.0::DOUBLE" if vectors == "none" else "coalesce(list_dot_product(v, qv), 0)"
    joins = {"none": "", "one": "LEFT JOIN pv USING (page_id) CROSS JOIN qv", "own": "LEFT JOIN pv USING (page_id) LEFT JOIN (SELECT page_id AS query_id, v AS qv FROM pv) USING (query_id)"}[vectors]
    has = {"none": "false", "one": "true", "own": "qv IS NOT NULL"}[vectors]
    weights = [f"CASE WHEN has_vector THEN {a} ELSE {b} END" for a, b in zip(*_WEIGHTS, strict=True)]
    return f"""
WITH {queries}, {token_cte("qtok", "q", "query_id", "query")},
terms AS (SELECT DISTINCT query_id, word FROM qtok), {postings_cte("pages", "id", "content")}, {VECTORS_CTE},
n AS (SELECT count(*) AS np FROM pages),
w AS (SELECT word, ln(1 + np / (1.0 + count(*))) AS idf FROM post, n WHERE word IN (SELECT word FROM terms) GROUP BY word, np),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, page_id) AS r
  FROM (SELECT query_id, page_id, round(sum(tf * idf), 12) AS raw FROM terms JOIN w USING (word) JOIN post USING (word) GROUP BY 1, 2)) WHERE r <= 50),
rows_ AS (SELECT query_id, page_id, raw, coalesce(p.pagerank, 0.15) AS pr, {similarity} AS sim, p.title AS t, p.content AS content, p.url AS url, p.language AS lang, p.crawl_time AS crawled, {has} AS has_vector
  FROM cand JOIN pages p ON p.id = page_id {joins}),
norm AS (SELECT *, raw / CASE WHEN mr > 0 THEN mr ELSE 1 END AS tfidf_, pr / CASE WHEN mp > 0 THEN mp ELSE 1 END AS rank_,
    greatest(sim / CASE WHEN ms > 0 THEN ms ELSE 1 END, 0) AS sem_
  FROM (SELECT *, max(raw) OVER w AS mr, max(pr) OVER w AS mp, max(sim) OVER w AS ms FROM rows_ WINDOW w AS (PARTITION BY query_id))),
scored AS (SELECT *, round_even({weights[0]} * tfidf_ + {weights[1]} * rank_ + {weights[2]} * sem_, 5) AS score FROM norm),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS position FROM scored) WHERE position <= 20),
qw AS (SELECT query_id, string_agg(word, '|' ORDER BY word) AS alt FROM terms GROUP BY 1)
SELECT {columns} FROM top JOIN qw USING (query_id) {tail}"""


_RESULT = """query_id, position, page_id, url, CASE WHEN coalesce(t, '') = '' THEN 'Untitled' ELSE t END AS title, CASE WHEN coalesce(lang, '') = '' THEN 'en' ELSE lang END AS language,
  replace(strftime(crawled AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') AS crawl_time, score,
  round_even(tfidf_, 4) AS tfidf, round_even(rank_, 4) AS pagerank, round_even(sem_, 4) AS semantic"""

SNIPPETS = f"""
SELECT query_id, page_id, CASE WHEN c = '' THEN '' WHEN NOT hit THEN substr(c, 1, 200) || CASE WHEN length(c) > 200 THEN '...' ELSE '' END
  ELSE CASE WHEN stop < length(c) THEN CASE WHEN contains(o, ' ') THEN regexp_replace(o, '(?s) [^ ]*$', '') ELSE o END || '...' ELSE o END END AS snippet
FROM (SELECT *, CASE WHEN start > 0 THEN '...' || CASE WHEN contains(piece, ' ') THEN substr(piece, instr(piece, ' ') + 1) ELSE piece END ELSE piece END AS o
 FROM (SELECT *, substr(c, start::INT + 1, (stop - start)::INT) AS piece
  FROM (SELECT *, greatest(first_ - 60, 0) AS start, least(length(c), first_ + 140) AS stop
   FROM (SELECT query_id, page_id, c, regexp_matches(m, '\\b(?:' || alt || ')') AS hit, length(regexp_extract(m, '(?s)^(.*?)\\b(?:' || alt || ')', 1)) AS first_
    FROM (SELECT query_id, page_id, alt, coalesce(content, '') AS c, {masked("content")} AS m FROM ({search_sql(queries_cte(5), "none", "query_id, page_id, alt, content")}))))))"""

_DECODED = "replace(replace(replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def decoded(x: str) -> str:
    return _DECODED.format(x=x)


def cleaned(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def content_of(html: str) -> str:
    text = html
    for element in ("script", "style", "noscript", "header", "footer", "nav"):
        text = rf"regexp_replace({text}, '(?is)<{element}\b[^>]*>.*?(?:</{element}\s*>|\z)', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?s)<!--.*?(?:-->|\z)', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?s)<[^>]*(?:>|\z)', ' ', 'g')"
    return cleaned(decoded(text))


BARE = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g')"
TITLE = "coalesce(nullif(trim(" + decoded(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)") + "), ''), 'Untitled')"
LANGUAGE = r"""coalesce(nullif(left(regexp_extract(html, '(?is)<html\b[^>]*?\blang\s*=\s*["'']?([^"''>\s]*)', 1), 10), ''), 'en')"""
_FORWARD = r"""regexp_extract(html, '(?is)<meta\b[^>]*?\bname\s*=\s*["'']?{n}["''\s][^>]*?\bcontent\s*=\s*"([^"]*)"', 1)"""
_BACKWARD = r"""regexp_extract(html, '(?is)<meta\b[^>]*?\bcontent\s*=\s*"([^"]*)"[^>]*?\bname\s*=\s*["'']?{n}["''\s>]', 1)"""


def meta(n: str) -> str:
    return "trim(" + decoded("CASE WHEN " + _FORWARD.format(n=n) + " <> '' THEN " + _FORWARD.format(n=n) + " ELSE " + _BACKWARD.format(n=n) + " END") + ")"


LINK_ROWS = rf"""
SELECT DISTINCT src, split_part(u, '#', 1) AS target FROM (
 SELECT src, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN h WHEN starts_with(h, '//') THEN split_part(url, ':', 1) || ':' || h
    WHEN starts_with(h, '#') THEN split_part(url, '#', 1) || h WHEN starts_with(h, '/') THEN origin || h
    WHEN starts_with(h, '../') THEN origin || regexp_replace(dir, '[^/]+/$', '') || substr(h, 4) WHEN h = '' THEN url ELSE origin || dir || h END AS u
 FROM (SELECT id AS src, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
     CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') END AS dir,
     trim({decoded("unnest(regexp_extract_all(" + BARE + chr(44) + chr(32) + "'" + r'''(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"''' + "', 1))")}) AS h
   FROM pages WHERE html IS NOT NULL AND url IS NOT NULL))
WHERE regexp_matches(u, '^https?:') AND split_part(u, '#', 1) <> ''
  AND NOT regexp_matches(lower(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1)), '\.(?:{"|".join(e.replace(".", chr(92) + ".") for e in NOT_PAGES)})$')"""

KEYWORDS = f"array_to_string([trim(x) for x in string_split({meta('keywords')}, ',') if trim(x) <> ''], '|')"
HEADINGS = "array_to_string([h for h in [" + cleaned(decoded("regexp_replace(x, '<[^>]*>', '', 'g')")) + " for x in regexp_extract_all(" + BARE + r", '(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>', 1)] if h <> ''], '|')"
IMAGES = "array_to_string(list_sort(list_distinct([" + decoded("x") + " for x in regexp_extract_all(" + BARE + r""", '(?is)<img\b[^>]*?\bsrc\s*=\s*"(https?://[^"]*)"', 1)])), '|')"""

EDGES = """
e AS (SELECT DISTINCT source_page AS src, destination_page AS dst FROM links WHERE source_page <> destination_page
  AND source_page IN (SELECT id FROM pages) AND destination_page IN (SELECT id FROM pages))"""

def rounds_sql(edges: str, rounds: int) -> str:
    """CTEs up to r (k, id, rank): the ranks of all rounds over the edges (src, dst) of a CTE ``g``."""
    return f"""
WITH RECURSIVE {EDGES}, g AS ({edges}), n AS (SELECT count(DISTINCT id) AS n FROM pages), o AS (SELECT src, count(*) AS d FROM g GROUP BY 1),
v AS (SELECT DISTINCT id, id NOT IN (SELECT src FROM o) AS leaf FROM pages WHERE id IS NOT NULL),
r AS (
  SELECT 0 AS k, id, 1.0::DOUBLE / n AS rank FROM v, n
  UNION ALL
  SELECT k + 1, id, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(flow, 0)
  FROM (SELECT k, r.id, sum(CASE WHEN leaf THEN rank ELSE 0 END) OVER () AS lost FROM r JOIN v USING (id) WHERE k < {rounds}) a
  LEFT JOIN (SELECT g.dst AS id, sum(rank / d) AS flow FROM r JOIN g ON g.src = r.id JOIN o ON o.src = g.src WHERE k < {rounds} GROUP BY 1) f USING (id), n)"""


ALL_LINKS, FORWARD = "SELECT * FROM e", "SELECT * FROM e WHERE src < dst"
PAGERANK = rounds_sql(ALL_LINKS, 20) + """
SELECT id, round(rank / max(rank) OVER (), 6) + 0.0 AS pagerank FROM r WHERE k = 20"""


def converged_sql(edges: str, columns: str, tail: str = "") -> str:
    """Ranks of the first round that changes them by less than 1e-6, of 50 rounds at most."""
    return rounds_sql(edges, 50) + f""",
change AS (SELECT k, sum(abs(rank - old)) AS c FROM (SELECT k, rank, lag(rank) OVER (PARTITION BY id ORDER BY k) AS old FROM r) WHERE k > 0 GROUP BY 1),
stop AS (SELECT coalesce(min(k) FILTER (c < 1e-6), 50)::INT AS k, coalesce(min(k) FILTER (c < 1e-6) IS NOT NULL, false) AS converged FROM change)
SELECT {columns} {tail}"""


_RANKS = "id, round_even(rank / max(rank) OVER (), 8) + 0.0 AS pagerank FROM r WHERE k = (SELECT k FROM stop)"
_STATS = "(SELECT n FROM n) AS pages, (SELECT count(*) FROM g) AS edges, k AS iterations, converged FROM stop"

QUEUE = """
queue AS (SELECT event_id AS id, 'https://site' || (user_id % 50) || '.example/p/' || (event_id % 400) AS url,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'pending' ELSE 'crawling' END AS status,
  (event_id % 5)::INT AS depth, (event_id % 11)::INT AS priority, 'site' || (user_id % 50) || '.example' AS domain, ts, 'w' || (user_id % 20) AS worker, value FROM events)"""

def best_of(by: str, key: str, k: int) -> str:
    """The k best rows of s for each query."""
    return f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC, {key}) AS r FROM s) WHERE r <= {k}"


CLASSIFIED = """WITH s AS (SELECT * FROM pages WHERE last_checked IS NOT NULL), h AS (SELECT page_hash, min(url) AS lo, max(url) AS hi FROM s WHERE page_hash IS NOT NULL GROUP BY 1),
      f AS (SELECT page_hash, min(id) AS first_ FROM pages WHERE status_code = 200 AND page_hash IS NOT NULL GROUP BY 1),
      j AS (SELECT p.id, p.url, status_code, p.page_hash, p.url IN (SELECT url FROM s) AS known, coalesce(lo <> p.url OR hi <> p.url, false) AS elsewhere, first_ FROM pages p LEFT JOIN h ON h.page_hash = p.page_hash LEFT JOIN f ON f.page_hash = p.page_hash)
      SELECT id, url, coalesce(status_code, 0) AS status_code, page_hash, coalesce(CASE WHEN status_code = 304 THEN CASE WHEN known THEN 'skipped' ELSE 'none' END WHEN status_code IN (301, 302) THEN 'redirect'
        WHEN status_code = 200 THEN CASE WHEN elsewhere OR (NOT known AND page_hash IS NOT NULL AND coalesce(id > first_, false)) THEN 'duplicate' WHEN known THEN 'updated' ELSE 'new' END
        WHEN status_code = 404 THEN 'missing' ELSE 'error' END, 'error') AS outcome FROM j"""

ORACLES: dict[str, str] = {
    "tokenize_docs": f"WITH {token_cte('tok', 'documents', 'doc_id', 'text')} SELECT doc_id, coalesce(any_value(s), '') AS tokens, coalesce(any_value(c), 0) AS n FROM documents LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*)::INT AS c FROM tok GROUP BY 1) USING (doc_id) GROUP BY doc_id",
    "stem_vocab": f"SELECT word, stem FROM {stemmed('(SELECT word, lower(trim(word)) AS w FROM words)')}",
    "term_frequency": f"WITH {postings_cte('documents', 'doc_id', 'text')} SELECT page_id, word, n, round(tf, 12) AS tf FROM post",
    "document_frequency": f"WITH {postings_cte('documents', 'doc_id', 'text')} SELECT word, count(*) AS df FROM post GROUP BY 1",
    "idf": f"WITH {postings_cte('documents', 'doc_id', 'text')} SELECT word, count(*) AS df, round(ln(1 + (SELECT count(*) FROM documents) / (1.0 + count(*))), 9) AS idf FROM post GROUP BY 1",
    "tfidf_topk": f"""WITH {postings_cte('documents', 'doc_id', 'text')}, w AS (SELECT word, ln(1 + (SELECT count(*) FROM documents) / (1.0 + count(*))) AS idf FROM post WHERE word IN ('museum', 'market') GROUP BY 1)
      SELECT page_id, raw FROM (SELECT page_id, round(sum(tf * idf), 12) AS raw FROM post JOIN w USING (word) GROUP BY 1) ORDER BY raw DESC, page_id LIMIT 50""",
    "search_blended": search_sql(queries_cte(5), "one", _RESULT),
    "search_no_semantic": search_sql(queries_cte(5), "none", _RESULT),
    "search_multi_query": search_sql(queries_cte(100), "none", _RESULT),
    "snippets": SNIPPETS,
    "search_blended_asked": search_sql(TITLES_CTE, "own", _RESULT),
    "cosine_topk_asked": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) "
    + best_of("similarity", "id", 20),
    "vector_cosine_asked": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) "
    + best_of("cosine", "id", 20),
    "page_similarity_asked": f"WITH {VECTORS_CTE}, s AS (SELECT q.page_id AS query_id, p.page_id, round(list_dot_product(p.v, q.v), 8) AS similarity FROM pv p, pv q WHERE q.page_id % 20 = 0) "
    + best_of("similarity", "page_id", 20),
    "tfidf_topk_asked": f"WITH {postings_cte('documents', 'doc_id', 'text')}, w AS (SELECT word, ln(1 + (SELECT count(*) FROM documents) / (1.0 + count(*))) AS idf FROM post GROUP BY 1), "
    "s AS (SELECT q.page_id AS query_id, p.page_id, round(sum(p.tf * idf), 12) AS raw FROM post q JOIN post p USING (word) JOIN w USING (word) WHERE q.page_id % 20 = 0 GROUP BY 1, 2) "
    + best_of("raw", "page_id", 50),
    "html_title_lang": f"SELECT id, {TITLE} AS title, {LANGUAGE} AS language FROM pages WHERE html IS NOT NULL",
    "html_meta": f"SELECT id, {meta('description')} AS description, {KEYWORDS} AS keywords FROM pages WHERE html IS NOT NULL",
    "html_content_hash": f"SELECT id, sha256(c) AS page_hash, length(c)::INT AS n_chars FROM (SELECT id, {content_of('html')} AS c FROM pages WHERE html IS NOT NULL)",
    "html_headings": f"SELECT id, {HEADINGS} AS headings FROM pages WHERE html IS NOT NULL",
    "html_links": LINK_ROWS,
    "html_images": f"SELECT id, {IMAGES} AS images FROM pages WHERE html IS NOT NULL",
    "html_parsed": f"""WITH l AS ({LINK_ROWS})
      SELECT id, {TITLE} AS title, length(c)::INT AS n_chars, sha256(c) AS page_hash, {meta('description')} AS description, {LANGUAGE} AS language, {KEYWORDS} AS keywords,
        coalesce((SELECT string_agg(target, '|' ORDER BY target) FROM l WHERE src = id), '') AS links, {HEADINGS} AS headings, {IMAGES} AS images
      FROM (SELECT *, {content_of('html')} AS c FROM pages WHERE html IS NOT NULL AND url IS NOT NULL)""",
    "html_link_edges": f"WITH l AS ({LINK_ROWS}), k AS (SELECT split_part(url, '#', 1) AS target, min(id) AS dst FROM pages GROUP BY 1) SELECT DISTINCT src, dst FROM l JOIN k USING (target) WHERE src <> dst",
    "url_parts": r"SELECT id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS domain, split_part(url, '#', 1) AS plain, lower(split_part(url, ':', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) || '/robots.txt' AS robots FROM pages",
    "normalize_seeds": r"""WITH s AS (SELECT domain AS raw FROM websites UNION ALL SELECT '  ' || domain || '/ ' FROM websites UNION ALL SELECT 'http://' FROM websites UNION ALL SELECT url FROM pages),
      u AS (SELECT raw, CASE WHEN regexp_matches(trim(raw), '^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END AS f FROM s),
      g AS (SELECT raw, CASE WHEN regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) <> '' THEN f END AS url FROM u),
      r AS (SELECT *, CASE WHEN url IS NULL THEN 'invalid' WHEN url IN (SELECT url FROM pages) THEN 'visited' ELSE 'added' END AS reason FROM g)
      SELECT raw, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS domain, reason = 'added' AS accepted, reason FROM r""",
    "content_dedup": "SELECT page_hash, min(id) AS id, count(*) AS copies FROM pages WHERE page_hash IS NOT NULL GROUP BY 1",
    "link_edges": f"WITH {EDGES} SELECT * FROM e",
    "out_degree": f"WITH {EDGES} SELECT src, count(*) AS out_degree FROM e GROUP BY 1",
    "dangling_nodes": f"WITH {EDGES} SELECT id FROM pages WHERE id NOT IN (SELECT src FROM e)",
    "pagerank_scores": PAGERANK,
    "pagerank_update": PAGERANK.replace("SELECT id, round(rank / max(rank) OVER (), 6) + 0.0 AS pagerank FROM r WHERE k = 20", "SELECT p.id, p.url, round(rank / max(rank) OVER (), 6) + 0.0 AS pagerank FROM r JOIN pages p USING (id) WHERE k = 20"),
    "pagerank_converged": converged_sql(ALL_LINKS, _RANKS),
    "pagerank_stats": converged_sql(ALL_LINKS, _STATS),
    "pagerank_forward": converged_sql(FORWARD, _RANKS),
    "pagerank_forward_stats": converged_sql(FORWARD, _STATS),
    "dangling_forward": f"WITH {EDGES} SELECT id FROM pages WHERE id NOT IN (SELECT src FROM e WHERE src < dst)",
    "pagerank_top": f"SELECT * FROM ({PAGERANK}) ORDER BY pagerank DESC, id LIMIT 5",
    "vector_cosine": "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS cosine FROM embeddings",
    "robots_addresses": r"SELECT DISTINCT lower(split_part(url, ':', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) || '/robots.txt' AS url FROM pages WHERE url IS NOT NULL",
    "cosine_topk": "SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20",
    "page_similarity": f"WITH {VECTORS_CTE} SELECT page_id, round(list_dot_product(v, qv), 8) AS similarity FROM pv, qv",
    "embedding_json_roundtrip": f"WITH {VECTORS_CTE} SELECT page_id, len(v)::INT AS dims, round(list_sum(v), 6) AS total, round(sqrt(list_dot_product(v, v)), 6) AS length FROM pv",
    "corpus_counts": "SELECT *, round_even(links / greatest(pages, 1), 2) AS links_per_page FROM (SELECT (SELECT count(id) FROM pages) AS pages, (SELECT count(id) FROM websites) AS websites, (SELECT count(id) FROM words) AS words, (SELECT count(id) FROM links) AS links, (SELECT count(id) FROM search_history) AS searches)",
    "queue_stats": f"WITH {QUEUE}, c AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'crawling') AS crawling, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM queue) SELECT *, round_even((completed + failed) / total * 100, 1) AS progress FROM c",
    "top_domains": "SELECT domain, count(*) AS pages FROM websites JOIN pages ON websites.id = website_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "pages_per_site": "SELECT w.id, domain, count(p.id) AS pages FROM websites w LEFT JOIN pages p ON w.id = p.website_id GROUP BY 1, 2",
    "top_queries": "SELECT query, count(*) AS searches FROM search_history WHERE query IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "status_histogram": "SELECT CASE WHEN status_code = 200 THEN '200' WHEN status_code = 304 THEN '304' WHEN status_code IN (301, 302) THEN 'redirect' WHEN status_code = 404 THEN '404' WHEN status_code >= 500 THEN '5xx' ELSE 'other' END AS status, count(*) AS fetches FROM pages GROUP BY 1",
    "latency_stats": """WITH s AS (SELECT list_sort(list(value)) AS l, count(*) AS n, avg(value) AS mean FROM events WHERE value IS NOT NULL)
      SELECT round_even(mean, 2) AS mean, round_even(l[1], 2) AS least, round_even(l[n], 2) AS most, round_even((l[((n - 1) // 2 + 1)] + l[(n // 2 + 1)]) / 2, 2) AS median,
        round_even(l[least(floor(n * 0.95)::BIGINT, n - 1) + 1], 2) AS p95, round_even(l[least(floor(n * 0.99)::BIGINT, n - 1) + 1], 2) AS p99, n FROM s""",
    "fetch_averages": "SELECT count(value) AS n, round_even(coalesce(sum(value), 0) / greatest(count(value), 1) * 1000, 2) AS mean FROM events",
    "success_rate": "SELECT n, ok, round_even(ok / greatest(n, 1) * 100, 2) AS success_percent, round_even(m, 2) AS mean_of_successes FROM (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok, avg(value) FILTER (event_type <> 'error') AS m FROM events)",
    "cache_efficiency": "SELECT crawled, skipped, visited, round_even(skipped / (crawled + skipped) * 100, 2) AS hit_percent, greatest(0, visited - (crawled + skipped)) AS dedup_skips FROM (SELECT count(*) FILTER (status_code = 200) AS crawled, count(*) FILTER (status_code = 304) AS skipped, count(DISTINCT url) AS visited FROM pages)",
    "throughput": "SELECT strftime(date_trunc('day', crawl_time AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS pages, round_even(count(*) / 1440.0, 4) AS pages_per_min FROM pages WHERE crawl_time IS NOT NULL GROUP BY 1",
    "set_cardinalities": f"WITH {QUEUE} SELECT (SELECT count(DISTINCT url) FROM pages) AS visited, (SELECT count(*) FROM queue WHERE status = 'pending') AS waiting, (SELECT count(DISTINCT worker) FROM queue) AS workers",
    "suggest": "SELECT DISTINCT suggestion FROM (SELECT * FROM (SELECT word AS suggestion FROM words WHERE word LIKE 'ma%' ORDER BY 1 LIMIT 5) UNION ALL SELECT * FROM (SELECT DISTINCT query FROM search_history WHERE query LIKE 'ma%' ORDER BY 1 LIMIT 5)) ORDER BY 1 LIMIT 8",
    "frontier_pop": f"WITH {QUEUE} SELECT id, url, depth, priority FROM queue WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 100",
    "frontier_dedup": f"WITH {QUEUE}, b AS (SELECT url, max(priority) AS priority FROM queue WHERE url NOT IN (SELECT url FROM queue WHERE status = 'completed') GROUP BY 1) SELECT b.url, min(depth) AS depth, b.priority FROM b JOIN queue USING (url, priority) GROUP BY 1, 3",
    "child_links": rf"WITH l AS ({LINK_ROWS}) SELECT DISTINCT target AS url, (src % 5 + 1)::INT AS depth, greatest(src % 11 - 1, 0)::INT AS priority, lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS domain FROM l WHERE src % 5 + 1 <= 3",
    "crawl_round": f"""WITH l AS ({LINK_ROWS}), c AS (SELECT target AS url, (src % 5 + 1)::INT AS depth, greatest(src % 11 - 1, 0)::INT AS priority FROM l JOIN pages ON id = src WHERE last_checked IS NULL AND src % 5 + 1 <= 3),
      f AS (SELECT * FROM c WHERE url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)), b AS (SELECT url, max(priority) AS priority FROM f GROUP BY 1)
      SELECT url, min(depth) AS depth, priority FROM b JOIN f USING (url, priority) GROUP BY 1, 3""",
    "redirect_targets": r"""SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) || CASE WHEN id % 2 = 1 THEN '/archive/' || id
        ELSE CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') END || 'moved-' || id END AS url,
      (id % 5)::INT AS depth, (id % 11)::INT AS priority FROM pages WHERE status_code IN (301, 302) AND url IS NOT NULL""",
    "query_log_append": "SELECT query, count(*) AS searches FROM search_history GROUP BY 1",
    "snapshot_sink": "SELECT id, url, page_hash FROM pages",
    "postings_sink": f"WITH {postings_cte('pages', 'id', 'content')} SELECT word, count(*) AS df FROM post GROUP BY 1",
    "encoded_texts": "SELECT doc_id, " + ", ".join(f"CASE WHEN ok THEN len(t) - len(replace(t, '{c}', '')) END::DOUBLE AS n_{c}" for c in "aeo") + r" FROM (SELECT doc_id, substr(text, 1, 800) AS t, regexp_matches(substr(text, 1, 800), '[^\s\x0b\x1c-\x1f\x85\p{Z}]') AS ok FROM documents)",
    "crawl_classify": CLASSIFIED,
    "merge_pages": f"""WITH c AS ({CLASSIFIED}) SELECT id, url, page_hash FROM pages WHERE last_checked IS NOT NULL AND url NOT IN (SELECT url FROM c WHERE outcome = 'updated')
      UNION ALL SELECT p.id, p.url, p.page_hash FROM pages p JOIN c ON c.url = p.url WHERE outcome IN ('updated', 'new')""",
    "politeness_schedule": f"WITH {QUEUE}, d AS (SELECT domain, CASE WHEN max(priority) % 3 > 0 THEN (max(priority) % 3)::DOUBLE ELSE 0.2 END AS delay FROM queue GROUP BY 1) SELECT id, domain, round((row_number() OVER (PARTITION BY domain ORDER BY priority DESC, id) - 1) * delay, 3) AS wait_s FROM queue JOIN d USING (domain)",
    "active_workers": f"WITH {QUEUE} SELECT count(*) AS active_workers FROM (SELECT worker, max(ts) AS last FROM queue GROUP BY 1) WHERE last >= (SELECT max(ts) FROM queue) - INTERVAL 15 SECOND",
    "recrawl_queue": "SELECT url, 0 AS depth, 5 AS priority FROM pages WHERE url IS NOT NULL",
    "uncrawled_sites": "SELECT id, domain, 'https://' || domain || '/' AS url FROM websites WHERE id NOT IN (SELECT website_id FROM pages WHERE website_id IS NOT NULL)",
    "restart_recovery": f"WITH {QUEUE}, o AS (SELECT url, depth, priority FROM queue WHERE status IN ('pending', 'crawling') UNION ALL SELECT 'https://' || domain || '/', 0, 10 FROM websites WHERE id NOT IN (SELECT website_id FROM pages WHERE website_id IS NOT NULL)), b AS (SELECT url, max(priority) AS priority FROM o WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM queue WHERE status = 'completed') GROUP BY 1) SELECT b.url, min(depth) AS depth, b.priority FROM b JOIN o USING (url, priority) GROUP BY 1, 3",
    "delete_seed_cascade": f"""WITH {QUEUE}, g AS (SELECT p.id FROM pages p JOIN websites w ON w.id = website_id WHERE domain = 'velmora-courier.example')
      SELECT 'queue' AS name, count(*) AS rows FROM queue UNION ALL SELECT 'websites', count(*) FROM websites WHERE coalesce(domain <> 'velmora-courier.example', true)
      UNION ALL SELECT 'pages', count(*) FROM pages WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'links', count(*) FROM links WHERE coalesce(source_page NOT IN (SELECT id FROM g), true) AND coalesce(destination_page NOT IN (SELECT id FROM g), true)
      UNION ALL SELECT 'inverted_index', count(*) FROM inverted_index WHERE page_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'page_embeddings', count(*) FROM page_embeddings WHERE page_id NOT IN (SELECT id FROM g)""",
    "reindex_merge": f"""WITH {postings_cte("pages", "id", "title")}, old AS (SELECT page_id, word, tf FROM post),
      {token_cte("tok2", "(SELECT id, content FROM pages WHERE last_checked IS NOT NULL)", "id", "content")}, tot2 AS (SELECT id, count(*) AS t FROM tok2 GROUP BY 1),
      fresh AS (SELECT id AS page_id, word, count(*) / any_value(t) AS tf FROM tok2 JOIN tot2 USING (id) GROUP BY 1, 2)
      SELECT page_id, word, round(tf, 12) AS tf FROM old WHERE page_id NOT IN (SELECT page_id FROM fresh) UNION ALL SELECT page_id, word, round(tf, 12) FROM fresh""",
    "dictionary_upsert": f"""WITH {postings_cte("pages", "id", "content")}, m AS (SELECT max(id) AS m FROM words), new AS (SELECT DISTINCT word FROM post WHERE word NOT IN (SELECT word FROM words))
      SELECT id, word FROM words UNION ALL SELECT m + row_number() OVER (ORDER BY word), word FROM new, m""",
    "embedding_upsert": "WITH n AS (SELECT DISTINCT page_id, model_name, embedding FROM page_embeddings WHERE model_name LIKE 'mini%' AND page_id IS NOT NULL) SELECT page_id, model_name, embedding FROM n UNION ALL SELECT DISTINCT page_id, model_name, embedding FROM page_embeddings WHERE model_name NOT LIKE 'mini%' AND page_id NOT IN (SELECT page_id FROM n)",
    "queue_status_update": f"WITH {QUEUE}, p AS (SELECT id FROM queue WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 100) SELECT id, CASE WHEN id IN (SELECT id FROM p) THEN 'crawling' ELSE status END AS status FROM queue",
    "point_lookup": "SELECT id, url, title FROM pages WHERE id = 1",
    "batch_lookup": "SELECT w.word, count(*) AS postings FROM words w JOIN inverted_index i ON i.word_id = w.id WHERE w.word IN ('museum', 'market', 'tunnel', 'velmora') GROUP BY 1",
    "queue_flush": "SELECT count(DISTINCT domain) AS pending, 0::BIGINT AS crawling, 0::BIGINT AS completed, 0::BIGINT AS failed, count(DISTINCT domain) AS total, 0.0::DOUBLE AS progress FROM websites WHERE domain IS NOT NULL",
    "page_source_replay": "SELECT url, status_code, NULL::VARCHAR AS location, etag, last_modified, CASE WHEN status_code = 200 THEN length(html)::INT END AS n_chars, NULL::VARCHAR AS error FROM pages",
    "task_json": f"WITH {QUEUE} SELECT id, url, depth, priority FROM queue",
    "stream_dedup": f"WITH {QUEUE} SELECT DISTINCT url FROM queue",
    "robots_allowed": r"""SELECT url, NOT (coalesce(f, false) AND starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/archive/')) AS allowed, CASE WHEN f AND delay > 0 THEN delay::DOUBLE ELSE 0.2 END AS delay
      FROM (SELECT url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS domain FROM pages WHERE url IS NOT NULL)
      LEFT JOIN (SELECT domain, true AS f, max(coalesce(crawl_delay, 0)) AS delay FROM websites WHERE robots_checked GROUP BY 1) USING (domain)""",
    "stream_heartbeats": f"WITH {QUEUE} SELECT time_bucket(INTERVAL 15 SECOND, ts::TIMESTAMP)::TIMESTAMPTZ AS start, count(DISTINCT worker) AS active_workers FROM queue WHERE ts IS NOT NULL GROUP BY 1",
    "stream_polite": f"""WITH {QUEUE}, o AS (SELECT domain, url, epoch_us(ts::TIMESTAMP) AS t, row_number() OVER (PARTITION BY domain ORDER BY ts, url) AS i FROM queue WHERE ts IS NOT NULL)
      SELECT domain, url, make_timestamp(i * 1000000 + max(t - i * 1000000) OVER (PARTITION BY domain ORDER BY i))::TIMESTAMPTZ AS fetch_at FROM o""",
    "stream_query_days": "SELECT date_trunc('day', searched_at)::TIMESTAMPTZ AS start, query, count(*) AS searches FROM search_history GROUP BY 1, 2",
    "stream_query_counts": "SELECT query, count(*) AS searches FROM search_history GROUP BY 1",
}

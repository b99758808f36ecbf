"""The catalogue's queries as SQL over the same tables, written independently of the plans."""

from __future__ import annotations

from lantern.plans.porter_sql import stems

# Fixed values, stated here again so that a wrong list of the engine's does not pass: words that open a question, words without
# content, capitalised words that do not make a name.
QUESTION_WORDS = "what which when where why how who whom whose is are was were does do did can could should would will has have had list find".split()
STOP_WORDS = (
    "a an the of to in on for and or but is are was were be been do does did what which when where why how who whom whose with from by at as that "
    "this it its we our i my you your they their he she have has had not no can could should would will there than then into about after before over under"
).split()
NAME_STOP = "What Which When Where Why How Who Does Did Is Was The In On For After Before At A An January February March April May June July August September October November December I My We Our".split()


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


W = r"\p{L}\p{N}_"

_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


def plain(text: str) -> str:
    return _WORDS.format(text)


def question(text: str) -> str:
    t = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    w = plain(t)
    return f"(ends_with({t}, '?') OR (len({w}) >= 4 AND coalesce(lower({w}[1]) IN {_in(QUESTION_WORDS)}, false)))"


def content(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_-]*'), lambda w: length(w) > 1 AND w NOT IN {_in(STOP_WORDS)})"


def chunks(text: str) -> str:
    w = plain(text)
    return f"list_transform(range(0, greatest(ceil(len({w}) / 350.0)::BIGINT, 1)), lambda i: array_to_string(list_slice({w}, i * 350 + 1, i * 350 + 350), ' '))"


RARE = rf"""list_sort(list_distinct(list_concat(
  list_filter(regexp_extract_all(q, '[A-Za-z0-9][{W}./-]*[{W}]'), lambda w:
    (length(w) > 3 OR (length(w) = 3 AND upper(w) = w AND lower(w) <> w)) AND
    (regexp_matches(w, '[-_/.]') OR regexp_matches(w, '[a-z][A-Z]') OR (upper(w) = w AND lower(w) <> w) OR (regexp_matches(w, '\p{{Nd}}') AND regexp_matches(w, '[A-Za-z]')))),
  list_concat(
    list_transform(list_filter(list_transform(regexp_extract_all(q, '(?:^|[^{W}])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?:[^{W}]|$)', 1),
      lambda p: list_filter(string_split_regex(p, '\s+'), lambda w: w NOT IN {_in(NAME_STOP)})), lambda ws: len(ws) >= 2), lambda ws: array_to_string(ws, ' ')),
    regexp_extract_all(q, '["`'']([^"`'']{{4,60}})["`'']', 1)))))"""

#: Common table expressions in their order; a query gets those it needs.
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(needs: list[str], final: str) -> str:
    wanted, todo = set(), list(needs)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += CTES[n][0]
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in CTES if n in wanted]
    return "WITH " + ",\n".join(parts) + "\n" + final


cte("docs", [], "SELECT 'doc/' || doc_id || '.md' AS path, doc_id::VARCHAR AS title, coalesce(text, '') AS body, doc_id, source FROM documents")
cte("asked", [], "SELECT item_id AS query_id, text AS q FROM benchmark")
cte(
    "questions",
    [],
    rf"""SELECT item_id AS query_id, coalesce((CASE WHEN item_id % 3 = 2 THEN 'mention of' ELSE 'Where is' END) || ' "' || array_to_string(list_slice({plain("text")}, 2, 4), ' ') || '" stated with '
     || upper({plain("text")}[6]) || ' ' || array_to_string(list_slice({plain("text")}, 7, 14), ' ') || ' and ' || upper({plain("text")}[10]) || (CASE WHEN item_id % 3 = 2 THEN '' ELSE '?' END), '') AS q FROM benchmark""",
)
cte(
    "longest_words",
    [],
    r"""SELECT item_id AS query_id, coalesce(array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g'))),
     lambda x: {'n': -length(x), 'w': x})), 1, 3), lambda x: x.w), ' '), '') AS q FROM benchmark""",
)
cte("posted", ["docs"], r"""SELECT term, path, sum(t)::BIGINT AS tf_title, sum(b)::BIGINT AS tf_body FROM (
  SELECT path, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS term, 1 AS t, 0 AS b FROM docs
  UNION ALL SELECT path, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')), 0, 1 FROM docs) GROUP BY ALL""")
cte("sizes", ["docs", "posted"], "SELECT d.path, coalesce(s.dl, 0) AS dl FROM docs d LEFT JOIN (SELECT path, sum(tf_title + tf_body) AS dl FROM posted GROUP BY path) s USING (path)")


TOKENS = "unnest(list_filter(regexp_extract_all(q, '[A-Za-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('AND', 'OR', 'NOT', 'NEAR')))"

# the stemmed index: whole words without marks, then their stems
cte("plain_words", ["docs"], r"""SELECT unnest(regexp_extract_all(strip_accents(lower(title)), '[\p{L}\p{N}]+')) AS term, path, 1 AS t, 0 AS b FROM docs
  UNION ALL SELECT unnest(regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+')), path, 0, 1 FROM docs""")
cte("stemmed", ["plain_words", "asked", "questions", "longest_words"], stems(f"SELECT term FROM plain_words UNION SELECT lower(t) FROM (SELECT {TOKENS} AS t FROM (SELECT q FROM asked UNION ALL SELECT q FROM questions UNION ALL SELECT q FROM longest_words))"))
cte("stem_posted", ["plain_words", "stemmed"], "SELECT coalesce(s.stem, w.term) AS term, path, sum(t)::BIGINT AS tf_title, sum(b)::BIGINT AS tf_body FROM plain_words w LEFT JOIN stemmed s ON s.term = w.term GROUP BY ALL")


def bm25(name: str, source: str, plain: bool = False) -> None:
    """Over the stemmed index, or over whole words."""
    posted = "posted" if plain else "stem_posted"
    asked = f"SELECT query_id, lower(t) AS term FROM (SELECT query_id, {TOKENS} AS t FROM {source})"
    if not plain:
        asked = f"SELECT query_id, coalesce(s.stem, a.term) AS term FROM ({asked}) a LEFT JOIN stemmed s ON s.term = a.term"
    cte(f"{name}_terms", [source, *([] if plain else ["stemmed"])], f"SELECT query_id, term, count(*) AS times FROM ({asked}) GROUP BY ALL")
    cte(f"{name}_bm25", [f"{name}_terms", posted, "sizes"], f"""SELECT query_id, path, sum(times * idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM (
      SELECT p.path, p.term, 5.0::DOUBLE * tf_title + 1.0::DOUBLE * tf_body AS f, dl, avgdl, CASE WHEN ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END AS idf
      FROM {posted} p JOIN (SELECT term, count(*) AS n FROM {posted} GROUP BY term) USING (term) JOIN sizes USING (path) CROSS JOIN (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM sizes)
      WHERE p.term IN (SELECT term FROM {name}_terms)) x JOIN {name}_terms t USING (term) GROUP BY query_id, path""")
    cte(f"{name}_words", [f"{name}_bm25"], f"SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM {name}_bm25")


def hashed(name: str, needs: list[str], source: str) -> None:
    """Dense unit vectors of source's (key, text)."""
    cte(f"{name}_sums", needs, rf"SELECT key, ('0x' || right(md5(token), 4))::INT % 64 AS bucket, sum(CASE WHEN (('0x' || right(md5(token), 4))::INT // 256) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[{W}]+')) AS token FROM ({source})) GROUP BY ALL")
    cte(f"{name}_vec", [*needs, f"{name}_sums"], f"""SELECT key, list(x ORDER BY b) AS v FROM (SELECT k.key, b, coalesce(s.v, 0.0::DOUBLE) / (CASE WHEN n.n > 0 THEN n.n ELSE 1.0::DOUBLE END) AS x
      FROM (SELECT DISTINCT key FROM ({source})) k CROSS JOIN (SELECT unnest(range(64)) AS b) LEFT JOIN {name}_sums s ON s.key = k.key AND s.bucket = b
      LEFT JOIN (SELECT key, sqrt(sum(v * v)) AS n FROM {name}_sums GROUP BY key) n ON n.key = k.key) GROUP BY key""")


cte("chunk_rows", ["docs"], f"SELECT path, title, ord, c[ord + 1] AS chunk FROM (SELECT path, title, {chunks('body')} AS c FROM docs), unnest(range(len(c))) t(ord)")
hashed("chunk", ["chunk_rows"], r"SELECT {'path': path, 'ord': ord} AS key, title || E'\n' || chunk AS text FROM chunk_rows")
cte("doc_vec", ["chunk_vec"], """SELECT path, list(x / (CASE WHEN n > 0 THEN n ELSE 1 END) ORDER BY b) AS v FROM (SELECT path, b, x, sqrt(sum(x * x) OVER (PARTITION BY path)) AS n FROM (
  SELECT key.path AS path, b, avg(v[b]) AS x FROM chunk_vec, unnest(range(1, 65)) t(b) GROUP BY ALL)) GROUP BY path""")
cte("section_rows", ["docs", "chunk_rows"], f"SELECT c.path, c.title, c.ord, c.chunk FROM chunk_rows c JOIN (SELECT path FROM docs WHERE len({plain('body')}) > 350) USING (path)")
hashed("section", ["section_rows"], r"SELECT {'path': path, 'ord': ord} AS key, title || ' > ' || E'\n' || chunk AS text FROM section_rows")


def hybrid(name: str, source: str, k: int, base: str | None = None) -> None:
    """Fused ranking of source for k; base: a ranking of the same source whose shared parts are used again."""
    b = base or name
    if base is None:
        bm25(name, source)
        hashed(f"{name}_q", [source], f"SELECT query_id AS key, q AS text FROM {source}")
        cte(f"{name}_near_docs", [f"{name}_q_vec", "doc_vec"], f"SELECT q.key AS query_id, d.path, list_distance(q.v, d.v) AS score FROM {name}_q_vec q, doc_vec d")
        cte(f"{name}_near_sections", [f"{name}_q_vec", "section_vec"], f"SELECT q.key AS query_id, s.key.path AS path, s.key.ord AS ord, list_distance(q.v, s.v) AS score FROM {name}_q_vec q, section_vec s")
    pool, sections = max(k, 50), max(k, 400)
    cte(f"{name}_leg", [f"{b}_near_docs", f"{b}_near_sections", "section_rows"], f"""SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), path) AS rank FROM (SELECT query_id, path, min(score) AS score FROM (
      SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), path) AS r FROM {b}_near_docs) WHERE r <= {pool} AND path NOT IN (SELECT path FROM section_rows)
      UNION ALL SELECT query_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), path, ord) AS r FROM {b}_near_sections) WHERE r <= {sections}) GROUP BY query_id, path)
      QUALIFY rank <= {pool}""")
    cte(f"{name}_hybrid", [f"{name}_leg", f"{b}_words"], f"""SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r0 NULLS LAST, r1 NULLS LAST) AS rank FROM (
      SELECT query_id, path, sum(part) AS score, min(r0) AS r0, min(r1) AS r1 FROM (SELECT query_id, path, 1.0::DOUBLE / (60 + rank) AS part, rank AS r0, NULL::BIGINT AS r1 FROM {name}_leg
      UNION ALL SELECT query_id, path, 0.5::DOUBLE / (60 + rank), NULL, rank FROM {b}_words WHERE rank <= {pool}) GROUP BY query_id, path) QUALIFY rank <= {k}""")


cte("named", ["asked"], "SELECT query_id, q || ' ' || (query_id * 10 + 11) || ' ' || (query_id * 10 + 11) AS q FROM asked")
bm25("n", "named")
bm25("u", "asked", plain=True)
bm25("r", "longest_words")
hybrid("a", "asked", 10)
hybrid("a20", "asked", 20, "a")
hybrid("q20", "questions", 20)
hybrid("q150", "questions", 150, "q20")

cte("rare_asked", ["questions"], f"SELECT query_id, unnest({RARE}) AS term FROM questions")
cte("rare_found", ["rare_asked", "docs"], "SELECT term, path FROM (SELECT DISTINCT term FROM rare_asked) t JOIN docs d ON contains(lower(d.body), lower(t.term))")
cte("rare_df", ["rare_found"], "SELECT term, count(*) AS df FROM rare_found GROUP BY term")


def rare_scores(gate: int, name: str) -> None:
    cte(f"{name}_pairs", ["rare_asked", "rare_found", "rare_df"], f"""SELECT query_id, term1, term2, path, 0.5::DOUBLE / df AS part FROM (SELECT *, count(*) OVER (PARTITION BY query_id, term1, term2) AS df FROM (
      SELECT a.query_id, a.term AS term1, b.term AS term2, x.path FROM rare_asked a JOIN rare_asked b ON a.query_id = b.query_id AND a.term < b.term
      JOIN rare_df da ON da.term = a.term AND da.df > {gate} JOIN rare_df db ON db.term = b.term AND db.df > {gate}
      JOIN rare_found x ON x.term = a.term JOIN rare_found y ON y.term = b.term AND y.path = x.path)) WHERE df <= {gate}""")


rare_scores(12, "r12")
cte("rare_ranked", ["rare_asked", "rare_found", "rare_df", "r12_pairs"], """SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM (SELECT query_id, path, sum(part) AS score FROM (
  SELECT query_id, path, 1.0::DOUBLE / df AS part FROM rare_asked JOIN rare_df USING (term) JOIN rare_found USING (term) WHERE df <= 12 UNION ALL SELECT query_id, path, part FROM r12_pairs) GROUP BY query_id, path)""")
cte("pool", ["q20_hybrid", "rare_ranked"], """SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank) AS pos FROM (SELECT query_id, path, leg, rank, row_number() OVER (PARTITION BY query_id, path ORDER BY leg, rank) AS f FROM (
  SELECT query_id, path, 0 AS leg, rank FROM q20_hybrid UNION ALL SELECT query_id, path, 1, rank FROM rare_ranked)) WHERE f = 1""")

# units of 350 words, packed into windows of at most size words; a last, shorter unit joins the window before it if it fits
cte("window_units", ["docs"], rf"""SELECT path, uord, total, CASE WHEN total <= 350 THEN regexp_replace(body, '^\s+|\s+$', '', 'g') ELSE array_to_string(list_slice(w, uord * 350 + 1, uord * 350 + 350), ' ') END AS text,
  CASE WHEN uord < full_units OR full_units = 0 THEN uord // m WHEN full_units % m <> 0 THEN uord // m WHEN m * 350 + rest <= size THEN uord // m - 1 ELSE uord // m END AS ord
  FROM (SELECT path, body, w, total, total // 350 AS full_units, total % 350 AS rest, greatest(600, total // 24 + 1) AS size, greatest(600, total // 24 + 1) // 350 AS m FROM (SELECT path, body, {plain('body')} AS w, len({plain('body')}) AS total FROM docs)),
  unnest(range(0, greatest(ceil(total / 350.0)::BIGINT, 1))) t(uord)""")
cte("windows", ["window_units"], r"SELECT path, ord, string_agg(text, E'\n\n' ORDER BY uord) AS text FROM window_units GROUP BY path, ord")
cte("window_terms", ["windows"], f"SELECT DISTINCT path, ord, unnest({content('text')}) AS word FROM windows")
cte("question_terms", ["questions"], f"SELECT DISTINCT query_id, unnest({content('q')}) AS word FROM questions")


def lexical(name: str, pool: str) -> None:
    cte(f"{name}_hits", [pool, "question_terms", "window_terms"], f"SELECT p.query_id, p.path, t.ord, t.word FROM {pool} p JOIN question_terms a USING (query_id) JOIN window_terms t ON t.path = p.path AND t.word = a.word")
    cte(f"{name}_idf", [pool, f"{name}_hits", "windows"], f"SELECT query_id, word, ln(1 + n / df::DOUBLE) AS idf FROM (SELECT query_id, word, count(*) AS df FROM {name}_hits GROUP BY ALL) JOIN (SELECT query_id, count(*) AS n FROM {pool} JOIN windows USING (path) GROUP BY query_id) USING (query_id)")
    cte(f"{name}_scored", [pool, f"{name}_hits", f"{name}_idf", "windows"], f"""SELECT p.query_id, p.path, w.ord, coalesce(raw, 0) AS raw, coalesce(raw / most, 0) AS score FROM {pool} p JOIN windows w USING (path)
      LEFT JOIN (SELECT query_id, path, ord, sum(idf) AS raw FROM {name}_hits JOIN {name}_idf USING (query_id, word) GROUP BY ALL) r ON r.query_id = p.query_id AND r.path = p.path AND r.ord = w.ord
      LEFT JOIN (SELECT query_id, sum(idf) AS most FROM {name}_idf GROUP BY ALL) m ON m.query_id = p.query_id""")
    cte(f"{name}_best", [f"{name}_scored"], f"SELECT query_id, path, CASE WHEN score > 0 THEN ord END AS ord, score FROM (SELECT query_id, path, ord, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id, path ORDER BY round(score, 9) DESC, ord) AS r FROM {name}_scored) WHERE r = 1")


lexical("s", "pool")
cte("gated", ["questions"], f"SELECT query_id, q, {question('q')} AS asks FROM questions")
cte("wider", ["pool", "q150_hybrid", "s_best", "gated"], """SELECT h.query_id, h.path, n + h.rank AS pos FROM q150_hybrid h JOIN (SELECT query_id, max(pos) AS n FROM pool GROUP BY query_id) USING (query_id)
  JOIN gated g ON g.query_id = h.query_id AND asks JOIN (SELECT query_id FROM s_best GROUP BY query_id HAVING max(score) < 0.5) u ON u.query_id = h.query_id WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = h.query_id AND p.path = h.path)""")
lexical("w", "wider")
cte("recalled", ["pool", "wider", "s_best", "w_best", "gated"], """SELECT query_id, path, 'rerank:lexical' AS mode, score, ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM (
  SELECT p.query_id, p.path, p.pos, coalesce(b.score, 0) AS score, b.ord FROM (SELECT * FROM pool UNION ALL SELECT * FROM wider) p LEFT JOIN (SELECT * FROM s_best UNION ALL SELECT * FROM w_best) b USING (query_id, path) JOIN gated g ON g.query_id = p.query_id AND asks)
  UNION ALL SELECT p.query_id, path, 'keyword', NULL, NULL, pos FROM pool p JOIN gated g ON g.query_id = p.query_id AND NOT asks""")
cte("gold", ["asked", "docs"], "SELECT DISTINCT a.query_id, d.path FROM asked a JOIN docs d ON length(a.q) > 0 AND contains(lower(d.body), lower(a.q))")
cte("any_all", ["gold", "a_hybrid"], """SELECT query_id, bool_or(coalesce(rank <= 1, false)) AS any_1, bool_or(coalesce(rank <= 5, false)) AS any_5, bool_and(coalesce(rank <= 5, false)) AS all_5, bool_and(coalesce(rank <= 10, false)) AS all_10
  FROM gold LEFT JOIN a_hybrid USING (query_id, path) GROUP BY query_id""")
cte("spend", [], """SELECT event_id, ts, abs(value) / 1000 AS usd, floor(abs(value))::BIGINT AS tokens, CASE WHEN event_type = 'view' THEN 'eval' ELSE 'live' END AS caller, CASE WHEN user_id % 4 <> 0 THEN user_id::VARCHAR END AS session FROM events""")
cte("replayed", ["spend"], """SELECT *, CASE WHEN usd6 <= 0 THEN 'ok' WHEN usd6 > 0.15 THEN 'per query' WHEN day6 + usd6 > 9.0 THEN 'daily cap' WHEN caller = 'live' AND session IS NOT NULL AND session6 + usd6 > 9.0 * 0.02 THEN 'session share' ELSE 'ok' END AS verdict FROM (
  SELECT *, round(usd, 6) AS usd6, round(day, 6) AS day6, round(session_day, 6) AS session6 FROM (SELECT *,
  sum(usd) OVER (PARTITION BY caller ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - usd AS day, sum(usd) OVER (PARTITION BY caller, session ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - usd AS session_day FROM spend))""")
cte("hashes", ["docs"], "SELECT path, doc_id, left(sha256(body), 16) AS hash FROM docs")
cte("known", ["hashes"], "SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE hash END AS hash, doc_id % 5 <> 0 AS embedded FROM hashes WHERE doc_id % 11 <> 0 UNION ALL SELECT 'gone/' || path, hash, true FROM hashes WHERE doc_id % 13 = 0")
cte("diff", ["hashes", "known"], "SELECT path, CASE WHEN f.hash IS NULL THEN 'gone' WHEN k.hash IS NULL THEN 'new' WHEN k.embedded AND k.hash = f.hash THEN 'same' ELSE 'changed' END AS status FROM hashes f FULL JOIN known k USING (path)")
cte("vecs", [], "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings")
cte("near", ["vecs"], "SELECT q.vec_id AS query_id, e.vec_id, e.label, list_distance(q.v, e.v) AS d FROM vecs q JOIN vecs e ON q.vec_id % 100 = 0")
cte("typed", [], "SELECT o_orderkey::VARCHAR || (CASE WHEN o_orderkey % 10 = 0 THEN '_abs' ELSE '' END) AS question_id, o_orderpriority AS kind FROM orders")
cte("kept_types", ["typed"], "SELECT kind, count(*) AS c, sum(count(*)) OVER () AS total FROM typed WHERE question_id NOT LIKE '%\\_abs' ESCAPE '\\' GROUP BY kind")


def shown(page: str) -> str:
    """The text of a page whose tags are closed, without nested elements that are not shown and with four entities at most."""
    rest = r"""(?:[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*)?>"""
    x = rf"regexp_replace({page}, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g')"
    for name in ("head", "noscript", "template", "svg", "style", "script"):
        x = rf"regexp_replace({x}, '(?is)<{name}{rest}.*?</{name}\s*>', '', 'g')"
    for level in "123456":
        x = f"regexp_replace({x}, '(?i)<h{level}{rest}', E'\\n\\n{'#' * int(level)} ', 'g')"
    lines = "p|div|section|article|li|tr|br|table|ul|ol|pre|blockquote|header|footer|main|nav|aside"
    x = rf"regexp_replace({x}, '(?i)</?(?:{lines}){rest}|</h[1-6]>', E'\n', 'g')"
    x = rf"regexp_replace({x}, '</?[a-zA-Z][a-zA-Z0-9]*{rest}', '', 'g')"
    x = entities(x)
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', E'\n\n', 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def entities(x: str) -> str:
    for name, to in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{to}')"
    return x


cte("page_text", [], rf"""SELECT page_id, {entities(r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))")} AS title, {shown("html")} AS text FROM pages""")
cte("ranked_parts", [], """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line, path) AS b, row_number() OVER (PARTITION BY query_id ORDER BY quantity DESC, path) AS r FROM (
  SELECT l_orderkey AS query_id, l_partkey AS path, min(l_linenumber) AS line, max(l_quantity) AS quantity, bool_or(l_returnflag = 'R') AS gold FROM lineitem GROUP BY ALL)""")
cte("part_scores", ["ranked_parts"], """SELECT query_id, min(b) FILTER (gold) AS b, min(r) FILTER (gold) AS r, max(b) FILTER (gold) AS all_b, max(r) FILTER (gold) AS all_r FROM ranked_parts GROUP BY query_id""")
# rounded shares, then one unit of a kind at a time comes or goes: recursively, as said
cte("drawn_kinds", ["kept_types"], """WITH RECURSIVE q AS (
  SELECT 0 AS step, list({'kind': kind, 'size': c, 'n': greatest(1, round_even(100.0::DOUBLE * c / total, 0))::BIGINT} ORDER BY kind) AS l FROM kept_types
  UNION ALL SELECT step + 1, list_transform(l, lambda x, i: CASE WHEN i = slot THEN {'kind': x.kind, 'size': x.size, 'n': x.n + sign(gap)::BIGINT} ELSE x END) FROM (
    SELECT step, l, 100 - list_sum(list_transform(l, lambda x: x.n)) AS gap, list_position(list_transform(l, lambda x: CASE WHEN list_sum(list_transform(l, lambda y: y.n)) > 100 THEN x.n ELSE x.size - x.n END), list_max(list_transform(l, lambda x: CASE WHEN list_sum(list_transform(l, lambda y: y.n)) > 100 THEN x.n ELSE x.size - x.n END))) AS slot FROM q) WHERE gap <> 0)
  SELECT x.kind AS kind, x.n AS quota FROM (SELECT unnest((SELECT l FROM q ORDER BY step DESC LIMIT 1)) AS x)""")

NOTE = "(CASE WHEN c_custkey % 3 = 2 THEN '' ELSE {0} END)"

QUERIES: dict[str, tuple[list[str], str]] = {
    "fts_query_string": (["asked"], """SELECT query_id, array_to_string(list_transform(list_filter(regexp_extract_all(q, '[A-Za-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('AND', 'OR', 'NOT', 'NEAR')), lambda t: '"' || t || '"'), ' OR ') AS fts FROM asked"""),
    "question_gate": ([], f"SELECT conv_id, turn, role, {question("coalesce(text, '')")} AS plain, {question("'which ' || coalesce(text, '')")} AS led, {question("coalesce(text, '') || '? '")} AS marked FROM conversations"),
    "rare_terms": (["questions"], f"SELECT query_id, array_to_string({RARE}, '|') AS terms FROM questions"),
    "content_words": ([], f"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {content("coalesce(text, '')")} AS w FROM documents)"),
    "content_hash": (["hashes"], "SELECT doc_id, hash FROM hashes"),
    "blind_names": ([], "SELECT conv_id, turn, 's' || left(sha256(conv_id || ':' || turn), 10) AS name FROM conversations"),
    "glob_exclude": ([], "SELECT doc_id, path, regexp_full_match(path, 'src1.*/.*') OR regexp_full_match(path, '.*/4.\\.md') OR regexp_full_match(path, '.*/x/.*') AS excluded FROM (SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.md' AS path FROM documents)"),
    "frontmatter_body": ([], f"SELECT c_custkey, {NOTE.format('c_name')} AS title, {NOTE.format('c_mktsegment')} AS segment, 'Customer of nation ' || c_nationkey || E'\\n# Head ' || c_custkey || E'\\nend' AS body FROM customer"),
    "doc_title": ([], "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN trim(p_name) ELSE 'part.' || p_partkey END AS title FROM part"),
    "fixed_chunks": (["docs"], f"SELECT doc_id, ord, len({plain('c[ord + 1]')}) AS n_words, md5(c[ord + 1]) AS chunk_md5 FROM (SELECT doc_id, {chunks('body')} AS c FROM docs), unnest(range(len(c))) t(ord)"),
    "embed_texts": (["docs"], rf"SELECT doc_id, ord, md5(t[ord + 1]) AS text_md5 FROM (SELECT doc_id, list_concat(list_transform({chunks('body')}, lambda c: title || E'\n' || c), CASE WHEN doc_id % 5 = 0 AND trim(coalesce(' from ' || source, '')) <> '' THEN [title || E'\n' || trim(' from ' || source)] ELSE [] END) AS t FROM docs), unnest(range(len(t))) x(ord)"),
    "eg2_prompts": ([], r"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'title: Item ' || item_id || ' | text: ' || text ELSE 'title: none | text: ' || replace(text, E'\n', ' ') END AS doc_prompt, 'task: search result | query: ' || text AS query_prompt FROM benchmark"),
    "html_title": ([], r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages"),
    "html_text": (["page_text"], r"SELECT page_id, CASE WHEN title <> '' AND NOT starts_with(text, '# ') THEN '# ' || title || E'\n\n' || text ELSE text END AS text FROM page_text"),
    "eval_totals": (["part_scores"], """SELECT count(*) AS n, count(*) FILTER (b = 1) AS base_1, count(*) FILTER (b <= 3) AS base_top, count(*) FILTER (r = 1) AS recall_1, count(*) FILTER (r <= 3) AS recall_top, round(sum(o_orderkey % 7 / 1000), 4) AS usd, round(avg(o_orderkey % 11 / 4), 2) AS mean_secs
      FROM orders LEFT JOIN part_scores ON query_id = o_orderkey"""),
    "benchmark_summary": (["part_scores"], """SELECT coalesce(o_orderpriority, 'all') AS kind, count(*) AS n, count(*) FILTER (b <= 1) AS search_any_1, count(*) FILTER (b <= 5) AS search_any_5, count(*) FILTER (all_b <= 5) AS search_all_5, count(*) FILTER (all_b <= 10) AS search_all_10,
      count(*) FILTER (r <= 1) AS recall_any_1, count(*) FILTER (r <= 5) AS recall_any_5, count(*) FILTER (all_r <= 5) AS recall_all_5, count(*) FILTER (all_r <= 10) AS recall_all_10, count(*) FILTER (query_id % 4 = 0) AS widened, count(*) FILTER (query_id % 9 = 0) AS fail_open,
      round(sum(query_id % 7 / 1000), 4) AS usd, round(sum(query_id % 7 / 1000) / count(*), 5) AS usd_per_question, sum(query_id % 500)::BIGINT AS tokens, round(avg(query_id % 11 / 4), 1) AS mean_secs FROM part_scores JOIN orders ON o_orderkey = query_id WHERE b IS NOT NULL GROUP BY ROLLUP (o_orderpriority)"""),
    "stratified_sample": (["drawn_kinds", "typed"], "SELECT question_id, kind FROM (SELECT question_id, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256('0:' || question_id), question_id) AS place FROM typed WHERE question_id NOT LIKE '%\\_abs' ESCAPE '\\') JOIN drawn_kinds USING (kind) WHERE place <= quota"),
    "openai_p_yes": ([], "SELECT l_orderkey, l_linenumber, round(CASE l_linenumber WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 ELSE exp(-l_discount) / (exp(-l_discount) + exp(-l_tax)) END, 6) AS p_yes FROM lineitem"),
    "section_units": ([], r"""WITH n AS (SELECT r_regionkey, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS i, len(string_split(r_name, ' ')) AS rw, len(string_split(n_name, ' ')) AS nw FROM nation JOIN region ON n_regionkey = r_regionkey),
      p AS (SELECT *, 1 + rw + coalesce(sum(1 + nw + 2 + 1 + 3 + 1 + 3 + 8) OVER (PARTITION BY r_regionkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM n),
      u AS (SELECT DISTINCT r_regionkey, -1 AS i, 0 AS j, r_name AS hpath, 0 AS start_word, '# ' || r_name AS text FROM n
       UNION ALL SELECT r_regionkey, i, 0, r_name || ' > ' || n_name, pos, array_to_string(list_slice(string_split('## ' || n_name || ' key ' || n_nationkey || ' ``` # no heading ```', ' '), 1, 6), ' ') FROM p
       UNION ALL SELECT r_regionkey, i, 1, r_name || ' > ' || n_name, pos + 6, array_to_string(list_slice(string_split('## ' || n_name || ' key ' || n_nationkey || ' ``` # no heading ```', ' '), 7, 12), ' ') FROM p
       UNION ALL SELECT r_regionkey, i, 2, r_name || ' > ' || n_name || ' > Deep', pos + 1 + nw + 7, '### Deep ## one two three' FROM p
       UNION ALL SELECT r_regionkey, i, 3, r_name || ' > ' || n_name || ' > Deep', pos + 1 + nw + 13, 'four five six seven eight' FROM p)
      SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY i, j) - 1 AS ord, hpath, start_word::INT AS start_word, text FROM u"""),
    "long_docs": (["docs"], f"SELECT path, len({plain('body')}) AS words FROM docs WHERE len({plain('body')}) > 350"),
    "window_bounds": (["windows"], f"SELECT path, ord, len({plain('text')}) AS n_words, length(text) AS n_chars FROM windows"),
    "session_markdown": ([], r"SELECT conv_id, '# Session ' || conv_id || E'\n\nDate: 2024-01-01\n\n' || string_agg('**' || role || ':** ' || coalesce(text, ''), E'\n\n' ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id"),
    "hash_embedding": ([], rf"""WITH s AS (SELECT doc_id, ('0x' || right(md5(token), 4))::INT % 64 AS bucket, sum(CASE WHEN (('0x' || right(md5(token), 4))::INT // 256) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[{W}]+')) AS token FROM documents) GROUP BY ALL)
      SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s WHERE v <> 0"""),
    "mean_vector": (["vecs"], "SELECT label, \"at\", round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, i - 1 AS \"at\", avg(v[i]) AS x FROM vecs, unnest(range(1, 65)) t(i) GROUP BY ALL)"),
    "normalize_vector": (["vecs"], "SELECT vec_id, i - 1 AS \"at\", round(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))) END, 6) AS x FROM vecs, unnest(range(1, 65)) t(i)"),
    "matryoshka_cut": (["vecs"], "SELECT vec_id, i - 1 AS \"at\", round(v[i] / sqrt(list_sum(list_transform(v[1:16], lambda x: x * x))), 6) AS x FROM vecs, unnest(range(1, 17)) t(i)"),
    "knn_exact": (["near"], "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank, vec_id, round(d, 6) AS distance FROM near QUALIFY rank <= 50"),
    "best_section": (["near"], "SELECT query_id, label, round(min(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), label, vec_id) AS r FROM near) WHERE r <= 400 GROUP BY ALL"),
    "vector_leg": (["near"], """SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), path) AS rank, round(d, 6) AS distance FROM (SELECT query_id, path, min(d) AS d FROM (
      SELECT query_id, 'd' || vec_id AS path, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), 'd' || vec_id) AS r FROM near) WHERE r <= 50 AND 'd' || vec_id NOT IN (SELECT 'd' || (vec_id - vec_id % 3) FROM embeddings WHERE vec_id % 3 > 0)
      UNION ALL SELECT query_id, path, d FROM (SELECT *, 'd' || (vec_id - vec_id % 3) AS path, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), 'd' || (vec_id - vec_id % 3), vec_id) AS r FROM near WHERE vec_id % 3 > 0) WHERE r <= 400) GROUP BY ALL) QUALIFY rank <= 50"""),
    "tokenize_unicode": (["docs"], r"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS t FROM docs)"),
    "term_postings": (["posted"], "SELECT term, path, tf_title, tf_body FROM posted"),
    "keyword_search": (["a_words"], "SELECT query_id, path, rank, round(score, 6) AS score FROM a_words WHERE rank <= 50"),
    "keyword_postings": (["r_words"], "SELECT query_id, path, rank, round(score, 6) AS score FROM r_words WHERE rank <= 50"),
    "segment_search": (["a_words"], "SELECT query_id, path, rank, round(score, 6) AS score FROM a_words WHERE rank <= 50"),
    "bm25_unstemmed": (["u_words"], "SELECT query_id, path, rank, round(score, 6) AS score FROM u_words WHERE rank <= 50"),
    "term_stems": (["stem_posted"], "SELECT term AS stem, count(*) AS documents FROM stem_posted GROUP BY term"),
    "bm25_weighted": (["n_words"], "SELECT query_id, path, rank, round(score, 6) AS score FROM n_words WHERE rank <= 50"),
    "rrf_fusion": ([], """WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS query_id, user_id::VARCHAR AS path, round(sum(value), 6) AS v, count(*) AS n FROM events GROUP BY ALL),
      a AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, path) AS rank FROM e QUALIFY rank <= 50), b AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, path) AS rank FROM e QUALIFY rank <= 50)
      SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r0 NULLS LAST, r1 NULLS LAST) AS rank, round(score, 9) AS score FROM (SELECT query_id, path, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0) AS score, a.rank AS r0, b.rank AS r1 FROM a FULL JOIN b USING (query_id, path))"""),
    "hybrid_search": (["a_hybrid"], "SELECT query_id, path, rank, round(score, 9) AS score FROM a_hybrid"),
    "rare_leg": (["rare_ranked"], "SELECT query_id, path, rank, round(score, 9) AS score FROM rare_ranked"),
    "rare_pairs": (["r12_pairs"], "SELECT query_id, term1, term2, path, round(part, 9) AS part FROM r12_pairs"),
    "candidate_pool": (["pool"], "SELECT query_id, path, pos FROM pool"),
    "score_windows": (["s_scored"], "SELECT query_id, path, ord, round(score, 6) AS score FROM s_scored"),
    "prefilter_windows": (["s_scored"], "SELECT query_id, path, ord, round(raw, 6) AS raw FROM s_scored QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY round(raw, 9) DESC, ord) <= 3"),
    "best_window": (["s_best"], "SELECT query_id, path, ord, round(score, 6) AS score FROM s_best"),
    "rerank_order": (["s_best", "pool"], "SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank, round(score, 6) AS score FROM pool JOIN s_best USING (query_id, path)"),
    "none_scores": (["pool"], "SELECT query_id, path, pos, round(1.0::DOUBLE - (pos - 1) / count(*) OVER (PARTITION BY query_id)::DOUBLE, 6) AS score FROM pool"),
    "token_estimate": (["pool", "windows", "questions"], "SELECT query_id, sum(length(text) + length(q) + 200)::BIGINT // 3 AS tokens FROM pool JOIN windows USING (path) JOIN questions USING (query_id) GROUP BY query_id"),
    "answer_search": (["recalled"], "SELECT query_id, path, rank, mode, round(score, 6) AS score, ord FROM recalled WHERE rank <= 5"),
    "plugin_scores": (["s_scored"], "SELECT query_id, path, ord, round(score, 6) AS score FROM s_scored"),
    "recall_with_scorer": (["recalled"], "SELECT query_id, path, rank, mode, round(score, 6) AS score FROM recalled WHERE rank <= 5"),
    "recall_log_rows": (["recalled", "wider", "pool", "q20_hybrid", "questions"], """SELECT q, mode, query_id IN (SELECT query_id FROM wider) AS widened, (SELECT count(*) FROM pool p WHERE p.query_id = r.query_id) + (SELECT count(*) FROM wider w WHERE w.query_id = r.query_id) AS pool, least(3, n) AS n_top, best,
      (SELECT path FROM q20_hybrid h WHERE h.query_id = r.query_id AND h.rank = 1) AS first, 0.0::DOUBLE AS usd FROM (SELECT query_id, any_value(mode) AS mode, count(*) AS n, round(max(score) FILTER (rank = 1), 6) AS best FROM recalled WHERE rank <= 5 GROUP BY query_id) r JOIN questions USING (query_id)"""),
    "ledger_rows": (["spend"], "SELECT caller, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(usd), 6) AS usd, count(DISTINCT session) AS sessions FROM spend GROUP BY 1, 2"),
    "indexed_title": ([], """SELECT (CASE WHEN c_custkey % 5 = 0 THEN 'log/' ELSE 'home/' END) || c_custkey || '.md' AS path, c_name || ' ' || c_mktsegment || (CASE WHEN c_custkey % 2 = 0 THEN ' nation ' || c_nationkey ELSE '' END) AS indexed, CASE WHEN c_custkey % 2 = 0 THEN 'nation ' || c_nationkey ELSE '' END AS summary,
      'body ' || c_custkey AS body, CASE WHEN c_custkey % 3 = 0 THEN 'note' WHEN c_custkey % 5 = 0 THEN 'record' ELSE '' END AS kind, '2024-02-0' || (c_custkey % 9 + 1) AS date FROM customer"""),
    "dataset_sessions": ([], r"""WITH c AS (SELECT conv_id, (conv_id % 7)::VARCHAR AS question_id, 's' || left(sha256((conv_id % 7)::VARCHAR || ':' || conv_id), 10) AS name, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id::VARCHAR) AS r,
       string_agg('**' || role || ':** ' || coalesce(text, ''), E'\n\n' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)
      SELECT question_id, name || '.md' AS path, md5('# Session ' || name || E'\n\nDate: 2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || E'\n\n' || turns) AS body_md5, r <= 2 AS gold FROM c"""),
    "question_rows": (["asked", "gold"], "SELECT q, sum(CASE WHEN query_id % 5 = 0 THEN 1 ELSE coalesce(n, 0) END)::BIGINT AS n_gold, sum(CASE WHEN query_id % 5 = 0 THEN 0 ELSE coalesce(n, 0) END)::BIGINT AS known FROM asked LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id) USING (query_id) GROUP BY q"),
    "widen_once": (["recalled", "wider"], "SELECT query_id, query_id IN (SELECT query_id FROM wider) AS widened, round(max(score), 6) AS best FROM recalled WHERE rank <= 5 GROUP BY query_id"),
    "gate_modes": (["gated"], "SELECT CASE WHEN asks THEN 'rerank:lexical' ELSE 'keyword' END AS mode, count(*) AS n, min(query_id) AS first_query FROM gated GROUP BY 1"),
    "rolling_spend": (["spend"], "SELECT event_id, caller, round(sum(usd) OVER (PARTITION BY caller ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), 6) AS spend FROM spend"),
    "ledger_summary": (["spend"], """SELECT count(*) FILTER (recent) AS calls_24h, round(coalesce(sum(usd) FILTER (recent), 0), 4) AS usd_24h, coalesce(sum(tokens) FILTER (recent), 0)::BIGINT AS tokens_24h, round(coalesce(sum(usd), 0), 4) AS usd_all_time,
      round(coalesce(sum(usd) FILTER (recent AND caller = 'live'), 0), 4) AS usd_24h_live, round(coalesce(sum(usd) FILTER (recent AND caller = 'eval'), 0), 4) AS usd_24h_eval FROM (SELECT *, ts >= TIMESTAMP '2024-01-19 00:00:00' AS recent FROM spend)"""),
    "budget_replay": (["replayed"], "SELECT event_id, caller, round(day, 6) AS day, verdict FROM replayed"),
    "session_share": (["replayed"], "SELECT session, count(*) AS refused, round(sum(usd), 4) AS usd FROM replayed WHERE verdict = 'session share' GROUP BY session"),
    "usage_report": ([], """WITH l AS (SELECT CASE WHEN event_type = 'view' THEN 'keyword' WHEN event_type = 'click' THEN 'first-stage' WHEN user_id % 10 = 0 THEN 'first-stage (reranker unavailable)' ELSE 'rerank:lexical' END AS mode, CASE WHEN event_id % 13 <> 0 THEN (event_id % 101) / 100.0::DOUBLE END AS top_score,
      CASE WHEN event_id % 2 = 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS wa, event_id % 5 = 0 AS widened, abs(value) / 1000 AS usd, round(abs(value), 2) AS secs, event_id % 7 AS top1, user_id % 7 AS first1 FROM events), r AS (SELECT * FROM l WHERE mode LIKE 'rerank%')
      SELECT (SELECT count(*) FROM l) AS queries, count(*) AS reranked, count(*) FILTER (top_score >= wa) AS confident_top1, count(*) FILTER (top_score < wa) AS low_confidence, count(*) FILTER (widened) AS widened, (SELECT count(*) FROM l WHERE mode LIKE 'first-stage%') AS fallbacks,
      count(*) FILTER (top1 <> first1) AS top1_differs_from_search, round(coalesce(median(secs), 0), 2) AS secs_p50, (SELECT round(sum(usd), 4) FROM l) AS usd, round(sum(usd) / greatest(count(*), 1), 5) AS usd_per_reranked, round(list_sort(list(secs))[floor(0.9 * (count(*) - 1))::BIGINT + 1], 2) AS secs_p90 FROM r"""),
    "doc_labels": ([], """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'checked' WHEN d.source LIKE 'src1%' THEN 'record' WHEN d.doc_id % 10 = 7 THEN 'seven' ELSE '' END AS kind, '2024-01-' || lpad((d.doc_id % 28 + 1)::VARCHAR, 2, '0') AS date
      FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id"""),
    "index_diff": (["diff"], "SELECT path, status FROM diff"),
    "index_merge": (["diff", "known", "hashes"], "SELECT k.path, k.hash, k.embedded FROM known k JOIN diff d ON d.path = k.path AND d.status = 'same' UNION ALL SELECT h.path, h.hash, true FROM hashes h JOIN diff d ON d.path = h.path AND d.status IN ('new', 'changed')"),
    "index_stats": (["docs", "section_rows"], f"SELECT count(*) AS docs, sum(len({plain('body')}))::BIGINT AS words, count(*) FILTER (doc_id % 5 = 0) AS pending, (SELECT count(*) FROM section_rows) AS sections, (SELECT count(DISTINCT path) FROM section_rows) AS long_docs FROM docs"),
    "pending_embed": (["diff", "hashes"], "SELECT h.path, h.hash, d.status = 'same' AS embedded FROM hashes h JOIN diff d USING (path)"),
    "budgeted_build": (["docs"], f"SELECT path, size, texts, \"before\", \"before\" = 0 OR \"before\" + texts <= 400 AS fits FROM (SELECT path, length(body) AS size, len({chunks('body')}) AS texts, coalesce(sum(len({chunks('body')})) OVER (ORDER BY length(body), path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"before\" FROM docs)"),
    "eval_first_stage": (["gold", "a20_hybrid", "asked"], """SELECT count(*) AS n, (SELECT count(*) FROM asked) - count(*) AS skipped, count(*) FILTER (rank = 1) AS hit_1, count(*) FILTER (rank BETWEEN 1 AND 5) AS hit_top, count(*) FILTER (rank > 0) AS hit_depth, round(coalesce(sum(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END) / greatest(count(*), 1), 0), 4) AS mrr
      FROM (SELECT query_id, coalesce(min(rank), 0) AS rank FROM gold LEFT JOIN a20_hybrid USING (query_id, path) GROUP BY query_id)"""),
    "eval_any_all": (["any_all"], "SELECT * FROM any_all"),
    "eval_by_type": (["any_all"], "SELECT coalesce(kind, 'all') AS kind, count(*) AS n, sum(any_1::INT)::BIGINT AS any_1, sum(any_5::INT)::BIGINT AS any_5, sum(all_5::INT)::BIGINT AS all_5, sum(all_10::INT)::BIGINT AS all_10 FROM (SELECT *, 'kind-' || query_id % 3 AS kind FROM any_all) GROUP BY ROLLUP (kind)"),
    "answerable_filter": (["kept_types"], "SELECT kind, c AS n FROM kept_types"),
}

QUERIES["logged_report"] = QUERIES["usage_report"]


def oracle_sql() -> dict[str, str]:
    out = {k: with_ctes(n, s) if n else s for k, (n, s) in QUERIES.items()}
    return out

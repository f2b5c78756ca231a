"""The registered queries as DuckDB SQL over the input tables, written from the definitions.

Each fragment is one or more common table expressions; a query names those it
needs, in order.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}]+')"


def _with(*parts: str) -> str:
    *tables, last = parts
    return "WITH RECURSIVE " + ",\n".join(tables) + "\n" + last


def _tokens(source: str = "documents") -> str:
    return f"""tok AS (
  SELECT doc_id, lang, source, w, len(w) AS n_w, greatest(len(w) - 33, 0) // 96 AS last_chunk
  FROM (SELECT doc_id, lang, source, {WORDS.format("text")} AS w FROM {source}) WHERE len(w) > 0)"""


CUT = """cut AS (
  SELECT doc_id, chunk::INTEGER AS chunk, w[chunk * 96 + 1 : chunk * 96 + 128] AS tokens,
    chunk = last_chunk AS is_last, lang, source
  FROM (SELECT *, unnest(range(0, last_chunk + 1)) AS chunk FROM tok))"""

OCCUR = """occ AS (
  SELECT doc_id, chunk, lang, source, is_last, unnest(tokens) AS term,
    generate_subscripts(tokens, 1) - 1 AS place, len(tokens) AS len FROM cut)"""

POST = """post AS (
  SELECT doc_id, chunk, term, count(*) AS tf, count(*) FILTER (WHERE is_last OR place < 96) AS own_tf,
    string_agg((place + chunk * 96)::VARCHAR, ' ' ORDER BY place) AS positions,
    len, lang, source
  FROM occ GROUP BY doc_id, chunk, term, len, lang, source)"""

STATS = """stats AS (
  SELECT term, count(*) AS df, count(DISTINCT doc_id) AS doc_df FROM post GROUP BY term)"""

CORPUS = """corpus AS (
  SELECT count(*) AS n, sum(len(tokens))::BIGINT AS total_len, count(DISTINCT doc_id) AS n_docs,
    sum(len(tokens))::DOUBLE / count(*) AS avgdl FROM cut)"""

INDEX = (_tokens(), CUT, OCCUR, POST, STATS, CORPUS)

QUESTIONS = "asked AS (SELECT item_id AS query_id, text, NULL::VARCHAR AS want FROM benchmark)"
QUESTIONS_BY_LANG = """asked AS (
  SELECT item_id * n + i AS query_id, text, want FROM benchmark,
    (SELECT lang AS want, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n
     FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)))"""

TURN_QUERIES = """turn_queries AS (
  SELECT conv_id * 2147483648 + turn AS query_id, conv_id, turn,
    array_to_string(coalesce(earlier, []) || [text], chr(10)) AS text
  FROM (SELECT *, list(text) OVER (PARTITION BY conv_id ORDER BY turn
          RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS earlier FROM conversations)
  WHERE role = 'user')"""
QUESTIONS_BY_TURN = "asked AS (SELECT query_id, text, NULL::VARCHAR AS want FROM turn_queries)"


def _bm25(name: str = "hits", k: int = 10, b: float = 0.75) -> str:
    """Hits of ``asked``; needs INDEX."""
    return f"""{name}_terms AS (
  SELECT query_id, want, term, count(*) AS qtf
  FROM (SELECT query_id, want, unnest({WORDS.format("text")}) AS term FROM asked) GROUP BY ALL),
{name}_scored AS (
  SELECT query_id, doc_id, chunk, round(sum(
    qtf * ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * len / avgdl))), 4) AS score
  FROM {name}_terms JOIN post USING (term) JOIN stats USING (term), corpus
  WHERE want IS NULL OR want = lang GROUP BY ALL),
{name} AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk))::INTEGER AS rank
  FROM {name}_scored QUALIFY rank <= {k})"""


FEEDBACK = """fed AS (SELECT h.query_id, unnest(c.tokens) AS term, 1::DOUBLE / len(c.tokens) AS part
  FROM hits h JOIN cut c ON h.doc_id = c.doc_id AND h.chunk = c.chunk WHERE h.rank <= 3),
worth AS (SELECT query_id, term, round(sum(part) * ln(1::DOUBLE + (max(n) - max(df) + 0.5::DOUBLE) / (max(df) + 0.5::DOUBLE)), 6) AS score
  FROM fed JOIN stats USING (term), corpus WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM hits_terms) GROUP BY query_id, term),
added AS (SELECT query_id, term, score FROM worth QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) <= 10),
more_terms AS (SELECT query_id, term, qtf::DOUBLE AS qtf FROM hits_terms
  UNION ALL SELECT query_id, term, round(0.5 * score / max(score) OVER (PARTITION BY query_id), 6) FROM added),
more_scored AS (
  SELECT query_id, doc_id, chunk, round(sum(
    qtf * ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 4) AS score
  FROM more_terms JOIN post USING (term) JOIN stats USING (term), corpus GROUP BY ALL)"""

CONTEXT = """found AS (SELECT h.query_id, h.doc_id, h.chunk, h.rank, c.tokens
  FROM hits h JOIN cut c ON h.doc_id = c.doc_id AND h.chunk = c.chunk),
single AS (SELECT * FROM found
  QUALIFY row_number() OVER (PARTITION BY query_id, array_to_string(tokens, ' ') ORDER BY rank) = 1),
trimmed AS (SELECT *,
    CASE WHEN lag(chunk) OVER d = chunk - 1 AND lag(rank) OVER d < rank THEN 32 ELSE 0 END AS b,
    CASE WHEN lead(chunk) OVER d = chunk + 1 AND lead(rank) OVER d < rank
      THEN least(96, len(tokens)) ELSE len(tokens) END AS e
  FROM single WINDOW d AS (PARTITION BY query_id, doc_id ORDER BY chunk)),
parts AS (SELECT *, CASE WHEN e > b THEN tokens[b + 1 : e] ELSE [] END AS part FROM trimmed),
running AS (SELECT *, sum(len(part)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM parts),
chosen AS (SELECT query_id, count(*) AS n_passages, max(used)::BIGINT AS n_words,
    string_agg(doc_id || ':' || chunk, ' ' ORDER BY rank) AS cited,
    string_agg(array_to_string(part, ' '), chr(10) ORDER BY rank) AS context
  FROM running WHERE used <= 400 GROUP BY query_id)"""

CONTEXT_ROWS = """SELECT query_id, coalesce(n_passages, 0) AS n_passages, coalesce(n_words, 0) AS n_words,
  coalesce(cited, '') AS cited, coalesce(context, '') AS context
FROM asked LEFT JOIN chosen USING (query_id)"""

PHRASE = f"""phrases AS (SELECT item_id AS query_id, {WORDS.format("text")} AS p FROM benchmark),
spots AS (SELECT doc_id, place, t0, lead(t0, 1) OVER s AS t1, lead(t0, 2) OVER s AS t2
  FROM (SELECT doc_id, unnest(w) AS t0, generate_subscripts(w, 1) - 1 AS place FROM tok)
  WINDOW s AS (PARTITION BY doc_id ORDER BY place)),
starts AS (SELECT query_id, doc_id, place, p FROM phrases JOIN spots ON t0 = p[1]
  WHERE (len(p) < 2 OR t1 = p[2]) AND (len(p) < 3 OR t2 = p[3])),
phrase_hits AS (SELECT query_id, doc_id, place::INTEGER AS start
  FROM starts JOIN tok USING (doc_id) WHERE w[place + 1 : place + len(p)] = p)"""

PROXIMITY = f"""near_asked AS (SELECT item_id AS query_id, {WORDS.format("text")} AS w FROM benchmark
  UNION ALL SELECT -1 - item_id, {WORDS.format("array_to_string(string_split(text, ' ')[1:8], ' ')")} FROM benchmark),
needs AS (SELECT query_id, term, count(*) AS need, count(*) OVER (PARTITION BY query_id) AS n_terms
  FROM (SELECT query_id, unnest(w) AS term FROM near_asked) GROUP BY query_id, term),
places AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM tok),
there AS (SELECT query_id, doc_id, term, pos, need, n_terms FROM needs JOIN places USING (term)
  QUALIFY count(*) OVER (PARTITION BY query_id, doc_id, term) >= need),
complete AS (SELECT query_id, doc_id FROM there GROUP BY query_id, doc_id HAVING count(DISTINCT term) = max(n_terms)),
backs AS (SELECT *, lag(pos, need - 1) OVER (PARTITION BY query_id, doc_id, term ORDER BY pos) AS back
  FROM there SEMI JOIN complete USING (query_id, doc_id)),
ends AS (SELECT e.query_id, e.doc_id, e.pos, e.n_terms, b.term, max(b.back) AS back
  FROM backs e JOIN backs b ON e.query_id = b.query_id AND e.doc_id = b.doc_id AND b.pos <= e.pos WHERE b.back IS NOT NULL GROUP BY ALL),
stretches AS (SELECT query_id, doc_id, min(back) AS start, pos - min(back) + 1 AS width FROM ends
  GROUP BY query_id, doc_id, pos HAVING count(*) = max(n_terms)),
shortest AS (SELECT query_id, doc_id, min(width) AS width, arg_min(start, width * 1000000000 + start) AS start FROM stretches GROUP BY query_id, doc_id)"""

DIVERSE = """scored AS (SELECT query_id, h.doc_id, h.chunk, h.rank, h.score / max(h.score) OVER (PARTITION BY query_id) AS part, len(c.tokens) AS n, c.tokens, list_distinct(c.tokens) AS kinds
  FROM hits h JOIN cut c ON h.doc_id = c.doc_id AND h.chunk = c.chunk),
alike AS (SELECT a.query_id, a.rank AS a, b.rank AS b, round(len(list_intersect(a.kinds, b.kinds))::DOUBLE / greatest(len(list_distinct(a.kinds || b.kinds)), 1), 6) AS alike
  FROM scored a JOIN scored b USING (query_id)),
picks AS (
  SELECT DISTINCT query_id, []::INTEGER[] AS chosen, 0::BIGINT AS used FROM scored
  UNION ALL
  SELECT query_id, list_append(chosen, rank), used + n FROM (
    SELECT p.query_id, p.chosen, p.used, s.rank, s.n,
      row_number() OVER (PARTITION BY p.query_id ORDER BY round(0.5 * s.part - 0.5 * coalesce(max(k.alike) FILTER (list_contains(p.chosen, k.b)), 0), 6) DESC, s.rank) AS place
    FROM picks p JOIN scored s ON s.query_id = p.query_id AND NOT list_contains(p.chosen, s.rank) AND p.used + s.n <= 400
    JOIN alike k ON k.query_id = p.query_id AND k.a = s.rank
    GROUP BY p.query_id, p.chosen, p.used, s.rank, s.n, s.part) WHERE place = 1),
ended AS (SELECT query_id, arg_max(chosen, len(chosen)) AS chosen, max(used) AS used FROM picks GROUP BY query_id),
listed AS (SELECT query_id, used, unnest(chosen) AS rank, generate_subscripts(chosen, 1) AS place FROM ended),
chosen AS (SELECT query_id, count(*) AS n_passages, max(used)::BIGINT AS n_words,
    string_agg(doc_id || ':' || chunk, ' ' ORDER BY place) AS cited, string_agg(array_to_string(tokens, ' '), chr(10) ORDER BY place) AS context
  FROM listed JOIN scored USING (query_id, rank) GROUP BY query_id)"""

MISSPELT = """name_words AS (SELECT DISTINCT alias, unnest(string_split(alias, ' ')) AS word FROM glossary),
long_words AS (SELECT DISTINCT word FROM name_words WHERE length(word) >= 5),
long_terms AS (SELECT term FROM stats WHERE length(term) >= 5 AND term NOT IN (SELECT word FROM name_words)),
-- One edit leaves two letters at one end as they are; all pairs that agree there are compared. levenshtein() would count bytes.
two_equal AS (
  SELECT word, term FROM long_words JOIN long_terms ON left(word, 2) = left(term, 2) AND abs(length(term) - length(word)) <= 1
  UNION SELECT word, term FROM long_words JOIN long_terms ON right(word, 2) = right(term, 2) AND abs(length(term) - length(word)) <= 1),
near_words AS (SELECT word, term FROM two_equal WHERE levenshtein(word, term) <= 4
  AND len(list_filter(range(1, greatest(length(word), length(term)) + 1), lambda i: left(word, i - 1) = left(term, i - 1) AND
    CASE WHEN length(word) = length(term) THEN substr(word, i + 1) = substr(term, i + 1)
      WHEN length(word) > length(term) THEN substr(word, i + 1) = substr(term, i) ELSE substr(term, i + 1) = substr(word, i) END)) > 0),
misspelt AS (
  SELECT entity_id, alias, word, term, array_to_string([CASE WHEN x = word THEN term ELSE x END FOR x IN string_split(alias, ' ')], ' ') AS variant
  FROM near_words JOIN name_words USING (word) JOIN glossary USING (alias)),
misspelt_rows AS (SELECT * FROM misspelt WHERE variant NOT IN (SELECT alias FROM glossary))"""

PAIRED = """truth AS (SELECT DISTINCT query_id, doc_id FROM phrase_hits),
gains AS (
  SELECT side, query_id, coalesce(round(1e9::DOUBLE / min(place)), 0)::BIGINT AS gain FROM (SELECT 'a' AS side UNION ALL SELECT 'b') JOIN truth ON true
  LEFT JOIN (SELECT side, query_id, doc_id, row_number() OVER (PARTITION BY side, query_id ORDER BY min(rank), doc_id) AS place
    FROM (SELECT 'a' AS side, query_id, doc_id, rank FROM hits UNION ALL SELECT 'b', query_id, doc_id, rank FROM plain) GROUP BY side, query_id, doc_id) USING (side, query_id, doc_id)
  GROUP BY side, query_id),
both_gains AS (SELECT query_id, a.gain AS a, b.gain AS b, a.gain - b.gain AS d
  FROM gains a JOIN gains b USING (query_id) WHERE a.side = 'a' AND b.side = 'b'),
flips AS (SELECT round, abs(sum(CASE WHEN round = 0 OR substr(md5('7:' || round || ':' || query_id), 1, 1) < '8' THEN d ELSE -d END)) AS total
  FROM both_gains, range(0, 1001) r(round) GROUP BY round),
p_values AS (SELECT round(count(*) FILTER (f.total >= r.total) / 1001.0::DOUBLE, 6) AS p_value FROM flips f, (SELECT total FROM flips WHERE round = 0) r)"""

WEIGHTS = """doc_terms AS (SELECT doc_id, term, sum(own_tf)::BIGINT AS tf FROM post GROUP BY ALL HAVING sum(own_tf) > 0),
weights AS (
  SELECT doc_id, term, tf, round(tf * ln(n_docs::DOUBLE / doc_df), 6) AS score
  FROM doc_terms JOIN stats USING (term), corpus)"""

VECTORS = """asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 5) AS score,
  (row_number() OVER (PARTITION BY query_id
    ORDER BY round(list_cosine_similarity(v, embedding::DOUBLE[]), 5) DESC, vec_id))::INTEGER AS rank
FROM asked, embeddings QUALIFY rank <= 10"""

IVF = """means AS (
  SELECT label::BIGINT AS id, list(x ORDER BY i) AS v FROM (
    SELECT label, i, avg(x) AS x FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label),
centers AS (SELECT id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM means),
units AS (SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS u
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
placed AS (SELECT vec_id, e.u, arg_min(c.id, list_distance(e.u, c.u)) AS list_id FROM units e, centers c GROUP BY vec_id, e.u),
probes AS (SELECT q.vec_id AS query_id, q.u AS q, c.id AS list_id FROM units q, centers c WHERE q.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.u, c.u), c.id) <= 8),
scored AS (SELECT query_id, vec_id, round(list_dot_product(q, u), 5) AS score FROM probes JOIN placed USING (list_id))
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank
FROM scored QUALIFY rank <= 10"""

BOILERPLATE = """lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
often AS (SELECT trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT text) >= 3),
marked AS (SELECT doc_id, pos, l.line, o.line IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON trim(l.line) = o.line),
cleaned AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
    count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY doc_id)
SELECT doc_id, c.text, lang, source, length(c.text) AS n_chars, coalesce(n_dropped, 0)::INTEGER AS n_dropped
FROM documents LEFT JOIN cleaned c USING (doc_id)"""


def _readable(text: str) -> str:
    for entity, sign in {
        "&nbsp;": "' '", "&lt;": "'<'", "&gt;": "'>'", "&quot;": "chr(34)", "&apos;": "chr(39)", "&#39;": "chr(39)",
        "&middot;": "chr(183)", "&copy;": "chr(169)", "&reg;": "chr(174)", "&ndash;": "chr(8211)", "&mdash;": "chr(8212)",
        "&hellip;": "chr(8230)", "&euro;": "chr(8364)", "&amp;": "'&'",
    }.items():
        text = f"replace({text}, '{entity}', {sign})"
    text = rf"regexp_replace({text}, '[ \t\f\r]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({text}, '\A[ \n]+|[ \n]+\z', '', 'g')"


BLANK = r"[ \t\n\f\r]*"
PAGES = rf"""shown AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script{BLANK}>|\z)'
  || '|<style\b.*?(?:</style{BLANK}>|\z)|<nav\b.*?</nav{BLANK}>', '', 'g') AS html FROM pages),
stripped AS (SELECT page_id, url,
  regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title', 1), '<[A-Za-z/!?][^>]*>', '', 'g') AS title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<title\b[^>]*>.*?</title[^>]*>', '', 'g'),
    '(?i)</?(?:p|br|hr|div|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|article|section|header|footer|main|aside|blockquote|pre|form)\b[^>]*>',
    chr(10), 'g'), '(?i)</?(?:td|th)\b[^>]*>', ' ', 'g'), '<[A-Za-z/!?][^>]*>', '', 'g') AS text
  FROM shown)
SELECT page_id, url, {_readable("title")} AS title, {_readable("text")} AS text FROM stripped"""

GLOSSARY = """glossary AS (
  SELECT ('0x' || substr(md5(alias), 1, 15))::BIGINT AS entity_id, alias, kind FROM (
    SELECT term AS alias, 'word' AS kind FROM stats WHERE length(term) >= 10 AND doc_df >= 3
    UNION ALL
    SELECT alias, 'pair' FROM (
      SELECT doc_id, a || ' ' || b AS alias FROM (
        SELECT doc_id, t0 AS a, lead(t0) OVER (PARTITION BY doc_id ORDER BY place) AS b
        FROM (SELECT doc_id, unnest(w) AS t0, generate_subscripts(w, 1) AS place FROM tok))
      WHERE length(a) >= 6 AND length(b) >= 6)
    GROUP BY alias HAVING count(DISTINCT doc_id) >= 3))"""

MENTIONS = """runs AS (
  SELECT doc_id, last_chunk, width, p, array_to_string(w[p + 1 : p + width], ' ') AS alias
  FROM (SELECT doc_id, last_chunk, w, width, unnest(range(0, n_w - width + 1)) AS p
        FROM tok, (SELECT DISTINCT len(string_split(alias, ' ')) AS width FROM glossary) WHERE n_w >= width)),
named AS (SELECT doc_id, last_chunk, p, width, entity_id FROM runs JOIN glossary USING (alias)),
mentions AS (
  SELECT doc_id, least(greatest((p - 16) // 96, 0), last_chunk)::INTEGER AS chunk,
    p::INTEGER AS pos, width::INTEGER AS len, entity_id
  FROM named m WHERE NOT EXISTS (
    SELECT 1 FROM named o WHERE o.doc_id = m.doc_id AND o.p < m.p + m.width AND m.p < o.p + o.width
      AND (o.width > m.width OR (o.width = m.width AND o.p < m.p))))"""

GRAPH = """pairs AS (
  SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS n
  FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 32 AND a.entity_id < b.entity_id
  GROUP BY ALL),
shares AS (SELECT e, sum(n) AS share FROM (
    SELECT entity_a AS e, n FROM pairs UNION ALL SELECT entity_b, n FROM pairs) GROUP BY e)"""

GRAPH_ROWS = """SELECT entity_a, entity_b, n,
  round(ln(2::DOUBLE * n * (SELECT sum(n) FROM pairs) / (a.share::DOUBLE * b.share::DOUBLE)), 6) AS pmi
FROM pairs JOIN shares a ON entity_a = a.e JOIN shares b ON entity_b = b.e"""

EVAL = """truth AS (SELECT DISTINCT query_id, doc_id FROM phrase_hits),
placed AS (SELECT query_id, doc_id,
    row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS place
  FROM hits GROUP BY query_id, doc_id),
by_query AS (
  SELECT k, query_id, count(*) AS n_true, count(*) FILTER (WHERE place <= k) AS found,
    min(place) FILTER (WHERE place <= k) AS first_place,
    coalesce(sum(1::DOUBLE / log2(place + 1)) FILTER (WHERE place <= k), 0) AS dcg
  FROM truth LEFT JOIN placed USING (query_id, doc_id), (VALUES (1), (5), (10)) ks(k) GROUP BY k, query_id)"""

EVAL_ROWS = """SELECT k, count(*) AS n_queries, round(avg(found::DOUBLE / n_true), 6) AS recall,
  round(avg(coalesce(1::DOUBLE / first_place, 0)), 6) AS mrr,
  round(avg(dcg / list_sum([1::DOUBLE / log2(i + 1) FOR i IN range(1, least(n_true, k) + 1)])), 6) AS ndcg
FROM by_query GROUP BY k"""

COPIES = r"""copies AS (
  SELECT *, min(doc_id) OVER same AS kept_id, count(*) OVER same AS n FROM documents
  WINDOW same AS (PARTITION BY trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\f\r]+', ' ', 'g'))))"""

EDITION = """edition AS (
  SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' errata' ELSE text END AS text,
    CASE WHEN lang = 'en' AND source = 'src5' THEN 'en-GB' ELSE lang END AS lang,
    CASE WHEN source = 'src3' THEN 'src3b' ELSE source END AS source
  FROM documents WHERE lang <> 'es')"""

TERM_STATS = _with(*INDEX[:5], "SELECT term, df, doc_df FROM stats")

ORACLES = {
    "passages": _with(_tokens(), CUT, """SELECT doc_id, chunk, array_to_string(tokens, ' ') AS words,
  len(tokens)::INTEGER AS n_tokens, (CASE WHEN is_last THEN len(tokens) ELSE 96 END)::INTEGER AS own, lang, source
FROM cut"""),
    "page_text": "WITH " + PAGES,
    "drop_boilerplate": "WITH " + BOILERPLATE,
    "exact_dedup": _with(COPIES, "SELECT doc_id, text, lang, source, n_chars FROM copies WHERE doc_id = kept_id"),
    "exact_copies": _with(COPIES, "SELECT doc_id, kept_id, n FROM copies"),
    "corpus_profile": _with(COPIES, """SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n_docs,
  sum(n_chars)::BIGINT AS n_chars, count(*) FILTER (WHERE doc_id <> kept_id) AS n_copies,
  count(quality) AS n_labelled, round(avg(quality), 6) AS good, round(avg(l.toxic), 6) AS toxic
FROM copies LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (lang, source)"""),
    "postings": _with(*INDEX[:4], """SELECT doc_id, chunk, term, tf::INTEGER AS tf, own_tf::INTEGER AS own_tf,
  positions, len::INTEGER AS len, lang, source FROM post"""),
    "term_stats": TERM_STATS,
    "stream_ingest": TERM_STATS,
    "standing_questions": _with(_tokens(), f"""kept_questions AS (SELECT item_id AS query_id, list_distinct({WORDS.format("array_to_string(string_split(text, ' ')[1:8], ' ')")}) AS needs FROM benchmark)""",
        "SELECT query_id, doc_id FROM kept_questions JOIN tok ON list_has_all(w, needs) WHERE len(needs) > 0"),
    "passage_stats": _with(_tokens(), CUT, "SELECT doc_id, chunk, len(tokens)::INTEGER AS len FROM cut"),
    "corpus_stats": _with(_tokens(), CUT, CORPUS, "SELECT * FROM corpus"),
    "keyterms": _with(*INDEX, WEIGHTS, """SELECT *,
  (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term))::INTEGER AS rank
FROM weights QUALIFY rank <= 20"""),
    "index_delta": _with(EDITION, """SELECT doc_id, CASE WHEN o.text IS NULL THEN 'added'
  WHEN e.text IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM documents WHERE lang <> 'de') o FULL JOIN edition e USING (doc_id)
WHERE o.text IS DISTINCT FROM e.text OR o.lang IS DISTINCT FROM e.lang OR o.source IS DISTINCT FROM e.source"""),
    "index_compact": _with(EDITION, _tokens("edition"), *INDEX[1:4], """SELECT doc_id, chunk, term, tf::INTEGER AS tf, own_tf::INTEGER AS own_tf,
  positions, len::INTEGER AS len, lang, source FROM post"""),
    "index_refresh": _with(EDITION, _tokens("edition"), CUT, OCCUR, POST, STATS, "SELECT term, df, doc_df FROM stats"),
    "bm25_search": _with(*INDEX, QUESTIONS, _bm25(), "SELECT query_id, doc_id, chunk, score, rank FROM hits"),
    "bm25_search_filtered": _with(
        *INDEX, QUESTIONS_BY_LANG, _bm25(), "SELECT query_id, doc_id, chunk, score, rank FROM hits"),
    "feedback_search": _with(*INDEX, QUESTIONS, _bm25(k=3), FEEDBACK, """SELECT *,
  (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk))::INTEGER AS rank FROM more_scored QUALIFY rank <= 10"""),
    "phrase_search": _with(_tokens(), PHRASE, "SELECT * FROM phrase_hits"),
    "proximity_search": _with(_tokens(), PROXIMITY, """SELECT query_id, doc_id, start::INTEGER AS start, width::INTEGER AS width,
  (row_number() OVER (PARTITION BY query_id ORDER BY width, doc_id))::INTEGER AS rank FROM shortest QUALIFY rank <= 10"""),
    "diverse_context": _with(*INDEX, QUESTIONS, _bm25(), DIVERSE, CONTEXT_ROWS),
    "misspelt_names": _with(*INDEX[:5], GLOSSARY, MISSPELT, "SELECT * FROM misspelt_rows"),
    "link_misspelt": _with(*INDEX[:5], GLOSSARY.replace("glossary AS", "names AS", 1), MISSPELT.replace("glossary", "names"),
        "glossary AS (SELECT DISTINCT entity_id, variant AS alias FROM misspelt_rows)", MENTIONS, "SELECT * FROM mentions"),
    "paired_test": _with(*INDEX, QUESTIONS, _bm25(), _bm25("plain", b=0.0), PHRASE, PAIRED, """SELECT count(*) AS n_queries,
  round(avg(a) / 1e9, 6) AS mean_a, round(avg(b) / 1e9, 6) AS mean_b, round(avg(d) / 1e9, 6) AS difference,
  any_value(p_value) AS p_value FROM both_gains, p_values"""),
    "vector_search": "WITH " + VECTORS,
    "vector_search_ivf": "WITH " + IVF,
    "vector_index_upkeep": "WITH " + VECTORS.replace("FROM asked, embeddings", "FROM asked, embeddings WHERE vec_id % 14 <> 0"),
    "rank_fusion": _with(*INDEX, QUESTIONS, _bm25(), _bm25("plain", b=0.0), """fused AS (
  SELECT query_id, doc_id, chunk, round(sum(1::DOUBLE / (60 + rank)), 8) AS score
  FROM (SELECT query_id, doc_id, chunk, rank FROM hits UNION ALL SELECT query_id, doc_id, chunk, rank FROM plain)
  GROUP BY ALL)""", """SELECT *,
  (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk))::INTEGER AS rank
FROM fused QUALIFY rank <= 10"""),
    "related_documents": _with(*INDEX, WEIGHTS, """units AS (
  SELECT doc_id, term, score / sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS weight
  FROM weights WHERE score > 0)""", """near AS (
  SELECT a.doc_id AS from_doc, b.doc_id AS doc_id, round(sum(a.weight * b.weight), 4) AS score
  FROM units a JOIN units b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL)""", """SELECT *,
  (row_number() OVER (PARTITION BY from_doc ORDER BY score DESC, doc_id))::INTEGER AS rank
FROM near QUALIFY rank <= 5"""),
    "conversation_queries": _with(TURN_QUERIES, "SELECT * FROM turn_queries"),
    "assemble_context": _with(*INDEX, QUESTIONS, _bm25(), CONTEXT, CONTEXT_ROWS),
    "answer_context": _with(*INDEX, TURN_QUERIES, QUESTIONS_BY_TURN, _bm25(), CONTEXT, CONTEXT_ROWS),
    "glossary": _with(*INDEX[:5], GLOSSARY, "SELECT * FROM glossary"),
    "link_entities": _with(*INDEX[:5], GLOSSARY, MENTIONS, "SELECT * FROM mentions"),
    "entity_graph": _with(*INDEX[:5], GLOSSARY, MENTIONS, GRAPH, GRAPH_ROWS),
    "retrieval_eval": _with(*INDEX, QUESTIONS, _bm25(), PHRASE, EVAL, EVAL_ROWS),
}

"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek.llm import chat_tree, decontamination, lang_id, lines, merkle, mixing, near_dups, pii, quality, token_files, tokens, top_k, whitening
from tomeseek.llm.common import held_out, table
from tomeseek.session import new_folder

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Both texts of the conversation that is added to those of the table.
PLANTED = "\\### Assistant: </turn> ok"
#: Sources that are not named weigh alike.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SHARE = 0.6
EPOCHS = 2
SEED = 11


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"), by_edits=True)
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows, classes = near_dups.near_duplicates(
        table(spark, folder, "documents").select("doc_id", "text"), words=near_dups.WORDS, similarity=None)
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, folder, "embeddings"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = lang_id.predict_language(docs.select("doc_id", "text"), lang_id.fit_language(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "language.*")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = mixing.mixture(
        table(spark, folder, "documents"), domain=mixing.domain_of("source"), share=SHARE, weights=WEIGHTS, epochs=EPOCHS, seed=SEED)
    return rows


def op8_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_private(table(spark, folder, "documents").select("doc_id", "text"))
    counts = (pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS))
    return found.select("doc_id", *counts, F.sha2(pii.written_out("base"), 256).alias("base_sha256"), pii.written_out("spans").alias("spans"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(
        table(spark, folder, "documents"), new_folder(spark, "tokens"), public_tokenizers.path(VOCABULARY))
    return token_files.read_documents(spark, files)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_chat_tree(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, i, role, PLANTED) for i, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    output = chat_tree.write_chat_stream(given.unionByName(planted), public_tokenizers.path(BYTE_VOCABULARY))
    return chat_tree.read_conversations(spark, output, public_tokenizers.path(BYTE_VOCABULARY))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_top_k": op5_top_k,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_private_data": op8_private_data,
    "op9_token_counts": op9_token_counts,
    "op10_token_files": op10_token_files,
    "op11_whitening": op11_whitening,
    "op12_chat_tree": op12_chat_tree,
    "op13_merkle": op13_merkle,
}


def _filled(name: str, nodes: str, level: str, parents: str) -> str:
    """SQL of one level's shares; ``nodes`` has weight, capacity and budget."""
    family = f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_a AS (SELECT *, CASE WHEN capacity > 0 THEN capacity / weight ELSE 0 END AS fills_at FROM ({nodes})),
{name}_b AS (SELECT *,
    coalesce(sum(capacity) OVER ({family} ORDER BY fills_at, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER ({family} ORDER BY fills_at, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_a),
{name}_c AS (SELECT *, capacity = 0 OR before + fills_at * rest <= budget AS is_full FROM {name}_b),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE
    (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({family}))
    / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({family}) * weight END AS part FROM {name}_c)"""


def _weight_sql(level: str) -> str:
    return f"(CASE {level} " + " ".join(f"WHEN '{k}' THEN {float(w)}" for k, w in WEIGHTS[level].items()) + " ELSE 1.0 END)::DOUBLE"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: crc32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
    4294967295::BIGINT)"""

ORACLES: dict[str, str] = {
    "op13_merkle": f"""
WITH RECURSIVE d AS (
    SELECT *, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS raised, coalesce({_CRC} % 7 = 0, false) AND n_chars IS NOT NULL AS changed FROM documents),
p AS (
    SELECT doc_id, leaf, CASE WHEN changed THEN raised ELSE leaf END AS start, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (
    SELECT tree, 0 AS level, i, n, leaf AS digest FROM p
    UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, level, i // 2, n),
top AS (
    SELECT 0 AS level, tree AS i, count(*) OVER () AS n, digest FROM up WHERE n = 1
    UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
    SELECT p.tree, p.i, u.level, s.digest, u.i % 2 = 1 AS is_right
    FROM p JOIN up u ON u.tree = p.tree AND u.n > 1 AND u.i = p.i // (2 ** u.level)::BIGINT LEFT JOIN up s ON s.tree = u.tree AND s.level = u.level AND s.i = xor(u.i, 1)
    UNION ALL SELECT p.tree, p.i, 1000 + u.level, s.digest, u.i % 2 = 1
    FROM p JOIN top u ON u.n > 1 AND u.i = p.tree // (2 ** u.level)::BIGINT LEFT JOIN top s ON s.level = u.level AND s.i = xor(u.i, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree, i ORDER BY level) AS step FROM steps),
folded AS (
    SELECT tree, i, 0 AS step, start AS digest FROM p
    UNION ALL SELECT f.tree, f.i, f.step + 1, sha256(CASE WHEN s.is_right THEN coalesce(s.digest, '') || f.digest ELSE f.digest || coalesce(s.digest, '') END)
    FROM folded f JOIN numbered s ON s.tree = f.tree AND s.i = f.i AND s.step = f.step + 1),
proof AS (SELECT tree, i, sha256(coalesce(string_agg(digest, '' ORDER BY step), '')) AS proof_sha256 FROM numbered GROUP BY tree, i),
ends AS (SELECT tree, i, arg_max(digest, step) AS folded_root FROM folded GROUP BY tree, i)
SELECT p.doc_id, p.leaf, u.digest AS subroot, r.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM p JOIN ends USING (tree, i) LEFT JOIN proof USING (tree, i) JOIN up u ON u.tree = p.tree AND u.n = 1 JOIN top r ON r.n = 1""",
    "op12_chat_tree": f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
w AS (SELECT *,
    '### ' || regexp_replace(role, '(\\\\|###|</turn>|\\n)', '\\\\\\1', 'g') || chr(10)
    || regexp_replace(text, '(\\\\|###|</turn>)', '\\\\\\1', 'g') || chr(10) || '</turn>' || chr(10) AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(written))::BIGINT AS formatted_chars
FROM w GROUP BY conv_id""",
    "op5_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op7_mixing": f"""
WITH t AS (
    SELECT doc_id, coalesce('d' || (try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4), 'none') AS domain,
        coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS n_tokens
    FROM documents),
d AS (SELECT * FROM t WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
n3 AS (SELECT *, 1::DOUBLE AS weight, tokens::DOUBLE * {EPOCHS} AS capacity FROM leaf),
n2 AS (SELECT domain, lang, {_weight_sql("lang")} AS weight, sum(capacity) AS capacity FROM n3 GROUP BY ALL),
n1 AS (SELECT domain, {_weight_sql("domain")} AS weight, sum(capacity) AS capacity FROM n2 GROUP BY ALL),
b AS (SELECT least((SELECT sum(tokens)::DOUBLE FROM leaf) * {SHARE}, (SELECT sum(capacity) FROM n1)) AS budget),
{_filled("p1", "SELECT n1.*, budget FROM n1, b", "domain", "")},
{_filled("p2", "SELECT n2.*, p1.part AS budget FROM n2 JOIN p1 USING (domain)", "lang", "domain")},
{_filled("p3", "SELECT n3.*, p2.part AS budget FROM n3 JOIN p2 USING (domain, lang)", "source", "domain, lang")},
plan AS (SELECT domain, lang, source, tokens, floor(part + 1e-6)::BIGINT AS whole, floor(part + 1e-6)::BIGINT // tokens AS full_epochs FROM p3),
placed AS (
    SELECT d.*, full_epochs, whole - full_epochs * tokens AS rest, substr(md5('{SEED}:' || full_epochs || ':' || name), 1, 16) AS place
    FROM d JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, (full_epochs + (up_to <= rest)::BIGINT)::INTEGER AS copies
FROM run WHERE full_epochs + (up_to <= rest)::BIGINT > 0""",
}

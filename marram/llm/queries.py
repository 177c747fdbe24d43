"""Thin queries over the driver's tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import bpe, chat_format, conversation_repair, exact_dedup, language_id, line_dedup, mixing, near_dedup, ranked_search, secret_scan, suffix_tree_lm, topk_search, url_filter
from marram.llm.vocabulary import default_vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.with_digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), default_vocabulary())


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.read_back(chat_format.format_chats(turns)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(table(spark, sf_dir, "documents"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5).drop("exact_score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(rows, copies))


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), 20)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_secret_scan, op3_near_dedup, op4_mixing, op5_exact_dedup, op6_lm_scoring, op7_url_filter, op8_bpe, op9_chat_format, op10_language_id, op11_conversation_repair, op12_block_max_wand, op13_line_dedup)}

_OP5 = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_OP9 = r"""
WITH t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
           length(text) + 4 * (length(text) - length(replace(text, '&', '')))
           + 3 * (length(text) - length(replace(text, '<', '')))
           + 4 * (length(text) - length(translate(text, '[]', ''))) AS escaped
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + CASE WHEN before = role THEN 5 ELSE 9 + length(role) END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

_OP3 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS shingles
    FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_id AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM s LEFT JOIN least_id ON a = doc_id
"""

_OP1 = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, r.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_OP11 = r"""
WITH RECURSIVE o AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
), c AS (
    SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS code
    FROM o
), dmg AS (
    SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
           CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM c, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(i)
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
           trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inside
    FROM dmg
), f AS (
    SELECT *, CASE WHEN inside = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
                   WHEN right(inside, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
           left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM n
), stats AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
), inserts(said, now, cost, letters, added) AS (
    VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
           (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'), (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
           (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), edits(said, then_said, role, keep) AS (
    VALUES (0, 2, 'user', 'u'), (1, 2, 'user', 'u'), (2, 3, 'assistant', 'a'), (3, 2, 'user', 'u'), (0, 1, NULL, 's')
), p AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS said, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM f
    UNION ALL
    SELECT conv_id, i, said, cost, audit, lines FROM (
        SELECT p.conv_id, f.i, e.said, (p.cost + s.cost + e.cost)::BIGINT AS cost, p.audit || s.letters || e.letter AS audit, p.lines || s.added || e.line AS lines
        FROM p JOIN inserts s ON s.said = p.said JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1,
        LATERAL (
            SELECT s.now AS said, 4 AS cost, 'D' AS letter, '' AS line
            UNION ALL
            SELECT then_said, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', chr(10) || f.role || ':' || f.text FROM edits WHERE edits.said = s.now AND keep = initial AND fault IN ('-', 't')
            UNION ALL
            SELECT then_said, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', chr(10) || edits.role || ':' || f.text FROM edits WHERE edits.said = s.now AND edits.role IS NOT NULL AND fault IN ('-', 't')
        ) e
    ) QUALIFY row_number() OVER (PARTITION BY conv_id, said ORDER BY cost, audit) = 1
), done AS (
    SELECT p.conv_id, (p.cost + s.cost)::BIGINT AS cost, p.audit || s.letters AS audit, p.lines || s.added AS lines
    FROM p JOIN stats ON stats.conv_id IS NOT DISTINCT FROM p.conv_id AND stats.n = p.i JOIN inserts s ON s.said = p.said AND s.now IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + s.cost, p.audit || s.letters) = 1
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM k.conv_id
"""

_OP12 = r"""
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM t WHERE len(terms) > 0),
p AS (
    SELECT r, doc_id, len(terms) AS n, u.term, count(*) AS tf FROM t, unnest(terms) AS u(term) GROUP BY ALL
), w AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs
), q AS (
    SELECT r, item_id, u.term FROM (
        SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM benchmark
    ), unnest(terms) AS u(term)
), c AS (
    SELECT q.r AS q, item_id, p.r, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) <= 20
"""

_OP13 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS position FROM d
), k AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), frequent AS (
    SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines, count(last_doc) FILTER (k.doc_id <> last_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (last_doc IS NULL OR k.doc_id = last_doc), '')) AS kept_sha256
FROM k LEFT JOIN frequent USING (key) GROUP BY r, k.doc_id
"""

ORACLE_SQL = {"op1_topk_search": _OP1, "op3_near_dedup": _OP3, "op5_exact_dedup": _OP5, "op9_chat_format": _OP9, "op11_conversation_repair": _OP11, "op12_block_max_wand": _OP12, "op13_line_dedup": _OP13}

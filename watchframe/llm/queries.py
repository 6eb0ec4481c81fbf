"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language_id, licenses, toxicity
from .bpe_chunks import bpe_digests
from .exact_dedup import exact_groups
from .fingerprints import edit_likeness
from .mixing import fair_mix
from .ngram_join import jaccard_components
from .packing import pack_documents
from .pii import span_digests
from .token_counts import token_counts
from .turn_repair import repair_digests
from .turn_trie import prefix_tree


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(_documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir))


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(_documents(spark, sf_dir))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return licenses.license_scan(docs, licenses.fit(docs))


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = tokenizer_file("byte_bpe_50k.tiktoken")
    return token_counts(_documents(spark, sf_dir), file, public_tokenizers.PATTERN, fields=("source", "text"), rule="first")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_one_permutation_minhash": op1_one_permutation_minhash,
    "op2_personal_data": op2_personal_data,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_fair_mix": op4_fair_mix,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_bpe_chunks": op7_bpe_chunks,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_turn_repair": op11_turn_repair,
    "op12_turn_trie": op12_turn_trie,
    "op13_best_fit_packing": op13_best_fit_packing,
}



def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit: 0xEDB88320 is the reflected polynomial."""
    bits = f"[((ascii({text}[i // 8 + 1]) >> (i % 8)::INT) & 1)::UBIGINT for i in range(8 * len({text}))]"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {bits}), lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END), 4294967295::UBIGINT)"


def _least_with_inserts(of: str) -> str:
    """The better of each grammar state's own way and one more insertion before the ways `of`."""
    way = f"{{'c': 2 + {of}[nx[g]].c, 'a': 'I' || {of}[nx[g]].a, 'r': chr(10) || nm[g] || ':' || {of}[nx[g]].r}}"
    return f"[CASE WHEN {way} < b[g] THEN {way} ELSE b[g] END for g in [1, 2, 3, 4]]"


ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op4_fair_mix": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS turn
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM d GROUP BY source
        ), r AS (
            SELECT *, 3 * source_size / weight AS ratio FROM s
        ), c AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))::DOUBLE
                      / sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM r
        ), l AS (
            SELECT min_by(level, ratio) AS level FROM c WHERE level <= ratio
        ), t AS (
            SELECT source, source_size, least(l.level * weight, 3.0::DOUBLE * source_size) AS target FROM s, l
        ), q AS (
            SELECT d.doc_id, d.source, d.size, d.turn, t.source_size, t.target,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
                   row_number() OVER () AS row
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), u AS (
            SELECT *, CASE WHEN target > 0 THEN (upto + use * source_size)::DOUBLE / target END AS finish
            FROM q, (SELECT unnest([0, 1, 2]) AS use)
        ), g AS (
            SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, use, turn, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS served,
                   sum(size) OVER ()::BIGINT // 3 AS budget
            FROM u
        )
        SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
               (sum(CASE WHEN 2 * served - size <= 2 * budget THEN size ELSE 0 END))::BIGINT AS taken, min(finish) AS first_finish
        FROM g GROUP BY row, doc_id
    """,
    # cheapest edits from the last turn to the first: a list of four states' cost, audit and repaired text
    "op11_turn_repair": f"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
            FROM conversations
        ), fated AS (
            SELECT *, {_crc32_sql("key")} % 20 AS fate FROM k
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM fated WHERE fate <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text), copy) AS n FROM damaged
        ), flags AS (
            SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
                   NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
                   left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
            FROM placed
        ), stats AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                   count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
                   count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns
            FROM flags GROUP BY conv_id
        ), steps AS (
            SELECT conv_id, turns AS n, [{{'c': 0, 'a': '', 'r': ''}}, {{'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}},
                                         {{'c': 2, 'a': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 'r': ''}}] AS m,
                   [3, 3, 4, 3] AS nx, ['user', 'user', 'assistant', 'user'] AS nm
            FROM stats
            UNION ALL
            SELECT conv_id, n, {_least_with_inserts("m2")} AS m, nx, nm FROM (
                SELECT *, {_least_with_inserts("m1")} AS m2 FROM (
                    SELECT *, {_least_with_inserts("b")} AS m1 FROM (
                        SELECT conv_id, n, nx, nm, [list_sort(list_filter([
                            {{'c': 3 + m[g].c, 'a': 'D' || m[g].a, 'r': m[g].r}},
                            CASE WHEN goes[g] > 0 AND NOT lost THEN {{'c': cut + m[goes[g]].c, 'a': 'K' || m[goes[g]].a, 'r': chr(10) || role || ':' || text || m[goes[g]].r}} END,
                            CASE WHEN NOT lost THEN {{'c': 2 + cut + m[nx[g]].c, 'a': 'R' || m[nx[g]].a, 'r': chr(10) || nm[g] || ':' || text || m[nx[g]].r}} END
                        ], lambda w: w IS NOT NULL))[1] for g in [1, 2, 3, 4]] AS b
                        FROM (
                            SELECT s.conv_id, s.n - 1 AS n, s.m, s.nx, s.nm, f.role, f.text, f.blank OR f.again AS lost, f.cut::INT AS cut,
                                   CASE f.i WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS goes
                            FROM steps s JOIN flags f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n
                        )
                    )
                )
            )
        ), best AS (
            SELECT conv_id, m[1].c AS cost, m[1].a AS audit, m[1].r AS repaired FROM steps WHERE n = 0
        )
        SELECT o.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
               coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
               coalesce(b.audit, '') AS audit, sha256(coalesce(b.repaired[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op12_turn_trie": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text)[:32]) AS place FROM t
        ), h AS (
            SELECT conv_id, conv_id - conv_id % 100 AS block, {_crc32_sql("(conv_id::VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
        ), turns AS (
            SELECT h.conv_id, 0 AS own, place, role, text FROM h JOIN placed p ON p.conv_id = h.block WHERE place <= h
            UNION ALL
            SELECT h.conv_id, 1, place, role, text FROM h JOIN placed p ON p.conv_id = h.conv_id WHERE place > h
        ), rebuilt AS (
            SELECT h.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY own, place) FILTER (place IS NOT NULL), []) AS turns
            FROM h LEFT JOIN turns t ON t.conv_id = h.conv_id GROUP BY h.conv_id
        ), members AS (
            SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
        ), nodes AS (
            SELECT turns[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
            FROM members GROUP BY 1, 2
        ), children AS (
            SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
        ), full_ AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node
        ), above AS (
            SELECT node[1:up] AS node, count(*) FILTER (n_children = 0) AS n_leaves,
                   sum(CASE WHEN depth > 0 THEN (n_convs - 1) * len(node[depth].text) ELSE 0 END)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM full_) GROUP BY 1
        )
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends_sha256
        FROM full_ f JOIN above a ON a.node = f.node LEFT JOIN full_ p ON f.depth > 0 AND p.node = f.node[1:f.depth - 1]
    """,
}

"""The registered queries of this subpackage and the DuckDB SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, kdtree, licenses, mixing, pii, sharding, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op3_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_components(_read(spark, sf_dir, "documents"))


def op6_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_read(spark, sf_dir, "embeddings"))


def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_read(spark, sf_dir, "documents"))


def op10_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(turns.unionByName(extra))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_suffix_decontamination, op2_pii_bilstm_crf, op3_warc_chunk_table, op4_differencing_shards, op5_simhash_trie, op6_kdtree_top_k, op7_lexicon_toxicity, op8_pfair_mix, op9_license_compression, op10_chat_round_trip, pipeline)
    return {f.__name__: f for f in ops}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_decontamination": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
            bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS ip FROM b),
            bw AS (SELECT item_id, n, ip, array_to_string(w[ip:ip + n - 1], ' ') AS g FROM bp),
            sizes AS (SELECT DISTINCT n FROM bw),
            dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
            dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
            h AS (SELECT doc_id, p, n, item_id, ip FROM dg JOIN bw USING (n, g)),
            runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - ip ORDER BY p) AS run FROM h),
            m AS (SELECT doc_id, item_id, min(p) - 1 AS dw, min(ip) - 1 AS iw, count(*) + any_value(n) - 1 AS size FROM runs GROUP BY doc_id, item_id, p - ip, run),
            longest AS (SELECT doc_id, max(size) AS longest, string_agg(concat_ws(':', item_id, dw, iw, size), ',' ORDER BY dw, iw, item_id::VARCHAR) AS places FROM m GROUP BY doc_id),
            hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
            hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match, coalesce(places, '') AS places
            FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN longest USING (doc_id)""",
        "op3_warc_chunk_table": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            h AS (SELECT page_id, strlen(body) AS size, sha1(body) AS x FROM p),
            r AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS response FROM h)
            SELECT page_id, size::BIGINT AS payload_bytes,
                   array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
                   CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> response THEN response END AS refers_to
            FROM r""",
        "op6_kdtree_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
            SELECT query_id, rank::INTEGER AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
        "op10_chat_round_trip": r"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
            m AS (SELECT *, len(text) + (len(text) - len(replace(text, '\', ''))) + (len(text) - len(replace(text, '</turn>', ''))) // 7 + (len(text) - len(replace(text, '### ', ''))) // 4 AS body FROM t)
            SELECT conv_id, count(*)::BIGINT AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
                   sum(4 + len(role) + 2 + body + 8)::BIGINT AS formatted_chars
            FROM m GROUP BY conv_id""",
    }

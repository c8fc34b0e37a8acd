"""One registered query per operator, over its whole table with the parameters meant for production."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, licenses, lines, merkle, neardup, packing, pieces, ppm, quality, rules, sharding, spelling, substrings

VOCABULARY = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def word_tokenizer() -> str:
    """Path of the vocabulary that packing counts in."""
    named = os.environ.get("WORD_TOKENIZER")
    if named is None:
        import public_tokenizers

        named = public_tokenizers.path("word_bpe_49k.json")
    return named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_license_scan(spark, sf_dir):
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    """Lines of every length that have a word are compared."""
    return lines.line_report(documents(spark, sf_dir), least=1)


def op3_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir))


def op4_byte_shards(spark, sf_dir):
    return sharding.shard_by_bytes(documents(spark, sf_dir))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark, sf_dir):
    return substrings.dedup_substrings(documents(spark, sf_dir))


def op7_quality_classifier(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_ppm_scores(spark, sf_dir):
    return ppm.score_texts(documents(spark, sf_dir))


def op9_quality_rules(spark, sf_dir):
    judged = rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed")


def op10_sentencepiece(spark, sf_dir):
    """Ids of every text, and whether they decode to it."""
    words = pieces.Vocabulary.load(VOCABULARY)
    coded = pieces.decode(pieces.encode(documents(spark, sf_dir).select("doc_id", "text"), words), words)
    return coded.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.group_variants(documents(spark, sf_dir))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.Manifest(documents(spark, sf_dir)).proofs()


def op13_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), word_tokenizer())


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_line_dedup, op3_near_duplicates, op4_byte_shards, op5_benchmark_decontamination,
        op6_substring_dedup, op7_quality_classifier, op8_ppm_scores, op9_quality_rules, op10_sentencepiece,
        op11_spelling_variants, op12_merkle_manifest, op13_best_fit_packing, pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op4_byte_shards": r"""
        WITH RECURSIVE crc(v, i, c) AS (  -- the byte table of crc32
            SELECT v, 0, v FROM range(256) t(v)
            UNION ALL
            SELECT v, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE i < 8
        ),
        lookup AS MATERIALIZED (SELECT list(c ORDER BY v) AS t FROM crc WHERE i = 8),
        raw AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
            FROM documents
        ),
        rows AS (
            SELECT doc_id, size,
                xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32
            FROM raw, lookup
        ),
        line AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS whole FROM rows
        ),
        cut AS (SELECT *, (((2 * upto - size) * 8) // (2 * whole))::INTEGER AS shard FROM line)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
        FROM cut
    """,
    "op9_quality_rules": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM documents
        ),
        places AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM texts),
        threes AS (
            SELECT doc_id, i, a, lead(a, 1) OVER in_order AS b, lead(a, 2) OVER in_order AS c
            FROM places WINDOW in_order AS (PARTITION BY doc_id ORDER BY i)
        ),
        hits AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS hit FROM threes),
        covers AS (
            SELECT doc_id, hit OR lag(hit, 1, false) OVER in_order OR lag(hit, 2, false) OVER in_order AS covered
            FROM hits WINDOW in_order AS (PARTITION BY doc_id ORDER BY i)
        ),
        repeats AS (SELECT doc_id, count(*) FILTER (covered) AS n FROM covers GROUP BY doc_id),
        counts AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
            FROM texts LEFT JOIN repeats USING (doc_id)
        ),
        judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END
                + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
                + CASE WHEN word_chars > 15 * n_words THEN 64 ELSE 0 END AS failed
            FROM counts
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 AS kept, n_lines, failed::BIGINT AS failed
        FROM judged
    """,
}

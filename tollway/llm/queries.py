"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollway.llm import align, bpe, decontaminate, main_text, orc_tokens, phrases, pii, ppm, quality, simhash, suffix_dedup, toxicity, warc_zip
from tollway.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Key of the pseudonyms in registered queries; a job passes its own.
DEMO_KEY = "registered-query"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def page_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.write_and_read(table(spark, sf_dir, "pages"))


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.write_and_read(table(spark, sf_dir, "documents"), vocabulary_path())


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents"))


def benchmark_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.scores(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_feistel_pseudonyms": pseudonyms,
    "op2_rank_array_bpe": bpe_round_trip,
    "op3_warc_in_zip": page_archives,
    "op4_distribution_divergence": divergence,
    "op5_suffix_repeats": repeated_strings,
    "op6_orc_tokens": orc_ids,
    "op7_ppm_scores": model_scores,
    "op8_weak_supervision": toxicity_scores,
    "op9_simhash_tiles": near_copies,
    "op10_benchmark_alignment": benchmark_copies,
    "op11_phrase_stripes": phrase_stripes,
    "op12_merge_path_alignment": token_alignment,
    "op13_text_density": page_texts,
}

ORACLES: dict[str, str] = {
    "op3_warc_in_zip": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        sized AS (
            SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
                   min(page_id) OVER (PARTITION BY payload) AS first_id
            FROM payloads)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM sized""",
    "op11_phrase_stripes": r"""
        WITH lowered AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        totals AS (SELECT lang, sum(len(words)) AS n FROM lists GROUP BY lang),
        sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
        occurrences AS (
            SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i : array_to_string(words[i : i + m - 1], ' '))) AS phrase
            FROM lists, sizes WHERE len(words) >= m),
        counts AS (SELECT lang, m, phrase, count(*) AS f FROM occurrences GROUP BY lang, m, phrase HAVING count(*) >= 30),
        candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS words, f AS a FROM counts WHERE m > 1),
        inner_sizes AS (SELECT unnest([2, 3]) AS size),
        inner_phrases AS (
            SELECT lang, a, unnest(list_transform(range(1, m - size + 2), lambda i : array_to_string(words[i : i + size - 1], ' '))) AS phrase
            FROM candidates, inner_sizes WHERE size < m),
        dropped AS (
            SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_phrases i ON c.lang = i.lang AND c.phrase = i.phrase
            WHERE 100 * i.a >= 80 * c.a),
        free AS (SELECT c.* FROM candidates c ANTI JOIN dropped d ON c.lang = d.lang AND c.phrase = d.phrase),
        cuts AS (
            SELECT lang, phrase, m, a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 : m], ' ') AS rest
            FROM (SELECT *, unnest(range(1, m)) AS k FROM free)),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, r.f AS r,
                   CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(h.f AS HUGEINT) + r.f) AS BIGINT) AS score
            FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
               CAST(n AS BIGINT) AS n, score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}

"""The registered corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, anchors, arrowfile, importance, langid, mixing, neardup, packing, quality, rules, sharding, tokencount, topk
from .tokens import public_path

SEQUENCE, END_ID = 1024, 2


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(_documents(spark, sf_dir), public_path("byte_bpe_50k.json"), END_ID, SEQUENCE)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "n_langs")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.exact_top_k(vectors, "vec_id", "embedding", F.col("id") % 50 == 0, k=5, scale=256)


def op6_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = arrowfile.round_trip(_documents(spark, sf_dir), public_path("word_bpe_49k.json"), END_ID, SEQUENCE)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_documents(_documents(spark, sf_dir), public_path("word_bpe_49k.json"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = anchors.remove_repeats(_documents(spark, sf_dir), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance.resample(_documents(spark, sf_dir), target, percent=10, min_words=20, seed=2024, buckets=10_000, low=1, high=1)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_documents(_documents(spark, sf_dir), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select("doc_id", *alignment.SUMS, digest.alias("groups_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_mix_sources,
        op3_language_mixture,
        op4_near_duplicates,
        op5_exact_top_k,
        op6_arrow_files,
        op7_token_counts,
        op8_quality_classifier,
        op9_quality_rules,
        op10_kd_sharding,
        op11_anchor_dedup,
        op12_importance_resampling,
        op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM w
        ), sizes AS (SELECT doc_id, len(s) AS n FROM s),
        flat AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common >= 85 * (x.n + y.n - common)
        ), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT a AS id, b AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other
        ), low AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
        SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
        FROM sizes LEFT JOIN low ON id = doc_id
    """,
    "op5_exact_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_anchor_dedup": r"""
        WITH w AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w)
        ), judged AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS repeated FROM windows),
        gone AS (
            SELECT r, list(DISTINCT k) AS k FROM (SELECT r, unnest(range(i, i + 13)) AS k FROM judged WHERE repeated) GROUP BY r
        ), kept AS (
            SELECT doc_id, len(w) AS n, CASE WHEN k IS NULL THEN w
                ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(k, i)), lambda i: w[i]) END AS kept
            FROM w LEFT JOIN gone USING (r)
        )
        SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept
    """,
    "op12_importance_resampling": r"""
        WITH bits AS (
            -- the reflected polynomial of crc32, a byte at a time
            SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS steps
            FROM (SELECT unnest(range(256)) AS i)
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f
            FROM benchmark
        ), f AS (SELECT r, unnest(w) AS f FROM d),
        entries AS (
            SELECT f, hex(encode(f)) AS x, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t
            FROM (SELECT f, false AS target FROM f UNION ALL SELECT f, true FROM b) GROUP BY f
        ), hashed AS (
            SELECT f, s, t, xor(4294967295, list_reduce(
                list_concat([4294967295], list_transform(range(len(x) // 2), lambda k: CAST('0x' || x[2 * k + 1:2 * k + 2] AS BIGINT))),
                lambda c, y: xor(c // 256, bits.steps[CAST(xor(c, y) % 256 AS INTEGER) + 1]))) % 10000 AS bucket
            FROM entries, bits
        ), buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000)
                / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
            FROM buckets
        ), weights AS (
            SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r
        ), scored AS (
            SELECT r, doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
            FROM d LEFT JOIN weights USING (r)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (WHERE n >= 20) OVER () AS eligible FROM scored
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND k <= 10 * eligible // 100 THEN k END AS rank FROM ranked
    """,
}

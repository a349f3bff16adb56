"""One query for each operator of this package, over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, langid, mixing, pii, quality, simhash, spm, substring_dedup, topk, warc
from .common import table


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept_text")).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))

    def joined(condition: Callable[[Column], Column] | None = None) -> Column:
        spans = F.filter("spans", condition) if condition else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) AS long) AS n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, _sha256(joined(lambda s: s["kind"].isin(*pii.BASE))).alias("base_sha256"), joined().alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, quality.train_labels(table(spark, sf_dir, "labels")))
    return quality.score(docs, trees).select("doc_id", (langid.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(langid.train_rows(docs))
    return langid.identify(docs, model).select("doc_id", (langid.remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm.encode(table(spark, sf_dir, "documents"), spm.read_model(), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), _sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_mixing, op4_pii, op5_quality, op6_top_k, op7_simhash, op8_embedding_dedup, op9_language_id, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": """
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
            g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) i, w FROM d),
            h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) h FROM g),
            f AS (SELECT h, min(doc_id) f FROM h GROUP BY h),
            hit AS (SELECT h.doc_id, i FROM h JOIN f USING (h) WHERE f < doc_id),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) p FROM hit),
            r AS (SELECT doc_id, list(p) p FROM gone GROUP BY doc_id)
            SELECT doc_id, len(w)::BIGINT n_words, coalesce(len(p), 0)::BIGINT n_removed,
              sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ')
                ELSE coalesce(array_to_string([x for x, k in w if NOT list_contains(p, k)], ' '), '') END) kept_sha256
            FROM d LEFT JOIN r USING (doc_id)""",
        "op3_mixing": """
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT size,
                md5(concat_ws(' ', doc_id::VARCHAR, text)) h FROM documents),
            s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
            r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE weight, 2.0::DOUBLE * source_size cap,
                [1.0, 0.5, 1.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE a, [1.0, 1.5, 0.5][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE b,
                row_number() OVER (ORDER BY source NULLS LAST) k FROM s),
            l AS (SELECT *, cap / weight fill, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) level
                FROM r WINDOW b AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            t AS (SELECT source, source_size, a, b, least(cap, coalesce((SELECT level FROM l WHERE level < fill ORDER BY fill, k LIMIT 1) * weight, cap)) target FROM l),
            p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) place FROM d)
            SELECT doc_id, size, source_size, target,
              (least(size, greatest(0, floor(target)::BIGINT - place)) + least(size, greatest(0, floor(target)::BIGINT - source_size - place)))::BIGINT taken,
              CASE WHEN size > 0 AND place < floor(target)::BIGINT THEN CASE WHEN a = b THEN place / target
                ELSE (sqrt(a * a + 2 * (b - a) * (place / target) * (a + (b - a) / 2)) - a) / (b - a) END END "position"
            FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source""",
        "op6_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) e FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS "rank" FROM s)
            SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10""",
    }

"""The queries opN_<name>: each applies one operator, with production parameters, to the whole of its table."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import decontaminate, language, lm, mixing, quality, secrets, warc, whitening
from sentrylake.llm.bpe_count import count_tokens
from sentrylake.llm.exact_dedup import DigestIndex, buckets_for, deduplicate
from sentrylake.llm.near_join import near_components
from sentrylake.llm.sharding import uniform_shards
from sentrylake.llm.variants import spelling_variants
from sentrylake.work import drop, drop_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digested(row: Column) -> Column:
    size = (F.coalesce(F.octet_length(row["text"]), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(row["text"], F.lit("")).cast("binary"))
    return F.struct(row["doc_id"].alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), row["shard"].alias("shard"), row["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = uniform_shards(_table(spark, sf_dir, "documents"), 40)
    # digests of whole rows, so that no column of a document is pruned before the exchanges
    row = F.transform(F.array(F.struct(*put.columns)), _digested)[0]
    return put.select(row.alias("row")).select("row.*")


def op2_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trie = lm.fit(docs.where(lm.training(F.col("doc_id"))))
    found = lm.scored(docs, trie)
    return found.select("doc_id", (~lm.training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", F.col("trigram_score").alias("score"), F.col("score").alias("pair_score"))


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model).drop("text")
    return found.select("doc_id", F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.KEPT).cast("int").alias("predicted"))


def op4_string_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it covers to half or more; clean documents have none."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def op5_script_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identified(docs.select("doc_id", "text"), language.fit(docs), spans=True)
    return found.select("doc_id", F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op6_min_cost_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    members = mixing.by_source(docs)
    found = mixing.mixed(docs, mixing.plan_mix(docs, members, mixing.weighted_targets), members)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x["kind"] == kind, x["kind"])


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.array_compact(F.transform("base", _is(kind)))).cast("long").alias(f"n_{kind}") for kind, *_ in secrets.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op9_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = DigestIndex(spark, buckets=buckets_for(docs.count()))
    found = deduplicate(docs, index)
    index.drop()  # the answer is settled, and no later batch comes
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    found = whitening.whitened(vectors, model)
    error = whitening.identity_error(found, len(model.components))
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)).cast("array<double>")
    each = found.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_loser_tree_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no times of capture, so a page's number stands for its second."""
    pages = _table(spark, sf_dir, "pages")
    path, runs = warc.archived(pages, F.timestamp_seconds(F.col("page_id")))
    drop_path(spark, path)  # the index has all that the result needs
    found = warc.merged(runs)
    drop(runs)
    return found.select(F.col("record").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", "nth", "position")


def op13_rare_qgram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hypergeometric_shards,
        op2_elias_fano_lm,
        op3_subword_quality,
        op4_string_tiling_decontamination,
        op5_script_viterbi_language,
        op6_min_cost_flow_mix,
        op7_bpe_token_counts,
        op8_entropy_secrets,
        op9_digest_index_dedup,
        op10_parity_sketch_join,
        op11_tsqr_whitening,
        op12_loser_tree_warc,
        op13_rare_qgram_variants,
    )
}

ORACLES = {
    "op9_digest_index_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op12_loser_tree_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, lower(coalesce(url, '')) AS u FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h,
                     regexp_extract(u, '^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/?#]*@)?(?:www\.)?([^/?#]*)', 1) AS host,
                     regexp_extract(u, '^(?:[a-z][a-z0-9+.\-]*://)?[^/?#]*([^#]*)', 1) AS rest FROM p),
        k AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest AS url_key FROM d)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to,
               url_key, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS nth,
               row_number() OVER (ORDER BY url_key, page_id) - 1 AS position
        FROM k""",
}

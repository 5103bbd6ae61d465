"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, chat, language, mixing, neighbours, quality, repeats, secrets, sharding, simhash, spelling, urls, whitening
from .components import stored
from .text import word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 by row counts at most one apart. Groups of equal texts are not kept together: with
    that law a group may be larger than a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.interleaved_shards(rows, 24, tie=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op4_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact: the pruning factor is one."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, factor=1.0)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled_strings(docs))
    found = docs.select("doc_id", secrets.spans_of(model, F.col("text")).alias("spans"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        number("markov"))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def encoded(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of the ids of every text and of the text they decode to."""
    _, _, both = bpe.codec_functions(spark, path)
    both = docs.select("doc_id", both(F.col("text")).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(_table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mixing.mix(sizes)[0].select("doc_id", "size", "source_size", "target", "taken", "source", "n_slots", "first_step")


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.identify(model, F.col("text")).alias("found"))
    listed = F.transform("found.spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"]))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.switches",
                        F.array_join(listed, ",").alias("spans"))


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)


def op12_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), keep=("page_id",))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose hash is a multiple of 97 loses one code point; a NULL doc_id hashes as ``null``."""
    docs = _table(spark, sf_dir, "documents")
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"),
                      F.explode(spelling.runs(F.col("text"))).alias("run")).where(F.length("run") >= 5)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))).otherwise(
        F.col("run"))
    counted = run.select(word.alias("word")).where(F.length("word") >= 5).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.variants(counted.where("n >= 3"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_interleaved_shards, op2_quality_rules, op3_simhash_dedup, op4_vantage_neighbours,
        op5_secret_scan, op6_repeated_strings, op7_bpe_codec, op8_source_mix,
        op9_language_spans, op10_chat_perspectives, op11_whitened_embeddings, op12_url_verdicts, op13_spelling_variants,
    )
}

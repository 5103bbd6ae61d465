"""The stages of the corpus pipeline: each applies one operator and lets its decisions take effect.

All take documents (doc_id, text, lang, source, n_chars). A NULL or empty text, a NULL in any other column, repeated
rows and an empty table are handled as the operators' docstrings say; further columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import mixing, quality, secrets, simhash
from .components import stored
from .queries import encoded
from .text import word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    packed = docs.select("text", F.struct(*docs.columns).alias("__doc"))  # whatever other columns are called
    return quality.judge(packed).where("kept").select("__doc.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id."""
    return simhash.without_near_duplicates(docs, shingle=4, distance=4)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of every secret; ``n_chars`` follows where a text changes."""
    model = secrets.train(secrets.labelled_strings(docs))
    clean = docs.withColumn("__text", secrets.cleaned(model, F.col("text")))
    changed = F.col("__text").isNotNull()
    return clean.withColumns({
        "n_chars": F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars")),
        "text": F.coalesce("__text", "text")}).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row for every time it takes the whole text, and, where it takes
    a part, a row with that many words from the start. Documents that the mix does not take, and
    those without words, have no row; ``n_chars`` follows where a text is cut."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    sizes = stored(rows.select("__row", "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    taken = mixing.mix(sizes)[0].where("taken > 0").select("__row", "size", "taken")
    part = F.expr("taken % size")
    turns = taken.select("__row", F.explode(F.concat(
        F.array_repeat(F.lit(0), F.expr("cast(taken div size as int)")),
        F.when(part > 0, F.array(part.cast("int"))).otherwise(F.array().cast("array<int>")))).alias("__words"))
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # after every word
    cut = F.array_join(F.slice(ends, 1, F.col("__words")), "")
    out = rows.join(turns, "__row").withColumn("__text", F.when(F.col("__words") > 0, cut).otherwise(F.col("text")))
    return out.withColumns({
        "n_chars": F.when(F.col("__words") > 0, F.length("__text").cast("long")).otherwise(F.col("n_chars")),
        "text": F.col("__text")}).select(*docs.columns)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to."""
    return encoded(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))

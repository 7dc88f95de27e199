"""The corpus pipeline: quality, near copies, secrets, mixture, packing.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import minhash, mixing, packing, quality, secrets, tokens
from tapeline.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits over the threshold, in all, that a document must have to go.
EVIDENCE = 32


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text rejects go; null and empty texts stay, repeated rows stay or go together.

    A few odd letters do not remove a short one: it goes if it exceeds its threshold by ``EVIDENCE`` bits in all.
    """
    docs = docs.select(COLUMNS)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    found = quality.judged(docs, trusted, "doc_id", "text", "lang")
    # A rejected row is named by id, language and text, so that rows of one id, or of none, are told apart.
    rejected = found.filter(~F.col("kept") & ((F.col("bits_per_byte") - F.col("threshold")) * F.col("n_bytes") >= EVIDENCE)).select(F.col("log_id").alias("i"), F.col("lang").alias("l"), F.col("message_hash").alias("h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("lang").eqNullSafe(F.col("l")) & (F.xxhash64("text") == F.col("h"))
    return docs.join(rejected, same, "left_anti").select(COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, on five-word shingles at 0.8: the one with the smallest id.

    Of rows that repeat id and text one stays; rows without an id stay, and those with null or empty texts.
    """
    docs = docs.select(COLUMNS)
    found = minhash.near_copies(docs, "doc_id", "text", k=5, percent=80).filter("log_id is not null")
    dropped = found.filter("not kept").select(F.col("log_id").alias("doc_id"), "message_hash").distinct()
    repeated = materialize(found.filter("kept").groupBy("log_id", "message_hash").count().filter("count > 1").select(F.col("log_id").alias("doc_id"), "message_hash"))
    keyed = docs.withColumn("message_hash", F.xxhash64("text"))
    key = ["doc_id", "message_hash"]
    once = keyed.join(dropped.unionByName(repeated), key, "left_anti").select(COLUMNS)
    return once.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates(key).select(COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that only one source has are masked; widely copied examples stay as they are.

    Only documents with a span are joined; the others pass as they are, null and empty texts too.  Repeated rows are
    masked alike.
    """
    docs = docs.select(COLUMNS)
    found = secrets.scan(docs, "doc_id", "text", "source", "source").filter(F.size("live") > 0)
    live = materialize(found.select(F.col("log_id").alias("i"), F.xxhash64("base").alias("b"), "live").dropDuplicates(["i", "b"]))
    spanned = docs.withColumn("base", secrets.base_spans(F.coalesce("text", F.lit(""))))
    plain = spanned.filter(F.size("base") == 0).select(COLUMNS)
    held = spanned.filter(F.size("base") > 0).withColumn("b0", F.xxhash64("base")).join(live, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("b0") == F.col("b")), "left")
    masked = F.when(F.col("live").isNotNull(), secrets.masked(F.col("text"), F.col("live"))).otherwise(F.col("text"))
    held = held.withColumn("masked", masked)
    length = F.when(F.col("live").isNotNull(), F.length("masked").cast("bigint")).otherwise(F.col("n_chars"))
    return plain.unionByName(held.select("doc_id", F.col("masked").alias("text"), "lang", "source", length.alias("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares of the characters, in random order.

    Null and empty texts are drawn like others; a source without characters stays once; repeated rows get the same
    number of copies; rows without an id are drawn by their text.
    """
    return mixing.replicate(docs.select(COLUMNS), sample_id="doc_id", source="source", size="n_chars", told_by="text").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048; null and empty texts are one piece of one token, repeated rows are packed each."""
    pieces = materialize(tokens.token_pieces(docs, "word_bpe_49k.json", "doc_id", "text"))
    episodes = pieces.select(F.col("log_id").alias("trade_id"), F.struct("piece", "start", "ids_crc32").alias("part"), F.col("length").alias("bars_held"))
    packed = packing.pack_episodes(episodes, capacity=2048)
    return packed.select(F.col("trade_id").alias("doc_id"), "part.piece", "part.start", F.col("bars_held").alias("length"), "part.ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near copies", near_copy_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL states neither the perplexities nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

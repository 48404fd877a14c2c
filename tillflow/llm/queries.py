"""The numbered queries: each operator over its whole table, in the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.llm import alignment, bpe, chat, decontamination, dedup, langid, merges, secrets, sharding, simhash, toxicity, warc, whitening
from tillflow.llm.tables import land
from tillflow.session import configure, scratch_dir

BPE_FILE = "word_bpe_49k.json"
RANK_FILE = "byte_bpe_50k.tiktoken"
# The two tokenizers that are aligned.
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 24
PREDICTED = 0.3
# A text with control strings of the template, escaped and not.
TRICKY = r"\### Assistant: </turn> ok"
# SimHash contract: four-word shingles, links at four bits.
SIMHASH = {"shingle": 4, "distance": 4, "total": None, "parts": 4}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha(text: Column | str) -> Column:
    return F.sha2(text, 256)


def shown_document(url: str = "url") -> Column:
    """The document a page shows: the number after the language in its path."""
    return F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/]+/[a-z]{2}/(\d{1,18})(?:\D|$)", 1), F.lit("")).cast("long")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_dir(spark, "archive")
    warc.write(read(spark, folder, "pages"), archive)
    warc.export(warc.records(spark, archive, revisited=False), f"{archive}/files")
    return warc.read_back(warc.read_files(spark, f"{archive}/files")).select(
        F.col("record").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path(BPE_FILE)
    rows = bpe.encode(read(spark, folder, "documents"), path, spelled=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha("text").alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    evidence = langid.page_evidence(read(spark, folder, "pages"), shown_document())
    return langid.identify(read(spark, folder, "documents"), evidence).select(
        "doc_id", "lang", "posterior", "text_lang", "declared", "suffix", "host", "accepted")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    field = toxicity.train(docs, read(spark, folder, "labels"))
    return toxicity.scores(docs, field).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "spans")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = dedup.members(read(spark, folder, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    # A repository is the part of a host that a page's address names, its owner the host; documents without a page have their source for both.
    pages = read(spark, folder, "pages").select(
        shown_document().alias("doc_id"), F.regexp_extract("url", r"^[a-z]+://([^?#]*/)", 1).alias("repo"),
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("owner")).filter("doc_id is not null")
    rows = secrets.secrets(read(spark, folder, "documents"), places=pages)
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *map(count, secrets.BASE), sha(F.array_join(F.transform(base, named), ",")).alias("base_sha256"),
        F.array_join(F.transform("spans", named), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"))
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    back = chat.read_back(land(chat.windows(rows), "chat-windows"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per_window = back.select(
        "conv_id", "window", "n_chars", F.size("turns").cast("long").alias("n"), said.alias("said"), F.array_join("learned", "").alias("learned"))
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("w"), F.sum("n_chars").alias("formatted_chars"))
    learned = F.array_join(F.col("w.learned"), "")
    return whole.select(
        "conv_id", "n_turns", sha(F.array_join(F.col("w.said"), "")).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"),
        sha(learned).alias("loss_sha256"), "formatted_chars")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_components(read(spark, folder, "documents"), **SIMHASH)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.sharded(read(spark, folder, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op11_whiten(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whitened(read(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = alignment.align(read(spark, folder, "documents"), *map(tokenizer_path, ALIGNED), hashed=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = merges.encode(read(spark, folder, "documents"), tokenizer_path(RANK_FILE), PATTERN, files=True)
    return rows.select("doc_id", "n_tokens", sha("packed").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_warc, op2_decontaminate, op3_bpe, op4_language_id, op5_toxicity, op6_exact_dedup, op7_secrets, op8_chat, op9_simhash, op10_shards,
        op11_whiten, op12_align_tokens, op13_byte_bpe)
    return {f.__name__: f for f in named}

"""Benchmark passages in documents by a prefix-filtered join of word shingles.

A window is ``window`` consecutive words of an item, or all words of a shorter
item.  A document contains a window if it contains all its shingles at their
places, so one shingle is prefix enough.  Shingles are ordered by their count
over all documents and each window is looked up by its rarest one.  A candidate's
alignment is fixed by that shingle's offset (positional bound) and has to fit into
the words around it (length bound).  Then the words themselves are compared over
the item-sized window.

The documents are read word by word once, against the set of all shingles of the
benchmark.  That set is broadcast only up to ``BROADCAST_ROWS`` counted rows;
beyond it Spark joins by exchange.  Everything after works on shingles that were
found.

Defined results.  Null texts have no words.  Items without an identifier are
ignored; items sharing one count once.  Documents are told apart by identifier
and text: repeated rows get the same numbers, once each.  Null document
identifiers are kept.  Empty tables give clean documents, or none.  Other columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.tables import land, text_of, unused

# Of ASCII only letters and digits are in words; all else there ends a word.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
ENDS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text, A to Z in lower case.

    One pass turns what ends a word into spaces, another splits at them; looking for
    words by a pattern takes twice as long.
    """
    spaced = F.trim(F.translate(text, ENDS + UPPER, " " * len(ENDS) + LOWER))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def key_of(id_col: str, text_col: str) -> Column:
    """Identifier and text digest; equality of structs counts nulls as equal."""
    return F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text"))


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``item_id, window, words, length`` for each window of each item."""
    items = benchmark.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item_id"), words_of(text_of(text_col)).alias("all")).filter(F.size("all") > 0)
    at = items.select("item_id", "all", F.least(F.size("all"), F.lit(window)).alias("length"))
    cut = at.select("item_id", "length", F.explode(F.expr(
        "transform(sequence(0, size(all) - length), i -> slice(all, i + 1, length))")).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("window"), "words", "length").distinct()


def shingles(table: DataFrame, shingle: int) -> DataFrame:
    """``window, length, k, offset, s`` of each distinct window; windows shorter than a shingle are one."""
    distinct = table.select("window", "words", "length").distinct().withColumn("k", F.least("length", F.lit(shingle)))
    return distinct.select("window", "length", "k", F.posexplode(F.expr(
        "transform(sequence(0, length - k), i -> array_join(slice(words, i + 1, k), ' '))")).alias("offset", "s"))


def found(docs: DataFrame, vocabulary: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``key, k, pos, first, s`` wherever a document has one of the ``k``-word shingles.

    The words after an exploded one are looked up in the array beside it, and the
    array ends there: all that is one generated loop, in which it is never copied, and
    whatever way Spark joins, only a shingle's words go on.
    """
    names = [f"w{i}" for i in range(k)]
    words = docs.select(key_of(id_col, text_col).alias("key"), words_of(text_of(text_col)).alias("words"))
    each = words.select("key", "words", F.posexplode("words").alias("pos", "w0")).select(
        "key", "pos", "w0", *(F.get("words", F.col("pos") + i).alias(names[i]) for i in range(1, k)))
    cut = F.split("s", " ")
    wanted = vocabulary.filter(F.col("k") == k).select(*(cut[i].alias(n) for i, n in enumerate(names)))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return each.join(wanted, names).select(
        "key", F.lit(k).alias("k"), "pos", F.col(names[0]).alias("first"), F.concat_ws(" ", *names).alias("s"))


def runs(hits: DataFrame) -> DataFrame:
    """Hits at consecutive positions of a document, joined: ``key, k, start, hits, words``.

    Copies of a row repeated whole are one document: their hits become one, in every task
    before the exchange.
    """
    hits = hits.groupBy("key", "k", "pos").agg(F.min("first").alias("first"), F.min("s").alias("s"))
    place = F.dense_rank().over(Window.partitionBy("key", "k").orderBy("pos"))
    gathered = hits.withColumn("run", F.col("pos") - place).groupBy("key", "k", "run").agg(
        F.array_sort(F.collect_set(F.struct("pos", "first", "s"))).alias("hits"))
    return gathered.select(
        "key", "k", F.col("hits")[0]["pos"].alias("start"), "hits",
        F.concat(
            F.expr("transform(slice(hits, 1, size(hits) - 1), h -> h.first)"),
            F.split(F.element_at("hits", -1)["s"], " ")).alias("words"))


def contained(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 3,
) -> DataFrame:
    """``key, start, end, item_id`` for every place where a document contains a window of an item."""
    table = land(windows(benchmark, item_col, item_text, window), "benchmark-windows")
    parts = land(shingles(table, shingle), "benchmark-shingles")
    vocabulary = land(parts.select("k", "s").distinct(), "benchmark-vocabulary")
    # At most ``shingle`` different lengths.
    sizes = sorted(r[0] for r in vocabulary.select("k").distinct().collect()) or [shingle]
    hits = found(docs, vocabulary, sizes[0], id_col, text_col)
    for k in sizes[1:]:
        hits = hits.union(found(docs, vocabulary, k, id_col, text_col))
    hits = land(hits, "shingle-hits")

    # Prefixes: the rarest shingle of each window; one that no document has rules its window out.
    rarity = hits.groupBy("k", "s").count()
    rarest = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "s", "offset"))
    prefixes = land(
        parts.join(rarity, ["k", "s"], "left").withColumn("rank", rarest).filter("rank = 1 and count > 0")
        .select("k", "s", "window", "length", "offset"), "prefixes")

    # Only the words that a window through this shingle can reach go along.
    reach = f"""transform(sequence(0, size(hits) - 1), i -> struct(
        hits[i].s as s, start + i as pos, least(i, {window} - k) as before,
        slice(words, greatest(i - ({window} - k), 0) + 1, least(i, {window} - k) + {window}) as around))"""
    around = runs(hits).select("key", "k", F.explode(F.expr(reach)).alias("h")).select("key", "k", "h.*")
    matched = (
        around.join(prefixes, ["k", "s"])
        .filter("before >= offset and before - offset + length <= size(around)")
        .filter("array_join(slice(around, before - offset + 1, length), ' ') = window")
        .select("key", (F.col("pos") - F.col("offset")).alias("start"), "length", "window"))
    return matched.join(table.select("window", "item_id"), "window").select(
        "key", "start", (F.col("start") + F.col("length")).alias("end"), "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``key, doc_id, n_words, n_hit, items, contaminated``; items sorted as strings."""
    spans = land(contained(docs, benchmark, id_col, text_col, **options), "contained")
    per_doc = spans.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    # Words in any span, each once: spans come by their start.
    covered = F.expr("""aggregate(spans, struct(0L as n, 0 as upto), (a, x) -> struct(
        a.n + greatest(0, x.end - greatest(a.upto, x.start)) as n, greatest(a.upto, x.end) as upto), a -> a.n)""")
    per_doc = per_doc.select("key", covered.alias("n_hit"), "items")
    counted = docs.select(key_of(id_col, text_col).alias("key"), F.size(words_of(text_of(text_col))).cast("long").alias("n_words"))
    return counted.join(per_doc, "key", "left").select(
        "key", "key.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any window of an item."""
    dirty = land(contained(docs, benchmark, id_col, text_col, **options).select("key").distinct(), "contaminated")
    name = unused("key", docs)
    return docs.withColumn(name, key_of(id_col, text_col)).join(
        dirty.withColumnRenamed("key", name), name, "left_anti").drop(name)

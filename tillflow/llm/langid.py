"""Language identification by Bayesian fusion of evidence.

The posterior of a language is its host prior times the likelihoods of the text,
of the language declared in the markup and of the address suffix.

* Text: byte trigrams, hashed to ``BUCKETS`` cells; counted by language over all
  labelled documents.  A class ``und`` with equal chances for all cells stands for
  what is in no known language.  Overlapping trigrams say each letter three times, so
  a third of their log likelihood counts.
* Declared language and suffix: how often each goes with a language, counted over
  all documents by the language their text alone suggests, and smoothed towards
  its overall frequency.
* Host prior: the languages of the host's documents, smoothed towards those of its
  domain, and these towards all documents, by grouped sums.
* A document shown by several pages has each different evidence once, all with equal
  weights that add up to one: in the counts, and in the mean of the log likelihoods.

Counts are grouped in Spark; only tables of fixed size (cells by languages, totals by
language) come to the driver.  A host, domain or suffix with a third of all rows is
reduced in each task before the exchange, and joined to written tables, so Spark can
split it.

Defined results.  Texts without a letter or digit (null too) are ``und`` with
posterior 0.  Missing evidence counts for nothing; without any, the prior decides.
Equal posteriors go to the language named first.  Repeated rows get equal results.
Values of several pages are named in order, with commas.  Empty
tables give an empty result; without labelled rows all languages have equal
likelihoods.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.tables import FILE, ROW, land, located, small_batches, text_of, without

LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
BUCKETS = 1 << 16
# Bytes looked at together; bounds the memory.
BLOCK = 1 << 22


def cells(data: bytes) -> np.ndarray:
    """The cell of each byte trigram."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def blocks(data: bytes) -> Iterator[np.ndarray]:
    """The trigrams of a text of any length, a block at a time; blocks overlap by two bytes."""
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        yield cells(data[at:at + BLOCK + 2])


def trigram_counts(docs: DataFrame, text_col: str, label_col: str, languages: Sequence[str]) -> np.ndarray:
    """Languages by cells, counted over all labelled documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for k, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[k].append(text) if len(text) < BLOCK >> 2 else add(total, k, text)
                sizes[k] += len(text)
                if sizes[k] > BLOCK >> 2:
                    add(total, k, "".join(held[k]))
                    held[k], sizes[k] = [], 0
        for k, texts in enumerate(held):
            add(total, k, "".join(texts))
        k, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[k, cell])], ["k", "cell", "n"])

    def add(total: np.ndarray, k: int, text: str) -> None:
        for part in blocks(text.encode().lower()):
            total[k] += np.bincount(part, minlength=BUCKETS)

    held: list[list[str]] = [[] for _ in languages]
    sizes = [0] * len(languages)
    label = F.array_position(F.array(*map(F.lit, languages)), F.col(label_col).cast("string")).cast("int") - 1
    labelled = docs.select(label.alias("label"), text_of(text_col).alias("text")).filter("label >= 0")
    sums = small_batches(labelled).mapInArrow(run, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(languages), BUCKETS))
    out[sums.column("k").to_numpy(), sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out


def text_likelihoods(counts: np.ndarray) -> np.ndarray:
    """Cells by classes: log likelihoods, smoothed towards equal chances; the last class is ``und``."""
    n = counts.sum(axis=1, keepdims=True)
    known = (counts + 0.5) / (n + 0.5 * BUCKETS)
    return np.log(np.vstack([known, np.full((1, BUCKETS), 1 / BUCKETS)])).T.astype(np.float32)


def text_scores(rows: DataFrame, table: np.ndarray, id_col: str, text_col: str, host_col: str | None, classes: Sequence[str]) -> DataFrame:
    """``doc_id, own_host``, the locator, ``blank`` and a log likelihood ``t_<class>`` of each located row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros((batch.num_rows, table.shape[1]))
            blank = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                blank.append(not any(map(str.isalnum, text)))
                for part in blocks(text.encode().lower()):
                    scores[i] += table[part].sum(axis=0, dtype=np.float64) / 3
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "own_host", FILE, ROW)), pa.array(blank), *map(pa.array, scores.T.copy())],
                ["doc_id", "own_host", FILE, ROW, "blank", *(f"t_{c}" for c in classes)])

    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    inputs = rows.select(F.col(id_col).alias("doc_id"), host.alias("own_host"), FILE, ROW, text_of(text_col).alias("text"))
    kind = inputs.schema["doc_id"].dataType.simpleString()
    return small_batches(inputs).mapInArrow(
        run, f"doc_id {kind}, own_host string, {FILE} string, {ROW} long, blank boolean, " + ", ".join(f"t_{c} double" for c in classes))


def best(prefix: str, classes: Sequence[str]) -> Column:
    """The class with the largest value; the one named first of equal ones."""
    return F.array_max(F.array(*(
        F.struct(F.col(f"{prefix}{c}").alias("score"), F.lit(-k).alias("order"), F.lit(c).alias("name")) for k, c in enumerate(classes))))["name"]


def grouped(rows: DataFrame, *keys: str, classes: Sequence[str]) -> DataFrame:
    """The weight of the rows of each key that the text puts into each class, ``n_<class>``, and ``n``."""
    return rows.groupBy(*keys).agg(
        *(F.sum(F.when(F.col("guess") == c, F.col("weight")).otherwise(0.0)).alias(f"n_{c}") for c in classes), F.sum("weight").alias("n"))


def likelihoods(rows: DataFrame, key: str, prefix: str, totals: dict[str, float], classes: Sequence[str], weight: float) -> DataFrame:
    """Log likelihood of each value of ``key`` given a class, smoothed towards its share of all rows."""
    seen = rows.filter(F.col(key).isNotNull())
    all_rows = max(sum(totals.values()), 1.0)
    share = (F.col("n") + 1) / (all_rows + 2)
    return grouped(seen, key, classes=classes).select(
        key, *(F.log((F.col(f"n_{c}") + weight * share) / (totals[c] + weight)).alias(f"{prefix}{c}") for c in classes))


def host_priors(counts: DataFrame, totals: dict[str, float], classes: Sequence[str], weight: float) -> DataFrame:
    """``host, h_<class>``: log prior of each host, smoothed towards its domain, and that towards all documents."""
    all_rows = sum(totals.values())
    everywhere = {c: (totals[c] + 1) / (all_rows + len(classes)) for c in classes}
    domains = counts.groupBy("domain").agg(*(F.sum(f"n_{c}").alias(f"m_{c}") for c in classes), F.sum("n").alias("m")).select(
        "domain", *((((F.col(f"m_{c}") + weight * everywhere[c]) / (F.col("m") + weight))).alias(f"p_{c}") for c in classes))
    return counts.join(domains, "domain").select(
        "host", *(F.log((F.col(f"n_{c}") + weight * F.col(f"p_{c}")) / (F.col("n") + weight)).alias(f"h_{c}") for c in classes))


def page_evidence(pages: DataFrame, doc_id: Column, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``doc_id, page_id, declared, suffix, host`` from addresses and markup.

    ``doc_id`` says which document a page shows; pages without one are left out.
    """
    html_lang = r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2})"
    host = F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(
        doc_id.alias("doc_id"), "page_id", F.nullif(F.lower(F.regexp_extract(html_col, html_lang, 1)), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"))
    return rows.filter("doc_id is not null").select(
        "doc_id", "page_id", "declared", F.nullif(F.regexp_extract("host", r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"), "host")


def identify(
    docs: DataFrame, evidence: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "lang", host_col: str | None = "source", languages: Sequence[str] = LANGUAGES,
    host_weight: float = 20.0, evidence_weight: float = 20.0, accept: float = 0.5,
) -> DataFrame:
    """One row per input row: ``doc_id, lang, posterior, text_lang, declared, suffix, host, accepted`` and the locator.

    ``evidence`` has ``doc_id, declared, suffix, host``; documents without a
    page take ``host_col`` for their host.
    """
    classes = (*languages, UNKNOWN)
    rows = located(docs)
    table = text_likelihoods(trigram_counts(rows, text_col, label_col, languages))
    scored = land(text_scores(rows, table, id_col, text_col, host_col, classes), "text-scores").withColumn("guess", best("t_", classes))
    if evidence is None:
        joined = scored.select("*", *(F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "host")), F.lit(1).cast("long").alias("pages"))
    else:
        each = land(evidence.select("doc_id", "declared", "suffix", "host").distinct(), "evidence")
        joined = scored.join(each.join(each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")), "doc_id"), "doc_id", "left")
    full = F.coalesce("host", "own_host", F.lit(""))
    rows_ = land(
        joined.withColumn("host", full).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn(
            "weight", 1 / F.coalesce("pages", F.lit(1))), "evidence-rows")
    known = rows_.filter("not blank")

    counts = land(grouped(known, "host", "domain", classes=classes), "host-counts")
    sums = counts.agg(*(F.coalesce(F.sum(f"n_{c}"), F.lit(0.0)) for c in classes)).first()
    totals = dict(zip(classes, sums, strict=True))
    priors = land(host_priors(counts, totals, classes, host_weight), "host-priors")
    # Two letters: at most 676 rows.
    declared = F.broadcast(likelihoods(known, "declared", "d_", totals, classes, evidence_weight))
    suffix = land(likelihoods(known, "suffix", "x_", totals, classes, evidence_weight), "suffixes")
    fused = rows_.join(declared, "declared", "left").join(suffix, "suffix", "left").join(priors, "host", "left")
    equal = F.lit(float(-np.log(len(classes))))
    said = [f"e_{c}" for c in classes]
    own = ["doc_id", FILE, ROW, "blank", "guess", *(f"t_{c}" for c in classes)]
    fused = land(fused.withColumns({
        f"e_{c}": F.coalesce(f"d_{c}", F.lit(0.0)) + F.coalesce(f"x_{c}", F.lit(0.0)) + F.coalesce(f"h_{c}", equal) for c in classes
    }).select(*own, *said, "declared", "suffix", "host", "weight"), "fused")
    several = fused.filter("weight < 1").groupBy(FILE, ROW).agg(
        *(F.first(c).alias(c) for c in own if c not in (FILE, ROW)), *(F.sum(F.col(c) * F.col("weight")).alias(c) for c in said),
        *(F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit("")).alias(c) for c in ("declared", "suffix", "host")))
    fused = fused.filter("weight = 1").drop("weight").unionByName(several)
    fused = fused.withColumns({f"s_{c}": F.col(f"t_{c}") + F.col(f"e_{c}") for c in classes})
    top = F.greatest(*(F.col(f"s_{c}") for c in classes))
    mass = sum((F.exp(F.col(f"s_{c}") - F.col("top")) for c in classes), F.lit(0.0))
    answered = fused.withColumn("top", top).withColumn("posterior", F.when(F.col("blank"), 0.0).otherwise(1 / mass)).withColumn(
        "lang", F.when(F.col("blank"), UNKNOWN).otherwise(best("s_", classes)))
    return answered.select(
        "doc_id", "lang", "posterior", F.when(F.col("blank"), UNKNOWN).otherwise(F.col("guess")).alias("text_lang"), "declared", "suffix", "host",
        ((F.col("lang") != UNKNOWN) & (F.col("posterior") >= accept)).alias("accepted"), FILE, ROW)


def accepted(docs: DataFrame, evidence: DataFrame | None = None, **options) -> DataFrame:
    """The documents in a known language."""
    rows = located(docs)
    return without(rows, identify(rows, evidence, **options).filter("not accepted"))

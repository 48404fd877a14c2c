r"""Secrets in texts, and whose they are.

Three kinds of spans are always found: assignments to secret-looking names, access
keys, and long hexadecimal numbers.  Two more are candidates only: signed web tokens,
and long strings mixing letters of both cases and digits.

Every candidate string is hashed, and the hashes are counted over the whole corpus by
distinct repositories and owners.  A string that many repositories or owners share is
an example that people copy; one that a single owner has, and that looks random enough,
looks live.  Candidates of the last two kinds become spans only if they look live.

Hashes are counted with the distinct repositories reduced in each task first, and
verdicts are joined to the spans by written tables on both sides, so an example in a third of all
documents is no burden for one task.  Texts never leave the scan.

Defined results.  A null text is empty.  Null repositories or owners are left out of
the counts.  Repeated rows give the same spans, and count once for a repository.  An
empty table gives an empty result.  Offsets are code points, the end exclusive.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.tables import FILE, ROW, land, located, small_batches, text_of

# Kinds in their order, patterns, and least lengths of what counts.
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# No shorter run can be long enough, so only these are looked at.
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "token", "mixed")
BASE = KINDS[:3]


def bits(secret: str) -> float:
    """Entropy of a string's characters, in bits for each."""
    counts = Counter(secret).values()
    return -sum(n / len(secret) * math.log2(n / len(secret)) for n in counts)


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """Kind, start, end and secret of every candidate, by start and kind."""
    found = [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX_LONG.finditer(text)]
    base = [(a, b) for _, a, b, _ in found]
    more = [(3, m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)] if "eyJ" in text else []
    more += [
        (4, m.start(), m.end(), m[0]) for m in MIXED.finditer(text)
        if all(re.search(letters, m[0]) for letters in ("[a-z]", "[A-Z]", "[0-9]")) and bits(m[0]) >= 4]
    found += [x for x in more if all(b <= x[1] or x[2] <= a for a, b in base)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan(rows: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per located row: ``doc_id, repo, owner`` and ``spans`` of kind, start, end, hash and bits."""
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[
                {"kind": k, "start": a, "end": b, "hash": hashlib.sha256(s.encode()).digest(), "bits": bits(s)} for k, a, b, s in spans_of(t)
            ] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kinds)], [*batch.schema.names[:-1], "spans"])

    inputs = small_batches(rows.select(
        F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), FILE, ROW,
        text_of(text_col).alias("text")))
    kind = inputs.schema["doc_id"].dataType.simpleString()
    return inputs.mapInArrow(run, f"""doc_id {kind}, repo string, owner string, {FILE} string, {ROW} long,
        spans array<struct<kind:int, start:long, end:long, hash:binary, bits:double>>""")


def ownership(spans: DataFrame, live_owners: int, live_bits: float) -> DataFrame:
    """``hash, repos, owners, live``: distinct repositories and owners of each candidate string."""
    pairs = spans.groupBy("hash", "repo", "owner").agg(F.max("bits").alias("bits"))
    return pairs.groupBy("hash").agg(
        F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"), F.max("bits").alias("bits")
    ).select("hash", "repos", "owners", ((F.col("repos") <= live_owners) & (F.col("owners") <= live_owners) & (F.col("bits") >= live_bits)).alias("live"))


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source",
    live_owners: int = 1, live_bits: float = 3.0, places: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, spans`` with ``kind, start, end, repos, owners, live``, by start and kind.

    ``places`` has ``doc_id, repo, owner`` for documents that are known to be in one or several
    repositories; the others are where their own columns say.
    """
    rows = land(scan(located(docs), id_col, text_col, repo_col, owner_col), "secret-spans")
    spans = rows.select("doc_id", FILE, ROW, "repo", "owner", F.explode("spans").alias("s")).select("doc_id", FILE, ROW, "repo", "owner", "s.*")
    held = spans.select("doc_id", "hash", "bits", "repo", "owner")
    if places is not None:
        known = places.select("doc_id", F.struct("repo", "owner").alias("place")).distinct()
        held = held.join(known, "doc_id", "left").select(
            "hash", "bits", F.when(F.col("place").isNull(), F.col("repo")).otherwise(F.col("place.repo")).alias("repo"),
            F.when(F.col("place").isNull(), F.col("owner")).otherwise(F.col("place.owner")).alias("owner"))
    verdicts = land(ownership(held, live_owners, live_bits), "secret-owners")
    judged = spans.select(FILE, ROW, "kind", "start", "end", "hash").join(verdicts, "hash").filter(F.col("live") | (F.col("kind") < len(BASE)))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    per_row = land(judged.groupBy(FILE, ROW).agg(F.array_sort(F.collect_list(
        F.struct("start", F.col("kind").alias("rank"), "end", kind.alias("kind"), "repos", "owners", "live"))).alias("found")), "judged")
    none = F.array().cast(per_row.schema["found"].dataType)
    return rows.select("doc_id", FILE, ROW).join(per_row, [FILE, ROW], "left").select("doc_id", F.coalesce("found", none).alias("spans"))

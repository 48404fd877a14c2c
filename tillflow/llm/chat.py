r"""Conversations as training text, in windows of a token budget.

Turns are written as ``### role:``, a new line, the text, and ``</turn>``.  Inside
roles and texts the characters that could begin a control string are escaped
(``\`` as ``\b``, ``#`` as ``\h``, ``<`` as ``\l``, in roles ``:`` as ``\c``), so no text
can close its turn or open another, and every text comes back as it was.

Prefix sums of the turns' tokens choose the windows: each takes as many new turns as the
budget holds beside the conversation's system turn and the last turns before it, up to
``history`` tokens of them.  So a conversation that fits is one window, and only the last
window of a conversation has room for its next turn.  A turn that fits only with less history
has less; one that exceeds the budget alone is kept whole in a window marked ``over``.  Repeated
turns are not trained on: the loss mask has each assistant text once, where it is new.

Turns are sorted once over all conversations and numbered through.  Blocks of ``BLOCK`` turns
are cut at a time, by their sums alone, without texts.  Where a conversation runs through a
whole block, the block says for each number of tokens that a window could have left on
entering what is left on leaving; these short tables (most windows end alike wherever they
began) are put together in order, and the blocks are cut again, knowing where they begin.  So a
conversation with a third of all turns is many tasks.

Defined results.  Null texts and roles are empty.  Turns come by number, equal
numbers by role, the text's hash and their place in the files; null numbers first.  Repeated rows are turns of their own.
Null conversation identifiers are one conversation.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.tables import FILE, ROW, land, located

# Fixed values of the template.
OPEN, SPLIT, CLOSE = "### ", ":\n", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
BLOCK = 1 << 16
# Tokens that the template adds to a turn.
MARKS = 2
TRAINED = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in (*ESCAPES, *(((":", "\\c"),) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    """The codes have one backslash each, at their start; the backslash itself comes last."""
    for plain, code in reversed((*ESCAPES, *(((":", "\\c"),) if role else ()))):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens_col: str | None) -> DataFrame:
    """``conv, role, text, tokens`` of all turns in order, and ``g``, which numbers them through; nulls in the key are kept by a struct."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) if tokens_col is None else F.greatest(F.coalesce(tokens_col, F.lit(0)), F.lit(0))
    table = located(rows).select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        text.alias("text"), (words + MARKS).cast("long").alias("tokens"), F.xxhash64(text).alias("hash"), FILE, ROW)
    order = ["conv.id", "turn", "role", "hash", FILE, ROW]
    sorted_ = located(land(table.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "tokens"), "sorted-turns"))
    parts = sorted_.withColumn("part", F.regexp_extract(FILE, r"part-(\d+)", 1).cast("long"))
    # One row per file.
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = land(parts.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("offset")), "files-of-turns")
    return parts.join(offsets, "part").select("conv", "role", "text", "tokens", (F.col("offset") + F.col(ROW)).alias("g"))


class Run:
    """The turns of one conversation in a block: ``upto`` are the sums up to each turn, with those before it for history."""

    def __init__(self, g: np.ndarray, tokens: np.ndarray, old: int, reserved: int, home: int, budget: int, history: int):
        self.g, self.home, self.old = g, home, old
        self.upto = np.insert(np.cumsum(tokens), 0, 0)
        at = np.arange(len(g))
        # History reaches back to the turn after the system turn, and leaves room for the turn itself.
        first = np.searchsorted(g, home + (reserved > 0))
        room = np.minimum(history, np.maximum(budget - reserved - tokens, 0))
        self.back = np.minimum(np.maximum(np.searchsorted(self.upto, self.upto[:-1] - room), first), at)
        held = self.upto[:-1] - self.upto[self.back]
        self.room = np.where(g == home, budget, np.maximum(budget - reserved - held, tokens))

    def fits(self, at: int, room: int) -> int:
        """The turn after the last one that fits from ``at`` on."""
        return int(np.searchsorted(self.upto, self.upto[at] + room, side="right")) - 1

    def windows(self, left: int, open_: int, known: dict[int, tuple[int, int]] | None = None) -> tuple[list[int], tuple[int, int]]:
        """Where windows begin, if the open one began with turn ``open_`` and has ``left`` tokens; what the last one has
        left, and the turn it began with.

        ``known`` remembers the end by where a window begins.
        """
        starts, at, end = [], self.fits(self.old, left), len(self.g)
        if at >= end:
            return starts, (left - int(self.upto[end] - self.upto[self.old]), open_)
        while at < end and (known is None or at not in known):
            starts.append(at)
            at = max(self.fits(at, int(self.room[at])), at + 1)
        if known is not None and at < end:
            out = known[at]
        else:
            out = max(int(self.room[starts[-1]] - (self.upto[end] - self.upto[starts[-1]])), 0), int(self.g[starts[-1]])
        if known is not None:
            known.update(dict.fromkeys(starts, out))
        return starts, out


def runs_of(table: pa.Table, budget: int, history: int) -> list[Run]:
    """The runs of a block, whose rows come with a few of the block before (``old``) and what is known of long conversations."""
    table = table.sort_by("g")
    g, tokens, old, home, reserved = (table.column(c).to_numpy() for c in ("g", "tokens", "old", "home", "reserved"))
    key = table.column("key").combine_chunks()
    changed = np.append(True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) if len(key) else np.zeros(0, bool)
    cuts = [*np.flatnonzero(changed).tolist(), len(g)]
    return [
        Run(g[lo:hi], tokens[lo:hi], int(old[lo:hi].sum()), int(reserved[lo]), int(home[lo]), budget, history)
        for lo, hi in pairwise(cuts) if not old[hi - 1]]


def assigned(narrow: DataFrame, budget: int, history: int) -> DataFrame:
    """``g, window, back`` of each turn: the first new turn of its window, and where it is that itself, the first turn repeated."""
    whole = narrow.withColumn("block", F.floor(F.col("g") / BLOCK)).withColumn("old", F.lit(False))
    reach = -(-history // MARKS)
    halo = whole.filter(F.col("g") % BLOCK >= BLOCK - reach).withColumns({"block": F.col("block") + 1, "old": F.lit(True)})
    dealt = whole.unionByName(halo)

    def leave(table: pa.Table) -> pa.Table:
        runs = runs_of(table, budget, history)
        outs: list[tuple[int, int, int]] = []
        if runs:
            last = runs[-1]
            outs = [(budget, *last.windows(0, -1)[1])]
            if len(runs) == 1 and last.g[last.old] != last.home:
                # What comes in is not known yet; neighbours that leave alike are one row, named by the largest.
                known: dict[int, tuple[int, int]] = {}
                each = [last.windows(left, -1, known)[1] for left in range(budget + 1)]
                outs = [(left, *out) for left, out in enumerate(each) if left == budget or each[left + 1] != out]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(outs), pa.int64()), *(pa.array([o[k] for o in outs], pa.int64()) for k in range(3))], ["block", "left", "out", "began"])

    tables: dict[int, list] = {}
    for row in land(dealt.groupBy("block").applyInArrow(leave, "block long, left long, out long, began long"), "blocks").sort("block", "left").collect():
        tables.setdefault(row.block, []).append(row)
    entry, left, open_ = {}, 0, -1
    for block in sorted(tables):
        entry[block] = left, open_
        out = next(row for row in tables[block] if left <= row.left)
        left, open_ = out.out, out.began if out.began >= 0 else open_
    shared = narrow.sparkSession.sparkContext.broadcast(entry)

    def cut(table: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for run in runs_of(table, budget, history):
            left, open_ = (0, -1) if run.g[run.old] == run.home else shared.value[table.column("block")[0].as_py()]
            starts, _ = run.windows(left, open_)
            g = run.g[run.old:]
            began = np.searchsorted(starts, np.arange(run.old, len(run.g)), side="right") - 1
            window = np.append(run.g[starts], open_)[began]
            for held, x in zip(columns, (g, window, np.where(window == g, run.g[run.back[run.old:]], -1)), strict=True):
                held.append(x)
        return pa.table([np.concatenate(x) for x in columns], ["g", "window", "back"])

    return dealt.groupBy("block").applyInArrow(cut, "g long, window long, back long")


def windows(
    rows: DataFrame, budget: int = 512, history: int = 128,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None,
) -> DataFrame:
    """One row per window: ``conv_id, window, text, mask, n_repeated, n_tokens, over``.

    ``mask`` has the stretches of ``text`` that are trained on, in code points;
    ``n_repeated`` says how many turns at the beginning are repeated.  ``tokens_col`` names a
    column with the tokens of a text; without it runs of other than white space are counted.
    """
    table = land(turns(rows, conv_col, turn_col, role_col, text_col, tokens_col), "turns")
    heads = land(table.groupBy("conv").agg(F.min(F.struct("g", "role", "tokens")).alias("first")).select(
        "conv", F.col("first.g").alias("home"), F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(0).alias("reserved")), "conversations")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv.id").cast("string")), F.lit(""))
    narrow = land(table.join(heads, "conv").select("g", "tokens", "home", "reserved", key.alias("key")), "narrow-turns")
    placed = land(assigned(narrow, budget, history), "window-turns")
    own = land(table.join(placed.select("g", "window"), "g").withColumnRenamed("g", "ord"), "own-turns")
    # Repeated: the system turn, and the turns from ``back`` on; each window names them.
    starts = placed.filter("back >= 0").join(narrow.select("g", "home", "reserved"), "g")
    recalled = F.filter(F.sequence("back", "window"), lambda g: g < F.col("window"))
    system = F.when((F.col("reserved") > 0) & (F.col("window") > F.col("home")), F.array("home")).otherwise(F.array().cast("array<long>"))
    named = land(starts.select("window", F.explode(F.concat(system, recalled)).alias("g")), "repeated-turns")
    repeated = named.join(table, "g").select("conv", "window", F.col("g").alias("ord"), "role", "text", "tokens")
    fields = ("conv", "window", "ord", "role", "text", "tokens")
    parts = own.select(*fields, F.lit(False).alias("repeated")).union(
        repeated.select(*fields, F.lit(True).alias("repeated")))

    body = escape(F.col("text"))
    lead = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(SPLIT))
    piece = F.concat(lead, body, F.lit(CLOSE))
    pieces = parts.select(
        "conv", "window", "ord", "repeated", "tokens", piece.alias("piece"), F.char_length(lead).alias("skip"), F.char_length(body).alias("long"),
        (~F.col("repeated") & (F.col("role") == TRAINED)).alias("trained"))
    order = Window.partitionBy("conv", "window").orderBy("ord")
    placed = pieces.withColumn("from", F.coalesce(
        F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("skip"))
    gathered = placed.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct(F.col("from").alias("start"), (F.col("from") + F.col("long")).alias("end"))))).alias("mask"),
        F.count(F.when(F.col("repeated"), 1)).alias("n_repeated"), F.sum("tokens").alias("n_tokens"))
    return gathered.select(
        F.col("conv.id").alias("conv_id"), "window", F.array_join(F.col("pieces.piece"), "").alias("text"), "mask", "n_repeated", "n_tokens",
        (F.col("n_tokens") > budget).alias("over"))


def read_back(table: DataFrame) -> DataFrame:
    """Per window what its text says: ``turns`` (role and text of the new ones) and ``learned``, the texts under the mask."""
    pieces = F.filter(F.split("text", CLOSE), lambda p: p != "")
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces), F.lit(1)))
    parsed = F.transform(fresh, lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, SPLIT, 1), F.lit(len(OPEN) + 1)), role=True).alias("role"),
        unescape(F.substr(p, F.char_length(F.substring_index(p, SPLIT, 1)) + len(SPLIT) + 1)).alias("text")))
    learned = F.transform("mask", lambda m: unescape(F.substr("text", m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int"))))
    return table.select("conv_id", "window", F.char_length("text").cast("long").alias("n_chars"), parsed.alias("turns"), learned.alias("learned"))

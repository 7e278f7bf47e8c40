"""Conversation structure repair by Wagner-Fischer alignment to an alternating grammar.

A conversation should read ``(s?(ua)+)?`` in role initials: an optional system turn,
then user and assistant in turn.  Its turns are aligned to every feasible length of
that string: Keep (0), Rerole to user or assistant (3), Delete (4), Insert an
empty-text user or assistant turn (3); blank and duplicate turns must go, truncated
ones cost 3 more unless deleted.  Lengths are tried from the nearest on; a length is
skipped when its least cost is above the incumbent's, and each table is filled only
inside the Ukkonen band that the incumbent cost leaves.  The backtrace of a length
takes the ASCII-least audit of its edits; of the cheapest lengths the least audit wins.

Long conversations are cut at *anchors*: the middle of five sound turns that alternate
is kept by every cheapest alignment (changing it costs at least nine beside a side that
is not kept, while keeping all five costs at most six of inserts around them).  An audit
up to an anchor ends in its Keep, so least audits of the pieces make the least audit
of the whole.  Pieces are aligned as the turns stream by, so a task holds a piece, not a
conversation; equal pieces are aligned once.  A stretch without an anchor is one
piece, and its time grows with its length, its band and its feasible lengths.

Defined cases: a null role or text counts as one space; turns go by number (nulls
first), then role, then text; repeated rows are duplicates of the first; a null id is a
conversation of its own; an initial other than s, u and a fits nothing; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
#: A piece's letters: role initial (``x``: another), upper case if truncated, ``.`` if it must go.
GONE = "."
ANCHORED = ("uauau", "auaua")
_FAR = 1 << 40


def _targets(start: str, anchor: str, free: int) -> Iterator[str]:
    """Feasible targets by distance of their length from ``free``: the alternation that
    follows ``start`` ('' at the beginning) and ends in ``anchor`` ('' at the end: a)."""
    first = "a" if start == "u" else "u"
    end = anchor or "a"
    parity = 1 if first == end else 0
    shortest = parity if (parity or not (anchor or start == "")) else 2
    lengths = range(shortest, 10 * free + 20, 2)
    strings = {n: (first + ("u" if first == "a" else "a")) * (n // 2) + (first if n % 2 else "") for n in lengths}
    out = list(strings.values())
    if not start:
        out += ["s" + s for s in strings.values()]
        if not anchor:
            out.append("")
    elif not anchor and not parity:
        out.append("")
    yield from sorted(set(out), key=lambda t: (abs(len(t) - free), t))


def _least(free: int, length: int, fixed: int) -> int:
    """A lower bound of the cost of aligning ``free`` turns to a target of ``length``."""
    return fixed + max(DELETE * (free - length), INSERT * (length - free), 0)


def _filled(rows: str, target: str, bound: int, fixed: int, anchored: bool) -> tuple[list, list]:
    """Costs of finishing from (i turns, j target letters) inside the band that ``bound``
    leaves, as one array and its first j per i."""
    n, m = len(rows), len(target)
    free = np.cumsum([0] + [r != GONE for r in rows])
    surplus = m - int(free[-1])
    width = (bound - _least(int(free[-1]), m, fixed)) // (INSERT + DELETE)
    letters = np.frombuffer(target.encode(), np.uint8)
    low = [max(0, int(f) + min(0, surplus) - width) for f in free]
    high = [min(m, int(f) + max(0, surplus) + width) for f in free]
    table: list = [None] * (n + 1)
    for i in range(n, -1, -1):
        at = np.arange(low[i], high[i] + 1)
        base = np.full(len(at), _FAR, np.int64)
        if i == n:
            base[at == m] = 0
        else:
            below, from_ = table[i + 1], low[i + 1]
            padded = np.full(m + 2, _FAR, np.int64)
            padded[from_:from_ + len(below)] = below
            only_keep = anchored and i == n - 1
            if not only_keep:
                base = padded[at] + DELETE
            if rows[i] != GONE:
                wanted = letters[np.minimum(at, m - 1)] if m else np.zeros(len(at), np.uint8)
                keep = wanted == ord(rows[i].lower())
                change = (wanted != ord("s")) & (not only_keep)
                step = np.where(keep, 0, np.where(change, REROLE, _FAR))
                step = np.where(at < m, step + (TRUNCATED if rows[i].isupper() else 0), _FAR)
                base = np.minimum(base, step + padded[at + 1])
        costs = np.minimum.accumulate((base + INSERT * at)[::-1])[::-1] - INSERT * at
        if len(at) and at[0] == 0 and m and target[0] == "s":
            costs[0] = base[0]  # a system turn cannot be inserted
        table[i] = costs
    return table, low


def _backtraced(rows: str, target: str, table: list, low: list, anchored: bool) -> str:
    """The ASCII-least audit among the cheapest alignments to ``target``."""
    n, m = len(rows), len(target)

    def cost(i: int, j: int) -> int:
        k = j - low[i]
        return int(table[i][k]) if 0 <= k < len(table[i]) else _FAR

    audit, i, j = [], 0, 0
    while i < n or j < m:
        now = cost(i, j)
        only_keep = anchored and i == n - 1
        more = TRUNCATED if i < n and rows[i].isupper() else 0
        if i < n and not only_keep and cost(i + 1, j) + DELETE == now:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and cost(i, j + 1) + INSERT == now:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[i].lower() == target[j] else "R")
            assert cost(i + 1, j + 1) + more + (0 if audit[-1] == "K" else REROLE) == now
            i, j = i + 1, j + 1
    return "".join(audit)


@lru_cache(maxsize=50_000)
def aligned(rows: str, start: str, anchored: bool) -> tuple[int, str]:
    """Cost and audit of a piece that follows the role initial ``start`` ('': none) and,
    if ``anchored``, ends in a turn that is kept."""
    free = sum(r != GONE for r in rows)
    fixed = DELETE * (len(rows) - free)
    best = DELETE * len(rows) + INSERT * (free + 3)  # all deleted, something inserted
    if anchored:
        best += REROLE * 4
    found = None
    for target in _targets(start, rows[-1] if anchored else "", free):
        if _least(free, len(target), fixed) > best:
            if len(target) > free:
                break  # shorter ones as near as this were no farther off
            continue
        table, low = _filled(rows, target, best, fixed, anchored)
        cost = int(table[0][0 - low[0]]) if low[0] == 0 else _FAR
        if cost > best:
            continue
        audit = _backtraced(rows, target, table, low, anchored)
        if found is None or (cost, audit) < found:
            best, found = cost, (cost, audit)
    return found


class _Stream:
    """One conversation's turns, repaired piece by piece."""

    def __init__(self, conv):
        self.conv, self.start, self.step = conv, "", 0
        self.letters, self.turns, self.recent, self.before = "", [], "", None

    def add(self, turn, role: str, text: str, duplicate: bool) -> list[tuple]:
        core = text.strip(SPACE)
        fault = "blank" if not core else "duplicate" if duplicate else "truncated" if core[-1] not in ".!?" else None
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        illegal = self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        letter = GONE if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        self.letters += letter
        self.turns.append((turn, role, text, fault, illegal))
        self.recent = (self.recent + letter)[-5:]
        return self._repaired(len(self.turns) - 2, True) if self.recent in ANCHORED else []

    def finished(self) -> list[tuple]:
        return self._repaired(len(self.turns), False)

    def _repaired(self, n: int, anchored: bool) -> list[tuple]:
        rows, turns = self.letters[:n], self.turns[:n]
        self.letters, self.turns = self.letters[n:], self.turns[n:]
        if not rows:
            # The end of the conversation right after an anchor, or no turns.
            _, audit = aligned("", self.start, False)
        else:
            _, audit = aligned(rows, self.start, anchored)
        out, i, state = [], 0, self.start
        for edit in audit:
            turn, role, text, fault, illegal = (None, "", "", None, False) if edit == "I" else turns[i]
            i += edit != "I"
            cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit in "KR" and fault == "truncated":
                cost += TRUNCATED
            if edit in "IR":
                state = "a" if state == "u" else "u"
                role_after = ROLES[state]
            elif edit == "K":
                state, role_after = role[:1], role
            else:
                role_after = role
            out.append((self.conv, self.step, edit, cost, fault, illegal, turn, role, role_after, text))
            self.step += 1
        self.start = state
        return out


EDITS = ("conv long, step long, edit string, cost long, fault string, illegal boolean, turn long, role_before string, "
         "role string, text string")
_ARROW = pa.schema([("conv", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()),
                    ("fault", pa.string()), ("illegal", pa.bool_()), ("turn", pa.int64()), ("role_before", pa.string()),
                    ("role", pa.string()), ("text", pa.string())])
FLUSH_ROWS, FLUSH_CHARS = 4096, 4 << 20


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size, stream = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if stream is None or stream.conv != row["conv"]:
                done = stream.finished() if stream else []
                out += done
                stream = _Stream(row["conv"])
            for copy in range(row["n"]):
                out += stream.add(row["turn"], row["role"], row["text"], copy > 0 or not row["first"])
                size += len(row["text"])
                if len(out) >= FLUSH_ROWS or out and size >= FLUSH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                    out, size = [], 0
    if stream:
        out += stream.finished()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per edit, in order of ``step``: ``edit`` (K, R, D, I), its cost, the turn's
    first fault (blank, duplicate, truncated) if any, whether it follows the turn before
    it illegally, its number, its role before and after, and its text.  The repaired
    conversation is the rows that are not deleted."""
    one = F.lit(" ")
    turns = rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role}`"), one).alias("role"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), one).alias("text"))
    # Equal rows are counted map-side; the first turn that says a text is no duplicate.
    turns = turns.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    said = Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))
    turns = turns.withColumn("first", F.row_number().over(said) == 1)
    placed = turns.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    return placed.select("conv", "turn", "role", "text", "n", "first").mapInArrow(_edits, EDITS)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties
    its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4
    makes its role user.  Nulls count as one space."""
    one = F.lit(" ")
    own = rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
                      F.pmod(F.crc32(F.encode(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(
                          F.col("turn").cast("string"), one)), "utf-8")), F.lit(20)).alias("_kind"))
    kind = F.col("_kind")
    return own.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def digests(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation of ``conversations`` (column conv_id): its counts, cost, audit and
    the digest of its repaired text, from the edits.  A digest needs a conversation's
    whole text in one row, as its definition says."""
    def counted(condition: Column) -> Column:
        return F.count_if(condition).cast("long")

    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    per = edits.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[counted(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        counted(F.col("illegal")).alias("illegal"), F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("step", "edit", line.alias("line")))).alias("e"))
    per = per.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                     F.array_join(F.transform("e", lambda x: x["edit"]), "").alias("audit"),
                     F.array_join(F.transform(F.filter("e", lambda x: x["line"].isNotNull()), lambda x: x["line"]), "\n")
                     .alias("repaired"), F.lit(1).alias("found"))
    every = conversations.select("conv_id").distinct()
    joined = every.join(per, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.sha2(F.encode(F.coalesce("repaired", F.lit("")), "utf-8"), 256).alias("repaired_sha256"))

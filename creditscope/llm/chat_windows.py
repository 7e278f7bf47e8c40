"""Chat formatting into budgeted, turn-aligned windows, in DataFrame functions only.

A turn is written as ``### role:\\ntext\\n</turn>\\n``; backslash, ``#`` and ``<`` inside
texts (and ``:`` in roles) get a backslash, so markers are unambiguous and
``unescaped`` restores every text.  Prefix sums of turn tokens lay the turns of a
conversation on a line that is cut into cells of ``budget`` less the retained
system turn less the history; the turns inside a cell form a window, and a turn
that crosses a cell's end forms its own.  So a window's new turns fit the cell,
unless a single turn alone is larger (turns are never cut).  Each window starts
with the system turn (a conversation's first turn, if its role is ``system``) and
the last turns before it that fit ``history`` tokens and what system turn and new
turns leave of the budget.  Only assistant turns that are
new in a window are targets: repeated ones are masked, so every assistant text is
under the loss exactly once.

Prefix sums run inside blocks of turn numbers and are joined by block offsets, so
one long conversation is spread over many tasks.

Defined cases: a null text or role is an empty string; turns with equal numbers
follow by role, then text; repeated rows are turns of their own; a null turn
number comes first; conversations with a null id form one conversation; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditscope.llm.tables import stored

BUDGET = 1024
HISTORY = 256
CHARS_PER_TOKEN = 4
TURNS_PER_BLOCK = 128
END = "\n</turn>\n"


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{more}])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escaped(role, ":"), F.lit(":\n"), escaped(text), F.lit(END))


def tokens(formatted: Column) -> Column:
    """Tokens of a formatted turn: its code points over ``CHARS_PER_TOKEN``, rounded up."""
    return F.ceil(F.length(formatted) / CHARS_PER_TOKEN).cast("long")


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, cell) -> tuple[DataFrame, DataFrame]:
    """Every turn with its tokens, its number ``at``, the tokens ``before`` it and its
    conversation's ``cell``; and the system turns.

    ``key`` is the conversation without nulls, so one partitioning by (key, block)
    serves the prefix sums and the join of the block offsets; the texts move once.
    """
    own = rows.select(F.col(conv).alias("conv"),
                      F.when(F.col(conv).isNull(), "null").otherwise(F.concat(F.lit("id "), F.col(conv))).alias("key"),
                      F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role), F.lit("")).alias("role"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("seg", formatted_turn(F.col("role"), F.col("text")))
    own = own.withColumn("t", tokens(F.col("seg"))).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-(2**62))))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    inside = Window.partitionBy("key", "block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("*", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("b"),
                     (F.row_number().over(inside) - 1).alias("a"))
    # Per block: its sums, and the tokens of its first turn if that is a system turn.
    sums = own.groupBy("key", "block").agg(
        F.sum("t").alias("t"), F.count("*").alias("n"),
        F.max(F.when((F.col("a") == 0) & (F.col("role") == "system"), F.col("t"))).alias("s"))
    earlier = Window.partitionBy("key").orderBy("block")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("key").alias("c"), F.col("block").alias("k"),
                          F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ob"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("oa"),
                          F.first("s").over(earlier).alias("sys_t"))
    turns = own.join(offsets, (F.col("key") == F.col("c")) & (F.col("block") == F.col("k"))).select(
        "key", "conv", "role", "seg", "t", (F.col("a") + F.col("oa")).alias("at"),
        (F.col("b") + F.col("ob")).alias("before"), cell(F.col("sys_t")).alias("cell"),
        F.coalesce("sys_t", F.lit(0)).alias("sys_n"),
        (F.col("sys_t").isNotNull() & (F.col("a") + F.col("oa") == 0)).alias("is_sys"))
    # Read for the spans, the history, the system turns and the windows: placed once.
    turns = stored(turns, "turns")
    return turns, turns.where("is_sys").select(F.col("key").alias("sc"), F.col("seg").alias("sys_seg"),
                                               F.col("t").alias("sys_t"))


def windows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Columns conv, window, n_context (leading turns that are repeated), n_tokens,
    formatted, targets (array of start and length, in code points of ``formatted``)."""
    # The system turn takes its place from the cells, which keep a quarter of the budget at least.
    turns, system = _turns(rows, conv, turn, role, text, lambda sys_t: F.greatest(
        F.lit(budget // 4), F.lit(budget - history) - F.coalesce(sys_t, F.lit(0))))
    first, last = (F.floor(x / F.col("cell")) for x in (F.col("before"), F.col("before") + F.col("t") - 1))
    turns = turns.withColumn("window", first * 2 + F.when(first == last, 0).otherwise(1))
    spans = turns.groupBy("key", "window").agg(F.first("conv").alias("conv"), F.min("before").alias("begins"), F.min("at").alias("starts"),
        (F.lit(budget) - F.max("sys_n") - F.sum("t")).alias("room"))
    # A turn is history of the windows that begin within ``history`` tokens of its own
    # begin; they lie in a few cells at most.
    lo, hi = F.col("before") + F.col("t"), F.col("before") + F.lit(history)
    old = turns.where(~F.col("is_sys") & (F.col("t") <= history)).select(
        F.col("key").alias("old_key"), "seg", "t", "at", "role", lo.alias("lo"), hi.alias("hi"),
        F.explode(F.sequence(F.floor(lo / F.col("cell")), F.floor(hi / F.col("cell")))).alias("in_cell"))
    later = spans.select("key", "conv", "window", "begins", "room", F.expr("window div 2").alias("begin_cell"))
    context = old.join(later, (F.col("old_key") == F.col("key")) & (F.col("in_cell") == F.col("begin_cell"))
                       & (F.col("begins") >= F.col("lo")) & (F.col("begins") <= F.col("hi"))
                       # From the turn on, history takes begins - before tokens: no more than are left.
                       & (F.col("begins") - F.col("hi") + history <= F.col("room")))
    context = context.select("key", "conv", "window", F.lit(1).alias("kind"), "at", "role", "seg", "t")
    kept = spans.where("starts > 0").join(system, F.col("key") == F.col("sc")).select(
        "key", "conv", "window", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"),
        F.lit("system").alias("role"), F.col("sys_seg").alias("seg"), F.col("sys_t").alias("t"))
    new = turns.select("key", "conv", "window", F.lit(2).alias("kind"), "at", "role", "seg", "t")
    parts = new.unionByName(context).unionByName(kept)
    # A window holds a cell's turns and bounded context, whatever the conversation's length.
    grouped = parts.groupBy("key", "window").agg(
        F.first("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("kind", "at", "role", "seg", "t"))).alias("p"))
    lengths = F.transform("p", lambda x: F.length(x["seg"]))
    head = lambda x: F.length(x["seg"]) - F.length(F.regexp_replace(x["seg"], r"(?s)^### .*?(?<!\\)(?:\\\\)*:\n", ""))
    starts = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.aggregate(
        F.slice("len", F.lit(1), i - 1), F.lit(0), lambda a, x: a + x))
    grouped = grouped.withColumn("len", lengths)
    targets = F.transform(
        F.filter(F.zip_with("p", starts, lambda x, s: F.struct(
            ((x["kind"] == 2) & (x["role"] == "assistant")).alias("loss"), (s + head(x)).alias("start"),
            (F.length(x["seg"]) - head(x) - len(END)).alias("length"))), lambda y: y["loss"]),
        lambda y: F.struct(y["start"].alias("start"), y["length"].alias("length")))
    return grouped.select(
        "conv", "window", F.size(F.filter("p", lambda x: x["kind"] < 2)).alias("n_context"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["t"]).alias("n_tokens"),
        F.array_join(F.transform("p", lambda x: x["seg"]), "").alias("formatted"),
        targets.alias("targets"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: its new turns (role, text) and its loss texts, parsed from the output."""
    cut = F.split("formatted", END)
    new = F.slice(cut, F.col("n_context") + 1, F.size(cut) - 1 - F.col("n_context"))
    head = r"(?s)^### (.*?(?<!\\)(?:\\\\)*):\n(.*)$"
    turns = F.transform(new, lambda s: F.struct(
        unescaped(F.regexp_extract(s, head, 1)).alias("role"),
        unescaped(F.regexp_extract(s, head, 2)).alias("text")))
    loss = F.transform("targets", lambda t: unescaped(F.substring(
        F.col("formatted"), t["start"] + 1, t["length"])))
    return formatted.select("conv", "window", F.length("formatted").cast("long").alias("chars"),
                            turns.alias("turns"), loss.alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of turns and loss texts.  A digest needs
    a conversation's whole text in one row, as its definition says."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    per = read_back(formatted).select(
        "conv", "window", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", line), "").alias("all"), F.array_join("loss", "").alias("loss"))
    whole = per.groupBy("conv").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "all", "loss"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["all"]), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        F.col("conv").alias("conv_id"), "n_turns", F.sha2(F.encode(text, "utf-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "utf-8"), 256).alias("loss_sha256"), "formatted_chars")

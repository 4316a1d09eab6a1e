"""Chat formatting: conversations as windows of a token budget, with a loss mask, on DataFrame operations only.

A turn is written ``### role: text</turn>`` and a line end.  In roles and texts a backslash is doubled, and ``###``, ``</turn``
and (in roles) ``:`` are broken by a backslash, so that no text can open or end a turn; ``turns_of`` reads a window back.

Windows are cut from prefix sums of the turns' tokens.  Each starts where the one before ended and takes the whole turns that
fit the budget beside the conversation's system turn (its first turn, if that is one, stands in every window) and a limited
history: the last turns before it, at most ``history`` tokens, are repeated as context.  ``repeated`` counts the leading turns
that an earlier window has brought already; their targets are masked.  ``loss`` has the spans (code points of the window,
end exclusive) of the texts of assistant turns that are new in the window.

Turns are gathered by run of RUN turn numbers, never by conversation, so that a conversation of any length spreads over as
many tasks as it has runs; a run takes its history and system turn from other runs by joins on (conversation, run), and a
window ends with its run.  Where turn numbers are sparse, runs are short and history goes back one run at most.

Defined results: a null role or text counts as empty; a null conversation is a conversation of its own; turns go by number,
null first, ties by role and text; repeated rows are turns each; a turn is never cut, so that one longer than the budget is a
window of its own (``tokens`` shows it), of any length; a conversation of a system turn alone is one window; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the template.
OPEN, BREAK, CLOSE = "### ", ": ", "</turn>\n"
RUN = 256  # 2 ** 8


def escaped(text: Column) -> Column:
    """The text without control strings; ``unescaped`` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "#(?=##)", r"#\\"), F.lit("</turn"), F.lit("<\\/turn"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#:])", "$1")


def pieces(text: Column) -> Column:
    """Tokens by a rule: runs of letters and digits, and each other character that isn't white space."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D\x20]"))


def written_turns(convs: DataFrame, tokens: Callable[[Column], Column], id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv (the conversation as a key), run and the turn as it is written: t (turn, head, body, n, system, target)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit(":"), F.lit("\\:")), F.lit(BREAK))
    turn = F.col(turn_col).cast("long")
    # never null, so that grouping and joins share one partitioning
    conv = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    rows = convs.select(conv.alias("conv"), turn.alias("turn"), head.alias("head"), escaped(text).alias("body"), role.alias("role"))
    rows = rows.withColumn("n", tokens(F.concat("head", "body", F.lit(CLOSE))).cast("long"))
    return rows.select(
        "conv", F.coalesce(F.shiftright("turn", 8), F.lit(-(1 << 56))).alias("run"),
        F.struct("turn", "head", "body", "n", (F.col("role") == "system").alias("system"), (F.col("role") == "assistant").alias("target")).alias("t"),
    )


def sums(turns: Column) -> Column:
    """Prefix sums of the turns' tokens, 0 first."""
    first = F.array(F.lit(0).cast("long"))
    return F.aggregate(turns, first, lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t["n"])))


def last_fitting(turns: Column, upto: Column, most: int) -> Column:
    """Of the prefix sums ``turns``: the first place from which on to ``upto`` the tokens are at most ``most``."""
    fits = lambda j: F.element_at(turns, (upto + 1).cast("int")) - F.element_at(turns, (j + 1).cast("int")) <= most
    return F.element_at(F.filter(F.sequence(F.lit(0), upto), fits), 1)


def runs(rows: DataFrame, history: int) -> DataFrame:
    """A row a run: its turns in order, the conversation's system turn, the history before it (``past``), whether it opens."""
    gathered = rows.groupBy("conv", "run").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    order = Window.partitionBy("conv").orderBy("run")
    ids = rows.select("conv", "run").distinct()
    later = ids.select("conv", "run", F.lag("run").over(order).alias("before"), F.first("run").over(order).alias("opens")).filter("before is not null")
    edge = later.select("conv", F.col("before").alias("run")).unionByName(later.select("conv", F.col("opens").alias("run"))).distinct()
    named = lambda df: df.withColumnsRenamed({"conv": "_conv", "run": "_run"})
    same = lambda on: (F.col("conv") == F.col("_conv")) & (F.col(on) == F.col("_run"))
    wanted = rows.join(named(edge), same("run"), "left_semi").groupBy("conv", "run").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    wanted = wanted.withColumn("sums", sums(F.col("turns")))
    tail = last_fitting(F.col("sums"), F.size("turns"), history)
    wanted = named(wanted.select("conv", "run", F.slice("turns", tail + 1, F.size("turns")).alias("tail"), F.slice("turns", 1, 1).alias("top")))
    past = later.join(wanted.drop("top"), same("before")).drop("_conv", "_run")
    past = named(past.join(wanted.drop("tail"), same("opens")).drop("_conv", "_run"))
    # a conversation's only run has no row there
    out = gathered.join(past, same("run"), "left").drop("_conv", "_run")
    opening = F.col("before").isNull()
    top = F.filter(F.when(opening, F.slice("turns", 1, 1)).otherwise(F.col("top")), lambda t: t["system"])
    out = out.withColumn("opening", opening).withColumn("top", top)
    body = F.when(opening, F.slice("turns", F.size("top") + 1, F.size("turns"))).otherwise(F.col("turns"))
    # of the run before, if that one opens the conversation, the system turn is no history
    kept = F.slice("tail", F.when((F.col("before") == F.col("opens")) & (F.size("tail") > 0) & (F.size("top") > 0) & (F.element_at("tail", 1) == F.element_at("top", 1)), 2).otherwise(1), F.greatest(F.size("tail"), F.lit(1)))
    return out.select("conv", "run", "opening", "top", body.alias("turns"), F.when(opening | (F.size("tail") == 0), F.slice("turns", 1, 0)).otherwise(kept).alias("past"))


def spans(gathered: DataFrame, budget: int, history: int) -> DataFrame:
    """conv, run, part, repeated, list (the turns of a window in order)."""
    g = gathered.withColumn("sums", sums(F.col("turns"))).withColumn("top_n", F.aggregate("top", F.lit(0).cast("long"), lambda s, t: s + t["n"]))
    at = lambda i: F.element_at("sums", (i + 1).cast("int"))
    room = lambda start: F.lit(budget) - F.col("top_n") - F.when(F.col("opening") & (start == 0), 0).otherwise(history)

    def further(s: Column, i: Column) -> Column:
        start = F.element_at(s, -1)
        return F.when((i > start) & (at(i + 1) - at(start) > room(start)), F.concat(s, F.array(i))).otherwise(s)

    cuts = F.aggregate(F.filter(F.sequence(F.lit(0), F.size("turns")), lambda i: i < F.size("turns")), F.array(F.lit(0)), further)
    g = g.withColumn("cuts", cuts).withColumn("all", F.concat("past", "turns"))
    g = g.withColumn("all_sums", sums(F.col("all")))
    # outer: for the other form Spark makes the arrays a second time, to filter empty ones
    g = g.select("conv", "run", "opening", "top", "past", "turns", "all", "all_sums", "cuts", F.posexplode_outer("cuts").alias("part", "start"))
    stop = F.when(F.col("part") + 1 < F.size("cuts"), F.get("cuts", F.col("part") + 1)).otherwise(F.size("turns"))
    g = g.withColumn("stop", stop).withColumn("upto", F.col("start") + F.size("past"))
    g = g.withColumn("since", last_fitting(F.col("all_sums"), F.col("upto"), history))
    fresh = F.col("opening") & (F.col("part") == 0)
    mark = lambda turns, new: F.transform(turns, lambda t: F.struct(t["head"].alias("head"), t["body"].alias("body"), t["n"].alias("n"), (t["target"] & F.lit(new)).alias("target")))
    listed = F.concat(mark(F.col("top"), False), mark(F.slice("all", F.col("since") + 1, F.col("upto") - F.col("since")), False), mark(F.slice("turns", F.col("start") + 1, F.col("stop") - F.col("start")), True))
    repeated = F.col("upto") - F.col("since") + F.when(fresh, 0).otherwise(F.size("top"))
    return g.select("conv", "run", "part", repeated.alias("repeated"), listed.alias("list"))


def chat_windows(
    convs: DataFrame, budget: int = 2048, history: int = 256, tokens: Callable[[Column], Column] = pieces,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, run, part, repeated, tokens, text, loss: every window, in order of run and part in its conversation."""
    rows = written_turns(convs, tokens, id_col, turn_col, role_col, text_col)
    w = spans(runs(rows, history), budget, history)
    length = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["head"])
        span = F.struct(start.alias("start"), (start + F.length(t["body"])).alias("stop"))
        return F.struct((s["at"] + length(t)).alias("at"), F.when(t["target"], F.concat(s["found"], F.array(span))).otherwise(s["found"]).alias("found"))

    text = F.array_join(F.transform("list", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    total = F.aggregate("list", F.lit(0).cast("long"), lambda s, t: s + t["n"])
    conv = F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(convs.schema[id_col].dataType)
    return w.select(conv.alias("conv_id"), "run", "part", "repeated", total.alias("tokens"), text.alias("text"), F.aggregate("list", none, add, lambda s: s["found"]).alias("loss"))


def turns_of(text: Column) -> Column:
    """array<struct<role, text>>: a window's turns, read from its text alone."""
    head = r"^### ((?:[^\\:]++|\\.)*+): "
    cut = F.filter(F.split(text, CLOSE), lambda t: t != "")
    return F.transform(cut, lambda t: F.struct(unescaped(F.regexp_extract(t, head, 1)).alias("role"), unescaped(F.regexp_replace(t, head, "")).alias("text")))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from windows: their texts, masks and
    numbers of repeated turns.  A digest takes what it covers of a conversation as one cell."""
    new = F.slice(turns_of(F.col("text")), F.col("repeated") + 1, F.length("text"))
    masked = F.array_join(F.transform("loss", lambda s: F.substr("text", s["start"] + 1, s["stop"] - s["start"])), "")
    per = windows.select("conv_id", "run", "part", new.alias("new"), masked.alias("masked"), F.length("text").cast("long").alias("chars"))
    lines = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = per.select("conv_id", "run", "part", F.size("new").cast("long").alias("n"), lines.alias("lines"), unescaped(F.col("masked")).alias("masked"), "chars")
    # parts of a run first, so that a long conversation's windows meet as a few strings
    for level in ("part", "run"):
        keys = ["conv_id", "run"] if level == "part" else ["conv_id"]
        ordered = F.sort_array(F.collect_list(F.struct(level, "lines", "masked")))
        joined = lambda c: F.array_join(F.transform("_all", lambda x: x[c]), "")  # noqa: B023, E731
        per = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), ordered.alias("_all"))
        per = per.select(*keys, "n", "chars", joined("lines").alias("lines"), joined("masked").alias("masked"))
    return per.select(
        "conv_id", F.col("n").alias("n_turns"), F.sha2("lines", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars")
    )

"""Conversations as training windows under a token budget, with DataFrame functions only.

Prefix sums of the turns' tokens decide everything: a window is a run of whole
turns whose sum fits what the budget leaves beside the system turn and the
repeated history, and the history is the longest run of turns before it that fits
its own limit. Only turn numbers and sums are gathered for that, at most
``SEGMENT`` turns in a row, so that a conversation of any length is spread over
many tasks; the texts then go to their windows by a key that no two turns share.

In a window each turn is ``<|im_start|>role, line end, text, <|im_end|>, line end``.
Inside texts and roles a backslash goes between ``<`` and ``|``, one more where
there are some already, so that markers only stand where the template puts them
and every text can be read back. The loss mask holds the text of each assistant
turn once: in the window that has the turn first, not where it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import join_groups
from tokenloom.session import materialize, scratch_path

#: Tokens of one window, and of the history it may repeat.
BUDGET, HISTORY = 1024, 256
#: Tokens of the markers of a turn.
MARKERS = 4
#: Turns whose windows are chosen together; a window's own turns never cross from one segment to the next.
SEGMENT = 256
START, END = "<|im_start|>", "<|im_end|>"
#: A token: a run of ASCII digits and letters and of characters beyond ASCII, or any other visible character.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def count_tokens(text: Column) -> Column:
    """The number of tokens of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def escaped(text: Column) -> Column:
    """``text`` without markers: one backslash more between each ``<`` and ``|`` that nothing else parts."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role in one line: line ends become ``\\n``, backslashes are doubled, markers are parted."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")  # doubled backslashes; what is left of single ones is part of an escape
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, row, cost with rank (place in the conversation), start (tokens before it) and system (tokens of the system turn, or null).

    Places come from counts per block of turn numbers, so that no task sorts a whole conversation.
    """
    slim = turns.select("conv", "turn", "row", "cost", F.xxhash64("role", "text").alias("h"), (F.col("role") == "system").alias("is_system"))
    slim = slim.withColumn("block", F.floor(F.col("turn") / SEGMENT))
    first = F.min(F.struct("turn", "h", "row", "is_system", "cost"))
    blocks = slim.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tokens"), first.alias("first"))
    order = Window.partitionBy("conv").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.first("first").over(order)
    blocks = blocks.select(
        F.col("conv").alias("b_conv"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.when(opening["is_system"], F.struct(opening["row"].alias("row"), opening["cost"].alias("cost"))).alias("system"),
    )
    # Turns that share a number follow by a hash of role and text; equal ones are interchangeable.
    inside = Window.partitionBy("conv", "block").orderBy("turn", "h", "row")
    slim = slim.withColumn("rank", F.row_number().over(inside) - 1).withColumn("start", F.sum("cost").over(inside) - F.col("cost"))
    same = F.col("conv").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    return slim.join(blocks, same).select(
        "conv",
        "row",
        "cost",
        "system",
        (F.col("rank") + F.col("rank_before")).alias("rank"),
        (F.col("start") + F.col("tokens_before")).alias("start"),
    )


def window_starts(budget: int, history: int) -> Column:
    """array<struct<first, since>>: the first turn of each window of a segment and the first one of the history before it.

    Of the columns ``before`` and ``own`` (turns as struct<rank, row, start, cost>, of the segment before and this one) and ``system``.
    """
    system_rank = F.when(F.col("system").isNull(), 0).otherwise(1)
    known = F.concat("before", "own")

    def step(acc: Column, t: Column) -> Column:
        repeated = F.when(t["rank"] > 0, F.coalesce(F.col("system.cost"), F.lit(0))).otherwise(0).cast("long")
        room = F.greatest(F.lit(budget) - repeated - t["cost"], F.lit(0).cast("long"))
        reach = t["start"] - F.least(F.lit(history).cast("long"), room)
        past = F.filter(known, lambda p: (p["rank"] < t["rank"]) & (p["rank"] >= system_rank) & (p["start"] >= reach))
        oldest = F.coalesce(F.get(past, F.lit(0)), t)
        left = F.lit(budget) - repeated - (t["start"] - oldest["start"])
        opened = F.struct(
            F.concat(acc["windows"], F.array(F.struct(t["rank"].alias("first"), oldest["rank"].alias("since")))).alias("windows"),
            (t["start"] + F.greatest(t["cost"], left)).alias("limit"),
        )
        return F.when(t["start"] + t["cost"] <= acc["limit"], acc).otherwise(opened)

    none = F.struct(F.array().cast("array<struct<first:bigint,since:bigint>>").alias("windows"), F.lit(-1).cast("long").alias("limit"))
    return F.aggregate("own", none, step, lambda acc: acc["windows"])


def window_turns(ranked: DataFrame, budget: int, history: int) -> DataFrame:
    """conv, first, rank, row, repeated: the turns of each window (named by its first own turn), the system turn among them."""
    segment = max(SEGMENT, history // MARKERS + 1)  # so that the history reaches back into one segment at most
    keyed = ranked.withColumn("segment", F.expr(f"rank div {segment}"))
    turn = F.struct("rank", "row", "start", "cost")
    segments = keyed.groupBy("conv", "segment").agg(F.array_sort(F.collect_list(turn)).alias("own"), F.first("system").alias("system"))
    tail = F.filter("own", lambda t: t["start"] >= F.element_at("own", -1)["start"] + F.element_at("own", -1)["cost"] - F.lit(history))
    earlier = segments.select(F.col("conv").alias("e_conv"), (F.col("segment") + 1).alias("e_segment"), tail.alias("before"))
    same = F.col("conv").eqNullSafe(F.col("e_conv")) & (F.col("segment") == F.col("e_segment"))
    met = segments.join(earlier, same, "left").withColumn("before", F.coalesce("before", F.array().cast(segments.schema["own"].dataType)))
    planned = met.withColumn("windows", window_starts(budget, history))
    last = F.element_at("own", -1)["rank"]
    opened = planned.select("conv", "system", F.concat("before", "own").alias("known"), "windows", last.alias("last"), F.posexplode("windows").alias("at", "w"))
    until = F.coalesce(F.get("windows", F.col("at") + 1)["first"] - 1, F.col("last"))
    inside = F.filter("known", lambda t: (t["rank"] >= F.col("w.since")) & (t["rank"] <= until))
    mine = F.transform(inside, lambda t: F.struct(t["rank"].alias("rank"), t["row"].alias("row"), (t["rank"] < F.col("w.first")).alias("repeated")))
    system = F.struct(F.lit(0).cast("long").alias("rank"), F.col("system.row").alias("row"), F.lit(True).alias("repeated"))
    with_system = F.when((F.col("w.first") > 0) & F.col("system").isNotNull(), F.concat(F.array(system), mine)).otherwise(mine)
    return opened.select("conv", F.col("w.first").alias("first"), F.explode(with_system).alias("t")).select("conv", "first", "t.*")


def format_chat(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Column | None = None,
) -> DataFrame:
    """One row per window: conv_id, first_turn, last_turn (places in the conversation, from 0), n_repeated, n_tokens, formatted, loss.

    Turns follow by number (null first), turns of one number by a hash of role and
    text. A first turn whose role is ``system`` opens every window. ``n_repeated``
    turns at a window's start are repeated ones: the system turn and at most
    ``history`` tokens of the turns before. Rows of one window cost at most
    ``budget`` tokens, ``tokens`` (by default counted in the text) and 4 per turn;
    a turn that is longer by itself stands alone beside the system turn. ``loss``
    lists the parts of ``formatted`` to learn, as struct<start, end> in code points,
    end exclusive: the texts of assistant turns that are not repeated. Null and
    empty texts and roles are empty; rows without a conv_id are one conversation.
    Repeated rows are turns like any others (those that share a conversation and a
    number are ordered in one task, by their numbers alone). Texts are never cut. An
    empty table gives no rows. Other columns are not read, so names cannot clash.
    """
    spark = turns.sparkSession
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    named = turns.select(
        F.col(f"`{conv_id}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        filled[0].alias("role"),
        filled[1].alias("text"),
        ((count_tokens(F.col(f"`{text}`")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))) + MARKERS).alias("cost"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Rows are referred to by number from here on, so they are stored.
    path = scratch_path(spark, "turns")
    named.write.parquet(path)
    stored = spark.read.schema(named.schema).parquet(path)
    chosen = materialize(window_turns(numbered_turns(stored), budget, history).join(stored.select("row", "cost"), "row"), "window-turns")
    own = chosen.where("rank > 0 or not repeated")
    body = stored.select("row", escaped_role(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learnt"))
    pieces = own.join(body, "row")
    # A system turn goes to all windows of its conversation, which may be a large share of all windows.
    opening = chosen.where("rank = 0 and repeated")
    systems = stored.where("role = 'system'").join(opening.groupBy("row").agg(F.count(F.lit(1)).alias("windows")), "row").select("row", "windows")
    systems = materialize(systems.join(body, "row").select(F.col("row").cast("string").alias("key"), "windows", "head", "body", "learnt"), "system-turns")
    spread = opening.withColumn("key", F.col("row").cast("string"))
    pieces = pieces.unionByName(join_groups(spread, systems, "key", "windows").drop("key", "windows"))
    gathered = pieces.groupBy("conv", "first").agg(
        F.array_sort(F.collect_list(F.struct("rank", "repeated", "learnt", "head", "body", "cost"))).alias("turns")
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["head"], F.lit("\n"), t["body"], F.lit(END + "\n"))), "")
    fixed = len(START) + len(END) + 2

    def place(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.lit(len(START) + 1) + F.length(t["head"])
        span = F.struct(begin.alias("start"), (begin + F.length(t["body"])).alias("end"))
        spans = F.when(t["learnt"] & ~t["repeated"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.lit(fixed) + F.length(t["head"]) + F.length(t["body"])).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return gathered.select(
        F.col("conv").alias("conv_id"),
        F.col("first").alias("first_turn"),
        F.element_at("turns", -1)["rank"].alias("last_turn"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["cost"]).alias("n_tokens"),
        formatted.alias("formatted"),
        F.aggregate("turns", none, place, lambda acc: acc["spans"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, first_turn, role, text of every turn once, in ``turns`` (array, in order) per window: parsed from ``formatted``."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    own = F.slice(pieces, F.col("n_repeated") + 2, F.greatest(F.size(pieces), F.lit(1)))  # nothing stands before the first marker

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(head) + 2, F.length(p) - F.length(head) - len(END) - 2)
        return F.struct(unescaped_role(head).alias("role"), unescaped(body).alias("text"))

    return windows.withColumn("turns", F.transform(own, turn))


def learnt_text(windows: DataFrame) -> Column:
    """All text of a window under its loss mask, as it was before the escapes."""
    parts = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(parts, "")


def digest_columns(windows: DataFrame) -> DataFrame:
    """Per conversation n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from its windows.

    A digest needs the whole conversation as one value: this report, unlike the windows, is bounded by its longest conversation.
    """
    read = read_back(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select(
        "conv_id",
        F.struct("first_turn", said.alias("said"), learnt_text(windows).alias("learnt")).alias("w"),
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    joined = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars")
    )
    learnt = F.array_join(F.transform("ws", lambda w: w["learnt"]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("ws", lambda w: w["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation becomes training windows of whole turns. Prefix sums of the
turns' token counts choose the windows: turn spans are cut where the sum passes
a multiple of the span budget. A window repeats the conversation's system turn
and a limited number of turns before its span; what is repeated is masked, so
every assistant text is a target once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control
string; line breaks in roles become ``<\\n``. ``unescape_text`` reverses it.

A conversation may hold any share of the rows: places and prefix sums come from
sums per block of turns and windows inside a block, and everything else is an
equi-join on (conversation, place) or an aggregate per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers whose places are computed together.
BLOCK_TURNS = 256
#: Tokens that the template itself adds to a turn.
TURN_OVERHEAD = 4


def escape_text(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescape_text(text: Column) -> Column:
    text = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape_text(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def word_tokens(text: Column) -> Column:
    """Tokens of a text: runs of letters, of digits, and other marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"))


def _placed(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 0, role, text, tokens, before: tokens of earlier turns)."""
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = turns.withColumn("row", F.row_number().over(inside) - 1).withColumn(
        "upto", F.sum("tokens").over(running))
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sum"))
    earlier = (Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_last())
               .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum_before"))
    both = local.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return both.select("conv_id", (F.col("rows_before") + F.col("row")).alias("place"), "role", "text", "tokens",
                       (F.col("sum_before") + F.col("upto") - F.col("tokens")).alias("before"))


def format_conversations(conversations: DataFrame, budget: int = 1024, history: int = 2, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: (conv_id, window, first_turn, turns, repeated, tokens,
    text, targets).

    ``text``: the formatted window. ``repeated``: its first turns that an earlier
    window has shown (the system turn, then history). ``targets``: array of
    struct(start, length), the code points of the assistant texts under the loss
    mask, in order. Turns go by ``turn`` (nulls last), then role, then text. The
    system turn is the first turn of role "system".

    A span of turns holds the turns that begin inside one multiple of
    ``budget / 2`` tokens, so a window holds more than ``budget`` only by the
    length of single turns: no turn is cut or left out. Null texts and roles are
    empty ones; rows without conversation id are one conversation; repeated rows
    are turns of their own; other columns are not read; an empty table gives an
    empty result.
    """
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", word_tokens(F.col("text")) + TURN_OVERHEAD)
    span = max(1, budget // 2)
    placed = _placed(turns).withColumn("window", F.floor(F.col("before") / span))
    spans = placed.groupBy("conv_id", "window").agg(F.min("place").alias("first_turn"))

    # (window, place) of all turns shown before a window's own
    system = placed.where("role = 'system'").groupBy("conv_id").agg(F.min("place").alias("system_turn"))
    later = spans.where("first_turn > 0")
    repeats = later.select("conv_id", "window", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("first_turn") - history), F.col("first_turn") - 1)).alias("place")) if history else None
    # a conversation's windows may be many: one row per conversation is joined to each
    heads = later.join(system.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).where(
        "system_turn < first_turn").select("conv_id", "window", F.col("system_turn").alias("place"))
    repeats = heads if repeats is None else repeats.union(heads).distinct()
    shown = repeats.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), F.col("place").alias("p"))
    old = placed.join(shown, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p"))).select(
        "conv_id", F.col("w").alias("window"), "place", "role", "text", "tokens", F.lit(True).alias("old"))
    rows = old.union(placed.select("conv_id", "window", "place", "role", "text", "tokens", F.lit(False).alias("old")))

    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape_text(F.col("text"))
    turn = F.struct("place", F.concat(head, body, F.lit(END + "\n")).alias("shown"), F.length(head).alias("head"),
                    F.length(body).alias("body"), (~F.col("old") & (F.col("role") == "assistant")).alias("target"), "old",
                    "tokens")
    windows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # targets' places: a running sum of the lengths before
    begin = F.aggregate(
        "t", F.struct(F.lit(0).cast("long").alias("at"),
                      F.array().cast("array<struct<start:bigint,length:bigint>>").alias("targets")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["shown"])).alias("at"),
            F.when(x["target"], F.concat(acc["targets"], F.array(F.struct(
                (acc["at"] + x["head"]).cast("long").alias("start"), x["body"].cast("long").alias("length")))))
            .otherwise(acc["targets"]).alias("targets")),
        lambda acc: acc["targets"])
    return windows.select(
        "conv_id", "window", F.filter("t", lambda x: ~x["old"])[0]["place"].alias("first_turn"),
        F.size("t").alias("turns"), F.size(F.filter("t", lambda x: x["old"])).alias("repeated"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
        F.concat_ws("", F.transform("t", lambda x: x["shown"])).alias("text"), begin.alias("targets"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back: (conv_id, window, formatted_chars, turns:
    the new ones as array<struct<role, text>>, targets: unescaped texts under
    the mask). Inverse of the template; nothing but ``text``, ``repeated`` and
    ``targets`` is read."""
    pieces = F.slice(F.split("text", F.lit(r"<\|im_start\|>"), F.lit(-1)), F.col("repeated") + 2,
                     F.greatest(F.lit(0), F.col("turns") - F.col("repeated")))
    one = F.transform(pieces, lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape_text(x.substr(F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(
            F.substring_index(x, "\n", 1)) - F.lit(1 + len(END) + 1))).alias("text")))
    masked = F.transform("targets", lambda s: unescape_text(F.col("text").substr(
        (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", F.length("text").cast("long").alias("formatted_chars"),
                          one.alias("turns"), masked.alias("targets"))


def digest_conversations(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows read back: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. A digest is of one string, so this
    report gathers a conversation's text in one row."""
    read = read_windows(windows)
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    per_window = read.select("conv_id", "formatted_chars", F.size("turns").alias("n"), F.struct(
        "window", said.alias("said"), F.concat_ws("", "targets").alias("loss")).alias("w"))
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("formatted_chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list("w")).alias("w"))
    loss = F.concat_ws("", F.transform("w", lambda x: x["loss"]))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.encode(F.concat_ws("", F.transform("w", lambda x: x["said"])), "UTF-8"), 256)
        .alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")

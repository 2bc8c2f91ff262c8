"""Chat formatting in budgeted windows, with DataFrame functions alone.

Prefix sums of turn tokens (window functions) lay a conversation out on a line that is cut into
blocks of the capacity: budget less system turn less history.  Turns within one block are a
span; a turn across a cut is a span of its own.  A span's window has the system turn, as many
earlier turns as the history budget takes, and the span; earlier turns are marked as repeated
and lie outside the loss mask, so each assistant text is a target once.

The template is <|im_start|>role, newline, text, <|im_end|>, newline; a repeated turn starts with
<|im_again|>.  In texts and roles & is written &amp; and < is written &lt; (in roles a newline
too: &nl;), so no text can hold a control string, and the inverse gives the text back.

Rows are ordered by turn, then role, then text, so ties and repeated rows have a defined order.
Null texts and roles are empty; rows with a null conv_id are one conversation.  A turn of more
tokens than fit keeps its own window whole.  A conversation is one row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import read_table

BUDGET = 512
HISTORY = 96
CHARS_PER_TOKEN = 4
TURN_TOKENS = 4
START, AGAIN, END = "<|im_start|>", "<|im_again|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def laid_out(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its number, and whether it begins a span and how many turns its history has."""
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", (F.ceil(F.char_length("text") / CHARS_PER_TOKEN) + TURN_TOKENS).cast("long"))
    rows = rows.withColumn("i", F.row_number().over(ordered)).withColumn("upto", F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("is_system", (F.col("i") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("system_tokens", F.first(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(ordered))
    room = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(budget // 4))
    begin, end = F.greatest(F.col("upto") - F.col("tokens") - F.col("system_tokens"), F.lit(0)), F.greatest(F.col("upto") - F.col("system_tokens"), F.lit(1))
    rows = rows.withColumns({"begin": F.col("upto") - F.col("tokens"), "block": F.struct(F.expr("1") * F.floor(begin / room), F.floor((end - 1) / room))})
    before = F.lag("block").over(ordered)
    after_system = F.lag("is_system").over(ordered)
    head = (F.col("i") == 1) | (~F.coalesce(after_system, F.lit(False)) & (F.col("block") != before))
    behind = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, -1)
    return rows.withColumns({"head": head, "behind": F.count(F.lit(1)).over(behind)})


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, windows): the formatted text of each window and its loss mask as character spans."""
    row = F.struct("i", "role", "text", "head", "behind", "is_system")
    held = laid_out(turns, budget, history).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    held = held.withColumn("heads", F.filter("turns", lambda t: t["head"]))

    def piece(t: Column, new: Column) -> Column:
        lead = F.concat(F.when(new, F.lit(START)).otherwise(F.lit(AGAIN)), escape_role(t["role"]), F.lit("\n"))
        body = escape(t["text"])
        return F.struct(F.concat(lead, body, F.lit(END)).alias("text"), F.char_length(lead).alias("lead"), F.char_length(body).alias("body"), (new & (t["role"] == "assistant")).alias("target"))

    def window(h: Column, k: Column) -> Column:
        last = F.when(k + 1 < F.size("heads"), F.get("heads", k + 1)["i"] - 1).otherwise(F.size("turns"))
        has_system = F.get("turns", F.lit(0))["is_system"] & (h["i"] > 1)
        first = F.greatest(h["i"] - h["behind"].cast("int"), F.when(has_system, 2).otherwise(1))
        shown = F.concat(F.when(has_system, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)), F.slice("turns", first, last - first + 1))
        pieces = F.transform(shown, lambda t: piece(t, t["i"] >= h["i"]))
        none = F.array().cast("array<struct<start:int,end:int>>")

        def add(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["lead"]
            here = F.array(F.struct(start.alias("start"), (start + p["body"]).alias("end")))
            return F.struct((acc["at"] + F.char_length(p["text"])).alias("at"), F.when(p["target"], F.concat(acc["loss"], here)).otherwise(acc["loss"]).alias("loss"))

        mask = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("loss")), add)
        return F.struct(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), mask["loss"].alias("loss"))

    return held.select("conv_id", F.transform("heads", window).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, targets, formatted_chars) from windows: repeated turns are dropped, texts unescaped."""

    def turns_of(w: Column) -> Column:
        parts = F.filter(F.split(w["text"], r"<\|im_"), lambda p: p.startswith("start|>"))
        plain = F.transform(parts, lambda p: F.substring(p, F.lit(8), F.char_length(p)))
        return F.transform(plain, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.char_length(p))).alias("text")))

    targets = F.flatten(F.transform("windows", lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], s["start"] + 1, s["end"] - s["start"])))))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform("windows", turns_of)).alias("turns"),
        targets.alias("targets"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w["text"])).alias("formatted_chars"),
    )


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(windows(rows.unionByName(extra)))
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )

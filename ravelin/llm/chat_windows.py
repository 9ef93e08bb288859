"""Chat formatting into budgeted windows, with DataFrame functions only.

A turn is written as `<s>[INST] role [/INST]text</s>`. Inside roles and texts each backslash, `<` and `[` becomes a
backslash and one of e, l, b, so no control string can appear there and the writing can be undone. A turn's tokens are its
runs of other than ASCII white space, and `overhead` for its marks; prefix sums of them choose spans of whole turns. Each
window after the first repeats a leading system turn, then turns before it in at most `history` tokens, then has new
turns: as many as leave the whole within `budget`, one at least. Where the system turn and a long new turn leave less than
`history`, less is repeated. Only a window of a system turn and one new turn that together exceed the budget is longer
than it, and repeats nothing else. The loss spans are the texts of new assistant turns; repeated ones are masked.

One conversation is one row, so it is gathered in one task: its digest and its windows read it from end to end.

Defined cases: null text and null role are empty; a very long text is a turn, whole, in a window of its own; rows without a conversation id are one conversation; rows of equal
turn are ordered by role, then text, repeated rows stay; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 256, overhead: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """(conv_id, windows): windows is an array of (text, n_context, loss), where n_context turns are repeated ones (or
    the system turn again) and loss holds the [begin, end) code point spans of the targets in text."""
    if not 0 <= history < budget or overhead < 1:
        raise ValueError("history must be from 0 to below budget, and overhead positive")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("body"))
    rows = rows.withColumn("tokens", F.size(F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != "")) + overhead)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"i": F.row_number().over(order), "upto": F.sum("tokens").over(running), "system": F.first("role").over(running) == "system"})
    shown = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("body")), F.lit(CLOSE))
    item = F.struct("i", "upto", "tokens", shown.alias("shown"), F.when(F.col("role") == target, F.length(escape(F.col("role"))) + len(OPEN + MIDDLE)).alias("from"))
    lead = F.coalesce(F.max(F.when(F.col("system") & (F.col("i") == 1), F.col("tokens"))), F.lit(0))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"), F.max("system").alias("system"), lead.alias("lead"))

    # Where windows begin: `since` is the prefix sum before the window. Beginnings are kept in lists of lists, as each addition
    # copies what it adds to.
    begun = F.aggregate(
        "turns",
        F.struct(F.array().cast("array<array<int>>").alias("done"), F.array(F.lit(1)).alias("at"), F.lit(0).cast("long").alias("since"), F.lit(1).alias("last")),
        lambda s, t: F.when(
            (t["upto"] - s["since"] > budget - history - F.when(s["last"] > 1, F.col("lead")).otherwise(0)) & (t["i"] > s["last"]),
            F.struct(
                F.when(F.size(s["at"]) >= 256, F.concat(s["done"], F.array(s["at"]))).otherwise(s["done"]).alias("done"),
                F.when(F.size(s["at"]) >= 256, F.array(t["i"])).otherwise(F.concat(s["at"], F.array(t["i"]))).alias("at"),
                (t["upto"] - t["tokens"]).alias("since"),
                t["i"].alias("last"),
            ),
        ).otherwise(s),
        lambda s: F.flatten(F.concat(s["done"], F.array(s["at"]))),
    )
    convs = convs.withColumn("starts", begun)

    reach = history // overhead + 1  # no more turns than this fit into the history

    def window(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        new = F.slice("turns", start, stop - start)
        before = F.get("turns", start - 2)["upto"]
        room = F.least(F.lit(history), F.lit(budget) - F.col("lead") - (F.get("turns", stop - 2)["upto"] - before))
        low = F.greatest(F.lit(1) + F.col("system").cast("int"), start - reach)
        near = F.slice("turns", low, F.greatest(start - low, F.lit(0)))
        old = F.filter(near, lambda t: before - t["upto"] + t["tokens"] <= room)
        repeated = F.when(F.col("system") & (start > 1), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        return F.struct(F.concat(repeated, old).alias("context"), new.alias("new"))

    convs = convs.withColumn("parts", F.transform("starts", window))

    def written(part: Column) -> Column:
        context = F.array_join(F.transform(part["context"], lambda t: t["shown"]), "")
        text = F.concat(context, F.array_join(F.transform(part["new"], lambda t: t["shown"]), ""))
        loss = F.aggregate(
            part["new"],
            F.struct(F.length(context).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")),
            lambda s, t: F.struct(
                (s["at"] + F.length(t["shown"])).alias("at"),
                F.when(t["from"].isNotNull(), F.concat(s["spans"], F.array(F.struct((s["at"] + t["from"]).alias("begin"), (s["at"] + F.length(t["shown"]) - len(CLOSE)).alias("end"))))).otherwise(s["spans"]).alias("spans"),
            ),
            lambda s: s["spans"],
        )
        return F.struct(text.alias("text"), F.size(part["context"]).alias("n_context"), loss.alias("loss"))

    return convs.select("conv_id", F.transform("parts", written).alias("windows"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, windows) from the windows alone: turns is an array of (role, text)."""

    def turns_of(w: Column) -> Column:
        shown = F.split(w["text"], CLOSE)
        new = F.slice(shown, w["n_context"] + 1, F.size(shown) - 1 - w["n_context"])
        cut = lambda x: F.locate(MIDDLE, x)
        return F.transform(new, lambda x: F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), cut(x) - len(OPEN) - 1)).alias("role"), unescape(F.substring(x, cut(x) + len(MIDDLE), F.length(x))).alias("text")))

    targets = F.flatten(F.transform("windows", lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], s["begin"] + 1, s["end"] - s["begin"])))))
    return formatted.select("conv_id", F.flatten(F.transform("windows", turns_of)).alias("turns"), F.array_join(targets, "").alias("loss_text"), "windows")

"""Chat formatting with DataFrame expressions only.

    <|start|>role \n text <|more|> text <|end|> \n ...

A conversation's turns are collected as structs and sorted, neighbours of one role are merged by array aggregation, and
the merged turns are concatenated to one string; the mark between merged texts keeps every single turn readable. The
loss mask is a list of byte ranges of that string, one per text of the learned role.

Control strings cannot occur inside a text or role: a backslash is doubled, and `<|` becomes `<\\|`. In a role a line
break becomes `<\\n`. The one lone backslash of an escape stands between `<` and its letter, so reading back is two
plain replacements.

No conversation is collected whole by its rows: turns meet in blocks of `BLOCK` turn numbers, each block becomes one
string with its mask, and a conversation's blocks (rows of a window over (conversation, block)) are then joined. What
remains per conversation is its output row.

Null text or role: empty. Null turn: before all others; equal turns: by role, then text; repeated rows are repeated
turns. Null conversation: a conversation of its own. Extra columns: ignored. Empty table: no rows. Very long texts pass
whole; a formatted conversation must fit a string.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.llm.tables import named

START, MORE, END = "<|start|>", "<|more|>", "<|end|>"
LEARNED = "assistant"
BLOCK = 64
"""Turn numbers of a block."""


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _merged(turns: Column) -> Column:
    """Sorted turns -> array of (role, texts): a turn joins the last entry when it has its role."""
    def take(done, turn):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(done) > 0) & (last["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(new)))
    return F.aggregate(turns, F.array().cast("array<struct<role:string,texts:array<string>>>"), take)


def _opening(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def _inner(groups: Column) -> Column:
    """A block's string from the first text on: what opens or continues its first turn depends on the block before."""
    def body(group, i):
        between = F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(END + "\n"), _opening(group["role"])))
        return F.concat(between, F.array_join(group["texts"], MORE))
    return F.array_join(F.transform(groups, body), "")


def _inner_mask(groups: Column, learned: str) -> Column:
    """Byte ranges (start, size) of the learned texts within a block's string."""
    def group_texts(group, i):
        lead = F.when(i == 0, F.lit(0)).otherwise(F.octet_length(F.concat(F.lit(END + "\n"), _opening(group["role"]))))
        return F.transform(group["texts"], lambda text, k: F.struct(
            F.when(k == 0, lead).otherwise(F.lit(len(MORE))).cast("long").alias("lead"), F.octet_length(text).cast("long").alias("size"), (group["role"] == escape_role(F.lit(learned))).alias("learn")))

    def take(state, part):
        start = state["at"] + part["lead"]
        spans = F.when(part["learn"], F.concat(state["spans"], F.array(F.struct(start.alias("start"), part["size"].alias("size"))))).otherwise(state["spans"])
        return F.struct((start + part["size"]).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("spans"))
    return F.aggregate(F.flatten(F.transform(groups, group_texts)), none, take)["spans"]


def format_chats(turns: DataFrame, learned: str = LEARNED, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss): one row per conversation; `loss` holds the byte ranges (start, size) of the learned texts."""
    empty = F.lit("")
    rows = turns.select(named(id_col).alias("c"), named(turn_col).alias("t"), escape_role(F.coalesce(named(role_col), empty)).alias("role"), escape(F.coalesce(named(text_col), empty)).alias("text"))
    blocks = (rows.groupBy("c", F.floor(F.col("t") / BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("t", "role", "text"))).alias("turns"))
              .select("c", "block", _merged(F.col("turns")).alias("groups"))
              .select("c", "block", F.element_at("groups", 1)["role"].alias("first_role"), F.element_at("groups", -1)["role"].alias("last_role"),
                      _inner(F.col("groups")).alias("inner"), _inner_mask(F.col("groups"), learned).alias("mask")))
    along = Window.partitionBy("c").orderBy(F.col("block").asc_nulls_first())
    before = F.lag("last_role").over(along)
    lead = (F.when(before.isNull(), _opening(F.col("first_role"))).when(before == F.col("first_role"), F.lit(MORE))
            .otherwise(F.concat(F.lit(END + "\n"), _opening(F.col("first_role")))))
    led = blocks.withColumn("lead", lead)
    size = (F.octet_length("lead") + F.octet_length("inner")).cast("long")
    placed = led.withColumn("at", F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length("inner"))
    shifted = F.transform("mask", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["size"].alias("size")))
    whole = placed.select("c", F.struct("at", F.concat("lead", "inner").alias("piece"), shifted.alias("mask")).alias("b"))
    joined = whole.groupBy("c").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return joined.select(F.col("c").alias(id_col), F.concat(F.array_join(F.transform("b", lambda b: b["piece"]), ""), F.lit(END + "\n")).alias("formatted"),
                         F.flatten(F.transform("b", lambda b: b["mask"])).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), one entry per original turn, read from the formatted string."""
    def parts(block):
        role = F.substring_index(block, "\n", 1)
        body = F.substring_index(F.substr(block, F.length(role) + 2), END + "\n", 1)
        return F.transform(F.split(body, f"\\Q{MORE}\\E"), lambda text: F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))
    written = F.split(formatted, f"\\Q{START}\\E")
    return F.flatten(F.transform(F.slice(written, 2, F.greatest(F.size(written) - 1, F.lit(0))), parts))


def loss_texts(raw: Column, loss: Column) -> Column:
    """The texts under the loss mask; `raw` is the formatted string as binary."""
    return F.transform(loss, lambda s: unescape(F.substr(raw, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string")))

"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is
trainable (``loss_start`` to ``loss_end``, code points of ``formatted``). A conversation that doesn't end
with an assistant turn gives one more example without a target, so that the output holds every turn.

Template: ``<s>[INST] role [/INST]text</s>`` for each turn. Inside roles and texts a backslash is doubled
and each control string gets a backslash after its first character, so no text can end a turn or start
one; a single pass takes the backslashes away again.

Turns are ordered by (turn, role, text), nulls last. Null texts and roles are empty strings. A null
conv_id is a conversation like any other. Repeated rows are turns of their own. Other columns are not
read. An empty table gives no rows. The size of an example grows with the turns before it, so a
conversation of n assistant turns gives text in proportion to n squared; that is what the method makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TARGET = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_examples(turns: DataFrame) -> DataFrame:
    """conv_id, target (0-based place of the trainable turn, null without one), whole (holds all turns), formatted, loss_start, loss_end of ``turns`` (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.select("conv_id", F.struct(F.col("turn").isNull().alias("unplaced"), "turn", "role", "text").alias("x"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("t"))
    conv = conv.select(
        "conv_id",
        F.transform("t", lambda x: x["role"] == TARGET).alias("hit"),
        F.transform("t", lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(MIDDLE))).alias("heads"),
        F.transform("t", lambda x: escape(x["text"])).alias("texts"),
    )
    conv = conv.withColumn("turns", F.zip_with("heads", "texts", lambda h, t: F.concat(h, t, F.lit(CLOSE)))).withColumn("n", F.size("hit"))
    ex = conv.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.col("hit")[i]) | (i == F.col("n") - 1))).alias("at"))
    ex = ex.withColumn("is_target", F.col("hit")[F.col("at")]).withColumn("formatted", F.array_join(F.slice("turns", F.lit(1), F.col("at") + 1), ""))
    # The reply ends where the last turn's closing mark starts.
    end = F.length("formatted") - len(CLOSE)
    return ex.select(
        "conv_id",
        F.when(F.col("is_target"), F.col("at")).alias("target"),
        (F.col("at") == F.col("n") - 1).alias("whole"),
        "formatted",
        F.when(F.col("is_target"), end - F.length(F.col("texts")[F.col("at")])).cast("long").alias("loss_start"),
        F.when(F.col("is_target"), end).cast("long").alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    parts = F.split(formatted, CLOSE)
    bodies = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.substr(s, F.lit(len(OPEN) + 1)))
    return F.transform(bodies, lambda s: F.struct(unescape(F.substring_index(s, MIDDLE, 1)).alias("role"), unescape(F.substr(s, F.instr(s, MIDDLE) + len(MIDDLE))).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation."""
    reply = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    turns = F.when(F.col("whole"), parse(F.col("formatted")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    ex = examples.withColumn("turns", turns).select(
        "conv_id",
        F.when(F.col("target").isNotNull(), F.struct("target", reply.alias("reply"))).alias("loss"),
        F.length("formatted").alias("chars"),
        F.size("turns").alias("n"),
        F.when(F.col("whole"), F.sha2(flat, 256)).alias("sha"),
        "whole",
    )
    out = ex.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["reply"]), "").alias("replies"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("replies").cast("long").alias("loss_chars"), F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that the contract adds: both turns consist of control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table, written

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [f"select {c}L as conv_id, {t}L as turn, '{r}' as role, '{x}' as text" for c, t, r, x in EXTRA]
    turns = turns.unionByName(spark.sql(" union all ".join(extra)))
    return digest(written(format_examples(turns), "chat"))


OP8_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 22 as chars from turns),
placed as (
  select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as so_far,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from sized)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(so_far) filter (role = 'assistant' or back = 1))::bigint as formatted_chars
from placed group by conv_id
"""

"""Chat formatting, native: prefix-target expansion of conversations.

A turn is written <s>[INST]role[/INST]text</s>. Inside roles and texts every backslash is doubled and
a backslash goes behind the first character of each control string (<s>, </s>, [INST], [/INST]), so no
text can close or open a turn, and dropping the first of each escaping pair gives it back. Each
assistant turn is one example: all turns before it are context, its reply alone is under the loss
mask. Turns behind the last reply, if any, make one more example with an empty mask, so that the
examples hold every turn. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
PROBE = "</s>[INST] ok [/INST]"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), r"(<)(/?s>)|(\[)(/?INST\])", r"$1$3\\$2$4")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): characters [loss_start, loss_end) of text are trainable.

    example is the place of the reply among the conversation's turns. Turns are taken by turn, then
    role, then text, nulls first, so ties and repeated rows have a fixed order and all stay. A null
    text or role is empty; rows with a null conv_id are one conversation. Other columns aren't read.
    An example is one string, so a conversation must fit in one.
    """
    c = conversations.select(conversations[id_col].alias("conv_id"), F.struct(conversations[turn_col].alias("t"), F.coalesce(conversations[role_col], F.lit("")).alias("r"), F.coalesce(conversations[text_col], F.lit("")).alias("x")).alias("turn"))
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    f = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["r"]), F.lit(MID), escape(t["x"]), F.lit(CLOSE)))
    length = F.transform("turns", lambda t: F.length(escape(t["x"])))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("turns", i)["r"] == "assistant")
    at = F.concat(replies, F.when(F.get("turns", n - 1)["r"] == "assistant", F.array().cast("array<int>")).otherwise(F.array(n)))
    c = c.select("conv_id", f.alias("f"), length.alias("n"), at.alias("at"))
    c = c.select("conv_id", "f", "n", F.explode("at").alias("example"))
    c = c.select("conv_id", "example", F.array_join(F.slice("f", 1, F.least(F.col("example") + 1, F.size("f"))), "").alias("text"), F.get("n", "example").alias("n"))
    end = F.length("text") - F.when(F.col("n").isNull(), 0).otherwise(len(CLOSE))
    return c.select(F.col("conv_id").alias(id_col), F.col("example").cast("long"), "text", (end - F.coalesce("n", F.lit(0))).cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def turns_of(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    halves = F.transform(parts, lambda p: F.split(p, r"\[/INST\]", 2))
    return F.transform(halves, lambda h: F.struct(unescape(F.substring(h[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescape(h[1]).alias("text")))


def digest(found: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The contract's columns, read back from examples()."""
    target = unescape(F.substring(found["text"], found["loss_start"].cast("int") + 1, (found["loss_end"] - found["loss_start"]).cast("int")))
    c = found.select(found[id_col].alias("c"), "example", "text", target.alias("target"))
    c = c.groupBy("c").agg(F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "target"))).alias("targets"), F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    lines = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    c = c.select("c", turns_of(F.col("whole")).alias("turns"), F.array_join(F.transform("targets", lambda t: t["target"]), "").alias("loss"), "formatted_chars")
    return c.select(
        F.col("c").alias(id_col), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations and conversation -1, whose two texts are control strings."""
    two = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    own = conversations.select("conv_id", "turn", "role", "text")
    return own.union(two.select(*(two[f.name].cast(f.dataType) for f in own.schema)))


_ESC = r"regexp_replace(replace({0}, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
ORACLE = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
f as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
    sum(20 + length({_ESC.format('role')}) + length({_ESC.format('text')})) over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as upto
  from c window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (role = 'assistant' or i = n)::bigint as formatted_chars
from f group by conv_id"""

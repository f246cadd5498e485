"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all preceding turns as context, and only that reply trainable.
Turns after the last reply (or a conversation without one) give one more example with nothing trainable,
so that the output holds every turn.

Template, a turn: <|im_start|>role NEWLINE text <|im_end|> NEWLINE. Each control string begins with "<|", and texts
have & as &amp; and <| as &lt;|, which `unescape` takes back exactly. Roles also have < and line ends escaped.

Defined cases: null texts and roles are empty; turns are ordered by turn (nulls last), then role, then text;
repeated rows are repeated turns; a null conv_id is one conversation; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    amp = F.replace(role, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to examples: conv_id, example, n_examples, formatted, loss_start, loss_length.

    formatted[loss_start : loss_start + loss_length], in code points from 0, is the trainable reply, still escaped;
    loss_length is null where nothing is trainable.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_t")).withColumn("_n", F.size("_t"))
    parts = whole.withColumn("_heads", F.transform("_t", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))).withColumn("_bodies", F.transform("_t", lambda t: escape(t["text"])))
    segments = parts.withColumn("_segments", F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b, F.lit(END))))
    last = F.get("_t", F.col("_n") - 1)["role"]
    replies = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_t", i)["role"] == "assistant")
    places = segments.withColumn("_places", F.when(last == "assistant", replies).otherwise(F.concat(replies, F.array(F.col("_n")))))
    each = places.withColumn("n_examples", F.size("_places")).select("*", F.posexplode("_places").alias("example", "_i"))
    context = each.withColumn("_before", F.array_join(F.slice("_segments", 1, F.col("_i")), ""))
    head, body = F.coalesce(F.get("_heads", "_i"), F.lit("")), F.get("_bodies", "_i")
    return context.select(
        "conv_id", "example", "n_examples",
        F.concat("_before", F.coalesce(F.get("_segments", "_i"), F.lit(""))).alias("formatted"),
        (F.char_length("_before") + F.char_length(head)).cast("long").alias("loss_start"),
        F.char_length(body).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(x.substr(F.instr(x, "\n") + 1, F.char_length(x) - F.instr(x, "\n") - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped; empty where there is none."""
    return unescape(F.coalesce(formatted.substr((start + 1).cast("int"), length.cast("int")), F.lit("")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    examples = format_conversations(turns)
    read = examples.withColumn("loss", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")))
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("_full"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("_loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    back = whole.withColumn("_turns", read_turns(F.col("_full"))).withColumn("_kept", F.array_join(F.transform("_loss", lambda x: x["loss"]), ""))
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("_kept").cast("long").alias("loss_chars"), F.sha2("_kept", 256).alias("loss_sha256"),
        "formatted_chars", "n_examples",
    )


OP8_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') as body,
             12 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) + 1 + 11 as frame from t),
s as (select *, sum(length(body) + frame) over (partition by conv_id order by turn nulls last, role, text rows unbounded preceding) as upto,
             row_number() over (partition by conv_id order by turn nulls last, role, text) as i,
             count(*) over (partition by conv_id) as n from e)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
       sum(upto) filter (role = 'assistant' or i = n)::bigint as formatted_chars,
       count(*) filter (role = 'assistant' or i = n)::bigint as n_examples
from s group by conv_id
"""

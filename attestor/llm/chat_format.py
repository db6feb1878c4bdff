"""Operator 10, chat formatting: prefix-target expansion, DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is under the loss mask. A conversation's formatted text is stored once, as one segment for
each turn; an example is a span of that text (from 0 to the end of its target) with the span of its
loss. So the output grows with the turns, not with their square; `materialize` writes the contexts
out where a trainer wants each example as a text of its own.

Template: `### Role: ` + escaped text + `</turn>` + newline. Inside texts a backslash goes before each
backslash, `###` and `</turn>`, which one replacement undoes.

Reading back: a conversation's formatted text is scanned for turns, which end at control strings that are not escaped; what
the scan finds says how many turns there are and what they say, and each example's loss span cuts its target out of it.

Defined cases: null text is empty; null role is the empty role; turns with equal numbers follow role, then
text; null turn comes first; repeated rows are turns of their own; a conversation without an assistant
has segments and no example; null conv_id is a conversation too, ids may be numbers or texts; texts are kept whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import table

CONTROL = r"(\\|###|</turn>)"
#: In a role a colon would end the header, so it is escaped too.
ROLE_CONTROL = r"(\\|###|</turn>|:)"
END = "</turn>\n"
#: A turn in formatted text: header, body and end, where a backslash always comes before something that it escapes.
HEADER = r"### (?:[^\\:#<]++|\\(?:\\|###|</turn>|:)|#(?!##)|<(?!/turn>))*+: "
TURN = HEADER + r"(?:[^\\#<]++|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*+</turn>\n"


def escape(text: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(text, control, r"\\$1")


def unescape(text: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(text, r"\\" + control, "$1")


def segments(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, seq (from 0), role, segment, and the segment's start in its conversation's text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    header = F.concat(F.lit("### "), escape(F.col("role"), ROLE_CONTROL), F.lit(": "))
    rows = rows.select("conv_id", "turn", "role", "text", header.alias("header"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("segment", F.concat("header", "body", F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("seq"),
        "role",
        "segment",
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        F.length("header").cast("long").alias("header_chars"),
    )


def with_example(parts: DataFrame) -> DataFrame:
    """parts with `example`: the spans of the example that ends in this turn, null where it is no assistant's."""
    end = F.col("start") + F.length("segment")
    spans = F.struct(
        F.col("seq").alias("target"),
        F.col("start").alias("context_chars"),
        (F.col("start") + F.col("header_chars")).alias("loss_start"),
        (end - len(END)).alias("loss_end"),
        end.alias("formatted_chars"),
    )
    return parts.withColumn("example", F.when(F.col("role") == "assistant", spans))


def examples(parts: DataFrame) -> DataFrame:
    """One row an assistant turn: its context is the conversation's text before context_chars, its loss
    the span [loss_start, loss_end), its whole text [0, formatted_chars)."""
    return with_example(parts).where("example is not null").select("conv_id", "example.*")


def materialize(parts: DataFrame, which: DataFrame) -> DataFrame:
    """The chosen examples as texts: conv_id, target, text, loss_start, loss_end. Grows with context length."""
    # groupBy and joins drop or mismatch a null conversation; <=> keeps it
    key = parts.withColumnRenamed("conv_id", "_c").select("_c", "seq", "segment")
    joined = which.join(key, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seq") <= F.col("target")))
    told = joined.groupBy("conv_id", "target", "loss_start", "loss_end").agg(F.array_sort(F.collect_list(F.struct("seq", "segment"))).alias("p"))
    return told.select("conv_id", "target", F.array_join(F.col("p.segment"), "").alias("text"), "loss_start", "loss_end")


def formatted(parts: DataFrame) -> DataFrame:
    """One row a conversation: its formatted text and its examples, in order and with null for other turns."""
    rows = with_example(parts).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "segment", "example"))).alias("p"))
    return rows.select("conv_id", F.array_join("p.segment", "").alias("formatted"), F.col("p.example").alias("examples"))


def read_back(texts: DataFrame) -> DataFrame:
    """texts: formatted(). One row for each turn that a scan of the text finds: at (its number), start, part, said (the role),
    text, and loss: what the loss span of the example of that number holds, unescaped."""
    found = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))
    rows = texts.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.arrays_zip(found.alias("part"), F.col("examples").alias("example"))).alias("at", "x"))
    rows = rows.select("conv_id", "formatted_chars", "at", "x.part", "x.example")
    # the conversation is in one partition already, so neither this nor the aggregate after it moves rows
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("size", F.length("part").cast("long")).withColumn("start", F.sum("size").over(before) - F.col("size"))
    header = F.length(F.regexp_extract("part", f"^{HEADER}", 0))
    rows = rows.withColumn("header", header)
    role = F.expr(f"substring(part, 5, header - {len('### : ')})")
    body = F.expr(f"substring(part, header + 1, length(part) - header - {len(END)})")
    loss = F.expr("substring(part, cast(example.loss_start - start + 1 as int), cast(example.loss_end - example.loss_start as int))")
    return rows.select("conv_id", "formatted_chars", "at", "start", "part", unescape(role, ROLE_CONTROL).alias("said"), unescape(body).alias("text"), unescape(loss).alias("loss"), "example")


def digests(turns: DataFrame) -> DataFrame:
    """The contract's row for each conversation, read back from its formatted text. sha-256 runs over a conversation in one
    piece, so its turns meet in one row."""
    back = read_back(formatted(segments(turns)))
    rows = back.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "said", "text", "loss"))).alias("t"),
        F.max("formatted_chars").alias("formatted_chars"),
        F.count("example").alias("n_examples"),
        F.coalesce(F.sum("example.formatted_chars"), F.lit(0)).alias("example_chars"),
    )
    whole = F.array_join(F.transform("t", lambda x: F.concat(x.said, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = F.array_join(F.col("t.loss"), "")
    return rows.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "example_chars",
    )


#: The fixed conversation that the query adds: its texts hold the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and the fixed conversation, whatever types the table's columns have."""
    turns = turns.select("conv_id", "turn", "role", "text")
    rows = F.array(*(F.struct(F.lit(PROBE_ID), F.lit(i), F.lit(role), F.lit(PROBE_TEXT)) for i, role in enumerate(("user", "assistant"))))
    probe = turns.sparkSession.range(1).select(F.inline(rows).alias("conv_id", "turn", "role", "text"))
    return turns.unionByName(probe.select(*(F.col(f.name).cast(f.dataType) for f in turns.schema.fields)))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(with_probe(table(spark, sf_dir, "conversations")))


OP10_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as seq,
    length(role) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 as size from turns),
placed as (
  select *, sum(size) over (partition by conv_id order by seq) as ends from sized)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by seq)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by seq) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size)::bigint as formatted_chars,
  count(*) filter (role = 'assistant') as n_examples,
  coalesce(sum(ends) filter (role = 'assistant'), 0)::bigint as example_chars
from placed group by conv_id
"""

"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has events: conversation, sequence number, message, kind, role, text. "message" and "edit" set a message's text,
"delta" appends to it, and "regenerate" sets it and takes back every message that began between the message's own
beginning and the event. A message's role is that of the last of its events that has one, so events without a role keep it. Events are partitioned by conversation and sorted by sequence once; running maxima find each
message's last setting event, what follows it is appended in order, and messages taken back are left out. The messages
left, in the order of their beginnings, are rendered.

The template writes a turn as <turn>ROLE, a line feed, the text and </turn> with a line feed. In roles and texts a backslash becomes \\b and
"<" becomes \\l (in roles a line feed becomes \\n as well), so a "<" in the output is always the template's own and the
texts can be had back exactly. The loss mask is a list of spans, in UTF-8 bytes of the output, over assistant texts.

Cases: null texts are empty; messages without any role have the empty role; null conversations are one conversation; null sequence numbers come
first; events of equal sequence number are ordered by message, kind, role and text; repeated messages stay repeated when
each row is a message; an empty table gives an empty table. Only the named columns are read, so others can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def events_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of a table with a finished message in each row: every row is a message of its own."""
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("seq"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv").orderBy("seq", "role", "text"))
    return rows.withColumn("message", number.cast("long")).withColumn("kind", F.lit("message"))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv, at (a message's number in its conversation, from 1), role, text: the final messages of a log with the columns
    conv, seq, message, kind, role, text."""
    e = events.select("conv", F.col("seq").cast("long").alias("seq"), "message", "kind", F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("seq", "message", "kind", "role", "text")
    e = e.withColumn("n", F.row_number().over(order))
    own = Window.partitionBy("conv", "message")
    sets = F.col("kind").isin("message", "edit", "regenerate")
    e = e.withColumn("began", F.min("n").over(own)).withColumn("set_at", F.max(F.when(sets, F.col("n"))).over(own))
    e = e.withColumn("role", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n"))).over(own))
    # A message is taken back by a regeneration, later than its beginning, of a message that began earlier.
    later = Window.partitionBy("conv").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("back_to", F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(later))
    e = e.withColumn("gone", F.max(F.when((F.col("n") == F.col("began")) & (F.col("back_to") < F.col("began")), 1)).over(own))
    left = e.filter(F.col("gone").isNull() & (F.col("n") >= F.coalesce("set_at", "began")))
    parts = left.groupBy("conv", "message").agg(F.min("began").alias("began"), F.max("role").alias("role"), F.sort_array(F.collect_list(F.struct("n", "text"))).alias("parts"))
    text = F.concat_ws("", F.transform("parts", lambda p: p["text"]))
    number = F.row_number().over(Window.partitionBy("conv").orderBy("began")).cast("long")
    return parts.select("conv", number.alias("at"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv, formatted, loss_spans (first byte, from 0, and bytes of each assistant text), of messages with the columns conv, at,
    role, text."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit("\n"))
    m = messages.select("conv", "at", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    size = F.octet_length("head") + F.octet_length("body") + F.lit(len(CLOSE))
    before = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.octet_length("head")
    m = m.withColumn("first", first.cast("long")).withColumn("bytes", F.octet_length("body").cast("long"))
    turn = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "first", "bytes", (F.col("role") == assistant).alias("loss"))
    turns = m.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["first"].alias("first"), t["bytes"].alias("bytes")))
    return turns.select("conv", F.concat_ws("", F.col("turns.turn")).alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    turns = F.slice(F.split(formatted, CLOSE), 1, F.greatest(F.size(F.split(formatted, CLOSE)) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        body = F.substring(t, len(OPEN) + 1, 2**31 - 1)
        line = F.instr(body, "\n")
        return F.struct(unescaped(F.substr(body, F.lit(1), line - 1), True).alias("role"), unescaped(F.substr(body, line + 1)).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, with nothing between. Bytes are cut from the binary form, without a scan from the
    beginning for each span."""
    data = formatted.cast("binary")
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substr(data, (s["first"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))))

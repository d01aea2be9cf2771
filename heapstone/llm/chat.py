"""Chat formatting: logged conversations that are prefixes of longer ones are left out, the rest is rendered.

A log often holds a conversation once for each turn that it grew by. Each turn has a rolling hash of all turns up to it; a conversation whose
last hash is an inner hash of another one is a snapshot of that one and goes (an anti-join). Of equal conversations the smallest conv_id stays.
The rolling hash is the exclusive or of two independent hashes of each turn with its place, one of them cut from MD5: 124 bits together, so
that even 1e12 prefixes hold two different ones of one hash with a chance of about 2e-14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heapstone.llm.common import Store, hash60, pick

#: Turn numbers of a conversation that one window holds.
SLICE = 4096
#: Roles as rendered; others keep their name.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "system": "system"}

_CELL = ["conv_id", "slice"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, slice, position (0, 1, ...), role, text, x0, x1: turns with the rolling hashes of their slice, and ``ends`` on a slice's last turn.

    Repeated turns (same conversation, number, role and text) count once; turns of one number stand by role, then text; null numbers come
    first; null roles and texts are empty. Rows without conv_id take no part. Positions and hashes run in slices of SLICE turn numbers, so a
    very long conversation is shared by many tasks.
    """
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    clean = rows.select("conv_id", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))).alias("slice"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = clean.groupBy(*_CELL).agg(F.count("*").alias("n")).select(*_CELL, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*_CELL).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = clean.join(starts, _CELL).withColumn("position", F.col("start") + F.row_number().over(inside) - 1).withColumn("ends", F.lead("position").over(inside).isNull())
    hashed = placed.withColumns({"h0": F.xxhash64("position", "role", "text"), "h1": hash60(F.col("position"), F.col("role"), F.col("text"))})
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select(*_CELL, "position", "ends", "role", "text", *(F.bit_xor(f"h{k}").over(upto).alias(f"x{k}") for k in (0, 1)))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position, length, x0, x1: the hashes of all turns up to each one, and the conversation's number of turns.

    The last turns of the slices, a few rows each conversation, give what comes before a slice and how long the conversation is.
    """
    lasts = turns.where("ends").select(*_CELL, "position", "x0", "x1")
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = lasts.select(*_CELL, (F.max("position").over(Window.partitionBy("conv_id")) + 1).alias("length"), *(F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (0, 1)))
    return turns.select(*_CELL, "position", "x0", "x1").join(starts, _CELL).select("conv_id", "position", "length", *(F.col(f"x{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"x{k}") for k in (0, 1)))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, length of the conversations that are no inner prefix of another, one of each set of equal ones."""
    key = ["position", "x0", "x1"]
    last = hashes.where("position = length - 1").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("position < length - 1").select(*key).distinct()
    return last.join(inner, key, "left_anti").select("conv_id", (F.col("position") + 1).alias("length"))


def format_conversations(conversations: DataFrame, part_chars: int | None = None) -> DataFrame:
    """conv_id, n_turns, part, n_parts, text: the maximal conversations, rendered as ``<|role|>`` line, text line, blank line for each turn.

    A conversation is one row (part 0 of 1). With ``part_chars``, conversations are cut between turns into parts of about that many code
    points, which follow each other: for logs in which a conversation may outgrow a task or Spark's 2 GB for one text. Empty table: no rows.
    What counts as a turn and how ties stand is in ``ordered_turns``.
    """
    store = Store(conversations.sparkSession, "chat")
    turns = store.keep(ordered_turns(conversations))
    hashes = store.keep(prefix_hashes(turns))
    kept = store.keep(maximal(hashes))
    store.finish(turns, kept)
    named = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = F.coalesce(named[F.lower(F.trim("role"))], F.col("role"))
    line = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim("text"), F.lit("\n\n"))
    rendered = turns.select(*_CELL, "position", "role", "text").join(kept, "conv_id").withColumn("line", line)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "").alias("text")
    if part_chars is None:
        return rendered.groupBy("conv_id", "length").agg(text).select("conv_id", F.col("length").alias("n_turns"), F.lit(0).alias("part"), F.lit(1).alias("n_parts"), "text")
    sized = rendered.withColumn("chars", F.length("line").cast("long"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy(*_CELL).agg(F.sum("chars").alias("c")).select(*_CELL, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*_CELL).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor((F.col("start") + F.coalesce(F.sum("chars").over(inside), F.lit(0))) / part_chars)
    parts = sized.join(starts, _CELL).withColumn("cut", cut).groupBy("conv_id", "length", "cut").agg(text)
    of_conversation = Window.partitionBy("conv_id")
    return parts.select("conv_id", F.col("length").alias("n_turns"), (F.row_number().over(of_conversation.orderBy("cut")) - 1).alias("part"), F.count("*").over(of_conversation).cast("int").alias("n_parts"), "text")

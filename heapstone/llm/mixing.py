"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each document draws an exponential key, -ln(u) / quality weight; within its source, documents are taken in key order until their summed words
fill the source's budget. Complete epochs come first: a budget of 1.4 times the source takes every document once, then 0.4 of it by key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.llm.common import Store, hash60, pick, running_before, slices_for, word_count


def cleanliness(text: Column, words: Column) -> Column:
    """A document's quality weight, 0.05 to 1: falls with the symbols it has for each word; 1 without words."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.when(F.coalesce(words, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), 1.0 - symbols / words))


def key_share(key: Column) -> Column:
    """0 to 1, rising with the key: the mean of the key's distribution functions at the qualities 1 and 0.05.

    At every quality between, a slice of this range holds at most some 3.3 times its even share of the rows, so four times the slices are cut.
    """
    return 1 - (F.exp(-key) + F.exp(-0.05 * key)) / 2


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target for a table of (source, source_size).

    Sources by code point (null last) weigh ``cycle``, repeating; they share ``share`` times all words by weight, none above ``cap`` times its own;
    what a capped source leaves is shared by the others. In closed form: by rising cap / weight, the level is what is left over the weight left,
    at the first source that this level does not cap.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(everything) - 1) % len(cycle) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(all_rows) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levelled = weighed.withColumn("_rank", F.row_number().over(by_cap)).withColumn("_level", left / F.sum("_w").over(after)).withColumn("_open", F.col("_level") * F.col("_w") <= F.lit(cap) * F.col("source_size"))
    level = F.min(F.when(F.col("_open"), F.struct("_rank", "_level"))).over(all_rows)["_level"]
    return levelled.withColumn("_share", level * F.col("_w")).select("source", F.col("source_size").cast("long"), F.least(F.coalesce("_share", F.lit(cap) * F.col("source_size")), F.lit(cap) * F.col("source_size")).cast("double").alias("target"))


def mix_documents(docs: DataFrame, seed: str = "mix-1", cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents: how many of its words the mix takes, repeats counted.

    The document on which a source's budget ends gives only the words that are still missing, so each source takes its target, rounded down.
    Null text has size 0 and takes 0; a null source is a source; rows without doc_id draw a key for each size. Equal rows (same id, source, size and weight) are
    counted before the shuffle, once for targets and order, and fill the budget one after the other. A source is cut into slices of the key range, so none has to fit one task.
    """
    rows = pick(docs, doc_id="long", text="string", source="string")
    sized = rows.withColumn("size", word_count(F.col("text"))).select("doc_id", "source", "size", cleanliness(F.col("text"), F.col("size")).alias("_quality"))
    counted = Store(docs.sparkSession, "mixing").keep(sized.groupBy("doc_id", "source", "size", "_quality").agg(F.count("*").alias("_n")))  # the result reads it
    targets = source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), cycle, share, cap)
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\u0000"), F.col("size").cast("string")))
    u = (hash60(F.lit(seed), drawn) + F.lit(0.5)) / F.lit(float(1 << 60))
    keyed = counted.withColumn("_key", -F.log(u) / F.col("_quality")).withColumn("_words", F.col("size") * F.col("_n")).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    cuts = slices_for(counted.count())
    summed = running_before(keyed, ["_source"], ["_key", F.col("doc_id").asc_nulls_first(), "size", "_quality"], "_words", "_before", F.floor(key_share(F.col("_key")) * (4 * cuts)))
    joined = summed.join(targets.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"), "_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = F.floor(F.col("target") - epochs * F.col("source_size"))
    each = joined.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("_before") - F.col("_k") * F.col("size")))
    return each.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each document as often as the mix takes it, a partly taken one whole; same columns as ``docs``.

    Decisions are matched by id, source and size; rows alike in these share their copies: all their taken words over their size, evenly, the rest by a hash of the text.
    """
    decided = mix_documents(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum(F.ceil(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)))).alias("_copies"), F.count("*").alias("_rows"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_row"), F.col("`doc_id`").cast("long").alias("_id"), F.col("`source`").cast("string").alias("_source"), word_count(F.col("`text`")).alias("_size"), F.xxhash64(F.col("`text`").cast("string")).alias("_deal"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))
    joined = rows.join(decided, same)
    times = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.pmod("_deal", F.col("_rows")) < F.col("_copies") % F.col("_rows"), F.lit(1)).otherwise(F.lit(0))
    return joined.withColumn("_times", F.when(F.col("_rows") == 1, F.col("_copies")).otherwise(times).cast("int")).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")

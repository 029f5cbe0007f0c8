"""Mixing sources to target weights with a low-discrepancy schedule.  DataFrame operations only.

* Every source gets a target number of words by weight; a target stops at ``most_epochs`` times the
  source's size and the excess goes to the others by weight (water filling, one sorted pass over the
  table of sources, which has one row per source).
* The mix has slots of equal length, at least about ``2**SLOT_BITS`` and more where a slot would pass
  ``MOST_BLOCK`` words.  Slot ``n`` is the van der Corput point of ``n``: the reversed bits of ``n``, mapped
  through the cumulative slots of the sources to a source.  Any stretch of the schedule holds each source
  in its share.  The last slot of a source is cut where its target ends, so a source gets its target to the
  word, however small it is beside a slot.
* The documents of a source are laid end to end in the order of a hash, epoch after epoch, and cut into
  blocks as long as a slot.  The k-th slot of a source takes its k-th block: an equi-join on
  (source, k).  A document's place in the mix is the first slot that takes a piece of it.

Nothing gathers a source in one task: hash order is summed by hash prefix first (``PREFIX`` digits),
slot ranks by runs of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD
from framelake.scratch import checkpointed

WEIGHTS = (3, 1, 2)
SLOT_BITS = 18
MOST_BLOCK = 1024  # words of a slot at most; larger corpora have more slots
PREFIX = 3  # hexadecimal digits: 4096 runs of documents in a source
RUN_BITS = 10  # slots in a run: 1024
UNIT = 1024  # targets are cut to 1/1024 word before they become slot borders, so borders are exact
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``row_hash`` (see ``_row_hash``)."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), _row_hash(docs).alias("row_hash"))


def _row_hash(docs: DataFrame) -> Column:
    """Hash of source, text, lang and n_chars where present; equal rows have equal hashes."""
    return F.xxhash64(*[F.col(c) for c in ("source", "text", "lang", "n_chars") if c in docs.columns])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """One row per source: ``sid`` (place by code point, null last), ``source_size``, ``target``, ``block`` (words of a slot),
    ``words`` (what the mix takes of it), ``first_slot`` and ``end_slot`` (its places on the grid of points).

    Targets are rounded to words by their running sum."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = per_source.select(
        "source", "source_size", (F.row_number().over(by_name) - 1).alias("sid"), F.sum("source_size").over(everything).alias("total"),
    ).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    most = F.lit(float(most_epochs)) * F.col("source_size")
    by_level = Window.orderBy(most / F.col("weight"), "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.col("total") - F.lit(float(most_epochs)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum(
        "weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levelled = placed.withColumn("level", level).withColumn("full", F.col("level") >= most / F.col("weight"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), most).otherwise(F.col("weight") * shared)
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total") / F.lit(float(1 << SLOT_BITS))))).cast("long")
    cut = levelled.select("source", "sid", "source_size", target.alias("target"), block.alias("block"))
    units = F.floor(F.col("target") * UNIT).cast("long")
    end = F.sum(units).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    bounded = cut.withColumn("_end", end).withColumn("_begin", F.col("_end") - units)
    up = lambda x, by: F.expr(f"({x} + {by} - 1) div ({by})")
    own = bounded.withColumn("words", up("_end", UNIT) - up("_begin", UNIT)).withColumn("_n", up("words", "block"))
    placed = own.withColumn("end_slot", F.sum("_n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "first_slot", F.col("end_slot") - F.col("_n"))
    return placed.select("source", "sid", "source_size", "target", "block", "words", "first_slot", "end_slot")


def schedule(targets: DataFrame) -> DataFrame:
    """``slot`` (place in the mix), ``sid`` and ``k``: the how-many-eth slot of its source it is, from 0.

    The grid is the smallest power of two that holds all slots; places without a slot stay empty.
    """
    points = targets.agg(F.max("end_slot")).first()[0] or 1
    slot_bits = max(1, (points - 1).bit_length())
    # a row of targets becomes runs first, so that no task makes all slots of a large source
    first = F.explode(F.sequence("first_slot", F.col("end_slot") - 1, F.lit(1 << RUN_BITS).cast("long")))
    point = F.explode(F.sequence("_from", F.least(F.col("_from") + (1 << RUN_BITS), F.col("end_slot")) - 1))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("_point"), slot_bits, "0")), 2, 10).cast("long")
    slots = (
        targets.where(F.col("end_slot") > F.col("first_slot")).select("sid", "end_slot", first.alias("_from"))
        .repartition("sid", "_from").select("sid", point.alias("_point"))
        .select("sid", reversed_bits.alias("slot")).withColumn("_run", F.shiftright("slot", RUN_BITS))
    )
    runs = slots.groupBy("sid", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("sid").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("sid", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("sid", "_run").orderBy("slot")) - 1
    return slots.withColumn("_in", inside).join(offsets, ["sid", "_run"]).select("slot", "sid", (F.col("_before") + F.col("_in")).alias("k"))


def placed_documents(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with its source's figures, ``begin`` (its first word in the source's hash order) and the row key (sid, run, place)."""
    named = targets.select(F.col("source").alias("_source"), "sid", "source_size", "target", "block", "words")
    if targets.count() <= BROADCAST_SOURCES:  # one short row per source
        named = F.broadcast(named)
    shuffled = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # rows without an id share one place in the order: they are dealt by size and hash, which order them too
    nameless = F.md5(F.lit("mix:").cast("binary"))
    by_hash = F.lpad(F.hex("row_hash"), 16, "0")
    part = F.when(F.col("doc_id").isNull(), F.concat(F.lit("1"), F.lpad(F.col("size").cast("string"), 12, "0"), F.substring(by_hash, 1, 2))).otherwise(
        F.when(F.col("_order") < nameless, "0").otherwise("2"))
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_order", shuffled).withColumn(
        "run", F.concat(F.substring("_order", 1, PREFIX), part))
    runs = rows.groupBy("sid", "run").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("sid", "run", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("sid", "run").orderBy("_order", "doc_id", "size", by_hash)
    return (
        rows.withColumn("place", F.row_number().over(inside))
        .withColumn("_within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(offsets, ["sid", "run"]).withColumn("begin", F.col("_before") + F.col("_within"))
        .drop("_order", "_before", "_within")
    )


def mixed_pieces(placed: DataFrame, slots: DataFrame, most_epochs: int = 2) -> DataFrame:
    """What the mix takes: one row per slot and document piece, with ``epoch``, ``from_word`` and ``to_word`` (end exclusive) of the document."""
    copies = placed.where(F.col("size") > 0).select(
        "sid", "run", "place", "size", "block", "words", F.col("begin"), F.col("source_size"),
        F.explode(F.sequence(F.lit(0), F.lit(most_epochs - 1))).alias("epoch"),
    ).withColumn("_at", F.col("begin") + F.col("source_size") * F.col("epoch")).where("_at < words")
    blocks = copies.withColumn("k", F.explode(F.expr("sequence(_at div block, (least(_at + size, words) - 1) div block)")))
    return blocks.join(slots, ["sid", "k"]).select(
        "slot", "sid", "run", "place", "epoch",
        F.greatest(F.lit(0), F.col("k") * F.col("block") - F.col("_at")).alias("from_word"),
        F.least(F.col("size"), F.col("words") - F.col("_at"), (F.col("k") + 1) * F.col("block") - F.col("_at")).alias("to_word"),
    )


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed documents, pieces the mix takes), joined by (sid, run, place).

    Every row of ``documents`` is placed, repeated rows each for themselves.  A null text has size 0
    and is never taken; a null source is a source of its own; an empty table gives two empty tables.
    Only doc_id, text, source, lang and n_chars are read, so other columns cannot clash.
    """
    sizes = checkpointed(sized(docs))
    targets = checkpointed(source_targets(sizes))
    placed = placed_documents(sizes, targets)
    return placed, mixed_pieces(placed, schedule(targets))


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row, and its place in the mix.

    ``first_slot``: the first slot that takes a piece of the row (null: none does); ``pieces``: how many pieces are taken.
    """
    placed, pieces = mix(docs)
    key = ["sid", "run", "place"]
    taken = pieces.groupBy(*key).agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("pieces"))
    return placed.join(taken, key, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", F.coalesce("pieces", F.lit(0)).alias("pieces")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per document and epoch taken, cut where the mix ends inside it.

    Rows come in the order of the schedule, by the first slot that takes a piece of the document in that epoch.
    """
    placed, pieces = mix(docs)
    key = ["sid", "run", "place"]
    spans = pieces.groupBy(*key, "epoch").agg(F.min("from_word").alias("a"), F.max("to_word").alias("b"), F.min("slot").alias("slot"))
    takes = placed.join(spans, key).groupBy("doc_id", "source", "row_hash").agg(F.collect_list(F.struct("slot", "size", "epoch", "a", "b")).alias("_takes"))
    own = [c for c in docs.columns if c not in ("doc_id", "source")]
    once = docs.withColumn("_hash", _row_hash(docs)).groupBy("doc_id", "source", "_hash").agg(*[F.first(c).alias(c) for c in own])
    takes = takes.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("row_hash").alias("_row"), "_takes")
    joined = once.join(takes, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_row")))
    one = joined.select(*docs.columns, F.explode("_takes").alias("_t"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("_t.a") + 1).cast("int"),
                                (F.col("_t.b") - F.col("_t.a")).cast("int")), " ")
    whole = (F.col("_t.a") == 0) & (F.col("_t.b") == F.col("_t.size"))
    cut = one.withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.orderBy("_t.slot", "_t.epoch").select(*docs.columns)

"""Interaction audit of document filters: what every filter removes in every order of application.

The files of a table are read as available-now micro-batches of a stream.

1. Every whole text becomes a mask of the filters A to D that it fails and a 128-bit digest (one Arrow pass).
2. Filter E (a text that a smaller id has too) needs all rows.  Inside a task the rows of a text are combined:
   the smallest id of the task counts as the first, all others fail E.  These counts per part and mask go on at
   once, and the smallest id goes to the state of its text.
3. The state of a text is its smallest id so far and the rows that hold it.  Where a smaller id arrives, or one
   that is not the smallest after all, the counts of the rows that lose their place are retracted
   from their mask and added to the mask with E.  About ``TEXTS_HELD`` texts, by digest, share one state key, so that
   calling the state function costs little beside its work.
4. Counts and retractions are appended to a table of deltas; their sums per part and mask are the part
   counters.  There are at most 32 masks, so all orders follow from the counters alone.

A third of all rows may have one text: what is shuffled is at most one row of a text per task and flush.  The
state is written to the shared folder after every batch, so lost executors and a restarted driver go on from the
last batch; a later call over the same folder reads the new files only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from framelake.llm.common import rows_in
from framelake.scratch import Intermediate, checkpointed, exists, is_file, scratch_path

FILTERS = "ABCDE"
SHORT, REPEATED, UPPER, SYMBOL, COPY = 1, 2, 4, 8, 16  # bits of the five filters
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
BATCHES = 4  # micro-batches of a fresh table at most
HELD = 100_000  # texts that a task combines before it passes them on
GOOD, TOXIC = 1, 2

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
TEXTS_HELD = 128  # texts that share a state key, on average
ROWS_IN_MEMORY = 200_000  # texts of a partition of the state, some 20 MB
COUNT_KEYS = 64  # keys below zero, for counts that pass the state by


def text_mask(text: str | None) -> int:
    """The filters A to D that a whole text fails (null: empty)."""
    data = (text or "").encode()
    words = data.split()
    mask = SHORT if len(words) < LEAST_WORDS else 0
    if 100 * len(set(words)) < DISTINCT_PERCENT * len(words):
        mask |= REPEATED
    if 100 * (len(data) - len(data.translate(None, _CAPITALS))) > UPPER_PERCENT * len(text or ""):
        mask |= UPPER
    if len(data) != len(data.translate(None, SYMBOLS)):
        mask |= SYMBOL
    return mask


def _marked(docs: DataFrame) -> DataFrame:
    """``key`` (digest of the text), ``doc_id``, ``part``, ``mask`` and ``n``: equal rows of an Arrow batch are counted."""
    schema = "key binary, doc_id bigint, part string, mask int, n bigint"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, int] = defaultdict(int)
            for doc_id, text, source in rows_in(batch):
                key = blake2b((text or "").encode(), digest_size=16).digest()
                rows[key, doc_id, source or "", text_mask(text)] += 1
            columns = [*zip(*rows, strict=True), list(rows.values())] if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return docs.select(F.col("doc_id").cast("long"), "text", "source").mapInArrow(run, schema)


def label_flags(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``flags``: whether any label row of it has quality 1 (bit 0) or toxic 1 (bit 1)."""
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (flag("quality", GOOD) + flag("toxic", TOXIC)).alias("flags"))


def _combined(marked: DataFrame, keys: int) -> DataFrame:
    """The rows of a task by text: for texts their state key, digest and smallest id with its rows; for counts, their sum.

    A row without id fails no E and makes no other row fail it; it is a count only.
    """
    schema = "state_key bigint, text binary, doc_id bigint, part string, mask int, flags int, n bigint"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def out(firsts: dict, counts: dict) -> pa.RecordBatch:
        rows = [(int.from_bytes(key[:8]) % keys, key, doc_id, *held, n)
                for key, (doc_id, holders) in firsts.items() for held, n in holders.items()]
        rows += [(-1 - crc32(repr(held).encode()) % COUNT_KEYS, None, None, *held, n) for held, n in counts.items() if n]
        columns = zip(*rows, strict=True) if rows else [[]] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[bytes, tuple[int, dict]] = {}
        counts: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for key, doc_id, part, mask, flags, n in rows_in(batch):
                held = part, mask, flags
                if doc_id is None:
                    counts[held] += n
                else:
                    _arrive(firsts, counts, key, doc_id, held, n, True)
            if len(firsts) >= HELD:
                yield out(firsts, counts)
                firsts, counts = {}, defaultdict(int)
        yield out(firsts, counts)

    return marked.select("key", "doc_id", "part", "mask", "flags", "n").mapInArrow(run, schema)


def _arrive(firsts: dict, counts: dict, key: bytes, doc_id: int, held: tuple, n: int, new: bool) -> bool:
    """``n`` rows of a text arrive: the smallest id stays in ``firsts``, counts change; whether ``firsts`` changed.

    ``new``: the rows are not counted yet; else they are counted as rows of the smallest id.
    """
    before = firsts.get(key)
    if new:
        counts[held] += n
    if before is not None and doc_id > before[0]:
        _lose({held: n}, counts)
        return False
    if before is not None and doc_id == before[0]:
        before[1][held] = before[1].get(held, 0) + n
        return True
    if before is not None:
        _lose(before[1], counts)
    firsts[key] = doc_id, {held: n}
    return True


def _lose(holders: dict, counts: dict) -> None:
    """Rows that counted as the first of their text are retracted and fail E from now on."""
    for (part, mask, flags), n in holders.items():
        counts[part, mask, flags] -= n
        counts[part, mask | COPY, flags] += n


STATE = "texts array<binary>, doc_ids array<bigint>, parts array<string>, masks array<int>, flags array<int>, counts array<bigint>"
DELTA = "part string, mask int, flags int, n bigint"


def _settled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts pass through; the state keeps the smallest id of every text, and what turns out not to be the first is retracted."""
    deltas: dict[tuple, int] = defaultdict(int)
    firsts: dict[bytes, tuple[int, dict]] = {}
    if state.exists:
        for text, doc_id, *held, n in zip(*state.get, strict=True):
            firsts.setdefault(bytes(text), (doc_id, {}))[1][tuple(held)] = n
    changed = False
    for frame in frames:
        columns = [frame[c].tolist() for c in ("part", "mask", "flags", "n")]
        if key[0] < 0:
            for *held, n in zip(*columns, strict=True):
                deltas[tuple(held)] += n
            continue
        ids = frame["doc_id"].astype("int64").tolist()
        for text, doc_id, *held, n in zip(frame["text"].tolist(), ids, *columns, strict=True):
            changed |= _arrive(firsts, deltas, bytes(text), doc_id, tuple(held), n, False)
    if changed:
        rows = [(text, doc_id, *held, n) for text, (doc_id, holders) in firsts.items() for held, n in holders.items()]
        state.update(tuple(map(list, zip(*rows, strict=True))))
    made = [(*held, n) for held, n in deltas.items() if n]
    if made:
        yield pd.DataFrame(made, columns=["part", "mask", "flags", "n"])


def _stream_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session of the same context for streams with a state of about ``rows`` texts.

    The state of a partition is held in memory below ``ROWS_IN_MEMORY`` texts, else on disk in bounded memory.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    if rows > ROWS_IN_MEMORY * int(spark.conf.get("spark.sql.shuffle.partitions")):
        own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
        own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    return own


def audit_new_files(spark: SparkSession, documents: str, labels: DataFrame, folder: str, batches: int = BATCHES) -> None:
    """Read the files below ``documents`` that ``folder`` has not seen yet; its deltas are appended to ``folder``/deltas.

    ``folder`` must be shared by driver and executors.  The state of all texts stays there for the next call.
    """
    seen = spark.read.parquet(documents)
    keys = _state_keys(spark, seen, folder)
    own = _stream_session(spark, keys * TEXTS_HELD)
    files = max(1, -(-len(seen.inputFiles()) // batches))
    known = label_flags(labels).select(F.col("doc_id").alias("_labelled"), "flags", F.lit(0).alias("_no_id"))
    known.write.mode("overwrite").parquet(f"{folder}/labels")
    flags = own.read.schema(known.schema).parquet(f"{folder}/labels")
    # a stream reads folders; braces make a single file a pattern, which it reads too
    place = re.sub(r"([^/]+)/*$", r"{\1}", documents) if is_file(spark, documents) else documents
    stream = own.readStream.schema(seen.schema).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").parquet(place)
    # rows without an id meet no label; their digest spreads them over the tasks of the join
    marked = _marked(stream).withColumn("_spread", F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0))
    joined = marked.join(flags, (F.col("doc_id") == F.col("_labelled")) & (F.col("_spread") == F.col("_no_id")), "left")
    combined = _combined(joined.withColumn("flags", F.coalesce("flags", F.lit(0))), keys)
    deltas = combined.groupBy("state_key").applyInPandasWithState(_settled, DELTA, STATE, "append", GroupStateTimeout.NoTimeout)
    run = (
        deltas.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/deltas")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()


def _state_keys(spark: SparkSession, documents: DataFrame, folder: str) -> int:
    """How many keys the state of ``folder`` has: chosen by the rows of the first call, then kept."""
    place = f"{folder}/state_keys"
    if not exists(spark, place):
        documents.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / TEXTS_HELD)).alias("keys")).write.parquet(place)
    return spark.read.parquet(place).first()[0]


def part_counters(spark: SparkSession, folder: str) -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: rows by source and set of failed filters, after all retractions."""
    deltas = spark.read.schema(DELTA).parquet(f"{folder}/deltas")
    having = lambda bit: F.sum(F.when(F.col("flags").bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
    return deltas.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), having(GOOD).alias("n_good"), having(TOXIC).alias("n_toxic")).where("n != 0")


def order_effects(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters of ``part_counters``."""
    masks = F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))
    entry = F.struct("mask", F.struct("n", "n_good", "n_toxic").alias("c"))
    parts = counters.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("_c"))  # at most 32 entries
    slot = lambda c: F.transform(masks, lambda m: F.coalesce(F.try_element_at("_c", m)[c], F.lit(0)))
    slots = parts.select("part", *[slot(c).alias(c) for c in ("n", "n_good", "n_toxic")])
    orders = ",".join(map("".join, permutations(FILTERS)))
    bit_of = F.create_map(*[x for k, c in enumerate(FILTERS) for x in (F.lit(c), F.lit(1 << k))])
    bits_of = lambda letters: F.aggregate(
        F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda bits, c: bits + bit_of[c])
    steps = (
        slots.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("_bit", bits_of(F.expr("substring(filter_order, step, 1)")))
        .withColumn("_before", bits_of(F.expr("substring(filter_order, 1, step - 1)")))
    )

    def total(counts: str, wanted, of=lambda m: F.lit(1)) -> Column:  # noqa: ANN001
        return F.aggregate(F.filter(masks, wanted), F.lit(0).cast("long"), lambda s, m: s + F.col(counts)[m] * of(m))

    fails = lambda m: m.bitwiseAND(F.col("_bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("_before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # of all orders, the share in which a filter comes before the others that a document fails
    share = lambda m: F.expr("int(120)") / F.bit_count(m)
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), F.col("n")[F.col("_bit")].alias("unique_fails"),
        total("n_good", removed).alias("good_lost"), total("n_toxic", removed).alias("toxic_lost"),
        total("n", fails, lambda m: share(m).cast("long")).alias("shapley"),
    )


def filter_audit(spark: SparkSession, documents: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for all files below ``documents``.

    Every row counts, repeated rows each for themselves; rows with the same text and the same smallest id pass E
    together.  A null text is an empty text, a null source is the part of the empty string.  A row without id neither fails
    E nor makes another one fail, and has no labels.  A document that several label rows name is good or toxic if one of them says
    so.  An empty table has no parts and gives no rows.  Only doc_id, text and source are read, so other columns cannot clash.
    """
    folder = scratch_path(spark, "filter-audit")
    with Intermediate(spark) as made:
        made.own(folder)
        audit_new_files(spark, documents, labels, folder, batches)
        counters = checkpointed(part_counters(spark, folder))
    return order_effects(counters)

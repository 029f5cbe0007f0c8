"""Job status, progress and change events (batch forms).

Status log: ``event_id, ts, image_id, status, progress, message``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.numeric import half_up
from framelake.keyed import global_index

FINISHED, FAILED, SUBMITTED, LOADING = "extraction_complete", "error", "processing", "loading_progress"


def latest_per_image(status_log: DataFrame) -> DataFrame:
    """Last state, its progress and the last error per image; combines before the shuffle."""
    at = F.struct("ts", "event_id")
    return status_log.groupBy("image_id").agg(
        F.max_by(F.struct("status", "progress"), at).alias("_last"),
        F.max_by("message", F.when(F.col("status") == FAILED, at)).alias("last_error"),
    ).select("image_id", F.col("_last.status").alias("status"), F.col("_last.progress").alias("progress"), "last_error")


def latest_status(manifest: DataFrame, status_log: DataFrame) -> DataFrame:
    """One row per manifest image; images without messages are ``idle`` at progress 0."""
    return manifest.select("image_id").join(latest_per_image(status_log), "image_id", "left").withColumns({
        "status": F.coalesce("status", F.lit("idle")),
        "progress": F.coalesce("progress", F.lit(0).cast(status_log.schema["progress"].dataType)),
    })


def counting_columns() -> list[Column]:
    """Conditional counts shared by the batch and the streaming form."""
    return [
        F.count_if(F.col("status") == SUBMITTED).alias("submitted"),
        F.count_if(F.col("status") == FINISHED).alias("finished"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    ]


def with_pending(counts: DataFrame) -> DataFrame:
    """Add ``pending``, and ``ready``: there are images, nothing is pending and every image has a result.

    ``counts``: ``submitted, finished, failed, images, results``.
    """
    pending = F.col("submitted") - F.col("finished") - F.col("failed")
    return counts.withColumn("pending", pending).withColumn(
        "ready", (F.col("images") > 0) & (F.col("pending") == 0) & (F.col("results") == F.col("images"))
    )


def pending_counts(status_log: DataFrame, manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Work of the manifest's images, overall or per ``by`` columns of the manifest.

    ``images`` counts manifest rows, ``results`` those with a finished or failed message; messages of
    other images do not count.  An empty manifest is not ready.
    """
    per_image = status_log.groupBy("image_id").agg(*counting_columns())
    images = manifest.select("image_id", *[c for c in by or [] if c != "image_id"]).join(per_image, "image_id", "left")
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("submitted", "finished", "failed")]
    counts = images.groupBy(*(by or [])).agg(
        *totals, F.count(F.lit(1)).alias("images"), F.count_if(F.col("finished") + F.col("failed") > 0).alias("results")
    )
    return with_pending(counts)


def percent(done: Column, total: Column) -> Column:
    """Half-up whole percent; 0 of nothing is 0."""
    return F.coalesce(half_up(done / F.nullif(total, F.lit(0)) * 100), F.lit(0)).cast("int")


def pair_total(n: Column) -> Column:
    """Comparisons an all-pairs pass over n images needs; in doubles, as n squared leaves the range of an int at 46,341."""
    return n.cast("double") * (n - 1) / 2


def progress_percent(steps: DataFrame, order_by: list[str], rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Percent shown when step i of n starts."""
    numbered = global_index(steps, order_by, "_at", 0, rows_per_bucket)
    return numbered.withColumn("percent", percent(F.col("_at"), F.lit(steps.count()))).drop("_at")


def progress_milestones(status_log: DataFrame, every: int = 20) -> DataFrame:
    """Progress messages at multiples of ``every`` percent, and all other messages."""
    return status_log.where((F.col("status") != LOADING) | (F.col("progress") % every == 0))


def change_cells(changes: DataFrame, gap_seconds: float = 0.3) -> DataFrame:
    """Last change and first time per key and time cell, one gap long; combines before the shuffle.

    ``changes``: ``key, ts, event_id, ...``.
    """
    payload = [c for c in changes.columns if c not in ("key", "ts", "event_id")]
    micros = F.unix_micros("ts")
    return changes.groupBy("key", F.floor(micros / F.lit(_micros(gap_seconds))).alias("cell")).agg(
        F.max(F.struct("ts", "event_id", *payload)).alias("last"), F.min(micros).alias("first")
    )


def quiet_changes(cells: DataFrame, gap_seconds: float = 0.3) -> DataFrame:
    """The last changes of ``change_cells`` rows (one or more per key and cell) that silence follows.

    Two changes of a cell are closer than the gap, so only the last of a cell can survive, and only the
    first change of the next cell can still cancel it: one combining aggregate and one equi-join, and
    no key is ever sorted as a whole.
    """
    whole = cells.groupBy("key", "cell").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    following = whole.select(F.col("key").alias("_k"), (F.col("cell") - 1).alias("_c"), F.col("first").alias("_next"))
    quiet = F.col("_next").isNull() | (F.col("_next") - F.unix_micros("last.ts") >= _micros(gap_seconds))
    return (
        whole.join(following, (F.col("key") == F.col("_k")) & (F.col("cell") == F.col("_c")), "left")
        .where(quiet).select("key", "last.*")
    )


def _micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def debounce_changes(changes: DataFrame, gap_seconds: float = 0.3) -> DataFrame:
    """The last change of every burst: the one followed by at least ``gap_seconds`` of silence."""
    return quiet_changes(change_cells(changes, gap_seconds), gap_seconds)


def request_signatures(requests: DataFrame) -> DataFrame:
    """One signature per request from its settings and its ids in order.

    ``requests``: ``request_id, settings, pos, image_id``.  Every (position, id) is hashed and the hashes
    are combined with XOR and with a sum, so a request over the whole corpus is summed up in parallel
    and a repeated row changes the signature.
    """
    digest = F.md5(F.concat_ws("|", F.col("pos").cast("string"), F.col("image_id").cast("string")))

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")

    folded = requests.groupBy("request_id", "settings").agg(
        F.count(F.lit(1)).alias("images"), F.bit_xor(part(1)).alias("_a"), F.bit_xor(part(16)).alias("_b"),
        F.sum(part(1).cast("decimal(38,0)")).alias("_c"),
    )
    return folded.select(
        "request_id", "settings", "images",
        F.sha2(F.concat_ws("|", "settings", "images", "_a", "_b", F.col("_c").cast("string")), 256).alias("signature"),
    )


def apply_once(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests to run, in the order of ``request_id``: those that differ from the one applied last.

    ``ledger``: ``signature, applied_at``; its latest row was applied last before these requests.  A request
    is compared with its predecessor only, so A, B, A runs all three.  ``request_id`` is unique.
    """
    signed = global_index(request_signatures(requests), ["request_id"], "_n")
    previous = signed.select((F.col("_n") + 1).alias("_n"), F.col("signature").alias("_before"))
    start = ledger.agg(F.max_by("signature", "applied_at").alias("_before")).select(F.lit(0).cast("long").alias("_n"), "_before")
    return signed.join(previous.unionByName(start), "_n", "left").where(
        F.col("_before").isNull() | (F.col("_before") != F.col("signature"))
    ).drop("_n", "_before")


def pageview_url(events: DataFrame) -> DataFrame:
    """Add ``url``: origin + path, and ``?query`` when there is one."""
    query = F.nullif(F.col("query"), F.lit(""))
    return events.withColumn("url", F.concat("origin", "path", F.coalesce(F.concat(F.lit("?"), query), F.lit(""))))

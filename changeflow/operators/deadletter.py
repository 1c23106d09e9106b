"""Parse-or-quarantine routing and bounded retries. Bad rows never hold back good ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing import dlq_topic
from ..functions.wire import wire_decode

# Retry cap and first back-off.
MAX_RETRIES = 3
BACKOFF_MS = 1000

BAD_HEADER, BAD_JSON, UNKNOWN_SCHEMA = "BAD_HEADER", "BAD_JSON", "UNKNOWN_SCHEMA"
# Error class and header text of a record that cannot be parsed.
ERROR_CLASS = "org.apache.kafka.connect.errors.DataException"
POISON = "POISON_PILL"


def parse_messages(
    messages: DataFrame, fields: str, value: str = "value", known_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Decodes header and JSON once. ``reason`` is NULL for a good row; ``doc`` holds its ``fields``
    (a DDL list). A payload that is broken, or does not fit the fields, is BAD_JSON. A NULL value is
    a tombstone: good, without a document.
    """
    decoded = messages.withColumn("__wire", wire_decode(F.col(value)))
    parsed = decoded.withColumn(
        "__doc", F.from_json(F.col("__wire.payload").cast("string"), f"{fields}, _corrupt_record string"))
    reason = F.when(F.col(value).isNull(), F.lit(None).cast("string")).when(~F.col("__wire.valid"), BAD_HEADER).when(
        F.col("__doc").isNull() | F.col("__doc._corrupt_record").isNotNull(), BAD_JSON)
    if known_ids is not None:
        reason = reason.when(~F.col("__wire.schema_id").isin(list(known_ids)), UNKNOWN_SCHEMA)
    # A one-row inline: a later filter on the reason is then not pushed below the parsing, where it
    # would parse every message a second time.
    verdict = F.struct(F.col("__wire.schema_id").alias("schema_id"), reason.alias("reason"))
    judged = parsed.drop("schema_id", "reason").select("*", F.inline(F.array(verdict)))
    doc = F.when(F.col("reason").isNull(), F.col("__doc").dropFields("_corrupt_record"))
    return judged.withColumn("doc", doc).drop("__wire", "__doc")


def with_route(parsed: DataFrame) -> DataFrame:
    """Adds ``route``, so that one pass serves both sides."""
    return parsed.withColumn("route", F.when(F.col("reason").isNull(), "main").otherwise("dlq"))


def with_topic(parsed: DataFrame, main: Column, dlq: Column) -> DataFrame:
    """Adds the ``topic`` a parsed message goes to, its own or the dead-letter topic."""
    return parsed.withColumn("topic", F.when(F.col("reason").isNull(), main).otherwise(dlq))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull())


def dead(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull())


def dlq_envelope(
    rejected: DataFrame, original_topic: Column, system: Column, table: Column,
    value: str = "value", override: str | None = None,
) -> DataFrame:
    """Dead-letter records that keep the original bytes."""
    target = F.lit(override) if override else dlq_topic(system, table)
    carried = [c for c in rejected.columns if c not in ("doc", "reason", "schema_id", value)]
    return rejected.select(
        *carried, original_topic.alias("original_topic"), target.alias("dlq_topic"),
        F.lit(ERROR_CLASS).alias("error_class"), F.col("reason").alias("error_reason"),
        F.col(value).alias("payload"),
        F.create_map(F.lit("error_type"), F.lit(POISON), F.lit("retry_count"), F.lit("0")).alias("headers"))


def dlq_retry(
    letters: DataFrame, fields: str, known_ids: Sequence[int] | None = None, value: str = "payload",
    retries: str = "retry_count", max_retries: int = MAX_RETRIES, backoff_ms: int = BACKOFF_MS,
) -> DataFrame:
    """Parses dead letters again. ``outcome`` is REPLAYED, RETRY or PARKED; the count and the wait
    before the next attempt (doubling) are updated. Letters at the cap are not tried again."""
    capped = F.col(retries) >= max_retries
    parsed = parse_messages(letters, fields, value, known_ids)
    count = F.when(capped | F.col("reason").isNull(), F.col(retries)).otherwise(F.col(retries) + 1)
    out = parsed.withColumn(
        "outcome",
        F.when(capped, "PARKED").when(F.col("reason").isNull(), "REPLAYED")
        .when(F.col(retries) + 1 >= max_retries, "PARKED").otherwise("RETRY"))
    return out.withColumns({
        retries: count.cast("int"),
        "next_wait_ms": F.when(F.col("outcome") == "RETRY", F.lit(backoff_ms) * F.pow(F.lit(2), F.col(retries)).cast("long")),
    })


def attempt_due(letters: DataFrame, now: Column, failed_at: str = "failed_at", retries: str = "retry_count", backoff_ms: int = BACKOFF_MS) -> DataFrame:
    """Adds ``attempt_at``, the time of the next attempt, which is the last failure and a wait that doubles, and ``due``.

    The wait follows from the count that a letter carries, so it is the same whoever computes it and whenever.
    """
    wait = F.lit(backoff_ms) * F.pow(F.lit(2), F.greatest(F.col(retries) - 1, F.lit(0))).cast("long")
    at = F.when(F.col(retries) > 0, F.timestamp_millis(F.unix_millis(failed_at) + wait)).otherwise(F.col(failed_at))
    return letters.withColumn("attempt_at", at).withColumn("due", F.col("attempt_at") <= now)


def retry_round(
    letters: DataFrame, fields: str, now: Column, known_ids: Sequence[int] | None = None, value: str = "payload",
    failed_at: str = "failed_at", retries: str = "retry_count", max_retries: int = MAX_RETRIES, backoff_ms: int = BACKOFF_MS,
) -> DataFrame:
    """One round over all letters: those that are due are tried, the others come out as WAITING. A failure moves ``failed_at`` to ``now``,
    and ``attempt_at`` is the time of the attempt that comes next, NULL where there is none."""
    timed = attempt_due(letters, now, failed_at, retries, backoff_ms)
    tried = dlq_retry(timed.withColumn("__before", F.col(retries)), fields, known_ids, value, retries, max_retries, backoff_ms)
    ready, failed = F.col("due"), F.col("outcome") == "RETRY"
    kept = letters.select(retries).schema[retries].dataType
    return tried.withColumns({
        "outcome": F.when(ready, F.col("outcome")).otherwise("WAITING"),
        retries: F.when(ready, F.col(retries)).otherwise(F.col("__before")).cast(kept),
        failed_at: F.when(ready & failed, now).otherwise(F.col(failed_at)),
        "attempt_at": F.when(~ready, F.col("attempt_at")).when(failed, F.timestamp_millis(F.unix_millis(now) + F.col("next_wait_ms"))),
    }).drop("next_wait_ms", "due", "__before")


def replay_messages(tried: DataFrame, key: Column, topic: Column, value: str = "payload", retries: str = "retry_count") -> DataFrame:
    """Records for the topic that the replayed letters came from: the original bytes, and in the headers how often they were tried."""
    return tried.filter(F.col("outcome") == "REPLAYED").select(
        topic.alias("topic"), key.alias("key"), F.col(value).alias("value"),
        F.create_map(F.lit("replayed"), F.lit("true"), F.lit("retry_count"), F.col(retries).cast("string")).alias("headers"))

"""Retry rules and log lines of a fetch, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def retry_after(value: Column, now: Column | None = None) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date relative to `now`; never negative, null if neither."""
    text = F.trim(value)
    seconds = F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.cast("double"))
    dated = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]+, *", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    clock = F.unix_micros(F.current_timestamp() if now is None else now) / 1e6
    found = F.coalesce(seconds, F.unix_micros(dated) / 1e6 - clock)
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), found))


def backoff_seconds(attempt: Column, wait: Column, base: float = 0.5, cap: float = 8.0, jitter: Column | None = None) -> Column:
    """Delay before retry `attempt` (0 for the first): capped doubling plus jitter, never under the server's wish."""
    delay = F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt)) + (F.lit(0.0) if jitter is None else jitter)
    return F.greatest(delay, wait)


def log_line(ts: Column, url: Column, status: Column, nbytes: Column, elapsed: Column, attempt: Column, error: Column, wait: Column) -> Column:
    """One attempt as key=value text; missing status and error show as "-", a missing wait is left out."""
    line = F.format_string(
        "ts=%s url=%s status=%s bytes=%d elapsed=%.3f attempt=%d error=%s",
        ts, url, F.coalesce(status.cast("string"), F.lit("-")), nbytes.cast("bigint"), elapsed, attempt, F.coalesce(F.when(error != "", error), F.lit("-")),
    )
    return F.when(wait.isNotNull(), F.concat(line, F.format_string(" retry_after=%.3f", wait))).otherwise(line)

"""Who may see what: tenants, actors and container tags, and the gates that every read passes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratamem.session import read_table

#: What a container tag looks like.
TAG = re.compile(r"^[a-zA-Z0-9_:-]{1,100}$")


def tenant_scan(df: DataFrame, tenant: str | None) -> DataFrame:
    """The rows of one tenant; none at all when no tenant is set. The filter reaches the file scan."""
    return df.where(F.col("tenant_id") == tenant) if tenant else df.where(F.lit(False))


def tenant_table(spark: SparkSession, sf_dir: str, name: str, tenant: str | None) -> DataFrame:
    return tenant_scan(read_table(spark, sf_dir, name), tenant)


def unexpired(now: Column) -> Column:
    return F.col("forget_after").isNull() | (F.col("forget_after") > now)


def current() -> Column:
    """The gate of matching and graph reads: latest and active, whatever the time to live."""
    return F.col("is_latest") & (F.col("status") == "active")


def live(now: Column) -> Column:
    """The gate of recall: latest, active and not past its time to live."""
    return current() & unexpired(now)


def live_or_forgotten(now: Column) -> Column:
    """As :func:`live`, and forgotten rows even past their time to live."""
    return live(now) | (F.col("status") == "forgotten")


def has_all_tags(tags: Sequence[str], column: str = "container_tags") -> Column:
    """Every tag asked for is there; no tags ask for nothing."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col(column))) == 0 if tags else F.lit(True)


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """A half-open period holds at ``t``; a null end is open."""
    return (F.col(start) <= t) & (F.col(end).isNull() | (t < F.col(end)))


def clamp_limit(limit: int | None, default: int = 10, most: int = 100) -> int:
    return max(1, min(most, default if limit is None else limit))


def validate_tags(tag: str | None = None, tags: Sequence[str] | None = None) -> str:
    """The one container tag of a request, given as ``tag`` or as a list of one."""
    given = [tag] if tag is not None else list(tags or [])
    if len(given) != 1:
        raise ValueError("exactly one container tag is needed")
    if not TAG.match(given[0]):
        raise ValueError("a container tag has 1 to 100 letters, digits, '_', ':' or '-'")
    return given[0]


def parse_container_tag(tag: str) -> tuple[str, list[str]]:
    """Actor and tags of one container tag string.

    One segment is the actor. With ``user`` before the last segment the actor is
    ``user:<last>`` and the leading segments pair up as ``key:value``, an odd one alone.
    Otherwise the last segment is the actor and each other one a tag.
    """
    parts = tag.split(":")
    if len(parts) == 1:
        return tag, []
    if parts[-2] == "user":
        lead = parts[:-2]
        return f"user:{parts[-1]}", [":".join(lead[i : i + 2]) for i in range(0, len(lead), 2)]
    return parts[-1], parts[:-1]


def format_container_tag(actor: str, tags: Sequence[str]) -> str:
    return ":".join([*tags, actor])


def container_actor(tag: Column) -> Column:
    """:func:`parse_container_tag` as columns: the actor."""
    p = F.split(tag, ":")
    n = F.size(p)
    return F.when(n == 1, tag).when(F.element_at(p, -2) == "user", F.concat(F.lit("user:"), F.element_at(p, -1))).otherwise(F.element_at(p, -1))


def container_tags(tag: Column) -> Column:
    """:func:`parse_container_tag` as columns: the tags."""
    p = F.split(tag, ":")
    n = F.size(p)
    lead = F.slice(p, F.lit(1), F.greatest(n - 2, F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.floor((n - 3) / 2).cast("int")), lambda i: F.array_join(F.slice(lead, i * 2 + 1, F.lit(2)), ":"))
    none = F.array().cast("array<string>")
    return F.when(n == 1, none).when(F.element_at(p, -2) == "user", F.when(n > 2, pairs).otherwise(none)).otherwise(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))))


#: The shape of an RFC 3339 time.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339(c: Column, field: str) -> Column:
    """The instant of an RFC 3339 text; null stays null, anything else is an error that names the field."""
    at = F.when(c.rlike(RFC3339), F.try_to_timestamp(F.upper(c)))
    return F.when(c.isNull() | at.isNotNull(), at).otherwise(F.raise_error(F.lit(f"{field} is not a valid RFC 3339 time")))


def event_date(dates: Column) -> Column:
    """The first of several event dates, which is the one that counts."""
    return rfc3339(F.when(F.size(dates) > 0, F.element_at(dates, 1)), "event date")


def interval_end(start: Column, end: Column) -> Column:
    """The end of a period, or none where it does not lie after the start."""
    return F.when(end > start, end)

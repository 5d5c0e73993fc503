"""Resolution of new facts against the facts already known.

A candidate repeats a known value (its confidence grows), replaces the current value of a
single-valued key, becomes history if it arrives late, or is simply added. Two forms: a
closed form with windows for facts that arrive in order of effect, and a fold over each key's
facts in order of arrival for everything else. Both are deterministic.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: First confidence, what a repeat adds, the bar for profiles.
CONFIDENCE, BUMP, BAR = 0.5, 0.1, 0.8


def decide(value: str | None, single_valued: bool, matches: Sequence[tuple[int, str | None]]) -> tuple[str, list[int]]:
    """What to do with a candidate, given ``(id, value)`` of the live facts of its key.

    ``("dedup", [id])`` for the first with exactly its value, ``("supersede", ids)`` for a
    single-valued candidate with another value, else ``("insert", [])``.
    """
    if value is not None:
        for i, v in matches:
            if v == value:
                return "dedup", [i]
    if single_valued:
        other = [i for i, v in matches if v != value]
        if other:
            return "supersede", other
    return "insert", []


def bumped(repeats: Column, first: Column | None = None) -> Column:
    """Confidence after so many repeats, at most 1, rounded so that three repeats reach the bar."""
    return F.round(F.least(F.lit(1.0), (first if first is not None else F.lit(CONFIDENCE)) + F.lit(BUMP) * repeats), 6)


def resolve_in_order(facts: DataFrame, key: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """Segments of single-valued keys whose facts arrive in order of effect.

    ``key + (valid_from, valid_to, value, n_reports, confidence, is_latest, fact_id,
    supersedes_id)``: repeats of the current value add confidence, another value closes the
    segment and opens the next. ``tie`` is a unique column that orders equal times. Rows with
    a null time or value are left out.
    """
    rows = facts.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(*key, F.col(at).alias("t"), F.col(value).alias("value"), F.col(tie).alias("tie"))
    order = Window.partitionBy(*key).orderBy("t", "tie")
    prev = F.lag("value").over(order)
    run = rows.withColumn("new", F.when(prev.isNull() | (prev != F.col("value")), 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    seg = run.groupBy(*key, "run").agg(F.min("t").alias("valid_from"), F.first("value").alias("value"), F.count("*").alias("n_reports"), F.min_by("tie", F.struct("t", "tie")).alias("fact_id"))
    by_run = Window.partitionBy(*key).orderBy("run")
    end = F.lead("valid_from").over(by_run)
    return seg.select(*key, "valid_from", end.alias("valid_to"), "value", "n_reports", bumped(F.col("n_reports") - 1).alias("confidence"), end.isNull().alias("is_latest"), "fact_id", F.lag("fact_id").over(by_run).alias("supersedes_id"))


def resolve_multi_valued(facts: DataFrame, key: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """One live row per key and value: first seen, reports, confidence."""
    rows = facts.where(F.col(value).isNotNull())
    return rows.groupBy(*key, F.col(value).alias("value")).agg(F.min(at).alias("valid_from"), F.count("*").alias("n_reports"), F.min_by(tie, F.struct(at, tie)).alias("fact_id")).withColumn("confidence", bumped(F.col("n_reports") - 1))


STATE = "fact_id bigint, value string, valid_from bigint, valid_to bigint, confidence double, is_latest boolean, status string, supersedes_id bigint, overlaps boolean"


FIELDS = [c.split(" ")[0] for c in STATE.split(", ")]


def fold(facts: Iterable[tuple[int, int, int | None, str | None, bool]], known: Sequence[dict] = ()) -> list[dict]:
    """The rows of one key after its facts ``(fact_id, from, to, value, single_valued)`` in order of arrival.

    ``known`` are the rows there already are; they are not changed in place. An end that is
    not after the start is none. A newer value closes the current one at its start (whatever
    end that had). A value that takes effect before the current one becomes active history up
    to the next start or its own end, whichever comes first. One that takes effect exactly
    when the current one does contradicts it: status ``conflict``, nothing else changes. A
    late value inside a closed stretch is kept and flagged ``overlaps``.
    """
    rows = [dict(r) for r in known]
    live = [r for r in rows if r["is_latest"] and r["status"] == "active"]
    starts = sorted(r["valid_from"] for r in rows if r["status"] != "conflict")
    for fact_id, start, end, value, single in facts:
        end = end if end is not None and end > start else None
        what, ids = decide(value, single, [(r["fact_id"], r["value"]) for r in live])
        new = dict(fact_id=fact_id, value=value, valid_from=start, valid_to=end, confidence=CONFIDENCE, is_latest=True, status="active", supersedes_id=None, overlaps=False)
        if what == "dedup":
            hit = next(r for r in live if r["fact_id"] == ids[0])
            hit["confidence"] = round(min(1.0, hit["confidence"] + BUMP), 6)
            continue
        if what == "supersede":
            wanted = set(ids)
            prior = [r for r in live if r["fact_id"] in wanted]
            newest = max(prior, key=lambda r: (r["valid_from"], r["fact_id"]))
            if start > newest["valid_from"]:
                for r in prior:
                    r |= dict(valid_to=start, status="superseded", is_latest=False)
                live = [r for r in live if r["fact_id"] not in wanted]
                new["supersedes_id"] = newest["fact_id"]
            elif start == newest["valid_from"]:
                new |= dict(status="conflict", is_latest=False)
            else:
                following = starts[bisect_right(starts, start)]  # the current one's start at the latest
                inside = [r for r in rows if r["status"] != "conflict" and r["valid_from"] <= start and r["valid_to"] is not None and start < r["valid_to"]]
                new |= dict(is_latest=False, valid_to=following if end is None else min(end, following), overlaps=bool(inside))
                if any(r["status"] == "active" for r in inside):
                    new["status"] = "conflict"
        rows.append(new)
        if new["is_latest"]:
            live.append(new)
        if new["status"] != "conflict":
            insort(starts, start)
    return rows


def as_facts(pdf: pd.DataFrame) -> list[tuple[int, int, int | None, str | None, bool]]:
    """The rows of :func:`fold_columns` as facts in order of arrival."""
    pdf = pdf.sort_values(["_arrival", "_id"])
    ends = [None if pd.isna(e) else int(e) for e in pdf["_end"]]
    return [(int(i), int(t), e, None if pd.isna(v) else v, bool(s)) for i, t, e, v, s in zip(pdf["_id"], pdf["_at"], ends, pdf["_value"], pdf["_single"])]


def as_frame(rows: list[dict], names: list[str], key: Sequence) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=FIELDS)
    for c in ("valid_to", "supersedes_id"):
        out[c] = out[c].astype("Int64")
    for c, v in reversed(list(zip(names, key))):
        out.insert(0, c, v)
    return out


def fold_columns(facts: DataFrame, names: list[str], arrival: str, at_us: str, value: str, fact_id: str, single_valued: str, end_us: str | None) -> DataFrame:
    """The columns that a fold reads, under names of their own; facts without a start are left out."""
    end = F.col(end_us) if end_us else F.lit(None).cast("bigint")
    return facts.where(F.col(at_us).isNotNull()).select(
        *names, F.col(arrival).alias("_arrival"), F.col(at_us).alias("_at"), end.alias("_end"), F.col(value).alias("_value"), F.col(fact_id).alias("_id"), F.col(single_valued).alias("_single")
    )


def key_schema(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)


def resolve_by_fold(facts: DataFrame, key: Sequence[str], arrival: str, at_us: str, value: str, fact_id: str, single_valued: str, end_us: str | None = None) -> DataFrame:
    """:func:`fold` over every key, in order of ``arrival`` and id.

    One key's facts go to one task, as each decision depends on the one before; use
    :func:`resolve_in_order` where arrival follows effect, which has no such bound.
    """
    names = list(key)
    rows = fold_columns(facts, names, arrival, at_us, value, fact_id, single_valued, end_us)

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return as_frame(fold(as_facts(pdf)), names, k)

    return rows.groupBy(*names).applyInPandas(run, f"{key_schema(rows, names)}, {STATE}")


def resolve_against(known: DataFrame, facts: DataFrame, key: Sequence[str], arrival: str, at_us: str, value: str, fact_id: str, single_valued: str, end_us: str | None = None) -> DataFrame:
    """``key + row columns`` of every key that ``facts`` touch, after they were folded into the ``known`` rows.

    ``known`` has the key and the row columns. Only the touched keys' rows are read into the
    fold. Rows that nothing changed come out as they were.
    """
    names = list(key)
    new = fold_columns(facts, names, arrival, at_us, value, fact_id, single_valued, end_us)
    touched = known.select(*names, *FIELDS).join(new.select(*names).distinct(), names, "left_semi")

    def run(k: tuple, old: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{c: None if c in ("value", "valid_to", "supersedes_id") and pd.isna(v) else v for c, v in zip(FIELDS, r)} for r in old[FIELDS].sort_values(["valid_from", "fact_id"]).itertuples(index=False)]
        return as_frame(fold(as_facts(pdf), rows), names, k)

    return touched.groupBy(*names).cogroup(new.groupBy(*names)).applyInPandas(run, f"{key_schema(new, names)}, {STATE}")


def overlapping(segments: DataFrame, key: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Segments that begin before an earlier one of their key has ended: none, if all is well.

    A running maximum of the ends replaces a self-join over the key.
    """
    far = F.coalesce(F.col(end), F.lit(2**62) if dict(segments.dtypes)[end] == "bigint" else F.lit("9999-12-31").cast("timestamp"))
    before = Window.partitionBy(*key).orderBy(start, far).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("_reach", F.max(far).over(before)).where(F.col(start) < F.col("_reach")).drop("_reach")

"""Mixing sources to target shares of the total size in tokens.

Time runs from 0 (start of training) to 1. Source s has a weight schedule w_s(t), linear
between any number of knots, whose integral is scaled to its share of the tokens. A document
copy that starts after a part x of its source's tokens stands at the t at which the integral
of the schedule reaches x, found in closed form within its segment; sorting all copies by t
gives the training order, in which at any time sources are read in the ratio of their weights.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratamem.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Buckets of the shuffled order in each source; prefix sums run within a bucket.
BUCKETS = 4096
_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path)
        for batch in batches:
            n = [len(own.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def token_counts(df: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)``; rows with a null source or text take no part."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    src = src.where("doc_id is not null and source is not null and text is not null")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_count(tokenizer), f"doc_id {kind}, source string, n_tokens bigint")


def plan_shares(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens to take of each source.

    Without ``total``, the largest mix in which every source that has text reaches its share
    without exceeding its repeats; shares of sources without text go to the others in
    proportion. With ``total``, sources that cannot supply their part give all they may, and
    the rest is taken from the others in proportion to their shares, as far as it goes.
    """
    able = {s: m * sizes.get(s, 0) for s, (q, m) in targets.items() if q > 0 and m * sizes.get(s, 0) > 0}
    if not able:
        return {}
    whole = sum(targets[s][0] for s in able)
    share = {s: targets[s][0] / whole for s in able}
    if total is None:
        size = min(able[s] / share[s] for s in able)
        return {s: min(float(able[s]), size * share[s]) for s in able}
    take, open_, left = {}, dict(share), float(total)
    while open_:
        part = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / part >= able[s]]
        if not full:
            return take | {s: left * q / part for s, q in open_.items()}
        for s in full:
            take[s] = float(able[s])
            del open_[s]
        left = max(0.0, float(total) - sum(take.values()))
    return take


Knots = Sequence[tuple[float, float]]


def segments(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """``(x, t, dt, w, dw)`` of each stretch of a schedule: the part of the whole before it, its place, length, weight and rise; weights scaled so that the whole is 1."""
    t, w = [float(k[0]) for k in knots], [float(k[1]) for k in knots]
    if len(knots) < 2 or t[0] != 0 or t[-1] != 1 or any(a >= b for a, b in zip(t, t[1:])) or min(w) < 0:
        raise ValueError("a schedule has knots at growing times from 0 to 1 and no negative weight")
    area = [(b - a) * (x + y) / 2 for a, b, x, y in zip(t, t[1:], w, w[1:])]
    whole = sum(area)
    if not whole > 0:
        raise ValueError("a schedule needs a weight somewhere")
    return [(sum(area[:k]) / whole, t[k], t[k + 1] - t[k], w[k] / whole, (w[k + 1] - w[k]) / whole) for k in range(len(area)) if area[k] > 0]


def _position(x: Column, parts: Column) -> Column:
    """The time at which the schedule in ``parts`` has used up a part ``x`` of its tokens."""
    at = F.element_at(F.filter(parts, lambda p: p["x"] <= x), -1)
    r = (x - at["x"]) / at["dt"]
    u = F.when(r > 0, 2 * r / (at["w"] + F.sqrt(F.greatest(F.lit(0.0), at["w"] * at["w"] + 2 * at["dw"] * r)))).otherwise(0.0)
    return F.least(F.lit(1.0), at["t"] + at["dt"] * F.least(F.lit(1.0), u))


def _schedules(share: dict[str, float], ramps: dict[str, float], given: dict[str, Knots]) -> dict[str, Knots]:
    """The schedule of each source: the one given, a ramp, or, beside ramps, the opposite slope that keeps the weights' sum even."""
    sloped = {s: a for s, a in ramps.items() if s in share}
    rest = [s for s in share if s not in ramps and s not in given]
    spare = sum(share[s] for s in rest)
    slopes = sloped | {s: -sum(share[r] * a for r, a in sloped.items()) / spare for s in rest if sloped and spare}
    if any(not -1 < a < 1 for a in slopes.values()):
        raise ValueError("ramps must lie in (-1, 1), and so must the slope that is left to the other sources")
    return {s: given.get(s, [(0.0, 1 - slopes.get(s, 0.0)), (1.0, 1 + slopes.get(s, 0.0))]) for s in share}


def mixture(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_tokens: int | None = None, ramps: dict[str, float] | None = None, schedules: dict[str, Knots] | None = None, tokenizer: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """``(doc_id, source, n_tokens, copy_no, position, target_share, taken_share)``, one row per use, in training order.

    ``targets`` has ``source, target_share, max_repeats`` and one row per source (a small
    table by definition; it and one row of sums per source are all that reaches the driver).
    Every document is used floor(d) or ceil(d) times, d being its source's demand over its
    size; the one more goes to a pseudo-random part of the source. ``schedules`` gives knots
    ``(time, weight)`` for some sources; ``ramps`` gives a slope a in (-1, 1) for others, for
    weights from 1 - a to 1 + a, and what neither names takes the opposite slope, so that the
    weights' sum stays even (a ValueError says if it cannot). ``taken_share`` is the
    share the source reaches in the whole result. Documents whose source is no target, is
    null, or whose text is null or has no token take no part; a repeated id counts as
    another document.
    """
    tokens = materialize(token_counts(df, id_col, source_col, text_col, tokenizer).where("n_tokens > 0"), "tokens")
    spec = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").collect()}
    spark = df.sparkSession
    named = tokens.where(F.col("source").isin(*spec)) if spec else tokens.limit(0)
    keyed = named.withColumn("h", F.xxhash64("doc_id", "source", F.lit(seed))).withColumn("b", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sums = keyed.groupBy("source", "b").agg(F.sum("n_tokens").alias("in_bucket"))
    sizes = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("in_bucket").alias("n")).collect()}
    take = plan_shares(sizes, spec, total_tokens)
    whole = sum(take.values()) or 1.0
    courses = _schedules({s: take[s] / whole for s in take}, ramps or {}, {s: k for s, k in (schedules or {}).items() if s in take})
    plan = spark.createDataFrame(
        [(s, float(take[s]), float(sizes[s]), segments(courses[s]), spec[s][0], spec[s][1]) for s in take],
        "source string, demand double, size double, parts array<struct<x: double, t: double, dt: double, w: double, dw: double>>, target_share double, max_repeats int",
    )
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a source
    starts = sums.withColumn("base", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).select("source", "b", "base")
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, ["source", "b"]).withColumn("offset", F.col("base") + F.col("ahead"))
    copies = F.ceil((F.col("demand") - F.col("offset")) / F.col("size"))
    used = placed.join(F.broadcast(plan), "source").withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("max_repeats")).cast("int")).where("copies > 0")
    taken = used.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()
    real = {r["source"]: r["n"] for r in taken}
    reached = spark.createDataFrame([(s, n / sum(real.values())) for s, n in real.items()], "source string, taken_share double")
    rows = used.join(F.broadcast(reached), "source").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = _position(F.least(F.lit(1.0), (F.col("offset") + F.col("copy_no") * F.col("size")) / F.col("demand")), F.col("parts"))
    return rows.select("doc_id", "source", "n_tokens", "copy_no", at.alias("position"), "target_share", "taken_share").orderBy("position", "source", "doc_id", "copy_no")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, n_documents, most_uses, tokens, actual_share)`` for every target source."""
    per_doc = mix.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    zero = F.lit(0).cast("bigint")
    return (
        targets.join(got, "source", "left")
        .join(F.broadcast(whole))
        .select("source", "target_share", "max_repeats", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("most_uses", zero).alias("most_uses"), F.coalesce("tokens", zero).alias("tokens"), F.round(F.coalesce("tokens", zero) / F.col("whole"), 6).alias("actual_share"))
    )

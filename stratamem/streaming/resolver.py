"""Streaming resolution: facts arrive in micro-batches, each key keeps its resolved rows as state.

Late facts are placed, never dropped, so there is no watermark. A batch folds a key's new
facts into its rows in order of arrival and emits the rows that changed, with the number of
facts the key has had, so a reader keeps the greatest version per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratamem.operators.resolve import FIELDS, STATE, as_facts, as_frame, fold, fold_columns, key_schema

_STATE_COLUMNS = ", ".join(f"s_{c.split(' ')[0]} array<{c.split(' ')[1]}>" for c in STATE.split(", "))


def resolve_stream(facts: DataFrame, key: Sequence[str], arrival: str, at_us: str, value: str, fact_id: str, single_valued: str, end_us: str | None = None) -> DataFrame:
    """``key + row columns + version`` for every row that a micro-batch changes (update mode).

    The state of a key is its rows and the ids of the facts it has had. A fact delivered
    twice (same id) is taken once, so a replayed batch changes nothing.
    """
    names = list(key)
    rows = fold_columns(facts, names, arrival, at_us, value, fact_id, single_valued, end_us)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, *columns = (list(x) for x in state.get) if state.exists else ([], *([] for _ in FIELDS))
        old = [dict(zip(FIELDS, r)) for r in zip(*columns)]
        had = set(ids)
        new = []
        for fact in as_facts(pd.concat(list(parts))):
            if fact[0] not in had:
                had.add(fact[0])
                ids.append(fact[0])
                new.append(fact)
        now = fold(new, old)
        state.update((ids, *([r[c] for r in now] for c in FIELDS)))
        before = {r["fact_id"]: r for r in old}
        out = as_frame([r for r in now if before.get(r["fact_id"]) != r], names, k)
        out["version"] = len(ids)
        yield out

    return rows.groupBy(*names).applyInPandasWithState(
        run, f"{key_schema(rows, names)}, {STATE}, version bigint", f"ids array<bigint>, {_STATE_COLUMNS}", "update", GroupStateTimeout.NoTimeout
    )


def latest_rows(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The current state from the appended changes: each row's greatest version."""
    cols = [c for c in changes.columns if c not in (*key, "fact_id")]
    best = changes.groupBy(*key, "fact_id").agg(F.max_by(F.struct(*cols), "version").alias("r"))
    return best.select(*key, "fact_id", "r.*")


def run_available(source: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything there is, appending each batch's changes once.

    Each batch writes its own folder by id, so a batch that is run again replaces its output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    source.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Queries of problem 3: history of changing entity attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratamem.operators import history
from stratamem.session import read_table


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of both tables: extracted facts and periodic snapshots."""
    synonyms = read_table(spark, sf_dir, "attribute_synonyms")
    facts = read_table(spark, sf_dir, "candidates")
    effect = F.when(F.col("temporal_kind") == "as_of", F.col("as_of_ts")).when(F.col("temporal_kind") == "range", F.col("range_from"))
    kept = read_table(spark, sf_dir, "existing_matches")
    return history.reports(facts, effect, synonyms).unionByName(history.reports(kept, F.col("valid_from"), synonyms))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(change_log(spark, sf_dir)).select(*history.KEY, "from_us", "to_us")


def attribute_list(spark: SparkSession, sf_dir: str) -> list[str]:
    """The canonical attributes; ``attribute_synonyms`` is a small table of fixed size."""
    return [r["canonical"] for r in read_table(spark, sf_dir, "attribute_synonyms").select("canonical").distinct().orderBy("canonical").collect()]


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.combined_history(history.versions(change_log(spark, sf_dir)), attribute_list(spark, sf_dir))


_LOG = r"""
with raw as (
  select tenant_id, actor_id, subject, attribute, value, recorded_at,
         coalesce(case temporal_kind when 'as_of' then as_of_ts when 'range' then range_from end, recorded_at) as eff
  from candidates where single_valued
  union all
  select tenant_id, actor_id, subject, attribute, value, recorded_at, coalesce(valid_from, recorded_at)
  from existing_matches where single_valued
), keyed as (
  select tenant_id, actor_id,
         regexp_replace(trim(regexp_replace(lower(subject), '\s+', ' ', 'g')), '^[\s.:,;?!]+|[\s.:,;?!]+$', '', 'g') as subject_key,
         regexp_replace(trim(regexp_replace(lower(attribute), '\s+', ' ', 'g')), '^[\s.:,;?!]+|[\s.:,;?!]+$', '', 'g') as a,
         trim(regexp_replace(lower(value), '\s+', ' ', 'g')) as val, eff, recorded_at
  from raw where trim(regexp_replace(subject, '\s+', ' ', 'g')) <> '' and trim(regexp_replace(attribute, '\s+', ' ', 'g')) <> ''
    and trim(regexp_replace(value, '\s+', ' ', 'g')) <> ''
), named as (
  select tenant_id, actor_id, subject_key, coalesce(s.canonical, a) as attribute_key, epoch_us(eff) as at_us, epoch_us(recorded_at) as rec, val
  from keyed left join (select surface, min(canonical) as canonical from attribute_synonyms group by surface) s on s.surface = a
  where subject_key <> '' and a <> ''
), one as (
  select tenant_id, actor_id, subject_key, attribute_key, at_us, max({'r': rec, 'v': val}).v as val
  from named where attribute_key <> '' and at_us is not null group by all
), marked as (
  select *, lag(val) over (partition by tenant_id, actor_id, subject_key, attribute_key order by at_us) as prev from one
), vers as (
  select tenant_id, actor_id, subject_key, attribute_key, at_us as from_us, val,
         coalesce(lead(at_us) over (partition by tenant_id, actor_id, subject_key, attribute_key order by at_us), -1) as to_us
  from marked where prev is null or prev <> val
)"""

_STATE = r""", canon as (select distinct canonical from attribute_synonyms),
cuts as (select distinct tenant_id, actor_id, subject_key, from_us from vers where attribute_key in (select canonical from canon)),
states as (
  select c.tenant_id, c.actor_id, c.subject_key, c.from_us,
         '{' || string_agg(to_json(v.attribute_key)::varchar || ':' || to_json(v.val)::varchar, ',' order by v.attribute_key) || '}' as state
  from cuts c join vers v on c.tenant_id is not distinct from v.tenant_id and c.actor_id is not distinct from v.actor_id
    and c.subject_key = v.subject_key and v.from_us <= c.from_us and (v.to_us = -1 or c.from_us < v.to_us)
    and v.attribute_key in (select canonical from canon)
  group by all
), moved as (select *, lag(state) over (partition by tenant_id, actor_id, subject_key order by from_us) as prev from states)
select tenant_id, actor_id, subject_key, from_us,
       coalesce(lead(from_us) over (partition by tenant_id, actor_id, subject_key order by from_us), -1) as to_us, state
from moved where prev is null or prev <> state"""

QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
ORACLES = {
    "p3_found": _LOG + " select tenant_id, actor_id, subject_key, attribute_key, from_us, to_us from vers",
    "p3_entities": _LOG + _STATE,
}

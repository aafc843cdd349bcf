"""Incremental precomputation: uploads in, affected caches, missing pairs, legs and states out, as micro-batches that may be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.operators.aggregates import incomplete_pairs, missing_pairs
from trailspark.operators.finder import stale
from trailspark.operators.spatial import affected, nearest_neighbours


def plan_batch(caches: DataFrame, new_ids: DataFrame, legs: DataFrame, version: str, radius_m: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(ids to be marked, pairs to be fetched) for new caches: themselves, the affected, and the stages of their adventures."""
    fresh = caches.join(new_ids, "id", "left_semi")
    siblings = caches.join(fresh.filter("adventure_id IS NOT NULL").select("adventure_id").distinct(), "adventure_id", "left_semi").select("id")
    ids = new_ids.select("id").union(affected(caches, new_ids, radius_m)).union(siblings).distinct()
    origins = caches.join(ids, "id", "left_semi")
    near = nearest_neighbours(origins, caches, k, radius_m).select("from_id", "to_id")
    s = origins.filter("adventure_id IS NOT NULL").select("adventure_id", F.col("id").alias("from_id"))
    own = s.join(s.withColumnRenamed("from_id", "to_id"), "adventure_id").filter("from_id <> to_id").select("from_id", "to_id")
    return ids, missing_pairs(near.union(own).distinct(), legs, version)


def run(uploads: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch of new ids goes to ``handle`` with its number, which makes repeats recognisable."""
    return uploads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retrigger(view: DataFrame, kind: str, version: str, now, ttl_days: int, chunk: int = 50, most: int = 10_000) -> DataFrame:
    """(owner, chunk, ids): stale caches of a kind by owner in chunks, at most so many in order of id."""
    test = stale(F.col("state"), F.col("osrm_version"), version, F.col("fetched_at"), now, ttl_days)
    ids = view.filter((F.col("kind") == kind) & test).orderBy("id").limit(most)
    n = F.row_number().over(Window.partitionBy("owner").orderBy("id")) - 1
    return ids.withColumn("chunk", F.floor(n / chunk)).groupBy("owner", "chunk").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def adventure_backfill(view: DataFrame, stages: DataFrame, legs: DataFrame, version: str, now, ttl_days: int) -> DataFrame:
    """Ids of stages that are stale or whose adventures lack legs."""
    test = stale(F.col("state"), F.col("osrm_version"), version, F.col("fetched_at"), now, ttl_days)
    old = view.filter((F.col("kind") == "walking") & test).join(stages.select("id"), "id", "left_semi").select("id")
    return old.union(incomplete_pairs(stages, legs.filter(F.col("osrm_version") == version))).distinct()


def late_guard(stored: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key by event time; among equal times the incoming one."""
    rows = stored.withColumn("__n", F.lit(0)).unionByName(incoming.withColumn("__n", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("__n"))
    return rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__n")


def retry_states(attempts: DataFrame, most: int = 3, delay_s: float = 5.0) -> DataFrame:
    """(job, state, tries, at, next_at): done after a success, failed after ``most`` tries, else waiting, twice as long after each try.  attempts: job, at (seconds), ok."""
    by = attempts.groupBy("job").agg(F.bool_or("ok").alias("ok"), F.count("*").alias("tries"), F.max("at").alias("at"))
    state = F.when(F.col("ok"), "done").when(F.col("tries") >= most, "failed").otherwise("waiting")
    next_at = F.when(state == "waiting", F.col("at") + F.lit(float(delay_s)) * F.pow(F.lit(2.0), F.col("tries") - 1))
    return by.select("job", state.alias("state"), "tries", "at", next_at.alias("next_at"))


def retained(jobs: DataFrame, now_s: float, done_s: float = 3600.0, done_most: int = 1000, failed_s: float = 7 * 24 * 3600.0) -> DataFrame:
    """Jobs that are kept: the newest done ones of a while, failed ones for longer, all that wait.  jobs: job, state, at (seconds)."""
    age = F.lit(float(now_s)) - F.col("at")
    done = jobs.filter((F.col("state") == "done") & (age <= done_s)).orderBy(F.desc("at"), "job").limit(done_most)
    return done.unionByName(jobs.filter(((F.col("state") == "failed") & (age <= failed_s)) | (F.col("state") == "waiting")))

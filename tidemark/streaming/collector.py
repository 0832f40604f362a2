"""One collection run over discovered candidates, as keyed state: a pure function of its tables, and a foreachBatch sink around it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing, text
from tidemark.functions.urls import identity
from tidemark.operators import predicates, ranking

STATE = "key string, source_id string, url string, title string, hash string, status string, attempts int, first_seen timestamp_ntz, last_attempt timestamp_ntz, error string"


class Run(NamedTuple):
    state: DataFrame
    developments: DataFrame
    reviews: DataFrame
    health: DataFrame


def candidate_key(url: Column, hash_: Column) -> Column:
    """A candidate's key in the state: its source's identity, and the version of the text where it stands for a change."""
    return hashing.state_key(identity(url), hash_)


def fresh(discovered: DataFrame, state: DataFrame, tracked: DataFrame) -> DataFrame:
    """The first discovery of each key that the state doesn't have; without a version, only sources that aren't tracked yet."""
    keyed = discovered.withColumn("key", candidate_key(F.col("url"), F.col("hash")))
    first = ranking.first_by(keyed, "key", "found", "url", "title").withColumn("_identity", identity(F.col("url")))
    known = tracked.select(identity(F.col("url")).alias("_identity")).distinct().withColumn("_known", F.lit(True))
    new = first.join(known, "_identity", "left").where(F.col("hash").isNotNull() | F.col("_known").isNull()).drop("_identity", "_known")
    return new.join(state.select("key"), "key", "left_anti")


def collect(discovered: DataFrame, state: DataFrame, tracked: DataFrame, verdicts: DataFrame, now: Column, most: int = 5, cut: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Run:
    """discovered: source_id, url, title, hash, found; state: as ``STATE``; tracked: url; verdicts: key, hash, score (null:
    none), error, fatal.

    Fresh candidates become pending; a source's fresh ones and retries share ``most`` places. Of those selected, one that its
    verdict accepts is processed and gives a development, and a review where a person must see it. A verdict on another
    version of the text than the candidate's counts for nothing. Pending candidates under the newest version of their source
    are dismissed, and of accepted ones with one headline in a month only the first is kept. ``cut`` may write the candidates
    with their outcomes and read them again, so that the tables of the run don't each compute them.
    """
    new = fresh(discovered, state, tracked).select("key", "source_id", "url", "title", "hash", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.col("found").alias("first_seen"), F.lit(None).cast("timestamp_ntz").alias("last_attempt"), F.lit(None).cast("string").alias("error"))
    held = state.unionByName(new)
    placed = new.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("first_seen", "key")))
    chosen = ranking.select_for_run(ranking.retry_queue(state), placed, most).select("key", F.lit(True).alias("_chosen"))
    told = verdicts.select("key", F.col("hash").alias("_hash"), F.col("score").alias("_score"), F.col("error").alias("_error"), "fatal")
    met = held.join(chosen, "key", "left").join(told, "key", "left")
    same = F.col("_hash").eqNullSafe(F.col("hash"))
    scored = F.col("_chosen").isNotNull() & same & F.col("_score").isNotNull()
    tried = F.when(F.col("_chosen").isNotNull(), F.col("attempts") + 1).otherwise(F.col("attempts"))
    outcome = F.when(F.col("_chosen").isNull(), "none").when(F.coalesce("fatal", F.lit(False)), "fatal").when(F.col("_error").isNotNull(), "error").when(scored, "scored").otherwise("selected")
    moved = met.withColumn("attempts", tried).withColumn("_outcome", outcome)
    moved = moved.withColumn("_next", predicates.next_state(F.col("status"), F.col("_outcome"), F.col("attempts"), F.col("_score")))
    moved = moved.withColumn("_accepted", (F.col("_outcome") == "scored") & (F.col("_next") == "processed")).withColumn("_headline", text.headline_month(F.col("title"), F.lit(None).cast("string"), F.date_format(now, "yyyy-MM-dd")))
    first = F.row_number().over(Window.partitionBy("_headline", "_accepted").orderBy("first_seen", "key")) == 1
    kept = F.col("_accepted") & (F.col("_headline").isNull() | first)
    moved = moved.withColumn("_kept", kept).withColumn("_next", F.when(F.col("_accepted") & ~F.col("_kept"), "dismissed").otherwise(F.col("_next")))
    moved = cut(moved)
    ended = moved.select("key", "source_id", "url", "title", "hash", F.col("_next").alias("status"), "attempts", "first_seen", F.when(F.col("_chosen").isNotNull(), now).otherwise(F.col("last_attempt")).alias("last_attempt"), F.when(F.col("_outcome").isin("error", "fatal"), F.col("_error")).when(F.col("_outcome") == "scored", F.lit(None)).otherwise(F.col("error")).alias("error"))
    developments = moved.where("_kept").select(development_id(F.col("title"), F.col("url")).alias("id"), "source_id", "title", "url", "hash", F.col("_score").alias("score"), F.lit("detected").alias("status"), now.alias("detected"))
    reviews = developments.where(predicates.wants_review(F.lit("ai"), F.col("score"))).select(F.concat(F.lit("source-review-"), "id").alias("id"), F.col("id").alias("development_id"), "url", "hash", F.lit("pending_review").alias("status"), F.col("detected").alias("discovered"))
    tally = moved.where("_chosen").groupBy("source_id").agg(F.count("*").alias("selected"), F.count_if(F.col("_outcome").isin("error", "fatal")).alias("errors"), F.count_if("_kept").alias("accepted"))
    return Run(ended, developments, reviews, tally)


def development_id(title: Column, url: Column) -> Column:
    """The same for the same title and source in every run."""
    return F.concat(F.lit("dev-"), text.slug(title, 40), F.lit("-"), F.left(F.sha2(identity(url), 256), F.lit(8)))


def changed_review(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """A review for each changed version of a tracked source. versions: source_id, url, hash, change, sequence, reverted, at;
    targets: id, url, title."""
    held = targets.select(F.col("id").alias("target_id"), identity(F.col("url")).alias("_identity"), "title")
    changed = versions.where(F.col("change") == "changed").withColumn("_identity", identity(F.col("url"))).join(held, "_identity")
    summary = predicates.change_summary(F.col("title"), F.lit(False), F.col("reverted"))
    return changed.select(F.concat_ws("-", F.lit("source-review"), "target_id", "sequence").alias("id"), "target_id", "url", "hash", F.col("sequence"), summary.alias("summary"), F.lit("pending_review").alias("status"), F.col("at").alias("discovered"))


def state_before(spark: SparkSession, folder: str) -> Callable[[int], DataFrame]:
    """The state that the batch before the given one has written; none before the first."""

    def read(batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], STATE)
        return spark.read.schema(STATE).parquet(f"{folder}/state/batch={batch_id - 1}")

    return read


def sink(read_state: Callable[[int], DataFrame], step: Callable[[DataFrame, DataFrame, Callable], Run], folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch starts from the state before its number, never from what an earlier try of its
    own has left, and writes its tables under its number, the state last. A batch that runs again gives the same files."""

    def run(batch: DataFrame, batch_id: int) -> None:
        def cut(rows: DataFrame) -> DataFrame:
            path = f"{folder}/outcomes/batch={batch_id}"
            rows.write.mode("overwrite").parquet(path)
            return rows.sparkSession.read.schema(rows.schema).parquet(path)

        made = step(batch, read_state(batch_id), cut)
        for name in ("developments", "reviews", "health", "state"):
            getattr(made, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    return run

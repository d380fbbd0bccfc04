"""The reaction and vote logs as streams; each has a batch twin it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accordant.operators.persons import REACTION_WEIGHTS, lookup
from accordant.operators.ranking import agreed_films

BUCKETS = 64


def current_preferences(reactions: DataFrame) -> DataFrame:
    """Newest nonzero reaction per (user, film), kept up to date.

    Zero weights are dropped before the state, so "not seen" never overwrites.  The
    state is one struct per (user, film): the answer to "what do they think now"
    has no end, so it is not aged out.
    """
    weighted = reactions.withColumn("weight", lookup("reaction", REACTION_WEIGHTS)).filter(F.col("weight") != 0)
    newest = F.max_by(F.struct("weight", "reaction", "submitted_at", "event_id"), F.struct("submitted_at", "event_id"))
    return weighted.groupBy("user_id", "film_id").agg(newest.alias("p")).select(
        "user_id", "film_id", "p.weight", F.col("p.reaction").alias("detail"), "p.submitted_at", "p.event_id")


def append_changes(root: str):
    """A foreachBatch sink: each batch writes the rows it changed under its own number, so
    its cost follows the batch, and a batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/epoch={epoch}")

    return write


def run_current_preferences(reactions: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    return (
        current_preferences(reactions).writeStream.outputMode("update")
        .foreachBatch(append_changes(root))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """Each (user, film) as of the last batch that changed it."""
    log = spark.read.parquet(f"{root}/changes")
    rest = [c for c in log.columns if c not in ("user_id", "film_id", "epoch")]
    newest = F.max_by(F.struct(*rest), "epoch").alias("p")
    return log.groupBy("user_id", "film_id").agg(newest).select("user_id", "film_id", "p.*")


def delivered_once(votes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Votes with re-deliveries of the same event dropped; a vote that is late but inside
    the watermark still counts."""
    return votes.withWatermark("submitted_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_agreed_films(votes: DataFrame, members: DataFrame, root: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Votes go to a log by bucket of sessions and batch; the agreed films of the sessions a
    batch touches are worked out again from their buckets, the first vote of each person and
    film counting, and written per batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
        rows = batch.withColumn("bucket", bucket).withColumn("epoch", F.lit(epoch)).persist()
        try:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(f"{root}/votes")
            touched = rows.select("session_id").distinct()
            buckets = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
            if not buckets:
                return
            # only the touched buckets of the log are read
            log = session.read.parquet(f"{root}/votes").filter(F.col("bucket").isin(buckets) & (F.col("epoch") <= epoch))
            first = F.min_by(F.struct("reaction", "submitted_at"), F.struct("submitted_at", "event_id"))
            live = log.join(touched, "session_id", "left_semi").groupBy("session_id", "user_id", "film_id").agg(
                first.alias("v")).select("session_id", "user_id", "film_id", "v.*")
            present = members.join(touched, "session_id", "left_semi")
            agreed_films(live, present).write.mode("overwrite").parquet(f"{root}/agreed/epoch={epoch}")
        finally:
            rows.unpersist()

    return (
        delivered_once(votes, delay).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_agreed(spark: SparkSession, root: str) -> DataFrame:
    """Each session's agreed films as of the last batch that touched it."""
    log = spark.read.parquet(f"{root}/votes").groupBy("session_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{root}/agreed").join(log, ["session_id", "epoch"]).drop("epoch")

"""The reaction and vote logs run as streams over the driver's event files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accordant.plans import people_queries as PQ
from accordant.plans.bindings import BINDINGS, bind, oracle_with, table
from accordant.plans.registry import query
from accordant.session import ensure_checkpoint_dir
from accordant.streaming import reactions as R


def stream(spark, d, name):
    """The bound event log read as a file stream."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    return spark.sql(BINDINGS[name], events=events)


def scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("current_preferences_stream", "ST1 W4", oracle_with("reactions", PQ.PREFS + " SELECT user_id, film_id, weight, detail FROM rp"))
def _preferences(spark, d):
    root = scratch(spark, "preferences")
    R.run_current_preferences(stream(spark, d, "reactions"), root, f"{root}/log").awaitTermination()
    return R.read_current(spark, root).select("user_id", "film_id", "weight", "detail")


@query("current_preferences", "ST1", oracle_with("reactions", PQ.PREFS + " SELECT user_id, film_id, weight, detail FROM rp"))
def _batch(spark, d):
    return R.current_preferences(bind(spark, d, "reactions")).select("user_id", "film_id", "weight", "detail")


@query("agreed_films_stream", "ST2 A42", oracle_with("votes members", """
, fv AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY session_id, user_id, film_id ORDER BY submitted_at, event_id) = 1),
sz AS (SELECT session_id, count(DISTINCT user_id) AS n_members FROM members GROUP BY ALL)
SELECT session_id, film_id, n_members FROM fv JOIN sz USING (session_id) GROUP BY ALL
HAVING count(DISTINCT CASE WHEN reaction = 'yes' THEN user_id END) = n_members AND count(*) FILTER (WHERE reaction = 'no') = 0"""))
def _agreed(spark, d):
    root = scratch(spark, "agreed")
    votes = stream(spark, d, "votes").withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    R.run_agreed_films(votes, bind(spark, d, "members"), root, f"{root}/log").awaitTermination()
    return R.read_agreed(spark, root).select("session_id", "film_id", "n_members")

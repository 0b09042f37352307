"""Streams over events and frames: an addition to the batch operators, never a replacement of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilespark.session import shared_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 8) -> DataFrame:
    """``path`` is a folder or a glob; a glob also takes a single file."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def windowed_counts(events: DataFrame, length: str = "6 hours", slide: str | None = None, late: str | None = "1 day") -> DataFrame:
    """Events and values per window and type; rows later than ``late`` behind the newest are dropped by the watermark, without ``late`` none is."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = "1 day") -> DataFrame:
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def acquisitions(seen: DataFrame, every: int) -> DataFrame:
    """The acquisition loop as a stream of ``clip_id, frame, object_id``: an object gets an identity at the first look at which it is seen.

    State is the known objects of each clip, as many as the clip has. Looks arrive in order of frames within a clip.
    """

    def look(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict.fromkeys(state.get[0]) if state.exists else {}
        out = []
        for rows in batches:
            for frame, own in rows[rows["frame"] % every == 0].sort_values(["frame", "object_id"]).groupby("frame", sort=True):
                for o in own["object_id"].tolist():
                    if o not in known:
                        known[o] = None
                        out.append((key[0], o, int(frame), len(known)))
        state.update((list(known),))
        yield pd.DataFrame(out, columns=["clip_id", "object_id", "acquired_frame", "track_id"])

    return seen.groupBy("clip_id").applyInPandasWithState(look, "clip_id int, object_id int, acquired_frame int, track_id int", "known array<int>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Everything a stream has to say about what is there now, kept as a table in the shared folder; a batch that is run again replaces what it wrote.

    In update mode, which needs the result's ``keys``, a batch writes only what it changed, so that writing grows with the input; complete mode rewrites the result for every
    batch, and is left to session windows, which Spark does not update.
    """
    spark = stream.sparkSession
    out, log = shared_path(spark, name), shared_path(spark, f"{name}-log")
    if mode == "update":
        # a batch writes what it changed; of a key the last word counts
        write = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out)
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_")).select(*keys, "_.*")
    write: Callable[[DataFrame, int], None] = lambda df, i: df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={i}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    return found if mode == "complete" else found.drop("batch")


# the queries cover the whole table, whatever the order of its files: both modes keep all state, so a watermark would only lose rows
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_to_end(windowed_counts(event_stream(spark, f"{sf_dir}/event[s].parquet"), late=None), "update", "windows", ("w", "event_type"))
    return found.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "total")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_to_end(sessions(event_stream(spark, f"{sf_dir}/event[s].parquet"), late=None), "complete", "sessions")
    return found.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")


QUERIES = {"stream_windows": stream_windows, "stream_sessions": stream_sessions}
ORACLE = {
    "stream_windows": "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k""",
}

"""Event-time operators that mean the same on a table and on a stream.

tumbling() and sliding() take either; on a stream they carry a watermark of look-back plus cool-down, which is how late data are
treated. Cool-down streams through sorted partitions of a table, where keys with very many events are spread by time, and is a function
of keyed state on a stream; state times out, so it doesn't grow with the stream's age.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from juristream.operators.lineage import cut

LOOK_BACK = "1 hour"
LATE = "2 hours"


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, late: str = LATE) -> DataFrame:
    """started, event_type, n, total by windows that don't overlap."""
    g = _timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = LOOK_BACK, step: str = "5 minutes", late: str = LATE) -> DataFrame:
    """started, event_type, n by windows that begin every step: the look-back of an alert poll, for every poll."""
    g = _timed(events, late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("started"), "event_type", "n")


def sessions(events: DataFrame, key: str, *, hours: int, late: str = LATE) -> DataFrame:
    """key, started, ended, n: runs of a key's events with no longer pause than this between neighbours."""
    if events.isStreaming:
        # session_window ends before the pause is over, a table's sessions when it is: one second more makes a pause of just `hours` no end.
        g = _timed(events, late).groupBy(F.session_window("ts", f"{hours * 3600 + 1} seconds").alias("w"), key).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
        return g.select(key, "started", "ended", "n")
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr(f"INTERVAL {hours} HOURS"), 0).otherwise(1)
    marked = events.select(key, "ts", "event_id", new.alias("new")).withColumn("session", F.sum("new").over(w))
    return marked.groupBy(key, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session")


def _fires(times: pd.Series, last: pd.Timestamp | None, pause: pd.Timedelta) -> tuple[list[bool], pd.Timestamp | None]:
    keep = []
    for t in times:
        keep.append(last is None or t >= last + pause)
        if keep[-1]:
            last = t
    return keep, last


def cooldown(events: DataFrame, keys: list[str], *, hours: int, hot_rows: int = 5_000_000, piece_rows: int = 1_000_000) -> DataFrame:
    """The events that fire: a key is silent for so many hours after it fired. Equal times fire in order of event_id.

    On a table, sorted partitions stream through: a task holds a key's last firing. Keys of more than `hot_rows` moments are spread over tasks by pieces of
    their time instead (spread_cooldown), with the same result.
    """
    if events.isStreaming:
        return _cooldown_stream(events, keys, hours)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    # Of a key's events at one moment only the first can fire, so no moment is hot either.
    moments = events.where("ts IS NOT NULL").groupBy(*keys, at.alias("_at")).agg(F.min("event_id").alias("event_id"))
    sizes = moments.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = cut(sizes)
    n_hot = hot.count()
    if not n_hot:
        return _streamed_cooldown(moments, keys, hours, types)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    named = hot.select("_n", *[F.col(k).alias(f"_h_{k}") for k in keys], F.row_number().over(Window.orderBy(*keys)).alias("_key"))
    named = F.broadcast(named) if n_hot <= 100_000 else named
    rest = moments.join(named, same, "left_anti")
    spread = spread_cooldown(cut(moments.join(named, same).select("_key", "_at", "event_id", "_n")), hours * 3_600_000_000, piece_rows)
    back = spread.join(named, "_key").select(*[F.col(f"_h_{k}").alias(k) for k in keys], "event_id")
    return _streamed_cooldown(rest, keys, hours, types).unionByName(back)


def _streamed_cooldown(moments: DataFrame, keys: list[str], hours: int, types: dict[str, str]) -> DataFrame:
    pause = hours * 3_600_000_000
    rows = moments.repartition(*keys).sortWithinPartitions(*keys, "_at").select(*keys, "event_id", "_at")

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            fires = []
            for *key, t in zip(*(batch.column(i).to_pylist() for i in (*range(len(keys)), len(keys) + 1)), strict=True):
                if key != now:
                    now, last = key, None
                fires.append(last is None or t >= last + pause)
                if fires[-1]:
                    last = t
            yield batch.filter(pa.array(fires, pa.bool_())).select([*keys, "event_id"])

    return rows.mapInArrow(fire, ", ".join(f"`{c}` {types[c]}" for c in (*keys, "event_id")))


def pieces(moments: DataFrame, piece_rows: int) -> DataFrame:
    """_key, _bounds: the times at which each key's moments (_key, _at, _n rows of it) are cut into pieces of about so many rows."""
    most = moments.agg(F.max("_n")).first()[0] or 1
    many = max(1, -(-most // piece_rows))
    shares = [(i + 1) / many for i in range(many - 1)]
    bounds = F.percentile_approx("_at", shares, 100 * many) if shares else F.array().cast("array<bigint>")
    return moments.groupBy("_key").agg(F.array_sort(F.array_distinct(bounds)).alias("_bounds"))


def following(moments: DataFrame, pause: int, piece_rows: int) -> DataFrame:
    """_key, _at, _next: the key's first moment at least a pause later, or null.

    An as-of join by pieces of time: moments and the times to look from lie in one sorted piece; where it has nothing later, the first moment
    of the next piece that has any is taken. A piece is a task's, a key isn't."""
    cuts = cut(pieces(moments, piece_rows))
    piece = lambda t: F.size(F.filter("_bounds", lambda x: x <= t))
    near = F.broadcast(cuts)  # a row of bounds for each hot key
    rows = moments.select("_key", "_at").join(near, "_key")
    own = rows.select("_key", piece(F.col("_at")).alias("_p"), F.col("_at").alias("_t"), F.lit(True).alias("_is"), F.lit(None).cast("long").alias("_from"))
    looks = rows.select("_key", piece(F.col("_at") + pause).alias("_p"), (F.col("_at") + pause).alias("_t"), F.lit(False).alias("_is"), F.col("_at").alias("_from"))
    # From the latest on; at one time a moment comes before those that look from there.
    w = Window.partitionBy("_key", "_p").orderBy(F.desc("_t"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = own.unionByName(looks).withColumn("_next", F.last(F.when(F.col("_is"), F.col("_t")), ignorenulls=True).over(w)).where("NOT _is")
    firsts = own.groupBy("_key", "_p").agg(F.min("_t").alias("_first"))
    every = cuts.select("_key", F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_p")).join(firsts, ["_key", "_p"], "left")
    after = every.withColumn("_later", F.min("_first").over(Window.partitionBy("_key").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)))
    return seen.join(F.broadcast(after.select("_key", "_p", "_later")), ["_key", "_p"]).select("_key", F.col("_from").alias("_at"), F.coalesce("_next", "_later").alias("_next"))


def spread_cooldown(moments: DataFrame, pause: int, piece_rows: int) -> DataFrame:
    """_key, event_id of the moments (_key, _at, event_id, _n; times once a key) that fire: those that the first leads to, each the first at least a pause
    after the one before. Pointers are doubled, so n firings take log2(n) rounds, and each round is spread by moment."""
    jump = cut(following(moments, pause, piece_rows).where("_next IS NOT NULL"))
    fired = cut(moments.groupBy("_key").agg(F.min("_at").alias("_at")))
    n = fired.count()
    while True:
        more = fired.join(jump, ["_key", "_at"]).select("_key", F.col("_next").alias("_at"))
        fired = cut(fired.union(more).distinct())
        before, n = n, fired.count()
        if n == before:
            return moments.join(fired, ["_key", "_at"], "left_semi").select("_key", "event_id")
        jump = cut(jump.join(jump.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_far")), ["_key", "_next"]).select("_key", "_at", F.col("_far").alias("_next")))


def _cooldown_stream(events: DataFrame, keys: list[str], hours: int) -> DataFrame:
    pause = pd.Timedelta(hours=hours)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", event_id {types['event_id']}"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = pd.Timestamp(state.get[0]) if state.exists else None
        keep, last = _fires(rows["ts"], last, pause)
        state.update((last.to_pydatetime(),))
        state.setTimeoutTimestamp(int((last + pause).timestamp() * 1000) + 1)
        yield rows[keep][[*keys, "event_id"]]

    return _timed(events, LATE).groupBy(*keys).applyInPandasWithState(run, out, "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(rows: DataFrame, keys: list[str], *, late: str = LATE) -> DataFrame:
    """One row per key: the first on a table (by ts, then event_id), the first to come within the watermark on a stream."""
    if rows.isStreaming:
        return _timed(rows, late).dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def into_snapshots(stream: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch under its own number, so a batch that is tried again replaces itself; ends when what is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cluster_stream(claims: DataFrame, late: str = LATE, idle: str = "30 days"):
    """ykien_id, founder, similarity of claims (ykien_id, topic, anchor, signature, normalized, ts) as they come: each joins the cluster whose first claim is most
    similar, as on a table, or founds one. State holds a key's founders; it goes when a key was idle for so long in event time."""
    from juristream.operators.claims import Founders

    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        founders = Founders()
        for text in state.get[0] if state.exists else []:
            founders.add(text)
        rows = pd.concat(list(batches)).sort_values(["ts", "ykien_id"])
        found = [founders.place(text) for text in rows["normalized"]]
        state.update((founders.texts,))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + pause)
        yield pd.DataFrame({"ykien_id": rows["ykien_id"].to_numpy(), "founder": [f for f, _ in found], "similarity": [v for _, v in found]})

    keyed = _timed(claims, late).groupBy("topic", "anchor", "signature")
    return keyed.applyInPandasWithState(run, "ykien_id string, founder string, similarity double", "founders array<string>", "append", GroupStateTimeout.EventTimeTimeout)

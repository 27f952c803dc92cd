"""The live loop as Structured Streaming: key presses to dictations, sessions, rates, drafts, alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TAP, DOUBLE_TAP = 0.25, 0.35
#: Values of ord in a stretch of sums.
STRETCH = 4096


#: Push to talk by state and input. idle; held (recording while the key is down); spent (the key still down, nothing recorded); free
#: (recording hands-free) and ending (its last press); late and late_ending: hands-free after a recording that was cancelled.
#: Inputs: down, up, other, esc; an up after less than TAP is a tap, or a second one within DOUBLE_TAP of the last. What isn't here changes nothing.
TRANSITIONS = {
    ("idle", "down"): ("held", "start"),
    ("held", "up"): ("idle", "stop"),
    ("held", "tap"): ("idle", "cancel_silent"),
    ("held", "second"): ("free", "start_hands_free"),
    ("held", "other"): ("idle", "cancel"),
    ("held", "esc"): ("spent", "cancel"),
    ("spent", "up"): ("idle", None),
    ("spent", "tap"): ("idle", "cancel_silent"),
    ("spent", "second"): ("late", "start_hands_free"),
    ("spent", "other"): ("idle", None),
    ("spent", "esc"): ("idle", None),
    ("free", "down"): ("ending", None),
    ("free", "esc"): ("idle", "cancel"),
    ("ending", "up"): ("idle", "stop"),
    ("ending", "esc"): ("spent", "cancel"),
    ("late", "down"): ("late_ending", None),
    ("late_ending", "up"): ("idle", "stop"),
}
_START = {"mode": "idle", "since": 0.0, "tapped": float("-inf")}


def step(state: dict, kind: str, now: float) -> tuple[dict, list[str]]:
    """One key event: the next state and the actions start, start_hands_free, stop, cancel, cancel_silent.

    A hold records while the key is down. A tap (under TAP) is dropped, but a second one within DOUBLE_TAP goes on
    hands-free until the next press ends. Another key during a hold, or Escape at any time, cancels."""
    mode, since, tapped = state["mode"], state["since"], state["tapped"]
    if kind == "up" and mode in ("held", "spent") and now - since < TAP:
        kind = "second" if now - tapped < DOUBLE_TAP else "tap"
    to, action = TRANSITIONS.get((mode, kind), (mode, None))
    since = now if kind == "down" and to != mode else since
    tapped = {"tap": now, "second": float("-inf")}.get(kind, tapped)
    return {"mode": to, "since": since, "tapped": tapped}, [action] if action else []


#: Users are dealt to this many groups: a group costs its worker some milliseconds in each micro-batch, however few its rows are.
GROUPS = 1024


def _by_user(events: DataFrame, columns: list[str], start: tuple, take: Callable[[tuple, tuple], tuple[tuple, list]], memory: dict[str, str], output: str, idle_ms: int | None) -> DataFrame:
    """What ``take`` makes of each user's rows (``columns``: first two in order, from its values and a row new values and what it gives, without the user).

    The state of a group is a list for each value, a place for each of its users. In a stream that goes on a user's place is dropped after
    ``idle_ms`` of processing time without an event, and a group's whole state when none of its users has one."""
    names = [c.strip().split(" ")[0] for c in output.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        own = {u: (seen, tuple(v)) for u, seen, *v in zip(*state.get, strict=True)} if state.exists else {}
        if idle_ms:
            own = {u: s for u, s in own.items() if now - s[0] < idle_ms}
        # pandas makes floats of integers among which are nulls
        users = lambda b: b["user_id"].astype("Int64").astype(object).where(b["user_id"].notna(), None)
        rows = sorted((r for b in batches for r in zip(*(b[c].tolist() for c in columns), users(b).tolist(), strict=True)), key=lambda r: r[:2])
        out = []
        for *row, u in rows:
            values, gives = take(own[u][1] if u in own else start, tuple(row))
            own[u] = (now, values)
            out += [(u, *g) for g in gives]
        state.update(tuple(map(list, zip(*((u, seen, *v) for u, (seen, v) in own.items()), strict=True))))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=names)

    kept = ", ".join(f"{c} array<{t}>" for c, t in {"users": "long", "seen": "long", **memory}.items())
    grouped = events.withColumn("_group", F.pmod(F.xxhash64("user_id"), F.lit(GROUPS))).groupBy("_group")
    return grouped.applyInPandasWithState(run, output, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def dictation_actions(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(user_id, ts, action) of a stream of (user_id, ts, kind, ord): a state machine for each user; ts in seconds.

    Events of a micro-batch are put in order; state outlives the batch and, in a stream that goes on, is dropped after
    ``idle_ms`` of processing time without an event (a stream that is only drained has no timers: they would keep it up)."""

    def take(own: tuple, row: tuple) -> tuple[tuple, list]:
        ts, _, kind = row
        state, acts = step(dict(zip(_START, own, strict=True)), kind, ts)
        return tuple(state.values()), [(ts, a) for a in acts]

    memory = {"mode": "string", "since": "double", "tapped": "double"}
    return _by_user(events, ["ts", "ord", "kind"], tuple(_START.values()), take, memory, "user_id long, ts double, action string", idle_ms)


def rate_limited(events: DataFrame, least: float, idle_ms: int | None = None) -> DataFrame:
    """(user_id, ts, ord): events at least ``least`` seconds after the last one that was let through.

    Events of a micro-batch are put in order; in a stream that goes on, a user's state is dropped after ``idle_ms`` of processing time
    without an event (let it be longer than ``least``)."""

    def take(own: tuple, row: tuple) -> tuple[tuple, list]:
        return ((row[0],), [row]) if row[0] - own[0] >= least else (own, [])

    return _by_user(events, ["ts", "ord"], (float("-inf"),), take, {"last": "double"}, "user_id long, ts double, ord long", idle_ms)


def bounded(events: DataFrame, most: float) -> DataFrame:
    """(user_id, ord, kept): how many of an event's seconds still fit a buffer of ``most`` seconds, by sums of what came before.

    Sums run within stretches of STRETCH values of ord and over the stretches' totals, so a user's events are many small groups."""
    rows = events.withColumns({"s": F.greatest(F.col("seconds").cast("double"), F.lit(0.0)), "stretch": F.floor(F.col("ord") / F.lit(STRETCH))})
    totals = rows.groupBy("user_id", "stretch").agg(F.sum("s").alias("total"))
    earlier = Window.partitionBy("user_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("user_id", "stretch", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)).alias("base"))
    inside = Window.partitionBy("user_id", "stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("base") + F.col("before")
    placed = rows.withColumn("before", F.coalesce(F.sum("s").over(inside), F.lit(0.0))).join(totals, ["user_id", "stretch"])
    return placed.select("user_id", "ord", F.greatest(F.lit(0.0), F.least(F.col("s"), F.lit(most) - used)).alias("kept"))


def tumbling_counts(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts and sums by kind in tumbling windows; later rows than ``delay`` are dropped by the watermark."""
    return events.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of each user: an event less than ``gap`` after the last goes on with it."""
    return events.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def tails(frames: DataFrame, stops: DataFrame, seconds: float, delay: str) -> DataFrame:
    """Frames of a recording that come at most ``seconds`` after its stop: a stream-stream interval join with watermarks on both sides."""
    f, s = frames.withWatermark("at", delay).alias("f"), stops.withWatermark("stop_at", delay).alias("s")
    within = F.expr(f"f.user_id = s.user_id and f.at >= s.stop_at and f.at <= s.stop_at + make_interval(0, 0, 0, 0, 0, 0, {seconds})")
    return f.join(s, within).select("f.user_id", "f.at", "s.stop_at")


def deduplicated(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["user_id", "kind", "at"])


def current(results: DataFrame) -> DataFrame:
    """The last version of each result: a final one beats drafts, later drafts earlier ones; of stale tokens nothing stays."""
    newest = results.groupBy("user_id").agg(F.max("token").alias("token"))
    return results.join(newest, ["user_id", "token"]).groupBy("user_id", "token").agg(F.max_by("text", F.struct("final", "version")).alias("text"))


def drained(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """All there is of a stream now, written as files under ``folder`` and read back."""
    path = f"{folder}/out"
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", path).trigger(availableNow=True).start().awaitTermination()
    else:
        # complete results replace each other: the last micro-batch's is the answer
        def keep(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(path)

        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

"""Stateful operators on event time: rows in order whatever the micro-batches, timers, lists of what is held, two-sided buffers.

All keep a row until the watermark has passed it, so no earlier row can come, and then take rows by (time, ord). So the answer to
one micro-batch is that to twenty, and a restart goes on from the checkpoint. What the watermark hasn't passed stays in state. Rows whose
time or key is null take no part; rows later than ``delay`` are dropped by the watermark."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
#: Keys are dealt to this many groups: a group costs its worker some milliseconds in each micro-batch, however few its rows are.
GROUPS = 1024
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _timed(rows: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows with a key and a time, under a watermark, and the time in microseconds: state holds plain values."""
    return rows.where(F.col("at").isNotNull() & F.col(key).isNotNull()).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))


def _run(rows: DataFrame, operator: InOrder, shape: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = ", ".join(f"{name} binary" for name in ("waiting", *operator.memory))
    rows = rows.select(operator.key, "at", *operator.names)
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(operator.key), F.lit(GROUPS))).groupBy("_group")
    output = f"{operator.key} {rows.schema[operator.key].dataType.simpleString()}, {shape}"
    return grouped.applyInPandasWithState(operator.take, output, kept, "append", GroupStateTimeout.EventTimeTimeout)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class InOrder:
    """Hands each key's rows on in order, once the watermark has passed them.

    Rows of a group of keys wait in its state under a timer at the earliest of them; ``released`` gets a key's rows that are due and returns what
    they make. State is a table for the waiting rows and for each kind of memory, as Arrow streams: a worker is called for groups, not for keys."""

    #: Columns that rows keep in state, with their types; they are due at the first, the second orders rows of equal time.
    columns: str = "us long, ord long"
    #: What a key remembers besides waiting rows: lists of rows by name, and the columns of each.
    memory: dict[str, str] = {}
    #: Columns of the output after the key.
    output: tuple[str, ...] = ()

    def __init__(self, key: str) -> None:
        self.key = key

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]

    def shape(self, columns: str, key: pa.DataType) -> pa.Schema:
        return pa.schema([("_key", key), *((n, _ARROW[t]) for n, t in (c.split() for c in columns.split(", ")))])

    def take(self, group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        waiting, own = [], {}
        if state.exists:
            first, *kept = (pa.ipc.open_stream(pa.py_buffer(bytes(b))).read_all() for b in state.get)
            waiting.append(first)
            for name, table in zip(self.memory, kept, strict=True):
                for k, *row in zip(*(c.to_pylist() for c in table.columns), strict=True):
                    own.setdefault(k, {m: [] for m in self.memory})[name].append(tuple(row))
        for batch in batches:
            if len(batch):
                new = batch[[self.key, *self.names]].rename(columns={self.key: "_key"})
                key = waiting[0].schema.field("_key").type if waiting else pa.array(new["_key"]).type
                # pandas makes floats of integers among which are nulls
                waiting.append(pa.Table.from_pandas(new, schema=self.shape(self.columns, key), preserve_index=False))
        if not waiting:
            return
        rows = pa.concat_tables(waiting).combine_chunks()
        rows = rows.take(np.lexsort((rows["ord"].to_numpy(), rows["us"].to_numpy())))
        n = int(np.searchsorted(rows["us"].to_numpy(), now, "right"))
        due: dict = {}
        for k, *row in zip(*(c.to_pylist() for c in rows.slice(0, n).columns), strict=True):
            due.setdefault(k, []).append(tuple(row))
        for k, o in own.items():
            if k not in due and any(t <= now for t in self.later(o)):
                due[k] = []
        out = []
        for k, own_rows in due.items():
            mine = own.setdefault(k, {m: [] for m in self.memory})
            out += [(k, *r) for r in self.released(mine, own_rows, now)]
            if not any(mine.values()):
                del own[k]
        rest = rows.slice(n)
        if len(rest) or own:
            key = rows.schema.field("_key").type
            tables = [pa.table(list(map(pa.array, zip(*held), schema.types)), schema=schema) if (held := [(k, *r) for k, o in own.items() for r in o[name]]) else schema.empty_table() for name, schema in ((m, self.shape(c, key)) for m, c in self.memory.items())]
            state.update((_packed(rest), *map(_packed, tables)))
            wake = min([*rest["us"].to_pylist()[:1], *(t for o in own.values() for t in self.later(o))], default=None)
            if wake is not None:
                # a group is called when the watermark is later than its timer
                state.setTimeoutTimestamp(max(-(-wake // 1000) - 1, now // 1000, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[self.key, *self.output], dtype=object)

    def later(self, own: dict[str, list[tuple]]) -> list[int]:
        """Further times at which a key is to be called."""
        return []

    def released(self, own: dict[str, list[tuple]], rows: list[tuple], now: int) -> list[tuple]:
        """What a key's rows make, without the key; ``own`` is its memory, changed in place."""
        raise NotImplementedError


# --- delayed re-checks --------------------------------------------------------------------------------------------


class _Checks(InOrder):
    columns = "us long, ord long, opens boolean, text string"
    memory = {"last": "us long, ord long, text string", "pending": "ord long, number int, due long, opened long"}
    output = ("ord", "number", "due_us", "seen")

    def __init__(self, key: str, delays: tuple[float, ...]) -> None:
        super().__init__(key)
        self.delays = delays

    def later(self, own: dict[str, list[tuple]]) -> list[int]:
        return [due for _, _, due, _ in own["pending"]]

    def released(self, own: dict[str, list[tuple]], rows: list[tuple], now: int) -> list[tuple]:
        # checks that rows open may themselves be due by now: what was seen is looked up by time, not by order of arrival
        seen, pending = own["last"], {(i, n): (due, opened) for i, n, due, opened in own["pending"]}
        for us, i, opens, text in rows:
            if opens:
                for n, d in enumerate(self.delays, 1):
                    pending[i, n] = (us + round(d * SECOND), us)
            else:
                seen.append((us, i, text))
        times = [us for us, *_ in seen]
        out, left = [], []
        for (i, n), (due, opened) in pending.items():
            if due > now:
                left.append((i, n, due, opened))
                continue
            at = bisect_right(times, due)
            out.append((i, n, due, seen[at - 1][2] if at and seen[at - 1][:2] > (opened, i) else None))
        own["last"], own["pending"] = seen[-1:] if left else [], left
        return out


def delayed_checks(rows: DataFrame, key: str, delays: tuple[float, ...] = (4.0, 12.0, 30.0), delay: str = "1 second") -> DataFrame:
    """(key, ord, number, due_us, seen): what stands in a key's field ``delays`` seconds after each row that opens a watch.

    ``rows`` are (key, at, ord, opens, text): a row opens a watch, or says what the field holds from then on. Each check happens once, when
    the watermark has passed it; seen is the text of the last field row after the opening and at or before the check (null: none). A key
    without a watch has no state. Rows that repeat an ord of a key open one watch."""
    return _run(_timed(rows, key, delay), _Checks(key, delays), "ord long, number int, due_us long, seen string")


# --- nearest match of two streams ---------------------------------------------------------------------------------


class _Nearest(InOrder):
    #: A left row is due when no right row near enough can come any more, a right row at its own time.
    columns = "us long, ord long, left boolean, target long"
    memory = {"right": "us long, ord long"}
    output = ("ord", "match", "apart_us")

    def __init__(self, key: str, within: int, shift: int) -> None:
        super().__init__(key)
        self.within, self.span = within, within + max(shift, within)

    def later(self, own: dict[str, list[tuple]]) -> list[int]:
        return [own["right"][0][0] + self.span + 1000] if own["right"] else []

    def released(self, own: dict[str, list[tuple]], rows: list[tuple], now: int) -> list[tuple]:
        right = own["right"] + [(us, i) for us, i, left, _ in rows if not left]
        times, out = [us for us, _ in right], []
        for _, i, left, target in rows:
            if not left:
                continue
            at = bisect_right(times, target)
            # of rows at one time the first, before or after the target
            near = [bisect_left(times, times[at - 1])] if at else []
            near += [at] if at < len(times) else []
            best = min(near, key=lambda k: (abs(times[k] - target), k), default=None)
            apart = None if best is None else times[best] - target
            out.append((i, right[best][1], apart) if apart is not None and abs(apart) <= self.within else (i, None, None))
        # targets of left rows that wait are later than the watermark less the reach, of those to come than the watermark less the shift
        own["right"] = right[bisect_left(times, now - self.span) :]
        return out


def nearest_match(left: DataFrame, right: DataFrame, key: str, shift: float = 0.06, within: float = 0.5, delay: str = "1 second") -> DataFrame:
    """(key, ord, match, apart_us): for each row of ``left`` the row of ``right`` nearest to its time less ``shift`` seconds.

    Both are streams of (key, at, ord) on one clock; a frame is read ``shift`` after it was exposed. A row further than ``within`` seconds is no
    match (null). Ties go to the earlier row, then the smaller ord. Both sides wait in state: a left row until the watermark has passed
    all that might be nearer, a right one until no left row can want it."""
    micros, reach = round(shift * SECOND), round(within * SECOND)
    # each side has a watermark of its own: the slower one counts
    one = lambda df, side: _timed(df.select(key, "at", F.col("ord").cast("long").alias("ord")), key, delay).withColumns({"left": F.lit(side), "target": F.col("us") - F.lit(micros)}).withColumn("us", F.when(F.col("left"), F.col("target") + F.lit(reach)).otherwise(F.col("us")))
    return _run(one(left, True).unionByName(one(right, False)), _Nearest(key, reach, micros), "ord long, match long, apart_us long")


# --- clean taps ---------------------------------------------------------------------------------------------------

#: A tap's length in seconds, both ends included.
LEAST_TAP, MOST_TAP = 0.025, 0.5
#: Kinds that spoil a tap while it lasts; those that begin and end something held.
SPOILS = frozenset({"key_down", "button_down", "scroll", "modifier"})
HOLDS = {"key_down": ("key", True), "key_up": ("key", False), "button_down": ("button", True), "button_up": ("button", False)}


class _Taps(InOrder):
    columns = "us long, ord long, generation long, kind string, code int, modified boolean, again boolean"
    memory = {"press": "generation long, since long, clean boolean", "held": "device string, code int"}
    output = ("us", "ord", "action")

    def released(self, own: dict[str, list[tuple]], rows: list[tuple], now: int) -> list[tuple]:
        current, since, clean = own["press"][0] if own["press"] else (None, None, False)
        held, out = set(own["held"]), []
        for us, i, generation, kind, code, modified, again in rows:
            if generation is None or (current is not None and generation < current):
                continue
            if generation != current:
                current, since = generation, None
                held.clear()
            if kind == "press" and since is None:
                since, clean = us, not modified and not held
            elif kind == "release" and since is not None:
                if clean and not modified and LEAST_TAP * SECOND <= us - since <= MOST_TAP * SECOND:
                    out.append((us, i, "toggle"))
                since = None
            clean = clean and kind not in SPOILS and not modified
            if kind in HOLDS:
                device, begins = HOLDS[kind]
                fresh = (device, code) not in held
                if kind == "key_down" and code == ESCAPE and fresh and not again:
                    out.append((us, i, "cancel"))
                if begins:
                    held.add((device, code))
                elif not fresh:
                    held.remove((device, code))
        own["press"], own["held"] = [(current, since, bool(clean))], list(held)
        return out


ESCAPE = 53


def clean_taps(rows: DataFrame, key: str, delay: str = "1 second") -> DataFrame:
    """(key, us, ord, action): toggles by short taps of one key, and cancels by Escape.

    ``rows`` are (key, at, ord, generation, kind, code, modified, again). kind is press or release (of the tapped key), key_down, key_up,
    button_down, button_up, scroll or modifier; modified says that another modifier is down, again that a key repeats. A tap of 0.025 to
    0.5 s toggles unless something was held when it began, or anything else was pressed, scrolled or modified before it ended. A press while
    pressed, a release while not, and ups of what isn't held change nothing. Escape cancels when it goes down afresh. A new generation (the
    listener began again) forgets all that is held; rows of an older generation, or of none, are dropped."""
    return _run(_timed(rows, key, delay), _Taps(key), "us long, ord long, action string")


# --- reads of a camera --------------------------------------------------------------------------------------------


class _Reads(InOrder):
    columns = "us long, ord long, valid boolean, recording boolean"
    memory = {"reads": "valid long, tracked long, ended boolean"}
    output = ("us", "ord", "what")

    def __init__(self, key: str, limit: int, interval: int) -> None:
        super().__init__(key)
        self.limit, self.interval = limit, interval

    def released(self, own: dict[str, list[tuple]], rows: list[tuple], now: int) -> list[tuple]:
        good, tracked, ended = own["reads"][0] if own["reads"] else (None, None, False)
        out = []
        for us, i, valid, recording in rows if not ended else ():
            good = us if good is None or valid else good
            if not valid and us - good >= self.limit:
                ended = True
                out.append((us, i, "failed"))
                break
            if valid and (recording or tracked is None or us - tracked >= self.interval):
                tracked = us
                out.append((us, i, "tracked"))
        own["reads"] = [(good, tracked, ended)]
        return out


def camera_reads(rows: DataFrame, key: str, limit: float = 3.0, interval: float = 1 / 12, delay: str = "1 second") -> DataFrame:
    """(key, us, ord, what) of a camera's reads (key, at, ord, valid, recording): which frames are tracked, and when it failed.

    While recording every valid frame is tracked; in a preview one ``interval`` seconds or more after the last tracked one, and the first. A read that gives no frame
    ``limit`` seconds or more after the last valid one (or the first read) fails, and ends the key: no later row counts. A null valid is no frame, a null recording a preview.
    A read that never returns isn't a row, so it fails nothing."""
    return _run(_timed(rows, key, delay), _Reads(key, round(limit * SECOND), round(interval * SECOND)), "us long, ord long, what string")


# --- drafts and finals --------------------------------------------------------------------------------------------

#: What a later row of another kind can't replace: the user's own text stands over finals, finals over drafts.
RANK = {"draft": 0, "final": 1, "edit": 2}


def newest_result(rows: DataFrame) -> DataFrame:
    """(token, rank, version, text) of each token's standing result: a maximum, so order, repeats and micro-batches don't matter.

    Rows of another kind, or without a token, version or text, take no part; of equal versions of a kind the larger text stands."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, r in RANK.items()))
    whole = rows.withColumn("rank", rank).where("token is not null and rank is not null and version is not null and text is not null")
    return whole.groupBy("token").agg(F.max(F.struct("rank", "version", "text")).alias("top")).select("token", "top.*")


def upserted(rows: DataFrame, folder: str) -> DataFrame:
    """The standing results of a stream of (token, kind, version, text), after all there is now, by changes merged under ``folder``.

    The stream runs in update mode: each micro-batch writes what changed in it to a folder of its number, overwriting what an
    attempt before a failure left there. Whoever reads takes each token's maximum, so a batch that is written twice changes nothing."""
    spark = rows.sparkSession

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    newest_result(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema("token long, rank int, version long, text string").parquet(f"{folder}/changes")
    return changes.groupBy("token").agg(F.max(F.struct("rank", "version", "text")).alias("top")).select("token", "top.*")


# --- streams of files in the order of time ------------------------------------------------------------------------

#: Rows of a file; rows of one key in a micro-batch, which a worker may have to hold at once; micro-batches, if that bound asks for no more.
FILE_ROWS, KEY_ROWS, BATCHES = 500_000, 500_000, 4


def time_split(df: DataFrame, at: str | Column, folder: str, rows: int = FILE_ROWS, least: int = BATCHES) -> str:
    """``df`` written as files of about ``rows`` rows, each later than the one before; a stream of some files a trigger then takes bounded batches in order.

    The file source takes older files first, so the files' times are set by their place."""
    spark = df.sparkSession
    parts = max(least, -(-df.count() // rows))
    df.repartitionByRange(parts, at).sortWithinPartitions(at).write.parquet(folder)
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    paths = sorted((s.getPath() for s in files.listStatus(there) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    first = files.getFileStatus(there).getModificationTime() - 1000 * len(paths)
    for i, p in enumerate(paths):
        files.setTimes(p, first + 1000 * i, -1)
    return folder


def files_a_trigger(written: DataFrame, key: str, most: int = KEY_ROWS, least: int = BATCHES) -> int:
    """How many files of ``time_split`` make a micro-batch: ``least`` batches of them all, or more, so that no batch has over ``most`` rows of a key.

    Each key of a micro-batch costs a few calls of its state, so batches must not become many as the input grows. A file has at most n rows of any
    key, so most / n files have at most ``most`` (a single file may, if it alone has more)."""
    own = written.groupBy(F.input_file_name().alias("file"), key).agg(F.count("*").alias("n"))
    files, n = own.agg(F.count_distinct("file"), F.max("n")).first()
    return max(1, min(-(-files // least), most // max(1, n or 0)))

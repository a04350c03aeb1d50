"""Exact per-event windows on streams: the same functions as `operators.windows`, with a key's state kept from batch to batch.

Rows wait in their key's state until the watermark has passed their time, so that they are taken in order of (ts_ms, pkt_id)
whatever the order and the batches they came in; then they are compared with the key's rows of the last `width`
milliseconds. A row later than the watermark is dropped. A key holds the rows of `width` and of the watermark's delay; a
timer clears it when it has been idle for `width`. The values of `previous` and `running_total` stay until `idle_ms`
after the key's last row, or for good where that is None.

Keys are dealt into BUCKETS, and a bucket's rows come, lie in the state and are looked at as columns: a call to the state
costs as much as thousands of rows in a column, so there is a fixed number of calls in a batch, not one for each row and key.

A stream must have a timestamp column `ts` with a watermark, and the long columns ts_ms and pkt_id. In the result ts_ms
stays, and `ts` is the watermark at which the answer came, so that one of these functions can follow another. Null keys
are a key of their own. Rules take this module as their `over`.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from packetlake import config as c

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys, by a hash, whose state is kept together.
BUCKETS = 128
#: Rows of a task that are packed together, bucket by bucket, before they are shuffled.
PACK = 200_000
#: Rows of a frame that is handed back.
FRAME = 100_000
#: A pack's column of the rows' `ts` in milliseconds, by which late ones are told.
_AT = "_at"


class _Places:
    """Rows in order of (key, ts_ms, pkt_id): code (of the key), new (whether a row is to be answered), t (a time at which no key's window reaches another key), at (that of the new rows)."""

    def __init__(self, code: np.ndarray, times: np.ndarray, new: np.ndarray, width: int):
        self.code, self.new, self.keys = code, new, np.unique(code[new])
        low = int(times.min())
        self.t = times - low + code * (int(times.max()) - low + width + 1)
        self.at = self.t[new]
        self.begin = np.searchsorted(code[new], self.keys)  # of each key among the new rows

    def ends(self) -> np.ndarray:
        return np.append(self.begin[1:], len(self.at))


class _InOrder(StatefulProcessor):
    """Takes each key's rows in order once the watermark has passed them. step(rows, places, memory) -> (new columns of the new rows, which of them stay (None: all), values).

    rows: a table of those of the last `width` milliseconds and the new ones, in order of key and time; memory: the value
    kept for each key's code; values: those to keep from now on for the keys of the new rows, or None.
    """

    def __init__(self, step, schema: pa.Schema, keys: list[str], columns: list[str], width: int, idle_ms: int | None):
        self.step, self.schema, self.keys, self.columns, self.width, self.idle_ms = step, schema, keys, columns, width, idle_ms
        self.kept = pa.schema([*[schema.field(k) for k in keys], ("value", pa.string()), ("last_ms", pa.int64())])

    def init(self, handle) -> None:
        self.handle = handle
        packs = StructType([StructField("rows", BinaryType())])
        self.waiting, self.recent, self.memory = (handle.getListState(n, packs) for n in ("waiting", "recent", "memory"))

    def _table(self, state, schema: pa.Schema) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(r[0]), schema) for r in state.get()] if state.exists() else [], schema)

    def _put(self, state, rows: pa.Table) -> None:
        if len(rows):
            state.put([(b.serialize().to_pybytes(),) for b in rows.combine_chunks().to_batches()])
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues):
        now, ends = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            for _, pack, oldest, first, last, _ in pdf.itertuples(index=False):
                if oldest <= now:  # a pack that holds late rows among others
                    table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(pack), self.schema)])
                    table = table.filter(pc.greater(table[_AT], now)).combine_chunks()
                    if not len(table):
                        continue
                    pack = table.to_batches()[0].serialize().to_pybytes()
                self.waiting.appendValue((pack,))
                ends += [int(first), int(last)]
        if ends:
            self.handle.registerTimer(min(ends))  # the first one ready, so that no more than a batch waits, and the last one
            self.handle.registerTimer(max(ends))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting, recent, memory = self._table(self.waiting, self.schema), self._table(self.recent, self.schema), self._table(self.memory, self.kept)
        passed = waiting["ts_ms"].to_numpy() <= now
        if passed.any():
            rows = pa.concat_tables([recent, waiting.filter(pa.array(passed))])
            code = _codes(pa.concat_tables([memory.select(self.keys), rows.select(self.keys)]), self.keys)
            known, code = code[: len(memory)], code[len(memory) :]
            order = np.lexsort((rows["pkt_id"].to_numpy(), rows["ts_ms"].to_numpy(), code))
            rows, code = rows.take(order).combine_chunks(), code[order]
            times = rows["ts_ms"].to_numpy()
            places = _Places(code, times, order >= len(recent), self.width)
            held = np.full(max(int(code.max()), int(known.max(initial=0))) + 1, None)
            held[known] = memory["value"].to_pylist()
            new, stay, values = self.step(rows, places, held)
            out = rows.filter(pa.array(places.new))
            for name, x in zip(self.columns, new):
                out = out.append_column(name, x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x))
            if stay is not None:
                out = out.filter(pa.array(stay))
            rest, recent = waiting.filter(pa.array(~passed)), rows.filter(pa.array(times > now - self.width))  # rows still to come are later than the watermark
            if values is not None:
                final = np.flatnonzero(places.new)[places.ends() - 1]  # the last row of each key
                latest = pa.Table.from_arrays([*[rows[k].take(final).combine_chunks() for k in self.keys], pa.array(values, pa.string()), pa.array(times[final])], schema=self.kept)
                memory = pa.concat_tables([memory.filter(pa.array(~np.isin(known, places.keys))), latest.filter(pc.is_valid(latest["value"]))])
            if len(rest):
                self.handle.registerTimer(pc.min(rest["ts_ms"]).as_py())
            self._put(self.waiting, rest)
            self._keep(recent, memory, now)
            for k in range(0, len(out), FRAME):
                pdf = out.slice(k, FRAME).drop_columns(_AT).to_pandas(integer_object_nulls=True)
                pdf["ts"] = pd.Timestamp(now + 1, unit="ms", tz="UTC")
                yield pdf
        else:  # nothing came for `width`, or for `idle_ms`
            self._keep(recent.filter(pc.greater(recent["ts_ms"], now - self.width)), memory, now)

    def _keep(self, recent: pa.Table, memory: pa.Table, now: int) -> None:
        self._put(self.recent, recent)
        if len(recent):
            self.handle.registerTimer(pc.max(recent["ts_ms"]).as_py() + self.width)
        if self.idle_ms and len(memory):
            memory = memory.filter(pc.greater(memory["last_ms"], now - self.idle_ms))
            if len(memory):
                self.handle.registerTimer(pc.min(memory["last_ms"]).as_py() + self.idle_ms)
        self._put(self.memory, memory)

    def close(self) -> None:
        pass


def _codes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row, the same for rows with the same keys."""
    code = np.zeros(len(rows), np.int64)
    for k in keys:
        of = rows[k].combine_chunks().dictionary_encode()
        code = code * (len(of.dictionary) + 1) + pc.fill_null(of.indices, -1).to_numpy(zero_copy_only=False) + 1
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    return code


def _packing(schema: pa.Schema):
    """For mapInArrow: a row for each bucket of some PACK rows, with the bucket's rows as one pack, the least of their `ts` in milliseconds, the ends of their ts_ms, and the newest `ts`."""

    def packed(rows: pa.Table) -> pa.RecordBatch:
        order = np.argsort(rows["bucket"].to_numpy(), kind="stable")
        rows = rows.take(order)
        bucket = rows["bucket"].to_numpy()
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        at, t = rows["ts"].cast(pa.int64()).to_numpy(), rows["ts_ms"].to_numpy()
        batch = pa.Table.from_arrays([*[rows[f.name] for f in schema if f.name != _AT], pa.array(at // 1000)], schema=schema).combine_chunks().to_batches()[0]
        packs = pa.array([batch.slice(s, e - s).serialize().to_pybytes() for s, e in zip(start, [*start[1:], len(order)])], pa.binary())
        ends = [pa.array(f.reduceat(x, start)) for f, x in ((np.minimum, at // 1000), (np.minimum, t), (np.maximum, t))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[start]), packs, *ends, pa.array(np.maximum.reduceat(at, start)).cast(rows["ts"].type)], ["bucket", "pack", "oldest", "first_ms", "last_ms", "ts"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= PACK:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return run


def _apply(df: DataFrame, keys: list[str], step, columns: dict[str, str], width: int = 0, idle_ms: int | None = None, drop: tuple = ()) -> DataFrame:
    """df with the new columns that `step` gives each row, but for rows that it lets go."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = df.select(*[x for x in df.columns if x != "ts"], "ts")
    state, at = StructType([f for f in rows.schema if f.name != "ts"]), rows.schema["ts"]  # with what tells its watermark
    schema = to_arrow_schema(state).append(pa.field(_AT, pa.int64()))
    new = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in columns.items())).fields if columns else []
    packs = StructType([StructField("bucket", LongType()), StructField("pack", BinaryType()), *[StructField(n, LongType()) for n in ("oldest", "first_ms", "last_ms")], at])
    packed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).mapInArrow(_packing(schema), packs)
    processor = _InOrder(step, schema, keys, list(columns), width, idle_ms)
    done = packed.groupBy("bucket").transformWithStateInPandas(processor, StructType([*state.fields, *new, at]), "Append", "EventTime", eventTimeColumnName="ts")
    return done.select(*[x for x in df.columns if x not in drop], *columns)


def count_in_window(df: DataFrame, keys: list[str], width: int, name: str) -> DataFrame:
    """Add the number of the key's rows in the last `width` milliseconds, those of the same millisecond included."""

    def step(rows, places, memory):
        t, at = places.t, places.at
        return [np.searchsorted(t, at, "right") - np.searchsorted(t, at - width, "right")], None, None

    return _apply(df, keys, step, {name: "long"}, width)


def distinct_in_window(df: DataFrame, keys: list[str], value: str, width: int, **tests) -> DataFrame:
    """Add, for each test (name -> condition on the row), how many different values rows that pass it had in the last `width` milliseconds.

    A value counts from the row that brings it until `width` after the last one before a gap.
    """
    marks = [f"_is{name}" for name in tests]
    # a constant would be moved over the stateful operator, and its column not reach it
    df = df.withColumns({m: F.coalesce(test, F.lit(False)) & (F.col("ts_ms") >= 0) for m, test in zip(marks, tests.values())})

    def step(rows, places, memory):
        t, at, out = places.t, places.at, []
        values = rows[value].combine_chunks().dictionary_encode()
        of = pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False)
        for m in marks:
            held = np.flatnonzero((of >= 0) & pc.fill_null(rows[m], False).to_numpy())
            v = places.code[held] * (len(values.dictionary) + 1) + of[held]
            order = np.argsort(v, kind="stable")  # by key and value, each in order of time
            s, v = t[held[order]], v[order]
            cut = (v[1:] != v[:-1]) | (s[1:] - s[:-1] >= width)
            first, final = np.ones(len(s), bool), np.ones(len(s), bool)
            first[1:], final[:-1] = cut, cut
            out.append(np.searchsorted(np.sort(s[first]), at, "right") - np.searchsorted(np.sort(s[final] + width), at, "right"))
        return out, None, None

    return _apply(df, keys, step, {name: "long" for name in tests}, width, drop=tuple(marks))


def newest_in_window(df: DataFrame, keys: list[str], width: int, value: str, name: str) -> DataFrame:
    """Add the newest `value` that is not empty of the key's rows in the last `width` milliseconds; of one millisecond that of the largest pkt_id."""

    def step(rows, places, memory):
        t, at = places.t, places.at
        some = np.flatnonzero(pc.fill_null(pc.not_equal(rows[value], ""), False).to_numpy())
        if not len(some):
            return [pa.nulls(len(at), rows[value].type)], None, None
        place = np.searchsorted(t[some], at, "right") - 1
        newest = some[np.maximum(place, 0)]
        return [rows[value].take(pa.array(newest, mask=(place < 0) | (t[newest] <= at - width)))], None, None

    return _apply(df, keys, step, {name: dict(df.dtypes)[value]}, width)


def previous(df: DataFrame, key: str, value: str, name: str, idle_ms: int | None = None) -> DataFrame:
    """Add the key's `value` (a text) of the row before in order of (ts_ms, pkt_id)."""

    def step(rows, places, memory):
        values = np.array(rows[value].filter(pa.array(places.new)).to_pylist(), object)
        before = np.empty(len(values), object)
        before[1:] = values[:-1]
        before[places.begin] = memory[places.keys]
        return [pa.array(before, pa.string())], None, values[places.ends() - 1]

    return _apply(df, [key], step, {name: "string"}, idle_ms=idle_ms)


def busy(df: DataFrame, keys: list[str], width: int, least: int, value: str | None = None) -> DataFrame:
    """df: which blocks of a stream have too few rows is not known beforehand."""
    return df


def running_total(df: DataFrame, key: str, value: str, name: str, idle_ms: int | None = None, changes=None) -> DataFrame:
    """Add the key's sum of `value` (a whole number) up to each row in order of (ts_ms, pkt_id); `changes` leaves nothing out here."""

    def step(rows, places, memory):
        sums = np.cumsum(pc.fill_null(rows[value].filter(pa.array(places.new)), 0).to_numpy().astype(np.int64))
        start = np.array([int(x or 0) for x in memory[places.keys]], np.int64) - np.where(places.begin > 0, sums[places.begin - 1], 0)
        total = sums + np.repeat(start, places.ends() - places.begin)
        return [total], None, [str(x) for x in total[places.ends() - 1]]

    return _apply(df, [key], step, {name: "long"}, idle_ms=idle_ms)


def cooldown(found: DataFrame, ms: int = c.DEFAULT.cooldown_ms) -> DataFrame:
    """Alerts without those within `ms` of the last one let through by (rule, source, destination); the time of that one is forgotten after `ms`."""
    keys, said = ["rule_id", "src_ip", "dst_ip"], dict(found.dtypes).get("evidence")
    found = found.withColumn("evidence", F.to_json("evidence")) if said else found

    def step(rows, places, memory):
        times, stay, passed = rows["ts_ms"].to_numpy()[places.new], np.zeros(len(places.at), bool), []
        for start, end, last in zip(places.begin, places.ends(), memory[places.keys]):
            k = start + int(np.searchsorted(times[start:end], int(last) + ms)) if last else start
            while k < end:
                stay[k], last = True, int(times[k])
                k += int(np.searchsorted(times[k:end], last + ms))
            passed.append(str(last))
        return [], stay, passed

    passed = _apply(found, keys, step, {}, idle_ms=ms)
    return passed.withColumn("evidence", F.from_json("evidence", said)) if said else passed

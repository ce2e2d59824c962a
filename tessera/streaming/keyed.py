"""Keyed state with timers: events of a key are taken one by one in time order, however they come within the watermark.

Rows wait in state until the watermark has passed them. Keys share ``SHELVES`` shelves by hash, and a shelf is the stream's group: what its keys remember, and their waiting rows while a
key has few, are one packed value, read and written once a shelf and batch, and the shelf has one timer, for the next thing that is due. Rows come to a shelf and answers leave it packed, a few
packs a task. Before, each row was a Python object, and each key and batch half a dozen calls to the state store and an Arrow batch of its own. A key with more rows than ``FEW`` has them under
the slots of time that they belong to, so what it needs at once is one slot's times or ``FEW`` of them, never a batch of the key: a key with a third of all rows is many slots in the state
store. What a rule keeps for a key is one number or two, and it goes when the timer says that it no longer matters.

A row is too late, and dropped, once its shelf was settled at a watermark beyond it; that mark stays with the shelf.
The state store must be RocksDB (``store``). Rows whose time is null have no place in time and are left out; a null key is a key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that wait in its one value, and rows of a key's answer.
FEW, ANSWERS = 20_000, 10_000
#: Groups of keys (fixed for a checkpoint), rows and bytes that a task packs together, rows that a shelf takes or answers at once.
SHELVES, PACK, PACK_BYTES, CHUNK = 4096, 500_000, 1 << 28, 200_000
#: Before any watermark, which Spark gives as 0.
NEVER = -(1 << 53)
TIMES = T.StructType([T.StructField("at", T.BinaryType())])
SLOT = T.StructType([T.StructField("slot", T.LongType())])
PLACE = T.StructType([T.StructField("number", T.LongType()), *SLOT.fields])


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class State:
    """What a key has: its timer, waiting times (or the slots that hold them) in microseconds, and what the rule keeps."""

    def __init__(self, timer: int | None = None, times: bytes = b"", slots: bytes = b"", kept: tuple | None = None):
        self.timer, self.kept = timer, kept
        self.times, self.slots = np.frombuffer(times, np.int64), set(np.frombuffer(slots, np.int64).tolist())


class InTimeOrder(StatefulProcessor):
    """Calls ``take`` for each event of a key in time order; ``kept`` is what it remembers between them (longs or doubles by ``memory``)."""

    memory = T.StructType([])

    def __init__(self, slot_ms: int):
        self.slot_ms = slot_ms
        self.few = FEW

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = [T.StructField("timer", T.LongType()), T.StructField("times", T.BinaryType()), T.StructField("slots", T.BinaryType()), T.StructField("keeps", T.BooleanType())]
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([*own, *self.memory.fields]))
        self.waiting = handle.getMapState("waiting", SLOT, TIMES)

    def take(self, kept: tuple | None, at: int) -> tuple[tuple, bool]:
        """What to keep after an event at a time in microseconds, and the answer for it."""
        raise NotImplementedError

    def forgets_at(self, kept: tuple) -> int | None:
        """Time in milliseconds from which on what is kept says nothing any more."""
        return None

    def load(self) -> State:
        found = self.state.get()
        if found is None:
            return State()
        timer, times, slots, keeps, *kept = found
        return State(timer, bytes(times), bytes(slots), tuple(kept) if keeps else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # all rows of the key in this batch are there, so what is due needs no timer of its own
        yield from self.arrived(key, np.fromiter((row["__at"] for row in rows), np.int64), timerValues.getCurrentWatermarkInMs())

    def arrived(self, key, times: np.ndarray, watermark: int) -> Iterator[Row]:
        """Takes new times of a key and answers for all that the watermark has passed."""
        state = self.load()
        state.times = np.concatenate((state.times, times))
        if state.slots or len(state.times) >= self.few:
            self.put(state, state.times)
            state.times = state.times[:0]
        yield from self.settle(key, state, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.load()
        if state.timer == expiredTimerInfo.getExpiryTimeInMs():
            state.timer = None  # goes by itself
        yield from self.settle(key, state, timerValues.getCurrentWatermarkInMs())

    def put(self, state: State, times: np.ndarray) -> None:
        """Adds times to their slots."""
        own = np.sort(times)
        slots, first = np.unique(own // 1000 // self.slot_ms, return_index=True)
        for slot, some in zip(slots.tolist(), np.split(own, first[1:]), strict=False):
            before = bytes(self.waiting.getValue((slot,))[0]) if slot in state.slots else b""
            self.waiting.updateValue((slot,), (before + some.tobytes(),))
            state.slots.add(slot)

    def settle(self, key, state: State, watermark: int) -> Iterator[Row]:
        """Answers for all that the watermark (milliseconds) has passed; sets the next timer."""
        for slot in sorted(s for s in state.slots if (s + 1) * self.slot_ms <= watermark):
            yield from self.answers(key, state, np.sort(np.frombuffer(bytes(self.waiting.getValue((slot,))[0]), np.int64)))
            self.waiting.removeKey((slot,))
            state.slots.discard(slot)
        times = np.sort(state.times)
        due = int(np.searchsorted(times, watermark * 1000, "right"))
        yield from self.answers(key, state, times[:due])
        state.times = times[due:]
        self.save(state, watermark)

    def answers(self, key, state: State, times: np.ndarray) -> Iterator[Row]:
        """Rows of several times and the answers for them."""
        for first in range(0, len(times), ANSWERS):
            some, told = times[first : first + ANSWERS].tolist(), []
            for at in some:
                state.kept, answer = self.take(state.kept, at)
                told.append(answer)
            yield Row(key=key[0], at=some, answer=told)

    def save(self, state: State, watermark: int) -> None:
        timer = None
        if state.slots:
            timer = (min(state.slots) + 1) * self.slot_ms
        elif len(state.times):
            timer = -(-int(state.times[0]) // 1000)
        elif state.kept is not None:
            timer = self.forgets_at(state.kept)
            if timer is not None and timer <= watermark:
                timer = state.kept = None
        if timer != state.timer:
            if state.timer is not None:
                self.handle.deleteTimer(state.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        if timer is None and state.kept is None:
            self.state.clear()
        else:
            kept = state.kept or (None,) * len(self.memory.fields)
            self.state.update((timer, state.times.tobytes(), np.array(sorted(state.slots), np.int64).tobytes(), state.kept is not None, *kept))

    def close(self) -> None:
        pass


class TokenBucket(InTimeOrder):
    """Each event takes a token where there is one; tokens return at ``rate`` a second up to ``capacity``. A full bucket is no memory."""

    memory = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("last", T.LongType())])

    def __init__(self, slot_ms: int, rate: float, capacity: float):
        super().__init__(slot_ms)
        self.rate, self.capacity = rate, capacity

    def take(self, kept, at):
        tokens, last = kept or (self.capacity, at)
        tokens = min(self.capacity, tokens + (at - last) / 1e6 * self.rate)
        allowed = tokens >= 1.0
        return (tokens - 1.0 if allowed else tokens, at), allowed

    def forgets_at(self, kept):
        return kept[1] // 1000 + int((self.capacity - kept[0]) / self.rate * 1000) + 2 if self.rate > 0 else None


class TtlCache(InTimeOrder):
    """A hit where an entry is younger than ``life_us``; a miss writes one. Hits don't renew it."""

    memory = T.StructType([T.StructField("entry", T.LongType())])

    def __init__(self, slot_ms: int, life_us: int):
        super().__init__(slot_ms)
        self.life_us = life_us

    def take(self, kept, at):
        hit = kept is not None and at < kept[0] + self.life_us
        return (kept if hit else (at,)), hit

    def forgets_at(self, kept):
        return (kept[0] + self.life_us) // 1000 + 1


class Place:
    """Stands for the state store while a rule serves one key of a shelf: the value is the shelf's to keep, its first number is the timer, and slots are found under the key's number."""

    def __init__(self, slots):
        self.slots, self.number, self.value = slots, 0, None

    def getValueState(self, *_) -> Place:
        return self

    def getMapState(self, *_) -> Place:
        return self

    def registerTimer(self, at: int) -> None:
        pass

    def deleteTimer(self, at: int) -> None:
        pass

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None

    def getValue(self, slot: tuple) -> tuple | None:
        return self.slots.getValue((self.number, *slot))

    def updateValue(self, slot: tuple, times: tuple) -> None:
        self.slots.updateValue((self.number, *slot), times)

    def removeKey(self, slot: tuple) -> None:
        self.slots.removeKey((self.number, *slot))


def name(key):
    """A key as one that finds itself in a dictionary, NaN and nested values too."""
    if isinstance(key, dict | list):
        return tuple(map(name, key.values() if isinstance(key, dict) else key))
    return repr(key) if key != key else key


class Shelf(StatefulProcessor):
    """The keys of a shelf, each served by the rule; (timer, settled, next number, keys) is the shelf's state."""

    def __init__(self, rule: InTimeOrder):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = [T.StructField("timer", T.LongType()), T.StructField("settled", T.LongType()), T.StructField("number", T.LongType()), T.StructField("keys", T.BinaryType())]
        self.handle = handle
        self.state = handle.getValueState("shelf", T.StructType(own))
        self.place = Place(handle.getMapState("waiting", PLACE, TIMES))
        self.rule.init(self.place)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self.served(rows, timerValues, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.served((), timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def served(self, packs: Iterable[Row], timerValues, expired: int | None) -> Iterator[Row]:
        timer, settled, self.number, keys = self.state.get() or (None, NEVER, 0, None)
        # name: (number, key, what the rule keeps in its value)
        self.keys = pickle.loads(bytes(keys)) if keys else {}
        watermark = timerValues.getCurrentWatermarkInMs() or NEVER
        yield from gathered(self.answers(packs, settled, watermark))
        due = min((value[0] for _, _, value in self.keys.values() if value[0] is not None), default=None)
        if due is not None:
            due = max(due, 1)
        before = None if timer == expired else timer  # one that has expired goes by itself
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((due, max(settled, watermark), self.number, pickle.dumps(self.keys, pickle.HIGHEST_PROTOCOL)))

    def answers(self, packs: Iterable[Row], settled: int, watermark: int) -> Iterator[Row]:
        keys, times = [], []
        for pack in packs:
            keys += pack["keys"]
            times.append(np.frombuffer(bytes(pack["at"]), np.int64))
            if len(keys) >= CHUNK:
                yield from self.taken(keys, np.concatenate(times), settled, settled)  # nothing is due yet
                keys, times = [], []
        if keys:
            yield from self.taken(keys, np.concatenate(times), settled, watermark)
        for own in [n for n, (_, _, value) in self.keys.items() if value[0] is not None and value[0] <= watermark]:
            yield from self.told(own, None, np.zeros(0, np.int64), watermark)

    def taken(self, keys: list, times: np.ndarray, settled: int, watermark: int) -> Iterator[Row]:
        """Hands times to their keys, except those that come too late."""
        numbers, firsts = {}, []
        codes = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys):
            own = name(key)
            code = numbers.get(own)
            if code is None:
                code = numbers[own] = len(firsts)
                firsts.append(key)
            codes[i] = code
        fresh = times > settled * 1000
        codes, times = codes[fresh], times[fresh]
        order = np.argsort(codes, kind="stable")
        times, ends = times[order], np.cumsum(np.bincount(codes, minlength=len(firsts))).tolist()
        start = 0
        for own, key, end in zip(numbers, firsts, ends, strict=True):
            if end > start:
                yield from self.told(own, key, times[start:end], watermark)
            start = end

    def told(self, own, key, times: np.ndarray, watermark: int) -> Iterator[Row]:
        place = self.place
        if own in self.keys:
            place.number, key, place.value = self.keys[own]
        else:
            place.number, place.value, self.number = self.number, None, self.number + 1
        yield from self.rule.arrived((key,), times, watermark)
        if place.value is None:
            self.keys.pop(own, None)
        else:
            self.keys[own] = place.number, key, place.value

    def close(self) -> None:
        pass


def gathered(answers: Iterable[Row]) -> Iterator[Row]:
    """Answers of several keys as packs: keys, how many times each has, the times and the answers."""
    held, n = [], 0
    for row in answers:
        held.append(row)
        n += len(row.at)
        if n >= CHUNK:
            yield gathering(held)
            held, n = [], 0
    if held:
        yield gathering(held)


def gathering(held: list[Row]) -> Row:
    join = lambda parts, kind: b"".join(np.array(p, kind).tobytes() for p in parts)
    return Row(keys=[r.key for r in held], n=np.array([len(r.at) for r in held], np.int64).tobytes(), at=join((r.at for r in held), np.int64), answer=join((r.answer for r in held), np.bool_))


def packing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shelf, keys, times) for each shelf, of up to ``PACK`` rows of a task."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= PACK or size >= PACK_BYTES:
            yield packed(held)
            held, n, size = [], 0, 0
    if n:
        yield packed(held)


def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    shelf, at = rows["shelf"].to_numpy(), rows["at"].to_numpy()
    order = np.argsort(shelf, kind="stable")
    shelves, firsts = np.unique(shelf[order], return_index=True)
    bounds = np.append(firsts, len(order)).astype(np.int32)
    keys = pa.concat_arrays(rows["key"].chunks).take(pa.array(order))
    times = pa.Array.from_buffers(pa.binary(), len(shelves), [None, pa.py_buffer(bounds * np.int32(8)), pa.py_buffer(at[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(shelves, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds), keys), times], names=["shelf", "keys", "at"])


def unpacking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, answer) for each row of the packs."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, (n, at, answer) = batch.column("keys")[i].values, (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("n", np.int64), ("at", np.int64), ("answer", np.bool_)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(at), pa.array(answer)], names=["key", "at", "answer"])


def run(df: DataFrame, key: str, ts: str, rule: InTimeOrder, answer: str) -> DataFrame:
    """(key, ts, answer) for each row of a stream with a watermark on ``ts``."""
    field = lambda n, kind: T.StructField(n, kind)
    kind, raw = df.schema[key].dataType, T.BinaryType()
    keys = field("keys", T.ArrayType(kind))
    own = df.filter(F.col(ts).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(SHELVES)).cast("int").alias("shelf"), F.col(key).alias("key"), F.unix_micros(ts).alias("at"))
    packs = own.mapInArrow(packing, T.StructType([field("shelf", T.IntegerType()), keys, field("at", raw)]))
    out = T.StructType([keys, field("n", raw), field("at", raw), field("answer", raw)])
    told = packs.groupBy("shelf").transformWithState(statefulProcessor=Shelf(rule), outputStructType=out, outputMode="Append", timeMode="EventTime")
    each = told.mapInArrow(unpacking, T.StructType([field("key", kind), field("at", T.LongType()), field("answer", T.BooleanType())]))
    return each.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("answer").alias(answer))


def token_bucket(df: DataFrame, key: str, ts: str, rate: float, capacity: float, slot_ms: int = 1000) -> DataFrame:
    """(key, ts, allowed) for each request of a stream."""
    return run(df, key, ts, TokenBucket(slot_ms, rate, capacity), "allowed")


def ttl_cache(df: DataFrame, key: str, ts: str, ttl_seconds: float = 86_400, slot_ms: int = 1000) -> DataFrame:
    """(key, ts, hit) for each request of a stream through a cache whose entries live for ``ttl_seconds``."""
    return run(df, key, ts, TtlCache(slot_ms, int(ttl_seconds * 1_000_000)), "hit")


def seen_within(df: DataFrame, key: str, ts: str, ttl_seconds: float, slot_ms: int = 1000) -> DataFrame:
    """(key, ts): the rows of keys that no row was let through for in the ``ttl_seconds`` before."""
    return ttl_cache(df, key, ts, ttl_seconds, slot_ms).filter("NOT hit").drop("hit")

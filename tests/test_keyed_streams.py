"""State with timers: results against a plain loop, a hot key, a restart."""

import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.streaming import keyed, streams

SCHEMA = "user long, ts timestamp, n long"
#: One row long after all others moves the watermark past them.
LAST = (-1, 4_000_000_000_000_000)


@pytest.fixture(autouse=True)
def store(spark):
    with keyed.store(spark):
        yield


def events(seed, n=400, users=6):
    """(user, microseconds) of stretches of time, each dealt in no order; a third of all rows are of user 0."""
    rng = random.Random(seed)
    rows = sorted((1_700_000_000_000_000 + rng.randrange(600_000_000), 0 if rng.random() < 0.33 else rng.randrange(1, users)) for _ in range(n))
    parts = [[(u, t) for t, u in rows[i : i + 100]] for i in range(0, n, 100)]
    for part in parts:
        rng.shuffle(part)
    return [*parts, [LAST]]


def write(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, "user long, us long").select("user", F.timestamp_micros("us").alias("ts"), F.lit(1).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, make, name="out"):
    source = streams.event_time(streams.files(spark, f"{tmp_path}/in", SCHEMA, max_files=1), delay="2 minutes")
    told = make(source)
    query = told.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{tmp_path}/{name}").filter("user >= 0")


def bucket(parts, rate, capacity):
    out, state = Counter(), {}
    for t, u in sorted((t, u) for p in parts for u, t in p if u >= 0):
        tokens, last = state.get(u, (capacity, t))
        tokens = min(capacity, tokens + (t - last) / 1e6 * rate)
        out[u, t, tokens >= 1] += 1
        state[u] = (tokens - (tokens >= 1), t)
    return out


def cache(parts, life):
    out, state = Counter(), {}
    for t, u in sorted((t, u) for p in parts for u, t in p if u >= 0):
        hit = u in state and t < state[u] + life
        out[u, t, hit] += 1
        if not hit:
            state[u] = t
    return out


def collected(df):
    return Counter((r[0], r[1], r[2]) for r in df.select("user", F.unix_micros("ts"), df.columns[2]).collect())


def test_token_bucket_in_time_order_with_a_hot_key(spark, tmp_path):
    parts = events(1)
    write(spark, f"{tmp_path}/in", parts)
    assert collected(run(spark, tmp_path, lambda s: keyed.token_bucket(s, "user", "ts", 0.2, 3.0))) == bucket(parts, 0.2, 3.0)


def test_cache_survives_a_restart(spark, tmp_path):
    parts = events(2)
    make = lambda s: keyed.ttl_cache(s, "user", "ts", 45.0, slot_ms=500)
    write(spark, f"{tmp_path}/in", parts[:2])
    early = collected(run(spark, tmp_path, make))
    # the rows that the watermark has not passed wait in the checkpoint
    assert 0 < sum(early.values()) < 200
    write(spark, f"{tmp_path}/in", parts[2:])
    assert collected(run(spark, tmp_path, make)) == cache(parts, 45_000_000)


def test_first_rows_of_keys_and_state_that_goes(spark, tmp_path):
    parts = events(3, n=200)
    write(spark, f"{tmp_path}/in", parts)
    got = run(spark, tmp_path, lambda s: keyed.seen_within(s, "user", "ts", 20.0))
    want = Counter((u, t) for (u, t, hit), n in cache(parts, 20_000_000).items() for _ in range(n) if not hit)
    assert Counter((r.user, r.us) for r in got.select("user", F.unix_micros("ts").alias("us")).collect()) == want


def test_rules_by_hand():
    rule = keyed.TokenBucket(1000, 1.0, 2.0)
    kept, answers = None, []
    for at in (0, 0, 0, 1_000_000, 1_000_000, 9_000_000):
        kept, answer = rule.take(kept, at)
        answers.append(answer)
    assert answers == [True, True, False, True, False, True] and kept == (1.0, 9_000_000)
    # full again a second later
    assert rule.forgets_at(kept) == 10_002


class Calls:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.n, self.value, self.map, self.timers = 0, None, {}, set()

    def counted(self, value=None):
        self.n += 1
        return value

    getValueState = getMapState = lambda self, *a: self
    get = lambda self: self.counted(self.value)
    getValue = lambda self, k: self.counted(self.map.get(k))
    exists = lambda self: self.counted(self.value is not None)
    containsKey = lambda self, k: self.counted(k in self.map)
    update = lambda self, v: self.counted(setattr(self, "value", v))
    clear = lambda self: self.counted(setattr(self, "value", None))
    updateValue = lambda self, k, v: self.counted(self.map.__setitem__(k, v))
    removeKey = lambda self, k: self.counted(self.map.pop(k))
    registerTimer = lambda self, t: self.counted(self.timers.add(t))
    deleteTimer = lambda self, t: self.counted(self.timers.discard(t))


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def told(rule, parts, watermarks):
    """Answers of one key, its rows and watermarks batch by batch, and the store."""
    store, out = Calls(), []
    rule.init(store)
    for times, ms in zip(parts, watermarks, strict=True):
        rows = list(rule.handleInputRows((1,), iter([Row(__at=t) for t in times]), Clock(ms))) if times else []
        for t in sorted(t for t in store.timers if t <= ms):
            rows += rule.handleExpiredTimer((1,), Clock(ms), Clock(t))
            store.timers.discard(t)
        out += [answer for r in rows for answer in zip([r.at] if isinstance(r.at, int) else r.at, [r.answer] if isinstance(r.at, int) else r.answer, strict=True)]
    return out, store


def spread(n=3000):
    """Three batches of one key's times, seconds apart; the watermark is behind each batch by some rows; the last is far beyond."""
    rng = random.Random(9)
    times = sorted(1_700_000_000_000_000 + rng.randrange(n * 1_000_000) for _ in range(n))
    parts = [times[i : i + n // 3] for i in range(0, n, n // 3)]
    marks = [0, *((p[-1] - 30_000_000) // 1000 for p in parts[:-1])]
    for part in parts:
        rng.shuffle(part)
    return [*parts, []], [*marks, times[-1] // 1000 + 10**9]


RULES = [(lambda: keyed.TokenBucket(500, 0.3, 3.0), lambda p: bucket(p, 0.3, 3.0)), (lambda: keyed.TtlCache(500, 7_000_000), lambda p: cache(p, 7_000_000))]


@pytest.mark.parametrize(("make", "plain"), RULES)
def test_calls_to_the_state_store_are_a_few_a_key_and_batch(make, plain):
    parts, marks = spread()
    got, store = told(make(), parts, marks)
    assert Counter((1, *g) for g in got) == plain([[(1, t) for t in p] for p in parts])
    assert store.n < 30, "calls grow with the rows"
    assert store.value is None and not store.timers, "the key is forgotten"


@pytest.mark.parametrize(("make", "plain"), RULES)
def test_a_key_with_many_rows_waits_in_slots(make, plain):
    parts, marks = spread()
    rule = make()
    rule.few = 100
    got, store = told(rule, parts, marks)
    assert [t for t, _ in got] == sorted(t for t, _ in got)
    assert Counter((1, *g) for g in got) == plain([[(1, t) for t in p] for p in parts])
    assert store.value is None and not store.timers and not store.map


def test_slots_through_the_state_store(spark, tmp_path):
    parts = events(4)
    write(spark, f"{tmp_path}/in", parts)
    rule = keyed.TokenBucket(1000, 0.2, 3.0)
    rule.few = 20
    assert collected(run(spark, tmp_path, lambda s: keyed.run(s, "user", "ts", rule, "allowed"))) == bucket(parts, 0.2, 3.0)


def shelved(rule, parts, watermarks):
    """Answers of a shelf of several keys, its (key, time) rows and watermarks batch by batch, and the store."""
    store, out = Calls(), []
    shelf = keyed.Shelf(rule)
    shelf.init(store)
    for rows, ms in zip(parts, watermarks, strict=True):
        packs = [Row(shelf=0, keys=[k for k, _ in some], at=np.array([t for _, t in some], np.int64).tobytes()) for some in (rows[::2], rows[1::2]) if some]
        got = list(shelf.handleInputRows((0,), iter(packs), Clock(ms))) if packs else []
        for t in sorted(t for t in store.timers if t <= ms):
            got += shelf.handleExpiredTimer((0,), Clock(ms), Clock(t))
            store.timers.discard(t)
        for r in got:
            counts, at, answer = (np.frombuffer(b, kind).tolist() for b, kind in ((r.n, "int64"), (r.at, "int64"), (r.answer, "bool")))
            out += zip([k for k, n in zip(r.keys, counts, strict=True) for _ in range(n)], at, answer, strict=True)
    return out, store


def many_keys():
    parts, marks = spread()
    rng = random.Random(5)
    return [[(0 if rng.random() < 0.33 else rng.randrange(1, 200), t) for t in part] for part in parts], marks


@pytest.mark.parametrize(("make", "plain"), RULES)
def test_calls_to_the_state_store_are_a_few_a_shelf_whatever_its_keys(make, plain):
    parts, marks = many_keys()
    got, store = shelved(make(), parts, marks)
    assert Counter(got) == plain(parts)
    assert store.n < 30, "calls grow with the keys"
    assert not store.timers and not store.map and not pickle.loads(store.value[3]), "the keys are forgotten"


@pytest.mark.parametrize(("make", "plain"), RULES)
def test_a_hot_key_of_a_shelf_waits_in_slots_and_comes_in_chunks(make, plain, monkeypatch):
    monkeypatch.setattr(keyed, "CHUNK", 50)
    parts, marks = many_keys()
    rule = make()
    rule.few = 20
    got, store = shelved(rule, parts, marks)
    assert Counter(got) == plain(parts)
    assert not store.timers and not store.map


def test_rows_behind_the_mark_of_their_shelf_are_dropped():
    at = 1_700_000_000_000_000
    parts = [[("a", at), ("b", at + 5)], [("a", at + 10_000_000)], [("b", at + 1_000_000), ("b", at + 3_000_000), ("c", at + 2_000_000), ("c", at + 2_000_001)], []]
    got, _ = shelved(keyed.TtlCache(500, 7_000_000), parts, [0, at // 1000 + 2000, at // 1000 + 2000, at // 1000 + 10**6])
    # the shelf was settled up to two seconds: a row at or before that has no place any more
    assert sorted(got) == [("a", at, False), ("a", at + 10_000_000, False), ("b", at + 5, False), ("b", at + 3_000_000, True), ("c", at + 2_000_001, False)]


def test_rows_before_1970_wait_for_a_watermark():
    parts = [[("a", -5_000_000)], [("a", -4_000_000)], []]
    got, _ = shelved(keyed.TtlCache(500, 7_000_000), parts, [0, 0, 10**9])
    assert got == [("a", -5_000_000, False), ("a", -4_000_000, True)]


def test_the_state_store_has_a_row_a_shelf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "SHELVES", 8)
    parts = events(6, users=300)[:-1]
    write(spark, f"{tmp_path}/in", parts)
    source = streams.event_time(streams.files(spark, f"{tmp_path}/in", SCHEMA, max_files=1), delay="2 hours")
    query = keyed.ttl_cache(source, "user", "ts", 45.0).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({u for p in parts for u, _ in p}) > 100
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


@pytest.mark.parametrize("key", ["IF(user = 0, NULL, concat('k', user))", "IF(user = 0, CAST('NaN' AS DOUBLE), user / 2)", "struct(IF(user = 0, CAST('NaN' AS DOUBLE), user) AS a, array(user) AS b)", "CAST(user AS DECIMAL(20, 3))", "IF(user = 0, NULL, (1L << 62) + user)"])
def test_keys_of_several_types(spark, tmp_path, key):
    parts = events(7, n=200)
    write(spark, f"{tmp_path}/in", parts)
    source = streams.event_time(streams.files(spark, f"{tmp_path}/in", SCHEMA, max_files=1), delay="2 minutes").selectExpr(f"{key} AS key", "ts")
    told = keyed.ttl_cache(source, "key", "ts", 45.0)
    told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(told.schema).parquet(f"{tmp_path}/out").select(F.expr("to_json(struct(key))").alias("k"), F.unix_micros("ts").alias("us"), "hit").collect()
    names = {r.user: r.k for r in spark.range(-1, 6).selectExpr("id AS user").selectExpr("user", f"to_json(struct({key} AS key)) AS k").collect()}
    want = Counter({(names[u], t, hit): n for (u, t, hit), n in cache(parts, 45_000_000).items()})
    assert Counter((r.k, r.us, r.hit) for r in got if r.k != names[-1]) == want

import random
import tracemalloc
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest

from tests import reference_model as model
from tideline.operators import failover
from tideline.streaming import failover as live

T0 = datetime(2024, 1, 1, 23, 59, 0, tzinfo=timezone.utc)
LIMIT = 30
FULL_STORY = [0.5, 1, 1.5, 2, 2.49, 2.51, 3.39, 3.52, 4.01, 4.5, 5, 5.5, 6]


def full_story():
    events = [(0, "heartbeat")]
    for x in FULL_STORY:
        second = int(x * LIMIT)
        events.append((second, "poll"))
        if x not in (2, 2.49, 6):
            events.append((second, "heartbeat"))
    return events


def frame(spark, timelines):
    rows = [(agent, T0 + timedelta(seconds=s), i, kind)
            for agent, events in timelines.items() for i, (s, kind) in enumerate(events)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "agent string, ts timestamp, seq bigint, kind string")


def random_timeline(rng, n, step):
    second, out = 0, []
    for _ in range(n):
        second += rng.choice([0, 0, 1, step, 3 * step])
        out.append((second, rng.choice(["poll", "poll", "heartbeat"])))
    return out


@pytest.mark.parametrize("chunk_seconds", [17, 60, 86_400])
def test_full_story(spark, chunk_seconds):
    df = frame(spark, {"a": full_story()})
    picked = failover.picks(df, LIMIT, chunk_seconds)
    polls = failover.poll_channels(df, picked).orderBy("seq").collect()
    assert "".join(r.channel[0].upper() for r in polls) == "PPPPPSSPPPPPP"


@pytest.mark.parametrize("chunk_seconds", [50, 1000])
def test_equals_the_walk_on_random_timelines(spark, chunk_seconds):
    rng = random.Random(chunk_seconds)
    timelines = {f"a{i}": random_timeline(rng, 150, rng.choice([3, 11, 40])) for i in range(12)}
    timelines["hot"] = random_timeline(rng, 1500, 7)
    df = frame(spark, timelines)
    picked = failover.picks(df, LIMIT, chunk_seconds)
    got = {a: [] for a in timelines}
    for r in failover.poll_channels(df, picked).orderBy("seq").collect():
        got[r.agent].append(r.channel)
    start = int(T0.timestamp())
    switched = {a: [] for a in timelines}
    for r in failover.switches(picked).orderBy("second").collect():
        switched[r.agent].append(r.second - start)
    for agent, events in timelines.items():
        picks, flips = model.failover(events, LIMIT)
        assert got[agent] == picks
        assert switched[agent] == flips
    assert sum(map(len, switched.values())) > 20


def test_continues_from_a_given_state(spark):
    start = int(T0.timestamp())
    df = frame(spark, {"a": [(40, "poll"), (60, "poll"), (61, "heartbeat"), (80, "poll")]})
    initial = spark.createDataFrame([("a", False, start + 35)],
                                    "agent string, on_primary boolean, clock bigint")
    picked = failover.picks(df, LIMIT, 50, initial).orderBy("second").collect()
    assert [r.channel for r in picked] == ["secondary", "secondary", "primary"]


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    rng = random.Random(5)
    timelines = {f"a{i}": random_timeline(rng, 80, 11) for i in range(4)}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = frame(spark, timelines)
    for lo in (0, 30):
        df.where(f"seq >= {lo} AND seq < {lo + 30 if lo == 0 else 1000}").coalesce(1).write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        (live.channels(stream, LIMIT).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
         .awaitTermination())
    got = spark.read.parquet(out)
    for agent, events in timelines.items():
        picks, _ = model.failover(events, LIMIT)
        rows = got.where(got.agent == agent).orderBy("seq").collect()
        assert [r.channel for r in rows] == picks
    assert got.where("channel = 'late'").count() == 0


def test_time_orders_events_inside_a_second_before_seq(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("a", start + timedelta(seconds=s), seq, kind) for s, seq, kind in (
        (0, 0, "heartbeat"), (600.1, 20, "poll"), (600.9, 10, "heartbeat"))]
    df = spark.createDataFrame(rows, "agent string, ts timestamp, seq bigint, kind string")
    assert failover.switches(failover.picks(df)).count() == 1


@pytest.mark.parametrize("seed", range(300))
def test_kernel_equals_the_walk_from_every_state(seed):
    rng = random.Random(seed)
    events = random_timeline(rng, rng.randrange(1, 40), rng.choice([1, 3, 11, 40]))
    seconds, kinds = zip(*events)
    poll = [k == "poll" for k in kinds]
    line = failover.Timeline(seconds, poll, [not p for p in poll], [False] * len(poll), LIMIT)
    for on_primary in (True, False):
        for age in range(LIMIT + 2):
            channel, clock, rows = on_primary, seconds[0] - age, []
            touched = False
            for i, (second, kind) in enumerate(events):
                if kind == "heartbeat" and channel:
                    clock, touched = second, True
                elif kind == "poll" and second - clock >= LIMIT:
                    channel, clock, touched = not channel, second, True
                    rows.append(i)
            assert line.switches(on_primary, seconds[0] - age).tolist() == rows
            end = line.exits([on_primary], [seconds[0] - age])[0]
            assert end == (2 * clock + channel if touched else -1)


def test_seconds_are_aggregated_without_a_sort(spark):
    plan = failover.per_second(frame(spark, {"a": full_story()}))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


class Handle:
    """The value state of one agent, without a stream."""

    value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def follow(chunks):
    """Rows and state that the stream's processor gives for one agent."""
    processor, handle = live._processor(LIMIT), Handle()
    processor.init(handle)
    sums = [np.zeros(4, np.int64)]
    for out in processor.handleInputRows(("a",), chunks, None):
        rows = out["seq"].to_numpy(np.int64)
        channel = out["channel"].map({"primary": 1, "secondary": 2, "late": 3}).to_numpy(np.int64)
        sums.append(np.array([len(out), (rows * channel).sum(), out["second"].sum(), (rows * out["switched"]).sum()]))
    return sum(sums).tolist(), handle.value


def chunks_of(n, rng):
    order = rng.permutation(n)
    for rows in np.array_split(order, max(1, n // 5000)):
        yield pd.DataFrame({"agent": "a", "us": rows // 2 * 700_000, "seq": rows,
                            "kind": np.where(rows % 970 < 600, "heartbeat", "poll").astype(object)})


@pytest.mark.parametrize("slab", [7, 100, 3000])
def test_stream_follows_an_agent_slab_by_slab(monkeypatch, slab):
    want = follow(chunks_of(4000, np.random.default_rng(slab)))
    monkeypatch.setattr(live, "SLAB", slab)
    assert follow(chunks_of(4000, np.random.default_rng(slab))) == want
    assert want[0][0] > 1000 and want[0][3] > 0


def test_stream_keeps_few_bytes_of_an_event(monkeypatch):
    monkeypatch.setattr(live, "SLAB", 20_000, raising=False)
    tracemalloc.start()
    follow(chunks_of(400_000, np.random.default_rng(1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Eight of them are the test's own order of the rows.
    assert peak / 400_000 < 70

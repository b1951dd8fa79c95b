"""JOB8 batch: which channel an agent used, from its heartbeats and polls.

An agent starts on the primary channel. A poll switches to the secondary when no
heartbeat came for T seconds, and back after T seconds there; heartbeats count on
the primary only; every switch restarts the clock. Time is in whole seconds.

Each switch depends on the one before, so a plain window cannot express it, and
one agent may own a third of all events, so its timeline is not walked in one
task either. The timeline is cut into chunks. A chunk is a function from the
state at its start to the state at its end, and only 2 * (T + 1) start states differ
(channel, and seconds from the clock to the first event, T or more being alike). Step one
computes that function for all chunks at once, step two chains the few chunk
functions of an agent, step three replays every chunk from its known state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import join_keyed, settled

FAILOVER_SECONDS = 600
CHUNK_SECONDS = 86_400
PRIMARY, SECONDARY = "primary", "secondary"


def per_second(events: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Everything one second of an agent can contribute, as a partial aggregate.

    After the first poll of a second no later event of that second can switch, so
    it is enough to know whether there was a poll, a heartbeat, and a heartbeat
    before the first poll, by time and then ``seq``. Rows per agent are bounded by its seconds.
    """
    second = F.floor(F.unix_millis("ts") / F.lit(1000)).cast("bigint")
    poll, beat = F.col("kind") == "poll", F.col("kind") == "heartbeat"
    # One number that orders by time, then seq: a struct would be aggregated by sorting.
    step = F.lit(str(2 * 10**19)).cast("decimal(20,0)")
    when = (F.unix_micros("ts").cast("decimal(17,0)") * step + F.col("seq").cast("decimal(19,0)")).cast("decimal(38,0)")
    return (
        events.groupBy("agent", second.alias("second"))
        .agg(
            F.min(F.when(poll, when)).alias("_poll"),
            F.min(F.when(beat, when)).alias("_beat"),
        )
        .select(
            "agent", "second",
            F.floor(F.col("second") / F.lit(chunk_seconds)).cast("bigint").alias("chunk"),
            F.col("_poll").isNotNull().alias("poll"),
            F.col("_beat").isNotNull().alias("beat"),
            F.coalesce(F.col("_beat") < F.col("_poll"), F.lit(False)).alias("beat_first"),
        )
    )


class Timeline:
    """Rows in time order, each a second or an event, and how channels switch along them.

    Work goes from switch to switch, each found by search for all asked states at once; rows are
    never walked.
    """

    def __init__(self, second, poll, beat, beat_first, failover: int):
        import numpy as np

        self.second, self.failover, self.n = np.asarray(second, np.int64), failover, len(second)
        self.beat_first = np.append(np.asarray(beat_first, bool), False)
        self.polls, self.beats = np.flatnonzero(poll), np.flatnonzero(beat)
        # The last heartbeat before the poll of each row, of the same row only if it came first.
        beat_at = np.where(np.asarray(beat, bool), np.arange(self.n), -1)
        seen = np.maximum.accumulate(beat_at) if self.n else beat_at
        before = np.where(self.beat_first[:-1], np.arange(self.n), np.append(-1, seen[:-1])[:self.n])
        quiet = (before >= 0) & (self.second - self.second[before] >= failover)
        self.overdue = np.flatnonzero(quiet & np.asarray(poll, bool))

    def _first(self, rows, at):
        """The first of the sorted ``rows`` from ``at`` on, or the number of rows."""
        import numpy as np

        return np.append(rows, self.n)[np.searchsorted(rows, at)]

    def next_switch(self, on_primary, at, clock):
        """Row of the next switch for each state (channel, next row, clock); the number of rows for none."""
        import numpy as np

        due = np.searchsorted(self.second, clock + self.failover)
        poll = self._first(self.polls, np.maximum(at, due))
        beat = self._first(self.beats, at)
        alone = (poll < beat) | ((poll == beat) & ~self.beat_first[poll])
        # From the first heartbeat on, a poll is due by the last heartbeat before it.
        return np.where(~on_primary | alone, poll, self._first(self.overdue, beat + 1))

    def exits(self, on_primary, clock):
        """State after the last row for each state before the first: 2 * clock + channel, or -1 if unchanged."""
        import numpy as np

        on_primary, clock = np.array(on_primary, bool), np.array(clock, np.int64)
        at, touched = np.zeros(len(clock), np.int64), np.zeros(len(clock), bool)
        seconds = np.append(self.second, 0)
        while self.n:
            row = self.next_switch(on_primary, at, clock)
            go = row < self.n
            if not go.any():
                break
            on_primary, at = on_primary ^ go, np.where(go, row + 1, at)
            clock, touched = np.where(go, seconds[row], clock), touched | go
            # A state without a next switch stays where it is.
        last = self.beats[-1] if len(self.beats) else -1
        heard = on_primary & (last >= at)
        clock, touched = np.where(heard, seconds[last], clock), touched | heard
        return np.where(touched, 2 * clock + on_primary, -1)

    def switches(self, on_primary: bool, clock: int):
        """Rows at which a switch happens, from one known state on; at least ``failover`` apart."""
        import numpy as np

        rows, at = [], 0
        state, since = np.array([on_primary]), np.array([clock], np.int64)
        while (row := int(self.next_switch(state, np.array([at]), since)[0])) < self.n:
            rows.append(row)
            state, since, at = ~state, self.second[row:row + 1], row + 1
        return np.array(rows, np.int64)


def _chunk_function(failover: int):
    """Closure for step one: exit state of a chunk for every start state."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("second")
        line = Timeline(*[pdf[c].to_numpy() for c in ("second", "poll", "beat", "beat_first")], failover)
        # Start states by age: how long before the first second the clock was set.
        clock = line.second[0] - np.tile(np.arange(failover + 1), 2)
        exits = line.exits(np.repeat([False, True], failover + 1), clock)
        return pd.DataFrame({"agent": [key[0]], "chunk": [key[1]], "first_second": [line.second[0]],
                             "exits": [exits.tolist()]})

    return run


def _chain(failover: int):
    """Closure for step two: start state of every chunk of one agent."""

    def run(key, pdf):
        pdf = pdf.sort_values("chunk")
        on_primary, clock = bool(pdf["start_primary"].iloc[0]), int(pdf["start_clock"].iloc[0])
        states = []
        for first_second, exits in zip(pdf["first_second"], pdf["exits"]):
            states.append((on_primary, clock))
            age = min(max(first_second - clock, 0), failover)
            code = int(exits[(failover + 1 if on_primary else 0) + age])
            if code >= 0:
                on_primary, clock = bool(code % 2), code // 2
        pdf = pdf[["agent", "chunk"]].copy()
        pdf["on_primary"] = [s[0] for s in states]
        pdf["clock"] = [s[1] for s in states]
        return pdf

    return run


def _replay(failover: int):
    """Closure for step three: channel after each polled second of a chunk."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("second")
        on_primary, clock = bool(pdf["on_primary"].iloc[0]), int(pdf["clock"].iloc[0])
        line = Timeline(*[pdf[c].to_numpy() for c in ("second", "poll", "beat", "beat_first")], failover)
        switched = np.zeros(line.n, bool)
        switched[line.switches(on_primary, clock)] = True
        channel = np.where(np.cumsum(switched) % 2 == 0, on_primary, not on_primary)
        out = pd.DataFrame({"agent": key[0], "second": line.second, "on_primary": channel, "switched": switched})
        return out[pdf["poll"].to_numpy()]

    return run


def picks(events: DataFrame, failover_seconds: int = FAILOVER_SECONDS,
          chunk_seconds: int = CHUNK_SECONDS, initial: DataFrame | None = None) -> DataFrame:
    """Channel per agent and polled second, with ``switched``.

    ``events``: agent, ts, seq, kind (heartbeat / poll). ``initial`` may give
    (agent, on_primary, clock) to continue from; otherwise an agent starts on the
    primary with its clock at its first event.
    """
    seconds = settled(per_second(events, chunk_seconds))
    functions = seconds.groupBy("agent", "chunk").applyInPandas(
        _chunk_function(failover_seconds),
        "agent string, chunk bigint, first_second bigint, exits array<bigint>",
    )
    starts = seconds.groupBy("agent").agg(F.min("second").alias("start_clock")).withColumn(
        "start_primary", F.lit(True)
    )
    if initial is not None:
        starts = starts.join(initial, "agent", "left").select(
            "agent",
            F.coalesce("clock", "start_clock").alias("start_clock"),
            F.coalesce("on_primary", "start_primary").alias("start_primary"),
        )
    entries = functions.join(starts, "agent").groupBy("agent").applyInPandas(
        _chain(failover_seconds),
        "agent string, chunk bigint, on_primary boolean, clock bigint",
    )
    return (
        join_keyed(seconds, entries, ["agent", "chunk"], "inner")
        .groupBy("agent", "chunk")
        .applyInPandas(
            _replay(failover_seconds),
            "agent string, second bigint, on_primary boolean, switched boolean",
        )
        .select(
            "agent", "second",
            F.when(F.col("on_primary"), PRIMARY).otherwise(SECONDARY).alias("channel"),
            "switched",
        )
    )


def poll_channels(events: DataFrame, picked: DataFrame) -> DataFrame:
    """Channel of every single poll: all polls of one second share it."""
    second = F.floor(F.unix_millis("ts") / F.lit(1000)).cast("bigint")
    polls = events.where("kind = 'poll'").withColumn("second", second)
    return polls.join(picked.select("agent", "second", "channel"), ["agent", "second"])


def switches(picked: DataFrame) -> DataFrame:
    """The timeline proper: one row per channel change, at least T apart."""
    return picked.where("switched").select("agent", "second", "channel")

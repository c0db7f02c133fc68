"""Stages with timers and bounded state: retries after a delay, batches by size or time, an address map.

State is kept by slots (hashes of the key), so that a bound on the whole is a bound on each slot and no single key carries it. Time is event time by
default: timers fire as the watermark passes, so a replay gives the same. With clock="ProcessingTime" they follow the machine's clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession, run):
    """Runs a stream with the state store that timers need, and gives what run gives."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def now(values, clock: str) -> int:
    return values.getCurrentProcessingTimeInMs() if clock == "ProcessingTime" else values.getCurrentWatermarkInMs()


class Retries(StatefulProcessor):
    """Holds a failed request until its delay is over; what finds the slot full, or has failed before, has failed for good.

    What waits in a slot is read once a micro-batch, and one timer, of the earliest, sends back all whose time has come.
    """

    def __init__(self, delay_ms: int, most: int, clock: str):
        self.delay_ms, self.most, self.clock = delay_ms, most, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "item string, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = dict(self.held.get())
        before, again, out = len(waiting), False, []
        for frame in rows:
            for item, tries, at in frame.sort_values(["at_ms", "item"])[["item", "n_retries", "at_ms"]].itertuples(index=False):
                known = item in waiting
                if tries > 0 or (not known and len(waiting) >= self.most):
                    out.append((item, "failed", int(at)))
                    continue
                waiting[item] = (now(timerValues, self.clock) if self.clock == "ProcessingTime" else int(at)) + self.delay_ms
                again |= known
        if again:
            self.held.put(list(waiting.items()))
        elif len(waiting) > before:
            self.held.appendList(list(islice(waiting.items(), before, None)))
        if waiting:
            self.handle.registerTimer(min(waiting.values()))
        yield pd.DataFrame(out, columns=["item", "what", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        come = max(now(timerValues, self.clock), expiredTimerInfo.getExpiryTimeInMs())
        held = list(self.held.get())
        left = [h for h in held if h[1] > come]
        if left:
            self.held.put(left)
            self.handle.registerTimer(min(due for _, due in left))
        else:
            self.held.clear()
        ready = sorted((due, item) for item, due in held if due <= come)
        yield pd.DataFrame([(item, "retry", due) for due, item in ready], columns=["item", "what", "at_ms"])


class Batches(StatefulProcessor):
    """Gathers items until there are `most` of them or the first has waited wait_ms."""

    def __init__(self, most: int, wait_ms: int, clock: str):
        self.most, self.wait_ms, self.clock = most, wait_ms, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "batch long, n long, due long")
        self.items = handle.getListState("items", "item string")

    def flush(self, key, batch: int, items: list[str], why: str) -> list[tuple]:
        return [(int(key[0]), batch, item, why) for item in items]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, _, due = self.count.get() if self.count.exists() else (0, 0, 0)
        items, out = [r[0] for r in self.items.get()], []
        for frame in rows:
            for item, at in frame.sort_values(["at_ms", "item"])[["item", "at_ms"]].itertuples(index=False):
                if not items:
                    due = (now(timerValues, self.clock) if self.clock == "ProcessingTime" else int(at)) + self.wait_ms
                    self.handle.registerTimer(due)
                elif self.clock != "ProcessingTime" and at >= due:  # items of one micro-batch may lie further apart than the wait
                    out += self.flush(key, batch, items, "time")
                    batch, items, due = batch + 1, [], int(at) + self.wait_ms
                    self.handle.registerTimer(due)
                items.append(item)
                if len(items) >= self.most:
                    out += self.flush(key, batch, items, "size")
                    batch, items = batch + 1, []
        self.items.put([(i,) for i in items]) if items else self.items.clear()
        self.count.update((batch, len(items), due))
        yield pd.DataFrame(out, columns=["slot", "batch", "item", "why"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch, n, due = self.count.get()
        out = []
        if n and due == expiredTimerInfo.getExpiryTimeInMs():  # else the batch was closed by its size
            out = self.flush(key, batch, [r[0] for r in self.items.get()], "time")
            self.items.clear()
            self.count.update((batch + 1, 0, 0))
        yield pd.DataFrame(out, columns=["slot", "batch", "item", "why"])


class Addresses(StatefulProcessor):
    """The last hashes seen at each address: at most `hashes` an address and `most` addresses a slot, the longest unseen go first, and all after a time."""

    def __init__(self, most: int, hashes: int, keep_ms: int):
        self.most, self.hashes, self.keep_ms = most, hashes, keep_ms

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "addr string", "last long, hashes array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: (v[0], list(v[1])) for k, v in self.seen.iterator()}
        touched, latest = set(), max([v[0] for v in held.values()], default=0)
        for frame in rows:
            for addr, item, at in frame.sort_values(["at_ms", "addr", "item"])[["addr", "item", "at_ms"]].itertuples(index=False):
                own = [h for h in held.get(addr, (0, []))[1] if h != item]
                held[addr] = (int(at), [*own, item][-self.hashes :])
                touched.add(addr)
                latest = max(latest, int(at))
        order = sorted(held, key=lambda a: (held[a][0], a))
        gone = {a for a in order if held[a][0] < latest - self.keep_ms} | set(order[: max(0, len(order) - self.most)])
        for addr in gone:
            self.seen.removeKey((addr,))
        for addr in touched - gone:
            self.seen.updateValue((addr,), held[addr])
        out = [(addr, held[addr][0], len(held[addr][1]), addr not in gone) for addr in sorted(touched | gone)]
        yield pd.DataFrame(out, columns=["addr", "last_ms", "n_hashes", "kept"])


def slotted(items: DataFrame, key: str, slots: int, clock: str, late: str) -> DataFrame:
    rows = items.withColumns({"slot": F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(slots)).cast("int"), "at_ms": F.unix_millis("at")})
    return rows if clock == "ProcessingTime" else rows.withWatermark("at", late)


def timed_retries(failed: DataFrame, delay_ms: int = 30_000, most: int = 1000, slots: int = 8, clock: str = "EventTime", late: str = "1 second") -> DataFrame:
    """item, what (retry or failed), at_ms: failed requests (item, n_retries, at) come back once, a delay after they failed; at most `most` wait in a slot."""
    rows = slotted(failed, "item", slots, clock, late).select("slot", "item", "n_retries", "at", "at_ms")
    return rows.groupBy("slot").transformWithStateInPandas(Retries(delay_ms, most, clock), "item string, what string, at_ms long", "append", clock)


def timed_batches(items: DataFrame, most: int = 1000, wait_ms: int = 1000, slots: int = 8, clock: str = "EventTime", late: str = "1 second") -> DataFrame:
    """slot, batch, item, why (size or time): items (item, at) gathered in batches of a slot, each closed by whichever comes first."""
    rows = slotted(items, "item", slots, clock, late).select("slot", "item", "at", "at_ms")
    return rows.groupBy("slot").transformWithStateInPandas(Batches(most, wait_ms, clock), "slot int, batch long, item string, why string", "append", clock)


def address_map(seen: DataFrame, most: int = 12_500, hashes: int = 200, keep_ms: int = 3_600_000, slots: int = 8) -> DataFrame:
    """addr, last_ms, n_hashes, kept for each address that a micro-batch touched or pushed out. seen: addr, item, at."""
    rows = slotted(seen, "addr", slots, "ProcessingTime", "").select("slot", "addr", "item", "at_ms")
    return rows.groupBy("slot").transformWithStateInPandas(Addresses(most, hashes, keep_ms), "addr string, last_ms long, n_hashes long, kept boolean", "update", "None")

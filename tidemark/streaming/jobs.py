"""Streaming jobs over event streams; each has a batch twin that gives the same rows after all input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERT = "symbol string, ts timestamp, previous double, sentiment double, kind string, severity string"


def _alert(x):
    kind = F.when(x <= -0.3, "drop").when(x >= 0.5, "surge")
    severity = F.when(x <= -0.5, "high").when(x <= -0.3, "medium").when(x >= 0.5, "low")
    return kind, severity


def sentiment_alerts(events: DataFrame) -> DataFrame:
    """Batch: alerts of (symbol, ts, sentiment) with the value before."""
    kind, severity = _alert(F.col("sentiment"))
    before = F.lag("sentiment").over(Window.partitionBy("symbol").orderBy("ts"))
    out = events.select("symbol", "ts", before.alias("previous"), "sentiment", kind.alias("kind"), severity.alias("severity"))
    return out.where("kind IS NOT NULL")


class _Alerts(StatefulProcessor):
    """Keeps the last sentiment of each symbol."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("ts")
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts, x in zip(batch["ts"], batch["sentiment"]):
            if x <= -0.3 or x >= 0.5:
                kind = "drop" if x < 0 else "surge"
                out.append((key[0], ts, before, x, kind, "high" if x <= -0.5 else "medium" if x < 0 else "low"))
            before = float(x)
        self.last.update((before,))
        yield pd.DataFrame(out, columns=["symbol", "ts", "previous", "sentiment", "kind", "severity"])

    def close(self) -> None:
        pass


def sentiment_alert_stream(events: DataFrame) -> DataFrame:
    """Stream: the same alerts, with the last value of a symbol as state."""
    return events.groupBy("symbol").transformWithStateInPandas(_Alerts(), ALERT, "Append", "None")


def volume_spikes(events: DataFrame, ts: str = "ts", window: str = "1 day", baseline: float = 5.0, factor: float = 3.0, late: str = "1 hour", key: str = "symbol") -> DataFrame:
    """Windows with at least baseline x factor rows of a key; batch or stream."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= baseline * factor).select(F.col("w.start").alias("start"), key, "n")


def alerts_of(alerts: DataFrame, watched: DataFrame) -> DataFrame:
    """Alerts (batch or stream) of the symbols on a watch list."""
    return alerts.join(watched.select("symbol").distinct(), "symbol", "left_semi")


CONTROL = {"remove": 0, "add": 1}


def _with_controls(events: DataFrame, controls: DataFrame) -> DataFrame:
    """(symbol, ts, step, sentiment): removals, additions and values in one."""
    step = F.when(F.col("action") == "add", CONTROL["add"]).otherwise(CONTROL["remove"]).alias("step")
    both = controls.where(F.col("action").isin(*CONTROL)).select("symbol", "ts", step, F.lit(None).cast("double").alias("sentiment"))
    return both.unionByName(events.where("sentiment IS NOT NULL").select("symbol", "ts", F.lit(2).alias("step"), F.col("sentiment").cast("double").alias("sentiment")))


def watched_alerts(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Batch: alerts of (symbol, ts, sentiment) while the symbol is on the list, by controls (symbol, ts, action add or remove).

    What happens at one time is taken in the order removals, additions, values (by size). Adding a symbol, also again, forgets
    its value before; a value before the first addition or after a removal is not looked at."""
    order = Window.partitionBy("symbol").orderBy("ts", "step", "sentiment")
    u = _with_controls(events, controls).withColumns({
        "on": F.last(F.when(F.col("step") < 2, F.col("step")), ignorenulls=True).over(order),
        "spell": F.count_if(F.col("step") < 2).over(order),
    })
    before = F.lag("sentiment").over(Window.partitionBy("symbol", "spell").orderBy("ts", "step", "sentiment"))
    kind, severity = _alert(F.col("sentiment"))
    out = u.withColumns({"previous": before, "kind": kind, "severity": severity}).where((F.col("step") == 2) & (F.col("on") == CONTROL["add"]) & F.col("kind").isNotNull())
    return out.select("symbol", "ts", "previous", "sentiment", "kind", "severity")


class _Watch(StatefulProcessor):
    """Whether a symbol is on the list and its value before; rows wait until the watermark has passed them, so that they are taken in
    the order of their time whatever batch they come in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "watched boolean, value double")
        self.waiting = handle.getListState("waiting", "ts timestamp, step int, sentiment double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for part in rows for r in zip(part["ts"], part["step"], part["sentiment"])]
        self.waiting.appendList([(ts.to_pydatetime(), int(step), None if pd.isna(x) else float(x)) for ts, step, x in new])
        for ms in {_ms(ts) for ts, _, _ in new}:
            self.handle.registerTimer(ms)
        yield self._out([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = expiredTimerInfo.getExpiryTimeInMs()
        rows = [(pd.Timestamp(ts), step, x) for ts, step, x in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if _ms(r[0]) <= passed), key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0.0))
        left = [(ts.to_pydatetime(), step, x) for ts, step, x in rows if _ms(ts) > passed]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        watched, before = self.now.get() if self.now.exists() else (False, None)
        out = []
        for ts, step, x in due:
            if step < 2:
                watched, before = step == CONTROL["add"], None
            elif watched:
                if x <= -0.3 or x >= 0.5:
                    out.append((key[0], ts, before, x, "drop" if x < 0 else "surge", "high" if x <= -0.5 else "medium" if x < 0 else "low"))
                before = x
        self.now.update((watched, before))
        yield self._out(out)

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["symbol", "ts", "previous", "sentiment", "kind", "severity"])
        return out.astype({"previous": "float64", "sentiment": "float64"})

    def close(self) -> None:
        pass


def _ms(ts: pd.Timestamp) -> int:
    """Milliseconds, rounded up, so that a timer never comes before its row."""
    stamp = ts.tz_localize("UTC") if ts.tzinfo is None else ts
    return -(-stamp.value // 1_000_000)


def watched_alert_stream(events: DataFrame, controls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream: the alerts of watched_alerts, once the watermark has passed them; rows that come later than that are dropped."""
    both = _with_controls(events, controls).withWatermark("ts", late)
    return both.groupBy("symbol").transformWithStateInPandas(_Watch(), ALERT, "Append", "EventTime")


_FACTS = "user_id {}, n long, risk string, horizon string, verbosity string, language string, expert boolean, charts boolean, tickers array<string>, concerns array<string>, sectors array<string>, owned array<string>"
_STATED = ("risk", "horizon", "verbosity", "language")


class _Profile(StatefulProcessor):
    """A user's counters, what was stated last (with its turn) and first mentions; all of it is independent of the order of rows."""

    def __init__(self, kept: dict[str, int]):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n long, expert boolean, charts boolean")
        self.stated = handle.getMapState("stated", "what string", "turn long, value string")
        self.first = handle.getMapState("first", "what string, name string", "turn long, place int")

    def _learn(self, parts) -> None:
        n, expert, charts = self.counts.get() if self.counts.exists() else (0, False, False)
        for part in parts:
            for row in part.to_dict("records"):
                n, expert, charts = n + 1, bool(expert or row["expert"]), bool(charts or row["charts"])
                for what in _STATED:
                    if row[what] is not None and not (self.stated.containsKey((what,)) and self.stated.getValue((what,))[0] > row["turn"]):
                        self.stated.updateValue((what,), (int(row["turn"]), row[what]))
                for what, names in (*((c, row[c]) for c in self.kept), ("owned", row["tickers"] if row["owns"] else [])):
                    for place, name in enumerate(names):
                        at = (int(row["turn"]), place)
                        if not self.first.containsKey((what, name)) or tuple(self.first.getValue((what, name))) > at:
                            self.first.updateValue((what, name), at)
        self.counts.update((n, expert, charts))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._learn([initialState])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._learn(rows)
        n, expert, charts = self.counts.get()
        stated = {what[0]: value[1] for what, value in self.stated.iterator()}
        seen: dict[str, list] = {}
        for (what, name), (turn, place) in self.first.iterator():
            seen.setdefault(what, []).append((turn, place, name))
        lists = {what: [name for *_, name in sorted(seen.get(what, []))] for what in (*self.kept, "owned")}
        out = {"user_id": key[0], "n": n, **{w: stated.get(w) for w in _STATED}, "expert": expert, "charts": charts, **{w: x[-self.kept[w] :] if w in self.kept else x for w, x in lists.items()}}
        yield pd.DataFrame([out])

    def close(self) -> None:
        pass


def live_profiles(log: DataFrame, aliases: dict[str, str], allowed: list[str], before: DataFrame | None = None, **words) -> DataFrame:
    """Stream: the profile (as build_profiles) of each user with new rows in (user_id, turn, text), in update mode. before: the log up
    to the stream's start, as a table; word lists as for profile_rows."""
    from tidemark.operators.views import KEPT, finish_profiles, profile_rows

    rows = profile_rows(log, aliases, allowed, **words)
    start = None if before is None else profile_rows(before, aliases, allowed, **words).groupBy("user_id")
    schema = _FACTS.format(dict(log.dtypes)["user_id"])
    return finish_profiles(rows.groupBy("user_id").transformWithStateInPandas(_Profile(dict(KEPT)), schema, "Update", "None", start))


def profile_stream(log: DataFrame, kinds: list[str]) -> DataFrame:
    """Running profile of each user from a log (user_id, ts, kind), batch or stream: counters by kind, hours of the day and the
    last time seen; a stream gives changed users (update) or all (complete)."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    return log.groupBy("user_id").agg(F.count("*").alias("n"), *counts, F.sort_array(F.collect_set(F.hour("ts"))).alias("hours"), F.max("ts").alias("last_seen"))


def upsert_batches(path: str, keys: list[str], policy: str = "replace", seq: str = "seq", buckets: int = 64):
    """A foreachBatch function that keeps the table under path: a batch rewrites the buckets of its keys only, and merging it
    again changes nothing."""
    from tidemark.operators.stored import upsert_stored

    def run(batch: DataFrame, number: int) -> None:
        upsert_stored(path, batch, keys, policy, seq=seq, buckets=buckets)

    return run


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key has not come before, within the watermark of a stream (or at all, in a batch)."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)

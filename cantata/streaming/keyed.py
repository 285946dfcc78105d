"""Keyed streams with state of their own: albums that come out when all of them has settled, scrobbles, labelled picks.

These use transformWithState, so a session needs the RocksDB state store (STATE_STORE as
spark.sql.streaming.stateStore.providerClass). Rows of one trigger are taken in order of time within a key. Batch functions
beside the streams give what a stream comes to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The level that gains bring albums to; a scrobble's least length, share of it, and longest time, in seconds.
REFERENCE_LEVEL = -18.0
LEAST_LENGTH, LEAST_SHARE, MOST_HEARD = 30, 2, 240

PENDING, DONE, GONE = "pending", "done", "gone"


def _keyed(rows: DataFrame, key: str, delay: str | None = None) -> DataFrame:
    """rows by key (a null one is ''), with ``ms``, the time as a number: what the state holds has no time zone."""
    rows = rows.withWatermark("at", delay) if delay else rows
    return rows.withColumn(key, F.coalesce(key, F.lit(""))).withColumn("ms", F.unix_millis("at"))


def _album(key, revision: int, members: list[tuple]) -> Row:
    """Level by power, weighted by length; the highest peak. Members are (state, level, peak, seconds)."""
    good = [m for m in members if m[0] == DONE and m[1] is not None]
    weight = math.fsum(m[3] or 1.0 for m in good)
    level = 10 * math.log10(math.fsum((m[3] or 1.0) * 10 ** (m[1] / 10) for m in good) / weight) if good else None
    peak = max((m[2] for m in good if m[2] is not None), default=None)
    return Row(album=key, revision=revision, members=len(members), good=len(good), gain=None if level is None else REFERENCE_LEVEL - level, peak=peak)


class _Albums(StatefulProcessor):
    """members: each one's latest row; progress: revision, and the revision that came out last. Timers: quiet times, and the end."""

    def __init__(self, quiet_ms: int, keep_ms: int):
        self.quiet_ms, self.keep_ms = quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "member string", "state string, level double, peak double, seconds double, ms long")
        self.progress = handle.getValueState("progress", "revision long, shown long, changed long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        revision, shown, changed = self.progress.get() or (0, 0, 0)
        before = revision
        for r in sorted(rows, key=lambda r: (r["ms"], str(r["member"]))):
            known = self.members.getValue((r["member"],)) if self.members.containsKey((r["member"],)) else None
            if known and known[4] > r["ms"]:
                continue  # what is known is later
            if r["state"] == GONE:
                if not known:
                    continue
                self.members.removeKey((r["member"],))
            else:
                new = (r["state"], r["level"], r["peak"], r["seconds"], r["ms"])
                if known and tuple(known)[:4] == new[:4]:
                    continue
                self.members.updateValue((r["member"],), new)
            revision, changed = revision + 1, max(changed, r["ms"])
        if revision > before:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.progress.update((revision, shown, changed))
            self.handle.registerTimer(changed + self.quiet_ms)
            self.handle.registerTimer(changed + self.keep_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.progress.exists():
            return
        revision, shown, changed = self.progress.get()
        members = [tuple(m) for _, m in self.members.iterator()]
        ready = bool(members) and all(m[0] != PENDING for m in members)
        if ready and revision > shown:
            self.progress.update((revision, revision, changed))
            yield _album(key[0], revision, members)
        if expiredTimerInfo.getExpiryTimeInMs() >= changed + self.keep_ms:
            self.members.clear()
            self.progress.clear()

    def close(self) -> None:
        pass


_ALBUM = "album string, revision long, members long, good long, gain double, peak double"


def settled_albums(events: DataFrame, delay: str = "1 minute", quiet_ms: int = 1000, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Events (album, member, state, level, peak, seconds, at) to an album's gain and peak, once all its members have settled.

    An album comes out when nothing has changed for the quiet time and no member is pending; if a member comes late, or one
    changes, it comes out again with a higher revision. Members of state 'gone' leave it. What hasn't changed for the keep
    time is forgotten: a member later than that begins the album anew. An album without a good level has a null gain.
    """
    return _keyed(events, "album", delay).groupBy("album").transformWithState(_Albums(quiet_ms, keep_ms), _ALBUM, "append", "EventTime")


def settled_albums_batch(events: DataFrame) -> DataFrame:
    """What the stream comes to: album, members, good, gain, peak of the albums whose members have all settled."""
    order = Window.partitionBy("album", "member").orderBy(F.desc("at"))
    last = events.withColumn("album", F.coalesce("album", F.lit(""))).withColumn("__r", F.row_number().over(order)).filter(f"__r = 1 AND state <> '{GONE}'")
    good, weight = (F.col("state") == DONE) & F.col("level").isNotNull(), F.coalesce(F.nullif("seconds", F.lit(0.0)), F.lit(1.0))
    sums = last.groupBy("album").agg(
        F.count(F.lit(1)).alias("members"),
        F.count(F.when(good, 1)).alias("good"),
        F.count(F.when(F.col("state") == PENDING, 1)).alias("__left"),
        F.sum(F.when(good, weight * F.pow(F.lit(10.0), F.col("level") / 10))).alias("__power"),
        F.sum(F.when(good, weight)).alias("__weight"),
        F.max(F.when(good, F.col("peak"))).alias("peak"),
    )
    gain = F.lit(REFERENCE_LEVEL) - 10 * F.log10(F.col("__power") / F.col("__weight"))
    return sums.filter("__left = 0").select("album", "members", "good", gain.alias("gain"), "peak")


class _Scrobbles(StatefulProcessor):
    """now: what plays, since when and how long it has been heard. A timer stands where it will have been heard enough."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "instance string, title string, artist string, length double, playing boolean, mark long, heard long, started long, sent boolean")

    def _due(self, s: dict) -> int | None:
        """Milliseconds still to be heard; None if nothing is due."""
        named = (s["title"] or "").strip() and (s["artist"] or "").strip()
        if s["sent"] or not named or s["started"] is None or s["length"] is None or s["length"] <= LEAST_LENGTH:
            return None
        return round(min(s["length"] / LEAST_SHARE, MOST_HEARD) * 1000) - s["heard"]

    def _heard(self, s: dict, until: int) -> None:
        if s["playing"] and until > s["mark"]:
            s["heard"] += until - s["mark"]
        s["mark"] = max(s["mark"], until)

    def _sent(self, listener, s: dict) -> list[Row]:
        if (due := self._due(s)) is None or due > 0:
            return []
        s["sent"] = True
        return [Row(listener=listener, instance=s["instance"], title=s["title"].strip(), artist=s["artist"].strip(), started=s["started"])]

    def _keep(self, s: dict) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.now.update(tuple(s.values()))
        due = self._due(s)
        if s["playing"] and due is not None:
            self.handle.registerTimer(s["mark"] + due)

    def _state(self) -> dict | None:
        found = self.now.get()
        names = ("instance", "title", "artist", "length", "playing", "mark", "heard", "started", "sent")
        return dict(zip(names, found, strict=True)) if found else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s, out = self._state(), []
        for r in sorted(rows, key=lambda r: (r["ms"], str(r["instance"]))):
            at = r["ms"]
            if s:
                if at < s["mark"]:
                    continue  # what is known is later
                self._heard(s, at)
                out += self._sent(key[0], s)
            if not s or s["instance"] != r["instance"]:
                s = {"instance": r["instance"], "title": None, "artist": None, "length": None, "playing": False, "mark": at, "heard": 0, "started": None, "sent": False}
            s |= {"title": r["title"], "artist": r["artist"], "length": r["length"], "playing": bool(r["playing"]), "mark": at}
            if s["playing"] and s["started"] is None:
                s["started"] = at
            out += self._sent(key[0], s)
        self._keep(s) if s else None
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._state()
        self._heard(s, expiredTimerInfo.getExpiryTimeInMs())
        out = self._sent(key[0], s)
        self._keep(s)
        return iter(out)

    def close(self) -> None:
        pass


def scrobbled(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Player events (listener, instance, title, artist, length in seconds, playing, at) to one row for each instance heard enough.

    Time counts only while it plays. A row comes out as soon as half the length, or four minutes, has been heard: at the next
    event, or when the watermark passes that moment. Another instance begins anew; titles of 30 seconds or less and those
    without a name or an artist don't count.
    """
    out = _keyed(events, "listener", delay).groupBy("listener").transformWithState(_Scrobbles(), "listener string, instance string, title string, artist string, started long", "append", "EventTime")
    return out.withColumn("started", F.timestamp_millis("started"))


class _Waiting(StatefulProcessor):
    """waiting: of each item the number and time of the pick that waits; made: how many picks there were."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "item string", "number long, ms long")
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made = (self.made.get() or (0,))[0]
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        before, out = dict(waiting), []
        for r in sorted(rows, key=lambda r: (r["ms"], r["reward"] is not None, r["item"])):
            picked = waiting.pop(r["item"], None)
            if r["reward"] is None:
                made += 1
                waiting[r["item"]] = (made, r["ms"])
                if len(waiting) > self.keep:
                    del waiting[min(waiting, key=lambda i: waiting[i][0])]
            elif picked:
                out.append(Row(listener=key[0], item=r["item"], picked_at=picked[1], label_at=r["ms"], reward=r["reward"]))
        for item in before.keys() - waiting.keys():
            self.waiting.removeKey((item,))
        for item, value in waiting.items():
            if before.get(item) != value:
                self.waiting.updateValue((item,), value)
        self.made.update((made,))
        return iter(out)

    def close(self) -> None:
        pass


def labelled_picks(rows: DataFrame, keep: int = 200) -> DataFrame:
    """Picks (reward is null) and feedback of (listener, item, at, reward) to each pick's first feedback.

    The state of a listener is its waiting picks, ``keep`` at most: the oldest goes first, one that got its feedback at once.
    operators.mixing.first_feedback is the same over a table.
    """
    named = _keyed(rows.filter("item IS NOT NULL"), "listener")
    out = named.groupBy("listener").transformWithState(_Waiting(keep), "listener string, item string, picked_at long, label_at long, reward double", "append", "None")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("picked_at", "label_at")})

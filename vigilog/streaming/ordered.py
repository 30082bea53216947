"""Stateful operators that see the rows of a key in event-time order.

Rows wait in list state until the watermark has passed them: then none before them can arrive any
more, and they are folded in order of time, exactly as in a batch. A timer at the earliest waiting
row wakes them; what neither a window nor a lockout can reach back to is dropped.

Keys are dealt to buckets. A bucket's rows are Arrow tables, folded for all of its keys at a time:
a call, a read and a write for each key took milliseconds, many times the work itself.
"""

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NEVER = -(2**62)
BUCKETS = 256  # of keys; a stream that goes on from its checkpoint must keep to it
PART_ROWS = 50_000  # of a state's table in one value


def due(us: int) -> int:
    """The watermark (milliseconds) that has passed an instant."""
    return -(-us // 1000)


def codes_of(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Equal values of the columns as equal numbers; a null is a value."""
    joined = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type).combine_chunks()
    codes = joined.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


class BucketProcessor(StatefulProcessor):
    """State of a bucket: ``tables`` names them and the types of their columns."""

    tables: dict[str, dict[str, pa.DataType]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.woken = handle, set()
        self.states = {name: handle.getListState(name, "part binary") for name in self.tables}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = tuple(key), timerValues.getCurrentWatermarkInMs()
        if now not in self.woken:  # several timers of a bucket may be due
            self.woken.add(now)
            yield from self.passed_by(now[1] * 1000)

    def passed_by(self, passed: int):
        """Folds what the watermark, in microseconds, has passed."""
        raise NotImplementedError

    def table_of(self, name: str, frames) -> pa.Table:
        kinds = self.tables[name]
        return pa.concat_tables([pa.table({c: pa.array(
            part[c].astype("int64") if kind == pa.int64() else part[c], kind, from_pandas=True) for c, kind in kinds.items()}) for part in frames])

    def held(self, name: str) -> pa.Table:
        kinds = pa.schema(self.tables[name].items())
        parts = [pa.ipc.open_stream(part).read_all() for part, in self.states[name].get()] if self.states[name].exists() else []
        return pa.concat_tables([kinds.empty_table(), *parts])

    def _parts(self, table: pa.Table) -> list[tuple]:
        parts = []
        for at in range(0, table.num_rows, PART_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table.slice(at, PART_ROWS).combine_chunks())
            parts.append((sink.getvalue().to_pybytes(),))
        return parts

    def append(self, name: str, table: pa.Table) -> None:
        self.states[name].appendList(self._parts(table))

    def put(self, name: str, table: pa.Table) -> None:
        if table.num_rows:
            self.states[name].put(self._parts(table))
        else:
            self.states[name].clear()

    def close(self) -> None:
        pass


# -- sequences -------------------------------------------------------------------------------

FIRE_SCHEMA = ("chain_id string, source_key string, us bigint, event_id string, first_us bigint, "
               "step_events array<string>")


class ChainFold:
    """The plain version of ``fold_chains``, which tests hold to it: what one source has to remember of its
    past is of each chain the latest start of each of its prefixes, the row number, and the newest rows (for
    the evidence of a fire).

    ``spec`` is (chain id, window in microseconds, number of steps); a row's mask of a chain has a
    bit for each step that it is. A row costs the same however long the windows are.
    """

    def __init__(self, spec: list[tuple], cap: int, lock: int, past: tuple | None = None):
        self.spec, self.cap, self.lock = spec, cap, lock
        self.widest = max(width for _, width, _ in spec)
        if past is None:
            empty = [[NEVER] * steps for _, _, steps in spec], [[0] * steps for _, _, steps in spec]
            past = (0, [], [], [], *empty, [NEVER] * len(spec))
        self.row, times, ids, masks, starts, start_rows, fired = past
        self.ring = deque(zip(times, ids, masks))
        self.starts, self.start_rows = [list(x) for x in starts], [list(x) for x in start_rows]
        self.fired = list(fired)

    def past(self) -> tuple:
        columns = [list(x) for x in zip(*self.ring)] or [[], [], []]
        return (self.row, *columns, self.starts, self.start_rows, self.fired)

    def newest(self) -> int:
        return self.ring[-1][0]

    def add(self, us: int, event_id: str, masks: list[int]):
        """(chain id, us, event id, first_us, step events) of the chains that fire at this row."""
        self.row += 1
        self.ring.append((us, event_id, masks))
        while len(self.ring) > self.cap or self.ring[0][0] < us - self.widest:
            self.ring.popleft()
        for c, (chain_id, width, steps) in enumerate(self.spec):
            mask, starts, rows = masks[c], self.starts[c], self.start_rows[c]
            if mask:
                for s in range(steps - 1, 0, -1):  # from the last one: a row is one step only
                    if mask >> s & 1 and rows[s - 1] > rows[s]:
                        starts[s], rows[s] = starts[s - 1], rows[s - 1]
                if mask & 1:
                    starts[0], rows[0] = us, self.row
            if (rows[-1] and starts[-1] >= us - width and self.row - rows[-1] < self.cap
                    and us - self.fired[c] >= self.lock):
                self.fired[c] = us
                yield self._fire(c, us, event_id)

    def _fire(self, c: int, us: int, event_id: str) -> tuple:
        chain_id, width, steps = self.spec[c]
        window = [r for r in self.ring if r[0] >= us - width]
        taken: list[str] = []
        for _, own, masks in window:
            if len(taken) < steps and masks[c] >> len(taken) & 1:
                taken.append(own)
        return chain_id, us, event_id, window[0][0], taken


def fold_chains(spec: list[tuple], cap: int, lock: int, past: pa.Table, fresh: pa.Table, fired: pa.Table
                ) -> tuple[pa.Table, pa.Table, pd.DataFrame]:
    """What ``ChainFold`` finds row by row, for all sources of a table at a time: the rows and the fires
    to remember, and the fires of ``fresh``.

    ``past`` are rows that were folded before: of each source the newest ``cap`` at most, in order.
    A prefix whose start is none of them can fire no more, so no other state is needed.
    """
    rows = pa.concat_tables([past, fresh])
    sources = pa.chunked_array([*rows["source_key"].chunks, *fired["source_key"].chunks], pa.string()).combine_chunks().dictionary_encode("encode")
    codes, names = sources.indices.to_numpy(zero_copy_only=False), sources.dictionary
    source, fired_source = codes[:rows.num_rows], codes[rows.num_rows:]
    new = np.arange(rows.num_rows) >= past.num_rows
    order = pc.sort_indices(pa.table({"source": source, "new": new, "us": rows["us"], "event_id": rows["event_id"]}), [
        (c, "ascending") for c in ("source", "new", "us", "event_id")]).to_numpy()
    rows, source, new = rows.take(order), source[order], new[order]
    us, places = rows["us"].to_numpy(), np.arange(rows.num_rows)
    first = np.append(True, source[1:] != source[:-1])[:rows.num_rows]
    start = np.maximum.accumulate(np.where(first, places, 0))
    times, at = np.unique(us, return_inverse=True)
    moments = source * (len(times) + 1) + at  # ascending: sources were sorted by their codes
    ids = rows["event_id"].to_numpy()

    found, kept = [], []
    for c, (chain_id, width, steps) in enumerate(spec):
        mask = rows[f"m{c}"].to_numpy()
        is_step = [mask >> s & 1 != 0 for s in range(steps)]
        latest = np.maximum.accumulate(np.where(is_step[0], places, -1))  # the row where the latest prefix starts
        for s in range(1, steps):  # a row is one step only: what was before it counts
            latest = np.maximum.accumulate(np.where(is_step[s], np.append(-1, latest[:-1]), -1))
        holds = np.flatnonzero(new & (latest >= start) & (us[latest] >= us - width) & (places - latest < cap))
        last = np.full(len(names), NEVER)
        own = fired["chain"].to_numpy() == c
        np.maximum.at(last, fired_source[own], fired["us"].to_numpy()[own])
        last, picked = last.tolist(), []
        for row, key, now in zip(holds.tolist(), source[holds].tolist(), us[holds].tolist()):
            if now - last[key] >= lock:
                last[key] = now
                picked.append(row)
        kept.append(pa.table({"source_key": names, "chain": np.full(len(names), c), "us": np.array(last, np.int64)}).filter(
            pa.array(np.array(last, np.int64) > NEVER)))
        picked = np.array(picked, np.int64)
        low = np.searchsorted(moments, source[picked] * (len(times) + 1) + np.searchsorted(times, us[picked] - width))
        low = np.maximum(np.maximum(low, picked - cap + 1), start[picked])
        taken, place = [], low
        for s in range(steps):
            following = np.append(np.minimum.accumulate(np.where(is_step[s], places, rows.num_rows)[::-1])[::-1], rows.num_rows)
            place = following[place]
            taken.append(ids[place])
            place = place + 1
        found.append(pd.DataFrame({
            "chain_id": chain_id, "source_key": names.take(pa.array(source[picked])).to_numpy(zero_copy_only=False), "us": us[picked],
            "event_id": ids[picked], "first_us": us[low], "step_events": list(map(list, zip(*taken)))}))
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, rows.num_rows))
    newest = np.repeat(starts + sizes, sizes) - places <= cap
    return rows.filter(pa.array(newest)), pa.concat_tables(kept), pd.concat(found, ignore_index=True)


class SequenceProcessor(BucketProcessor):
    """Fires of chains per source. State lives until a window or a lockout reaches back no more."""

    def __init__(self, spec: list[tuple], cap: int, lock: int):
        self.spec, self.cap, self.lock = spec, cap, lock
        self.widest = max(width for _, width, _ in spec)
        self.waiting_columns = {"source_key": pa.string(), "us": pa.int64(), "event_id": pa.string(),
                                **{f"m{c}": pa.int64() for c in range(len(spec))}}
        self.tables = {"waiting": self.waiting_columns, "past": self.waiting_columns,
                       "fired": {"source_key": pa.string(), "chain": pa.int64(), "us": pa.int64()}}

    def handleInputRows(self, key, rows, timerValues):
        fresh = self.table_of("waiting", rows)
        self.append("waiting", fresh)
        self.handle.registerTimer(due(pc.min(fresh["us"]).as_py()))
        return iter(())

    def passed_by(self, passed: int):
        waiting = self.held("waiting")
        ready = pc.less_equal(waiting["us"], passed)
        rest = waiting.filter(pc.invert(ready))
        past, fired, fires = fold_chains(self.spec, self.cap, self.lock, self.held("past"), waiting.filter(ready), self.held("fired"))
        past = past.filter(pc.greater(past["us"], passed - self.widest))
        fired = fired.filter(pc.greater(fired["us"], passed - self.lock))
        self.put("past", past)
        self.put("fired", fired)
        if rest.num_rows < waiting.num_rows:
            self.put("waiting", rest)
        ends = [pc.min(rest["us"]).as_py()] if rest.num_rows else []
        for table, reach in ((past, self.widest), (fired, self.lock)):
            if table.num_rows:
                ends.append(pc.max(table["us"]).as_py() + reach)
        if ends:
            self.handle.registerTimer(due(min(ends)))
        if len(fires):
            yield fires


# -- alerts ----------------------------------------------------------------------------------

ALERT_SCHEMA = "status string, hit_count bigint, first_us bigint, last_us bigint, row string"


class AlertProcessor(BucketProcessor):
    """Merged hits per fingerprint: a row at the first hit of an alert, another when it has closed.

    Hits that wait are kept as one row per micro-batch and slot of one gap length (two hits in one slot
    are less than a gap apart), and as one per slot once the watermark has passed any of them.
    """

    def __init__(self, gap: int):
        self.gap = gap
        self.tables = {
            "slots": {"fingerprint": pa.string(), "slot": pa.int64(), "n": pa.int64(), "lo": pa.int64(), "hi": pa.int64(),
                      "event_id": pa.string(), "row": pa.string()},
            "open": {"fingerprint": pa.string(), "hit_count": pa.int64(), "first_us": pa.int64(), "last_us": pa.int64(), "row": pa.string()}}

    def handleInputRows(self, key, rows, timerValues):
        hits = (part.assign(slot=part["us"].astype("int64") // self.gap, n=1, lo=part["us"], hi=part["us"]) for part in rows)
        fresh = merged_slots(self.table_of("slots", hits))
        self.append("slots", fresh)
        self.handle.registerTimer(due((pc.min(fresh["slot"]).as_py() + 1) * self.gap))
        return iter(())

    def passed_by(self, passed: int):
        held = self.held("slots")
        slots = merged_slots(held)
        is_ready = (slots["slot"].to_numpy() + 1) * self.gap <= passed
        ready, rest = slots.filter(pa.array(is_ready)), slots.filter(pa.array(~is_ready))
        first, closed, now, ends = fold_slots(self.held("open"), ready, rest, self.gap, passed)
        if ready.num_rows or rest.num_rows < held.num_rows:
            self.put("slots", rest)
        if ready.num_rows or closed.num_rows:
            self.put("open", now)
        if rest.num_rows:
            ends = [*ends, (pc.min(rest["slot"]).as_py() + 1) * self.gap]
        if len(ends):
            self.handle.registerTimer(due(max(min(ends), passed + 1)))
        for status, rows in (("first", first), ("closed", closed)):
            if rows.num_rows:
                yield rows.drop_columns("fingerprint").to_pandas().assign(status=status)[[c.split()[0] for c in ALERT_SCHEMA.split(", ")]]


def merged_slots(hits: pa.Table) -> pa.Table:
    """One row per fingerprint and slot, sorted by both; event and row are those of the first hit."""
    order = pc.sort_indices(hits, [(c, "ascending") for c in ("fingerprint", "slot", "lo", "event_id")])
    hits = hits.take(order)
    if not hits.num_rows:
        return hits
    prints, slots = codes_of(hits["fingerprint"])[0], hits["slot"].to_numpy()
    starts = np.flatnonzero(np.append(True, (prints[1:] != prints[:-1]) | (slots[1:] != slots[:-1])))
    own = hits.take(starts)
    for name, values in (("n", np.add.reduceat(hits["n"].to_numpy(), starts)), ("hi", np.maximum.reduceat(hits["hi"].to_numpy(), starts))):
        own = own.set_column(own.column_names.index(name), name, pa.array(values))
    return own


def fold_slots(now: pa.Table, ready: pa.Table, rest: pa.Table, gap: int, passed: int) -> tuple[pa.Table, pa.Table, pa.Table, list[int]]:
    """Open alerts and the slots that the watermark has passed: first hits, closed alerts, those still open,
    and the instants at which some of these close if nothing else comes."""
    names = now.column_names
    slots = ready.select(["fingerprint", "n", "lo", "hi", "row"]).rename_columns(names)
    rows = pa.concat_tables([now, slots])
    if not rows.num_rows:
        return rows, rows, rows, []
    every, codes = codes_of(rows["fingerprint"], rest["fingerprint"])
    order = np.lexsort((np.arange(rows.num_rows), every))  # slots are in order, open alerts before them
    rows, prints, is_open = rows.take(order), every[order], order < now.num_rows
    n, lo, hi = (rows[c].to_numpy() for c in names[1:4])
    other = np.append(True, prints[1:] != prints[:-1])
    starts = np.flatnonzero(other | np.append(True, lo[1:] - hi[:-1] >= gap))
    ends = np.append(starts[1:], rows.num_rows) - 1
    alerts = pa.table({"fingerprint": rows["fingerprint"].take(starts), "hit_count": np.add.reduceat(n, starts), "first_us": lo[starts],
                       "last_us": hi[ends], "row": rows["row"].take(starts)}, schema=rows.schema)
    following = np.full(max(every.max(), codes.max(initial=0)) + 1, -NEVER)  # the first hit that waits
    np.minimum.at(following, codes, rest["lo"].to_numpy())
    last, owner = hi[ends], prints[starts]
    is_last = np.append(owner[1:] != owner[:-1], True)
    goes_on = following[owner] - last < gap
    done = ~is_last | (last + gap <= passed) & ~goes_on
    return (rows.take(starts[~is_open[starts]]), alerts.filter(pa.array(done)), alerts.filter(pa.array(~done)),
            (last[~done & ~goes_on] + gap).tolist())

"""Decisions that depend on those before them: folds over ordered groups.

Each fold runs in ``applyInPandas`` on a group that is bounded by its meaning: one
file group, one reader, one object, one round of at most a few thousand candidates.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def cut_points(inode: list[int], extent: list[int], size: list[int], target: int, slack: int) -> list[int]:
    """End positions of batches over extents in file order.

    A batch takes what fits the target.  If the next extent continues its file, the cut goes back to the
    last break between files or holes within ``slack`` bytes; failing that, a run
    that fits a batch of its own is put off whole, and a longer one is cut where it is.
    """
    n = len(size)
    total = [0]
    for s in size:
        total.append(total[-1] + s)
    breaks = [k for k in range(1, n) if not (inode[k] == inode[k - 1] and extent[k] == extent[k - 1] + 1)] + [n]
    ends: list[int] = []
    start = 0
    while start < n:
        full = start + 1
        while full < n and total[full + 1] - total[start] <= target:
            full += 1
        if full == n:
            ends.append(n)
            break
        k = bisect_left(breaks, full + 1) - 1
        last = breaks[k] if k >= 0 and breaks[k] > start else None
        if last is not None and total[full] - total[last] <= slack:
            cut = last
        else:
            run_start = breaks[k] if k >= 0 else 0
            run_end = breaks[k + 1]
            cut = run_start if run_start > start and total[run_end] - total[run_start] <= target else full
        ends.append(cut)
        start = cut
    return ends


def batches(extents: DataFrame, target: int, slack: int, sliver: int = 0, group_bytes: int = 1 << 36) -> DataFrame:
    """Extents with the batch that repacking writes them in; files are dealt to groups, each cut in file order.

    There are as many groups as ``group_bytes`` of extents ask for; a task holds the extents of one.
    sliver: a last batch of fewer bytes joins the one before it.
    """

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["inode", "extent"], ignore_index=True)
        ends = cut_points(rows["inode"].tolist(), rows["extent"].tolist(), rows["byte_len"].tolist(), target, slack)
        if len(ends) > 1 and rows["byte_len"].iloc[ends[-2] :].sum() < sliver:
            del ends[-2]
        rows["batch"] = np.searchsorted(ends, np.arange(len(rows)), side="right")
        return rows[["file_group", "inode", "extent", "byte_len", "batch"]]

    groups = -(-(extents.agg(F.sum("byte_len")).first()[0] or 1) // group_bytes)
    rows = extents.select(F.pmod("inode", F.lit(groups)).alias("file_group"), "inode", "extent", "byte_len")
    return rows.groupBy("file_group").applyInPandas(cut, "file_group long, inode long, extent long, byte_len long, batch long")


def read_ahead_plan(offset: list[int], length: list[int], window: int, least: int = 2) -> list[tuple[int, int | None, int | None]]:
    """Per read: length of the sequential run, and the range to fetch ahead of it, if any."""
    out = []
    end = fetched = 0
    run = 0
    for at, n in zip(offset, length, strict=True):
        stop = at + n
        run = run + 1 if at == end else 1
        if run < least or at != end:
            fetched = stop
            out.append((run, None, None))
        elif fetched - stop >= window // 2:
            out.append((run, None, None))
        else:
            out.append((run, max(fetched, stop), stop + window))
            fetched = stop + window
        end = stop
    return out


def read_ahead(reads: DataFrame, window: int) -> DataFrame:
    """Read-ahead decisions for every file, in event order."""

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id", ignore_index=True)
        found = read_ahead_plan(rows["offset"].tolist(), rows["length"].tolist(), window)
        rows[["run", "fetch_start", "fetch_end"]] = pd.DataFrame(found, columns=["run", "fetch_start", "fetch_end"]).astype("Int64")
        return rows[["event_id", "inode", "run", "fetch_start", "fetch_end"]]

    at = reads.select("event_id", "inode", "offset", "length")
    return at.groupBy("inode").applyInPandas(plan, "event_id long, inode long, run long, fetch_start long, fetch_end long")


@dataclass
class Stream:
    start: int
    end: int
    window: int
    frontier: int  # up to here all bytes from the stream's reads on are fetched or on their way


Span = tuple[int, int] | None


class StreamTracker:
    """Sequential streams of reads of one object, and what is fetched for them.

    A read continues the stream whose end it is nearest to (at or after its start, within
    ``stride``), which doubles that stream's window; a read a little behind a stream's head changes
    nothing; any other starts a stream in a free place or in that of the smallest window.

    A read that starts a stream, or that its stream's frontier does not cover, fetches its window at once.  A
    stream that goes on keeps whole windows on their way, from its frontier to ``depth`` windows past the read.
    Ranges are not cut at the object's end, which reads do not tell.
    """

    def __init__(self, streams: int = 4, low: int = 128 << 10, high: int = 8 << 20, stride: int = 1 << 20, slack: int = 8, depth: int = 4):
        self.limit, self.low, self.high, self.stride, self.slack, self.depth = streams, low, high, stride, slack, depth
        self.heads: list[Stream] = []

    def read(self, offset: int, length: int) -> tuple[str, int, Span, Span]:
        """The read's effect, its window, the range fetched for it and the range fetched ahead."""
        gaps = [(max(0, offset - s.end), k) for k, s in enumerate(self.heads) if offset >= s.start and max(0, offset - s.end) <= self.stride]
        if not gaps and length and any(0 < s.start - offset <= self.slack * length for s in self.heads):
            return "behind", self.low, None, None
        if gaps:
            own, effect = self.heads[min(gaps)[1]], "continue"
            own.start, own.end, own.window = offset, offset + length, min(own.window * 2, self.high)
        else:
            own, effect = self.begin(offset, length), "start"
        ahead = self.ahead(own)
        if ahead:
            self.note(offset, ahead[1])
        now = None
        if own.end > own.frontier or effect == "start":
            now = (offset, offset + max(length, own.window))
            self.note(*now)
        return effect, own.window, now, ahead

    def begin(self, offset: int, length: int) -> Stream:
        fresh = Stream(offset, offset + length, self.low, offset)
        if len(self.heads) < self.limit:
            self.heads.append(fresh)
        else:
            self.heads[min(range(self.limit), key=lambda k: (self.heads[k].window, k))] = fresh
        return fresh

    def ahead(self, own: Stream) -> Span:
        """Whole windows from the frontier on, as many as reach ``depth`` windows past the read."""
        short = own.start + self.depth * own.window - own.frontier
        if own.window <= self.low or own.frontier <= own.start or short <= 0:
            return None
        return own.frontier, own.frontier + min(self.depth, -(-short // own.window)) * own.window

    def note(self, offset: int, stop: int) -> None:
        """Move the frontier of every stream that a fetch goes on without a gap."""
        for s in self.heads:
            if stop > s.frontier and offset <= max(s.frontier, s.end):
                s.frontier = stop


def stream_tracker(reads: DataFrame) -> DataFrame:
    """What each read of an object did to its streams, the window it got, and the ranges fetched for and ahead of it."""
    names = ["effect", "fetch_window", "fetch_start", "fetch_end", "ahead_start", "ahead_end"]

    def track(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id", ignore_index=True)
        own = StreamTracker()
        found = [own.read(o, n) for o, n in zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True)]
        flat = [(effect, window, *(now or (None, None)), *(ahead or (None, None))) for effect, window, now, ahead in found]
        rows[names] = pd.DataFrame(flat, columns=names).astype({k: "Int64" for k in names[1:]})
        return rows[["event_id", "path", *names]]

    schema = "event_id long, path string, effect string, fetch_window long, fetch_start long, fetch_end long, ahead_start long, ahead_end long"
    return reads.select("event_id", "path", "offset", "length").groupBy("path").applyInPandas(track, schema)


def walk_order(pairs: list[tuple]) -> list[list]:
    """Members of each chain of pairs in breadth-first order from the smallest, neighbours in order."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, seen = [], set()
    for start in sorted(near):
        if start in seen:
            continue
        chain = [start]
        seen.add(start)
        for node in chain:
            fresh = sorted(near[node] - seen)
            chain += fresh
            seen.update(fresh)
        found.append(chain)
    return found


def breadth_first(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chain, place, node): members of each chain in breadth-first order from the smallest, neighbours by number."""
    edges = pairs.join(members.select(c("node").alias("a"), "chain"), "a").select("chain", "a", "b")

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        (out,) = walk_order(list(zip(rows["a"].tolist(), rows["b"].tolist(), strict=True)))
        return pd.DataFrame({"chain": int(rows["chain"].iloc[0]), "place": range(len(out)), "node": out})

    return edges.groupBy("chain").applyInPandas(order, "chain long, place long, node long")


class Round:
    """One compaction round: what it takes, within slots and live bytes, part of both reserved for hot segments."""

    def __init__(self, live_budget: int, slots: int = 64, reserved_slots: int = 32):
        self.live_budget, self.slots, self.reserved_slots = live_budget, slots, reserved_slots
        self.reserve = live_budget // 2
        self.taken: dict[object, str] = {}
        self.live = self.held_live = self.held_slots = 0
        self.saturated = False
        self.deferred = self.warm = self.unpackable = 0

    def _take(self, segment, live: int, why: str, reserved: bool) -> bool:
        if segment in self.taken:
            return False
        self.taken[segment] = why
        self.live += live
        if reserved:
            self.held_live += live
            self.held_slots += 1
        return True

    def _fits(self, live: int, n: int, fresh: bool = False) -> bool:
        slots, held = (0, 0) if fresh else (self.held_slots, self.held_live)
        return slots + n <= self.reserved_slots and held + live <= self.reserve

    def _room(self, sizes: list[int]) -> int:
        """How many members from the first on the reserve has room for."""
        slots, live, n = self.reserved_slots - self.held_slots, self.reserve - self.held_live, 0
        for size in sizes[: max(0, slots)]:
            live -= size
            if live < 0:
                break
            n += 1
        return n

    def chain(self, members: list[tuple], edges: list[tuple[int, int]], cold: bool) -> None:
        """Hot segments that should be written together: all, a prefix of two or more, or the cheapest pair that reads cross.

        edges: places in members of the pairs.  A chain that an empty reserve would hold whole waits for one.
        """
        sizes = [live for _, live in members]
        room = self._room(sizes)
        wait = room < len(sizes) and self._fits(sum(sizes), len(sizes), fresh=True)
        if not cold or wait:
            self.warm += not cold
            self.deferred += cold
            return
        group = members[:room]
        if room < min(2, len(members)):
            pair = min(((sizes[a] + sizes[b], a, b) for a, b in edges if a != b), default=None)
            if pair is None or pair[0] > self.reserve:
                self.unpackable += 1
                return
            if not self._fits(pair[0], 2):
                self.deferred += 1
                return
            group = [members[pair[1]], members[pair[2]]]
        for segment, live in group:
            self._take(segment, live, "chain", reserved=True)

    def candidates(self, ranked: list[tuple], nominated: set) -> None:
        """Fragmented segments in rank order: nominated ones on the reserve first, then any while the budget lasts."""
        rest = []
        for segment, live in ranked:
            if segment in self.taken:
                continue
            if segment in nominated and self._fits(live, 1):
                self._take(segment, live, "nominated", reserved=True)
            else:
                rest.append((segment, live))
        for segment, live in rest:
            if len(self.taken) >= self.slots or self.live >= self.live_budget:
                self.saturated = True
                return
            self._take(segment, live, "rank", reserved=False)

    def tail(self, ranked: list[tuple]) -> None:
        """Slightly dead segments, most dead first, only while they fit."""
        for segment, live in ranked:
            if len(self.taken) >= self.slots or self.live + live > self.live_budget:
                self.saturated = True
                return
            self._take(segment, live, "tail", reserved=False)


def select_round(rows: DataFrame, pairs: DataFrame, live_budget: int, buffer: int = 8192) -> DataFrame:
    """Segments that one round takes, with the reason.

    rows: epoch, counter, live, permille, class, nominated, cold, of all segments with live bytes.
    pairs: epoch_a, counter_a, epoch_b, counter_b, heat: pairs that reads cross.  Of pairs (the hottest), candidates
    and tail the ``buffer`` best each are looked at, by one task; pairs with a segment that is not in rows are none.
    """
    order = ["permille", "epoch", "counter"]
    named = {s: rows.select(c("epoch").alias(f"epoch_{s}"), c("counter").alias(f"counter_{s}")) for s in "ab"}
    seams = pairs
    for s in "ab":
        seams = seams.join(named[s], [f"epoch_{s}", f"counter_{s}"], "left_semi")
    seams = seams.orderBy(F.desc("heat"), "epoch_a", "counter_a", "epoch_b", "counter_b").limit(buffer).select("epoch_a", "counter_a", "epoch_b", "counter_b")
    ends = seams.select(c("epoch_a").alias("epoch"), c("counter_a").alias("counter")).unionAll(seams.select("epoch_b", "counter_b")).distinct()
    short = rows.join(F.broadcast(ends), ["epoch", "counter"], "left_semi").unionByName(rows.where("class = 'candidate'").orderBy(F.desc("nominated"), *order).limit(buffer))
    short = short.unionByName(rows.where("class = 'tail' and cold").orderBy(*order).limit(buffer)).dropDuplicates(["epoch", "counter"])

    def choose(part: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, ignore_index=True)
        key = list(zip(part["epoch"].tolist(), part["counter"].tolist(), strict=True))
        live, cold = dict(zip(key, part["live"].tolist(), strict=True)), dict(zip(key, part["cold"].tolist(), strict=True))
        own = Round(live_budget)
        edges = [((a, b), (x, y)) for a, b, x, y in crossed.itertuples(index=False)]
        for chain in walk_order(edges):
            place = {s: k for k, s in enumerate(chain)}
            inside = sorted({tuple(sorted((place[a], place[b]))) for a, b in edges if a in place})
            own.chain([(s, live[s]) for s in chain], inside, all(cold[s] for s in chain))
        ranked = [(s, live[s]) for s, k in zip(key, part["class"], strict=True) if k == "candidate"]
        own.candidates(ranked, {s for s, n in zip(key, part["nominated"], strict=True) if n})
        own.tail([(s, live[s]) for s, k in zip(key, part["class"], strict=True) if k == "tail" and cold[s]])
        return pd.DataFrame([(*k, why, i) for i, (k, why) in enumerate(own.taken.items())], columns=["epoch", "counter", "reason", "place"])

    one = F.lit(0).alias("round")
    return short.groupBy(one).cogroup(seams.groupBy(one)).applyInPandas(choose, "epoch long, counter long, reason string, place long")


def gate(totals: DataFrame, least_freed: int, seal: int) -> DataFrame:
    """Whether a round is worth its writes: enough freed, or enough live data, or a chain."""
    go = (c("freed") >= least_freed) | (c("live") * 4 >= seal) | (c("chains") > 0)
    return totals.withColumn("go", go)


def next_pass(completed: Column, saturated: Column, idle: Column, dead: Column, deferred: Column, over: Column, base: int = 60, drain: int = 15, fast: int = 5, busy_dead: int = 20) -> tuple[Column, Column, Column]:
    """Interval, tier and reason of the next collection pass."""
    much, seams = dead >= busy_dead, deferred > 0
    hurry = much | seams
    parts = F.concat_ws(" + ", F.when(much, F.concat(dead.cast("string"), F.lit("% dead"))), F.when(seams, F.concat(deferred.cast("string"), F.lit(" seams deferred"))))
    tier = F.when(~completed | ~saturated, "base").when(idle, "fast").when(hurry & (F.lit(drain) < F.lit(base)), "drain").otherwise("base")
    why = (
        F.when(~completed, "pass not completed").when(~saturated, "backlog drained").when(idle, "saturated backlog, store idle").when(hurry, F.concat(parts, F.lit(", store active" if drain < base else ", store active, drain tier disabled")))
        .otherwise(F.concat(dead.cast("string"), F.lit("% dead, store active, small backlog")))
    )
    why = F.concat(why, F.when(over > 0, F.concat(F.lit("; "), over.cast("string"), F.lit(" seams over-reserve"))).otherwise(""))
    return F.when(tier == "fast", fast).when(tier == "drain", drain).otherwise(base), tier, why

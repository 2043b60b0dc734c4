"""Problem 8: filling containers of fixed capacity, by swap-based local search.

A text above the capacity is divided into full containers and a rest; nothing else is divided. Texts and rests are dealt by hash to
groups of about GROUP items, packed independently: a group's total leaves less than one container over what its items need at best,
so grouping costs at most one container in as many as a group fills. Within a group, best fit (largest first) makes the start, and
local search then empties the least filled container: an item moves, one item is exchanged for a smaller one, two for one, or one
for two, wherever that fills the other container further, which raises the sum of squared fills; an emptied container is gone.
The search ends at the least possible number of containers, or when no container it tries can be emptied.

Defined results: texts without tokens need no container; repeated keys are items of their own, with the same key; capacities that
are null or below 1 are ignored; a text of exactly the capacity is one full container."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.session import materialize

GROUP = 8000  #: items packed together
DONORS = 24  #: containers tried to be emptied, one after the other, before the search ends
STEPS = 400  #: exchanges made for one of them at most


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest container that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            free, b = rooms.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free - s:
            insort(rooms, (free - s, b))
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Fewer containers, where exchanges that raise the sum of squared fills can empty some."""
    least = -(-int(sizes.sum()) // capacity)
    where = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    fill = np.array([int(sizes[x].sum()) for x in bins])
    alive = fill > 0
    failed: set[int] = set()
    while alive.sum() > least and len(failed) < DONORS:
        order = np.argsort(np.where(alive, fill, np.iinfo(np.int64).max), kind="stable")
        donor = next((int(b) for b in order[: len(failed) + 1] if b not in failed), -1)
        if donor < 0 or not alive[donor]:
            break
        saved = where.copy(), fill.copy()
        for _ in range(STEPS):
            if not fill[donor] or not _step(sizes, where, fill, alive, donor, capacity):
                break
        if fill[donor]:
            failed.add(donor)
            if (fill**2).sum() < (saved[1] ** 2).sum():
                where, fill = saved
        else:
            alive[donor] = False
            failed.clear()
    out: list[list[int]] = [[] for _ in bins]
    for i, b in enumerate(where.tolist()):
        out[b].append(i)
    return [x for x in out if x]


def _step(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, alive: np.ndarray, donor: int, capacity: int) -> bool:
    """The exchange that raises the sum of squared fills most, of those that take something from the donor."""
    free = np.where(alive, capacity - fill, -1)
    free[donor] = -1
    mine = np.flatnonzero(where == donor)
    mine = mine[np.argsort(sizes[mine], kind="stable")]
    # a whole item moves
    for i in mine[::-1]:
        fits = np.flatnonzero(free >= sizes[i])
        if len(fits):
            b = fits[np.argmax(fill[fits])]
            where[i] = b
            fill[b] += sizes[i]
            fill[donor] -= sizes[i]
            return True
    theirs = np.flatnonzero(free[where] > 0)
    if not len(theirs):
        return False
    s, room = sizes[theirs], free[where[theirs]]
    best, move = 0, None
    gives = [((int(i),), int(sizes[i])) for i in mine[-40:]]
    gives += [((int(i), int(j)), int(sizes[i] + sizes[j])) for x, i in enumerate(mine[-16:]) for j in mine[-16:][x + 1 :]]
    for items, total in gives:
        delta = total - s
        ok = (delta > 0) & (delta <= room)
        if ok.any():
            gain = np.where(ok, 2 * delta * (fill[where[theirs]] - fill[donor] + delta), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, move = int(gain[k]), (items, (int(theirs[k]),), int(delta[k]))
    # one of the donor's for two of the fullest containers that have room
    near = theirs[np.argsort(-fill[where[theirs]], kind="stable")[:200]]
    for b in np.unique(where[near]):
        inside = np.flatnonzero(where == b)[:16]
        if len(inside) > 1:
            x, y = np.triu_indices(len(inside), 1)
            pair = sizes[inside[x]] + sizes[inside[y]]
            for i in mine[-8:]:
                delta = int(sizes[i]) - pair
                ok = (delta > 0) & (delta <= free[b])
                if ok.any():
                    gain = np.where(ok, 2 * delta * (fill[b] - fill[donor] + delta), 0)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, move = int(gain[k]), ((int(i),), (int(inside[x[k]]), int(inside[y[k]])), int(delta[k]))
    if move is None:
        return False
    give, take, delta = move
    b = where[take[0]]
    where[list(give)] = b
    where[list(take)] = donor
    fill[b] += delta
    fill[donor] -= delta
    return True


def pack(sized: DataFrame, capacities: DataFrame, key: str = "doc_id", profile: str = "profile", capacity: str = "capacity_tokens", group: int = GROUP) -> DataFrame:
    """(profile, capacity, container, key, piece, start_token, tokens): where each text, or piece of one, of sized (key, tokens) goes."""
    kind = sized.schema[key].dataType.simpleString()
    items = materialize(sized.where("tokens > 0").select(F.col(key).alias("key"), "tokens"), "sizes")
    groups = max(1, -(-items.count() // group))
    # the profiles are a handful of rows, a parameter of the operator
    wanted = [(r[0], int(r[1])) for r in capacities.where(F.col(capacity) >= 1).select(profile, capacity).distinct().collect()]
    if not wanted:
        return items.sparkSession.createDataFrame([], f"profile string, capacity int, container string, {key} {kind}, piece int, start_token bigint, tokens bigint")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity")) for p, c in wanted]))
    # rows with the same key are told apart by their place in the table of sizes, so that they are dealt like any others
    dealt = items.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "row"), F.lit(groups)).cast("int")).select("key", "row", "tokens", "shard", each.alias("p")).select("key", "row", "tokens", "shard", "p.*")
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    full = dealt.where("tokens >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1)))
    start = F.col("piece").cast("long") * F.col("capacity")
    full = full.select("profile", "capacity", F.concat_ws("-", F.lit("full"), "row", "piece").alias("container"), "key", "piece", start.alias("start_token"), F.col("capacity").cast("long").alias("tokens"))
    rest = dealt.withColumn("piece", whole).withColumn("start_token", start).withColumn("tokens", F.col("tokens") - start).where("tokens > 0")

    def kernel(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        t = t.sort_by([("tokens", "descending"), ("key", "ascending"), ("piece", "ascending")])
        size = np.asarray(t.column("tokens"))
        cap, name, shard = t.column("capacity")[0].as_py(), t.column("profile")[0].as_py(), t.column("shard")[0].as_py()
        bins = local_search(size, best_fit(size, cap), cap)
        place = np.empty(len(size), np.int64)
        for b, x in enumerate(bins):
            place[x] = b
        container = pa.array([f"{shard}-{b}" for b in place.tolist()])
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.string()), pa.array([cap] * n, pa.int32()), container, *[t.column(c).combine_chunks() for c in ("key", "piece", "start_token", "tokens")]],
            names=["profile", "capacity", "container", "key", "piece", "start_token", "tokens"],
        )

    packed = rest.groupBy("profile", "capacity", "shard").applyInArrow(kernel, f"profile string, capacity int, container string, key {kind}, piece int, start_token bigint, tokens bigint")
    return full.unionByName(packed).withColumnRenamed("key", key)


def fill_report(packed: DataFrame) -> DataFrame:
    """(profile, capacity, containers, least, tokens, fill): containers used, the fewest that could do, and the share of them filled."""
    bins = packed.groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("t"))
    return bins.groupBy("profile", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("t") / F.first("capacity")).alias("least"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("fill")
    )

"""Filling fixed-capacity containers with items (problem 7).

Method: large-item matching. Items above a third of the capacity are paired, at most two to a container, by greedy matching; smaller
items go best-fit into the gaps that are left, and into containers of their own when no gap takes them.

An item's size is a whole number of tokens not above the capacity, so everything that matters is how many items there are of each size: a
histogram of at most ``capacity`` numbers, whatever the size of the corpus. The driver packs the histogram, moving counts
instead of items: its result is a list of patterns (the sizes of one container and how many containers look like it), and
their number is bounded by the number of sizes too. The items then take the places of their size by rank, in parallel: ranks are
counted in hashed slices of each size, as many as the commonest size needs, so a size that a third of all items share (such as
that of the pieces of cut items) is spread over many tasks; the places, whose number is checked, go to every task and are found by binary search.

Defined cases: an item larger than the container is cut into full containers and a rest, which is packed like an item; items of
no tokens (null or empty texts) take no room and get container null; items of equal size are placed in the order of a
hash of their id; repeated ids are separate pieces only if their rows differ; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.tokens import RANKS, with_tokens
from prefloom.plans.lineage import land

#: Items of a slice of one size, on average, and patterns' places that may be sent to every task (40 bytes each).
RANK_BITS = 44
SLICE, MAX_PLACES = 50_000, 5_000_000


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes in one container, largest first) with the number of containers of each, for ``counts`` items by size."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s < capacity}
    done: Counter = Counter({(capacity,): n for s, n in counts.items() if s == capacity and n > 0})
    large = sorted(s for s in left if 3 * s > capacity)
    open_: dict[int, Counter] = {}  # room -> patterns with that room

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room:
            open_.setdefault(room, Counter())[pattern] += n
        else:
            done[pattern] += n

    # greedy matching: the largest takes the largest that still fits beside it
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k < 0:
            put((a,), left.pop(a))
            large.pop()
            continue
        b = large[k]
        if a == b:
            n, odd = divmod(left[a], 2)
            if n:
                put((a, a), n)
            left[a] = odd
            if odd:
                k = bisect.bisect_left(large, a) - 1
                if k < 0:
                    put((a,), 1)
                else:
                    b = large[k]
                    put((a, b), 1)
                    left[b] -= 1
                    if not left[b]:
                        del left[b], large[k]
            large.remove(a)
            del left[a]
            continue
        n = min(left[a], left[b])
        put((a, b), n)
        for s in (a, b):
            left[s] -= n
            if not left[s]:
                del left[s]
                large.remove(s)
    # best fit of the small ones, largest first: the tightest gap that takes them; each move fills whole groups of equal containers
    rooms = sorted(open_)
    for s in sorted((s for s in left), reverse=True):
        n = left[s]
        while n:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                per = capacity // s
                full, rest = divmod(n, per)
                if full:
                    _move((s,) * per, full, capacity, open_, rooms, done)
                if rest:
                    _move((s,) * rest, 1, capacity, open_, rooms, done)
                break
            room = rooms[k]
            group = open_[room]
            pattern, m = next(iter(group.items()))
            per = min(room // s, max(1, n // m) if n >= m else 1)
            take = min(m, n // per)
            group[pattern] -= take
            if not group[pattern]:
                del group[pattern]
            if not group:
                del open_[room]
                rooms.pop(k)
            _move((*pattern, *(s,) * per), take, capacity, open_, rooms, done)
            n -= take * per
    for g in open_.values():
        done.update(g)
    return sorted(done.items(), reverse=True)


def _move(pattern: tuple[int, ...], n: int, capacity: int, open_: dict, rooms: list[int], done: Counter) -> None:
    room = capacity - sum(pattern)
    if not room:
        done[pattern] += n
        return
    if room not in open_:
        open_[room] = Counter()
        bisect.insort(rooms, room)
    open_[room][pattern] += n


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """id, piece_no, size: an item within capacity is one piece; a larger one is cut into full pieces and a rest."""
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    n = F.when(F.col("n_tokens") % capacity == 0, whole).otherwise(whole + 1)
    return sized.where("n_tokens > 0").select("id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no")).select(
        "id", "piece_no", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece_no") * F.lit(capacity)).cast("int").alias("size"))


def ranked(items: DataFrame, slices: int) -> DataFrame:
    """``items`` with ``rank``, from 0, among those of equal size, counted in hashed slices."""
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("id", "piece_no"), F.lit(slices)).cast("int"))
    per = sliced.groupBy("size", "slice").agg(F.count("*").alias("n"))  # at most capacity x slices rows
    base = per.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("size", "slice", "base")
    own = F.row_number().over(Window.partitionBy("size", "slice").orderBy(F.xxhash64("id"), "id", "piece_no")) - 1
    return sliced.withColumn("own", own).join(base, ["size", "slice"]).select("id", "piece_no", "size", (F.col("base") + F.col("own")).alias("rank"))


def pack(sized: DataFrame, capacity: int) -> DataFrame:
    """id, piece_no, size, container_no, for the items of ``sized`` (id, n_tokens)."""
    items = land(pieces(sized, capacity))
    counts = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most capacity rows
    places, first = [], 0
    at: Counter = Counter()
    for pattern, n in pack_counts(counts, capacity):
        for s, per in Counter(pattern).items():
            # ranks at[s] .. at[s] + n * per - 1 fill the containers first .. first + n - 1, per to each
            places.append((s, at[s], at[s] + n * per, per, first))
            at[s] += n * per
        first += n
    if len(places) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} places: too many to send to every task")
    where = np.array(sorted(places), np.int64).reshape(-1, 5)
    # size and rank as one number: the place of an item is the last that begins at or before it
    keys = where[:, 0] << RANK_BITS | where[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b["rank"].to_numpy(np.int64)
            at = where[np.searchsorted(keys, b["size"].to_numpy(np.int64) << RANK_BITS | rank, "right") - 1]
            b["container_no"] = at[:, 4] + (rank - at[:, 1]) // at[:, 3]
            yield b[["id", "piece_no", "size", "container_no"]]

    r = ranked(items, max(counts.values(), default=0) // SLICE + 1)
    return r.mapInPandas(run, "id bigint, piece_no int, size int, container_no bigint")


def packed(documents: DataFrame, capacities: DataFrame, path: str = RANKS, max_kinds: int = 1000) -> DataFrame:
    """container_kind, id, piece_no, size, container_no for every container kind; documents without tokens have size 0 and container null."""
    kinds = capacities.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().limit(max_kinds + 1).collect()
    if len(kinds) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of containers")
    sized = land(with_tokens(documents, path=path))
    out = None
    for r in sorted(kinds):
        one = pack(sized, r["capacity_tokens"]).unionByName(sized.where("n_tokens = 0").select("id", F.lit(0).alias("piece_no"), F.lit(0).alias("size"), F.lit(None).cast("bigint").alias("container_no")))
        one = one.select(F.lit(r["container_kind"]).alias("container_kind"), "id", "piece_no", "size", "container_no")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else documents.sparkSession.createDataFrame([], "container_kind string, id bigint, piece_no int, size int, container_no bigint")


def usage(packed_: DataFrame, capacities: DataFrame) -> DataFrame:
    """container_kind, containers, tokens, share of room used, least possible number of containers."""
    return (packed_.where("container_no is not null").groupBy("container_kind").agg(F.countDistinct("container_no").alias("containers"), F.sum("size").alias("tokens"))
            .join(capacities.select("container_kind", "capacity_tokens").distinct(), "container_kind")
            .select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")))

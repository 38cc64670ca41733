"""Copies that differ only in form (problem 4).

Method: recursive radix partitioning on canonical bytes, then one trie with terminal counters per bucket.

1. One pass turns rows into canonical bytes. Each task counts equal ones in a table that it empties whenever it holds ``held``
   bytes, so a hot text leaves a task as a handful of entries. The same pass notes the digest of each row, so texts are
   made canonical once.
2. All entries start in one bucket. A bucket of more than ``fit`` bytes is split by the next ``step`` bytes after those all its
   entries share (the common prefix of its least and greatest entry), so every split divides, however long the shared beginning.
   Only entries of oversized buckets go on to the next level. Small neighbours under one parent are put together up to ``fit``.
3. A path-compressed trie per bucket adds up the copies and keeps the smallest row number at each terminal. A bucket of one
   string can't be split; if it is oversized, its single counter is added up with partial sums instead of in one task.

Rows of hot groups (more than one row in ``HOT``, so fewer than ``HOT`` groups) find their first row by a broadcast of those groups, the others
by a shuffle on the digest.

Defined cases: null, blank and content-free texts (punctuation or invisible characters only) are in no group; repeated
``row_no`` values count as often as they occur, but ``copies_found`` lists each once; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.text import canonical
from prefloom.plans.lineage import land

HOT = 1000
#: What an entry weighs beside its bytes.
ENTRY = 32
#: Rows of a routing table that may be broadcast (about 60 bytes each).
SMALL = 200_000


class Trie:
    """Path-compressed trie; a terminal holds the number of insertions and the smallest number inserted."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, first: int, n: int) -> None:
        node = self.root
        while True:
            if not key:
                old = node.get(b"")
                node[b""] = (min(first, old[0]), n + old[1]) if old else (first, n)
                return
            edge = node.get(key[0])
            if edge is None:
                node[key[0]] = (key, {b"": (first, n)})
                return
            label, child = edge
            if key.startswith(label):
                node, key = child, key[len(label):]
                continue
            k = next(i for i in range(1, min(len(label), len(key)) + 1) if i == len(key) or i == len(label) or label[i] != key[i])
            middle = {label[k]: (label[k:], child)}
            node[key[0]] = (label[:k], middle)
            node, key = middle, key[k:]

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            for k, v in node.items():
                if k == b"":
                    yield path, v[0], v[1]
                else:
                    stack.append((path + v[0], v[1]))


def digest(canon: bytes) -> bytes:
    return hashlib.blake2b(canon, digest_size=16).digest()


_ONCE = "canon binary, first bigint, n bigint, id bigint, key binary"


def _once(held: int):
    """Entries (canon, first, n) and rows (id, key) in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[bytes, list[int]] = {}
        weight = 0

        def entries() -> pd.DataFrame:
            f = pd.DataFrame({"canon": list(have), "first": [v[0] for v in have.values()], "n": [v[1] for v in have.values()]})
            f["id"], f["key"] = pd.array([None] * len(f), "Int64"), None
            return f.astype({"first": "Int64", "n": "Int64"})

        for b in batches:
            ids, keys = [], []
            for i, t in zip(b["id"], b["text"]):
                c = canonical(t).encode("utf-8", "surrogatepass")
                if not c:
                    continue
                old = have.get(c)
                if old is None:
                    have[c] = [i, 1]
                    weight += len(c) + ENTRY
                else:
                    old[0], old[1] = min(old[0], i), old[1] + 1
                ids.append(i)
                keys.append(digest(c))
            f = pd.DataFrame({"canon": None, "first": pd.array([None] * len(ids), "Int64"), "n": pd.array([None] * len(ids), "Int64"), "id": ids, "key": keys})
            yield f.astype({"canon": object, "id": "Int64"})
            if weight > held:
                yield entries()
                have, weight = {}, 0
        yield entries()

    return run


def _count(bucket: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for key, first, n in zip(bucket["canon"], bucket["first"], bucket["n"]):
        trie.add(key, int(first), int(n))
    return pd.DataFrame([(*t, digest(t[0])) for t in trie.terminals()], columns=["canon", "first", "n", "key"])


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["next"] = [os.path.commonprefix([lo, hi]) for lo, hi in zip(b["lo"], b["hi"])]
        yield b[["bucket", "piece", "next"]]


def _routed(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """``rows`` with what ``plan`` says of their bucket and piece; AQE splits the join where the plan is too large to broadcast."""
    return rows.join(F.broadcast(plan) if n <= SMALL else plan, ["bucket", "piece"])


def radix_buckets(entries: DataFrame, fit: int, step: int) -> tuple[DataFrame, DataFrame]:
    """(bucketed, single): entries with ``level``, ``bucket`` and ``part`` that name a bucket of at most twice ``fit`` bytes, and entries of
    oversized buckets that consist of one string."""
    open_, level, bucketed, single = entries.select("canon", "first", "n", F.lit(b"").alias("bucket")), 0, [], []
    while True:
        rows = open_.withColumn("piece", F.substring("canon", F.length("bucket") + 1, F.lit(step)))
        h = F.xxhash64("canon")  # equal hashes throughout: treated as one string, which is added up by string all the same
        sizes = land(rows.groupBy("bucket", "piece").agg(F.sum(F.octet_length("canon") + ENTRY).alias("size"), (F.min(h) == F.max(h)).alias("one")))
        n = sizes.count()
        before = F.sum("size").over(Window.partitionBy("bucket").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))  # at most 256 ** step pieces
        small = sizes.where(F.col("size") <= fit).select("bucket", "piece", F.floor(F.coalesce(before, F.lit(0)) / fit).alias("part"))
        bucketed.append(_routed(rows, small, n).select("canon", "first", "n", F.lit(level).alias("level"), "bucket", "part"))
        single.append(_routed(rows, sizes.where((F.col("size") > fit) & F.col("one")).select("bucket", "piece"), n).select("canon", "first", "n"))
        over = sizes.where((F.col("size") > fit) & ~F.col("one")).select("bucket", "piece")
        if over.isEmpty():
            break
        split = _routed(rows, over, n).groupBy("bucket", "piece").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).mapInPandas(_shared, "bucket binary, piece binary, next binary")
        open_ = land(_routed(rows, land(split), n).select("canon", "first", "n", F.col("next").alias("bucket")))
        level += 1
    for more in bucketed[1:]:
        bucketed[0] = bucketed[0].unionByName(more)
    for more in single[1:]:
        single[0] = single[0].unionByName(more)
    return bucketed[0], single[0]


def _collapsed(rows: DataFrame, id_col: str, text_col: str, fit: int, step: int, held: int) -> tuple[DataFrame, DataFrame]:
    """(groups, keyed): groups has canon, first, n, key; keyed has id, key of every row."""
    once = land(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null").mapInPandas(_once(held), _ONCE))
    bucketed, single = radix_buckets(once.where("canon is not null"), fit, step)
    counted = bucketed.groupBy("level", "bucket", "part").applyInPandas(lambda b: _count(b), "canon binary, first bigint, n bigint, key binary")
    added = single.groupBy("canon").agg(F.min("first").alias("first"), F.sum("n").alias("n")).mapInPandas(_with_digest, "canon binary, first bigint, n bigint, key binary")
    return counted.unionByName(added), once.where("id is not null").select("id", "key")


def _with_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["key"] = [digest(c) for c in b["canon"]]
        yield b


def collapse(rows: DataFrame, id_col: str, text_col: str, fit: int = 4 << 20, step: int = 2, held: int = 32 << 20) -> DataFrame:
    """One row per group of copies: ``key`` (digest), ``canon``, ``first`` (smallest id), ``n`` (copies)."""
    return _collapsed(rows, id_col, text_col, fit, step, held)[0].select("key", F.col("canon").cast("string").alias("canon"), "first", "n")


def copies_found(rows: DataFrame, id_col: str = "row_no", text_col: str = "instruction", fit: int = 4 << 20, step: int = 2, held: int = 32 << 20) -> DataFrame:
    """Each row that is a copy of an earlier one, with the first of its group."""
    groups, keyed = _collapsed(rows, id_col, text_col, fit, step, held)
    groups = land(groups.where("n > 1").select("key", "first", "n"))
    bar = max(1000, keyed.count() // HOT)
    hot = F.broadcast(groups.where(F.col("n") > bar).select("key", "first"))  # fewer than HOT groups can hold so many rows
    rest = groups.where(F.col("n") <= bar).select("key", "first")
    found = keyed.join(hot, "key").unionByName(keyed.join(hot.select("key"), "key", "left_anti").join(rest, "key"))
    return found.where("id > first").select(F.col("first").alias(f"first_{id_col}"), F.col("id").alias(id_col)).distinct()

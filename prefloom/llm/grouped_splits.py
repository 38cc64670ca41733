"""Splits that keep related records together (problem 6).

Method: iterative minimum-label propagation over the bipartite graph of records and entities (prompts, authors), then stratified
assignment of whole groups to splits.

Propagation: each record starts with the smallest prompt_id of its own pairs; in a round every entity takes the smallest label
of its records and every record the smallest of its entities', and labels are then shortened by following them (a label names a
prompt, whose own label is at most as large), so that the number of rounds grows with the logarithm of a chain and not with
its length. Both steps are aggregations with partial sums before the shuffle, and the labels of hot entities (a bounded number)
are broadcast to their edges, so an entity that holds a third of all records costs one row per task. Rounds end when no label changes; each is written to the shared folder, and the one before removed.

Defined cases: null, blank and ``unknown`` authors link nothing; pairs without a split count in no split; split names are
compared without case and padding, ``val`` and ``dev`` mean validation, other names are kept as they are; pairs whose record
is unknown are linked by prompt and record only; rows without prompt_id are ignored; repeated rows change nothing; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.plans.lineage import drop, land

SPLITS = ("train", "validation", "test")


def split_name(c):
    """train, validation, test or null."""
    s = F.lower(F.trim(F.regexp_replace(c, r"[\s _]+", " ")))
    return F.when(s.isin("val", "dev", "valid"), "validation").otherwise(F.when(s != "", s))


def author(c):
    """The author, or null where none is known."""
    s = F.trim(F.regexp_replace(c, r"[\s ​﻿]+", " "))
    return F.when((s != "") & ~F.lower(s).isin("unknown", "none", "null", "n/a", "na", "-"), s)


def edges(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """Distinct (prompt_id, entity) with entities ``r:<record>`` and ``a:<author>``: prompts on one side, records and authors on the other."""
    p = pairs.where("prompt_id is not null").select("prompt_id", "record_id").distinct()
    a = raw.select(F.col("id").alias("record_id"), author(F.col("author_id")).alias("author")).where("author is not null and record_id is not null").distinct()
    by_author = p.join(a, "record_id").select("prompt_id", F.concat(F.lit("a:"), "author").alias("entity"))
    by_record = p.where("record_id is not null").select("prompt_id", F.concat(F.lit("r:"), "record_id").alias("entity"))
    return by_record.unionByName(by_author).distinct()


#: An entity with more than one in HOT of all edges is hot; there are fewer than HOT of them, so what is known of them may be broadcast.
HOT = 1000


def components(links: DataFrame, node: str = "prompt_id", entity: str = "entity") -> DataFrame:
    """(node, label): the smallest node connected with each node through shared entities."""
    # an entity with one node links nothing
    counted = land(links.groupBy(entity).agg(F.count("*").alias("c")).where("c > 1"))
    total = counted.agg(F.sum("c")).first()[0] or 0
    e = land(links.join(counted.select(entity), entity, "left_semi").select(F.col(node).alias("node"), F.col(entity).alias("entity")))
    hot = counted.where(F.col("c") > max(1000, total // HOT)).select(F.col(entity).alias("entity"))
    # the edges of hot entities stay where they are: only the labels of these entities move
    cold, hot_e = (e, None) if hot.isEmpty() else (land(e.join(F.broadcast(hot), "entity", "left_anti")), land(e.join(F.broadcast(hot), "entity")))
    labels = land(e.groupBy("node").agg(F.min("node").alias("label")))
    while True:
        least = lambda x: x.join(labels, "node").groupBy("entity").agg(F.min("label").alias("label"))
        reached = cold.join(least(cold), "entity").select("node", "label")
        if hot_e is not None:
            reached = reached.unionByName(hot_e.join(F.broadcast(least(hot_e)), "entity").select("node", "label"))
        mine = reached.groupBy("node").agg(F.min("label").alias("near"))
        # a label names a node: what that node has meanwhile reached is at most as large
        jump = mine.select(F.col("node").alias("near"), F.col("near").alias("far"))
        step = (labels.join(mine, "node").join(jump, "near", "left")
                .select("node", F.least("label", "near", F.coalesce("far", "near")).alias("label"), (F.least("near", F.coalesce("far", "near")) < F.col("label")).alias("moved")))
        step, before = land(step), labels
        labels = step.select("node", "label")
        drop(before)
        if step.where("moved").isEmpty():
            break
    alone = links.select(F.col(node).alias("node")).distinct().join(labels, "node", "left")
    return alone.select(F.col("node").alias(node), F.coalesce("label", "node").alias("label"))


def separated(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """prompt_id, group_prompt_id of every linked group whose pairs lie in more than one split."""
    linked = land(components(edges(pairs, raw)))
    at = pairs.where("prompt_id is not null").select("prompt_id", split_name(F.col("split")).alias("split")).where("split is not null").distinct()
    torn = (at.join(linked, "prompt_id").groupBy("label").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo < hi").select("label"))
    return linked.join(torn, "label", "left_semi").select("prompt_id", F.col("label").alias("group_prompt_id"))


def assign(pairs: DataFrame, raw: DataFrame, shares: dict[str, float] | None = None, stratum: str = "label_confidence", big: float = 0.002) -> DataFrame:
    """group_prompt_id, n_pairs, split: see ``_assigned``."""
    groups, _, _ = _assigned(pairs, raw, shares, stratum, big)
    return groups


def assign_pairs(pairs: DataFrame, raw: DataFrame, shares: dict[str, float] | None = None, stratum: str = "label_confidence", big: float = 0.002) -> DataFrame:
    """pair_id, prompt_id, group_prompt_id, split: the new split of every pair, each once. Groups placed one by one, whose number has a
    bound, are broadcast to their pairs; no other group holds more than the fraction ``big`` of them."""
    groups, linked, placed = _assigned(pairs, raw, shares, stratum, big)
    of = groups.select(F.col("group_prompt_id").alias("label"), "split")
    large = F.broadcast(placed)
    by_prompt = linked.join(large, "label").unionByName(linked.join(large, "label", "left_anti").join(of, "label")).select("prompt_id", "label", "split")
    p = pairs.where("prompt_id is not null").select("pair_id", "prompt_id").distinct()
    return p.join(by_prompt, "prompt_id").select("pair_id", "prompt_id", F.col("label").alias("group_prompt_id"), "split")


def _assigned(pairs: DataFrame, raw: DataFrame, shares: dict[str, float] | None, stratum: str, big: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, linked, placed): whole groups to splits, close to ``shares`` overall and within each stratum of ``stratum``.

    Groups above the fraction ``big`` of all pairs (at most 1/big of them, so their number has a proven bound) are placed one by
    one, largest first, where they lower most the squared deviation of split sizes by stratum from the targets. The rest is
    laid out in a fixed pseudo-random order within its main stratum and cut where the remaining quotas of the strata end.
    """
    shares = shares or {"train": 0.70, "validation": 0.15, "test": 0.15}
    names = list(shares)
    p = pairs.where("prompt_id is not null").select("pair_id", "prompt_id", F.coalesce(F.col(stratum).cast("string"), F.lit("?")).alias("s")).dropDuplicates(["pair_id"])
    linked = land(components(edges(pairs, raw)))
    sized = p.join(linked, "prompt_id").groupBy("label", "s").agg(F.count("*").alias("n"))
    g = land(sized.groupBy("label").agg(F.sum("n").alias("n"), F.max_by("s", F.struct("n", "s")).alias("main"), F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("parts")))
    total = {r["s"]: r["n"] for r in sized.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row per stratum value
    whole = sum(total.values())
    left = {(k, s): shares[k] * n for k in names for s, n in total.items()}
    placed = []
    for r in g.where(F.col("n") > big * whole).orderBy(F.desc("n"), "label").collect():  # at most 1/big rows
        gain = lambda k: sum((left[k, s] - c) ** 2 - left[k, s] ** 2 for s, c in r["parts"].items())
        k = min(names, key=gain)
        for s, c in r["parts"].items():
            left[k, s] -= c
        placed.append((r["label"], k))
    spark = pairs.sparkSession
    fixed = spark.createDataFrame(placed, "label string, split string")
    rest = g.join(F.broadcast(fixed), "label", "left_anti").withColumn("u", F.pmod(F.xxhash64("label"), F.lit(4096)))
    # running totals in two levels: 4096 slices per stratum, then inside a slice
    slices = rest.groupBy("main", "u").agg(F.sum("n").alias("m"))
    before = slices.withColumn("base", F.sum("m").over(Window.partitionBy("main").orderBy("u").rowsBetween(Window.unboundedPreceding, -1))).select("main", "u", F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("main", "u").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    pos = rest.join(before, ["main", "u"]).withColumn("at", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2)
    sums = {r["main"]: r["n"] for r in rest.groupBy("main").agg(F.sum("n").alias("n")).collect()}  # one row per stratum value
    cuts = []
    for s, n in sums.items():
        want = {k: max(0.0, left[k, s]) for k in names}
        scale = n / (sum(want.values()) or 1)
        end = 0.0
        for k in names:
            cuts.append((s, k, end, end + want[k] * scale))
            end += want[k] * scale
        cuts[-1] = (s, names[-1], cuts[-1][2], float("inf"))
    ends = spark.createDataFrame(cuts, "main string, split string, lo double, hi double")
    small = pos.join(ends, "main").where("at >= lo and at < hi").select("label", "n", "split")
    groups = g.join(F.broadcast(fixed), "label").select("label", "n", "split").unionByName(small).select(F.col("label").alias("group_prompt_id"), F.col("n").alias("n_pairs"), "split")
    return groups, linked, fixed

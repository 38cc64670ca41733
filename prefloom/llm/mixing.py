"""Mixing sources to target weights (problem 8).

Method: Efraimidis-Spirakis sampling. Each document gets the exponential key -ln(u) / w, u a hash of its id and the seed, w its
quality weight; documents are sorted by key within their source and their tokens summed up to the source's budget. A budget beyond one
pass over the source is met by complete epochs first (every document once per epoch) and a fractional selection by key last.

Total size: the largest at which every named source that has documents can give its share within its repeats, or the ``total``
given. A source without documents can't give anything: its share is reported as not reached, and the others keep their shares among
themselves. A source enters the selection as long as its running total stays within the budget. The document that crosses it
doesn't end the source: those too large for what is left are passed over and the running totals formed anew, again and again; what then is left
goes to the largest single document that fits, and last to the smallest one if that brings the total nearer. This ends when less than a
thousandth of the budget is left or nothing fits, or after ``fills`` rounds of either kind.

The running totals are taken in two levels, slices of the key range first and inside slices then, so a source that holds a third
of all documents is sorted in many tasks. Slices are of equal probability under the distribution of keys, so none grows beyond its share.

Defined cases: source names differing in case, padding or ``_`` for ``-`` are one source; documents of null source or without
tokens are in no mix; a null or negative share counts as 0, null repeats as 1; ties of keys go by id; a document listed twice
counts as two; an empty table gives no rows but the report; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.tokens import RANKS, with_tokens
from prefloom.plans.lineage import land

#: Documents of a slice, on average; slices are of equal probability, and their number follows from the number of documents.
SLICE = 20_000


def source_name(c):
    """One spelling per source."""
    s = F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""), r"[_\s]+", "-"))
    return F.when(s != "", s)


def quality():
    """Quality weight of a document, from 0.25 to 1: lower for very short texts and for texts all in one letter case or full of signs."""
    t, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / n
    uniform = (F.upper(t) == t) | (F.lower(t) == t)
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), letters + 0.2) * F.when(F.length(t) < 80, 0.5).otherwise(1.0) * F.when(uniform, 0.5).otherwise(1.0))


def keyed(documents: DataFrame, seed: int, path: str) -> DataFrame:
    """id, source, n_tokens, k (sampling key) of every document with a source and tokens."""
    d = documents.withColumn("src", source_name(F.col("source"))).withColumn("w", quality()).where("src is not null and text is not null")
    d = with_tokens(d, path=path, keep=("src", "w")).where("n_tokens > 0")
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    k = -F.log(u) / F.col("w")
    return d.withColumn("k", k).select("id", F.col("src").alias("source"), "n_tokens", "k")


def sliced(docs: DataFrame, slices: int) -> DataFrame:
    """``docs`` with ``slice``: 1 - exp(-k) lies between 0 and 1 and spreads the keys; weights differ by a factor of 4 at most."""
    return docs.withColumn("slice", F.least(F.lit(slices - 1), F.floor((1 - F.exp(-F.col("k") * 0.6)) * slices)).cast("int"))


def targets(mix_targets: DataFrame) -> DataFrame:
    t = mix_targets.where("mix_name is not null").select("mix_name", source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    return t.where("source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan(docs: DataFrame, mix_targets: DataFrame, total: float | None) -> DataFrame:
    """mix_name, source, target_share, max_repeats, have (tokens there), budget, epochs (complete), rest (tokens of the fractional pass)."""
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    t = targets(mix_targets).join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    by = Window.partitionBy("mix_name")
    able = F.when((F.col("have") > 0) & (F.col("target_share") > 0), F.col("target_share"))
    t = t.withColumn("share", able / F.sum(able).over(by))
    size = F.lit(float(total)) if total is not None else F.min(F.when(F.col("share").isNotNull(), F.col("have") * F.col("max_repeats") / F.col("share"))).over(by)
    t = t.withColumn("budget", F.coalesce(F.least(F.col("share") * size, (F.col("have") * F.col("max_repeats")).cast("double")), F.lit(0.0)))
    epochs = F.when(F.col("have") > 0, F.floor((F.col("budget") + 1e-6) / F.col("have"))).otherwise(0).cast("int")
    return t.withColumn("epochs", F.least(epochs, F.col("max_repeats"))).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("have"))).drop("share")


def running(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with ``upto``, the tokens up to and with each document in the order of its key: slices first, then inside a slice."""
    slices = docs.groupBy(*keys, "slice").agg(F.sum("n_tokens").alias("t"))
    base = slices.withColumn("base", F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*keys, "slice", "base")
    own = F.sum("n_tokens").over(Window.partitionBy(*keys, "slice").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return docs.withColumn("own", own).join(base, [*keys, "slice"]).withColumn("upto", F.col("base") + F.col("own")).drop("own", "base")


def mixed(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, seed: int = 42, path: str = RANKS, fills: int = 12, max_targets: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan): chosen has mix_name, source, id, n_tokens, repeats."""
    docs = land(keyed(documents, seed, path))
    p = land(plan(docs, mix_targets, total))
    if p.count() > max_targets:
        raise ValueError(f"more than {max_targets} targets: too many to send to every task")
    docs = sliced(docs, docs.count() // SLICE + 1)
    run = running(docs, ["source"])  # does not depend on the mix
    wide = run.join(F.broadcast(p), "source")  # of a checked size
    within = F.col("upto") <= F.col("rest")
    state = wide.groupBy("mix_name", "source").agg(F.coalesce(F.max(F.when(within, F.col("upto"))), F.lit(0)).alias("taken"), F.max("rest").alias("rest"), F.max(F.col("epochs") < F.col("max_repeats")).alias("free")).collect()
    gaps = {(r["mix_name"], r["source"]): [r["rest"] - r["taken"], r["rest"]] for r in state if r["free"] and r["rest"] > 0}
    spark = documents.sparkSession
    key = ["mix_name", "source", "k", "id"]
    doc, fill = [*key, "n_tokens", "slice"], "mix_name string, source string, k double, id bigint"
    wanted = lambda: [(m, s, float(g)) for (m, s), (g, rest) in gaps.items() if g > rest / 1000]
    with_gap = lambda rows: rows.join(F.broadcast(spark.createDataFrame(wanted(), "mix_name string, source string, gap double")), ["mix_name", "source"])
    open_, added, n = wide.where(~within).select(*doc), None, 0
    # past the documents that are too large for what is left, in the order of the keys
    while wanted() and n < fills:
        n += 1
        fits = land(running(with_gap(open_).where("n_tokens <= gap"), ["mix_name", "source"]))
        taken = fits.where("upto <= gap")
        got = taken.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("t")).collect()  # a row per mix and source
        if not got:
            break
        for r in got:
            gaps[r["mix_name"], r["source"]][0] -= r["t"]
        added = taken.select(*key) if added is None else added.unionByName(taken.select(*key))
        open_ = fits.where("upto > gap").select(*doc)
    # then single documents: the largest that fits, last the smallest that brings the total nearer
    if added is not None:
        open_ = wide.where(~within).select(*doc).join(added, key, "left_anti")
    more: list[tuple] = []
    for n in range(fills):
        if not wanted():
            break
        one = F.struct("n_tokens", "k", "id")
        best = with_gap(open_).join(F.broadcast(spark.createDataFrame(more, fill)), key, "left_anti").groupBy("mix_name", "source").agg(
            F.max(F.when(F.col("n_tokens") <= F.col("gap"), one)).alias("x"), F.min(F.when(F.col("n_tokens") < 2 * F.col("gap"), one)).alias("y")).collect()  # a row per mix and source
        for r in best:
            x = r["x"] or r["y"]
            if x is not None:
                more.append((r["mix_name"], r["source"], x["k"], x["id"]))
                gaps[r["mix_name"], r["source"]][0] -= x["n_tokens"]
        if all(r["x"] is None for r in best):
            break
    extra = spark.createDataFrame(more, fill) if added is None else added.unionByName(spark.createDataFrame(more, fill))
    filled = wide.join(extra.withColumn("filled", F.lit(1)), key, "left")
    chosen = filled.withColumn("repeats", F.col("epochs") + F.when((within & (F.col("rest") > 0)) | F.col("filled").isNotNull(), 1).otherwise(0)).where("repeats > 0")
    return chosen.select("mix_name", "source", "id", "n_tokens", "repeats"), p


def report(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, seed: int = 42, path: str = RANKS) -> DataFrame:
    """mix_name, source, target_share, actual_share, tokens, documents, most_repeats, max_repeats of every mix and source."""
    chosen, p = mixed(documents, mix_targets, total, seed, path)
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    r = p.join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return r.select("mix_name", "source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")

"""The same or nearly the same records across splits (problem 5).

Method: a suffix array over partitioned concatenated texts; adjacent suffixes with long common prefixes reveal shared spans, and
spans are merged into the coverage of each record, which decides.

1. Texts that are equal word for word become one text, named by 128 bits, with flags for the splits it occurs in.
2. From each text the suffixes at winnowed word positions are taken: of each ``window`` words the rarest one (of equals the one with
   the smallest hash), so any span of ``window`` or more shared words starts a suffix at the same word in both texts, and the words
   that tell requests apart, such as names, start one wherever they stand. How rare a word is comes from a sketch of
   ``SKETCH`` counters over all texts, whose size does not depend on the data. Of a suffix its first ``KEPT`` words are kept, long words as
   hashes, so the array grows with the length of the texts and not with its square.
3. The suffixes are written once, range-partitioned and sorted: the suffix array, in pieces of about ``PIECE`` suffixes however common a
   phrase is. A scan links neighbours of different texts that share at least ``span`` words; the neighbours across the edges of
   pieces are linked in a second, tiny scan. A suffix makes one link to either side, so links grow with the input, not with its square.
   Each suffix carries a 128-bit map of its text's words; two maps differ in at most as many bits as the texts have words outside shared
   spans, so links that can't reach the coverage go at once.
4. Linked texts are checked: the spans of ``span`` or more words that they share, merged, cover at least ``least`` of the words of both (so
   moved sentences don't matter), and no name is exchanged (see ``same_names``).
   A neighbour that fails must not end the search: texts of two splits that share a name (or, without names, the first words of a
   suffix) and whose maps allow it are linked wherever they stand, by an exact join (see ``_beyond_neighbours``).
5. Checked links are joined into classes by minimum-label propagation, since copies of one request follow each other in the array
   but need not all be direct neighbours. ``classes`` gives one row per pair with its class; ``pairs_found``, whose rows are pairs, checks
   the texts of the train split against the others of their class.

Defined cases: null or wordless texts and rows without a known split are in no pair; repeated rows count once; a pair_id whose
split differs between its rows is compared in both roles but never with itself; ties of equal suffixes are ordered by text; very long
texts are compared whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.rows import beside
from prefloom.llm.grouped_splits import components, split_name
from prefloom.llm.text import words
from prefloom.plans.lineage import land

#: Words a span must have to count, and the share of the words of both texts that spans must cover.
SPAN, LEAST = 2, 0.65
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Function words that may open a sentence before a capitalised noun (fixed list: en, de, fr, es, it).
_OPENERS = frozenset(
    "the a an in at on of to for and or but if since when how what my as with from "
    "der die das den dem des ein eine einen im am zu seit für wie wer wenn bei beim "
    "le la les de du des un une chez dans en el los las lo il gli da di nel per al".split())


_SALUTED = re.compile(r"[!:]\s$")
#: Words of courtesy and function words that may be put in or exchanged without changing what is asked (fixed list).
_COURTESY = frozenset("hi hello hey there dear please kindly thanks thank you your it is be to of the a an and for with on at by in ought should must would could can shall may will like want wants need needs".split())


def names_in(text: str) -> str | None:
    """Names of two words in one line, both capitalised, joined by ``|``; None if the letter case of the text carries no information."""
    ws = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    if not ws:
        return None
    share = sum(w[0].isupper() for w, _, _ in ws) / len(ws)
    if share > 0.6 or not any(w[0].isupper() for w, _, _ in ws):
        return None
    found = set()
    for (a, _, end), (b, start, _) in zip(ws, ws[1:]):
        # a salutation put before a sentence may have lowered its first letter
        lowered = a.islower() and _SALUTED.search(text, max(0, end - len(a) - 3), end - len(a)) is not None
        if text[end:start].isspace() and "\n" not in text[end:start] and len(a) > 1 and len(b) > 1 and (a[0].isupper() or lowered) and b[0].isupper() and a[1:].islower() and b[1:].islower() and a.lower() not in _OPENERS:
            found.add(f"{a.casefold()} {b.casefold()}")
    return "|".join(sorted(found))


def _close(a: str, b: str) -> bool:
    """Equal, or two neighbouring letters swapped: the slip that still names the same place. Names a letter apart are different names."""
    if a == b or len(a) != len(b):
        return a == b
    k = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
    return a[k:k + 2] == b[k:k + 2][::-1] and a[k + 2:] == b[k + 2:]


def same_names(a: list[str], b: list[str], names_a: str | None, names_b: str | None) -> bool:
    """No name exchanged: the names of one text all stand in the other, neighbouring letters swapped in one of the two words allowed. Where neither text's letter case shows
    names, two or more adjacent words, no courtesies, that only one text has, on both sides, count as an exchanged name."""

    def inside(names: str, ws: list[str]) -> bool:
        have = set(zip(ws, ws[1:]))
        there, gone = set(), []
        for n in names.split("|"):
            x, y = n.split(" ")
            if (x, y) in have or any(x == p and _close(y, q) or y == q and _close(x, p) for p, q in have):
                there |= {x, y}
            else:
                gone.append((x, y))
        # a capitalised word beside a name that stands in both belongs to the sentence
        return bool(there) and all(x in there or y in there for x, y in gone)

    shown = [(n, ws) for n, ws in ((names_a, b), (names_b, a)) if n]
    if shown:
        return any(inside(n, ws) for n, ws in shown)
    sa, sb = set(a), set(b)

    def run(ws: list[str], other: set[str]) -> bool:
        return any(x not in other and y not in other and x not in _COURTESY and y not in _COURTESY and not any(_close(x, o) or _close(y, o) for o in other) for x, y in zip(ws, ws[1:]) if x.isalpha() and y.isalpha())

    return not (run(a, sb) and run(b, sa))


def coverage(a: list[str], b: list[str], span: int) -> float:
    """Share of the words of ``b`` inside spans of ``span`` or more words that also stand in ``a``, overlapping spans merged."""
    if not a or not b:
        return 0.0
    w = min(span, len(a), len(b))
    have = {tuple(a[i:i + w]) for i in range(len(a) - w + 1)}
    hit = [False] * len(b)
    for i in range(len(b) - w + 1):
        if tuple(b[i:i + w]) in have:
            hit[i:i + w] = [True] * w
    return sum(hit) / len(b)


def _bits(ws: list[str]) -> tuple[int, int]:
    v = 0
    for w in set(ws):
        v |= 1 << (xxhash.xxh32_intdigest(w) & 127)
    lo, hi = v & (2**64 - 1), v >> 64
    return (lo - 2**64 if lo >> 63 else lo), (hi - 2**64 if hi >> 63 else hi)


#: Counters of the sketch of word frequencies: 1 MB, whatever the vocabulary. Words that share a counter look more frequent, never rarer.
SKETCH = 1 << 18


def _slot(word: str) -> int:
    return xxhash.xxh32_intdigest(word, 7) % SKETCH


def winnowed(ws: list[str], window: int, counts=None) -> list[int]:
    """Positions of the rarest word (of equals: the smallest hash, the rightmost) in each run of ``window`` words."""
    h = [(0 if counts is None else int(counts[_slot(w)]), xxhash.xxh32_intdigest(w)) for w in ws]
    if len(h) <= window:
        return [min(range(len(h)), key=lambda i: (h[i], -i))] if h else []
    out, last = [], -1
    for i in range(len(h) - window + 1):
        if last < i:
            last = min(range(i, i + window), key=lambda k: (h[k], -k))
            out.append(last)
        elif h[i + window - 1] <= h[last]:
            last = i + window - 1
            out.append(last)
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n: Counter = Counter()
    for b in batches:
        for t in b["norm"]:
            n.update(set(t.split(" ")))
    slots: Counter = Counter()
    for w, c in n.items():
        slots[_slot(w)] += c
    yield pd.DataFrame({"slot": list(slots), "n": list(slots.values())}).astype("int64")


def sketch(texts: DataFrame) -> np.ndarray:
    """Texts per counter, from all texts; at most SKETCH rows reach the driver."""
    counts = np.zeros(SKETCH, np.int64)
    for r in texts.select("norm").mapInPandas(_counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    return np.minimum(counts, 2**31 - 1).astype(np.int32)


def _normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ws = [words(p) for p in b["prompt"]]
        maps = [_bits(w) for w in ws]
        yield pd.DataFrame({"ph": b["ph"], "norm": [" ".join(w) for w in ws], "names": [names_in(p) for p in b["prompt"]], "train": b["train"], "held": b["held"], "size": [len(w) for w in ws], "lo": [m[0] for m in maps], "hi": [m[1] for m in maps]})


#: Words of a suffix that are kept, and letters of a word beyond which its hash stands for it: a suffix has a bounded size.
KEPT, LONG = 16, 24


def suffix_key(ws: list[str], i: int) -> str:
    """The first KEPT words of the suffix that starts at word ``i``."""
    return " ".join(w if len(w) <= LONG else f"\x01{xxhash.xxh64_hexdigest(w)}" for w in ws[i:i + KEPT])


def _suffixes(window: int, shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, counts = [], shared.value
            for tid, norm, names, *rest in zip(b["tid"], b["norm"], b["names"], b["size"], b["lo"], b["hi"], b["train"], b["held"]):
                ws = norm.split(" ")
                out.extend((suffix_key(ws, i), tid, *rest, not names) for i in winnowed(ws, window, counts))
            yield pd.DataFrame(out, columns=["suffix", "tid", "size", "lo", "hi", "train", "held", "plain"])

    return run


def _common_words(a: str, b: str) -> int:
    """Whole words of the common prefix."""
    if a == b:
        return a.count(" ") + 1
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        lo = hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    n = a[:lo].count(" ")
    return n + (lo > 0 and (lo == len(a) or a[lo] == " ") and (lo == len(b) or b[lo] == " "))


def _linked(x: tuple, y: tuple, span: int, least: float) -> tuple | None:
    if x[1] == y[1]:
        return None
    if ((x[3] ^ y[3]) & (2**64 - 1)).bit_count() + ((x[4] ^ y[4]) & (2**64 - 1)).bit_count() > (1 - least) * (x[2] + y[2]):
        return None
    n = _common_words(x[0], y[0])
    if n < min(span, x[2], y[2]):
        return None
    return (x[1], y[1], n) if x[1] < y[1] else (y[1], x[1], n)


def _scan(span: int, least: float):
    """Links inside a piece; its first and last suffix come out as rows with ``edge`` 0 and 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        cols = ["a", "b", "n", "edge", "part", "suffix", "size", "lo", "hi"]
        part, before = TaskContext.get().partitionId(), None
        for b in batches:
            out, rows = [], list(zip(b["suffix"], b["tid"], b["size"], b["lo"], b["hi"]))
            if before is None and rows:
                s = rows[0]
                out.append((s[1], None, None, 0, part, s[0], s[2], s[3], s[4]))
            for row in rows:
                if before is not None and (link := _linked(before, row, span, least)):
                    out.append((*link, None, None, None, None, None, None))
                before = row
            yield _frame(out, cols)
        if before is not None:
            s = before
            yield _frame([(s[1], None, None, 1, part, s[0], s[2], s[3], s[4])], cols)

    return run


def _frame(rows: list, cols: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=cols, dtype=object)


_SUFFIX = "suffix string, tid binary, size int, lo bigint, hi bigint, train int, held int, plain boolean"
_SCANNED = "a binary, b binary, n int, edge int, part int, suffix string, size int, lo bigint, hi bigint"


def _edges(span: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if link := _linked((r.suffix, r.a, r.size, r.lo, r.hi), (r.suffix2, r.a2, r.size2, r.lo2, r.hi2), span, least):
                    out.append(link)
            yield pd.DataFrame(out, columns=["a", "b", "n"])

    return run


def near(wa: list[str], wb: list[str], names_a: str | None, names_b: str | None, span: int, least: float) -> float | None:
    """Share of the words of ``b`` that shared spans cover, if that makes the two nearly the same: the spans cover at least ``least`` of both
    and no name is exchanged, or both have the same words in another order."""
    covered = coverage(wa, wb, span)
    if covered >= least and coverage(wb, wa, span) >= least and same_names(wa, wb, names_a, names_b):
        return covered
    return covered if len(wa) == len(wb) and sorted(wa) == sorted(wb) else None


def _checked(span: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for a, b, na, nb, ma, mb in zip(f["a"], f["b"], f["norm_a"], f["norm_b"], f["names_a"], f["names_b"]):
                covered = near(na.split(" "), nb.split(" "), ma, mb, span, least)
                if covered is not None:
                    out.append((a, b, covered))
            yield pd.DataFrame(out, columns=["a", "b", "covered"]).astype({"covered": "float64"})

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("tid").alias("a"), F.col("norm").alias("norm_a"), F.col("names").alias("names_a"))
    right = texts.select(F.col("tid").alias("b"), F.col("norm").alias("norm_b"), F.col("names").alias("names_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "norm_a", "norm_b", "names_a", "names_b")


def _sorted_letters(ws):
    return F.transform(ws, lambda w: F.array_join(F.sort_array(F.split(w, "")), ""))


#: Bits of the map of keys: 512 kB, whatever the number of keys. Full or not, a key that is in it is never taken for absent.
BITS = 1 << 22


def _bitmap(keys: DataFrame) -> DataFrame:
    """One row with the map of the column ``key`` as an array of BITS / 64 numbers."""
    bit = F.pmod("key", F.lit(BITS))
    words = np.zeros(BITS // 64, np.int64)
    for r in keys.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key, {BITS}) % 64 as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("b")).collect():  # at most BITS / 64 rows
        words[r["word"]] = r["b"]
    return keys.sparkSession.createDataFrame([(words.tolist(),)], "bits array<bigint>")


#: Whether the bit of ``key`` is set; in compiled code the array is never copied.
_MARKED = f"shiftright(get(bits, cast(pmod(key, {BITS}) div 64 as int)), cast(pmod(key, {BITS}) % 64 as int)) & 1 = 1"


def _beyond_neighbours(texts: DataFrame, array: DataFrame, span: int, least: float) -> DataFrame:
    """a, b: the texts of two splits that may pass the check wherever they stand in the array, joined on what the check asks for.

    A pair of which a text shows names needs one of these in the other text: names meet adjacent words, each word by its letters in
    order, which a swap leaves as they are. Where neither shows any, suffixes meet that begin with the same ``span`` words. Texts of
    the same words in another order pass always and meet in the first of them. No partner is left out, however often a name stands;
    maps of words that differ too much go inside the join, which AQE can split.
    """
    cols = ["tid", "size", "lo", "hi", "train", "held"]
    named = (texts.where("names <> ''").select(*cols, F.explode(F.split("names", r"\|")).alias("name")).select(*cols, _sorted_letters(F.split("name", " ")).alias("w"))
             .select(*cols, F.xxhash64(F.col("w")[0], F.col("w")[1]).alias("key")).distinct())
    # adjacent words that no text shows as a name stay at home
    ws = _sorted_letters(F.split("norm", " "))
    keys = F.array_distinct(F.zip_with(F.expr("slice(w, 1, size - 1)"), F.expr("slice(w, 2, size - 1)"), lambda x, y: F.xxhash64(x, y)))
    every = texts.where("size > 1").select(*cols, ws.alias("w")).select(*cols, F.explode(keys).alias("key"))
    grams = beside(every, _bitmap(named.select("key").distinct())).where(_MARKED).select(*cols, "key")
    starts = array.where("plain").select(*cols, F.xxhash64(F.substring_index("suffix", " ", span)).alias("key")).distinct()

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        j = x.alias("x").join(y.alias("y"), F.expr(
            "x.key = y.key and x.tid <> y.tid and (x.train = 1 and y.held = 1 or x.held = 1 and y.train = 1) "
            f"and bit_count(x.lo ^ y.lo) + bit_count(x.hi ^ y.hi) <= {1 - least!r}D * (x.size + y.size)"))
        return j.select(F.least("x.tid", "y.tid").alias("a"), F.greatest("x.tid", "y.tid").alias("b"))

    bags = texts.select("tid", F.xxhash64(F.sort_array(F.split("norm", " "))).alias("bag"))
    moved = bags.join(bags.groupBy("bag").agg(F.min("tid").alias("a")), "bag").where("a <> tid").select("a", F.col("tid").alias("b"))
    return met(named, grams).unionByName(met(starts, starts)).unionByName(moved)


def _id(text: str):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


#: Suffixes of a piece of the array: about 30 MB.
PIECE = 200_000


def classes_of(pairs: DataFrame, window: int, span: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, texts, classes): members has tid, pair_id, split of every row with a split and words; classes has tid and label of every text."""
    rows = (pairs.select("pair_id", split_name(F.col("split")).alias("split"), "prompt").where("prompt is not null and pair_id is not null")
            .where(F.col("split").isin("train", "validation", "test")).withColumn("ph", _id("prompt")))
    flags = [F.max((F.col("split") == "train").cast("int")).alias("train"), F.max((F.col("split") != "train").cast("int")).alias("held")]
    prompts = rows.groupBy("ph").agg(F.first("prompt").alias("prompt"), *flags)
    known = land(prompts.mapInPandas(_normalised, "ph binary, norm string, names string, train int, held int, size int, lo bigint, hi bigint").where("norm <> ''").withColumn("tid", _id("norm")))
    texts = land(known.groupBy("tid").agg(F.first("norm").alias("norm"), F.max("names").alias("names"), F.max("train").alias("train"), F.max("held").alias("held"), *[F.first(c).alias(c) for c in ("size", "lo", "hi")]))
    shared = pairs.sparkSession.sparkContext.broadcast(sketch(texts))
    array = land(texts.select("tid", "norm", "names", "size", "lo", "hi", "train", "held").mapInPandas(_suffixes(window, shared), _SUFFIX))
    n = max(pairs.sparkSession.sparkContext.defaultParallelism, array.count() // PIECE + 1)
    scanned = land(array.select("suffix", "tid", "size", "lo", "hi").repartitionByRange(n, "suffix", "tid").sortWithinPartitions("suffix", "tid").mapInPandas(_scan(span, least), _SCANNED))
    # two rows a piece: their number is that of the pieces
    order = Window.orderBy("part", "edge")
    ends = scanned.where("edge is not null")
    nexts = ends.select("*", *[F.lead(c).over(order).alias(f"{c}2") for c in ("suffix", "a", "size", "lo", "hi", "part")]).where("edge = 1 and part2 is not null")
    across = nexts.select("suffix", "a", "size", "lo", "hi", "suffix2", "a2", "size2", "lo2", "hi2").mapInPandas(_edges(span, least), "a binary, b binary, n int")
    links = scanned.where("edge is null").select("a", "b", "n").unionByName(across).select("a", "b").unionByName(_beyond_neighbours(texts, array, span, least)).distinct()
    good = land(_with_texts(links, texts).mapInPandas(_checked(span, least), "a binary, b binary, covered double").select("a", "b"))
    # a link is an entity of its two texts; were the hashes of two links equal, their classes would meet and the check of pairs still keep them apart
    ends2 = good.select("a", "b", F.xxhash64("a", "b").alias("entity"))
    labels = components(ends2.select(F.col("a").alias("tid"), "entity").unionByName(ends2.select(F.col("b").alias("tid"), "entity")), "tid")
    members = rows.select("pair_id", "split", "ph").distinct().join(known.select("ph", "tid"), "ph").select("tid", "pair_id", "split")
    return members, texts, labels


def overlaps(pairs: DataFrame, window: int = 5, span: int = SPAN, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members, found): members has tid, pair_id, split; found has a (train text), b (other split's text) and covered (share of b's words)."""
    members, texts, labels = classes_of(pairs, window, span, least)
    flagged = labels.join(texts.select("tid", "train", "held", "size", "lo", "hi"), "tid")
    cross = flagged.where("train = 1").alias("x").join(flagged.where("held = 1").alias("y"), F.expr(
        f"x.label = y.label and x.tid <> y.tid and bit_count(x.lo ^ y.lo) + bit_count(x.hi ^ y.hi) <= {1 - least!r}D * (x.size + y.size)")).select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b"))
    near_ = _with_texts(cross, texts).mapInPandas(_checked(span, least), "a binary, b binary, covered double")
    same = texts.where("train = 1 and held = 1").select(F.col("tid").alias("a"), F.col("tid").alias("b"), F.lit(1.0).alias("covered"))
    return members, near_.unionByName(same)


def classes(pairs: DataFrame, window: int = 5, span: int = SPAN, least: float = LEAST) -> DataFrame:
    """pair_id, split, class_id (hex), n_train, n_held: the class of every pair and its distinct pairs on either side, without a pair written out."""
    members, _, labels = classes_of(pairs, window, span, least)
    m = members.join(labels, "tid", "left").select("pair_id", "split", F.lower(F.hex(F.coalesce("label", "tid"))).alias("class_id"))
    # counted by class and split first, so that a hot class is one row per split and task
    n = m.distinct().groupBy("class_id").agg(F.count(F.when(F.col("split") == "train", 1)).alias("n_train"), F.count(F.when(F.col("split") != "train", 1)).alias("n_held"))
    return m.distinct().join(n, "class_id").select("pair_id", "split", "class_id", "n_train", "n_held")


def pairs_found(pairs: DataFrame) -> DataFrame:
    """pair_id_a < pair_id_b: one in train, one in validation or test, with the same or nearly the same prompt."""
    members, found = overlaps(pairs)
    left = members.where("split = 'train'").select(F.col("tid").alias("a"), F.col("pair_id").alias("p"))
    right = members.where("split <> 'train'").select(F.col("tid").alias("b"), F.col("pair_id").alias("q"))
    return (found.select("a", "b").join(left, "a").join(right, "b").where("p <> q")
            .select(F.least("p", "q").alias("pair_id_a"), F.greatest("p", "q").alias("pair_id_b")).distinct())


def report(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """Per split and source: pairs, pairs whose prompt is also in train, and the mean covered share of those prompts' words."""
    members, found = overlaps(pairs)
    best = found.groupBy("b").agg(F.max("covered").alias("covered"))
    held = members.where("split <> 'train'").join(best, members["tid"] == best["b"], "left").select("pair_id", "split", "covered")
    of = pairs.select("pair_id", "record_id").distinct().join(raw.groupBy("id").agg(F.max("collection").alias("source")), F.col("record_id") == F.col("id"), "left")
    return (held.join(of.groupBy("pair_id").agg(F.max("source").alias("source")), "pair_id", "left").groupBy("split", "source")
            .agg(F.countDistinct("pair_id").alias("n_pairs"), F.countDistinct(F.when(F.col("covered").isNotNull(), F.col("pair_id"))).alias("n_overlapping"), F.round(F.avg("covered"), 6).alias("mean_covered")))

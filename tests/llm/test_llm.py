"""The operators for training data: against brute force on small data, and the defined edge cases."""

import itertools
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.llm import answers, consensus, copies, cross_split, grouped_splits, mixing, packing, pii, tokens
from prefloom.llm.text import canonical, content, fields, words

# ---- problem 1 ----

EV = "evaluation_id bigint, record_id string, source string, judge_model string, attempt int, judge_score double, status string, record string, judges string, grade int"


def judged(seed=3, items=400):
    """Simulated responses with known grades: good judges, a shifted one, an inverted one and a constant one."""
    g = np.random.default_rng(seed)
    truth, rows = {}, []
    for i in range(items):
        t = int(g.integers(1, 6))
        truth[f"r{i}"] = t
        for j in g.choice(9, 6, replace=False):
            k = t if g.random() < 0.8 else int(np.clip(t + g.choice([-1, 1]), 1, 5))
            k = min(5, k + 1) if j == 6 else 6 - k if j == 7 else 4 if j == 8 else k
            rows.append((len(rows), f"r{i}", "s", ["judge-a", "Judge-A "][i % 2] if j == 0 else f"judge_{j}", 1, float(k), "Success", "x", "y", 9))
    return truth, rows


def test_consensus_beats_mean_and_reads_judges(spark):
    truth, rows = judged()
    df = spark.createDataFrame(rows, EV)
    got = {r["record_id"]: r["grade"] for r in consensus.found(df).collect()}
    right = sum(got[k] == t for k, t in truth.items()) / len(truth)
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r[5])
    mean = sum(round(np.mean(v)) == truth[k] for k, v in by.items()) / len(truth)
    assert right > 0.9 and right > mean + 0.1
    rel = {r["judge_model"]: r for r in consensus.reliability(df).collect()}
    assert len(rel) == 9 and rel["judge-a"]["accuracy"] > 0.6 and rel["judge-8"]["information"] < 0.1 < rel["judge-7"]["information"] and rel["judge-6"]["bias"] > 0.4


def test_consensus_reports_convergence_and_weighs_patterns(spark):
    _, rows = judged(5, 120)
    df = spark.createDataFrame(rows, EV)
    m = consensus.fit(consensus.responses(df))
    assert m.converged and m.moved < 0.02 and len(m.dual) > 3 and all(b >= a - 1e-6 * abs(a) for a, b in zip(m.dual, m.dual[1:]))
    # everything three times is the same as weight 3, which is the same as less regularisation
    many = df.select("*").unionByName(df.withColumn("record_id", F.concat("record_id", F.lit("x")))).unionByName(df.withColumn("record_id", F.concat("record_id", F.lit("y"))))
    three, light = consensus.fit(consensus.responses(many)), consensus.fit(consensus.responses(df), alpha=1 / 3)
    assert abs(three.sigma - light.sigma).max() < 0.1
    with pytest.warns(UserWarning, match="not converged"):
        assert not consensus.fit(consensus.responses(df), passes=2).converged


def test_consensus_edges(spark):
    bad = [None, float("nan"), float("inf"), 0.0, 6.0]
    rows = [(i, "r", "s", f"j{i}", 1, x, "success", "", "", 0) for i, x in enumerate(bad)] + [(9, "r", "s", None, 1, 3.0, "success", "", "", 0), (10, "r", "s", " ", 1, 3.0, "success", "", "", 0), (11, "r", "s", "k", 1, 3.0, "failed", "", "", 0), (12, None, "s", "k", 1, 3.0, "success", "", "", 0), (13, "r", "s", "k", 1, 3.0, None, "", "", 0)]
    assert consensus.found(spark.createDataFrame(rows, EV)).count() == 0
    assert consensus.reliability(spark.createDataFrame([], EV)).count() == 0
    rows = [(i, "r", "s", j, a, x, "success", "", "", 0) for i, (j, a, x) in enumerate([("a", 1, 4.0), ("a", 1, 4.0), ("a", 2, 5.0), ("b", 1, 4.0), ("c", 1, 4.0), ("d", None, 4.0)])]
    df = spark.createDataFrame(rows, EV)
    assert {(r["judge"], r["score"]) for r in consensus.votes(df).collect()} == {("a", 4.5), ("b", 4.0), ("c", 4.0), ("d", 4.0)}
    assert [r["grade"] for r in consensus.found(df).collect()] == [4]
    two = spark.createDataFrame(rows[:4], EV)
    assert consensus.found(two).count() == 0
    with pytest.raises(ValueError, match="judges"):
        consensus.fit(consensus.responses(df), max_judges=2)


def test_fit_block_matches_loops():
    g = np.random.default_rng(0)
    item = np.array([0, 0, 1, 1, 1, 2])
    judge = np.array([0, 1, 0, 1, 2, 2])
    w = consensus.spread(g.integers(2, 11, 6) / 2)
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w @ np.arange(1, 6), g.__class__(np.random.PCG64(0)).integers(2, 11, 6) / 2)
    sigma, prior = g.normal(size=(3, 5, 5)), np.full(5, 0.2)
    q, gr, h, _ = consensus.fit_block(item, judge, w, 3, sigma, prior, 4.0, rounds=1)
    for i in range(3):
        ll = np.log(prior)
        for o in np.flatnonzero(item == i):
            for c in range(5):
                p = np.exp(sigma[judge[o], c]) / np.exp(sigma[judge[o], c]).sum()
                ll[c] += (w[o] * np.log(p)).sum()
        want = np.exp(ll - ll.max())
        assert np.allclose(q[i], want / want.sum(), atol=1e-6)
    want = np.zeros((3, 5, 5))
    for o in range(6):
        for c in range(5):
            p = np.exp(sigma[judge[o], c]) / np.exp(sigma[judge[o], c]).sum()
            want[judge[o], c] += q[item[o], c] * (w[o] - p)
    assert np.allclose(gr, want, atol=1e-6)


# ---- problem 2 ----

PROMPT = "How can a tired nurse plan the rota? The people at Veld Norr say that money is short."


@pytest.mark.parametrize("prompt,answer,defect", [
    (PROMPT, None, "empty"), (PROMPT, "", "empty"), (PROMPT, " ​\n", "empty"), (PROMPT, "N/A", "empty"), (PROMPT, "[no answer]", "empty"), (PROMPT, "...", "empty"),
    (PROMPT, "N/A" + " " * 80, "empty"), (PROMPT, "[no response]" + "-" * 60, "empty"), (PROMPT, "Keep what helped (" + "at least for now and for the coming weeks " * 4 + "of rest)", None), (PROMPT, "Keep it short (see (a) of " + "the plan that we made " * 5 + "(b)) and", "truncated"),
    (PROMPT, PROMPT, "copies_prompt"), (PROMPT, "You asked: " + PROMPT.upper(), "copies_prompt"), (PROMPT, PROMPT + "\n\n" + PROMPT, "copies_prompt"), (PROMPT, '"' + re.sub(" ", "  ", PROMPT) + '"', "copies_prompt"),
    ("Task: a b; Tone: calm and warm", "Tone: calm and warm\nTask: a b", "copies_prompt"),
    (PROMPT, "I'm sorry, but I can't help with that.", "refusal"), (PROMPT, "Thank you for asking! However, I have to pass on this one. Is there anything else I can do for you?", "refusal"), (PROMPT, "Je ne suis pas en mesure de vous aider sur ce point.", "refusal"),
    (PROMPT, "Das kann ich leider nicht beantworten.", "refusal"), (PROMPT, "Lo siento, no puedo ayudarte con eso.", "refusal"), (PROMPT, "Non mi è consentito rispondere.", "refusal"),
    (PROMPT, "Start small. Then look at what the", "truncated"), (PROMPT, "Start small. Then,", "truncated"), (PROMPT, "Start small.\n- one step\n-", "truncated"), (PROMPT, "Start small.\n\n##", "truncated"), (PROMPT, "Start small (at home.", "truncated"), (PROMPT, "Use this:\n```\ncode.", "truncated"),
    (PROMPT, "Fang klein an und schau nach zwei Wochen, ob es dir hilft. Das ist nicht schwer.", "other_language"), (PROMPT + " Antworte bitte auf Deutsch.", "Start small and look at what helps. That is all you need.", "other_language"), (PROMPT, "Начните с малого и посмотрите.", "other_language"),
    (PROMPT, PROMPT + "\n\nStart small. Look at what helps. Then decide together.", None), (PROMPT, "I'm sorry to hear that. Start small and see what helps you both.", None), (PROMPT, 'If someone says "I won\'t answer that", give them time.', None), (PROMPT, "I can't recommend silence, but here is what does work: a walk every day.", None),
    (PROMPT, "That is enough for a first week :)", None), (PROMPT, "Keep what helped (at least for now)", None), (PROMPT, "Good luck, and be patient 🌱", None), (PROMPT + " Antworte bitte auf Deutsch.", "Fang klein an und schau nach zwei Wochen, ob es dir hilft.", None), (None, "Start small. Then rest.", None), ("", "Fang klein an und ruh dich aus.", None),
])
def test_defects(spark, prompt, answer, defect):
    import pandas as pd

    f = pd.DataFrame([("raw", "1", "s", prompt, answer)], columns=["origin", "record_key", "slot", "prompt", "answer"])
    found = [d for b in answers._rules(iter([f])) for d in b["defect"]]
    assert (sorted(found, key=answers.ORDER.index)[0] if found else None) == defect, found


def test_answers_tables(spark):
    lists = "Do this.\n- one hour for the plan\n- time for quiet work\n- a talk with the team\n- time for quiet work"
    raw = spark.createDataFrame([(n, PROMPT, {"a": lists, "b": None}, "x") for n in range(5)] + [(7, PROMPT, {"a": "Do this.\n- a talk with the team\n- one hour for the"}, "x"), (8, PROMPT, {"a": "Do this.\n- a talk with the team\n- one hour for the plan", "c": lists}, "x"), (9, None, None, "x")], "row_no bigint, instruction string, responses map<string,string>, answer string")
    pairs = spark.createDataFrame([("p", PROMPT, "I cannot assist with this request.", "Fine. Do it.", 1), ("p", PROMPT, "I cannot assist with this request.", "Fine. Do it.", 1), (None, PROMPT, None, None, 1)], "pair_id string, prompt string, chosen string, rejected string, slot int")
    got = {tuple(r) for r in answers.found(raw, pairs).collect()}
    assert got == {("raw", str(n), "b", "empty") for n in range(5)} | {("raw", "7", "a", "truncated"), ("dpo_pairs", "p", "chosen", "refusal")}
    assert answers.found(raw.limit(0), pairs.limit(0)).count() == 0
    both = spark.createDataFrame([("q", PROMPT, "Das kann ich leider nicht beantworten, weil", "Fine. Do it.", 1)], pairs.schema)
    assert {tuple(r)[1:] for r in answers.defects(answers.answers(raw.limit(0), both)).collect()} == {("q", "chosen", d) for d in ("refusal", "truncated", "other_language")}


# ---- problem 4 ----

def test_canonical():
    assert canonical("Hello, World!") == canonical("  hello​ world ") == "helloworld"
    assert canonical("about 7.5 hours") != canonical("about 75 hours") and canonical("e-mail") == canonical("E–MAIL")
    a = "Task: share the plan; Audience: shy cook; Tone: calm"
    for b in ("TONE: CALM | TASK: SHARE THE PLAN | AUDIENCE: SHY COOK", "- **Audience:** shy cook.\n- **Tone:** calm.\n- **Task:** share the plan.", json.dumps({"Tone": "calm", "Audience": "shy cook", "Task": "share the plan"})):
        assert canonical(a) == canonical(b)
    assert canonical(a) != canonical(a.replace("calm", "warm")) and fields("Background: a b. Help me. Please answer: yes") is None
    assert canonical(None) == canonical("") == canonical(" ?! ") == "" and content("3-20") == "3-20" and words("We don't, 7.5!") == ["we", "don't", "7.5"]


@pytest.mark.parametrize("fit", [2, 50_000])
def test_copies_against_brute_force(spark, fit):
    rnd = random.Random(fit)
    base = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))) for _ in range(120)] + ["prefix" * 9 + str(k) for k in range(30)]
    rows = []
    for n in range(900):
        t = base[0] if n % 3 == 0 else rnd.choice(base)
        rows.append((n, rnd.choice([t, t.upper(), f" {t}!", " ".join(t), f"“{t}”", f"{t}​"]), 1))
    rows += [(1000, None, 1), (1001, " ", 1), (1002, "?!", 1), (1003, "?!", 1), (None, "ab", 1)]
    df = spark.createDataFrame(rows, "row_no bigint, instruction string, n int").repartition(5)
    groups = defaultdict(list)
    for n, t, _ in rows:
        if n is not None and t and canonical(t):
            groups[canonical(t)].append(n)
    want = {(min(v), n) for v in groups.values() for n in v if n > min(v)}
    got = copies.collapse(df, "row_no", "instruction", fit=fit, step=1)
    assert {(r["canon"], r["first"], r["n"]) for r in got.collect()} == {(k, min(v), len(v)) for k, v in groups.items()}
    assert {tuple(r) for r in copies.copies_found(df).collect()} == want
    assert copies.copies_found(df.limit(0)).count() == 0


def test_copies_with_a_long_shared_beginning(spark):
    """A third of the rows is one text, the others share its first hundred characters: the bucket splits behind what they share, at the production fit."""
    pre = "the same long beginning of all requests " * 3
    n = 150_000
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("row_no"), F.when(F.col("id") % 3 == 0, F.lit(pre + "!")).otherwise(F.concat(F.lit(pre), F.md5(F.col("id").cast("string")), F.when(F.col("id") % 3 == 1, "").otherwise("."))).alias("instruction"))
    df = df.unionByName(spark.createDataFrame([(n, pre + "0" * 31), (n + 1, pre.upper() + " " + "0" * 31)], "row_no bigint, instruction string"))
    got = {tuple(r) for r in copies.copies_found(df).collect()}
    assert got == {(0, k) for k in range(3, n, 3)} | {(n, n + 1)}
    # an oversized bucket of one string is added up without a trie, whatever the fit
    few = df.where(f"row_no < 3000 or row_no >= {n}")
    for fit in (40, 4000, 200_000):
        assert {(r["first"], r["n"]) for r in copies.collapse(few, "row_no", "instruction", fit=fit, held=10_000).where("n > 1").collect()} == {(0, 1000), (n, 2)}


def test_trie():
    t = copies.Trie()
    rnd = random.Random(1)
    want = defaultdict(lambda: [10**9, 0])
    for i in range(3000):
        k = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))).encode()
        t.add(k, i, 1)
        want[k] = [min(want[k][0], i), want[k][1] + 1]
    assert {k: [f, n] for k, f, n in t.terminals()} == dict(want)


# ---- problem 5 ----

PAIRS = "pair_id string, split string, prompt string, record_id string, tid int, norm string"


def requests(seed=2, n=60):
    """Requests about invented places; some again with slips, moved sentences or another place, over all splits."""
    rnd = random.Random(seed)
    name = lambda: " ".join("".join(rnd.choice(x) for x in ("vnkt", "aeiou", "lrmd", "aeiou", "gbsz", "aeiou", "lrnk")).capitalize() for _ in range(2))
    rows, truth = [], []
    tasks = ["plan the rota", "share the garden map", "review a podcast script", "protect the quiet hour", "finish a savings target"]
    for k in range(n):
        who, place, num = rnd.choice(["tired nurse", "shy cook", "new tiler"]), name(), rnd.randint(2, 90)
        s = [f"How can a {who} {rnd.choice(tasks)} in a mountain school?", f"In the {place} team the schedule keeps changing, so a wall planner made things worse.", f"Give {num} examples from daily work."]
        t = " ".join(s)
        forms = [t, t.upper(), t.replace("schedule", "schedlue"), " ".join([s[1], s[0], s[2]]), t.replace(str(num), str(num + 1)), "Hello! " + t + " Thanks."]
        other = t.replace(place, name())
        for f in [t, *rnd.sample(forms, 2)]:
            rows.append((f"p{len(rows)}", rnd.choice(["train", "Train ", "val", "test", "dev", None]), f, "r", 1, "n"))
            truth.append((k, 0))
        rows.append((f"p{len(rows)}", rnd.choice(["train", "test"]), other, "r", 1, "n"))
        truth.append((k, 1))
    return rows, truth


def test_cross_split(spark):
    rows, truth = requests()
    side = lambda s: None if s is None else {"val": "validation", "dev": "validation"}.get(s.strip().lower(), s.strip().lower())
    want = set()
    for (a, ta), (b, tb) in itertools.combinations(zip(rows, truth), 2):
        x, y = side(a[1]), side(b[1])
        if ta == tb and x and y and (x == "train") != (y == "train"):
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    df = spark.createDataFrame(rows + [("q1", "train", None, "r", 1, "n"), ("q2", "test", " ", "r", 1, "n"), (None, "test", rows[0][2], "r", 1, "n")], PAIRS).repartition(6)
    got = {tuple(r) for r in cross_split.pairs_found(df).collect()}
    assert got == want and len(want) > 40
    # many small pieces: neighbours mostly lie across their edges
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert {tuple(r) for r in cross_split.pairs_found(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert cross_split.pairs_found(df.limit(0)).count() == 0
    raw = spark.createDataFrame([("r", "c")], "id string, collection string")
    rep = cross_split.report(df, raw).collect()
    assert sum(r["n_pairs"] for r in rep) == sum(side(r[1]) not in (None, "train") and bool(r[2].strip()) for r in rows) and {r["source"] for r in rep} == {"c"}


def test_cross_split_goes_past_refused_neighbours(spark):
    """Hundreds of texts about one hot name, and copies with four numbers changed or a text turned to lower case: all pairs, as brute force has them."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(300)]
    pools = [[" ".join(rnd.choice(vocabulary) for _ in range(8)) + f" {i} {rnd.randint(10, 99)}" for i in range(30)] for _ in range(4)]
    base = ["In the Veld Norr team " + " ".join(rnd.choice(p) for p in pools) for _ in range(450)]
    changed = lambda t: re.sub(r"\d{2}\b", lambda m: str(rnd.randint(100, 999)), t)
    prompts = [(t, "train") for t in base] + [(changed(t), "test") for t in base[:80]] + [(changed(t).lower(), "test") for t in base[80:100]] + [(t.lower(), "validation") for t in base[100:110]]
    df = spark.createDataFrame([(f"p{i}", s, p, "r", 1, "n") for i, (p, s) in enumerate(prompts)], PAIRS)
    w, names = [words(p) for p, _ in prompts], [cross_split.names_in(p) for p, _ in prompts]
    want = set()
    for i, j in itertools.product(range(450), range(450, len(prompts))):
        if cross_split.near(w[i], w[j], names[i], names[j], cross_split.SPAN, cross_split.LEAST) is not None:
            want.add((min(f"p{i}", f"p{j}"), max(f"p{i}", f"p{j}")))
    got = {tuple(r) for r in cross_split.pairs_found(df).collect()}
    assert got == want and len(want) >= 110


def test_cross_split_long_texts(spark):
    """Texts of 8,000 words, one copied with a few words changed and one word of 5,000 letters: found, and the array stays in proportion to the text."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    long = [[rnd.choice(vocabulary) for _ in range(8000)] for _ in range(3)]
    near = [w if rnd.random() > 0.03 else rnd.choice(vocabulary) for w in long[0]]
    huge = "x" * 5000
    rows = [("a", "train", " ".join(long[0]), "r", 1, "n"), ("b", "test", " ".join(near), "r", 1, "n"), ("c", "train", " ".join(long[1]), "r", 1, "n"), ("d", "dev", " ".join(long[2]), "r", 1, "n"), ("e", "train", f"say {huge} again and again", "r", 1, "n"), ("f", "test", f"Say {huge} again, and again!", "r", 1, "n")]
    df = spark.createDataFrame(rows, PAIRS)
    assert {tuple(r) for r in cross_split.pairs_found(df).collect()} == {("a", "b"), ("e", "f")}
    got = {r["pair_id"]: r for r in cross_split.classes(df).collect()}
    assert got["a"]["class_id"] == got["b"]["class_id"] and (got["a"]["n_train"], got["a"]["n_held"], got["c"]["n_held"]) == (1, 1, 0) and len(got) == 6

    class Shared:
        value = None

    import pandas as pd

    text = pd.DataFrame([(b"x" * 16, " ".join(long[0]), None, 8000, 0, 0, 1, 0)], columns=["tid", "norm", "names", "size", "lo", "hi", "train", "held"])
    size = sum(f["suffix"].str.len().sum() for f in cross_split._suffixes(5, Shared)(iter([text])))
    assert size < 10 * len(text["norm"][0])


def test_winnowing_guarantee():
    rnd = random.Random(5)
    for _ in range(200):
        span = [rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(6, 20))]
        noise = lambda: [str(rnd.random()) for _ in range(rnd.randint(0, 9))]
        a, b = noise(), noise()
        x, y = a + span + noise(), b + span + noise()
        px = {i - len(a) for i in cross_split.winnowed(x, 6)} & set(range(len(span)))
        py = {i - len(b) for i in cross_split.winnowed(y, 6)} & set(range(len(span)))
        assert px & py
    assert cross_split._common_words("a b cc", "a b cd") == 2 and cross_split._common_words("a b", "a b c") == 2 and cross_split._common_words("ab", "abc") == 0 and cross_split._common_words("a b", "a b") == 2


def test_names():
    assert cross_split.names_in("In the Veld Norr team we rest.\nTone: calm") == "veld norr" and cross_split.names_in("in the veld norr team") is None
    a, b = "in the veld norr team we rest".split(), "in the vedl norr team we sleep".split()
    assert cross_split.same_names(a, b, "veld norr", None) and not cross_split.same_names(a, "in the gara bolm team we rest".split(), "veld norr", "gara bolm")
    assert not cross_split.same_names(a, "in the gara bolm team we rest".split(), None, None)


# ---- problem 6 ----

def test_components_and_splits(spark):
    rnd = random.Random(4)
    pairs, raw = [], []
    for r in range(300):
        a = rnd.choice([f"au{rnd.randint(0, 200)}", None, "", "unknown", " Unknown "])
        raw.append((f"r{r}", a, 5))
        for p in rnd.sample(range(400), rnd.randint(0, 2)):
            pairs.append((f"x{len(pairs)}", f"{p:03}", f"r{r}", rnd.choice(["train", "val", "test", None, "TEST"]), rnd.choice(["high", "low"]), 1))
    chain = [(f"c{i}", f"z{i // 2 * 2 + (i % 2):03}", f"k{(i + 1) // 2}", "train" if i < 60 else "test", "high", 1) for i in range(120)]
    pairs += chain + [("n", None, "r1", "train", "low", 1)]
    df = spark.createDataFrame(pairs, "pair_id string, prompt_id string, record_id string, split string, label_confidence string, label int")
    rw = spark.createDataFrame(raw + [raw[0]], "id string, author_id string, label int")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    author = {r: a for r, a, _ in raw if (a or "").strip().lower() not in ("", "unknown")}
    for _, p, r, *_ in pairs:
        if p:
            parent[find("p" + p)] = find("r" + r)
            if r in author:
                parent[find("r" + r)] = find("a" + author[r])
    groups, at = defaultdict(set), defaultdict(set)
    for _, p, r, s, *_ in pairs:
        if p:
            groups[find("p" + p)].add(p)
            if s:
                at[find("p" + p)].add({"val": "validation"}.get(s.lower(), s.lower()))
    want = {(p, min(v)) for k, v in groups.items() if len(at[k]) > 1 for p in v}
    assert {tuple(r) for r in grouped_splits.separated(df, rw).collect()} == want and want
    out = grouped_splits.assign(df, rw).collect()
    assert {r["group_prompt_id"] for r in out} == {min(v) for v in groups.values()} and len(out) == len(groups)
    n = Counter()
    for r in out:
        n[r["split"]] += r["n_pairs"]
    total = sum(n.values())
    assert total == len(pairs) - 1 and abs(n["train"] / total - 0.7) < 0.25
    assert grouped_splits.separated(df.limit(0), rw.limit(0)).count() == 0 and grouped_splits.assign(df.limit(0), rw.limit(0)).count() == 0


def test_assignment_shares(spark):
    df = spark.createDataFrame([(f"p{i}", f"{i % 1500:05}", f"r{i % 1500}", "train", "high" if i % 3 else "low") for i in range(4000)], "pair_id string, prompt_id string, record_id string, split string, label_confidence string")
    rw = spark.createDataFrame([("r0", None)], "id string, author_id string")
    n = Counter()
    for r in grouped_splits.assign(df, rw).collect():
        n[r["split"]] += r["n_pairs"]
    assert abs(n["train"] / 4000 - 0.7) < 0.02 and abs(n["validation"] / 4000 - 0.15) < 0.02


def test_assignment_of_pairs_with_a_hot_author(spark):
    """One author has a third of 9,000 pairs: one group, and every pair gets the split of its group, shares within two hundredths."""
    n = 9000
    df = spark.range(n).select(F.concat(F.lit("p"), "id").alias("pair_id"), F.format_string("%05d", F.col("id") % 4500).alias("prompt_id"), F.concat(F.lit("r"), F.col("id") % 4500).alias("record_id"), F.lit("train").alias("split"), F.when(F.col("id") % 3 == 0, "high").otherwise("low").alias("label_confidence"))
    rw = spark.range(4500).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") < 1500, "one").alias("author_id"))
    out = grouped_splits.assign_pairs(df.unionByName(df.limit(5)), rw).collect()
    count = Counter(r["split"] for r in out)
    assert len(out) == n and abs(count["train"] / n - 0.7) < 0.02 and abs(count["validation"] / n - 0.15) < 0.02 and abs(count["test"] / n - 0.15) < 0.02
    assert {r["group_prompt_id"] for r in out if r["prompt_id"] < "01500"} == {"00000"} and len({r["split"] for r in out if r["prompt_id"] < "01500"}) == 1
    assert all(r["group_prompt_id"] == r["prompt_id"] for r in out if r["prompt_id"] >= "01500")


# ---- problem 7 ----

@pytest.mark.parametrize("seed", range(6))
def test_packing_counts(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 100, 512])
    sizes = [min(cap, max(1, int(rnd.expovariate(3 / cap)))) if seed % 2 else rnd.randint(1, cap) for _ in range(2000)]
    patterns = packing.pack_counts(Counter(sizes), cap)
    again = Counter()
    for p, n in patterns:
        assert 0 < sum(p) <= cap and n > 0 and sum(3 * s > cap for s in p) <= 2
        for s in p:
            again[s] += n
    assert again == Counter(sizes)
    # no worse than first-fit decreasing by more than one container in fifty
    bins = []
    for s in sorted(sizes, reverse=True):
        k = next((i for i, b in enumerate(bins) if b + s <= cap), None)
        if k is None:
            bins.append(s)
        else:
            bins[k] += s
    assert sum(n for _, n in patterns) <= len(bins) * 1.02 + 1
    assert packing.pack_counts({}, 5) == [] and packing.pack_counts({5: 2}, 5) == [((5,), 2)]


def test_pack(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 1, 5, 7, 40, 99, 100, 101, 250, 333]) if i % 3 else 7) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, n_tokens bigint")
    got = packing.pack(df, 100).collect()
    per, fill = defaultdict(list), Counter()
    for r in got:
        per[r["id"]].append((r["piece_no"], r["size"]))
        fill[r["container_no"]] += r["size"]
    assert max(fill.values()) <= 100 and set(fill) == set(range(len(fill)))
    for i, n in rows:
        assert sorted(per[i]) == [(k, min(100, n - 100 * k)) for k in range(-(-n // 100))]
    assert packing.pack(df.limit(0), 100).count() == 0


def test_packed_documents(spark):
    docs = spark.createDataFrame([(1, "one two three " * 50, 3, 4), (2, "", 3, 4), (3, None, 3, 4), (4, "short text", 3, 4), (None, "x", 3, 4), (5, "short text", 3, 4)], "doc_id bigint, text string, size int, rank int")
    kinds = spark.createDataFrame([("k", 64), ("k", 64), (None, 3), ("z", 0)], "container_kind string, capacity_tokens int")
    out = packing.packed(docs, kinds)
    rows = out.collect()
    enc = tokens.encoder()
    assert sum(r["size"] for r in rows) == sum(len(enc.encode_ordinary(t)) for t in ("one two three " * 50, "short text", "short text"))
    assert {r["id"] for r in rows if r["container_no"] is None} == {2, 3}
    u = packing.usage(out, kinds).first()
    assert u["containers"] >= u["least_containers"] and 0 < u["used"] <= 1
    assert packing.packed(docs.limit(0), kinds).count() == 0 and packing.packed(docs, kinds.limit(0)).count() == 0


# ---- problem 8 ----

DOCS = "doc_id bigint, text string, source string, id string, k int, w int"
MIX = "mix_name string, source string, target_share double, max_repeats int"


def test_mixing_goes_past_long_documents(spark):
    """Documents of about 10 tokens and one of 600 that comes early: the budget of 300 is met by the short ones all the same; equal sizes packed, too."""
    docs = spark.createDataFrame([(i, "word " * (600 if i == 7 else 10), "one") for i in range(90)] + [(i, "word " * 10, "two") for i in range(100, 130)], "doc_id bigint, text string, source string")
    mix = spark.createDataFrame([("m", "one", 0.5, 1), ("m", "two", 0.5, 1)], MIX)
    for seed in range(3):
        got = {r["source"]: r["actual_share"] for r in mixing.report(docs, mix, seed=seed).collect()}
        assert abs(got["one"] - 0.5) < 0.02, (seed, got)
    cut = spark.createDataFrame([(0, 100_000), (1, 7), (2, 7)], "id bigint, n_tokens bigint")
    out = packing.pack(cut, 10).collect()
    room = Counter()
    for r in out:
        room[r["container_no"]] += r["size"]
    assert len(out) == 10_002 and max(room.values()) <= 10 and len(room) == 10_002 and len({(r["id"], r["piece_no"]) for r in out}) == 10_002


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["plan", "rest", "talk", "walk"]) for _ in range(rnd.randint(1, 60))), ["big", "Big ", "b_ig" if False else "BIG"][i % 3] if i % 5 else "small_one", "x", 1, 1) for i in range(1500)]
    rows += [(9001, None, "big", "x", 1, 1), (9002, "", "big", "x", 1, 1), (9003, "lost words", None, "x", 1, 1), (9004, "other", "elsewhere", "x", 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    mix = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small-one", 0.4, 3), ("m", "missing", 0.1, 2), ("even", "big", 0.5, None), ("even", "small-one", 0.5, 1), (None, "big", 1.0, 1)], MIX)
    chosen, _ = mixing.mixed(docs, mix)
    got = chosen.collect()
    assert max(Counter((r["mix_name"], r["id"]) for r in got).values()) == 1
    assert all(1 <= r["repeats"] <= (3 if r["source"] == "small-one" and r["mix_name"] == "m" else 1) for r in got)
    share = {(r["mix_name"], r["source"]): r for r in mixing.report(docs, mix).collect()}
    assert abs(share["m", "small-one"]["actual_share"] - 4 / 9) < 0.02 and share["m", "missing"]["tokens"] == 0 and abs(share["even", "big"]["actual_share"] - 0.5) < 0.02
    # complete epochs come first: a source used twice has every document at least once
    many = {r["id"]: r["repeats"] for r in got if r["source"] == "small-one" and r["mix_name"] == "m"}
    assert max(many.values()) < 2 or len(many) == sum(r[2] == "small_one" for r in rows)
    again = mixing.mixed(docs.repartition(7), mix)[0].collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    small = {r["source"]: r["tokens"] for r in mixing.report(docs, mix.where("mix_name = 'even'"), total=1000).collect()}
    assert all(abs(x - 500) < 60 for x in small.values())
    assert mixing.mixed(docs.limit(0), mix)[0].count() == 0 and mixing.report(docs.limit(0), mix).count() == 5


# ---- problem 9 ----

def people():
    heads, tails = ["bram", "drav", "fenn", "gors", "hald"], ["elius", "enko", "hollow", "lund", "mont"]
    fam = [(h + t).capitalize() for h in heads for t in tails][:-3]
    given = ["Eskil", "Anneke", "Mark", "Hope", "Zofia"]
    return [(given[i % 5] if i % 7 else None, f if i % 6 else f.upper()) for i, f in enumerate(fam)]


def texts():
    """Texts with known mentions: each sentence marks its mention with {...|type}."""
    rnd = random.Random(8)
    fam = ["Bramelius", "Halderling" if False else "Haldmont", "Gorslund", "Haldhollow"]
    parts = []
    for i in range(400):
        g, f = rnd.choice(["Eskil", "Anneke", "Zofia", "Carys"]), rnd.choice(fam)
        d = f"{rnd.randint(0, 99):02}"
        s = [f"My name is {{{g} {f}|person_name}} and I label the evening batch.", f"According to Dr. {{{f}|person_name}}, the answer is too long.", f"Call {{212-555-01{d}|phone}} if the viewer hangs.", f"My number is {{+49 30 23125-1{d}|phone}}, evenings only.",
             f"Send the form to {{{g.lower()}.{f.lower()}@lab.fennsted.example|email}}, thanks.", f"The account {{{f.lower()}{d} (at) tolvane dot example|email}} was locked.", f"SSN: {{9{d}-12-34{d}|id_number}}", f"She showed passport {{X0{d}12345|id_number}} at the door.",
             f"I moved to {{Flat 2, 1{d} Copperleaf Road|street_address}} last month.", f"Mon adresse : {{1{d} bis, rue des Quatre-Lanternes|street_address}}.", f"We met at {{2{d}B Ninefold Ave.|street_address}} and read.", "Mark the row and move on.", "Hope is not a plan.", f"Score@{d} rose from 0.25 to 0.30.",
             "Ask @channel before you change it.", f"Ticket 907-2{d}-153 is closed.", f"Run 2024-06{d}-0132 used batch ZZ-1{d}.", "Judge Alder and Judge Birch disagree.", "Lantern Hall hosts the meeting.", "See section 9.2.3 of version 10.3.2.7."]
        parts.append("\n".join(rnd.sample(s, 9)))
    out, truth = [], set()
    for i, t in enumerate(parts):
        plain, marks, at = "", re.split(r"\{([^|}]+)\|(\w+)\}", t), 0
        for k in range(0, len(marks), 3):
            plain += marks[k]
            if k + 2 < len(marks):
                truth.add((i, marks[k + 2], len(plain)))
                plain += marks[k + 1]
        out.append((i, plain, "x"))
    return out, truth


def test_pii_recall_and_precision(spark):
    rows, truth = texts()
    roster = spark.createDataFrame(people(), "given_name string, family_name string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, s string").repartition(3)
    got = {tuple(r) for r in pii.found(docs, roster).collect()}
    for t in pii.TYPES:
        w, g = {x for x in truth if x[1] == t}, {x for x in got if x[1] == t}
        assert len(w & g) / len(w) > 0.95 and len(w & g) / len(g) > 0.95, (t, len(w), len(g), list(w - g)[:3], list(g - w)[:3])
    red = {r["doc_id"]: r for r in pii.redacted(docs, roster).collect()}
    assert len(red) == len(rows) and all("@lab" not in r["text"] for r in red.values()) and "[EMAIL]" in " ".join(r["text"] for r in red.values())
    untouched = next(i for i, _, _ in rows)
    assert red[untouched]["text"].count("[") >= sum(x[0] == untouched for x in truth)


def test_pii_in_sentences_never_seen(spark):
    """Sentences that no labeler and no other text knows, social security numbers without a word of context, and a short family name."""
    rows, _ = texts()
    frames = ["Our file lists {n|person_name}; kindly forward the leaflet.", "Please note {s|id_number} for the records of the clinic.", "Grandmother keeps {s|id_number} on a slip in her purse.", "Yesterday {n|person_name} repaired the garden gate.", "Parcels for the choir belong to {a|street_address}, behind the bakery.",
              "Whoever rings {p|phone} hears the caretaker.", "Invoices travel through {e|email} every Friday.", "The choir met {n|person_name} beside the lake.", "They found the keys at {a|street_address} last night.", "Dial {p|phone} when the boiler stops.", "A slip with {s|id_number} lay under the mat.", "Post the photos via {e|email} instead.", "Then {r|person_name} slept."]
    rnd = random.Random(2)
    new, truth = [], set()
    for i in range(130):
        k = 10_000 + i
        value = {"n": f"{rnd.choice(['Eskil', 'Anneke', 'Zofia'])} {rnd.choice(['Bramelius', 'Gorslund', 'Dravmont'])}", "s": f"{rnd.randint(101, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", "a": f"{rnd.randint(3, 900)} {rnd.choice(['Copperleaf Road', 'Wexley Avenue', 'Harrow Lane'])}",
                 "p": f"+1 {rnd.randint(201, 989)} 555 0{rnd.randint(100, 199)}", "e": f"{rnd.choice(['office', 'j.hill', 'kim_3'])}@{rnd.choice(['mail', 'post'])}.example", "r": "Zofia Ruiz"}
        a, name, kind, b = re.fullmatch(r"(.*)\{(\w)\|(\w+)\}(.*)", frames[i % len(frames)]).groups()
        new.append((k, a + value[name] + b, "x"))
        truth.add((k, kind, len(a)))
    roster = spark.createDataFrame([*people(), ("Zofia", "Ruiz")], "given_name string, family_name string")
    got = {tuple(r) for r in pii.found(spark.createDataFrame(rows + new, "doc_id bigint, text string, s string"), roster).collect() if r["doc_id"] >= 10_000}
    for t in pii.TYPES:
        w, g = {x for x in truth if x[1] == t}, {x for x in got if x[1] == t}
        assert len(w & g) / len(w) >= 0.95 and len(w & g) / len(g) >= 0.95, (t, len(w), len(g), [new[x[0] - 10_000] for x in w - g][:4], list(g - w)[:3])


def test_pii_given_names_are_counted_over_all_documents(spark):
    n = 20_000
    named = {7: "I talked to Ilvara Bramelius about the batch.", 5007: "Later Ilvara Gorslund read the notes.", 11007: "We asked Ilvara Haldmont to stay.", 17007: "Here Ilvara Fennmont wrote the rest."}
    rows = [(i, named.get(i, "Meanwhile the batch was read again and nothing else changed.")) for i in range(n)] + [(n, "thanks to ilvara bramelius for the careful notes")]
    roster = spark.createDataFrame(people(), "given_name string, family_name string")
    got = {tuple(r) for r in pii.found(spark.createDataFrame(rows, "doc_id bigint, text string"), roster).collect()}
    assert (n, "person_name", 10) in got
    # a common word that stands there by chance is none, however large the table is
    chance = [(i, "Meanwhile Bramelius slept." if i < 5 else "Meanwhile the batch was read again.") for i in range(2000)]
    names = pii.Names(*({x for x in c if x} for c in zip(*people())))
    assert pii.given_names(spark.createDataFrame(rows + chance, "doc_id bigint, text string"), names, 10) == {"ilvara"}
    with pytest.raises(ValueError, match="given names"):
        pii.given_names(spark.createDataFrame(rows, "doc_id bigint, text string"), names, 0)


def test_pii_edges(spark):
    roster = spark.createDataFrame(people() + [(None, None)], "given_name string, family_name string")
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Call 212-555-0100."), (3, "𝔘𝔫𝔦 🌱 mail a.b@c.example now"), (4, "x" * 50_000)], "doc_id bigint, text string")
    got = {tuple(r) for r in pii.found(docs, roster).collect()}
    assert got <= {(3, "email", 11)}
    assert pii.found(docs.limit(0), roster).count() == 0 and pii.found(docs.limit(0), roster.limit(0)).count() == 0
    assert {r["doc_id"] for r in pii.redacted(docs, roster).collect()} == {1, 2, 3, 4, None}
    with pytest.raises(ValueError, match="roster"):
        pii.found(docs, roster, ) if False else pii.mentions(docs, roster, max_roster=3)


def test_weak_supervision():
    g = np.random.default_rng(1)
    n = Counter()
    keep = {}
    for _ in range(4000):
        y = g.random() < 0.4
        v = tuple(int((1 if y else -1) * (1 if g.random() < a else -1)) if g.random() < 0.8 else 0 for a in (0.9, 0.85, 0.8, 0.55))
        n[v] += 1
        keep.setdefault(v, []).append(y)
    p = pii.reliabilities(sorted(n.items()))
    right = sum((p[v] > 0.5) == y for v, ys in keep.items() for y in ys) / 4000
    assert right > 0.88 and pii.reliabilities([]) == {}
    w = pii.train([([1], ["a=1"], 1.0), ([-1], ["a=2"], 0.0)] * 200)
    s = lambda v, f: w[pii._indices(v, f)].sum() + w[-1]
    assert s([1], ["a=1"]) > 1 and s([-1], ["a=2"]) < -1

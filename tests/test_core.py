"""Operators of the core on hand-made rows and against plain Python."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from prefloom.functions.stats import dpo_loss, exact_sum, mcnemar, wilson
from prefloom.functions.text import assign_split, margin_bucket, normalize_prompt, prompt_group_id, stripped
from prefloom.operators import audit, nested, selection, summary, tensors, tuning
from prefloom.operators.judges import expected_judges, judge_scores
from prefloom.operators.pairs import Policy, build_pairs, combinations
from prefloom.operators.scoring import TokenScorer, UnigramScorer, batch_scorer, boundary, evaluated, response_start, score_pairs, skip_reasons
from prefloom.sources import records

RAW = "row_no bigint, " + records.RAW


def judgment(model, scores, status="success", avg=None, std=None):
    return {"judge_model": model, "status": status, "scores": None if scores is None else [{"judge_score": x} for x in scores], "score_avg": avg, "score_std": std}


def record(n, instruction="Explain the plan", responses=None, evaluations=None, preferred="a"):
    return (n, f"r{n}", instruction, responses, preferred, evaluations)


def sample(n=1, **kw):
    e = lambda x, y: {"judgments": [judgment("j1", x), judgment("j2", y)]}
    return record(n, responses={"a": "long answer", "b": "short", "c": "other"}, evaluations={"a": e([5.0] * 3, [4.0] * 3), "b": e([2.0] * 3, [2.0] * 3), "c": e([3.0] * 3, [3.0] * 3)}, **kw)


def test_pair_of_sample(spark):
    rows = {r["comparison_type"]: r for r in build_pairs(spark.createDataFrame([sample()], RAW)).collect()}
    assert len(rows) == 3
    r = rows["a__vs__b"]
    assert (r["chosen_source"], r["label_margin"], r["judge_agreement"], r["pair_weight"], r["retain"]) == ("a", 2.5, 1.0, 1.0, True)
    assert r["preferred_field_agrees"] is True and len(r["pair_id"]) == 20
    assert len({x["split"] for x in rows.values()}) == 1


def test_swapping_names_changes_labels_only(spark):
    r = sample()
    swapped = (r[0], r[1], r[2], {"b": r[3]["a"], "a": r[3]["b"]}, "b", {"b": r[5]["a"], "a": r[5]["b"]})
    x = build_pairs(spark.createDataFrame([r], RAW)).where("comparison_type = 'a__vs__b'").first()
    y = build_pairs(spark.createDataFrame([swapped], RAW)).first()
    assert (x["chosen"], x["label_margin"], x["retain"]) == (y["chosen"], y["label_margin"], y["retain"]) and y["chosen_source"] == "b"


def test_judge_branches(spark):
    e = {"x": {"judgments": [judgment("valid", [4.0, 5.0]), judgment("failed", [0.0], "failed"), judgment(" padded ", [3.0]), judgment("reported", [None, math.nan], avg=2.5, std=0.5), judgment("reported2", None, avg=2.0), judgment("none", [math.inf]),
                             judgment("twice", [1.0]), judgment("twice", [5.0], "SUCCESS"), judgment("then_failed", [2.0]), judgment("then_failed", [9.0], "failed"), judgment("then_empty", [2.0]), judgment("then_empty", []), judgment("", [1.0]), None]}, "y": None, "z": {"judgments": None}}
    df = spark.createDataFrame([record(1, responses={"x": "t"}, evaluations=e), record(2)], RAW)
    got = {r["judge"]: (r["mean"], r["repeat_std"], r["valid_attempts"]) for r in judge_scores(df).collect()}
    assert got == {"valid": (4.5, 0.5, 2.0), "padded": (3.0, 0.0, 1.0), "reported": (2.5, 0.5, 0.0), "reported2": (2.0, 0.0, 0.0), "twice": (5.0, 0.0, 1.0), "then_failed": (2.0, 0.0, 1.0), "then_empty": (2.0, 0.0, 1.0)}
    assert {r[0] for r in df.select(expected_judges(F.col("evaluations"))).collect()} == {9, 0}


def plain_scores(evaluation):
    out = {}
    for j in (evaluation or {}).get("judgments") or []:
        if j is None or (j["status"] or "").lower() != "success" or not (j["judge_model"] or "").strip():
            continue
        xs = [s["judge_score"] for s in j["scores"] or [] if s["judge_score"] is not None and math.isfinite(s["judge_score"])]
        if xs:
            out[j["judge_model"].strip()] = (statistics.fmean(xs), statistics.pstdev(xs) if len(xs) > 1 else 0.0)
        elif j["score_avg"] is not None:
            out[j["judge_model"].strip()] = (j["score_avg"], j["score_std"] or 0.0)
    return out


def test_random_records_against_plain_python(spark):
    rnd = random.Random(7)
    rows = []
    for n in range(400):
        sources = rnd.sample(["a", "b", "c", "d"], rnd.randint(0, 4))
        ev = {s: {"judgments": [judgment(f"j{k}", [rnd.choice([1.0, 2.0, 3.3, 4.7, 5.0, None, math.nan]) for _ in range(rnd.randint(0, 3))], rnd.choice(["success", "Success", "failed"]), rnd.choice([None, 3.0]), rnd.choice([None, 0.2])) for k in range(rnd.randint(0, 4))]} for s in rnd.sample(["a", "b", "c", "d"], rnd.randint(0, 4))}
        rows.append(record(n, rnd.choice(["q one", "  Q  ONE ", "", None, "q two"]), {s: rnd.choice(["t", " t ", "", "u", None]) for s in sources}, ev, rnd.choice(["a", "b", "zz", None])))
    got = {(r["row_no"], r["comparison_type"]): r for r in build_pairs(spark.createDataFrame(rows, RAW).repartition(7)).collect()}
    seen = 0
    for n, rid, ins, resp, pref, ev in rows:
        src = sorted(resp)
        expected = {j["judge_model"] for e in ev.values() for j in e["judgments"]}
        for i, a in enumerate(src):
            for b in src[i + 1:]:
                r = got[n, f"{a}__vs__{b}"]
                ja, jb = plain_scores(ev.get(a)), plain_scores(ev.get(b))
                common = sorted(set(ja) & set(jb))
                deltas = [ja[j][0] - jb[j][0] for j in common]
                d = statistics.fmean(deltas) if deltas else 0.0
                assert math.isclose(r["label_margin"], abs(d), abs_tol=1e-12) and r["common_successful_judges"] == len(common) and r["expected_judges"] == len(expected)
                agree = sum(abs(x) > 1e-12 and (x > 0) == (d > 0) for x in deltas) / len(deltas) if deltas and d else 0.0
                assert math.isclose(r["judge_agreement"], agree)
                cover = len(common) / len(expected) if expected else 0.0
                std = statistics.fmean([x for j in common for x in (ja[j][1], jb[j][1])]) if common else 0.0
                assert math.isclose(r["confidence_score"], agree * cover * max(0.0, 1 - std / 4), abs_tol=1e-12)
                assert r["chosen_source"] == (a if d >= 0 else b)
                ta, tb = (resp[a] or "").strip(), (resp[b] or "").strip()
                why = [w for w, t in (("empty_prompt", not (ins or "").strip()), ("empty_response", not ta or not tb), ("identical_responses", ta == tb), ("insufficient_common_successful_judges", len(common) < 2), ("aggregate_tie", d == 0), ("margin_below_threshold", abs(d) < 0.1), ("confidence_below_threshold", r["confidence_score"] < 0.6)) if t]
                assert r["exclusion_reasons"] == why and r["retain"] == (not why)
                seen += 1
    assert seen == len(got) > 500


def test_prompt_normalisation_and_split(spark):
    import hashlib

    texts = ["  Hello World \n", "hello world", "STRASSE straße", "a\x1cb", "µ ſ ς", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    n = normalize_prompt("t")
    got = {r["i"]: r for r in df.select("i", n.alias("n"), prompt_group_id(n).alias("g"), assign_split(n, 42, 0.7, 0.15).alias("s"), normalize_prompt("t", exact=True).alias("e")).collect()}
    for i, t in enumerate(texts):
        want = " ".join((t or "").split()).casefold()
        assert got[i]["n"] == got[i]["e"] == want
        assert got[i]["g"] == hashlib.sha256(want.encode()).hexdigest()[:16]
        u = int.from_bytes(hashlib.sha256(f"42::{want}".encode()).digest()[:8], "big") / 2**64
        assert got[i]["s"] == ("train" if u < 0.7 else "validation" if u < 0.85 else "test")
    assert got[0]["g"] == got[1]["g"]
    with pytest.raises(ValueError):
        assign_split(n, 1, 1.2)
    with pytest.raises(ValueError):
        assign_split(n, 1, 0.9, 0.2)


def test_casefold_residue(spark):
    """Code points where the native fold differs from Python's: none in Latin-1, Latin Extended-A or Greek basics."""
    points = [c for c in range(0x21, 0x530) if not chr(c).isspace()]
    got = {r["c"]: r["n"] for r in spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string").select("c", normalize_prompt("t").alias("n")).collect()}
    bad = [c for c in points if got[c] != chr(c).casefold()]
    assert not [c for c in bad if c < 0x180], [hex(c) for c in bad][:9]
    assert len(bad) < 25


def test_leakage_unique_and_keys(spark):
    df = spark.createDataFrame([("p1", "a", "train"), ("p2", "a", "test"), ("p3", "b", "train")], "pair_id string, prompt_id string, split string")
    with pytest.raises(ValueError, match="Prompt leakage"):
        audit.check_no_leakage(df)
    audit.check_no_leakage(df.where("prompt_id = 'b'"))
    with pytest.raises(ValueError, match="Duplicate pair_id: p1"):
        audit.check_unique(df.unionByName(df.where("pair_id = 'p1'")))
    with pytest.raises(ValueError, match="exactly the same pair IDs"):
        audit.check_same_keys(df, df.where("pair_id <> 'p1'"))
    with pytest.raises(ValueError, match="nonempty"):
        audit.check_same_keys(df, df.limit(0))
    audit.check_same_keys(df, df)


DETAIL = "pair_id string, prompt_id string, correct boolean, model_margin double, chosen_logprob_sum double, rejected_logprob_sum double, chosen_token_count int, rejected_token_count int"


def compared(spark):
    base = spark.createDataFrame([("1", "p1", False, -0.2, -10.0, -8.0, 10, 8), ("2", "p1", True, 0.1, -5.0, -6.0, 10, 8), ("3", "p2", False, -0.1, -9.0, -8.0, 10, 8)], DETAIL)
    other = spark.createDataFrame([("1", "p1", True, 0.3, -8.0, -7.0, 10, 8), ("2", "p1", True, 0.2, -4.5, -5.0, 10, 8), ("3", "p2", False, -0.05, -9.0, -8.0, 10, 8)], DETAIL)
    return base, other


def test_comparison(spark):
    base, other = compared(spark)
    summary.check_comparable(base, other, 0.1)
    r = summary.compare(summary.relative_details(base, other, 0.1)).first()
    assert r["paired_n"] == 3 and math.isclose(r["implicit_reward_accuracy"], 1 / 3) and math.isclose(r["accuracy_delta"], 1 / 3)
    assert (r["baseline_wrong_candidate_correct"], r["baseline_correct_candidate_wrong"], r["pairs_changed"], r["all_pairs_changed"], r["mcnemar_p"]) == (1, 0, 2, False, 1.0)
    with pytest.raises(ValueError, match="beta"):
        summary.check_comparable(base, other, 0.0)
    with pytest.raises(ValueError, match="are missing"):
        summary.check_comparable(base.drop("model_margin"), other, 0.1)
    with pytest.raises(ValueError, match="token counts"):
        summary.check_comparable(base, other.withColumn("chosen_token_count", F.lit(9)), 0.1)


def test_statistics(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (3, 10), (40, 25), (700, 800), (2000, 2100)], "b bigint, c bigint")
    for r in df.select("b", "c", mcnemar(F.col("b"), F.col("c")).alias("p")).collect():
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = 1.0 if not n else min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)) if n < 1000 else None
        if want is None:
            from fractions import Fraction

            want = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
        assert math.isclose(r["p"], want, rel_tol=1e-9)
    lo, hi = wilson(F.col("s"), F.col("n"))
    r = spark.createDataFrame([(8, 10), (0, 0), (10, 10)], "s bigint, n bigint").select("n", lo.alias("lo"), hi.alias("hi")).collect()
    assert math.isclose(r[0]["lo"], 0.4901624715, rel_tol=1e-6) and math.isclose(r[0]["hi"], 0.9433178, rel_tol=1e-5) and r[1]["lo"] is None and math.isclose(r[2]["hi"], 1.0)
    xs = [-1.0, -0.9999999999999998, -1.0, 3.0, 0.0]
    assert spark.createDataFrame([(xs,)], "x array<double>").select(exact_sum(F.col("x"))).first()[0] == math.fsum(xs)
    loss = spark.range(1).select(dpo_loss(F.lit(-5.0), F.lit(-7.0), F.lit(-6.0), F.lit(-7.0), 0.1)).first()[0]
    assert math.isclose(loss, math.log1p(math.exp(-0.1)))
    b = [x[0] for x in spark.createDataFrame([(0.05,), (0.25,), (0.5,)], "m double").select(margin_bucket(F.col("m"))).collect()]
    assert b == ["[0.10,0.25)", "[0.25,0.50)", "[0.50,+inf)"]


def test_bootstrap_modes(spark):
    rnd = random.Random(1)
    rows = [(f"p{rnd.randint(0, 30):02}", float(rnd.random() < 0.6)) for _ in range(200)]
    df = spark.createDataFrame(rows, "prompt_id string, v double")
    per = {}
    for p, v in rows:
        per.setdefault(p, []).append(v)
    means = [statistics.fmean(per[p]) for p in sorted(per)]
    g = random.Random(42)
    e = sorted(statistics.fmean(means[g.randrange(len(means))] for _ in means) for _ in range(300))
    r = summary.bootstrap_twister(df, F.col("v"), 300).first()
    assert (r["lo"], r["hi"]) == (e[int(0.025 * 299)], e[int(0.975 * 299)])
    m = statistics.fmean(means)
    for x in (summary.bootstrap(df, F.col("v"), 500).first(), summary.bootstrap_portable(df, F.col("v"), 500).first(), summary.bootstrap_poisson(df, F.col("v"), 300).first()):
        assert x["lo"] < m < x["hi"] and x["hi"] - x["lo"] < 0.5
    assert summary.bootstrap(df.limit(0), F.col("v"), 50).collect() == []


def test_boundary():
    render = lambda p, r: f"<u>{p}</u><a>{r}</a>"
    chars = lambda t: (list(map(ord, t)), [(i, i + 1) for i in range(len(t))])
    assert boundary("repeat answer", "answer", render, chars) == (len("<u>repeat answer</u><a>"), list(map(ord, "<u>repeat answer</u><a>answer</a>")))
    with pytest.raises(ValueError, match="empty_response"):
        boundary("p", "", render, chars)
    with pytest.raises(ValueError, match="marker_not_found"):
        boundary("p", "r", lambda p, r: p, chars)
    with pytest.raises(ValueError, match="empty_tokenized_response"):
        boundary("p", "r", render, lambda t: ([7], [(0, 1)]))


def test_scoring(spark):
    corpus = spark.createDataFrame([("a a b",), ("c",)], "t string")
    pairs = spark.createDataFrame([("1", "p", "q", "a b", "c c"), ("2", "p", "q", "", "a"), ("3", "p", "q", "!!", "a"), ("4", "p", "q", "b a", "a b"), ("5", "p", "q " * 20, "a", "b"), ("6", "p", "q", "zz", "a")], "pair_id string, prompt_id string, prompt string, chosen string, rejected string")
    for c, v in (("split", "test"), ("label_confidence", "high"), ("comparison_type", "x"), ("label_margin", 1.0)):
        pairs = pairs.withColumn(c, F.lit(v))
    d = score_pairs(pairs, UnigramScorer(corpus, "t"), 10)
    got = {r["pair_id"]: r for r in d.collect()}
    la, lb, lc, lz = (math.log(x / 8) for x in (3, 2, 2, 1))  # 4 tokens, 3 words, 1 token of the prompt
    assert math.isclose(got["1"]["chosen_logprob_sum"], la + lb, abs_tol=1e-9) and math.isclose(got["1"]["model_margin"], (la + lb) / 2 - lc, abs_tol=1e-9) and got["1"]["correct"]
    assert got["4"]["tie"] and not got["4"]["correct"] and math.isclose(got["6"]["chosen_logprob_sum"], lz, abs_tol=1e-9)
    assert {r["skip_reason"]: r["n"] for r in skip_reasons(d).collect()} == {"empty_response": 1, "empty_tokenized_response": 1, "over_max_length": 1} and evaluated(d).count() == 3
    # a word of the prompt is likelier in the answer
    echo = score_pairs(pairs.where("pair_id = '6'").withColumn("prompt", F.lit("zz q")), UnigramScorer(corpus, "t")).first()
    assert math.isclose(echo["chosen_logprob_sum"], math.log(2 / 9), abs_tol=1e-9)
    # null texts keep their row and are skipped
    null = score_pairs(pairs.withColumn("chosen", F.when(F.col("pair_id") != "1", F.col("chosen"))).withColumn("prompt", F.when(F.col("pair_id") != "4", F.col("prompt"))), UnigramScorer(corpus, "t"))
    assert null.count() == 6 and {r["pair_id"]: r["skip_reason"] for r in null.collect()} == {"1": "empty_response", "2": "empty_response", "3": "empty_tokenized_response", "4": None, "5": None, "6": None}
    b = {r["pair_id"]: r for r in score_pairs(pairs, batch_scorer(lambda p, r: [(-float(len(x) * len(y)), len(x)) for x, y in zip(r, p)]), 25).collect()}
    assert b["1"]["chosen_logprob_per_token"] == -1.0 and b["5"]["chosen_logprob_sum"] == -40.0 and b["2"]["skip_reason"] == "empty_response"
    r = pairs.select("pair_id", response_start(F.concat(F.lit("user: "), "prompt", F.lit(" assistant: ")), F.col("chosen")).alias("s")).collect()
    assert {x["pair_id"]: x["s"] for x in r}["1"] == 3 and {x["pair_id"]: x["s"] for x in r}["2"] is None


def test_token_scorer(spark):
    class Pieces:
        """A tokenizer whose tokens are two characters wide, so one straddles where a response begins after an odd number; the model likes no token but x."""

        def render(self, prompt, response):
            return f"[{prompt}]{response}."

        def encode(self, text):
            return [ord(text[i]) for i in range(0, len(text), 2)], [(i, min(i + 2, len(text))) for i in range(0, len(text), 2)]

        def logprobs(self, batch):
            return [[-1.0 if i == ord("x") else -2.0 for i in ids[1:]] for ids in batch]

    rows = [("1", "abc", "xyxy", "zzzz"), ("2", "ab", "xyxy", "zzzz"), ("3", "abc", "", "zz"), ("4", "abc", "x" * 40, "zz"), ("5", None, "xx", None)]
    pairs = spark.createDataFrame([(i, "q", p, c, r, "test", "high", "t", 1.0) for i, p, c, r in rows], "pair_id string, prompt_id string, prompt string, chosen string, rejected string, split string, label_confidence string, comparison_type string, label_margin double")
    got = {r["pair_id"]: r for r in score_pairs(pairs, TokenScorer(Pieces), 12).collect()}
    # "[a" "bc" "]x" "yx" "y.": the token that straddles the border belongs to the response
    assert (got["1"]["chosen_token_count"], got["1"]["chosen_logprob_sum"], got["1"]["rejected_logprob_sum"], got["1"]["model_margin"]) == (3, -6.0, -6.0, 0.0) and got["1"]["tie"]
    # "[a" "b]" "xy" "xy" ".": here it doesn't straddle
    assert (got["2"]["chosen_token_count"], got["2"]["chosen_logprob_sum"], got["2"]["rejected_logprob_sum"]) == (3, -4.0, -6.0) and got["2"]["correct"]
    assert [got[k]["skip_reason"] for k in "345"] == ["empty_response", "over_max_length", "empty_response"] and len(got) == 5


def test_medians(spark):
    from statistics import median

    rows = [("a", float(i % 7)) for i in range(50)] + [("b", 1.0)] + [("c", 2.0), ("c", 5.0), ("c", None)] + [("d", 3.0 if i % 3 else float(i)) for i in range(30_001)] + [("e", float(i * i % 30_011)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["median"] for r in summary.medians(df, ["g"], "v").collect()}
    assert got == {g: median(v for k, v in rows if k == g and v is not None) for g in "abcde"}
    assert [r["median"] for r in summary.medians(df, [], "v").collect()] == [median(v for _, v in rows if v is not None)] and summary.medians(df.limit(0), [], "v").collect() == []


def test_shared_folder(spark, monkeypatch):
    from pathlib import Path

    from prefloom.plans import lineage

    kept, gone = lineage.land(spark.range(3)), lineage.land(spark.range(4).withColumn("x", F.lit(1)))
    files = [Path(f.removeprefix("file:").replace("///", "/")) for f in gone.inputFiles()]
    assert all(f.exists() for f in files)
    lineage.drop(gone.select("id"))
    assert not any(f.exists() for f in files) and kept.count() == 3

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Elsewhere)


def test_deep_json():
    deep = '{"a": ' * 30_000 + "[1, {}]" + "}" * 30_000
    v = nested.parse(deep)
    for _ in range(30_000):
        v = v["a"]
    assert v == [1, {}]
    for t in ("[1,]", '{"a"}', "[1 2]", '{"a":1,}', "[true] x", "{1:2}", "[", "", "nul", '{"a":[}'):
        with pytest.raises(ValueError):
            nested._deep(t)
    for t in ('{"a":[1,2.5e3,{"b":"c\\u0041"}],"d":null}', "[]", "{}", '"x"', "-1", "[[],{}]"):
        assert nested._deep(t) == json.loads(t)


def test_summary_empty_and_groups(spark):
    schema = "pair_id string, prompt_id string, label_confidence string, label_margin double, comparison_type string, chosen_logprob_per_token double, rejected_logprob_per_token double, model_margin double, correct boolean, tie boolean"
    df = spark.createDataFrame([("1", "p", "high", 0.2, "x", -1.0, -2.0, 1.0, True, False), ("2", "p", "high", 0.3, "x", -2.0, -2.0, 0.0, False, True), ("3", "q", "medium", 0.9, "x", -1.0, -2.0, math.nan, False, False)], schema)
    r = summary.metrics(df.where("pair_id <> '3'")).first()
    assert (r["n"], r["unique_prompts"], r["correct"], r["ties"], r["preference_accuracy"], r["model_margin_std"]) == (2, 1, 1, 1, 0.5, 0.5)
    assert summary.metrics(df.limit(0)).first()["n"] == 0 and summary.metrics(df.limit(0)).first()["preference_accuracy"] is None
    assert {x["label_margin_bucket"]: x["n"] for x in summary.by_margin_bucket(df).collect()} == {"[0.10,0.25)": 1, "[0.25,0.50)": 1, "[0.50,+inf)": 1}


def test_selection(spark):
    rows = [(str(i), "r", "high" if i % 3 else "low", 0.05 * i, ("train", "validation", "test")[i % 3], "p " * i, "c", "r", i != 4) for i in range(12)]
    df = spark.createDataFrame(rows, "pair_id string, record_id string, label_confidence string, label_margin double, split string, prompt string, chosen string, rejected string, retain boolean")
    e = selection.eligible(df, min_margin=0.2)
    assert {r["pair_id"] for r in e.collect()} == {"5", "7", "8", "10", "11"}
    with pytest.raises(ValueError, match="train"):
        selection.check_splits(e)
    assert selection.check_splits(df) == {"train": 4, "validation": 4, "test": 4}
    a = [r["pair_id"] for r in selection.capped(df, 5).collect()]
    assert a == [r["pair_id"] for r in selection.capped(df.repartition(6), 5).collect()] and len(a) == 5
    assert selection.within_length(df, 5).count() == 5
    m = selection.messages(df.where("pair_id = '1'")).first()
    assert m["chosen"][0].asDict() == {"role": "assistant", "content": "c"} and len(m) == 3


def test_tensors_and_tuning(spark):
    base = spark.createDataFrame([("w", 0, 3.0), ("w", 1, 4.0), ("z", 0, 0.0)], "param string, idx int, value double")
    moved = base.withColumn("value", F.when(F.col("idx") == 1, F.col("value") + 1).otherwise(F.col("value")))
    r = {x["param"]: x for x in tensors.tensor_change(base, moved).collect()}
    assert (r["w"]["changed_elements"], r["w"]["l2_change"], r["w"]["relative_l2_change"], r["z"]["exactly_equal"], r["z"]["relative_l2_change"]) == (1, 1.0, 0.2, True, None)
    tensors.check_shapes(base, moved)
    with pytest.raises(ValueError, match="shape"):
        tensors.check_shapes(base, moved.where("idx = 0"))
    with pytest.raises(ValueError, match="identical"):
        tensors.check_changed(tensors.tensor_change(base, base))
    c = spark.createDataFrame([("a", 0.5, 1.0, 2.0), ("b", 0.5, 1.0, 1.0), ("c", math.nan, 9.0, 0.0), ("d", 0.4, None, 0.0)], "candidate string, m double, g double, l double")
    assert [r["candidate"] for r in tuning.ranked(c, "m", "g", "l", "candidate").collect()] == ["b", "a", "d", "c"]
    w = tuning.with_schedule(spark.createDataFrame([(17, 8, 1.5, 0.25), (1, 8, 1.0, 0.1)], "n int, b int, e double, r double"), "n", "b", "e", "r").collect()
    assert [(x["updates"], x["warmup"]) for x in w] == [(6, 2), (1, 1)]
    g = tuning.grid(spark, lr=(1e-7, 5e-7), beta=(0.1, 0.2))
    fin = spark.createDataFrame([(1e-7, 0.1, True), (5e-7, 0.1, False)], "lr double, beta double, complete boolean")
    todo, done = tuning.to_train(g, fin, ["lr", "beta"])
    assert {r["candidate"] for r in todo.collect()} == {"c001", "c002", "c003"} and {r["candidate"] for r in done.collect()} == {"c000"}
    assert tuning.policy_fingerprint({"b": 1, "a": 2}) == tuning.policy_fingerprint({"a": 2, "b": 1})
    f = tuning.table_fingerprint(base).first()
    assert f == tuning.table_fingerprint(base.repartition(3)).first() and f != tuning.table_fingerprint(moved).first()


def test_report_and_combinations(spark):
    raw = spark.createDataFrame([sample(1), sample(2, instruction=" "), record(3, responses={"a": "x"}), record(4)], RAW)
    p = build_pairs(raw, Policy())
    t = audit.report_totals(p, raw).first()
    assert (t["records"], t["possible_pairs"]) == (4, 6)
    counts = audit.report_counts(p)
    assert counts.where("split is not null").agg(F.sum("pairs")).first()[0] == 6 == counts.where("label_confidence is not null").agg(F.sum("pairs")).first()[0]
    assert {r["reason"]: r["pairs"] for r in audit.report_exclusions(p).collect()}["empty_prompt"] == 3
    q = audit.report_preferred(p).first()
    assert q["agrees"] + q["disagrees"] + q["not_applicable"] == 6
    assert combinations(raw).count() == 6
    assert build_pairs(raw.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    rec = {"id": 7, "instruction": "q", "responses": {"a": "x", "b": "y"}, "preferred_response": "a", "evaluations": {"a": {"judgments": [{"judge_model": "j", "status": "success", "scores": [{"judge_score": True}, {"judge_score": "4"}, {"judge_score": 3}]}]}}}
    p = tmp_path / "raw.json"
    p.write_text(json.dumps([rec, rec]))
    df = records.read_raw_json(spark, str(p))
    assert df.count() == 2 and df.first()["id"] == "7"
    assert [r["mean"] for r in judge_scores(df).collect()] == [3.0, 3.0]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="list"):
        records.read_raw_json(spark, str(tmp_path / "bad.json"))
    pairs = build_pairs(df).drop("row_no").limit(1)
    records.write_jsonl(pairs, str(tmp_path / "pairs"))
    again = records.read_jsonl(spark, str(tmp_path / "pairs"), records.PAIR, key="pair_id")
    assert again.first().asDict() == pairs.first().asDict()
    records.write_csv(pairs.select("pair_id"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    assert records.write_report(pairs.select("pair_id"), str(tmp_path / "r" / "x.json"), echo=False)["pair_id"]
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "c.yaml").write_text("pairs_file: data/p.jsonl\nseed: 3\n")
    assert records.load_config(str(tmp_path / "conf" / "c.yaml")) == {"pairs_file": str(tmp_path / "data" / "p.jsonl"), "seed": 3}
    (tmp_path / "conf" / "d.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="mapping"):
        records.load_config(str(tmp_path / "conf" / "d.yaml"))


def test_stripped(spark):
    df = spark.createDataFrame([("  x y \x1f",), (None,)], "t string")
    assert [r[0] for r in df.select(stripped("t")).collect()] == ["x y", None]


# ---- nested records ----

JSONS = [
    (1, json.dumps({"evaluations": {"a": {"judgments": [{"judge_model": "j", "status": "failed", "scores": [{"judge_score": 1}, None, {"judge_score": "4"}, {"judge_score": True}, 2.5, {"judge_score": {"judge_score": 3}}, {"criteria": [{"judge_score": 4}]}]}, None, {"scores": {"judge_score": 3}}]}, "b": None, "c": {"judgments": {"scores": 4}}}})),
    (2, json.dumps({"record": {"evaluations": [{"source": "x", "judgments": [{"scores": []}, {"scores": [{"judge_score": 1e999}]}]}, {"source": "y", "judgments": "n/a"}]}})),
    (3, json.dumps({"evaluations": json.dumps({"z": {"judgments": [{"scores": [{"judge_score": 5}]}]}})})),
    (4, '{"evaluations": {"a": {"judgments": [{"scores": [{"judge_score": 1}]}'), (5, None), (6, ""), (7, "[]"), (8, '{"evaluations": {}} trailing'), (9, "3"), (10, '{"evaluations": 7}'),
]


def test_nested_scores(spark):
    raw = spark.createDataFrame([sample(1), record(2, evaluations={"s": {"judgments": [None, judgment("j", [None, 2.0, math.nan, math.inf])]}, "t": None}), record(3)], RAW)
    text = spark.createDataFrame(JSONS, "row_no bigint, payload string")
    got = {tuple(r) for r in nested.scores_found(raw, text.withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))).collect()}
    assert {x for x in got if x[0] == "raw_json"} == {("raw_json", 1, "a", 0, 0), ("raw_json", 1, "a", 0, 4), ("raw_json", 1, "a", 2, 0), ("raw_json", 1, "c", 0, 0), ("raw_json", 3, "z", 0, 0)}
    assert {x for x in got if x[1] == 2} == {("raw", 2, "s", 1, 1)} and len({x for x in got if x[:2] == ("raw", 1)}) == 18
    links = {(r["origin"], r["path"]): r["orphans"] for r in nested.linked_tables(raw, text).collect()}
    assert set(links.values()) == {0} and len(links) == 6
    assert nested.scores_found(raw.limit(0), text.limit(0)).count() == 0


def test_dewey_nodes(spark):
    doc = {"a": [{"b": 1}, None, {"b": "x", "c": []}], "d": True}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "broken"), (3, None)], "i bigint, j string")
    n = nested.with_parent(nested.json_nodes(df, "i", "j"))
    rows = {tuple(r["dewey"]): r for r in n.collect()}
    assert rows[0, 2, 0]["path"] == "$.a[].b" and rows[0, 2, 0]["text"] == "x" and tuple(rows[0, 2, 0]["parent"]) == (0, 2) and rows[()]["parent"] is None
    assert rows[0, 1]["kind"] == "null" and rows[0, 0, 0]["number"] == 1.0 and rows[1,]["kind"] == "bool"
    assert all(r["parent"] is None or tuple(r["parent"]) in rows for r in rows.values())
    assert nested.path_table(nested.json_nodes(df, "i", "j"), "$.a[]").count() == 3
    deep = "[" * 3000 + "]" * 3000
    assert nested.json_nodes(spark.createDataFrame([(1, deep)], "i bigint, j string"), "i", "j").count() in (0, 3000)

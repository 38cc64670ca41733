"""Queries of the core and the same in SQL, over whole tables."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from prefloom.functions.stats import dpo_loss
from prefloom.functions.text import assign_split, normalize_prompt, prompt_group_id, stripped
from prefloom.operators import audit, nested, selection, summary, tensors, tuning
from prefloom.operators import judges as jd
from prefloom.operators import pairs as pr
from prefloom.operators import scoring as sc
from prefloom.plans.lineage import land, own_path
from prefloom.sources import records
from prefloom.sources.tables import spread, table

#: Policy of the queries: the sample run's shares.
POLICY = pr.Policy(train_share=0.70, validation_share=0.15)
SPLIT = "test"
SAMPLES = 10_000
BETA = 0.1


def _r(df, *keep):
    """Doubles rounded to six places for output; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def p3_found(spark, d):
    return nested.scores_found(table(spark, d, "raw"), table(spark, d, "raw_json"))


def p3_tables(spark, d):
    """Rows, records and orphans of the flat tables."""
    return nested.linked_tables(table(spark, d, "raw"), table(spark, d, "raw_json"))


def _flat(name):
    def run(spark, d):
        return _r(nested.flat_tables(table(spark, d, "raw"), table(spark, d, "raw_json"))[name])

    return run


def _raw(spark, d):
    return spread(table(spark, d, "raw"))


def judge_scores(spark, d):
    return _r(jd.judge_scores(_raw(spark, d)))


def expected_judges(spark, d):
    return _raw(spark, d).select("row_no", jd.expected_judges(F.col("evaluations")).alias("expected_judges"))


def attempt_scores(spark, d):
    """Per record, source and judge of the flat table: attempts that succeeded with a finite number, and their mean."""
    e = table(spark, d, "evaluations").withColumn("judge", stripped("judge_model")).where((F.lower("status") == "success") & (F.col("judge") != ""))
    s = F.col("judge_score")
    return _r(e.where(~F.isnan(s) & (F.abs(s) < float("inf"))).groupBy("record_id", "source", "judge").agg(F.count("*").alias("attempts"), F.avg("judge_score").alias("mean")))


def prompt_normalize(spark, d):
    return _raw(spark, d).select("row_no", normalize_prompt("instruction").alias("normal"))


def prompt_ids(spark, d):
    return pr.prompts(_raw(spark, d), POLICY).select("row_no", "prompt_id")


def prompt_split(spark, d):
    return pr.prompts(_raw(spark, d), POLICY).select("row_no", "split")


def split_shares(spark, d):
    p = pr.prompts(_raw(spark, d), POLICY)
    return p.groupBy("split").agg(F.count("*").alias("records"), F.countDistinct("prompt_id").alias("prompts"))


def response_combinations(spark, d):
    return pr.combinations(_raw(spark, d))


def pair_metrics(spark, d):
    m = pr.measured(_raw(spark, d), POLICY)
    return _r(m.select("row_no", "source_a", "source_b", "n_common", "expected_judges", "delta", "label_margin", "judge_agreement", "judge_coverage", "average_repeat_std", "repeat_consistency", "confidence_score"))


def pair_side_scores(spark, d):
    return _r(pr.build_pairs(_raw(spark, d), POLICY).select("row_no", "comparison_type", "chosen_source", "chosen_score_common_judges", "rejected_score_common_judges"))


def preferred_agreement(spark, d):
    return pr.build_pairs(_raw(spark, d), POLICY).select("row_no", "comparison_type", "raw_preferred_response", "preferred_field_agrees")


def pair_exclusions(spark, d):
    return pr.build_pairs(_raw(spark, d), POLICY).select("row_no", "comparison_type", "retain", F.concat_ws(",", "exclusion_reasons").alias("reasons"))


def pairs_full(spark, d):
    return _r(pr.build_pairs(_raw(spark, d), POLICY).select("row_no", "pair_id", "record_id", "prompt_id", "split", "prompt", "chosen", "rejected", "chosen_source", "rejected_source", "label_margin", "label_confidence", "confidence_score", "common_successful_judges", "expected_judges", "retain"))


def leakage_audit(spark, d):
    """Of the built pairs: none."""
    return audit.leaked_prompts(pr.build_pairs(_raw(spark, d), POLICY))


def leakage_audit_violations(spark, d):
    """Of the delivered pairs."""
    return audit.leaked_prompts(_delivered(spark, d))


def duplicate_pair_ids(spark, d):
    return audit.duplicate_keys(table(spark, d, "dpo_pairs"))


def report_totals(spark, d):
    raw = _raw(spark, d)
    return audit.report_totals(pr.build_pairs(raw, POLICY), raw)


def _counts(spark, d, key):
    c = audit.report_counts(pr.build_pairs(_raw(spark, d), POLICY))
    return c.where(F.col(key).isNotNull()).select(key, "pairs", "retained")


def report_by_split(spark, d):
    return _counts(spark, d, "split")


def report_by_confidence(spark, d):
    return _counts(spark, d, "label_confidence")


def report_by_type(spark, d):
    return _counts(spark, d, "comparison_type")


def report_exclusions(spark, d):
    return audit.report_exclusions(pr.build_pairs(_raw(spark, d), POLICY))


def report_preferred(spark, d):
    return audit.report_preferred(pr.build_pairs(_raw(spark, d), POLICY))


def _delivered(spark, d):
    """The delivered pairs, each once, with clean split names and texts that are never null."""
    s = F.lower(F.trim("split"))
    t = table(spark, d, "dpo_pairs")
    keep = ["pair_id", "record_id", "prompt_id", "label_margin", "label_confidence", "comparison_type", "retain"]
    return t.select(*keep, F.when(s.isin("val", "dev"), "validation").otherwise(s).alias("split"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "chosen", "rejected")]).distinct()


def train_eligible(spark, d):
    return selection.eligible(_delivered(spark, d)).groupBy("split", "label_confidence").agg(F.count("*").alias("pairs"))


def eval_eligible(spark, d):
    return selection.eligible(_delivered(spark, d), SPLIT, min_margin=0.10).select("pair_id")


def train_capped(spark, d):
    """The first 50 training pairs in seeded order: the cap is the feature."""
    return selection.capped(selection.eligible(_delivered(spark, d), "train"), 50).select("pair_id")


def train_within_length(spark, d):
    return selection.within_length(selection.eligible(_delivered(spark, d), "train"), 150).select("pair_id")


def train_messages(spark, d):
    m = selection.messages(selection.eligible(_delivered(spark, d), "train"))
    return m.select(*[F.concat(F.col(c)[0]["role"], F.lit(": "), F.col(c)[0]["content"]).alias(c) for c in ("prompt", "chosen", "rejected")])


def manifest_counts(spark, d):
    return selection.manifest(_delivered(spark, d), 150)


def _models(spark, d):
    """Two unigram models over one vocabulary: a baseline of the documents, a candidate of the chosen answers of the training split."""
    of_docs = land(sc.token_counts(table(spark, d, "documents"), "text"))
    of_chosen = land(sc.token_counts(_delivered(spark, d).where("split = 'train'").select("chosen"), "chosen"))
    v = land(of_docs.select("token").unionByName(of_chosen.select("token")).distinct())
    return sc.UnigramScorer(vocabulary=v, counts=of_docs), sc.UnigramScorer(vocabulary=v, counts=of_chosen)


def ngram_lm(spark, d):
    base, cand = _models(spark, d)
    b, c = base.logprobs(), cand.logprobs().withColumnRenamed("logprob", "candidate")
    return _r(b.withColumnRenamed("logprob", "baseline").join(c, "token"))


def response_logprobs(spark, d):
    """Every answer of the delivered pairs given its prompt, under the baseline."""
    p = _delivered(spark, d).select("pair_id", "prompt", F.explode(F.create_map(F.lit("chosen"), "chosen", F.lit("rejected"), "rejected")).alias("side", "response"))
    p = p.withColumn("key", sc.conversation_key(F.col("prompt"), F.col("response")))
    got = _models(spark, d)[0].score(p.select("key", "prompt", "response").dropDuplicates(["key"]))
    return _r(p.select("pair_id", "side", "key").join(got, "key").select("pair_id", "side", "prompt_tokens", "token_count", "logprob_sum", "logprob_mean", "skip_reason"))


def response_boundary(spark, d):
    p = _delivered(spark, d)
    before = F.concat(F.lit("user: "), F.col("prompt"), F.lit(" assistant: "))
    return p.select("pair_id", sc.response_start(before, F.col("chosen")).alias("start"))


def _details(spark, d, which, models=None, max_length=1024):
    return sc.score_pairs(selection.eligible(_delivered(spark, d), SPLIT, min_margin=0.10), (models or _models(spark, d))[which], max_length)


def pair_scores(spark, d):
    """All eligible pairs of the split and, as a case that must be skipped, those without an answer."""
    e = selection.eligible(_delivered(spark, d), SPLIT, min_margin=0.10)
    void = e.select("pair_id", "prompt_id", "split", "label_confidence", "label_margin", "comparison_type", "prompt", F.lit(None).cast("string").alias("chosen"), "rejected").withColumn("pair_id", F.concat("pair_id", F.lit(":void")))
    return _r(sc.score_pairs(e.select(void.columns).unionByName(void), _models(spark, d)[0]))


def skip_reasons(spark, d):
    """At 150 tokens, so that there are long ones; the other queries take 1024."""
    return sc.skip_reasons(_details(spark, d, 0, max_length=150))


def _evaluated(spark, d, which=0, models=None):
    return land(sc.evaluated(_details(spark, d, which, models)))  # read by several aggregates


def _both(spark, d):
    models = _models(spark, d)
    return _evaluated(spark, d, 0, models), _evaluated(spark, d, 1, models)


def eval_overall(spark, d):
    return _r(summary.metrics(_evaluated(spark, d)))


def eval_by_confidence(spark, d):
    return _r(summary.metrics(_evaluated(spark, d), ["label_confidence"]))


def eval_by_type(spark, d):
    return _r(summary.metrics(_evaluated(spark, d), ["comparison_type"]))


def eval_by_margin_bucket(spark, d):
    return _r(summary.by_margin_bucket(_evaluated(spark, d)))


def eval_subgroups(spark, d):
    """All groupings in one pass."""
    return _r(summary.all_subgroups(_evaluated(spark, d)))


def paired_id_audit(spark, d):
    return audit.key_sets(*_both(spark, d))


def token_parity_audit(spark, d):
    return summary.token_mismatches(*_both(spark, d))


def token_parity_violations(spark, d):
    """Where the second side counts one token more in pairs of high confidence."""
    e = _evaluated(spark, d)
    return summary.token_mismatches(e, e.withColumn("chosen_token_count", F.col("chosen_token_count") + (F.col("label_confidence") == "high").cast("int")))


def _relative(spark, d):
    return summary.relative_details(*_both(spark, d), BETA)


def relative_details(spark, d):
    return _r(_relative(spark, d))


PRIMARY = ["paired_n", "unique_prompts", "implicit_reward_accuracy", "implicit_reward_wilson_lo", "implicit_reward_wilson_hi", "implicit_reward_prompt_macro_accuracy", "mean_implicit_reward_margin", "median_implicit_reward_margin", "ties"]
SECONDARY = ["baseline_preference_accuracy", "candidate_preference_accuracy", "accuracy_delta", "baseline_prompt_macro_accuracy", "candidate_prompt_macro_accuracy", "prompt_macro_accuracy_delta", "mean_model_margin_baseline", "mean_model_margin_candidate", "mean_model_margin_delta", "baseline_correct_candidate_wrong", "baseline_wrong_candidate_correct"]
BEHAVIOR = ["pairs_changed", "all_pairs_changed", "mean_abs_chosen_policy_logratio", "mean_abs_rejected_policy_logratio"]


def compare_primary(spark, d):
    return _r(summary.compare(_relative(spark, d)).select(*PRIMARY))


def compare_secondary(spark, d):
    return _r(summary.compare(_relative(spark, d)).select(*SECONDARY))


def compare_behavior(spark, d):
    return _r(summary.compare(_relative(spark, d)).select(*BEHAVIOR))


def final_results(spark, d):
    """One row per model."""
    c = land(summary.compare(_relative(spark, d)))
    row = lambda name, k: c.select(F.lit(name).alias("model"), F.col(f"{k}_preference_accuracy").alias("accuracy"), F.col(f"{k}_prompt_macro_accuracy").alias("prompt_macro_accuracy"), F.col(f"mean_model_margin_{k}").alias("mean_margin"))
    return _r(row("baseline", "baseline").unionByName(row("candidate", "candidate")))


def mcnemar_exact(spark, d):
    return _r(summary.compare(_relative(spark, d)).select("baseline_correct_candidate_wrong", "baseline_wrong_candidate_correct", "mcnemar_p"))


def dpo_loss_mean(spark, d):
    b, o = (x.alias(n) for x, n in zip(_both(spark, d), "bo"))
    return _r(b.join(o, "pair_id").select(dpo_loss(F.col("o.chosen_logprob_sum"), F.col("o.rejected_logprob_sum"), F.col("b.chosen_logprob_sum"), F.col("b.rejected_logprob_sum"), BETA).alias("loss")).agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss")))


def _interval(column, seed):
    def run(spark, d):
        return _r(summary.bootstrap_portable(land(_relative(spark, d)), F.col(column).cast("double"), SAMPLES, seed))

    return run


def bootstrap_hashed(spark, d):
    """The default mode, whose draws no other engine repeats."""
    return _r(summary.bootstrap(land(_relative(spark, d)), F.col("implicit_reward_correct").cast("double"), SAMPLES))


def bootstrap_exact_mt(spark, d):
    return _r(summary.bootstrap_twister(land(_relative(spark, d)), F.col("implicit_reward_correct").cast("double"), SAMPLES))


def bootstrap_poisson(spark, d):
    return _r(summary.bootstrap_poisson(land(_relative(spark, d)), F.col("implicit_reward_correct").cast("double"), SAMPLES))


def tensor_change(spark, d):
    base = tensors.long_form(table(spark, d, "embeddings"))
    moved = base.withColumn("value", F.when(F.col("param") % 2 == 0, F.col("value") + 0.001 * (F.col("idx") % 3)).otherwise(F.col("value")))
    return _r(tensors.tensor_change(base, moved))


def _candidates(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.concat_ws(":", "c_mktsegment", F.col("n_regionkey").cast("string")).alias("candidate"))
    g = g.agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), -1).alias("metric"), F.round(F.median("c_acctbal"), 2).alias("margin"), F.round(F.stddev_pop("c_acctbal"), 2).alias("loss"))
    return g.withColumn("metric", F.when(F.col("n") % 7 == 0, None).otherwise(F.col("metric")))


def tuning_rank(spark, d):
    r = tuning.ranked(_candidates(spark, d), "metric", "margin", "loss", "candidate")
    from pyspark.sql import Window

    w = Window.orderBy(*[F.col(c) for c in ("k1", "k2", "k3", "candidate")])  # one row per candidate
    return r.select("candidate", "metric", "margin", "loss", (-F.coalesce("metric", F.lit(-1e300))).alias("k1"), (-F.col("margin")).alias("k2"), F.col("loss").alias("k3")).withColumn("place", F.row_number().over(w).cast("bigint")).drop("k1", "k2", "k3")


def tuning_winner(spark, d):
    return tuning.winner(_candidates(spark, d), "metric", "margin", "loss", "candidate")


def tuning_warmup(spark, d):
    t = _candidates(spark, d).withColumns({"batch": F.lit(8), "epochs": F.lit(2.0), "ratio": F.lit(0.1)})
    return tuning.with_schedule(t, "n", "batch", "epochs", "ratio").select("candidate", "n", "updates", "warmup")


def policy_fingerprint(spark, d):
    """What identifies a run under the policy of these queries, beside the number of its records."""
    f = tuning.policy_fingerprint(asdict(POLICY))
    return table(spark, d, "raw").agg(F.count("*").alias("records")).select(F.lit(f).alias("fingerprint"), "records")


def tuning_grid(spark, d):
    """Open candidates of a grid, when those of the lower learning rate are finished."""
    g = tuning.grid(spark, learning_rate=(1e-7, 5e-7), epochs=(1, 2), beta=(0.05, 0.1))
    done = g.where("learning_rate < 2e-7").withColumn("complete", F.col("epochs") == 1)
    return tuning.to_train(g, done, ["learning_rate", "epochs", "beta"])[0]


def table_fingerprint(spark, d):
    return tuning.table_fingerprint(table(spark, d, "dpo_pairs"), "pair_id", "prompt_id", "split")


def _back(spark, write, read):
    """Written to the shared folder and read again; the files go with the landed tables."""
    path = own_path(spark)
    write(path)
    return read(path)


def io_jsonl(spark, d):
    """The delivered pairs as JSONL, all columns, written and read back."""
    t = table(spark, d, "dpo_pairs").drop("exported_at")
    got = _back(spark, lambda p: records.write_jsonl(t, p), lambda p: records.read_jsonl(spark, p, records.PAIR))
    return _r(got.select("pair_id", "record_id", "split", "prompt", "chosen", "rejected", "label_margin", "common_successful_judges", "preferred_field_agrees", F.concat_ws(",", "exclusion_reasons").alias("reasons")))


def io_jsonl_keyed(spark, d):
    """Each pair once, read back with its key checked."""
    t = table(spark, d, "dpo_pairs").select("pair_id").distinct()
    return _back(spark, lambda p: records.write_jsonl(t, p), lambda p: records.read_jsonl(spark, p, "pair_id string", "pair_id"))


def io_csv(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return _r(_back(spark, lambda p: records.write_csv(c, p), lambda p: spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").option("header", True).csv(p)))


def io_parquet_by_split(spark, d):
    """Built pairs by split, counted from the files."""
    b = pr.build_pairs(_raw(spark, d), POLICY)
    return _back(spark, lambda p: records.write_parquet(b, p, ("split",)), lambda p: spark.read.parquet(p)).groupBy("split").agg(F.count("*").alias("pairs"), F.countDistinct("pair_id").alias("ids"))


QUERIES = {f.__name__: f for f in (
    p3_found, p3_tables, judge_scores, expected_judges, attempt_scores, prompt_normalize, prompt_ids, prompt_split, split_shares, response_combinations, pair_metrics, pair_side_scores, preferred_agreement, pair_exclusions, pairs_full,
    leakage_audit, leakage_audit_violations, duplicate_pair_ids, report_totals, report_by_split, report_by_confidence, report_by_type, report_exclusions, report_preferred, train_eligible, eval_eligible, train_capped, train_within_length, train_messages,
    manifest_counts, ngram_lm, response_logprobs, response_boundary, pair_scores, skip_reasons, eval_overall, eval_by_confidence, eval_by_type, eval_by_margin_bucket, eval_subgroups, paired_id_audit, token_parity_audit, token_parity_violations, relative_details, compare_primary,
    compare_secondary, compare_behavior, final_results, mcnemar_exact, dpo_loss_mean, bootstrap_hashed, bootstrap_exact_mt, bootstrap_poisson, tensor_change, tuning_rank, tuning_winner, tuning_warmup, policy_fingerprint, tuning_grid, table_fingerprint, io_jsonl, io_jsonl_keyed, io_csv, io_parquet_by_split)}
QUERIES |= {f"p3_{name}": _flat(name) for name in ("evaluations", "judgments", "scores")}
QUERIES |= {"bootstrap_accuracy": _interval("implicit_reward_correct", 42), "bootstrap_margin": _interval("implicit_reward_margin", 43), "bootstrap_delta": _interval("absolute_accuracy_delta", 44)}

from prefloom.plans.sql import SQL  # noqa: E402,F401

"""Scoring pairs by log-probability.

A scorer has ``score(rows, max_length)``: of ``rows`` (key, prompt, response; no nulls, each key once) it gives key, prompt_tokens, token_count,
logprob_sum, logprob_mean and skip_reason, one row for each key. ``UnigramScorer`` is built in, in plain relational operators; ``batch_scorer``
makes one of a function over lists; ``TokenScorer`` of a tokenizer and a model, which each Python worker loads once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.rows import beside
from prefloom.functions.stats import close, positive

SCORED = "key binary, prompt_tokens bigint, token_count bigint, logprob_sum double, logprob_mean double, skip_reason string"


class Scorer(Protocol):
    def score(self, rows: DataFrame, max_length: int) -> DataFrame: ...


MARKER = "<|response-begins-here|>"


def tokens(text: Column) -> Column:
    """Runs of lower-case ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def token_counts(corpus: DataFrame, text_col: str) -> DataFrame:
    """token, n over all texts: what a unigram model is made of. Land it where several models or passes need it."""
    return corpus.select(F.explode(tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def conversation_key(prompt: Column, response: Column) -> Column:
    """128 bits that stand for a prompt and a response."""
    return F.unhex(F.md5(F.concat(F.md5(prompt), F.md5(response))))


class UnigramScorer:
    """Add-one unigram model given the prompt: a token's probability is (count + 1 + its count in the prompt) / (tokens + vocabulary + tokens of
    the prompt). The vocabulary is given by the caller so that models can share it."""

    def __init__(self, corpus: DataFrame | None = None, text_col: str = "text", vocabulary: DataFrame | None = None, counts: DataFrame | None = None):
        self.counts = counts if counts is not None else token_counts(corpus, text_col)
        self.vocabulary = vocabulary if vocabulary is not None else self.counts.select("token")

    def totals(self) -> DataFrame:
        """One row: total (tokens of the corpus) and size (of the vocabulary)."""
        return beside(self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")), self.vocabulary.distinct().agg(F.count("*").alias("size")))

    def logprobs(self) -> DataFrame:
        """token, logprob for the vocabulary after an empty prompt."""
        v = self.vocabulary.distinct().join(self.counts, "token", "left")
        return beside(v, self.totals()).select("token", F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("total") + F.col("size"))).alias("logprob"))

    def score(self, rows: DataFrame, max_length: int = 1024) -> DataFrame:
        """Means are kept to twelve decimals, so that equal bags of words tie."""
        t = rows.select("key", (F.col("response") == "").alias("void"), tokens(F.col("prompt")).alias("before"), tokens(F.col("response")).alias("after"))
        heads = t.select("key", "void", F.size("before").cast("bigint").alias("prompt_tokens"), F.size("after").cast("bigint").alias("token_count"))
        both = F.concat(F.transform("after", lambda x: F.struct(x.alias("token"), F.lit(1).alias("r"))), F.transform("before", lambda x: F.struct(x.alias("token"), F.lit(0).alias("r"))))
        bag = (t.select("key", F.size("before").alias("len"), F.explode(both).alias("x")).groupBy("key", "len", F.col("x.token").alias("token"))
               .agg(F.sum("x.r").alias("c"), F.count(F.when(F.col("x.r") == 0, 1)).alias("in_prompt")).where("c > 0"))
        known = self.counts.join(self.vocabulary.distinct(), "token", "left_semi")
        p = (F.coalesce("n", F.lit(0)) + 1.0 + F.col("in_prompt")) / (F.col("total") + F.col("size") + F.col("len"))
        summed = beside(bag.join(known, "token", "left"), self.totals()).groupBy("key").agg(F.sum(F.col("c") * F.log(p)).alias("s"))
        return heads.join(summed, "key", "left").select("key", "prompt_tokens", "token_count", F.round("s", 11).alias("logprob_sum"), F.round(F.col("s") / F.col("token_count"), 12).alias("logprob_mean"),
                                                        F.when(F.col("void"), "empty_response").when(F.col("token_count") == 0, "empty_tokenized_response").alias("skip_reason"))


class _Batches:
    """A scorer over Arrow batches: ``scored(prompts, responses, max_length)`` gives (prompt_tokens, token_count, logprob_sum, skip_reason) for each row."""

    def __init__(self, load: Callable[[], Callable]):
        self.load = load

    def score(self, rows: DataFrame, max_length: int = 1024) -> DataFrame:
        load = self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scored = load()  # once per task
            for b in batches:
                out = [(k, p, n, s if why is None else None, s / n if why is None and n else None, why) for k, (p, n, s, why) in zip(b["key"], scored(list(b["prompt"]), list(b["response"]), max_length))]
                f = pd.DataFrame(out, columns=["key", "prompt_tokens", "token_count", "logprob_sum", "logprob_mean", "skip_reason"])
                yield f.astype({"prompt_tokens": "int64", "token_count": "int64", "logprob_sum": "float64", "logprob_mean": "float64", "skip_reason": "object"})

        return rows.select("key", "prompt", "response").mapInPandas(run, SCORED)


def batch_scorer(score: Callable[[list[str], list[str]], list[tuple[float, int]]]) -> Scorer:
    """A scorer from a function: lists of prompts and responses in, (sum of log-probabilities, tokens) out. Prompts are measured by the built-in tokenizer."""

    def load():
        import re

        def scored(prompts: list[str], responses: list[str], max_length: int) -> list[tuple]:
            return [(len(re.findall("[a-z0-9]+", p.lower())), int(n), float(s), "empty_response" if not r else None if n else "empty_tokenized_response") for p, r, (s, n) in zip(prompts, responses, score(prompts, responses))]

        return scored

    return _Batches(load)


def TokenScorer(load: Callable[[], Any]) -> Scorer:
    """A scorer from a language model. ``load()`` gives an object with ``render(prompt, response)`` (the conversation as text), ``encode(text)``
    (token ids and their character offsets) and ``logprobs(list of ids)`` (for each list the log-probability of every token after the first,
    given those before it). The response begins where ``boundary`` finds it; only its tokens count. Conversations longer than
    ``max_length`` tokens don't reach the model."""

    def make():
        model = load()

        def scored(prompts: list[str], responses: list[str], max_length: int) -> list[tuple]:
            out, open_, ids = [], [], []
            for p, r in zip(prompts, responses):
                try:
                    start, tokens_ = boundary(p, r, model.render, model.encode)
                except ValueError as e:
                    out.append((0, 0, None, str(e)))
                    continue
                out.append((start, len(tokens_) - start, None, "over_max_length" if len(tokens_) > max_length else None))
                if len(tokens_) <= max_length:
                    open_.append(len(out) - 1)
                    ids.append(tokens_)
            for k, lp in zip(open_, model.logprobs(ids) if ids else ()):
                start, n, _, _ = out[k]
                out[k] = (start, n, float(sum(lp[max(start - 1, 0):])), None)
            return out

        return scored

    return _Batches(make)


def response_start(rendered_before: Column, rendered_after: Column) -> Column:
    """Index of the first token that ends after the response begins, of the built-in tokenizer over the rendered conversation."""
    whole = F.concat(rendered_before, rendered_after)
    t = tokens(whole)
    # tokens wholly before the response; a token that straddles the border already belongs to the response
    head = F.size(tokens(rendered_before))
    straddles = rendered_before.rlike("(?i)[a-z0-9]$") & rendered_after.rlike("(?i)^[a-z0-9]")
    start = head - F.when(straddles, 1).otherwise(0)
    return F.when(F.size(tokens(rendered_after)) == 0, F.lit(None)).otherwise(F.least(start, F.size(t) - 1))


def boundary(prompt: str, response: str, render: Callable[[str, str], str], encode: Callable[[str], tuple[list[int], list[tuple[int, int]]]]) -> tuple[int, list[int]]:
    """Position of the first response token, and all token ids: a marker before the response is found in the rendered conversation and taken
    out, and the first token with text that ends behind that place is the start."""
    if not response:
        raise ValueError("empty_response")
    mark = MARKER
    while mark in prompt or mark in response:
        mark += "_"
    marked = render(prompt, mark + response)
    if marked.count(mark) != 1:
        raise ValueError("response_boundary_marker_not_found")
    at = marked.index(mark)
    ids, offsets = encode(marked.replace(mark, ""))
    for k, (start, end) in enumerate(offsets):
        if end > at and end > start:
            return k, list(ids)
    raise ValueError("empty_tokenized_response")


def score_pairs(pairs: DataFrame, scorer: Scorer, max_length: int = 1024) -> DataFrame:
    """Detail rows, evaluated and skipped: the skipped have a skip_reason and no scores. Every pair keeps its row; null texts count as empty.

    Each distinct conversation is scored once and joined by 128-bit keys, so texts don't move but to the scorer.
    """
    p = pairs.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("prompt", "chosen", "rejected")})
    p = p.withColumns({f"{c}_key": conversation_key(F.col("prompt"), F.col(c)) for c in ("chosen", "rejected")})
    sides = F.array(*[F.struct(F.col(f"{c}_key").alias("key"), F.col(c).alias("response")) for c in ("chosen", "rejected")])
    s = scorer.score(p.select("prompt", F.explode(sides).alias("x")).select("x.key", "prompt", "x.response").dropDuplicates(["key"]), max_length)
    side = lambda x: s.select(F.col("key").alias(f"{x}_key"), F.col("prompt_tokens").alias(f"{x}_prompt_tokens"), F.col("token_count").alias(f"{x}_token_count"), F.col("logprob_sum").alias(f"{x}_logprob_sum"), F.col("logprob_mean").alias(f"{x}_logprob_per_token"), F.col("skip_reason").alias(f"{x}_skip"))
    d = p.select("pair_id", "prompt_id", "split", "label_confidence", "label_margin", "comparison_type", "chosen_key", "rejected_key").join(side("chosen"), "chosen_key").join(side("rejected"), "rejected_key")
    longest = F.greatest(F.col("chosen_prompt_tokens") + F.col("chosen_token_count"), F.col("rejected_prompt_tokens") + F.col("rejected_token_count"))
    reason = F.coalesce("chosen_skip", "rejected_skip", F.when(longest > max_length, "over_max_length"))
    m = F.when(reason.isNull(), F.col("chosen_logprob_per_token") - F.col("rejected_logprob_per_token"))
    return d.select("pair_id", "prompt_id", "split", "label_confidence", "label_margin", "comparison_type", "chosen_logprob_per_token", "rejected_logprob_per_token", "chosen_logprob_sum", "rejected_logprob_sum", "chosen_token_count", "rejected_token_count",
                    m.alias("model_margin"), positive(m).alias("correct"), close(m, 1e-12).alias("tie"), reason.alias("skip_reason"))


def evaluated(details: DataFrame) -> DataFrame:
    return details.where("skip_reason is null").drop("skip_reason")


def skip_reasons(details: DataFrame) -> DataFrame:
    return details.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))

"""One grade per judged response from judges who disagree (problem 1).

Method: minimax conditional entropy. A judge i facing a response j of true grade c gives grade k with probability proportional
to exp(sigma_i[c, k] + tau_j[c, k]): sigma tilts by judge, tau by response. Both are fitted by ascent on the dual with quadratic
regularisation, block by block (diagonal Newton steps), in turn with the posterior of the grade:

    sum_j sum_c Q_j(c) sum_i log P_ij(x_ij | c) + H(Q) - alpha/2 |sigma|^2 - beta/2 |tau|^2

Each pass over the data is one ``mapInPandas`` that holds a batch of responses: given sigma it fits Q and tau of each response to
convergence of a few rounds and adds up the gradient and curvature of sigma, so tau needs no table of its own. A task returns one
row per judge and cell; the driver holds sigma only, whose size is judges x 25 (checked against ``max_judges``).

Votes: attempts of one judge on one response are one vote, the mean of the attempts; a vote between two grades is shared between
them. The response that is scored again and again is reduced to one vote per judge before it is gathered, so no row grows
with the data.

Defined cases: scores that are null, NaN, infinite or outside 1 to 5, failed attempts and unknown judges don't count; the same
attempt delivered twice counts once; ties of the posterior go to the lower grade; responses with fewer than ``min_judges`` judges
help to fit but get no row; a null record or source is no response; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.plans.lineage import drop, land

K = 5


def judge_name(c):
    """Judge names that differ in case, padding or ``_`` for ``-`` are one; blank is null."""
    s = F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\s ​]+|[\s ​]+$", ""), "_", "-"))
    return F.when(s != "", s)


def usable(evaluations: DataFrame) -> DataFrame:
    """record_id, source, judge, attempt, score of the attempts that count."""
    s = F.col("judge_score")
    return (evaluations.select("record_id", "source", judge_name(F.col("judge_model")).alias("judge"), "attempt", "judge_score", F.lower(F.trim("status")).alias("status"))
            .where((F.col("status") == "success") & F.col("judge").isNotNull() & ~F.isnan(s) & (s >= 1) & (s <= 5) & F.col("record_id").isNotNull() & F.col("source").isNotNull())
            .select("record_id", "source", "judge", "attempt", F.col("judge_score").alias("score")))


def votes(evaluations: DataFrame) -> DataFrame:
    """record_id, source, judge, score: one vote per judge and response, the mean over distinct attempts."""
    once = usable(evaluations).groupBy("record_id", "source", "judge", "attempt").agg(F.avg("score").alias("score"))
    return once.groupBy("record_id", "source", "judge").agg(F.avg("score").alias("score"))


def responses(evaluations: DataFrame) -> DataFrame:
    """record_id, source, judges, scores: the votes on each response, at most one per judge."""
    v = votes(evaluations).groupBy("record_id", "source").agg(F.sort_array(F.collect_list(F.struct("judge", "score"))).alias("v"))
    return v.select("record_id", "source", F.col("v.judge").alias("judges"), F.col("v.score").alias("scores"))


def spread(scores: np.ndarray) -> np.ndarray:
    """Votes as weights on the grades 1 to 5; a vote between two grades is shared in proportion."""
    lo = np.clip(np.floor(scores).astype(int), 1, K - 1)
    w = np.zeros((len(scores), K))
    rows = np.arange(len(scores))
    w[rows, lo - 1] = 1 - (scores - lo)
    w[rows, lo] += scores - lo
    return w


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _fit_group(judge: np.ndarray, w: np.ndarray, sigma: np.ndarray, prior: np.ndarray, beta: float, rounds: int):
    """(q, p, value) of items that have equally many votes: ``judge`` (votes x items) and ``w`` (grade x votes x items); q is (true grade x items), p is
    (grade x true grade x votes x items), value the dual objective of each item. Sums run over leading axes, which is where they are cheap."""
    base = np.ascontiguousarray(sigma.astype(np.float32).transpose(2, 1, 0)[:, :, judge])
    tau = np.zeros((K, K, judge.shape[1]), np.float32)
    given, mass = w.sum(axis=1)[:, None, :], w.sum(axis=0)
    log_prior = np.log(prior)[:, None]
    for r in range(rounds):
        z = base + tau[:, :, None, :]
        z -= z.max(axis=0)
        p = np.exp(z)
        total = p.sum(axis=0)
        p /= total
        # log-probability of the votes under each true grade, without the logarithms of all cells
        ll = np.einsum("kcvn,kvn->cn", z, w) - (np.log(total) * mass).sum(axis=1)
        q = log_prior + ll
        top = q.max(axis=0)
        q = np.exp(q - top)
        sums = q.sum(axis=0)
        q /= sums
        if r < rounds - 1:
            q4 = q.astype(np.float32)
            expected = p.sum(axis=2)
            curved = expected - np.einsum("kcvn,kcvn->kcn", p, p)
            tau += (q4 * (given - expected) - beta * tau) / (beta + q4 * curved)
    return q, p, top + np.log(sums) - beta / 2 * (tau.astype(float) ** 2).sum(axis=(0, 1))


def fit_block(item: np.ndarray, judge: np.ndarray, w: np.ndarray, n: int, sigma: np.ndarray, prior: np.ndarray, beta: float, rounds: int = 4, first: bool = False, weight: np.ndarray | None = None):
    """(Q, gradient, curvature, value) for one batch: ``item`` and ``judge`` index the votes ``w``, sorted by item; an item counts ``weight`` times. The
    value is the items' part of the dual objective at the given sigma. Items with equally many votes are fitted together."""
    q, g, h, value = np.tile(prior, (n, 1)), np.zeros_like(sigma), np.zeros_like(sigma), 0.0
    weight = np.ones(n) if weight is None else weight
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(item)])
    for v in np.unique(sizes):
        at = starts[sizes == v]
        who = item[at]
        votes = at[None, :] + np.arange(v)[:, None]
        ww = np.ascontiguousarray(w[votes].transpose(2, 0, 1), np.float32)
        if first:  # start: the votes themselves, smoothed
            qs = ww.sum(axis=1).astype(float) + 0.2
            qs /= qs.sum(axis=0)
            p = np.full((K, K, *votes.shape), 1 / K, np.float32)
        else:
            qs, p, each = _fit_group(judge[votes], ww, sigma, prior, beta, rounds)
            value += float((weight[who] * each).sum())
        q[who] = qs.T
        qw = (qs * weight[who]).astype(np.float32)[None, :, None, :]
        jv = judge[votes].ravel()
        order = np.argsort(jv, kind="stable")
        edge = np.flatnonzero(np.r_[True, jv[order][1:] != jv[order][:-1]])
        for out, x in ((g, qw * (ww[:, None] - p)), (h, qw * (p * (1 - p)))):
            out[jv[order][edge]] += np.add.reduceat(x.reshape(K, K, -1)[:, :, order], edge, axis=2, dtype=float).transpose(2, 1, 0)
    return q, g, h, value


def _flat(b: pd.DataFrame, index: dict[str, int]):
    sizes = b["scores"].map(len).to_numpy()
    item = np.repeat(np.arange(len(b)), sizes)
    judge = np.fromiter((index[x] for v in b["judges"] for x in v), int, int(sizes.sum()))
    return item, judge, spread(np.concatenate(b["scores"].to_numpy()).astype(float))


def _pass(judges: list[str], sigma: np.ndarray, prior: np.ndarray, beta: float, first: bool):
    index = {x: i for i, x in enumerate(judges)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h, m, value = np.zeros_like(sigma), np.zeros_like(sigma), np.zeros(K), 0.0
        for b in batches:
            if len(b):
                weight = b["n"].to_numpy(float)
                q, dg, dh, dv = fit_block(*_flat(b, index), len(b), sigma, prior, beta, first=first, weight=weight)
                g += dg
                h += dh
                m += (q * weight[:, None]).sum(axis=0)
                value += dv
        cell = np.arange(g.size)
        yield pd.DataFrame({"cell": np.r_[cell, -1 - np.arange(K + 1)], "g": np.r_[g.ravel(), m, value], "h": np.r_[h.ravel(), np.zeros(K + 1)]})

    return run


class Fit:
    """Judges with their parameters ``sigma`` and the distribution ``prior`` of grades; ``dual`` has the objective before each pass, ``moved`` the
    largest step of the last, and ``converged`` says whether that fell below the tolerance."""

    def __init__(self, judges: list[str], sigma: np.ndarray, prior: np.ndarray, beta: float, passes: int, dual: list[float], moved: float, converged: bool):
        self.judges, self.sigma, self.prior, self.beta, self.passes, self.dual, self.moved, self.converged = judges, sigma, prior, beta, passes, dual, moved, converged

    def confusion(self) -> np.ndarray:
        """P(given grade | true grade) per judge, for a response without a tilt of its own."""
        return np.exp(_log_softmax(self.sigma))


def fit(packed: DataFrame, alpha: float = 1.0, beta: float = 4.0, passes: int = 60, tol: float = 0.02, max_judges: int = 20_000) -> Fit:
    """Alternate posteriors and judge parameters over ``packed`` (see ``responses``), which should be landed, until no parameter moves by ``tol``.

    Responses with the same votes of the same judges are one pattern with a weight, so a pass costs as much as there are different patterns.
    The dual objective is tracked: where a block step lowers it, the step is taken back by half until it doesn't. A fit that has not
    converged after ``passes`` passes says so with a warning and in ``converged``.
    """
    rows = packed.select(F.explode("judges").alias("j")).distinct().orderBy("j").limit(max_judges + 1).collect()
    if len(rows) > max_judges:
        raise ValueError(f"more than {max_judges} judges: their parameters would not fit the driver")
    judges = [r["j"] for r in rows]
    sigma, prior = np.zeros((len(judges), K, K)), np.full(K, 1 / K)
    if not judges:
        return Fit(judges, sigma, prior, beta, 0, [], 0.0, True)
    patterns = land(packed.groupBy("judges", "scores").agg(F.count("*").alias("n")))

    def sums(sigma: np.ndarray, prior: np.ndarray, first: bool):
        got = patterns.mapInPandas(_pass(judges, sigma, prior, beta, first), "cell int, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # judges x 25 + 6 rows
        g, h, m, value = np.zeros(sigma.size), np.zeros(sigma.size), np.ones(K), -alpha / 2 * float((sigma**2).sum())
        for r in got:
            if r["cell"] >= 0:
                g[r["cell"]], h[r["cell"]] = r["g"], r["h"]
            elif r["cell"] == -1 - K:
                value += r["g"]
            else:
                m[-1 - r["cell"]] += r["g"]
        return g.reshape(sigma.shape), h.reshape(sigma.shape), m, value

    dual, step, moved, n = [], None, np.inf, 0
    g, h, m, value = sums(sigma, prior, True)
    while n < passes:
        n += 1
        step = np.clip((g - alpha * sigma) / (h + alpha), -2, 2)
        sigma, prior = sigma + step, m / m.sum()
        moved = float(np.abs(step).max())
        if moved < tol:
            break
        g, h, m, value = sums(sigma, prior, False)
        while dual and value < dual[-1] - 1e-6 * abs(dual[-1]) and np.abs(step).max() > tol / 8 and n < passes:
            n += 1
            step = step / 2
            sigma = sigma - step
            g, h, m, value = sums(sigma, prior, False)
        dual.append(value)
    converged = moved < tol
    if not converged:
        warnings.warn(f"the fit has not converged after {passes} passes: a parameter still moved by {moved:.3f}", stacklevel=2)
    drop(patterns)
    return Fit(judges, sigma, prior, beta, n, dual, moved, converged)


def _agreement(item: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Share of judge pairs that give the same grade (votes between grades agree in part); null below two judges."""
    total = np.zeros((n, K))
    own = np.zeros(n)
    np.add.at(total, item, w)
    np.add.at(own, item, (w**2).sum(axis=1))
    m = total.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m > 1, ((total**2).sum(axis=1) - own) / (m * (m - 1)), np.nan)


def grades(packed: DataFrame, model: Fit, min_judges: int = 3) -> DataFrame:
    """record_id, source, grade, probability, agreement, n_judges."""
    index = {x: i for i, x in enumerate(model.judges)}
    sigma, prior, beta = model.sigma, model.prior, model.beta

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            item, judge, w = _flat(b, index)
            q = fit_block(item, judge, w, len(b), sigma, prior, beta, rounds=6)[0]
            yield pd.DataFrame({"record_id": b["record_id"].to_numpy(), "source": b["source"].to_numpy(), "grade": (q.argmax(axis=1) + 1).astype("int32"), "probability": q.max(axis=1),
                                "agreement": _agreement(item, w, len(b)), "n_judges": b["scores"].map(len).to_numpy().astype("int32")})

    return packed.where(F.size("judges") >= min_judges).mapInPandas(run, "record_id string, source string, grade int, probability double, agreement double, n_judges int")


def found(evaluations: DataFrame) -> DataFrame:
    packed = land(responses(evaluations))
    return grades(packed, fit(packed)).select("record_id", "source", "grade")


def agreement(evaluations: DataFrame) -> DataFrame:
    packed = land(responses(evaluations))
    return grades(packed, fit(packed))


def reliability(evaluations: DataFrame) -> DataFrame:
    """judge_model, n_votes, accuracy (expected share of right grades), information (bits its grade tells about the true one), bias (mean given minus true grade)."""
    packed = land(responses(evaluations))
    m = fit(packed)
    c, p = m.confusion(), m.prior
    joint = p[None, :, None] * c
    marginal = joint.sum(axis=1, keepdims=True)
    bits = (joint * np.log2(np.maximum(c, 1e-12) / np.maximum(marginal, 1e-12))).sum(axis=(1, 2))
    k = np.arange(1, K + 1)
    rows = [(j, float((p * np.diag(c[i])).sum()), float(bits[i]), float((joint[i] * (k[None, :] - k[:, None])).sum())) for i, j in enumerate(m.judges)]
    spark = evaluations.sparkSession
    known = spark.createDataFrame(rows, "judge_model string, accuracy double, information double, bias double")
    n = packed.select(F.explode("judges").alias("judge_model")).groupBy("judge_model").agg(F.count("*").alias("n_votes"))
    return known.join(n, "judge_model").select("judge_model", "n_votes", "accuracy", "information", "bias")

"""The core queries in DuckDB's SQL, written against the tables and independent of the operators."""

from __future__ import annotations

SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _fold(c: str) -> str:
    for a, b in (("ß", "ss"), ("ſ", "s"), ("µ", "μ"), ("ς", "σ"), ("ŉ", "ʼn"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _norm(c: str) -> str:
    return _fold(f"lower(trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g')))")


def _unit(key: str) -> str:
    return f"(('0x' || substring(sha256({key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE AS {name}"


def _sum(x: str, order: str) -> str:
    """Sum with the rounding errors carried along (Neumaier), in a fixed order."""
    t = "(a.s + x.s)"
    lost = f"CASE WHEN abs(a.s) >= abs(x.s) THEN (a.s - {t}) + x.s ELSE (x.s - {t}) + a.s END"
    reduced = f"list_reduce(list({{'s': ({x})::DOUBLE, 'c': 0.0::DOUBLE}} ORDER BY {order}), lambda a, x: {{'s': {t}, 'c': a.c + ({lost})}})"
    return f"({reduced}.s + {reduced}.c)"


FIN = "CASE WHEN isfinite({0}) THEN {0} END"

# records with their prompt, id and split
RECORDS = f"""
rec AS (SELECT row_no, coalesce(id, '') AS record_id, {_strip("coalesce(instruction, '')")} AS prompt, {_norm('instruction')} AS normal, responses, evaluations, {_strip("coalesce(preferred_response, '')")} AS preferred FROM raw),
prm AS (SELECT *, substring(sha256(normal), 1, 16) AS prompt_id, CASE WHEN {_unit("'42::' || normal")} < 0.70::DOUBLE THEN 'train' WHEN {_unit("'42::' || normal")} < 0.70::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM rec)
"""
# one row per record, source and judge
JUDGES = f"""
ev AS (SELECT row_no, unnest(map_entries(evaluations)) AS m FROM raw),
jd AS (SELECT row_no, m.key AS source, unnest(m.value.judgments) AS j, generate_subscripts(m.value.judgments, 1) AS pos FROM ev),
ok AS (SELECT row_no, source, pos, {_strip('j.judge_model')} AS judge, j.scores AS scores, {FIN.format('j.score_avg')} AS a, {FIN.format('j.score_std')} AS s FROM jd WHERE lower(j.status) = 'success' AND {_strip('j.judge_model')} <> ''),
att AS (SELECT row_no, source, pos, x.judge_score AS x FROM (SELECT row_no, source, pos, unnest(scores) AS x FROM ok)),
st AS (SELECT row_no, source, pos, fsum(x) / count(x) AS mean, stddev_pop(x) AS sd, count(x) AS n FROM att WHERE isfinite(x) GROUP BY ALL),
val AS (SELECT ok.row_no, ok.source, ok.pos, ok.judge, coalesce(st.mean, ok.a) AS mean, CASE WHEN st.n > 1 THEN st.sd WHEN st.n = 1 THEN 0 ELSE coalesce(ok.s, 0) END AS repeat_std, coalesce(st.n, 0)::DOUBLE AS valid_attempts
        FROM ok LEFT JOIN st ON ok.row_no = st.row_no AND ok.source = st.source AND ok.pos = st.pos WHERE coalesce(st.mean, ok.a) IS NOT NULL),
js AS (SELECT row_no, source, judge, mean, repeat_std, valid_attempts FROM (SELECT *, row_number() OVER (PARTITION BY row_no, source, judge ORDER BY pos DESC) AS rn FROM val) WHERE rn = 1),
ex AS (SELECT row_no, count(DISTINCT {_strip('j.judge_model')})::INT AS expected_judges FROM jd WHERE {_strip('j.judge_model')} <> '' GROUP BY row_no)
"""
PAIRS = f"""
rs AS (SELECT row_no, unnest(map_keys(responses)) AS source, unnest(map_values(responses)) AS body FROM raw),
cmb AS (SELECT a.row_no, a.source AS source_a, b.source AS source_b, {_strip("coalesce(a.body, '')")} AS text_a, {_strip("coalesce(b.body, '')")} AS text_b FROM rs a JOIN rs b ON a.row_no = b.row_no AND a.source < b.source),
com AS (SELECT c.row_no, c.source_a, c.source_b, a.mean AS ma, b.mean AS mb, a.repeat_std AS sa, b.repeat_std AS sb, a.judge FROM cmb c JOIN js a ON a.row_no = c.row_no AND a.source = c.source_a JOIN js b ON b.row_no = c.row_no AND b.source = c.source_b AND a.judge = b.judge),
agg AS (SELECT row_no, source_a, source_b, count(*) AS n, {_sum('ma - mb', 'judge')} / count(*) AS delta, fsum(ma) / count(*) AS score_a, fsum(mb) / count(*) AS score_b, (fsum(sa) + fsum(sb)) / (2 * count(*)) AS sd FROM com GROUP BY ALL),
agr AS (SELECT com.row_no, com.source_a, com.source_b, count(*) FILTER (abs(ma - mb) > 1e-12 AND ((ma - mb > 0) = (delta > 0))) AS same FROM com JOIN agg USING (row_no, source_a, source_b) GROUP BY ALL),
met AS (SELECT c.*, coalesce(agg.n, 0)::INT AS n_common, coalesce(ex.expected_judges, 0)::INT AS expected_judges, coalesce(agg.delta, 0) AS delta, abs(coalesce(agg.delta, 0)) AS label_margin, score_a, score_b,
        CASE WHEN coalesce(agg.n, 0) > 0 AND agg.delta <> 0 THEN agr.same::DOUBLE / agg.n ELSE 0 END AS judge_agreement, CASE WHEN ex.expected_judges > 0 THEN coalesce(agg.n, 0)::DOUBLE / ex.expected_judges ELSE 0 END AS judge_coverage, coalesce(agg.sd, 0) AS average_repeat_std
        FROM cmb c LEFT JOIN agg USING (row_no, source_a, source_b) LEFT JOIN agr USING (row_no, source_a, source_b) LEFT JOIN ex USING (row_no)),
mez AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - average_repeat_std / 4.0::DOUBLE) AS repeat_consistency FROM met),
mes AS (SELECT *, judge_agreement * judge_coverage * repeat_consistency AS confidence_score FROM mez),
prs AS (SELECT m.row_no, source_a, source_b, record_id, prompt_id, split, prompt, preferred, substring(sha256(record_id || '::' || prompt_id || '::' || source_a || '::' || source_b), 1, 20) AS pair_id,
        CASE WHEN delta >= 0 THEN text_a ELSE text_b END AS chosen, CASE WHEN delta >= 0 THEN text_b ELSE text_a END AS rejected, CASE WHEN delta >= 0 THEN source_a ELSE source_b END AS chosen_source, CASE WHEN delta >= 0 THEN source_b ELSE source_a END AS rejected_source,
        source_a || '__vs__' || source_b AS comparison_type, CASE WHEN delta >= 0 THEN score_a ELSE score_b END AS chosen_score, CASE WHEN delta >= 0 THEN score_b ELSE score_a END AS rejected_score, delta, label_margin, confidence_score, n_common, expected_judges,
        CASE WHEN confidence_score >= 0.8::DOUBLE THEN 'high' WHEN confidence_score >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS label_confidence,
        CASE WHEN preferred IN (source_a, source_b) AND delta <> 0 THEN preferred = CASE WHEN delta > 0 THEN source_a ELSE source_b END END AS agrees,
        prompt = '' AS x1, text_a = '' OR text_b = '' AS x2, text_a = text_b AS x3, n_common < 2 AS x4, delta = 0 AS x5, label_margin < 0.1::DOUBLE AS x6, confidence_score < 0.6::DOUBLE AS x7
        FROM mes m JOIN prm USING (row_no)),
bp AS (SELECT *, NOT (x1 OR x2 OR x3 OR x4 OR x5 OR x6 OR x7) AS retain, concat_ws(',', CASE WHEN x1 THEN 'empty_prompt' END, CASE WHEN x2 THEN 'empty_response' END, CASE WHEN x3 THEN 'identical_responses' END, CASE WHEN x4 THEN 'insufficient_common_successful_judges' END,
        CASE WHEN x5 THEN 'aggregate_tie' END, CASE WHEN x6 THEN 'margin_below_threshold' END, CASE WHEN x7 THEN 'confidence_below_threshold' END) AS reasons FROM prs)
"""
ALL = f"WITH {RECORDS}, {JUDGES}, {PAIRS} "
J = f"WITH {JUDGES} "
P = f"WITH {RECORDS} "

# the delivered pairs, their eligible part and the unigram models
DELIVERED = """
dl AS (SELECT DISTINCT pair_id, record_id, prompt_id, label_margin, label_confidence, comparison_type, retain, CASE WHEN lower(trim(split)) IN ('val', 'dev') THEN 'validation' ELSE lower(trim(split)) END AS split,
       coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected FROM dpo_pairs),
el AS (SELECT * FROM dl WHERE retain AND label_confidence IN ('high', 'medium') AND coalesce(label_margin, 0) >= 0)
"""
D = f"WITH {DELIVERED} "


def _toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


LENGTH = f"(len({_toks('prompt')}) + greatest(len({_toks('chosen')}), len({_toks('rejected')})))"
MODELS = f"""
wd AS (SELECT unnest({_toks('text')}) AS token FROM documents),
wc AS (SELECT unnest({_toks('chosen')}) AS token FROM dl WHERE split = 'train'),
voc AS (SELECT token FROM wd UNION SELECT token FROM wc),
cb AS (SELECT token, count(*) AS n FROM wd GROUP BY token),
cc AS (SELECT token, count(*) AS n FROM wc GROUP BY token),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM cb)::DOUBLE AS tb, (SELECT coalesce(sum(n), 0) FROM cc)::DOUBLE AS tc, (SELECT count(*) FROM voc)::DOUBLE AS v),
lm AS (SELECT voc.token, coalesce(cb.n, 0) AS b, coalesce(cc.n, 0) AS c FROM voc LEFT JOIN cb USING (token) LEFT JOIN cc USING (token)),
txt AS (SELECT prompt AS p, chosen AS t FROM dl UNION SELECT prompt, rejected FROM dl),
prb AS (SELECT p, token, count(*) AS n FROM (SELECT p, unnest({_toks('p')}) AS token FROM (SELECT DISTINCT p FROM txt)) GROUP BY ALL),
bag AS (SELECT p, t, token, count(*) AS n FROM (SELECT p, t, unnest({_toks('t')}) AS token FROM txt) GROUP BY ALL),
ts AS (SELECT bag.p, bag.t, sum(bag.n)::BIGINT AS k, sum(bag.n * ln((coalesce(lm.b, 0) + 1.0::DOUBLE + coalesce(prb.n, 0)) / (tb + v + len({_toks('bag.p')})))) AS sb, sum(bag.n * ln((coalesce(lm.c, 0) + 1.0::DOUBLE + coalesce(prb.n, 0)) / (tc + v + len({_toks('bag.p')})))) AS sc
       FROM bag LEFT JOIN lm USING (token) LEFT JOIN prb ON prb.p = bag.p AND prb.token = bag.token, tot GROUP BY bag.p, bag.t),
sco AS (SELECT txt.p, txt.t, len({_toks('txt.p')})::BIGINT AS pk, coalesce(k, 0) AS k, round(sb, 11) AS sb, round(sb / k, 12) AS mb, round(sc, 11) AS sc, round(sc / k, 12) AS mc FROM txt LEFT JOIN ts ON ts.p = txt.p AND ts.t = txt.t),
det AS (SELECT el.*, x.k AS kc, y.k AS kr, x.sb AS xsb, x.mb AS xmb, x.sc AS xsc, x.mc AS xmc, y.sb AS ysb, y.mb AS ymb, y.sc AS ysc, y.mc AS ymc, x.pk + greatest(x.k, y.k) AS longest,
        CASE WHEN chosen = '' THEN 'empty_response' WHEN x.k = 0 THEN 'empty_tokenized_response' WHEN rejected = '' THEN 'empty_response' WHEN y.k = 0 THEN 'empty_tokenized_response' END AS void,
        CASE WHEN void IS NOT NULL THEN void WHEN longest > 1024 THEN 'over_max_length' END AS why
        FROM el JOIN sco x ON x.p = prompt AND x.t = chosen JOIN sco y ON y.p = prompt AND y.t = rejected WHERE split = 'test' AND label_margin >= 0.1),
e0 AS (SELECT pair_id, prompt_id, split, label_confidence, label_margin, comparison_type, xmb AS pc, ymb AS pr, xsb AS sc, ysb AS sr, kc, kr, xmb - ymb AS m FROM det WHERE why IS NULL),
e1 AS (SELECT pair_id, prompt_id, split, label_confidence, label_margin, comparison_type, xmc AS pc, ymc AS pr, xsc AS sc, ysc AS sr, kc, kr, xmc - ymc AS m FROM det WHERE why IS NULL),
rel AS (SELECT pair_id, e0.prompt_id, e0.m > 0 AS b, e1.m > 0 AS o, (e1.m > 0)::INT::DOUBLE - (e0.m > 0)::INT::DOUBLE AS dacc, e0.m AS bm, e1.m AS om, e1.m - e0.m AS dm, e1.sc - e0.sc AS lc, e1.sr - e0.sr AS lr, 0.1::DOUBLE * ((e1.sc - e0.sc) - (e1.sr - e0.sr)) AS im FROM e0 JOIN e1 USING (pair_id)),
per AS (SELECT prompt_id, avg((im > 0)::INT) AS ok, avg(b::INT) AS b, avg(o::INT) AS o, avg(dacc) AS dacc, avg(im) AS im FROM rel GROUP BY prompt_id)
"""
M = f"WITH {DELIVERED}, {MODELS} "
_Z = "1.959963984540054::DOUBLE"


def _wilson(s: str, n: str) -> tuple[str, str]:
    p, d = f"({s}::DOUBLE / {n})", f"(1 + {_Z} * {_Z} / {n})"
    mid = f"(({p} + {_Z} * {_Z} / (2 * {n})) / {d})"
    half = f"({_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z} * {_Z} / (4.0::DOUBLE * {n} * {n})) / {d})"
    return f"greatest(0.0::DOUBLE, {mid} - {half})", f"least(1.0::DOUBLE, {mid} + {half})"


def _metrics(key: str | None, expr: str | None = None) -> str:
    src = f"(SELECT *, {expr} AS {key} FROM e0)" if expr else "e0"
    lo, hi = _wilson("correct", "n")
    k, g = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    join = f"JOIN mac USING ({key})" if key else ", mac"
    return M + f"""
, one AS (SELECT {k}count(*) AS n, count(DISTINCT prompt_id) AS unique_prompts, count(*) FILTER (m > 0) AS correct, count(*) FILTER (abs(m) <= 1e-12) AS ties, avg((m > 0)::INT) AS acc, avg(m) AS mm, median(m) AS md, stddev_pop(m) AS sd, avg(pc) AS pc, avg(pr) AS pr FROM {src} x {g}),
mac AS (SELECT {k}avg(a) AS a FROM (SELECT {k}prompt_id, avg((m > 0)::INT) AS a FROM {src} x GROUP BY {k}prompt_id) y {g})
SELECT {k}n, unique_prompts, correct, ties, {_r('acc', 'preference_accuracy')}, {_r('mm', 'mean_model_margin')}, {_r('md', 'median_model_margin')}, {_r('sd', 'model_margin_std')}, {_r('pc', 'mean_chosen_logprob_per_token')}, {_r('pr', 'mean_rejected_logprob_per_token')},
{_r('mac.a', 'prompt_macro_accuracy')}, {_r(lo, 'accuracy_wilson_lo')}, {_r(hi, 'accuracy_wilson_hi')} FROM one {join}"""


def _bootstrap(col: str, seed: int, samples: int = 10_000) -> str:
    lo, hi = int(0.025 * (samples - 1)) + 1, int(0.975 * (samples - 1)) + 1
    return M + f"""
, v AS (SELECT {col} AS m, row_number() OVER (ORDER BY prompt_id) - 1 AS i FROM per), p AS (SELECT count(*) AS p FROM v),
dr AS (SELECT r.rep, ('0x' || substring(md5('{seed}:' || r.rep || ':' || v.i), 1, 15))::BIGINT % p.p AS i FROM (SELECT unnest(range({samples})) AS rep) r, v, p),
est AS (SELECT rep, sum(v.m) / max(p.p) AS e FROM dr JOIN v USING (i), p GROUP BY rep), o AS (SELECT e, row_number() OVER (ORDER BY e) AS k FROM est)
SELECT {_r(f'max(CASE WHEN k = {lo} THEN e END)', 'lo')}, {_r(f'max(CASE WHEN k = {hi} THEN e END)', 'hi')} FROM o HAVING count(*) > 0"""


# the nested tables: every shape of the payloads, and the typed column
NESTED = r"""
WITH j AS (SELECT row_no, payload::JSON AS d FROM raw_json WHERE json_valid(payload)),
r AS (SELECT row_no, CASE WHEN json_extract(d, '$.evaluations') IS NULL AND json_type(d, '$.record') = 'OBJECT' THEN json_extract(d, '$.record.evaluations') ELSE json_extract(d, '$.evaluations') END AS e FROM j WHERE json_type(d) = 'OBJECT'),
o AS (SELECT row_no, CASE WHEN json_type(e) = 'VARCHAR' AND json_valid(e ->> '$') THEN (e ->> '$')::JSON ELSE e END AS e FROM r),
k AS (SELECT row_no, e, unnest(json_keys(e)) AS source, generate_subscripts(json_keys(e), 1) - 1 AS evaluation_no FROM o WHERE json_type(e) = 'OBJECT'),
l AS (SELECT row_no, unnest(from_json(e, '["JSON"]')) AS b, generate_subscripts(from_json(e, '["JSON"]'), 1) AS n FROM o WHERE json_type(e) = 'ARRAY'),
s AS (SELECT row_no, source, json_extract(e, '$."' || source || '"') AS b, evaluation_no FROM k UNION ALL SELECT row_no, b ->> '$.source', b, row_number() OVER (PARTITION BY row_no ORDER BY n) - 1 FROM l WHERE json_type(b) = 'OBJECT'),
g AS (SELECT row_no, source, evaluation_no, json_extract(b, '$.judgments') AS g FROM s WHERE json_type(b) = 'OBJECT'),
gl AS (SELECT row_no, source, evaluation_no, CASE json_type(g) WHEN 'ARRAY' THEN from_json(g, '["JSON"]') WHEN 'OBJECT' THEN [g] END AS x FROM g),
jd AS (SELECT row_no, source, evaluation_no, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS judgment_no FROM gl),
sc AS (SELECT row_no, source, evaluation_no, judgment_no, t, json_extract(t, '$.scores') AS s FROM jd WHERE json_type(t) = 'OBJECT'),
sl AS (SELECT row_no, source, evaluation_no, judgment_no, CASE WHEN json_type(s) = 'ARRAY' THEN from_json(s, '["JSON"]') WHEN json_type(s) <> 'NULL' THEN [s] END AS x FROM sc),
en AS (SELECT row_no, source, evaluation_no, judgment_no, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS score_no FROM sl),
nm AS (SELECT row_no, source, evaluation_no, judgment_no, score_no, CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.judge_score') ELSE v END AS v FROM en),
ev AS (SELECT row_no, unnest(map_entries(evaluations)) AS m, generate_subscripts(map_entries(evaluations), 1) - 1 AS evaluation_no FROM raw),
ej AS (SELECT row_no, m.key AS source, evaluation_no, unnest(m.value.judgments) AS q, generate_subscripts(m.value.judgments, 1) - 1 AS judgment_no FROM ev),
es AS (SELECT row_no, source, evaluation_no, judgment_no, unnest(q.scores) AS z, generate_subscripts(q.scores, 1) - 1 AS score_no FROM ej)
"""

_CAND = """WITH g AS (SELECT c_mktsegment || ':' || n_regionkey AS candidate, count(*) AS n, round(avg(c_acctbal), -1) AS metric, round(median(c_acctbal), 2) AS margin, round(stddev_pop(c_acctbal), 2) AS loss FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
cand AS (SELECT candidate, n, CASE WHEN n % 7 = 0 THEN NULL ELSE metric END AS metric, margin, loss FROM g) """
_lo, _hi = _wilson("sum((im > 0)::INT)", "count(*)")
_MC = "n.b + n.c"

BUCKET = "CASE WHEN label_margin < 0.25 THEN '[0.10,0.25)' WHEN label_margin < 0.5 THEN '[0.25,0.50)' ELSE '[0.50,+inf)' END"

SQL: dict[str, str] = {
    "judge_scores": J + f"SELECT row_no, source, judge, {_r('mean', 'mean')}, {_r('repeat_std', 'repeat_std')}, valid_attempts FROM js",
    "expected_judges": J + "SELECT row_no, coalesce(expected_judges, 0)::INT AS expected_judges FROM raw LEFT JOIN ex USING (row_no)",
    "attempt_scores": f"SELECT record_id, source, {_strip('judge_model')} AS judge, count(*) AS attempts, {_r('avg(judge_score)', 'mean')} FROM evaluations WHERE lower(status) = 'success' AND {_strip('judge_model')} <> '' AND isfinite(judge_score) GROUP BY 1, 2, 3",
    "prompt_normalize": P + "SELECT row_no, normal FROM prm",
    "prompt_ids": P + "SELECT row_no, prompt_id FROM prm",
    "prompt_split": P + "SELECT row_no, split FROM prm",
    "split_shares": P + "SELECT split, count(*) AS records, count(DISTINCT prompt_id) AS prompts FROM prm GROUP BY split",
    "response_combinations": "WITH rs AS (SELECT row_no, unnest(map_keys(responses)) AS source FROM raw) SELECT a.row_no, a.source AS source_a, b.source AS source_b FROM rs a JOIN rs b ON a.row_no = b.row_no AND a.source < b.source",
    "pair_metrics": ALL + f"SELECT row_no, source_a, source_b, n_common, expected_judges, {', '.join(_r(c, c) for c in ('delta', 'label_margin', 'judge_agreement', 'judge_coverage', 'average_repeat_std', 'repeat_consistency', 'confidence_score'))} FROM mes",
    "pair_side_scores": ALL + f"SELECT row_no, comparison_type, chosen_source, {_r('chosen_score', 'chosen_score_common_judges')}, {_r('rejected_score', 'rejected_score_common_judges')} FROM bp",
    "preferred_agreement": ALL + "SELECT row_no, comparison_type, preferred AS raw_preferred_response, agrees AS preferred_field_agrees FROM bp",
    "pair_exclusions": ALL + "SELECT row_no, comparison_type, retain, reasons FROM bp",
    "pairs_full": ALL + f"SELECT row_no, pair_id, record_id, prompt_id, split, prompt, chosen, rejected, chosen_source, rejected_source, {_r('label_margin', 'label_margin')}, label_confidence, {_r('confidence_score', 'confidence_score')}, n_common AS common_successful_judges, expected_judges, retain FROM bp",
    "leakage_audit": ALL + "SELECT prompt_id, count(DISTINCT split) AS n_splits FROM bp GROUP BY prompt_id HAVING count(DISTINCT split) > 1",
    "leakage_audit_violations": D + "SELECT prompt_id, count(DISTINCT split) AS n_splits FROM dl GROUP BY prompt_id HAVING count(DISTINCT split) > 1",
    "duplicate_pair_ids": "SELECT pair_id, count(*) AS n FROM dpo_pairs GROUP BY pair_id HAVING count(*) > 1",
    "report_totals": ALL + "SELECT (SELECT count(*) FROM raw) AS records, count(*) AS possible_pairs, count(*) FILTER (retain) AS retained_pairs, count(DISTINCT CASE WHEN retain THEN prompt_id END) AS retained_prompts FROM bp",
    "report_by_split": ALL + "SELECT split, count(*) AS pairs, count(*) FILTER (retain) AS retained FROM bp GROUP BY split",
    "report_by_confidence": ALL + "SELECT label_confidence, count(*) AS pairs, count(*) FILTER (retain) AS retained FROM bp GROUP BY label_confidence",
    "report_by_type": ALL + "SELECT comparison_type, count(*) AS pairs, count(*) FILTER (retain) AS retained FROM bp GROUP BY comparison_type",
    "report_exclusions": ALL + "SELECT reason, count(*) AS pairs FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM bp WHERE reasons <> '') GROUP BY reason",
    "report_preferred": ALL + "SELECT count(*) FILTER (agrees) AS agrees, count(*) FILTER (NOT agrees) AS disagrees, count(*) FILTER (agrees IS NULL) AS not_applicable FROM bp",
    "train_eligible": D + "SELECT split, label_confidence, count(*) AS pairs FROM el GROUP BY ALL",
    "eval_eligible": D + "SELECT pair_id FROM el WHERE split = 'test' AND label_margin >= 0.1",
    "train_capped": D + "SELECT pair_id FROM el WHERE split = 'train' ORDER BY sha256('42::' || pair_id), pair_id LIMIT 50",
    "train_within_length": D + f"SELECT pair_id FROM el WHERE split = 'train' AND {LENGTH} <= 150",
    "train_messages": D + "SELECT 'user: ' || prompt AS prompt, 'assistant: ' || chosen AS chosen, 'assistant: ' || rejected AS rejected FROM el WHERE split = 'train'",
    "manifest_counts": D + f"SELECT split, count(*) AS before, count(*) FILTER ({LENGTH} <= 150) AS within_length, count(*) FILTER ({LENGTH} > 150) AS dropped FROM el GROUP BY split",
    "ngram_lm": M + f"SELECT token, {_r('ln((b + 1.0::DOUBLE) / (tb + v))', 'baseline')}, {_r('ln((c + 1.0::DOUBLE) / (tc + v))', 'candidate')} FROM lm, tot",
    "response_logprobs": M + f"SELECT d.pair_id, d.side, s.pk AS prompt_tokens, s.k AS token_count, {_r('s.sb', 'logprob_sum')}, {_r('s.mb', 'logprob_mean')}, CASE WHEN s.t = '' THEN 'empty_response' WHEN s.k = 0 THEN 'empty_tokenized_response' END AS skip_reason FROM (SELECT pair_id, prompt, 'chosen' AS side, chosen AS t FROM dl UNION ALL SELECT pair_id, prompt, 'rejected', rejected FROM dl) d JOIN sco s ON s.p = d.prompt AND s.t = d.t",
    # tokens of the rendered conversation by their character offsets: the first that ends behind the place where the response begins
    "response_boundary": D + """, r AS (SELECT row_number() OVER () AS i, pair_id, lower('user: ' || prompt || ' assistant: ') AS head, lower(chosen) AS tail FROM dl),
u AS (SELECT i, unnest(regexp_extract_all(head || tail, '[a-z0-9]+|[^a-z0-9]+')) AS piece, generate_subscripts(regexp_extract_all(head || tail, '[a-z0-9]+|[^a-z0-9]+'), 1) AS pos FROM r),
e AS (SELECT i, pos, regexp_matches(piece, '^[a-z0-9]') AS token, sum(length(piece)) OVER (PARTITION BY i ORDER BY pos) AS ends FROM u),
k AS (SELECT e.i, count(*) FILTER (token AND ends <= length(head)) AS start, count(*) FILTER (token AND ends > length(head)) AS own FROM e JOIN r ON e.i = r.i GROUP BY e.i)
SELECT pair_id, CASE WHEN own > 0 THEN start::INT END AS start FROM r JOIN k USING (i)""",
    "pair_scores": M + f"""SELECT pair_id, prompt_id, split, label_confidence, {_r('label_margin', 'label_margin')}, comparison_type, {_r('xmb', 'chosen_logprob_per_token')}, {_r('ymb', 'rejected_logprob_per_token')}, {_r('xsb', 'chosen_logprob_sum')}, {_r('ysb', 'rejected_logprob_sum')}, kc AS chosen_token_count, kr AS rejected_token_count,
{_r('CASE WHEN why IS NULL THEN xmb - ymb END', 'model_margin')}, CASE WHEN why IS NULL THEN xmb - ymb > 0 END AS correct, CASE WHEN why IS NULL THEN abs(xmb - ymb) <= 1e-12 END AS tie, why AS skip_reason FROM det
UNION ALL SELECT pair_id || ':void', prompt_id, split, label_confidence, {_r('label_margin', 'x').removesuffix(' AS x')}, comparison_type, NULL, {_r('ymb', 'x').removesuffix(' AS x')}, NULL, {_r('ysb', 'x').removesuffix(' AS x')}, 0, kr, NULL, NULL, NULL, 'empty_response' FROM det""",
    "skip_reasons": M + "SELECT coalesce(void, 'over_max_length') AS skip_reason, count(*) AS n FROM det WHERE void IS NOT NULL OR longest > 150 GROUP BY 1",
    "eval_overall": _metrics(None),
    "eval_by_confidence": _metrics("label_confidence"),
    "eval_by_type": _metrics("comparison_type"),
    "eval_by_margin_bucket": _metrics("label_margin_bucket", BUCKET),
    "eval_subgroups": " UNION ALL BY NAME ".join(f"SELECT '{k}' AS grouping, {'label' if k == 'overall' else k} AS label, * EXCLUDE ({'label' if k == 'overall' else k}) FROM ({q})" for k, q in (
        ("overall", f"SELECT '' AS label, * FROM ({_metrics(None)})"), ("label_confidence", _metrics("label_confidence")), ("comparison_type", _metrics("comparison_type")), ("label_margin_bucket", _metrics("label_margin_bucket", BUCKET)))),
    "paired_id_audit": M + "SELECT (SELECT count(DISTINCT pair_id) FROM e0) AS n_base, (SELECT count(DISTINCT pair_id) FROM e1) AS n_other, (SELECT count(*) FROM (SELECT pair_id FROM e0 INTERSECT SELECT pair_id FROM e1)) AS n_shared",
    "token_parity_audit": M + "SELECT pair_id FROM e0 JOIN e1 USING (pair_id) WHERE e0.kc <> e1.kc OR e0.kr <> e1.kr",
    "token_parity_violations": M + "SELECT pair_id FROM e0 WHERE label_confidence = 'high'",
    "relative_details": M + f"SELECT pair_id, prompt_id, b AS baseline_correct, o AS candidate_correct, {_r('dacc', 'absolute_accuracy_delta')}, {_r('bm', 'baseline_model_margin')}, {_r('om', 'candidate_model_margin')}, {_r('dm', 'absolute_margin_delta')}, {_r('lc', 'chosen_policy_logratio')}, {_r('lr', 'rejected_policy_logratio')}, {_r('im', 'implicit_reward_margin')}, im > 0 AS implicit_reward_correct, abs(im) <= 1e-12 AS implicit_reward_tie, abs(lc) > 1e-8 OR abs(lr) > 1e-8 AS behavior_changed FROM rel",
    "compare_primary": M + f"SELECT count(*) AS paired_n, count(DISTINCT prompt_id) AS unique_prompts, {_r('avg((im > 0)::INT)', 'implicit_reward_accuracy')}, {_r(_lo, 'implicit_reward_wilson_lo')}, {_r(_hi, 'implicit_reward_wilson_hi')}, {_r('(SELECT avg(ok) FROM per)', 'implicit_reward_prompt_macro_accuracy')}, {_r('avg(im)', 'mean_implicit_reward_margin')}, {_r('median(im)', 'median_implicit_reward_margin')}, count(*) FILTER (abs(im) <= 1e-12) AS ties FROM rel",
    "compare_secondary": M + f"SELECT {_r('avg(b::INT)', 'baseline_preference_accuracy')}, {_r('avg(o::INT)', 'candidate_preference_accuracy')}, {_r('avg(o::INT) - avg(b::INT)', 'accuracy_delta')}, {_r('(SELECT avg(b) FROM per)', 'baseline_prompt_macro_accuracy')}, {_r('(SELECT avg(o) FROM per)', 'candidate_prompt_macro_accuracy')}, {_r('(SELECT avg(dacc) FROM per)', 'prompt_macro_accuracy_delta')}, {_r('avg(bm)', 'mean_model_margin_baseline')}, {_r('avg(om)', 'mean_model_margin_candidate')}, {_r('avg(dm)', 'mean_model_margin_delta')}, count(*) FILTER (b AND NOT o) AS baseline_correct_candidate_wrong, count(*) FILTER (o AND NOT b) AS baseline_wrong_candidate_correct FROM rel",
    "compare_behavior": M + f"SELECT count(*) FILTER (abs(lc) > 1e-8 OR abs(lr) > 1e-8) AS pairs_changed, count(*) FILTER (abs(lc) > 1e-8 OR abs(lr) > 1e-8) = count(*) AS all_pairs_changed, {_r('avg(abs(lc))', 'mean_abs_chosen_policy_logratio')}, {_r('avg(abs(lr))', 'mean_abs_rejected_policy_logratio')} FROM rel",
    "final_results": M + f"SELECT 'baseline' AS model, {_r('avg(b::INT)', 'accuracy')}, {_r('(SELECT avg(b) FROM per)', 'prompt_macro_accuracy')}, {_r('avg(bm)', 'mean_margin')} FROM rel UNION ALL SELECT 'candidate', {_r('avg(o::INT)', 'a')}, {_r('(SELECT avg(o) FROM per)', 'p')}, {_r('avg(om)', 'm')} FROM rel",
    "mcnemar_exact": M + f", n AS (SELECT count(*) FILTER (b AND NOT o) AS b, count(*) FILTER (o AND NOT b) AS c FROM rel), k AS (SELECT unnest(range((SELECT least(b, c) FROM n) + 1)) AS k) SELECT n.b AS baseline_correct_candidate_wrong, n.c AS baseline_wrong_candidate_correct, {_r(f'CASE WHEN {_MC} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma({_MC} + 1.0) - lgamma(k.k + 1.0) - lgamma({_MC} - k.k + 1.0) - ({_MC}) * ln(2.0::DOUBLE))) FROM k)) END', 'mcnemar_p')} FROM n",
    "dpo_loss_mean": M + f"SELECT count(*) AS n, {_r('avg(greatest(-im, 0.0::DOUBLE) + ln(1 + exp(-abs(im))))', 'mean_loss')} FROM rel",
    "bootstrap_accuracy": _bootstrap("ok", 42),
    "bootstrap_margin": _bootstrap("im", 43),
    "bootstrap_delta": _bootstrap("dacc", 44),
    "io_jsonl": f"SELECT pair_id, record_id, split, prompt, chosen, rejected, {_r('label_margin', 'label_margin')}, common_successful_judges, preferred_field_agrees, coalesce(array_to_string(exclusion_reasons, ','), '') AS reasons FROM dpo_pairs",
    "io_jsonl_keyed": "SELECT DISTINCT pair_id FROM dpo_pairs",
    "io_csv": f"SELECT c_custkey, c_name, {_r('c_acctbal', 'c_acctbal')} FROM customer",
    "io_parquet_by_split": ALL + "SELECT split, count(*) AS pairs, count(DISTINCT pair_id) AS ids FROM bp GROUP BY split",
    "tensor_change": f"""WITH t AS (SELECT vec_id AS param, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings), u AS (SELECT param, value, CASE WHEN param % 2 = 0 THEN value + 0.001::DOUBLE * (idx % 3) ELSE value END - value AS d FROM t)
SELECT param, count(*) AS numel, bool_and(d = 0) AS exactly_equal, count(*) FILTER (d <> 0) AS changed_elements, {_r('avg(abs(d))', 'mean_absolute_change')}, {_r('max(abs(d))', 'max_absolute_change')}, {_r('sqrt(sum(d * d))', 'l2_change')}, {_r('CASE WHEN sum(value * value) > 0 THEN sqrt(sum(d * d)) / sqrt(sum(value * value)) END', 'relative_l2_change')} FROM u GROUP BY param""",
    "tuning_rank": _CAND + "SELECT candidate, metric, margin, loss, row_number() OVER (ORDER BY metric DESC NULLS LAST, margin DESC NULLS LAST, loss ASC NULLS LAST, candidate) AS place FROM cand",
    "tuning_winner": _CAND + "SELECT candidate, n, metric, margin, loss FROM cand ORDER BY metric DESC NULLS LAST, margin DESC NULLS LAST, loss ASC NULLS LAST, candidate LIMIT 1",
    "tuning_warmup": _CAND + "SELECT candidate, n, (ceil(n / 8.0) * 2)::BIGINT AS updates, greatest(1, round_even((ceil(n / 8.0) * 2)::DOUBLE * 0.1::DOUBLE, 0)::BIGINT)::BIGINT AS warmup FROM cand",
    "policy_fingerprint": """SELECT substring(sha256(to_json({'min_common_judges': 2, 'min_confidence': 0.6::DOUBLE, 'min_margin': 0.1::DOUBLE, 'score_span': 4.0::DOUBLE, 'seed': 42, 'train_share': 0.7::DOUBLE, 'validation_share': 0.15::DOUBLE})::VARCHAR), 1, 12) AS fingerprint, count(*) AS records FROM raw""",
    "tuning_grid": """WITH g AS (SELECT lr.v AS learning_rate, ep.v AS epochs, be.v AS beta FROM (VALUES (1e-7::DOUBLE), (5e-7)) lr(v), (VALUES (1.0::DOUBLE), (2.0)) ep(v), (VALUES (0.05::DOUBLE), (0.1)) be(v)),
n AS (SELECT 'c' || lpad((row_number() OVER (ORDER BY learning_rate, epochs, beta) - 1)::VARCHAR, 3, '0') AS candidate, * FROM g) SELECT * FROM n WHERE NOT (learning_rate < 2e-7 AND epochs = 1)""",
    "p3_found": NESTED + """
SELECT DISTINCT 'raw' AS origin, row_no, source, judgment_no::INT AS judgment_no, score_no::INT AS score_no FROM es WHERE isfinite(z.judge_score)
UNION ALL SELECT DISTINCT 'raw_json', row_no, source, judgment_no::INT, score_no::INT FROM nm WHERE json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') AND isfinite((v ->> '$')::DOUBLE)""",
    "p3_evaluations": NESTED + "SELECT 'raw' AS origin, row_no, evaluation_no::VARCHAR AS node, NULL::VARCHAR AS parent, m.key AS source FROM ev UNION ALL SELECT 'raw_json', row_no, evaluation_no::VARCHAR, NULL, source FROM s",
    "p3_judgments": NESTED + f"""SELECT 'raw' AS origin, row_no, evaluation_no || '.' || judgment_no AS node, evaluation_no::VARCHAR AS parent, source, q.judge_model AS judge_model, q.status AS status, {_r(FIN.format('q.score_avg'), 'score_avg')} FROM ej WHERE q IS NOT NULL
UNION ALL SELECT 'raw_json', row_no, evaluation_no || '.' || judgment_no, evaluation_no::VARCHAR, source, CASE WHEN json_type(t, '$.judge_model') = 'VARCHAR' THEN t ->> '$.judge_model' END, CASE WHEN json_type(t, '$.status') = 'VARCHAR' THEN t ->> '$.status' END,
CASE WHEN json_type(t, '$.score_avg') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') AND isfinite((t ->> '$.score_avg')::DOUBLE) THEN {_r("(t ->> '$.score_avg')::DOUBLE", 'x').removesuffix(' AS x')} END FROM sc""",
    "p3_scores": NESTED + f"""SELECT 'raw' AS origin, row_no, evaluation_no || '.' || judgment_no || '.' || score_no AS node, evaluation_no || '.' || judgment_no AS parent, source, {_r(FIN.format('z.judge_score'), 'score')} FROM es
UNION ALL SELECT 'raw_json', row_no, evaluation_no || '.' || judgment_no || '.' || score_no, evaluation_no || '.' || judgment_no, source, CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') AND isfinite((v ->> '$')::DOUBLE) THEN {_r("(v ->> '$')::DOUBLE", 'x').removesuffix(' AS x')} END FROM nm""",
    "p3_tables": NESTED + """
, c AS (SELECT 'raw' AS origin, 'evaluations.*' AS path, row_no, evaluation_no::VARCHAR AS node, NULL AS parent FROM ev UNION ALL SELECT 'raw', 'evaluations.*.judgments[]', row_no, evaluation_no || '.' || judgment_no, evaluation_no::VARCHAR FROM ej WHERE q IS NOT NULL
UNION ALL SELECT 'raw', 'evaluations.*.judgments[].scores[]', row_no, evaluation_no || '.' || judgment_no || '.' || score_no, evaluation_no || '.' || judgment_no FROM es
UNION ALL SELECT 'raw_json', 'evaluations.*', row_no, evaluation_no::VARCHAR, NULL FROM s UNION ALL SELECT 'raw_json', 'evaluations.*.judgments[]', row_no, evaluation_no || '.' || judgment_no, evaluation_no::VARCHAR FROM sc
UNION ALL SELECT 'raw_json', 'evaluations.*.judgments[].scores[]', row_no, evaluation_no || '.' || judgment_no || '.' || score_no, evaluation_no || '.' || judgment_no FROM en)
SELECT c.origin, c.path, count(*) AS n_rows, count(DISTINCT c.row_no) AS n_records, count(*) FILTER (c.parent IS NOT NULL AND u.node IS NULL) AS orphans FROM c LEFT JOIN (SELECT DISTINCT origin, row_no, node FROM c) u ON u.origin = c.origin AND u.row_no = c.row_no AND u.node = c.parent GROUP BY c.origin, c.path""",
}

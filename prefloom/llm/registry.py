"""Queries of the subpackage, over whole tables with production parameters."""

from __future__ import annotations

from prefloom.llm import answers, consensus, copies, cross_split, grouped_splits, mixing, packing, pii
from prefloom.sources.tables import table


def p1_found(spark, d):
    return consensus.found(table(spark, d, "evaluations"))


def p1_agreement(spark, d):
    return consensus.agreement(table(spark, d, "evaluations"))


def p1_reliability(spark, d):
    return consensus.reliability(table(spark, d, "evaluations"))


def p2_found(spark, d):
    return answers.found(table(spark, d, "raw"), table(spark, d, "dpo_pairs"))


def p2_all_defects(spark, d):
    """Every triggered defect of every answer, not only the first."""
    return answers.defects(answers.answers(table(spark, d, "raw"), table(spark, d, "dpo_pairs"))).distinct()


def p2_defect_counts(spark, d):
    """Counts of every triggered defect by origin and slot."""
    return p2_all_defects(spark, d).groupBy("origin", "slot", "defect").count()


def p4_found(spark, d):
    return copies.copies_found(table(spark, d, "raw"))


def p4_collapsed(spark, d):
    """One row per group with the number of its copies."""
    return copies.collapse(table(spark, d, "raw"), "row_no", "instruction").selectExpr("first as first_row_no", "n as copies")


def p5_found(spark, d):
    return cross_split.pairs_found(table(spark, d, "dpo_pairs"))


def p5_report(spark, d):
    """Overlaps per split and source."""
    return cross_split.report(table(spark, d, "dpo_pairs"), table(spark, d, "raw"))


def p5_classes(spark, d):
    """The class of every pair with a split, and how many pairs it has on either side."""
    return cross_split.classes(table(spark, d, "dpo_pairs"))


def p6_found(spark, d):
    return grouped_splits.separated(table(spark, d, "dpo_pairs"), table(spark, d, "raw"))


def p6_assigned(spark, d):
    """The new split of every pair."""
    return grouped_splits.assign_pairs(table(spark, d, "dpo_pairs"), table(spark, d, "raw"))


def p6_groups(spark, d):
    """The new split of every linked group."""
    return grouped_splits.assign(table(spark, d, "dpo_pairs"), table(spark, d, "raw"))


def p7_packed(spark, d):
    """Every piece of every document with its container, for each kind of container."""
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p7_usage(spark, d):
    return packing.usage(packing.packed(table(spark, d, "documents"), table(spark, d, "pack_capacities")), table(spark, d, "pack_capacities"))


def p8_mixed(spark, d):
    """The documents of each mix and how often each is used."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark, d):
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    return pii.found(table(spark, d, "documents"), table(spark, d, "roster"))


def p9_redacted(spark, d):
    """Every document with typed placeholders."""
    return pii.redacted(table(spark, d, "documents"), table(spark, d, "roster"))


QUERIES = {"p1_found": p1_found, "p1_agreement": p1_agreement, "p1_reliability": p1_reliability, "p2_found": p2_found, "p2_all_defects": p2_all_defects, "p2_defect_counts": p2_defect_counts, "p4_found": p4_found, "p4_collapsed": p4_collapsed, "p5_found": p5_found, "p5_report": p5_report, "p5_classes": p5_classes, "p6_found": p6_found, "p6_assigned": p6_assigned, "p6_groups": p6_groups, "p7_packed": p7_packed, "p7_usage": p7_usage, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p9_found": p9_found, "p9_redacted": p9_redacted}
#: The other queries can't be put in SQL that ends in time on whole tables; tests compare them with brute force on small ones.
SQL: dict[str, str] = {
    "p6_found": """
WITH RECURSIVE sp AS (SELECT prompt_id, record_id, CASE WHEN lower(trim(split)) IN ('val', 'dev') THEN 'validation' ELSE lower(trim(split)) END AS split FROM dpo_pairs WHERE prompt_id IS NOT NULL),
au AS (SELECT DISTINCT id, trim(author_id) AS author FROM raw WHERE trim(author_id) <> '' AND lower(trim(author_id)) <> 'unknown'),
e AS (SELECT DISTINCT prompt_id, 'r:' || record_id AS x FROM sp WHERE record_id IS NOT NULL UNION SELECT DISTINCT prompt_id, 'a:' || author FROM sp JOIN au ON sp.record_id = au.id),
lk AS (SELECT DISTINCT a.prompt_id AS a, b.prompt_id AS b FROM e a JOIN e b USING (x)),
rc AS (SELECT DISTINCT prompt_id AS a, prompt_id AS b FROM sp UNION SELECT rc.a, lk.b FROM rc JOIN lk ON rc.b = lk.a),
g AS (SELECT a AS prompt_id, min(b) AS group_prompt_id FROM rc GROUP BY a),
t AS (SELECT group_prompt_id FROM g JOIN sp USING (prompt_id) WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT prompt_id, group_prompt_id FROM g WHERE group_prompt_id IN (SELECT group_prompt_id FROM t)""",
}

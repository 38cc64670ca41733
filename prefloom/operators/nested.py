"""Nested records to related flat tables (problem 3).

Method: Dewey labelling. Every node of a record gets an ordinal path such as ``0.2.1`` (position among its siblings at each
level) and a schema path such as ``evaluations.*.judgments[].scores[]``. The parent's label is the label without its last
number, and the nodes of one schema path form one table, so any level can be joined to the one above it.

Two front ends make the same nodes: ``typed_*`` explode declared columns inside the JVM; ``json_nodes`` parses text whose shape
varies from line to line, in Arrow batches.

Defined cases: null containers and null elements hold their position but have no children; a single object (or number) where
a list is expected is its only element, at position 0; text that is not one complete JSON document yields nothing; JSON inside
a JSON string is opened where a container is expected; repeated keys: the last wins; an empty table gives empty tables;
extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "id bigint, dewey array<int>, path string, name string, kind string, number double, text string"


_LEXEME = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null|NaN|-?Infinity)|(")|$)')
_WORDS = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def parse(text: str):
    """The value of a complete JSON text, however deep; ValueError for any other text."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """The same without recursion: open containers on a stack, each with the key that waits for its value."""
    at, stack, state = 0, [], "value"
    while True:
        m = _LEXEME.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, number, word, quote = m.groups()
        if quote:
            value, at = scanstring(text, at, True)
            if state in ("key", "first key"):
                stack[-1][1], state = value, "colon"
                continue
        elif number:
            value = int(number) if number.lstrip("-").isdigit() else float(number)
        elif word:
            value = _WORDS[word]
        elif sign in ("{", "[") and state in ("value", "first value"):
            stack.append([{} if sign == "{" else [], None])
            state = "first key" if sign == "{" else "first value"
            continue
        elif sign == ":" and state == "colon":
            state = "value"
            continue
        elif sign == "," and state == "after" and stack:
            state = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif sign in ("}", "]") and stack and state in ("after", "first key", "first value") and isinstance(stack[-1][0], dict) == (sign == "}"):
            value, state = stack.pop()[0], "value"
        else:
            raise ValueError(f"no JSON at {at}")
        if state not in ("value", "first value"):
            raise ValueError(f"no JSON at {at}")
        if not stack:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(f"no JSON at {at}")
            return value
        top, key = stack[-1]
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        state = "after"


def _opened(value):
    """A container; JSON text that holds one is opened."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = parse(value)
        except ValueError:
            return value
    return value


def walk(value, path: str = "$", dewey: tuple[int, ...] = (), name: str | None = None, keep=None) -> Iterator[tuple]:
    """Nodes of a parsed document in document order, without recursion: (dewey, path, name, kind, number, text)."""
    stack = [(value, path, dewey, name)]
    while stack:
        v, p, d, k = stack.pop()
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        number = None
        if kind == "number":
            try:
                number = float(v)
            except OverflowError:
                number = math.inf
        yield d, p, k, kind, number, v if kind == "string" else None
        if kind == "string" and v.lstrip()[:1] in ("{", "["):
            v = _opened(v)
            kind = "array" if isinstance(v, list) else "object" if isinstance(v, dict) else kind
        if kind == "object":
            children = [(x, f"{p}.{key}", (*d, i), key) for i, (key, x) in enumerate(v.items())]
        elif kind == "array":
            children = [(x, f"{p}[]", (*d, i), None) for i, x in enumerate(v)]
        else:
            continue
        stack.extend(c for c in reversed(children) if keep is None or keep(c[1]))


def json_nodes(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """All nodes of the JSON documents in ``json_col``: id, dewey, path, name, kind, number, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                try:
                    doc = parse(t)
                except ValueError:
                    continue
                out.extend((i, list(n[0]), *n[1:]) for n in walk(doc))
            yield pd.DataFrame(out, columns=["id", "dewey", "path", "name", "kind", "number", "text"])

    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(json_col).cast("string").alias("text")).where("text is not null").mapInPandas(run, NODES)


def with_parent(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent``: the label without its last number (null at the root)."""
    return nodes.withColumn("parent", F.when(F.size("dewey") > 0, F.slice("dewey", F.lit(1), F.size("dewey") - 1)))


def path_table(nodes: DataFrame, path: str) -> DataFrame:
    """The flat table of one schema path: key, parent key and values of its nodes."""
    return with_parent(nodes.where(F.col("path") == path))


LEVEL = "path string, dewey array<int>, source string, judge_model string, status string, score_avg double, score double"
#: Schema paths of the three tables of a judged record; a judgment's label is evaluation.judgment, a score's one number longer.
EVALUATION, JUDGMENT, SCORE = "evaluations.*", "evaluations.*.judgments[]", "evaluations.*.judgments[].scores[]"


def _number(v):
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    try:
        v = float(v)
    except OverflowError:
        return None
    return v if math.isfinite(v) else None


def _text(v):
    return v if isinstance(v, str) else None


def _listed(value) -> list:
    """A list as it is; null: none; a single item: itself at position 0."""
    value = _opened(value)
    return value if isinstance(value, list) else [] if value is None else [value]


def _evaluations(doc) -> list[tuple[str | None, object]]:
    """Source and body of each evaluation, from a mapping by source, a list of objects with ``source``, or one such object."""
    doc = _opened(doc)
    if not isinstance(doc, dict):
        return []
    if "evaluations" not in doc and isinstance(_opened(doc.get("record")), dict):
        doc = _opened(doc["record"])
    found = _opened(doc.get("evaluations"))
    if isinstance(found, dict):
        if "source" in found and "judgments" in found and isinstance(found["source"], str):
            return [(found["source"], found)]
        return [(k, _opened(v)) for k, v in found.items()]
    if isinstance(found, list):
        out = []
        for e in map(_opened, found):
            if isinstance(e, dict):
                if "source" in e:
                    out.append((_text(e["source"]), e))
                else:
                    out.extend((k, _opened(v)) for k, v in e.items())
        return out
    return []


def judged(doc) -> Iterator[tuple]:
    """Labelled nodes of the levels evaluation, judgment and score of one parsed record, in document order (see LEVEL)."""
    for e, (source, body) in enumerate(_evaluations(doc)):
        yield EVALUATION, [e], source, None, None, None, None
        judgments = body.get("judgments") if isinstance(body, dict) else body if isinstance(body, list) else None
        for j, judgment in enumerate(map(_opened, _listed(judgments))):
            if not isinstance(judgment, dict):
                continue
            yield JUDGMENT, [e, j], source, _text(judgment.get("judge_model")), _text(judgment.get("status")), _number(judgment.get("score_avg")), None
            for k, entry in enumerate(_listed(judgment.get("scores"))):
                yield SCORE, [e, j, k], source, None, None, None, _number(entry.get("judge_score") if isinstance(entry, dict) else entry)


def json_levels(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The labelled nodes of judged records in JSON text: id and the columns of LEVEL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", *(c.split()[0] for c in LEVEL.split(", "))]
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"]):
                try:
                    doc = parse(t)
                except ValueError:
                    continue
                out.extend((i, *r) for r in judged(doc))
            f = pd.DataFrame(out, columns=names)
            yield f.astype({"score_avg": "float64", "score": "float64"})

    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(json_col).cast("string").alias("text")).where("id is not null and text is not null").mapInPandas(run, "id bigint, " + LEVEL)


def _finite(c):
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def typed_levels(raw: DataFrame, id_col: str = "row_no", paths: tuple[str, ...] = (EVALUATION, JUDGMENT, SCORE)) -> DataFrame:
    """The labelled nodes of the declared column ``evaluations``: id and the columns of LEVEL, for the tables in ``paths``."""
    none = {"judge_model": "string", "status": "string", "score_avg": "double", "score": "double"}

    def shaped(df: DataFrame, path: str, label, **values) -> DataFrame:
        cells = [values[c].alias(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in none.items()]
        return df.select("id", F.lit(path).alias("path"), label.alias("dewey"), "source", *cells)

    e = raw.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.map_entries("evaluations")).alias("e", "x")).select(
        "id", "e", F.col("x.key").alias("source"), F.col("x.value.judgments").alias("judgments"))
    j = e.select("id", "e", "source", F.posexplode("judgments").alias("j", "y")).where("y is not null")
    s = j.select("id", "e", "j", "source", F.posexplode("y.scores").alias("k", "z"))
    made = {
        EVALUATION: lambda: shaped(e, EVALUATION, F.array("e")),
        JUDGMENT: lambda: shaped(j, JUDGMENT, F.array("e", "j"), judge_model=F.col("y.judge_model"), status=F.col("y.status"), score_avg=_finite(F.col("y.score_avg"))),
        SCORE: lambda: shaped(s, SCORE, F.array("e", "j", "k"), score=_finite(F.col("z.judge_score"))),
    }
    out = [made[p]() for p in paths]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1]) if len(out) == 2 else out[0].unionByName(out[1]).unionByName(out[2])


def labelled(raw: DataFrame, raw_json: DataFrame) -> DataFrame:
    """origin, id and the columns of LEVEL of all nodes of both tables."""
    return typed_levels(raw).withColumn("origin", F.lit("raw")).unionByName(json_levels(raw_json, "row_no", "payload").withColumn("origin", F.lit("raw_json")))


def scores_found(raw: DataFrame, raw_json: DataFrame) -> DataFrame:
    """origin, row_no, source, judgment_no, score_no of every finite score of both tables: the table of scores, its position from the
    label and its judgment's from the parent's label. A row_no that occurs twice gives distinct rows."""
    scores = typed_levels(raw, paths=(SCORE,)).withColumn("origin", F.lit("raw")).unionByName(json_levels(raw_json, "row_no", "payload").withColumn("origin", F.lit("raw_json")))
    return path_table(scores, SCORE).where("score is not null").select(
        "origin", F.col("id").alias("row_no"), "source", F.element_at("parent", -1).alias("judgment_no"), F.element_at("dewey", -1).alias("score_no")).distinct()


def _key(label):
    return F.array_join(F.transform(label, lambda x: x.cast("string")), ".")


def flat_tables(raw: DataFrame, raw_json: DataFrame) -> dict[str, DataFrame]:
    """``evaluations``, ``judgments`` and ``scores``: the table of each schema path with origin, row_no, node (its label) and parent (the label of
    the row above it, which is its node; null for evaluations, whose parent is the record)."""
    nodes = labelled(raw, raw_json)
    keys = ["origin", F.col("id").alias("row_no"), _key(F.col("dewey")).alias("node"), F.when(F.size("parent") > 0, _key(F.col("parent"))).alias("parent"), "source"]
    return {"evaluations": path_table(nodes, EVALUATION).select(*keys), "judgments": path_table(nodes, JUDGMENT).select(*keys, "judge_model", "status", "score_avg"), "scores": path_table(nodes, SCORE).select(*keys, "score")}


def linked_tables(raw: DataFrame, raw_json: DataFrame) -> DataFrame:
    """Rows, records and orphans per table and origin; an orphan is a row whose truncated label is no row of the table above. Every node is
    made once: it gives a row for itself and one for its parent, and these meet in one aggregation."""
    child = with_parent(labelled(raw, raw_json))
    own = F.struct(F.col("dewey").alias("label"), F.lit(1).alias("own"), F.lit(0).alias("kids"), "path")
    up = F.struct(F.col("parent").alias("label"), F.lit(0).alias("own"), F.lit(1).alias("kids"), "path")
    both = child.select("origin", "id", F.explode(F.when(F.size("dewey") > 1, F.array(own, up)).otherwise(F.array(own))).alias("x")).select("origin", "id", "x.*")
    met = both.groupBy("origin", "id", "label").agg(F.sum("own").alias("own"), F.sum("kids").alias("kids"), F.max(F.when(F.col("own") == 1, F.col("path"))).alias("at"), F.max(F.when(F.col("own") == 0, F.col("path"))).alias("under"))
    return met.groupBy("origin", F.coalesce("at", "under").alias("path")).agg(F.sum("own").alias("n_rows"), F.countDistinct(F.when(F.col("own") > 0, F.col("id"))).alias("n_records"), F.sum(F.when(F.col("own") == 0, F.col("kids")).otherwise(0)).alias("orphans"))

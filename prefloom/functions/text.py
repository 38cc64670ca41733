"""Prompt normalisation, ids and split assignment as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's ``str.split`` treats as white space (fixed value), as a class for Java's regular expressions and RE2.
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters that case folding changes beyond lower-casing, in Latin and Greek (fixed value).
FOLDS = (("ß", "ss"), ("ſ", "s"), ("µ", "μ"), ("ς", "σ"), ("ŉ", "ʼn"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space at either end; null stays null."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def casefolded(c: Column | str) -> Column:
    """Lower case with the folds of Latin and Greek letters, inside the JVM."""
    out = F.lower(_col(c))
    for a, b in FOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_prompt(c: Column | str, exact: bool = False) -> Column:
    """White space trimmed, its runs one space, case folded; null counts as empty. ``exact`` folds in an Arrow function by Python's own table."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"{SPACE}+", " "))
    if not exact:
        return casefolded(flat)
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.casefold()

    return fold(flat)


def prompt_group_id(normal: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a normalised prompt."""
    return F.substring(F.sha2(normal, 256), 1, 16)


def unit_interval(key: Column) -> Column:
    """The first 8 bytes of the SHA-256 of ``key``, read as a big-endian fraction of 2^64."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def assign_split(normal: Column, seed: int = 42, train_share: float = 0.80, validation_share: float = 0.10) -> Column:
    """train, validation or test of a normalised prompt: half-open intervals of its hash."""
    if not 0 < train_share < 1:
        raise ValueError("the share of train must lie strictly between 0 and 1")
    if not 0 <= validation_share < 1 or train_share + validation_share >= 1:
        raise ValueError("validation_share must not be negative, and the two shares must sum to less than 1")
    u = unit_interval(F.concat(F.lit(f"{seed}::"), normal))
    return F.when(u < train_share, "train").when(u < train_share + validation_share, "validation").otherwise("test")


def pair_id(record_id: Column, prompt_id: Column, a: Column, b: Column) -> Column:
    """First 20 hex digits of the SHA-256 of record, prompt and the two sources."""
    return F.substring(F.sha2(F.concat_ws("::", *[F.coalesce(x, F.lit("")) for x in (record_id, prompt_id, a, b)]), 256), 1, 20)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.80, "high").when(score >= 0.60, "medium").otherwise("low")


def margin_bucket(margin: Column) -> Column:
    return F.when(margin < 0.25, "[0.10,0.25)").when(margin < 0.50, "[0.25,0.50)").otherwise("[0.50,+inf)")

"""The four "is this a noise complaint" rules.

The reference uses a different rule at each stage and they disagree on
edge cases (leading blanks, lower case, "Loud Noise"), so the rule is a
parameter everywhere instead of one hard-coded test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpulse.functions.parse import strip_blanks

# The patterns the rules test for.
NOISE_PREFIX_PATTERN = "Noise%"
NOISE_WORD = "Noise"
NOISE_WORD_LOWER = "noise"


def py_strip(c: Column) -> Column:
    """``str.strip()``: removes tabs, newlines and no-break spaces too, unlike SQL ``trim``."""
    return strip_blanks(c)


def _ilike_prefix(c: Column) -> Column:
    # complaint_type ILIKE 'Noise%' (no trim; NULL stays NULL)
    return c.ilike(NOISE_PREFIX_PATTERN)


def _contains_ci(c: Column) -> Column:
    # lower(trim(complaint_type)) contains 'noise'
    return F.lower(F.trim(c)).contains(NOISE_WORD_LOWER)


def _contains_cs(c: Column) -> Column:
    # "Noise" in (complaint_type or "").strip(): NULL counts as "" -> False
    return py_strip(F.coalesce(c, F.lit(""))).contains(NOISE_WORD)


def _like_prefix(c: Column) -> Column:
    # complaint_type like 'Noise%' (case-sensitive)
    return c.like(NOISE_PREFIX_PATTERN)


NOISE_RULES = {
    "ilike_prefix": _ilike_prefix,
    "contains_ci": _contains_ci,
    "contains_cs": _contains_cs,
    "like_prefix": _like_prefix,
}


def noise_rule(rule: str, c: Column | str = "complaint_type") -> Column:
    """Boolean Column for one named rule (``None`` rule = no noise test)."""
    try:
        fn = NOISE_RULES[rule]
    except KeyError:
        raise ValueError(f"unknown noise rule {rule!r}; expected one of {sorted(NOISE_RULES)}") from None
    return fn(F.col(c) if isinstance(c, str) else c)

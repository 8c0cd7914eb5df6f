"""Column expressions: grid buckets, noise rules, text parsing, time buckets."""

from gridpulse.functions.exact import mean_of, split, sum_parts
from gridpulse.functions.geo import grid_bucket, is_finite
from gridpulse.functions.morton import PLACE_CODE, place_code, place_predicate
from gridpulse.functions.noise import NOISE_RULES, noise_rule, py_strip
from gridpulse.functions.parse import empty_to_null, iso_timestamp, ntz_lit, parse_iso_param, text_to_double
from gridpulse.functions.timebuckets import time_bucket

__all__ = [
    "NOISE_RULES",
    "PLACE_CODE",
    "empty_to_null",
    "grid_bucket",
    "is_finite",
    "iso_timestamp",
    "mean_of",
    "noise_rule",
    "ntz_lit",
    "place_code",
    "place_predicate",
    "parse_iso_param",
    "py_strip",
    "split",
    "sum_parts",
    "text_to_double",
    "time_bucket",
]

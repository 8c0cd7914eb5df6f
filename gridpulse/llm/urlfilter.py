"""URL filter: rules first, else logistic regression on hashed character n-grams.

Rules are (action, host, path). The longest rule that fits decides. For the
other urls a logistic regression over hashed 3- and 4-grams of host and path,
trained from a small labelled url table, decides. DataFrame functions and the
DataFrame-based pyspark.ml only.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ascii_lower, written
from gridpulse.session import scratch_path

FEATURES = 1 << 16
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _grams(column: Column, n: int, mark: str) -> Column:
    """Each run of n characters, with a mark; the work grows with the length, not its square."""
    characters = F.split(F.concat(F.lit("^"), column, F.lit("$")), "")
    grams = F.transform(characters, lambda c: F.concat(F.lit(mark), c))
    for k in range(1, n):  # the shorter array is filled up with nulls, which make no gram
        grams = F.zip_with(grams, F.slice(characters, F.lit(1 + k), F.size(characters)), lambda a, b: F.concat(a, b))
    return F.filter(grams, lambda g: g.isNotNull())


def featured(df: DataFrame) -> DataFrame:
    """Adds ``features``, the hashed n-grams of the columns host and path."""
    terms = F.concat(*[_grams(F.col(c), n, f"{c}:{n}:") for c in ("host", "path") for n in (3, 4)])
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")
    return hashing.transform(df.withColumn("terms", terms)).drop("terms")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(action, rule) of the longest rule that fits, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    Of equally long rules the first listed wins.
    """
    picked = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule_host, rule_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        picked = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(picked)
    return picked


def fit(labelled: DataFrame, max_rows: int = 20_000) -> LogisticRegressionModel | str:
    """Fit to labelled(host, path, blocked 0/1), at most ``max_rows`` distinct rows by hash.

    With one class only there is nothing to separate: its verdict is returned
    instead of a model, ``allow`` for an empty table.
    """
    h = F.xxhash64("host", "path", "blocked")
    rows, _ = written(
        labelled.where("blocked is not null").select("host", "path", F.col("blocked").cast("double").alias("blocked")).distinct()
        .orderBy(h, "host", "path", "blocked").limit(max_rows),
        "url-labels",
    )
    classes = [r[0] for r in rows.select("blocked").distinct().collect()]
    if len(classes) < 2:
        return "block" if classes == [1.0] else "allow"
    lr = LogisticRegression(featuresCol="features", labelCol="blocked", maxIter=40, regParam=1e-3)
    # a fitted model holds its training summary and so the session, which tasks can't take; a loaded one doesn't
    path = scratch_path(rows.sparkSession, "url-model")
    lr.fit(featured(rows).coalesce(1)).save(path)
    return LogisticRegressionModel.load(path)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: LogisticRegressionModel | str) -> DataFrame:
    """pages(page_id, url) -> (page_id, host, path, rule, verdict, p_block).

    One row per input row; a null url or one without ``://`` has an empty host
    and path, which no rule fits, and is judged by the model. ``p_block`` is the
    model's probability. Other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    if isinstance(model, str):
        scored = rows.withColumn("p_block", F.lit(1.0 if model == "block" else 0.0))
    else:
        scored = model.transform(featured(rows)).withColumn("p_block", vector_to_array("probability")[1])
    learned = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.action"), learned).alias("verdict"), "p_block"
    )

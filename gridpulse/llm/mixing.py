"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source that is to be taken ``rate`` times gets floor(rate)
copies for sure and one more with the fractional probability. Fractional
documents are paired: words of probability mass move from one to the other, in
a random direction that keeps both expectations, until one of them is integral.
Every pair keeps its sum of words times probability, so the words taken from a
source miss its target by less than its largest document. The pairing runs in a
tree: each bucket of about ``fan_in`` documents is folded to one fractional
residual, residuals are dealt to the buckets of the next level, up to one
residual a source, which a last draw rounds. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.llm.common import text_or_empty, written


def word_count(text: str = "text") -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, rows, target, rate), one row per source.

    The weights repeat over the sources by code point, null last. ``share`` of
    all sizes is dealt by weight; a target stops at ``cap`` times its source's
    size and the excess goes to the others by weight. Sorted by the level at
    which they fill up, the sources that stop are a prefix, which running sums
    find. The windows here hold one row per source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    t = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("fills_at", F.col("cap") / F.col("weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    by_fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    to_here = by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("budget") - (F.sum("cap").over(to_here) - F.col("cap"))) / F.sum("weight").over(from_here))
    # the first source that doesn't fill up sets the level of all behind it
    place = F.row_number().over(by_fill)
    t = t.withColumn("open", F.when(F.col("level") < F.col("fills_at"), F.struct(place.alias("place"), "level")))
    t = t.withColumn("level", F.min("open").over(every)["level"])
    t = t.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return t.select("source", "source_size", "rows", "target", rate.alias("rate"))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _uniform(*of) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") * F.lit(2.0**-53)


def _item(of: Column, p: Column) -> Column:
    return F.struct(of["h"].alias("h"), of["doc_id"].alias("doc_id"), of["size"].alias("size"), of["k"].alias("k"), p.alias("p"))


def _done(of: Column, up: int) -> Column:
    return F.array(F.struct(of["doc_id"].alias("doc_id"), of["size"].alias("size"), of["k"].alias("k"), F.lit(up).alias("up")))


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """One pivotal step: what is held meets x; one of the two becomes integral."""
    held = acc["held"]

    def settle(v: Column) -> Column:
        def state(kept: Column, p: Column, gone: Column, up: int) -> Column:
            p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
            return F.struct(_item(kept, p).alias("held"), F.concat(acc["done"], _done(gone, up)).alias("done"))

        rise = F.least(v["a_free"], v["b_mass"])  # words that may move to what is held
        fall = F.least(v["a_mass"], v["b_free"])
        up = F.when(v["a_free"] <= v["b_mass"], state(x, x["p"] - rise / x["size"], held, 1)).otherwise(
            state(held, held["p"] + rise / held["size"], x, 0)
        )
        down = F.when(v["a_mass"] <= v["b_free"], state(x, x["p"] + fall / x["size"], held, 0)).otherwise(
            state(held, held["p"] - fall / held["size"], x, 1)
        )
        return F.when(v["u"] * (rise + fall) < fall, up).otherwise(down)

    masses = F.struct(
        (held["p"] * held["size"]).alias("a_mass"),
        ((1 - held["p"]) * held["size"]).alias("a_free"),
        (x["p"] * x["size"]).alias("b_mass"),
        ((1 - x["p"]) * x["size"]).alias("b_free"),
        _uniform(F.lit(seed), held["h"], x["h"]).alias("u"),
    )
    return F.when(held.isNull(), F.struct(x.alias("held"), acc["done"].alias("done"))).otherwise(_let(masses, settle))


def mix(
    sized: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 42, fan_in: int = 64
) -> DataFrame:
    """sized(doc_id, source, size) -> (doc_id, source, size, source_size, target, copies, taken).

    One row per input row; ``taken`` is copies x size. The draws are hashes of
    the ids, so reruns agree whatever the partitions. Repeated rows are numbered
    and drawn one by one; rows of size 0 (or null) take no words; a source
    without words has target 0; null sources are one source; null ids are kept.
    Other columns are not read. An empty table gives an empty table.
    """
    sized = sized.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    targets, _ = written(source_targets(sized, weights, share, cap), "source-targets")
    same = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    t = targets.select(F.col("source").alias("of"), "rate", "rows")
    rows = same.join(t, same["source"].eqNullSafe(t["of"])).drop("of")
    rows = rows.select("source", "doc_id", "size", "rate", "rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    rows, _ = written(rows, "mix-rows")
    part = F.col("rate") - F.floor("rate")
    drawn = (F.col("size") > 0) & (part > 0)
    plain = rows.where(~drawn).select("source", "doc_id", "size", F.lit(0).alias("up"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("k"))
    item = F.struct(h.alias("h"), "doc_id", "size", "k", part.alias("p"))
    open_ = rows.where(drawn).select("source", "rows", item.alias("item"))
    largest = targets.agg(F.max("rows")).first()[0] or 0
    ended, level, width = [], 0, fan_in
    while largest:
        buckets = F.ceil(F.col("rows") / F.lit(width))
        dealt = open_.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), F.col("item.h")), buckets))
        kinds = open_.schema["item"].dataType
        start = F.struct(
            F.lit(None).cast(kinds).alias("held"),
            F.array().cast(f"array<struct<doc_id:{kinds['doc_id'].dataType.simpleString()},size:bigint,k:bigint,up:int>>").alias("done"),
        )
        items = F.array_sort(F.collect_list("item"))
        folded = dealt.groupBy("source", "rows", "bucket").agg(items.alias("items")).select(
            "source", "rows", F.aggregate("items", start, lambda acc, x: _pair(acc, x, seed)).alias("to")
        )
        folded, _ = written(folded, f"mix-level-{level}")
        ended.append(folded.select("source", F.explode("to.done").alias("d")).select("source", "d.doc_id", "d.size", "d.up"))
        open_ = folded.select("source", "rows", F.col("to.held").alias("item"))
        if width >= largest:
            break
        level, width = level + 1, width * fan_in
    last = (_uniform(F.lit(seed), F.lit("last"), F.col("item.h")) < F.col("item.p")).cast("int")
    out = plain.unionByName(open_.select("source", "item.doc_id", "item.size", last.alias("up")))
    for e in ended:
        out = out.unionByName(e)
    t = targets.select(F.col("source").alias("of"), "source_size", "target", "rate")
    out = out.join(t, out["source"].eqNullSafe(t["of"]))
    copies = (F.floor("rate") + F.col("up")).cast("long")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )

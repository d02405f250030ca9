"""Pairs of similar texts without comparing all of them.

Two texts that are close share many grams of q characters. Each text keeps
only its rarest grams, as many as edits within the bound can destroy and one
more, so that two close texts have one of them in common; an equi-join on
these grams gives the candidates, and the metric decides.

A bound too loose for that (or texts too short) leaves nothing to prune by.
Then texts are packed into blocks by length, blocks whose lengths may fit meet
in an equi-join on the pair of blocks, and the pairs stream out of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts in a block.
BLOCK = 256


def edit_similarity(a: Column, b: Column) -> Column:
    """A built-in metric beside ``fuzzy_ratio``: 100 (1 - edits / longer length), rounded."""
    return F.round(100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))).cast("int")


def ratio(x: str | None, y: str | None) -> int:
    return int(round(100 * SequenceMatcher(None, x or "", y or "").ratio()))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the matched characters over all characters."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y)], dtype="int32")

    return F.pandas_udf(run, "int")(a, b)


@dataclass(frozen=True)
class Metric:
    """A score of 0 to 100 and what it implies: a text of n characters has at most ``loss * n`` characters inserted, deleted or
    replaced on the way to a partner of at most its length that scores ``least``; the shorter has at least ``short * n``."""

    score: Callable[[Column, Column], Column]
    loss: Callable[[float], float]
    short: Callable[[float], float]
    symmetric: bool = True


#: Scores are rounded, so the bounds start half a point lower.
EDIT = Metric(edit_similarity, lambda least: 1 - (least - 0.5) / 100, lambda least: (least - 0.5) / 100)
#: 2 m / (n + n') >= r with m <= n': n' >= r n / (2 - r), and no more than (1 - r) (n + n') characters stand outside the matches.
FUZZY = Metric(fuzzy_ratio, lambda least: 2 * (1 - (least - 0.5) / 100), lambda least: (least - 0.5) / 100 / (2 - (least - 0.5) / 100), symmetric=False)


def _gram_size(loss: float) -> int:
    """The longest grams of which a text keeps a good part unspoilt; 0: none."""
    return next((q for q in (4, 3, 2) if q * loss <= 0.6), 0)


def _candidates(texts: DataFrame, q: int, loss: float, short: float, border: float) -> DataFrame:
    """(x, y): candidates among ``texts`` (id, text, n), one of each longer than ``border``, found by their rarest grams.

    The longer text, of m characters, has m - q + 1 grams, and each edit spoils
    q at most: more than m (1 - q loss) - q of them are left in the other. So
    the q loss m + 1 rarest of its grams hold one that the other has, and
    likewise for the shorter.
    """
    grams = texts.where(F.col("n") >= q).select("id", "n", F.explode(F.expr(f"transform(sequence(1, n - {q - 1}), i -> substring(text, i, {q}))")).alias("gram"))
    counted = grams.groupBy("id", "n", "gram").agg(F.count(F.lit(1)).alias("times"))
    single = counted.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda k: F.concat(F.col("gram"), k.cast("string")))).alias("gram"))  # a gram's k-th time is a gram of its own
    common = single.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")  # the others can't be shared, but come first
    ranked = single.join(common, "gram", "left").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "gram"))).alias("g"))
    rare = F.slice("g", F.lit(1), F.floor(F.col("n") * q * loss + 1e-9).cast("int") + 1)
    kept = ranked.select("id", "n", F.explode(F.filter(rare, lambda x: x["texts"] > 1)).alias("g")).select("id", "n", "g.gram")
    left, right = (kept.select("gram", F.col("id").alias(i), F.col("n").alias(f"n{i}")) for i in "xy")
    fits = (F.least("nx", "ny") >= F.greatest("nx", "ny") * short - 1e-9) & (F.greatest("nx", "ny") > border)
    return left.join(right, "gram").where("x < y").where(fits).select("x", "y").distinct()


def _blocks(texts: DataFrame, short: float) -> DataFrame:
    """(a, b): blocks of ``texts`` that meet, as arrays of (id, text, n); within a block of itself both are the same."""
    spark = texts.sparkSession
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / (1.0001 * math.log(1 / min(max(short, 0.02), 0.98)))).cast("int")  # partners are in one band or neighbours
    banded = texts.withColumn("band", band)
    counts = {r.band: r.n for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few bands, logarithms of lengths
    blocks = {b: -(-n // BLOCK) for b, n in counts.items()}
    sizes = spark.createDataFrame([(b, k, blocks.get(b + 1, 0)) for b, k in blocks.items()], "band int, own int, next int")
    dealt = banded.join(F.broadcast(sizes), "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("own")))
    packed = dealt.groupBy("band", "block", "own", "next").agg(F.collect_list(F.struct("id", "text", "n")).alias("rows"))
    upper = F.when(F.col("next") > 0, F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda k: F.struct((F.col("band") + 1).alias("band"), k.cast("long").alias("block")))).otherwise(F.array().cast("array<struct<band:int,block:bigint>>"))
    same = F.transform(F.sequence(F.col("block"), F.col("own").cast("long") - 1), lambda k: F.struct(F.col("band").alias("band"), k.alias("block")))
    left = packed.select(F.col("rows").alias("a"), F.struct("band", "block").alias("own"), F.explode(F.concat(same, upper)).alias("to"))
    return left.join(packed.select(F.struct("band", "block").alias("to"), F.col("rows").alias("b")), "to").select("a", "b", (F.col("own") == F.col("to")).alias("itself"))


def similar_pairs(df: DataFrame, key: str, text: str, least: float, metric: Metric = EDIT) -> DataFrame:
    """[J16, X14] (a, b, score): each pair of rows that scores at least ``least``, once, smaller key first
    (``FUZZY`` depends on the order).

    Equal texts are compared once, whatever their number. A null text counts
    as empty; two empty texts score 100 by ``FUZZY`` and, like any equal ones,
    by ``EDIT``. Keys tell rows apart.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    classes = rows.groupBy("text").agg(F.min("key").alias("id")).withColumn("n", F.length("text"))
    members = rows.join(classes.select("text", "id"), "text").select("id", "key")
    loss, short = metric.loss(least), metric.short(least)
    q = _gram_size(loss)
    if least <= 0.5:
        raise ValueError("least must be above 0.5: all pairs are as good as a cross join")
    border = (q - 1) / (1 - q * loss) if q else math.inf  # up to here edits may spoil all grams of both
    met = _blocks(classes.where(F.col("n") <= border), short).select("itself", F.explode("a").alias("p"), "b").select("itself", "p", F.explode("b").alias("r"))
    fits = (~F.col("itself") | (F.col("p.id") < F.col("r.id"))) & (F.least("p.n", "r.n") >= F.greatest("p.n", "r.n") * short - 1e-9)
    pairs = met.where(fits).select(F.col("p.id").alias("x"), F.col("r.id").alias("y"), F.col("p.text").alias("s"), F.col("r.text").alias("t"))
    if q:
        found = _candidates(classes, q, loss, short, border)
        left, right = (classes.select(F.col("id").alias(i), F.col("text").alias(c)) for i, c in (("x", "s"), ("y", "t")))
        pairs = pairs.unionByName(found.join(left, "x").join(right, "y").select("x", "y", "s", "t"))
    there = metric.score(F.col("s"), F.col("t"))
    scored = pairs.select("x", "y", there.alias("xy"), (there if metric.symmetric else metric.score(F.col("t"), F.col("s"))).alias("yx")).where(F.greatest("xy", "yx") >= least)
    left, right = members.select(F.col("id").alias("x"), F.col("key").alias("k")), members.select(F.col("id").alias("y"), F.col("key").alias("l"))
    across = scored.join(left, "x").join(right, "y").select("k", "l", F.when(F.col("k") < F.col("l"), F.col("xy")).otherwise(F.col("yx")).alias("score")).where(F.col("score") >= least)
    within = members.select("id", F.col("key").alias("k")).join(members.select("id", F.col("key").alias("l")), "id").where("k < l").select("k", "l", F.lit(100).alias("score"))
    return across.unionByName(within).select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"), "score")

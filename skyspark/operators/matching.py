"""One-to-one assignment by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyspark.operators.rounds import Rounds


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def two_step(df: DataFrame, first: list[str], second: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each first key, then among these the first of each second key."""
    return first_per(first_per(df, first, order), second, order)


def greedy(pairs: DataFrame, left: str, right: str, score: str, within: tuple[str, ...] = (), rounds: int = 1000) -> DataFrame:
    """One-to-one pairs as if taken in ascending (score, left, right) order whenever both ends are free.

    Each round takes the pairs that are first at both ends and drops what they block; that is the sequential result for a total
    order. The number of rounds is the length of the longest chain of displacements, not the size of the data; a round's winners are written once and read at the end."""
    held, order, keep = Rounds(pairs.sparkSession), [score, left, right], list(within)
    rest = held.keep(pairs.dropDuplicates([*keep, left, right]), "rest")
    for _ in range(rounds):
        a = F.row_number().over(Window.partitionBy(*keep, left).orderBy(*order))
        b = F.row_number().over(Window.partitionBy(*keep, right).orderBy(*order))
        won = held.add(rest.withColumn("__a", a).withColumn("__b", b).where("__a = 1 AND __b = 1").drop("__a", "__b"), "won")
        rest = held.keep(rest.join(won.select(*keep, left), [*keep, left], "left_anti").join(won.select(*keep, right), [*keep, right], "left_anti"), "rest")
        if rest.isEmpty():
            held.drop()
            return held.all("won")
    raise RuntimeError(f"greedy did not end in {rounds} rounds")


def first_owner(claims: DataFrame, item: list[str], owner: str, order: list[Column | str], least: int = 2) -> DataFrame:
    """Each item goes to its first claimant; owners left with fewer than ``least`` items lose them."""
    won = first_per(claims, item, order)
    n = won.groupBy(owner).agg(F.count("*").alias("n_owned")).where(F.col("n_owned") >= least)
    return won.join(n, owner)


def resolve_conflicts(matches: DataFrame, item: list[str], order: list[Column | str]) -> DataFrame:
    """Items that several templates matched go to the best; the others aren't tried again."""
    return first_per(matches, item, order)

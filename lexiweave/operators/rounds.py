"""Forced choice in rounds: pools are cut into groups, two of each group go on, until pools are small."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.operators.lexicon import balanced_group
from lexiweave.sources.workdir import stored


def groups_of_round(pools: DataFrame, size: int, seed: str) -> DataFrame:
    """cue, word, grp: each pool in an order by hash, cut into groups of at most `size`; pools of two and groups of one sit out."""
    hashed = pools.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "cue", "word")))
    sizes = pools.groupBy("cue").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cue").orderBy("h", "word")
    placed = hashed.join(sizes.where("n > 2"), "cue").withColumn("place", F.row_number().over(w) - 1)
    return placed.select("cue", "word", balanced_group(F.col("place"), F.col("n"), size).alias("grp"))


def play(pools: DataFrame, score: Column, *, size: int = 16, most_rounds: int = 1, seed: str = "12345") -> tuple[DataFrame, int]:
    """cue, word of the last pools and the number of rounds played.

    score says which words of a group win (the two smallest; ties by word): a model's picks, or a rule.
    Each round is a stored table, so that the plan doesn't grow. It ends when no pool has more than two words.
    """
    current, played = stored(pools.select("cue", "word").distinct(), "pools"), 0
    while played < most_rounds:
        grouped = groups_of_round(current, size, f"{seed}.{played}")
        if grouped.isEmpty():
            break
        w = Window.partitionBy("cue", "grp").orderBy(score, "word")
        won = grouped.withColumn("p", F.row_number().over(w)).where("p <= 2").select("cue", "word")
        idle = current.join(grouped.select("cue").distinct(), "cue", "left_anti")
        current, played = stored(won.unionByName(idle), "pools"), played + 1
    return current, played

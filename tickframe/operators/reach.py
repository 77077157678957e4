"""The first later bar whose price reaches a level, by a tree of block extremes.

A series is cut into blocks of ``FAN`` bars, those into blocks of ``FAN`` blocks, and so on; every block keeps its
highest high and lowest low. An order looks at the bars after its own in its block, then at the blocks after that
in the next wider one, until one reaches its price, and comes down into it again. Each step is an equi-join on a
block, so one long series is spread over as many tasks as it has blocks, and an order that waits for a
million bars meets a few dozen extremes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.series import settle

FAN = 64


def block_tree(bars: DataFrame, keys: Sequence[str], number: str, carry: Sequence[str] = (), fan: int = FAN) -> list[DataFrame]:
    """Levels of (keys, _block, _kids) from the finest up; ``_kids`` are a block's at most ``fan`` parts in order.

    ``bars`` (keys, number from 0 without gaps, high, low) may have null prices: such a bar reaches nothing. The finest
    parts also hold the columns named in ``carry``.
    """
    level = bars.select(*keys, F.col(number).alias("_at"), "high", "low", *carry)
    most = bars.agg(F.max(number)).first()[0]
    levels, extra = [], list(carry)
    while True:
        part = F.struct("_at", "high", "low", *extra)
        made = settle(level.groupBy(*keys, F.floor(F.col("_at") / fan).alias("_block")).agg(
            F.sort_array(F.collect_list(part)).alias("_kids"), F.max("high").alias("high"), F.min("low").alias("low")))
        levels.append(made.select(*keys, "_block", "_kids"))
        most = (most or 0) // fan
        if most == 0:
            return levels
        level, extra = made.select(*keys, F.col("_block").alias("_at"), "high", "low"), []


def _first(after: Column) -> Column:
    """The first part beyond ``after`` in ``_kids`` that reaches up or down, or null."""
    def hit(kid: Column) -> Column:
        return (kid["_at"] > after) & (F.coalesce(kid["high"] >= F.col("up"), F.lit(False))
                                       | F.coalesce(kid["low"] <= F.col("down"), F.lit(False)))
    return F.get(F.filter("_kids", hit), F.lit(0))


def first_reach(orders: DataFrame, tree: list[DataFrame], keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """``orders`` (keys, ``_from``, ``up``, ``down``, ...) with ``reached``, the first bar after number ``_from``
    with a high of at least ``up`` or a low of at most ``down``: a struct of its number, high, low and what the tree carries.

    A null ``up`` or ``down`` is never reached. ``reached`` is null where no bar does. A row stays a row; without bars nothing is reached.
    """
    join = [*keys, "_block"]
    waiting, found = orders.withColumn("_pos", F.col("_from")), []
    for level in tree:
        met = settle(waiting.withColumn("_block", F.greatest(F.floor(F.col("_pos") / fan), F.lit(0))).join(level, join, "left")
                     .withColumn("_hit", _first(F.col("_pos"))).drop("_kids"))
        found.append(met.where("_hit is not null").drop("_block", "_pos"))
        waiting = met.where("_hit is null").withColumn("_pos", F.col("_block")).drop("_block", "_hit")
    # down again: what was found in wider blocks joins what the finer ones found
    current = found[-1]
    for k in range(len(tree) - 2, -1, -1):
        lower = current.withColumn("_block", F.col("_hit._at")).drop("_hit").join(tree[k], join, "left").withColumn(
            "_hit", _first(F.lit(-1))).drop("_kids", "_block")
        current = lower.unionByName(found[k])
    done = current.withColumnRenamed("_hit", "reached")
    none = F.lit(None).cast(done.schema["reached"].dataType)
    return done.unionByName(waiting.drop("_pos").withColumn("reached", none))

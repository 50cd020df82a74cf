"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of all rows; so hot keys are fewer than this.
HOT_SHARE = 1000
#: Groups that all meet their members by a broadcast, at most.
FEW_GROUPS = 100_000


def join_groups(members: DataFrame, groups: DataFrame, by: list[str], size: str, total: int, how: str = "inner", number: int | None = None) -> DataFrame:
    """Join ``members`` to their group (one row of ``groups`` for each key ``by``, without nulls).

    ``size`` is a group's number of members and ``total`` that of all members. Members of hot groups,
    of which there are fewer than HOT_SHARE, meet them by a broadcast and stay where they are;
    the others meet theirs by a shuffle in which no key has over a thousandth of the rows. Where ``number``, which is no less
    than that of the groups, is up to FEW_GROUPS, all stay.
    """
    if number is not None and number <= FEW_GROUPS:
        return members.join(F.broadcast(groups), by, how)
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    cold = groups.where(F.col(size) * HOT_SHARE <= total)
    return members.join(hot, by).unionByName(members.join(hot, by, "left_anti").join(cold, by, how), allowMissingColumns=True)

"""Descendants of ontology terms by a fixpoint of semi-joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import keep, release, scope


def descendants(relation: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct ids reachable from ``roots`` (id), themselves included, over (parent, child); cycles end, and no path is walked twice.

    What is known is written anew each 16 levels, so a deep hierarchy's plan stays short; the levels below it go then.
    """
    with scope(relation.sparkSession) as own:
        found = keep(roots.select("id").distinct(), "closure")
        seen, front, since = found, found, []
        for level in count(1):
            nxt = relation.join(front, relation["parent"] == front["id"]).select(F.col("child").alias("id")).distinct().join(seen, "id", "left_anti")
            front = keep(nxt, "closure")
            if front.isEmpty():
                break
            since.append(front)
            seen = seen.unionByName(front)
            if level % 16 == 0:
                whole = keep(seen, "closure")
                release(found, *since[:-1])
                seen, found, since = whole, whole, since[-1:]
        out = keep(seen, "closure")
        own.spare(out)
    return out

"""Connected components of a distributed list of links, by contraction.

Each round gives every vertex the smallest vertex among itself and its neighbours, follows these
pointers to their roots, and contracts the links to roots. Vertices at least halve each round. All
tables stay distributed and are stored between steps; joins are plain equi-joins of stored tables,
so adaptive execution can split a root that very many vertices point to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.store import kept


def _rooted(pointers: DataFrame) -> DataFrame:
    """(id, to) with every pointer followed to its root (a vertex that points to itself)."""
    while True:
        there = pointers.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        step = kept(
            pointers.join(there, "to").select("id", F.col("_next").alias("to"),
                                              (F.col("_next") != F.col("to")).alias("_moved")),
            "pointers",
        )
        pointers = step.select("id", "to")
        if step.filter("_moved").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (id, component): the smallest id reachable, for every id in a link."""
    links = kept(links.filter("a <> b").select("a", "b").distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b"), F.col("a")))
        pointers = kept(
            both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("to")),
            "pointers",
        )
        roots = _rooted(pointers)
        rounds.append(roots)
        links = kept(
            links.join(roots.select(F.col("id").alias("a"), F.col("to").alias("_a")), "a")
            .join(roots.select(F.col("id").alias("b"), F.col("to").alias("_b")), "b")
            .filter("_a <> _b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            .distinct(),
            "links",
        )
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = rounds[0]
    for later in rounds[1:]:
        later = later.select(F.col("id").alias("to"), F.col("to").alias("_to"))
        found = kept(found.join(later, "to", "left").select("id", F.coalesce("_to", "to").alias("to")),
                     "pointers")
    return found.select("id", F.col("to").alias("component"))

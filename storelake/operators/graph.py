"""Connected components of rows that depend on each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.session import discard, made_from, written

#: Links that one task joins at the end: some 100 MB.
LAST_LINKS = 2_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and the smallest node of the component of each."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = places[:len(a)], places[len(a):]
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]


def _forest(held: int):
    """Links of the same components, one for each node but the smallest; a few at a time."""
    def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []

        def contracted() -> pd.DataFrame:
            both = pd.concat(waiting)
            nodes, root = roots_of(both["u"].to_numpy(), both["v"].to_numpy())
            return pd.DataFrame({"u": nodes, "v": root})[nodes != root]

        for pdf in frames:
            waiting.append(pdf)
            if sum(map(len, waiting)) >= held:
                waiting = [contracted()]
                if len(waiting[0]) > held / 2:
                    yield waiting.pop()
        if waiting:
            yield contracted()

    return contract


def components(links: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """node and root (the smallest node) of every linked node but the roots themselves.

    ``links`` are pairs a, b of numbers. Every task first joins the links it has, which
    leaves one for each node. While more are left than one task may have, neighbours hang
    themselves on the smallest one they know of (large and small stars in turn), which takes
    about as many rounds as the logarithm of the longest chain; the last task joins the rest.
    :func:`storelake.session.discard` deletes the table that the result is read from.
    """
    kind = "u long, v long"
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = written(pairs.filter("u != v").distinct().mapInPandas(_forest(last_links), kind),
                    "forest")
    mark = None
    while True:
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] <= last_links:
            stars = made_from(stars.repartition(1).mapInPandas(_forest(2 * last_links + 2), kind),
                              stars)
            break
        if seen == mark:
            break
        mark = seen
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = written(both.join(low, "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        last, stars = stars, written(small.select("u", F.col("low").alias("v")).unionByName(
            small.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        ).distinct(), "small-stars")
        discard(last, large)
    return made_from(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), stars)

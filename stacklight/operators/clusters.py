"""Packing blobs into clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.operators import entries as E

#: A cluster takes blobs up to so many bytes.
CLUSTER_SIZE = 2 << 20


def greedy(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, blob) of each size, in the order given: a new cluster begins where the current one would grow over the limit."""
    ends = np.cumsum(sizes)
    cluster, first = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    at = k = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        cluster[at:to], first[at:to] = k, at
        at, k = to, k + 1
    return cluster, np.arange(len(sizes)) - first


def _effects(sizes: np.ndarray, limit: int) -> pd.DataFrame:
    """What a stretch makes of the open cluster that it is given, by the bytes in it: from `low` bytes on, `cuts` new clusters begin
    and the last one holds `fill` bytes in `blobs` items at the end. Under the smallest `low` all items join the open cluster."""
    ends, n = np.cumsum(sizes), len(sizes)
    base = ends - sizes
    nxt = np.maximum(np.arange(n) + 1, np.searchsorted(ends, base + limit, "right")).tolist()
    last, cuts = list(range(n)), [1] * n
    for at in range(n - 1, -1, -1):
        if nxt[at] < n:
            last[at], cuts[at] = last[nxt[at]], cuts[nxt[at]] + 1
    first = np.arange(min(int(np.searchsorted(ends, limit, "right")), n - 1), -1, -1)  # where the first new cluster may begin
    first = first[np.append(ends[first[1:]] != ends[first[:-1]], True)]  # of items without bytes the earliest
    at, count = np.array(last)[first], np.array(cuts)[first]
    kept = np.append(True, (at[1:] != at[:-1]) | (count[1:] != count[:-1]))
    first, at, count = first[kept], at[kept], count[kept]
    return pd.DataFrame({"low": limit - ends[first] + 1, "cuts": count, "fill": ends[-1] - base[at], "blobs": n - at, "fresh": cuts[0], "items": n, "total": ends[-1]})


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(stretch, fill, blobs, cluster) of the open cluster that each stretch is given, from rows in the order of stretch and low."""
    now, fill, blobs, cluster, seen = None, 0, 0, 0, None

    def after() -> tuple[int, int, int]:
        if not blobs:  # nothing is open: the stretch's first item opens a cluster, which the last row stands for
            return last.fill, last.blobs, cluster + last.fresh - 1
        return (fill + last.total, blobs + last.items, cluster) if seen is None else (seen.fill, seen.blobs, cluster + seen.cuts)

    last = None
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if r.stretch != now:
                if last is not None:
                    fill, blobs, cluster = after()
                now, seen = r.stretch, None
                out.append((now, fill, blobs, cluster))
            last = r
            if r.low <= fill:
                seen = r
        yield pd.DataFrame(out, columns=["stretch", "open_fill", "open_blobs", "open_cluster"])


def packed(items: DataFrame, order_col: str, size_col: str, limit: int = CLUSTER_SIZE, stretch: int = 1 << 16) -> DataFrame:
    """`items` with cluster and blob, as greedy() gives them for the whole table in the order of order_col (a dense number).

    Items of `stretch` consecutive numbers are packed by one task. A first pass finds what each stretch makes of any open cluster,
    as a few rows for each; these are chained, and a second pass packs each stretch from the cluster that it is really given.
    """
    kept = items.columns
    dealt = items.withColumn("stretch", F.floor(F.col(order_col) / stretch))

    def effects(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        return _effects(pdf["s"].to_numpy(np.int64), limit).assign(stretch=key[0])

    sizes = dealt.select("stretch", F.col(order_col).alias("o"), F.col(size_col).alias("s"))
    found = sizes.groupBy("stretch").applyInPandas(effects, "stretch long, low long, cuts long, fill long, blobs long, fresh long, items long, total long")
    opened = found.coalesce(1).sortWithinPartitions("stretch", "low").mapInPandas(_chained, "stretch long, open_fill long, open_blobs long, open_cluster long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col, kind="stable")
        size = pdf[size_col].to_numpy(np.int64)
        fill, blobs, k = (int(pdf[c].iloc[0]) for c in ("open_fill", "open_blobs", "open_cluster"))
        joined = int(np.searchsorted(np.cumsum(size), limit - fill, "right")) if blobs else 0
        cluster, blob = greedy(size[joined:], limit)
        cluster = np.append(np.full(joined, k), cluster + (k + 1 if blobs else k))
        return pdf.assign(cluster=cluster, blob=np.append(np.arange(joined) + blobs, blob))

    dealt = dealt.join(opened, "stretch")
    schema = ", ".join(f"`{n}` {t}" for n, t in [*dealt.dtypes, ("cluster", "bigint"), ("blob", "bigint")])
    return dealt.groupBy("stretch").applyInPandas(run, schema).select(*kept, "cluster", "blob")


def cluster_stats(clustered: DataFrame, size_col: str) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count("*").alias("blobs"), F.sum(size_col).alias("bytes"))


def with_sizes(clusters: DataFrame, archives: DataFrame) -> DataFrame:
    """Cluster sizes from neighbouring offsets; the last one ends at the checksum or at the end of the file."""
    end = archives.select("archive_id", F.when(F.col("has_checksum"), F.col("checksum_pos")).otherwise(F.col("size")).alias("end"))
    rows = E.preceded(clusters.join(end, "archive_id"), ["archive_id"], -F.col("offset"), {"__next": "offset"}, [*clusters.columns, "end"])
    return rows.withColumn("size", F.coalesce("__next", "end") - F.col("offset")).drop("end", "__next")

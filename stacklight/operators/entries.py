"""Directory operators: lookups, iteration orders, numbering, redirects, metadata over tables of entries.

An entries table has archive_id, entry_idx, namespace, path, title, entry_type, mime, redirect_idx, cluster and blob (see
stacklight.sources.container.SCHEMAS); operators read only the columns that they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions import detect
from stacklight.session import written

#: First letters of a bare path that name a namespace in the strict reading.
LETTERS = "AIJ-MXCW"
#: Ranges at least and at most, and rows of one between these.
RANGES, MOST_RANGES, PER_RANGE = 8, 4096, 1 << 18


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with its 0-based position in the order of `keys`, nulls first, without a window over all rows: rows are written in ranges of all keys
    together, numbered there, and shifted by the rows of the ranges before. Ranges grow in number with the rows."""
    ranges = max(RANGES, min(MOST_RANGES, df.count() // PER_RANGE))
    dealt = written(df.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    w = Window.partitionBy("__range").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    return dealt.withColumn("__k", F.row_number().over(w)).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__k") - 1).drop("__range", "__k", "__before")


def preceded(df: DataFrame, by: list[str], order: Column, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns `keep` of `df`, and under new names those of the row ahead in the order of `order` within `by`: columns has new name and column.

    A group may be as large as the table: rows are written in ranges of group and order together, each range looks back within itself, and
    its first row of a group takes the last row of the group's ranges before, of which there is one for each range and group."""
    rows = df.select(*dict.fromkeys([*by, *keep, *columns.values()]), order.alias("__order"))
    ranges = max(RANGES, min(MOST_RANGES, df.count() // PER_RANGE))
    dealt = written(rows.repartitionByRange(ranges, *by, "__order").withColumn("__range", F.spark_partition_id()), "preceded")
    whole = ["__order", *dict.fromkeys(columns.values())]  # equal places are ordered by what is looked up, within ranges and over them
    last = dealt.groupBy(*by, "__range").agg(F.max(F.struct(*whole)).alias("__last"))
    ahead = last.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__at"), F.lag("__last").over(Window.partitionBy(*by).orderBy("__range")).alias("__ahead"))
    same = F.col("__range") == F.col("__at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    w = Window.partitionBy(*by, "__range").orderBy(*whole)
    out = dealt.withColumns({"__k": F.row_number().over(w)} | {n: F.lag(c).over(w) for n, c in columns.items()}).join(ahead, same)
    return out.withColumns({n: F.when(F.col("__k") > 1, F.col(n)).otherwise(F.col("__ahead")[c]) for n, c in columns.items()}).select(*by, *[k for k in keep if k not in by], *columns)


def live(entries: DataFrame) -> DataFrame:
    return entries.where("entry_type <> 'deleted'")


def resolve(path: str, strict: bool = False) -> tuple[str, str] | None:
    """(namespace, path) that a lookup means: `N/rest` names both, anything else is content. `strict` knows no bare path that
    begins with a namespace's letter."""
    if len(path) > 1 and path[1] == "/" and path[0] in LETTERS:
        return path[0], path[2:]
    return None if strict and path[:1] in tuple(LETTERS) else ("C", path)


def by_path(entries: DataFrame, path: str, strict: bool = False) -> DataFrame:
    at = resolve(path, strict)
    return entries.where(F.lit(False)) if at is None else entries.where((F.col("namespace") == at[0]) & (F.col("path") == at[1]))


def by_title(entries: DataFrame, title: str) -> DataFrame:
    """The first entry of the title in each archive."""
    order = "title_pos" if "title_pos" in entries.columns else "entry_idx"
    if "archive_id" not in entries.columns:
        return entries.where(F.col("title") == title).orderBy(order).limit(1)
    found = entries.where(F.col("title") == title)
    first = found.groupBy("archive_id").agg(F.min(order).alias(order))
    return found.join(first, ["archive_id", order], "left_semi")


def by_index(entries: DataFrame, index: int) -> DataFrame:
    return entries.where(F.col("entry_idx") == index)


def having(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of `paths` (namespace, path) that have an entry."""
    return paths.join(entries.select("namespace", "path"), ["namespace", "path"], "left_semi")


def with_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    return entries.where(F.col("path").startswith(prefix))


def main_entry(archives: DataFrame, entries: DataFrame) -> DataFrame:
    heads = archives.where("main_page is not null").select("archive_id", F.col("main_page").alias("entry_idx"))
    return entries.join(heads, ["archive_id", "entry_idx"], "left_semi")


def random_entry(articles: DataFrame, seed: int | None = None) -> DataFrame:
    return articles.orderBy(F.rand(seed)).limit(1)


def title_order(entries: DataFrame, name: str = "pos") -> DataFrame:
    """Front articles (live user content) numbered by title."""
    return numbered(live(entries).where(detect.is_user_content(F.col("namespace"))), ["title", "namespace", "path"], name)


def cluster_order(entries: DataFrame, name: str = "pos") -> DataFrame:
    """Entries with content or link targets, numbered in the order in which their clusters lie."""
    return numbered(entries.where("entry_type in ('content', 'linktarget')"), ["cluster", "blob", "entry_idx"], name)


def metadata(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """(archive_id, metadata map) of the M namespace."""
    rows = entries.where("namespace = 'M' and entry_type = 'content'").join(blobs.select("archive_id", "cluster", "blob", "data"), ["archive_id", "cluster", "blob"])
    pair = F.struct(F.col("path"), F.make_valid_utf8(F.col("data").cast("string")))
    return rows.groupBy("archive_id").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("metadata"))


def illustration(entries: DataFrame, size: int) -> DataFrame:
    return entries.where((F.col("namespace") == "M") & (F.col("path") == f"Illustration_{size}x{size}@1"))


def items(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Content entries with size and data of their blobs."""
    return entries.where("entry_type = 'content'").join(blobs.select("archive_id", "cluster", "blob", "size", "data"), ["archive_id", "cluster", "blob"])


def blob_range(data: Column, offset: int, size: int = 0) -> Column:
    """`size` bytes from offset; 0, or more than there are, means up to the end; null if the offset lies beyond."""
    rest = F.substring(data, offset + 1, size if size > 0 else 2**31 - 1)
    return F.when(F.octet_length(data) >= offset, rest)


def redirect_targets(entries: DataFrame) -> DataFrame:
    """Redirects with their direct target: target_idx, target_path, target_type (null if it lies outside the directory)."""
    r = entries.where("entry_type = 'redirect'")
    t = entries.select("archive_id", F.col("entry_idx").alias("target_idx"), F.col("namespace").alias("target_namespace"), F.col("path").alias("target_path"), F.col("entry_type").alias("target_type"))
    return r.withColumnRenamed("redirect_idx", "target_idx").join(t, ["archive_id", "target_idx"], "left")


def resolved(entries: DataFrame) -> DataFrame:
    """Redirects with `status`: ok if the target is content, else why an item cannot be had by one hop."""
    status = F.when(F.col("target_type").isNull(), "missing").when(F.col("target_type") == "content", "ok").otherwise(F.col("target_type"))
    return redirect_targets(entries).withColumn("status", status)


def final_targets(redirects: DataFrame, hops: int = 64) -> DataFrame:
    """(src, dst, looping) of a functional graph: where each chain of redirects ends, or that it never does. Nodes may be of any type
    that compares, such as structs of an archive and an index.

    Pointer doubling: after k rounds dst is 2**k hops away, and a chain of at most 2**k hops has ended. Only chains that have not are joined and
    written again, in the shared folder. A chain that is longer than 2**k hops has redirects ahead that end in the next round; so once a round ends
    none, what is left goes round.
    """
    open_, ended = written(redirects.select("src", "dst", F.lit(True).alias("looping")).where("src is not null and dst is not null"), "hops"), []
    left, done = open_.count(), 0
    while left and done < hops:
        known = open_
        for part in ended:
            known = known.unionByName(part)
        nxt = known.select(F.col("src").alias("at"), F.col("dst").alias("far"))
        now = written(open_.join(nxt, F.col("dst") == F.col("at"), "left").select("src", F.coalesce("far", "dst").alias("dst"), F.col("at").isNotNull().alias("looping")), "hops")
        open_, before, done = now.where("looping"), left, done + 1
        ended.append(now.where("not looping"))
        left = open_.count()
        if left == before:
            break
    for part in ended:
        open_ = open_.unionByName(part)
    return open_


def looping(redirects: DataFrame) -> DataFrame:
    """(src, dst) of the redirects that run into a cycle, dst a member of it; nodes as in final_targets().

    Doubling again, but chains that end are dropped as they do, so the tables shrink to what loops. Once none is dropped, and the places that
    chains stand on are as many as a round before, hops map these places onto themselves: all lie on cycles.
    """
    now = written(redirects.select("src", "dst").where("src is not null and dst is not null"), "hops")
    left, places = now.count(), None
    while left:
        nxt = now.select(F.col("src").alias("at"), F.col("dst").alias("far"))
        now, before = written(now.join(nxt, F.col("dst") == F.col("at")).select("src", F.col("far").alias("dst")), "hops"), left
        left = now.count()
        if left == before:
            found = now.select("dst").distinct().count()
            if found == places:
                break
            places = found
    return now


def loop_reports(redirects: DataFrame) -> DataFrame:
    """(entry_idx, loop array): for each redirect that runs into a cycle, the cycle's members in ascending order; nodes as in final_targets().

    Members are where the looping chains stand; each is found from itself.
    """
    ends = looping(redirects)
    members = written(ends.select(F.col("dst").alias("m")).distinct(), "members")
    edges = redirects.select("src", "dst").join(members, F.col("src") == F.col("m"), "left_semi")
    # cycles are found by the smallest member each member reaches; all members are on cycles, so reach is symmetric
    low = written(edges.select("src", F.col("dst").alias("far"), F.least("src", "dst").alias("low"), F.lit(True).alias("fell")), "low")
    while not low.where("fell").isEmpty():  # if none falls, no window has a smaller member than the one before it, so each has its cycle's
        o = low.select(F.col("src").alias("at"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        low = written(low.join(o, F.col("far") == F.col("at")).select("src", F.col("far2").alias("far"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")), "low")
    loops = low.groupBy("low").agg(F.sort_array(F.collect_list("src")).alias("loop"))
    of = low.join(loops, "low").select(F.col("src").alias("m"), "loop")
    return ends.join(of, F.col("dst") == F.col("m")).select(F.col("src").alias("entry_idx"), "loop")

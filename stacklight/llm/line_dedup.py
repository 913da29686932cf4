"""Line deduplication against levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm.common import ascii_lower, fresh, remove, shared_dir, table, written_at

BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Lines of one hash, in a batch, that meet their owner in one part of a join.
HOT = 1 << 13


class SortedRuns:
    """Runs of (h1, h2, owner), each bucketed and sorted by the 128-bit line hash, in levels.

    No hash is in two runs. `fanout` runs of a level are merged into one of the next, so n batches leave about
    log(n) runs to look a hash up in, and each hash is rewritten log(n) times. A look-up is a chain of merge joins that
    shuffles the batch's distinct hashes once: the runs lie bucketed in the shared folder, and so do runs that are merged, bucket by bucket,
    without a shuffle. Runs outlive a call: `levels` names their tables, and SortedRuns(spark, levels=..) goes on from there.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, levels: list[list[str]] | None = None, home: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [list(x) for x in levels or []]
        self.home = home or f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def write(self, rows: DataFrame) -> str:
        """(h1, h2, owner, n) as a sorted file for each bucket; rows of another partitioning are shuffled."""
        name = f"stacklight_run_{uuid.uuid4().hex}"
        rows.select(*KEY, "owner", "n").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.home}/{name}").saveAsTable(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys` whose hash no run has: an anti join with each run."""
        for run in self.runs():
            keys = keys.join(run, KEY, "left_anti")
        return keys

    def seen(self, keys: DataFrame) -> DataFrame:
        """(h1, h2, owner, n) of the rows of `keys` whose hash some run has, with the run's owner."""
        found = [keys.select(*KEY, "n").join(run.select(*KEY, "owner"), KEY).select(*KEY, "owner", "n") for run in self.runs()]
        return functools.reduce(DataFrame.unionByName, found) if found else keys.select(*KEY, "owner", "n").limit(0)

    def add(self, name: str) -> None:
        """Adds a table of write() whose hashes no run has, then merges levels that are full."""
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            # tables that are bucketed alike meet bucket by bucket: no hash is in two of them, so all rows stay
            merged = self.spark.table(full[0])
            for x in full[1:]:
                other = self.spark.table(x).withColumnsRenamed({"owner": "owner2", "n": "n2"})
                merged = merged.join(other, KEY, "full").select(*KEY, F.coalesce("owner", "owner2").alias("owner"), F.coalesce("n", "n2").alias("n"))
            name = self.write(merged)
            for x in full:
                self.drop(x)
            level += 1

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.home}/{name}")

    def close(self) -> None:
        for name in [x for level in self.levels for x in level]:
            self.drop(name)
        self.levels = []
        remove(self.spark, self.home)


def _lines(text):
    return F.split(text, "\n", -1)


def _text(text_col: str):
    return F.coalesce(F.col(text_col), F.lit(""))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, th, pos, h1, h2) of each line whose key is long enough; th tells rows of one id apart."""
    text = _text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.posexplode(_lines(text)).alias("pos", "line"))
    keyed = rows.select("id", "th", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def lost_lines(docs: DataFrame, runs: SortedRuns, id_col: str, text_col: str, min_chars: int, keep: bool = True) -> DataFrame:
    """(id, th, gone array<int>) of the lines of a batch that the runs know, or that a smaller id of the batch holds. `keep`: the batch's
    own hashes become a run.

    A hash that more than HOT lines of the batch have meets its owner in as many parts as that takes; only such hashes are in the table
    that all lines look their number of parts up in.
    """
    spark = runs.spark
    batch, path = written_at(line_hashes(docs, id_col, text_col, min_chars), "hashes")
    keys = runs.write(batch.groupBy(*KEY).agg(F.min("id").alias("owner"), F.count("*").alias("n")).repartition(runs.buckets, *KEY))
    new = runs.write(runs.unseen(spark.table(keys)))
    # only hashes of a second line can lose one; the others are not joined back
    owned, owned_path = written_at(spark.table(new).where("n > 1").unionByName(runs.seen(spark.table(keys))), "owned")
    hot, hot_path = written_at(owned.where(F.col("n") > HOT).select(*KEY, F.ceil(F.col("n") / HOT).alias("parts")), "hot")
    one = F.lit(1).cast("long")
    dealt = batch.join(hot, KEY, "left").withColumn("part", F.pmod(F.xxhash64("id", "th"), F.coalesce("parts", one))).drop("parts")
    owners = owned.select(*KEY, "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / HOT) - 1)).alias("part"))
    met = dealt.join(owners, [*KEY, "part"]).where(~F.col("id").eqNullSafe(F.col("owner")))
    gone = written_at(met.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "gone")[0]
    runs.drop(keys)
    runs.add(new) if keep else runs.drop(new)
    for p in (path, owned_path, hot_path):
        remove(spark, p)
    return gone


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2, runs: SortedRuns | None = None, counts: bool = True) -> DataFrame:
    """`docs` with its text_col cut to the lines that stay, and with n_lines and n_dropped in place of columns of these names (`counts`: else without).

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least min_chars code points stays only
    in the smallest id that holds it (there each time), and so do all shorter ones. Documents are taken in `batches` by
    ascending id; each batch looks its distinct hashes up in the runs of those before it and then adds its own. With `runs` given, their
    documents come before all of `docs`, and the hashes of `docs` stay in them for later calls.
    A null or empty text is one empty line. Rows without an id come last and yield to all others, not to each other.
    Rows that repeat an id are one document. Very long texts take time in proportion. Other columns are kept as they are; an empty table stays empty.
    """
    spark = docs.sparkSession
    given = docs.drop(*[c for c in ("n_lines", "n_dropped") if counts and c not in (id_col, text_col)])
    marks = [(i + 1) / batches for i in range(batches - 1)]
    cuts = sorted(set(given.agg(F.percentile_approx(F.col(id_col).cast("long"), marks, 1000)).first()[0] or [])) if marks else []
    found, own_runs = None, runs is None
    runs = SortedRuns(spark, fanout) if own_runs else runs
    for k in range(len(cuts) + 1):
        own = F.lit(True)
        if k:
            own = own & (F.col(id_col) > cuts[k - 1])
        if k < len(cuts):
            own = own & (F.col(id_col) <= cuts[k])
        elif cuts:
            own = own | F.col(id_col).isNull()
        gone = lost_lines(given.where(own), runs, id_col, text_col, min_chars, not own_runs or k < len(cuts))
        found = gone if found is None else found.unionByName(gone)
    if own_runs:
        runs.close()
    text = _text(text_col)
    gone_id, gone_th, gone_at = fresh(given, "gone_id", "gone_th", "gone")
    gone = found.select(F.col("id").alias(gone_id), F.col("th").alias(gone_th), F.col("gone").alias(gone_at))
    out = given.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_th)), "left")
    lines = _lines(text)
    kept = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone_at)), lambda i: F.get(ls, i)), "\n"))[0]
    more = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(gone_at), F.lit(0)).cast("long")} if counts else {}
    return out.withColumns({text_col: F.when(F.col(gone_at).isNull(), text).otherwise(kept), **more}).drop(gone_id, gone_th, gone_at)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
g AS (SELECT k.doc_id, k.line, k.pos, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""

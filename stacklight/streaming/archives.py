"""Archives that arrive in a folder, indexed as they come. (An addition: batch queries never need it.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stacklight.operators import entries as E
from stacklight.operators import search as S
from stacklight.sources import zim


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.zim") -> DataFrame:
    """A stream of (path, modificationTime, length): the files' contents are not read here."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def index_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the entries and the postings of each new archive to Parquet tables under `out`. Spark's checkpoint keeps which files
    are done; the batch number is a partition, so a batch that is run again replaces what it had written."""
    zim.register(spark)

    def add(batch: DataFrame, number: int) -> None:
        paths = [r.path.removeprefix("file:") for r in batch.select("path").collect()]  # names of one trigger's files
        if not paths:
            return
        files = ",".join("/" + p.lstrip("/") for p in paths)
        t = zim.tables(spark, files)
        t["entries"].withColumn("batch", F.lit(number)).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{out}/entries")
        html = E.items(t["entries"].where("namespace = 'C' and mime like 'text/%'"), t["blobs"])
        docs = html.select(F.struct("archive_id", "entry_idx").alias("doc_id"), F.make_valid_utf8(F.col("data").cast("string")).alias("text"))
        posts = S.postings(docs).select("term", "doc_id.*", "tf", "positions")
        posts.withColumn("batch", F.lit(number)).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{out}/postings")

    writer = arrivals(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

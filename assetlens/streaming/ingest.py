"""Snapshots that arrive as files in a folder, merged batch by batch."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..operators.crawl import Header, Snapshot, crawl_many, iso
from ..schemas import SNAPSHOT
from ..store import Store


def ingest_folder(spark: SparkSession, folder: str, store: Store, library_path: str, checkpoint: str, provider: str = "json", refused: str | None = None, files: int = 1000):
    """Start a query that merges new snapshot documents, `files` at most in one commit, and stops when all are in.

    Within a batch snapshots count in order of their paths. Ids are deterministic and the first tombstone wins, so a batch that
    is replayed after a failure changes nothing. A snapshot that arrives late overwrites live columns, as it does in batch. A
    snapshot that the archive refuses fails the query; with a folder `refused`, it is recorded there as JSON instead and the
    others are merged.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        said = ("photos_version", "authorization_status", "metadata")
        docs = written(batch.select(F.col("_metadata.file_path").alias("path"), *said, "assets"), "documents")
        heads = docs.select("path", *said).orderBy("path").collect()  # one row a document, `files` at most
        now = datetime.now(timezone.utc)
        times = [iso(now + timedelta(microseconds=n)) for n in range(len(heads))]
        snapshots = [Snapshot(n, Header(*[h[c] for c in said]), times[n], times[n]) for n, h in enumerate(heads)]
        if not snapshots:
            return
        places = spark.createDataFrame([(h.path, n) for n, h in enumerate(heads)], "path string, n int")
        assets = docs.join(places, "path").select("n", F.posexplode("assets").alias("ord", "a")).select("n", "ord", "a.*")

        def record(n: int, error: str) -> None:
            row = [(number, heads[n].path, error, times[n])]
            spark.createDataFrame(row, "batch long, path string, error string, at string").write.mode("append").json(refused)

        crawl_many(store, assets, snapshots, library_path, provider, None if refused is None else record)

    source = spark.readStream.schema(SNAPSHOT).option("multiLine", True).option("maxFilesPerTrigger", files).json(folder).select("*", "_metadata")
    return source.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

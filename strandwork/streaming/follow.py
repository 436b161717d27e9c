"""Variant files that arrive in a folder, as operations of a repository.

The stream is one of file names: what a file holds is read by the update itself, so a file is one operation however many
partitions it has. Spark's checkpoint remembers which files have been seen; a file that came in twice, after a crash
between the operation and the checkpoint, changes nothing the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandwork.repository import NoChanges, Repository


def follow_vcf(repo: Repository, folder: str, collection: str, checkpoint: str, once: bool = True, **how) -> StreamingQuery:
    """Apply each new .vcf file of a folder to a collection, in the order of their names within a batch.

    With ``once`` the query ends when all files that are there have been applied; else it goes on. ``how`` goes to update_vcf.
    """

    def apply(batch: DataFrame, _: int) -> None:
        for row in batch.select("path").distinct().orderBy("path").collect():  # file names of one batch
            try:
                repo.update_vcf(row.path, collection, **how)
            except NoChanges:
                pass

    names = repo.spark.readStream.format("binaryFile").option("pathGlobFilter", "*.vcf").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    writer = names.select(F.col("path")).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""A folder that N-Triples files are dropped into, as a stream of quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import files


def ingest(spark: SparkSession, folder: str, to: str, checkpoint: str, form: str = "ntriples", once: bool = True) -> StreamingQuery:
    """Write the quads of new files in the folder to parquet at `to`, a sub-folder `batch=n` for each micro-batch; a file
    is read once, also after a restart: a batch that is run again writes over what it wrote before.

    With once, the stream ends when it has read what is there. Quads that are in two files are there twice: give
    dropDuplicates() of the result to an engine."""

    def batch(frame: DataFrame, number: int) -> None:
        names = [r[0] for r in frame.select("file").distinct().collect()]  # a batch has few files, by maxFilesPerTrigger
        if names:
            quads = files.read_lines(spark, names, form)
            quads.write.mode("overwrite").parquet(f"{to}/batch={number}")

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = stream.option("maxFilesPerTrigger", 100).load(folder).selectExpr("path AS file")
    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

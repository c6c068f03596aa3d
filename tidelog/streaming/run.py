"""Running a stream to the end of its present input, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shared_dir


def keep_model(model: DataFrame, path: str | None = None) -> DataFrame:
    """The model as a written table: a stream would work out anything else with every batch."""
    path = path or shared_dir(model.sparkSession, "model")
    model.write.parquet(path)
    return model.sparkSession.read.parquet(path)


def run_to_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Process all input there is, append the output to a Parquet table and return the table.

    Windows and sessions appear once the watermark has closed them. Progress and state lie under the output, so
    another run into the same path goes on where the last one ended and loses and repeats nothing.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark, "stream")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{path.rstrip('/')}/_progress")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

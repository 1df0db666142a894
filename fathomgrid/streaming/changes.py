"""Structured Streaming over the change stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []


def window_counts(spark: SparkSession, path: str, file: str, width: str = "1 day") -> DataFrame:
    """(start, event_type, n) of a Parquet file stream, run to its end with ``availableNow``."""
    schema = spark.read.parquet(f"{path}/{file}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(path)
    counted = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN[0] if _OWN else _OWN.append(tempfile.mkdtemp(prefix="fathomgrid-stream-")) or _OWN[0]
    at = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/counts")  # noqa: E731  the whole result each time
    write(spark.createDataFrame([], counted.schema), 0)
    q = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/state")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(counted.schema).parquet(f"{at}/counts")

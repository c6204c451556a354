"""The motif scan as a stateless stream over files of sequences."""
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandframe.operators.motif_scan import Model, search


def stream_search(spark: SparkSession, folder: str, model: Model):
    """Streaming hits of parquet files (seq_idx, seq) as they arrive in the folder."""
    return search(spark.readStream.schema("seq_idx long, seq string").parquet(folder).filter(F.length("seq") >= 44), model)

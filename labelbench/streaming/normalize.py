"""Row-wise preparation on a stream.

The original has no streaming operators.  All projections and scalar
functions (2.3, 2.9) are row-wise, so the same column expressions run
unchanged on a ``readStream`` frame; this module wires X6 (text shrink) and
P3 (label map) to a file-source stream and a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import shrink_text
from ..operators.labels import map_labels


def normalize_stream(stream: DataFrame, src_col: str = "src", label_col: str | None = None,
                     mapping: dict | None = None, keep_formatting: bool = False) -> DataFrame:
    """X6 on ``src`` and, when given, P3 on ``label`` of a streaming frame."""
    out = stream.withColumn(src_col, shrink_text(src_col, keep_formatting))
    if label_col is not None:
        out = out.withColumn(label_col, map_labels(label_col, mapping) if mapping else map_labels(label_col))
    return out


def run_available(spark: SparkSession, src_dir: str, schema: str, out_dir: str, checkpoint: str,
                  fmt: str = "json", **kw) -> None:
    """Process every file present in ``src_dir`` once (``availableNow``) and
    write the normalised rows as parquet; the checkpoint makes reruns pick up
    only new files."""
    stream = spark.readStream.schema(schema).format(fmt).load(src_dir)
    q = (normalize_stream(stream, **kw).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_dir))
    q.awaitTermination()

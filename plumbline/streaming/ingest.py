"""Continuous ingestion: recognised label texts in, detection tables out.

Extraction and comparison are row-local and run unchanged on a stream; joining
the static drawings needs no state. Each micro-batch is written under its own
batch number and replaces itself when it is repeated, so a restart after a lost
driver or executor leaves no duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from plumbline.catalogue import APPLIANCE, Catalogue
from plumbline.operators import compare as C, extract as E, history as H
from plumbline.sources.sinks import save_detections


def checkpoint_root(df: DataFrame, fallback: str | None = None) -> str:
    """Shared folder the cluster names; the fallback serves where none is set."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass a fallback")
    return root.rstrip("/")


def stream_records(texts: DataFrame, cat: Catalogue = APPLIANCE, text: str = "text") -> DataFrame:
    """Field records of a (streaming) text table."""
    return E.extract_fields(texts, cat, text)


def compare_batch(texts: DataFrame, drawings: DataFrame, cat: Catalogue = APPLIANCE) -> DataFrame:
    """Verdicts of one batch of (case_id, label_no, label_file, detected_at, text)."""
    return C.compare_to_drawing(E.extract_fields(texts, cat), drawings, cat)


def detection_stream(texts: DataFrame, drawings: DataFrame, history_path: str, detail_path: str,
                     name: str, fallback_checkpoint: str | None = None,
                     cat: Catalogue = APPLIANCE) -> DataStreamWriter:
    """Writer that compares every micro-batch and saves its detections."""
    def save(batch: DataFrame, batch_id: int) -> None:
        compared = compare_batch(batch, drawings, cat)
        rows = H.assemble(compared, cat, "detected_at", ["case_id", "label_no"], ["case_id", "label_no"])
        save_detections(rows, history_path, detail_path, f"{name}-{batch_id:010d}")
    return (texts.writeStream.queryName(name).foreachBatch(save)
            .option("checkpointLocation", f"{checkpoint_root(texts, fallback_checkpoint)}/{name}"))


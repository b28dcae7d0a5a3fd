"""JSON text sources: one document per line, or a document / list of documents per body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import variants as V
from ..operators.normalize import normalize
from ..session import once


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and arrival order within this read."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("arrival_seq"),
    )


def parse_lines(lines: DataFrame, *carry: str, line: str = "line", max_bytes: int | None = None) -> DataFrame:
    """Adds ``doc`` and ``line_error`` to non-blank lines; a bad line never stops its siblings.

    ``max_bytes`` is the caller's choice: lines of that size and more are rejected.
    """
    text = F.col(line)
    long = F.lit(False) if max_bytes is None else F.octet_length(text) >= max_bytes
    doc = V.parse(F.when(~long, text))
    # The test for blank lines reads the text as it was made for parsing; below that it would make every text twice.
    rows = once(lines.select(*carry, line, doc.alias("doc"))).where(~text.rlike(r"^\s*$"))
    error = (
        F.when(long, "exceeds max_line_bytes")
        .when(F.col("doc").isNull(), "invalid JSON")
        .when(~V.is_object(F.col("doc")), "record must be an object")
    )
    return rows.withColumn("line_error", error)


def line_rejects(parsed: DataFrame, *carry: str) -> DataFrame:
    return parsed.where(F.col("line_error").isNotNull()).select(*carry, F.col("line_error").alias("reason"))


def events_from_lines(
    lines: DataFrame, *carry: str, source_name: str = "jsonl", line: str = "line",
    max_bytes: int | None = None,
) -> DataFrame:
    """Envelope rows with ``reasons``; unreadable lines come out with their error as reason."""
    parsed = parse_lines(lines, *carry, line=line, max_bytes=max_bytes)
    rows = normalize(
        parsed, carry=(*carry, "line_error"),
        defaults={"schema_version": "1.0", "event_type": "unknown.event"},
        source_defaults={"kind": "adapter", "name": source_name}, assign_ids=True,
    )
    reasons = F.when(F.col("line_error").isNotNull(), F.array("line_error")).otherwise(F.col("reasons"))
    return rows.withColumn("reasons", reasons).drop("line_error")


def explode_bodies(bodies: DataFrame, *carry: str, body: str = "body") -> DataFrame:
    """Documents of request bodies that are one object or a list; ``index`` is the position."""
    doc = V.parse(F.col(body))
    docs = F.when(V.is_array(doc), V.items(doc)).otherwise(F.array(doc))
    return bodies.select(*carry, F.posexplode_outer(docs).alias("index", "doc"))

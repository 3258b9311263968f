"""JSON sink of answers and option pages."""

from pyspark.sql import DataFrame


def write_payload(payload: DataFrame, path: str) -> None:
    """One JSON document per row, missing values written as null."""
    payload.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

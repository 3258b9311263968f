"""Table shapes."""

from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("location", T.StringType()),
    T.StructField("cuisines", T.ArrayType(T.StringType(), False), False),
    T.StructField("rating", T.DoubleType()),
    T.StructField("cost_for_two", T.DoubleType()),
    T.StructField("budget", T.StringType()),
])
CATALOG_COLUMNS = CATALOG.fieldNames()

REQUEST = "request_id bigint, location string, cuisine string, min_rating string, budget string"
RESPONSE = "request_id bigint, attempt int, raw string, error string"

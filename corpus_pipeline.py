"""The corpus pipeline: documents pass the stages in order; each stage works on all its predecessor kept.

Toxic documents go first, then exact and near copies; the rest is mixed by source to target weights (documents
that the mix takes twice appear twice, others not at all) and packed into sequences. Every stage but the last returns
the columns of documents, the last one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
"""

import uuid

from pyspark.sql import functions as F

from listforge.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from listforge.llm.common import lower_batches, narrow_batches, table
from listforge.llm.queries import vocabulary_path
from listforge.sources.shared import kept_tables, shared_dir

#: Similarity from which the near-duplicate stage drops a copy; the 85 of op10 is that query's own contract.
PERCENT = 80


def toxic_filter(spark, docs, sf_dir):
    lower_batches(spark)  # texts are scored when the caller writes them
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup.keep_one(docs, PERCENT)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixture(docs)


def pack_sequences(spark, docs, sf_dir):
    with narrow_batches(spark):
        pieces = packing.token_pieces(docs, vocabulary_path())
        return packing.pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("toxicity", toxic_filter),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The model's scores, the links' estimates and the tokens are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over documents, each written and read again; what a stage keeps on its way goes once its result is written.

    Nulls in any column, empty and very long texts, repeated rows and an empty table pass as the stages' own docstrings say: a null text
    is empty, rows that repeat an id and text become one, an empty table gives an empty result. Other columns keep their names and values.
    """
    with narrow_batches(spark):
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            path = f"{shared_dir(spark).rstrip('/')}/listforge/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            with kept_tables(spark):
                docs = stage(spark, docs, sf_dir)
                docs.write.parquet(path)
                shape = docs.schema
            docs = spark.read.schema(shape).parquet(path)
        return STAGES[-1][1](spark, docs, sf_dir)


def pipeline_queries() -> dict:
    return {"pipeline": run}


def pipeline_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

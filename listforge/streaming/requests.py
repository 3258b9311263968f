"""Requests answered as they arrive: the batch plan per micro-batch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import recommend
from ..plans.requests import checked
from ..plans.scoring import Scorer
from ..plans.shortlist import Cells, indexed
from ..sources.payload import write_payload
from ..sources.shared import keep, kept_tables


def answer_stream(requests: DataFrame, cells: DataFrame | Cells, path: str, checkpoint: str,
                  scorer: Scorer | None = None, **trigger) -> StreamingQuery:
    """Validate and answer a stream of requests.

    Answers go to ``path/answers/batch=<n>``, refused requests to ``path/rejected/batch=<n>``. A batch that is
    run again after a failure overwrites its own folder, so each request is answered once. ``cells`` is the
    kept reduction of the catalog and is not rebuilt per batch. ``trigger`` takes the
    arguments of ``DataStreamWriter.trigger``.
    """
    cells = indexed(cells)  # once, not per batch

    def one_batch(batch: DataFrame, n: int) -> None:
        with kept_tables(batch.sparkSession):
            rows = keep(checked(batch), "requests")
            valid = rows.filter(F.size("errors") == 0).drop("errors")
            rejected = rows.filter(F.size("errors") > 0).select("request_id", "errors")
            answered = recommend.recommend(valid, None, scorer, cells)
            write_payload(recommend.recommend_payload(answered), f"{path}/answers/batch={n}")
            write_payload(rejected, f"{path}/rejected/batch={n}")

    return (
        requests.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )

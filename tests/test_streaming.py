from listforge.plans import shortlist
from listforge.sources.schema import CATALOG, REQUEST
from listforge.sources.shared import keep
from listforge.streaming.requests import answer_stream
from tests.test_recommend import CATALOG_ROWS


def test_stream_answers_each_request_once(spark, tmp_path):
    cells = keep(shortlist.best_cells(spark.createDataFrame(CATALOG_ROWS, CATALOG)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive = lambda rows: spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(source)
        answer_stream(stream, cells, out, str(tmp_path / "checkpoint")).awaitTermination()
        answers = spark.read.json(f"{out}/answers").select("request_id", "summary", "items").collect()
        rejected = spark.read.schema("request_id bigint, errors array<string>").json(f"{out}/rejected").collect()
        return {r.request_id: [i.rank for i in r["items"] or []] for r in answers}, {r.request_id: r.errors for r in rejected}, len(answers)

    arrive([(1, "btm", "cafe", "4", "medium"), (2, "btm", " ", "4", "medium")])
    assert run() == ({1: [1, 3, 5]}, {2: ["cuisine"]}, 1)
    arrive([(3, "mg", "cafe", None, "medium"), (4, "none", "cafe", "0", "low")])
    assert run() == ({1: [1, 3, 5], 3: [1], 4: []}, {2: ["cuisine"]}, 3)

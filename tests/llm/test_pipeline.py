"""The pipeline's stages by their laws on the smallest tables, and its registration."""

import re

import __spark_entry__
import corpus_pipeline
from listforge.sources import shared
from listforge.sources.shared import keep

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.toPandas())
    clean, exact, near, mixed = seen
    assert set(exact.doc_id) == set(clean.sort_values("doc_id").drop_duplicates("text", keep="last").doc_id)
    assert set(near.doc_id) <= set(exact.doc_id) and set(mixed.doc_id) <= set(near.doc_id)
    assert mixed.doc_id.value_counts().max() <= 2
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()
    assert packed[packed.piece == 0].doc_id.value_counts().to_dict() == mixed.doc_id.value_counts().to_dict()


def test_stages_on_odd_rows(spark, odd, clashing):
    """Nulls, empty and long texts, repeated rows and clashing columns: one row of each text is left, and no stage fails."""
    for docs in (odd, clashing):
        columns, kind = docs.columns, docs.schema
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            docs = keep(stage(spark, docs, SF))
            assert docs.columns == columns and docs.schema.simpleString() == kind.simpleString()
            if k == 1:
                texts = [r.text or "" for r in docs.collect()]
                assert len(texts) == len(set(texts))
            if k == 2:
                # The two long texts are near copies, and so are the two equal single words; three texts have no words.
                assert sorted(r.doc_id for r in docs.filter("length(text) > 1000").collect()) == [5]
        last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
        assert last.count() > 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(last.columns)


def test_stages_on_an_empty_table(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = keep(stage(spark, docs, SF))
        assert docs.count() == 0 and docs.columns == odd.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 0


def test_run_leaves_only_what_it_needs(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(shared, "remove", lambda spark, path, _r=shared.remove: (written.append(path), _r(spark, path)))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(list((tmp_path / "listforge").iterdir())) == 4 and len(written) > 20


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_stage_at_80(spark, make):
    base = [f"w{i}" for i in range(104)]
    # 100 shingles; two words far apart and one at the end lose 5 + 5 + 1 of them: 89 of 111, 80.2 %.
    near = ["x" if i in (30, 60, 103) else w for i, w in enumerate(base)]
    far = ["y" if i in (10, 30, 60) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make(*rows), SF).collect()) == [1, 3]

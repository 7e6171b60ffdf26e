"""The pipeline's stages on a small folder of tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import DDL, documents  # noqa: E402


def test_stages(spark, tmp_path):
    rows = documents(48, 3)
    docs = spark.createDataFrame(rows, DDL).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(48)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [at.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        sizes.append(at.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == spark.read.parquet(str(tmp_path / "out3")).count()
    masked = spark.read.parquet(str(tmp_path / "out3"))
    assert masked.filter("text like '%AKIAQ%'").count() == 0 and masked.filter("text like '%[SECRET]%' and n_chars = length(text)").count() > 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
    assert key(whole) == key(at)


def test_stages_on_hostile_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, and columns named like the stages' own."""
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ddl = "doc_id long, text string, lang string, source string, n_chars long, row string, th long, keep boolean, spans string, id long, n long, block long, `odd.name` int"
    more = ("r", 1, True, "s", 2, 3, 4, 5)
    text = lambda i: " ".join(f"w{(i * 7 + k) % 50}{'abcde'[k % 5]}" for k in range(40))
    rows = [(i, text(i), "en", "s", 1, *more) for i in range(20)] + [(None, text(3), None, None, None, *more), (None, None, None, None, None, *more), (5, text(5), "en", "s", 1, *more), (6, "", "en", "s", 0, *more)]
    docs, none = spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= len(rows) and stage(spark, none, str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() >= len(rows) and last(spark, none, str(tmp_path)).count() == 0

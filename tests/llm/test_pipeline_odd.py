"""The corpus pipeline on empty and odd tables, and what it leaves behind."""

import corpus_pipeline
from rankforge.llm.common import Stage
from tests_llm_helpers import ODD, docs


def test_empty_and_odd_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = [*ODD, *((10 + k, "some words of a plain text about nothing at all, number " + str(k % 3)) for k in range(9))]
    docs(spark, rows).write.parquet(f"{tmp_path}/odd/documents.parquet")
    before = len(Stage.made)
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert len(Stage.made) == before + 1  # the pipeline's own, which holds the result
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    assert all(r.n_tokens * 4 == len(r.ids) for r in out.collect())

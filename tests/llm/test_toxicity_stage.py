import os

import pytest

import corpus_pipeline as C
from foliospark.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_stage_drops_what_op6_marks(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, labels).collect()
    assert any(r.predicted and r.score < 0.5 for r in scored)
    assert {r.doc_id for r in C.toxicity(spark, docs, SF).collect()} == {r.doc_id for r in scored if not r.predicted}

"""Both language models are matched: scores fall on both sides of 0, wherever the corpus ends."""

import pytest

from symloom.llm import lm_score


@pytest.mark.parametrize("times", [1, 10])
def test_target_like_texts_score_below_zero(spark, times):
    formal = "the committee considered the annual report and approved it "
    noise = "zx qv jjk wq zzxx kq "
    docs = [(i, formal * (1 + i % 3)) for i in range(20)] + [(100 + i, noise * 4) for i in range(20 * times)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(table, labels).collect()}
    assert max(rows[i] for i in range(20)) < 0 < min(rows[i] for i in rows if i >= 100)

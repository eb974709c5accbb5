"""The pipeline against a plain version of its stages."""

from collections import Counter

import corpus_pipeline
from symloom.llm import langid, mixing, pieces
from tests.conftest import SF
from tests.llm import brute, test_shingles


def test_stages_and_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, " 123 \n", None, None, 6), (10_003, "", "de", "src2", 0)], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    start = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in start.collect()}

    model = langid.train(langid.learned_rows(start))
    left = {d: r.text for d, r in rows.items() if r.text and langid.has_letters(r.text.encode()) and not model.predict(r.text.encode())[2]}
    assert set(rows) - set(left) == {10_001, 10_002, 10_003}
    left = {d: left[d] for d, g in brute.exact_groups(list(left.items())).items() if g[2]}
    left = {d: left[d] for d, head in test_shingles.brute(list(left.items())).items() if head == d}
    taken = {r.doc_id: r.repeats for r in mixing.mix(start.where(start.doc_id.isin(list(left)))).collect()}
    vocab = pieces.read_vocabulary()
    want = Counter({(d, tuple(pieces.Encoder(vocab).encode(left[d])[0])): n for d, n in taken.items() if n})
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert got.where("NOT round_trip").count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0

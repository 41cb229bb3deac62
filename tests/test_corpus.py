"""Corpus queries on tables written for the case."""

from quillstone.plans import corpus


def test_nested_overlap_bans_every_evaluation_split(spark, tmp_path):
    dev, test, own = (f"{k} evaluation sentence of more than thirty characters" for k in ("a dev", "a test", "no"))
    rows = [(1, "train", '{"a": "%s"}' % dev), (2, "train", '{"a": ["%s"]}' % test.upper()), (3, "train", own), (4, "dev", dev), (5, "test", test), (6, None, own)]
    spark.createDataFrame(rows, "item_id bigint, split string, state string").write.parquet(f"{tmp_path}/verify.parquet")
    assert sorted(tuple(r) for r in corpus.nested_overlap(spark, str(tmp_path)).collect()) == [(1, 1), (2, 1)]

"""Queries with the reference's limits see all of a text."""

import __spark_entry__


def test_text_behind_the_first_characters_counts(spark, tmp_path):
    long = "word " * 240  # 1,200 characters
    documents = [(1, long + "a"), (2, long + "b"), (3, "x" * 400_001)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in __spark_entry__.queries()["whole_documents"](spark, str(tmp_path)).collect()}
    assert [(rows[i].n, rows[i].was_cut) for i in (1, 2, 3)] == [(1201, False), (1201, False), (400_000, True)]
    assert rows[1].text_sha256 != rows[2].text_sha256

    said = "word " * 30  # 150 characters
    turns = [(1, 1, said + "a"), (1, 2, said + "b")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = __spark_entry__.queries()["whole_turns"](spark, str(tmp_path)).collect()
    assert len({r.cleaned_sha256 for r in rows}) == len({r.lines_sha256 for r in rows}) == 2

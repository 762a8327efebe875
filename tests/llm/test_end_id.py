"""Texts that quote the tokenizer's own end mark."""

from citemill.llm import queries


def test_text_that_quotes_the_end_mark(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == 2 and got[4] == 1 and got[1] > 3

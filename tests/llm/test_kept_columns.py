"""Only what goes with the tokens travels to the encoder."""

from pairgrade.llm.queries import byte_bpe


def test_bpe_keeps_the_named_columns(spark):
    import public_tokenizers as P
    import tiktoken

    from pairgrade.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = ["Hello world's  \n\n x", None, "", "ab" * 700, "日本語 ٣٤", "Hello world's  \n\n x"]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    tok = byte_bpe()
    kept = tok.encode(rows, "text", "ids", ["doc_id"])
    assert kept.columns == ["doc_id", "ids"]
    assert [list(r.ids) for r in kept.orderBy("doc_id").collect()] == [enc.encode_ordinary(t or "") for t in texts]
    assert tok.encode(rows, "text", "ids").columns == ["doc_id", "text", "source", "ids"]

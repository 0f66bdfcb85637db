import public_tokenizers
import pytest

from assetlens.llm.token_count import PieceCounter, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "  two  spaces\tand\ttabs\n\nlines ", "<s> </s> <unk> <0x0A>", "a▁b ▁▁", "日本語 ①ﬁ é ñ 🙂", "x" * 5000, "\x00\x01​", "héé " * 400, "aaaa bbbb " * 50, "　\xa0x"]


def test_same_counts_as_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, MODEL).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("text", ["the the the", "mississippi", "aaaaaaa", "ab" * 99])
def test_merging_one_segment(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = PieceCounter(MODEL)
    assert c.merge("▁" + text.replace(" ", "▁")) == c.count(text) == len(sp.encode(text))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(docs, MODEL).count() == 0

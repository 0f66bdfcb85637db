import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetlens.llm.simple8b import decode, encode, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_round_trip(ids):
    words, at, value = encode(np.array(ids, np.uint64))
    assert decode(words, len(ids), at, value).tolist() == ids


@pytest.mark.parametrize("bits", [1, 2, 7, 15, 16, 30, 59, 60])
def test_packs_by_width(bits):
    ids = np.full(600, (1 << bits) - 1, np.uint64)
    words, at, value = encode(ids)
    per_word = max(c for c, b in ((60, 1), (30, 2), (8, 7), (4, 15), (3, 20), (2, 30), (1, 60)) if b >= bits)
    assert len(words) // 8 == -(-600 // per_word)
    assert (decode(words, 600) == ids).all()


TEXTS = [None, "", "Hello  World's", "<|endoftext|> a<|startoftext|>b", "É é \xa0x\x85y\x1cz 日本 ①", "x" * 300, "don't\tstop 123", "the word " * 900, "á b"]


def test_files_hold_the_library_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(100 - i, x, 5, "s") for i, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, words string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in encode_documents(docs, PATH, 2).collect()}
    want, start = {}, 0
    for k, x, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[k] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_empty_repeated_and_null_keys(spark):
    schema = "doc_id long, text string"
    assert encode_documents(spark.createDataFrame([], schema), PATH, 2).count() == 0
    got = sorted(encode_documents(spark.createDataFrame([(5, "b"), (5, "a"), (None, "a b")], schema), PATH, 2).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 3), (5, 3, 2), (5, 5, 2)]


def thue_morse(n):
    """Two words of n letters that any hash which is a sum of powers modulo 2**64 takes for one, from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_polynomial_hash_keep_their_own_ids():
    from tokenizers import Tokenizer

    from assetlens.llm.simple8b import WordIds

    t, known = Tokenizer.from_file(PATH), WordIds(PATH)
    texts = [w for n in (1024, 2048, 8192) for w in thue_morse(n)]
    ids, n = known.encode_texts(texts, 2)
    assert ids.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]] and known.by_word


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    from tokenizers import Tokenizer

    from assetlens.llm import simple8b
    from assetlens.llm.common import Words

    monkeypatch.setattr(Words, "_hashes", lambda self: (self.end - self.start).astype(np.uint64) % np.uint64(3))
    monkeypatch.setattr(simple8b, "CACHE", 9)
    t, known = Tokenizer.from_file(PATH), simple8b.WordIds(PATH)
    for texts in (["one two six, ten!", None], ["ten six two one", "a bb ccc dddd. " + "e" * 70 + " " + "f" * 70], ["six"]):
        ids, _ = known.encode_texts(texts, 2)
        assert ids.tolist() == [i for x in texts for i in [*t.encode(x or "", add_special_tokens=False).ids, 2]]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    from assetlens.llm.simple8b import WordIds

    made = Tokenizer.from_file(PATH)
    made.normalizer = None
    path = str(tmp_path / "t.json")
    made.save(path)
    known = WordIds(path)
    ids, n = known.encode_texts(["Hello  World", None], 2)
    assert not known.by_word and n.tolist()[1] == 1 and ids.tolist() == [*made.encode("Hello  World", add_special_tokens=False).ids, 2, 2]


def test_new_words_are_tokenized_together_and_without_their_marks():
    """Words go to the tokenizer many in one text, and those that differ by punctuation behind them once, with the library's ids."""
    from tokenizers import Tokenizer

    from assetlens.llm.simple8b import WordIds

    t, known, asked = Tokenizer.from_file(PATH), WordIds(PATH), []
    real = known.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **kw)

    known.tokenizer = Counted()
    tails = ["", "###", "$$$", "***", "%%%", "&&&", "'", "_~`^", ".)]}", "\"'", "|>"]
    texts = ["".join(f"wörd{'abcdefg'[i]}ü{x} {i}{x} don't{x} " for x in tails) for i in range(7)]
    texts += ["a\x01b \x01 c\x01 \x01\x01", "x<|endoftext|>### <|endoftext|>$ <|", "\u0301a e\u0301* \x01\u0301", "s' 's 't' x's# \x7f z\x7f"]
    ids, lens = known.encode_texts(texts, 2)
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(asked) < 12 and sum(x.count("wörda") for x in asked) == 1

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from edgetide.llm import bpe_codec as codec
from edgetide.llm import queries as llm
from edgetide.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return codec.Merges.read(PATH)


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(PATH)
    tool.no_padding()
    tool.no_truncation()
    return tool


def same(merges, library, texts):
    found = codec.Encoder(merges).encode(texts)
    wanted = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in found] == wanted
    assert [codec.decode_ids(merges, x.astype(np.int64)) for x in found] == [library.decode(w, skip_special_tokens=False) for w in wanted]


def test_every_character_in_every_neighbourhood(merges, library):
    """Letters, digits and white space are told apart as the library does, for all of Unicode."""
    def near(c):
        return f"a{c}a {c}1{c} {c} {c}{c}\n{c}!{c}"

    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    same(merges, library, ["".join(map(near, characters[i:i + 4096])) for i in range(0, len(characters), 4096)])


def test_runs_added_tokens_and_random_texts(merges, library):
    dice = random.Random(3)
    texts = ["", " ", "\n \t x  y   ", "a" * 100_001, "ab" * 5000 + "  \n\n x", "x'll we've 'S 's", "<|endoftext|>",
             "a <|endoftext|> b<|endoftext|><|endoftext|><|endoftext", "\x00\x00 \x00", "漢字" * 3000]
    texts += ["".join(dice.choice("abcdefgh zéß漢字 0123'!\n") for _ in range(2000)) for _ in range(40)]
    texts += ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]
    same(merges, library, texts)


def test_pieces_and_a_forgetful_cache_change_nothing(merges, library, monkeypatch):
    dice = random.Random(4)
    texts = ["".join(dice.choice("ab  \n\t'1.é") for _ in range(3000)) for _ in range(20)] + [" " * 500, "x" * 500 + "\n " * 300]
    monkeypatch.setattr(codec, "PIECE", 17)
    monkeypatch.setattr(codec, "BATCH_WORDS", 50)
    monkeypatch.setattr(codec, "CACHE_WORDS", 20)
    same(merges, library, texts)


def test_bytes_that_are_no_text_decode_like_the_library(merges, library):
    dice = random.Random(5)
    for _ in range(200):
        ids = [dice.randrange(50257) for _ in range(30)]
        assert codec.decode_ids(merges, np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        codec.Merges.read(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="stands before"):
        letters = {c: i for i, c in enumerate(codec.byte_letters())}
        codec.Merges.build(letters | {"abc": 256, "ab": 257}, [("ab", "c"), ("a", "b")], {})


def test_whole_table_and_edge_cases(spark, merges, library, edge_docs, no_docs, sf):
    def wanted(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return (doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    found = [tuple(r) for r in llm.q_op11_bpe_codec(spark, sf).collect()]
    assert sorted(found) == sorted(wanted(*r) for r in docs)
    for frame in (edge_docs, no_docs):
        rows = codec.decode(codec.encode(frame, merges), merges).collect()
        given = frame.select("doc_id", "text").collect()
        assert sorted(((r["doc_id"], r["decoded"]) for r in rows), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in given), key=str)
        assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert codec.decode(spark.createDataFrame([(1, None, None)], codec.ENCODED), merges).first()["decoded"] == ""

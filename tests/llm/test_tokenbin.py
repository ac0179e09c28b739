import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import tokenbin
from brindle.llm.pretokens import Words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(300))])
def test_stream_round_trip(values):
    assert tokenbin.decode_stream(tokenbin.encode_stream(np.array(values, np.uint32))).tolist() == values


def test_words_as_the_library():
    words = Words(PATH, bits=8, most=500)
    random.seed(1)
    letters = "ab' \n\t.!?19s t're'll  'déß²ªµé—日本\x1c 'sve"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(4000)] + ["", "a<|endoftext|>b", "x" * 5000]
    for i in range(0, len(texts), 500):
        assert all(a.tolist() == b.tolist() for a, b in zip(words.encode(texts[i : i + 500]), words.whole(texts[i : i + 500])))


def test_written_file(spark, tmp_path):
    texts = {5: "hello world", 3: None, 9: "", 4: "naïve " * 30000, 7: "日本", None: "x"}
    rows = [*texts.items(), (5, "hello world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as crc")
    path = f"file://{tmp_path}/f"
    tokenbin.write(docs.repartition(3), path, tokenizer=PATH, end_id=2)
    got = sorted(tokenbin.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 4, 5, 5, 7, 9]
    library, start = Tokenizer.from_file(PATH), 0
    for r in got:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark, tmp_path):
    tokenbin.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", tokenizer=PATH, end_id=2)
    assert tokenbin.read(spark, f"file://{tmp_path}/e").count() == 0


def test_pieces_are_compared_and_not_only_their_hashes(monkeypatch):
    from brindle.llm import pretokens

    monkeypatch.setattr(pretokens, "mix64", lambda x: x % np.uint64(7))
    words = Words(PATH, bits=3)
    texts = ["one two three four five six seven " * 3, "eight nine ten one", "two eight"]
    for _ in range(2):
        assert all(a.tolist() == b.tolist() for a, b in zip(words.encode(texts), words.whole(texts)))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Words(public_tokenizers.path("word_bpe_49k.json"))

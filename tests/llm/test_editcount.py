import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import editcount
from brindle.llm.pretokens import Words

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = Words(PATH)
TEXT = st.lists(st.sampled_from(list("ab 'st\n  .1é") + ["   ", "日", "'re", "word ", "<|endof", "text|>", "\u3000", "“", "٣", "é\u0301", "\U0010ffff"]), max_size=300).map("".join)


def apply(text, edits):
    for pos, n_del, ins in edits:
        pos = max(0, min(pos, len(text)))
        text = text[:pos] + ins + text[max(pos, min(pos + n_del, len(text))) :]
    return text


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-3, 420), st.integers(0, 60), TEXT.map(lambda t: t[:12])), max_size=5))
def test_edits_as_a_recount(text, edits):
    text = text * 3
    doc = editcount.Document(text, *editcount.count(WORDS, [text])[0])
    editcount.apply(WORDS, [doc], [edits])
    want = apply(text, edits)
    assert doc.text == want
    assert doc.tree.tokens[1] == len(WORDS.whole([want])[0])
    assert doc.tree.chars[1] == len(want)


def test_long_text_encodes_regions_only():
    random.seed(4)
    text = " ".join(random.choice(["alpha", "beta's", "12,5", "\n\n", "ça", "“quoted”", "日本語", "<|endoftext|>", "Ελλάδα"]) for _ in range(20000))
    doc = editcount.Document(text, *editcount.count(WORDS, [text])[0])
    edits = [(random.randrange(len(text)), 5, " new") for _ in range(20)]
    editcount.apply(WORDS, [doc], [edits])
    assert doc.tree.tokens[1] == len(WORDS.whole([apply(text, edits)])[0])
    assert doc.encoded < len(text) / 5


def test_query_shape(spark):
    rows = [(1, "hello world " * 50, [(3, 2, "xx"), (100, 0, None), None]), (2, None, [(0, 9, "日本")]), (3, "", None), (4, "a", []), (4, "a", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<pos:int,n_del:int,ins:string>>").withColumn("n_tokens", docs_lit())
    state = editcount.counted(docs, tokenizer=PATH, keep=("doc_id", "edits"))
    got = sorted((r.doc_id, r.text, r.n_tokens, r.n_tokens_before) for r in editcount.edited(state, tokenizer=PATH).collect())
    count = lambda t: len(WORDS.whole([t])[0])
    one = apply(rows[0][1], [(3, 2, "xx")])
    assert got == [(1, one, count(one), count(rows[0][1])), (2, "日本", count("日本"), 0), (3, "", 0, 0), (4, "a", 1, 1), (4, "a", 1, 1)]


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit(7)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, edits array<struct<pos:int,n_del:int,ins:string>>")
    assert editcount.edited(editcount.counted(docs, tokenizer=PATH, keep=("doc_id", "edits")), tokenizer=PATH).count() == 0

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import bpe

PATH = os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_as_the_plain_definition_and_back(text):
    e = bpe.encoder(PATH)
    want = [i for w in e.findall(text) for i in bpe.merge_encode(w.encode("utf-8", "surrogatepass"), e.fst.ranks)]
    assert e.encode(text) == want
    assert "".join(bpe.decode_stream(want, e.fst.bytes_of)) == text


def test_same_as_another_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    for t in ("Hello world, 1234!", "ကြောင့် ဖြစ်", "zażółć 😀 \n\n  x", "a" * 5000, "<|endoftext|>"):
        assert bpe.encoder(PATH).encode(t) == other.encode_ordinary(t)


def test_bad_utf8():
    bytes_of = {0: b"\xe1\x80", 1: b"a", 2: b"\xff", 3: b"\xe1", 4: b"\x80\x80"}
    assert "".join(bpe.decode_stream([3, 4, 0, 1, 2], bytes_of)) == "က�a�"


def test_table(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, None), (3, ""), (4, "  ")], "doc_id bigint, text string")
    got = bpe.encode_documents(df, PATH)
    assert sorted((r.doc_id, len(r.ids)) for r in got.collect())[2:4] == [(2, 0), (3, 0)]
    assert {r.doc_id: r.text for r in bpe.decode_documents(got, PATH).collect()} == {1: "ab", 2: "", 3: "", 4: "  "}
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0

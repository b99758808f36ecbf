import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from lantern.llm import bpe  # noqa: E402

TEXTS = ["", "Hello, world!  It's 2024\n\n done", "naïve façade Straße 12½ 漢字かな交じり", "a" * 3000, " \t\n ", "🙂🙃🙂 é́ <|endoftext|>", "ab" * 2500 + " x", "don't WE'LL they've 's", "\r\n\r\n  x", "ñandú öä#%&&& $$$ 000111222"]


@pytest.fixture(scope="module")
def vocabulary():
    return open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()


def test_matches_library(vocabulary):
    ranks = bpe.read_ranks(vocabulary)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for t in [*TEXTS, "the quick brown Füchse 12 " * 50_000 + "xyz" * 20_000]:
        ids = codec.encode(t)
        assert ids.tolist() == want.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bounded_cache(vocabulary):
    codec = bpe.Codec(bpe.read_ranks(vocabulary), public_tokenizers.PATTERN)
    codec.known.most = 3
    text = " ".join(f"word{i}" for i in range(50))
    assert codec.decode(codec.encode(text)) == text.encode() and len(codec.known) <= 3


def test_documents(spark, vocabulary):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[1]])] + [(None, "abc", "y"), (1, TEXTS[1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    codec = bpe.Codec(bpe.read_ranks(vocabulary), public_tokenizers.PATTERN)
    want = sorted((str(i), len(codec.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got) == want
    assert all(hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r.token_ids)).hexdigest() == r.ids_sha256 for r in got)
    assert bpe.encode_documents(docs.limit(0), vocabulary, public_tokenizers.PATTERN).count() == 0

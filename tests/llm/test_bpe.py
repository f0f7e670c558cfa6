import random
import struct

import pytest
from pyspark.sql import functions as F

from folio.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe._Codec(bpe.load_vocabulary(PATH))


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_fragments_are_cut_where_no_token_reaches_over(codec):
    data = "The cat sat, 3 times: don't!".encode()
    parts = codec.fragments(data)
    assert b"".join(parts) == data and len(parts) > 5
    for left, right in zip(parts, parts[1:]):
        pair = left[-1:] + right[:1]
        assert not any(pair in t for t in codec.tokens.values())


def test_equal_to_the_library(codec, library):
    rng = random.Random(5)
    alphabet = ["a", "b", "Z", " ", "  ", "\n", "\t", "'s", "'re", "'", "!", "..", "é", "́", " ", "　", "\u0085", "\x1c", "​", "<|endoftext|>", "<|", "日", "1", "٣", "😀", "ß", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text.encode())
        assert ids(packed) == want, text
        assert codec.decode(packed) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_000, "ab " * 20_000, "日本" * 10_000, "'" * 5_000 + "s"])
def test_long_runs(codec, library, text):
    assert ids(codec.encode(text.encode())) == library.encode(text, add_special_tokens=False).ids


def test_parts_of_a_text_decode_with_replacement(codec):
    assert codec.decode(codec.encode("日".encode())[:4]) == "�"


def test_documents(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (3, "", "y"), (None, "long " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit("clash"))
    vocabulary = bpe.load_vocabulary(PATH)
    encoded = bpe.encode_documents(docs, vocabulary)
    got = bpe.decode_documents(encoded, vocabulary).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in got) == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in rows)
    assert all(ids(r["ids"]) == library.encode(r["decoded"], add_special_tokens=False).ids for r in got)
    assert bpe.encode_documents(docs.limit(0), vocabulary).collect() == []


def test_the_query_equals_the_library_on_all_documents(spark, data, library):
    import hashlib

    from folio.llm.registry import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op12_bpe"](spark, data).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_vocabularies_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))

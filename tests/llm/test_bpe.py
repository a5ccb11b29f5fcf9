import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from starloom.llm import bpe
from starloom.llm.common import tokenizer_path

TEXTS = [None, "", " ", "Hello, World!  it's 42² ΣΣ İx été", "a" * 5000, "x\x1cy z   q", "<|endoftext|> b<|startoftext|>c", "́ ́a", "tab\tnew\nline\r\x0b\x0c end", "don't we'll I'M they'RE", "\U0001f600\U0001f600 café naïve 你好", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_equals_library(spark, library):
    rows = [(i if i != 11 else None, t, "clash") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(docs).collect()}
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (i, tuple(ids), library.decode(ids, skip_special_tokens=False)) in got
    assert bpe.encode_documents(docs).count() == len(rows)
    assert bpe.digest_documents(docs.limit(0)).count() == 0


def test_digest_on_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.digest_documents(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        own = got[r.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

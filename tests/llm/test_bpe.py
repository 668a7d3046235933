import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import encode_decode, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_as_the_library(library, rows):
    r = random.Random(0)
    texts = [t or "" for _, t in rows] + ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|> Don't WE'LL 12345 !!! ΣΑΣ İé x\x1cy\x1f", "日本語 한국어 \U0001f600 👨‍👩‍👧", "<|endoftext", "ab" * 2000]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), r.randrange(0x4E00, 0x4F00), 32, 39])) for _ in range(r.randrange(60))) for _ in range(400)]
    ids, counts, decoded = vocabulary(PATH).encode(texts)
    at = 0
    for text, n, own in zip(texts, counts, decoded):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want
        assert own == library.decode(want, skip_special_tokens=False)
        at += n


def test_rows(docs, rows, library):
    out = encode_decode(docs, PATH)
    assert out.columns == [c if c != "n_tokens" else "n_tokens_in" for c in docs.columns] + ["n_tokens", "ids", "decoded"]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_empty(none):
    assert encode_decode(none, PATH).collect() == []

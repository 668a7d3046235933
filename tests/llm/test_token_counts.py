import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_as_the_library(docs, rows):
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    for buckets in (None, 300):
        got = token_counts(docs, PATH, buckets=buckets).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_white_space_and_marks(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["a  b\n\n c\t", "  ", "\n", "I'll don't 'S 12 3.4 ½ é́ 中文  x", "<|endoftext|><|endoftext|> x<|endoftext|>", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, PATH).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_empty(none):
    assert token_counts(none, PATH).collect() == []

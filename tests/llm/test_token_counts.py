import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from braidgraph.llm.token_counts import counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equals_the_library():
    library, count, draw = Tokenizer.from_file(PATH), counter(PATH), random.Random(3)
    letters = "aab  \n\t'strelvdm0123é日本\x1c\x85  😀!?<|endoftext|>"
    for i in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        if i % 3 == 0:
            text = text[:20] + "<|endoftext|>" + text[20:]
        assert count(text) == len(library.encode(text, add_special_tokens=False)), text
    for text in ("ab" * 30_000, "<|endoftext|>" * 3, " " * 500, "x" * 3000):
        assert count(text) == len(library.encode(text, add_special_tokens=False))


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    rows = docs.join(token_counts(docs, PATH), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(library.encode(r["text"], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(r["text"].encode()), n, n > 512)


def test_odd_rows(odd_docs, no_docs):
    rows = token_counts(odd_docs, PATH).collect()
    assert len(rows) == 10 and sorted(r["n_tokens"] for r in rows)[:3] == [0, 0, 0]
    assert token_counts(no_docs, PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        counter(public_tokenizers.path("word_bpe_49k.json"))

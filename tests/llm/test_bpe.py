import random

import pytest
from tokenizers import Tokenizer

from heliograph.llm.bpe import VOCABULARY, ByteBpe, encode

DOC = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def coder():
    with open(VOCABULARY, encoding="utf-8") as f:
        return ByteBpe(f.read())


def texts(n, seed):
    rnd = random.Random(seed)
    letters = "aaaaabcdefgh  \n\t'sélöñ漢字🚀0123456789<|>endoftext_=- 　́\x00\r"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def test_fuzz(coder, reference):
    many = [*texts(3000, 1), "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 50, "é" * 2000, "0123456789" * 500, "don't I'll we've"]
    offsets, ids = coder.encode_batch(many)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == reference(many)


def test_every_token_is_its_own_encoding(coder):
    assert len(coder.valid) == len(coder.ids)


def test_memory_is_bounded(coder, reference, monkeypatch):
    from heliograph.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    many = texts(300, 2)
    for _ in range(2):
        offsets, ids = coder.encode_batch(many)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == reference(many)


def test_portions_cover_all_rows():
    import pyarrow as pa

    from heliograph.llm.bpe import _portions

    texts = pa.array(["a" * n for n in (5, 0, 3, 100, 1)] + [None, "é" * 4])
    got = list(_portions(texts, 3, 9))
    assert [i for start, rows in got for i in range(start, start + rows)] == list(range(7)) and all(r <= 3 for _, r in got)
    assert list(_portions(texts.slice(0, 0))) == []


def test_table(spark, reference):
    many = [*texts(300, 3), "x " * 200_000, "x" * 100_000]
    rows = [(i, t, "clash") for i, t in enumerate(many)] + [(None, "a b", "c"), (900, None, "c"), (901, "", "c"), (0, many[0], "clash")]
    got = encode(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows) and all(r.ids is not None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.ids)
    assert by[900] == [[]] and by[901] == [[]] and len(by[0]) == 2
    assert [by[i][0] for i in range(len(many))] == reference(many)
    assert encode(spark.createDataFrame([], DOC)).count() == 0

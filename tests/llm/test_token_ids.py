"""The encoder against the tokenizer itself, as it comes from its file."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wavefield.llm import token_ids

PARTS = [
    " ", " ", " ", " ", "\n", "\n", "\t", "  ", "\r\n", "\n\n", "\n\n\n", "a", "Word", "the", "ing", "éß", "É", "don't", "'s", "12", ".", ",", "!?", "--", "<|endoftext|>", "<|ENDOFTEXT|>",
    "<|startoftext|>", "<|", "\x00", "\xa0", " ", "日本", "Σ", "ς", "İ", "é", "\U0001f600", "x" * 60, "ё", "ǅ", ";", "K",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_of_all_kinds(name):
    plain, rng = Tokenizer.from_file(token_ids.vocabulary(name)), random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4_000)]
    texts += ["a <|endoftext|> b", "", " ", "\n", "\n\n", "word\n", "word \n", "word\n\n", " lead", "lead  ", *PARTS]
    for memo in (40, token_ids.MEMO):
        e = token_ids.Encoder(token_ids.vocabulary(name), memo)
        for some in (texts, texts[:50], [None], []):
            for text, got in zip(some, e.encode(some), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_documents_and_end_ids(spark, name):
    plain = Tokenizer.from_file(token_ids.vocabulary(name))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = token_ids.Encoder(token_ids.vocabulary(name)).encode_array(pa.array(texts).slice(3), 7).to_pylist()
    assert got == [[*plain.encode(x or "", add_special_tokens=False).ids, 7] for x in texts[3:]]


def test_blocks_keep_every_row(monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK", 10)
    batch = pa.record_batch([pa.array(["a" * 50, None, "", "bb", "c" * 9, "d" * 3, "e"])], ["text"])
    found = list(token_ids.blocks(iter([batch, batch.slice(0, 0)])))
    assert [x for b in found for x in b.column("text").to_pylist()] == batch.column("text").to_pylist() and len(found) > 2

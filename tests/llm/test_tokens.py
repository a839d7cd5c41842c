import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokens as K

from .util import DOC, frame, words

ODD = [None, "", " ", "  ", "\n", "tail ", "  two", " lead  x", "a  b   c \n d\n\n e  ", "x\n y", "<|endoftext|> a <|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y  z", "é è\u00a0x \u2003 y", "a\tb \t c", "😀 😀  z"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(K.default_tokenizer())


def test_encode_equals_the_library(tok):
    rnd = random.Random(1)
    parts = [" ", " ", "\n", "\t", "\r", "a", "Bc.", "é", "12", "'s", "\u00a0"]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(10))) for _ in range(5000)]
    for t, b in zip(texts, K.encode(texts, K.default_tokenizer()), strict=True):
        assert np.frombuffer(b, "<u2").tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(K, "CACHE", 50)
    enc = K._Encoder(K.default_tokenizer())
    texts = [words(i, 60, 300) for i in range(40)]
    K.encoder.cache_clear()
    want = K.encode(texts, K.default_tokenizer())
    for _ in range(3):
        enc.learn({w for t in texts[:20] for w in t.split(" ")[1:]})
    K.encoder.cache_clear()
    assert [K.encode([t], K.default_tokenizer())[0] for t in texts] == want


def test_files_round_trip(spark, tok, tmp_path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (-5, words(3, 20_000))]
    manifest = K.write_tokens(frame(spark, docs), K.default_tokenizer(), f"file://{tmp_path}/out")
    ids = {}
    total = 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        assert r["base"] == total
        offsets, keys, flat = K.open_file(r["file"])
        for k, a, b in zip(keys, offsets[:-1], offsets[1:], strict=True):
            ids.setdefault(k, []).append(flat[a:b].tolist())
        total += r["n_tokens"]
    want = {}
    for k, t in docs:
        want.setdefault(k, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(v) for k, v in want.items()}
    rows = sorted(K.read_tokens(manifest).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in rows]
    assert order[0] is None and order[1:] == sorted(order[1:])
    crc = {zlib.crc32(np.array(x, "<u4").tobytes()) for v in want.values() for x in v}
    assert {r["ids_crc32"] for r in rows} == crc


def test_empty(spark):
    assert K.encode_to_files(frame(spark, [], DOC)).count() == 0

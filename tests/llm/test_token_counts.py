import random

import public_tokenizers
from helpers import AWKWARD, frame
from tokenizers import Tokenizer

from residua.llm import token_counts as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_matches_the_library(spark):
    rng = random.Random(1)
    texts = ["", "aaaa aaaaa   \n\n  x", "<|endoftext|>hi<|endoftext|>", "日本語テキスト 😀😀 é", "x\x1c\x1d\x85y​", "I'll don't we've ٣٤٥ ²½", "a" * 3000, "\r\n\t " * 50, "<|endoftext|", " '" * 30]
    texts += ["".join(rng.choice("abct hein 'sdlrv\n\t.,!?1290éß日 <|>\x1f\x00") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + r[0], r[1]) for r in AWKWARD]
    encoded = Tokenizer.from_file(PATH).encode_batch([t or "" for _, t, *_ in docs], add_special_tokens=False)
    want = sorted((i, len((t or "").encode()), len(e.ids)) for (i, t, *_), e in zip(docs, encoded, strict=True))
    for group in (1, 2_000_000):
        got = op.token_counts(frame(spark, docs), PATH, group_chars=group)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert op.token_counts(frame(spark, []), PATH).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(op, "CACHE", 10)
    counter = op.Counter(op.load(PATH))
    for i in range(20):
        counter.count([" ".join(f"w{i}x{k}" for k in range(8))])
    assert len(counter.cache) < 60

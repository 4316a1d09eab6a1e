import hashlib
import random
from collections import Counter
from pathlib import Path

import public_tokenizers
import sentencepiece
from helpers import AWKWARD, frame
from tokenizers import Tokenizer

from residua.llm import token_alignment as op

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FILES = [Path(p).read_bytes() for p in (A, B)]


def expected(rows):
    """Whole texts by the libraries, a loop over byte offsets."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    pair = op.Pair(*FILES)
    per, total = [], Counter()
    for i, text, *_ in rows:
        a = a_tok.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        want = f" {text}".encode() if text else b""
        if b"".join(pair.a_bytes[x] for x in a) != want or b"".join(pair.b_bytes[x] for x in b) != want:
            a, b = [], []
        ends, at, owner = [], 0, []
        for side, ids, table in ((0, a, pair.a_bytes), (1, b, pair.b_bytes)):
            at, mine = 0, {}
            for x in ids:
                at += len(table[x])
                mine[at] = x
            ends.append(mine)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = Counter((ends[0][c], ends[1][c]) for c in cuts)
        total += links
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(m[e]) for e in sorted(m) if last < e <= c) for m in ends))
            last = c
        text = ";".join(groups)
        per.append((i, len(a), len(b), len(cuts), sum(links.values()), hashlib.sha256(text.encode()).hexdigest() if text else "", links))
    top = Counter()
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    out = [(i, x, y, g, n, s, sum(k for p, k in links.items() if total[p] == top[p[1]]), sum(k * total[p] for p, k in links.items())) for i, x, y, g, n, s, links in per]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    alphabet = ["the", "there", "éle", " ", "  ", "\n", "\t", "'s", ".", ",", "123", "日本語", "😀", "x\x1cy", "\x00", "</s>", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "ing", "-", "(", " ", " "]
    rows = [(100 + i, "".join(rng.choices(alphabet, k=rng.randint(1, 40)))) for i in range(200)]
    odd = ["▁", "a ▁b c", " lead", "trail ", "two  spaces", " ", "  ", "\n", "a\n b", "a \n", "﻿bom", "é", "ﬁ ½ ①", "A" * 5000]
    return [*AWKWARD[:6], *AWKWARD[8:], (7, "long text " * 3000), *[(1000 + i, t) for i, t in enumerate(odd)], *rows]


WANT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_equals_a_loop(spark):
    rows = corpus()
    want = expected(rows)
    for most in (2_000_000, 10):  # broadcast, salted join
        got = op.alignment(frame(spark, rows), A, B, most_pairs=most)
        assert sorted(map(tuple, got.select(*WANT).collect()), key=str) == want
    assert op.alignment(frame(spark, []), A, B).count() == 0


def test_small_lines_and_caches(monkeypatch):
    rows = [(i, t) for i, t, *_ in corpus()]
    aligner = op.Aligner(op.Pair(*FILES))
    whole, groups, *_ = aligner.align([t or "" for _, t in rows])
    monkeypatch.setattr(op, "LINE", 7)
    monkeypatch.setattr(op, "CELLS", 20)
    again = op.Aligner(op.Pair(*FILES))
    for k, (_, t) in enumerate(rows):
        counts, own, *_ = again.align([t or ""])
        assert own == [groups[k]] and counts[0].tolist() == whole[k].tolist()
    again.pair.cut = False
    again.clear()
    counts, own, *_ = again.align([t or "" for _, t in rows])
    assert own == groups and (counts == whole).all()


def test_groups_are_kept_on_request(spark):
    row = op.alignment(frame(spark, [(1, "Hello there")]), A, B, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.n_overlaps >= row.n_links == row.groups.count(";") + 1

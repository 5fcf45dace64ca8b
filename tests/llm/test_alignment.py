import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from retailspark.llm import alignment

from .conftest import corpus, frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def brute(texts):
    """The contract, token by token and pair by pair."""
    lib, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    out, seen = [], Counter()
    for text in texts:
        t = text or ""
        a = lib.encode(" " + t, add_special_tokens=False)
        b = model.encode(t)
        a_ids = a.ids  # a new list each time it is asked for
        a_bytes = [bytes(BYTE[c] for c in x) for x in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(model.id_to_piece, b))]
        whole = (" " + t).encode()
        if not t or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append(None)
            continue
        spans = []
        for side in (a_bytes, b_bytes):
            at, here = 0, []
            for x in side:
                here.append((at, at + len(x)))
                at += len(x)
            spans.append(here)
        links = []
        low = 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((a_ids[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        i = j = 0
        for cut in cuts:
            x, y = [], []
            while i < len(a_ids) and spans[0][i][1] <= cut:
                x.append(str(a_ids[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                y.append(str(b[j]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        seen.update(set(links))
        out.append((len(a_ids), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (x, _), n in seen.items():
        most[x] = max(most.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(seen[p] == most[p[0]] for p in r[3]), sum(seen[p] for p in r[3]), r[4]) for r in out]


EXTRA = [(800, "a\n b  c\tñ\x00d"), (801, "<|endoftext|> <s></s><unk> x"), (802, "▁under▁lines"), (803, " "), (804, "  two"), (805, "́é"), (806, "🙂🙂 naïve ﬁ"), (807, "x" * 3000 + "\n" * 700)]


def expected(rows):
    return sorted(((d, *r) for (d, _), r in zip(rows, brute([t for _, t in rows]))), key=repr)


def test_alignment_against_brute_force(spark):
    rows = [r for r in corpus() if r[0] != 701] + EXTRA
    got = sorted(map(tuple, alignment.alignments(frame(spark, rows), A, B).collect()), key=repr)
    assert got == expected(rows)


def test_several_pieces_of_the_counts_and_a_very_long_text(spark, none, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_EACH", 3000)
    monkeypatch.setattr(alignment, "STRETCH", 64)
    rows = [r for r in corpus() if r[0] in (1, 2, 500, 600, 701)]
    got = sorted(map(tuple, alignment.alignments(frame(spark, rows), A, B).collect()), key=repr)
    assert got == expected(rows)
    assert alignment.alignments(none, A, B).collect() == []


def cut_at(sizes):
    return np.cumsum(sizes)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, n)), st.sets(st.integers(1, n)))), min_size=1, max_size=6), st.integers(1, 8))
def test_lockstep_links_overlaps_and_cuts_common_ends(texts, stretch):
    a_end, b_end, a_n, b_n, at = [], [], [], [], 0
    for n, x, y in texts:
        x, y = sorted(x | {n}), sorted(y | {n})
        a_end += [at + e for e in x]
        b_end += [at + e for e in y]
        a_n.append(len(x))
        b_n.append(len(y))
        at += n
    a_end, b_end, a_stop, b_stop = map(np.array, (a_end, b_end, np.cumsum(a_n), np.cumsum(b_n)))
    want = {(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if max(a_end[i - 1] if i else 0, b_end[j - 1] if j else 0) < min(a_end[i], b_end[j])}
    before, alignment.STRETCH = alignment.STRETCH, stretch
    try:
        some = alignment._stretches(a_end, b_end, a_stop - a_n, a_stop, b_stop - b_n)
    finally:
        alignment.STRETCH = before
    for first, stop, begun in (some, (a_stop - a_n, a_stop, b_stop - b_n)):
        la, lb, ca, cb = alignment.lockstep(a_end, b_end, first, stop, begun)
        assert len(la) == len(want) and set(zip(la.tolist(), lb.tolist())) == want
        assert sorted(a_end[ca].tolist()) == sorted(set(a_end.tolist()) & set(b_end.tolist())) == sorted(b_end[cb].tolist())

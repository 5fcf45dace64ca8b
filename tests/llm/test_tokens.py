import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import AddedToken, Tokenizer

from retailspark.llm import bpe, packing, tokenfile, tokens

from .conftest import corpus

RANKS, SPEC = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(SPEC)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def strange(n):
    r = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "ab", "é", "日", "'s", "'ll", "1", "12", "!!", "\x85", "\xa0", "\x1c", "﻿", "aaaa", "<|endoftext|>", "🎉"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a" * 50_000, "ab" * 20_000, " " * 3000 + "x", "".join(r.choice("abcdefgh") for _ in range(60_000))]


def test_bitmap_finds_the_least():
    m, have, r = bpe.Bitmap(), set(), random.Random(1)
    assert m.least() == -1
    for _ in range(3000):
        x = r.randrange(64**3)
        m.add(x)
        have.add(x)
        if r.random() < 0.4:
            y = r.choice(sorted(have))
            m.discard(y)
            have.discard(y)
        assert m.least() == min(have, default=-1)


def test_encoding_equals_tiktoken(reference):
    coder = bpe.Bpe(bpe.load_ranks(RANKS), P.PATTERN, cached=500)
    texts = strange(3000)
    for i in range(0, len(texts), 700):
        some = texts[i:i + 700]
        got = coder.encode(some)
        assert got == [u4(reference.encode_ordinary(t)) for t in some]
        assert [coder.decode(g) for g in got] == [t.encode() for t in some]
    assert coder.encode(["ab cd " * 100, ""], run=50) == coder.encode(["ab cd " * 100, ""])


def test_merges_follow_ranks_where_a_merge_makes_a_lower_one():
    # "bc" (256) makes the pair (a, bc) of a lower rank than others that wait
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b"cd": 258, b"aa": 259, b"aaa": 260, b"aaaa": 261}
    own, other = bpe.Bpe(ranks, r".+"), tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for t in ["".join(r.choice("abcd") for _ in range(r.randint(1, 30))) for _ in range(500)] + ["a" * n for n in range(1, 40)]:
        assert own.encode([t])[0] == u4(other.encode_ordinary(t))


def test_documents_encode_and_decode(docs, none, reference):
    got = bpe.digests(docs, RANKS, P.PATTERN).collect()
    want = []
    for d, t in corpus():
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(u4(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    full = bpe.encode_documents(docs, RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in full if r.doc_id) == sorted(w for w in want if w[0])
    assert bpe.digests(none, RANKS, P.PATTERN).collect() == []


def test_encoder_equals_the_library(library):
    enc = tokens.Encoder(SPEC)
    assert enc.fast is not None
    texts = strange(800)
    assert [x.tolist() for x in enc.encode(texts)] == [library(t) for t in texts]


def test_added_tokens_in_texts_are_matched(spark, tmp_path):
    library = Tokenizer.from_file(SPEC)
    plain = lambda text: library.encode(text, add_special_tokens=False).ids
    texts = strange(400) + ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|> z", "<|endoftext|", "don<|endoftext|>'t  <|endoftext|>\n\n q"]
    assert plain("a<|endoftext|>b") == [64, 50256, 65]
    assert [x.tolist() for x in tokens.encoder(SPEC).encode(texts)] == [plain(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, SPEC, 2)).collect()
    assert {r.doc_id: bytes(r.ids) for r in got} == {i: u4([*plain(t), 2]) for i, t in enumerate(texts)}
    # overlapping and stripping added tokens: by the library
    odd = Tokenizer.from_file(SPEC)
    odd.add_special_tokens([AddedToken("<|end", special=True), AddedToken("<mask>", lstrip=True, special=True)])
    odd.add_tokens([AddedToken("qq", normalized=False)])
    odd.save(str(tmp_path / "odd.json"))
    more = [*texts, "a  <mask> b", "qqq <|end|> aqqb"]
    assert [x.tolist() for x in tokens.encoder(str(tmp_path / "odd.json")).encode(more)] == [odd.encode(t, add_special_tokens=False).ids for t in more]


def test_an_encoder_that_disagrees_stops(monkeypatch):
    enc = tokens.Encoder(SPEC)
    monkeypatch.setattr(enc, "_by_library", lambda t: np.array([1, 2, 3], np.uint32))
    with pytest.raises(ValueError, match="disagree"):
        enc.encode(["some text"])


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000, 40_001])
def test_variable_length_coding_round_trip(n):
    r = np.random.default_rng(n)
    v = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = tokenfile.pack(v)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in v)
    assert (tokenfile.unpack(control, data, n) == v).all()


def test_foreign_blocks_are_refused():
    with pytest.raises(ValueError):
        tokenfile.read_block(b"XXXX" + bytes(60))


def test_token_files(spark, docs, none, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_TOKENS", 2000)
    path = tokenfile.write_tokens(docs, SPEC, 2)
    got = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    want = {}
    for d, t in corpus():
        want.setdefault(d, []).append(u4([*library(t), 2]))
    have = defaultdict(list)
    at, last = 0, None
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        assert last is None or r.doc_id >= last  # nulls first, then ascending
        at, last = at + r.n_tokens, r.doc_id
        have[r.doc_id].append(bytes(r.ids))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True) and sum(r.n for r in ranks) == at
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(none, SPEC, 2)).collect() == []


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed,high", [(0, 100), (1, 40), (2, 64), (3, 10)])
def test_plans_hold_all_and_waste_little(seed, high):
    r = random.Random(seed)
    lengths = [r.randint(1, high) for _ in range(r.randint(1, 900))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan(histogram, 100)
    held = defaultdict(int)
    for take, copies in plan:
        assert copies > 0 and sum(n * k for n, k in take.items()) <= 100
        for n, k in take.items():
            held[n] += k * copies
    assert dict(held) == histogram
    assert sum(c for _, c in plan) <= best_fit_decreasing(lengths, 100) * 1.01 + 1


def test_most_sequences_come_from_the_program(monkeypatch):
    rest = []
    greedy = packing._greedy
    monkeypatch.setattr(packing, "_greedy", lambda *a: rest.append(greedy(*a)) or rest[-1])
    r = random.Random(5)
    histogram = {n: r.randint(1, 60) for n in range(1, 200)}
    sequences = sum(copies for _, copies in packing.plan(histogram, 200))
    assert sequences <= best_fit_decreasing([n for n, c in histogram.items() for _ in range(c)], 200) * 1.01 + 1
    assert sum(copies for _, copies in rest) <= 0.25 * sequences


def test_a_program_covers_about_once():
    lengths, counts = np.array([3, 4, 7]), np.array([100, 100, 100])
    solution = packing.cover(lengths, counts, 10)
    assert math.isclose(sum(x * float(lengths @ take) for take, x in solution), float(lengths @ counts))
    whole = packing.rounded(solution, counts)
    assert (sum(take * n for take, n in whole) <= counts).all()


def test_plan_of_awkward_lengths():
    assert packing.plan({}, 10) == []
    assert sum(c for _, c in packing.plan({6: 5}, 10)) == 5
    assert sum(c for _, c in packing.plan({6: 5, 4: 5}, 10)) == 5
    assert sum(c for _, c in packing.plan({7: 4, 3: 2, 1: 6}, 10)) == 4
    assert sum(c for _, c in packing.plan({10: 10**9, 5: 10**9}, 10)) == 15 * 10**8
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_knapsack_is_optimal():
    r = random.Random(9)
    for _ in range(30):
        n = np.array(sorted(r.sample(range(1, 13), 4)))
        v, most = np.array([r.randint(1, 20) for _ in n], float), np.array([r.randint(0, 4) for _ in n])
        take = packing.knapsack(n, v, most, 20)
        best = max(sum(k * x for k, x in zip(ks, v)) for ks in np.ndindex(*(most + 1)) if (np.array(ks) * n).sum() <= 20)
        assert (take <= most).all() and (take * n).sum() <= 20 and abs((take * v).sum() - best) < 1e-9


def test_packed_documents(docs, none, library):
    got = packing.pack_documents(docs, SPEC, 2, 64).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for d, t in corpus():
        ids = [*library(t), 2]
        cuts = [0, len(ids)] if len(ids) <= 64 else [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want[d] += [(i, a, b - a, zlib.crc32(u4(ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64
    assert len(sequences) <= best_fit_decreasing([r.length for r in got], 64) * 1.01 + 1
    assert packing.pack_documents(none, SPEC, 2, 64).collect() == []

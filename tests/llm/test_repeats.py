import hashlib
import random
import re
import struct
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
import xxhash

from retailspark.llm import components, jaccard, queries, substrings, syncmers
from retailspark.llm.common import number_within
from pyspark.sql import functions as F

from .conftest import corpus, frame, passage

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removed(rows, n):
    split = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, split):
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i:i + n])] > 1:
                hit[i:i + n] = [True] * n
        kept = [x for x, h in zip(w, hit) if not h]
        out.append((d, len(w), sum(hit), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [35, 5])
def test_repeated_passages(docs, none, n):
    got = substrings.remove_repeats(docs, n, ["doc_id"], digest=True).collect()
    assert sorted(((r.row.doc_id, r.n_words, r.n_removed, r.result) for r in got), key=repr) == brute_removed(corpus(), n)
    assert substrings.remove_repeats(none, n).collect() == []


def test_repeated_passages_small_alphabet(spark):
    r = random.Random(12)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(30)]
    for n in (3, 8, 12):
        got = substrings.remove_repeats(frame(spark, rows), n, digest=True).collect()
        assert sorted(((r.row.doc_id, r.n_words, r.n_removed, r.result) for r in got), key=repr) == brute_removed(rows, n)


def test_texts_without_removals_stay_as_they_are(spark):
    rows = [(1, "a  b\n c "), (2, None), (3, ""), (4, "x y z w"), (5, "q x y z w")]
    df = frame(spark, rows)
    got = {r.row.doc_id: (r.result, r.row.dk) for r in substrings.remove_repeats(df, 4, ["doc_id", "dk", "row"]).collect()}
    assert got == {1: ("a  b\n c ", "x"), 2: (None, "x"), 3: ("", "x"), 4: ("", "x"), 5: ("q", "x")}


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def joined(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, **kw).collect()), key=repr)


def test_near_duplicates(docs, none):
    assert joined(docs) == brute_components(corpus())
    assert joined(none) == []


def variants(seed):
    """Groups at all distances around the threshold, with passages that many share."""
    r = random.Random(seed)
    common = passage(70, 25).split()
    out = []
    for i in range(16):
        base = passage(1000 * seed + i, r.choice([3, 6, 12, 30, 60, 100])).split()
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                at = r.randrange(len(w))
                w[at:at + r.randint(0, 2)] = [f"w{r.randint(0, 5)}"] * r.randint(0, 2)
            if r.random() < 0.4:
                w = w + common
            if r.random() < 0.1:
                w = [x.upper() for x in w]
            out.append((len(out) * 7 % 1009, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,rounds", [(1, 3), (2, 0), (3, 1)])
def test_near_duplicates_around_the_threshold(spark, seed, rounds):
    rows = variants(seed)
    assert joined(frame(spark, rows), rounds=rounds) == brute_components(rows)


def test_one_of_each_group_stays(docs, none):
    rows = corpus()
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    # rows without words all stay; of the others one a component, of the smallest doc_id
    blank = Counter((d, t) for d, t in rows if not WORD.findall(t or ""))
    assert {x: k for x, k in got.items() if x in blank} == blank
    ids = sorted((d for (d, t), k in got.items() if (d, t) not in blank for _ in range(k)), key=repr)
    # doc_id 600 has two texts that aren't alike: two groups
    assert ids == sorted([*{c for _, n, c in brute_components(rows) if n}, 600], key=repr)
    assert jaccard.one_of_each(none).collect() == []


def test_the_suffix_filter_only_drops_what_cannot_link():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(400):
        x = np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], r.integers(0, 60, r.integers(0, 6)).astype(np.uint64)]))
        if len(y):
            i = len(np.intersect1d(x, y))
            assert jaccard.linked(x, y) == (100 * i >= 75 * (len(x) + len(y) - i))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 9), (9, 3), (-4, 3)]
    random.Random(1).shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 100 for i in range(101, 141)} | {i: 500 for i in range(501, 560)} | {3: -4, 9: -4}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("x"))
    got = defaultdict(list)
    for r in number_within(df, ["g"], [F.col("x")], "i", 10_000_000).collect():
        got[r.g].append(r.i)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got) == 3


def x64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def q(x):
    return struct.pack("<Q", x)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_syncmers_are_context_free(spark):
    text = passage(77, 200)
    df = spark.createDataFrame([(text, "zz yy xx " + text)], "a string, b string")
    a, b = df.select(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).first()
    inside = {(x.pos + 3, x.hash) for x in a}
    assert inside <= {(x.pos, x.hash) for x in b}
    assert 0.25 < len(a) / 195 < 0.55


def test_short_texts_have_fingerprints_of_their_own(spark):
    # by the rule alone: different piece sequences differ, equal ones are equal
    texts = [passage(2000 + i, 1 + i % 9) for i in range(180)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t.replace(" ", " \n ")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = dict(df.select("i", syncmers.fingerprint(syncmers.anchors(F.col("text")))).collect())
    own = [got[i] for i in range(len(texts))]
    assert all(own) and len(set(own)) == len(set(texts))
    assert own == [got[1000 + i] for i in range(len(texts))]


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x4E00 + 800))), "กขคงจฉชซญดตถทธนบปผฝพฟมยรลวสหอฮ", "🎉🎈🎁🎂🎄🎃🎆🎇", "ACGT", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
def test_syncmers_of_blankless_texts_are_context_free(spark, letters):
    r = random.Random(31)
    text = "".join(r.choice(letters) for _ in range(600))
    rows = [(text, front + text) for front in (letters[1], letters[2] * 5, letters[:3] * 7)]
    df = spark.createDataFrame(rows, "a string, b string")
    for a, b in df.select(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).collect():
        first = {x.hash for x in a}
        assert len(first) > 20 and len(first & {x.hash for x in b}) >= 0.9 * len(first)


ENDS = set("aeiouAEIOU0257_/.,;:=&?!-")


def piece_list(text):
    out = []
    for run in re.split(r"[ \t\n\x0b\f\r]+", text):
        if len(run) <= 12:
            out += [run] * bool(run)
            continue
        now = ""
        for ch in run:
            if ord(ch) > 127:
                out += [now] * bool(now) + [ch]
                now = ""
                continue
            now += ch
            if ch in ENDS or len(now) == 12:
                out.append(now)
                now = ""
        out += [now] * bool(now)
    return out


def chain(xs):
    s = 42
    for x in xs:
        s = x64(q(x % (1 << 64)), s)
    return signed(s)


def all_anchors(text):
    """(piece, hash) by the rule of the module's head, from the pieces on: closed syncmers, else the whole sequence."""
    h = [x64(w.encode()) for w in piece_list(text)]
    pairs = [chain(h[i:i + 2]) for i in range(len(h) - 1)]
    kmers = [pairs[i:i + 5] for i in range(len(h) - 5)]
    chosen = [(i, chain(m[::2])) for i, m in enumerate(kmers) if min(m[0], m[4]) == min(m)]
    return chosen or ([(0, chain(h))] if h else [])


def printed(found):
    return " ".join(f"{p - b:X}.{h % (1 << 64):X}" for (p, h), (b, _) in zip(found, [(0, 0), *found]))


def alike(a, b):
    """From the two strings alone."""
    sets = []
    for text in (a, b):
        now = [tuple(int(x, 16) for x in t.split(".")) for t in text.split()]
        sets.append({(h0, h, gap) for (_, h0), (gap, h) in zip(now, now[1:])} | {now[0][1] for _ in now[:1]})
    both = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(both) if both else 1.0


def fingerprints_of(rows):
    keyed = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x64(x[1].encode()))))
    want = {}
    for (d, t), (_, nxt) in zip(keyed, keyed[1:] + keyed[:1]):
        n = len(t)
        edited = t[:n - n // 2] + nxt[:n // 2]
        own, changed, after = (printed(all_anchors(x)) for x in (t, edited, nxt))
        want[d, t] = (d, n, hashlib.sha256(edited.encode()).hexdigest(), own, changed, alike(own, changed), alike(own, after))
    return sorted((want[d, t or ""] for d, t in rows), key=repr)


def test_fingerprints(spark, none):
    r = random.Random(8)
    cjk = "".join(chr(r.randrange(0x4E00, 0x5200)) for _ in range(900))
    long = [passage(3000 + i, 1500) for i in range(4)]
    rows = corpus() + [(800, long[0]), (799, long[0][:6000] + " " + long[1]), (798, long[1] + " " + long[2]), (797, long[3]), (796, cjk), (795, "前" + cjk), (794, cjk[:300])]
    rows += [(900 + i, passage(2000 + i, 5 + i % 5)) for i in range(60)]
    got = syncmers.edited_likeness(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == fingerprints_of(rows)
    assert syncmers.edited_likeness(none).collect() == []


def test_matching_is_by_position(spark):
    a, b, c = (passage(5000 + i, 120) for i in range(3))
    shuffled = a.split(" ")
    random.Random(4).shuffle(shuffled)
    rows = [(3, " ".join((a, b, c))), (2, " ".join((c, a, b))), (1, " ".join(shuffled)), (0, a)]
    near = {r.doc_id: r.near_next for r in syncmers.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near[3] > 0.9  # moved passages, but for the seams
    assert near[1] == 0  # the same words, dealt anew
    same = [(9, a), (8, a)]
    got = syncmers.edited_likeness(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in got}) == 1 and all(r.near_next == 1 for r in got)


@pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    own = queries.QUERIES[name](spark, SF)
    sql = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(own.columns)
    assert sorted(map(tuple, own.select(columns).collect())) == sorted(sql.fetchall())

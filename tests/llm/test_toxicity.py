import math
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailspark.llm import langid, quality, queries, toxicity

from .conftest import corpus, frame, passage

SF = "/root/testdata/sf0.1"


def distance(a, b, prefix=False):
    """Levenshtein distance of entry ``a`` to ``b`` (or to any beginning of b)."""
    row = list(range(len(a) + 1))
    best = row[-1]
    for c in b:
        new = [row[0] + 1]
        for i, x in enumerate(a):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best if prefix else row[-1]


ENTRIES = [("scum", False), ("idiot", False), ("worthless", False), ("trash", False), ("lowe", True), ("schmutz", True), ("trasher", False), ("ñé", False)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("idiotscumwrhlezaéñ", min_size=1, max_size=12), st.sampled_from([w for w, _ in ENTRIES]).flatmap(lambda w: st.tuples(st.just(w), st.integers(0, len(w)), st.integers(0, 2), st.text("aeirst-é1", max_size=3))).map(lambda x: x[0][:x[1]] + x[3] + x[0][x[1] + x[2]:])))
def test_automaton_accepts_what_levenshtein_distance_allows(text):
    machine = toxicity.automaton(ENTRIES)
    words = toxicity.words_of([text], machine.classes())
    word, entry, edits = toxicity.matches(machine, words)
    for i in range(len(words.start)):
        w = words.word(i)
        whole = [(distance(e, w), n) for n, (e, stem) in enumerate(ENTRIES) if not stem and distance(e, w) <= toxicity.edits_allowed(e, False)]
        stems = [(k, n) for k in range(1, len(w) + 1) for n, (e, stem) in enumerate(ENTRIES) if stem and distance(e, w[:k]) <= toxicity.edits_allowed(e, True)]
        got = [(e, n) for x, n, e in zip(word.tolist(), entry.tolist(), edits.tolist()) if x == i]
        if stems:  # the word is taken at the first beginning that a stem accepts
            assert len(got) == 1 and ENTRIES[got[0][1]][1] and distance(ENTRIES[got[0][1]][0], w, True) <= got[0][0]
        else:
            assert got == ([min(whole)] if whole else [])


def test_words_are_trimmed_and_belong_to_their_text():
    texts = ["The $$trash%% is, (x) 12\nId!ot.", "", "«ÉTÉ»", None]
    words = toxicity.words_of([t or "" for t in texts], toxicity.automaton([]).classes())
    assert [words.word(i) for i in range(len(words.start))] == ["the", "trash", "is", "x", "id!ot", "été"]
    assert words.owner.tolist() == [0, 0, 0, 0, 0, 2]


def labelled(n=400):
    r = np.random.default_rng(3)
    bad = ["idiot", "moron", "worthless"]
    rows = []
    for i in range(n):
        ws = passage(i + 5000, 80).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(int(r.integers(0, 80)), bad[int(r.integers(0, 3))])
        elif i % 8 == 1:  # quoted, reported, in clean documents
            ws[10:10] = ["they", "said", '"' + bad[i % 3] + '"', "reportedly"]
        rows.append((" ".join(ws), int(i % 4 == 0)))
    return rows


def test_misspellings_abuse_and_quotation():
    rows = labelled()
    model = toxicity.learned([t for t, _ in rows], np.array([y for _, y in rows]))
    assert {e for e, _ in model.entries} >= {"idiot", "moron", "worthless"}
    assert model.quotation < -1 and {"said", "reportedly"} <= set(model.context) and model.context["said"] < 0
    base = passage(99_999, 60)
    texts = [base, base + " you idiot and moron", base + " you id1ot you morron, wortless", base + ' they said "idiot" reportedly ' + base, ""]
    s = model.score(texts, model.machine.classes())
    assert s[0] < 0.2 and s[4] < 0.2 and s[1] > 0.5 and s[3] < 0.5
    assert s[2] > s[0] and s[1] > s[3]
    alone = [model.score([t], model.machine.classes())[0] for t in texts]
    assert np.allclose(s, alone)


def test_a_large_group_of_near_copies_counts_once():
    rows = [(passage(i, 60), 0) for i in range(150)] + [(passage(7000, 60) + f" idiot end{i}", 1) for i in range(100)] + [(passage(8000 + i, 60) + " idiot", 1) for i in range(20)]
    model = toxicity.learned([t for t, _ in rows], np.array([y for _, y in rows]))
    assert [e for e, _ in model.entries] == ["idiot"]


@pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")
def test_toxicity_of_held_out_documents(spark):
    got = queries.op11_toxicity(spark, SF).toPandas()
    assert len(got) == 10_000
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    out = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.01


def test_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(1, 0), (1, 1), (None, 1), (2, None), (999, 1), (600, 1), (500, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.predictions(docs, model).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, _ in corpus()), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.predictions(none, model).collect() == []
    nothing = toxicity.fit(none, labels, F.lit(True))
    assert {r.score for r in toxicity.predictions(docs, nothing).collect()} == {0.5}
    one = toxicity.learned(["a b", "c"], np.array([1, 1]))
    assert one.score(["x"], one.machine.classes())[0] == pytest.approx(0.999, abs=1e-3)


def test_surprise_is_the_likelihood_ratio():
    ll = lambda k, n, p: k * math.log(p) + (n - k) * math.log(1 - p)
    want = 2 * (ll(9, 40, 9 / 40) + ll(3, 200, 3 / 200) - ll(9, 40, 12 / 240) - ll(3, 200, 12 / 240))
    assert toxicity.surprise(9, 3, 40, 200) == pytest.approx(want)
    assert toxicity.surprise(1, 50, 40, 200) == 0 == toxicity.surprise(0, 0, 40, 200)


def test_samples_use_a_repeated_id_once_and_rows_without_id_are_held_out(spark):
    rows = [(1, "the cat and the dog " * 5, "en")] * 200 + [(i, "der hund und die katze " * 5, "de") for i in range(2, 30)] + [(None, "the cat", "en"), (1, "le chat", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    from retailspark.llm.features import labelled_sample
    got = labelled_sample(docs, "lang", F.lit(True), 10, 50).collect()
    assert len(got) == 11 and [r.lang for r in got if r.doc_id == 1] == ["en"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), per_label=5)
    assert model.weights.any()
    assert docs.select(queries.held_out(4, 2), "doc_id").filter("doc_id IS NULL").first()[0] is True
    assert langid.fit(docs, F.lit(True), windows=1).classes == ["de", "en"]

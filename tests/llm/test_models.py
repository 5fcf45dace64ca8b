import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retailspark.llm import langid, quality, queries
from retailspark.llm.arrowtext import raw

from .conftest import corpus, frame

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")


@here
def test_languages_of_held_out_documents(spark):
    got = queries.op5_langid(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    assert len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


@here
def test_quality_of_held_out_documents(spark):
    got = queries.op9_quality(spark, SF).toPandas()
    assert len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    out = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.7
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean() > 0.97


def test_windows_hold_every_byte_once():
    texts = ["", "a" * 256, "b" * 257, None, "é" * 300, "x"]
    data, offs = raw(pa.array(texts))
    x, owner = langid.cut(data, offs)
    for i, t in enumerate(texts):
        assert bytes(x[owner == i].reshape(-1)).rstrip(b"\0") == (t or "").encode()


def test_tables_and_plain_convolution_agree():
    r = np.random.default_rng(3)
    x = r.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.train(x, r.integers(0, 3, 40), ["a", "b", "c"], epochs=1)
    plain, at = net.pooled_at(x)
    assert np.allclose(net.pooled(x, net.tables()), plain, atol=1e-4)
    w = langid.WIDTHS[1]  # against the definition
    e = net.embed[x]
    conv = np.stack([np.einsum("bwd,wdf->bf", e[:, i:i + w], net.filters[w]) for i in range(langid.WINDOW - w + 1)], 1)
    k = langid.FILTERS
    assert np.allclose(np.maximum(conv.max(1) + net.bias[w], 0), plain[:, k:2 * k], atol=1e-4)


def languages(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 8, "en"), ("der hund und die katze " * 8, "de")] * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_edge_cases(spark, docs, none):
    net = langid.fit(languages(spark), F.lit(True), windows=2)
    assert net.classes == ["de", "en"]
    got = langid.identify(docs, net).collect()
    letters = sorted(((d, any(c.isalpha() for c in t or "")) for d, t in corpus()), key=repr)
    assert sorted(((r.doc_id, r.lang_pred != "und") for r in got), key=repr) == letters
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.identify(none, net).collect() == []
    kept = langid.accepted(docs, net, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(x for _, x in letters)
    long = frame(spark, [(1, "der hund und die katze " * 20_000), (2, "the cat and the dog")])
    assert {r.doc_id: r.lang_pred for r in langid.identify(long, net).collect()} == {1: "de", 2: "en"}
    # nothing to learn from
    empty = langid.fit(languages(spark).filter("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    null = spark.createDataFrame([(1, None, "en"), (2, "abc", None), (None, "abc", "en")], "doc_id long, text string, lang string")
    assert langid.fit(null, F.lit(True)).classes == ["und"]


def test_training_is_repeatable(spark):
    a, b = (langid.fit(languages(spark).repartition(n), F.lit(True)) for n in (1, 5))
    assert np.array_equal(a.embed, b.embed) and np.array_equal(a.out, b.out)


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [(" " + w + " ")[i:i + k] for w in words for k in quality.SIZES for i in range(len(w) + 3 - k)]
    return len(words), len(grams), max(0, len(words) - 1)


def test_features_are_words_ngrams_and_pairs():
    texts = ["the cat sat", "", "a a a bb", "  x\n\nyé  ", "日本語 テキスト", "one"]
    kinds = [np.bincount(owner, minlength=len(texts)) for _, owner in quality.features(texts)]
    n = len(quality.SIZES)
    for i, t in enumerate(texts):
        words, grams, pairs = plain_features(t)
        assert (sum(k[i] for k in kinds[:n]), kinds[n][i], kinds[n + 1][i]) == (grams, words, pairs)
    buckets = [b for b, _ in quality.features(["ab cd ab", "ab"])]
    assert buckets[n][0] == buckets[n][2] == buckets[n][3] != buckets[n][1]
    assert list(quality.features(["x x y"]))[n + 1][0][0] == 0
    assert list(quality.features([])) == [] or all(len(b) == 0 for b, _ in quality.features([]))


def test_a_batch_scores_as_each_text_alone():
    r = np.random.default_rng(0)
    model = quality.Model(r.standard_normal(quality.BUCKETS).astype(np.float32), 0.2)
    texts = [t or "" for _, t in corpus()]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])
    assert abs(model.score([""])[0] - 1 / (1 + np.exp(-0.2))) < 1e-12


def test_quality_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(1, 0), (1, 1), (None, 1), (2, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.predictions(docs, model).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d for d, _ in corpus()), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.predictions(none, model).collect() == []
    kept = quality.accepted(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    one = quality.fit(docs, labels.filter("quality = 1 AND doc_id > 1"), F.lit(True))
    assert all(r.predicted == 1 for r in quality.predictions(docs, one).collect())
    nothing = quality.fit(docs, labels.filter("false"), F.lit(True))
    assert nothing.score(["x"])[0] == 0.5

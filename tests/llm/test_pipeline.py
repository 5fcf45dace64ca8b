import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from retailspark.llm import langid, quality
from retailspark.llm.common import stored

from .test_repeats import WORD, brute_components, brute_removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not Path(SF).exists():
        pytest.skip("test data not present")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "language", "near_duplicates", "substrings", "packing"]
    assert all(df.columns == stages[0].columns and df.dtypes == stages[0].dtypes for df in stages[:-1])


def test_classifier_stages_drop_what_they_reject(spark, stages):
    crc = lambda m: F.crc32(F.col("doc_id").cast("string").cast("binary")) % m
    model = quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), crc(5) != 0)
    good = {r.doc_id for r in quality.predictions(stages[0], model).collect() if r.predicted}
    assert set(rows(stages[1])) == good and 0 < len(good) < stages[0].count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)
    net = langid.fit(stages[1], crc(4) != 2)
    known = {r.doc_id for r in langid.identify(stages[1], net).collect() if r.lang_pred != "und" and r.score >= 0.3}
    assert set(rows(stages[2])) == known
    before, after = rows(stages[0]), rows(stages[2])
    assert all(before[d] == r for d, r in after.items())


def test_one_near_duplicate_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    keep = {c for _, _, c in brute_components([(d, r.text) for d, r in before.items()])}
    assert set(after) == keep and all(before[d] == r for d, r in after.items())


def test_repeated_passages_go(stages):
    before, after = rows(stages[3]), rows(stages[4])
    want = {d: (n, gone) for d, n, gone, _ in brute_removed([(d, r.text) for d, r in before.items()], 35)}
    assert set(after) == set(before)
    for d, r in after.items():
        n, gone = want[d]
        assert len(WORD.findall(r.text)) == n - gone and r.n_chars == len(r.text)
        assert (r.text == before[d].text) == (gone == 0)
        assert (r.lang, r.source) == (before[d].lang, before[d].source)


def test_the_corpus_is_packed(spark, stages):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = stages[5].collect()
    want = set()
    for d, r in rows(stages[4]).items():
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, len(ids)] if len(ids) <= 1024 else [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert {key(r) for r in got} == want and len(got) == len(want)
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 1024
    assert len(room) <= -(-sum(r.length for r in got) // 1024) * 1.03 + 2
    assert {key(r) for r in pipeline.run(spark, SF).collect()} == want


def test_empty_tables_and_nulls_pass(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    some = [(None, "the cat and the dog", "en", None, 5), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, "der hund und die katze", "de", "s", 1)]
    spark.createDataFrame(some * 2, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == [3, None]

"""The pipeline's stages on a small table with every awkward row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from shiftlens.llm import mixing, neardup, quality, secret_scan
from test_structure_operators import WORDS, brute_components, pick

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _kept int, _score double, component_id long, topic string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        text = pick(rng, WORDS, rng.randint(30, 90))
        bad = i % 5 == 0
        if bad:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    base = pick(rng, WORDS, 120)
    rows += [(300 + k, base + f" end{k}") for k in range(4)] + [(400, rows[1][1]), (1, rows[1][1])]
    rows += [(500, pick(rng, WORDS, 40) + ' token = "abcdefghijklmnop" ' + pick(rng, WORDS, 40))]
    rows += [(600, None), (601, ""), (None, pick(rng, WORDS, 50)), (None, pick(rng, WORDS, 50))]
    rows += [(700, pick(rng, WORDS, 60)), (700, pick(rng, WORDS, 60)), (700, rows[2][1])]  # one id, three texts
    full = [(i, t, "en", rng.choice(["s1", "s1", "s2", None]), None if t is None else len(t), 7, 0.5, -1, "t") for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_do_what_their_operators_say(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5 and names[1] == "near_dedup"
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        kept[name] = docs
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in kept.items()}
    # Quality: junk goes, clean rows stay, rows without an id included.
    after = ids["near_dedup"]
    assert not [i for i in after if i is not None and i < 160 and i % 5 == 0]
    assert {i for i in range(160) if i % 5} | {300, 301, 302, 303, 400, 500} <= set(after) and after.count(None) == 2
    # Near copies: one row of each group, as by brute force.
    keyed = sorted({(r.doc_id, r.text or "") for r in kept["near_dedup"].collect() if r.doc_id is not None})
    wanted = sorted(keyed[k][0] for k, (_, c) in brute_components({k: t for k, (_, t) in enumerate(keyed)}, 5, 80).items() if c == k)
    deduped = ids["secret_scanning"]
    assert sorted(i for i in deduped if i is not None) == wanted and len(deduped) == len(wanted) + 2
    assert wanted.count(700) == 2  # the third text under that id is a copy of another document's
    assert 400 not in deduped and 300 in deduped and 301 not in deduped
    # Secrets: replaced, lengths follow, other rows unchanged.
    before = {r.doc_id: r.text for r in kept["secret_scanning"].collect() if r.doc_id is not None}
    for r in kept["source_mixing"].collect():
        if r.doc_id in (None, 700):
            continue
        assert r.text == (before[r.doc_id] and secret_scan.redacted(before[r.doc_id], secret_scan.EntropyRules()))
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert "[assign]" in {r.doc_id: r.text for r in kept["source_mixing"].collect()}[500]
    # Mixing keeps the drawn rows.
    drawn = mixing.mix(kept["source_mixing"].select("doc_id", "text", "lang", "source", "topic")).where("_kept")
    assert sorted(map(str, ids["sequence_packing"])) == sorted(str(r.doc_id) for r in drawn.collect())
    # Packing holds every token of what was drawn.
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).where("doc_id <> 700")
    assert {700} | {r.doc_id for r in pieces.collect()} == {700} | {i for i in ids["sequence_packing"] if i is not None}
    assert pieces.where("n <> `all`").count() == 0


def test_empty_tables(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_parameters_of_the_stage():
    assert (C.NEAR.words, C.NEAR.percent) == (5, 80) and isinstance(C.NEAR, neardup.NearParams)
    assert C.ORACLE_SQL is None and quality.QualityParams().max_per_class == 2000

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.quality import COLUMNS, co_train, features, keep_good, labels_of, scores, word_columns

from .helpers import docs_frame
from .test_decontamination import brute as brute_leaks
from .test_simhash_dedup import brute_components, brute_simhash
from .test_substring_dedup import brute as brute_repeats

LABELS = "doc_id long, quality int, toxic int"
WORDS = ["the", "of", "and", *(f"v{i}" for i in range(300))]


def made(rng, n):
    texts, kinds = [], []
    for _ in range(n):
        kind = rng.choices(["good", "junk", "toxic"], [6, 2, 2])[0]
        ws = rng.choices(WORDS, k=rng.randint(30, 120))
        if kind == "junk":
            ws = [w.upper() + "!!" for w in ws] if rng.random() < 0.5 else [x for w in ws for x in (w, "|")]
        if kind == "toxic":
            for w in rng.sample(["idiot", "moron", "scum"], 2):
                ws[rng.randrange(len(ws))] = w
        texts.append(" ".join(ws) + "\nend.")
        kinds.append(kind)
    return texts, kinds


@pytest.fixture(scope="module")
def judged(spark):
    # a session that has observed metrics cannot be serialized with a model's tasks
    spark.range(3).observe(Observation("seen"), F.count("*").alias("n")).collect()
    texts, kinds = made(random.Random(5), 900)
    docs = docs_frame(spark, [*texts, None, "", texts[0]], [*range(900), 900, 901, None])
    labels = spark.createDataFrame([(i, int(kinds[i] != "junk"), int(kinds[i] == "toxic")) for i in range(450)], LABELS)
    return docs, labels, kinds, {r["doc_id"]: r for r in scores(docs, labels).collect()}


def test_held_out_accuracy(judged):
    _, _, kinds, got = judged
    assert len(got) == 903
    right = Counter((k, got[i]["keep"] == (k == "good")) for i, k in enumerate(kinds) if i >= 450)
    for kind, least in (("good", 0.97), ("junk", 0.97), ("toxic", 0.85)):
        assert right[kind, True] >= least * (right[kind, True] + right[kind, False]), right
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("text_score", "page_score", "score"))
    # calibrated: the mean score of unlabelled rows is near their share of good ones
    rest = [i for i in range(450, 900)]
    assert abs(np.mean([got[i]["score"] for i in rest]) - np.mean([kinds[i] == "good" for i in rest])) < 0.06
    assert abs(got[None]["score"] - got[0]["score"]) < 1e-9


def test_keep_good_passes_rows_through(spark, judged):
    docs, labels, _, got = judged
    wide = docs.selectExpr("*", "1 as text_score", "'x' as terms", "2 as extra_0", "3 as chars")
    kept = keep_good(wide, labels)
    assert kept.columns == wide.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows == {i: t for i, t in before.items() if got[i]["score"] >= 0.5}


def test_no_word_is_cut_for_being_rarer_than_others(spark):
    common = " ".join(f"w{i}" for i in range(9000))
    docs = docs_frame(spark, [common] * 8 + ["telling"] * 5 + ["Seldom, seldom."] * 4)
    got = {r["doc_id"]: np.frombuffer(r["columns"], "<u4") for r in features(docs).collect()}
    assert len(got[0]) > 8800 and len(got[8]) == 1 == len(got[16]) and max(got[0]) < COLUMNS


def test_the_whole_corpus_is_judged_each_round(spark):
    """A word that only unlabelled rows have is learnt from the page view's sure judgements."""
    rng = random.Random(9)
    rows = [(" ".join(rng.choices(WORDS, k=60)), 1) for _ in range(300)] + [(" | ".join(rng.choices(WORDS, k=60)).upper(), 0) for _ in range(300)]
    texts = [t if i % 2 == 0 or good else t + " spamword" for i, (t, good) in enumerate(rows)]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, good, 0) for i, (_, good) in enumerate(rows) if i % 2 == 0], LABELS)
    (_, _, column), plain = word_columns("spamword"), co_train(docs, labels, rounds=0)
    assert plain.words[column[0]] == 0 and co_train(docs, labels, rounds=2).words[column[0]] < -2


def test_ties_repeats_and_a_very_long_text(spark):
    rng = random.Random(10)
    good, bad = " ".join(rng.choices(WORDS, k=80)), " | ".join(WORDS[:60]).upper()
    long = " ".join(rng.choices(WORDS, k=400_000))
    docs = docs_frame(spark, [good] * 30 + [bad] * 30 + [long, long + " |" * 400_000], [*range(60), 60, 60])
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(0, 60, 2)], LABELS)
    got = scores(docs, labels).collect()
    assert len(got) == 62 and len({r["score"] for r in got if r["doc_id"] < 30}) == 1


def test_labels_of_one_kind_nulls_and_empty(spark):
    docs = docs_frame(spark, ["a b", "c", None])
    one = spark.createDataFrame([(0, 1, 0), (0, 1, None), (1, None, 1), (None, 0, 0)], LABELS)
    assert [tuple(r) for r in labels_of(one).collect()] == [(0, 1.0)]
    assert {r["score"] for r in scores(docs, one).collect()} == {1.0}
    assert {r["score"] for r in scores(docs, one.limit(0)).collect()} == {1.0}
    bad = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], LABELS)
    assert {r["keep"] for r in scores(docs, bad).collect()} == {False}
    assert scores(docs_frame(spark, []), one).collect() == [] == keep_good(docs_frame(spark, []), one).collect()


def test_few_labels_of_a_kind_are_still_learnt(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=60)) for _ in range(60)] + [" | ".join(rng.choices(WORDS, k=60)).upper() for _ in range(60)]
    docs = docs_frame(spark, texts)
    held = {r["id"] for r in spark.range(60, 120).filter("pmod(xxhash64(id, 3), 4) = 0").collect()}
    fitted = sorted(set(range(60, 120)) - held)
    for bad in (fitted[:2], sorted(held)[:2], fitted[:1]):  # none held out, none fitted, one row only
        labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in bad], LABELS)
        got = {r["doc_id"]: r["score"] for r in scores(docs, labels, rounds=0).collect()}
        assert len(set(got.values())) > 1
        assert np.mean([got[i] for i in range(60)]) > np.mean([got[i] for i in range(60, 120)])


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(70))
    items = [(i, " ".join(rng.choices(WORDS, k=20))) for i in range(5)]
    texts, kinds = made(rng, 240)
    for i in range(0, 240, 9):
        texts[i] = f"{texts[i]}\n{passage}\n" + " ".join(rng.choices(WORDS, k=20))
    for i in range(4, 240, 30):
        texts[i] = f"{texts[i]} {items[i % 5][1]} tail"
    texts += texts[:30] + [passage, None, ""]
    docs_frame(spark, texts, extra="doc_id as extra").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(kinds[i] != "junk"), int(kinds[i] == "toxic")) for i in range(200)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/out{k}"
        before = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
        step(spark, docs, str(tmp_path)).write.parquet(out)
        columns, docs = docs.columns, spark.read.parquet(out)
        rows = docs.collect()
        if name != "packed":
            assert docs.columns == columns and all(r["extra"] == r["doc_id"] for r in rows)
            after = {r["doc_id"]: r["text"] for r in rows}
            seen[name] = len(after)
        if name == "quality":
            assert {i for i in after if i < 240 and kinds[i] == "good"} >= {i for i in range(200) if kinds[i] == "good"} - {i for i in range(200) if i % 4 == 0}
            assert sum(kinds[i % 240] == "good" for i in after if i < 270) >= 0.9 * len([i for i in after if i < 270])
        elif name == "near_duplicates":
            prints = [(i, brute_simhash(t)) for i, t in before]
            assert set(after) == set(brute_components(prints)) and all(after[i] == t for i, t in before if i in after)
        elif name == "repeated_passages":
            want = {i: n - gone for i, n, gone, _ in brute_repeats(before, 50) if not gone or gone < n}
            assert {i: len((t or "").split()) for i, t in after.items()} == want
            assert sum("p69" in (t or "") for t in after.values()) <= 1
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        elif name == "decontaminated":
            hit = {before[d][0] for d, _ in brute_leaks([t for _, t in before], items)}
            assert hit and set(after) == {i for i, _ in before} - hit
        else:
            assert {r["doc_id"] for r in rows} == {i for i, _ in before}
    assert seen["quality"] > seen["near_duplicates"] >= seen["repeated_passages"] > seen["decontaminated"] > 50


def test_pipeline_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert all(any(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) for n in range(1, 14))


def test_pipeline_run_on_small_tables(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    per = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert per <= 2048 and rows.count() > 50

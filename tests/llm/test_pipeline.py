"""The pipeline's stages on the small tables: what each must catch, and what it must leave alone."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simgraph.llm import decontam, repeats, resample, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert k == len(corpus_pipeline.STAGES) - 1 or after.columns == columns
        n = after.count()
        assert 0.7 * before < n <= before and after.select("doc_id").distinct().count() == n
        if name == "near_duplicates":
            assert simhash.near_groups(after).where("doc_id <> component_id").isEmpty()
        if name == "repeated_strings":
            assert n == before
            left = repeats.remove_repeats(after).where("n_removed > 0").count()
            assert left <= repeats.remove_repeats(docs).where("n_removed > 0").count()
        if name == "decontaminated":
            assert decontam.judge(after, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").isEmpty()
        if name == "encoded":
            assert after.where("not round_trip").isEmpty()
        docs, before = after, n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_encoded_takes_one_python_pass(spark):
    """Two passes need two workers for each task, and those of an executor stay."""
    done = corpus_pipeline.encoded(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert done.count() and done.where("not round_trip").isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_run_takes_no_rows(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "web", None if t is None else len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_keep_one_row_of_each_group(spark):
    """Copies under one id, under null, with and without other columns alike."""
    a, b, c, d = (words(k, 60) for k in range(4))
    rows = [(None, a, "en"), (None, a, "en"), (None, a, "de"), (7, b, "en"), (7, b, "en"), (7, c, "en"), (7, c, "de"), (9, c, "en"), (None, d, "en"), (3, d, "en"), (None, None, "en"), (None, "", "en"), (7, " ", "en")]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    assert Counter((r.doc_id, (r.text or "").strip()) for r in got) == Counter([(None, a), (7, b), (7, c), (3, d), (7, "")])
    assert all((r.doc_id, r.text, r.lang) in rows for r in got)


def brute_repeats(rows, length):
    seen = Counter(b[k : k + length] for _, t, _ in rows for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    for i, t, x in rows:
        b = (t or "").encode()
        gone = {k + j for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1 for j in range(length)}
        at, left = 0, []
        for c in t or "":
            size = len(c.encode())
            if gone.isdisjoint(range(at, at + size)):
                left.append(c)
            at += size
        new = None if t is None else "".join(left)
        yield i, new, x, None if t is None else len(new)


def test_repeated_strings_match_brute_force(spark):
    """Rows that share an id or have none lose their own bytes only, and stay as many as they were."""
    same = words(9, 40)
    rows = [(i, f"{words(10 + k, 8)} {same} {words(30 + k, 8)}", f"l{k}") for k, i in enumerate([None, None, None, 4, 4, 5])]
    rows += [(6, words(50, 60), "x"), (6, words(50, 60), "y"), (None, None, "x"), (None, "", "x"), (4, "short", "x"), (4, "short", "y")]
    got = corpus_pipeline.repeated_strings(spark, frame(spark, rows), "").collect()
    assert Counter((r.doc_id, r.text, r.lang, r.n_chars) for r in got) == Counter(brute_repeats(rows, corpus_pipeline.REPEATED))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_rows_are_judged_by_themselves(spark):
    """With half of the ids null and the others shared by two, each row has its own verdict."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared = docs.withColumn("doc_id", F.when(F.col("doc_id") % 4 < 2, F.col("doc_id") - F.col("doc_id") % 4))
    judged = resample.resample(shared, spark.read.parquet(f"{SF}/labels.parquet"))
    assert not judged.where("not kept").isEmpty()
    assert corpus_pipeline.quality(spark, shared, SF).count() == judged.where("kept").count()
    want = decontam.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    got = corpus_pipeline.decontaminated(spark, shared, SF)
    assert 0 < want.count() < docs.count()
    assert Counter(r.text for r in got.select("text").collect()) == Counter(r.text for r in want.select("text").collect())
    ids = corpus_pipeline.encoded(spark, shared, SF)
    assert ids.count() == docs.count() and ids.where("not round_trip").isEmpty()


def test_repeated_strings_keep_replacement_characters(spark):
    """U+FFFD of the input stays where no repeated string covers it; code points cut at either end go whole."""
    same = words(60, 40)
    rows = [(1, f"a\ufffdb é{same}\u00e9 c\ufffd", "x"), (2, f"{words(61, 3)} \u00e9{same}\u00e8 \ufffd", "x"), (3, f"\u00f6\u0129{same}\u00eb", "x")]
    got = corpus_pipeline.repeated_strings(spark, frame(spark, rows), "").collect()
    assert all("\ufffd" in r.text for r in got if r.doc_id < 3)
    assert Counter((r.doc_id, r.text, r.lang, r.n_chars) for r in got) == Counter(brute_repeats(rows, corpus_pipeline.REPEATED))

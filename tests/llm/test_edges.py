"""Every operator on empty tables, nulls, repeats, ties and clashing columns; every query alone in a session of its own."""

import os
import subprocess
import sys
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from simgraph.llm import bpe, chat, decontam, mlm, queries, repeats, resample, ring, rules, simhash, urls

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Columns that operators use for themselves.
CLASH = ["uid", "check", "h", "z", "spans", "fp", "root", "cell", "shard", "kept", "ids", "_text", "_key", "_h", "chunk", "rank"]
TEXT = "one two three four five six seven eight nine ten " * 5
ROWS = [(1, TEXT), (1, TEXT), (2, None), (None, TEXT), (None, None), (3, ""), (4, " \n\t "), (5, "é漢😀 " * 40_000), (None, "alone here")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * len(CLASH)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH))


def runs(spark):
    """Each operator on documents, by name: a function of the table that returns a row for each of its rows."""
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(7, "two three four five six seven"), (8, None), (9, "")], "item_id long, text string")
    return {
        "decontaminate": lambda d: decontam.judge(d, items),
        "repeats": lambda d: repeats.remove_repeats(d),
        "resample": lambda d: resample.resample(d, labels),
        "rules": lambda d: rules.judge(d, rules.fit(*([r[k] for r in rules.labelled_sample(d, labels, "quality", 10)] for k in (1, 2)))),
        "ring": lambda d: ring.bounded_ring(d, 4),
        "encode": lambda d: bpe.decode(bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH),
        "simhash": lambda d: simhash.near_groups(d),
        "score": lambda d: mlm.score(d, mlm.train(d)),
    }


@pytest.mark.parametrize("name", ["decontaminate", "repeats", "resample", "rules", "ring", "encode", "simhash", "score"])
def test_documents(spark, name):
    run = runs(spark)[name]
    got = run(documents(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    assert run(documents(spark, [])).count() == 0
    assert run(documents(spark, [(None, None)] * 5)).count() == 5


def test_ties_and_repeats_have_one_result(spark):
    both = documents(spark, ROWS), documents(spark, ROWS[::-1]).repartition(3)
    for name in ("decontaminate", "repeats", "rules", "ring", "simhash"):
        run = runs(spark)[name]
        a, b = (Counter(str(tuple(r)) for r in run(d).collect()) for d in both)
        assert a == b, name


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, path string, rule string, keys string, h1 long"
    rows = [(1, "http://example.com/en/a"), (1, "http://example.com/en/a"), (None, "x://b.net/es/"), (None, None), (2, ""), (3, "://"), (4, "http://" + "a." * 5000 + "com/" + "x" * 100_000)]
    pages = spark.createDataFrame([(i, u, "<p>", "clash", "clash", "clash", "clash", 1) for i, u in rows], schema)
    got = urls.url_verdicts(pages, queries.URL_RULES).collect()
    assert Counter((r.page_id, r.verdict) for r in got) == Counter([(1, "block"), (1, "block"), (None, "block"), (None, "allow"), (2, "allow"), (3, "allow"), (4, "allow")])
    assert {r.rule for r in got if r.page_id == 4} == {"com/"}
    assert urls.url_verdicts(pages.limit(0), queries.URL_RULES).count() == 0


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, part int, speaker string, told string, masks string"
    rows = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (1, None, None, None), (None, None, None, None), (None, None, None, None), (2, 1, "ann", ""), (2, 1, "bob", "é" * 100_000)]
    frame = spark.createDataFrame([(*r, 9, "clash", "clash", "clash") for r in rows], schema)
    got = {(r.conv_id, r.speaker): r for r in chat.perspectives(frame).collect()}
    assert {k: r.n_messages for k, r in got.items()} == {(1, "ann"): 3, (1, "unknown"): 3, (None, "unknown"): 2, (2, "ann"): 2, (2, "bob"): 2}
    for r in got.values():
        for m in r.masks:
            assert r.rendered[:m.start].endswith("<|assistant|>\n") and r.rendered[m.end] == "\n"
    assert chat.perspectives(frame.limit(0)).count() == 0


def test_pipeline_keeps_rows_apart(spark):
    """Rows with ids 1, 1, 2, null, null, 7, 7 and texts of their own, but for the last two, which are one row twice: six stay."""
    import random

    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    shared = words(40)
    texts = [f"{words(60)} {shared} {words(60)}" for _ in range(6)]
    rows = list(zip([1, 1, 2, None, None, 7, 7], [*texts, texts[5]], strict=True))
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.near_duplicates(spark, docs, "")
    assert Counter(r.doc_id for r in docs.collect()) == Counter([1, 1, 2, None, None, 7])
    docs = corpus_pipeline.repeated_strings(spark, docs, "")
    got = docs.collect()
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))  # the passage, and what some texts have next to it alike by chance
    gone = [{k + j for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for j in range(200)} for t in texts]
    assert all(len(shared) <= len(x) < len(shared) + 10 for x in gone)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, "".join(c for k, c in enumerate(t) if k not in x)) for (i, t), x in zip(rows[:6], gone, strict=True))
    items = spark.createDataFrame([(1, texts[3][:300])], "item_id long, text string")
    left = decontam.clean(docs, items)
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 1, 2, None, 7])
    assert corpus_pipeline.encoded(spark, docs, "").where("round_trip").count() == 6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_alone_in_a_fresh_session(name, tmp_path):
    """As the first query of a session that was started elsewhere, with nothing on PYTHONPATH."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()[{name!r}](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-3000:]

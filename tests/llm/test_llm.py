"""Training-data operators against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from simgraph.llm import bpe, chat, decontam, mlm, repeats, resample, ring, rules, simhash, urls
from simgraph.llm.arrowtext import text_bytes
from simgraph.llm.components import components
from simgraph.llm.suffix import COVER, PERIOD, repeated_windows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "no id"), (5, "é漢😀 " * 3000), (6, "a" * 5000)]
SCHEMA = "doc_id long, text string, uid string, h string, _text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def words(rng, n, size=40):
    return " ".join("w" + str(rng.randrange(size)) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 120), 200) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " tail", texts[7][:300] + words(rng, 20), "ab" * 400, texts[9][:250] + texts[11][:260]]
    return list(enumerate(texts)) + [(None, texts[0]), (100, None), (101, "")]


def test_labelled_sample_is_bounded(spark):
    rows = docs(spark, [(i, "x" * 100) for i in range(50)] + [(3, "y" * 100), (None, "z"), (60, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)] + [(4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    got = rules.labelled_sample(rows, labels, "quality", 4000)
    assert len(got) == 51 and len({r[0] for r in got}) == 51 and (60, "", 0) in got and (4, "x" * 100, 0) in got
    some = rules.labelled_sample(rows, labels, "quality", 4000, most_bytes=1000)
    assert len(some) in (10, 11) and set(some) <= set(got)
    assert rules.labelled_sample(rows, labels.limit(0), "quality", 4000) == []


@pytest.mark.parametrize("shared", [2, 3, 4])
def test_links_on_any_number_of_blocks(spark, monkeypatch, shared):
    rng = np.random.default_rng(shared)
    base = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    words_ = np.unique(np.concatenate([base, *(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 4)).astype(np.uint64), axis=1) for _ in range(4))]))
    monkeypatch.setattr(simhash, "shared_blocks", lambda n, radius: shared)
    got = {tuple(r) for r in components(simhash.links(spark.createDataFrame([(int(x),) for x in words_.view(np.int64)], "fp long"))).collect()}
    near = np.argwhere(np.bitwise_count(words_[:, None] ^ words_[None, :]) <= 4)
    edges = spark.createDataFrame([(int(words_.view(np.int64)[a]), int(words_.view(np.int64)[b])) for a, b in near if a < b], "a long, b long")
    assert got == {tuple(r) for r in components(edges).collect()}


def test_shared_blocks_grow():
    assert [simhash.shared_blocks(n, 4) for n in (0, 10**6, 10**9, 4 * 10**10, 10**12, 10**15)] == [2, 2, 2, 3, 4, 5]


def test_simhash_matches_brute_force(spark):
    rows = corpus() + [(200 + i, " ".join(["shared"] * 30 + [f"x{i}"])) for i in range(8)]
    rows = [r for r in rows if r[0] is not None]

    def fingerprint(text):
        parts = (text or "").encode().lower().split()
        runs = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)

    fps = {i: fingerprint(t) for i, t in rows}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert got == {i: (fps[i], comp[i]) for i in fps}


def test_bk_forest_and_hot_keys(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    near = np.unique(np.concatenate([base, *(base[:5] ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(b // 2)) for b in range(0, 60, 3))]))
    forest = simhash.BKForest(near, np.zeros(len(near), np.int64))
    asked, node = forest.within(near, forest.root, 4)
    assert len(asked) == (np.bitwise_count(near[:, None] ^ near[None, :]) <= 4).sum()
    fps = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    want = {tuple(r) for r in components(simhash.links(fps)).collect()}
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert {tuple(r) for r in components(simhash.links(fps)).collect()} == want


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 60: 60, 61: 60}


@pytest.mark.parametrize("hot", [2048, 2])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", 2 if hot == 2 else 1024)
    rows = corpus(4) + [(300, "z" * 900), (5, corpus(4)[5][1])]
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_windows():
    """Strings longer than the usual depth of ranks."""
    rng = np.random.default_rng(3)
    for length in (300, 400, 600):
        for _ in range(6):
            text = rng.integers(97, 99, 3000).astype(np.uint8)
            for _ in range(4):
                a, b = rng.integers(0, 2000, 2)
                n = int(rng.integers(length - 2, 900))
                text[b : b + n] = text[a : a + n]
            at = np.arange(len(text) - length + 1)
            raw = text.tobytes()
            seen = Counter(raw[i : i + length] for i in at)
            assert repeated_windows(text, at, np.zeros(len(at), np.int64), length).tolist() == [seen[raw[i : i + length]] > 1 for i in at]


def test_repeats_take_any_ids(spark):
    same = "the same passage of two hundred bytes or more, " * 6
    rows = [("a", 1.5, same), ("b", None, same + "x"), (None, 2.5, "short")]
    for kind in ("s", "d"):
        got = repeats.remove_repeats(spark.createDataFrame(rows, "s string, d double, text string"), id_col=kind).collect()
        assert sorted(r.n_removed > 0 for r in got) == [False, True, True] and len({r[kind] for r in got}) == 3


def test_suffix_order_of_repetitive_texts():
    assert all(any((a - b) % PERIOD == d for a in COVER for b in COVER) for d in range(PERIOD))
    rng = np.random.default_rng(0)
    for trial in range(40):
        n, letters, length = int(rng.integers(40, 600)), int(rng.integers(1, 4)), int(rng.choice([16, 17, 40]))
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        at = np.arange(n - length + 1)
        group = rng.integers(0, 2, len(at)) if trial % 2 else np.zeros(len(at), np.int64)
        b = text.tobytes()
        seen = Counter((g, b[i : i + length]) for i, g in zip(at, group))
        assert repeated_windows(text, at, group, length).tolist() == [seen[g, b[i : i + length]] > 1 for i, g in zip(at, group)]


def test_bpe_matches_tiktoken(spark):
    ranks = bpe.Ranks(PATH)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    rng = random.Random(5)
    rows = EDGE + [(10 + i, "".join(rng.choice("ab \n\t\x1c é漢😀'12s!Z") for _ in range(rng.randrange(200)))) for i in range(150)] + [(200, "<|endoftext|>"), (201, "x" * 9000)]
    ids = bpe.encode(docs(spark, rows), PATH, public_tokenizers.PATTERN)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.decode(ids, PATH).collect()]
    want = [(i, known.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for piece in (b"hello", b"aaaaaaaaaaaa", b"\xff\xfe\x00", b"x" * 300):
        assert ranks.ids(piece) == known._encode_single_piece(piece)


def test_rules_match_brute_force(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randrange(0, 80), 6) + rng.choice(["", "\nab\nab\n\n ab", " #*", "\x0b|<"]) for _ in range(80)] + [t for _, t in EDGE]
    c = rules.measure(*text_bytes(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))
        assert (c.n_words[k], c.word_chars[k], c.n_symbols[k], c.n_dup_lines[k], c.n_repeat_words[k]) == want
    # Thue-Morse texts collide under any polynomial hash modulo a power of two; bytes decide.
    thue = lambda a, b, n: "".join(b if k.bit_count() % 2 else a for k in range(n))
    pair = thue("a", "b", 2048), thue("b", "a", 2048)
    eight = lambda w: " ".join([w] * 8)
    c2 = rules.measure(*text_bytes(pa.array(["\n".join(pair), eight(pair[0]) + " x " + eight(pair[1]), "\n".join([pair[0], pair[0], pair[1]])])))
    assert c2.n_dup_lines.tolist() == [0, 0, 1] and c2.n_repeat_words.tolist() == [0, 0, 0]
    good = [words(rng, 60, 50) for _ in range(60)]
    bad = [" ".join(x + "###" for x in words(rng, 60, 50).split()) for _ in range(60)]
    model = rules.fit(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    judged = {r.doc_id: r for r in rules.judge(docs(spark, list(enumerate(good[40:] + bad[40:])) + [(99, None)]), model).collect()}
    assert sum(judged[i].quality > 0.5 for i in range(20)) >= 19 and sum(judged[i].quality < 0.5 for i in range(20, 40)) >= 19
    assert judged[99].base_failed and not judged[99].kept
    assert rules.fit([], []).probability(c, len(texts)).shape == (len(texts),)


def test_resampling(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, 60, 50)) for i in range(60)] + [(100 + i, " ".join(x + "###" for x in words(rng, 60, 50).split())) for i in range(30)] + [(None, None), (200, "")]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(i, 0) for i in range(100, 110)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scored = resample.resample(docs(spark, rows), labels).collect()
    good = sum(c in (1,) for c in [1] * 30 + [0] * 10) / 40
    assert len(scored) == len(rows) and sum(r.kept for r in scored) == round(len(rows) * good)
    least = min(r.score for r in scored if r.kept)
    assert all(r.kept == (r.score >= least) for r in scored)
    assert min(r.score for r in scored if (r.doc_id or 99) < 60) > max(r.score for r in scored if 100 <= (r.doc_id or 0) < 130)
    part = resample.resample(docs(spark, rows), labels, share=0.5).collect()
    assert sum(r.kept for r in part) == round(len(rows) * good / 2) and all((r.doc_id or 0) < 60 for r in part if r.kept)
    assert sum(r.kept for r in resample.resample(docs(spark, rows), labels, k=10).collect()) == 10
    assert sum(r.kept for r in resample.resample(docs(spark, [(5, "x y z")] * 7), labels, k=1).collect()) == 7
    values = spark.createDataFrame([(float(x % 50),) for x in range(6000)], "s double")
    assert resample.kth_largest(values, "s", 121) == 48.0
    assert resample.resample(docs(spark, []), labels).count() == 0
    assert [r.kept for r in resample.resample(docs(spark, [(1, None), (2, "")]), labels).collect()] == [True, True]


def test_gumbel_top_k_draws_by_weight(spark):
    """Over many seeds the top two of four are drawn as without replacement, in proportion to their weights."""
    from pyspark.sql import functions as F

    weights = [0.5, 0.3, 0.15, 0.05]
    rows = spark.createDataFrame([(s, i, float(np.log(w))) for s in range(4000) for i, w in enumerate(weights)], "seed long, i long, w double")
    scores = rows.withColumn("score", F.col("w") + resample.gumbel(F.col("seed"), F.col("i"))).toPandas()
    top = scores.sort_values("score", ascending=False).groupby("seed").head(2)
    share = top.groupby("i").size() / 4000
    for i, w in enumerate(weights):
        want = w + sum(v * w / (1 - v) for j, v in enumerate(weights) if j != i)
        assert abs(share[i] - want) < 0.03


def test_log_ratio_matches_brute_force():
    rng = np.random.default_rng(4)
    target, raw = rng.integers(0, 50, 3 * resample.BUCKETS), rng.integers(0, 90, 3 * resample.BUCKETS)
    got = resample.log_ratio(target, raw)
    for at in (0, 7, resample.BUCKETS, 3 * resample.BUCKETS - 1):
        k = at // resample.BUCKETS
        part = slice(k * resample.BUCKETS, (k + 1) * resample.BUCKETS)
        want = np.log((target[at] + resample.SMOOTH) / (raw[at] * (target[part].sum() / raw[part].sum()) + resample.SMOOTH))
        assert abs(got[at] - want) < 1e-12


def test_decontamination(spark):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    question = "Alice bought 12 apples and 30 pears in Paris, then Alice walked 5 km to Berlin and sold 12 of her apples for 9 euros."
    items = spark.createDataFrame([(1, question), (2, say(30)), (3, None), (4, "")], "item_id long, text string")
    renamed = question.replace("Alice", "Zelda").replace("12", "77").replace("Paris", "Oslo").replace("5 km", "8 miles")
    mixed = question.replace("12 apples", "77 apples")
    rows = [(1, "Some text. " + question + " More."), (2, "Then came this. " + renamed), (3, say(300)), (4, say(20) + ". " + question.upper()), (5, "Well. " + mixed), *EDGE[:3], EDGE[5]]
    got = Counter((r.doc_id, r.contaminated) for r in decontam.judge(docs(spark, rows), items).collect())
    # rows 1 and 2 hold the question; the other rows with their ids are null and empty, and are judged by themselves
    assert got == Counter([(1, True), (2, True), (3, False), (4, False), (5, False), (1, False), (2, False), (3, False), (None, False)])
    left = decontam.clean(docs(spark, rows), items).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter(rows[2:])
    assert Counter(tuple(r)[:2] for r in decontam.contaminated_by(docs(spark, rows), items).collect()) == Counter([(1, 1), (2, 1)])
    assert decontam.judge(docs(spark, []), items).count() == 0
    assert not any(r.contaminated for r in decontam.judge(docs(spark, rows), items.limit(0)).collect())


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|assistant|>"), (1, 2, "bob", "yo"), (1, 3, None, None), (1, 2, "bob", "yo"), (None, 0, "ann", "alone"), (2, 0, "system", "only"), (3, 5000, "ann", "late"), (3, None, "ann", "early")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, part int")
    got = {(r.conv_id, r.part, r.speaker): r for r in chat.perspectives(frame).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, 0, "unknown"), (None, 0, "ann"), (3, 0, "ann")}
    bob = got[1, 0, "bob"]
    assert bob.rendered == "<|system|>\nbe kind\n<|user name=ann|>\nhi < |assistant|>\n<|assistant|>\nyo\n<|assistant|>\nyo\n<|user name=unknown|>\n\n"
    assert [bob.rendered[m.start : m.end] for m in bob.masks] == ["yo", "yo"]
    assert [got[1, 0, "ann"].rendered[m.start : m.end] for m in got[1, 0, "ann"].masks] == ["hi < |assistant|>"]
    assert got[3, 0, "ann"].rendered == "<|assistant|>\nearly\n<|assistant|>\nlate\n"
    parts = {(r.conv_id, r.part, r.speaker): r for r in chat.perspectives(frame, part=2).collect()}
    assert set(parts) == {(1, p, x) for p in range(3) for x in ("ann", "bob", "unknown")} | {(None, 0, "ann"), (3, 0, "ann")}
    for who in ("ann", "bob", "unknown"):
        assert "".join(parts[1, p, who].rendered for p in range(3)) == got[1, 0, who].rendered
        assert sum((list(parts[1, p, who].masks) != []) * sum(m.end - m.start for m in parts[1, p, who].masks) for p in range(3)) == sum(m.end - m.start for m in got[1, 0, who].masks)
    assert chat.perspectives(frame.limit(0)).count() == 0


def brute_ring(rows, shards, slack=0.0):
    """Row by row: each walks clockwise from its place; homes first, the rest in ring order from where they overflow."""
    import zlib

    spark_hash = {k: h for k, h in rows["hash"].items()}
    order = sorted((spark_hash[i, t] % (1 << 64), i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16, n) for n, (i, t) in enumerate(rows["rows"]))
    nodes = ring.ring_nodes(shards)
    room = ring.capacities(len(order), shards, slack)
    cells = [c for c, _ in nodes]
    home = lambda h: next((k for k, c in enumerate(cells) if c >= h >> (64 - ring.CELL_BITS)), 0)
    out, late = {}, {}
    for row in order:
        at = home(row[0])
        if room[nodes[at][1]]:
            room[nodes[at][1]] -= 1
            out[row[-1]] = nodes[at][1]
        else:
            late.setdefault(at, []).append(row)
    queue = []
    while late or queue:
        for at, (_, shard) in enumerate(nodes):
            queue += late.pop(at, [])
            while queue and room[shard]:
                room[shard] -= 1
                out[queue.pop(0)[-1]] = shard
    return Counter((*rows["rows"][n], s) for n, s in out.items())


def test_ring(spark, monkeypatch):
    import zlib

    from pyspark.sql import functions as F

    monkeypatch.setattr(ring, "CHUNK", 7)
    rows = [(i, "t" * (i % 7)) for i in range(500)] + EDGE + [(77, "same")] * 40 + [(None, None)] * 30
    given = docs(spark, rows)
    found = ring.bounded_ring(given, 8).collect()
    count = Counter(r.shard for r in found)
    assert len(found) == len(rows) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(count[s]))
    digest = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, *digest(t)) for i, t in rows)
    body = F.coalesce("text", F.lit(""))
    hashes = {(r.doc_id, r.text): r.h for r in given.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), body))).alias("h")).collect()}
    want = brute_ring({"rows": rows, "hash": hashes}, 8)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in found) == Counter({(i, *digest(t), s): n for (i, t, s), n in want.items()})
    again = ring.bounded_ring(given.repartition(3), 8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert ring.bounded_ring(docs(spark, []), 8).count() == 0
    home = lambda n: {r.doc_id: r.shard for r in ring.bounded_ring(docs(spark, rows[:500]), n, slack=0.25).collect()}
    old, new = home(20), home(21)
    assert sum(old[i] != new[i] for i in old) < 0.25 * len(old)


def test_urls(spark):
    rules_ = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    pages = ["http://a.example.com/en/x?y", "https://www.Example.COM/en/#z", "x://net/es/", "x://sub.net/es/a", "x://net/esp", "x://notexample.com/en/", "no scheme", None, "x://com", "x://com?/en/", "x://a..net/es/q", "://", "x:///en/"]

    def judge(u):
        rest = u[u.find("://") + 3 :] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, a) for a, h, p in rules_ if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *((max(fit)[1], max(fit)[2]) if fit else (None, "allow"))

    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in urls.url_verdicts(df, rules_).collect()}
    assert got == {i: judge(u) for i, u in enumerate(pages)}
    assert urls.url_verdicts(df, []).where("verdict = 'allow'").count() == len(pages)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    listed = keys.where("int(substring(key, 2, 9)) % 7 = 0")
    cascade = urls.build_cascade(keys, listed)
    hashed = urls._hashed(keys).collect()
    h = [np.array([r[k] for r in hashed], np.int64).view(np.uint64) for k in ("h1", "h2")]
    assert cascade.member(*h).tolist() == [int(r.key[1:]) % 7 == 0 for r in hashed]


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.standard_normal(n) * 0.3 for n in mlm._SIZES])
    none = np.zeros(0, np.uint64)
    tails = np.arange(mlm.HEADS, mlm.VOCAB)
    return mlm.Model(flat, none, np.zeros(0, np.int64), tails, none, np.zeros(0, np.float32), np.full(mlm.VOCAB, -2.5, np.float32), np.full(mlm.VOCAB, 1 / mlm.VOCAB), 1000)


def test_network_gradients():
    """All seven groups of weights, against differences of the loss."""
    rng = np.random.default_rng(1)
    net = mlm.unflatten(small_model().flat)
    ids, owner, at = rng.integers(0, mlm.VOCAB, 40), np.repeat([0, 1], 20), np.arange(1, 40, 3)
    for name, (rows, g) in mlm.Pass(net, ids, owner, at).gradients().items():
        full = np.zeros_like(net[name])
        full[slice(None) if rows is None else rows] = g
        for place in (np.unravel_index(np.abs(full).argmax(), full.shape), np.unravel_index(np.abs(full).argmin(), full.shape)):
            ends = []
            for step in (1e-4, -2e-4):
                net[name][place] += step
                ends.append(-mlm.Pass(net, ids, owner, at).log_prob.mean())
            net[name][place] += 1e-4
            assert abs(full[place] - (ends[0] - ends[1]) / 2e-4) < 1e-6, name


def test_pseudo_likelihood(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    after = {w: rng.sample(vocab, 2) for w in vocab[:60]}

    def chain(n):
        out = [vocab[0]]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]])) if out[-1] in after else out.append(rng.choice(vocab[:60]))
        return " ".join(out)

    rows = [(i, chain(200)) for i in range(500)]
    model = mlm.train(docs(spark, rows))
    assert model.tokens == 100_000 and abs(model.shares.sum() - 1) < 1e-6
    held = [t for t in (chain(200) for _ in range(40))]
    data, off = text_bytes(pa.array(held))
    net = mlm.unflatten(model.flat)
    each, word, owner = mlm.net_log_probs(net, model, data, off)
    _, tail, _ = mlm._hashed(data, off)
    cls = model.classes(word, tail)
    plain = np.log(model.shares[cls]) + model.in_class(word, cls)
    assert each.mean() > plain.mean() + 0.5  # nats a word that the context is worth on texts never seen
    for p in (0, 17, 99):  # what the network gives to all classes at a place is one
        total = 0.0
        for c in range(mlm.VOCAB):
            ids = cls.copy()
            ids[p] = c
            total += np.exp(mlm.Pass(net, ids[:200], owner[:200], np.array([p])).log_prob[0])
        assert abs(total - 1) < 1e-3
    again = mlm.train(docs(spark, rows).repartition(7))
    assert np.abs(again.flat - model.flat).max() < 1e-4 and (again.listed == model.listed).all()
    got = {r.doc_id: r for r in mlm.score(docs(spark, EDGE), mlm.train(docs(spark, EDGE))).collect()}
    assert got[1].n_tokens == 0 and got[1].mean_log_prob is None and got[5].n_tokens == 3000 and len(got) == len({i for i, _ in EDGE})
    empty = docs(spark, [])
    assert mlm.score(empty, mlm.train(empty)).count() == 0


def test_repeated_documents_score_apart(spark):
    """Texts of rare words that occur twice, and the same number that occur once."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(3)) for _ in range(80))
    rows = [(i, text()) for i in range(120)]
    rows += [(1000 + i, t) for i, t in rows[:30]]
    got = {r.doc_id: r.mean_log_prob for r in mlm.score(docs(spark, rows), mlm.train(docs(spark, rows))).collect()}
    assert min(got[i] for i in range(30)) > max(got[i] for i in range(30, 120)) + 1


def test_network_takes_each_word_of_a_chunk_once(monkeypatch):
    """Classes and shares are looked up for distinct words; blocks of hashed bytes and of places don't change what a word gets."""
    rng = random.Random(6)
    texts = [words(rng, n, 50) for n in (0, 1, 2, 300, 0, 5000, 7)] + ["", "x" * 300 + " y" * 3]
    data, off = text_bytes(pa.array(texts))
    word, tail, owner = mlm._hashed(data, off)
    model, asked = small_model(), []
    net = mlm.unflatten(model.flat)
    ids = model.classes(word, tail)
    wanted = np.concatenate([mlm.Pass(net, ids[owner == t], owner[owner == t], np.arange((owner == t).sum())).log_prob for t in np.unique(owner)]) + model.in_class(word, ids)
    for name in ("classes", "in_class"):
        plain = getattr(mlm.Model, name)
        monkeypatch.setattr(mlm.Model, name, lambda self, x, y, plain=plain: asked.append(len(x)) or plain(self, x, y))
    for block in (7, 1 << 15):
        monkeypatch.setattr(mlm, "HASH_BYTES", block, raising=False)
        each, got, of = mlm.net_log_probs(net, model, data, off)
        assert (got == word).all() and (of == owner).all() and np.abs(each - wanted).max() < 1e-5
    assert asked == [len(set(" ".join(texts).split()))] * 4


def test_training_on_a_long_text_sees_its_batches_whole():
    """A text of several batches: each batch's gradients are those of its places among all words."""
    rng = np.random.default_rng(2)
    ids, owner = rng.integers(0, mlm.VOCAB, 3 * mlm.BATCH), np.repeat([0, 1, 2], [5, 3 * mlm.BATCH - 10, 5])
    flat, seen = small_model().flat, np.full(sum(mlm._SIZES), 1e-4)
    trainer, at = mlm.Trainer(flat, seen), np.arange(1, 3 * mlm.BATCH, 2)
    trainer.feed(ids, owner, at)
    net, sums = mlm.unflatten(flat.copy()), mlm.unflatten(seen.copy())
    for k in range(0, len(at), mlm.BATCH):
        for name, (rows, g) in mlm.Pass(net, ids, owner, at[k : k + mlm.BATCH]).gradients().items():
            full = np.zeros_like(net[name])
            full[slice(None) if rows is None else rows] = g
            sums[name] += full * full
            net[name] -= mlm.RATE * full / np.sqrt(sums[name])
    assert all(np.abs(trainer.net[k] - net[k]).max() < 1e-9 for k in net)


@pytest.mark.parametrize("chunk", [1 << 22, 700])
def test_scores_match_brute_force(spark, monkeypatch, chunk):
    """Pseudo-likelihoods and importance weights by loops over single words."""
    monkeypatch.setattr(mlm, "CHUNK_BYTES", chunk)
    rng = random.Random(10)
    rows = [(i, words(rng, rng.randrange(0, 30), 9)) for i in range(40)] + [(90, None), (91, " ")]
    model = small_model()
    net = mlm.unflatten(model.flat)
    got = {r.doc_id: r for r in mlm.score(docs(spark, rows), model).collect()}
    around, filled = Counter(), Counter()
    for _, text in rows:
        w = [None, *(text or "").split(), None]
        for k in range(1, len(w) - 1):
            around[w[k - 1], w[k + 1]] += 1
            filled[w[k - 1], w[k], w[k + 1]] += 1
    for i, text in rows:
        word, tail, _ = mlm._hashed(*text_bytes(pa.array([text], pa.string())))
        ids, w = model.classes(word, tail), [None, *(text or "").split(), None]
        total = plain = 0.0
        for k, c in enumerate(ids):
            near = sum((net["left"][ids[j]] for j in range(max(0, k - mlm.REACH), k)), np.zeros(mlm.DIM)) + sum((net["right"][ids[j]] for j in range(k + 1, min(len(ids), k + mlm.REACH + 1))), np.zeros(mlm.DIM))
            hidden, high, low = np.tanh(near), c // mlm.SIDE, c % mlm.SIDE
            x = hidden @ net["high"] + net["high_bias"]
            y = (hidden + net["of_high"][high]) @ net["low"] + net["low_bias"][high]
            own = x[high] - np.log(np.exp(x).sum()) + y[low] - np.log(np.exp(y).sum()) - 2.5
            m, n = filled[w[k], w[k + 1], w[k + 2]] - 1, around[w[k], w[k + 2]] - 1
            plain += own
            total += np.log((m + mlm.TRUST * np.exp(own)) / (n + mlm.TRUST))
        assert abs(got[i].net_log_prob - plain) < 1e-3 and got[i].n_tokens == len(ids)
        assert abs(got[i].log_prob - total) < 0.5 / mlm.NATS * max(1, len(ids))
    rows = rows[:12]
    owner, bucket = resample.grams(*text_bytes(pa.array([t for _, t in rows])))
    ratio = np.random.default_rng(3).standard_normal(3 * resample.BUCKETS)
    weights = {r.doc_id: r for r in resample.weigh(docs(spark, rows), ratio).collect()}
    assert all(abs(weights[i].log_weight - ratio[bucket[owner == i]].sum()) < 1e-9 for i, _ in rows)
    assert (resample.bucket_counts(docs(spark, rows)) == np.bincount(bucket, minlength=len(ratio))).all()


def test_decontamination_matches_brute_force(spark):
    """Items and texts of few words, so that templates, repeats and slots collide."""
    import regex

    def template(text):
        raw = regex.findall(decontam.TOKEN, text or "")
        out = []
        for i, x in enumerate(raw):
            c, bare = x[0], regex.sub(r"^[.!?\n][^\p{L}\p{N}]*", "", x.lower())
            if c in "0123456789":
                out.append("0")
            elif c in ".!?\n":
                out.append("0" if bare[0] in "0123456789" else bare)
            elif i and raw[i - 1][-1] in "0123456789" and x.lower() in decontam.UNITS:
                out.append("U")
            elif i and c != c.lower() and len(x) > 1 and x[1] != x[1].upper():
                out.append("N")
            else:
                out.append(x.lower())
        return [regex.sub(r"^[.!?\n][^\p{L}\p{N}]*|[.,]+$", "", x.lower()) for x in raw], out

    def windows(t):
        return [tuple(t[i : i + 5]) for i in range(len(t) - 4)] if len(t) >= 5 else [("short", *t)] if t else []

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["a", "b", "Ann", "Bob", "7", "8", "km", "c.", "d"]) for _ in range(n))
    items = [(i, say(rng.choice([3, 6, 9, 12]))) for i in range(12)]
    texts = [(i, say(rng.randrange(0, 60)) + " " + items[i % 12][1] * (i % 2)) for i in range(60)]
    want = set()
    for d, text in texts:
        raw, t = template(text)
        places = {}
        for p, w in enumerate(windows(t)):
            places.setdefault(w, []).append(p)
        for k, item in items:
            iraw, it = template(item)
            lines = {}
            for q, w in enumerate(windows(it)):
                for p in places.get(w, []):
                    line = lines.setdefault(p - q, (set(), set()))
                    line[0].add(q)
                    line[1].update((iraw[q + j], raw[p + j]) for j in range(5) if q + j < len(it) and it[q + j] in ("0", "N", "U"))
            held = set().union(*(qs for qs, pairs in lines.values() if len(pairs) == len({v for v, _ in pairs})))
            if windows(it) and len(held) >= 0.8 * len(windows(it)):
                want.add((d, k))
    found = decontam.contaminated_by(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want

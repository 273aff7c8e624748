"""Near duplicates, suffix dedup, mixing, the pipeline."""

import hashlib
import random

import numpy as np
import regex
from cases import SCHEMA, frame, plain, rows, same, sentence
from pyspark.sql import functions as F

from storyloom.llm import jaccard, mixing, suffixes


def near_by_hand(data):
    words = [regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for _, t in data]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    n = len(data)
    alike = lambda a, b: bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    links = [[j for j in range(n) if j != i and alike(i, j)] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in links[i]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    out = []
    for i, (d, _) in enumerate(data):
        group = [data[j][0] for j in range(n) if find(j) == find(i) and data[j][0] is not None]
        copies = sum(words[j] == words[i] for j in range(n)) if words[i] else 1
        texts = {" ".join(words[j]) for j in links[i]} - {" ".join(words[i])}
        out.append((d, (min(group) if group else None) if words[i] else d, copies, len(links[i]), len(texts)))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    data = [r[:2] for r in rows()]
    start = " ".join(sentence(rng) for _ in range(14)).split()
    for k in range(14):  # a group that needs several blocks
        w = list(start)
        w[k * 7] = f"other{k}"
        data.append((2000 + k, " ".join(w)))
    got = jaccard.near_duplicates(spark.createDataFrame([(*d, "x", 3) for d in data], "doc_id long, text string, key string, band int"), block=4)
    same([tuple(r) for r in got.drop("text_hash", "class_key").collect()], near_by_hand(data))


def test_one_of_each_class_stays(spark):
    data = [r[:2] for r in rows()]
    kept = jaccard.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    left = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    classes = near_by_hand(data)
    wordless = sum(1 for _, t in data if not regex.search(r"[\p{L}\p{N}]", t or ""))
    whole = {c for (d, t), (_, c, *_) in zip(data, classes, strict=True) if regex.search(r"[\p{L}\p{N}]", t or "")}
    assert len(left) == wordless + len(whole) + 1  # another text has the number 7 as well
    assert jaccard.keep_one(plain(spark, [])).count() == 0
    assert jaccard.near_duplicates(plain(spark, [(1, None), (1, "")])).count() == 2


def test_bands_reach_the_recall():
    bands, width = jaccard.choose_bands(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**width) ** bands >= 0.9999 and bands * width <= 128


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    data = [r[:2] for r in rows()]
    passage = " ".join(sentence(rng) for _ in range(6))
    data += [(3000 + k, f"{sentence(rng)} {passage[k * 3 :]} {sentence(rng)}") for k in range(9)]
    data += [(3100, "ab" * 400), (3101, "a" * 500), (3102, "a" * 199), (3103, "é" * 150 + "z" + "é" * 150), (3104, passage[:199]), (3105, passage[:200]), (3106, "\x00" * 260)]
    docs = spark.createDataFrame([(*d, b"x", 1) for d in data], "doc_id long, text string, data binary, head int")
    got = suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    same([tuple(r) for r in got], suffixes.brute_force(data))
    assert suffixes.remove_repeats(plain(spark, [])).count() == 0
    assert [r.n_removed for r in suffixes.remove_repeats(plain(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_anchors_are_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 101, 5_000).astype(np.uint8)
    bounds = np.array([0, 100, 100, 1_700, 1_899, 5_000])
    whole = suffixes.anchors(buf, bounds)
    monkeypatch.setattr(suffixes, "PIECE", 333)
    for a, b in zip(whole, suffixes.anchors(buf, bounds), strict=True):
        assert (a == b).all()


def test_loser_tree_merges_and_knows_the_shared_prefixes():
    rng = np.random.default_rng(5)
    runs, every = [], []
    for _ in range(5):
        rows_ = np.unique(rng.integers(97, 99, (40, 6)), axis=0).astype(np.uint8)
        rows_ = np.hstack([rows_, np.full((len(rows_), suffixes.DEPTH - 6), 98, np.uint8)])
        every += [bytes(r) for r in rows_]
        runs.append(suffixes.front_code(rows_, np.zeros(len(rows_))))
    out = list(suffixes.LoserTree([suffixes.front_decode(r) for r in runs]))
    assert [s for s, _, _ in out] == sorted(every)
    for (a, _, _), (b, shared, _) in zip(out, out[1:], strict=False):
        assert shared == next((k for k in range(suffixes.DEPTH) if a[k] != b[k]), suffixes.DEPTH)
    assert list(suffixes.LoserTree([])) == []


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, la, t, 10 + 7 * i) for i, (s, la, t) in enumerate((s, la, t) for s in "abc" for la in ("x", None) for t in "pq")], "source string, lang string, topic string, tokens long")
    goals = {"source": mixing.targets(cells, "source", {"a": 0.5}), "lang": mixing.targets(cells, "lang", {"x": 0.3}), "topic": mixing.targets(cells, "topic", None)}
    raked = mixing.rake(cells, goals).collect()
    share = lambda c, v: sum(r.raked for r in raked if r[c] == v)
    assert abs(share("source", "a") - 0.5) < 1e-4 and abs(share("lang", "x") - 0.3) < 1e-4 and abs(sum(r.raked for r in raked) - 1) < 1e-9
    # by hand
    want = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}
    aims = [{v.source: v.target for v in goals["source"].collect()}, {v.lang: v.target for v in goals["lang"].collect()}, {v.topic: v.target for v in goals["topic"].collect()}]
    whole = sum(want.values())
    want = {k: v / whole for k, v in want.items()}
    for _ in range(mixing.ROUNDS):
        for m, aim in enumerate(aims):
            now = {v: sum(x for k, x in want.items() if k[m] == v) for v in aim}
            want = {k: x * aim[k[m]] / now[k[m]] for k, x in want.items()}
    assert all(abs(r.raked - want[r.source, r.lang, r.topic]) < 1e-4 for r in raked)
    picked = mixing.calibrate(mixing.rake(cells, goals), 200.0).collect()
    assert abs(sum(r.tokens * r.probability for r in picked) - 200) < 1e-3 and all(0 < r.probability <= 1 for r in picked)


def test_mixing_of_odd_rows(spark):
    data = frame(spark)
    all_of_it = mixing.mix_sources(data.drop("topic"), share=1.0)
    assert all_of_it.filter("n_tokens > 0").count() == sum(bool((r[1] or "").strip()) for r in rows())
    half = mixing.mix_sources(data.drop("topic"), share=0.5)
    assert half.count() == half.count() and 0 < half.count() < len(rows())
    assert mixing.mix_sources(data.drop("topic").limit(0)).count() == 0
    assert {r.topic for r in spark.createDataFrame([("a@b",), ("licensed under x",), ("x 12345",), ("x",)], "t string").select(mixing.topic_of(F.col("t")).alias("topic")).collect()} == {"contact", "license", "numbers", "prose"}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    data = rows()
    for name, frame_ in (("documents", spark.createDataFrame(data, SCHEMA)), ("benchmark", spark.createDataFrame([(1, " ".join(data[5][1].split()[:14]))], "item_id long, text string"))):
        frame_.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "decontamination":
            assert docs.filter("doc_id = 5").count() == 0
        if name == "personal_data":
            assert docs.filter("text like '%@%'").count() == 0 and docs.filter("n_chars <> length(text)").count() == 0
    assert docs.count() > 0
    run = corpus_pipeline.run(spark, str(tmp_path))
    digest = lambda df: sorted(hashlib.sha256(str(tuple(r)).encode()).hexdigest() for r in df.select("doc_id", "text", "probability").collect())
    assert digest(run) == digest(docs)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_strings_of_many_surroundings_are_counted_over_the_cluster(spark, monkeypatch):
    rng = random.Random(8)
    passage = " ".join(sentence(rng) for _ in range(7))
    data = [(k, f"{sentence(rng)} {passage[k % 5 :]} {sentence(rng)} {sentence(rng)}") for k in range(20)]
    monkeypatch.setattr(suffixes, "LARGE", 2)
    got = suffixes.remove_repeats(plain(spark, data)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    same([tuple(r) for r in got], suffixes.brute_force(data))

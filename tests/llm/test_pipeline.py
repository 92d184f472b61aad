"""The pipeline on a small corpus against plain Python, stage by stage."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import mixing, quality, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, folder = random.Random(12), tmp_path_factory.mktemp("sf")
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    line = lambda n=14: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels, items = [], [], [(i, line(25)) for i in range(5)]
    for i in range(240):
        good = i % 6 != 0
        lines = [line() for _ in range(rng.randint(4, 12))]
        if not good:
            lines = [" ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in x.split()) for x in lines]
        if i % 7 == 1:
            lines.insert(1, f"Released under licence {i} of the year, see the file")
        if i % 41 == 2:
            lines.append(items[i % 5][1])
        rows.append([i, "\n".join(lines), "en", f"s{i % 4}" if i % 50 else None, 0])
        labels.append((i, int(good), 0))
    for k in range(30):  # exact and near copies of long texts
        text = rows[k * 5 + 1][1] + "\n" + "\n".join(line() for _ in range(20))
        rows[k * 5 + 1][1] = text
        at = rng.randrange(len(text) - 20)
        rows.append([300 + k, text if k % 2 else f"{text[:at]} {line(1)} {text[at:]}", "en", "s1", 0])
    rows += [[400, None, None, None, None], [401, "", "en", "s0", 0]]
    rows = [[a, b, c, d, None if b is None else len(b)] for a, b, c, d, _ in rows]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def read(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sizer, weights, states = quality.Sizer(model.good, model.bad), np.array(model.weights), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        states.append(stage(spark, states[-1], sf_dir).cache())
        assert states[-1].columns == docs.columns + ["copy"] * (k == 4)
    texts = [read(s) for s in states]

    score = {i: 1 / (1 + np.exp(-(np.array(sizer.features(t)) @ weights))) for i, t in texts[0].items()}
    assert set(texts[1]) == {i for i, s in score.items() if s >= 0.3}
    assert np.mean([(i in texts[1]) == (i % 6 != 0) for i in range(240)]) > 0.97

    for i, t in texts[1].items():
        if i < 300 and t:
            assert texts[2][i] == "\n".join(x for x in t.split("\n") if not x.startswith("Released under"))
    assert all(n == len(t) for t, n in ((r.text, r.n_chars) for r in states[2].collect()) if t is not None)

    ids, sets = sorted(texts[2]), {}
    for i in ids:
        w = (texts[2][i] or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    assert set(texts[3]) == {i for i, r in root.items() if r == i}
    assert not set(texts[3]) & set(range(300, 330))

    grams = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = r.text.split()
        grams |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    dirty = {i for i, t in texts[3].items() if any(tuple(w[k : k + 10]) in grams for w in [(t or "").lower().split()] for k in range(len(w)))}
    assert dirty and set(texts[4]) == set(texts[3]) - dirty

    taken, drawn = Counter(), mixing.mixed(states[4])
    for r in states[5].collect():
        taken[r.doc_id] += 1
        assert 1 <= r.copy <= 3
    assert dict(taken) == {r.doc_id: r.copies for r in drawn.collect() if r.copies}


def test_run_is_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: sorted(map(repr, df.select("doc_id", "copy", F.md5(F.coalesce("text", F.lit("")))).collect()))
    assert key(out) == key(docs)


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_groups_of_copies_leave_one(spark):
    rows = [(i, "one two three four five six seven " * 30, "en", "s", 1) for i in range(50)] + [(100 + i, f"{i} different words altogether here {i}" * 5, "en", "s", 1) for i in range(5)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "")
    by = defaultdict(list)
    for r in kept.collect():
        by[r.text].append(r.doc_id)
    assert by[rows[0][1]] == [0] and len(by) == 6


@pytest.mark.parametrize(("rounds", "few"), [(6, 4), (0, 0), (2, 0)])
def test_sets_of_one_bucket_by_pairs_heads_and_rarest_shingles(spark, monkeypatch, rounds, few):
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "FEW", few)
    rng, sets = random.Random(4), []
    for size in (30, 12, 5):  # groups around a core, some members within the similarity, some not
        core = rng.sample(range(10**9), 60)
        sets += [sorted(core[: rng.randint(44, 60)] + rng.sample(range(10**9), rng.randint(0, 9))) for _ in range(size)]
    sets += [[1], [1, 2], sets[0] + [10**9 + 1]]
    root = {i: i for i in range(len(sets))}
    for a in root:
        for b in root:
            common = len({*sets[a]} & {*sets[b]})
            if a < b and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    assert 3 < len(set(root.values())) < len(sets)
    members = spark.createDataFrame([(7, i, len(s)) for i, s in enumerate(sets)], "key bigint, cid bigint, n bigint")
    arrays = spark.createDataFrame(list(enumerate(sets)), "cid bigint, s array<bigint>")
    found = {r.id: r.component for r in simhash.linked(members, arrays, 0.8).collect()}
    assert {i: found.get(i, i) for i in root} == root

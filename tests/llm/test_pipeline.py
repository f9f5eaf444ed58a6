"""Each stage on what the one before it kept, against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as near_duplicates
from tests.llm.test_rules import base
from tests.llm.test_suffix import brute as repeated_strings
from tidemill.llm import graph, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    raw = text.encode()
    return quality.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def kept_by_quality(docs, trusted):
    raw = sum(np.bincount(grams(t), minlength=quality.BINS) for _, t in docs)
    target = sum(np.bincount(grams(t), minlength=quality.BINS) for i, t in docs if i in trusted)
    weight = np.log(target + 1) - np.log(target.sum() + quality.BINS) - np.log(raw + 1) + np.log(raw.sum() + quality.BINS)
    return [(i, t) for i, t in docs if not base(t)[5] and weight[grams(t)].mean() >= quality.THRESHOLD]


def kept_by_benchmark(docs, items):
    windows = set()
    for text in items:
        words = WORD.findall(low(text))
        windows |= {tuple(words[k : k + 13]) for k in range(max(1, len(words) - 12))} if words else set()
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words = WORD.findall(low(text))
        hit = set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(words):
            out.append((i, text))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, d = tmp_path_factory.mktemp("stages"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], d).write.parquet(f"{folder}/{name}")
        found.append(spark.read.parquet(f"{folder}/{name}"))
    return [f.toPandas() for f in found]


def pairs(frame):
    return sorted(zip(frame.doc_id.tolist(), frame.text.tolist(), strict=True))


def test_quality(spark, stages):
    trusted = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").collect()}
    assert pairs(stages[1]) == kept_by_quality(pairs(stages[0]), trusted)


def test_near_duplicates(stages):
    roots = {i: r for i, _, r in near_duplicates(pairs(stages[1]), 5, 80)}
    assert pairs(stages[2]) == [(i, t) for i, t in pairs(stages[1]) if roots[i] == i]


def test_repeated_strings(stages):
    rows = pairs(stages[2])
    want = [(i, k.decode(errors="ignore") if n else t) for (i, t), (_, _, n, _, k) in zip(rows, repeated_strings(rows, 50), strict=True)]
    assert pairs(stages[3]) == want
    assert (stages[3].n_chars == stages[3].text.str.len()).all()


def test_decontamination(spark, stages):
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert pairs(stages[4]) == kept_by_benchmark(pairs(stages[3]), items)


def test_columns_and_packing(stages):
    for frame in stages[1:5]:
        assert list(frame.columns) == list(stages[0].columns)
    packed = stages[5]
    assert sorted(set(packed.doc_id)) == sorted(stages[4].doc_id)
    assert packed.groupby("doc_id").length.sum().equals(packed.groupby("doc_id").doc_tokens.first())


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    key = ["doc_id", "doc_tokens"]
    assert Counter(map(tuple, found[key].drop_duplicates().to_numpy().tolist())) == Counter(map(tuple, stages[5][key].drop_duplicates().to_numpy().tolist()))


@pytest.mark.parametrize("per_task", [graph.PER_TASK, 40, 1])
def test_components_of_random_graphs(spark, per_task):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    given = spark.createDataFrame([*edges, (None, 1), (2, None), (None, None)], "a long, b long").repartition(7)
    found = {r["node"]: r["root"] for r in graph.components(given, per_task).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
    a, b = graph.local_stars(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == found

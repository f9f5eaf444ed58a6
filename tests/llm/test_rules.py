"""Quality rules, classifier, decontamination, sharding and licences."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tidemill.llm import classifier, decontaminate, licences, quality, scan, sharding

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marks = [0] * len(words)
    for k in range(len(words) - 2):
        if count[tuple(words[k : k + 3])] > 1:
            marks[k : k + 3] = [1] * 3
    failed = len(words) < 50 or 100 * sum(marks) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(marks), failed


def test_base_counts(documents):
    found = Counter(tuple(r)[:7] for r in quality.measure(documents, documents.selectExpr("doc_id", "1 as quality")).collect())
    assert found == Counter((r["doc_id"], *base(r["text"])) for r in documents.collect())


def test_likelihood_ratio_by_definition(documents, labels):
    def grams(text):
        raw = (text or "").encode()
        data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        return quality.grams(data, offs)[0].tolist()

    rows = documents.collect()
    trusted = {1, 6}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(g := grams(r["text"]))
        if r["doc_id"] in trusted:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    weight = lambda g: np.log(target[g] + 1) - np.log(m + quality.BINS) - np.log(raw[g] + 1) + np.log(n + quality.BINS)
    want = sorted(((r["doc_id"] if r["doc_id"] is not None else -99), round(float(np.mean([weight(g) for g in grams(r["text"])] or [0])), 6)) for r in rows)
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else -99), round(r["score"], 6)) for r in quality.measure(documents, labels).collect())
    assert [i for i, _ in found] == [i for i, _ in want]
    assert [x for _, x in found] == pytest.approx([x for _, x in want], abs=1e-5)


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_and_lines_are_compared_by_their_bytes(spark):
    """Polynomial hashes modulo 2**64 take the two Thue-Morse words of 2,048 letters for one."""
    x, y = thue_morse(2048, "ab"), thue_morse(2048, "ba")
    texts = [f"{x}\n{y}\n{x}", f"{x} p q {y} p q", f"{x} p q {x} p q", "a b c a b c", "a b c\na b", "l\n\n \nl\n l"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:7] for r in quality.measure(docs, docs.selectExpr("doc_id", "1 as quality")).collect()}
    assert found == {k: base(t) for k, t in enumerate(texts)}
    assert found[0][3] == 1 and found[1][4] == 0 and found[2][4] == 6


def test_combined_numbers_are_equal_where_all_parts_are():
    r = np.random.default_rng(4)
    for bound in (3, 1 << 20, 1 << 40):
        parts = [r.integers(0, 3, 500) * (bound // 3) for _ in range(4)]
        found = scan.combined(*((p, bound) for p in parts))
        rows = list(zip(*(p.tolist() for p in parts), strict=True))
        assert len(set(found.tolist())) == len(set(rows)) == len(set(zip(found.tolist(), rows, strict=True)))


def test_scores_do_not_depend_on_neighbours():
    r = np.random.default_rng(7)
    texts = ["".join(r.choice(list("ab cd#\n"), r.integers(0, 300))).encode() for _ in range(200)]
    whole = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    weight = r.normal(size=classifier.BINS)
    units = np.rint(r.normal(size=quality.BINS) * quality.UNIT).astype(np.int64)
    rated, scored = classifier.scores(weight, *classifier.features(*whole)), quality.verdicts(*whole, units, 0.0)[3]
    for k, text in enumerate(texts):
        alone = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        assert classifier.scores(weight, *classifier.features(*alone))[0] == rated[k]
        assert quality.verdicts(*alone, units, 0.0)[3][0] == scored[k]


def test_classifier_against_a_plain_version(spark):
    """Learning and scoring of the whole query again, one document and one feature at a time."""
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kept_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = sorted((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if not kept_out(r["doc_id"]))

    def vector(text):
        raw = (text or "").encode()
        bins = classifier.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        return {k: n / len(bins) ** 0.5 for k, n in Counter(bins).items()}

    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= classifier.L1 else (math.copysign(classifier.L1, z[k]) - z[k]) / ((classifier.BETA + n[k] ** 0.5) / classifier.ALPHA + classifier.L2)
    chance = lambda x: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
    for _ in range(classifier.EPOCHS):
        for _, i, label in labels[: classifier.SAMPLE]:
            if i in texts:
                x = vector(texts[i])
                slope = chance(x) - label
                for k, v in x.items():
                    g, w = slope * v, weight(k)
                    z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / classifier.ALPHA * w
                    n[k] += g * g
    found = {r["doc_id"]: r for r in classifier.op7_classifier(spark, d).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        p = chance(vector(text))
        assert found[i]["held_out"] == kept_out(i) and found[i]["score"] == pytest.approx(p, abs=1e-5)
        assert abs(p - classifier.CUT) < 1e-5 or found[i]["predicted"] == (p >= classifier.CUT)


def test_grams_do_not_cross_texts():
    parts = [b"abcd", b"", b"ab", b"abcde", b"x"]
    data, offs = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    bins, firsts = quality.grams(data, offs)
    assert np.diff(firsts).tolist() == [1, 0, 0, 2, 0]
    assert bins[0] == bins[1]


def test_verdicts_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    found = quality.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    count = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert count.get((1, False), 0) == 0 and count.get((0, True), 0) <= 0.02 * count[0, False]


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = classifier.op7_classifier(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_score_is_a_sparse_dot_product():
    text = "One two two two ## one".encode()
    bins, begins = classifier.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert begins.tolist() == [0, 12] and bins[0] == 0
    tokens, pairs = bins[1:7], bins[7:]
    assert tokens[2] == tokens[3] != tokens[1] and len(pairs) == 5 and pairs[2] != pairs[1]
    weight = np.random.default_rng(1).normal(size=classifier.BINS)
    assert classifier.scores(weight, bins, begins)[0] == pytest.approx(1 / (1 + np.exp(-weight[bins].sum() / np.sqrt(12))))


def test_ftrl_learns():
    model = classifier.Ftrl()
    for _ in range(50):
        model.learn(np.array([0, 5]), np.ones(2), 1)
        model.learn(np.array([0, 9]), np.ones(2), 0)
    w = model.weight()
    assert w[5] > 0.5 and w[9] < -0.5 and np.count_nonzero(w) <= 3


def test_benchmark_in_small_blocks_and_spans(spark, documents, benchmark_items):
    whole = sorted(map(str, decontaminate.measure(documents, benchmark_items).collect()))
    assert sorted(map(str, decontaminate.measure(documents, benchmark_items, block=3).collect())) == whole
    docs = spark.createDataFrame([(1, "Intro here. Two  WORDS, then more. End one!", 43)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, "two words then more"), (2, "one")], "item_id long, text string")
    row = decontaminate.clean(docs, items, remove="spans").first()
    assert (row["text"], row["n_chars"]) == ("Intro here. . End !", 19)
    assert decontaminate.clean(docs, items).count() == 0


def test_shards_match_the_mixture(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "concat('t', id) as text", "case when id % 3 > 0 then 'hot' when id % 30 = 0 then null else concat('s', id % 5) end as source")
    rows = sharding.interleave(docs, shards=7, buckets=16).collect()
    by_shard = Counter(r["shard"] for r in rows)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    for shard in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(by_shard[shard]))
    for stratum, n in Counter(r["stratum"] for r in rows).items():
        own = Counter(r["shard"] for r in rows if r["stratum"] == stratum)
        assert all(abs(own[s] - n * by_shard[s] / 1000) <= 2 for s in range(7))
    assert sorted(map(str, sharding.interleave(docs.repartition(9), shards=7, buckets=1).collect())) == sorted(map(str, rows))


def test_licences(spark):
    mit = licences.KNOWN["MIT"]
    wrapped = "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper().replace(", ", ",\n  ")
    rows = [(1, mit), (2, wrapped), (3, mit + " and more"), (4, "   "), (5, "Released under the MIT Licence"), (6, "© 2021 X\nLicensed under the Apache License, version 2.0")]
    found = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: "MIT-short", 6: "Apache-2.0-short"}
    assert len({r["digest"] for r in licences.scan(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()}) == 1
    with pytest.raises(ValueError):
        licences.known(spark, {str(k): str(k) for k in range(licences.LIMIT + 1)})


def test_copyright_statements(spark):
    mit, bsd = licences.KNOWN["MIT"], licences.KNOWN["BSD-3-Clause"]
    cases = [
        ("MIT", f"MIT License\n\nCopyright Acme Inc.\n\n{mit}"),
        ("MIT", f"Copyright Acme Inc.\n\n{mit}"),
        ("MIT", f"Copyright by A. Person and others\r\n\r\n{mit}"),
        ("MIT", f"Copyright (c) 2020 Acme, Inc. {mit}"),
        ("MIT", f"The MIT License (MIT)\n\n(c) 2020-2024 Acme All rights reserved. {mit}"),
        ("MIT", f"Copyright Acme Inc. {mit}"),
        ("MIT", f"Copyright (c) 2020 A\nCopyright (c) 2021 B\n© 2022 C\n\n{mit}\n\nCopyright Acme"),
        ("BSD-3-Clause", f"Copyright © 1999, Regents. All rights reserved. {bsd}"),
        ("Apache-2.0-short", "© 2021 X. Licensed under the Apache License, Version 2.0"),
        (None, f"Copyright Acme Inc. keeps some rights.\n{mit}"),
        (None, f"A tale of copyright.\n\n{mit}"),
        (None, "Copyright Acme Inc."),
        (None, "Copyright (c) 2020 Acme Inc.\nAll rights reserved."),
    ]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r["licence"] for r in licences.scan(docs).collect()}
    assert [found[k] for k in range(len(cases))] == [name for name, _ in cases]


def test_whole_licences_with_and_without_title(spark):
    # Line breaks and capitals of a whole licence are of no account.
    wrapped = "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + licences.KNOWN["MIT"].upper().replace(", ", ",\n  ")
    texts = {file.stem: file.read_text(encoding="utf-8") for file in (Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    apache, gpl, cc0 = texts["Apache-2.0"], texts["GPL-3.0"], texts["CC0-1.0"]
    cases = [("MIT", wrapped), *texts.items()]
    cases += [(name, f"{title}\n\nCopyright (c) 2021 B. Person\n\n{licences.KNOWN[name]}\n") for name, titles in licences.TITLES.items() for title in titles]
    cases += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2022 C. Person")), ("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache[apache.index("TERMS AND COND") :])]
    cases += [("GPL-3.0", gpl[gpl.index("Copyright (C)") :]), ("GPL-3.0", gpl.replace("https:", "http:")), ("CC0-1.0", cc0[cc0.index("CREATIVE COMMONS CORP") :]), ("CC0-1.0", cc0[cc0.index("CC0 1.0 Univ") :])]
    cases += [(None, apache + "\nand more"), (None, gpl[: len(gpl) // 2]), (None, "MIT License"), (None, "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/")]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r["licence"] for r in licences.scan(docs).collect()}
    assert len(texts) >= 14
    assert [found[k] for k in range(len(cases))] == [name for name, _ in cases]

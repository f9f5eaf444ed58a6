"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from tests.llm.conftest import bag, prose
from tidemill.llm import chat, classifier, decontaminate, extract, jaccard, licences, packing, quality, sharding, substrings


def operators(labels, items):
    return {
        "substrings": lambda d: substrings.dedup(d, digest=True),
        "decontaminate": lambda d: decontaminate.measure(d, items),
        "quality": lambda d: quality.measure(d, labels),
        "sharding": lambda d: sharding.interleave(d, shards=3),
        "classifier": lambda d: classifier.score(d, classifier.train(d, labels)),
        "jaccard": lambda d: jaccard.join(d, 3, 90),
        "licences": licences.scan,
    }


NAMES = ["substrings", "decontaminate", "quality", "sharding", "classifier", "jaccard", "licences"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row_whatever_the_other_columns(documents, crowded, labels, benchmark_items, name):
    run = operators(labels, benchmark_items)[name]
    plain = bag(run(documents))
    assert sum(plain.values()) == documents.count()
    assert bag(run(crowded)) == plain


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(documents, labels, benchmark_items, name):
    run = operators(labels.where("false"), benchmark_items.where("false"))[name]
    assert run(documents.where("false")).count() == 0
    assert run(documents).count() == documents.count()


@pytest.mark.parametrize(
    "stage",
    [
        lambda d, labels, items: quality.keep(d, labels),
        lambda d, labels, items: jaccard.representatives(d),
        lambda d, labels, items: substrings.dedup(d),
        lambda d, labels, items: decontaminate.clean(d, items),
        lambda d, labels, items: decontaminate.clean(d, items, remove="spans"),
    ],
)
def test_stages_keep_columns(crowded, labels, benchmark_items, stage):
    out = stage(crowded, labels, benchmark_items)
    assert out.dtypes == crowded.dtypes
    rest = [c for c in crowded.columns if c not in ("text", "n_chars")]
    assert not bag(out.select(rest)) - bag(crowded.select(rest))
    assert stage(crowded.where("false"), labels, benchmark_items).count() == 0


def test_packing_covers_every_row(documents, crowded):
    plain = bag(packing.pack(documents, packing.default_vocabulary()))
    assert bag(packing.pack(crowded, packing.default_vocabulary())) == plain
    assert packing.pack(documents.where("false"), packing.default_vocabulary()).count() == 0
    assert packing.pack(documents, packing.default_vocabulary()).where("start = 0").count() == documents.count()


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "hi"), (2, 5, "assistant", ""), (3, 1, "a\nb", "### </turn>\\")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold(chat.as_log(talk)))
    turns = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.select("conv_id", chat.parse(out["formatted"]).alias("turns")).collect()}
    assert turns == {1: [("", "x"), ("user", ""), ("user", "")], None: [("user", "hi")], 2: [("assistant", "")], 3: [("a\nb", "### </turn>\\")]}
    assert chat.render(chat.fold(chat.as_log(talk.where("false")))).count() == 0


def test_pages(spark):
    rows = [(1, "u", None, "z"), (1, "u", "", "z"), (None, None, "<p>x", "z"), (2, "u", "<article><p>one  two<p>three &amp; four</article><footer>f</footer>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract.extract(pages).collect()
    assert [r["text"] for r in found if r["page_id"] == 2] == ["one two\nthree & four"]
    assert [r["text"] for r in found if r["page_id"] == 1] == ["", ""]
    assert len(found) == 4
    assert extract.extract(pages.where("false")).count() == 0


def test_long_conversations_and_other_columns(spark):
    long = prose(9, 60_000) + " ###\\</turn>\n" * 500
    rows = [(1, 0, "user", long, "a"), (1, 1, "assistant", long, "b"), (1, 2, "assistant", None, "c"), (2, 0, "assistant", "x", "d")]
    names = "seq kind k cut parts piece span formatted loss n at".split()
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string")
    for given in (talk, talk.selectExpr("*", *[f"'own {c}' as {c}" for c in names])):
        for eventful in (False, True):
            out = chat.render(chat.fold(chat.as_log(given, eventful)))
            got = {r["conv_id"]: r for r in out.select("conv_id", chat.parse(out["formatted"]).alias("turns"), chat.masked(out["formatted"], out["loss"]).alias("learnt")).collect()}
            assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", long), ("assistant", long), ("assistant", "")]
            assert got[1]["learnt"] == long and got[2]["learnt"] == "x"


def test_long_pages(spark):
    blocks = [prose(k, 40) + "." for k in range(3000)]
    html = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body></html>"
    whole = prose(5, 90_000)
    pages = spark.createDataFrame([(1, "u", html), (2, "v", f"<article><p>{whole}</p></article>")], "page_id long, url string, html string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extract(pages).collect()}
    assert found == {1: ("\n".join(blocks), len("\n".join(blocks))), 2: (whole, len(whole))}


def test_pipeline_on_awkward_and_empty_tables(spark, documents, crowded, benchmark_items, tmp_path):
    import corpus_pipeline

    labels = documents.selectExpr("doc_id", "1 as quality", "cast(null as int) as toxic")
    for name, docs in (("plain", documents), ("crowded", crowded), ("empty", documents.where("false"))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        (labels if name != "empty" else labels.where("false")).write.parquet(f"{folder}/labels.parquet")
        (benchmark_items if name != "empty" else benchmark_items.where("false")).write.parquet(f"{folder}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, folder).toPandas()
        if name == "empty":
            assert not len(pieces)
            continue
        assert set(pieces.doc_id.dropna()) <= {r["doc_id"] for r in documents.collect()}
        assert {4, 5} & set(pieces.doc_id) and 2 not in set(pieces.doc_id)
        assert (pieces[pieces.offset == 0].groupby("sequence_id").size() == 1).all()
        counts = pieces.dropna(subset=["doc_id"]).groupby("doc_id").length.sum()
        assert (counts >= 1).all()
        if name == "plain":
            plain = pieces
        else:
            key = ["doc_id", "doc_tokens"]
            assert sorted(map(str, pieces[key].drop_duplicates().to_numpy().tolist())) == sorted(map(str, plain[key].drop_duplicates().to_numpy().tolist()))

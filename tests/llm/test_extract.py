import itertools

import numpy as np

from tests.llm.layouts import LAYOUTS
from tidemill.llm import dom, extract, training_pages


def test_accuracy_on_unseen_layouts():
    model = extract.train()
    wrong = total = 0
    for page in training_pages.pages(150, seed=77):
        blocks = extract._labelled(page)
        scores = [sum(model.by_feature.get(x, 0.0) for x in set(names)) for names, _ in blocks]
        wrong += sum(a != y for a, (_, y) in zip(extract.viterbi(scores, model.pairs), blocks, strict=True))
        total += len(blocks)
    assert wrong <= total * 0.01


def test_parts_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
    <div class=ad>Buy this.</div><article><h1>Title &lt;1&gt;</h1><p>First   <b>bold</b>
    line.<p>Second &eacute;&#233;&#x1F600 one<script>x("<p>no</p>")</script> more.<!-- <p>hidden</p> --><aside class="sidebar"><p>Related things.</p></aside>
    <p title="a > b">Third.</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>Bob wrote:</p><p>Nice text, thank you for it.</p></div></section>
    <form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site</footer></body></html>"""
    assert extract.train().main_text(page) == "Title <1>\nFirst bold line.\nSecond éé\U0001f600 one more.\nThird."


def test_leaves_of_broken_markup():
    texts = lambda page: [x.text for x in dom.leaves(page, None, lambda c, t, a: None)]
    assert texts("<p>a<p>b</div>c<br>d<li>e<li>f<!-- never closed <p>x") == ["a", "b", "c d", "e", "f"]
    assert texts("1 < 2 & 3 > 2 &amp &notit;") == ["1 < 2 & 3 > 2 & ¬it;"]
    assert texts('<a href="x>y">link</a> <b title=\'q">\'>z') == ["link z"]
    assert texts("<script>never closed <p>x") == []
    assert texts("<html><head><title>T</title><p>Hello") == ["Hello"]
    assert texts("<html><head><meta charset=utf-8><title>T</title>\n Hello <b>you</b>") == ["Hello you"]
    assert texts("<head><noscript><style>x</style></noscript><script>1</script><link rel=x><article>A</article>") == ["A"]
    assert texts("<head><template><p>not shown</p></template></head>shown") == ["shown"]
    assert texts("<b>" * 5000 + "deep" + "</i>" * 5000 + "</b>" * 5000) == ["deep"]
    assert texts("<div>" * 5000 + "deep") == ["deep"]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    for _ in range(60):
        scores, pairs = r.normal(size=6), r.normal(size=(2, 2))
        value = lambda y: sum(s * l for s, l in zip(scores, y, strict=True)) + sum(pairs[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731, E741
        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert extract.viterbi(scores.tolist(), pairs) == list(best)


def test_marginals_by_enumeration():
    r = np.random.default_rng(2)
    scores, pairs = r.normal(size=(1, 4)), r.normal(size=(2, 2))
    one, both = extract._marginals(scores, np.ones((1, 4), bool), pairs)
    weight = {y: np.exp((scores[0] * y).sum() + sum(pairs[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=4)}
    total = sum(weight.values())
    assert np.allclose(one[0], [sum(w for y, w in weight.items() if y[t]) / total for t in range(4)])
    want = np.zeros((2, 2))
    for y, w in weight.items():
        for a, b in itertools.pairwise(y):
            want[a, b] += w / total
    assert np.allclose(both, want)


def test_long_notice_without_a_telling_name():
    prose = "The river rose in the night, and by morning the lower fields were under water. The farmers moved their animals to the hill. "
    notice = "We value your choices. Cookies help us to remember them, and our privacy policy explains how. You may subscribe to the newsletter at any time. " * 3 + "All rights reserved."
    other = "Historians still argue over the copyright of these letters, which the family sold to the museum. " + prose * 4
    assert len(notice) > 400
    texts = [(prose * 5).strip(), other.strip(), (prose * 4).strip()]
    for tag, head, tail in (("p", "", ""), ("div", "", ""), ("p", '<div class="content">', "</div>"), ("p", "<article>", "</article>")):
        blocks = [f"<{tag}>{x}</{tag}>" for x in texts]
        page = f"<html><body>{head}{''.join(blocks)}<{tag}>{notice}</{tag}>{tail}</body></html>"
        assert extract.train().main_text(page) == "\n".join(texts)


def test_a_notice_of_any_length_is_left_out():
    prose = "The river rose in the night, and by morning the lower fields were under water. The farmers moved their animals to the hill. "
    notice = "We use cookies to improve this site, as our privacy policy explains, and you may subscribe to the newsletter at any time. "
    more = "Your choices are kept for thirty days and then asked for again, unless you say otherwise in the settings of your account. " * 6
    for tag in ("p", "div"):
        for n in (*range(130, 520, 13), 700, 830):
            page = f"<html><body><{tag}>{prose * 4}</{tag}><{tag}>{prose * 3}</{tag}><{tag}>{(notice + more)[:n]}</{tag}></body></html>"
            assert extract.train().main_text(page) == f"{(prose * 4).strip()}\n{(prose * 3).strip()}", n


def test_formulas_are_shown_without_annotations():
    page = '<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="application/x-tex">x = {2}</annotation></semantics></math> holds.'
    assert [x.text for x in dom.leaves(page, None, lambda c, t, a: None)] == ["So x=2 holds."]


def test_layouts_written_by_hand():
    """Characters of main text, over pages of ten kinds of sites that are not in the training set."""
    model = extract.train()
    right = wrong = missed = 0
    for page in LAYOUTS.values():
        kept = model.main_text(page).split("\n")
        for leaf, (_, label) in zip(dom.leaves(page, None, lambda c, t, a: None), extract._labelled(page), strict=True):
            found = bool(kept) and kept[0] == leaf.text
            kept = kept[found:]
            right, wrong, missed = right + found * label * len(leaf.text), wrong + (found and not label) * len(leaf.text), missed + (label and not found) * len(leaf.text)
        assert not kept
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_whole_query_against_a_plain_version(spark, small):
    """Features of each block from scratch and the best of all paths by plain dynamic programming."""
    model = extract.train()

    def plain(page):
        texts = [leaf.text for leaf in dom.leaves(page or "", None, lambda c, t, a: None)]
        best = {0: (0.0, []), 1: (0.0, [])}
        for k, (names, _) in enumerate(extract._labelled(page or "")):
            score = sum(model.by_feature.get(x, 0.0) for x in set(names))
            step = lambda y: max(((v + (model.pairs[x, y] if k else 0.0), path) for x, (v, path) in best.items()), key=lambda z: z[0])  # noqa: B023, E731
            best = {y: ((old := step(y))[0] + y * score, [*old[1], y]) for y in (0, 1)}
        path = max(best.values(), key=lambda z: z[0])[1]
        return "\n".join(t for t, y in zip(texts, path, strict=True) if y)

    given = spark.read.parquet(f"{small}/pages.parquet").collect()
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extract.op1_extraction(spark, small).collect()}
    assert found == {r["page_id"]: (r["url"], text := plain(r["html"]), len(text)) for r in given}

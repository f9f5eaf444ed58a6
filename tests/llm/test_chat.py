from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import chat

TEXT = st.text(st.sampled_from(list("\\#</turn>ehn \né")), max_size=20)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "delta", "user", "How"), (1, 2, 0, "delta", "user", " are"), (1, 3, 1, "delta", "assistant", "Wrong"),
        (1, 4, 1, "regenerate", "assistant", ""), (1, 5, 1, "delta", "assistant", "Fi"), (1, 6, 1, "delta", "assistant", "ne"),
        (1, 7, 2, "delta", "user", "Bye"), (2, 1, 0, "delta", "user", "A"), (2, 2, 1, "delta", "assistant", "B"), (2, 3, 0, "edit", "user", "C"),
        (2, 4, 1, "delta", "assistant", "D"), (3, 2, 0, "delta", "user", "b"), (3, 1, 0, "delta", "user", "a"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(3)
    found = sorted(map(tuple, chat.fold(events).collect()))
    assert found == [(1, 0, "user", "How are"), (1, 1, "assistant", "Fine"), (1, 2, "user", "Bye"), (2, 0, "user", "C"), (2, 1, "assistant", "D"), (3, 0, "user", "ab")]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n###"]), TEXT), min_size=1, max_size=12))
def test_format_reads_back(spark, turns):
    rows = [(k // 3, k, "delta", r, t) for k, (r, t) in enumerate(turns)]
    log = spark.createDataFrame([(c, k, k, kind, r, t) for c, k, kind, r, t in rows], "conv_id long, seq long, turn long, kind string, role string, text string")
    out = chat.render(chat.fold(log))
    for row in out.select("conv_id", "formatted", chat.parse(out["formatted"]).alias("turns"), chat.masked(out["formatted"], out["loss"]).alias("learnt")).collect():
        own = [(r, t) for c, _, _, r, t in rows if c == row["conv_id"]]
        assert [(x["role"], x["text"]) for x in row["turns"]] == own
        assert row["learnt"] == "".join(t for r, t in own if r == "assistant")
        assert row["formatted"].count(chat.CLOSE) == len(own)

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcurves.llm import token_counts as C
from sparkcurves.llm import tokens as K


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=20), st.lists(st.integers(0, 9), max_size=6), st.sampled_from(C.RULES))
def test_rules_byte_by_byte(sizes, cuts, rule):
    total = sum(sizes)
    edges = np.array(sorted([0, total, *(c for c in cuts if c < total)]))
    got, crossing = C.attribute(np.array(sizes, np.int64), edges, rule)
    section = [max(i for i in range(len(edges) - 1) if edges[i] <= b) for b in range(total)]
    want, crossed, at = np.zeros(len(edges) - 1), np.zeros(len(edges) - 1), 0
    for n in sizes:
        own = section[at : at + n]
        at += n
        if rule == "share":
            for s in own:
                want[s] += 1 / n
        else:
            want[own[0] if rule == "first" else max(sorted(set(own)), key=own.count)] += 1
        crossed[own[0]] += len(set(own)) > 1
    assert np.allclose(got, want) and np.allclose(crossing, crossed)


ROWS = [(1, "A title", "First line\nsecond, longer line\n\nend"), (2, None, "x"), (3, "", ""), (None, "t", "no id\n"), (4, "big", "word\n" * 20_000), (1, "A title", "First line\nsecond, longer line\n\nend"),
        (5, "日本", "語\nñ")]


@pytest.mark.parametrize("section, joiner", [("\n", "\n"), (None, " "), ("ord", "\n\n"), ("e", "")])
def test_sections_cover_the_text_and_tokens_add_up(spark, section, joiner):
    frame = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, title string, text string, field string, tokens int")
    got = C.count_tokens(frame, ("title", "text"), section=section, joiner=joiner).collect()
    encoder = K.Encoder(K.vocabulary_path())
    want, seen = {}, {}
    for i, title, text in ROWS:
        whole = (title or "") + joiner + (text or "")
        want[i] = want.get(i, 0) + len(encoder.tokenizer.encode(whole, add_special_tokens=False).ids)
    for r in got:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["tokens"]
    assert seen == want
    own = [r for r in got if r["doc_id"] == 5]
    for f, text in (("title", "日本"), ("text", "語\nñ")):
        raw = text.encode()
        assert b"".join(raw[r["start"] : r["start"] + r["length"]] for r in sorted(own, key=lambda r: r["section"]) if r["field"] == f) == raw
    if section == "\n":
        assert [r["section"] for r in sorted((r for r in got if r["doc_id"] is None and r["field"] == "text"), key=lambda r: r["section"])] == [0]


def test_empty_table_and_unknown_rule(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(frame).count() == 0
    with pytest.raises(ValueError):
        C.count_tokens(frame, rule="last")

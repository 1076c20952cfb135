"""Folds over ordered rows: edits of texts, stitched segments; and links filled in."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import markup as M
from docloom.operators import analyse as A
from docloom.operators.edit import apply_edits
from docloom.operators.fold import fold_groups


def test_a_fold_carries_its_state_over_batches(spark, monkeypatch):
    monkeypatch.setattr("docloom.operators.fold.ROWS", 3)
    rows = [(k, i) for k in ("a", "b", None) for i in range(25_000 if k == "a" else 5)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    sums = fold_groups(df, "k", ["i"], lambda: (0, -1), lambda s, r: ((s[0] + r["i"], r["i"]), [] if r["i"] == s[1] + 1 else [{"k": "bad"}]), lambda k, s: [{"k": k, "total": s[0]}], "k string, total long")
    assert {r.k: r.total for r in sums.collect()} == {"a": 25_000 * 24_999 // 2, "b": 10, None: 10}
    assert fold_groups(df.limit(0), "k", ["i"], lambda: 0, lambda s, r: (s, []), lambda k, s: [{"k": k, "total": 0}], "k string, total long").count() == 0


def run_edits(spark, texts, edits, **options):
    done, errors = apply_edits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(edits, "doc_id long, seq long, old_str string, new_str string"), **options)
    return {r.doc_id: tuple(r)[1:] for r in done.collect()}, {(r.doc_id, r.seq): r.error for r in errors.collect()}


def test_edits_are_applied_in_order_or_refused(spark):
    texts = [(1, "one two one"), (2, None), (3, "x"), (3, "x"), (4, "keep"), (None, "no id")]
    edits = [
        (1, 1, "two", "<span>two</span>"), (1, 2, "one", "<span>one</span>"), (1, 3, "</span> one", "</span> <slice/>one"), (1, 4, "two", "2"),
        (1, 5, "three", "<span>three</span>"), (2, 1, "a", "<slice/>a"), (3, 1, "x", "x"), (3, 2, "", "y"), (3, 3, "x", "<slice/>x"), (9, 1, "a", "b"), (None, 1, "a", "b"),
    ]
    done, errors = run_edits(spark, texts, edits)
    assert done == {
        1: ("one <span>two</span> <slice/>one", 2, 3, "old_str must match exactly once (found 0 matches)"),
        2: ("", 0, 1, "old_str must match exactly once (found 0 matches)"), 3: ("<slice/>x", 1, 2, None), 4: ("keep", 0, 0, None),
    }
    assert errors == {
        (1, 2): "old_str must match exactly once (found 2 matches)", (1, 4): "replacements may only insert markup", (1, 5): "old_str must match exactly once (found 0 matches)",
        (2, 1): "old_str must match exactly once (found 0 matches)", (3, 1): "the replacement changes nothing", (3, 2): "old_str and new_str must not be empty", (9, 1): "there is no such document",
    }
    assert run_edits(spark, [(1, "a b")], [(1, 1, "a", "c")], insert_only=False)[0] == {1: ("c b", 1, 0, None)}
    assert run_edits(spark, [], []) == ({}, {})


def by_hand(texts):
    """Segments one after the other; (idx, text) of those that stay."""
    out = []
    for i, text in enumerate((t for t in texts if t.strip()), 1):
        text = text.strip()
        if out and text in out[-1][1]:
            continue
        if out and out[-1][1] in text:
            out[-1] = (i, text)
        else:
            out.append((i, text))
    return out


def sentences(chunk):
    return F.concat(F.lit('<span kind="s">'), F.array_join(F.split(chunk, "\\."), '.</span><span kind="s">'), F.lit("</span>"))


@pytest.mark.parametrize(("size", "overlap"), [(None, 0), (30, 10), (17, 16), (7, 0)])
def test_span_segments_equal_a_sequential_version(spark, size, overlap):
    r = random.Random(11)
    texts = ["".join(r.choice("ab ab.\n") for _ in range(r.randrange(200))) for _ in range(40)] + [None, "", " \n", "Speaker 0: me. me.\nSpeaker 1: you\nSpeaker 0: again."]
    expected = {}
    for seq, text in enumerate(texts):
        text = text or ""
        own = [x[len("Speaker 0:"):].strip() for x in text.splitlines() if x.startswith("Speaker 0:")]
        text = "\n".join(own) if own else text
        starts, at = [], 0
        while at < len(text):
            starts.append(text[at : at + size] if size else text)
            if size is None or at + size >= len(text):
                break
            at += size - overlap
        parts = [p + ("." if i + 1 < n else "") for chunk in starts for n in [len(chunk.split("."))] for i, p in enumerate(chunk.split("."))]
        for nth, (idx, found) in enumerate(by_hand(parts), 1):
            expected[seq, nth] = idx, found
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    got = {(x.seq, x.nth): (x.idx, x.text) for x in A.span_segments(df, sentences, size, overlap).collect()}
    assert got == expected


def test_labels_are_prepended_and_must_be_there(spark):
    df = spark.createDataFrame([(1, "a.b")], "seq long, text string")
    assert [x.text for x in A.span_segments(df, sentences, label="kind", prepend_label=True).orderBy("nth").collect()] == ["s\na.", "s\nb"]
    with pytest.raises(Exception, match="a span has no other"):
        A.span_segments(df, sentences, label="other", prepend_label=True).collect()
    with pytest.raises(ValueError):
        A.span_segments(df, sentences, prepend_label=True)


def links(marked):
    text = M.re.sub(M.TAG, "", marked)
    return [(s["start"], s["end"], s["attributes"]) for s in M.fill_links(text, M.parse(marked))]


def test_links_fill_every_uncovered_place():
    assert links('<span id="link_1">cat</span> catalog cat') == [(0, 3, {"id": "link_1"}), (4, 7, {"ref": "link_1"}), (12, 15, {"ref": "link_1"})]
    assert links('x aa <span id="link_1">aa</span> aaa') == [(2, 4, {"ref": "link_1"}), (5, 7, {"id": "link_1"}), (8, 10, {"ref": "link_1"})]
    # a place that another span covers, in part, is left alone
    assert links('<span id="link_1">cat</span> <span id="link_2">the cat</span> cat') == [(0, 3, {"id": "link_1"}), (4, 11, {"id": "link_2"}), (12, 15, {"ref": "link_1"})]


def test_only_a_text_without_an_id_has_its_first_ref_promoted():
    assert links('<span ref="link_1">cat</span> <span ref="link_1">cat</span>') == [(0, 3, {"id": "link_1"}), (4, 7, {"ref": "link_1"})]
    assert links('<span ref="link_1">cat</span> <span id="link_1">cat</span>') == [(0, 3, {"ref": "link_1"}), (4, 7, {"id": "link_1"})]
    assert links('<span id="link_1">cat</span> <span ref="link_2">cat</span>') == [(0, 3, {"id": "link_1"}), (4, 7, {"ref": "link_2"})]
    assert links('<span ref="x1">cat</span> cat') == [(0, 3, {"ref": "x1"})]

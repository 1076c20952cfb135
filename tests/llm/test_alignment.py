"""Token alignment against plain Python over token spans."""

import hashlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from docloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(texts):
    """Rows of every document, from spans compared one by one with two pointers and the libraries' own encoders."""
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    spelt = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    own = alignment.byte_of_symbol()

    def spans(tokens):
        at, out = 0, []
        for i, token in tokens:
            out.append((at, at + len(token), i))
            at += len(token)
        return out

    documents = {}
    for doc, text in texts.items():
        whole = (" " + text).encode() if text else b""
        a_tokens = [(i, bytes(own[c] for c in spelt[i])) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        b_tokens = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]] if text else []
        if b"".join(t for _, t in a_tokens) != whole or b"".join(t for _, t in b_tokens) != whole:
            a_tokens, b_tokens = [], []
        documents[doc] = spans(a_tokens), spans(b_tokens)
    links = {doc: [(x[2], y[2]) for x in xs for y in ys if x[0] < y[1] and y[0] < x[1]] for doc, (xs, ys) in documents.items()}
    counts = Counter(pair for own in links.values() for pair in own)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    rows = {}
    for doc, (xs, ys) in documents.items():
        groups, start = [], 0
        for end in sorted({e for _, e, _ in xs} & {e for _, e, _ in ys}):
            groups.append(",".join(str(i) for s, _, i in xs if start <= s < end) + "|" + ",".join(str(i) for s, _, i in ys if start <= s < end))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows[doc] = (doc, len(xs), len(ys), len(groups), len(links[doc]), sum(counts[p] == most[p[1]] for p in links[doc]), sum(counts[p] for p in links[doc]), digest)
    return sorted(rows.values())


TEXTS = {
    1: None, 2: "", 3: " ", 4: "Hello world, hello  world\n\ttabs", 5: "Hello world, hello  world\n\ttabs", 6: "naïve café — ☃ 𝔘nicode \U0001f600", 7: "<|endoftext|> <s> </s> <unk> <0x41>",
    8: "literal ▁ mark", 9: "\x00nul and ﻿ mark", 10: "ﬁ ligature ½ Å", 11: "don't I'll  2024-11-28 1234567890", 12: "a" * 3000, 13: " " * 700 + "x", 14: "日本語のテキスト и кириллица", 15: "end with space ", 16: "é combining",
}


def run(spark, texts):
    return sorted(tuple(r) for r in alignment.align_tokenizers(spark.createDataFrame(texts, "doc_id long, text string"), A, B).collect())


def test_equals_spans_compared_one_by_one(spark):
    assert run(spark, list(TEXTS.items())) == by_hand(TEXTS)


def test_pairs_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIR_BLOCK", 40)
    assert run(spark, list(TEXTS.items())) == by_hand(TEXTS)


def test_counts_given_out_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "COUNT_BLOCK", 5)
    a, b = alignment._sides(A, B)
    texts = [t for t in TEXTS.values() if t] * 3
    batch = next(alignment._aligned(iter([pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})]), A, B))
    total, most = Counter(), 0
    for out in alignment._count_links(iter([batch])):
        most += 1
        for key, n in zip(*[c.to_pylist() for c in out.columns], strict=True):
            total[key] += n
    assert most > 1
    assert sum(total.values()) == sum(batch.column("n_links").to_pylist())
    assert total == Counter(int(k) for packed in batch.column("pairs").to_pylist() for k in alignment._keys(packed))


def test_long_repeated_missing_and_clashing_rows(spark):
    long = "The quick brown fox. " * 20_000
    rows = [(1, long, 7), (1, long, 8), (None, "no id", 9), (2, None, 1)]
    found = alignment.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string, pairs int").withColumn("n_best", F.lit("x")), A, B).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 2]
    one, two = [r for r in found if r.doc_id == 1]
    assert one == two and one.n_links > 100_000 and one.groups_sha256
    assert tuple(next(r for r in found if r.doc_id == 2)) == (2, 0, 0, 0, 0, 0, 0, "")


def test_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0

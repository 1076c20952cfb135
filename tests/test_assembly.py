"""Contexts assembled as data against one context at a time in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import assembly as X

CONTEXT = "context_id string, max_tokens long, overflow string, max_rounds int, pack_tokens long, system string, user string"
PACK = "context_id string, position int, priority int, weight double, child string, query_id string, limit int, offset int, max_characters long"
EVIDENCE = "query_id string, item_id string, score double, characters long, tokens long"


def share_by_hand(entries, total):
    if total is None:
        return [None] * len(entries)
    order = sorted(range(len(entries)), key=lambda i: (-(entries[i][2] or 0), -(entries[i][3] if entries[i][3] is not None else 1.0), entries[i][1]))
    whole, left, out = sum(e[3] if e[3] is not None else 1.0 for e in entries), total, [0] * len(entries)
    for i in order:
        out[i] = min(left, max(1, int(total * (entries[i][3] if entries[i][3] is not None else 1.0) / whole)))
        left -= out[i]
    if order:
        out[order[0]] += left
    return out


def pack_by_hand(p, tokens, found, tight):
    limit, offset, chars = p[6], p[7] or 0, p[8]
    if tokens is not None:
        chars = 4 * tokens if chars is None else min(chars, 4 * tokens)
    if tight:
        limit, chars = max(1, limit // 2), None if chars is None else max(1, chars // 2)
    taken, used = [], 0
    for _, item, score, n, t in sorted((e for e in found if e[0] == p[5]), key=lambda e: (-e[2], e[1]))[offset:]:
        if len(taken) < limit and (chars is None or used + n <= chars):
            taken.append((item, t))
            used += n
    out, so_far = [], 0
    for item, t in taken:
        so_far += t
        if tokens is not None and so_far > tokens:
            break
        out.append(item)
    return out


def items_by_hand(context_id, total, contexts, packs, found, tight):
    entries = sorted((p for p in packs if p[0] == context_id), key=lambda p: p[1])
    out = []
    for p, tokens in zip(entries, share_by_hand(entries, total)):
        if p[4] is None:
            out += pack_by_hand(p, tokens, found, tight)
        else:
            own = next(c for c in contexts if c[0] == p[4])[4]
            out += items_by_hand(p[4], min((x for x in (own, tokens) if x is not None), default=None), contexts, packs, found, tight)
    return out


def by_hand(contexts, packs, found, history, texts):
    count, result = lambda t: len((t or "").split()), {}
    for context_id, most, overflow, rounds, pack_tokens, system, user in contexts:
        said = sorted((h for h in history if h[0] == context_id), key=lambda h: h[1])
        for i in range(max(1, rounds if rounds is not None else 2)):
            total = None if pack_tokens is None else max(1, int(pack_tokens * 0.5**i))
            blocks = [texts[x].strip() for x in items_by_hand(context_id, total, contexts, packs, found, i > 0)]
            prompt = "\n\n".join(x for x in [system, *blocks] if x)
            compacted = False
            n = lambda: count(prompt) + count(user) + sum(count(h[2]) for h in said)  # noqa: B023, E731
            if most is not None and n() > most and overflow == "compact":
                compacted = True
                while said and n() > most:
                    said.pop(0)
                if n() > most:
                    prompt = " ".join(prompt.split()[: max(0, most - count(user))])
            result[context_id] = (i + 1, prompt, len(said), n(), compacted)
            if not compacted:
                break
    return result


def make(seed):
    r = random.Random(seed)
    texts = {f"i{k:03}": " ".join("w" * r.randrange(1, 9) for _ in range(r.choice([0, 3, 10, 40, 200]))) for k in range(150)}
    found = [(q, k, float(r.randrange(6)), len(t), len(t.split())) for q in ("q1", "q2", "q3") for k, t in texts.items() if r.random() < 0.8]
    contexts, packs, history = [], [], []
    for i in range(40):
        c = f"c{i:02}"
        contexts.append((c, r.choice([None, 0, 20, 80, 200, 5000]), r.choice(["compact", "compact", "error", None]), r.choice([None, 1, 2, 3, 4]), r.choice([None, 1, 2, 30, 150, 900]), r.choice(["", None, "be brief"]), r.choice(["", "what is it", "x " * 30])))
        for p in range(r.randrange(4)):
            child = r.choice([None, None, f"n{r.randrange(3)}"])
            packs.append((c, p, r.choice([None, 0, 5]), r.choice([None, 0.5, 1.0, 3.0]), child, None if child else r.choice(["q1", "q2", "q3", "q9"]), r.randrange(1, 9), r.choice([None, 0, 2]), r.choice([None, 50, 2000])))
        history += [(c, t, "m " * r.randrange(30)) for t in range(r.randrange(6))]
    for k in range(3):
        contexts.append((f"n{k}", None, None, None, (None, 10, 100)[k], "", ""))
        packs += [(f"n{k}", p, 0, 1.0 + p, None if p or k == 2 else f"n{k + 1}", "q1" if p or k == 2 else None, 5, 0, None) for p in range(2)]
    return contexts, packs, found, history, texts


def run(spark, contexts, packs, found, history, texts):
    df = spark.createDataFrame
    got = X.assemble_contexts(df(contexts, CONTEXT), df(packs, PACK), df(found, EVIDENCE), df(history, "context_id string, turn int, text string"), df(list(texts.items()), "item_id string, text string"))
    rows = got.collect()
    assert len(rows) == len(contexts)
    return {r.context_id: (r.rounds, r.prompt, r.n_history, r.token_count, r.compacted) for r in rows}


def test_equals_one_context_at_a_time(spark):
    given = make(5)
    expected = by_hand(*given)
    found = run(spark, *given)
    assert {k: v for k, v in found.items() if v != expected[k]} == {}
    assert len({v[0] for v in expected.values()}) >= 3 and any(v[4] for v in expected.values())


def test_an_outer_pack_caps_what_is_in_it(spark):
    contexts = [("outer", None, None, None, 12, "", ""), ("inner", None, None, None, 500, "", "")]
    packs = [("outer", 0, 0, 1.0, "inner", None, 0, 0, None), ("inner", 0, 0, 1.0, None, "q", 9, 0, None)]
    df = spark.createDataFrame
    roots = df([("outer", 1.0), ("inner", 1.0)], "root string, scale double")
    leaves = {r.root: (r.path, r.tokens) for r in X.leaf_packs(df(contexts, CONTEXT).select("context_id", "pack_tokens"), df(packs, PACK), roots).collect()}
    assert leaves == {"outer": ([0, 0], 12), "inner": ([0], 500)}
    circle = [("outer", 0, 0, 1.0, "inner", None, 0, 0, None), ("inner", 0, 0, 1.0, "outer", None, 0, 0, None)]
    with pytest.raises(ValueError, match="circle"):
        X.leaf_packs(df(contexts, CONTEXT).select("context_id", "pack_tokens"), df(circle, PACK), roots)


def test_contexts_without_packs_history_or_rows(spark):
    assert run(spark, [("a", 1, "compact", 1, None, "one two", None)], [], [], [], {}) == {"a": (1, "one", 0, 1, True)}
    df = spark.createDataFrame
    assert X.assemble_contexts(df([], CONTEXT), df([], PACK), df([], EVIDENCE), df([], "context_id string, turn int, text string"), df([], "item_id string, text string")).count() == 0


def test_pages_stop_where_each_query_has_enough(spark):
    r = random.Random(2)
    ranked = [(f"q{q}", k + 1, f"i{k}", r.randrange(1, 30)) for q in range(20) for k in range(r.choice([0, 2, 7, 40]))]
    requests = [(f"q{q}", r.choice([1, 3, 5]), r.choice([None, 1, 4, 9]), r.choice([None, 1, 60, 10_000]), r.choice([None, 0.5, 0.9])) for q in range(20)]
    expected = set()
    for q, limit, pages, target, ratio in requests:
        own, tokens = sorted((x for x in ranked if x[0] == q), key=lambda x: x[1]), 0
        for p in range(max(1, pages if pages is not None else 1)):
            page = own[p * limit : (p + 1) * limit]
            expected |= {(q, p, x[1], x[2]) for x in page}
            tokens += sum(x[3] for x in page)
            if target is None or len(page) < limit or tokens >= int(target * (1.0 if ratio is None else ratio)):
                break
    df = spark.createDataFrame(ranked, "query_id string, rank int, item_id string, tokens long"), spark.createDataFrame(requests, "query_id string, limit int, max_pages int, target_tokens long, ratio double")
    assert {tuple(x) for x in X.expand_pages(*df).collect()} == expected
    assert X.expand_pages(df[0].limit(0), df[1]).count() == 0


def test_shares_of_a_budget(spark):
    entries = [("a", 0, 0, 1.0), ("a", 1, 5, 2.0), ("a", 2, None, None), ("b", 0, 0, 1.0), ("b", 1, 0, 1.0), ("b", 2, 0, 1.0)]
    df = spark.createDataFrame(entries, "owner string, position int, priority int, weight double")
    got = {(r.owner, r.position): r.tokens for r in X.share_out(df, F.when(F.col("owner") == "a", 101).otherwise(2)).collect()}
    assert got == {("a", 0): 25, ("a", 1): 51, ("a", 2): 25, ("b", 0): 1, ("b", 1): 1, ("b", 2): 0}

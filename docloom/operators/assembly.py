"""Contexts assembled as data: budgets shared out, packs retrieved under them, and what is too large made again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fold import fold_groups
from .lineage import cut
from .rank import _useful

#: Packs in packs in packs: more levels than these are taken for a circle.
DEPTH = 16


def share_out(entries: DataFrame, total: Column) -> DataFrame:
    """Entries (owner, position, priority, weight, ...) with ``tokens``: their shares of each owner's ``total``.

    In order of priority and weight, the higher first, then position, each gets its part by weight, rounded down, but 1 at
    least while any is left; what remains goes to the first. A null total leaves tokens null. An owner's entries are few.
    """
    order = Window.partitionBy("owner").orderBy(F.desc(F.coalesce("priority", F.lit(0))), F.desc(F.coalesce("weight", F.lit(1.0))), "position")
    whole = Window.partitionBy("owner")
    weight = F.coalesce("weight", F.lit(1.0))
    df = entries.withColumn("_total", total.cast("long"))
    df = df.withColumn("_part", F.greatest(F.lit(1), F.floor(F.col("_total") * weight / F.sum(weight).over(whole)))).withColumn("_nth", F.row_number().over(order))
    df = df.withColumn("_before", F.sum("_part").over(order) - F.col("_part"))
    df = df.withColumn("tokens", F.greatest(F.lit(0), F.least("_part", F.col("_total") - F.col("_before"))))
    rest = F.col("_total") - F.sum("tokens").over(whole)
    return df.withColumn("tokens", F.when(F.col("_total").isNotNull(), F.col("tokens") + F.when(F.col("_nth") == 1, rest).otherwise(0)).cast("long")).drop("_total", "_part", "_nth", "_before")


def leaf_packs(contexts: DataFrame, packs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, query_id, limit, offset, max_characters, tokens): the retrievals that roots (root, scale) are made of.

    contexts (context_id, pack_tokens): what all packs of a context may hold, null for no bound; packs (context_id,
    position, priority, weight, child, query_id, limit, offset, max_characters): a retrieval, or with ``child`` another
    context. A root's bound is scaled, and a child gets what its place allots, or its own bound if that is less, so an
    outer pack caps all that is in it. path orders the retrievals. Levels are gone through one by one.
    """
    level = roots.join(contexts, F.col("root") == F.col("context_id")).select("root", F.array().cast("array<int>").alias("path"), "context_id", F.when(F.col("pack_tokens").isNotNull(), F.greatest(F.lit(1), F.floor(F.col("pack_tokens") * F.col("scale")))).alias("total"))
    found = []
    for _ in range(DEPTH):
        own = level.join(packs, "context_id").withColumn("owner", F.struct("root", "path"))
        shared = cut(share_out(own, F.col("total")).withColumn("path", F.concat("path", F.array(F.col("position").cast("int")))))
        found.append(shared.where("child is null").select("root", "path", "query_id", "limit", "offset", "max_characters", "tokens"))
        inner = shared.where("child is not null").select("root", "path", F.col("child").alias("context_id"), F.col("tokens").alias("outer"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = inner.join(contexts, "context_id").select("root", "path", "context_id", F.least("outer", "pack_tokens").alias("total"))  # least() passes over nulls
    raise ValueError("packs are nested in a circle, or too deep")


def useful_evidence(evidence: DataFrame, packs: DataFrame) -> DataFrame:
    """Rows of evidence (query_id, item_id, score, characters, tokens) that some pack's limit can reach; see ``rank.fit_budget``."""
    most = packs.agg(F.coalesce(F.max(F.coalesce("limit", F.lit(1)) + F.coalesce("offset", F.lit(0))), F.lit(1))).first()[0]
    at = F.struct((-F.col("score")).alias("less"), "item_id", "tokens")
    rows = evidence.select("query_id", at.alias("at"), F.col("item_id").alias("source"), F.coalesce("characters", F.lit(0)).cast("long").alias("characters"))
    return cut(_useful(rows, int(most), None, 0).select("query_id", "at.less", "at.item_id", "at.tokens", "characters"))


def fill_packs(leaves: DataFrame, useful: DataFrame) -> DataFrame:
    """(root, path, nth, query_id, item_id, tokens): what each retrieval takes, in order of score.

    After its offset, up to its limit, an item is taken if the characters left allow it, else skipped; characters are bound
    by max_characters and by four for each token. Of what is taken, blocks stay while their tokens fit together.
    """
    rows = leaves.join(useful.withColumnRenamed("tokens", "size"), "query_id").withColumn("own", F.struct("root", "path"))

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        met, taken, chars, tokens, open_ = state
        fits = met >= (row["offset"] or 0) and taken < row["limit"] and (row["max_characters"] is None or chars + row["characters"] <= row["max_characters"])
        if not fits:
            return (met + 1, taken, chars, tokens, open_), []
        tokens += row["size"]
        open_ = open_ and (row["tokens"] is None or tokens <= row["tokens"])
        out = {"root": row["own"]["root"], "path": row["own"]["path"], "nth": taken + 1, "query_id": row["query_id"], "item_id": row["item_id"], "tokens": row["size"]}
        return (met + 1, taken + 1, chars + row["characters"], tokens, open_), [out] if open_ else []

    kinds = dict(rows.dtypes)
    schema = f"root {kinds['root']}, path array<int>, nth int, query_id {kinds['query_id']}, item_id {kinds['item_id']}, tokens long"
    return fold_groups(rows, "own", ["less", "item_id"], lambda: (0, 0, 0, 0, True), step, lambda *_: [], schema)


def _tightened(leaves: DataFrame, tight: bool) -> DataFrame:
    """Characters bound by tokens too; and half of these and of the items, one at least, where packs are made again."""
    characters = F.least("max_characters", F.col("tokens") * 4)
    if not tight:
        return leaves.withColumn("max_characters", characters)
    half = lambda c: F.greatest(F.lit(1), F.floor(c / 2))
    return leaves.withColumn("max_characters", F.when(characters.isNotNull(), half(characters))).withColumn("limit", half(F.col("limit")).cast("int"))


def assemble_contexts(contexts: DataFrame, packs: DataFrame, evidence: DataFrame, history: DataFrame, items: DataFrame) -> DataFrame:
    """(context_id, rounds, prompt, n_history, token_count, compacted) of contexts (context_id, max_tokens, overflow,
    max_rounds, pack_tokens, system, user).

    A context's prompt is its system text and the texts of its packs (see ``leaf_packs`` and ``fill_packs``), joined by
    blank lines; with the history (context_id, turn, text) and the user's text it may have ``max_tokens`` (null: any
    number). If it has more and overflow is "compact", the oldest messages go until it fits, and if that isn't enough the
    prompt is cut to the tokens left; then the context is made again with half of its packs' bounds, and of what is left of
    its history, up to ``max_rounds`` rounds (null: 2). Each round makes only contexts that the one before had to compact,
    so one large context makes no other smaller.

    evidence (query_id, item_id, score, characters, tokens) is ranked by score and item_id; items (item_id, text) are
    joined to what is in the end taken. Evidence whose text is blank takes its place in a limit and adds nothing. A
    context without packs or history is its own texts; null texts are empty. Contexts must have different ids.
    """
    size = lambda c: T.token_count(F.coalesce(c, F.lit(""))).cast("long")
    useful = useful_evidence(evidence, packs)
    from_end = Window.partitionBy("context_id").orderBy(F.desc("turn"))
    said = cut(history.select("context_id", "turn", size(F.col("text")).alias("n")).withColumn("nth", F.row_number().over(from_end)).withColumn("upto", F.sum("n").over(from_end.rowsBetween(Window.unboundedPreceding, 0))))
    open_ = cut(contexts.select("context_id", "max_tokens", "overflow", F.greatest(F.lit(1), F.coalesce("max_rounds", F.lit(2))).alias("max_rounds"), size(F.col("system")).alias("head"), size(F.col("user")).alias("tail"), F.lit(None).cast("long").alias("kept")))
    bounds = contexts.select("context_id", "pack_tokens")
    done, taken, i = [], [], 0
    while True:
        roots = open_.select(F.col("context_id").alias("root"), F.lit(0.5**i).alias("scale"))
        picked = cut(fill_packs(_tightened(leaf_packs(bounds, packs, roots), i > 0), useful))
        filled = picked.groupBy(F.col("root").alias("context_id")).agg(F.sum("tokens").alias("filled"))
        both = open_.join(filled, "context_id", "left").withColumn("prompt_tokens", F.col("head") + F.coalesce("filled", F.lit(0)))
        room = F.col("max_tokens") - F.col("prompt_tokens") - F.col("tail")
        now = F.col("kept").isNull() | (F.col("nth") <= F.col("kept"))
        sums = both.join(said, "context_id", "left").groupBy(*both.columns).agg(
            F.coalesce(F.max(F.when(now, F.col("nth"))), F.lit(0)).cast("long").alias("now"), F.coalesce(F.max(F.when(now, F.col("upto"))), F.lit(0)).alias("now_tokens"),
            F.coalesce(F.max(F.when(now & (F.col("upto") <= room), F.col("nth"))), F.lit(0)).cast("long").alias("fit"), F.coalesce(F.max(F.when(now & (F.col("upto") <= room), F.col("upto"))), F.lit(0)).alias("fit_tokens"),
        )
        total = F.col("prompt_tokens") + F.col("tail") + F.col("now_tokens")
        large = F.coalesce((total > F.col("max_tokens")) & (F.col("overflow") == "compact"), F.lit(False))
        left = F.greatest(F.lit(0), F.col("max_tokens") - F.col("tail"))
        cut_to = F.when(large & (room < 0), left)
        made = cut(sums.withColumn("compacted", large).withColumn("total", total).withColumn("cut_to", cut_to).withColumn("kept", F.when(large, F.col("fit")).otherwise(F.col("now"))).withColumn("rounds", F.lit(i + 1)))
        tokens = F.when(F.col("cut_to").isNotNull(), F.least("cut_to", "prompt_tokens") + F.col("tail")).when(F.col("compacted"), F.col("prompt_tokens") + F.col("tail") + F.col("fit_tokens")).otherwise(F.col("total"))
        ends = ~F.col("compacted") | (F.col("rounds") >= F.col("max_rounds"))
        done.append(made.where(ends).select("context_id", "rounds", "cut_to", F.col("kept").alias("n_history"), tokens.alias("token_count"), "compacted"))
        taken.append(picked.withColumn("rounds", F.lit(i + 1)))
        open_ = made.where(~ends).select("context_id", "max_tokens", "overflow", "max_rounds", "head", "tail", "kept")
        i += 1
        if open_.isEmpty():
            break
    results, picks = reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, taken)
    own = picks.join(results.select(F.col("context_id").alias("root"), "rounds"), ["root", "rounds"], "left_semi")
    texts = own.join(items.select("item_id", T.strip(F.coalesce("text", F.lit(""))).alias("text")), "item_id").where("text <> ''")
    blocks = texts.groupBy(F.col("root").alias("context_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "nth", "text"))), lambda x: x.text), "\n\n").alias("blocks"))  # what one model reads
    whole = results.join(contexts.select("context_id", "system"), "context_id").join(blocks, "context_id", "left")
    prompt = F.concat_ws("\n\n", F.nullif(F.col("system"), F.lit("")), "blocks")
    prompt = F.when(F.col("cut_to") < T.token_count(prompt), T.truncate_tokens(prompt, F.col("cut_to"))).otherwise(prompt)
    return whole.select("context_id", "rounds", prompt.alias("prompt"), "n_history", "token_count", "compacted")


def expand_pages(ranked: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, page, rank, item_id) of ranked evidence (query_id, rank, item_id, tokens), for requests (query_id, limit,
    max_pages, target_tokens, ratio): pages of ``limit`` until the tokens so far reach ``ratio`` of the target, a page comes
    short, or ``max_pages`` are in. Without a target there is one page.

    All queries are decided at once, from each page's count and tokens and their running sums, so nothing is fetched page
    by page. rank must be 1, 2, ...; only ranks that the pages can reach take part.
    """
    page = F.floor((F.col("rank") - 1) / F.col("limit")).cast("int")
    near = ranked.join(requests, "query_id").withColumn("page", page).where((F.col("page") < F.greatest(F.lit(1), F.coalesce("max_pages", F.lit(1)))) & ((F.col("page") == 0) | F.col("target_tokens").isNotNull()))
    near = cut(near.select("query_id", "page", "rank", "item_id", "tokens", "limit", F.floor(F.col("target_tokens") * F.coalesce("ratio", F.lit(1.0))).alias("enough")))
    sums = near.groupBy("query_id", "page", "limit", "enough").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    so_far = F.sum("t").over(Window.partitionBy("query_id").orderBy("page"))
    stop = sums.withColumn("ends", (F.col("n") < F.col("limit")) | (so_far >= F.col("enough"))).where("ends").groupBy("query_id").agg(F.min("page").alias("last"))
    return near.join(stop, "query_id", "left").where("last is null or page <= last").select("query_id", "page", "rank", "item_id")


__all__ = ["assemble_contexts", "expand_pages", "fill_packs", "leaf_packs", "share_out", "useful_evidence"]

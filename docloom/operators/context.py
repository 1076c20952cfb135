"""Context packs under budgets, chat history eviction and weighted allocation of token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Metadata fields that head a block, in this order.
HEAD_FIELDS = ("item_id", "source_uri", "score", "stage")


def metadata_header(fields: dict[str, Column]) -> Column:
    """"name: value" lines of the fixed fields, then of all others by name; nulls are left out."""
    order = [f for f in HEAD_FIELDS if f in fields] + sorted(set(fields) - set(HEAD_FIELDS))
    return F.array_join(F.filter(F.array(*[F.concat(F.lit(f"{n}: "), fields[n].cast("string")) for n in order]), lambda x: x.isNotNull()), "\n")


def blocks(evidence: DataFrame, order: str = "rank", header: Column | None = None) -> DataFrame:
    """(query_id, position, block): trimmed texts in order of rank, score or source; blank ones go."""
    keys = {"rank": ["rank"], "score": [F.col("score").desc(), "item_id"], "source": ["source_uri", "rank"]}[order]
    text = T.strip(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("query_id").orderBy(*keys)
    block = text if header is None else F.concat(header, F.lit("\n"), text)
    return evidence.where(text != "").select("query_id", F.row_number().over(w).alias("position"), block.alias("block"))


def fit_tokens(packed: DataFrame, most: int) -> DataFrame:
    """The first blocks whose tokens fit together; the trailing rest goes, all of it if need be."""
    return _prefix(packed, T.token_count(F.col("block")), F.lit(0), most)


def fit_characters(packed: DataFrame, most: int, join_with: str = "\n\n") -> DataFrame:
    """The first blocks whose joined text fits."""
    return _prefix(packed, F.length("block"), F.lit(len(join_with)), most)


def _prefix(packed: DataFrame, size: Column, gap: Column, most: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return packed.withColumn("used", F.sum(size).over(w) + gap * (F.col("position") - 1)).where(F.col("used") <= most).drop("used")


def join_blocks(packed: DataFrame, join_with: str = "\n\n") -> DataFrame:
    """(query_id, n_blocks, text): one pack for each query; blocks were held to a budget before."""
    listed = F.array_sort(F.collect_list(F.struct("position", "block")))
    return packed.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(listed, lambda x: x.block), join_with).alias("text"))


def evict_history(messages: DataFrame, most: int) -> DataFrame:
    """Messages (conv_id, turn, text) of each conversation that fit into ``most`` tokens, the oldest gone first.

    A conversation's messages are summed from its end; a chat is as long as what one model reads, so that is small.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("used", F.sum(T.token_count(F.col("text"))).over(w)).where(F.col("used") <= most).drop("used")


def allocate(weights: list[tuple[str, int, float]], total: int) -> dict[str, int]:
    """Shares of ``total`` for (name, priority, weight), higher priority and weight first: by weight, rounded down, 1 at
    least while any is left; what remains goes to the first."""
    order = sorted(weights, key=lambda x: (-x[1], -x[2]))
    whole, left, out = sum(w for _, _, w in weights), total, {}
    for name, _, weight in order:
        share = min(left, max(1, int(total * weight / whole))) if whole > 0 else 0
        out[name], left = share, left - share
    if order and left > 0:
        out[order[0][0]] += left
    return out


def expand(fetch, most_tokens: int, ratio: float, page: int, most_pages: int) -> DataFrame:
    """Pages of evidence, fetched by (offset, limit), until the tokens reach ``ratio`` of the budget, a page comes short
    or ``most_pages`` are in. Only a page's counts reach the driver."""
    out, tokens = None, 0
    for k in range(most_pages):
        got = fetch(k * page, page)
        n, t = got.agg(F.count("*"), F.coalesce(F.sum(T.token_count(F.col("text"))), F.lit(0))).first()
        out = got if out is None else out.unionByName(got)
        tokens += t
        if n < page or tokens >= ratio * most_tokens:
            break
    return out


def render(template: str, values: dict) -> str:
    """A template with ``{dotted.names}`` filled from nested values."""
    import re

    def look(m: re.Match) -> str:
        value = values
        for part in m.group(1).split("."):
            if not isinstance(value, dict) or part not in value:
                raise KeyError(m.group(1))
            value = value[part]
        return str(value)

    return re.sub(r"\{([A-Za-z_][\w.]*)\}", look, template)


def assemble(build, most_tokens: int, most_rounds: int = 2) -> tuple[DataFrame, int]:
    """(packs, tokens) of ``build(scale)`` at scale 1, 1/2, 1/4, ... until the largest pack fits or the rounds are over."""
    scale = 1.0
    for _ in range(max(1, most_rounds)):
        packs = build(scale)
        tokens = packs.agg(F.coalesce(F.max(T.token_count(F.col("text"))), F.lit(0))).first()[0]
        if tokens <= most_tokens:
            break
        scale /= 2
    return packs, tokens

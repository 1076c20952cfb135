"""What has to be built before a query, from a manifest of what exists: load, extract, index, query."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, rank, retrieve


def configuration_id(kind: str, configuration: dict) -> str:
    """sha256 of the kind and its configuration as canonical JSON."""
    return hashlib.sha256(f"{kind}:{json.dumps(configuration, sort_keys=True, separators=(',', ':'))}".encode()).hexdigest()


def with_overrides(configuration: dict, overrides: list[str]) -> dict:
    """A copy with ``dotted.name=value`` set; values are JSON where they can be, else text."""
    out = json.loads(json.dumps(configuration))
    for item in overrides:
        name, _, value = item.partition("=")
        *path, last = name.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


@dataclass
class Task:
    name: str
    needs: tuple[str, ...]
    snapshot_id: str
    build: Callable[[], None]
    status: str = field(default="pending")


@dataclass
class Plan:
    """Tasks in order of need; one is complete if the manifest has its id for the present catalog."""

    tasks: list[Task]

    def pending(self, manifest: set[str]) -> list[Task]:
        for t in self.tasks:
            t.status = "complete" if t.snapshot_id in manifest else "pending"
        return [t for t in self.tasks if t.status == "pending"]

    def run(self, manifest: set[str], mode: str = "auto", ask: Callable[[Task], bool] = lambda _: False) -> list[str]:
        """Build what is pending; ``prompt`` asks for each task, ``dry_run`` builds nothing. Names of the tasks met."""
        if mode not in ("auto", "prompt", "dry_run"):
            raise ValueError(f"unknown mode: {mode}")
        met = []
        for t in self.pending(manifest):
            if mode == "prompt" and not ask(t):
                t.status = "declined"
                break
            met.append(t.name)
            if mode != "dry_run":
                t.build()
                manifest.add(t.snapshot_id)
                t.status = "complete"
        return met


class KnowledgeBase:
    """Items, a scan over them and a pack of what it finds."""

    def __init__(self, items: DataFrame, most_items: int = 5, most_characters: int = 2000) -> None:
        self.items = items
        self.budget = rank.QueryBudget(most_items, maximum_total_characters=most_characters)

    def query(self, spark: SparkSession, text: str) -> DataFrame:
        asked = spark.createDataFrame([("q", text)], "query_id string, query_text string")
        found = retrieve.scan(self.items, asked).select("query_id", "item_id", "source_uri", "score", F.length("text").alias("characters"))
        return rank.fit_budget(found, self.budget).join(self.items, "item_id")

    def pack(self, spark: SparkSession, text: str, most_tokens: int) -> DataFrame:
        return context.join_blocks(context.fit_tokens(context.blocks(self.query(spark, text)), most_tokens))


@dataclass(frozen=True)
class PackRequest:
    """What a context pack of retrieved evidence may hold. Characters are four for each token if only tokens are given."""

    max_items: int = 3
    offset: int = 0
    max_tokens: int | None = None
    maximum_total_characters: int | None = None
    max_items_per_source: int | None = None

    def budget(self) -> rank.QueryBudget:
        chars = self.maximum_total_characters
        if chars is None and self.max_tokens is not None:
            chars = 4 * self.max_tokens
        return rank.QueryBudget(self.max_items, self.offset, chars, self.max_items_per_source)

    def tightened(self, share: float = 0.5) -> PackRequest:
        """The same with a share of the tokens and characters, one at least; items stay."""
        less = lambda n: None if n is None else max(1, int(n * share))
        return replace(self, max_tokens=less(self.max_tokens), maximum_total_characters=less(self.maximum_total_characters))


def retrieve_pack(scored: DataFrame, items: DataFrame, request: PackRequest, header: Column | None = None) -> DataFrame:
    """(query_id, n_blocks, text): a pack for each query from a snapshot's scores (query_id, item_id, score).

    Lengths alone take part in the budget; texts are joined to what is kept, and the pack is then cut to the tokens.
    Queries whose evidence doesn't fit have no row.
    """
    sized = scored.join(items.select("item_id", "source_uri", F.length("text").alias("characters")), "item_id")
    kept = rank.fit_budget(sized, request.budget())
    packed = context.blocks(kept.join(items.select("item_id", "source_uri", "text"), "item_id"), header=header)
    return context.join_blocks(packed if request.max_tokens is None else context.fit_tokens(packed, request.max_tokens))


def render_pack(scored: DataFrame, items: DataFrame, request: PackRequest, most_tokens: int, tighten: bool = True, most_rounds: int = 4) -> tuple[DataFrame, PackRequest]:
    """(pack, request it was made by): where the largest pack has more than ``most_tokens`` the request is tightened by
    half, as often as ``most_rounds`` allow; without limits of its own it first gets the budget's tokens."""
    if request.max_tokens is None and request.maximum_total_characters is None:
        request = replace(request, max_tokens=most_tokens)
    for _ in range(max(1, most_rounds)):
        pack = retrieve_pack(scored, items, request)
        tokens = pack.agg(F.coalesce(F.max(T.token_count(F.col("text"))), F.lit(0))).first()[0]
        if tokens <= most_tokens or not tighten:
            break
        request = request.tightened()
    return pack, request


__all__ = ["KnowledgeBase", "PackRequest", "Plan", "Task", "configuration_id", "render_pack", "retrieve_pack", "with_overrides"]

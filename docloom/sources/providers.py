"""What outside models and services must offer, how their calls run in tasks, and deterministic stand-ins.

None of these was run against a real service or model: there is no network here and the libraries are absent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import strip


class EmbeddingProvider(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class ChatProvider(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class RecognitionProvider(Protocol):
    """Optical or speech recognition: words with confidences of one item's bytes."""

    def recognise(self, content: bytes, media_type: str) -> list[tuple[str, float]]: ...


class SpeechProvider(Protocol):
    """Speech recognition: segments of one item's bytes, each with the probability that nothing is said in it."""

    def transcribe(self, content: bytes, media_type: str) -> list[tuple[str, float]]: ...


class LanguageProvider(Protocol):
    """Named entities (text, kind, start, end) and subject-verb-object relations of a text."""

    def entities(self, text: str) -> list[tuple[str, str, int, int]]: ...

    def relations(self, text: str) -> list[tuple[str, str, str]]: ...


class HashEmbedding:
    """Stand-in: unit vectors from sha256."""

    def __init__(self, dimensions: int, seed: str = "fixture") -> None:
        self.dimensions, self.seed = dimensions, seed

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{self.seed}:{i}:{t}".encode()).digest() for i in range(-(-self.dimensions // 32)))
            v = [b / 255 * 2 - 1 for b in raw[: self.dimensions]]
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


class EchoChat:
    """Stand-in: the user's text as a JSON list of its sentences."""

    def complete(self, system: str, user: str) -> str:
        return json.dumps([s.strip() for s in user.split(". ") if s.strip()])


class FixedRecognition:
    """Stand-in: the words of the content itself, all of one confidence."""

    def recognise(self, content: bytes, media_type: str) -> list[tuple[str, float]]:
        return [(w, 0.9) for w in content.decode("utf-8", "replace").split()]


class LineSpeech:
    """Stand-in: the lines of the content itself; nothing is said in blank ones."""

    def transcribe(self, content: bytes, media_type: str) -> list[tuple[str, float]]:
        return [(line, 0.1 if line.strip() else 0.9) for line in content.decode("utf-8", "replace").split("\n")]


class CapitalWords:
    """Stand-in: entities are runs of capitalised ASCII words, names where there are several; the subject of a relation is
    such a word, its verb and object are the two words of small letters after it."""

    def entities(self, text: str) -> list[tuple[str, str, int, int]]:
        return [(m[0], "NAME" if " " in m[0] else "WORD", m.start(), m.end()) for m in re.finditer("[A-Z][a-z]+(?: [A-Z][a-z]+)*", text)]

    def relations(self, text: str) -> list[tuple[str, str, str]]:
        return re.findall("([A-Z][a-z]+) ([a-z]+) ([a-z]+)", text)


def embed(df: DataFrame, provider: EmbeddingProvider, batch: int = 64) -> DataFrame:
    """Rows of (key, text) with their embedding, asked for in batches inside tasks, order kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(pdf), batch):
                vectors += provider.embed(list(pdf.text[at : at + batch].fillna("")))
            yield pdf[["key"]].assign(embedding=vectors)

    return df.select("key", "text").mapInPandas(run, f"key {df.schema['key'].dataType.simpleString()}, embedding array<float>")


def complete(text: Column, provider: ChatProvider, system: str, template: str = "{text}") -> Column:
    """A model's answer to every text."""

    @F.pandas_udf(StringType())
    def ask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else provider.complete(system, template.format(text=t)))

    return ask(text)


def recognise(content: Column, media_type: Column, provider: RecognitionProvider, kinds: str) -> Column:
    """Words (text, confidence) of items whose media type starts with ``kinds`` (audio/, image/); null for others."""

    @F.pandas_udf("array<struct<text:string,confidence:double>>")
    def ask(contents: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([[{"text": w, "confidence": c} for w, c in provider.recognise(x, t)] if x is not None and t and t.startswith(kinds) else None for x, t in zip(contents, types, strict=True)])

    return ask(content, media_type)


def transcribed(content: Column, media_type: Column, provider: SpeechProvider, least_silence: float | None = None) -> Column:
    """Stripped transcripts of audio items; null for others. Segments are joined by spaces. With ``least_silence`` a
    transcript is empty if some segment's probability that nothing is said reaches it."""

    @F.pandas_udf("array<struct<text:string,silence:double>>")
    def ask(contents: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([[{"text": s, "silence": p} for s, p in provider.transcribe(x, t)] if x is not None and t and t.startswith("audio/") else None for x, t in zip(contents, types, strict=True)])

    heard = ask(content, media_type)
    said = strip(F.array_join(F.transform(heard, lambda s: s.text), " "))
    if least_silence is None:
        return said
    return F.when(F.exists(heard, lambda s: s.silence >= least_silence), "").otherwise(said)


def analysed(text: Column, provider: LanguageProvider) -> Column:
    """(entities, relations) of every text; null for null ones."""

    @F.udf("struct<entities:array<struct<text:string,kind:string,start:int,end:int>>,relations:array<struct<subject:string,verb:string,object:string>>>", useArrow=False)  # a hundred rows at a time
    def ask(text: str | None) -> tuple:
        return (None, None) if text is None else ([tuple(e) for e in provider.entities(text)], [tuple(r) for r in provider.relations(text)])

    return ask(text)


def edited(text: str, provider: ChatProvider, system: str, strip: Callable[[str], str], most_tries: int = 3) -> str:
    """Marked-up text from a model that may only add tags: an answer that changes anything else is asked for again."""
    for _ in range(most_tries):
        answer = provider.complete(system, text)
        if strip(answer) == text:
            return answer
    raise ValueError("the model changed the text itself")

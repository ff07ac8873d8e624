"""Stand-ins for model services: deterministic and offline. Results of theirs say so; the quality of a model is not claimed."""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.spans import matches

STUB = "offline-stub"


class Embedder(Protocol):
    name: str

    def documents(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    name: str

    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Signed hashes of words, summed and normalised."""

    name = STUB

    def __init__(self, size: int = 64):
        self.size = size

    def one(self, text: str) -> list[float]:
        v = [0.0] * self.size
        for w in re.findall("[a-z0-9]+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.size] += 1 if h >> 63 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]

    def query(self, text: str) -> list[float]:
        return self.one(text)


class OverlapReranker:
    """The share of the query's words that a text has."""

    name = STUB

    def scores(self, query: str, texts: list[str]) -> list[float]:
        asked = set(re.findall("[a-z0-9]+", query.lower()))
        return [len(asked & set(re.findall("[a-z0-9]+", t.lower()))) / max(1, len(asked)) for t in texts]


#: The stand-in's idea of a person: first name, initial, last name.
PERSON = r"(?U)\b[A-Z]\p{Ll}+ [A-Z]\. [A-Z]\p{Ll}+\b"


def people(text: Column, pattern: str = PERSON) -> Column:
    """Array of struct a, b: where the stand-in for a recogniser of names sees persons."""
    return F.transform(matches(text, pattern), lambda m: F.struct(m["pos"].alias("a"), (m["pos"] + F.length(m["raw"])).alias("b")))


def rerank_or_keep(reranker: Reranker, query: str, texts: list[str]) -> tuple[list[float], bool]:
    """Scores and True, or, if the reranker fails, falling scores in the order given and False."""
    try:
        return (reranker.scores(query, texts), True) if texts else ([], True)
    except Exception:
        return [-float(i) for i in range(len(texts))], False

"""Extension points as table functions: extractors, checklists and routes that a user registers by name and calls from SQL with lateral joins.

`extract(name, text)` gives kind, at (from 0) and raw for what an extractor finds; `checklist(name)` gives place and clause of a named checklist;
`route(text)` gives item and why for every route that takes a text. `register` hands the tables of that moment to a session; a later registration needs another call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

Found = Iterable[tuple[str, int, str]]


def by_pattern(kind: str, pattern: str) -> Callable[[str], Found]:
    """An extractor of all matches of a pattern."""
    made = re.compile(pattern)
    return lambda text: ((kind, m.start(), m.group()) for m in made.finditer(text))


@dataclass
class Extensions:
    """Extractors by name, checklists by name, and routes: an item, why, and a test of a text."""

    extractors: dict[str, Callable[[str], Found]] = field(default_factory=dict)
    checklists: dict[str, list[str]] = field(default_factory=dict)
    routes: list[tuple[str, str, Callable[[str], bool]]] = field(default_factory=list)

    def register(self, spark: SparkSession) -> None:
        """Makes extract, checklist and route callable from the session's SQL. A null text or an unknown name gives no rows."""
        extractors, checklists, routes = dict(self.extractors), {k: list(v) for k, v in self.checklists.items()}, list(self.routes)

        class Extract:
            def eval(self, name: str, text: str) -> Iterator[tuple[str, int, str]]:
                if text is not None and name in extractors:
                    yield from extractors[name](text)

        class Checklist:
            def eval(self, name: str) -> Iterator[tuple[int, str]]:
                yield from enumerate(checklists.get(name, []), 1)

        class Route:
            def eval(self, text: str) -> Iterator[tuple[str, str]]:
                if text is not None:
                    yield from ((item, why) for item, why, takes in routes if takes(text))

        for name, kind, row in (("extract", Extract, "kind string, at int, raw string"), ("checklist", Checklist, "place int, clause string"), ("route", Route, "item string, why string")):
            spark.udtf.register(name, udtf(kind, returnType=row))

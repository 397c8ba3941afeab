"""Many keyword rules at once: one scan of a text finds all rules whose keyword it holds, however many there are."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a rulebook may have: it goes to every worker as one automaton (about 100 bytes a character of its keywords).
MOST_RULES = 200_000

_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, rules: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Built once in each worker."""
    if name not in _automata:
        made, by_keyword = ahocorasick.Automaton(), {}
        for rule, keyword in rules:
            by_keyword.setdefault(keyword, []).append(rule)
        for keyword, numbers in by_keyword.items():
            made.add_word(keyword, numbers)
        made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return _automata[name]


def match(text: Column, rulebook: DataFrame) -> Column:
    """array<int>: the rules of ``rulebook`` (rule, keyword) whose keyword stands in the text, in ascending order; case counts. Null texts match nothing, nor do null or empty keywords.

    ``F.get(match, 0)`` is what a chain of ``when`` in rule order would choose, without a test for each rule.
    """
    rows = rulebook.filter("rule IS NOT NULL AND keyword <> ''").select("rule", "keyword").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rulebook has at most {MOST_RULES} rules")
    shared, name = rulebook.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex

    @F.pandas_udf("array<int>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = automaton(name, shared.value) if shared.value else None
        for texts in batches:
            yield pd.Series([sorted({n for _, numbers in found.iter(t) for n in numbers}) if found and t else [] for t in texts], dtype=object)

    return scan(text)

"""Many substrings looked for in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def _automaton(groups: tuple[tuple[str, ...], ...]) -> ahocorasick.Automaton:
    """Of all groups' terms, each with the first group that has it; built once in a worker."""
    first: dict[str, int] = {}
    for i, terms in enumerate(groups):
        for t in terms:
            first.setdefault(t, i)
    found = ahocorasick.Automaton()
    for term, i in first.items():
        found.add_word(term, i)
    found.make_automaton()
    return found


def first_group(text: Column, groups: list[list[str]]) -> Column:
    """The number of the first group of which a term stands anywhere in the text, or null; terms are in lower case, as the text is taken."""
    fixed = tuple(tuple(g) for g in groups)

    @F.pandas_udf("int")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(fixed)
        for texts in batches:
            yield pd.Series([None if t is None else min((i for _, i in automaton.iter(t.lower())), default=None) for t in texts], dtype="Int32")

    return found(text)

"""Commands like a typed text, and help sections for a question: two lists met in blocks of bounded size."""

from __future__ import annotations

import difflib
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each list that meet in one task.
LEFT_ROWS, RIGHT_ROWS = 2_000, 20_000


def in_blocks(left: DataFrame, right: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``meet`` of every block of ``left`` with every block of ``right``; both lists are dealt by a hash, and neither passes the driver.

    A row goes to as many tasks as the other list has blocks, so a short list costs next to nothing.
    """
    ways = [max(1, -(-rows.count() // most)) for rows, most in ((left, LEFT_ROWS), (right, RIGHT_ROWS))]

    def dealt(rows: DataFrame, own: int) -> DataFrame:
        here = F.pmod(F.xxhash64(*rows.columns), F.lit(ways[own])).cast("int")
        there = F.explode(F.sequence(F.lit(0), F.lit(ways[1 - own] - 1)))
        return rows.select("*", here.alias(f"_{own}"), there.alias(f"_{1 - own}"))

    grid = [dealt(rows, i).groupBy("_0", "_1") for i, rows in enumerate((left, right))]
    return grid[0].cogroup(grid[1]).applyInPandas(lambda a, b: meet(a, b), schema)


def _automaton(terms: set[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms - {""}:
        found.add_word(term, term)
    found.make_automaton()
    return found


def _held(automaton: ahocorasick.Automaton, text: str) -> set[str]:
    """The terms that stand anywhere in the text."""
    return {t for _, t in automaton.iter(text)} if len(automaton) else set()


class Vocabulary:
    """A block of commands, as candidates for typed texts are looked up in it."""

    def __init__(self, commands: list[str], least: float):
        self.least = least
        # by length, so that those of about a text's length are one run
        self.commands = sorted(commands, key=lambda c: (len(c.lower()), c))
        self.lows = [c.lower() for c in self.commands]
        self.lengths = np.array([len(c) for c in self.lows], dtype=np.int64)
        self.letters = {x: i for i, x in enumerate(sorted({x for c in self.lows for x in c}))}
        self.counts = np.zeros((len(self.lows), len(self.letters)), dtype=np.int32)
        self.by_low, self.by_word, self.words = defaultdict(list), defaultdict(list), []
        for i, c in enumerate(self.lows):
            for x, n in Counter(c).items():
                self.counts[i, self.letters[x]] = n
            self.by_low[c].append(i)
            self.words.append(len(set(c.split())))
            for w in set(c.split()):
                self.by_word[w].append(i)
        self.automaton = _automaton(set(self.by_low))

    def confidences(self, low: str, inside: list[int]) -> dict[int, float]:
        """Commands by place with a confidence of ``least`` at least; ``inside``: those that hold the text.

        The sequence ratio is twice the matched characters by both lengths, and no more characters
        match than both have of each: first lengths, then counts of characters leave few to compare.
        """
        found: dict[int, float] = defaultdict(float)
        for i in [*inside, *(j for t in _held(self.automaton, low) for j in self.by_low[t]), *(self.by_low.get("", ()))]:
            found[i] = 0.8
        words = set(low.split())
        for i, n in Counter(i for w in words for i in self.by_word.get(w, ())).items():
            found[i] = max(found[i], n / max(len(words), self.words[i], 1) * 0.7)
        n, least = len(low), self.least
        a = int(np.searchsorted(self.lengths, np.floor(n * least / (2 - least)))) if least < 2 else 0
        b = int(np.searchsorted(self.lengths, np.ceil(n * (2 - least) / least), side="right")) if least > 0 else len(self.lengths)
        own = np.zeros(len(self.letters), dtype=np.int32)
        for x, k in Counter(low).items():
            if x in self.letters:
                own[self.letters[x]] = k
        common = np.minimum(self.counts[a:b], own).sum(axis=1)
        whole = self.lengths[a:b] + n
        bound = np.where(whole > 0, 2 * common / np.maximum(whole, 1), 1.0)
        matcher = difflib.SequenceMatcher(None)
        for i in (np.flatnonzero(bound >= least) + a).tolist():
            if bound[i - a] > found.get(i, 0.0):
                matcher.set_seqs(low, self.lows[i])
                found[i] = max(found[i], matcher.ratio())
        return {i: c for i, c in found.items() if c >= least}


def suggest(typed: DataFrame, commands: DataFrame, least: float = 0.7, most: int = 5, typos: dict[str, str] | None = None) -> DataFrame:
    """(typed, command, confidence, rank) of the commands most like each typed text; lists of any length.

    Confidence: 0.8 if one holds the other, 0.7 times the share of common words, or the sequence ratio,
    whichever is greatest; a known typo has 0.95 for its command.  Ties go by the command.
    """

    def meet(texts: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts) and len(names):
            block = Vocabulary(names["command"].tolist(), least)
            lows = {t: t.lower().strip() for t in texts["typed"]}
            inside, automaton = defaultdict(list), _automaton(set(lows.values()))
            for i, c in enumerate(block.lows):
                for t in _held(automaton, c):
                    inside[t].append(i)
            for t, low in lows.items():
                known = block.confidences(low, inside[low] if low else range(len(block.lows)))
                best = sorted(((block.commands[i], c) for i, c in known.items()), key=lambda x: (-x[1], x[0]))[:most]
                out += [(t, c, s) for c, s in best]
        return pd.DataFrame(out, columns=["typed", "command", "confidence"])

    texts = typed.select("typed").where("typed IS NOT NULL").distinct()
    found = in_blocks(texts, commands.select("command").where("command IS NOT NULL").distinct(), meet, "typed string, command string, confidence double")
    if typos:
        fixed = F.create_map(*[F.lit(x) for pair in typos.items() for x in pair])
        found = found.unionByName(texts.select("typed", F.try_element_at(fixed, F.trim(F.lower("typed"))).alias("command"), F.lit(0.95).alias("confidence")).where("command IS NOT NULL"))
    order = Window.partitionBy("typed").orderBy(F.desc("confidence"), "command")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("confidence", F.round("confidence", 6))


def _split(text: str) -> list[str]:
    return re.split(r"\s+", text, flags=re.A)


def help_scores(queries: DataFrame, sections: DataFrame, query: str = "query") -> DataFrame:
    """Sections (title, keywords array, content, examples array) by relevance to each query, best first; lists of any length.

    Two points for each keyword that the query holds, three if it holds a word of the title, half a
    point for each word in common with the content, and one for each example of which it holds a word.
    """
    kind = queries.schema[query].dataType.simpleString()

    def meet(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        # each term with the sections and the role in which it counts; examples are told apart
        roles, content = defaultdict(list), defaultdict(list)
        for i, s in enumerate(found.itertuples(index=False)):
            for k in s.keywords if s.keywords is not None else ():
                roles[k].append((i, "keyword"))
            for w in _split(s.title.lower()) if s.title is not None else ():
                roles[w].append((i, "title"))
            for n, e in enumerate(s.examples if s.examples is not None else ()):
                for w in set(_split(e.lower())) if e is not None else ():
                    roles[w].append((i, n))
            for w in set(_split(s.content.lower())) if s.content is not None else ():
                content[w].append(i)
        automaton, out = _automaton(set(roles)), []
        for text in texts["q"]:
            low, scores, counted = text.lower(), Counter(), set()
            for t in _held(automaton, low) | ({""} & set(roles)):
                for i, role in roles[t]:
                    if role == "keyword":
                        scores[i] += 2.0
                    elif (i, role) not in counted:
                        counted.add((i, role))
                        scores[i] += 3.0 if role == "title" else 1.0
            for w in set(_split(low)):
                for i in content.get(w, ()):
                    scores[i] += 0.5
            out += [(text, found["title"].iloc[i], float(s)) for i, s in scores.items() if s > 0]
        return pd.DataFrame(out, columns=["q", "title", "score"])

    texts = queries.select(F.col(query).alias("q")).where("q IS NOT NULL").distinct()
    scored = in_blocks(texts, sections.select("title", "keywords", "content", "examples"), meet, f"q {kind}, title string, score double")
    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "title"))
    return scored.withColumn("rank", ranked).withColumnRenamed("q", query)

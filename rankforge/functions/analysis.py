"""Text analysis: lower case, words, stopwords, stemming; for columns and, alike, for query strings.

Positions are given before stopwords go, so a stopword leaves a gap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores; an apostrophe inside it doesn't end it.
WORD = r"[a-z0-9_\p{L}\p{N}]++(?:['’][a-z0-9_\p{L}\p{N}]++)*+"
#: The customary short English list.
STOPWORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def _s_stem(term: str) -> str:
    """Harman's S-stemmer."""
    if term.endswith("ies") and not term.endswith(("eies", "aies")):
        return term[:-3] + "y"
    if term.endswith("es") and not term.endswith(("aes", "ees", "oes")):
        return term[:-1]
    if term.endswith("s") and not term.endswith(("us", "ss")):
        return term[:-1]
    return term


def _s_stem_column(t: Column) -> Column:
    drop = lambda n: F.substring(t, 1, F.length(t) - n)
    return (
        F.when(t.endswith("ies") & ~t.rlike("[ea]ies$"), F.concat(drop(3), F.lit("y")))
        .when(t.endswith("es") & ~t.rlike("[aeo]es$"), drop(1))
        .when(t.endswith("s") & ~t.rlike("[us]s$"), drop(1))
        .otherwise(t)
    )


@dataclass(frozen=True)
class Analyzer:
    """stem: "none", "s", or a pair of functions (of a column, of a string)."""

    stopwords: frozenset[str] = STOPWORDS
    stem: str | tuple[Callable[[Column], Column], Callable[[str], str]] = "none"

    def words(self, text: Column) -> Column:
        """All words of a text in order, stopwords too; none of a null text."""
        return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))

    def kept(self, word: Column) -> Column:
        return ~word.isin(*sorted(self.stopwords)) if self.stopwords else F.lit(True)

    def term(self, word: Column) -> Column:
        if self.stem == "none":
            return word
        return _s_stem_column(word) if self.stem == "s" else self.stem[0](word)

    def terms_of(self, text: str) -> list[str]:
        """Terms of a query string: stopwords dropped."""
        stem = {"none": lambda t: t, "s": _s_stem}[self.stem] if isinstance(self.stem, str) else self.stem[1]
        return [stem(w) for w in regex.findall(WORD, text.lower()) if w not in self.stopwords]

"""Terms of one or more words found in normalised texts by one pass of a trie.

The terms become one pattern in the form of a trie, so that a text is gone through once however many terms there are:
at the start of a word the pattern follows the characters that some term has next, and gives the longest term that
ends with a word. A match takes no characters, so that terms which begin within others are found too; terms that
are the first words of others follow from those.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

END = ""


def _trie(terms: Iterable[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for letter in term:
            node = node.setdefault(letter, {})
        node[END] = {}
    return root


def _pattern(node: dict) -> str:
    """Alternatives of the node's letters, the end of a term last."""
    run = ""
    while len(node) == 1 and END not in node:
        letter, node = next(iter(node.items()))
        run += re.escape(letter)
    if set(node) == {END}:
        return f"{run}(?= )"
    ways = [re.escape(letter) + _pattern(below) for letter, below in sorted(node.items()) if letter != END]
    return f"{run}(?:{'|'.join([*ways, '(?= )'] if END in node else ways)})"


def trie_pattern(terms: Iterable[str]) -> str:
    """Group 1 is the longest of ``terms`` that starts at a word of a text padded with blanks."""
    return f"(?<= )(?=({_pattern(_trie(terms))}))"


def texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def longest_terms(text: Column, terms: Iterable[str]) -> Column:
    """Distinct terms of a normalised text, less those found only as the first words of a longer one."""
    terms = sorted(set(terms) - {""})
    if not terms:
        return texts(())
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(trie_pattern(terms)), F.lit(1)))


def with_beginnings(longest: Column, terms: Iterable[str]) -> Column:
    """All terms of a text, from its :func:`longest_terms`."""
    terms = set(terms) - {""}
    found = [longest]
    for term in sorted(terms):
        words = term.split(" ")
        begun = [b for n in range(1, len(words)) if (b := " ".join(words[:n])) in terms]
        if begun:
            found.append(F.when(F.array_contains(longest, term), texts(begun)).otherwise(texts(())))
    return F.array_distinct(F.concat(*found)) if found[1:] else longest

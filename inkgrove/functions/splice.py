"""Regex substitution with a computed replacement, inside the JVM.

Spark's ``regexp_replace`` takes a fixed template.  Splitting the text on the
pattern gives the pieces between matches, ``regexp_extract_all`` gives the
matches; zipping the two puts any per-match expression back in place.  The cost
is linear in the text, however many matches there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group, in order of appearance."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def between(text: Column, pattern: str) -> Column:
    """Pieces around the matches; always one more than there are matches."""
    return F.split(text, pattern, -1)


def put_back(text: Column, pattern: str, replacements: Column) -> Column:
    """Replace the i-th match of ``pattern`` by the i-th array element.

    There is one more piece than there are matches; ``zip_with`` pads with NULL.
    """
    glued = F.zip_with(
        between(text, pattern), replacements, lambda piece, new: F.concat(piece, F.coalesce(new, F.lit("")))
    )
    return F.array_join(glued, "")


def substitute(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """``re.sub`` with a function of the matched text."""
    return let(text, lambda t: put_back(t, pattern, F.transform(matches(t, pattern), replace)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def only_with(text: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` for texts that contain ``mark``; the others stay as they are.

    The search is far cheaper than a regular expression that finds nothing.
    """
    return let(text, lambda t: F.when(t.contains(mark), change(t)).otherwise(t))


def drop_all(text: Column, characters: str) -> Column:
    """Remove single characters; each search is fast when there is none."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text

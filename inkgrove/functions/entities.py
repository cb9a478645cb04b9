"""HTML entities.

Eight common references are resolved with native string functions.  For others
only the reference strings themselves go through Arrow to the standard library,
never the text; rows without such references pass a NULL.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.functions.patterns import ENTITY
from inkgrove.functions.splice import let, matches, only_with, put_back

# --- fixed values; the ampersand is resolved last, so that one pass is enough
COMMON = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", "\xa0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]
# --- end of fixed values

RARE_ENTITY = r"&(?!(?:lt|gt|quot|#39|nbsp|copy|middot|amp);)(?:#[0-9xX]|[^\t\n\f <&#;])"


def _in_common_form(reference: str) -> str:
    """What a reference stands for, the five mark-up characters as common references."""
    return html.escape(html.unescape(reference)).replace("&#x27;", "&#39;")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve(references: pd.Series) -> pd.Series:
    return references.map(lambda refs: None if refs is None else [_in_common_form(r) for r in refs])


@F.pandas_udf(T.StringType())
def _resolve_and_simplify(texts: pd.Series) -> pd.Series:
    rare = re.compile(RARE_ENTITY[: RARE_ENTITY.index("(?:#")] + ENTITY[1:])
    return texts.map(lambda t: None if t is None else rare.sub(lambda m: _in_common_form(m[0]), html.unescape(t)))


def unescape_simplified(text: Column) -> Column:
    """Resolve every reference once; rare ones that this brings out are simplified.

    So ``unescape_common`` is enough to resolve the result again.  Short texts with rare
    references, at first or second sight, go to the standard library.
    """
    seen = let(text, lambda t: F.when(F.replace(t, F.lit("&amp;"), F.lit("&")).rlike(RARE_ENTITY), t))
    return F.coalesce(_resolve_and_simplify(seen), unescape_common(text))


def simplify_entities(text: Column) -> Column:
    """Rewrite rare references as characters or as common references."""
    # ``text`` is often a long expression; ``let`` keeps it from being repeated.
    resolved = _resolve(
        let(text, lambda t: F.when(t.contains("&") & t.rlike(RARE_ENTITY), matches(t, ENTITY)))
    )
    return let(
        F.struct(text.alias("text"), resolved.alias("resolved")),
        lambda x: F.when(x["resolved"].isNull(), x["text"]).otherwise(put_back(x["text"], ENTITY, x["resolved"])),
    )


def unescape_common(text: Column) -> Column:
    """Resolve the common references, natively."""

    def each(text: Column) -> Column:
        for reference, character in COMMON:
            text = F.replace(text, F.lit(reference), F.lit(character))
        return text

    return only_with(text, "&", each)


def unescape(text: Column) -> Column:
    """Resolve every HTML5 character reference once."""
    return unescape_common(simplify_entities(text))

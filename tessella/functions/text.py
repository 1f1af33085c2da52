"""From marked-up text to terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Lower case without tags, entities and addresses."""
    for pattern in (r"<[^>]*>", r"&[a-zA-Z#0-9]+;", r"https?://[^ \t\n\r\f]+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.lower(text)


def terms(text: Column, stop: Sequence[str] = (), least: int = 1) -> Column:
    """Runs of a-z of at least so many letters, without stop words."""
    found = F.regexp_extract_all(plain(text), F.lit("([a-z]+)"), F.lit(1))
    # the lambda runs once a term, so nothing of the whole text may stand in it
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stop))

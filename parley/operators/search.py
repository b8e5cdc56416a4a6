"""A trigram index of the archive for substring search.

A posting says that a conversation's title or id holds a gram of three characters. Postings are written in the order of
their grams, so that row-group statistics lead a search to those of its own grams; conversations that have all of them
in one field are the candidates, and the exact pattern decides afterwards. A changed conversation adds its new postings:
old ones cost a candidate, never a wrong row. A search without three literal characters in a row has no gram and scans.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import KEY

GRAM = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("source_id", "title")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def search_pattern(q: str) -> str:
    """The LIKE pattern of a search: `%` and `_` stay wildcards, a backslash is itself, case folds for ASCII only."""
    return "%" + q.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"


def search_grams(q: str) -> list[str]:
    """The grams that every match of a search holds."""
    runs = re.split("[%_]", q.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def _grams(text: Column) -> Column:
    low = ascii_lower(text)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM)))))


def postings(conversations: DataFrame) -> DataFrame:
    """(gram, field, KEY): the distinct grams of every conversation's fields."""
    both = F.array(*[F.struct(F.lit(f).alias("field"), _grams(F.col(f)).alias("grams")) for f in FIELDS])
    return (conversations.select(*KEY, F.explode(both).alias("f"))
            .select(F.explode("f.grams").alias("gram"), "f.field", *KEY).distinct())


def write_postings(conversations: DataFrame, root: str, mode: str = "append") -> None:
    """Add the postings of ``conversations``, in the order of their grams; a frequent gram is spread by the keys."""
    found = postings(conversations).repartitionByRange("gram", *KEY).sortWithinPartitions("gram", *KEY)
    found.write.mode(mode).parquet(root)


def candidates(index: DataFrame, q: str) -> DataFrame | None:
    """(KEY) of the conversations that have all grams of the search in one field; None where it has no gram."""
    grams = search_grams(q)
    if not grams:
        return None
    held = index.where(F.col("gram").isin(*grams)).select("gram", "field", *KEY).distinct()
    counted = held.groupBy("field", *KEY).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") == len(grams)).select(*KEY).distinct()


def matches(q: str) -> Column:
    """The exact rule over a conversation row."""
    pattern = search_pattern(q)
    return ascii_lower(F.col("source_id")).like(pattern) | F.coalesce(ascii_lower(F.col("title")).like(pattern), F.lit(False))

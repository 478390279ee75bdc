"""Spellings of split and question-type labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the splits after everything but letters is removed.
SPLITS = {
    "train": "train training trainset tr",
    "validation": "validation valid val dev development validate",
    "test": "test testing tst testset",
}


def plain(column: Column) -> Column:
    """Lower-case letters and digits of a label, null when nothing is left."""
    bare = F.regexp_replace(F.lower(column), "[^\\p{L}\\p{N}]+", "")
    return F.when(F.length(bare) > 0, bare)


def split_name(column: Column) -> Column:
    """train, validation or test for any usual spelling; other labels in their plain form; null stays null."""
    pairs = [F.lit(x) for name, forms in SPLITS.items() for form in forms.split() for x in (form, name)]
    bare = plain(column)
    return F.coalesce(F.element_at(F.create_map(*pairs), bare), bare)

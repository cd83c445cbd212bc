"""Column names: cleaning, fallback and uniqueness. Works on metadata only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame


def clean_name(label: str) -> str:
    """ASCII-fold a label, turn each run of white space into ``_`` and drop other punctuation."""
    decomposed = unicodedata.normalize("NFKD", label)
    ascii_only = "".join(ch for ch in decomposed if ch.isascii())
    joined = "_".join(re.split(r"\s+", ascii_only))
    return "".join(ch for ch in joined if ch.isalnum() or ch == "_")


def clean_names(labels: Sequence[str]) -> list[str]:
    """Clean every label; ``column_<ordinal>`` where nothing is left, ``_2``, ``_3`` on collision.

    Names differing only in case collide too, because Spark resolves columns without case.
    """
    taken: set[str] = set()
    names = []
    for ordinal, label in enumerate(labels, start=1):
        base = clean_name(label) or f"column_{ordinal}"
        name, copy = base, 1
        while name.lower() in taken:
            copy += 1
            name = f"{base}_{copy}"
        taken.add(name.lower())
        names.append(name)
    return names


def header_labels(cells: Sequence[str | None]) -> list[str]:
    """Labels of a raw header row: empty cells are numbered, repeated ones get ``.1``, ``.2``."""
    named = [cell if cell else f"Unnamed: {index}" for index, cell in enumerate(cells)]
    used: set[str] = set()
    labels = []
    for label in named:
        unique, copy = label, 0
        while unique in used or (copy and unique in named):
            copy += 1
            unique = f"{label}.{copy}"
        used.add(unique)
        labels.append(unique)
    return labels


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))

"""Entities that a document declares in its own document type: replaced by their values before the parse, within bounds.

Only general entities with a quoted value count; nothing outside the document is read. A value may use other entities, down
to ``DEPTH`` levels. What would grow beyond ``GROWTH`` times the document, refers to itself, nests deeper or hides references
in CDATA keeps its declarations, and the parser then refuses it like any other malformed document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH, GROWTH = 4, 8
ROOM = 1 << 16
DECLARES = "<!ENTITY"
SUBSET = r"(?s)<!DOCTYPE[^\[>]*\[.*?\]\s*>"
ENTITY = r"""<!ENTITY\s+([A-Za-z_][\w.-]*)\s+(?:"([^"]*)"|'([^']*)')\s*>"""
REFERENCE = r"&(?!(?:lt|gt|amp|quot|apos);)[A-Za-z_][\w.-]*;"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _replaced(text: Column, entities: Column, most: Column) -> Column:
    """Each entity's references replaced once, in the order of their declarations; NULL where the text would grow too much."""

    def one(t: Column, e: Column) -> Column:
        name, value = e["name"], e["value"]
        times = F.floor((F.length(t) - F.length(F.replace(t, name, F.lit("")))) / F.length(name))
        grown = F.length(t) + times * (F.length(value) - F.length(name))
        return F.when(grown <= most, F.replace(t, name, value))

    return F.aggregate(entities, text, one)


def resolved(text: Column) -> Column:
    """The text without its document type and with its entities in place, or as it is where the bounds forbid that."""

    def with_subset(subset: Column) -> Column:
        part = lambda i: F.regexp_extract_all(subset, F.lit(ENTITY), F.lit(i))
        # of two declarations of one name the first counts, as it leaves no reference to the second
        found = F.zip_with(part(1), F.zip_with(part(2), part(3), lambda a, b: F.concat(a, b)), lambda n, v: F.struct(F.concat(F.lit("&"), n, F.lit(";")).alias("name"), v.alias("value")))

        def expanded(entities: Column) -> Column:
            body, most = F.regexp_replace(text, SUBSET, ""), GROWTH * F.length(text) + ROOM
            for _ in range(DEPTH):
                body = _let(body, lambda t: _replaced(t, entities, most))
            return body

        return _let(found, expanded)

    body = _let(F.regexp_extract(text, SUBSET, 0), with_subset)
    sound = _let(body, lambda t: F.when(~t.rlike(REFERENCE) & ~t.contains("<![CDATA["), t))
    return F.coalesce(sound, text)


def with_entities(text: Column) -> Column:
    """Documents that declare entities are resolved; the others cost one search for the declaration."""
    return F.when(F.contains(text, F.lit(DECLARES)), resolved(text)).otherwise(text)

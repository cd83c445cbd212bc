"""Declared fields over a nested document: each names its paths and how to turn them into a column.

The paths of the wanted fields also make up the schema handed to ``from_xml``, so a report that
needs two columns parses two columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


RECORD = "r"
# Split into records of one each before the paths are read, so it is no array there.
ITEM = "det"


@dataclass(frozen=True)
class Field:
    """``paths`` are relative to the record column ``r``; ``raw`` takes the text from it, ``then`` makes the value.

    ``pick`` names the same text in a shape (``operators.plain``): its place there, or a fixed text, or None.
    """

    name: str
    paths: tuple[str, ...]
    raw: Callable[[], Column]
    pick: Callable[[Node], int | str | None]
    cast: str | None = None
    then: Callable[[Column], Column] | None = None

    def value(self, raw: Column, *, typed: bool = False) -> Column:
        made = raw if self.then is None else self.then(raw)
        return (made.try_cast(self.cast) if typed and self.cast else made).alias(self.name)


@dataclass(frozen=True)
class Node:
    """An element of a shape: the places of its text and attributes among the values, and the elements below by name."""

    text: int | None
    attributes: Mapping[str, int]
    below: Mapping[str, list[Node]]

    def all(self, path: str) -> list[Node]:
        above, _, name = path.rpartition("/")
        node = self.at(above) if above else self
        return node.below.get(name, []) if node else []

    def at(self, path: str) -> Node | None:
        return next(iter(self.all(path)), None)

    def text_at(self, path: str) -> int | None:
        above, _, name = path.rpartition("/")
        if name.startswith("@"):
            node = self.at(above) if above else self
            return node.attributes.get(name[1:]) if node else None
        node = self.at(path)
        return node.text if node else None

    def first_text(self, paths: Iterable[str]) -> int | None:
        return next((t for t in map(self.text_at, paths) if t is not None), None)


def elements(path: str) -> str:
    """SQL for all repetitions of the element at ``a/b/c``, below the first ``a/b``; NULL where there is none."""
    above, _, name = path.rpartition("/")
    return f"{at(above) if above else RECORD}.{name}"


def at(path: str) -> str:
    """SQL for the value at ``a/b/c``, with ``@x`` for an attribute; NULL wherever a part is missing.

    Of a repeated element the first counts, at every step. SQL text rather than chained columns: a record
    has some hundred paths, and each step of a chain would be a call into the JVM.
    """
    above, _, name = path.rpartition("/")
    if name.startswith("@"):
        return f"{at(above) if above else RECORD}._{name[1:]}"
    return f"{RECORD}.{ITEM}" if path == ITEM else f"get({elements(path)}, 0)"


def text_at(path: str) -> str:
    """The text at a path, the empty text as NULL."""
    return f"nullif({at(path)}, '')"


def field(name: str, path: str, then: Callable[[Column], Column] | None = None, cast: str | None = None) -> Field:
    """The text at one path, optionally decoded or cut by ``then``."""
    return Field(name, (path,), lambda: F.expr(text_at(path)), lambda node: node.text_at(path), cast, then)


def first_field(name: str, repeated: str, leaf: str) -> Field:
    """The first filled ``leaf`` among the repetitions of an element."""
    sql = f"get(filter(transform({elements(repeated)}, e -> get(e.{leaf}, 0)), v -> nullif(v, '') IS NOT NULL), 0)"

    def pick(node: Node) -> int | None:
        return next((t for t in (e.text_at(leaf) for e in node.all(repeated)) if t is not None), None)

    return Field(name, (f"{repeated}/{leaf}",), lambda: F.expr(sql), pick)


def variant_field(
    name: str, parent: str, groups: Sequence[str], leaves: Sequence[str], cast: str | None = None
) -> Field:
    """The first filled leaf over alternative groups, in group order and then in leaf order."""
    paths = tuple(f"{parent}/{group}/{leaf}" for group in groups for leaf in leaves)
    sql = f"coalesce({', '.join(text_at(p) for p in paths)})"
    return Field(name, paths, lambda: F.expr(sql), lambda node: node.first_text(paths), cast)


def branch_field(name: str, parent: str, leaf: str, otherwise: str) -> Field:
    """The leaf below ``parent`` once that is there, even an empty one; else the other path."""
    sql = f"CASE WHEN {at(parent)} IS NOT NULL THEN {text_at(f'{parent}/{leaf}')} ELSE {text_at(otherwise)} END"

    def pick(node: Node) -> int | None:
        return node.text_at(f"{parent}/{leaf}" if node.at(parent) else otherwise)

    return Field(name, (f"{parent}/{leaf}", otherwise), lambda: F.expr(sql), pick)


def schema_of(paths: Iterable[str]) -> T.StructType:
    """The narrowest struct holding all paths. Elements are arrays, since a plain field keeps the last of a repeated one."""
    tree: dict[str, dict] = {}
    for path in paths:
        node = tree
        for part in path.split("/"):
            node = node.setdefault(part, {})
    return _struct(tree)


def _struct(tree: dict[str, dict]) -> T.StructType:
    fields = []
    for part, below in tree.items():
        kind: T.DataType = _struct(below) if below else T.StringType()
        attribute = part.startswith("@")
        fields.append(T.StructField(part.replace("@", "_"), kind if attribute else T.ArrayType(kind)))
    return T.StructType(fields)

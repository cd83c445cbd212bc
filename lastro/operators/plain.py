"""Plain documents, read in Python tasks by their shape; all others are handed on to ``from_xml``.

The shape of a piece of XML is the piece without the texts between its tags. Texts without ``<`` and ``&`` change neither
whether it is well formed nor where its elements are, so a shape is parsed once and tells which text belongs to which field;
later pieces of that shape only have their texts picked. A document is cut into items and the rest around them, whose
shapes recur. A task keeps a bounded number of shapes; one that is met once costs one parse.

Plain is what both parsers are sure to take alike: a sound document without comments, CDATA, document type, processing
instructions, character references, names in another case, blank texts, empty groups or attributes at unexpected places. Whatever
is not, and every document that would be rejected, keeps its text for the parser of ``operators.fiscal``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from operator import itemgetter
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import types as T

from lastro.operators.paths import ITEM, Field, Node

#: Shapes kept in a worker for one choice of fields, and records sent to the JVM at once.
SHAPES, RECORDS = 20_000, 10_000

ROOT = re.compile(r"""<(?:([A-Za-z_][\w.-]*):)?([A-Za-z_][\w.-]*)(?=[\s>])""", re.ASCII)
PROLOG = re.compile(r"""<\?xml version="1\.0"(?: encoding="(?:UTF-8|utf-8|ISO-8859-1|iso-8859-1|windows-1252)")?\?>\s*""", re.ASCII)
#: Characters beyond which the parsers may differ, but for those XML forbids.
ODD = re.compile("[^\\t\\n\\x20-\\x7e\\xa0-\\ud7ff\\ue000-\\ufdcf\\ufdf0-\\ufefe\\uff00-\\uffef]")
TEXTS, TAGS = re.compile(r">([^<>]+)<"), re.compile("<[^>]*")
BLANK = " \t\n"
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
OTHER_REFERENCE = re.compile("&(?!(?:lt|gt|quot|apos|amp);)")
NUMBER, NAME = re.compile(r"[0-9]{1,9}", re.ASCII), re.compile(r"[A-Za-z0-9]{1,200}", re.ASCII)
ID = "-id-"
# Texts that stand behind the values of a piece: the places of fixed texts and of the piece's own attribute.
FIXED = {None: -4, "": -3, "0": -2}
ATTRIBUTE = -1


class NotPlain(Exception):
    """Left to the other parser."""


@dataclass(frozen=True)
class Kind:
    """A document type: the names of its element and its body, what its root's name must match, the schema of its body, and
    the fields that are read, those of the items last."""

    doc_type: str
    body: str
    marks: str
    schema: T.StructType
    fields: tuple[Field, ...]
    has_items: bool


def of_item(f: Field) -> bool:
    return f.paths[0].startswith(f"{ITEM}/")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _node(e: ElementTree.Element, kind: T.DataType, attributes: dict[str, str]) -> Node:
    """The element as the schema sees it. ``attributes``: those the schema knows, with the text they must have."""
    names = {_local(a) for a in e.attrib}
    if len(names) < len(e.attrib) or any(e.get(n) != text for n, text in attributes.items()) or names - set(attributes) - {"versao"}:
        raise NotPlain
    held = dict.fromkeys(attributes, ATTRIBUTE)
    if isinstance(kind, T.StringType):
        if len(e) or names or (e.text is not None and not NUMBER.fullmatch(e.text)):
            raise NotPlain
        return Node(None if e.text is None else int(e.text), held, {})
    if e.text is not None or not len(e):
        raise NotPlain
    known = {f.name: f.dataType.elementType for f in kind.fields if isinstance(f.dataType, T.ArrayType)}
    lower = {n.lower() for n in known}
    below: dict[str, list[Node]] = {}
    for child in e:
        name = _local(child.tag)
        if child.tail is not None or (name not in known and name.lower() in lower):
            raise NotPlain
        if name == ITEM and name in known:
            below.setdefault(name, []).append(Node(None, {}, {}))
        elif name in known:
            below.setdefault(name, []).append(_node(child, known[name], {}))
    return Node(None, held, below)


def _parsed(skeleton: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(skeleton)
    except ElementTree.ParseError as e:
        raise NotPlain from e


def _skeleton(pieces: list[str]) -> str:
    """The shape as XML, each text replaced by its number."""
    return "".join(x for i, piece in enumerate(pieces) for x in ((f">{i - 1}<", piece) if i else (piece,)))


class Reader:
    """Records of plain documents of these kinds: for each record the texts of ``Kind.fields``."""

    def __init__(self, kinds: Sequence[Kind]):
        self.kinds = kinds
        self.named = {k.doc_type: (re.compile(k.marks), re.compile(rf"<((?:[\w.-]+:)?){k.doc_type}(?=[\s>])", re.ASCII)) for k in kinds}
        self.shapes: dict[tuple, Callable | None] = {}
        self.frames: dict[tuple, bool] = {}

    def _root(self, text: str) -> tuple[Kind, bool]:
        """The type of a document by its root, as ``fiscal.is_type`` says, and whether the document is bare."""
        prolog = PROLOG.match(text)
        root = ROOT.match(text, prolog.end() if prolog else 0)
        if not root:
            raise NotPlain
        for kind in self.kinds:
            if self.named[kind.doc_type][0].search(root[2]):
                return kind, root[2] == kind.doc_type
        raise NotPlain

    def read(self, text: str) -> tuple[Kind, list[tuple]]:
        if (not text.isprintable() and ODD.search(text)) or "<!" in text or "]]>" in text or text.find("<?", 1) >= 0:
            raise NotPlain
        if "&" in text and OTHER_REFERENCE.search(text):
            raise NotPlain
        text = text.lstrip(BLANK)
        kind, bare = self._root(text)
        first = self.named[kind.doc_type][1].search(text)
        if not first:
            raise NotPlain
        prefix, opening = first[1], text[: first.start()]
        *docs, closing = text[first.start() :].split(f"</{prefix}{kind.doc_type}>")
        if not docs or (bare and (len(docs) > 1 or closing.strip(BLANK))):
            raise NotPlain
        if not bare:
            self._framed(kind, prefix, opening, closing)
        found = []
        for i, doc in enumerate(docs):
            if i:
                doc = doc.lstrip(BLANK)
            if not doc.startswith(first[0]):
                raise NotPlain
            found += self._document(kind, prefix, doc)
        if "&" in text:
            found = [tuple(v if v is None or "&" not in v else _resolved(v) for v in r) for r in found]
        return kind, found

    def _framed(self, kind: Kind, prefix: str, opening: str, closing: str) -> None:
        """What lies around the documents must make them children of the root."""
        key = (kind.doc_type, prefix, opening, closing)
        if key not in self.frames:
            if len(self.frames) >= SHAPES // 10:
                self.frames.clear()
            self.frames[key] = self._is_frame(kind, prefix, opening, closing)
        if not self.frames[key]:
            raise NotPlain

    @staticmethod
    def _is_frame(kind: Kind, prefix: str, opening: str, closing: str) -> bool:
        prolog = PROLOG.match(opening)
        if not all(t.isascii() for t in TAGS.findall(opening + closing)):
            return False
        try:
            root = _parsed(f"{opening[prolog.end() if prolog else 0:]}<{prefix}{kind.doc_type}/>{closing}")
        except NotPlain:
            return False
        if {_local(a) for a in root.attrib} - {"versao"} or (root.text or "").strip(BLANK):
            return False
        names = [_local(c.tag) for c in root]
        if any((c.tail or "").strip(BLANK) for c in root) or any(n.lower() == "_bad" for n in names):
            return False
        return [n for n in names if n.lower() == kind.doc_type.lower()] == [kind.doc_type]

    def _document(self, kind: Kind, prefix: str, doc: str) -> list[tuple]:
        """``doc`` from its opening tag up to its closing one."""
        start, end = f'<{prefix}{ITEM} nItem="', f"</{prefix}{ITEM}>"
        if kind.has_items:
            head, *items = doc.split(start)
            if not items:
                raise NotPlain
            tail = ""
            for i, item in enumerate(items):
                number, _, rest = item.partition('">')
                inside, closed, gap = rest.partition(end)
                if not closed or not NUMBER.fullmatch(number) or (gap and i < len(items) - 1):
                    raise NotPlain
                items[i], tail = (number, inside), gap
            around = f"{head}<{prefix}{ITEM}/>{tail}"
        else:
            around = doc
        before, named, rest = around.partition(' Id="')
        key, _, rest = rest.partition('"')
        if not named or not NAME.fullmatch(key):
            raise NotPlain
        outer = self._picked(kind, prefix, False, f'{before} Id="{ID}"{rest}', key)
        return [outer + self._picked(kind, prefix, True, inside, number) for number, inside in items] if kind.has_items else [outer]

    def _picked(self, kind: Kind, prefix: str, item: bool, piece: str, attribute: str) -> tuple:
        parts = TEXTS.split(piece)
        texts = parts[1::2]
        if any(map(str.isspace, texts)):
            raise NotPlain
        shape = (kind.doc_type, prefix, item, "\x01".join(parts[::2]))
        if shape not in self.shapes:
            if len(self.shapes) >= SHAPES:
                self.shapes.clear()
            try:
                self.shapes[shape] = self._getter(kind, prefix, item, _skeleton(parts[::2]))
            except NotPlain:
                self.shapes[shape] = None
        get = self.shapes[shape]
        if get is None:
            raise NotPlain
        texts += (None, "", "0", attribute)
        return get(texts)

    @staticmethod
    def _getter(kind: Kind, prefix: str, item: bool, skeleton: str) -> Callable[[list], tuple]:
        """Which texts of a piece its fields are; ``NotPlain`` where the shape is not sound."""
        if not skeleton.isascii():
            raise NotPlain
        declared = f' xmlns:{prefix[:-1]}="urn:x"' if prefix else ""
        fields = [f for f in kind.fields if of_item(f) == item]
        if item:
            if "xmlns" in skeleton:
                raise NotPlain
            e = _parsed(f'<x{declared}><{prefix}{ITEM} nItem="{ID}">{skeleton}</{prefix}{ITEM}></x>')[0]
            node = _node(e, kind.schema[ITEM].dataType.elementType, {"nItem": ID})
            if not node.all("imposto"):
                raise NotPlain
            record = Node(None, {}, {ITEM: [node]})
        else:
            e = _parsed(f"<x{declared}>{skeleton}</{prefix}{kind.doc_type}></x>")[0]
            bodies = [c for c in e if _local(c.tag).lower() == kind.body.lower()]
            if {_local(a) for a in e.attrib} - {"versao"} or e.text is not None or any(c.tail is not None for c in e):
                raise NotPlain
            if len(bodies) != 1 or _local(bodies[0].tag) != kind.body:
                raise NotPlain
            record = _node(bodies[0], kind.schema, {"Id": ID})
            if not record.all("ide") or (kind.has_items and len(record.all(ITEM)) != 1):
                raise NotPlain
        places = [p if isinstance(p, int) else FIXED[p] for p in (f.pick(record) for f in fields)]
        if len(places) > 1:
            return itemgetter(*places)
        return lambda texts: tuple(texts[p] for p in places)


def _resolved(text: str) -> str:
    for reference, char in REFERENCES.items():
        text = text.replace(reference, char)
    return text


#: Readers of this worker, by the kinds they read: shapes serve the later tasks too.
_READERS: dict[tuple, Reader] = {}


def record_column(doc_type: str) -> str:
    return f"plain_{doc_type}"


def output_schema(kinds: Sequence[Kind]) -> T.StructType:
    """A column per type with the texts of a record that was read here; ``path`` and ``text`` are a document for the other parser.

    ``plain`` is the type of a record, or NULL. A record is one column, so that the steps behind pass it on whole.
    """
    out = T.StructType().add("plain", "string").add("path", "string").add("text", "string")
    for kind in kinds:
        out = out.add(record_column(kind.doc_type), T.StructType([T.StructField(f.name, T.StringType()) for f in kind.fields]))
    return out


def read_plain(batches: Iterator[pa.RecordBatch], key: tuple, kinds: Callable[[], Sequence[Kind]], keep: bool) -> Iterator[pa.RecordBatch]:
    """Records of plain documents and the documents that are not plain; without ``keep`` the latter only."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(kinds())
    reader = _READERS[key]
    types = {k.doc_type: pa.struct([(f.name, pa.string()) for f in k.fields]) for k in reader.kinds}
    schema = pa.schema([("plain", pa.string()), ("path", pa.string()), ("text", pa.string()), *[(record_column(t), kind) for t, kind in types.items()]])

    def sent(kind: Kind, rows: list[tuple]) -> pa.RecordBatch:
        n, doc_type = len(rows), kind.doc_type
        texts = [pa.array(values, pa.string()) for values in zip(*rows, strict=True)]
        record = pa.StructArray.from_arrays(texts, fields=list(types[doc_type])) if texts else pa.array([{}] * n, types[doc_type])
        nulls = pa.nulls(n, pa.string())
        arrays = [record if t == doc_type else pa.nulls(n, types[t]) for t in types]
        return pa.RecordBatch.from_arrays([pa.array([doc_type] * n, pa.string()), nulls, nulls, *arrays], schema=schema)

    for batch in batches:
        records: dict[str, list[tuple]] = {k.doc_type: [] for k in reader.kinds}
        left = []
        for i, raw in enumerate(batch.column("text").cast(pa.binary())):
            value = raw.as_py()
            try:
                if value is None:
                    raise NotPlain
                kind, found = reader.read(value.decode())
            except (NotPlain, UnicodeDecodeError):
                left.append(i)
                continue
            if not keep:
                continue
            rows = records[kind.doc_type]
            rows += found
            if len(rows) >= RECORDS:
                yield sent(kind, rows)
                records[kind.doc_type] = []
        for kind in reader.kinds:
            if records[kind.doc_type]:
                yield sent(kind, records[kind.doc_type])
        if left:
            rest, n = batch.take(pa.array(left, pa.int32())), len(left)
            nulls = [pa.nulls(n, types[t]) for t in types]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), rest.column("path"), rest.column("text"), *nulls], schema=schema)

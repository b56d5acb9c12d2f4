"""Shredding XML documents into a flat, pre-ordered node array.

One row in, one row out: a document becomes its own array of nodes, so every
later per-document step is a narrow projection and nothing is shuffled. The only
Python in the conversion path is the tokeniser below; it knows nothing about
mapping rules.

Node ids count from 0 in document order, hence the subtree of a node is the id
range ``id .. last`` and a parent always precedes its children. ``text`` is the
first own text run; the text of a whole subtree is ``body[t0:t1]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tradeloom import ship_with_tasks
from tradeloom.functions import record, transform

ship_with_tasks(__name__)

NODE_TYPE = (
    "struct<id:int,parent:int,last:int,name:string,attrs:map<string,string>,"
    "text:string,t0:int,t1:int,filled:boolean,anc:array<int>>"
)
# What a worker holds: a node takes some hundred bytes before it is an Arrow row.
_FLUSH_NODES = 20_000
_FLUSH_CHARS = 4_000_000


class _Batch:
    """Column buffers for the nodes of several documents."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.last: list[int] = []
        self.name: list[str] = []
        self.text: list[str | None] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.filled: list[bool] = []
        self.ids: list[int] = []
        self.anc: list[int] = []
        self.anc_offsets: list[int] = [0]
        self.attr_keys: list[str] = []
        self.attr_values: list[str] = []
        self.attr_offsets: list[int] = [0]
        self.doc_offsets: list[int] = [0]
        self.bodies: list[str | None] = []
        self.errors: list[str | None] = []
        self.chars = 0

    def cut(self, mark: tuple[int, int, int]) -> None:
        """Drop a half-read document."""
        nodes, ancestors, attributes = mark
        for column in (self.parent, self.last, self.name, self.text, self.t0,
                       self.t1, self.filled, self.ids):
            del column[nodes:]
        del self.anc[ancestors:], self.anc_offsets[nodes + 1:]
        del self.attr_keys[attributes:], self.attr_values[attributes:]
        del self.attr_offsets[nodes + 1:]

    def arrays(self) -> list[pa.Array]:
        i32 = pa.int32()
        anc = pa.ListArray.from_arrays(pa.array(self.anc_offsets, i32), pa.array(self.anc, i32))
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, i32),
            pa.array(self.attr_keys, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        nodes = pa.StructArray.from_arrays(
            [
                pa.array(self.ids, i32), pa.array(self.parent, i32),
                pa.array(self.last, i32), pa.array(self.name, pa.string()), attrs,
                pa.array(self.text, pa.string()), pa.array(self.t0, i32),
                pa.array(self.t1, i32), pa.array(self.filled, pa.bool_()), anc,
            ],
            names=["id", "parent", "last", "name", "attrs", "text", "t0", "t1",
                   "filled", "anc"],
        )
        return [
            pa.array(self.bodies, pa.string()),
            pa.ListArray.from_arrays(pa.array(self.doc_offsets, i32), nodes),
            pa.array(self.errors, pa.string()),
        ]


def _read_document(content: bytes, out: _Batch) -> None:
    """Append one document to the batch, or an error if it is not well formed."""
    base = len(out.ids)
    mark = (base, len(out.anc), len(out.attr_keys))
    pieces: list[str] = []
    path: list[int] = []
    run = [0]  # per open element: 0 no text yet, 1 inside first run, 2 past it
    position = blanks_passed = 0
    before: list[int] = []

    def end_run(*_: object) -> None:
        if run[-1] == 1:
            run[-1] = 2

    def start(name: str, attributes: dict[str, str]) -> None:
        end_run()
        run.append(0)
        out.ids.append(len(out.ids) - base)
        out.parent.append(path[-1] if path else -1)
        out.last.append(0)
        out.name.append(name.rsplit("}", 1)[-1])
        out.text.append(None)
        out.t0.append(position)
        out.t1.append(0)
        out.filled.append(False)
        out.anc.extend(path)
        out.anc_offsets.append(len(out.anc))
        out.attr_keys.extend(attributes)
        out.attr_values.extend(attributes.values())
        out.attr_offsets.append(len(out.attr_keys))
        path.append(out.ids[-1])
        before.append(blanks_passed)

    def end(_name: str) -> None:
        row = base + path.pop()
        run.pop()
        out.last[row] = out.ids[-1]
        out.t1[row] = position
        out.filled[row] = blanks_passed > before.pop()

    def characters(data: str) -> None:
        nonlocal position, blanks_passed
        pieces.append(data)
        position += len(data)
        if not data.isspace():
            blanks_passed += 1
        if run[-1] == 0:
            run[-1] = 1
            out.text[base + path[-1]] = data
        elif run[-1] == 1:
            out.text[base + path[-1]] += data

    def other(data: str) -> None:
        if data.startswith("&"):  # an entity left unexpanded splits the text
            end_run()

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.CharacterDataHandler = characters
    parser.CommentHandler = end_run
    parser.ProcessingInstructionHandler = end_run
    parser.DefaultHandler = other
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, ValueError, LookupError) as exc:
        out.cut(mark)
        out.bodies.append(None)
        out.errors.append(f"Invalid XML: {exc}")
    else:
        out.bodies.append("".join(pieces))
        out.chars += position
        out.errors.append(None)
    out.doc_offsets.append(len(out.ids))


def _shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [name for name in batch.schema.names if name != "content"]
        contents = batch.column("content")
        begin, buffers = 0, _Batch()
        for row in range(batch.num_rows):
            value = contents[row].as_py()
            _read_document(b"" if value is None else value, buffers)
            full = len(buffers.ids) >= _FLUSH_NODES or buffers.chars >= _FLUSH_CHARS
            if full or row == batch.num_rows - 1:
                part = batch.slice(begin, row + 1 - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in kept] + buffers.arrays(),
                    names=[*kept, "body", "nodes", "parse_error"],
                )
                begin, buffers = row + 1, _Batch()


def shred(docs: DataFrame) -> DataFrame:
    """Parse the ``content`` column (binary) of every row.

    Returns the other columns plus ``body``, ``nodes`` and ``parse_error``. A
    malformed document keeps its row: no nodes and an error text.
    """
    if not isinstance(docs.schema["content"].dataType, T.BinaryType):
        docs = docs.withColumn("content", F.col("content").cast("binary"))
    kept = T.StructType([f for f in docs.schema.fields if f.name != "content"])
    extra = T.StructType.fromDDL(
        f"body string, nodes array<{NODE_TYPE}>, parse_error string"
    )
    return docs.mapInArrow(_shred_batches, T.StructType(kept.fields + extra.fields))


def whole_text(n: str) -> str:
    """All text below a node, in document order (SQL expression text)."""
    return f"substring(body, {n}.t0 + 1, {n}.t1 - {n}.t0)"


def node_path(n: str) -> str:
    """Slash-separated local names from the root down to the node."""
    names = transform(f"{n}.anc", lambda i: f"get(nodes, {i}).name")
    return f"concat('/', array_join(concat({names}, array({n}.name)), '/'))"


def explode_nodes(shredded: DataFrame) -> DataFrame:
    """The node table in relational form: one row per element, with its path.

    Rows are finished inside the array, so that only they and the keys are exploded;
    the document's text and nodes are not copied to every row.
    """
    keys = [c for c in shredded.columns if c not in ("body", "nodes", "parse_error")]
    rows = transform("nodes", lambda n: record(
        node_id=f"{n}.id", parent_id=f"{n}.parent", depth=f"size({n}.anc)",
        local_name=f"{n}.name", path=node_path(n), text_first=f"{n}.text",
        text_all=whole_text(n), attrs=f"{n}.attrs",
    ))
    return shredded.selectExpr(*keys, f"explode({rows}) AS n").select(*keys, "n.*")

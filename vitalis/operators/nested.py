"""Nested JSON documents into flat node tables linked by interval labels.

A depth-first traversal numbers every node of a document when it is entered (pre) and when it is left (post). Node a
encloses node b exactly if a.pre < b.pre and b.post < a.post; so the tables of all node types stay linked without any
foreign key, and a link between two types is an interval comparison within one document.

Defined results: a document stored as a JSON string is the document in that string, however often it is wrapped; JSON in
other strings is text. Null, empty, broken and non-standard JSON (NaN, text after the end) gives no nodes. Of equal
member names the last counts. Nesting has no limit: what is too deep for the fast parser goes to one without recursion.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vitalis.session import ship


def _not_standard(name: str):
    raise ValueError(f"{name} is no JSON")


#: No number's value is asked for; a float takes integers of any length, which int() refuses to read.
_decode = json.JSONDecoder(parse_constant=_not_standard, parse_int=float).decode
_space = re.compile(r"[ \t\n\r]*").match
_number = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?").match
_words = {"true": True, "false": False, "null": None}


def parse(text: str | None):
    """(document, whether there is one): strings that hold a document are opened."""
    found = False
    doc = text
    while isinstance(doc, str):
        try:
            doc = _decode(doc)
        except RecursionError:
            try:
                doc = parse_deep(doc)
            except ValueError:
                return None, False
        except ValueError:
            return None, False
        found = True
    return doc, found


def parse_deep(text: str):
    """The same JSON without recursion; containers under way are kept on a list."""
    out: list = [None]  # holds the document at its end
    under_way: list[tuple[object, str | None]] = []
    here: object = out
    key: str | None = None
    i = _space(text, 0).end()

    def put(value) -> None:
        if isinstance(here, dict):
            here[key] = value
        elif here is out:
            out[0] = value
        else:
            here.append(value)

    def member(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("a member name is missing")
        name, i = json.decoder.scanstring(text, i + 1, True)
        i = _space(text, i).end()
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return name, _space(text, i + 1).end()

    while True:
        c = text[i : i + 1]
        opened = False
        if c in ("{", "["):
            new: object = {} if c == "{" else []
            put(new)
            under_way.append((here, key))
            here, key = new, None
            i = _space(text, i + 1).end()
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                opened = True
                if c == "{":
                    key, i = member(i)
        elif c == '"':
            value, i = json.decoder.scanstring(text, i + 1, True)
            put(value)
        elif m := _number(text, i):
            put(float(m.group()))
            i = m.end()
        else:
            for word, value in _words.items():
                if text.startswith(word, i):
                    put(value)
                    i += len(word)
                    break
            else:
                raise ValueError("no value")
        if opened:
            continue
        while True:
            i = _space(text, i).end()
            if not under_way:
                if i != len(text):
                    raise ValueError("text after the end")
                return out[0]
            c = text[i : i + 1]
            if c == ",":
                i = _space(text, i + 1).end()
                if isinstance(here, dict):
                    key, i = member(i)
                break
            if c != ("}" if isinstance(here, dict) else "]"):
                raise ValueError("a container isn't closed")
            i += 1
            here, key = under_way.pop()


class Node:
    """A node with its interval; its path is put together when asked for, as paths of all nodes would be quadratic in the depth."""

    __slots__ = ("around", "step", "value", "pre", "post")

    def __init__(self, around: Node | None, step: str, value, pre: int):
        self.around, self.step, self.value, self.pre, self.post = around, step, value, pre, pre

    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.around
        return "".join(reversed(steps))


def label(doc) -> list[Node]:
    """Every node in order of pre, numbered by a depth-first traversal without recursion."""
    nodes: list[Node] = []
    clock = 0
    todo: list = [(None, "$", doc)]
    while todo:
        top = todo.pop()
        if isinstance(top, Node):  # the node is left
            top.post = clock
            clock += 1
            continue
        node = Node(*top, clock)
        clock += 1
        nodes.append(node)
        v = node.value
        if isinstance(v, (dict, list)) and v:
            todo.append(node)
            inner = [(node, f".{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(node, f"[{k}]", x) for k, x in enumerate(v)]
            todo.extend(reversed(inner))
        else:
            node.post = clock
            clock += 1
    return nodes


def nearest_enclosing(labels: list[tuple[int, int]]) -> list[int]:
    """For (pre, post) labels in order of pre, the index of the smallest interval around each, or -1."""
    out, around = [], []
    for i, (_, post) in enumerate(labels):
        while around and labels[around[-1]][1] < post:
            around.pop()
        out.append(around[-1] if around else -1)
        around.append(i)
    return out


def node_table(df: DataFrame, id_col: str, doc_col: str, type_member: str) -> DataFrame:
    """(id, path, parent_path, type, pre, post): the objects that have a non-empty text in type_member.

    parent_path is the path of the nearest enclosing such object, found by interval containment; empty if there is none.
    """
    id_type = df.schema[id_col].dataType
    schema = StructType(
        [StructField("id", id_type), *[StructField(n, StringType()) for n in ("path", "parent_path", "type")], StructField("pre", LongType()), StructField("post", LongType())]
    )
    arrow = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}.get(id_type.typeName())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc, there = parse(text.as_py())
                if not there:
                    continue
                typed = [n for n in label(doc) if isinstance(n.value, dict) and isinstance(n.value.get(type_member), str) and n.value[type_member]]
                paths = [n.path() for n in typed]
                for n, path, parent in zip(typed, paths, nearest_enclosing([(n.pre, n.post) for n in typed])):
                    row = (key, path, paths[parent] if parent >= 0 else "", n.value[type_member], n.pre, n.post)
                    for c, x in zip(columns, row):
                        c.append(x)
            yield pa.record_batch([pa.array(columns[0], arrow or batch.schema.types[0]), *[pa.array(c, pa.string()) for c in columns[1:4]], *[pa.array(c, pa.int64()) for c in columns[4:]]], names)

    names = schema.names
    ship(df.sparkSession)
    return df.select(F.col(id_col), F.col(doc_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def type_tables(nodes: DataFrame, types: list[str], type_col: str = "type") -> dict[str, DataFrame]:
    """A table per node type; link() joins two of them."""
    return {t: nodes.where(F.col(type_col) == t) for t in types}


def link(outer: DataFrame, inner: DataFrame, id_col: str) -> DataFrame:
    """(id, outer_path, inner_path): all pairs of an enclosing and an enclosed node of the same document."""
    o = outer.select(F.col(id_col).alias("__id"), F.col("path").alias("outer_path"), F.col("pre").alias("__pre"), F.col("post").alias("__post"))
    inside = (F.col(id_col) == F.col("__id")) & (F.col("__pre") < F.col("pre")) & (F.col("post") < F.col("__post"))
    return inner.join(o, inside).select(id_col, "outer_path", F.col("path").alias("inner_path"))

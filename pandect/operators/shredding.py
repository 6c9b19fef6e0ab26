"""Nested documents to flat tables through an adjacency table.

``adjacency`` turns every document into nodes: node number, parent, label,
ordinal, kind and scalar value. Entity tables come from joining the object
nodes with their scalar children, pivoted by label; lists of scalars and keys
of objects are selections of nodes. Every row keeps the document's key, its
node and its parent, so child rows lead back to their parent's.

Documents are JSON text, or typed columns rendered as JSON. Nodes are made by
an Arrow-batched parser rather than by SQL's JSON functions, because those
need the shape in advance, and here one column holds several encodings.

Cases: null, empty and broken text give no nodes; a JSON string that holds
JSON itself is opened (once more for each such layer); of a key given twice in
an object the last counts; nulls are nodes of kind 'null'; depth is not
limited (parser and walk keep their own stacks), nor is the number of nodes.
A node's path is spelled down to ``PATH_DEPTH`` levels, since spelling every
path of a deep document takes space in the square of its depth; below it is
null and the way leads over the parents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nodes in one batch that the parser hands back.
BATCH_NODES = 50_000
PATH_DEPTH = 64

NODE = T.StructType(
    [
        T.StructField("node", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("scalar", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)


_BLANKS = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
_ESCAPED = str.maketrans({c: f"\\{c}" for c in "\\.[]"})


def _deep(text: str):
    """The value of a JSON text of any depth: a parser with a stack of its own,
    for texts on which the library's recursion gives up."""
    space, at, done = _BLANKS.match, 0, False
    top: list = []
    stack: list = [top]  # open containers; an object waits as [object, key]

    def put(value) -> None:
        holder = stack[-1]
        if isinstance(holder, tuple):
            holder[0][holder[1].pop()] = value
        else:
            holder.append(value)

    def key(at: int) -> int:
        at = space(text, at).end()
        if text[at : at + 1] != '"':
            raise ValueError("key expected")
        name, at = scanstring(text, at + 1)
        at = space(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError(": expected")
        stack[-1][1].append(name)
        return at + 1

    while not done:
        at = space(text, at).end()
        c = text[at : at + 1]
        if c in ("{", "["):
            made: dict | list = {} if c == "{" else []
            put(made)
            at = space(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                stack.append((made, []) if c == "{" else made)
                at = key(at) if c == "{" else at
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
            put(value)
        elif m := _SCALAR.match(text, at):
            put(json.loads(m.group()))
            at = m.end()
        else:
            raise ValueError("value expected")
        # A value ended: so may the containers around it.
        while True:
            at = space(text, at).end()
            if stack[-1] is top:
                done = True
                break
            c, inside = text[at : at + 1], isinstance(stack[-1], tuple)
            at += 1
            if c == ",":
                at = key(at) if inside else at
                break
            if c != ("}" if inside else "]"):
                raise ValueError(", or end expected")
            stack.pop()
    if at != len(text):
        raise ValueError("more than one value")
    return top[0]


def _value(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def nodes_of(text: str | None) -> list[tuple]:
    """Nodes of one document in document order; the root is node 0.

    ``path`` names the way from the root: list elements are ``[]`` and keys
    ``.key``, with a backslash before each of ``\\ . [ ]`` in a key.
    """
    if text is None:
        return []
    try:
        value = _value(text)
        while isinstance(value, str) and value.lstrip()[:1] in ('"', "{", "["):
            value = _value(value)
    except ValueError:
        return []
    out: list[tuple] = []
    stack: list[tuple] = [(value, None, None, None, "$", 0)]
    while stack:
        v, parent, label, ordinal, path, depth = stack.pop()
        n, below = len(out), depth + 1
        way = path if depth < PATH_DEPTH else None
        if isinstance(v, dict):
            out.append((n, parent, label, ordinal, "object", None, path))
            stack.extend((x, n, k, i, way and f"{way}.{k.translate(_ESCAPED)}", below) for i, (k, x) in reversed(list(enumerate(v.items(), 1))))
        elif isinstance(v, list):
            out.append((n, parent, label, ordinal, "array", None, path))
            stack.extend((x, n, None, i, way and f"{way}[]", below) for i, x in reversed(list(enumerate(v, 1))))
        elif v is None:
            out.append((n, parent, label, ordinal, "null", None, path))
        elif isinstance(v, bool):
            out.append((n, parent, label, ordinal, "boolean", "true" if v else "false", path))
        elif isinstance(v, str):
            out.append((n, parent, label, ordinal, "string", v, path))
        else:
            out.append((n, parent, label, ordinal, "number", repr(v), path))
    return out


def adjacency(documents: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys`` and the columns of ``NODE`` for each node of each document."""
    source = documents.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    schema = T.StructType([*[source.schema[k] for k in keys], *NODE])
    names = [f.name for f in NODE]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at: list[int] = []
            made: list[tuple] = []

            def block() -> pa.RecordBatch:
                taken = pa.array(at, pa.int32())
                columns = [batch.column(i).take(taken) for i in range(len(keys))]
                flat = list(zip(*made, strict=True)) if made else [()] * len(names)
                return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, k) for c, k in zip(flat, kinds, strict=True)]], names=[*keys, *names])  # noqa: B023

            for i in range(batch.num_rows):
                nodes = nodes_of(texts[i].as_py())
                at.extend([i] * len(nodes))
                made.extend(nodes)
                if len(made) >= BATCH_NODES:
                    yield block()
                    at, made = [], []
            yield block()

    return source.mapInArrow(shred, schema)


def entities(nodes: DataFrame, keys: Sequence[str], objects, labels: Sequence[str]) -> DataFrame:
    """Object nodes (those for which ``objects`` holds) joined with their scalar
    children: ``keys``, ``node``, ``parent``, ``label``, ``ordinal``, ``path``
    and one column per label, null where the field is absent or null."""
    own = nodes.where(F.col("kind") == "object").where(objects).select(*keys, "node", "parent", "label", "ordinal", "path")
    leaf = nodes.where(F.col("kind").isin("string", "number", "boolean") & F.col("label").isin(*labels))
    pivoted = leaf.groupBy(*keys, F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == x, F.col("scalar"))).alias(f"__{x}") for x in labels])
    joined = own.join(pivoted, [*keys, "node"], "left")
    return joined.select(*keys, "node", "parent", "label", "ordinal", "path", *[F.col(f"__{x}").alias(f"field_{x}") for x in labels])


def census(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each path holds each kind of value: what shapes a column really has."""
    return nodes.groupBy(*keys, "path", "kind").agg(F.count(F.lit(1)).alias("n"))

"""Nested JSON records as related flat tables with Merkle identities."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.session import staged

_SEP = "\x1f"
#: Distinct list fields up to which their names are sent to every task; beyond it they are joined to the records.
LIST_FIELDS_MAX = 20_000


def _decoded(value: object) -> object:
    """What a value stands for: strings that hold a whole JSON object or list, at any depth of encoding, are opened."""
    while isinstance(value, str) and value.lstrip()[:1] in ('{', '[', '"'):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            break
        if not isinstance(inner, (dict, list, str)):
            break
        if isinstance(inner, str) and not _opens(inner):
            break
        value = inner
    return value


def _opens(text: str) -> bool:
    return isinstance(_decoded(text), (dict, list))


def parsed(text: str | None) -> object:
    """The object or list of one metadata string; None for null, blank, damaged or scalar content."""
    if text is None:
        return None
    try:
        root = _decoded(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return root if isinstance(root, (dict, list)) else None


def field_kinds(root: object) -> tuple[set[str], set[str]]:
    """Field paths (keys only) of a record that hold lists, and those that hold an object outside a list."""
    lists: set[str] = set()
    lone: set[str] = set()
    todo = [(root, "", False)]
    while todo:
        value, path, inside = todo.pop()
        value = _decoded(value)
        if isinstance(value, list):
            if path:
                lists.add(path)
            todo += [(x, path, True) for x in value]
        elif isinstance(value, dict):
            if path and not inside:
                lone.add(path)
            todo += [(x, f"{path}{_SEP}{k}" if path else k, False) for k, x in value.items()]
    return lists, lone


def nodes_of(root: object, lists: set[str] | frozenset[str]) -> list[tuple]:
    """Every object of a record, children before parents.

    Returns (node_path, parent_path, owner_path, field, ordinal, is_element, node_hash, owner_hash, body): owner is
    the enclosing object of any kind, parent the nearest enclosing object that is itself a list element. Hashes are
    built bottom-up over sorted keys, with nested objects replaced by their hashes. The walk keeps its own stack, so
    depth is not limited by recursion.
    """
    out: list[tuple] = []
    # frame: value, path, keys path, parent element path, owner path, field, ordinal, is element, child results
    done: dict[int, object] = {}
    order: list[list] = []
    stack = [[_decoded(root), "", "", "", "", "", 0, False, None]]
    while stack:
        frame = stack.pop()
        order.append(frame)
        value, path, keys, parent, owner, _, _, element, _ = frame
        frame[8] = kids = []
        if isinstance(value, dict):
            below = path if element else parent
            for k, x in value.items():
                x = _decoded(x)
                sub = f"{keys}{_SEP}{k}" if keys else k
                if isinstance(x, dict) and sub in lists:
                    x = [x]
                if isinstance(x, (dict, list)):
                    kid = [x, f"{path}.{k}" if path else k, sub, below, path, k, 0, False, None]
                    kids.append((k, kid))
                    stack.append(kid)
                else:
                    kids.append((k, x))
        else:
            for i, x in enumerate(value):
                x = _decoded(x)
                if isinstance(x, (dict, list)):
                    kid = [x, f"{path}[{i}]", keys, parent, owner, frame[5], i, isinstance(x, dict), None]
                    kids.append((i, kid))
                    stack.append(kid)
                else:
                    kids.append((i, x))
    owners: dict[str, str] = {}
    for frame in reversed(order):
        value, path, _, parent, owner, field, ordinal, element, kids = frame
        shown = [(k, done[id(x)] if isinstance(x, list) and id(x) in done else x) for k, x in kids]
        if isinstance(value, dict):
            body = json.dumps({str(k): x for k, x in shown}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            digest = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            done[id(frame)] = {"#": digest}
            owners[path] = digest
            out.append([path, parent, owner, field, ordinal, element, digest, body])
        else:
            done[id(frame)] = [x for _, x in shown]
    return [(p, par, own, f, i, el, h, owners.get(own, "") if p != own or p else "", b) for p, par, own, f, i, el, h, b in out]


_NODE_SCHEMA = (
    "record_id string, node_path string, parent_path string, owner_path string, field string, ordinal int, "
    "is_element boolean, node_hash string, owner_hash string, body string"
)
_NODE_ARROW = pa.schema(
    [("record_id", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("owner_path", pa.string()),
     ("field", pa.string()), ("ordinal", pa.int32()), ("is_element", pa.bool_()), ("node_hash", pa.string()),
     ("owner_hash", pa.string()), ("body", pa.string())]
)


def _kinds_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the distinct list fields: rows leave the task already merged."""
    for b in batches:
        lists: set[str] = set()
        for text in b.column(0).to_pylist():
            lists |= field_kinds(parsed(text))[0]
        yield pa.RecordBatch.from_pydict({"field_path": sorted(lists)}, schema=pa.schema([("field_path", pa.string())]))


def _lone_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in sorted(field_kinds(parsed(t))[1])]
        yield pa.RecordBatch.from_pydict({"record_id": [r[0] for r in rows], "field_path": [r[1] for r in rows]}, schema=pa.schema([("record_id", pa.string()), ("field_path", pa.string())]))


def _nodes_arrow(names: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            own = b.column(2).to_pylist() if names is None else None
            rows: list[tuple] = []
            for n, (i, t) in enumerate(zip(ids, texts)):
                root = parsed(t)
                if root is not None:
                    rows += [(i, *x) for x in nodes_of(root, names if own is None else frozenset(own[n] or ()))]
            cols = list(zip(*rows)) if rows else [[]] * len(_NODE_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE_ARROW)], schema=_NODE_ARROW)

    return run


@dataclass
class FlatRecords:
    """Related tables of a set of nested records."""

    nodes: DataFrame  #: every occurrence of an object, with both hashes
    objects: DataFrame  #: (node_hash, body): identical objects once
    bridge: DataFrame  #: (record_id, owner_hash, owner_path, field, ordinal, node_hash, node_path, parent_path, is_element)


def flatten_records(df: DataFrame, record_id: str, metadata: str, list_fields_max: int = LIST_FIELDS_MAX) -> FlatRecords:
    """Flat related tables of the JSON column `metadata`.

    Objects are canonicalised and hashed bottom-up; `objects` holds each distinct object once, `bridge` one row per
    occurrence with its owner and its ordinal. Values stored as JSON strings count as what they stand for. A lone
    object in a field that holds lists in other records is element 0: the names of list fields are gathered first, and
    either sent to the tasks, if they are at most `list_fields_max`, or joined to the records that need them.

    Defined results: null, blank, scalar or damaged metadata gives no rows; null list elements keep their position;
    rows of one record id that repeat count once; of differing contents under one id each counts; a null id is an id;
    objects nested deeper than Python's JSON reader allows count as damaged; an empty input gives empty tables. Other
    columns are ignored, whatever their names.
    """
    picked = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(metadata).alias("text"))
    picked = picked.filter(F.col("text").isNotNull()).dropDuplicates(["record_id", "text"])
    fields = picked.select("text").mapInArrow(_kinds_arrow, "field_path string").distinct()
    names = [r[0] for r in fields.limit(list_fields_max + 1).collect()]
    if len(names) <= list_fields_max:
        nodes = picked.mapInArrow(_nodes_arrow(frozenset(names)), _NODE_SCHEMA)
    else:
        lone = picked.mapInArrow(_lone_arrow, "record_id string, field_path string").distinct()
        lone = lone.join(fields, "field_path", "left_semi").groupBy("record_id").agg(F.collect_set("field_path").alias("own"))
        joined = picked.alias("p").join(lone.alias("l"), F.col("p.record_id").eqNullSafe(F.col("l.record_id")), "left")
        nodes = joined.select("p.record_id", "p.text", "l.own").mapInArrow(_nodes_arrow(None), _NODE_SCHEMA)
    nodes = staged(nodes)
    objects = nodes.groupBy("node_hash").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("occurrences"))
    return FlatRecords(nodes, objects, nodes.drop("body"))

"""Reads and edits of JSON paths inside documents.

Lookups of plain paths are built-in functions. Edits keep the text of numbers and the order of members, which built-ins
do not, so they are one Arrow-batched function that folds a list of operations over a document.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a path and of a list of operations, the flag that makes parents, and the range of counters.
PATH_PARTS, PATH_BYTES, OPERATIONS = 32, 1024, 16
MAKE_PARENTS = 0x01
INT64 = (-(1 << 63), (1 << 63) - 1)

_PART = re.compile(r"`((?:[^`]|``)*)`|\[(-?\d+)\]|([^.\[\]`]+)")


class Fault(Exception):
    """Carries the status of an operation that failed."""


class Number(str):
    """A number with its text."""


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


# One decoder for all documents: json.loads makes one a call if it is given options.
loads = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse).decode
_quoted = json.encoder.encode_basestring
_WORDS = {None: "null", True: "true", False: "false"}


def dumps(value: Any) -> str:
    if isinstance(value, Number):
        return str.__str__(value)
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join([_quoted(k) + ":" + dumps(v) for k, v in value.items()]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return _WORDS[value]


def parse_path(path: str) -> list[str | int]:
    """Member names and array positions; a name in backticks may hold any character, a backtick in it is doubled."""
    if len(path.encode()) > PATH_BYTES:
        raise Fault("path_too_big")
    parts: list[str | int] = []
    at = 0
    while at < len(path):
        if parts and path[at] == ".":
            at += 1
        elif parts and path[at] != "[":
            raise Fault("path_invalid")
        m = _PART.match(path, at)
        if not m:
            raise Fault("path_invalid")
        if m[2] is not None:
            if int(m[2]) < -1:
                raise Fault("path_invalid")
            parts.append(int(m[2]))
        else:
            parts.append(m[1].replace("``", "`") if m[1] is not None else m[3])
        at = m.end()
    if len(parts) > PATH_PARTS:
        raise Fault("path_too_deep")
    return parts


#: Paths are few and documents many, so a path is parsed once in a worker. What it returns is not to be changed.
_parsed = lru_cache(1024)(parse_path)


def _child(value: Any, part: str | int) -> Any:
    if isinstance(part, int):
        if not isinstance(value, list):
            raise Fault("path_mismatch")
        if part >= len(value) or not value:
            raise Fault("path_missing")
        return value[part]
    if not isinstance(value, dict):
        raise Fault("path_mismatch")
    if part not in value:
        raise Fault("path_missing")
    return value[part]


def find(value: Any, parts: list[str | int]) -> Any:
    for part in parts:
        value = _child(value, part)
    return value


def _parent(root: Any, parts: list[str | int], make: bool) -> Any:
    """The container of a path's last part; missing objects on the way are made if wanted."""
    for k, part in enumerate(parts[:-1]):
        try:
            root = _child(root, part)
        except Fault as fault:
            if not (make and fault.args[0] == "path_missing" and isinstance(part, str) and isinstance(parts[k + 1], str)):
                raise
            root[part] = {}
            root = root[part]
    return root


def _values(text: str) -> list[Any]:
    try:
        found = loads(f"[{text}]")
    except ValueError:
        raise Fault("value_cannot_insert") from None
    if not found:
        raise Fault("value_cannot_insert")
    return found


def _one(text: str) -> Any:
    found = _values(text)
    if len(found) != 1:
        raise Fault("value_cannot_insert")
    return found[0]


@dataclass
class Doc:
    root: Any


def _array(doc: Doc, parts: list[str | int], make: bool) -> list:
    try:
        found = find(doc.root, parts)
    except Fault as fault:
        if not (make and fault.args[0] == "path_missing" and isinstance(parts[-1], str)):
            raise
        found = _parent(doc.root, parts, True)[parts[-1]] = []
    if not isinstance(found, list):
        raise Fault("path_mismatch")
    return found


def _set(doc: Doc, parts: list[str | int], value: Any, make: bool, exists: bool | None) -> None:
    if not parts or (exists is not True and isinstance(parts[-1], int)):
        raise Fault("path_invalid")
    owner, last = _parent(doc.root, parts, make), parts[-1]
    if isinstance(last, int):
        _child(owner, last)
        owner[last] = value
        return
    if not isinstance(owner, dict):
        raise Fault("path_mismatch")
    if exists is True and last not in owner:
        raise Fault("path_missing")
    if exists is False and last in owner:
        raise Fault("path_exists")
    owner[last] = value


def _insert(doc: Doc, parts: list[str | int], values: list[Any]) -> None:
    if not parts or not isinstance(parts[-1], int) or parts[-1] < 0:
        raise Fault("path_invalid")
    found = find(doc.root, parts[:-1])
    if not isinstance(found, list):
        raise Fault("path_mismatch")
    if parts[-1] > len(found):
        raise Fault("path_missing")
    found[parts[-1] : parts[-1]] = values


def _add_unique(doc: Doc, parts: list[str | int], value: Any, make: bool) -> None:
    if isinstance(value, dict | list):
        raise Fault("value_cannot_insert")
    found = _array(doc, parts, make)
    if any(isinstance(x, dict | list) for x in found):
        raise Fault("path_mismatch")
    if dumps(value) in map(dumps, found):
        raise Fault("path_exists")
    found.append(value)


def _count(doc: Doc, parts: list[str | int], text: str, make: bool) -> str:
    if not re.fullmatch(r"-?\d+", text) or not INT64[0] <= int(text) <= INT64[1] or int(text) == 0:
        raise Fault("delta_invalid")
    try:
        have = find(doc.root, parts)
        if not isinstance(have, Number) or not re.fullmatch(r"-?\d+", have):
            raise Fault("path_mismatch")
        if not INT64[0] <= int(have) <= INT64[1]:
            raise Fault("number_too_big")
    except Fault as fault:
        if fault.args[0] != "path_missing":
            raise
        have = Number("0")
    total = int(have) + int(text)
    if not INT64[0] <= total <= INT64[1]:
        raise Fault("value_overflow")
    new = Number(str(total))
    owner, last = _parent(doc.root, parts, make), parts[-1]
    if isinstance(last, int):
        _child(owner, last)
    elif not isinstance(owner, dict):
        raise Fault("path_mismatch")
    owner[last] = new
    return str(new)


def apply_one(doc: Doc, op: str, path: str, value: str, flags: int) -> str | None:
    """Does one operation; returns what it reads."""
    parts, make = _parsed(path), bool(flags & MAKE_PARENTS)
    if op == "get":
        return dumps(find(doc.root, parts))
    if op == "exists":
        find(doc.root, parts)
        return None
    if op == "count":
        found = find(doc.root, parts)
        if not isinstance(found, dict | list):
            raise Fault("path_mismatch")
        return str(len(found))
    if op == "counter":
        return _count(doc, parts, value, make)
    if op == "delete":
        if not parts:
            raise Fault("path_invalid")
        owner = find(doc.root, parts[:-1])
        _child(owner, parts[-1])
        del owner[parts[-1]]
    elif op == "push_last":
        _array(doc, parts, make).extend(_values(value))
    elif op == "push_first":
        _array(doc, parts, make)[:0] = _values(value)
    elif op == "insert":
        _insert(doc, parts, _values(value))
    elif op == "add_unique":
        _add_unique(doc, parts, _one(value), make)
    elif op in ("add", "upsert", "replace"):
        _set(doc, parts, _one(value), make, {"add": False, "upsert": None, "replace": True}[op])
    else:
        raise Fault("unknown_operation")
    return None


def apply_all(text: str | None, ops: list[dict]) -> tuple[str, str | None, int | None, list[str | None]]:
    """(status, document, index of the first failure, results): all of the operations or none."""
    if len(ops) > OPERATIONS:
        return "too_many_paths", text, None, []
    try:
        doc = Doc(loads(text or ""))
    except ValueError:
        return "doc_not_json", text, None, []
    results: list[str | None] = []
    for k, op in enumerate(ops):
        try:
            results.append(apply_one(doc, op["op"], op["path"], op.get("value") or "", op.get("flags") or 0))
        except Fault as fault:
            return fault.args[0], text, k, []
    return "success", dumps(doc.root), None, results


def fold(doc: Column, ops: Column) -> Column:
    """struct<status, doc, failed, results> of array<struct<op, path, value, flags>> applied to a JSON document."""

    @F.arrow_udf("status string, doc string, failed int, results array<string>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        fields = [lists.values.field(k).to_pylist() for k in ("op", "path", "value", "flags")]
        ops = [{"op": o, "path": p, "value": v, "flags": f} for o, p, v, f in zip(*fields, strict=True)]
        ends = lists.offsets.to_pylist()
        rows = [apply_all(t, ops[a:b] if has else []) for t, a, b, has in zip(texts.to_pylist(), ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
        status, docs, failed, results = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
        return pa.StructArray.from_arrays([pa.array(status, pa.string()), pa.array(docs, pa.string()), pa.array(failed, pa.int32()), pa.array(results, pa.list_(pa.string()))], ["status", "doc", "failed", "results"])

    return run(doc, ops)


def operation(op: str, path: str, value: Column | str = "", flags: int = 0) -> Column:
    return F.struct(F.lit(op).alias("op"), F.lit(path).alias("path"), (value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(flags).alias("flags"))


def get(doc: Column, path: str) -> Column:
    """JSON text at a plain path, null if missing."""
    return F.get_json_object(doc, f"$.{path}")


def exists(doc: Column, path: str) -> Column:
    """Whether a plain path is there, a JSON null included."""
    return F.try_variant_get(F.try_parse_json(doc), f"$.{path}", "variant").isNotNull()


def count(doc: Column) -> Column:
    """Members of a JSON object or array at the root."""
    return F.coalesce(F.json_array_length(doc), F.size(F.json_object_keys(doc))).cast("long")


# Bits of an operation list's flags for the document as a whole.
MAKE_DOCUMENT, ONLY_NEW, SEE_DELETED, MAKE_DELETED, REVIVE = 0x01, 0x02, 0x04, 0x08, 0x10


def document_status(doc: Column, deleted: Column, flags: Column) -> Column:
    """What an edit of a document that is absent (null), deleted or there comes to under its flags, before its operations are looked at."""
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    seen = doc.isNotNull() & (~deleted | has(SEE_DELETED))
    bad = has(MAKE_DOCUMENT) & has(ONLY_NEW) | has(MAKE_DELETED) & ~(has(MAKE_DOCUMENT) | has(ONLY_NEW)) | has(REVIVE) & has(MAKE_DELETED)
    made = ~seen & (has(MAKE_DOCUMENT) | has(ONLY_NEW))
    return F.when(bad, "invalid_arguments").when(has(REVIVE) & doc.isNotNull() & ~deleted, "cannot_revive_living").when(seen & has(ONLY_NEW), "key_already_exists").when(~seen & ~made, "no_such_key").when(made, "made").otherwise("success")


def edit_document(doc: Column, deleted: Column, flags: Column, ops: Column) -> Column:
    """struct<status, doc, deleted, results>: the list applied under its flags; a made document starts as {} and its operations make parents.

    Attributes come before the body in a list: an operation list is in phases already, since it is sorted here by whether it
    is of the whole document. Operations `set_doc` and `delete_doc` replace or remove the body after all others.
    """
    before = document_status(doc, deleted, flags)
    made = before == "made"
    within = F.filter(ops, lambda o: ~o["op"].isin("set_doc", "delete_doc"))
    parents = F.transform(within, lambda o: F.struct(o["op"].alias("op"), o["path"].alias("path"), o["value"].alias("value"), F.when(made, o["flags"].bitwiseOR(F.lit(MAKE_PARENTS))).otherwise(o["flags"]).alias("flags")))
    whole = F.filter(ops, lambda o: o["op"].isin("set_doc", "delete_doc"))
    inner = fold(F.when(made, "{}").otherwise(doc), parents)
    last = F.try_element_at(whole, F.lit(-1))
    ok = before.isin("made", "success")
    status = F.when(~ok, before).when(F.size(whole) > 1, "invalid_combination").otherwise(inner["status"])
    fine = status == "success"
    removed = F.coalesce(last["op"] == "delete_doc", F.lit(False))
    body = F.when(~fine, doc).when(removed, F.lit(None)).when(F.size(whole) == 1, last["value"]).otherwise(inner["doc"])
    dead = F.when(~fine, deleted).when(removed, True).when(made, flags.bitwiseAND(F.lit(MAKE_DELETED)) != 0).when(flags.bitwiseAND(F.lit(REVIVE)) != 0, False).otherwise(deleted)
    return F.struct(status.alias("status"), body.alias("doc"), dead.alias("deleted"), inner["results"].alias("results"))

"""Compiled symbol indexes: protobuf messages read from their wire format, one row for each document.

``documents`` takes (id, content), for example ``spark.read.format("binaryFile")``. An
artifact is decoded by the task that reads it, in numpy: a step takes the next field of every
message of a level at once. Documents leave in batches of about ``TOGETHER`` bytes of wire format.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The fields of each message: number, name, and what it holds; a list repeats.
MESSAGES = {
    "index": {2: ("documents", ["document"]), 3: ("external_symbols", ["symbol"])},
    "document": {1: ("relative_path", "text"), 2: ("occurrences", ["occurrence"]), 3: ("symbols", ["symbol"]), 4: ("language", "text"), 5: ("text", "text")},
    "occurrence": {1: ("range", ["int"]), 2: ("symbol", "text"), 3: ("symbol_roles", "int"), 5: ("syntax_kind", "int"), 7: ("enclosing_range", ["int"])},
    "symbol": {
        1: ("symbol", "text"), 3: ("documentation", ["text"]), 4: ("relationships", ["relationship"]), 5: ("kind", "int"), 6: ("display_name", "text"), 7: ("signature", "signature"), 8: ("enclosing_symbol", "text"),
    },
    "signature": {5: ("text", "text")},  # a document, of which the text is read
    "relationship": {1: ("symbol", "text"), 2: ("is_reference", "bool"), 3: ("is_implementation", "bool"), 4: ("is_type_definition", "bool"), 5: ("is_definition", "bool")},
}
EMPTY = {"text": "", "int": 0, "bool": False}
VARINT, LONG, BYTES, SHORT = 0, 1, 2, 5
SYMBOL = (
    "struct<symbol: string, documentation: array<string>, relationships: array<struct<symbol: string, is_reference: boolean, is_implementation: boolean, is_type_definition: boolean, is_definition: boolean>>, "
    "kind: int, display_name: string, signature: string, enclosing_symbol: string>"
)
OCCURRENCE = "struct<range: array<int>, symbol: string, symbol_roles: int, syntax_kind: int, enclosing_range: array<int>>"
DOCUMENT = f"id long, document int, external boolean, relative_path string, language string, symbols array<{SYMBOL}>, occurrences array<{OCCURRENCE}>"
#: Bytes of wire format that are decoded at a time, a document at least; messages of a level fewer than which are read one by one.
TOGETHER, FEW = 4 << 20, 48


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("an artifact is cut off or malformed")
        byte = raw[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _signed(value: int) -> int:
    """The 32 bits that an int field keeps of a varint."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == VARINT:
            value, at = _varint(raw, at)
        elif kind in (BYTES, LONG, SHORT):
            size, at = _varint(raw, at) if kind == BYTES else ({LONG: 8, SHORT: 4}[kind], at)
            value, at = raw[at : at + size], at + size
            if at > len(raw):
                raise ValueError("an artifact is cut off or malformed")
        else:
            raise ValueError("an artifact has a field of an unknown wire type")
        yield key >> 3, kind, value


def _value(of: str, kind: int, raw: int | bytes):
    if of in MESSAGES:
        return read(of, raw)
    if of == "text":
        return raw.decode(errors="replace")
    return bool(raw) if of == "bool" else _signed(raw)


def read(message: str, raw: bytes) -> dict:
    """A message as a dict with every field that is known; unknown ones are passed over."""
    known = MESSAGES[message]
    out = {name: [] if isinstance(of, list) else EMPTY.get(of) for name, of in known.values()}
    for number, kind, value in fields(raw):
        if number not in known:
            continue
        name, of = known[number]
        one = of[0] if isinstance(of, list) else of
        if (kind == BYTES) != (one not in ("int", "bool")) and not (kind == BYTES and of == ["int"]):
            raise ValueError(f"field {name} of an artifact has the wrong wire type")
        if of == ["int"] and kind == BYTES:  # packed
            at = 0
            while at < len(value):
                number, at = _varint(value, at)
                out[name].append(_signed(number))
        elif isinstance(of, list):
            out[name].append(_value(one, kind, value))
        else:
            out[name] = _value(one, kind, value)
    return out


def _put(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def write(message: str, value: dict) -> bytes:
    """The wire format of a dict as ``read`` gives it; fields that are empty are left out."""
    out = bytearray()
    for number, (name, of) in MESSAGES[message].items():
        held = value.get(name)
        if of == ["int"]:
            items, one = ([b"".join(map(_put, held))] if held else []), "packed"
        else:
            items, one = (held or [], of[0]) if isinstance(of, list) else ([held] if held else [], of)
        for item in items:
            if one in ("int", "bool"):
                out += _put(number << 3 | VARINT) + _put(int(item))
            else:
                body = item if one == "packed" else write(one, item) if one in MESSAGES else item.encode()
                out += _put(number << 3 | BYTES) + _put(len(body)) + body
    return bytes(out)


def _varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varint at each place, and the places after them."""
    value, at, more, shift = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at)), 0
    while len(more):
        if shift > 63 or (at[more] >= end[more]).any():
            raise ValueError("an artifact is cut off or malformed")
        byte = data[at[more]]
        value[more] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
        at[more] += 1
        more, shift = more[byte > 127], shift + 7
    return value, at


def _tokens(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(message, number, wire type, value, end) of the fields of the messages ``data[at:end]``, those of one message in
    order; the value of bytes is where they start. A step reads a field of every message; the last few are read one by one."""
    out, at, rows = [], at.copy(), np.flatnonzero(at < end)
    while len(rows) > FEW:
        key, place = _varints(data, at[rows], end[rows])
        kind = (key & np.uint64(7)).astype(np.int64)
        if not np.isin(kind, (VARINT, LONG, BYTES, SHORT)).all():
            raise ValueError("an artifact has a field of an unknown wire type")
        value, after = np.zeros(len(rows), np.int64), place.copy()
        some = np.flatnonzero((kind == VARINT) | (kind == BYTES))
        number, after[some] = _varints(data, place[some], end[rows[some]])
        value[some] = number.view(np.int64)
        size = np.where(kind == BYTES, value, np.where(kind == LONG, 8, np.where(kind == SHORT, 4, 0)))
        if ((size < 0) | (size > end[rows] - after)).any():
            raise ValueError("an artifact is cut off or malformed")
        value = np.where(kind == VARINT, value, after)
        at[rows] = after + size
        out.append((rows, (key >> np.uint64(3)).astype(np.int64), kind, value, at[rows]))
        rows = rows[at[rows] < end[rows]]
    for row in rows.tolist():
        begin, raw, place = int(at[row]), data[at[row] : end[row]].tobytes(), 0
        one = []
        while place < len(raw):
            key, place = _varint(raw, place)
            kind = key & 7
            if kind == VARINT:
                value, place = _varint(raw, place)
                value &= 0xFFFFFFFF
            elif kind in (BYTES, LONG, SHORT):
                size, place = _varint(raw, place) if kind == BYTES else ({LONG: 8, SHORT: 4}[kind], place)
                value, place = begin + place, place + size
                if place > len(raw):
                    raise ValueError("an artifact is cut off or malformed")
            else:
                raise ValueError("an artifact has a field of an unknown wire type")
            one.append((row, key >> 3, kind, value, begin + place))
        out.append(tuple(np.array(one, np.int64).reshape(-1, 5).T))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    together = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.argsort(together[0], kind="stable")
    return tuple(c[order] for c in together)


def _low(value: np.ndarray) -> np.ndarray:
    """The 32 bits that an int field keeps of a varint."""
    return (value & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pieces ``data[start:end]`` put after one another, and their bytes."""
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    return bounds, data[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], end - start)]


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    bounds, raw = _cut(data, start, end)
    held = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
    try:
        return held.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in held.to_pylist()], pa.string())


def _ints(data: np.ndarray, row: np.ndarray, kind: np.ndarray, value: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(message, number) of the fields of a list of numbers, packed or not, in order."""
    start = np.where(kind == BYTES, value, end)
    bounds, raw = _cut(data, start, end)
    last = np.flatnonzero(raw < 128)
    full = bounds[1:][np.diff(bounds) > 0]
    if len(full) and (raw[full - 1] > 127).any():
        raise ValueError("an artifact is cut off or malformed")
    packed, _ = _varints(raw, np.concatenate([[0], last[:-1] + 1]) if len(last) else last, np.full(len(last), len(raw)))
    of, plain = np.searchsorted(bounds, last, "right") - 1, np.flatnonzero(kind == VARINT)
    owner, number = np.concatenate([of, plain]), np.concatenate([_low(packed.view(np.int64)), _low(value[plain])])
    order = np.argsort(owner, kind="stable")
    return row[owner[order]], number[order]


def _lists(items: pa.Array, row: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32()), items)


def decoded(message: str, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StructArray:
    """The messages ``data[start:end]`` with every field that is known, as ``read`` gives them; a missing message is null."""
    n, names, columns = len(start), [], []
    row, number, kind, value, stop = _tokens(data, start, end)
    for field, (name, of) in MESSAGES[message].items():
        own = np.flatnonzero(number == field)
        one = of[0] if isinstance(of, list) else of
        if (((kind[own] == BYTES) != (one not in ("int", "bool"))) & ~((kind[own] == BYTES) & (of == ["int"]))).any() or (np.isin(one, ("int", "bool")) and (kind[own] > BYTES).any()):
            raise ValueError(f"field {name} of an artifact has the wrong wire type")
        if not isinstance(of, list):  # the last one counts
            own = own[np.concatenate([row[own][1:] != row[own][:-1], [True]])] if len(own) else own
        r, v, e = row[own], value[own], stop[own]
        if of == ["int"]:
            r, numbers = _ints(data, r, kind[own], v, e)
            held = pa.array(numbers, pa.int32())
        elif one in ("int", "bool"):
            held = pa.array(_low(v) if one == "int" else v != 0)
        else:
            held = _texts(data, v, e) if one == "text" else decoded(one, data, v, e)
        if isinstance(of, list):
            held = _lists(held, r, n)
        else:
            place = np.full(n, -1)
            place[r] = np.arange(len(r))
            held = held.take(pa.array(place, mask=place < 0))
            if one in EMPTY:
                held = pc.fill_null(held, EMPTY[one])
        names.append(name)
        columns.append(held)
    return pa.StructArray.from_arrays(columns, names)


def _plain(symbols: pa.StructArray, kind: pa.StructType) -> pa.StructArray:
    """Symbols with the text of their signature."""
    signature = pc.fill_null(pc.struct_field(symbols.field("signature"), "text"), "")
    columns = [signature if f.name == "signature" else symbols.field(f.name) for f in kind]
    return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))


def documents(artifacts: DataFrame) -> DataFrame:
    """The documents of each artifact in order, and after them a row with its external symbols. An empty artifact is an error.

    All rows of an artifact lie in one task. Columns beside (id, content) go along to each of its rows."""
    also = [c for c in artifacts.columns if c not in ("id", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _types()
        symbol, found = kinds.field("symbols").type.value_type, kinds.field("occurrences").type

        def rows(ids: pa.Array, beside: list[pa.Array], data: np.ndarray, row: np.ndarray, nth: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            d = decoded("document", data, start, end)
            symbols = d.field("symbols")
            symbols = pa.ListArray.from_arrays(symbols.offsets, _plain(symbols.values, symbol))
            columns = [ids.take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(np.zeros(len(row), bool)), d.field("relative_path"), d.field("language"), symbols, d.field("occurrences").cast(found)]
            return told(columns, [c.take(pa.array(row)) for c in beside])

        def told(columns: list[pa.Array], beside: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, kinds, strict=True)), *beside], [*kinds.names, *also])

        for b in batches:
            ids, content = b.column("id"), b.column("content")
            size = pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not size.all():
                raise ValueError("an empty artifact")
            ends = np.cumsum(size)
            a = 0
            while a < len(size):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
                part, own, beside = content.slice(a, z - a), ids.slice(a, z - a), [b.column(c).slice(a, z - a) for c in also]
                data = np.frombuffer(b"".join(x.as_buffer() for x in part), np.uint8)
                end = np.cumsum(size[a:z])
                row, number, kind, value, stop = _tokens(data, end - size[a:z], end)
                if ((kind != BYTES) & ((number == 2) | (number == 3))).any():
                    raise ValueError("a field of an artifact has the wrong wire type")
                for field in (2, 3):
                    at = np.flatnonzero(number == field)
                    if field == 2:
                        nth = np.arange(len(at)) - np.searchsorted(row[at], row[at])
                        cuts = np.searchsorted(np.cumsum(stop[at] - value[at]), np.arange(0, int((stop[at] - value[at]).sum()) + 1, TOGETHER))
                        for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
                            if i < j:
                                yield rows(own, beside, data, row[at[i:j]], nth[i:j], value[at[i:j]], stop[at[i:j]])
                        continue
                    external = _lists(_plain(decoded("symbol", data, value[at], stop[at]), symbol), row[at], z - a)
                    n = z - a
                    counts = np.bincount(row[number == 2], minlength=n)
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], found.value_type))
                    columns = [own, pa.array(counts, pa.int32()), pa.array(np.ones(n, bool)), pa.nulls(n, pa.string()), pa.array([""] * n), external, none]
                    yield told(columns, beside)
                a = z

    return artifacts.select("id", "content", *also).mapInArrow(run, _with(DOCUMENT, artifacts, also))


def _with(kinds: str, rows: DataFrame, also: list[str]) -> str:
    """Columns of a row, and after them some of other rows."""
    return ", ".join([kinds, *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in also)])


def _types() -> pa.Schema:
    text, ints = pa.string(), pa.list_(pa.int32())
    related = pa.struct([("symbol", text), *((name, pa.bool_()) for name in ("is_reference", "is_implementation", "is_type_definition", "is_definition"))])
    symbol = pa.struct([("symbol", text), ("documentation", pa.list_(text)), ("relationships", pa.list_(related)), ("kind", pa.int32()), ("display_name", text), ("signature", text), ("enclosing_symbol", text)])
    occurrence = pa.struct([("range", ints), ("symbol", text), ("symbol_roles", pa.int32()), ("syntax_kind", pa.int32()), ("enclosing_range", ints)])
    return pa.schema([("id", pa.int64()), ("document", pa.int32()), ("external", pa.bool_()), ("relative_path", text), ("language", text), ("symbols", pa.list_(symbol)), ("occurrences", pa.list_(occurrence))])


def _as_varints(value: np.ndarray) -> pa.Array:
    """Each number as a varint."""
    left = value.astype(np.int64).view(np.uint64)
    width, rest = np.ones(len(left), np.int64), left >> np.uint64(7)
    while rest.any():
        width += rest > 0
        rest = rest >> np.uint64(7)
    bounds = np.concatenate([[0], np.cumsum(width)])
    step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], width)
    byte = (np.repeat(left, width) >> (7 * step).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    byte[step < np.repeat(width, width) - 1] |= 128
    return pa.Array.from_buffers(pa.large_binary(), len(left), [None, pa.py_buffer(bounds), pa.py_buffer(byte)])


def _joined(*parts: pa.Array | pa.Scalar) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))


def _together(pieces: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The pieces of each list as one."""
    at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at[bounds]), pieces.buffers()[2]])


def written(message: str, values: pa.StructArray) -> pa.Array:
    """The wire format of messages, as ``write`` gives it for each."""
    pieces = []
    for number, (name, of) in MESSAGES[message].items():
        if values.type.get_field_index(name) < 0:
            continue
        held, one, bounds = values.field(name), of[0] if isinstance(of, list) else of, None
        if isinstance(of, list):
            held = pc.if_else(pc.is_null(held), pa.scalar([], held.type), held) if held.null_count else held
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))]).astype(np.int64)
            held = held.flatten()
        if one in ("int", "bool"):
            n = pc.fill_null(held.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            body, some = _as_varints(n), n != 0
            if bounds is not None:  # packed
                body, some = _together(body, bounds), np.diff(bounds) > 0
        else:
            body = written(one, held) if one in MESSAGES else held.cast(pa.large_string()).cast(pa.large_binary())
            some = pc.is_valid(held).to_numpy(zero_copy_only=False) if one in MESSAGES else (pc.fill_null(pc.binary_length(body), 0).to_numpy(zero_copy_only=False) > 0)
            body = pc.fill_null(body, pa.scalar(b"", pa.large_binary()))
            if bounds is not None:
                some = np.ones(len(body), bool)
        tag = pa.scalar(bytes([number << 3 | (VARINT if of in ("int", "bool") else BYTES)]), pa.large_binary())
        sized = [body] if of in ("int", "bool") else [_as_varints(pc.binary_length(body).to_numpy(zero_copy_only=False)), body]
        out = pc.if_else(pa.array(some), _joined(tag, *sized), pa.scalar(b"", pa.large_binary()))
        pieces.append(_together(out, bounds) if bounds is not None and one not in ("int", "bool") else out)
    return _joined(*pieces)


def encoded(indexes: DataFrame) -> DataFrame:
    """(id, content): the artifact of each row (id, documents, external_symbols) of nested rows, as an indexer writes it. Other columns go along."""
    also = [c for c in indexes.columns if c not in ("id", "documents", "external_symbols")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = written("index", pa.StructArray.from_arrays([b.column("documents"), b.column("external_symbols")], ["documents", "external_symbols"]))
            yield pa.RecordBatch.from_arrays([b.column("id"), raw.cast(pa.binary()), *map(b.column, also)], ["id", "content", *also])

    return indexes.select("id", "documents", "external_symbols", *also).mapInArrow(run, _with("id long, content binary", indexes, also))

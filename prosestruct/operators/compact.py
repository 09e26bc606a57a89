"""Arrow arrays as few bytes: columns of offsets, repeated strings and running numbers are what a sentence's tokens mostly take.

A string column is its distinct strings and a number for each row, a list column its lengths, a whole number its difference
from the one before. A string column of a struct may go by its first one, as a lemma by its form. All such columns are compressed together, so a column that is much like another costs little.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

LEVEL = 12
#: In place of null flags: the column goes by the numbers of its struct's first string column without nulls.
_BY_KEY = "by key"


def _planes(x: np.ndarray) -> tuple[str, bytes]:
    """Differences of whole numbers in the smallest type that holds them, first bytes first."""
    d = np.diff(x.astype(np.int64), prepend=0)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if not len(d) or np.iinfo(k).min <= d.min() and d.max() <= np.iinfo(k).max)
    d = d.astype("<" + kind)
    return kind, d.view(np.uint8).reshape(len(d), d.itemsize).T.tobytes()


def _numbers(held: tuple[str, bytes], n: int) -> np.ndarray:
    kind, data = held
    d = np.frombuffer(data, np.uint8).reshape(-1, n).T if n else np.zeros((0, int(kind[1])), np.uint8)
    return np.cumsum(np.ascontiguousarray(d).view("<" + kind).reshape(-1).astype(np.int64))


def _smallest(x: np.ndarray) -> tuple[str, bytes]:
    kind = next(k for k in ("u1", "u2", "u4") if not len(x) or x.max() <= np.iinfo(k).max)
    x = x.astype("<" + kind)
    return kind, x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _codes(held: tuple[str, bytes]) -> np.ndarray:
    kind, data = held
    size = int(kind[1])
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view("<" + kind).reshape(-1).astype(np.int64)


def _held(a: pa.Array):
    """What an array holds, as nested tuples of bytes: rows, null flags or none, content."""
    nulls = np.packbits(a.is_null().to_numpy(zero_copy_only=False)).tobytes() if a.null_count else None
    if pa.types.is_list(a.type):
        lengths = a.value_lengths().fill_null(0).to_numpy()
        return len(a), nulls, (_smallest(lengths), _held(a.flatten()))
    if pa.types.is_struct(a.type):
        # Fields under a null struct are null, whatever they hold.
        fields = a.flatten()
        strings = [i for i, f in enumerate(fields) if pa.types.is_string(f.type) and not f.null_count]
        if not strings or not len(a):
            return len(a), nulls, tuple(map(_held, fields))
        coded = fields[strings[0]].dictionary_encode()
        at, n = coded.indices.to_numpy(), len(coded.dictionary)
        return len(a), nulls, tuple(_by_key(f, at, n) if i in strings[1:] else _held(f) for i, f in enumerate(fields))
    if pa.types.is_string(a.type):
        coded = a.dictionary_encode()
        values = coded.dictionary.to_pylist()
        return len(a), nulls, (_smallest(coded.indices.fill_null(0).to_numpy()), values)
    if pa.types.is_boolean(a.type):
        return len(a), nulls, np.packbits(a.fill_null(False).to_numpy(zero_copy_only=False)).tobytes()
    if pa.types.is_signed_integer(a.type):
        return len(a), nulls, _planes(a.fill_null(0).to_numpy())
    return len(a), None, a.to_pylist()


def _by_key(a: pa.Array, at: np.ndarray, n: int):
    """A string column by the numbers of the struct's first one, if each of that one's n strings goes with one string here."""
    own = a.dictionary_encode()
    codes, of = own.indices.to_numpy(), np.zeros(n, np.int64)
    of[at] = codes
    return (len(a), _BY_KEY, (_smallest(of), own.dictionary.to_pylist())) if (of[at] == codes).all() else _held(a)


def _array(held, type: pa.DataType) -> pa.Array:
    n, nulls, content = held
    null = None if nulls is None else np.unpackbits(np.frombuffer(nulls, np.uint8), count=n).astype(bool)
    mask = None if null is None else pa.array(null)
    if pa.types.is_list(type):
        lengths, values = content
        offsets = np.concatenate([[0], np.cumsum(_codes(lengths))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _array(values, type.value_type), type=type, mask=mask)
    if pa.types.is_struct(type):
        fields, at = [], None
        for x, f in zip(content, type, strict=True):
            if x[1] == _BY_KEY:
                codes, values = x[2]
                fields.append(pa.array(values, f.type).take(pa.array(_codes(codes)[at])))
                continue
            fields.append(_array(x, f.type))
            if at is None and pa.types.is_string(f.type) and x[1] is None and n:
                at = _codes(x[2][0])
        return pa.StructArray.from_arrays(fields, fields=list(type), mask=mask)
    if pa.types.is_string(type):
        codes, values = content
        at = pa.array(_codes(codes), mask=null)
        return pa.array(values, type).take(at) if values else pa.nulls(n, type)
    if pa.types.is_boolean(type):
        return pa.array(np.unpackbits(np.frombuffer(content, np.uint8), count=n).astype(bool), type, mask=null)
    if pa.types.is_signed_integer(type):
        return pa.array(_numbers(content, n), mask=null).cast(type)
    return pa.array(content, type)


def to_bytes(batch: pa.RecordBatch) -> bytes:
    raw = pickle.dumps([_held(x) for x in batch.columns], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def from_bytes(blob: bytes, schema: pa.Schema) -> pa.RecordBatch:
    """The batch that was written, whose columns must have the schema's types."""
    held = pickle.loads(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))
    return pa.RecordBatch.from_arrays([_array(x, f.type) for x, f in zip(held, schema, strict=True)], schema=schema)

"""Work units: tables of documents packed some megabytes a row, and sorted hash lists.

Operators that ask the whole corpus about every word or n-gram send, for each unit,
its sorted distinct 64-bit hashes to hash-range buckets; a bucket answers with one
value for each hash, in the same order. So a hash travels once a unit, as a packed
difference, and the answer needs no keys. Nothing is ever larger than a unit or a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow.llm.common import written

UNIT_BYTES = 8 << 20
_MASK = (1 << 64) - 1


def squeeze(a: np.ndarray) -> bytes:
    """Integers as bytes, the bytes of equal weight together, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T if len(a) else a.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.str.encode().ljust(4) + np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(raw, np.uint8, offset=4).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    d = unsqueeze(data)
    return np.cumsum(d, dtype=d.dtype)


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hash of each word; forgets when it gets large."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pack(docs: DataFrame, id_col: str, text_col: str, flag: Column | None = None) -> DataFrame:
    """(unit, ids, flags, lens, blob): the documents in rows of about UNIT_BYTES of
    text; a longer text is a unit of its own. lens is -1 for null. Written, so that a
    unit keeps its name and rows whatever is run again."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                         (F.lit(False) if flag is None else flag).alias("flag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, ids, flags, texts = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(t or b"" for t in texts))
            lens = [-1 if t is None else len(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n]), pa.array([ids], pa.list_(kind)), pa.array([flags], pa.list_(pa.bool_())),
                 pa.array([lens], pa.list_(pa.int32())), pa.array([blob], pa.binary())], ["unit", "ids", "flags", "lens", "blob"])

        for b in batches:
            kind = b.schema.field("id").type
            for i, t, f in zip(b.column("id").to_pylist(), b.column("text"), b.column("flag").to_pylist()):
                t = t.as_buffer().to_pybytes() if t.is_valid else None
                ids.append(i)
                flags.append(f)
                texts.append(t)
                size += len(t or b"")
                if size >= UNIT_BYTES:
                    yield flush()
                    n, size, ids, flags, texts = n + 1, 0, [], [], []
        if texts:
            yield flush()

    kind = narrow.schema["id"].dataType.simpleString()
    return written(narrow.mapInArrow(run, f"unit long, ids array<{kind}>, flags array<boolean>, lens array<int>, blob binary"), "units")


def texts_of(blob: bytes, lens: list[int]) -> Iterator[bytes | None]:
    raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
    for n in lens:
        yield None if n < 0 else raw[at:at + n]
        at += max(n, 0)


def ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes by equal ranges of the hash space."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


REQUEST = "kind int, bucket int, unit long, keys binary, vals binary"


def requests(kind: int, unit: int, keys: np.ndarray, vals: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of REQUEST for one unit's sorted distinct hashes."""
    parts = ranges(keys, buckets)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([unit] * len(parts), pa.int64()),
         pa.array([squeeze_sorted(keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([squeeze(vals[a:b]) for _, a, b in parts], pa.binary())],
        ["kind", "bucket", "unit", "keys", "vals"])


def gathered(table: pa.Table) -> tuple[list[int], list[slice], np.ndarray, np.ndarray]:
    """A bucket's requests in order of unit: units, their slices, all hashes, all values."""
    rows = sorted(zip(table.column("unit").to_pylist(), table.column("keys").to_pylist(), table.column("vals").to_pylist()))
    keys, vals = [unsqueeze_sorted(r[1]) for r in rows], [unsqueeze(r[2]) for r in rows]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    return [r[0] for r in rows], [slice(a, b) for a, b in zip([0, *ends], ends)], np.concatenate(keys), np.concatenate(vals)


def answers(table: pa.Table, kind: int) -> np.ndarray:
    """A unit's answers for one kind of request, in the order of its hashes."""
    rows = sorted((b, v) for k, b, v in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "vals"))) if k == kind)
    return np.concatenate([unsqueeze(v) for _, v in rows]) if rows else np.zeros(0, np.int64)

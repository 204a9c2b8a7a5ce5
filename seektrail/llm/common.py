"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Runs of anything but the space and the characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that a task turns into arrays at once. A longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, null being equal to null; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__{k}"])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def in_pieces(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece hold about `limit` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(length.astype(np.int64)) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def in_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key at a time, from a partition sorted by the keys (whole numbers)."""
    open_rows: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            changed |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        if open_rows and any(open_rows[-1][k][-1] != batch[k][0] for k in keys):
            yield pa.Table.from_batches(open_rows)
            open_rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            open_rows.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(open_rows)
                open_rows = []
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, null as empty, and the n + 1 limits between them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, limits, data = texts.buffers()
    limits = np.frombuffer(limits, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[limits[0] : limits[-1]], limits - limits[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finishing step of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, before rows become Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def packed(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Sizes in bytes and compressed bytes of texts (null as empty), for a shuffle."""
    codec = pa.Codec("zstd", 1)
    raw = [(x or "").encode() for x in texts.to_pylist()]
    values = pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())
    return pa.array([len(x) for x in raw], pa.int64()), values


def unpack(size: int, value: bytes) -> bytes:
    return pa.Codec("zstd").decompress(value, size, asbytes=True)


def unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with `text` from columns `size` and `packed`."""
    pairs = zip(batch["size"].to_pylist(), batch["packed"].to_pylist(), strict=True)
    texts = pa.array([unpack(n, x).decode() for n, x in pairs], pa.string())
    columns = {c: batch[c] for c in batch.schema.names if c not in ("size", "packed")}
    return pa.record_batch(columns | {"text": texts})

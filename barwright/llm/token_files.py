"""Token-id files: best-fit-decreasing packing of documents into rows of a fixed length.

Documents (closing id 0 included) longer than a row are cut into whole rows and a rest, so nothing is lost. Pieces are then packed in
decreasing order of length, each into the fullest row that still holds it; a segment tree over free capacities finds it in log(row
length) steps. A task packs blocks of about ``BLOCK`` ids, so memory is bounded whatever the input, and rows are not shuffled: a
block holds thousands of rows, and leaves only its last ones part empty.

Files: ``<name>.ids`` is a matrix of little-endian unsigned 16- or 32-bit ids, row after row, zeros behind the last document of a
row; ``<name>.resets`` has one bit an id, set where positions restart at 0 (high bit first). Cumulative segment lengths are in the index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm import tokens
from barwright.llm.files import Reader, Writer
from barwright.llm.shared import keep, scratch_path

LENGTH = 2048
BLOCK = 4 << 20
INDEX = ("file string, row long, used long, cu_seqlens array<long>, doc_ids array<long>, starts array<long>, ids_crc32 long")


class Capacities:
    """Which free capacities occur among open rows: a segment tree over 0..size, searched for the smallest one not below a need."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def best(self, need: int) -> int | None:
        """The smallest capacity >= need that some row has."""
        k = self.leaves + need
        if self.count[k]:
            return need
        while k > 1:  # up to the first ancestor with something to the right, then down its left edge
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows as lists of piece numbers: pieces in decreasing order, each into the fullest row it fits; ties keep their order."""
    tree, rows, free = Capacities(size), [], [[] for _ in range(size + 1)]
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        capacity = tree.best(n)
        if capacity is None:
            row, capacity = len(rows), size
            rows.append([])
        else:
            row = free[capacity].pop()
            tree.add(capacity, -1)
        rows[row].append(k)
        if capacity > n:
            free[capacity - n].append(row)
            tree.add(capacity - n, 1)
    return rows


def write(docs: DataFrame, folder: str | None = None, length: int = LENGTH, path: str | None = None, width: int = 2) -> DataFrame:
    """Pack ``docs`` into files in ``folder``; the index, one row per packed row: file, row, used, cu_seqlens, doc_ids, starts (of each segment
    in its document), ids_crc32 (of the row as little-endian unsigned 32-bit ids).

    Null and empty texts are the single id 0. Repeated rows and null doc_id are packed like any row. Extra columns are left out; an
    empty table gives no rows and no files. Ids above what ``width`` bytes hold raise an error.
    """
    path, folder = path or tokens.vocabulary(), folder or scratch_path(docs.sparkSession, "ids")
    names = [f.split()[0] for f in INDEX.split(", ")]
    longs = pa.list_(pa.int64())
    kinds = [pa.string(), pa.int64(), pa.int64(), longs, longs, longs, pa.int64()]

    def block(pieces: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        ids, resets, index = Writer(folder, ".ids"), None, []
        resets = Writer(folder, ".resets")
        for number, members in enumerate(best_fit([len(p[2]) for p in pieces], length)):
            row = np.zeros(length, "<u4")
            ends = np.cumsum([0, *(len(pieces[k][2]) for k in members)])
            used = int(ends[-1])
            row[:used] = np.concatenate([pieces[k][2] for k in members])
            if row.max() >= 1 << 8 * width:
                raise ValueError(f"an id does not fit into {width} bytes")
            ids.write(row.astype(f"<u{width}").tobytes())
            marks = np.zeros(length, bool)
            marks[ends[:-1]] = True
            resets.write(np.packbits(marks).tobytes())
            index.append((ids.name, number, used, ends.tolist(), [pieces[k][0] for k in members], [pieces[k][1] for k in members], zlib.crc32(row.tobytes())))
        ids.close()
        # the second file goes by the name of the first
        resets.close()
        resets.files.move(_at(folder, resets.name), _at(folder, ids.name[:-len(".ids")] + ".resets"))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces, held = tokens.encoder(path), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.document_ids(encode, text.as_py())
                pieces.extend((doc_id, k, ids[k:k + length]) for k in range(0, len(ids), length))
                held += len(ids)
                if held >= BLOCK:
                    yield block(pieces)
                    pieces, held = [], 0
        if pieces:
            yield block(pieces)

    return keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, INDEX), "id-index")[0]


def _at(folder: str, name: str) -> str:
    from barwright.llm.files import store
    return f"{store(folder)[1]}/{name}"


def read_row(reader: Reader, file: str, row: int, length: int = LENGTH, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Ids and positions of one packed row; positions restart where a reset is set."""
    ids = np.frombuffer(reader.read(file, row * length * width, length * width), f"<u{width}")
    marks = np.unpackbits(np.frombuffer(reader.read(file[:-len(".ids")] + ".resets", row * length // 8, length // 8), np.uint8))
    at = np.arange(length)
    return ids, at - np.maximum.accumulate(np.where(marks, at, 0))

"""Token-id files: one concatenated id array per file, with Elias-Fano coded document boundaries."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_groups, stored, table
from tidemark.llm.registry import query
from tidemark.llm.tokens import VOCABULARY, encoder
from tidemark.session import scratch

MAGIC = b"TMTOKEN1"
SAMPLE = 256                  # every so many ones of the upper bits have their position kept
FILE_IDS = 1 << 25            # a file is closed at this many ids


class EliasFano:
    """A non-decreasing sequence of integers from 0 up in about 2 + log2(u/n) bits an item, with select.

    Low bits lie side by side; high bits are unary, one 1 per item. ``select(i)`` jumps to the kept position of every
    ``SAMPLE``-th one and counts on from there.
    """

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray):
        self.n, self.low, self.lower, self.upper = n, low, lower, upper
        ones = np.flatnonzero(np.unpackbits(upper, bitorder="little")) if n else np.zeros(0, np.int64)
        self.kept = ones[::SAMPLE].astype(np.uint32)

    @classmethod
    def of(cls, items: np.ndarray) -> EliasFano:
        n = len(items)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        items = np.asarray(items, np.int64)
        low = max(0, int(items[-1] // n).bit_length() - 1)
        bits = (items[:, None] >> np.arange(low)) & 1
        ones = (items >> low) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1, np.uint8)
        upper[ones] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(upper, bitorder="little"))

    def select(self, i: int) -> int:
        at = int(self.kept[i // SAMPLE])
        left = i % SAMPLE
        octet = at // 8
        word = int(self.upper[octet]) >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            octet += 1
            word = int(self.upper[octet])
        for _ in range(left):
            word &= word - 1
        high = octet * 8 + (word & -word).bit_length() - 1 - i
        first = i * self.low
        chunk = int.from_bytes(self.lower[first // 8:(first + self.low + 7) // 8].tobytes(), "little") >> (first % 8)
        return high << self.low | chunk & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[:self.n] - np.arange(self.n)
        bits = np.unpackbits(self.lower, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        return high << self.low | (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low, len(self.lower), len(self.upper)) + self.lower.tobytes() + self.upper.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low, a, b = struct.unpack_from("<QBQQ", data, at)
        at += 25
        lower, upper = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low, lower, upper), at + a + b


def _place(uri: str):
    """Filesystem and path of a URI, for any store that Arrow opens."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, doc_ids: list, docs: list[np.ndarray]) -> None:
    """One file: header, boundaries, document ids (null ones first, counted), ids."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    kind = docs[0].dtype if docs else np.dtype("<u2")
    files, path = _place(uri)
    with files.open_output_stream(path) as out:
        out.write(MAGIC + struct.pack("<BQQq", kind.itemsize, len(docs), len(doc_ids) - len(known), base))
        out.write(EliasFano.of(ends).to_bytes())
        out.write(EliasFano.of(known - base).to_bytes())
        for d in docs:
            out.write(d.tobytes())


class TokenFile:
    """A file read back; ``document(i)`` finds its ids by two selects."""

    def __init__(self, uri: str):
        files, path = _place(uri)
        with files.open_input_file(path) as f:
            data = f.read()
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        width, self.n, nulls, base = struct.unpack_from("<BQQq", data, 8)
        self.bounds, at = EliasFano.read(data, 33)
        known, at = EliasFano.read(data, at)
        self.doc_ids = [None] * nulls + (known.all() + base).tolist()
        self.ids = np.frombuffer(data, np.dtype(f"<u{width}"), -1, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]


def write_token_files(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text",
                      tokenizer: str = VOCABULARY, end_id: int | None = 2, whole: bool = False,
                      file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts in ascending id order into files under ``folder``; returns the table of files.

    A null or empty text is its end id alone. Rows with a null id come first; rows that repeat an id are all written,
    side by side. Ids must be integers. Extra columns are not read. An empty table writes no file. The table
    (part, seq, file, docs, ids) lists what finished tasks wrote: a file of a lost task is in no row.
    """
    from pyarrow import fs
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)

    def run(batches):
        task = TaskContext.get()
        enc = encoder(tokenizer, whole)
        tail = np.array([] if end_id is None else [end_id], enc.kind)
        held_ids, held, size, seq = [], [], 0, 0

        def close():
            uri = f"{folder}/part-{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}.tokens"
            write_file(uri, held_ids, held)
            return pd.DataFrame({"part": [task.partitionId()], "seq": [seq], "file": [uri], "docs": [len(held)], "ids": [size]})

        for b in batches:
            names = iter([None if pd.isna(i) else int(i) for i in b["id"]])
            for group in in_groups(b["text"]):
                for ids in enc.encode(group):
                    held_ids.append(next(names))
                    held.append(np.concatenate([ids, tail]))
                    size += len(held[-1])
                    if size >= file_ids:
                        yield close()
                        held_ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield close()

    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    return stored(ordered.mapInPandas(run, "part int, seq int, file string, docs long, ids long"), "token-files")


def read_token_files(listing: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary of unsigned 32-bit little-endian) of every document in the listed files."""
    def run(batches):
        for b in batches:
            for uri, base in zip(b["file"], b["base"]):
                f = TokenFile(uri)
                bounds = f.bounds.all()
                for i in range(0, f.n, 1000):
                    at = bounds[i:i + 1001]
                    yield pd.DataFrame({"doc_id": pd.array(f.doc_ids[i:i + 1000], "Int64"), "start": at[:-1] + base,
                                        "ids": [f.ids[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:])]})

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    based = listing.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    return (based.select("file", "base").repartition(max(1, listing.count()))
            .mapInPandas(run, "doc_id long, start long, ids binary"))


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    listing = write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "ids"))
    return read_token_files(listing).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

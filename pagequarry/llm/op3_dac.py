"""Token-ID output as directly addressable codes.

Every document's token ids become one BINARY value.  An id is cut into chunks, low bits first, of
``WIDTHS`` bits by level; level k holds the k-th chunk of each id that has one, a bitmap says which of
its ids continue on level k + 1, and a directory of ranks (one running count for every ``RANK_EVERY``
bits of the bitmap) gives an id's place on the next level.  Any one id is read by one probe a level,
without decoding its neighbours.

Layout (little-endian): ``DAC1``, ids u32, levels u8; then for each level its width u8, size u32,
packed chunks, bitmap, ranks u32.  The bitmap and ranks of the last level are left out.

Defined results: a null text has null ``n_tokens`` and ``codes``; an empty text has no ids and no
levels; repeated rows are encoded repeatedly; null ids are kept.  Other columns are ignored, whatever
their names.  One pass over the input, no shuffle.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._tokens import DEFAULT_VOCABULARY, encoder

WIDTHS = (8, 4, 4, 8, 8)
RANK_EVERY = 512
MAGIC = b"DAC1"


def _pack(values: np.ndarray, width: int) -> bytes:
    if width == 8:
        return values.astype(np.uint8).tobytes()
    if width == 4:
        v = values.astype(np.uint8)
        if len(v) & 1:
            v = np.append(v, np.uint8(0))
        return (v[::2] | (v[1::2] << np.uint8(4))).tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _packed_size(n: int, width: int) -> int:
    return -(-n * width // 8)


def encode(ids, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The code of a sequence of ids, each from 0 to 2**sum(widths) - 1."""
    rest = np.asarray(ids, dtype=np.uint64)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError(f"ids must be below 2**{sum(widths)}")
    levels = []
    n = len(rest)
    for width in widths:
        if not len(rest):
            break
        chunk = rest & np.uint64((1 << width) - 1)
        rest = rest >> np.uint64(width)
        more = rest > 0
        part = [struct.pack("<BI", width, len(chunk)), _pack(chunk, width)]
        rest = rest[more]
        if len(rest):
            part.append(np.packbits(more, bitorder="little").tobytes())
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_EVERY), dtype=np.uint32)
            part.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
        levels.append(b"".join(part))
    return MAGIC + struct.pack("<IB", n, len(levels)) + b"".join(levels)


class Reader:
    """Random access to a code."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.blob = blob
        self.n, count = struct.unpack_from("<IB", blob, 4)
        self.levels: list[tuple[int, int, int, int, int]] = []  # width, size, place of chunks, of the bitmap, of the ranks
        at = 9
        for k in range(count):
            width, size = struct.unpack_from("<BI", blob, at)
            chunks = at + 5
            bitmap = chunks + _packed_size(size, width)
            last = k == count - 1
            ranks = bitmap + (0 if last else -(-size // 8))
            at = ranks + (0 if last else 4 * -(-size // RANK_EVERY))
            self.levels.append((width, size, chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift, b = 0, 0, self.blob
        for k, (width, _, chunks, bitmap, ranks) in enumerate(self.levels):
            bit = i * width
            word = int.from_bytes(b[chunks + bit // 8 : chunks + (bit + width + 7) // 8], "little")
            value |= ((word >> (bit % 8)) & ((1 << width) - 1)) << shift
            if k == len(self.levels) - 1 or not (b[bitmap + i // 8] >> (i % 8)) & 1:
                break
            block = i // RANK_EVERY
            before = int.from_bytes(b[bitmap + block * RANK_EVERY // 8 : bitmap + i // 8 + 1], "little")
            before &= (1 << (i - block * RANK_EVERY)) - 1
            i = struct.unpack_from("<I", b, ranks + 4 * block)[0] + before.bit_count()
            shift += width
        return value

    def decode(self) -> np.ndarray:
        """All ids, level by level from the last."""
        upper = np.zeros(0, np.uint64)
        for k in range(len(self.levels) - 1, -1, -1):
            width, size, chunks, bitmap, _ = self.levels[k]
            raw = np.frombuffer(self.blob, np.uint8, _packed_size(size, width), chunks)
            bits = np.unpackbits(raw, bitorder="little", count=size * width).reshape(size, width)
            value = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
            if k < len(self.levels) - 1:
                more = np.unpackbits(np.frombuffer(self.blob, np.uint8, -(-size // 8), bitmap), bitorder="little", count=size).astype(bool)
                value[more] |= upper << np.uint64(width)
            upper = value
        return upper


def encode_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, codes) of every document."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = encoder(vocabulary)
        for batch in batches:
            counts, codes = [], []
            for text in batch.column(1).to_pylist():
                ids = None if text is None else tokenize(text)
                counts.append(None if ids is None else len(ids))
                codes.append(None if ids is None else encode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(codes, pa.binary())], names=["doc_id", "n_tokens", "codes"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens int, codes binary")


def token_at(codes: Column, place: Column) -> Column:
    """The id at a 0-based place of each code; null outside it or for a null code."""

    def one(blob, i):
        if blob is None or i is None or i != i:
            return None
        reader = Reader(blob)
        return reader[int(i)] if 0 <= i < len(reader) else None

    @F.pandas_udf("int")
    def get(blobs: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([one(b, i) for b, i in zip(blobs, places)], dtype="Int32")

    return get(codes, place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None

"""Media columns: Ogg containers in a BINARY column.

``demux_ogg`` reads every physical stream in one pass of Arrow batches: it finds capture patterns,
verifies each page's checksum, reassembles packets from the lacing values, separates the logical
streams by serial number and derives times from granule positions.  Nothing is shuffled.

Defined results: a null or empty container gives no rows; a container without one good page gives
no rows; a page with a wrong checksum is skipped and counted in ``bad_pages`` of its container (on
each of that container's rows); a gap in the page sequence numbers counts in ``lost_pages`` and
drops the packet that it cuts; a truncated last page counts as bad.  Rows that repeat are read
twice.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, BOS, EOS = 1, 2, 4


def page_crc(page: bytes) -> int:
    """The container's CRC-32 (0x04c11db7, not reflected, from 0) by way of the reflected CRC of
    bit-reversed bytes, which zlib computes natively."""
    c = zlib.crc32(page.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "big").translate(_REV), "little")


@dataclass
class LogicalStream:
    serial: int
    codec: str = "unknown"
    rate: float | None = None
    shift: int = 0
    preskip: int = 0
    headers: int = 0
    pages: int = 0
    lost: int = 0
    eos: bool = False
    next_seq: int | None = None
    partial: list[bytes] | None = None
    packets: list[bytes] = field(default_factory=list)
    page_granule: list[int] = field(default_factory=list)  # of the page on which each packet ends
    first_granule: int | None = None
    last_granule: int | None = None

    def seconds(self, granule: int | None) -> float | None:
        if granule is None or not self.rate:
            return None
        if self.shift:
            granule = (granule >> self.shift) + (granule & ((1 << self.shift) - 1))
        return max(0, granule - self.preskip) / self.rate


def _identify(s: LogicalStream, packet: bytes) -> None:
    """Codec, clock and number of header packets from the first packet."""
    if packet[:7] == b"\x01vorbis" and len(packet) >= 16:
        s.codec, s.rate, s.headers = "vorbis", float(struct.unpack_from("<I", packet, 12)[0]), 3
    elif packet[:8] == b"OpusHead" and len(packet) >= 12:
        s.codec, s.rate, s.headers, s.preskip = "opus", 48000.0, 2, struct.unpack_from("<H", packet, 10)[0]
    elif packet[:8] == b"Speex   " and len(packet) >= 40:
        s.codec, s.rate, s.headers = "speex", float(struct.unpack_from("<I", packet, 36)[0]), 2
    elif packet[:5] == b"\x7fFLAC" and len(packet) >= 30:
        s.codec, s.rate = "flac", float(int.from_bytes(packet[27:30], "big") >> 4)
        s.headers = 1 + struct.unpack_from(">H", packet, 7)[0]
    elif packet[:7] == b"\x80theora" and len(packet) >= 42:
        num, den = struct.unpack_from(">II", packet, 22)
        s.codec, s.rate, s.headers = "theora", num / den if den else None, 3
        s.shift = (int.from_bytes(packet[40:42], "big") >> 5) & 31


def parse_ogg(blob: bytes) -> tuple[list[LogicalStream], int]:
    """The logical streams in order of appearance, and the number of bad pages."""
    streams: dict[int, LogicalStream] = {}
    done: list[LogicalStream] = []
    bad, at = 0, blob.find(b"OggS")
    while at >= 0:
        ok = len(blob) - at >= 27 and blob[at + 4] == 0
        if ok:
            _, _, kind, granule, serial, seq, crc, nsegs = _HEAD.unpack_from(blob, at)
            body = at + 27 + nsegs
            lacing = blob[at + 27 : body]
            end = body + sum(lacing)
            ok = len(lacing) == nsegs and end <= len(blob)
            ok = ok and page_crc(blob[at : at + 22] + b"\0\0\0\0" + blob[at + 26 : end]) == crc
        if not ok:
            bad += 1
            at = blob.find(b"OggS", at + 4)
            continue
        s = streams.get(serial)
        if s is None or kind & BOS:
            if s is not None:
                done.append(s)
            s = streams[serial] = LogicalStream(serial)
        if s.next_seq is not None and seq != s.next_seq:
            s.lost += (seq - s.next_seq) & 0xFFFFFFFF
            s.partial = None
        s.next_seq = (seq + 1) & 0xFFFFFFFF
        s.pages += 1
        s.eos = s.eos or bool(kind & EOS)
        parts = s.partial
        if not kind & CONTINUED:
            parts = []
        # a continued page whose beginning is unknown: skip to the packet's end
        skip = parts is None
        parts, p, ended = parts or [], body, 0
        for size in lacing:
            if not skip:
                parts.append(blob[p : p + size])
            p += size
            if size < 255:
                if not skip:
                    packet = b"".join(parts)
                    if not s.packets:
                        _identify(s, packet)
                    s.packets.append(packet)
                    ended += 1
                parts, skip = [], False
        s.partial = parts if nsegs and lacing[-1] == 255 and not skip else None
        s.page_granule += [granule] * ended
        if granule >= 0:
            if len(s.packets) > s.headers or not s.headers:
                s.first_granule = granule if s.first_granule is None else s.first_granule
            s.last_granule = granule
        at = end if blob[end : end + 4] == b"OggS" else blob.find(b"OggS", end)
    order = [*done, *streams.values()]
    return order, bad


def mux_ogg(streams: list[tuple[int, list[tuple[bytes, int]]]], payload: int = 4096) -> bytes:
    """A container of (serial, [(packet, granule)]) streams, their pages interleaved in turn; a page
    is closed at ``payload`` bytes, after each of a stream's first packets, or at 255 segments."""
    queues: list[list[bytes]] = []
    for serial, packets in streams:
        pages: list[tuple[int, int, bytes, bytes]] = []
        lacing, body, granule, fresh, size = bytearray(), [], -1, True, 0

        def close(more: bool) -> None:
            nonlocal lacing, body, granule, fresh, size
            pages.append((0 if fresh else CONTINUED, granule, bytes(lacing), b"".join(body)))
            lacing, body, granule, fresh, size = bytearray(), [], -1, not more, 0

        for k, (packet, g) in enumerate(packets):
            at, left = 0, [255] * (len(packet) // 255) + [len(packet) % 255]
            for i, seg in enumerate(left):
                lacing.append(seg)
                body.append(packet[at : at + seg])
                at, size = at + seg, size + seg
                last = i == len(left) - 1
                if last:
                    granule = g
                if len(lacing) == 255 or size >= payload or (last and k == 0):
                    close(more=not last)
        if lacing or not pages:
            close(more=False)
        out = []
        for seq, (kind, granule_, lac, data) in enumerate(pages):
            kind |= (BOS if seq == 0 else 0) | (EOS if seq == len(pages) - 1 else 0)
            head = _HEAD.pack(b"OggS", 0, kind, granule_, serial & 0xFFFFFFFF, seq, 0, len(lac)) + lac
            crc = page_crc(head + data)
            out.append(head[:22] + struct.pack("<I", crc) + head[26:] + data)
        queues.append(out)
    turns = max((len(q) for q in queues), default=0)
    return b"".join(q[t] for t in range(turns) for q in queues if t < len(q))


STREAM_SCHEMA = (
    "serial BIGINT, codec STRING, n_pages INT, bad_pages INT, lost_pages INT, n_packets INT, payload_bytes BIGINT, "
    "payload_md5 STRING, start_s DOUBLE, end_s DOUBLE, eos BOOLEAN"
)


def _arrow_streams(id_type: pa.DataType) -> pa.Schema:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    return pa.schema([("id", id_type), *zip([x.split()[0] for x in STREAM_SCHEMA.split(", ")], kinds)])


def demux_ogg(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each logical stream of each container; ``id`` holds the value of ``id_col``."""
    from pyspark.sql.pandas.types import to_arrow_type

    slim = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = _arrow_streams(to_arrow_type(slim.schema["id"].dataType))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, blob in zip(batch.column(0), batch.column(1)):
                if not blob.is_valid:
                    continue
                streams, bad = parse_ogg(blob.as_py())
                for s in streams:
                    data = s.packets[s.headers :]
                    digest = hashlib.md5()
                    for packet in data:
                        digest.update(packet)
                    rows.append((key.as_py(), s.serial, s.codec, s.pages, bad, s.lost, len(data), sum(map(len, data)), digest.hexdigest(), s.seconds(s.first_granule), s.seconds(s.last_granule), s.eos))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(read, f"id {kind}, {STREAM_SCHEMA}")


PACKET = 960
PRESKIP = 312


def document_media(doc_id: int, text: str, source: str | None) -> bytes:
    """The container that stands for a document: its text as a 48 kHz Opus-framed stream of 20 ms
    packets, its source as a second, Vorbis-framed one."""
    data, name = text.encode(), (source or "").encode()
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, PRESKIP, 48000, 0, 0)
    voice = [(head, 0), (b"OpusTags" + struct.pack("<II", 0, 0), 0)]
    voice += [(data[i : i + PACKET], PRESKIP + 960 * (i // PACKET + 1)) for i in range(0, len(data), PACKET)]
    ident = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 8000, 0, 0, 0, 0xB8, 1)
    label = [(ident, 0), (b"\x03vorbis", 0), (b"\x05vorbis", 0), (name, 8000)]
    serial = (doc_id * 2) & 0xFFFFFFFF
    return mux_ogg([(serial, voice), (serial + 1, label)])


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of every document with a text and an id."""

    @F.pandas_udf("binary")
    def mux(ids, texts, sources):
        import pandas as pd

        return pd.Series([None if d is None or d != d or t is None else document_media(int(d), t, s) for d, t, s in zip(ids, texts, sources)], dtype=object)

    d: Column = F.col("doc_id")
    return docs.where(d.isNotNull() & F.col("text").isNotNull()).select("doc_id", mux("doc_id", "text", "source").alias("media"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return demux_ogg(with_media(docs), "doc_id", "media").withColumnRenamed("id", "doc_id").drop("n_pages")


SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS source, strlen(text) AS size, strlen(coalesce(source, '')) AS label
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, (doc_id * 2) % 4294967296 AS serial, 'opus' AS codec, 0 AS bad_pages, 0 AS lost_pages,
       CAST(ceil(size / {PACKET}.0) AS INTEGER) AS n_packets, size AS payload_bytes, md5(text) AS payload_md5,
       CASE WHEN size >= 4 * {PACKET} + 255 THEN 0.08 WHEN size > 0 THEN ceil(size / {PACKET}.0) * 0.02 END AS start_s,
       ceil(size / {PACKET}.0) * 0.02 AS end_s, true AS eos FROM d
UNION ALL
SELECT doc_id, (doc_id * 2) % 4294967296 + 1, 'vorbis', 0, 0, 1, label, md5(source), 1.0, 1.0, true FROM d
"""

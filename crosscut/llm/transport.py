"""Media columns: MPEG transport streams.

mux() stores a payload as a single-program transport stream: a program association and a program map table before every
random-access point, the payload in access units, each a PES packet with a presentation timestamp, cut into 188-byte
packets with continuity counters; packets at random-access points carry the flag and a clock reference. A private
descriptor in the program map says how many payload bytes and access units the stream has.

demux() parses the tables (sections' checksums verified), follows the continuity counters of the tables' and of the
elementary stream's packets (a repeated packet is left out and counted, a flagged discontinuity is none), reassembles
the PES packets, holds their lengths against the bytes that came and their timestamps and number against the
descriptor, and returns the payload with the timestamps and the random-access points (timestamp and packet number).
The media and then, read back from it, its timestamps and points are columns of tables in the shared folder.

Defined cases: a null or empty text is 576 bytes of 255; equal texts give equal streams; repeated rows, null ids and
extra columns pass through, and an input column named like a result is replaced; an empty table gives an empty result;
a very long text is one stream, handled alone (some four times its size in memory). A stream that lost packets keeps
what came and is reported by its counts; a null stream, one out of sync or one with broken tables has null results and
says so in column error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts, settle

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
PROGRAM = 1
PAD = 576
#: Bytes of an access unit, access units from one random-access point to the next, ticks of 90 kHz between two units.
UNIT, UNITS_PER_POINT, TICKS = 5 * PAD, 8, 3600
FIRST_PTS = 90_000
PES_HEADER = 14


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])  # starts a unit, payload only, counter 0; pointer 0
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


ASSOCIATION = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
#: Private descriptor in the program's loop: payload bytes (8 bytes), access units and ticks between them (4 bytes each).
DESCRIPTOR_TAG, DESCRIPTOR_SIZE = 0xE0, 16


def _map_packet(size: int, units: int) -> np.ndarray:
    own = bytes([DESCRIPTOR_TAG, DESCRIPTOR_SIZE]) + size.to_bytes(8, "big") + units.to_bytes(4, "big") + TICKS.to_bytes(4, "big")
    stream = bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    return _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + (0xF000 | len(own)).to_bytes(2, "big") + own + stream))


def pad(data: bytes, multiple: int = PAD) -> bytes:
    return data + b"\xff" * (-len(data) % multiple or (0 if data else multiple))


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload (not empty)."""
    size = len(payload)
    units = -(-size // UNIT)
    index = np.arange(units)
    length = np.full(units, UNIT)
    length[-1] = size - (units - 1) * UNIT
    point = index % UNITS_PER_POINT == 0
    pts = FIRST_PTS + index * TICKS
    # PES packets: a header of 14 bytes before each unit
    head = np.empty((units, PES_HEADER), np.uint8)
    head[:, :4] = (0, 0, 1, STREAM_ID)
    head[:, 4], head[:, 5] = length + 8 >> 8, length + 8 & 255
    head[:, 6:9] = (0x80, 0x80, 5)
    head[:, 9] = 0x21 | pts >> 29 & 14
    head[:, 10], head[:, 11], head[:, 12], head[:, 13] = pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1
    pes = np.empty(size + units * PES_HEADER, np.uint8)
    data = np.frombuffer(payload, np.uint8)
    full = units - 1
    body = pes[: full * (PES_HEADER + UNIT)].reshape(full, PES_HEADER + UNIT)
    body[:, :PES_HEADER], body[:, PES_HEADER:] = head[:full], data[: full * UNIT].reshape(full, UNIT)
    pes[full * (PES_HEADER + UNIT) :][:PES_HEADER], pes[full * (PES_HEADER + UNIT) + PES_HEADER :] = head[full], data[full * UNIT :]
    # packets: a unit's first one may carry flags and clock, its last one is stuffed
    total, first = length + PES_HEADER, np.where(point, 176, 184)
    count = 1 + np.maximum(0, -(-(total - first) // 184))
    ends = np.cumsum(count)
    starts, n = ends - count, int(ends[-1])
    carried = np.full(n, 184)
    carried[starts] = np.minimum(first, total)
    many = count > 1
    carried[ends[many] - 1] = (total - first - (count - 2) * 184)[many]
    adapt = 184 - carried  # bytes of the adaptation field, its length byte included
    out = np.full((n, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[starts, 1] |= 0x40
    out[:, 3] = np.where(adapt > 0, 0x30, 0x10) | np.arange(n) % 16
    has = adapt > 0
    out[has, 4] = adapt[has] - 1
    out[adapt > 1, 5] = 0
    at, clock = starts[point], pts[point] - TICKS
    out[at, 5] = 0x50
    out[at, 6], out[at, 7], out[at, 8], out[at, 9] = clock >> 25 & 255, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255
    out[at, 10], out[at, 11] = (clock & 1) << 7 | 0x7E, 0
    out[np.arange(PACKET)[None, :] >= PACKET - carried[:, None]] = pes
    # tables stand before every random-access point
    points = int(point.sum())
    before = np.zeros(n, np.int64)
    before[at] = 2
    whole = np.empty((n + 2 * points, PACKET), np.uint8)
    place = np.arange(n) + np.cumsum(before)
    whole[place] = out
    for i, packet in enumerate((ASSOCIATION, _map_packet(size, units))):
        rows = place[at] - 2 + i
        whole[rows] = packet
        whole[rows, 3] |= (np.arange(points) % 16).astype(np.uint8)
    return whole.tobytes()


def _section_of(packets: np.ndarray, pids: np.ndarray, pid: int, table_id: int) -> bytes:
    """The body of the first whole section of a table."""
    rows = np.flatnonzero((pids == pid) & (packets[:, 1] & 0x40 > 0))
    if not len(rows):
        raise ValueError(f"no table on PID {pid}")
    for row in rows:
        raw = packets[row, 4:].tobytes()
        raw = raw[1 + raw[0] :]
        size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
        if raw[:1] == bytes([table_id]) and size <= len(raw) and not section_crc(raw[:size]):
            return raw[8 : size - 4]
    raise ValueError(f"broken table on PID {pid}")


def _descriptors(data: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 2 <= len(data):
        out[data[at]] = data[at + 2 : at + 2 + data[at + 1]]
        at += 2 + data[at + 1]
    return out


def _checked(packets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, int]:
    """(rows without repeated packets, jumps of the counter): rows are the payload packets of one PID, in order.

    A packet may come twice in a row, the same in every byte but the clock reference; a flagged discontinuity may jump."""
    counters, before = (packets[rows[1:], 3] & 15).astype(np.int64), (packets[rows[:-1], 3] & 15).astype(np.int64)
    twice = np.zeros(len(rows), bool)
    for i in np.flatnonzero(counters == before):
        twice[i + 1] = not twice[i] and bool((packets[rows[i], 12:] == packets[rows[i + 1], 12:]).all())
    kept = rows[~twice]
    step = np.diff((packets[kept, 3] & 15).astype(np.int64)) % 16
    flagged = (packets[kept, 3] & 0x20 > 0) & (packets[kept, 4] > 0) & (packets[kept, 5] & 0x80 > 0)
    return kept, int(((step != 1) & ~flagged[1:]).sum())


def demux(media: bytes) -> dict:
    """What a stream of mux()'s kind holds: payload, pts, point_pts and point_packets (lists), packets, and its faults:

    continuity_errors (jumps of any PID's counter), repeated_packets, length_errors (PES packets with more or fewer bytes
    than their length says, and runs of bytes before the first one), missing_units (by timestamps and the descriptor) and
    missing_bytes (of the payload that the descriptor promises)."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("out of sync")
    pids = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    programs = _section_of(packets, pids, PAT_PID, 0)
    map_pid = next((int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(programs), 4) if programs[i : i + 2] != b"\0\0"), None)
    if map_pid is None:
        raise ValueError("no program")
    table = _section_of(packets, pids, map_pid, 2)
    at = 4 + (int.from_bytes(table[2:4], "big") & 0xFFF)
    if at + 5 > len(table):
        raise ValueError("no elementary stream")
    es_pid = int.from_bytes(table[at + 1 : at + 3], "big") & 0x1FFF
    own = _descriptors(table[4:at]).get(DESCRIPTOR_TAG, b"")
    size, units, ticks = (int.from_bytes(own[i:j], "big") for i, j in ((0, 8), (8, 12), (12, 16)))
    errors = repeated = 0
    for pid in (PAT_PID, map_pid, es_pid):
        every = np.flatnonzero((pids == pid) & (packets[:, 3] & 0x10 > 0))
        rows, jumps = _checked(packets, every)
        errors, repeated = errors + jumps, repeated + len(every) - len(rows)
    es = packets[rows]
    adapt = np.where(es[:, 3] & 0x20 > 0, es[:, 4].astype(np.int64) + 1, 0)
    carried = 184 - adapt
    data = es[np.arange(PACKET)[None, :] >= PACKET - carried[:, None]]
    begin = es[:, 1] & 0x40 > 0
    starts = (np.cumsum(carried) - carried)[begin]
    sizes = np.diff(np.append(starts, len(data)))
    if (sizes < PES_HEADER).any():
        raise ValueError("a PES packet ends within its header")
    heads = data[starts[:, None] + np.arange(PES_HEADER)].astype(np.int64).reshape(-1, PES_HEADER)
    if (heads[:, :3] != (0, 0, 1)).any():
        raise ValueError("a PES packet has no start code")
    orphans = int(starts[0]) if len(starts) else len(data)
    lengths = (heads[:, 4] << 8 | heads[:, 5]) + 6
    pts = (heads[:, 9] >> 1 & 7) << 30 | heads[:, 10] << 22 | (heads[:, 11] >> 1) << 15 | heads[:, 12] << 7 | heads[:, 13] >> 1
    keep = np.ones(len(data), bool)
    keep[:orphans] = False
    for extra in np.unique(heads[:, 8]):
        keep[starts[heads[:, 8] == extra][:, None] + np.arange(9 + int(extra))] = False
    point = (adapt > 1) & (es[:, 5] & 0x40 > 0) & begin
    payload = data[keep].tobytes()
    gaps = int(np.maximum(np.diff(pts) // ticks - 1, 0).sum()) if ticks else 0
    return {
        "payload": payload, "pts": pts.tolist(), "point_pts": pts[point[begin]].tolist(), "point_packets": rows[point].tolist(), "packets": len(packets),
        "continuity_errors": errors, "repeated_packets": repeated, "length_errors": int((sizes != lengths).sum()) + (orphans > 0),
        "missing_units": max(gaps, units - len(pts)), "missing_bytes": max(0, size - len(payload)),
    }


def store_media(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs' rows without the text, with n_bytes and the text's padded bytes as a transport stream in column media."""

    def kernel(texts: list[str]) -> dict:
        raw = [t.encode() for t in texts]
        return {"n_bytes": [len(r) for r in raw], "media": [mux(pad(r)) for r in raw]}

    return map_texts(docs, lambda: kernel, "n_bytes long, media binary", [c for c in docs.columns if c not in (text, "n_bytes", "media")], text)


FAULTS = ["continuity_errors", "repeated_packets", "length_errors", "missing_units", "missing_bytes"]
FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, "
    + ", ".join(f"{f} long" for f in FAULTS)
    + ", pts array<long>, point_pts array<long>, point_packets array<long>, error string"
)


def read_media(media: DataFrame) -> DataFrame:
    """Parse the streams of column media; its other columns stay."""
    spark = media.sparkSession
    added = spark.createDataFrame([], FEATURES).schema
    keep = [c for c in media.columns if c != "media" and c not in added.names]
    schema = type(added)(media.select(*keep).schema.fields + added.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def parse(media: bytes | None) -> dict:
        if media is None:
            return {"error": "no media"}
        stored = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
        try:
            got = demux(media)
        except ValueError as e:
            return stored | {"error": str(e)}
        payload, pts = got["payload"], got["pts"]
        faults = sum(got[f] > 0 for f in FAULTS)
        return stored | {n: got[n] for n in (*FAULTS, "pts", "point_pts", "point_packets")} | {
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "n_packets": got["packets"],
            "feature": f"packets={got['packets']} units={len(pts)} points={len(got['point_pts'])} faults={faults} pts={min(pts, default=0)}-{max(pts, default=0)}",
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, 500):
                rows = [parse(x.as_py()) for x in column.slice(start, 500)]
                arrays = [batch.column(i).slice(start, len(rows)) for i in range(batch.num_columns - 1)]
                arrays += [pa.array([r.get(n) for r in rows], out.field(n).type) for n in added.names]
                yield pa.RecordBatch.from_arrays([a.cast(out.field(i).type) if a.type != out.field(i).type else a for i, a in enumerate(arrays)], schema=out)

    return media.select(*keep, "media").mapInArrow(run, schema)


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = settle(store_media(documents(spark, sf_dir).select("doc_id", "text")), "media")
    return read_media(stored).select("doc_id", "n_bytes", *[f.split()[0] for f in FEATURES.split(", ")])

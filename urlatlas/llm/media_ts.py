"""Media columns for MPEG transport streams: program tables, continuity counters, elementary packets, time stamps and
random-access points.

`demux` reads any stream of 188-byte packets: it follows the program association table to the program maps and their
elementary streams, whose sections may span packets and of which the latest version holds, counts breaks of the continuity
counters where no discontinuity is announced, joins packets into elementary packets and keeps their presentation times and
random-access marks. After inserted or lost bytes it looks for the next two sync bytes that are a packet apart. `mux` writes
bytes as one private stream, losslessly.

Cases: null or empty text is a payload of 64 zero bytes; packets that are cut short, without the sync byte, scrambled or marked
as damaged are skipped and counted; a repeated packet counts once; a stream without tables has no streams; repeated rows and
ties give equal values; very long texts make one long stream; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, tidy

PACKET = 188
SYNC = 0x47
MAP_PID, DATA_PID, PROGRAM = 0x1000, 0x100, 1
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
UNIT_BYTES = 4096
UNIT_TICKS = 3600  # of 90 kHz: 25 units a second
RANDOM_ACCESS_EVERY = 8


def _mpeg_crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _mpeg_crc_table()


def mpeg_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", mpeg_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | MAP_PID))) + _table_packet(
    MAP_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))
)


def _time_stamp(t: int) -> bytes:
    return bytes((0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE))


def _clock(t: int) -> bytes:
    return struct.pack(">IH", t >> 1 & 0xFFFFFFFF, (t & 1) << 15 | 0x7E00)


def mux(payload: bytes) -> bytes:
    """A transport stream of one program: units of the payload as elementary packets with time stamps and clocks."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        part, t = payload[at : at + UNIT_BYTES], 90000 + k * UNIT_TICKS
        unit = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(part) + 8, 0x84, 0x80, 5) + _time_stamp(t) + part
        room = PACKET - 4 - 8  # the first packet has a clock
        flags = 0x50 if k % RANDOM_ACCESS_EVERY == 0 else 0x10
        stuff = max(0, room - len(unit))
        out.append(struct.pack(">BHBBB", SYNC, 0x4000 | DATA_PID, 0x30 | counter, 7 + stuff, flags) + _clock(t) + b"\xff" * stuff + unit[:room])
        counter = counter + 1 & 15
        rest = len(unit) - room
        if rest > 0:
            full, tail = divmod(rest, PACKET - 4)
            packets = np.empty((full + (tail > 0), PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(len(packets))) & 15
            packets[:full, 4:] = np.frombuffer(unit, np.uint8, full * (PACKET - 4), room).reshape(full, PACKET - 4)
            if tail:
                stuff = PACKET - 4 - tail
                packets[full, 3] |= 0x20
                packets[full, 4] = stuff - 1
                packets[full, 5 : 4 + stuff] = 0xFF
                if stuff > 1:
                    packets[full, 5] = 0
                packets[full, 4 + stuff :] = np.frombuffer(unit, np.uint8, tail, len(unit) - tail)
            counter = counter + len(packets) & 15
            out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its packets' data, presentation times (None without), and which begin a random access."""

    pid: int
    kind: int
    units: list[bytes] = field(default_factory=list)
    times: list[int | None] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    breaks: int = 0


@dataclass
class Transport:
    streams: list[Stream]
    packets: int
    damaged: int


class Sections:
    """Sections of the tables on one packet identifier, put together from the packets' data."""

    def __init__(self):
        self.data, self.found = None, {}  # (table, extension, number) -> (version, body)

    def packet(self, data: bytes, begins: bool) -> None:
        if begins:
            at = 1 + (data[0] if data else 0)
            self._go_on(data[1:at])
            self.data = b""
            data = data[at:]
        self._go_on(data)

    def _go_on(self, data: bytes) -> None:
        if self.data is None:
            return  # nothing has begun yet
        self.data += data
        while len(self.data) >= 3 and self.data[0] != 0xFF:
            end = 3 + ((self.data[1] & 0x0F) << 8 | self.data[2])
            if len(self.data) < end:
                return
            section, self.data = self.data[:end], self.data[end:]
            if end >= 12 and section[5] & 1 and mpeg_crc(section) == 0:  # in force now, and whole
                table, version = (section[0], section[3] << 8 | section[4]), section[5] >> 1 & 31
                self.found = {k: v for k, v in self.found.items() if k[:2] != table or v[0] == version}
                self.found[*table, section[6]] = version, section[8:-4]

    def bodies(self, table_id: int) -> list[bytes]:
        return [body for key, (_, body) in sorted(self.found.items()) if key[0] == table_id]


def _packets(media: bytes) -> tuple[np.ndarray, int]:
    """Whole packets (rows of PACKET bytes) that begin with a sync byte, and how many runs of other bytes there are."""
    data = np.frombuffer(media, np.uint8)
    whole = len(data) // PACKET
    rows = data[: whole * PACKET].reshape(whole, PACKET)
    if whole * PACKET == len(data) and (rows[:, 0] == SYNC).all():
        return rows, 0
    follows = lambda at: at + PACKET >= len(data) or media[at + PACKET] == SYNC
    at, starts, bad = 0, [], 0
    while at + PACKET <= len(data):
        if media[at] == SYNC and (follows(at) or follows(at + PACKET)):
            starts.append(at)
            at += PACKET
            continue
        bad += 1
        if follows(at):
            at += PACKET
            continue
        at = media.find(SYNC, at + 1)
        while at >= 0 and not follows(at):
            at = media.find(SYNC, at + 1)
        at = at if at >= 0 else len(data)
    return data[np.array(starts, np.int64)[:, None] + np.arange(PACKET)], bad + (0 < len(data) - at < PACKET)


def demux(media: bytes) -> Transport:
    p, bad = _packets(media)
    good = (p[:, 1] < 0x80) & (p[:, 3] < 0x40)
    whole, damaged = len(p) + bad, bad + int(len(p) - good.sum())
    p = p[good]
    pids = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    begins, counters = (p[:, 1] & 0x40) > 0, (p[:, 3] & 15).astype(np.int64)
    adapted, loaded = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    offset = np.where(adapted, 5 + p[:, 4].astype(np.int64), 4)
    loaded &= offset < PACKET
    accessible = adapted & (p[:, 4] > 0) & ((p[:, 5] & 0x40) > 0)
    announced = adapted & (p[:, 4] > 0) & ((p[:, 5] & 0x80) > 0)

    def table(pid: int, table_id: int) -> list[bytes]:
        sections, before = Sections(), None
        for k in np.flatnonzero((pids == pid) & loaded).tolist():
            if before is None or p[k].tobytes() != before:  # a repeated packet says nothing new
                sections.packet(p[k, offset[k] :].tobytes(), bool(begins[k]))
            before = p[k].tobytes()
        return sections.bodies(table_id)

    maps = {(s[i + 2] & 0x1F) << 8 | s[i + 3] for s in table(0, 0) for i in range(0, len(s) - 3, 4) if s[i] or s[i + 1]}
    found: dict[int, int] = {}
    for pid in sorted(maps):
        for s in table(pid, 2):
            at = 4 + ((s[2] & 0x0F) << 8 | s[3])
            while at + 5 <= len(s):
                found[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
    streams = []
    for pid, kind in sorted(found.items()):
        out, of = Stream(pid, kind), np.flatnonzero((pids == pid) & loaded)
        if len(of):
            step = np.diff(counters[of]) & 15
            again = np.concatenate([[False], (step == 0) & (p[of[1:]] == p[of[:-1]]).all(axis=1)])
            out.breaks = int(((step != 1) & ~again[1:] & ~announced[of[1:]]).sum())
            of = of[~again]
            data = p[of][np.arange(PACKET) >= offset[of][:, None]].tobytes()
            ends = np.cumsum(PACKET - offset[of])
            heads = np.flatnonzero(begins[of])
            starts = (ends - (PACKET - offset[of]))[heads].tolist()
            for k, lo, hi in zip(heads.tolist(), starts, [*starts[1:], len(data)], strict=True):
                unit = data[lo:hi]
                if unit[:3] != b"\0\0\1" or len(unit) < 9:
                    out.breaks += 1
                    continue
                length = unit[4] << 8 | unit[5]
                t = None
                if unit[7] & 0x80 and len(unit) >= 14:
                    a, b, c, d, e = unit[9:14]
                    t = (a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1
                out.units.append(unit[9 + unit[8] : 6 + length if length else None])
                out.times.append(t)
                out.random_access.append(bool(accessible[of[k]]))
        streams.append(out)
    return Transport(streams, whole, damaged)


def describe(t: Transport) -> str:
    """What the tables and the packets say, in one line."""
    out = [f"packets={t.packets}", f"damaged={t.damaged}"]
    for s in t.streams:
        times = [x for x in s.times if x is not None]
        points = [str(x) for x, r in zip(s.times, s.random_access, strict=True) if r]
        out.append(f"pid={s.pid},type={s.kind},units={len(s.units)},breaks={s.breaks},times={times[0] if times else ''}-{times[-1] if times else ''},bytes={sum(map(len, s.units))},access={'+'.join(points)}")
    return ";".join(out)


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media binary, units array<struct<time, random_access, bytes>> read back from it."""

    def run(batches):
        kind = pa.list_(pa.struct([("time", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.binary())]))
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                media = [mux(padded((x.as_py() or "").encode())) for x in part.column("text")]
                units = [[{"time": t, "random_access": r, "bytes": u} for s in demux(m).streams for t, r, u in zip(s.times, s.random_access, s.units, strict=True)] for m in media]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary()), pa.array(units, kind)], ["doc_id", "media", "units"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary, units array<struct<time: long, random_access: boolean, bytes: binary>>")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """The digests of `media_column`, taken where the media is."""

    def digest(text: bytes) -> tuple:
        media = mux(padded(text))
        back = demux(media)
        payload = b"".join(u for s in back.streams for u in s.units)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(back)

    def run(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if "string" in x else pa.int64() for x in DIGEST.split(", ")]
        for b in batches:
            rows = [digest((x.as_py() or "").encode()) for x in b.column("text")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGEST}")

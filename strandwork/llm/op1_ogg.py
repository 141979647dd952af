"""Ogg media columns: multiplex bytes into pages, and read them back with every check that the format allows.

Pages carry packets as lacing values: runs of 255 and a last value below it. A packet may run over pages, so
packets are put together per logical stream. The page checksum is the unreflected CRC-32 of polynomial
0x04C11DB7 from 0 with no final inversion; mirrored bit by bit it is the reflected one that zlib has.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, functions as F

RATE = 8000
ALIGN = 192
#: Samples of a data packet. With 255 lacing values a page, packets regularly run over pages.
PACKET_SAMPLES = 24_000
PCM, NOTE = 0x50434D38, 0x4E4F5445
CONTINUED, FIRST, LAST = 1, 2, 4
PAGE = struct.Struct("<4sBBqIIIB")
#: Header packet of the PCM mapping: name, version, sample format (1: unsigned 8 bits), rate, bits, channels, frames a packet, extra headers.
HEADER = struct.Struct(">8sHHIIBBHI")
NOTE_HEADER = b"\x80length\x00"

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def stream_pages(serial: int, headers: Iterable[bytes], packets: Iterable[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream: each header packet on its own page, then packets with the granule that each ends at."""
    pages, lacing, body, granule, flags = [], bytearray(), bytearray(), -1, 0

    def close(last: bool = False) -> None:
        nonlocal granule, flags
        first = FIRST if not pages else 0
        pages.append(_page(flags | first | (LAST if last else 0), granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing.clear(), body.clear()
        granule, flags = -1, 0

    for header in headers:
        for at in range(0, len(header) + 1, 255):
            lacing.append(min(255, len(header) - at))
        body += header
        granule = 0
        close()
    for packet, end in packets:
        for at in range(0, len(packet) + 1, 255):
            if len(lacing) == 255:
                close()
                flags = CONTINUED if at else 0
            part = packet[at : at + 255]
            lacing.append(len(part))
            body += part
        granule = end
    close(last=True)
    return pages


def multiplex(payload: bytes, n_bytes: int) -> bytes:
    """A physical stream of two logical ones: the payload as samples, and a note of its unpadded length."""
    header = HEADER.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET_SAMPLES, 0)
    cuts = range(0, len(payload), PACKET_SAMPLES)
    sound = stream_pages(PCM, [header], [(payload[a : a + PACKET_SAMPLES], min(a + PACKET_SAMPLES, len(payload))) for a in cuts])
    note = stream_pages(NOTE, [NOTE_HEADER], [(struct.pack("<Q", n_bytes), 1)])
    return b"".join([sound[0], note[0], *sound[1:-1], *note[1:], sound[-1]])  # all first pages precede all others


def demultiplex(media: bytes) -> dict:
    """Logical streams by serial number, as lists of (packet, seconds at its page's end or None), and counts of faults.

    A page with a wrong checksum is skipped to the next capture pattern; a packet that lost a page, by a gap in
    page numbers or a missing continuation, is dropped and counted in `lost`.
    """
    streams: dict[int, dict] = {}
    found, at = {"pages": 0, "bad_pages": 0, "lost": 0, "streams": streams}, 0
    while (at := media.find(b"OggS", at)) >= 0 and at + PAGE.size <= len(media):
        _, version, flags, granule, serial, number, crc, segments = PAGE.unpack_from(media, at)
        body = at + PAGE.size + segments
        lacing = media[at + PAGE.size : body]
        end = body + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < segments or end > len(media) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            found["bad_pages"] += 1
            at += 4
            continue
        found["pages"] += 1
        stream = streams.setdefault(serial, {"packets": [], "open": None, "next": number, "granule": 0, "ended": False})
        if number != stream["next"] or bool(flags & CONTINUED) != (stream["open"] is not None):
            found["lost"] += stream["open"] is not None
            stream["open"] = None
        skip = bool(flags & CONTINUED) and stream["open"] is None
        part, place, done = stream["open"] or b"", body, []
        for n in lacing:
            part += media[place : place + n]
            place += n
            if n < 255:
                if skip:
                    skip, found["lost"] = False, found["lost"] + 1
                else:
                    done.append(part)
                part = b""
        stream["open"] = part if lacing and lacing[-1] == 255 and not skip else None
        seconds = granule / RATE if granule >= 0 else None
        stream["packets"] += [(p, None) for p in done[:-1]] + [(p, seconds) for p in done[-1:]]
        stream["granule"], stream["next"] = max(stream["granule"], granule), number + 1
        stream["ended"] |= bool(flags & LAST)
        at = end
    found["lost"] += sum(s["open"] is not None for s in streams.values())
    return found


DECODED = "payload binary, n_bytes long, pages int, bad_pages int, lost int, streams int, packets int, seconds double"


def _encode(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        raw = (text or "").encode()
        out.append(multiplex(raw + b" " * (max(1, -(-len(raw) // ALIGN)) * ALIGN - len(raw)), len(raw)))
    return pa.array(out, pa.binary())


def _decode(media: pa.Array) -> pa.Array:
    rows = []
    for blob in media:
        found = demultiplex(blob.as_py() or b"")
        streams = found["streams"]
        sound = streams.get(PCM, {"packets": [], "granule": 0})
        note = streams.get(NOTE, {"packets": []})["packets"][1:]
        n_bytes = struct.unpack("<Q", note[0][0])[0] if note and len(note[0][0]) == 8 else None
        packets = sum(len(s["packets"]) for s in streams.values())
        rows.append((b"".join(p for p, _ in sound["packets"][1:]), n_bytes, found["pages"], found["bad_pages"], found["lost"], len(streams), packets, sound["granule"] / RATE))
    kinds = [pa.binary(), pa.int64(), *[pa.int32()] * 5, pa.float64()]
    names = [c.split()[0] for c in DECODED.split(", ")]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)


def encode(text: Column) -> Column:
    """A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as an Ogg file of 8-bit samples.

    Null counts as empty; texts of any length; equal texts give equal files.
    """
    return F.arrow_udf(_encode, "binary")(text.cast("string"))


def decode(media: Column) -> Column:
    """Struct of the payload read back, its unpadded length (null if the note is lost), counts of good and bad pages,
    of lost packets, logical streams and packets, and the seconds that the last granule position stands for.

    A null, empty or foreign file gives an empty payload and no pages.
    """
    return F.arrow_udf(_decode, DECODED)(media)

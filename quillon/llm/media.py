"""Media columns: signature sniffing. Aho-Corasick finds magic bytes, format validators confirm structure and lengths.

A declared type is corrected when a confirmed signature at the start says otherwise, and confirmed media inside a value are
carved out, also media inside media, to any depth. Formats: WAV/AVI/WebP (RIFF), PNG, JPEG, GIF, BMP, PDF, ZIP, GZIP, FLAC, Ogg, MP4. A magic without a valid
structure or with lengths beyond the value (or beyond the media that it lies in) is not confirmed and changes nothing.

The same pass finds the marks that end a format (the end records of ZIP and PDF, the end of a JPEG), so a validator looks them up
instead of searching the rest of the value, and a value full of magic bytes costs no more than its length.

Null and empty values have no signature: their type is the declared one, unconfirmed. Values are judged one by one, so equal values get equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_column, blocks, read, slices

FRAME = 576  # samples in a frame of the stored form
FILL = 255
RATE = 8000

# --- formats: validator(value, at, end) -> length from `at`, or 0; nothing may reach beyond `end` ---------------


class Value:
    """Bytes with the places of the marks that end formats, and places from which a walk is known to fail."""

    def __init__(self, data: bytes):
        self.data, self.marks, self.dead = data, {m: [] for m in MARKS}, set()
        self.archives: dict[int, int] | None = None  # first byte -> byte behind the last

        self.zeros = (0, -1)  # from where, the next zero byte

    def zero(self, at: int) -> int:
        """The first zero byte from `at`; the length of the data if there is none."""
        lo, found = self.zeros
        if not lo <= at <= found:
            found = self.data.find(0, at)
            self.zeros = (at, len(self.data) if found < 0 else found)
        return self.zeros[1]

    def first(self, mark: bytes, at: int) -> int:
        """The first place of a mark from `at`; the length of the data if there is none."""
        places = self.marks[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else len(self.data)

    def between(self, mark: bytes, at: int, end: int) -> list[int]:
        places = self.marks[mark]
        return places[bisect_left(places, at) : bisect_left(places, end)]


def _riff(kind: bytes, holds: tuple[bytes, ...]) -> Callable[[Value, int, int], int]:
    """Chunks that fill the form, one of `holds` among them."""

    def check(v: Value, at: int, end: int) -> int:
        d = v.data
        if end - at < 12 or d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != kind:
            return 0
        stop, p, seen = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12, False
        if stop > end:
            return 0
        while p < stop:
            if p + 8 > stop:
                return 0
            seen |= d[p : p + 4] in holds
            n = struct.unpack_from("<I", d, p + 4)[0]
            p += 8 + n + (n & 1)
        return stop - at if seen and p in (stop, stop + 1) else 0

    return check


def _png(v: Value, at: int, end: int) -> int:
    d, p = v.data, at + 8
    while p + 12 <= end:
        n, kind = struct.unpack_from(">I", d, p)[0], d[p + 4 : p + 8]
        if p + 12 + n > end or (p == at + 8) != (kind == b"IHDR") or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _walk(v: Value, name: str, p: int, step: Callable[[int], int]) -> int:
    """p, moved on by step(p) until it says 0 (done, the place is returned) or -1 (failed). A place that led to a failure fails at once for later walks."""
    went = []
    while (name, p) not in v.dead:
        went.append((name, p))
        n = step(p)
        if n == 0:
            return p
        if n < 0:
            break
        p += n
    v.dead.update(went)
    return -1


def _jpeg(v: Value, at: int, end: int) -> int:
    d = v.data

    def step(p: int) -> int:
        if p + 4 > end or d[p] != 0xFF:
            return -1
        mark, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if mark in (0xD8, 0x00, 0xFF) or n < 2:
            return -1
        return 0 if mark == 0xDA else 2 + n

    scan = _walk(v, f"jpeg{end}", at + 2, step)
    if scan < 0:
        return 0
    stop = v.first(b"\xff\xd9", scan + 4)  # behind the entropy-coded data
    return stop + 2 - at if stop + 2 <= end else 0


def _gif(v: Value, at: int, end: int) -> int:
    d = v.data
    if end - at < 14:
        return 0

    def step(p: int) -> int:
        if p >= end:
            return -1
        if d[p] == 0x3B:
            return 0
        q = p
        if d[p] == 0x21:
            q += 2
        elif d[p] == 0x2C and p + 10 <= end:
            q += 10 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 0x80 else 0) + 1
        else:
            return -1
        while q < end and d[q]:
            q += 1 + d[q]
        return q + 1 - p

    stop = _walk(v, f"gif{end}", at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0), step)
    return stop + 1 - at if stop >= 0 else 0


def _bmp(v: Value, at: int, end: int) -> int:
    if end - at < 30:
        return 0
    n, reserved, start, head = struct.unpack_from("<IIII", v.data, at + 2)
    return n if reserved == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= n <= end - at else 0


def _pdf(v: Value, at: int, end: int) -> int:
    """To the last end mark before the next document's head: a document may have several, one for each update."""
    heads = v.first(b"%PDF-", at + 1)
    ends = v.between(b"%%EOF", at, min(end, heads) - 4)
    return ends[-1] + 5 - at if ends and v.first(b"startxref", at) < ends[-1] else 0


def _zip(v: Value, at: int, end: int) -> int:
    """An end record says where the archive starts; those of stored archives inside say another place."""
    if v.archives is None:
        v.archives = {}
        for stop in v.marks[b"PK\x05\x06"]:
            if stop + 22 <= len(v.data):
                n, start, note = struct.unpack_from("<IIH", v.data, stop + 12)
                if not n or v.data[stop - n : stop - n + 4] == b"PK\x01\x02":
                    v.archives.setdefault(stop - n - start, stop + 22 + note)
    stop = v.archives.get(at, 0)
    return stop - at if at < stop <= end else 0


def _gzip(v: Value, at: int, end: int) -> int:
    d, flags, p = v.data, v.data[at + 3] if end - at >= 18 else 0xFF, at + 10
    if flags & 0xE0:
        return 0
    if flags & 4:
        p += 2 + int.from_bytes(d[p : p + 2], "little")
    for flag in (8, 16):  # a name, a comment: to the next zero
        if flags & flag:
            p = v.zero(p) + 1
    p += flags & 2
    if p > end - 9:
        return 0
    z, crc, n = zlib.decompressobj(-15), 0, 0
    try:
        while p < end and not z.eof:
            part, p = d[p : min(p + 65536, end)], p + 65536
            while part and not z.eof:  # bounded memory for any expansion
                text = z.decompress(part, 1 << 20)
                crc, n, part = zlib.crc32(text, crc), n + len(text), z.unconsumed_tail
    except zlib.error:
        return 0
    p = min(p, end) - len(z.unused_data)
    return p + 8 - at if z.eof and p + 8 <= end and struct.unpack_from("<II", d, p) == (crc, n & 0xFFFFFFFF) else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16, _CRC32 = _crc_table(0x07, 8), _crc_table(0x8005, 16), _crc_table(0x04C11DB7, 32)


def _flac_frame(d: bytes, p: int, end: int) -> tuple[int, int]:
    """(header bytes, samples) of the frame at p, or (0, 0): the header has a checksum of its own."""
    if p + 6 > end or d[p] != 0xFF or d[p + 1] & 0xFC != 0xF8 or d[p + 3] & 1:
        return 0, 0
    lead, q = d[p + 4], p + 5
    while lead & 0x80 and lead & 0x40:  # a coded number: one byte more for each further leading one
        lead, q = lead << 1 & 0xFF, q + 1
    kind, rate = d[p + 2] >> 4, d[p + 2] & 15
    extra = {6: 1, 7: 2}.get(kind, 0)
    if kind == 0 or rate == 15 or q + extra + 3 > end:
        return 0, 0
    samples = 192 if kind == 1 else 576 << (kind - 2) if kind < 6 else int.from_bytes(d[q : q + extra], "big") + 1 if kind < 8 else 256 << (kind - 8)
    q += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in d[p:q]:
        crc = _CRC8[crc ^ x]
    return (q + 1 - p, samples) if q < end and crc == d[q] else (0, 0)


def _flac(v: Value, at: int, end: int) -> int:
    """Metadata blocks, then frames: a frame ends where its checksum is met and the next one starts or all samples are there."""
    d, p, total = v.data, at + 4, 0
    while p + 4 <= end:
        kind, n, last = d[p] & 0x7F, int.from_bytes(d[p + 1 : p + 4], "big"), d[p] & 0x80
        if (p == at + 4) != (kind == 0) or kind == 0 and n != 34 or p + 4 + n > end:
            return 0
        if kind == 0:
            total = int.from_bytes(d[p + 17 : p + 22], "big") & 0xFFFFFFFFF
        p += 4 + n
        if last:
            break
    else:
        return 0
    done = 0
    while not total or done < total:
        head, samples = _flac_frame(d, p, end)
        if not head:
            return p - at if done and not total else 0
        crc, q = 0, p
        for q in range(p, end):
            crc = (crc << 8 ^ _CRC16[crc >> 8 ^ d[q]]) & 0xFFFF
            if not crc and q >= p + head + 1 and (q + 1 == end or total and done + samples >= total or _flac_frame(d, q + 1, end)[0]):
                break
        else:
            return 0
        done, p = done + samples, q + 1
        if p == end:
            break
    return p - at if done and (not total or done >= total) else 0


def _ogg(v: Value, at: int, end: int) -> int:
    """Pages with right checksums, the first of which starts a stream (so that later pages aren't streams of their own)."""
    d = v.data

    def step(p: int) -> int:
        if p + 27 > end or d[p : p + 5] != b"OggS\0" or d[p + 5] > 7 or p + 27 + d[p + 26] > end:
            return 0
        n, crc = 27 + d[p + 26] + sum(d[p + 27 : p + 27 + d[p + 26]]), 0
        if p + n > end:
            return -1
        for x in d[p : p + 22] + bytes(4) + d[p + 26 : p + n]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC32[crc >> 24 ^ x]
        return n if crc == struct.unpack_from("<I", d, p + 22)[0] else -1

    return max(_walk(v, f"ogg{end}", at, step) - at, 0) if end - at >= 27 and d[at + 5] & 2 else 0


def _mp4(v: Value, at: int, end: int) -> int:
    """Boxes up to the first bytes that are none; a length of 1 is followed by a long one, a length of 0 reaches to the end."""
    d, p, seen = v.data, at, set()
    while p + 8 <= end:
        n, kind = struct.unpack_from(">I", d, p)[0], d[p + 4 : p + 8]
        if n == 1 and p + 16 <= end:
            n = struct.unpack_from(">Q", d, p + 8)[0]
        elif n == 0:
            n = end - p
        if n < 8 or p + n > end or not all(32 <= c < 127 or c == 169 for c in kind) or kind == b"ftyp" and p > at:
            break
        seen.add(kind)
        p += n
    return p - at if b"moov" in seen or b"moof" in seen else 0


#: (type, magic, place of the magic in the format, validator)
FORMATS: list[tuple[str, bytes, int, Callable[[Value, int, int], int]]] = [
    ("audio/wav", b"WAVE", 8, _riff(b"WAVE", (b"fmt ",))),
    ("video/avi", b"AVI ", 8, _riff(b"AVI ", (b"LIST",))),
    ("image/webp", b"WEBPVP8", 8, _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/bmp", b"BM", 0, _bmp),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("audio/flac", b"fLaC", 0, _flac),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
]
MARKS = (b"%PDF-", b"%%EOF", b"startxref", b"PK\x05\x06", b"\xff\xd9")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in dict.fromkeys([*(m for _, m, _, _ in FORMATS), *MARKS]):
        a.add_word(magic.decode("latin-1"), (magic, [(kind, place, check) for kind, m, place, check in FORMATS if m == magic]))
    a.make_automaton()
    return a


class Sniffer:
    def __init__(self):
        self.automaton = _automaton()

    def found(self, data: bytes) -> list[tuple[int, int, str]]:
        """(offset, length, type) of confirmed media, by offset, those that hold others first."""
        value, hits = Value(data), []
        for end, (magic, formats) in self.automaton.iter(data.decode("latin-1")):
            at = end + 1 - len(magic)
            if magic in value.marks:
                value.marks[magic].append(at)
            hits += [(at - place, kind, check) for kind, place, check in formats if at >= place]
        hits.sort(key=lambda x: x[0])
        out, around = [], []  # around: ends of the media that the place lies in
        for at, kind, check in hits:
            while around and around[-1] <= at:
                around.pop()
            if n := check(value, at, around[-1] if around else len(data)):
                out.append((at, n, kind))
                around.append(at + n)
        return out


_SNIFFER: list[Sniffer] = []


def sniffer() -> Sniffer:
    if not _SNIFFER:
        _SNIFFER.append(Sniffer())
    return _SNIFFER[0]


SNIFF = "struct<type:string,confirmed:boolean,corrected:boolean,carved:array<struct<type:string,offset:bigint,length:bigint,data:binary>>>"


def sniff(df: DataFrame, media_col: str, declared_col: str | None = None, out_col: str = "sniffed", carve_data: bool = True) -> DataFrame:
    """The input's columns and out_col: the type, whether a validator confirmed it, whether it corrects the declared one, and embedded media."""
    kind = pa.struct([("type", pa.string()), ("confirmed", pa.bool_()), ("corrected", pa.bool_()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])))])

    def judge(media, declared=None):
        out = []
        for data, said in zip(media, declared.to_pylist() if declared is not None else [None] * len(media), strict=True):
            data = data.as_py() or b""
            found = sniffer().found(data)
            own = next((f for f in found if f[0] == 0), None)
            carved = [{"type": k, "offset": a, "length": n, "data": data[a : a + n] if carve_data else None} for a, n, k in found if (a, n, k) != own]
            out.append({"type": own[2] if own else said, "confirmed": own is not None, "corrected": own is not None and said is not None and said != own[2], "carved": carved})
        return pa.array(out, kind)

    return add_column(df, out_col, SNIFF, judge, media_col, *[declared_col] * (declared_col is not None), rows=500)


# --- stored form: 8-bit mono PCM ---------------------------------------------------------------------------------


def wav_bytes(payload: bytes, n: int) -> bytes:
    """A WAV file with one sample a byte. A chunk of its own keeps the count of bytes before padding."""
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"size" + struct.pack("<IQ", 8, n) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_payload(media: bytes) -> tuple[bytes, int]:
    """(samples, count of bytes before padding), by walking the chunks."""
    p, n, data = 12, 0, b""
    while p + 8 <= len(media):
        kind, size = media[p : p + 4], struct.unpack_from("<I", media, p + 4)[0]
        if kind == b"data":
            data = media[p + 8 : p + 8 + size]
        elif kind == b"size":
            n = struct.unpack_from("<Q", media, p + 8)[0]
        p += 8 + size + (size & 1)
    return data, n


def to_media(df: DataFrame, text_col: str = "text", media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and media_col: each text's bytes, filled up to a positive multiple of a frame, as a media file."""
    rows = df.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        for b in slices(batches):
            out = []
            for lo, hi, data, off in blocks(b.column("__text")):
                raw = data.tobytes()
                for i in range(hi - lo):
                    text = raw[off[i] : off[i + 1]]
                    out.append(wav_bytes(text + bytes([FILL]) * (max(-(-len(text) // FRAME), 1) * FRAME - len(text)), len(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, media_col])

    return rows.mapInArrow(run, rows.select(*keep, F.lit(b"").alias(media_col)).schema)


def op6_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = to_media(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sniffed = sniff(media.withColumn("declared", F.lit("application/octet-stream")), "media", "declared", carve_data=False)

    def run(batches):
        for b in slices(batches):
            rows = []
            for data, s in zip(b.column("media"), b.column("sniffed").to_pylist(), strict=True):
                data = data.as_py()
                payload, n = wav_payload(data)
                x = np.frombuffer(payload, np.uint8)
                feature = f"{s['type']};corrected={int(s['corrected'])};carved={len(s['carved'])};frames={len(x) // FRAME};mean={x.mean():.4f};peak={int(x.max())};crossings={int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return sniffed.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

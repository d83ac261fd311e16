"""MPEG audio columns: resynchronise frame headers, parse tags and VBR tables, verify checksums,
and keep exact durations and frame seek offsets.

`read_media` parses a binary column of any MPEG-1/2/2.5 audio, layers I to III. `store_payloads`
writes a payload losslessly as a valid stream: an ID3v2 tag, a VBR table frame, and Layer III
frames without main data whose ancillary bytes carry the payload (a decoder plays silence).
A frame's ancillary area starts with the number of payload bytes in it.

A header is trusted when it is valid and the next frame, found by its length, has the same
version, layer and rate, or the data end there; otherwise the search goes on at the next byte,
so payloads full of false sync words are read back right. Both operators work file by file
where the rows are, without a shuffle.

Tags: text frames of ID3v2.2 to 2.4 in all four encodings, with unsynchronisation, extended header
and footer; the fields of ID3v1 (`ID3v1.title` and so on) where they are filled. Tables: Xing, Info
and VBRI with their seek tables; an encoder's delay and padding, where they are stated, are taken
off the samples, so durations are those of the sound. Checksums are verified for Layers I and III;
those of Layer II, whose protected length depends on its allocation tables, are not judged. A
free-format stream counts as junk.

Edge cases: null media gives null fields; data without a frame have 0 frames and duration 0;
trailing bytes and a cut last frame are counted as junk; null text is an empty payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s by (version 1 or 2, layer), and sample rates.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

RATE = 48000
SIDE = 17
HEAD = 4 + 2 + SIDE
UNIT = 64


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005, as the standard's error check has it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


class Header:
    __slots__ = ("bitrate", "bound", "crc", "kind", "layer", "length", "mono", "rate", "samples", "version")

    def __init__(self, version, layer, bitrate, rate, padding, crc, mono, bound):
        generation = 1 if version == 3 else 2
        self.bound = bound  # first subband that both channels share
        self.version, self.layer, self.bitrate, self.rate, self.crc, self.mono = version, layer, bitrate, rate, crc, mono
        self.samples = SAMPLES[generation, layer]
        if layer == 1:
            self.length = (12000 * bitrate // rate + padding) * 4
        else:
            self.length = self.samples // 8 * 1000 * bitrate // rate + padding
        self.kind = (version, layer, rate)

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def protected(self) -> int:
        """Bytes after the checksum that it covers: side information, or the bit allocation of Layer I."""
        return self.side if self.layer == 3 else 16 if self.mono else (32 + self.bound) // 2


@lru_cache(maxsize=65536)
def header(four: bytes) -> Header | None:
    """A frame header, or None where the four bytes are none (free-format streams included)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate_i, bit_i = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate_i == 3 or bit_i in (0, 15):
        return None
    return Header(version, layer, BITRATES[1 if version == 3 else 2, layer][bit_i], SAMPLE_RATES[version][rate_i], four[2] >> 1 & 1, not four[1] & 1, four[3] >> 6 == 3, ((four[3] >> 4 & 3) + 1) * 4 if four[3] >> 6 == 1 else 32)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
ID3V1 = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Reads the text frames of the tag at `at`; returns where it ends."""
    version, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80:
        body = body.replace(b"\xff\0", b"\xff")
    width, p = (3, 0) if version == 2 else (4, 0)
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        p = _syncsafe(body[:4]) if version >= 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if version == 2 else 10
    while p + head <= len(body) and body[p : p + width].isalnum():
        n = _syncsafe(body[p + 4 : p + 8]) if version >= 4 else int.from_bytes(body[p + width : p + 2 * width], "big")
        text = body[p + head : p + head + n]
        if body[p : p + 1] == b"T" and text and text[0] < len(ENCODINGS):
            tags[body[p : p + width].decode("latin-1")] = text[1:].decode(ENCODINGS[text[0]], "replace").rstrip("\0")
        p += head + n
    return at + 10 + size + (10 if flags & 0x10 and version >= 4 else 0)


def _vbri(data: bytes, at: int, out: dict) -> None:
    out["vbr"], out["vbr_bytes"], out["vbr_frames"] = "VBRI", *struct.unpack(">II", data[at + 10 : at + 18])
    entries, _, width, _ = struct.unpack(">4H", data[at + 18 : at + 26])
    out["toc"] = data[at + 26 : at + 26 + entries * width]


def _trimmed(tag: bytes) -> int:
    """Samples of delay and padding that an encoder's tag after the table states."""
    if tag[:4] not in (b"LAME", b"Lavf", b"Lavc") or len(tag) < 24:
        return 0
    return (tag[21] << 4 | tag[22] >> 4) + ((tag[22] & 15) << 8 | tag[23])


def parse(data: bytes) -> dict:
    """What a stream holds; `offsets` has the place of each audio frame, `bodies` its ancillary spans for Layer III."""
    at, end, tags = 0, len(data), {}
    n_tags = 0
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at, n_tags = _id3v2(data, at, tags), n_tags + 1
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        old = data[end - 128 : end]
        filled = {f"ID3v1.{name}": old[a:b].split(b"\0")[0].decode("latin-1").strip() for name, (a, b) in ID3V1.items()}
        tags.update({name: text for name, text in filled.items() if text})
        end, n_tags = end - 128, n_tags + 1
    out = {"tags": tags, "n_tags": n_tags, "frames": 0, "samples": 0, "rate": 0, "crc_ok": 0, "crc_bad": 0, "junk": 0, "vbr": "", "vbr_frames": 0, "vbr_bytes": 0, "toc": b"", "offsets": [], "bodies": [], "kbits": 0}
    locked, first, cut = None, True, 0
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.length if h else 0
        if h and locked == h.kind and after <= end:
            good = True
        elif h and after <= end and (locked is None or locked == h.kind):
            follower = header(data[after : after + 4])
            good = after == end or (follower is not None and follower.kind == h.kind)
        else:
            good = False
        if not good:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out["junk"] += found - at
            at, locked = found, None
            continue
        locked = h.kind
        body = at + 4 + 2 * h.crc + (h.side if h.layer == 3 else 0)
        if first:
            first = False
            mark = data[body : body + 4]
            if mark in (b"Xing", b"Info"):
                flags = int.from_bytes(data[body + 4 : body + 8], "big")
                p = body + 8
                out["vbr"] = mark.decode()
                if flags & 1:
                    out["vbr_frames"], p = int.from_bytes(data[p : p + 4], "big"), p + 4
                if flags & 2:
                    out["vbr_bytes"], p = int.from_bytes(data[p : p + 4], "big"), p + 4
                if flags & 4:
                    out["toc"], p = data[p : p + 100], p + 100
                cut = _trimmed(data[p + 4 * (flags >> 3 & 1) : after])
                at = after
                continue
            if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= after:
                _vbri(data, at + 36, out)
                at = after
                continue
        if h.crc and h.layer != 2:
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.protected]) == int.from_bytes(data[at + 4 : at + 6], "big")
            out["crc_ok" if good else "crc_bad"] += 1
        out["frames"] += 1
        out["samples"] += h.samples
        out["rate"] = h.rate
        out["kbits"] += h.bitrate
        out["offsets"].append(at)
        if h.layer == 3:
            out["bodies"].append((body, after))
        at = after
    out["junk"] += end - at
    out["samples"] = max(0, out["samples"] - cut)
    return out


_NO_MAIN_DATA = bytes(SIDE)


def _frame(kbits: int, payload: bytes) -> bytes:
    index = BITRATES[1, 3].index(kbits)
    low = bytes([index << 4 | 1 << 2, 0xC0])
    check = crc16(low + _NO_MAIN_DATA).to_bytes(2, "big")
    room = 3 * kbits - HEAD - 2
    return b"\xff\xfa" + low + check + _NO_MAIN_DATA + len(payload).to_bytes(2, "big") + payload + bytes(room - len(payload))


def build(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A variable-bitrate stream that carries the payload: large frames, then the smallest that holds the rest."""
    rates = BITRATES[1, 3][1:]
    room = {k: 3 * k - HEAD - 2 for k in rates}
    most = room[rates[-1]]
    frames = [_frame(rates[-1], payload[a : a + most]) for a in range(0, len(payload) - len(payload) % most, most)]
    if rest := payload[len(payload) - len(payload) % most :]:
        frames.append(_frame(next(k for k in rates if room[k] >= len(rest)), rest))
    sizes = [len(f) for f in frames]
    total = sum(sizes)
    table_size = 3 * 64
    toc, seen, at = [], table_size, 0
    for percent in range(100):
        while at < len(frames) and at * 100 < percent * len(frames):
            seen, at = seen + sizes[at], at + 1
        toc.append(min(255, 256 * seen // (total + table_size)))
    table = b"\xff\xfb" + bytes([BITRATES[1, 3].index(64) << 4 | 1 << 2, 0xC0]) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), total + table_size) + bytes(toc)
    named = b"".join(k.encode() + bytes([0, 0, (len(v.encode()) + 1) >> 7, (len(v.encode()) + 1) & 127, 0, 0]) + b"\x03" + v.encode() for k, v in (tags or {"TSSE": "payload"}).items())
    size = len(named)
    tag = b"ID3\x04\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + named
    return tag + table + bytes(table_size - len(table)) + b"".join(frames)


def payload_of(data: bytes, parsed: dict) -> bytes:
    out = []
    for start, stop in parsed["bodies"]:
        n = int.from_bytes(data[start : start + 2], "big")
        out.append(data[start + 2 : min(start + 2 + n, stop)])
    return b"".join(out)


def _store(frames):
    for pdf in C.by_bytes(frames, "body", 8 << 20):
        bodies = [b or b"" for b in pdf["body"]]
        padded = [b + bytes(max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b)) for b in bodies]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(b) for b in bodies], "media": [build(b) for b in padded]})


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text, padded to a positive multiple of 64 bytes, as an MPEG stream."""
    rows = docs.select(C.id_or_last(docs), F.col("text").cast("binary").alias("body"))
    return rows.mapInPandas(_store, "doc_id long, n_bytes long, media binary").select(C.id_or_null(), "n_bytes", "media")


MEDIA = "frames long, samples long, sample_rate int, duration_us long, mean_kbits double, crc_ok long, crc_bad long, junk_bytes long, n_tags int, tags map<string,string>, vbr string, vbr_frames long, vbr_bytes long, toc binary, seek_offsets array<long>, payload binary"


def _described(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 16
    p = parse(data)
    micros = 1_000_000 * p["samples"] // p["rate"] if p["rate"] else 0
    mean = p["kbits"] / p["frames"] if p["frames"] else 0.0
    return (p["frames"], p["samples"], p["rate"], micros, mean, p["crc_ok"], p["crc_bad"], p["junk"], p["n_tags"], p["tags"], p["vbr"], p["vbr_frames"], p["vbr_bytes"], p["toc"], p["offsets"], payload_of(data, p))


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the columns of MEDIA for each row of (key, media)."""
    names = [x.split()[0] for x in MEDIA.split(", ")]
    kind = media.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in C.by_bytes(frames, "media", 8 << 20):
            out = pd.DataFrame([_described(b) for b in pdf["media"]], columns=names, dtype=object)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return media.select(key, "media").mapInPandas(run, f"{key} {kind}, {MEDIA}")


def _digests(frames):
    for pdf in C.by_bytes(frames, "media", 8 << 20):
        rows = []
        for data in pdf["media"]:
            frames_, samples, rate, micros, _, ok, bad, junk, n_tags, tags, vbr, vbr_frames, vbr_bytes, toc, offsets, payload = _described(data)
            seek = zlib.crc32(struct.pack(f"<{len(offsets)}Q", *offsets))
            tag = ",".join(f"{k}={v}" for k, v in sorted(tags.items()))
            feature = f"frames={frames_};samples={samples};rate={rate};duration_us={micros};crc_ok={ok};crc_bad={bad};junk={junk};tags={n_tags}:{tag};vbr={vbr}:{vbr_frames}:{vbr_bytes};toc={zlib.crc32(toc)};seek={seek}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        yield pd.concat([pdf[["doc_id", "n_bytes"]].reset_index(drop=True), out], axis=1)


def media_digest(docs: DataFrame) -> DataFrame:
    stored = store_payloads(docs).select(C.id_or_last(docs), "n_bytes", "media")
    out = stored.mapInPandas(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(C.id_or_null(), *out.columns[1:])

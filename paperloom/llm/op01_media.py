"""Media columns: AVI motion-JPEG to timed clip rows.

``store_media`` keeps a payload losslessly as 8-bit grey samples: frames of 24 x 24 samples, each a lossless JPEG
(predictor 1), in an AVI file with an ``idx1`` index. ``read_media`` walks any AVI's RIFF chunks and index and
decodes its intra frames: lossless greyscale JPEG and baseline DCT JPEG (the luma of it). ``clips`` cuts the frames
into shots where the histogram difference of neighbouring frames stands out against the differences around it,
and yields one row per clip with its times.

The Huffman table that ``store_media`` writes gives every difference a code of 9 bits, length and value together
(category s has a prefix of 9 - s bits), so frames of one size are coded and decoded as arrays. Other tables take
the bit-by-bit reader.

Defined results: a null text is an empty one and is stored as one frame of bytes 255; a null id is passed
through; repeated rows give equal values; a file without frames has no clips; a null or damaged file, or one of a
coding that isn't read, has an ``error`` and no digests, clips or feature; an empty table gives no rows; only the named
columns are read, so others can't clash. A task codes and reads about 1 MB of rows at a time, and long payloads
in blocks of frames, so that working memory stays bounded beside the payload itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import map_arrow, table, text_of

SIDE = 24
UNIT = SIDE * SIDE
FPS = 25
#: Frames coded at once.
BLOCK = 2048


@dataclass(frozen=True)
class ShotConfig:
    bins: int = 16
    #: Neighbouring differences on either side that the threshold is drawn from.
    reach: int = 8
    #: A cut differs by more than mean + deviations * standard deviation, and by the floor at least.
    deviations: float = 3.0
    floor: float = 0.10


# --- lossless JPEG, one component ---------------------------------------------------------------------------------

_CATEGORIES = bytes(range(8, -1, -1))  # code lengths 1..9 in this order


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: SOI, DHT (table 0, one code of each length 1..9), SOF3 (8 bits, 24 x 24, one component), SOS (predictor 1).
HEADER = (
    b"\xff\xd8"
    + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + _CATEGORIES)
    + _segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
    + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
)
END = b"\xff\xd9"


def _code_table() -> np.ndarray:
    """9-bit code of every difference -255..255: 8 - s ones, a zero, then s value bits (s = 0: eight ones, a zero)."""
    d = np.arange(-255, 256)
    s = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(int) + 1)
    value = np.where(d < 0, d + (1 << s) - 1, d)
    prefix = ((1 << (8 - s)) - 1) << 1
    return ((prefix << s) | value).astype(np.uint16)


_CODES = _code_table()
_DIFFS = np.full(512, -1000, np.int16)
_DIFFS[_CODES] = np.arange(-255, 256)


def _predict(samples: np.ndarray) -> np.ndarray:
    """Differences to the left sample; first column to the one above; the first sample to 128."""
    x = samples.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    return d


def _restore(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of (n, 24, 24) samples."""
    codes = _CODES[_predict(samples).reshape(len(samples), UNIT) + 255]
    bits = ((codes[:, :, None] >> np.arange(8, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8)
    packed = np.packbits(bits.reshape(len(samples), -1), axis=1)
    return [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + END for row in packed]


def _decode_own(frames: list[bytes]) -> np.ndarray:
    size = UNIT * 9 // 8
    raw = b"".join(f[len(HEADER) : -2].replace(b"\xff\x00", b"\xff") for f in frames)
    if len(raw) != size * len(frames):
        raise ValueError("a frame's scan has an unexpected length")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(frames), UNIT, 9)
    codes = np.zeros((len(frames), UNIT), np.uint16)
    for k in range(9):
        codes = (codes << 1) | bits[:, :, k]
    return _restore(_DIFFS[codes].reshape(-1, SIDE, SIDE))


# --- any greyscale lossless or baseline JPEG ----------------------------------------------------------------------


class _Bits:
    """A bit reader over an entropy-coded segment whose stuffing is removed."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def signed(self, s: int) -> int:
        if s == 0:
            return 0
        v = self.take(s)
        return v if v >> (s - 1) else v - (1 << s) + 1


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    codes, code, k = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            codes[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def _zigzag() -> np.ndarray:
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[1] if sum(x) % 2 == 0 else x[0]))
    return np.array([r * 8 + c for r, c in order])


_ZIGZAG = _zigzag()
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def decode_jpeg(data: bytes) -> np.ndarray:
    """Samples of the first component of a lossless (SOF3, predictor 1) or baseline (SOF0) JPEG."""
    at, tables, quant, frame, restart = 2, {}, {}, None, 0
    while True:
        marker = data[at + 1]
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(int)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC3):
            frame = (marker, *struct.unpack(">BHHB", body[:6]), [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(body[5])])
        elif marker == 0xDA:
            scan = body
            break
    if frame is None or restart:
        raise ValueError("unsupported JPEG")
    kind, _, height, width, _, parts = frame
    bits = _Bits(data[at : data.rindex(END)].replace(b"\xff\x00", b"\xff"))
    chosen = {scan[1 + 2 * k]: scan[2 + 2 * k] for k in range(scan[0])}
    if kind == 0xC3:
        if len(parts) > 1 or scan[1 + 2 * scan[0]] != 1:
            raise ValueError("unsupported lossless JPEG")
        codes = tables[chosen[parts[0][0]] >> 4]
        d = np.array([bits.signed(bits.symbol(codes)) for _ in range(height * width)]).reshape(1, height, width)
        return _restore(d)[0]
    most_h, most_v = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
    if len(parts) == 1:
        parts = [(parts[0][0], 0x11, parts[0][2])]
        most_h = most_v = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    h, v = parts[0][1] >> 4, parts[0][1] & 15
    luma, last = np.zeros((down * v * 8, across * h * 8)), [0] * len(parts)
    for m in range(across * down):
        for p, (name, factors, q) in enumerate(parts):
            dc, ac = tables[chosen[name] >> 4], tables[16 | chosen[name] & 15]
            for j in range((factors >> 4) * (factors & 15)):
                block, k = np.zeros(64), 1
                last[p] += bits.signed(bits.symbol(dc))
                block[0] = last[p]
                while k < 64:
                    run = bits.symbol(ac)
                    if run == 0:
                        break
                    k += run >> 4
                    if run & 15:
                        block[_ZIGZAG[k]] = bits.signed(run & 15)
                    k += 1
                if p == 0:
                    scale = np.zeros(64)
                    scale[_ZIGZAG] = quant[q]
                    y, x = (m // across * v + j // h) * 8, (m % across * h + j % h) * 8
                    luma[y : y + 8, x : x + 8] = _COSINES.T @ (block * scale).reshape(8, 8) @ _COSINES
    return np.clip(np.rint(luma[:height, :width] + 128), 0, 255).astype(np.uint8)


# --- AVI ----------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    most = max((len(f) for f in frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    places = np.cumsum([4, *(len(c) for c in chunks)])
    index = b"".join(struct.pack("<4sIII", b"00dc", 0x10, int(at), len(f)) for at, f in zip(places, frames))
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Seconds per frame, and the video frames by the index, or in file order where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, seconds, movi, entries = 12, 1 / FPS, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            seconds = struct.unpack_from("<I", data, data.index(b"avih", at) + 8)[0] / 1e6
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1":
            entries = np.frombuffer(data, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None:
        return seconds, []
    frames = []
    if entries is not None:
        base = movi[0] if len(entries) == 0 or entries[0, 2] < movi[0] else 0  # offsets count from the list or the file
        for tag, _, place, size in entries.tolist():
            if tag >> 16 in (0x6364, 0x6264):  # ..dc, ..db
                frames.append(data[base + place + 8 : base + place + 8 + size])
        return seconds, frames
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return seconds, frames


def decode_frames(frames: list[bytes]):
    """Yields (n, height, width) arrays; neighbours of the own kind are decoded together."""
    k = 0
    while k < len(frames):
        own = k
        while own < len(frames) and own - k < BLOCK and frames[own].startswith(HEADER):
            own += 1
        if own > k:
            yield _decode_own(frames[k:own])
            k = own
        else:
            yield decode_jpeg(frames[k])[None]
            k += 1


# --- shots --------------------------------------------------------------------------------------------------------


def histograms(samples: np.ndarray, bins: int) -> np.ndarray:
    """Shares of grey levels per frame."""
    n, each = len(samples), samples[0].size
    level = samples.reshape(n, each).astype(np.int64) * bins >> 8
    return np.bincount((level + np.arange(n)[:, None] * bins).ravel(), minlength=n * bins).reshape(n, bins) / each


def cuts(hist: np.ndarray, config: ShotConfig = ShotConfig()) -> np.ndarray:
    """First frames of shots after the first: differences above the adaptive threshold, largest in their neighbourhood."""
    if len(hist) < 2:
        return np.zeros(0, int)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    r = config.reach
    padded = np.pad(d, r, constant_values=np.nan)
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1).copy()
    largest = d >= np.nanmax(around, axis=1)
    around[:, r] = np.nan
    known = ~np.isnan(around)
    n = np.maximum(known.sum(1), 1)
    mean = np.where(known, around, 0).sum(1) / n
    std = np.sqrt(np.where(known, (around - mean[:, None]) ** 2, 0).sum(1) / n)
    return np.flatnonzero(largest & (d > np.maximum(config.floor, mean + config.deviations * std))) + 1


# --- Spark --------------------------------------------------------------------------------------------------------


def padded_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _store(batch: pa.RecordBatch) -> pa.RecordBatch:
    size, media = [], []
    for text in batch.column("text"):
        n, payload = padded_payload(text.as_py())
        samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE)
        frames = [f for k in range(0, len(samples), BLOCK) for f in encode_frames(samples[k : k + BLOCK])]
        size.append(n)
        media.append(write_avi(frames))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text as an AVI file."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), _store, "doc_id long, n_bytes long, media binary", "text")


CLIP = "struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,mean_level:double>"


def _read(config: ShotConfig):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []

        def one(media: bytes) -> tuple:
            seconds, frames = read_avi(media)
            whole, tail, size, hist, mean = hashlib.sha256(), b"", 0, [], []
            for samples in decode_frames(frames):
                raw = samples.tobytes()
                whole.update(raw)
                size, tail = size + len(raw), (tail + raw)[-32:]
                hist.append(histograms(samples, config.bins))
                mean.append(samples.reshape(len(samples), -1).mean(1))
            hist = np.vstack(hist) if hist else np.zeros((0, config.bins))
            mean = np.concatenate(mean) if mean else np.zeros(0)
            edges = [0, *cuts(hist, config).tolist(), len(hist)] if len(hist) else []
            clips = [
                {"clip": k, "first_frame": a, "n_frames": b - a, "start_s": a * seconds, "end_s": b * seconds, "mean_level": float(mean[a:b].mean())}
                for k, (a, b) in enumerate(zip(edges, edges[1:]))
            ]
            feature = ";".join(f"{c['first_frame']}+{c['n_frames']}@{c['mean_level']:.3f}" for c in clips)
            return size, whole.hexdigest(), zlib.crc32(tail), feature, clips, None

        for media in batch.column("media"):
            try:
                rows.append(one(media.as_py()) if media.is_valid else (*[None] * 5, "no media"))
            except (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error) as damage:
                rows.append((*[None] * 5, str(damage) or type(damage).__name__))
        a, b, c, d, e, f = zip(*rows)
        kind = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_level", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array(d, pa.string()), pa.array(e, kind), pa.array(f, pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"],
        )

    return run


def read_media(media: DataFrame, config: ShotConfig = ShotConfig()) -> DataFrame:
    """The payload's digests as read back from the media column, its clips, and them as a feature string."""
    d = media.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(d, _read(config), f"{schema}, clips array<{CLIP}>, error string", "media")


def clips(media: DataFrame, config: ShotConfig = ShotConfig()) -> DataFrame:
    """One timed row per clip."""
    return read_media(media, config).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def query(spark, sf_dir: str) -> DataFrame:
    return read_media(store_media(table(spark, sf_dir, "documents"))).drop("clips", "error")


def clips_query(spark, sf_dir: str) -> DataFrame:
    """Timed clip rows of every document's media."""
    return clips(store_media(table(spark, sf_dir, "documents")))

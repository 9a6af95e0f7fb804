"""Media columns: AVI files with motion-JPEG frames, read into timed clips.

Reading parses the RIFF chunks and the ``idx1`` index, decodes the baseline JPEG frames (any Huffman tables,
one or more components; the restart intervals of all frames of many files side by side) and detects shots where the luma histogram
changes by more than recent changes let expect. Writing stores bytes losslessly: each block of 64 bytes is the
64 quantised DCT coefficients of one 8x8 block, 256 + byte, so every coefficient has the same category and code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from equityjobs.llm.tokens import sliced

SIDE = 4
BLOCKS = SIDE * SIDE
FRAME_US = 40_000
#: Bytes of files that are decoded side by side.
STEP = 2_000_000
#: What reading a file that is no readable AVI file raises.
BROKEN = (ValueError, KeyError, IndexError, struct.error)
#: Luma histogram bins, and how many earlier differences the threshold of a cut looks at.
BINS, MEMORY = 16, 8


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order: along the diagonals, turning at each end."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _cosines() -> np.ndarray:
    """(64, 64): natural-order coefficients to pixels of one block."""
    x, u = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, 8**-0.5, 0.5)
    return np.einsum("xu,yv->uvxy", basis, basis).reshape(64, 64).astype("f4")


PIXELS = _cosines()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int) -> bytes:
    """A Huffman table of one symbol with the one-bit code 0."""
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


def _frame_head() -> bytes:
    frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * SIDE, 8 * SIDE, 1, 1, 0x11, 0))
    return (
        b"\xff\xd8" + _segment(0xDB, bytes([0, *[1] * 64])) + frame + _table(0x00, 9) + _table(0x10, 9)
        + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


HEAD = _frame_head()
#: What ends each block of a frame: restart markers 0 to 7 in turn, and the end of the image.
ENDS = np.array([[0xFF, 0xD0 + i % 8] for i in range(BLOCKS - 1)] + [[0xFF, 0xD9]], "u1")


def _scan(payload: np.ndarray) -> np.ndarray:
    """80 bytes of entropy-coded data per 64 payload bytes: each sample is 0 (its code), 1 and its 8 bits."""
    s = payload.reshape(-1, 4).astype("u4")
    out = np.empty((len(s), 5), "u1")
    out[:, 0] = 0x40 | s[:, 0] >> 2
    out[:, 1] = (s[:, 0] & 3) << 6 | 0x10 | s[:, 1] >> 4
    out[:, 2] = (s[:, 1] & 15) << 4 | 0x04 | s[:, 2] >> 6
    out[:, 3] = (s[:, 2] & 63) << 2 | 0x01
    out[:, 4] = s[:, 3]
    return out.reshape(-1, 80)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def to_avi(payload: bytes) -> bytes:
    """An AVI file that holds ``payload`` (a multiple of 64 bytes) losslessly; its length is the comment chunk."""
    blocks = len(payload) // 64
    frames = -(-blocks // BLOCKS)
    scans = _scan(np.frombuffer(payload.ljust(frames * BLOCKS * 64, b"\0"), "u1")).reshape(frames, BLOCKS, 80)
    if (scans == 0xFF).any():  # not in UTF-8: a data byte 255 is followed by 0
        bodies = [HEAD + b"".join(b.tobytes().replace(b"\xff", b"\xff\0") + e.tobytes() for b, e in zip(f, ENDS)) for f in scans]
        chunks = [_chunk(b"00dc", b) for b in bodies]
        sizes = np.array([len(b) for b in bodies])
        movie = b"movi" + b"".join(chunks)
        steps = np.array([len(c) for c in chunks])
    else:
        size = len(HEAD) + BLOCKS * 82
        grid = np.zeros((frames, 8 + size + size % 2), "u1")
        grid[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), "u1")
        grid[:, 8 : 8 + len(HEAD)] = np.frombuffer(HEAD, "u1")
        body = grid[:, 8 + len(HEAD) : 8 + size].reshape(frames, BLOCKS, 82)
        body[:, :, :80], body[:, :, 80:] = scans, ENDS
        grid[:, 8 + len(HEAD) : 8 + size] = body.reshape(frames, -1)
        movie, sizes, steps = b"movi" + grid.tobytes(), np.full(frames, size), np.full(frames, grid.shape[1])
    index = np.zeros(frames, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(steps) - steps, sizes
    side, rate = 8 * SIDE, 1_000_000 // FRAME_US
    avih = struct.pack("<14I", FRAME_US, 0, 0, 0x10, frames, 0, 1, int(sizes.max()), side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, frames, int(sizes.max()), 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + stream)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", movie) + _chunk(b"idx1", index.tobytes()))


def _chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


@dataclass
class Jpeg:
    """One frame's tables and scan: component sampling and table numbers, quantisers, Huffman codes."""

    height: int
    width: int
    parts: list[tuple[int, int, int, int, int]]
    quantisers: dict[int, np.ndarray]
    codes: dict[int, tuple[bytes, bytes]]
    restart: int
    scan: int


def _head_of(raw: bytes, at: int, end: int) -> Jpeg:
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quantisers, codes, restart, frame = at + 2, {}, {}, 0, None
    while at + 4 <= end:
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype("f4")
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            frame = height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame header")
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            parts = [(h, v, q, tables[c] >> 4, tables[c] & 15) for c, h, v, q in frame[2]]
            return Jpeg(frame[0], frame[1], parts, quantisers, codes, restart, at)
    raise ValueError("no scan in the frame")


def _lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix: code length times 256 plus symbol; 0 where there is no code."""
    table, code, k = np.zeros(65536, "i8"), 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits * 256 + symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, jpeg: Jpeg) -> tuple[np.ndarray, np.ndarray]:
    """Scan-order coefficients of all blocks of all restart intervals (lanes), and each block's component.

    A lane is ``data[start:end]``, without escapes; ``counts`` has its coded units (MCUs). Each step decodes the next
    symbol of every lane.
    """
    pattern = np.repeat(np.arange(len(jpeg.parts)), [h * v if len(jpeg.parts) > 1 else 1 for h, v, *_ in jpeg.parts])
    tables = np.stack([_lookup(*jpeg.codes[kind | number]) for _, _, _, dc, ac in jpeg.parts for kind, number in ((0x00, dc), (0x10, ac))]).ravel()
    per_lane = counts * len(pattern)
    base = np.cumsum(per_lane) - per_lane
    out = np.zeros((int(per_lane.sum()), 64), "i4")
    # The 40 bits that start at each byte.
    wide = np.concatenate([data, np.zeros(8, "u1")]).astype("i8")
    wide = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]
    bit, limit = starts * 8, ends * 8
    done, k = np.zeros(len(starts), "i8"), np.zeros(len(starts), "i8")
    last = np.zeros((len(starts), len(jpeg.parts)), "i8")
    live = np.flatnonzero(per_lane > 0)
    while len(live):
        b = bit[live]
        window = wide[b >> 3]
        free = 40 - (b & 7)
        window &= (1 << free) - 1
        at = k[live]
        part = pattern[done[live] % len(pattern)]
        found = tables[((2 * part + (at > 0)) << 16) + (window >> (free - 16))]
        if not found.all():
            raise ValueError("a code that is in no table")
        length, symbol = found >> 8, found & 255
        extra = symbol & 15
        value = window >> (free - length - extra) & ((1 << extra) - 1)
        value = np.where((extra > 0) & (value < (1 << np.maximum(extra - 1, 0))), value - (1 << extra) + 1, value)
        b += length + extra
        if (b > limit[live]).any():
            raise ValueError("a scan ends too early")
        bit[live] = b
        row, dc = base[live] + done[live], at == 0
        if dc.any():
            last[live[dc], part[dc]] += value[dc]
            out[row[dc], 0] = last[live[dc], part[dc]]
        run = symbol >> 4
        spot = at + np.where(dc, 0, run)
        put = ~dc & (extra > 0) & (spot < 64)
        out[row[put], spot[put]] = value[put]
        stop = ~dc & (extra == 0) & (run != 15)
        k[live] = np.where(stop, 64, spot + 1)
        over = k[live] >= 64
        if over.any():
            ended = live[over]
            done[ended] += 1
            k[ended] = 0
            live = live[done[live] < per_lane[live]]
    owner = np.tile(pattern, int(counts.sum()))
    return out, owner


def _frames(scans: list[bytes], jpeg: Jpeg) -> list[np.ndarray]:
    """Luma coefficients of each frame, from the entropy-coded data of frames that share their headers."""
    data = np.frombuffer(b"".join(s if s.endswith(b"\xff\xd9") else s + b"\xff\xd9" for s in scans), "u1")
    sizes = np.array([len(s) if s.endswith(b"\xff\xd9") else len(s) + 2 for s in scans])
    escape = np.flatnonzero(data[:-1] == 0xFF)
    after = data[escape + 1]
    marks = escape[(after >= 0xD0) & (after <= 0xD9)]
    keep = np.ones(len(data), bool)
    keep[escape[after == 0] + 1] = False
    place = np.cumsum(keep) - keep  # of each byte among those kept
    starts, ends = place[np.append(0, marks[:-1] + 2)], place[marks]
    wide, tall = (max(p[i] for p in jpeg.parts) for i in (0, 1)) if len(jpeg.parts) > 1 else (1, 1)
    units = -(-jpeg.width // (8 * wide)) * -(-jpeg.height // (8 * tall))
    each = jpeg.restart or units
    lanes = -(-units // each)
    first = np.searchsorted(marks, np.cumsum(sizes) - sizes)
    if (np.diff(np.append(first, len(marks))) < lanes).any():
        raise ValueError("a scan ends too early")
    use = (first[:, None] + np.arange(lanes)).ravel()
    counts = np.tile(np.minimum(each, units - each * np.arange(lanes)), len(scans))
    blocks, owner = _blocks(data[keep], starts[use], ends[use], counts, jpeg)
    return np.split(blocks[owner == 0], len(scans))


@dataclass
class Video:
    """Coefficients of all luma blocks in scan order, frame by frame, and the luma pictures' geometry."""

    coefficients: np.ndarray
    frames: int
    quantiser: np.ndarray
    frame_us: int
    payload: int | None

    def luma(self) -> np.ndarray:
        """(frame, pixel) 8-bit luma; pixels stand block by block."""
        natural = np.empty((len(self.coefficients), 64), "f4")
        natural[:, ZIGZAG] = self.coefficients * self.quantiser
        pixels = natural @ PIXELS
        pixels += 128.5
        return np.clip(pixels, 0, 255, out=pixels).astype("u1").reshape(self.frames, -1)


@dataclass
class Container:
    """What the RIFF chunks say: frame time, payload length, and (start, size) of the video frames."""

    frame_us: int
    payload: int | None
    spots: list[tuple[int, int]]


def _container(raw: bytes) -> Container:
    """Parse the file by its index (by its chunks where it has none)."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frame_us, payload, movie, index = FRAME_US, None, None, None
    for name, at, end in _chunks(raw, 12, len(raw)):
        kind = raw[at : at + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            frame_us = next((struct.unpack_from("<I", raw, a)[0] for n, a, _ in _chunks(raw, at + 4, end) if n == b"avih"), FRAME_US)
        elif kind == b"INFO":
            notes = [raw[a:e] for n, a, e in _chunks(raw, at + 4, end) if n == b"ICMT" and raw[a:e].startswith(b"payload=")]
            payload = int(notes[0][8:].rstrip(b"\0")) if notes else None
        elif kind == b"movi":
            movie = at, end
        elif name == b"idx1":
            index = np.frombuffer(raw, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], (end - at) // 16, at)
    if movie is None:
        raise ValueError("no movie in the file")
    if index is not None and len(index):
        video = index[np.isin(index["id"], (b"00dc", b"00db"))]
        start = movie[0] if len(video) and raw[movie[0] + video["at"][0] : movie[0] + video["at"][0] + 4] == video["id"][0] else 0
        spots = [(start + a + 8, s) for a, s in zip(video["at"].tolist(), video["size"].tolist())]
    else:
        spots = [(a, e - a) for n, a, e in _chunks(raw, movie[0] + 4, movie[1]) if n in (b"00dc", b"00db")]
    return Container(frame_us, payload, [s for s in spots if s[1]])


def read_avis(raws: list[bytes]) -> list[Video]:
    """Parse the files and decode all frames of their video streams, those with equal headers side by side."""
    files = [_container(raw) for raw in raws]
    heads: dict[bytes, Jpeg] = {}
    groups: dict[tuple[bytes, bytes], list[tuple[int, int, bytes]]] = {}
    quantisers, head = [np.ones(64, "f4") for _ in files], b""
    for n, (raw, file) in enumerate(zip(raws, files)):
        first = b""
        for frame, (at, size) in enumerate(file.spots):
            if not head or not raw.startswith(head, at):
                scan = _head_of(raw, at, at + size).scan
                head = raw[at:scan]
                heads.setdefault(head, _head_of(raw, at, at + size))
            first = first or head
            groups.setdefault((head, first if not heads[head].codes else head), []).append((n, frame, raw[at + len(head) : at + size]))
        if first:
            quantisers[n] = heads[first].quantisers[heads[first].parts[0][2]]
    luma: list[dict[int, np.ndarray]] = [{} for _ in files]
    for (head, coded), frames in groups.items():
        jpeg = replace(heads[head], codes=heads[coded].codes)
        while frames:
            many = max(1, int(np.searchsorted(np.cumsum([len(s) for _, _, s in frames]), STEP)))
            part, frames = frames[:many], frames[many:]
            for (n, frame, _), found in zip(part, _frames([s for _, _, s in part], jpeg)):
                luma[n][frame] = found
    empty = np.zeros((0, 64), "i4")
    return [Video(np.concatenate([found[k] for k in sorted(found)] or [empty]), len(f.spots), q, f.frame_us, f.payload) for f, q, found in zip(files, quantisers, luma)]


def read_avi(raw: bytes) -> Video:
    return read_avis([raw])[0]


def _together(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges [first, end) of files of about ``STEP`` bytes."""
    first, size = 0, 0
    for n, raw in enumerate(raws):
        size += len(raw)
        if size >= STEP or n == len(raws) - 1:
            yield first, n + 1
            first, size = n + 1, 0


def payload_of(video: Video) -> bytes:
    """The bytes that ``to_avi`` stored."""
    return (video.coefficients - 256).astype("u1").tobytes()[: video.payload]


def shots(luma: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the histogram differences between neighbours (0 to 2).

    A frame starts a shot where its difference is over 0.2 and over the mean and three standard deviations of
    up to ``MEMORY`` differences before it within the shot (over 0.4 while there are fewer than two).
    """
    n, pixels = luma.shape
    if not n:
        return [], np.zeros(0)
    keys = (luma >> 4).astype("i4") + BINS * np.arange(n)[:, None]
    hist = np.bincount(keys.ravel(), minlength=n * BINS).reshape(n, BINS) / pixels
    moved = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    starts = [0]
    for i, d in enumerate(moved):
        past = moved[max(starts[-1], i - MEMORY) : i]
        if d > (max(0.2, past.mean() + 3 * past.std()) if len(past) > 1 else 0.4):
            starts.append(i + 1)
    return starts, moved


def clips_of(video: Video) -> list[tuple[int, int, int, int, float]]:
    """(clip, start_ms, end_ms, frames, mean luma) of each shot."""
    luma = video.luma()
    starts, _ = shots(luma)
    means = luma.mean(axis=1) if len(luma) else []
    ends = [*starts[1:], video.frames]
    return [(i, a * video.frame_us // 1000, b * video.frame_us // 1000, b - a, round(float(means[a:b].mean()), 4)) for i, (a, b) in enumerate(zip(starts, ends))]


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, zero-padded to a positive multiple of 64, as an AVI file.

    A null text is empty: 64 zero bytes. Repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                files = [to_avi(r.ljust(max(64, -(-len(r) // 64) * 64), b"\0")) for r in raws]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raws]), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _or_error(raw: bytes) -> Video | str:
    try:
        return read_avi(raw)
    except BROKEN as e:
        return str(e)


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, clip, start_ms, end_ms, frames, mean_luma, error: the timed clips of each file.

    A file that is null gives no row; one that is not a readable AVI file gives one row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            rows: list[tuple] = []
            files = [(key, raw) for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if raw is not None]
            for first, last in _together([raw for _, raw in files]):
                part = files[first:last]
                try:
                    videos = read_avis([raw for _, raw in part])
                except BROKEN:  # find the file that is at fault
                    videos = [_or_error(raw) for _, raw in part]
                for (key, _), video in zip(part, videos):
                    rows += [(key, *c, None) for c in clips_of(video)] if isinstance(video, Video) else [(key, None, None, None, None, None, video)]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string())
            names = ("doc_id", "clip", "start_ms", "end_ms", "frames", "mean_luma", "error")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(run, f"doc_id {kind}, clip int, start_ms long, end_ms long, frames int, mean_luma double, error string")


def media_digest(media: DataFrame) -> DataFrame:
    """Checksums of what is read back from each file, and its clips as a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                files = part.column(2).to_pylist()
                videos = (v for a, b in _together(files) for v in read_avis(files[a:b]))
                for raw, video in zip(files, videos):
                    payload = payload_of(video)
                    clips = clips_of(video)
                    feature = f"frames={video.frames};clips=" + ",".join(f"{a}-{b}:{m:.2f}" for _, a, b, _, m in clips)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
                columns = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(columns[c]) for c in columns)], ["doc_id", "n_bytes", *columns])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )

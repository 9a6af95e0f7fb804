"""Token ids in binary files: Simple-8b words with escapes and block offsets.

A 64-bit word is a 4-bit selector and up to 60 one-bit, 30 two-bit, ... ids. Ids are coded in blocks
of ``BLOCK``; every block starts a word, and the block offsets let a reader decode any range of blocks at
once with array operations. An id that needs more than 60 bits is an escape: selector 0 and the number
of its entry in the list of wide values.

A file row is one self-contained segment (``Segment``): whole documents, in ascending id order. Spark's
own Parquet writer holds the segments, so any store that Spark writes to will do, and its commit protocol
covers lost executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equityjobs.llm.shared import lean, text_batches
from equityjobs.llm.tokens import Encoder, gathered, with_end

# Fixed values of Simple-8b: ids per word and bits per id by selector from 1 on; selector 0 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 256
_COUNT_OF = np.array((1, *COUNTS))
_BITS_OF = np.array((60, *BITS), "uint64")
#: Bits that a value needs to the first class (index into BITS) that holds it; 14: an escape.
_CLASS = np.searchsorted(BITS, np.arange(65)).astype("uint8")
_HEADER = struct.Struct("<4sIQQQQ")
_MAGIC = b"S8B1"


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    high = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype("float64"))[1]
    return np.where(high > 0, np.frexp(high.astype("float64"))[1] + 32, low)


def _window_max(classes: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """For each count of COUNTS: the largest class in the next so many values, by doubling."""
    powers, n = {1: classes}, 1
    while 2 * n <= most:
        powers[2 * n] = np.maximum(powers[n][:, :-n], powers[n][:, n:])
        n *= 2
    out = {}
    for count in COUNTS:
        p = 1 << (count.bit_length() - 1)
        rest = count - p
        out[count] = np.maximum(powers[p][:, : powers[p].shape[1] - rest], powers[p][:, rest:]) if rest else powers[p]
    return out


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 values to (words, first word of each block, wide values)."""
    total, blocks = len(values), -(-len(values) // BLOCK)
    if not total:
        return np.zeros(0, "uint64"), np.zeros(0, "uint64"), np.zeros(0, "uint64")
    span = BLOCK + max(COUNTS)
    grid = np.zeros((blocks, span), "uint64")
    padded = np.zeros(blocks * BLOCK, "uint64")
    padded[:total] = values
    grid[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    small = total and values.max() < 65536
    classes = (_CLASS[_bit_lengths(np.arange(65536, dtype="uint64"))] if small else _CLASS)[grid if small else _bit_lengths(grid)]
    largest = _window_max(classes, max(COUNTS))
    selector = np.zeros((blocks, BLOCK), "uint8")
    for k in range(len(COUNTS) - 1, -1, -1):  # from one id a word to sixty: the last that fits holds most
        np.putmask(selector, largest[COUNTS[k]][:, :BLOCK] <= k, np.uint8(k + 1))
    # Greedy parse of all blocks in step.
    ends = np.minimum(total - np.arange(blocks) * BLOCK, BLOCK)
    lane, at, picked = np.arange(blocks), np.zeros(blocks, "int64"), []
    while len(lane):
        s = selector[lane, at]
        picked.append((lane, at, s))
        at = at + _COUNT_OF[s]
        keep = at < ends[lane]
        lane, at = lane[keep], at[keep]
    per_block = np.bincount(np.concatenate([p[0] for p in picked]), minlength=blocks)
    offsets = np.cumsum(per_block) - per_block
    words, wide = np.zeros(int(per_block.sum()), "uint64"), []
    where = np.concatenate([offsets[p[0]] + step for step, p in enumerate(picked)])
    lane, at, s = (np.concatenate([p[i] for p in picked]) for i in range(3))
    flat = grid.reshape(-1)
    start = lane * span + at
    for k, (count, bits) in enumerate(zip(COUNTS, BITS), 1):
        mine = s == k
        if mine.any():
            word = np.full(int(mine.sum()), k << 60, "uint64")
            first = start[mine]
            for i in range(count):
                word |= flat[first + i] << np.uint64(i * bits)
            words[where[mine]] = word
    if (mine := s == 0).any():
        order = np.argsort(where[mine])
        wide = flat[start[mine]][order]
        words[where[mine][order]] = np.arange(len(wide), dtype="uint64")
    return words, offsets.astype("uint64"), np.array(wide, "uint64")


def decode_words(words: np.ndarray, offsets: np.ndarray, wide: np.ndarray, total: int) -> np.ndarray:
    """The inverse of ``encode_words``: every word of every block at once."""
    if not total:
        return np.zeros(0, "uint64")
    selectors = (words >> np.uint64(60)).astype("int64")
    counts = _COUNT_OF[selectors]
    first = np.cumsum(counts) - counts
    # The last word of a block may hold fewer ids than its selector says.
    starts = first[offsets.astype("int64")]
    lengths = np.minimum(total - np.arange(len(offsets)) * BLOCK, BLOCK)
    out = np.empty(int(counts.sum()), "uint64")
    for k, (count, bits) in enumerate(zip(COUNTS, BITS), 1):
        mine = selectors == k
        if mine.any():
            word, at, mask = words[mine], first[mine], np.uint64((1 << bits) - 1)
            for i in range(count):
                out[at + i] = (word >> np.uint64(i * bits)) & mask
    if (mine := selectors == 0).any():
        out[first[mine]] = wide[(words[mine] & np.uint64((1 << 60) - 1)).astype("int64")]
    return out[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)]


@dataclass
class Segment:
    """Documents of one file row: ids (null allowed) as text-free keys, id counts, and their coded ids."""

    doc_ids: np.ndarray
    has_id: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray

    def to_bytes(self) -> bytes:
        words, offsets, wide = encode_words(self.ids)
        head = _HEADER.pack(_MAGIC, BLOCK, len(self.doc_ids), len(self.ids), len(words), len(wide))
        parts = (self.doc_ids.astype("<i8"), self.has_id.astype("u1"), self.lengths.astype("<u8"), offsets.astype("<u8"), words.astype("<u8"), wide.astype("<u8"))
        return head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Segment:
        magic, block, docs, total, n_words, n_wide = _HEADER.unpack_from(raw)
        if magic != _MAGIC or block != BLOCK:
            raise ValueError("not a segment of this format")
        at, parts = _HEADER.size, []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", -(-total // BLOCK)), ("<u8", n_words), ("<u8", n_wide)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        doc_ids, has_id, lengths, offsets, words, wide = parts
        return cls(doc_ids, has_id, lengths.astype("int64"), decode_words(words, offsets, wide, total))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_ids: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write segments in ascending document order to ``path``.

    A null text is empty (the end id alone); null ids come first; repeated ids stay next to each other in
    text order; an empty table writes no segment. Ids are whole numbers (others are an error); other columns are ignored.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, start = TaskContext.get().partitionId(), Encoder(tokenizer), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal start
            segment = Segment(*(np.concatenate(x) for x in zip(*held)))
            row = [pa.array([x], kind) for x, kind in ((part, pa.int32()), (start, pa.int64()), (len(segment.ids), pa.int64()), (segment.to_bytes(), pa.binary()))]
            start += len(segment.ids)
            held.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "part_start", "n_ids", "payload"])

        for batch in gathered(batches):
            keys = batch.column(0).cast(pa.int64())
            doc_ids, has_id = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False)
            for first, last, ids, lengths in encoder.encode(batch.column(1)):
                ids, lengths = with_end(ids, lengths, end_id)
                held.append((doc_ids[first:last], has_id[first:last], lengths, ids.astype("uint64")))
                if sum(len(h[3]) for h in held) >= segment_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    text_batches(docs.sparkSession)
    ordered.mapInArrow(lean(run), "part int, part_start long, n_ids long, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(i) for i in range(3))):
                segment = Segment.from_bytes(payload.as_buffer())
                n, ends = len(segment.doc_ids), np.cumsum(segment.lengths)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype("int64")), pa.py_buffer(segment.ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part.as_py(), "int32")), pa.array(segment.doc_ids, mask=segment.has_id == 0),
                        pa.array(start.as_py() + ends - segment.lengths), pa.array(segment.lengths), raw.cast(pa.binary()),
                    ],
                    ["part", "doc_id", "part_start", "n_tokens", "ids"],
                )

    segments = spark.read.schema("part int, part_start long, n_ids long, payload binary").parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_ids"))  # one row for each task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_start"))
    rows = segments.select("part", "part_start", "payload").mapInArrow(run, "part int, doc_id long, part_start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("_start") + F.col("part_start")).alias("start"), "n_tokens", "ids")

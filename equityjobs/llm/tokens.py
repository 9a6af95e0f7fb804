"""Token ids of whole texts with a public tokenizer file: texts stay Arrow buffers, only distinct pieces are encoded."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from equityjobs.llm.shared import lean, text_batches

#: Bytes of text in one step, and new pieces that are encoded in one line.
_STEP, _LINE = 4_000_000, 400
#: Lines of one call: the library's own objects take about a hundred bytes a token.
_LINES = 64

# Kinds of bytes. A byte of another kind may belong to any character, so no cut stands beside it.
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _WHITE, _LEAD = range(8)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, "u1")
    kinds[0x21:0x7F] = _MARK
    kinds[0x30:0x3A] = _DIGIT
    kinds[0x41:0x5B] = kinds[0x61:0x7B] = _LETTER
    kinds[0x27], kinds[0x20], kinds[0x09:0x0E] = _QUOTE, _BLANK, _WHITE
    kinds[0xC3:0xCA] = kinds[0xD0:0xD2] = _LEAD  # first of two bytes of a letter, but for two signs after 0xC3
    return kinds


def _cuts() -> np.ndarray:
    """For two kinds side by side (first * 8 + second): 1 for a cut between them, 2 for one before the first, 3 for both."""
    solid = (_LETTER, _DIGIT, _MARK, _QUOTE)
    cuts = np.zeros(64, "u1")
    for a in solid[:3]:
        for b in solid:
            cuts[a * 8 + b] = a != b and (a, b) != (_MARK, _QUOTE)
    for b in solid:
        # The last blank before a word goes with the word; other white space there is a piece of its own.
        cuts[_BLANK * 8 + b], cuts[_WHITE * 8 + b] = 2, 3
    return cuts


_KINDS, _CUTS = _kinds(), _cuts()
def _kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte, letters of two bytes found."""
    kinds = _KINDS[data]
    lead = np.flatnonzero(kinds == _LEAD)
    if len(lead):
        second = data[np.minimum(lead + 1, len(data) - 1)]
        letter = lead[(second >= 0x80) & ~((data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7)))]
        kinds[lead] = _OTHER
        kinds[letter] = kinds[letter + 1] = _LETTER
    return kinds


def _positions(data: np.ndarray, rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces start in ``data``, whose texts start at ``rows``; texts marked ``whole`` are one piece."""
    kinds = _kinds_of(data)
    cuts = _CUTS[(kinds[:-1] << 3) | kinds[1:]]
    inner = rows[(rows > 0) & (rows < len(data))]
    cuts[inner - 1] = 0  # what follows in another text does not count
    for i in np.flatnonzero(whole):
        cuts[rows[i] : (rows[i + 1] if i + 1 < len(rows) else len(data)) - 1] = 0
    starts = np.zeros(len(data), bool)
    starts[1:] = cuts & 1
    starts[:-1] |= cuts > 1
    starts[rows[rows < len(data)]] = True
    return np.flatnonzero(starts)


def _buffers(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a large_binary array without nulls."""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, "int64", len(pieces) + 1, 8 * pieces.offset)
    return offsets - offsets[0], np.frombuffer(data, "u1")[offsets[0] : offsets[-1]]


def _sorts_of(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces are plain (one pre-token of ASCII, after a leading blank) and which stay apart in lines.

    The latter start, after a leading blank, and end with what is surely not white space.
    """
    offsets, data = _buffers(pieces)
    first, last = offsets[:-1], offsets[1:] - 1
    kinds = _kinds_of(data)
    after = np.minimum(first + 1, last)
    begin = np.where(kinds[first] == _BLANK, kinds[after], kinds[first])
    sure = np.isin(kinds, (_LETTER, _DIGIT, _MARK, _QUOTE))
    apart = sure[last] & np.isin(begin, (_LETTER, _DIGIT, _MARK, _QUOTE))
    kinds[kinds == _QUOTE] = _MARK
    kinds[first[kinds[first] == _BLANK]] = 0
    same = np.where(begin == _QUOTE, _MARK, begin)
    high = np.maximum.reduceat(kinds, first)
    kinds[kinds == 0] = 255
    kinds[data >= 0x80] = 0
    blank = data[first] == 0x20
    kinds[first[blank]] = 255
    low = np.minimum.reduceat(kinds, first)
    return apart & (high == same) & (low == same), apart


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` for many texts.

    Strings of added tokens in a text become those tokens, as the library does it; with ``plain`` they are ordinary text. With
    a byte-level pre-tokenizer, texts are cut where it always cuts, and each distinct piece is encoded once;
    with any other tokenizer, whole texts are the pieces.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.inner = Tokenizer(self.tokenizer.model)  # the same vocabulary in memory
        self.tokenizer.encode_special_tokens = plain
        cutter = self.tokenizer.pre_tokenizer
        self.cuttable = self.tokenizer.normalizer is None and isinstance(cutter, pre_tokenizers.ByteLevel) and not cutter.add_prefix_space and cutter.use_regex
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        # Takes pieces that are pre-tokens already, parted by blanks; there are no repeats, so no cache.
        self.inner.encode_special_tokens = True
        self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if hasattr(self.inner.model, "_resize_cache"):
            self.inner.model._resize_cache(0)
        # In a byte-level vocabulary each character of a token stands for one byte.
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])

    @staticmethod
    def _many(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in one array, and the number of ids of each."""
        found: list[np.ndarray] = []
        for first in range(0, len(texts), _LINES):
            found += [np.array(e.ids, "uint32") for e in tokenizer.encode_batch_fast(texts[first : first + _LINES], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "uint32"), *found]), np.fromiter(map(len, found), "int64", len(found))

    def _one_by_one(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._many(self.tokenizer, [p.decode("utf-8", "surrogatepass") for p in pieces.to_pylist()])

    def _in_lines(self, pieces: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that stay apart from their neighbours in lines, where line feeds stand between them.

        The ids part where their bytes add up to the pieces' bytes. Plain pieces go to the tokenizer that only
        splits at white space (and leaves no id for it), with their leading blanks as the vocabulary has them.
        """
        n = len(pieces)
        offsets, data = _buffers(pieces)
        ends = offsets[1:] + np.arange(n)  # of each piece in the joined bytes, with one line feed after each
        joined = np.full(len(data) + n, 0x0A, "u1")
        inside = np.ones(len(joined), bool)
        inside[ends] = False
        joined[inside] = data
        raw = joined.tobytes()
        heads, tails = np.append(0, ends[_LINE - 1 : -1 : _LINE] + 1), np.append(ends[_LINE - 1 : -1 : _LINE], ends[-1])
        lines = [raw[a:b] for a, b in zip(heads, tails)]
        if plain:
            ids, _ = self._many(self.inner, [line.replace(b" ", "Ġ".encode()).decode() for line in lines])
            piece_ends = offsets[1:].astype("int64")
        else:
            ids, _ = self._many(self.tokenizer, [line.decode("utf-8", "surrogatepass") for line in lines])
            piece_ends = ends - np.arange(n) // _LINE  # no line feed is left between two lines
        reached = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(reached, piece_ends)
        if not len(ids) or last[-1] != len(ids) - 1 or (reached[last] != piece_ends).any():
            return self._one_by_one(pieces)
        first = np.append(0, last[:-1] + 1)
        if plain:
            return ids, last + 1 - first
        gap = np.append(False, np.arange(1, n) % _LINE != 0)  # a line feed's id comes before the piece
        keep = np.ones(len(ids), bool)
        keep[first[gap]] = False
        return ids[keep], last + 1 - first - gap

    def _encoded(self, pieces: pa.Array, marked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each piece's ids, their number) of distinct pieces, none of them empty."""
        n = len(pieces)
        plain, apart = _sorts_of(pieces) if self.cuttable else (np.zeros(n, bool), np.zeros(n, bool))
        if marked:
            free = ~np.fromiter((any(m in p for m in self.marks) for p in pieces.to_pylist()), bool, n)
            plain, apart = plain & free, apart & free
        parts, starts, lengths, at = [np.zeros(0, "uint32")], np.zeros(n, "int64"), np.zeros(n, "int64"), 0
        in_lines = (lambda x: self._in_lines(x, True)), (lambda x: self._in_lines(x, False))
        for mine, ids_of in ((plain, in_lines[0]), (apart & ~plain, in_lines[1]), (~plain & ~apart, self._one_by_one)):
            where = np.flatnonzero(mine)
            if len(where):
                ids, size = ids_of(pieces.take(pa.array(where)))
                starts[where], lengths[where] = at + np.cumsum(size) - size, size
                parts.append(ids)
                at += len(ids)
        return np.concatenate(parts), starts, lengths

    def _step(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that start at ``rows`` in ``data`` (the last entry is its end), and their number by text."""
        if not len(data):
            return np.zeros(0, "uint32"), np.zeros(len(rows) - 1, "int64")
        whole, marked = np.full(len(rows) - 1, not self.cuttable), False
        if self.cuttable:
            for mark in self.marks:
                if re.search(re.escape(mark), data):
                    marked = True
                    whole |= np.fromiter((re.search(re.escape(mark), data[a:b]) is not None for a, b in zip(rows, rows[1:])), bool, len(rows) - 1)
        pieces = _positions(data, rows[:-1], whole)
        offsets = np.append(pieces, len(data)).astype("int64")
        words = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        pool, starts, lengths = self._encoded(words.dictionary, marked)
        at = words.indices.to_numpy()
        del words, offsets
        # A step has fewer than 2**31 ids, since each stands for a byte at least.
        lengths = lengths.astype("int32")[at]
        ends = np.cumsum(lengths, dtype="int32")
        where = np.repeat(starts.astype("int32")[at] - ends + lengths, lengths)
        where += np.arange(ends[-1], dtype="int32")
        return pool[where], np.diff(np.append(0, ends)[np.searchsorted(pieces, rows)]).astype("int64")

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For consecutive texts [first, end) of a string array: their ids in one array, and the number of ids of each.

        Null is the empty text. A step holds at most ``_STEP`` bytes, or one longer text.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not n:
            return
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, "int64", n + 1, texts.offset * 8)
        data = np.frombuffer(data, "u1") if data else np.zeros(0, "u1")
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + _STEP, side="right")) - 1)
            last = min(last, n)
            yield first, last, *self._step(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
            first = last


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, and the new lengths."""
    out = np.full(len(ids) + len(lengths), end_id, "uint32")
    taken = np.ones(len(out), bool)
    taken[np.cumsum(lengths + 1) - 1] = False
    out[taken] = ids
    return out, lengths + 1


def gathered(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about a step's bytes: many texts share their pieces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= (size or _STEP):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that fewer texts are Python strings at once."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """Whole texts; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every document, ``end_id`` last.

    uid tells repeated rows apart. A null or empty text is the end id alone. The string of a special token in a
    text becomes that token.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = Encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in gathered(batches):
            for first, last, ids, lengths in encoder.encode(batch.column(1)):
                ids, lengths = with_end(ids, lengths, end_id)
                ends = np.concatenate([[0], np.cumsum(lengths) * 4])
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(ends.astype("int64")), pa.py_buffer(ids)])
                for a in range(first, last, 512):
                    n = min(512, last - a)
                    part = raw.slice(a - first, n).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), batch.column(0).slice(a, n), pa.array(lengths[a - first : a - first + n]), part], ["uid", "doc_id", "n_tokens", "ids"])
                    uid += n

    kind = docs.schema[id_col].dataType.simpleString()
    text_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"uid long, doc_id {kind}, n_tokens long, ids binary")

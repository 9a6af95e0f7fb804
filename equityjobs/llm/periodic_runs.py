"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

A run is a stretch of consecutive words whose smallest period q is at most a third of its length, of at least
``least`` words, that no neighbouring word extends. The texts of a batch share one grammar. Pairs of neighbouring
symbols that occur twice or more become nonterminals, more frequent pairs first where two overlap; what then remains
of each text is folded pairwise into nonterminals of one occurrence, so that each text is one binary derivation.
A run lies whole in the lowest node that holds it and crosses the boundary of that node's two children. So it is
enough to look, once for each nonterminal, for runs across its boundary; they are translated to all places where
the nonterminal stands, and intervals of one period that belong together are merged into maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from equityjobs.llm.shared import lean, text_batches

#: Shortest run in words, and the least number of periods in it.
LEAST, PERIODS = 24, 3
#: A round of replacements that shortens the symbols by less than this share ends the grammar.
_GAIN = 0.001
#: Pairs of a nonterminal and a period that are looked at in one step.
_STEP = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Nodes:
    """Nonterminals: where one occurrence starts, length of the left child and of all; and all occurrences."""

    start: np.ndarray
    left: np.ndarray
    length: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values.astype("u8") * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _codes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key by first occurrence, and how often each number occurs."""
    codes = pa.array(keys).dictionary_encode().indices.to_numpy()
    return codes, np.bincount(codes)


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Positions of pairs to replace: those that outrank both neighbours, every second one of equal neighbours."""
    starts = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1])
    value = rank[starts]
    beats = value > 0
    beats[1:] &= value[1:] > value[:-1]
    beats[:-1] &= value[:-1] > value[1:]
    first, size = starts[beats], np.diff(np.append(starts, len(rank)))[beats]
    taken = (size + 1) // 2
    if len(taken) and taken.max() > 1:
        inner = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
        return np.repeat(first, taken) + 2 * inner
    return first


def grammar(words: np.ndarray, ends: np.ndarray) -> Nodes:
    """All nonterminals over ``words`` (ids of many texts; ``ends`` marks each text's last word)."""
    symbols, last = words.astype("i8"), ends.copy()
    start, length = np.arange(len(words)), np.ones(len(words), "i8")
    live = np.ones(len(words), bool)  # the pair that begins here may occur twice
    fresh = int(symbols.max()) + 1 if len(symbols) else 0
    found: list[tuple[np.ndarray, ...]] = []
    count = 0

    def replaced(at: np.ndarray, rule: np.ndarray, rules: int) -> None:
        """Record ``rules`` new nonterminals at the positions ``at`` and shorten the arrays."""
        nonlocal symbols, last, start, length, live, fresh, count
        example = np.empty(rules, "i8")
        example[rule[::-1]] = at[::-1]
        total = length[at] + length[at + 1]
        found.append((start[example], length[example], length[example] + length[example + 1], rule + count, start[at]))
        symbols[at], length[at], last[at] = fresh + rule, total, last[at + 1]
        live[at] = True
        live[at[at > 0] - 1] = True
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last, start, length, live = symbols[keep], last[keep], start[keep], length[keep], live[keep]
        fresh, count = fresh + rules, count + rules

    while len(symbols) > 1:
        open_pairs = np.flatnonzero(live[:-1] & ~last[:-1])
        keys = symbols[open_pairs] << 32 | symbols[open_pairs + 1]
        codes, counts = _codes(keys)
        often = counts[codes]
        live[:] = False
        live[open_pairs[often > 1]] = True
        rank = np.zeros(len(symbols), "u8")
        rank[open_pairs] = np.where(often > 1, often.astype("u8") << np.uint64(32) | _mixed(keys) >> np.uint64(32), 0)
        at = _chosen(rank)
        rule, uses = _codes(symbols[at] << 32 | symbols[at + 1])
        at, rule = at[uses[rule] > 1], rule[uses[rule] > 1]
        before = len(symbols)
        if len(at):
            rule, uses = _codes(rule)
            replaced(at, rule, len(uses))
        if before - len(symbols) <= _GAIN * before:
            break
    while len(symbols) and not last.all():
        first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        order = np.arange(len(symbols)) - np.repeat(first, np.diff(np.append(first, len(symbols))))
        at = np.flatnonzero((order % 2 == 0) & ~last)
        replaced(at, np.arange(len(at)), len(at))
    if not found:
        return Nodes(*(np.zeros(0, "i8") for _ in range(5)))
    return Nodes(*(np.concatenate(part) for part in zip(*found)))


class _Sums:
    """Sums of the words' values times powers of an odd number, for comparing stretches a period apart."""

    def __init__(self, words: np.ndarray) -> None:
        self.powers = np.full(len(words) + 1, 0xD1342543DE82EF95, "u8")
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.sums = np.zeros(len(words) + 1, "u8")
        np.cumsum(_mixed(words + 1) * self.powers[:-1], out=self.sums[1:])

    def same(self, at: np.ndarray, size: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether words at, at + 1, ... (``size`` of them) equal those a period later."""
        here = self.sums[at + size] - self.sums[at]
        return here * self.powers[period] == self.sums[at + period + size] - self.sums[at + period]

    def reach(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those a period later, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.same(at - middle if back else at, middle, period)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _across(words: np.ndarray, sums: _Sums, nodes: Nodes, least: int) -> tuple[np.ndarray, ...]:
    """(node, start within it, length, period) of the stretches across each node's boundary, cut to the node.

    For a period q, positions whose word equals the one q later form a stretch of at least max(2 q, least - q) positions.
    If it reaches q or more before the boundary b, it holds b - q, and half of it stands on one side of that;
    otherwise it holds b and goes on from there.
    """
    wide = np.flatnonzero(nodes.length >= max(least, PERIODS))
    parts: list[tuple[np.ndarray, ...]] = []
    sizes = nodes.length[wide] // PERIODS
    bounds = np.cumsum(sizes)
    first = 0
    while first < len(wide):
        done = bounds[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(bounds, done + _STEP, "right")))
        ids, n = wide[first:after], sizes[first:after]
        node = np.repeat(ids, n)
        q = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n) + 1
        x, b = nodes.start[node], nodes.start[node] + nodes.left[node]
        end = x + nodes.length[node] - q  # positions before it have a partner in the node
        for at in (b - q, b):
            hit = np.flatnonzero((at >= x) & (at < end))
            hit = hit[words[at[hit]] == words[at[hit] + q[hit]]]
            h_at, h_q, h_x, h_end = at[hit], q[hit], x[hit], end[hit]
            half = (np.maximum((PERIODS - 1) * h_q, least - h_q) + 1) // 2
            held = np.zeros(len(hit), bool)
            for begin in (h_at, h_at - half + 1):
                inside = (begin >= h_x) & (begin + half <= h_end) & ~held
                held[inside] |= sums.same(begin[inside], half[inside], h_q[inside])
            h_at, h_q, h_x, h_end, h_node = h_at[held], h_q[held], h_x[held], h_end[held], node[hit[held]]
            forward = sums.reach(h_at, h_q, h_end - h_at)
            behind = sums.reach(h_at, h_q, h_at - h_x, back=True)
            size = forward + behind + h_q
            long = size >= np.maximum(least, PERIODS * h_q)
            parts.append((h_node[long], (h_at - behind - h_x)[long], size[long], h_q[long]))
        first = after
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else tuple(np.zeros(0, "i8") for _ in range(4))


def plain_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of one text's runs, by comparing it with itself at every period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // PERIODS + 1):
        same = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(least, PERIODS * q):
                found.setdefault((s, e - s + q), q)
    return np.array([(s, n, q) for (s, n), q in sorted(found.items(), key=lambda r: (r[0][0], r[1]))], "i8").reshape(-1, 3)


def runs_of(words: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), sorted so, of the runs of texts ``words[offsets[i]:offsets[i + 1]]``."""
    ends = np.zeros(len(words), bool)
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    nodes, sums = grammar(words, ends), _Sums(words)
    node, begin, size, q = _across(words, sums, nodes, least)
    if not len(node):
        return np.zeros((0, 4), "i8")
    # All places of the nodes that hold a stretch.
    order = np.argsort(nodes.owner, kind="stable")
    owners, places = nodes.owner[order], nodes.place[order]
    low, high = np.searchsorted(owners, node, "left"), np.searchsorted(owners, node, "right")
    times = high - low
    which = np.repeat(np.arange(len(node)), times)
    place = places[np.repeat(low, times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
    s, q = place + begin[which], q[which]
    e = s + size[which]
    text = np.searchsorted(offsets, s, "right") - 1
    # Of one period, a stretch that starts a period or more before the end so far belongs to the same run.
    order = np.lexsort((-e, s, q, text))
    text, q, s, e = text[order], q[order], s[order], e[order]
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (q[1:] != q[:-1])])
    group = np.cumsum(fresh)
    reach = np.maximum.accumulate(e + group * (len(words) + 1)) - group * (len(words) + 1)
    fresh[1:] |= s[1:] > reach[:-1] - q[1:]
    heads = np.flatnonzero(fresh)
    text, s, q, e = text[heads], s[heads], q[heads], np.maximum.reduceat(e, heads)
    # The same words with a smaller period: a multiple is not the smallest one.
    order = np.lexsort((q, e, s))
    text, s, q, e = text[order], s[order], q[order], e[order]
    smallest = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])
    rows = np.stack([text, s - offsets[text], e - s, q], axis=1)[smallest]
    # Sums can agree by chance: a text with a run that is none is searched plainly.
    wrong = {t for t, i, n, p in rows.tolist() if not np.array_equal(words[offsets[t] + i : offsets[t] + i + n - p], words[offsets[t] + i + p : offsets[t] + i + n])}
    if wrong:
        again = [(t, *r) for t in wrong for r in plain_runs(words[offsets[t] : offsets[t + 1]], least).tolist()]
        rows = np.concatenate([rows[~np.isin(rows[:, 0], list(wrong))], np.array(again, "i8").reshape(-1, 4)])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word ids of all texts, offsets of each text in them, and the words by id; a null text has no word."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = parts.flatten().dictionary_encode()
    ids, edges = coded.indices.to_numpy(), parts.offsets.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()
    kept = ids != empty
    before = np.concatenate([[0], np.cumsum(kept)])
    return ids[kept], before[edges - edges[0]], coded.dictionary


def joined(ids: np.ndarray, offsets: np.ndarray, words: pa.Array) -> pa.Array:
    """The texts of word ids joined by one space."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(ids)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _kept(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the words that no run holds after its first period."""
    change = np.zeros(offsets[-1] + 1, "i8")
    np.add.at(change, offsets[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(change, offsets[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed.

    ``collapsed`` joins by one space the words that stay when each run keeps its first period only. Words are
    separated by ASCII white space. A null or empty text has no word, no run and an empty collapsed text. Null and repeated
    ids stay rows of their own, other columns are left out, an empty table gives no rows. Memory grows with the batch
    of texts (2 MB, or the longest text), about 200 bytes a word.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets, words = word_lists(batch.column(1))
            rows = runs_of(ids, offsets, least)
            kept = _kept(rows, offsets)
            collapsed = joined(ids[kept], np.concatenate([[0], np.cumsum(kept)])[offsets], words)
            cells = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], fields=list(run_type))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1)), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), runs, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def repeated_tails(docs: DataFrame, seed_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: texts in which the words from a word on repeat with a period, as the number h of ``seed_col`` says.

    Where h % 10 = 0 and the text has n > 0 words, with g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), each word
    i >= a becomes word a + (i - a) % p. Other texts, null ones and rows with a null number stay as they are.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seeds = batch.column(1), batch.column(2).to_pylist()
            rows = [i for i, h in enumerate(seeds) if h is not None and h % 10 == 0]
            if rows:
                ids, offsets, words = word_lists(texts.take(pa.array(rows)))
                for k, i in enumerate(rows):
                    n, g = int(offsets[k + 1] - offsets[k]), seeds[i] // 10
                    if n:
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        own = ids[offsets[k] : offsets[k + 1]]
                        own[a:] = own[a + np.arange(n - a) % p]
                mask = np.zeros(batch.num_rows, bool)
                mask[[i for k, i in enumerate(rows) if offsets[k + 1] > offsets[k]]] = True
                full = joined(ids, offsets, words).cast(texts.type).filter(pa.array(np.diff(offsets) > 0))
                texts = pc.replace_with_mask(texts, pa.array(mask), full)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return docs.select(id_col, text_col, seed_col).mapInArrow(lean(run), f"doc_id {kind}, text string")

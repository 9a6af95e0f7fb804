"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on windows of labelled documents. To
predict, every text is read whole: its UTF-8 bytes are cut into windows that run side by side, both
directions label every byte position, and the document's probabilities are the mean over its positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityjobs.llm.shared import give_back, text_batches

UNDETERMINED = "und"
WINDOW = 128
#: Windows that run side by side in one step of a prediction.
LANES = 4096


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    return np.clip(x, 0, 1, out=x)


@dataclass
class Direction:
    """One gated recurrent layer: byte tables and recurrent weights of update, reset and candidate."""

    tables: list[np.ndarray]
    recurrent: list[np.ndarray]

    @classmethod
    def fresh(cls, hidden: int, rng: np.random.Generator) -> Direction:
        tables = [rng.normal(0, 0.1, (256, hidden)) for _ in range(3)]
        tables[0] += 0.3  # update and reset start in the linear part of the gate
        tables[1] += 0.5
        return cls([t.astype("f4") for t in tables], [(rng.normal(0, 0.5, (hidden, hidden)) / hidden**0.5).astype("f4") for _ in range(3)])

    def run(self, steps: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """States after each of the (time, lane) bytes and what the way back needs."""
        (ez, er, en), (uz, ur, un) = self.tables, self.recurrent
        h = np.zeros((steps.shape[1], ez.shape[1]), "f4")
        states, tape = np.empty((*steps.shape, ez.shape[1]), "f4"), []
        for t, x in enumerate(steps):
            z, r = _gate(ez[x] + h @ uz), _gate(er[x] + h @ ur)
            n = np.tanh(en[x] + (r * h) @ un)
            tape.append((h, z, r, n))
            h = h + z * (n - h)
            states[t] = h
        return states, tape

    def back(self, steps: np.ndarray, tape: list[tuple[np.ndarray, ...]], d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of tables and recurrent weights, from those of the states."""
        uz, ur, un = self.recurrent
        grads = [np.zeros_like(u) for u in self.recurrent]
        inputs = np.empty((3, *d_states.shape), "f4")
        dh = np.zeros_like(d_states[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, n = tape[t]
            dh = dh + d_states[t]
            dn = dh * z * (1 - n * n)
            dz = dh * (n - h) * ((z > 0) & (z < 1))
            drh = dn @ un.T
            dr = drh * h * ((r > 0) & (r < 1))
            inputs[:, t] = dz, dr, dn
            grads[0] += h.T @ dz
            grads[1] += h.T @ dr
            grads[2] += (r * h).T @ dn
            dh = dh * (1 - z) + drh * r + dz @ uz.T + dr @ ur.T
        flat = steps.reshape(-1)
        order = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        tables = []
        for d in inputs.reshape(3, len(flat), -1):
            g = np.zeros_like(self.tables[0])
            g[seen] = np.add.reduceat(d[order], first, axis=0)
            tables.append(g)
        return [*tables, *grads]

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Network:
    """Both directions and the layer that labels each position."""

    languages: list[str]
    ahead: Direction
    behind: Direction
    out_ahead: np.ndarray
    out_behind: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        outs = [rng.normal(0, 0.3, (hidden, len(languages))).astype("f4") for _ in range(2)]
        return cls(languages, Direction.fresh(hidden, rng), Direction.fresh(hidden, rng), *outs, np.zeros(len(languages), "f4"))

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights(), *self.behind.weights(), self.out_ahead, self.out_behind, self.bias]

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross entropy of every position's label and its gradients, by backpropagation through time."""
        steps = np.ascontiguousarray(windows.T)
        a, tape_a = self.ahead.run(steps)
        b, tape_b = self.behind.run(steps[::-1])
        b = b[::-1]
        p = _softmax(a @ self.out_ahead + b @ self.out_behind + self.bias)
        lanes = np.arange(steps.shape[1])
        loss = float(-np.log(p[:, lanes, labels] + 1e-9).mean())
        p[:, lanes, labels] -= 1
        p /= steps.size
        grads_a = self.ahead.back(steps, tape_a, p @ self.out_ahead.T)
        grads_b = self.behind.back(steps[::-1], tape_b, (p @ self.out_behind.T)[::-1])
        outs = [np.einsum("tbh,tbc->hc", s, p) for s in (a, b)]
        return loss, [*grads_a, *grads_b, *outs, p.sum(axis=(0, 1))]

    def position_probabilities(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(position, probabilities of each lane) for (lane, position) bytes, without keeping the way back."""
        steps = np.ascontiguousarray(windows.T)
        a = np.empty((*steps.shape, len(self.out_ahead)), "f4")
        for t, h in self._sweep(self.ahead, steps, range(len(steps))):
            a[t] = h
        for t, h in self._sweep(self.behind, steps, range(len(steps) - 1, -1, -1)):
            logits = a[t] @ self.out_ahead
            logits += h @ self.out_behind
            logits += self.bias
            np.exp(logits, out=logits)  # bounded states: no overflow
            logits /= logits.sum(axis=1, keepdims=True)
            yield t, logits

    @staticmethod
    def _sweep(layer: Direction, steps: np.ndarray, times: range) -> Iterator[tuple[int, np.ndarray]]:
        (ez, er, en), (uz, ur, un) = layer.tables, layer.recurrent
        shape = (steps.shape[1], ez.shape[1])
        h, z, r, n, m = (np.zeros(shape, "f4") for _ in range(5))
        for t in times:
            x = steps[t]
            np.take(ez, x, axis=0, out=z, mode="clip")
            np.take(er, x, axis=0, out=r, mode="clip")
            np.take(en, x, axis=0, out=n, mode="clip")
            z += np.matmul(h, uz, out=m)
            r += np.matmul(h, ur, out=m)
            _gate(z)
            _gate(r)
            r *= h
            n += np.matmul(r, un, out=m)
            np.tanh(n, out=n)
            n -= h
            n *= z
            h += n
            yield t, h


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = 8, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on minibatches of (window, position) bytes; ``labels`` index ``languages``."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, hidden, rng)
    weights = net.weights()
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for first in range(0, len(order), batch):
            pick = order[first : first + batch]
            _, grads = net.gradients(windows[pick], labels[pick])
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            for w, g, m, s in zip(weights, grads, mean, square):
                g = g / norm
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return net


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def training_windows(docs: DataFrame, labelled: Column, per_language: int = 300, per_doc: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample: about ``per_language`` labelled documents each, ``per_doc`` windows each.

    The sample is drawn by a hash of the id over all labelled rows; only windows come to the driver, so their
    bytes are at most 2 * per_language * per_doc * WINDOW per language, whatever the table or its texts.
    """
    rows = docs.filter(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), "uint8"), np.zeros(0, "int64"), []
    pairs = [x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))]
    share = F.element_at(F.create_map(*pairs), F.col(lang_col))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 20)) < share * (1 << 20)).select(lang_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, bytes]] = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if not _has_letter(text):
                    continue
                rng = np.random.default_rng([seed, len(raw)])
                starts = rng.integers(0, max(1, len(raw) - WINDOW + 1), min(per_doc, -(-len(raw) // WINDOW)))
                mark = zlib.crc32(raw)
                out += [(mark + int(s), lang, raw[s : s + WINDOW].ljust(WINDOW, b" ")) for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.binary()))], ["at", "lang", "window"])

    found = sorted(drawn.mapInArrow(cut, "at long, lang string, window binary").collect())
    windows = np.frombuffer(b"".join(r["window"] for r in found), "uint8").reshape(-1, WINDOW)
    return windows, np.array([languages.index(r["lang"]) for r in found], "int64"), languages


def _pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all byte positions of each text (not empty)."""
    sizes = np.array([len(t) for t in texts])
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    grid = np.zeros((int(counts.sum()), WINDOW), "uint8")
    lengths = np.full(len(grid), WINDOW)
    lengths[np.cumsum(counts) - 1] = sizes - (counts - 1) * WINDOW
    grid[np.arange(WINDOW) < lengths[:, None]] = np.frombuffer(b"".join(texts), "uint8")
    order = np.argsort(-lengths, kind="stable")
    sums = np.zeros((len(grid), len(net.languages)), "f8")
    for first in range(0, len(grid), LANES):
        lanes = order[first : first + LANES]
        part = np.zeros((len(lanes), len(net.languages)), "f4")
        # Lanes stand from long to short: those that still have byte t are the first ``alive[t]``.
        alive = np.searchsorted(-lengths[lanes], -np.arange(WINDOW), side="left")
        for t, p in net.position_probabilities(grid[lanes]):
            part[: alive[t]] += p[: alive[t]]
        sums[lanes] = part
    total = np.zeros((len(texts), len(net.languages)))
    np.add.at(total, owner, sums)
    return total / sizes[:, None]


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and ``keep`` columns of every document.

    A text that is null, empty or without a letter is ``und`` with score 0; so is every text without a
    network. Texts are read whole. Repeated rows are predicted alike; an empty table gives no rows.
    """
    found = labeller(net)(F.col(text_col))
    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("_found"), *keep).select("doc_id", "_found.lang_pred", "_found.score", *keep)


def labeller(net: Network | None) -> Callable[[Column], Column]:
    """The function from a column of texts to (lang_pred, score); only the texts go to Python."""

    def one(column: pa.Array) -> Iterator[pa.Array]:
        for start in range(0, len(column), 1024):  # bounds memory
            texts = column.slice(start, 1024).to_pylist()
            langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            read = [n for n, t in enumerate(texts) if t and _has_letter(t)] if net else []
            at = 0
            while at < len(read):
                first, size = at, 0
                while at < len(read) and size < 4 * LANES * WINDOW:
                    size += len(texts[read[at]])
                    at += 1
                p = _pooled(net, [texts[n].encode("utf-8", "surrogatepass") for n in read[first:at]])
                best = p.argmax(axis=1)
                langs[read[first:at]] = [net.languages[b] for b in best]
                scores[read[first:at]] = np.clip(p[np.arange(len(p)), best], 0, 1)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                parts = list(one(column))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct({"lang_pred": pa.string(), "score": pa.float64()}))
        finally:
            give_back()

    return label


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that the network never learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = 300, per_doc: int = 8, hidden: int = 8, epochs: int = 6) -> Network | None:
    """The network learnt from the labelled documents that are not held out; None without any."""
    windows, labels, languages = training_windows(docs, ~held_out(), per_language, per_doc)
    return train(windows, labels, languages, hidden, epochs) if len(windows) else None

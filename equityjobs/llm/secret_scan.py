"""Secret scans: broad patterns find candidates, a random forest removes the false positives.

The features of a candidate are its length and classes of characters, how likely its character transitions and how
well covered its letters are by the corpus (both counted over all texts), and how often labelled findings
with the same path or neighbouring words were secrets (for a training row, counted without its own fold). The
forest is grown here, in numpy, from a bounded sample of labelled findings. Where there are none, known shapes and
assignments label the candidates; such a forest is blind to what those rules read (the word and the marks before the
value), so it has to tell secrets by the value, the path and the other words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityjobs.llm.shared import stored, text_batches
from equityjobs.llm.tokens import sliced

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
#: Shapes that count as a labelled secret where no labels are given: provider keys and quoted assignments.
PROVIDER = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_(live|test)_[A-Za-z0-9]{16,}")
ASSIGNED = re.compile(r"(?i)(token|secret|passw(or)?d|api_?key|credential)s?[\"']?\s*[:=]\s*[\"']?$")
#: Values of any length and of any characters: after a secret-like word, and the password part of a URL.
NAMES = ("token", "secret", "password", "passwd", "passphrase", "passwor", "pwd", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "privatekey", "private_key", "private-key", "credential")
#: An identifier from its first character on, the mark after it and the blanks; and the value that follows.
HEAD = re.compile(r"""(?<![A-Za-z0-9_\-])([A-Za-z0-9_\-]++)["'`]?+[ \t]*+(?::=|=>|[:=])[ \t]*+""")
NAMED = re.compile("(?i:" + "|".join(NAMES) + ")")
VALUE = re.compile(r"""(?:"(?P<double>(?:\\.|[^"\\\n])++)"|'(?P<single>(?:\\.|[^'\\\n])++)'|`(?P<back>[^`\n]++)`|(?P<bare>[^\s"'`]++))""")
URL = re.compile(r"""://[^\s/:@"'`<>]*:(?P<url>[^\s/"'`<>]+)@(?=[^\s@])""")
_NEAR = re.compile(r"[A-Za-z]+")
#: Character classes of transitions: the letters, digits one by one, capitals together by letter, the rest.
_CLASS = np.full(256, 63, "i8")
for _n, _c in enumerate(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    _CLASS[_c] = _n
_LETTER = np.full(256, -1, "i8")
for _n in range(26):
    _LETTER[97 + _n] = _LETTER[65 + _n] = _n
RUN = 4


def _runs(raw: np.ndarray) -> np.ndarray:
    """Number of each run of four letters (any case), -1 where one of the four is no letter."""
    letters = _LETTER[raw]
    if len(letters) < RUN:
        return np.zeros(0, "i8")
    parts = [letters[i : len(letters) - RUN + 1 + i] for i in range(RUN)]
    code = ((parts[0] * 26 + parts[1]) * 26 + parts[2]) * 26 + parts[3]
    return np.where(np.minimum.reduce(parts) < 0, -1, code)


@dataclass
class Corpus:
    """What all texts say: log probabilities of transitions (64 x 64) and which four-letter runs are usual."""

    transitions: np.ndarray
    usual: np.ndarray


def corpus_statistics(docs: DataFrame, text_col: str = "text", share: float = 2e-5) -> Corpus:
    """Counts over every whole text; at most 64 * 64 + 26 ** 4 sums come to the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, runs = np.zeros(64 * 64, "i8"), np.zeros(26**RUN, "i8")
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(first, 256).to_pylist()
                raw = np.frombuffer("\n".join(t for t in texts if t).encode("utf-8", "surrogatepass"), "u1")
                if len(raw) > 1:
                    classes = _CLASS[raw]
                    pairs += np.bincount(classes[:-1] * 64 + classes[1:], minlength=64 * 64)
                    found = _runs(raw)
                    runs += np.bincount(found[found >= 0], minlength=26**RUN)
        keys = np.concatenate([np.flatnonzero(pairs), 4096 + np.flatnonzero(runs)])
        counts = np.concatenate([pairs[pairs > 0], runs[runs > 0]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    text_batches(docs.sparkSession)
    table = docs.select(text_col).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(4096 + 26**RUN)
    counts[table["key"].to_numpy("i8")] = table["n"].to_numpy("f8")
    pairs = counts[:4096].reshape(64, 64) + 0.5
    runs = counts[4096:]
    return Corpus(np.log(pairs / pairs.sum(axis=1, keepdims=True)), runs > max(1.0, share * runs.sum()))


NUMBERS = ("length", "digits", "capitals", "lower", "marks", "distinct", "entropy", "changes", "transition", "coverage", "quoted", "assigned")


def _numbers(word: str, before: str, after: str, corpus: Corpus) -> list[float]:
    raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), "u1")
    n, classes = len(raw), _CLASS[raw]
    kinds = np.where(classes < 26, 0, np.where(classes < 52, 1, np.where(classes < 62, 2, 3)))
    share = np.bincount(kinds, minlength=4) / n
    seen = np.bincount(raw)
    p = seen[seen > 0] / n
    covered = np.zeros(n, bool)
    found = _runs(raw)
    at = np.flatnonzero((found >= 0) & corpus.usual[found])
    covered[(at[:, None] + np.arange(RUN)).ravel()] = True
    return [
        min(n, 200), share[2], share[1], share[0], share[3], len(p) / n, float(-(p * np.log2(p)).sum()), float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(corpus.transitions[classes[:-1], classes[1:]].mean()) if n > 1 else 0.0, float(covered.mean()),
        float(before[-1:] in ("'", '"', "`")) + float(after[:1] in ("'", '"', "`")), float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
    ]


def _spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a text, in order; kind is 'quoted', 'bare', 'url', or 'run' for ``CANDIDATE`` alone.

    A value in a quoted value and a run in a value are candidates of their own. Of assignments within one unquoted value
    (``token=secret=x``), the outermost and the innermost value are. Each pattern reads a character a bounded number of times.
    """
    spans = {m.span(): "run" for m in CANDIDATE.finditer(text)}
    folded = text.casefold()
    if any(n in folded for n in NAMES):
        ends, inner = -1, -1  # of the unquoted value so far: its end, and where its innermost value starts

        def settle() -> None:
            if inner >= 0:
                _add_bare(text, inner, ends, spans)

        for head in HEAD.finditer(text):
            if not NAMED.search(head[1]):
                continue
            a = head.end()
            if a < ends and text[a] not in "\"'`":
                inner = a
                continue
            m = VALUE.match(text, a)
            if not m:
                continue
            if m.lastgroup == "bare":
                settle()
                ends, inner = m.end(), -1
                _add_bare(text, a, ends, spans)
            else:
                spans[m.span(m.lastgroup)] = "quoted"
        settle()
    if "://" in text:
        spans |= {m.span("url"): "url" for m in URL.finditer(text)}
    return sorted((a, b, kind) for (a, b), kind in spans.items())


def _add_bare(text: str, a: int, b: int, spans: dict[tuple[int, int], str]) -> None:
    while b > a and text[b - 1] in ",;)]}>":
        b -= 1
    if a < b:
        spans[a, b] = "bare"


def _shaped(word: str, before: str, kind: str) -> bool:
    """Whether the candidate has a known secret's shape."""
    if PROVIDER.fullmatch(word) or kind == "url" or (kind != "run" or ASSIGNED.search(before)) and re.search(r"\d", word):
        return True
    return kind == "quoted" and not re.search(r"\s", word) and bool(re.search(r"[^\w\-]|[a-z][A-Z]", word))


def candidates(docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, start (in characters), length, sha256, path, before, after, shaped, numbers of every candidate.

    ``shaped`` says whether the candidate has a known secret's shape. The value itself is not kept. Null and
    empty texts have no candidate; a null path is the path ''. Texts are scanned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            rows: list[tuple] = []
            for key, text, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for a, b, kind in _spans(text or ""):
                    before, after, word = text[max(0, a - 40) : a], text[b : b + 40], text[a:b]
                    words = _NEAR.findall(before)[-1:], _NEAR.findall(after)[:1]
                    shaped = _shaped(word, before, kind)
                    rows.append((key, a, b - a, hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest(), path or "", *("".join(w).lower() for w in words), shaped, _numbers(word, before, after, corpus)))
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.float64()))
            names = ("doc_id", "start", "length", "sha256", "path", "before", "after", "shaped", "numbers")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, path_col).mapInArrow(
        run, f"doc_id {kind}, start long, length long, sha256 string, path string, before string, after string, shaped boolean, numbers array<double>"
    )


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> int:
        """Split by Gini impurity on a random subset of features until pure, small or deep; returns the node."""
        at = len(self.value)
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, float(y.mean()))):
            column.append(v)
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return at
        best = (0.0, -1, 0.0)
        for f in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5))]:
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            gain = y.mean() * (1 - y.mean()) - (n * left * (1 - left) + (len(y) - n) * right * (1 - right)) / len(y)
            gain[v[1:] == v[:-1]] = -1
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return at
        goes = x[:, best[1]] <= best[2]
        if goes.all() or not goes.any():
            return at
        self.feature[at], self.cut[at] = best[1], best[2]
        self.left[at] = self.grow(x[goes], y[goes], rng, depth - 1)
        self.right[at] = self.grow(x[~goes], y[~goes], rng, depth - 1)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(c) for c in (self.feature, self.cut, self.left, self.right, self.value))
        node = np.zeros(len(x), int)
        while (inner := feature[node] >= 0).any():
            i = np.flatnonzero(inner)
            low = x[i, feature[node[i]]] <= cut[node[i]]
            node[i] = np.where(low, left[node[i]], right[node[i]])
        return value[node]


#: Features, and the column of words, that the labels of known shapes come from.
_READ = [NUMBERS.index("quoted"), NUMBERS.index("assigned")]


def unread(word: str) -> str:
    """The word before a value, or '' where the labelling rules read it."""
    return "" if any(n in word for n in NAMES) else word


@dataclass
class Forest:
    """Trees on bootstrap samples, and the log odds of a secret by path and neighbouring words (path, before, after)."""

    odds: list[dict[str, float]]
    trees: list[Tree]
    blind: bool = False

    def features(self, numbers: np.ndarray, words: list[list[str]], odds: list[dict[str, float]] | None = None) -> np.ndarray:
        if self.blind:
            numbers = numbers.copy()
            numbers[:, _READ] = 0.0
            words = [words[0], [unread(w) for w in words[1]], words[2]]
        return np.column_stack([numbers, *([o.get(w, 0.0) for w in column] for o, column in zip(odds or self.odds, words))])

    def scores(self, numbers: np.ndarray, words: list[list[str]]) -> np.ndarray:
        x = self.features(numbers, words)
        return np.mean([t.predict(x) for t in self.trees], axis=0) if self.trees else np.zeros(len(numbers))


def _odds(words: list[list[str]], labels: np.ndarray, rows: np.ndarray) -> list[dict[str, float]]:
    """Log odds of a secret by word over the overall odds, smoothed, from the given rows, for words of at least two of them."""
    prior, out = (labels[rows].sum() + 1) / (len(rows) + 2), []
    for column in words:
        seen: dict[str, list[float]] = {}
        for i in rows:
            total = seen.setdefault(column[i], [2 * prior, 2.0])
            total[0] += labels[i]
            total[1] += 1
        out.append({w: float(np.log(a / n / (1 - a / n)) - np.log(prior / (1 - prior))) for w, (a, n) in seen.items() if n > 3})
    return out


def fit_forest(numbers: np.ndarray, words: list[list[str]], labels: np.ndarray, trees: int = 25, depth: int = 8, seed: int = 3, folds: int = 5, blind: bool = False) -> Forest:
    """A forest from labelled findings; without both kinds of labels it scores every candidate by their share.

    A training row's odds are counted over the other ``folds``, so that its own label is in none of its features.
    """
    rng = np.random.default_rng(seed)
    if blind:
        words = [words[0], [unread(w) for w in words[1]], words[2]]
    everyone = np.arange(len(labels))
    forest = Forest(_odds(words, labels, everyone), [], blind)
    fold = rng.permutation(len(labels)) % folds
    x = np.empty((len(labels), len(NUMBERS) + len(words)))
    for f in range(folds):
        mine = np.flatnonzero(fold == f)
        x[mine] = forest.features(numbers[mine], [[c[i] for i in mine] for c in words], _odds(words, labels, np.flatnonzero(fold != f)))
    for _ in range(trees):
        pick = rng.integers(0, len(x), len(x))
        tree = Tree()
        tree.grow(x[pick], labels[pick].astype("f8"), rng, depth)
        forest.trees.append(tree)
    return forest


def train(found: DataFrame, label: Column, most: int = 4000, seed: int = 5, blind: bool = False) -> Forest:
    """Fit on at most about ``most`` of the stored candidates with a label, half of them from each kind, drawn by hash."""
    labelled = found.withColumn("label", label).filter(F.col("label").isNotNull())
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label"), min(1.0, most / 2 / counts.get(True, 1))).otherwise(min(1.0, most / 2 / counts.get(False, 1)))
    drawn = labelled.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start"), F.lit(1 << 20)) < share * (1 << 20))
    rows = sorted(drawn.select("numbers", "path", "before", "after", "label", "sha256").collect(), key=lambda r: (r["sha256"], r["path"], r["before"], r["after"], r["numbers"]))
    if not rows:
        return Forest([{}, {}, {}], [], blind)
    words = [[r[c] for r in rows] for c in ("path", "before", "after")]
    return fit_forest(np.array([r["numbers"] for r in rows]), words, np.array([r["label"] for r in rows], int), blind=blind)


def score(found: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id", "start", "length", "sha256", "shaped")) -> DataFrame:
    """``keep`` columns of the candidates, and score: the forest's probability of a secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            numbers = np.array(columns["numbers"].to_pylist(), "f8").reshape(batch.num_rows, len(NUMBERS))
            p = forest.scores(numbers, [columns[c].to_pylist() for c in ("path", "before", "after")])
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in keep), pa.array(p)], [*keep, "score"])

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in keep)
    inputs = list(dict.fromkeys([*keep, "numbers", "path", "before", "after"]))
    return found.select(*inputs).mapInArrow(run, f"{kinds}, score double")


def quality(found: DataFrame, forest: Forest, label: Column, threshold: float = 0.5) -> tuple[float, float]:
    """(precision, recall) of the forest on the stored candidates that have the label."""
    kept = score(found.withColumn("_label", label).filter("_label is not null"), forest, ("_label",))
    hit = F.col("score") >= threshold
    row = kept.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in (("both", hit & F.col("_label")), ("found", hit), ("there", F.col("_label"))))).first()
    return row["both"] / max(1, row["found"]), row["both"] / max(1, row["there"])


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, most: int = 4000, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, start, length, sha256, score: candidates that the forest takes for secrets.

    ``labels`` (doc_id, start, secret) are labelled findings; without them, candidates are labelled by known
    shapes and assignments, which the forest's features then leave out, and those of documents whose crc32(id) mod 3 is 1
    take no part in the training. Repeated rows are scanned alike; null and empty texts have no candidate;
    empty tables, and tables without a candidate, give no rows.
    """
    corpus = corpus_statistics(docs, text_col)
    found = stored(candidates(docs, corpus, id_col, text_col, path_col), "candidates")
    if labels is None:
        label = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1, F.col("shaped"))
        forest = train(found, label, most, blind=True)
    else:
        forest = train(found.join(labels, ["doc_id", "start"], "left"), F.col("secret"), most)
    return score(found, forest).filter(F.col("score") >= threshold).select("doc_id", "start", "length", "sha256", "score")

"""Near duplicates by SimHash fingerprints that BK-trees link.

Two fingerprints within ``radius`` bits agree in at least c of ``radius + c`` bands of bits, so the
fingerprints that share the values of c bands form a shard (c grows with the number of fingerprints, which keeps
shards small), and each shard gets a BK-tree: an element's children are keyed by their Hamming distance to it, and a search follows only the edges within the radius of its own
distance. A large shard is cut into blocks, each with its tree; every pair of blocks is searched, so no task
holds more than two blocks of any shard. A task answers with the links of a spanning forest, not with all
pairs. Trees of many shards are built and searched together, one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from equityjobs.llm.shared import give_back, join_side, lean, looked_up, stored, text_batches
from equityjobs.llm.tokens import sliced, texts_of

#: Blanks that part words, as in the pattern [^\x20\x09-\x0D]+.
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Children of a node in the trees of links between texts.
DEGREE = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _shingle_hashes(text: str, width: int, seed: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_BLANKS).split(b" ")
    words = [w for w in words if w]
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(line, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: -width])]
    return [xxh64_intdigest(line[i:j], seed) for i, j in zip(starts, ends[width - 1 :])]


def _majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is 1 if set in over half of the run."""
    out = np.zeros(len(counts), "uint64")
    sizes = np.array(counts)
    full = np.flatnonzero(sizes)
    if len(full):
        raw = hashes.astype("<u8").view("uint8").reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype="int32")
        marks = (2 * ones > sizes[full, None]).astype("uint64")
        out[full] = (marks << np.arange(64, dtype="uint64")).sum(axis=1, dtype="uint64")
    return out


def _mixed(hashes: np.ndarray, rank: int) -> np.ndarray:
    """The hashes for rank 0, else a bijective mix of them that stands for another hash function."""
    if not rank:
        return hashes
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * rank & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x * np.uint64(0xC4CEB9FE1A85EC53)


def _min_hashes(hashes: np.ndarray, counts: list[int], bands: int, rows: int) -> np.ndarray:
    """(text, band): a key of ``rows`` minima of the text's hashes under different hash functions; 0 without a word."""
    out = np.zeros((len(counts), bands), "uint64")
    sizes = np.array(counts)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(bands * rows):
            least = np.minimum.reduceat(_mixed(hashes, 101 + k), starts)
            out[full, k // rows] = (out[full, k // rows] ^ least) * np.uint64(0x9FB21C651E98DF25)
    return out


def _set_of(hashes: list[int], seed: int) -> tuple[np.ndarray, int]:
    """The distinct hashes in order, and a key of their set."""
    from xxhash import xxh64_intdigest

    distinct = np.unique(np.array(hashes, "uint64"))
    return distinct, xxh64_intdigest(distinct.tobytes(), seed)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", words: int = 1, bands: int = 0, rows: int = 3, sets: bool = False) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every whole text; null, empty and blank texts have 0.

    With more ``words``, fp1, fp2, ... carry on the fingerprint under other hash functions; with ``bands``, the array
    ``bands`` holds min-hash keys of the shingles. With ``sets``, a repeated shingle counts once, ``node`` is a key of
    the set of shingles and ``n`` its size.
    """
    names = ["fp", *(f"fp{v}" for v in range(1, words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints: list[list[np.ndarray]] = [[] for _ in names]
            keys: list[np.ndarray] = []
            hashes: list[int] = []
            counts: list[int] = []
            nodes: list[int] = []
            sizes: list[int] = []

            def settle() -> None:
                h = np.array(hashes, "uint64")
                for v in range(words):
                    prints[v].append(_majority(_mixed(h, v), counts))
                if bands:
                    keys.append(_min_hashes(h, counts, bands, rows))
                hashes.clear()
                counts.clear()

            for text in texts_of(batch, 1):
                one = _shingle_hashes(text, width, seed)
                if sets:
                    distinct, node = _set_of(one, seed)
                    one = distinct.tolist()
                    nodes.append(node)
                    sizes.append(len(one))
                hashes += one
                counts.append(len(one))
                if len(hashes) > 200_000:
                    settle()
            settle()
            columns = [pa.array(np.concatenate(p).view("int64")) for p in prints]
            if bands:
                flat = np.concatenate(keys).view("int64").ravel()
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype="int32") * bands), pa.array(flat)))
            if sets:
                columns += [pa.array(np.array(nodes, "uint64").view("int64")), pa.array(np.array(sizes, "int64"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names, *(["bands"] if bands else []), *(["node", "n"] if sets else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = [f"doc_id {kind}", *(f"{n} long" for n in names), *(["bands array<long>"] if bands else []), *(["node long", "n long"] if sets else [])]
    text_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(lean(run), ", ".join(schema))


def _shingle_sets(docs: DataFrame, width: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles: the set of shingle hashes of every whole text, under the key that ``fingerprints`` gives it; once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            found = [_set_of(_shingle_hashes(text, width, seed), seed) for text in texts_of(batch, 1)]
            found = [(h, k) for h, k in found if not (k in seen or seen.add(k))]
            ends = np.cumsum([0, *(len(h) for h, _ in found)]).astype("int32")
            flat = np.concatenate([np.zeros(0, "uint64"), *(h for h, _ in found)]).view("int64")
            nodes = np.array([k for _, k in found], "uint64").view("int64")
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "shingles"])

    text_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(lean(run), "node long, shingles array<long>")


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distance of fingerprints of 64 bits, or of rows of several words."""
    bits = np.bitwise_count(x ^ y)
    return bits.astype("int64") if bits.ndim == 1 else bits.sum(axis=1, dtype="int64")


def _bk_forest(values: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all ``tree`` numbers at once: (root of each tree, parent, distance to the parent).

    The elements of a tree are inserted in their order: at each level, the first element to come to a
    (node, distance) edge becomes that child and the later ones go down to it.
    """
    n, span = len(values), 64 * values[:1].size + 1
    _, roots = np.unique(tree, return_index=True)
    parent, edge = np.full(n, -1), np.zeros(n, "int64")
    node = roots[tree].copy()
    left = np.setdiff1d(np.arange(n), roots, assume_unique=True)
    while len(left):
        distance = _distance(values[left], values[node[left]])
        _, first, group = np.unique(node[left] * span + distance, return_index=True, return_inverse=True)
        child = left[first]
        parent[child], edge[child] = node[child], distance[first]
        node[left] = child[group]
        keep = np.ones(len(left), bool)
        keep[first] = False
        left = left[keep]
    return roots, parent, edge


def _bk_hits(values: np.ndarray, tree: np.ndarray, asks: np.ndarray, asked_tree: np.ndarray, radius: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, element, distance) of the pairs within the question's ``radius``, for ``step`` questions at a time."""
    span = 64 * values[:1].size + 1
    roots, parent, edge = _bk_forest(values, tree)
    child = np.flatnonzero(parent >= 0)
    child = child[np.argsort(parent[child] * span + edge[child], kind="stable")]
    keys = parent[child] * span + edge[child]
    for first in range(0, len(asks), step):  # bounds the pairs that are held at once
        q = np.arange(first, min(first + step, len(asks)))
        node = roots[asked_tree[q]]
        found = []
        while len(q):
            distance = _distance(asks[q], values[node])
            hit = distance <= radius[q]
            found.append((q[hit], node[hit], distance[hit]))
            low = np.searchsorted(keys, node * span + np.maximum(distance - radius[q], 0))
            high = np.searchsorted(keys, node * span + np.minimum(distance + radius[q], span - 1), side="right")
            many = high - low
            total = np.cumsum(many)
            at = np.repeat(low - total + many, many) + np.arange(total[-1])
            q, node = np.repeat(q, many), child[at]
        yield tuple(np.concatenate(x) for x in zip(*found))


def _bk_links(values: np.ndarray, tree: np.ndarray, asks: np.ndarray, asked_tree: np.ndarray, radius: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(question, element) pairs within ``radius``; question i searches the tree numbered ``asked_tree[i]``."""
    hits = list(_bk_hits(values, tree, asks, asked_tree, np.full(len(asks), radius), step))
    return np.concatenate([q for q, _, _ in hits] or [np.zeros(0, int)]), np.concatenate([e for _, e, _ in hits] or [np.zeros(0, int)])


def _forest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n elements that the pairs (a, b) link."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tree_links(nodes: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    """Links (a, b) that join the nodes with the same root by a tree of at most ``DEGREE`` children a node: there is no hub."""
    order = np.argsort(root, kind="stable")
    _, starts, counts = np.unique(root[order], return_index=True, return_counts=True)
    start = np.repeat(starts, counts)
    rank = np.arange(len(order)) - start
    child = np.flatnonzero(rank)
    return pd.DataFrame({"a": nodes[order[child]], "b": nodes[order[start[child] + (rank[child] - 1) // DEGREE]]})


def _shard_links(rows: pd.DataFrame, names: list[str], radius: int) -> pd.DataFrame:
    """Spanning links (node, root) of the block pairs in one task: ``side`` of a ``shard`` is 0, 1, or 2 for both."""
    rows = rows.drop_duplicates(["shard", "side", "node"])
    _, number = np.unique(rows["shard"].to_numpy(), return_inverse=True)
    prints, side = rows[names].to_numpy("int64").view("uint64"), rows["side"].to_numpy()
    prints = prints[:, 0] if len(names) == 1 else prints
    held, asking = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    known = np.unique(number[held])
    asking = asking[np.isin(number[asking], known)]
    if not len(held) or not len(asking):
        return pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64")})
    q, e = _bk_links(prints[held], np.searchsorted(known, number[held]), prints[asking], np.searchsorted(known, number[asking]), radius)
    unique, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
    a, b = at[asking[q]], at[held[e]]
    return _tree_links(unique, _forest_of(len(unique), a[a != b], b[a != b]))


def _shard_forest(rows: pd.DataFrame, names: list[str], radii: np.ndarray, similarity: float, step: int = 256) -> pd.DataFrame:
    """Links (a, b) that join the nodes of one task which fingerprints and set sizes allow to be ``similarity`` alike.

    ``radii`` has the radius by set size, the last one for all larger sets.
    """
    rows = rows.drop_duplicates(["shard", "side", "node"])
    unique, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
    root = np.arange(len(unique))
    for q, e in _alike_hits(rows, names, radii, similarity, step):
        new = at[q] != at[e]
        root = _forest_of(len(unique), root[at[q[new]]], root[at[e[new]]])[root]
    return _tree_links(unique, root)


def _alike_hits(rows: pd.DataFrame, names: list[str], radii: np.ndarray, similarity: float, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, element) row numbers of the pairs of each ``shard`` within the radius of their size, ``step`` questions at a time."""
    _, number = np.unique(rows["shard"].to_numpy(), return_inverse=True)
    prints, side, size = rows[names].to_numpy("int64").view("uint64"), rows["side"].to_numpy(), rows["n"].to_numpy()
    held, asking = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    known = np.unique(number[held])
    asking = asking[np.isin(number[asking], known)]
    if not len(held) or not len(asking):
        return
    radius = radii[np.minimum(size[asking], len(radii) - 1)]
    for q, e, _ in _bk_hits(prints[held], np.searchsorted(known, number[held]), prints[asking], np.searchsorted(known, number[asking]), radius, step):
        q, e = asking[q], held[e]
        keep = np.minimum(size[q], size[e]) >= similarity * np.maximum(size[q], size[e]) - 1e-9
        yield q[keep], e[keep]


def _family_links(rows: pd.DataFrame, names: list[str], radii: np.ndarray, similarity: float, step: int = 64) -> pd.DataFrame:
    """Links (a, b) that join the nodes of one task whose sets of shingles are ``similarity`` alike (Jaccard) or more.

    BK-trees of the families propose pairs; a pair that earlier links do not join counts its common shingles.
    """
    rows = rows.drop_duplicates(["shard", "side", "node"]).reset_index(drop=True)
    unique, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
    sets = rows["shingles"].to_list()
    sizes = np.fromiter(map(len, sets), "int64", len(sets))
    _, flat = np.unique(np.concatenate([np.zeros(0, "int64"), *sets]), return_inverse=True)
    flat, starts, marked = flat.astype("int32"), np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()) + 1, bool)
    root = np.arange(len(unique))
    for q, e in _alike_hits(rows, names, radii, similarity, step):
        order = np.argsort(q, kind="stable")
        q, e = q[order], e[order]
        for i, mine in zip(np.unique(q), np.split(e, np.flatnonzero(np.diff(q)) + 1)):
            mine = mine[root[at[mine]] != root[at[i]]]
            if not len(mine):
                continue
            one = flat[starts[i] : starts[i] + sizes[i]]
            marked[one] = True
            span = sizes[mine]
            other = np.repeat(starts[mine] - np.cumsum(span) + span, span) + np.arange(span.sum())
            common = np.add.reduceat(marked[flat[other]], np.cumsum(span) - span, dtype="int64")
            marked[one] = False
            linked = mine[common >= similarity * (sizes[i] + span - common) - 1e-9]
            if len(linked):
                joined = np.append(root[at[linked]], root[at[i]])
                root[np.isin(root, joined)] = joined.min()
    give_back()
    return _tree_links(unique, root)


def _dealt_shards(keyed: DataFrame, columns: list[str], block: int, task_rows: int, weight: str | None = None) -> GroupedData:
    """Rows (node, ``columns``, shard, side) of the block pairs of all shared band values, grouped into tasks.

    A block holds about ``block`` rows, or rows that add up to ``block`` by the column ``weight``. Each block pair of a
    shard that is cut is a group of its own; the other shards share groups of about ``task_rows``.
    """
    load = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("_n"), load.alias("_load")).filter("_n > 1")
    cut = F.greatest(F.lit(1), F.least(F.ceil(F.col("_load") / block), F.col("_n"))).cast("int")
    blocks = stored(sizes.select("band", "value", "_load", cut.alias("_blocks")), "blocks")
    tasks = max(1, -(-(blocks.filter("_blocks = 1").agg(F.sum("_load")).first()[0] or 0) // task_rows))
    # With c blocks, block i meets each block j in the pair (min, max); the smaller side holds the tree.
    mine = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("_blocks")).cast("int")
    pairs = keyed.join(blocks.drop("_load"), ["band", "value"]).withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_i") == F.col("_j"), 2).when(F.col("_i") < F.col("_j"), 0).otherwise(1).cast("int")
    shard = F.xxhash64("band", "value", F.least("_i", "_j"), F.greatest("_i", "_j"))
    dealt = pairs.select("node", *columns, shard.alias("shard"), side.alias("side"), (F.col("_blocks") > 1).alias("_cut"))
    task = F.when(F.col("_cut"), F.col("shard")).otherwise(F.pmod(F.xxhash64(F.lit(3), "shard"), F.lit(tasks)))
    return dealt.select("*", task.alias("_task")).groupBy("_cut", "_task")


def _linked_shards(keyed: DataFrame, names: list[str], radius: int, block: int, task_rows: int) -> DataFrame:
    """a, b: links between nodes that share a shard (band, value), from rows (node, ``names``, band, value)."""
    return _dealt_shards(keyed, names, block, task_rows).applyInPandas(lambda rows: _shard_links(rows, names, radius), "a long, b long")


def band_keys(radius: int, rows: int, most: int, fp: str = "fp") -> list[Column]:
    """Keys of which two fingerprints within ``radius`` bits share at least one, with about ``most`` of ``rows`` rows a value.

    In ``radius + c`` bands at least c agree, so every choice of c bands makes a key: c grows until its bits part the rows.
    """
    chosen = 1
    while chosen < 8 and rows > most << (64 * chosen // (radius + chosen)):
        chosen += 1
    bands = radius + chosen
    edges = [64 * k // bands for k in range(bands + 1)]
    parts = [F.shiftrightunsigned(fp, low).bitwiseAND((1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])]
    keys = []
    for choice in combinations(range(bands), chosen):
        key = F.lit(0).cast("long")
        for k in choice:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(parts[k])
        keys.append(key)
    return keys


def links(prints: DataFrame, radius: int = 4, block: int = 4096, task_rows: int = 1 << 15) -> DataFrame:
    """a, b: links between distinct fingerprints whose closure is that of all pairs within ``radius`` bits.

    ``prints`` holds distinct ``fp``, stored. No pair is left out: each key's shard is searched whole.
    """
    keys = F.array(*band_keys(radius, prints.count(), block))
    keyed = prints.select(F.col("fp").alias("node"), "fp", F.posexplode(keys).alias("band", "value"))
    return _linked_shards(keyed, ["fp"], radius, block, task_rows)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """fp, root: the smallest linked fingerprint of every fingerprint in ``edges`` (stored), by minimum labels.

    Each round takes the neighbours' smallest label and then the label's own label, which halves the way to the
    root; the labels are stored after each round, so the lineage stays short. More than ``most_rounds`` rounds (a chain of
    over 2**59 links) are an error.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("_near"))
        low = label.join(near, "fp").select("fp", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        # Only roots are looked up: one row for each, however many rows have it.
        used = label.groupBy("root").agg(F.lit(1).alias("_used")).select(F.col("root").alias("fp"))
        jump = stored(label.join(used, "fp", "left_semi").select(F.col("fp").alias("root"), F.col("root").alias("_up")), "jump")
        new = stored(looked_up(low, jump, "root", "fp").select("fp", "_old", F.least("root", "_up").alias("root")), "labels")
        label = new.select("fp", "root")
        if not new.filter("_old != root").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) of every document.

    Null, empty and blank texts share fingerprint 0, which links like any other. Repeated rows come out as
    often as they come in. An empty table gives no rows. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = stored(links(distinct.select("fp"), radius, block).distinct(), "links")
    roots = stored(components(edges), "roots")
    classed = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(looked_up(classed, stored(smallest, "smallest"), "root", "fp").select("fp", "component_id"), "named")
    # A fingerprint that very many rows share is one row of ``named``; its rows are dealt over salts.
    return looked_up(prints, named, "fp", "doc_id").select("doc_id", "fp", "component_id")


def _differing(common: int, one: int, other: int) -> float:
    """Share of bits that differ between the fingerprints of two sets with ``common`` shingles and ``one``, ``other`` of their own."""

    def coins(n: int) -> np.ndarray:
        return np.array([comb(n, k) / 2**n for k in range(n + 1)])

    # above[m]: chance that a set of common + x shingles has its bit set if m of the common ones have it.
    def above(x: int) -> np.ndarray:
        p = coins(x)
        return np.array([p[max(0, (common + x) // 2 - m + 1) :].sum() for m in range(common + 1)])

    p, q = above(one), above(other)
    return float((coins(common) * (p * (1 - q) + q * (1 - p))).sum())


def radii(similarity: float, bits: int, sigmas: float = 4.0, exact: int = 64) -> np.ndarray:
    """Radius by set size: ``sigmas`` standard deviations above the expected distance of two sets ``similarity`` alike.

    The bits of a fingerprint are independent, so a distance is binomial. Its share is counted out for sets of
    up to ``exact`` shingles, where ties count as 0 (worst over the sizes of the other set); the last entry, for all larger ones,
    is the greater of the limit arccos(2 s / (1 + s)) / pi and the share at the largest sizes counted.
    """

    def worst(n: int) -> float:
        shares = [0.0]
        for other in range(ceil(n * similarity), floor(n / similarity) + 1):
            common = ceil(similarity * (n + other) / (1 + similarity) - 1e-9)
            if 0 < common <= min(n, other):
                shares.append(_differing(common, n - common, other - common))
        return max(shares)

    shares = [0.0, *(worst(n) for n in range(1, exact + 1))]
    shares.append(max(float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), *shares[-8:]))
    return np.array([ceil(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5) for p in shares])


def _family_shards(held: DataFrame, similarity: float, block: int) -> DataFrame:
    """``held`` (node, n, shingles, ...; value is the family) with the band and value of each shard that a set goes to.

    A family of at most ``block`` hashes is one shard. In a larger one, sets that are ``similarity`` alike share one of the first
    n - ceil(similarity n) + 1 shingles of each, the family's rarest first: each such shingle that two sets share is a shard (once, if the same sets share several), so
    a set is copied at most once for each of its own, however large the family, and a set without one is alike to none.
    Where that copies more hashes than all pairs of blocks do, the family stays one shard, which is cut into blocks. Both are exact.
    """
    load, copied = F.sum("n").alias("_load"), F.col("_load") * F.ceil(F.col("_load") / block)
    whole = held.withColumn("band", F.lit(0))
    large = stored(held.groupBy("value").agg(load).filter(F.col("_load") > block), "large_families")
    if not large.limit(1).count():
        return whole
    inside = looked_up(held.select("node", "n", "shingles", "value"), large.select("value"), "value", "node").dropDuplicates(["node"])
    words = inside.select("node", "n", F.col("value").alias("family"), F.explode("shingles").alias("_shingle"))
    words = words.select("node", "n", "family", F.xxhash64("family", "_shingle").alias("value"))
    common = stored(words.groupBy("value").agg(F.count(F.lit(1)).alias("_held")).filter("_held > 1"), "common_shingles")
    # Shingles of one set only come first in every order, so their number is all that counts.
    own = Window.partitionBy("node")
    ranked = looked_up(words, common, "value", "node").select(
        "node", "n", "family", "value", F.row_number().over(own.orderBy("_held", "value")).alias("_rank"), F.count(F.lit(1)).over(own).alias("_common")
    )
    first = ranked.filter(F.col("_rank") <= F.col("_common") - F.ceil(similarity * F.col("n") - 1e-9) + 1)
    keys = stored(first.select("node", "n", "family", "value"), "prefixes")
    members = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"_members{seed}") for seed in (7, 8)]
    shards = keys.groupBy("family", "value").agg(F.count(F.lit(1)).alias("_n"), load, *members).filter("_n > 1")
    # Shards of the same sets say the same: one of them stays.
    shared = stored(shards.groupBy("family", "_n", "_load", "_members7", "_members8").agg(F.min("value").alias("value")), "shared_prefixes")
    costs = shared.groupBy("family").agg(F.sum(copied).alias("_cost")).withColumnRenamed("family", "value")
    parted = stored(large.join(costs, "value", "left").filter(F.coalesce("_cost", F.lit(0)) < copied).select("value"), "parted_families")
    kept = stored(shared.join(join_side(parted.withColumnRenamed("value", "family")), "family", "left_semi").select("value"), "prefix_shards")
    own_sets = looked_up(held, parted, "value", "node").drop("value")
    dealt = looked_up(keys, kept, "value", "node").select("node", "value").join(own_sets, "node").withColumn("band", F.lit(1))
    return whole.join(join_side(parted), "value", "left_anti").unionByName(dealt)


def near_copies(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 4, bands: int = 10, rows: int = 3, seed: int = 42, block: int = 4096, task_rows: int = 1 << 15,
    shingles: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, component_id over links between texts whose sets of shingles are ``similarity`` alike (Jaccard) or more.

    Fingerprints of ``64 * words`` bits only propose pairs, within four standard deviations of their distance at
    ``similarity`` (``radii``); a pair links by its common shingles (64-bit hashes). Bands of so long fingerprints
    would not part them, so the shards of the BK-trees are min-hash keys: a pair at 0.8 shares one of 10 keys of
    3 minima with probability 0.999. Proposed pairs make families; the sets of shingles of a family of up to ``shingles``
    hashes come together once, those of a larger one by the rare shingles that they share (``_family_shards``), and its
    proposed pairs are checked there. Edge cases are those of
    ``near_duplicates``; a text without a word has the empty set, which is alike to itself only.
    """
    prints = stored(fingerprints(docs, width, seed, id_col, text_col, words, bands, rows, sets=True), "fingerprints")
    names = ["fp", *(f"fp{v}" for v in range(1, words))]
    radius = radii(similarity, 64 * words)
    classes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "bands", *names))), "classes")
    keyed = classes.select("node", "n", *names, F.posexplode("bands").alias("band", "value"))
    proposed = stored(_dealt_shards(keyed, ["n", *names], block, task_rows).applyInPandas(lambda x: _shard_forest(x, names, radius, similarity), "a long, b long").distinct(), "proposed")
    families = stored(components(proposed).select(F.col("fp").alias("node"), F.col("root").alias("value")), "families")
    members = stored(families.join(classes.drop("bands"), "node"), "members")
    # The row with a node's smallest id has its text; rows that repeat the id with another text have other nodes.
    wanted = stored(members.select(F.col("least").alias("_least")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(join_side(wanted), F.col("_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = _shingle_sets(texts, width, seed, "_id", "_text").join(join_side(members.select("node", "n", "value", *names)), "node")
    held = stored(sets.select("node", "shingles", "n", *names, "value"), "shingles")
    dealt = _dealt_shards(_family_shards(held, similarity, shingles), ["n", *names, "shingles"], shingles, shingles // 4, weight="n")
    edges = stored(dealt.applyInPandas(lambda x: _family_links(x, names, radius, similarity), "a long, b long").distinct(), "links")
    roots = stored(components(edges).select(F.col("fp").alias("node"), "root"), "roots")
    rooted = classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = stored(looked_up(rooted, smallest, "root", "node").select("node", "component_id"), "named")
    return looked_up(prints.select("doc_id", "node"), named, "node", "doc_id").select("doc_id", "component_id")

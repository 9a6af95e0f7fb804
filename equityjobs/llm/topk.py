"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to the cells of a few sampled centres, large cells to blocks of bounded size, and each block is
indexed by a cover tree: a node is a point with its covering radius, its children are points of it that are more
than half that radius apart and cover the rest, so a child's radius is at most half of its parent's. Queries are
indexed the same way. A pair of nodes is dropped when no inner product between them can reach the worst k-th
score of the node's queries:

    <q, x> <= <cq, cx> + |cq| rx + |cx| rq + rq rx   for q within rq of cq and x within rx of cx.

The same bound drops whole cells for a block of queries, once a first block has given its queries k scores.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityjobs.llm.shared import stored

#: Points of a node that is not split, and leaves that one query node meets at once.
LEAF, MEET = 8, 512
#: A node is not split either if it would have more children than this and fewer than two points in each on average.
FLAT = 256
_LEAST = np.iinfo("int64").min
_NO_ID = np.iinfo("int64").max


@dataclass
class CoverTree:
    """Points in tree order; the points and the children of a node are ranges, the root is node 0."""

    ids: np.ndarray
    points: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child_low: np.ndarray
    child_high: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        x = points.astype("f8")

        def distances(members: np.ndarray, point: np.ndarray) -> np.ndarray:
            gap = x[members] - point
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        everyone = np.arange(len(ids))
        middle = int(distances(everyone, x.mean(axis=0)).argmin())
        nodes, order, children = [(everyone, middle, distances(everyone, x[middle]), 0)], np.empty(len(ids), int), []
        for members, centre, far, start in nodes:  # grows while it is read
            radius, first = far.max(), len(nodes)
            net, nearest, owner = [centre], far.copy(), np.zeros(len(members), int)
            ends = len(members) <= leaf or radius == 0
            while not ends and (bare := nearest > radius / 2).any():
                net.append(int(members[bare.argmax()]))  # the first that is not covered
                d = distances(members, x[net[-1]])
                closer = d < nearest
                nearest[closer], owner[closer] = d[closer], len(net) - 1
                # Children of less than two points on average have bounds that cost more than they can save.
                ends = len(net) > FLAT and 2 * len(net) > len(members)
            if ends:
                order[start : start + len(members)] = members
            else:
                sort = np.argsort(owner, kind="stable")
                for point, part in zip(net, np.split(sort, np.cumsum(np.bincount(owner, minlength=len(net)))[:-1])):
                    nodes.append((members[part], point, nearest[part], start))
                    start += len(part)
            children.append((first, len(nodes)))
        low = np.array([n[3] for n in nodes])
        # Rounding of the distances must not make a radius too small.
        radii = np.array([n[2].max() for n in nodes]) * (1 + 1e-12)
        child_low, child_high = np.array(children).T
        return cls(ids[order], points[order], x[[n[1] for n in nodes]], radii, low, low + np.array([len(n[0]) for n in nodes]), child_low, child_high)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CoverTree:
        with np.load(io.BytesIO(raw)) as parts:
            return cls(**{k: parts[k] for k in parts.files})

    def is_leaf(self, nodes: np.ndarray) -> np.ndarray:
        return self.child_low[nodes] == self.child_high[nodes]

    def below(self, node: int) -> np.ndarray:
        """The children of the node; a leaf itself."""
        return np.arange(self.child_low[node], self.child_high[node]) if self.child_low[node] < self.child_high[node] else np.array([node])

    def rows_of(self, nodes: np.ndarray) -> np.ndarray:
        size = self.high[nodes] - self.low[nodes]
        return np.repeat(self.low[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as wide as the wider one, and as doubles where inner products of such integers are exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (a, b))
    most = float(np.abs(a.astype("f8")).max(initial=0)) * float(np.abs(b.astype("f8")).max(initial=0)) * width
    if most >= 2**63:
        raise OverflowError("scores of these vectors may not fit into 64 bits")
    return (a.astype("f8"), b.astype("f8")) if most < 2**53 else (a, b)


def _bounds(cq: np.ndarray, rq: np.ndarray, cx: np.ndarray, rx: np.ndarray) -> np.ndarray:
    """No inner product between the balls (row, column) is larger; with room for rounding."""
    width = max(cq.shape[1], cx.shape[1])
    cq, cx = (np.pad(c, ((0, 0), (0, width - c.shape[1]))) for c in (cq, cx))
    nq, nx = np.sqrt((cq**2).sum(axis=1))[:, None], np.sqrt((cx**2).sum(axis=1))[None]
    rq, rx = rq[:, None], rx[None]
    return cq @ cx.T + nq * rx + nx * rq + rq * rx + 1e-9 * ((nq + rq) * (nx + rx)) + 1e-6


class Search:
    """Running top k of the queries of one tree over any number of data trees; scores under ``floor`` are of no use.

    ``compared`` counts the inner products that were taken: of queries with rows, and of centres for the bounds.
    """

    def __init__(self, queries: CoverTree, k: int, floor: np.ndarray | None = None) -> None:
        self.q, self.k, self.compared = queries, k, 0
        n = len(queries.ids)
        self.floor = np.full(n, _LEAST) if floor is None else floor
        self.scores = np.full((n, k), _LEAST)
        self.found = np.full((n, k), _NO_ID)

    def _worst(self, nodes: np.ndarray) -> np.ndarray:
        """The least score that is of use to any query of each node."""
        rows = self.q.rows_of(nodes)
        size = self.q.high[nodes] - self.q.low[nodes]
        return np.minimum.reduceat(np.maximum(self.scores[rows, -1], self.floor[rows]), np.cumsum(size) - size)

    def add(self, data: CoverTree) -> None:
        q = self.q
        asked, held = _comparable(q.points, data.points)
        pending = [(np.inf, 0, 0)]
        while pending:
            bound, i, j = pending.pop()
            if bound < self._worst(np.array([i]))[0]:
                continue
            a, b = q.below(i), data.below(j)
            bounds = _bounds(q.centres[a], q.radii[a], data.centres[b], data.radii[b])
            self.compared += bounds.size
            ends, stops = q.is_leaf(a), data.is_leaf(b)
            if ends.any() and stops.any():
                self._meet(a[ends], b[stops], bounds[np.ix_(ends, stops)], data, asked, held)
            open_ = (bounds >= self._worst(a)[:, None]) & ~(ends[:, None] & stops[None])
            row, col = np.nonzero(open_)
            best = np.argsort(bounds[row, col], kind="stable")  # the most promising is popped first
            pending += list(zip(bounds[row, col][best].tolist(), a[row[best]].tolist(), b[col[best]].tolist()))

    def _meet(self, a: np.ndarray, b: np.ndarray, bounds: np.ndarray, data: CoverTree, asked: np.ndarray, held: np.ndarray) -> None:
        """Leaves ``a`` of the queries against leaves ``b`` of the data, from the most promising on."""
        order = np.argsort(-bounds.max(axis=0), kind="stable")
        for first in range(0, len(order), MEET):
            cols = order[first : first + MEET]
            use = bounds[:, cols] >= self._worst(a)[:, None]
            if not use.any():
                if first:
                    break  # all later leaves have lower bounds
                continue
            self._compare(self.q.rows_of(a[use.any(axis=1)]), data.rows_of(b[cols[use.any(axis=0)]]), data, asked, held)

    def _compare(self, rows: np.ndarray, cols: np.ndarray, data: CoverTree, asked: np.ndarray, held: np.ndarray) -> None:
        s = (asked[rows] @ held[cols].T).astype("int64", copy=False)
        self.compared += s.size
        ids = data.ids[cols]
        s[ids[None] == self.q.ids[rows][:, None]] = _LEAST
        least = np.maximum(self.scores[rows, -1], self.floor[rows])
        if len(cols) > self.k:
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((s >= least[:, None]) & (s > _LEAST))
        if not len(row):
            return
        touched, r = np.unique(row, return_inverse=True)
        at = rows[touched]
        owner = np.concatenate([r, np.repeat(np.arange(len(touched)), self.k)])
        score = np.concatenate([s[row, col], self.scores[at].ravel()])
        ident = np.concatenate([ids[col], self.found[at].ravel()])
        order = np.lexsort((ident, ~score, owner))  # ~ turns the order of integers around
        starts = np.searchsorted(owner[order], np.arange(len(touched)))
        pick = order[starts[:, None] + np.arange(self.k)]
        self.scores[at], self.found[at] = score[pick], ident[pick]

    def rows(self) -> pd.DataFrame:
        there = self.found < _NO_ID
        return pd.DataFrame({"query_id": np.repeat(self.q.ids, self.k)[there.ravel()], "vec_id": self.found[there], "score": self.scores[there]})


def scaled(vectors: DataFrame, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(factor * x) of each component; rows that are null or hold null or non-finite ones are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(vectors: list, width: int = 0) -> np.ndarray:
    """The vectors as rows, padded with zeros to the widest one or to ``width``."""
    widths = {len(v) for v in vectors} | {width}
    if len(widths - {0}) == 1 and 0 not in {len(v) for v in vectors}:
        return np.array(vectors, "int64")
    width = max(widths)
    return np.stack([np.pad(np.asarray(v, "int64"), (0, width - len(v))) for v in vectors]) if len(vectors) else np.zeros((0, width), "int64")


def _centres(rows: DataFrame, cells: int, sample: int) -> np.ndarray:
    """At most ``cells`` of at most ``sample`` rows (by hash) as centres, each the farthest from those before it."""
    drawn = _matrix([r["v"] for r in rows.orderBy(F.xxhash64(F.lit(23), "vec_id"), "vec_id", "v").limit(sample).collect()]).astype("f8")
    picked, nearest = [0], np.full(len(drawn), np.inf)
    while len(picked) < cells:
        nearest = np.minimum(nearest, ((drawn - drawn[picked[-1]]) ** 2).sum(axis=1))
        if not nearest.max() > 0:
            break
        picked.append(int(nearest.argmax()))
    return drawn[picked]


def _celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with cell, the nearest centre, and its distance."""

    @F.arrow_udf("struct<cell:int,distance:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = _matrix([v.values.to_numpy() for v in vectors], centres.shape[1]).astype("f8")
        c = np.pad(centres, ((0, 0), (0, x.shape[1] - centres.shape[1])))
        cell = ((c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(cell.astype("int32")), pa.array(far)], ["cell", "distance"])

    return rows.withColumn("_near", nearest("v")).select("vec_id", "v", "_near.cell", "_near.distance")


def _trees(celled: DataFrame, block_rows: int, name: str) -> tuple[DataFrame, list]:
    """(cell, block, tree): a cover tree for each block of about ``block_rows`` rows of a cell; and (cell, blocks, radius) of the cells."""
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # one row for each centre

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree.build(part["vec_id"].to_numpy(), _matrix(part["v"].to_list()))
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "block": part["block"].iloc[:1], "tree": [tree.to_bytes()], "centre": [tree.centres[0]], "radius": tree.radii[:1]})

    blocks = {r["cell"]: -(-r["n"] // block_rows) for r in cells}
    many = F.element_at(F.create_map(*[F.lit(int(x)) for c, n in blocks.items() for x in (c, n)]), F.col("cell")) if blocks else F.lit(1)
    dealt = celled.select("vec_id", "v", "cell", F.pmod(F.xxhash64(F.lit(11), "vec_id"), many).cast("int").alias("block"))
    built = dealt.groupBy("cell", "block").applyInPandas(build, "cell int, block int, tree binary, centre array<double>, radius double")
    return stored(built, name), [(r["cell"], blocks[r["cell"]], r["radius"]) for r in cells]


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, block_rows: int = 4096, query_rows: int = 1024, run: int = 4, cells: int = 256, sample: int = 1024, stats: bool = False,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each query over all other rows.

    ``vectors`` has vec_id and v (an array of long); ``queries`` says which rows ask. Ties go to the smaller
    vec_id; a query with fewer candidates gets all of them. Scores that may not fit into 64 bits are an error. A repeated
    vec_id is a candidate row each time for other ids and asks once, with its smallest vector. A shorter vector counts
    as padded with zeros. Empty tables give no rows. Other columns are ignored. ``cells`` (at most) and ``sample``, the
    rows that centres are picked from, bound what is at the driver and decide speed only. With ``stats``:
    asks, compared (inner products taken, those of the bounds included) instead, a row for each task.
    """
    rows = stored(vectors.select("vec_id", "v"), "vectors")
    total = rows.count()
    schema = "asks long, compared long" if stats else "query_id long, vec_id long, score long"
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long" if not stats else schema)
    asking = rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    centres = _centres(rows, min(cells, max(1, total // block_rows)), sample)
    data, held = _trees(stored(_celled(rows, centres), "celled"), block_rows, "data_trees")
    asking = stored(asking, "asking")
    asks, _ = _trees(stored(_celled(asking, centres[: max(1, asking.count() // query_rows)]), "asking_celled"), query_rows, "query_trees")
    number, counts, radii = (np.array(x) for x in zip(*sorted(held)))
    balls = centres[number], radii

    # A block of queries first meets one block of the cell that promises most, which gives its queries a floor.
    @F.arrow_udf("array<double>")
    def promised(centre: pa.Array, radius: pa.Array) -> pa.Array:
        bounds = _bounds(np.stack(centre.to_numpy(zero_copy_only=False)), radius.to_numpy(zero_copy_only=False), *balls)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bounds) + 1, dtype="int32") * bounds.shape[1]), pa.array(bounds.ravel()))

    bounded = stored(asks.withColumn("bounds", promised("centre", "radius")), "bounds")
    table = F.array(*[F.struct(F.lit(int(c)).alias("cell"), F.lit(int(n)).alias("n")) for c, n in zip(number, counts)])
    met = F.transform(table, lambda x, i: F.struct(x["cell"].alias("cell"), x["n"].alias("n"), F.get("bounds", i).alias("bound")))
    ask = F.struct("cell", "block").alias("ask")
    wide = bounded.select(ask, F.explode(met).alias("_met")).select("ask", "_met.*")
    best = wide.groupBy("ask").agg(F.max_by("cell", F.struct("bound", "cell")).alias("cell"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["head", "bound"], ascending=False)
        if not group["head"].iloc[0]:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype="int64")
        tree = CoverTree.from_bytes(group["tree"].iloc[0])
        floor = group["floor"].iloc[0]
        found = Search(tree, k, None if floor is None or not len(floor) else np.frombuffer(floor, "int64"))
        for raw in group["tree"].iloc[1:]:
            found.add(CoverTree.from_bytes(raw))
        return pd.DataFrame({"asks": [len(tree.ids)], "compared": [found.compared]}) if stats else found.rows()

    def floors(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("head", ascending=False)
        found = Search(CoverTree.from_bytes(group["tree"].iloc[0]), k)
        for raw in group["tree"].iloc[1:]:
            found.add(CoverTree.from_bytes(raw))
        worst = found.scores[:, -1]
        return pd.DataFrame({"cell": [group["ask"].iloc[0]["cell"]], "block": [group["ask"].iloc[0]["block"]], "floor": [worst.tobytes()], "worst": [int(worst.min())]})

    heads = bounded.select(ask, "tree", F.lit(True).alias("head"))
    first = best.withColumn("block", F.lit(0)).join(data, ["cell", "block"]).select("ask", "tree", F.lit(False).alias("head"))
    floor = stored(heads.unionByName(first).groupBy("ask").applyInPandas(floors, "cell int, block int, floor binary, worst long"), "floors")
    floor = floor.select(ask, "floor", "worst")
    # Then it meets every block of the cells whose bound reaches the worst of its floors; ``run`` blocks are a task.
    left = wide.join(floor.select("ask", "worst"), "ask").filter(F.col("bound") >= F.col("worst"))
    pairs = left.select("ask", "cell", "bound", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    lap = F.floor((F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("bound"), "cell", "block")) - 1) / run).cast("int")
    pairs = stored(pairs.withColumn("lap", lap), "pairs")
    blocks = pairs.join(data.select("cell", "block", "tree"), ["cell", "block"]).select("ask", "lap", "bound", "tree", F.lit(False).alias("head"), F.lit(None).cast("binary").alias("floor"))
    laps = pairs.select("ask", "lap").distinct()
    asked = laps.join(bounded.select(ask, "tree"), "ask").join(floor.select("ask", "floor"), "ask").select("ask", "lap", F.lit(0.0).alias("bound"), "tree", F.lit(True).alias("head"), "floor")
    best = blocks.unionByName(asked).groupBy("ask", "lap").applyInPandas(search, schema)
    if stats:
        return best
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

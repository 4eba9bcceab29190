"""Problem 3: the most similar vectors of every vector, by randomly rotated one-bit codes.

1. Valid vectors are parsed once and stored packed (exactly: as 16-bit integers
   where all numbers have at most four decimals, else as doubles). Exact copies
   are one vector until the end, so a group of copies of any size costs nothing.
2. A tree of centroids cuts the collection into cells of about ``CELL`` vectors,
   however many there are: the root is fitted on a bounded sample, and cells that
   turn out too large are cut again, each by a fit on a bounded sample of its own.
   Centroids that are nearly parallel cut one dense region at random, so they are
   joined to one cell; a cell that consists of such a region alone stays whole.
3. Every vector goes to the ``PROBES`` cells nearest to it. The cells' true sizes
   are counted; a cell that is too large for one task is cut into blocks, and each
   pair of its blocks is a task.
4. In a task the vectors are centred and rotated; the signs of the rotated
   residual, packed into 64-bit words, and two scalars are a vector's code. Bits
   that differ between two codes, counted word by word, estimate the angle and so
   the inner product; its upper error bound decides who is reranked by the exact
   cosine, against the exact cosines of the k best by estimate.
5. The best k of all tasks are the neighbours.

Nothing is dropped: the index holds every vector, and a cell's candidates have no
cap. A dense region is compared with itself in full, block by block.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weftlight.plans.joins import sized_join
from weftlight.plans.lineage import written
from weftlight.plans.spread import spread

#: Numbers of a valid vector.
DIMENSIONS = 384
#: Vectors that one node of the tree is fitted on, at most about this many.
FIT_VECTORS = 16_384
#: Vectors that a cell should have, and the multiple of it from which a cell is cut again.
CELL, TOO_LARGE = 512, 3
#: Vectors of the sample for each centroid of a node.
FIT_EACH = 32
#: Cells that each vector is put into.
PROBES = 3
#: Centroids with at least this cosine belong to one cell.
SAME_REGION = 0.9
#: Vectors of one block of a large cell.
BLOCK = 16_384
#: Bytes of vectors that a task should read, besides one pair of blocks.
TASK_BYTES = 32 << 20
#: Width of the error bound in standard deviations.
BOUND = 2.5
#: Share of pairs within the bounds from which one matrix product is cheaper than pairs.
DENSE_PAIRS = 0.2
#: Rows of one matrix product while fitting and placing.
STEP = 1024
_SEED = 20_011


def parse_vector(text: str | None, dimensions: int) -> np.ndarray | None:
    """The vector of a JSON list, or None if it is not a list of that many finite numbers, not all zero."""
    if not text or text.count(",") != dimensions - 1:
        return None
    try:
        numbers = json.loads(text)
        if not isinstance(numbers, list) or not all(type(x) in (int, float) for x in (numbers[0], numbers[-1])):
            return None
        v = np.array(numbers)
    except (ValueError, TypeError, OverflowError, RecursionError):
        return None
    if v.shape != (dimensions,) or v.dtype.kind not in "if":
        return None
    v = v.astype(np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def packed(v: np.ndarray) -> bytes:
    """Exact bytes: 16-bit integers of ten-thousandths where that is lossless, else doubles."""
    scaled = np.round(v * 1e4)
    if np.abs(scaled).max() < 32_000 and (scaled / 1e4 == v).all():
        return scaled.astype("<i2").tobytes()
    return v.astype("<f8").tobytes()


def valid_vectors(page_embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(page_id, payload): the valid vector of each page.

    A page counts once: of several valid vectors the newest, then the larger bytes.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            vectors = [parse_vector(t, dimensions) for t in frame["embedding"]]
            ok = np.fromiter((v is not None for v in vectors), bool, len(vectors))
            yield pd.DataFrame({
                "page_id": frame["page_id"][ok], "created_at": frame["created_at"][ok],
                "payload": [packed(v) for v in vectors if v is not None],
            })

    parsed = (
        spread(
            page_embeddings.filter("page_id is not null and embedding is not null")
            .select("page_id", F.col("created_at").cast("timestamp").alias("created_at"), "embedding")
        ).mapInPandas(parse, "page_id long, created_at timestamp, payload binary")
    )
    return parsed.groupBy("page_id").agg(F.max(F.struct("created_at", "payload"))["payload"].alias("payload"))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(_SEED)
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        fresh = np.zeros_like(centroids)
        for i in range(0, len(sample), STEP):  # piece by piece: the sample is never copied whole
            part = sample[i : i + STEP]
            nearest = (part @ centroids.T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(nearest[order]) > 0])
            fresh[nearest[order][starts]] += np.add.reduceat(part[order], starts)
        empty = ~fresh.any(axis=1)
        fresh[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centroids = fresh / np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
    return centroids


def joined_cells(centroids: np.ndarray, same: float = SAME_REGION) -> np.ndarray:
    """The cell of each centroid: nearly parallel centroids share one."""
    label = np.arange(len(centroids))
    alike = centroids @ centroids.T >= same
    while True:
        fresh = np.where(alike, label[None, :], len(label)).min(axis=1)
        fresh = np.minimum(fresh, label)
        if (fresh == label).all():
            break
        label = fresh
    return np.unique(label, return_inverse=True)[1]


class Tree:
    """Centroids in nodes; a centroid leads to a cell or, where that was cut again, to a further node."""

    def __init__(self):
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        self.cells = 0
        #: cells that are one dense region
        self.dense: set[int] = set()

    def add(self, centroids: np.ndarray, cell: np.ndarray, instead_of: int | None = None) -> None:
        """Adds a node whose centroids lead to new cells, in the place of a cell."""
        if instead_of is not None:
            if int(cell.max()) == 0:
                self.dense.add(instead_of)
                return
            for _, leads in self.nodes:
                leads[leads == instead_of] = ~len(self.nodes)
        self.nodes.append((centroids.astype(np.float32), cell.astype(np.int64) + self.cells))
        self.cells += int(cell.max()) + 1

    def _near(self, node: int, vectors: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(targets, cosines) of the nearest targets of a node, -1e9 as the cosine where there are fewer."""
        centroids, leads = self.nodes[node]
        order = np.argsort(leads, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(leads[order]) != 0])
        best = np.maximum.reduceat((vectors @ centroids.T)[:, order], starts, axis=1)
        targets = leads[order][starts]
        if len(targets) <= probes:
            return np.broadcast_to(targets, best.shape), best
        top = np.argpartition(-best, probes - 1, axis=1)[:, :probes]
        return targets[top], np.take_along_axis(best, top, 1)

    def nearest(self, vectors: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the at most ``probes`` nearest cells of each vector; rows ascend, the nearest cell comes first."""
        rows, targets, cosines = [], [], []
        waiting = {0: np.arange(len(vectors))}
        while waiting:
            node, at = waiting.popitem()
            found, near = self._near(node, vectors[at], probes)
            row = np.repeat(at, found.shape[1])
            found, near = found.ravel(), near.ravel()
            leaf = found >= 0
            rows.append(row[leaf])
            targets.append(found[leaf])
            cosines.append(near[leaf])
            for further in np.unique(found[~leaf]):
                waiting[int(~further)] = row[found == further]
        row, target, cosine = (np.concatenate(x) for x in (rows, targets, cosines))
        order = np.lexsort((target, -cosine, row))
        row, target = row[order], target[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < probes
        return row[kept], target[kept]


def fitted_node(sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the cell of each) of about ``k`` cells of a sample."""
    centroids = fit_centroids(sample, max(1, min(k, len(sample))))
    return centroids, joined_cells(centroids)


def cell_counts(vectors: DataFrame, tree: Tree, dimensions: int, probes: int) -> pd.DataFrame:
    """(cell, nearest, placed): how many vectors have a cell as their nearest one, and as one of their ``probes`` nearest."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it = sent.value
        nearest, placed = np.zeros(it.cells, np.int64), np.zeros(it.cells, np.int64)
        for frame in batches:
            row, cell = it.nearest(Vectors(list(frame["payload"]), dimensions).unit, probes)
            nearest += np.bincount(cell[np.r_[True, np.diff(row) > 0]], minlength=it.cells)
            placed += np.bincount(cell, minlength=it.cells)
        some = np.flatnonzero(placed)
        yield pd.DataFrame({"cell": some, "nearest": nearest[some], "placed": placed[some]})

    found = vectors.select("payload").mapInPandas(count, "cell long, nearest long, placed long")
    return found.groupBy("cell").agg(F.sum("nearest").alias("nearest"), F.sum("placed").alias("placed")).toPandas()  # one row per cell


def grown_tree(vectors: DataFrame, total: int, dimensions: int, fit_vectors: int, probes: int, cell_size: int) -> tuple[Tree, pd.DataFrame]:
    """The tree of (page_id, payload), and the counts of its cells."""
    spark = vectors.sparkSession
    most = max(2, fit_vectors // FIT_EACH)
    part = F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) / 1_000_003.0
    share = min(1.0, fit_vectors / max(total, 1))
    fit = (vectors if share >= 1 else vectors.filter(part < share)).toPandas().sort_values("page_id")  # bounded by fit_vectors
    if not len(fit):
        fit = vectors.limit(1).toPandas()
    tree = Tree()
    tree.add(*fitted_node(Vectors(list(fit["payload"]), dimensions).unit, min(most, math.ceil(total / cell_size))))
    del fit
    while True:
        counts = cell_counts(vectors, tree, dimensions, probes)
        large = {int(c): int(n) for c, n in zip(counts["cell"], counts["nearest"], strict=True) if n > TOO_LARGE * cell_size and int(c) not in tree.dense}
        if not large:
            return tree, counts
        sent = spark.sparkContext.broadcast((tree, large))

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            it, wanted = sent.value  # noqa: B023 - the batches are read before the next round
            rate = np.zeros(it.cells)
            rate[list(wanted)] = [min(1.0, fit_vectors / n) for n in wanted.values()]
            for frame in batches:
                _, cell = it.nearest(Vectors(list(frame["payload"]), dimensions).unit, 1)
                kept = frame["part"].to_numpy() < rate[cell]
                yield pd.DataFrame({"cell": cell[kept], "page_id": frame["page_id"].to_numpy()[kept], "payload": frame["payload"].to_numpy()[kept]})

        def fit_cell(frame: pd.DataFrame) -> pd.DataFrame:
            _, wanted = sent.value  # noqa: B023
            cell = int(frame["cell"].iloc[0])
            sample = Vectors(list(frame.sort_values("page_id")["payload"]), dimensions).unit
            centroids, joined = fitted_node(sample, min(most, max(2, math.ceil(wanted[cell] / cell_size))))
            return pd.DataFrame({"cell": [cell], "centroids": [centroids.astype("<f4").tobytes()], "joined": [joined.tolist()]})

        chosen = vectors.select("page_id", "payload", part.alias("part")).mapInPandas(members, "cell long, page_id long, payload binary")
        fits = chosen.groupBy("cell").applyInPandas(fit_cell, "cell long, centroids binary, joined array<long>")
        cells = tree.cells
        for r in sorted(fits.collect(), key=lambda r: r["cell"]):  # the centroids of the cells that are cut again
            tree.add(np.frombuffer(r["centroids"], "<f4").reshape(-1, dimensions), np.array(r["joined"]), r["cell"])
        if tree.cells == cells:
            return tree, counts


def rotation(dimensions: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


class Vectors:
    """Packed vectors: their exact numbers, lengths, and the unit vectors in single precision."""

    def __init__(self, payloads: list[bytes], dimensions: int):
        short = np.fromiter((len(p) == 2 * dimensions for p in payloads), bool, len(payloads))
        if short.all():
            self.raw = np.frombuffer(b"".join(payloads), "<i2").reshape(-1, dimensions)
        else:
            self.raw = np.empty((len(payloads), dimensions))
            if short.any():
                self.raw[short] = np.frombuffer(b"".join(p for p, s in zip(payloads, short, strict=True) if s), "<i2").reshape(-1, dimensions)
            long = np.frombuffer(b"".join(p for p, s in zip(payloads, short, strict=True) if not s), "<f8").reshape(-1, dimensions)
            self.raw[~short] = long / np.abs(long).max(axis=1, keepdims=True)
        self.length = np.concatenate([np.zeros(0), *(np.linalg.norm(self.raw[i : i + STEP].astype(np.float64), axis=1) for i in range(0, len(self.raw), STEP))])
        self.unit = self.raw.astype(np.float32)
        self.unit /= self.length[:, None].astype(np.float32)

    def cosines(self, mine: np.ndarray, other: Vectors, theirs: np.ndarray) -> np.ndarray:
        """The exact cosines of pairs of rows."""
        out = [
            np.einsum("ij,ij->i", self.raw[mine[i : i + 4 * STEP]].astype(np.float64), other.raw[theirs[i : i + 4 * STEP]].astype(np.float64))
            for i in range(0, len(mine), 4 * STEP)
        ]
        return np.concatenate([np.zeros(0), *out]) / (self.length[mine] * other.length[theirs])


class Codes:
    """One-bit codes of unit vectors around a centre: packed signs, the residual's length and its product with the centre."""

    def __init__(self, unit: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        residual = unit - centre
        self.length = np.linalg.norm(residual, axis=1).astype(np.float32)
        self.centre_dot = (residual @ centre).astype(np.float32)
        bits = np.packbits(residual @ turn >= 0, axis=1)
        words = -(-bits.shape[1] // 8)
        self.words = np.zeros((len(unit), 8 * words), np.uint8)
        self.words[:, : bits.shape[1]] = bits
        self.words = self.words.view(np.uint64)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which each code of ``a`` differs from each of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def cosine_bounds(dimensions: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, upper bound) of the cosine of two residuals, by the number of their codes' differing bits."""
    p = np.arange(dimensions + 1) / dimensions
    width = bound * np.sqrt(np.maximum(p * (1 - p), 1 / dimensions) / dimensions)
    return np.cos(np.pi * p).astype(np.float32), np.cos(np.pi * np.maximum(p - width, 0)).astype(np.float32)


def best_in_task(
    ids: np.ndarray, mine: Vectors, other_ids: np.ndarray, other: Vectors, centre: np.ndarray, turn: np.ndarray, k: int, bound: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``ids`` its k most similar of ``other_ids`` (never itself): ids, neighbours, cosines."""
    dimensions = mine.unit.shape[1]
    _, upper_of = cosine_bounds(dimensions, bound)
    asking, codes = Codes(mine.unit, centre, turn), Codes(other.unit, centre, turn)
    to_centre = (mine.unit @ centre).astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, min(256, (1 << 20) // max(1, len(other_ids))))
    by_codes = True
    for a in range(0, len(ids), step):
        z = slice(a, min(a + step, len(ids)))
        here = np.arange(z.start, z.stop)
        itself = ids[z, None] == other_ids[None, :]
        few = min(k, len(other_ids))
        row = None
        if by_codes:
            # <o, q> = <o - c, q - c> + <o - c, c> + <q, c>
            upper = upper_of[differing_bits(asking.words[z], codes.words)]
            upper *= codes.length
            upper *= asking.length[z, None]
            upper += codes.centre_dot
            upper += to_centre[z, None]
            upper[itself] = -9
            first = np.argpartition(-upper, few - 1, axis=1)[:, :few]
            floor = mine.cosines(np.repeat(here, few), other, first.ravel()).reshape(first.shape)
            floor[np.take_along_axis(itself, first, 1)] = -9
            keep = (upper >= floor.min(axis=1, keepdims=True) - 1e-6) & ~itself
            row, col = np.nonzero(keep)
            by_codes = len(row) <= DENSE_PAIRS * keep.size
        if not by_codes:  # a dense region: the bounds part nobody there
            near = mine.unit[z] @ other.unit.T
            near[itself] = -9
            floor = np.partition(near, -few, axis=1)[:, -few, None]
            row, col = np.nonzero((near >= floor - 4e-6) & ~itself)
        exact = np.round(mine.cosines(z.start + row, other, col), 6)
        order = np.lexsort((other_ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((ids[z.start + row[top]], other_ids[col[top]], exact[top]))
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))  # type: ignore[return-value]


def copies_of(vectors: DataFrame) -> DataFrame:
    """(page_id, first): the pages whose vector others have too, byte by byte, with the smallest of their ids."""
    small = vectors.select("page_id", F.xxhash64("payload").alias("_a"), F.hash("payload").alias("_b"))
    shared = written(small.groupBy("_a", "_b").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1").drop("n"), "vector-copies")
    return sized_join(small, shared, ["_a", "_b"]).select("page_id", "first")


def nearest_neighbours(
    page_embeddings: DataFrame, k: int = 5, *, dimensions: int = DIMENSIONS, fit_vectors: int = FIT_VECTORS,
    probes: int = PROBES, block: int = BLOCK, bound: float = BOUND, cell_size: int = CELL,
) -> DataFrame:
    """(page_id, neighbour, cosine, rank): the k most similar pages of each page with a valid vector.

    Cosines are rounded to six decimals, ties go to the smaller id. Null ids,
    null, broken, short, zero or non-finite vectors take no part; an empty table
    gives no row; a page with fewer than k others has fewer rows.
    """
    spark = page_embeddings.sparkSession
    every = written(valid_vectors(page_embeddings.select("page_id", "embedding", "created_at"), dimensions), "vectors")
    schema = "page_id long, neighbour long, cosine double"
    if every.isEmpty():
        return spark.createDataFrame([], schema + ", rank int")
    copies = written(copies_of(every), "copies")
    again = copies.filter("page_id <> first").select("page_id")
    copied = again.count()
    vectors = sized_join(every, again, ["page_id"], "left_anti", right_rows=copied) if copied else every
    tree, counts = grown_tree(vectors, every.count() - copied, dimensions, fit_vectors, probes, cell_size)
    blocks = np.ones(tree.cells, np.int64)
    blocks[counts["cell"].to_numpy()] = np.ceil(counts["placed"].to_numpy() / block).astype(np.int64)
    index = spark.sparkContext.broadcast((tree, blocks))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it, blocks = index.value
        for frame in batches:
            for a in range(0, len(frame), STEP):
                part = frame.iloc[a : a + STEP]
                ids, payloads = part["page_id"].to_numpy(), part["payload"].to_numpy()
                row, cell = it.nearest(Vectors(list(payloads), dimensions).unit, probes)
                parts = blocks[cell]
                mine = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                # block i meets block j in the task (min, max); a cell of one block has the task (0, 0)
                many = np.repeat(np.arange(len(row)), parts)
                partner = np.arange(len(many)) - np.repeat(np.cumsum(parts) - parts, parts)
                own = mine[many]
                yield pd.DataFrame({
                    "cell": cell[many], "first": np.minimum(own, partner), "second": np.maximum(own, partner),
                    "own": own, "page_id": ids[row[many]], "payload": payloads[row[many]],
                })

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        ids, own = frame["page_id"].to_numpy(), frame["own"].to_numpy()
        turn = rotation_once(dimensions)
        first, second = int(frame["first"].iloc[0]), int(frame["second"].iloc[0])
        sides = [(ids[own == side], Vectors(list(frame["payload"][own == side]), dimensions)) for side in sorted({first, second})]
        sides = [side for side in sides if len(side[0])]
        centre = sum(v.unit.sum(axis=0, dtype=np.float64) for _, v in sides) / len(ids)
        pairs = [(sides[0], sides[0])] if first == second else [(sides[0], sides[1]), (sides[1], sides[0])] if len(sides) == 2 else []
        parts = [best_in_task(a[0], a[1], b[0], b[1], centre.astype(np.float32), turn, k, bound) for a, b in pairs]
        if not parts:
            return pd.DataFrame({"page_id": [], "neighbour": [], "cosine": []})
        page, other, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"page_id": page, "neighbour": other, "cosine": cosine})

    placed = vectors.mapInPandas(place, "cell long, first long, second long, own long, page_id long, payload binary")
    # a task reads about as much at any number of vectors
    shuffled = int((counts["placed"].to_numpy() * blocks[counts["cell"].to_numpy()]).sum()) * (2 * dimensions + 64)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shuffled / TASK_BYTES))
    keys = ["cell", "first", "second"]
    local = placed.repartition(parts, *keys).groupBy(*keys).applyInPandas(search, schema)
    # at most k rows of each task a page is in: a bounded list per page
    best = local.groupBy("page_id").agg(_best(k).alias("b"))
    if copied:
        best = _with_copies(written(best, "unlike-neighbours"), copies, k)
    return (
        best.select("page_id", F.posexplode("b").alias("pos", "n"))
        .select("page_id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.c")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
    )


def _best(k: int, cosine: str = "cosine", neighbour: str = "neighbour"):
    """The k best (negative cosine, neighbour) of a bounded group."""
    return F.slice(F.sort_array(F.collect_set(F.struct((-F.col(cosine)).alias("c"), F.col(neighbour).alias("neighbour")))), 1, k)


def _with_copies(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """The lists of all pages, from those of unlike vectors: a copy has its copies as neighbours, and stands beside each of them in other lists."""
    rank = Window.partitionBy("first").orderBy("page_id")
    some = copies.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= k + 1)  # limited before it is shuffled
    members = written(some.groupBy("first").agg(F.sort_array(F.collect_list("page_id")).alias("members")), "first-copies")
    each = best.select("page_id", F.explode("b").alias("n")).select("page_id", F.col("n.neighbour").alias("first"), (-F.col("n.c")).alias("cosine"))
    size = members.count()
    each = sized_join(each, members, ["first"], "left", right_rows=size)
    each = each.select("page_id", "cosine", F.explode(F.coalesce("members", F.array("first"))).alias("neighbour"))
    own = members.select(F.col("first").alias("page_id"), F.lit(1.0).alias("cosine"), F.explode("members").alias("neighbour"))
    # at most k lists of k + 1 copies: one more than k are kept, since a page is not its own neighbour
    lists = written(each.unionByName(own).groupBy("page_id").agg(_best(k + 1).alias("b")), "class-lists")
    of_copies = sized_join(copies, lists.join(members.select(F.col("first").alias("page_id")), "page_id", "left_semi").withColumnRenamed("page_id", "first"), ["first"], right_rows=size)
    single = lists.join(members.select(F.col("first").alias("page_id")), "page_id", "left_anti")
    every = single.unionByName(of_copies.select("page_id", "b"))
    return every.select("page_id", F.slice(F.filter("b", lambda n: n["neighbour"] != F.col("page_id")), 1, k).alias("b"))


_turns: dict[int, np.ndarray] = {}


def rotation_once(dimensions: int) -> np.ndarray:
    if dimensions not in _turns:
        _turns[dimensions] = rotation(dimensions).astype(np.float32)
    return _turns[dimensions]


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b), smaller first, each pair once."""
    return neighbours.select(
        F.least("page_id", "neighbour").alias("page_id_a"), F.greatest("page_id", "neighbour").alias("page_id_b")
    ).distinct()

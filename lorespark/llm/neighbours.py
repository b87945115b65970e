"""The k most similar vectors of every vector.

A forest of random-projection trees. Each tree has one direction for each level, a
random combination of differences from the mean, so that it follows the spread of
the data, and splits every node at a median. A forest is a small table however
many rows it indexes, and its depth grows with the rows: borders are medians of a
bounded sample as far as that reaches, and below it those of the last node that
held enough of the sample. Every vector is put into its leaf of every tree. To
search, one priority queue holds the unexplored branches of all trees by their
distance from the vector (the squared gaps to the borders crossed, added up); the
best leaves are visited and their members reranked by the exact similarity of the
stored integers.

Each vector is routed once, next to its bytes; the copies for the leaves are made
in the JVM. A vector and its leaves meet in one shuffle by leaf, under a number
that has the order of the ids. Equal vectors are one class and searched once, so
copies don't make a leaf hot. A leaf that is large for other reasons is cut into a
grid of blocks of members and of searching vectors, each cell a task's group of
bounded size; nothing is dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import md5
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.sources.shared import kept

K = 5
#: Rows from which the borders are fitted, over all spaces; the index itself holds every row.
SAMPLE = 20_000
TREES, LEAF = 8, 768
#: Leaves that a row visits in a forest of up to 7 levels, and more for each further level.
PROBES, PROBES_A_LEVEL = 12, 4
#: A leaf of more rows than this in one role is cut into blocks.
BLOCK = 4_096
#: Rows of one class that meet in one task; a larger class is salted.
HOT = 50_000


def probes_at(depth: int, probes: int = PROBES) -> int:
    return probes + PROBES_A_LEVEL * max(0, depth - 7)


class Forest:
    """The trees of one space: directions[tree][level] and, by level, borders of the nodes of each tree.

    A level has 2**level nodes; a level that the sample does not reach shares one border among the nodes below one that it does.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf: int, seed: int = 7):
        dims = sample.shape[1]
        self.depth = max(0, ceil(log2(max(1, rows / leaf))))
        # at least 8 rows of the sample in a node, so that borders are medians of something
        self.fitted = min(self.depth, int(log2(max(1, len(sample) / 8))))
        self.trees = trees if self.depth else 1
        rng = np.random.default_rng(seed)
        unit = self._unit(sample)
        spread_ = unit - unit.mean(0) if len(unit) else unit
        n = self.trees * max(1, self.depth)
        if len(unit) > 1:
            few = rng.integers(0, len(unit), (n, 64))
            weights = rng.standard_normal((n, 64)).astype(np.float32)
            self.directions = np.stack([w @ spread_[f] for w, f in zip(weights, few)], axis=1)
        else:
            self.directions = rng.standard_normal((dims, n))
        self.directions = (self.directions / np.maximum(np.linalg.norm(self.directions, axis=0), 1e-9)).astype(np.float32)
        self.borders = [np.zeros((self.trees, 1 << min(level, self.fitted)), np.float32) for level in range(self.depth)]
        at = self.project(sample)
        for t in range(self.trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                x, border = at[:, t, level], self.borders[level]
                order = np.argsort(node, kind="stable")
                starts = np.searchsorted(node[order], np.arange(border.shape[1] + 1))
                for k in range(border.shape[1]):
                    own = order[starts[k] : starts[k + 1]]
                    border[t, k] = np.median(x[own]) if len(own) else 0
                if level < self.fitted:
                    node = 2 * node + (x > border[t, node])

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return (self._unit(vectors) @ self.directions).reshape(len(vectors), self.trees, max(1, self.depth))

    def own(self, at: np.ndarray) -> np.ndarray:
        """[row, tree]: the leaf that holds each row."""
        node = np.zeros(at.shape[:2], np.int64)
        tree = np.arange(self.trees)[None, :]
        for level in range(self.depth):
            node = 2 * node + (at[:, :, level] > self.borders[level][tree, node >> max(0, level - self.fitted)])
        return node

    def probe(self, at: list, probes: int) -> list[tuple[int, int]]:
        """The (tree, leaf) to visit for one row: its own leaf of each tree, then the branches nearest to it in any tree."""
        borders, depth, fitted, found = self._lists, self.depth, self.fitted, []
        heap = [(0.0, t, 0, 0) for t in range(self.trees)]
        while heap and len(found) < probes:
            far, t, level, node = heapq.heappop(heap)
            while level < depth:
                gap = at[t][level] - borders[level][t][node >> level - fitted if level > fitted else node]
                right = gap > 0
                level += 1
                heapq.heappush(heap, (far + gap * gap, t, level, 2 * node + (not right)))
                node = 2 * node + right
            found.append((t, node))
        return found

    @property
    def _lists(self):
        if not hasattr(self, "_cached"):
            self._cached = [b.tolist() for b in self.borders]
        return self._cached


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of integer vectors, row by row: the products are exact, so equal pairs have equal values wherever they meet."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dots, na, nb = (np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (a, a), (b, b)))
    return np.round(dots / np.sqrt(na * nb), 12)


def _best_in_group(group: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """Of a leaf (or a cell of it): the k nearest members of each searching row, by similarity, then number.

    Single precision finds what may be among them, with a margin for its error; the exact value decides.
    """
    vectors = unpacked(group["vector"])
    ids = group["id"].to_numpy()
    members, seekers = np.flatnonzero(group["member"].to_numpy()), np.flatnonzero(group["seeks"].to_numpy())
    members = members[np.argsort(ids[members], kind="stable")]
    names = ids[members]
    width = min(k + 1, len(members))  # a row may find itself
    unit = Forest._unit(vectors.astype(np.float32))
    across = unit[members].T.copy()
    owner, others, found = [], [], []
    for start in range(0, len(seekers) if width else 0, 1024):
        mine = seekers[start : start + 1024]
        s = unit[mine] @ across
        if least > 0:
            rows, cols = np.nonzero(s >= least - 1e-4)
        else:
            rows, cols = np.nonzero(s >= np.partition(s, len(members) - width, axis=1)[:, len(members) - width][:, None] - 1e-4)
        apart = names[cols] != ids[mine[rows]]
        rows, cols = rows[apart], cols[apart]
        exact = np.concatenate([similarities(vectors[mine[rows[i : i + 65_536]]], vectors[members[cols[i : i + 65_536]]]) for i in range(0, len(rows), 65_536)] or [np.zeros(0)])
        near = exact >= least
        rows, cols, exact = rows[near], cols[near], exact[near]
        order = np.lexsort((cols, -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, cols, exact = rows[keep], cols[keep], exact[keep]
        with_any, first = np.unique(rows, return_index=True)
        owner += ids[mine[with_any]].tolist()
        others += np.split(names[cols], first[1:]) if len(first) else []
        found += np.split(exact, first[1:]) if len(first) else []
    return pd.DataFrame({"id": np.array(owner, np.int64), "others": pd.Series(others, dtype=object), "similarities": pd.Series(found, dtype=object)})


def unpacked(vectors) -> np.ndarray:
    """A row of numbers for each value of a column of equally long packed vectors."""
    return np.frombuffer(b"".join(vectors), np.int8).reshape(len(vectors), -1)


def sound_vectors(vectors: DataFrame, spaces: DataFrame) -> DataFrame:
    """(space, chunk_id, vector, a, b) of the sound rows, repeated ones included.

    Sound: the length is the ``dims`` of the manifest row of its model and revision, no entry missing, not all zero.
    The hashes a and b, 128 bits of space and vector, stand for the vector where rows of equal vectors meet.
    """
    dims = spaces.select("model_id", "model_revision", "dims").distinct()
    space = F.concat_ws("\x1f", "model_id", "model_revision")
    return (
        vectors.where("vector is not null and chunk_id is not null")
        .join(dims, ["model_id", "model_revision"])
        .where("size(vector) = dims and exists(vector, x -> x <> 0) and not exists(vector, x -> x is null)")
        .select(space.alias("space"), "chunk_id", "vector", F.xxhash64(F.lit(1), space, "vector").alias("a"), F.xxhash64("vector", F.lit(2), space).alias("b"))
    )


def grown_forests(own: DataFrame, rows: int, trees: int, leaf: int, sample: int) -> dict[str, Forest]:
    """A forest for each space, from a sample of at most about ``sample`` of the table's rows, chosen by a hash."""
    share = min(1.0, sample / max(1, rows))
    picked = own.where(F.pmod("a", F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else own
    spaces: dict[str, list] = {}
    for batch in picked.select("space", "vector").limit(2 * sample).toArrow().to_batches():
        at, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
        for space, start, end in zip(batch.column(0).to_pylist(), at[:-1], at[1:]):
            spaces.setdefault(space, []).append(values[start:end])
    # copies of one vector are one row, so that a large class does not fill the sample
    return {space: Forest(np.unique(np.stack(some), axis=0).astype(np.float32), int(len(some) / share), trees, leaf) for space, some in spaces.items()}


ROUTES = "id bigint, a bigint, b bigint, n bigint, vector binary, leaves array<bigint>, roles array<int>"


def routed_classes(own: DataFrame, rows: int, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(id, a, b, n, vector, leaves, roles): one row for each class of equal vectors, its rows (n), and the leaves it belongs to or visits.

    ``id`` numbers the classes in the order of their smallest chunk ids. ``roles``: 1 member, 2 visitor, 3 both.
    """
    shared = own.sparkSession.sparkContext.broadcast(grown_forests(own, rows, trees, leaf, sample))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forests = shared.value
        number = {space: k for k, space in enumerate(sorted(forests))}
        for frame in frames:
            for space, part in frame.groupby("space", sort=False):
                vectors = np.stack(part["vector"].to_list()).astype(np.int8)
                part = part.assign(vector=[v.tobytes() for v in vectors])
                forest = forests.get(space)
                if forest is None:  # a space so small that the sample missed it is one leaf, apart from all others
                    alone = -1 - int.from_bytes(md5(space.encode()).digest()[:7], "big")
                    yield part.assign(leaves=[[alone]] * len(part), roles=[[3]] * len(part))[COLUMNS]
                    continue
                base = number[space] << 56
                most = probes_at(forest.depth, probes)
                at = forest.project(vectors.astype(np.float32))
                all_leaves, all_roles = [], []
                for near, held in zip(at.tolist(), forest.own(at).tolist()):
                    role = {(t, n): 1 for t, n in enumerate(held)}
                    for x in forest.probe(near, most):
                        role[x] = role.get(x, 0) | 2
                    all_leaves.append([base | t << 48 | n for t, n in role])
                    all_roles.append(list(role.values()))
                yield part.assign(leaves=all_leaves, roles=all_roles)[COLUMNS]

    named = own.groupBy("a", "b").agg(F.min("chunk_id").alias("class"), F.any_value("space").alias("space"), F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("n"))
    numbered = named.orderBy("class").withColumn("id", F.monotonically_increasing_id())
    return kept(numbered.select("id", "a", "b", "n", "space", "vector").mapInPandas(route, ROUTES))


COLUMNS = ["id", "a", "b", "n", "vector", "leaves", "roles"]


def search(routed: DataFrame, k: int = K, least: float = -1.0) -> DataFrame:
    """(id, best array<struct<d, other>>): the k nearest other classes that the forest finds, d = -similarity, none below ``least``."""
    stops = routed.select("id", F.explode(F.arrays_zip("leaves", "roles")).alias("x")).select("id", F.col("x.leaves").alias("leaf"), F.col("x.roles").alias("role"))
    member, seeks = F.col("role").bitwiseAND(1) > 0, F.col("role").bitwiseAND(2) > 0
    grid = stops.groupBy("leaf").agg(F.ceil(F.count_if(member) / BLOCK).cast("int").alias("rows"), F.ceil(F.count_if(seeks) / BLOCK).cast("int").alias("cols")).where("rows > 1 or cols > 1")
    copies = routed.select("id", "vector", F.explode(F.arrays_zip("leaves", "roles")).alias("x")).select("id", "vector", F.col("x.leaves").alias("leaf"), F.col("x.roles").alias("role"))
    # a leaf in blocks: a member goes to each block of searching rows, a searching row to each block of members
    every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    own = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    cell = lambda r, c, m: F.struct(r.alias("r"), c.alias("c"), F.lit(m).alias("m"))
    as_member = F.transform(every(F.col("cols")), lambda c: cell(own(F.col("rows")), c, 1))
    as_seeker = F.transform(every(F.col("rows")), lambda r: cell(r, own(F.col("cols")), 2))
    none = F.array_except(as_member, as_member)
    cells = F.concat(F.when(member, as_member).otherwise(none), F.when(seeks, as_seeker).otherwise(none))
    blocks = (
        copies.join(grid, "leaf", "left")
        .withColumn("cell", F.explode(F.when(F.col("rows").isNull(), F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("role").alias("m")))).otherwise(cells)))
        .select("leaf", F.col("cell.r").alias("r"), F.col("cell.c").alias("c"), "id", "vector", (F.col("cell.m").bitwiseAND(1) > 0).alias("member"), (F.col("cell.m").bitwiseAND(2) > 0).alias("seeks"))
    )
    found = blocks.groupBy("leaf", "r", "c").applyInPandas(lambda g: _best_in_group(g, k, least), "id bigint, others array<bigint>, similarities array<double>")
    pairs = F.zip_with("similarities", "others", lambda s, o: F.struct((-s).alias("d"), o.alias("other")))
    return found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k).alias("best"))


def nearest(vectors: DataFrame, spaces: DataFrame, k: int = K, least: float = -1.0, **forest) -> DataFrame:
    """(chunk_id, other, similarity): the k most similar chunks of each chunk with a sound vector.

    Compared are vectors of one model and revision; at equal similarity the smaller id comes first; rows below ``least``
    are left out; repeated rows count once; null, empty, zero and wrongly long vectors have no row. Within a class of equal
    vectors the answer is exact; between classes it is the forest's, reranked exactly.
    """
    own = sound_vectors(vectors, spaces)
    routed = routed_classes(own, vectors.count(), **forest)
    members = own.select("a", "b", "chunk_id").distinct()
    classes = routed.select("id", "a", "b", "n").join(_smallest(members, k + 1), ["a", "b"])
    far = (
        search(routed, k, least)
        .select("id", F.explode("best").alias("x"))
        .select("id", F.col("x.d").alias("d"), F.col("x.other").alias("other"))
        .join(classes.select(F.col("id").alias("other"), "few"), "other")
        .select("id", F.explode(F.slice("few", 1, k)).alias("other"), "d")
        .groupBy("id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k).alias("far"))
    )
    # of a class larger than a task should hold the rows are spread over salts, and the class's answer is copied to each
    salts = F.ceil(F.col("n") / HOT).cast("int")
    hot = routed.where(F.col("n") > HOT).select("a", "b", salts.alias("salts"))  # at most one row for HOT rows of the table
    answers = classes.join(far, "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("a", "b", "salt", "few", "far")
    salted = members.join(F.broadcast(hot), ["a", "b"], "left").withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    near = F.transform(F.array_remove("few", F.col("chunk_id")), lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("other")))
    best = F.slice(F.array_sort(F.concat(near, F.coalesce("far", F.array_except(near, near)))), 1, k)
    return (
        salted.join(answers, ["a", "b", "salt"])
        .select("chunk_id", F.explode(best).alias("x"))
        .select("chunk_id", F.col("x.other").alias("other"), (-F.col("x.d")).alias("similarity"))
        .where(F.col("similarity") >= least)
    )


def _smallest(members: DataFrame, k: int) -> DataFrame:
    """(a, b, few): the k smallest chunk ids of each class, first within 64 parts of it, so that no list grows with a class."""
    ranked = members.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(64)))
    w = Window.partitionBy("a", "b", "part").orderBy("chunk_id")
    first = ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return first.groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_list("chunk_id")), 1, k).alias("few"))


def similar_pairs(vectors: DataFrame, spaces: DataFrame, k: int = K, least: float = 0.75, **forest) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: one is among the k most similar of the other, with at least that similarity."""
    rows = nearest(vectors, spaces, k, least, **forest)
    return rows.select(F.least("chunk_id", "other").alias("chunk_a"), F.greatest("chunk_id", "other").alias("chunk_b")).distinct()

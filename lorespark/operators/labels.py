"""Label propagation in the order of ids, over edges that lie in local files: only what is told of each node is held in memory."""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa

from lorespark.operators.graphs import SEMANTIC, WEIGHTS

#: Edges and ends that are worked on at a time; ends from which on a run of nodes is worth arrays.
BLOCK, DENSE = 1_000_000, 4_000
LABELS = tuple(WEIGHTS)
#: Weights as they are and as whole numbers, in which sums are exact; of each edge code (kind, label, side) the place among these.
W = np.array(sorted(set(WEIGHTS.values())))
TENTHS = np.round(W * 10).astype(np.int64)
PLACE = np.array([int(np.searchsorted(W, WEIGHTS[label])) for _ in SEMANTIC for label in LABELS for _ in (0, 1)], dtype=np.int64)


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in an ordered array that is not empty."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


class Sweeps:
    """Edges (a, b, code, id) between the nodes ``names``, which are in order; ``code`` is that of kind and label, ``id`` None where it is the hash.

    A node takes the label of greatest weight among its neighbours, the smallest on ties, one node after the other. Consecutive
    nodes without edges among them do not see each other's labels, so they are taken at once, with the same result. Sums are
    those of floating-point weights in the order of edge ids; ids are only looked at where exact sums tie.
    """

    def __init__(self, names: pa.Array, folder: str, block: int = BLOCK, dense: int = DENSE, ends: np.ndarray | None = None):
        """``ends``: how many ends each node has, or more. With it edges are laid out as they come, else they are written to a file first."""
        self.names, self.n, self.folder, self.block, self.dense = names, len(names), folder, block, dense
        self.degree, self.low = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64)
        self.sizes: list[tuple[int, int]] = []
        self.ids = self.named = 0  # bytes of ids that are no hash; edges with a place for one
        self.number = None
        self.raw, self.text, self.until = (open(f"{folder}/{f}", "wb") for f in ("raw", "text", "until"))
        self.known = ends is not None
        if self.known:
            self._begin(ends)

    def _new(self, name: str, kind: type) -> np.ndarray:
        return np.memmap(f"{self.folder}/{name}", kind, "w+", shape=int(self.start[-1]))

    def _begin(self, ends: np.ndarray) -> None:
        self.start = np.concatenate(([0], np.cumsum(ends)))
        self.fill = self.start[:-1].copy()
        if self.start[-1]:
            self.other, self.code = self._new("other", np.int32), self._new("code", np.uint8)

    def add(self, a: np.ndarray, b: np.ndarray, code: np.ndarray, ids: list[str | None] | None) -> None:
        self.degree += np.bincount(a, minlength=self.n) + np.bincount(b, minlength=self.n)
        np.maximum.at(self.low, np.maximum(a, b), np.minimum(a, b))
        first = 0  # the number of the first edge among those with a place for an id, from 1 on
        if ids:
            own = [(i or "").encode() for i in ids]
            self.text.write(b"".join(own))
            until = self.ids + np.cumsum([len(i) for i in own])
            until.astype(np.int64).tofile(self.until)
            first, self.ids, self.named = self.named + 1, int(until[-1]), self.named + len(own)
        self.sizes.append((len(a), first))
        if self.known:
            self._lay(a, b, code, first)
            return
        for x, kind in ((a, np.int32), (b, np.int32), (code, np.uint8)):
            x.astype(kind).tofile(self.raw)

    def _lay(self, a: np.ndarray, b: np.ndarray, code: np.ndarray, number: int) -> None:
        """Puts each edge's ends to those of their nodes."""
        node = np.concatenate((a, b))
        order = np.argsort(node, kind="stable")
        node = node[order]
        first = firsts(node)
        count = np.diff(np.append(first, len(node)))
        at = self.fill[node] + np.arange(len(node)) - np.repeat(first, count)
        self.fill[node[first]] += count
        if (self.fill[node[first]] > self.start[node[first] + 1]).any():
            raise ValueError("a node has more ends than were counted")
        self.other[at] = np.concatenate((b, a))[order]
        code = code.astype(np.uint8)
        self.code[at] = np.concatenate((2 * code, 2 * code + 1))[order]
        if number:
            self.number = self._new("number", np.int64) if self.number is None else self.number
            self.number[at] = np.tile(np.arange(number, number + len(a)), 2)[order]

    def arrange(self) -> None:
        """Puts the other ends of each node's edges beside each other."""
        for f in (self.raw, self.text, self.until):
            f.close()
        if not self.known:
            self._begin(self.degree)
            with open(f"{self.folder}/raw", "rb") as raw:
                for size, number in self.sizes:
                    self._lay(*(np.fromfile(raw, kind, size) for kind in (np.int32, np.int32, np.uint8)), number)
        os.remove(f"{self.folder}/raw")
        if not np.array_equal(self.fill, self.start[1:]):
            self._close_up()
        if self.ids:
            self.bytes, self.until = np.memmap(f"{self.folder}/text", np.uint8, "r"), np.memmap(f"{self.folder}/until", np.int64, "r")

    def _close_up(self) -> None:
        """Leaves no room between nodes that have fewer ends than were counted."""
        start, s = np.concatenate(([0], np.cumsum(self.degree))), 0
        while s < self.n:
            e = max(s + 1, int(np.searchsorted(start, start[s] + self.block, "right")) - 1)
            at = np.arange(start[s], start[e]) + np.repeat(self.start[s:e] - start[s:e], self.degree[s:e])
            for x in (self.other, self.code, self.number):
                if x is not None:
                    x[start[s] : start[e]] = x[at]
            s = e
        self.start = start

    def runs(self) -> Iterator[tuple[int, int, bool]]:
        """(first, end, whether they are taken at once) of consecutive nodes."""
        begins, s = [0], 0
        for i, low in enumerate(self.low.tolist()):
            if low >= s:
                begins.append(s := i)
        begins.append(self.n)
        few = None  # where runs of few ends began
        for s, e in zip(begins, begins[1:]):
            dense = self.start[e] - self.start[s] >= self.dense
            if few is not None and (dense or self.start[e] - self.start[few] > self.block):
                yield few, s, False
                few = None
            if not dense:
                few = s if few is None else few
                continue
            while s < e:
                to = max(s + 1, min(e, int(np.searchsorted(self.start, self.start[s] + self.block, "right")) - 1))
                yield s, to, True
                s = to
        if few is not None:
            yield few, self.n, False

    def run(self, sweeps: int) -> np.ndarray:
        """The label of each node after the sweeps, as a place in ``names``."""
        label, due = np.arange(self.n), self.degree > 0  # due: a neighbour's label is another than when the node was last seen
        runs = list(self.runs())
        for _ in range(sweeps):
            changed = False
            for s, e, dense in runs:
                if due[s:e].any():
                    changed |= (self.at_once if dense else self.one_by_one)(s, e, label, due)
            if not changed:
                break
        return label

    def at_once(self, s: int, e: int, label: np.ndarray, due: np.ndarray) -> bool:
        part = slice(int(self.start[s]), int(self.start[e]))
        seen = np.flatnonzero(due[s:e])
        due[s:e] = False
        other, code = np.asarray(self.other[part]), np.asarray(self.code[part])
        degree = self.degree[s:e]
        if len(seen) < e - s:
            mine = np.zeros(e - s, bool)
            mine[seen] = True
            mine = np.repeat(mine, degree)
            other, code = other[mine], code[mine]
        degree = degree[seen]
        key = np.repeat(np.arange(len(seen)), degree)
        key *= self.n
        key += label[other]
        key <<= 2
        key |= PLACE[code]
        key.sort()
        place = key & 3
        key >>= 2
        first = firsts(key)
        last = np.append(first[1:], len(key)) - 1
        total = np.add.reduceat(TENTHS[place], first)
        node, theirs = np.divmod(key[first], self.n)
        begin = firsts(node)
        most = np.flatnonzero(total == np.maximum.reduceat(total, begin)[node])
        first, last, node, theirs = first[most], last[most], node[most], theirs[most]
        begin = firsts(node)
        best = theirs[begin]
        tied = np.repeat(np.diff(np.append(begin, len(node))) > 1, np.diff(np.append(begin, len(node))))
        if tied.any():
            first, last, node, theirs = first[tied], last[tied], node[tied], theirs[tied]
            count, w, v = last - first + 1, place[first], place[last]
            times = np.cumsum(np.tile(W[:, None], (1, int(count.max()))), axis=1)  # a weight added to itself, one by one
            value = np.where(w == v, times[w, count - 1], W[w] + W[v])
            begin = firsts(node)
            unsure = np.maximum.reduceat((count > 2) & (w != v), begin)
            top = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, begin), np.diff(np.append(begin, len(node)))))
            best[node[begin]] = theirs[top[firsts(node[top])]]
            for k in np.flatnonzero(unsure).tolist():
                i = int(node[begin[k]])
                best[i] = self.by_ids(s + int(seen[i]), label)
        moved = best != label[s + seen]
        if not moved.any():
            return False
        label[s + seen[moved]] = best[moved]
        due[other[np.repeat(moved, degree)]] = True
        return True

    def one_by_one(self, s: int, e: int, label: np.ndarray, due: np.ndarray) -> bool:
        base = int(self.start[s])
        others, places = np.asarray(self.other[base : self.start[e]]), PLACE[self.code[base : self.start[e]]]
        tenths, changed = TENTHS.tolist(), False
        for i in range(s, e):
            if not due[i]:
                continue
            due[i] = False
            part = slice(int(self.start[i]) - base, int(self.start[i + 1]) - base)
            votes: dict[int, int] = defaultdict(int)
            for k, p in zip(label[others[part]].tolist(), places[part].tolist()):
                votes[k] += tenths[p]
            most = max(votes.values())
            best = [k for k, v in votes.items() if v == most]
            best = best[0] if len(best) == 1 else self.by_ids(i, label)
            if best != label[i]:
                label[i] = best
                due[others[part]] = changed = True
        return changed

    def by_ids(self, node: int, label: np.ndarray) -> int:
        """The label of a node by sums in the order of edge ids."""
        part = slice(int(self.start[node]), int(self.start[node + 1]))
        others, codes = np.asarray(self.other[part]), np.asarray(self.code[part])
        theirs, places = label[others], PLACE[codes]
        own, back = np.unique(theirs, return_inverse=True)
        total = np.bincount(back, TENTHS[places]).astype(np.int64)
        mine = np.flatnonzero((total == total.max())[back])  # no other sum can be as great
        here, there = self.names[node].as_py(), self.names.take(pa.array(others[mine])).to_pylist()
        rows = []
        for at, x in zip(mine.tolist(), there):
            (kind, name), side = divmod(int(codes[at]) >> 1, len(LABELS)), int(codes[at]) & 1
            a, b = (x, here) if side else (here, x)
            rows.append((self.given(part.start + at) or sha256("\x00".join(("edge", SEMANTIC[kind], a, b, LABELS[name])).encode()).hexdigest(), a, b, float(W[places[at]]), int(theirs[at])))
        votes: dict[int, float] = defaultdict(float)
        for *_, w, k in sorted(rows):
            votes[k] += w
        most = max(votes.values())
        return min(k for k, v in votes.items() if v == most)

    def given(self, at: int) -> str:
        n = int(self.number[at]) if self.ids else 0
        return self.bytes[int(self.until[n - 2]) if n > 1 else 0 : int(self.until[n - 1])].tobytes().decode() if n else ""


def sweeper(names, ends, sweeps: int, block: int = BLOCK, dense: int = DENSE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes all coded edges (a, b, code, other_id) in one task and gives (node_id, community_id); ``names`` and how many ``ends`` each has are broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespark.operators.iterative import in_blocks

        known = names.value
        with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
            work = Sweeps(known, folder, block, dense, ends.value)
            for rows in in_blocks(batches, block):
                other = rows["other_id"]
                work.add(*(rows[c].to_numpy() for c in ("a", "b", "code")), None if other.null_count == len(other) else other.to_pylist())
                del rows, other
                pa.default_memory_pool().release_unused()
            if not work.sizes:
                return
            work.arrange()
            label = work.run(sweeps)
        for k in range(0, len(known), 10_000):
            yield pa.RecordBatch.from_arrays([known.slice(k, 10_000), known.take(pa.array(label[k : k + 10_000]))], ["node_id", "community_id"])

    return run


def coder(names, block: int = BLOCK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (from_id, to_id, code, other_id) with places in ``names`` for their ends; those with an end that is not there are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        from lorespark.operators.iterative import in_blocks

        for rows in in_blocks(batches, block):
            at = pc.index_in(pa.chunked_array([*rows["from_id"].chunks, *rows["to_id"].chunks], "string"), value_set=names.value)
            a, b = at.slice(0, rows.num_rows).combine_chunks(), at.slice(rows.num_rows).combine_chunks()
            out = pa.table({"a": a, "b": b, "code": rows["code"], "other_id": rows["other_id"]})
            yield from (out.filter(pc.and_(pc.is_valid(a), pc.is_valid(b))) if at.null_count else out).to_batches(10_000)
            del rows, at, a, b, out
            pa.default_memory_pool().release_unused()

    return run


def counted_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n): the ends of a task's edges, each once, and how often they are one."""
    from lorespark.operators.iterative import in_blocks

    ids, n = pa.array([], "string"), np.zeros(0, np.int64)
    for rows in in_blocks(batches, BLOCK):
        ends = pa.chunked_array([ids, *rows["from_id"].chunks, *rows["to_id"].chunks], "string").combine_chunks().dictionary_encode()
        count = np.bincount(ends.indices.to_numpy(), minlength=len(ends.dictionary))
        count[: len(ids)] += n - 1
        ids, n = ends.dictionary, count
        del rows, ends
        pa.default_memory_pool().release_unused()
    yield from pa.table({"id": ids, "n": pa.array(n, "int64")}).to_batches(10_000)

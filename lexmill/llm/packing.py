"""Filling containers of fixed capacity by patterns fitted with non-negative least squares.

Documents are spread over shards of bounded size by key hash; each shard is
packed for itself, so the last containers of a shard are the only ones that
sharding leaves less full. Within a shard a document above the capacity gives full
pieces and one rest. Each container is thought of as cells of equal size, chosen so
that two or three lengths fill a cell: a length takes whole cells and leaves a
remainder. All patterns of up to three remainders that fill a cell exactly are
enumerated, their repeat counts are fitted to the histogram of remainders by
non-negative least squares and rounded; patterns that still can be made of what is
left follow, from the longest part on. Filled cells, with the whole cells of their
documents, are put side by side in containers. What no pattern takes is put where it
leaves the least space; where it lacks short documents, a share of the cells is given
back to it first.

Edge cases: a document without tokens needs no container (null container and
unused space, one row). Repeated rows of a doc_id count once. Capacities that are
null or below 1 are left out.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a shard, and the largest cell: patterns of three parts are about a twelfth of its square.
SHARD_DOCS, CELL = 65_536, 512
#: In containers of so few cells a pattern holds at most one item that takes whole cells besides.
FEW_CELLS = 4
#: Shares of the filled cells that are given back in turn, until no container could be saved or patterns placed fewer than LEAST_PLACED.
LEAST_PLACED = 0.8
GIVEN_BACK = (0.0, 0.04, 0.08, 0.12, 0.15, 0.18)
#: Kinds of containers (rows of the settings table) allowed.
KINDS = 1000
PACKED = "container_name string, capacity_tokens int, doc_id bigint, piece_no int, piece_tokens bigint, container_id string, unused_tokens bigint"


def cell_size(sizes: np.ndarray, capacity: int) -> int:
    """Largest cell (at most CELL) whose remainders are on average at least a third of it, so few of them fill it."""
    cells = max(1, -(-capacity // CELL))
    while cells < capacity // 16 and 3 * remainders(sizes, capacity // cells).mean() < capacity // cells:
        cells *= 2
    return capacity // cells


def remainders(sizes: np.ndarray, cell: int) -> np.ndarray:
    """What each length leaves after whole cells, from 1 to the cell."""
    return (sizes - 1) % cell + 1


def patterns(present: np.ndarray, cell: int, one_long: bool = False) -> np.ndarray:
    """All ways to fill ``cell`` with one, two or three of the classes ``present``: rows of three, 0 for none.

    Classes up to ``cell`` are lengths; class ``cell + n`` is length n of an item that takes
    whole cells besides, of which a pattern holds at most one if ``one_long``.
    """
    there = np.zeros(2 * cell + 1, bool)
    there[present] = True
    found = [np.array([[c, 0, 0] for c in (cell, 2 * cell) if there[c]], np.int64).reshape(-1, 3)]
    for tails in ((False, False), (True, False), (True, True)):  # whether the first and second part are long
        first, second = (present[(present > cell) == t] for t in tails)
        a, b = np.meshgrid(first, second, indexing="ij")
        rest = cell - (a - cell * tails[0]) - (b - cell * tails[1])
        ordered = (a >= b) if tails[0] == tails[1] else np.ones_like(rest, bool)
        pairs = ordered & (rest == 0)
        found.append(np.stack([a[pairs], b[pairs], rest[pairs]], 1))
        for last in (False, True):
            c = np.clip(rest, 0, cell) + cell * last
            triples = ordered & (rest > 0) & there[c] & ((c <= b) if tails[1] == last else (tails[1] > last))
            found.append(np.stack([a[triples], b[triples], c[triples]], 1))
    out = np.concatenate(found).astype(np.int64)
    return out[(out > cell).sum(1) <= 1] if one_long else out


def nonnegative_fit(parts: np.ndarray, target: np.ndarray, weight: np.ndarray, start: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that minimises the weighted squares of (uses of each length) - target, by accelerated projected gradient.

    ``parts`` has the lengths of each pattern (0 for none); ``target`` and ``weight`` go by length. Of the many
    solutions one near ``start`` is found.
    """
    n, width = len(target), parts.shape[1]
    square = weight * weight
    square[0] = 0.0
    flat = parts.ravel()

    def uses(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, width), n)

    v = np.ones(len(parts))
    for _ in range(12):  # largest eigenvalue, for the step
        v = (uses(v) * square)[parts].sum(1)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    x = y = start
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(y - ((uses(y) - target) * square)[parts].sum(1) / (norm * 1.05), 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def repeats(parts: np.ndarray, counts: np.ndarray, cell: int) -> np.ndarray:
    """Whole repeat counts of the patterns that together use no more of each length than there is."""
    longest = parts.max(1)
    # from the longest part on, as short ones fit anywhere; few parts first
    order = np.lexsort(((parts > 0).sum(1), -longest))

    def taken(wanted: np.ndarray, left: np.ndarray) -> np.ndarray:
        times = np.zeros(len(parts), np.int64)
        for r in order[wanted[order] > 0].tolist():
            times[r] = take(parts[r], left, int(wanted[r]))
        return times

    left = counts.copy()
    left[0] = everything = np.iinfo(np.int64).max // 4
    start = taken(np.full(len(parts), everything), left.copy())
    x = nonnegative_fit(parts, counts.astype(float), np.arange(len(counts)) / cell, start.astype(float))
    times = taken(np.rint(x).astype(np.int64), left)
    return times + taken(np.full(len(parts), everything), left)  # what rounding left over


def take(parts: np.ndarray, left: np.ndarray, most: int) -> int:
    """Up to ``most`` repeats of one pattern taken from the lengths left; their number."""
    need: dict[int, int] = {}
    for v in parts.tolist():
        if v:
            need[v] = need.get(v, 0) + 1
    k = min(most, *(int(left[v]) // c for v, c in need.items()))
    if k > 0:
        for v, c in need.items():
            left[v] -= k * c
    return max(k, 0)


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container of each item (1 <= size <= capacity), the space each container has left, and the items that patterns placed."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    cell = cell_size(sizes, capacity)
    groups = filled_cells(remainders(sizes, cell), (sizes - 1) // cell, cell, capacity // cell)
    bound, best = -(-int(sizes.sum()) // capacity), None
    for back in GIVEN_BACK:  # short items that patterns held may go with the rest, where it lacks them
        kept = [g for i, g in enumerate(groups) if (i * back) % 1 + back < 1 or not back]
        tried = fill(sizes, capacity, kept, cell)
        if best is not None and tried[2].mean() < LEAST_PLACED:
            break
        if best is None or len(tried[1]) < len(best[1]):
            best = tried
        if len(best[1]) <= bound:
            break
    return best


def fill(sizes: np.ndarray, capacity: int, groups: list[tuple[int, list[int]]], cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pack`` with the filled cells given: they are put side by side, and other items by best fit."""
    bins = np.full(len(sizes), -1, np.int64)
    left = side_by_side(groups, capacity // cell, bins)
    placed = bins >= 0
    space = [capacity - (capacity // cell - n) * cell for n in left]
    items = np.flatnonzero(~placed)
    if len(items):  # best fit, longest first
        least = int(sizes[items].min())
        open_bins = sorted((s, b) for b, s in enumerate(space) if s >= least)
        for i in items[np.argsort(-sizes[items], kind="stable")].tolist():
            size = int(sizes[i])
            at = bisect_left(open_bins, (size, -1))
            room, b = open_bins.pop(at) if at < len(open_bins) else (capacity, len(space))
            if b == len(space):
                space.append(capacity)
            bins[i], space[b] = b, room - size
            if room - size >= least:
                insort(open_bins, (room - size, b))
    return bins, np.array(space, np.int64), placed


def filled_cells(rest: np.ndarray, whole: np.ndarray, cell: int, cells: int) -> list[tuple[int, list[int]]]:
    """Items that fill a cell together, with the number of cells they take; those with most cells first."""
    kind = np.where(whole > 0, rest + cell, rest)
    counts = np.bincount(kind, minlength=2 * cell + 1)
    parts = patterns(np.flatnonzero(counts), cell, cells <= FEW_CELLS)
    if not len(parts):
        return []
    times = repeats(parts, counts, cell)
    # the first long part takes from those with most whole cells, other parts from those with fewest
    order = np.lexsort((-whole, kind))
    present, sizes = np.unique(kind, return_counts=True)
    queues = {int(v): deque(q.tolist()) for v, q in zip(present, np.split(order, np.cumsum(sizes)[:-1]), strict=True)}
    groups: list[tuple[int, list[int]]] = []
    for r in np.flatnonzero(times).tolist():
        first, *more = (v for v in parts[r].tolist() if v)
        for _ in range(int(times[r])):
            own = [queues[first].popleft(), *(queues[v].pop() for v in more)]
            n = 1 + int(whole[own].sum())
            if n <= cells:
                groups.append((n, own))
    return sorted(groups, key=lambda g: -g[0])


def side_by_side(groups: list[tuple[int, list[int]]], cells: int, bins: np.ndarray) -> list[int]:
    """Puts filled cells into containers of ``cells`` cells each; the cells that each container has left."""
    left: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(cells + 1)]
    for n, own in groups:  # least room that is enough
        room = next((k for k in range(n, cells + 1) if by_room[k]), 0)
        if room:
            b = by_room[room].pop()
        else:
            b, room = len(left), cells
            left.append(cells)
        bins[own] = b
        left[b] = room - n
        if left[b]:
            by_room[left[b]].append(b)
    return left


def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one shard's documents in containers of one capacity."""
    pdf = pdf.sort_values("doc_id")
    name, capacity, shard = pdf.container_name.iloc[0], int(pdf.capacity_tokens.iloc[0]), int(pdf.shard.iloc[0])
    ids, sizes = pdf.doc_id.to_numpy(), pdf.n_tokens.to_numpy(np.int64)
    full, rest = sizes // capacity, sizes % capacity
    whole = np.repeat(np.arange(len(ids)), full)
    number = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    some = np.nonzero(rest)[0]
    bins, left, _ = pack(rest[some], capacity)
    none = np.nonzero(sizes == 0)[0]
    label = f"{name}-{shard}-"
    frames = [
        pd.DataFrame({"doc_id": ids[whole], "piece_no": number, "piece_tokens": np.full(len(whole), capacity), "container_id": [f"{label}f{i}" for i in range(len(whole))], "unused_tokens": np.zeros(len(whole), np.int64)}),
        pd.DataFrame({"doc_id": ids[some], "piece_no": full[some], "piece_tokens": rest[some], "container_id": [f"{label}{b}" for b in bins.tolist()], "unused_tokens": left[bins] if len(bins) else np.zeros(0, np.int64)}),
        pd.DataFrame({"doc_id": ids[none], "piece_no": np.zeros(len(none), np.int64), "piece_tokens": np.zeros(len(none), np.int64), "container_id": [None] * len(none), "unused_tokens": pd.array([pd.NA] * len(none), "Int64")}),
    ]
    out = pd.concat([f.astype({"unused_tokens": "Int64"}) for f in frames if len(f)] or frames[:1], ignore_index=True)
    return out.assign(container_name=name, capacity_tokens=capacity)[[c.split()[0] for c in PACKED.split(", ")]]


def pack_documents(sizes: DataFrame, containers: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row per piece of each document and capacity, with its container and that container's unused space.

    ``sizes``: ``doc_id, n_tokens``; ``containers``: ``container_name, capacity_tokens``.
    """
    kinds = containers.filter("container_name is not null and capacity_tokens >= 1").select("container_name", "capacity_tokens").distinct().limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    items = sizes.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    shards = max(1, -(-sizes.count() // shard_docs))
    if not kinds:
        return sizes.sparkSession.createDataFrame([], PACKED)
    each = F.explode(F.array(*[F.struct(F.lit(k.container_name).alias("container_name"), F.lit(k.capacity_tokens).alias("capacity_tokens")) for k in kinds]))
    spread = items.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), each.alias("kind")).select("doc_id", "n_tokens", "shard", "kind.*")
    return spread.groupBy("container_name", "capacity_tokens", "shard").applyInPandas(pack_shard, PACKED)

"""Best-fit packing of token sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import bisect
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, shuffle_partitions
from .tokens import MAX_WORDS, crc32_u32, tokenizer


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole if it fits, else full pieces after a first one of the rest."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in range(rest, n, capacity)]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False, max_words: int = MAX_WORDS) -> DataFrame:
    """Tokenize whole texts, append ``end_id``, cut only documents longer than ``capacity``: one row a piece."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path, max_words)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.ids32(text.as_py(), end_id)
                for i, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[start : start + length]
                    for k, v in zip(rows, (key, i, start, length, crc32_u32(part), part.astype("i4") if with_ids else None)):
                        rows[k].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class _Greedy:
    """The incumbent: the largest length's bin is completed as full as a bounded search can, again and again."""

    def __init__(self, counts: dict[int, int], sizes: list[int], nodes: int):
        self.counts, self.sizes, self.nodes = counts, sizes, nodes

    def best(self, room: int) -> list[int]:
        """Lengths, largest first, that leave the least of ``room`` unused; among equals the one with larger items, which dominates."""
        self.left = self.nodes
        self.found = self._best_fit(room)
        self.waste = room - sum(self.found)
        if self.waste:
            self._search(room, bisect.bisect_right(self.sizes, room) - 1, [])
        return self.found

    def _best_fit(self, room: int) -> list[int]:
        """Again and again the largest item that fits."""
        taken: dict[int, int] = {}
        out = []
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0:
            size = self.sizes[i]
            n = min(room // size, self.counts[size] - taken.get(size, 0))
            if n:
                taken[size] = n
                out += [size] * n
                room -= size * n
            i = min(i - 1, bisect.bisect_right(self.sizes, room) - 1)
        return out

    def _search(self, room: int, i: int, taken: list[int]) -> bool:
        """Items from the i-th smallest length down; true once nothing is wasted or the nodes are used up."""
        if room < self.waste:
            self.found, self.waste = list(taken), room
            if not room:
                return True
        while i >= 0:
            self.left -= 1
            if self.left < 0:
                return True
            i = min(i, bisect.bisect_right(self.sizes, room) - 1)
            if i < 0:
                return False
            size = self.sizes[i]
            # An exact last item closes the bin at once.
            exact = bisect.bisect_left(self.sizes, room, 0, i + 1)
            if exact <= i and self.sizes[exact] == room and self.counts[room] > taken.count(room):
                self.found, self.waste = [*taken, room], 0
                return True
            if self.counts[size] > taken.count(size):
                taken.append(size)
                if self._search(room - size, i, taken):
                    return True
                taken.pop()
            # Waste bound: with only smaller items, can the rest still beat the incumbent?
            i -= 1
            if i >= 0 and room - self._reach(i, room) >= self.waste:
                return False
        return False

    def _reach(self, i: int, room: int) -> int:
        """No more than this can be filled with the lengths up to the i-th."""
        total = 0
        while i >= 0 and total < room:
            total += self.sizes[i] * self.counts[self.sizes[i]]
            i -= 1
        return min(total, room)

    def plan(self, capacity: int) -> list[tuple[int, list[int]]]:
        out = []
        while self.sizes:
            top = self.sizes[-1]
            self.counts[top] -= 1
            filled = [top, *self.best(capacity - top)]
            self.counts[top] += 1
            need = {s: filled.count(s) for s in filled}
            repeats = min(self.counts[s] // n for s, n in need.items())
            for s, n in need.items():
                self.counts[s] -= n * repeats
                if not self.counts[s]:
                    del self.counts[s]
                    self.sizes.pop(bisect.bisect_left(self.sizes, s))
            out.append((repeats, filled))
        return out


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the bins: for each k, items over ``capacity - k`` are alone, those over half never share, and items of k or more need what room is left beside them."""
    n = np.zeros(capacity + 1, np.int64)
    for s, c in counts.items():
        n[s] = c
    up, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    alone, paired = up[-1] - up[capacity - k], up[capacity - k] - up[half]
    paired_sum = total[capacity - k] - total[half]
    small = total[half] - np.r_[0, total][k]
    more = -(-(small - (paired * capacity - paired_sum)) // capacity)
    return int((alone + paired + np.maximum(more, 0)).max())


class _Completion:
    """Bin completion: branch over the undominated fillings around the largest remaining item, bounded by waste.

    ``nodes`` bounds the work on the driver; ``complete`` tells whether the search ended by itself, so
    that its plan is proved to be least.
    """

    #: With more bins than this left a filling is repeated while its lengths last, and few fillings of a bin are tried.
    FEW, WIDTH = 64, 24

    def __init__(self, counts: dict[int, int], capacity: int, plan: list, nodes: int):
        self.counts, self.capacity, self.plan, self.left = dict(counts), capacity, plan, nodes
        self.total = sum(s * n for s, n in counts.items())
        self.best, self.lower = sum(n for n, _ in plan), least_bins(counts, capacity)
        self.complete = True

    def run(self) -> list[tuple[int, list[int]]]:
        if self.best > self.lower:
            self._branch(0, 0, [])
        return self.plan

    def _take(self, items: list[int], n: int) -> None:
        for s in items:
            self.counts[s] = self.counts.get(s, 0) - n
            if not self.counts[s]:
                del self.counts[s]

    def _branch(self, used: int, waste: int, plan: list) -> bool:
        """True to stop: the lower bound is reached or the nodes are used up."""
        if not self.counts:
            self.best, self.plan = used, list(plan)
            return self.best <= self.lower
        rest = least_bins(self.counts, self.capacity)
        if used + rest >= self.best:
            return False
        self.left -= 1
        if self.left < 0:
            self.complete = False
            return True
        many = rest > self.FEW
        top = max(self.counts)
        self._take([top], 1)
        options = self._fillings(self.capacity - top, (self.best - 1) * self.capacity - self.total - waste, many)
        self._take([top], -1)
        for unused, items in options:
            filled = [top, *items]
            n = min(self.counts[s] // filled.count(s) for s in filled) if many else 1
            # A better incumbent since the fillings were listed leaves less to waste.
            if waste + unused * n > (self.best - 1) * self.capacity - self.total:
                continue
            self._take(filled, n)
            plan.append((n, filled))
            stop = self._branch(used + n, waste + unused * n, plan)
            plan.pop()
            self._take(filled, -n)
            if stop:
                return True
        if many:
            self.complete = False  # neither all fillings nor all repeats were tried
        return False

    def _fillings(self, room: int, slack: int, many: bool) -> list[tuple[int, list[int]]]:
        """(unused, lengths) of undominated fillings of ``room`` that leave ``slack`` at most, the fullest and largest first."""
        sizes = sorted((s for s in self.counts if s <= room), reverse=True)
        reach = np.cumsum([s * self.counts[s] for s in sizes][::-1])[::-1].tolist() + [0]
        out: list[tuple[int, list[int]]] = []

        def fill(i: int, room: int, items: list[int]) -> None:
            if many and len(out) >= self.WIDTH or self.left < 0:
                return
            while i < len(sizes) and sizes[i] > room:
                i += 1
            if room - reach[i] > slack:
                return
            if i == len(sizes):
                if self._undominated(items, room):
                    out.append((room, list(items)))
                return
            self.left -= 1
            s = sizes[i]
            for n in range(min(room // s, self.counts[s]), -1, -1):
                fill(i + 1, room - n * s, [*items, *[s] * n])

        fill(0, room, [])
        if self.left < 0:
            self.complete = False
        return sorted(out, key=lambda x: (x[0], [-s for s in x[1]]))

    def _undominated(self, items: list[int], unused: int) -> bool:
        """No length left over could replace items of the filling that sum to as much or up to ``unused`` less: the filling with it would dominate."""
        sums: dict[int, bool] = {0: False}  # sum of a part: whether one of two items or more has it
        for k, s in enumerate(items):
            for t, several in list(sums.items()):
                sums[t + s] = sums.get(t + s, False) or several or t > 0
        for x, n in self.counts.items():
            if n > items.count(x):
                for t in range(x - unused, x + 1):
                    if t in sums and (t < x or sums[t]):
                        return False
        return True


class Plan(list):
    """(repeats, lengths) of sequences; ``sequences`` and the lower bound ``least``; ``proved`` if no plan has fewer."""

    def __init__(self, rows: list, least: int, complete: bool):
        super().__init__(rows)
        self.sequences, self.least = sum(n for n, _ in rows), least
        self.proved = complete or self.sequences <= least


def plan_bins(histogram: dict[int, int], capacity: int, nodes: int = 20_000) -> Plan:
    """(repeats, lengths) of sequences that hold exactly the pieces of the histogram.

    The incumbent completes the largest remaining length's bin as full as it can and repeats that filling
    while its lengths last, so its work follows the number of distinct lengths (at most ``capacity``),
    not of documents. Only where it needs more than the lower bound, bin completion branches over the
    undominated fillings of each bin. ``nodes`` bounds that search, and a bin's search of the incumbent
    by a seventh of it; whether the plan is proved to be least is told by the plan.
    """
    counts = {s: n for s, n in histogram.items() if n > 0}
    if not counts:
        return Plan([], 0, True)
    greedy = _Greedy(dict(counts), sorted(counts), max(1, nodes // 7)).plan(capacity)
    search = _Completion(counts, capacity, greedy, nodes)
    return Plan(search.run(), search.lower, search.complete)


def _intervals(plan: list[tuple[int, list[int]]]) -> list[tuple]:
    """(length, rank from, rank to, first sequence, copies a sequence, offset): where the k-th piece of a length goes."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, filled in plan:
        offset = 0
        for size in sorted(set(filled), reverse=True):
            n = filled.count(size)
            low = used.get(size, 0)
            used[size] = low + n * repeats
            out.append((size, low, used[size], sequence, n, offset))
            offset += size * n
        sequence += repeats
    return out


def pack(pieces: DataFrame, capacity: int = 2048, buckets: int | None = None, nodes: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``id``, ``piece`` and ``length`` (1 to ``capacity``).

    Only the histogram, at most ``capacity`` rows, reaches the driver. Pieces of a length are numbered
    in salted buckets, so a length that most rows share is spread over tasks; the number finds the
    place in the plan. Sequences are filled without gaps from 0. Every row is placed once, repeated
    rows too; an empty table gives an empty result. A plan that ``nodes`` kept from being proved least
    is logged with its lower bound.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(s < 1 or s > capacity for s in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    schema = "p_length long, low long, high long, first long, copies long, base long"
    plan = plan_bins(histogram, capacity, nodes)
    if not plan.proved:
        logging.getLogger(__name__).warning("%d sequences, not proved least within %d nodes; the lower bound is %d", plan.sequences, nodes, plan.least)
    places = F.broadcast(spark.createDataFrame(_intervals(plan), schema))  # bounded by the distinct lengths, whatever the rows
    n = buckets or 4 * shuffle_partitions(spark)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("id", "piece")
    ranked = salted.withColumn("_k", F.row_number().over(within) - 1).join(sums, ["length", "_salt"]).withColumn("_k", F.col("_k") + F.col("_before"))
    placed = ranked.join(places, (F.col("length") == F.col("p_length")) & (F.col("_k") >= F.col("low")) & (F.col("_k") < F.col("high")))
    k = F.col("_k") - F.col("low")
    return placed.select(
        *pieces.columns,
        (F.col("first") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(k, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False, max_words: int = MAX_WORDS) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row a piece. ``max_words`` bounds the words a worker keeps.

    Null text is empty and gives the end id alone; rows repeated in full are packed each; null ids stay.
    Columns other than id and text are not carried. The pieces are written once, so nothing is
    tokenized twice.
    """
    pieces = cut(cut_pieces(docs, tokenizer_path, capacity, id_col, text_col, end_id, with_ids, max_words), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)

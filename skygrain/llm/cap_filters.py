"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, shuffle_partitions
from .components import components, contract


class ProductCode:
    """Filter directions that are all pairs of codewords of two blocks of a randomly turned space.

    The number of directions follows the number of vectors so that each vector passes about
    ``per_vector`` filters and each filter holds about ``per_filter`` of evenly spread vectors. A
    vector that passes fewer than ``least`` (``per_vector`` if not given) takes its best ``least``.
    """

    def __init__(self, dim: int, vectors: int, per_vector: float = 24, per_filter: float = 64, least: int | None = None, seed: int = 11, size: int | None = None, threshold: float | None = None):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.half, self.least = dim, max(1, dim // 2), int(per_vector) if least is None else least
        self.size = size or int(min(1 << 15, max(16, ceil(sqrt(vectors * per_vector / per_filter)))))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        words = [rng.standard_normal((self.size, d)) for d in (self.half, dim - self.half)]
        self.words = [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / sqrt(2) for w in words]
        self.threshold = self._calibrate(min(per_vector, self.size**2 / 2)) if threshold is None else threshold

    def _calibrate(self, per_vector: float, sample: int = 192) -> float:
        """The score that ``per_vector`` filters exceed on average, over random unit vectors: the code's own tail, which is shorter than a Gaussian's."""
        x = np.random.default_rng([7, self.dim]).standard_normal((sample, self.dim))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        # The best 64 * per_vector of each vector hold all that count, unless a few vectors have them all; they lie among its best codewords.
        k = min(self.size, int(64 * per_vector))
        s1, s2 = (np.sort(y, axis=1)[:, ::-1][:, :k] for y in (x[:, : self.half] @ self.words[0].T, x[:, self.half :] @ self.words[1].T))
        low, high = -1.5, 1.5
        for _ in range(24):
            t = (low + high) / 2
            n = sum(np.searchsorted(-b, a - t, side="right").sum() for a, b in zip(s1, s2)) / sample
            low, high = (t, high) if n > per_vector else (low, t)
        return low

    def recall(self, cosine: float, pairs: int = 1000, seed: int = 3) -> float:
        """Simulated: the share of random pairs at exactly ``cosine`` that have a filter in common."""
        rng = np.random.default_rng([seed, self.dim])
        u, w = rng.standard_normal((2, pairs, self.dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        return float(np.mean([len(np.intersect1d(a, b, True)) > 0 for a, b in zip(self.decode(u), self.decode(cosine * u + sqrt(1 - cosine**2) * w))]))

    @classmethod
    def fitted(cls, dim: int, vectors: int, cosine: float, recall: float = 0.995) -> ProductCode:
        """The cheapest code whose simulated recall at ``cosine`` holds: more filters a vector first, then fewer and so wider filters.

        In few dimensions many vectors make filters narrower than a link; halved codes hold more vectors each.
        """
        size = None
        while True:
            for each in (24, 36, 48, 64):
                code = cls(dim, vectors, each, size=size)
                if dim < 2 or code.size <= 4 or cosine >= 1 or code.recall(cosine) >= recall:
                    return code
            size = code.size // 2

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters that each row exceeds, sorted; a row that exceeds fewer than ``least`` gets its best ``least``."""
        out: list[np.ndarray] = []
        for i in range(0, len(unit), 256):
            x = unit[i : i + 256] @ self.turn
            s1, s2 = x[:, : self.half] @ self.words[0].T, x[:, self.half :] @ self.words[1].T
            # Prune: a first codeword counts only if the best second one lifts it over the threshold.
            row, c1 = np.nonzero(s1 + s2.max(axis=1, keepdims=True) >= self.threshold)
            which, c2 = np.nonzero(s2[row] >= (self.threshold - s1[row, c1])[:, None])
            ids = c1[which].astype(np.int64) * self.size + c2
            rows = row[which]
            ends = np.searchsorted(rows, np.arange(len(x) + 1))
            for r in range(len(x)):
                own = ids[ends[r] : ends[r + 1]]
                if len(own) < self.least:
                    k = min(self.least, self.size)
                    a, b = np.argsort(-s1[r])[:k], np.argsort(-s2[r])[:k]
                    score = s1[r, a][:, None] + s2[r, b][None, :]
                    top = np.argsort(-score, axis=None)[: self.least]
                    own = a[top // len(b)] * self.size + b[top % len(b)]
                out.append(np.sort(own.astype(np.int64)))
        return out


def block_links(left, right, same: bool, filter_id: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks of one filter: for each side, the weight linked for the first time here; and all linked pairs' sides.

    A block is (unit vectors, weights, filter lists). A pair that shares a smaller filter was counted there.
    """
    (u, wu, fu), (v, wv, fv) = left, right
    hit = u @ v.T >= cosine
    if same:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return np.zeros(len(u)), np.zeros(len(v)), np.zeros(0, int), np.zeros(0, int)
    ru, rv = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    lower = [[x[x < filter_id] for x in (f[i] for i in rows)] for f, rows in ((fu, ru), (fv, rv))]
    names = np.unique(np.concatenate([*lower[0], *lower[1]]))

    def members(lists):
        m = np.zeros((len(lists), len(names)), dtype=np.float32)
        for i, x in enumerate(lists):
            m[i, np.searchsorted(names, x)] = 1
        return m

    part = hit[np.ix_(ru, rv)]
    fresh = part & (members(lower[0]) @ members(lower[1]).T == 0) if len(names) else part
    nu, nv = np.zeros(len(u)), np.zeros(len(v))
    nu[ru] = fresh @ wv[rv]
    nv[rv] = fresh.T @ wu[ru]
    # Linked sides for components: each row to the first it hits spans the hits of this block pair together with its mirror.
    a, b = np.nonzero(part)
    return nu, nv, ru[a], rv[b]


def cap_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, block: int = 1024) -> DataFrame:
    """id_col, n_links, component_id, kept for every row: vectors found with a cosine of ``cosine`` or more are linked.

    Equal vectors are collapsed to their least id with a weight. Every distinct vector is sent to all
    filters whose direction it exceeds; inside a filter cosines are computed in double precision in
    blocks, and a filter with more than ``block`` vectors is dealt out as pairs of blocks, so no task
    holds an unbounded filter. Tasks return one row a vector and block pair (new links, and a link
    towards its component), never pairs.

    Square sums of single floats neither overflow nor vanish in double precision; doubles are scaled by a
    power of two first. Null, zero and non-finite vectors, vectors with null components and rows with a null id link with
    nothing; vectors of different lengths never link. Rows that repeat an id with its vector count as
    copies of it. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    width = np.dtype("<f4" if single else "<f8")  # vectors travel as they came; cosines are of doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    most = F.aggregate("v", F.lit(0.0), lambda a, x: F.when(F.isnan(x) | F.isnan(a), F.lit(float("nan"))).otherwise(F.when(x.isNull() | a.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(a, F.abs(x)))))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce((F.col("most") > 0) & (F.col("most") < float("inf")), F.lit(False))
    rows = rows.withColumn("most", most)
    # A power of two brings the largest component near 1, exactly, so that squares neither overflow nor vanish.
    near_one = F.col("v") if single else F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2("most") / 2)) / F.pow(F.lit(2.0), F.ceil(F.log2("most") / 2)))
    keyed = cut(rows.select("id", F.when(sound, F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)).alias("key"), F.when(sound, near_one).alias("v")), "vectors")
    reps = cut(keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")), "vector-reps")
    dims = {r["dim"]: r["n"] for r in reps.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = [ProductCode.fitted(d, n, cosine) for d, n in dims.items()]
    codes = {c.dim: {"dim": c.dim, "vectors": 0, "least": c.least, "size": c.size, "threshold": c.threshold} for c in fitted}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {d: ProductCode(**x) for d, x in codes.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                reps_, weights = part.column(0).to_numpy(), part.column(1).to_numpy()
                vecs = [np.array(x, dtype=np.float64) for x in part.column(2).to_pylist()]
                for d in sorted({len(x) for x in vecs}):
                    at = [i for i, x in enumerate(vecs) if len(x) == d]
                    x = np.stack([vecs[i] for i in at])
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    lists = made[d].decode(unit)
                    n = [len(f) for f in lists]
                    which = np.repeat(np.arange(len(at)), n)
                    raw, names = [r.tobytes() for r in x.astype(width)], [f.astype(np.int32).tobytes() for f in lists]
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array(np.full(len(which), d, np.int32)), "filter": pa.array(np.concatenate(lists)),
                        "rep": pa.array(reps_[at][which]), "weight": pa.array(weights[at][which]),
                        "vector": pa.array([raw[i] for i in which], pa.binary()), "filters": pa.array([names[i] for i in which], pa.binary()),
                    })

    sent = cut(reps.select("rep", "weight", "v").mapInArrow(decode, "dim int, filter long, rep long, weight long, vector binary, filters binary"), "vector-filters")
    # Filters with more than a block of vectors are cut into blocks; each vector meets every block once.
    sizes = sent.groupBy(F.col("dim").alias("_d"), F.col("filter").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.filter(F.col("_n") > block).select("_d", "_f", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "vector-large")
    dealt = sent.join(large, (F.col("dim") == F.col("_d")) & (F.col("filter") == F.col("_f")), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    dealt = dealt.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("dim", "filter", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "rep", "weight", "vector", "filters")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _groups(batches):
            dim, name, i, j = key
            rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy().astype(np.float64)
            x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=width).astype(np.float64).reshape(-1, dim)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            lists = [np.frombuffer(f, dtype=np.int32) for f in table.column("filters").to_pylist()]
            side = table.column("_own").to_numpy()
            l, r = np.flatnonzero(side == i), np.flatnonzero(side == j)
            pick = lambda at: (unit[at], weight[at], [lists[k] for k in at])
            nl, nr, a, b = block_links(pick(l), pick(r), i == j, name, cosine)
            links = np.zeros(len(rep))
            links[l] += nl
            if i != j:
                links[r] += nr
            if len(a):
                root = contract(len(rep), l[a], r[b])
                # The root of a component within the task is its least index; any member serves to span it.
                out = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
                yield pa.RecordBatch.from_pydict({"a": rep[out], "b": rep[root[out]], "links": links[out].astype(np.int64)})

    parts = 4 * shuffle_partitions(spark)
    placed = dealt.repartition(parts, "dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")
    found = cut(placed.mapInArrow(verify, "a long, b long, links long"), "vector-links")
    roots = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("_links"))
    named = reps.select("key", "rep", "weight").join(counts, F.col("rep") == F.col("_a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = cut(named.select(F.col("key").alias("_key"), (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("_root")), "vector-named")
    out = keyed.select("id", "key").join(named, F.col("key") == F.col("_key"), "left")
    root = F.coalesce("_root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with the same dim, filter and blocks, from batches sorted by them; one run at a time is held."""
    names = ("dim", "filter", "i", "j")
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(int(x) for x in keys[:, lo])
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)

"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_ids, cut, free_name, ship, shuffle_partitions
from .components import components, contract

BITS = 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits: each is set if it is set in over half of the XXH64 values (seed 42) of the word shingles, repeats included.

    Words are what ASCII white space separates, A-Z in lower case; fewer than ``words`` words make one
    shingle; no word gives zero.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest, n = xxhash.xxh64_digest, len(starts)
    total = np.zeros(BITS, dtype=np.int64)
    stops = ends[words - 1 :].tolist()
    for i in range(0, n, 1 << 16):  # bounded memory for texts of any length
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])])
        total += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(hashes, "id long, fp long")


def _flips(width: int, most: int) -> np.ndarray:
    """All masks of ``width`` low bits with at most ``most`` set."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)], dtype=np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


#: Members of a run of equal variants that are compared with one another; a longer run is one group without comparison.
RUN = 4096


def bucket_links(fps: np.ndarray, bucket: int, prefix: int, half: int, limit: int = 1 << 21, bits: int = BITS, check: np.ndarray | None = None, within: int = BITS) -> np.ndarray:
    """Component roots (indices) of ``fps`` that share a variant whose first ``prefix`` of ``bits`` bits are ``bucket``.

    All variants within ``half`` flips that fall in the bucket are made, sorted and compared; two
    fingerprints that share one are at most ``2 * half`` bits apart, so a run of equal variants is one
    linked group and needs no pairs. More variants than ``limit`` are made in parts, by further bits.

    With ``check``, a second fingerprint of each, members of a run link only if their checks are
    ``within`` so many bits. Members already linked are not compared again, and a run of more than
    ``RUN`` members, which only copies make, links as a whole: the links are a superset then.
    """
    parent = np.arange(len(fps))

    def grow(members: np.ndarray, value: int, depth: int) -> None:
        nonlocal parent
        low = bits - depth
        top = (fps[members] >> np.uint64(low)) if low < BITS else np.zeros(len(members), dtype=np.uint64)
        left = half - _ones(top ^ np.uint64(value)).astype(np.int64)
        members, left = members[left >= 0], left[left >= 0]
        if len(members) < 2:
            return
        made = sum(int((left == r).sum()) * sum(comb(low, k) for k in range(r + 1)) for r in range(half + 1))
        if made > limit and low > 8:
            for sub in range(8):
                grow(members, value << 3 | sub, depth + 3)
            return
        mask = np.uint64((1 << low) - 1)
        variants, owners = [], []
        for r in range(half + 1):
            own = members[left == r]
            if len(own):
                flips = _flips_of(low, r)
                variants.append(((fps[own] & mask)[:, None] ^ flips[None, :]).ravel())
                owners.append(np.repeat(own, len(flips)))
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        at, lag = np.flatnonzero(v[1:] == v[:-1]), 1
        if check is None:
            if len(at):
                parent = contract(len(fps), o[at], o[at + 1], parent)  # both are within half of the variant
            return
        while len(at):
            a, b = o[at], o[at + lag]
            near = parent[a] != parent[b]
            near[near] = _ones(check[a[near]] ^ check[b[near]]) <= within
            if near.any():
                parent = contract(len(fps), a[near], b[near], parent)
            lag += 1
            at = at[at + lag < len(v)]
            at = at[v[at + lag] == v[at]]
            if lag > RUN and len(at):
                at = np.flatnonzero((v[1:] == v[:-1]) & np.isin(v[1:], v[at]))
                parent = contract(len(fps), o[at], o[at + 1], parent)
                return

    grow(np.arange(len(fps)), bucket, prefix)
    return parent


_masks: dict[tuple[int, int], np.ndarray] = {}


def _flips_of(width: int, most: int) -> np.ndarray:
    if (width, most) not in _masks:
        _masks[width, most] = _flips(width, most)
    return _masks[width, most]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns behind each value of the first one, from batches sorted by it; one bucket at a time is held."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            key = int(columns[0][lo])
            if held and key != last:
                yield last, [np.concatenate(c) for c in zip(*held)]
                held = []
            last = key
            held.append([c[lo:hi] for c in columns[1:]])
    if held:
        yield last, [np.concatenate(c) for c in zip(*held)]


def fingerprint_links(distinct: DataFrame, radius: int = 4, rows_a_bucket: int = 1 << 18) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, distinct) within ``radius`` bits: a spanning forest of every bucket.

    Every fingerprint emits all variants within half the radius. They are shuffled by their leading
    bits: one row stands for all variants of a fingerprint with the same leading bits, and its task
    makes the rest of their bits, for one bucket at a time. The number of leading bits follows the input.
    """
    half = radius // 2
    n = distinct.count()
    each = sum(comb(BITS, k) for k in range(half + 1))
    prefix = min(24, max(6, ceil(log2(max(1, n * each / rows_a_bucket)))))
    masks = F.array(*[F.lit(int(m)) for m in _flips(prefix, half)])
    top = F.shiftrightunsigned("fp", BITS - prefix)
    sent = distinct.select("fp", F.explode(masks).alias("_mask")).select(F.col("_mask").bitwiseXOR(top).cast("int").alias("bucket"), "fp")
    ship(distinct.sparkSession)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (fp,) in _buckets(batches):
            if len(fp) > 1:
                own = np.sort(fp)
                root = bucket_links(own.view(np.uint64), bucket, prefix, half)
                linked = np.flatnonzero(root != np.arange(len(own)))
                yield pa.RecordBatch.from_pydict({"a": own[linked], "b": own[root[linked]]})

    return sent.repartition(4 * shuffle_partitions(distinct.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """id_col, fp (signed), fingerprint (hex), component_id: the least id reachable over links of at most ``radius`` bits.

    Equal fingerprints are collapsed first, so exact copies never meet. Null text and text without words
    have fingerprint zero and link like any other. A null id never is a component's id unless all its
    ids are null; repeated rows come back each. An empty table gives an empty result.
    """
    if radius % 2:
        raise ValueError("the radius is even: variants within half of it meet in the middle")
    fps = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("_least")), "fp-distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    whole = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    ids = whole.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("component_id"))
    named = cut(whole.join(ids, F.col("_root") == F.col("_r")).select(F.col("fp").alias("_fp"), "component_id"), "fp-named")
    out = fps.join(named, F.col("fp") == F.col("_fp"))
    return out.select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates, the one with the least id.

    Ids name documents: all rows with a kept id stay, and rows with a null id stay. Columns stay as
    they are, whatever their names. Null and empty texts are one group; an empty table stays empty.
    """
    groups = simhash_components(docs, id_col, text_col, words, radius)
    name = free_name(docs, "gone")
    gone = cut(groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct(), "fp-gone")
    # Ids alone, counted: below the limit texts stay where they are, beyond it both sides are shuffled and sorted.
    return docs.join(broadcast_ids(gone), docs[id_col] == F.col(name), "left_anti")

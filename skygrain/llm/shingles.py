"""Near-duplicates by the similarity of their word shingles: SimHash blocks in Hamming balls find candidates, whole shingle sets decide.

A pair whose sets have a Jaccard similarity of 0.8 differs in about 15 % of the bits of a SimHash, so
one radius over 64 bits finds few of them. Fingerprints are wider here and cut into many short blocks:
each block goes through the ball hashing of ``simhash`` by itself, and a pair needs one near block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_ids, cut, free_name, ship, shuffle_partitions
from .components import components, contract
from .simhash import BITS, _buckets, _flips, bucket_links

#: Documents, and bytes of their sets, that a task compares with as many others at a time.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Members of a large candidate cluster that all others are compared with before blocks are dealt out.
PIVOTS = 64
RADIUS = 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values (seed 42) of the word shingles, of the words that ``simhash.fingerprint`` takes.

    At most ``words`` words make one shingle; no word makes none.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: max(1, len(parts) - words + 1)].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, stops)), np.uint64, len(starts)))


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(found: np.ndarray, longs: int) -> np.ndarray:
    """``64 * longs`` SimHash bits (0 or 1) of a set of shingle hashes: each is set if it is set in over half of their mixed hashes."""
    total = np.zeros(BITS * longs, np.int64)
    salt = (np.arange(1, longs + 1, dtype=np.uint64) * _GOLDEN)[None, :]
    for i in range(0, len(found), 1024):  # bounded memory for texts of any length
        h = _mixed(found[i : i + 1024, None] + salt)
        total += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return (2 * total > len(found)).astype(np.uint8)


class Blocks:
    """How a wide fingerprint is cut: a 64-bit check, then ``tables`` blocks of ``bits`` bits.

    A block's bits follow the number of documents, so that unlike texts seldom meet: about 0.1 chance
    meetings a document also pass the check. The tables follow the bits, so that a pair of the wanted
    similarity has a near block with a probability of ``recall``. The check of such a pair is
    ``within`` with three standard deviations to spare.
    """

    def __init__(self, documents: int, similarity: float, recall: float = 0.995):
        # Sets of equal size at Jaccard J have the cosine 2J / (1 + J); bits differ as the angle.
        p = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
        self.within = min(BITS, ceil(BITS * p + 3 * (BITS * p * (1 - p)) ** 0.5))
        chance = sum(comb(BITS, k) for k in range(self.within + 1)) / 2.0**BITS
        for self.bits in range(24, 31):
            near = sum(comb(self.bits, k) * p**k * (1 - p) ** (self.bits - k) for k in range(RADIUS + 1))
            self.tables = 1 if near >= recall else ceil(log(1 - recall) / log(1 - near))
            meet = self.tables * sum(comb(self.bits, k) for k in range(RADIUS + 1)) / 2.0**self.bits
            if documents * meet * chance <= 0.1:
                break
        self.longs = 1 + ceil(self.tables * self.bits / BITS)

    def of(self, found: np.ndarray) -> tuple[int, list[int]]:
        """(check as a signed long, blocks) of a set of shingles; the empty set has no block."""
        bits = wide_fingerprint(found, self.longs)
        check = int(np.packbits(bits[:BITS]).view(">u8")[0].astype(np.uint64).view(np.int64))
        if not len(found):
            return check, []
        blocks = bits[BITS : BITS + self.tables * self.bits].reshape(self.tables, self.bits)
        return check, (blocks @ (1 << np.arange(self.bits))).tolist()


def candidate_links(prints: DataFrame, cutting: Blocks, rows_a_bucket: int = 1 << 20) -> DataFrame:
    """Edges (a, b) between the checks of rows (check long, blocks array<int>) with a block within ``RADIUS`` bits and checks that fit.

    Meet-in-the-middle ball hashing, block by block: all variants within half the radius are shuffled by
    their leading bits and compared in the bucket's task, which returns a spanning forest, no pairs.
    """
    half, bits = RADIUS // 2, cutting.bits
    n = prints.count()
    prefix = min(bits - 4, max(6, ceil(log2(max(1, n * 8 / rows_a_bucket)))))
    masks = F.array(*[F.lit(int(m)) for m in _flips(prefix, half)])
    each = prints.select("check", F.posexplode("blocks").alias("_t", "block")).select("check", "_t", "block", F.explode(masks).alias("_mask"))
    bucket = F.col("_t").cast("long") * (1 << prefix) + F.shiftright("block", bits - prefix).bitwiseXOR(F.col("_mask").cast("int"))
    ship(prints.sparkSession)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (block, check) in _buckets(batches):
            if len(block) > 1:
                order = np.argsort(check.view(np.uint64))  # the least check of a group is its root in every bucket that it reaches
                block, check = block[order], check[order]
                root = bucket_links(block.astype(np.uint64), bucket & ((1 << prefix) - 1), prefix, half, bits=bits, check=check.view(np.uint64), within=cutting.within)
                linked = np.flatnonzero(check[root] != check)
                yield pa.RecordBatch.from_pydict({"a": check[linked], "b": check[root[linked]]})

    sent = each.select(bucket.alias("bucket"), "block", "check")
    found = sent.repartition(4 * shuffle_partitions(prints.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(link, "a long, b long").distinct()
    # A check has a root in each bucket that it is sent to, at most: join those roots to their least, so that copies leave few edges.
    hooked = found.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return hooked.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of every pair of sets, by exact counts; empty sets are like nothing."""
    names, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    n = np.concatenate(sizes)
    owner, both = np.repeat(np.arange(len(n)), n), np.zeros((len(left), len(right)))
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for lo in range(0, len(names), 8192):
        a, b = np.searchsorted(at, [lo, lo + 8192])
        holds = np.zeros((len(n), min(8192, len(names) - lo)), np.float32)
        holds[owner[a:b], at[a:b] - lo] = 1
        both += holds[: len(left)] @ holds[len(left) :].T
    return both / np.maximum(sizes[0][:, None] + sizes[1][None, :] - both, 1)


def _compared(side: str, similarity: float):
    """For runs of (left and right) rows of a cluster: the forest of pairs alike, from rows (key columns, node, ``side``, found)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in _runs(batches):
            node, own = table.column("node").to_numpy(), table.column(side).to_numpy()
            found = [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
            l, r = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if len(l) and len(r):
                a, b = np.nonzero(similarities([found[k] for k in l], [found[k] for k in r]) >= similarity)
                root = contract(len(node), l[a], r[b])
                out = np.flatnonzero(node[root] != node)
                yield pa.RecordBatch.from_pydict({"a": node[out], "b": node[root[out]]})

    return verify


def _pairs(spark, rows: DataFrame, similarity: float) -> DataFrame:
    """Edges of rows (cluster, i, j, own, node, found) between the sides i and j of each (cluster, i, j)."""
    placed = rows.select("cluster", "i", "j", "own", "node", "found").repartition(4 * shuffle_partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return placed.mapInArrow(_compared("own", similarity), "a long, b long")


def _large_links(spark, large: DataFrame, similarity: float) -> DataFrame:
    """Edges of the clusters of more than a block, rows (node, cluster, blocks, per, found): first against pivots, then what pivots leave open.

    ``per`` is the members a block. Up to ``PIVOTS`` members are compared with all others. The largest group that they link is the
    cluster's core: its members are linked already, so only the rest is compared, with itself and
    with the core, as pairs of blocks. Where no core forms, that is every pair of blocks.
    """
    # Least hashes by a bounded aggregate, one for each of at most PIVOTS salts; fewer where texts are long, so that pivots stay a part of a block.
    salts = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(F.col("per") / 4)))
    least = large.select("cluster", F.xxhash64("node").alias("_h"), salts.alias("_salts")).groupBy("cluster", F.pmod("_h", "_salts").alias("_s")).agg(F.min("_h").alias("_h"))
    size = least.select(F.col("cluster").alias("_pc"), F.col("_h").alias("_ph"))
    pivots = cut(large.withColumn("_h", F.xxhash64("node")).join(size, (F.col("cluster") == F.col("_pc")) & (F.col("_h") == F.col("_ph"))).select("node", "cluster", "blocks", "found"), "shingle-pivots")
    spread = pivots.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.lit(-1).alias("i"), "j", F.lit(-1).alias("own"), "node", "found")
    others = large.select("cluster", F.lit(-1).alias("i"), F.pmod("node", F.col("blocks")).cast("int").alias("j"), F.pmod("node", F.col("blocks")).cast("int").alias("own"), "node", "found")
    near = cut(_pairs(spark, others.unionByName(spread), similarity), "shingle-near")
    groups = components(near).select(F.col("node").alias("_n"), F.col("root").alias("_g"))
    named = cut(large.select("node", "cluster", "blocks").join(groups, F.col("node") == F.col("_n"), "left").select("node", "cluster", "blocks", F.coalesce("_g", "node").alias("group")), "shingle-groups")
    counted = named.groupBy("cluster", "blocks", "group").agg(F.count(F.lit(1)).alias("n"))
    core = counted.groupBy("cluster", "blocks").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("all"))
    # Sides 0 .. rest - 1 hold the rest, from there on the core.
    per = F.col("all") / F.col("blocks")
    core = core.select(F.col("cluster").alias("_c"), F.col("top.group").alias("_core"), F.ceil((F.col("all") - F.col("top.n")) / per).cast("int").alias("_rest"), F.ceil(F.col("top.n") / per).cast("int").alias("_cores"))
    sides = named.join(core, F.col("cluster") == F.col("_c")).filter("_rest > 0")
    in_core = F.col("group") == F.col("_core")
    sides = sides.select(F.col("node").alias("_n"), in_core.alias("_in"), "_rest", "_cores", F.when(in_core, F.col("_rest") + F.pmod("node", "_cores")).otherwise(F.pmod("node", "_rest")).cast("int").alias("own"))
    dealt = large.join(sides, F.col("node") == F.col("_n"))
    last = F.when(F.col("_in"), F.col("_rest")).otherwise(F.col("_rest") + F.col("_cores")) - 1
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return near.unionByName(_pairs(spark, dealt.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}), similarity))


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int = BLOCK, recall: float = 0.995) -> DataFrame:
    """id_col, component_id for every row: the least id reachable over pairs whose shingle sets are ``similarity`` alike or more.

    Rows with equal sets are collapsed first, so exact copies never meet. Candidates are what ball
    hashing over the blocks of a wide SimHash links (``recall`` of pairs at the limit, more above it).
    They form clusters, whose rows are shipped with their whole sets, and only pairs that are alike
    link. A cluster of more than ``block`` documents or of long ones goes through pivots and pairs
    of blocks. Texts without words are equal to one another and like nothing else. Null and empty
    texts have no words; null ids never name a component that has another id; repeated rows come back
    each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cutting = Blocks(docs.count(), similarity, recall)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, checks, blocks, sizes = [], [], [], []
            for t in batch.column(1):
                found = shingles(t.as_py(), words)
                check, own = cutting.of(found)
                nodes.append(node_of(found))
                checks.append(check)
                blocks.append(own)
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((nodes, checks, blocks, sizes), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())))], ["id", "node", "check", "blocks", "size"])

    rows = cut(texts.mapInArrow(signed, "id long, node long, check long, blocks array<int>, size long"), "shingle-sets")
    distinct = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("check").alias("check"), F.first("blocks").alias("blocks"), F.first("size").alias("size")), "shingle-distinct")
    able = distinct.filter("least IS NOT NULL AND size > 0")
    linked = components(candidate_links(able.select("check", "blocks").distinct(), cutting))
    placed = able.select("node", "least", "size", "check").join(linked.select(F.col("node").alias("_k"), "root"), F.col("check") == F.col("_k"), "left")
    placed = placed.select("node", "least", "size", F.coalesce("root", "check").alias("cluster"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(8 * F.sum("size") / BLOCK_BYTES)).cast("int")
    placed = cut(placed, "shingle-placed")
    sizes = placed.groupBy(F.col("cluster").alias("_c")).agg(F.count(F.lit(1)).alias("_n"), blocks.alias("blocks")).filter("_n > 1").withColumn("per", F.ceil(F.col("_n") / F.col("blocks")).cast("int"))
    sizes = cut(sizes, "shingle-sizes")  # few beside the documents, so that a hot cluster is not shuffled to them
    members = cut(placed.join(sizes, F.col("cluster") == F.col("_c")).select(F.col("least").alias("_id"), F.col("node").alias("_node"), "cluster", "blocks", "per"), "shingle-members")
    chosen = texts.join(broadcast_ids(members, 4), F.col("id") == F.col("_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [shingles(t.as_py(), words) for t in part.column(0)]
                own = np.array([node_of(x) == n.as_py() for x, n in zip(found, part.column(1))])  # an id may name other texts too
                kept = part.filter(pa.array(own))
                raw = pa.array([x.tobytes() for x, ok in zip(found, own) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], raw], ["node", "cluster", "blocks", "per", "found"])

    sent = cut(chosen.select("text", "_node", "cluster", "blocks", "per").mapInArrow(sets, "node long, cluster long, blocks int, per int, found binary"), "shingle-found")
    edges = _pairs(spark, sent.filter("blocks = 1").select("cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "node", "found"), similarity)
    if not members.filter("blocks > 1").isEmpty():
        edges = edges.unionByName(_large_links(spark, sent.filter("blocks > 1"), similarity))
    roots = components(edges)
    whole = distinct.select("node", "least").join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("node") == F.col("_node"), "left")
    whole = whole.select("node", "least", F.coalesce("_root", "node").alias("_root"))
    ids = whole.groupBy(F.col("_root").alias("_r")).agg(F.min("least").alias("component_id"))
    named = cut(whole.join(ids, F.col("_root") == F.col("_r")).select(F.col("node").alias("_node"), "component_id"), "shingle-named")
    return rows.select("id", "node").join(named, F.col("node") == F.col("_node")).select(F.col("id").alias(id_col), "component_id")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with the same cluster and blocks, from batches sorted by them; one run at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
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


def shingle_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates, the one with the least id.

    Ids name documents: all rows with a kept id stay, and rows with a null id stay. Columns stay as
    they are, whatever their names. Null and empty texts are one group; an empty table stays empty.
    """
    groups = shingle_components(docs, id_col, text_col, words, similarity)
    name = free_name(docs, "gone")
    gone = cut(groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct(), "shingle-gone")
    return docs.join(broadcast_ids(gone), docs[id_col] == F.col(name), "left_anti")

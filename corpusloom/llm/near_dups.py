"""SimHash near-duplicates: 64-bit fingerprints, vantage-point shards and trees, connected components.

A fingerprint's bit is 1 if it is set in over half of the document's shingle hashes. Fingerprints that differ in
``radius`` bits or fewer are linked; a component is all that is reachable.

Equal fingerprints collapse first. The distinct ones are dealt to shards by their Hamming distance to a vantage point: into
rings of twice the radius, each of which also gets the fingerprints of the next ring that lie within the radius of its edge,
so that every pair within the radius meets in a ring. Distances of random fingerprints crowd at 32 bits, so rings alone do not
get small; each ring is divided further by blocks of bits: of ``radius + 1`` blocks two fingerprints within the radius
agree on one at least (beyond 160 million fingerprints: of ``radius + 2`` on two), and meet in the shard of that ring and
block. Shards above ``shard_rows`` are divided by further vantage points of their own, for as long as the largest shrinks.
A shard is searched through a vantage-point tree whose branches are pruned by triangle bounds. Shards emit no pairs, only
one link from each member to its local root.

Null and empty texts have fingerprint 0. Repeated rows and ties get the same component; a null doc_id takes no part
in the smallest id (null if a component has no other); other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import checkpointed, components

from .common import WORD, lower_ascii, map_rows, row_key, texts

SHINGLE, RADIUS, SEED = 4, 4, 42
LEAF, SHARD_ROWS = 64, 20_000
#: Shards by one block of about 13 bits hold ``SHARD_ROWS`` fingerprints up to this many; above it two blocks make them.
ONE_BLOCK = SHARD_ROWS << 13
SALTS, HOT = 16, 1000
#: Bits of the map that tells the rows of groups apart from those that stay where they are.
ROW_BITS = 1 << 26


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    grams = [" ".join(words)] if len(words) < shingle else map(" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    grams, total, n = iter(grams), np.zeros(64, np.int64), 0
    while block := [hash_(g, SEED) for g in islice(grams, 65_536)]:
        total += np.unpackbits(np.array(block, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer, and the text's SHA-256 if ``digest`` (null: empty)."""

    def make():
        def fn(texts):
            out = [fingerprint(t, shingle) for t in texts]
            more = [[b"" if t is None else hashlib.sha256(t.encode()).digest() for t in texts]] if digest else []
            return [[x - (1 << 64) if x >> 63 else x for x in out], *more]

        return fn

    return map_rows(docs, [F.col(id_col), F.col(text_col)], make, "fp long" + ", _digest binary" * digest, 1)


class Tree:
    """A vantage-point tree over distinct fingerprints, by Hamming distance."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.compared = 0  # pairs whose distance a search took at leaves
        self.root = self.build(np.arange(len(points)))

    def build(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        d = np.bitwise_count(self.points[ids] ^ self.points[ids[0]])
        middle = np.median(d)
        inner = d <= middle
        if inner.all():
            inner = d < middle
            if not inner.any():
                return ids
        return ids[0], int(d[inner].max()), int(d[~inner].min()), self.build(ids[inner]), self.build(ids[~inner])

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair within the radius, in arrays of bounded size."""
        yield from self.meet(self.root, np.arange(len(self.points)), radius)

    def meet(self, node, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(queries):
            return
        if isinstance(node, np.ndarray):
            step = max(1, 1_000_000 // max(1, len(node)))
            self.compared += len(queries) * len(node)
            for at in range(0, len(queries), step):
                q = queries[at : at + step]
                a, b = np.nonzero(np.bitwise_count(self.points[q][:, None] ^ self.points[node][None, :]) <= radius)
                yield q[a], node[b]
            return
        vantage, most, least, inner, outer = node
        d = np.bitwise_count(self.points[queries] ^ self.points[vantage]).astype(np.int16)
        yield from self.meet(inner, queries[d <= most + radius], radius)
        yield from self.meet(outer, queries[d >= least - radius], radius)


def unite(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the first place of its component under the pairs."""
    parent = np.arange(n)

    def lift(x: np.ndarray) -> np.ndarray:
        while True:
            y = parent[x]
            if (y == x).all():
                return x
            x = y

    for a, b in pairs:
        while True:
            ra, rb = lift(a), lift(b)
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return lift(np.arange(n))


def shard_pairs(starts: np.ndarray, ends: np.ndarray, points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius in each shard [start, end) of points: large shards through a tree; for the many of up to
    LEAF points, which would be a single leaf, all shards' leaves are scanned at once."""
    size = ends - starts
    group = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(points))
    leaf = np.repeat(size <= LEAF, size)
    step, live = 1, place[leaf]
    while len(live):
        live = live[live + step < ends[group[live]]]
        near = np.bitwise_count(points[live] ^ points[live + step]) <= radius
        yield live[near], live[near] + step
        step += 1
    for k in np.nonzero(size > LEAF)[0]:
        for a, b in Tree(points[starts[k] : ends[k]]).links(radius):
            yield a + starts[k], b + starts[k]


def _search(radius: int):
    """Star links of the shards in rows sorted by shard; a shard may go on over several batches."""

    def star(keys: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(points)]])
        r = unite(len(points), shard_pairs(starts, ends, points.view(np.uint64), radius))
        far = (r != np.arange(len(points))) & (points != points[r])
        return pa.RecordBatch.from_arrays([pa.array(points[far]), pa.array(points[r[far]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, points = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([b.column(i).to_numpy() for i in range(2)], axis=1)])
            points = np.concatenate([points, b.column(2).to_numpy()])
            last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0])  # the last shard may go on
            if last:
                yield star(keys[:last], points[:last])
                keys, points = keys[last:], points[last:]
        if len(points):
            yield star(keys, points)

    return run


def _block_keys(radius: int, chosen: int) -> Column:
    """The block keys of fp: for each choice of ``chosen`` of radius + ``chosen`` blocks, their bits (the choice's number on top)."""
    n = radius + chosen
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [F.shiftrightunsigned(F.col("fp"), cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)) for k in range(n)]
    keys = []
    for k, places in enumerate(combinations(range(n), chosen)):
        key = F.lit(k).cast("long")
        for i in places:
            key = F.shiftleft(key, 20) + blocks[i]
        keys.append(key)
    return F.array(*keys)


def _rings(vantage: Column, radius: int) -> Column:
    """The rings about a vantage point to which fp goes: its own, and the next lower one if it lies within the radius of that one's edge."""
    d = F.bit_count(F.col("fp").bitwiseXOR(vantage))
    ring = F.floor(d / (2 * radius or 1))
    return F.when((d % (2 * radius or 1) < radius) & (ring > 0), F.array(ring, ring - 1)).otherwise(F.array(ring))


def links(distinct: DataFrame, *, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, one_block: int = ONE_BLOCK) -> DataFrame:
    """Star links (a, b) whose components are those of all pairs within ``radius``. distinct: fp, each once."""
    n, first = distinct.agg(F.count("*"), F.min("fp")).first()
    rows = distinct.select("fp", F.explode(_rings(F.lit(first or 0), radius)).alias("ring"))
    rows = rows.select("fp", "ring", F.explode(_block_keys(radius, 1 if n <= one_block else 2)).alias("key"))
    level, size = 0, n
    while size > shard_rows:
        counts = rows.groupBy("key", "ring").agg(F.count("*").alias("n"), F.max_by("fp", F.xxhash64("fp", F.lit(level))).alias("vantage"))
        big = checkpointed(distinct.sparkSession, counts.where(F.col("n") > shard_rows))
        largest = big.agg(F.max("n")).first()[0] or 0
        if not largest or (level and largest > 0.9 * size):
            break
        held = rows.join(big.drop("n"), ["key", "ring"], "left")
        inner = F.transform(_rings(F.col("vantage"), radius), lambda r: F.xxhash64("ring", r))
        rows = held.select("fp", "key", F.explode(F.when(F.col("vantage").isNull(), F.array("ring")).otherwise(inner)).alias("ring"))
        level, size = level + 1, largest
    dealt = rows.select("key", "ring", "fp").repartition("key", "ring").sortWithinPartitions("key", "ring", "fp")
    return dealt.mapInArrow(_search(radius), "a long, b long").distinct()


def _linked(distinct: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fp, root) of every fingerprint that has a link, roots included."""
    found = components(distinct.sparkSession, links(distinct, radius=radius, shard_rows=shard_rows)).withColumnRenamed("node", "fp")
    return found.unionByName(found.select(F.col("root").alias("fp"), "root").distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp (signed), component_id (the component's smallest doc_id), one row per input row."""
    spark = docs.sparkSession
    prints = checkpointed(spark, fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = checkpointed(spark, prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    nodes = distinct.join(_linked(distinct, radius, shard_rows), "fp")
    # a component of many fingerprints is dealt over several tasks
    roots = nodes.groupBy("root").agg(F.min("least").alias("of_root")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    named = nodes.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(roots, ["root", "salt"]).select("fp", "of_root", F.lit(True).alias("linked"))
    of = distinct.join(named, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("of_root")).otherwise(F.col("least")).alias("component_id"))
    # rows of the commonest fingerprints (each over a HOT-th of all rows, so under HOT in number) are not dealt by fingerprint
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(checkpointed(spark, of.where(F.col("n") * HOT > rows).drop("n")))
    return prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(of.drop("n"), "fp")).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with one row of each component: that of the smallest id (a row without id only if none has one); of equal rows one.

    Rows alone in their component stay where they are: a map of fixed size (``ROW_BITS``) over hashed ids tells which rows may
    be in a group, and only those are joined, by id and text digest, with the rows to keep.
    """
    spark = docs.sparkSession
    prints = checkpointed(spark, fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, digest=True))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_digest"))
    distinct = checkpointed(spark, prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    linked = _linked(distinct, radius, shard_rows)
    alone = distinct.join(linked, "fp", "left_anti")
    roots = distinct.join(linked, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = roots.select("first.id", "first._digest").unionByName(alone.select("first.id", "first._digest"))

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ROW_BITS))
    grouped = distinct.where("n > 1").select("fp").unionByName(linked.select("fp")).distinct()
    slots = prints.join(grouped, "fp", "left_semi").select(slot(id_col).alias("s"))
    words = checkpointed(spark, slots.groupBy(F.shiftright("s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("_bits")))

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows whose id has a bit, and the others."""
        held = df.withColumn("slot", slot("id")).withColumn("_word", F.shiftright("slot", 6)).join(F.broadcast(words), "_word", "left")  # ROW_BITS / 64 rows at most
        bit = F.coalesce(F.expr("_bits & shiftleft(1L, CAST(slot & 63 AS INT))"), F.lit(0)) != 0
        return held.where(bit), held.where(~bit)

    touched, others = split(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*map(F.col, docs.columns)).alias("row")))
    wanted = split(kept)[0].select(*row_key("id", "id", F.col("_digest")))
    held = touched.select("row", *row_key("id", "text")).dropDuplicates(["_id", "_digest"])
    return others.select("row.*").unionByName(held.join(wanted, ["_id", "_digest"], "left_semi").select("row.*"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(texts(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

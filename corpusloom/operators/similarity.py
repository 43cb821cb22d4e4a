"""Vector search, similarity joins, duplicate groups, hybrid ranking, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import components


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; for unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fit_width(v: Column, width: int) -> Column:
    """Zero-padded or cut to ``width``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)


def query_literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding", floor: float | None = None) -> DataFrame:
    """The k nearest rows to one query vector (ties: smaller id). A per-task heap; nothing is shuffled but k rows a task."""
    scored = vectors.withColumn("similarity", dot(F.col(vec_col), query_literal(query)))
    if floor is not None:
        scored = scored.where(F.col("similarity") >= floor)
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


COPIES, LARGEST = 24, 16_000


def _blocks(rows: int, block_rows: int) -> int:
    """Blocks of about ``block_rows``, or more rows where there would be over ``COPIES`` blocks, for each vector goes to as many groups as there
    are blocks; never above ``LARGEST`` rows, which bound a task's memory (unless ``block_rows`` is larger itself)."""
    return max(1, math.ceil(rows / max(block_rows, min(LARGEST, math.ceil(rows / COPIES)))))


def _block_pairs(vectors: DataFrame, id_col: str, vec_col: str, block_rows: int) -> DataFrame:
    """Vectors dealt to blocks, once for every pair of blocks (i <= j) that theirs is one of: id, v, blk, i, j."""
    b = _blocks(vectors.count(), block_rows)
    block = F.pmod(F.xxhash64(id_col), F.lit(b)).cast("int")
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), block.alias("blk"))
    dealt = v.select("id", "v", "blk", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("other"))
    return dealt.select("id", "v", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))


def _sides(frame: pd.DataFrame, i: int, j: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the two blocks of a group."""
    out = []
    for k in (i, j):
        part = frame[frame.blk == k]
        out.append((part.id.to_numpy(), np.stack(part.v.to_numpy()).astype("f8") if len(part) else np.zeros((0, 1))))
    return out


def similarity_join(vectors: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", block_rows: int = 4000) -> DataFrame:
    """Pairs (a < b) with cosine >= threshold, exactly.

    Vectors are dealt to blocks of about ``block_rows``; each pair of blocks is one group and one matrix product, so memory is
    bounded by two blocks and only pairs above the threshold leave a task. An exact join is quadratic in arithmetic; for
    thresholds near 1 ``candidate_join`` is the way at scale.
    """

    def pairs(key, frame: pd.DataFrame) -> pd.DataFrame:
        (ids, x), (other, y) = _sides(frame, *key)
        out = [pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64"), "similarity": np.zeros(0)})]
        for at in range(0, len(x) if len(y) else 0, 1000):
            s = x[at : at + 1000] @ y.T
            p, q = np.nonzero(s >= threshold)
            left, right = ids[p + at], other[q]
            keep = left != right if key[0] != key[1] else left < right
            out.append(pd.DataFrame({"a": np.minimum(left, right)[keep], "b": np.maximum(left, right)[keep], "similarity": s[p, q][keep]}))
        return pd.concat(out, ignore_index=True)

    return _block_pairs(vectors, id_col, vec_col, block_rows).groupBy("i", "j").applyInPandas(pairs, "a long, b long, similarity double")


def tables_for(threshold: float, recall: float, bits: int) -> float:
    """Hash tables with which a pair at the threshold meets with chance ``recall``; inf where it never does."""
    met = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-met)) if met > 1e-12 else math.inf


def candidate_join(vectors: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", dim: int = 64, tables: int = 16, bits: int = 12, seed: int = 3, recall: float = 0.95, most_tables: int = 64) -> DataFrame:
    """Pairs (a < b) that reach the threshold: near-linear for thresholds near 1, by buckets of random hyperplanes.

    A pair at angle t meets in a table with chance (1 - t / pi) ** bits. As many tables are used (``tables`` at least) as a pair
    at the threshold needs to meet with chance ``recall``; where that takes over ``most_tables`` (at 12 bits and .95, for
    thresholds under about .76), the exact join is cheaper and gives all pairs.
    """
    needed = tables_for(threshold, recall, bits)
    if needed > most_tables:
        return similarity_join(vectors, threshold, id_col, vec_col)
    tables = max(tables, needed)
    planes = np.random.default_rng(seed).normal(size=(tables * bits, dim))

    @F.pandas_udf("array<long>")
    def buckets(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for s in it:
            x = np.stack(s.to_numpy()).astype("f8")
            h = ((x @ planes.T) > 0).reshape(len(x), tables, bits) @ weight + (np.arange(tables, dtype=np.int64) << 32)
            yield pd.Series(list(h))

    # ids meet in buckets; vectors are fetched for the distinct pairs only
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    dealt = v.select("id", F.explode(buckets("v")).alias("bucket"))
    met = dealt.withColumnRenamed("id", "a").join(dealt.withColumnRenamed("id", "b"), "bucket").where("a < b").select("a", "b").distinct()
    both = met.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return both.withColumn("similarity", dot(F.col("va"), F.col("vb"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def duplicate_groups(vectors: DataFrame, threshold: float = 0.92, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, group_id, size) of every row with a duplicate: groups are components of the similarity join, named by the smallest id."""
    pairs = similarity_join(vectors, threshold, id_col, vec_col)
    found = components(vectors.sparkSession, pairs.select("a", "b"))
    both = found.select(F.col("node").alias("id"), F.col("root").alias("group_id")).unionByName(found.select(F.col("root").alias("id"), F.col("root").alias("group_id"))).distinct()
    return both.join(both.groupBy("group_id").agg(F.count("*").alias("size")), "group_id")


def neighbours(vectors: DataFrame, k: int = 5, floor: float = 0.35, id_col: str = "id", vec_col: str = "embedding", block_rows: int = 4000) -> DataFrame:
    """For every row its k most similar others above ``floor`` (ties: smaller id). Each pair of blocks keeps its own best k of a row,
    so at most k rows per row and block leave the tasks."""

    def best(key, frame: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(frame, *key)
        out = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        for (ids, x), (other, y) in (sides, sides[::-1])[: 1 if key[0] == key[1] else 2]:
            by_id = np.argsort(other, kind="stable")
            other, y = other[by_id], y[by_id]
            for at in range(0, len(x) if len(y) else 0, 1000):
                s = x[at : at + 1000] @ y.T
                s[ids[at : at + 1000, None] == other[None, :]] = -np.inf
                few = np.count_nonzero(s > floor, axis=1) <= k
                # what lies above the floor is seldom more than k; only other rows are sorted (stable: ties go to the smaller id)
                r, c = np.nonzero((s > floor) & few[:, None])
                out.append((ids[at + r], other[c], s[r, c]))
                for n in np.nonzero(~few)[0]:
                    kth = np.partition(s[n], -k)[-k]
                    c = np.nonzero(s[n] >= kth)[0]
                    c = c[np.argsort(-s[n, c], kind="stable")[:k]]
                    out.append((np.full(len(c), ids[at + n]), other[c], s[n, c]))
        return pd.DataFrame({name: np.concatenate(v) for name, v in zip(("id", "other", "similarity"), zip(*out, strict=True), strict=True)})

    found = _block_pairs(vectors, id_col, vec_col, block_rows).groupBy("i", "j").applyInPandas(best, "id long, other long, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid_search(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer union of keyword hits (id) and semantic hits (id, similarity): 1, the similarity, or both added."""
    joined = keyword.select("id", F.lit(True).alias("k")).join(semantic.select("id", "similarity"), "id", "full_outer")
    score = F.when(F.col("k").isNull(), F.col("similarity")).when(F.col("similarity").isNull(), 1.0).otherwise(1 + F.col("similarity"))
    kind = F.when(F.col("k").isNull(), "semantic").when(F.col("similarity").isNull(), "keyword").otherwise("both")
    return joined.select("id", score.alias("score"), kind.alias("match_type"))


def clusters(vectors: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding", seed: int = 42, rounds: int = 20) -> DataFrame:
    """(id, cluster), clusters numbered by size: Lloyd's k-means by Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(F.col(id_col).alias("id"), array_to_vector(vec_col).alias("features"))
    fitted = KMeans(k=k, seed=seed, maxIter=rounds).fit(x).transform(x).select("id", F.col("prediction").alias("raw"))
    sizes = fitted.groupBy("raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    order = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1)  # k rows
    return fitted.join(F.broadcast(order.select("raw", "cluster")), "raw").select("id", "cluster")


def passages(chunks: DataFrame, query: list[float], k: int = 4, doc_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """The k best chunks of each document for one query vector."""
    rank = F.row_number().over(Window.partitionBy(doc_col).orderBy(F.desc("similarity"), "id"))
    return chunks.withColumn("similarity", dot(F.col(vec_col), query_literal(query))).withColumn("rank", rank).where(F.col("rank") <= k)

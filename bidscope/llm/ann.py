"""Approximate nearest neighbours by cosine (operator 2): hash-prefix forest.

Each of ``TREES`` trees gives a vector a string of ``BITS`` bits, the sides
of random hyperplanes.  A tree is the sorted array of those strings, stored
in ranges of (tree, string).  A query descends in all trees to the longest
prefix under which they hold ``FIRST`` candidates together, scores those and
so learns a lower bound ``s`` for the cosine of its last neighbour.  A vector
at cosine ``c`` shares one bit with chance ``p(c) = 1 - acos(c) / pi`` and
misses a prefix of ``x`` bits in every tree with ``(1 - p ** x) ** TREES``;
the query ascends in all trees to the longest prefix for which that is at
most ``1 - RECALL`` at ``s``, the empty prefix (all vectors) if need be, and
scores what it then sees.  Near neighbours so cost long prefixes, and vectors
without any cost short ones; there is no cap on candidates.

Equal vectors are one vector in the forest with their smallest ids (one more
than neighbours asked for, which is all that can be returned).  A prefix with
many vectors or many queries is dealt in blocks of both, each scored by one
task, which returns a few rows per query.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows without an id; rows that
repeat an id and vector count once, and of several vectors of one id the
smallest (by components) counts; fewer candidates than neighbours give fewer
rows; vectors of another length than the query's are no candidates; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read

TREES, BITS = 16, 32
NEIGHBOURS = 5
RECALL = 0.95
# Candidates (over all trees) under a query's first, longest prefix.
FIRST = 64
# Lengths of prefixes that queries stop at.
LENGTHS = (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32)
# Vectors and queries that one task scores against each other.
POINT_BLOCK, QUERY_BLOCK = 4096, 1024
SEED = 20

VECTORS = "vec_id long, key binary, vec binary, dim int"


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, key, vec, dim): usable vectors, their bytes and a hash of them."""
    wide = isinstance(table.schema[vec_col].dataType, T.ArrayType) and isinstance(
        table.schema[vec_col].dataType.elementType, T.FloatType)
    kind = "<f4" if wide else "<f8"

    def usable(batches):
        for batch in batches:
            out = []
            for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not vec.is_valid or not len(vec.values) or vec.values.null_count:
                    continue
                x = vec.values.to_numpy().astype(kind)
                if np.isfinite(x).all() and x.any():
                    # A zero's sign does not make a vector another one.
                    data = (x + 0).astype(kind).tobytes()
                    out.append((vec_id, hashlib.md5(data).digest(), data, len(x)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*out) if out else ([], [], [], []),
                    (pa.int64(), pa.binary(), pa.binary(), pa.int32()))],
                names=["vec_id", "key", "vec", "dim"])

    one = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")) \
        .where(F.col("vec_id").isNotNull())
    if wide:
        one = one.select("vec_id", F.col("v").cast("array<float>").alias("v"))
    else:
        one = one.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    return one.mapInArrow(usable, VECTORS).groupBy("vec_id").agg(
        F.min(F.struct("vec", "key", "dim")).alias("m")).select(
        "vec_id", "m.key", "m.vec", "m.dim")


def _numbers(data: list[bytes], dims: list[int]) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if not data:
        return np.zeros((0, 0))
    kind = "<f4" if len(data[0]) == 4 * dims[0] else "<f8"
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)


def codes(distinct: DataFrame, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """(key, dim, tree, code): every vector's bit string in every tree."""

    def hashed(batches):
        planes: dict[int, np.ndarray] = {}
        weights = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal(
                        (dim, trees * bits))
                x = _numbers(rows.column("vec").to_pylist(), [dim])
                side = (x @ planes[dim] > 0).reshape(len(x), trees, bits)
                code = (side * weights).sum(axis=2)
                yield pa.record_batch({
                    "key": rows.column("key").take(pa.array(np.repeat(np.arange(len(x)), trees))),
                    "dim": pa.array(np.full(len(x) * trees, dim, np.int32)),
                    "tree": pa.array(np.tile(np.arange(trees, dtype=np.int32), len(x))),
                    "code": pa.array(code.ravel())})

    return distinct.select("key", "vec", "dim").mapInArrow(
        hashed, "key binary, dim int, tree int, code long")


def _prefix(length: Column, bits: int) -> Column:
    return F.call_function("shiftright", F.col("code"), F.lit(bits) - length)


def prefix_length(cosine: Column, trees: int, recall: float) -> Column:
    """The longest listed prefix under which a vector of this cosine is seen
    in some tree with chance ``recall``."""
    share = 1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) / math.pi
    needed = 1 - (1 - recall) ** (1 / trees)
    reach = F.when(share >= 1.0, F.lit(float(BITS))).when(share <= 0.0, F.lit(0.0)).otherwise(
        F.lit(math.log(needed)) / F.log(share))
    found = F.lit(LENGTHS[0])
    for x in LENGTHS[1:]:
        found = F.when(reach >= x, F.lit(x)).otherwise(found)
    return found


def _best(rows: list[dict], points: list[dict], keep: int):
    """The ``keep`` nearest points of every query of one block."""
    p = _numbers([x["vec"] for x in points], [points[0]["dim"]])
    q = _numbers([x["vec"] for x in rows], [rows[0]["dim"]])
    score = np.einsum("ij,kj->ik", q, p)
    score /= np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * np.sqrt(
        np.einsum("ij,ij->i", p, p))[None]
    low = np.array([x["low"] for x in points])
    for i, row in enumerate(rows):
        s = score[i]
        if len(s) > keep:
            edge = np.partition(s, len(s) - keep)[len(s) - keep]
            near = np.flatnonzero(s >= edge)
        else:
            near = np.arange(len(s))
        for j in near[np.lexsort((low[near], -s[near]))][:keep].tolist():
            yield row["key"], points[j]["key"], float(s[j])


def score(queries: DataFrame, sizes: DataFrame, stored: DataFrame, distinct: DataFrame,
          keep: int, bits: int = BITS) -> DataFrame:
    """(query, key, score): the ``keep`` nearest of the vectors under each
    query's prefixes of its ``length``.  ``queries``: key, length."""
    mine = queries.join(stored, "key").withColumn("prefix", _prefix(F.col("length"), bits))
    # The empty prefix is the same in all trees.
    mine = mine.where((F.col("length") > 0) | (F.col("tree") == 0))
    node = ["dim", "tree", "length", "prefix"]
    nodes = mine.groupBy(*node).agg(F.count("*").alias("nq")).join(sizes, node).withColumn(
        "pb", F.ceil(F.col("n") / POINT_BLOCK).cast("int")).withColumn(
        "qb", F.ceil(F.col("nq") / QUERY_BLOCK).cast("int")).select(*node, "pb", "qb")
    # At most len(LENGTHS) numbers.
    used = [r.length for r in queries.select("length").distinct().collect()]
    used = F.array(*[F.lit(x) for x in used]).cast("array<int>")
    there = stored.select("*", F.explode(used).alias("length")).where(
        (F.col("length") > 0) | (F.col("tree") == 0)).withColumn(
        "prefix", _prefix(F.col("length"), bits))
    deal = F.xxhash64("key")
    points = there.join(nodes, node).select(
        *node, F.pmod(deal, F.col("pb")).cast("int").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "key", F.lit(0).alias("role"))
    asks = mine.join(nodes, node).select(
        *node, F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("p"),
        F.pmod(deal, F.col("qb")).cast("int").alias("q"), "key", F.lit(1).alias("role"))
    block = [*node, "p", "q"]
    dealt = points.unionByName(asks).join(distinct.drop("dim"), "key").repartition(*block) \
        .sortWithinPartitions(*block, "role")

    def scored(batches):
        at, points, rows = None, [], []

        def done():
            out = list(_best(rows, points, keep)) if rows and points else []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else ([], [], []), (pa.binary(), pa.binary(), pa.float64()))],
                names=["query", "key", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                here = tuple(row[c] for c in block)
                if here != at:
                    if rows:
                        yield done()
                    at, points, rows = here, [], []
                (rows if row["role"] else points).append(row)
        if rows:
            yield done()

    seen = dealt.mapInArrow(scored, "query binary, key binary, score double")
    # A vector can be seen in several trees.
    return seen.groupBy("query", "key").agg(F.max("score").alias("score"))


def search(table: DataFrame, is_query: Column, id_col: str = "vec_id",
           vec_col: str = "embedding", neighbours: int = NEIGHBOURS, trees: int = TREES,
           recall: float = RECALL, first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``table`` for which
    ``is_query`` (over ``vec_id``) holds, against all others."""
    usable = materialize(vectors(table, id_col, vec_col), "ann-vectors")
    keep = neighbours + 1
    # Smallest ids of equal vectors; one of them may be the query itself.
    members = usable.select("key", "vec_id", F.row_number().over(
        Window.partitionBy("key").orderBy("vec_id")).alias("nth")).where(F.col("nth") <= keep)
    members = materialize(members, "ann-members")
    low = members.where("nth = 1").select("key", F.col("vec_id").alias("low"))
    distinct = materialize(usable.join(low.withColumnRenamed("low", "vec_id"),
                                       ["key", "vec_id"]).withColumnRenamed("vec_id", "low"),
                           "ann-distinct")
    # The forest: sorted arrays of (tree, string).
    stored = materialize(codes(distinct, trees).repartitionByRange("dim", "tree", "code", "key")
                         .sortWithinPartitions("dim", "tree", "code"), "ann-forest")
    asked = usable.where(is_query).select("vec_id", "key")
    queries = asked.select("key").distinct()
    levels = F.array(*[F.lit(x) for x in LENGTHS])
    node = ["dim", "tree", "length", "prefix"]

    def under(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.explode(levels).alias("length")).where(
            (F.col("length") > 0) | (F.col("tree") == 0)).withColumn(
            "prefix", _prefix(F.col("length"), BITS))

    sizes = materialize(under(stored.groupBy("dim", "tree", "code").agg(F.count("*").alias("n")))
                        .groupBy(*node).agg(F.sum("n").alias("n")), "ann-sizes")
    # Descend: the longest prefix with enough candidates in all trees together.
    seen = under(queries.join(stored, "key")).join(sizes, node).groupBy("key", "length").agg(
        F.sum("n").alias("n"))
    start = seen.groupBy("key").agg(F.coalesce(
        F.max(F.when(F.col("n") >= first, F.col("length"))), F.lit(0)).alias("length"))
    start = materialize(start, "ann-start")
    found = materialize(score(start, sizes, stored, distinct, keep), "ann-found")
    # Ascend: as far as the last neighbour found so far calls for.
    by = Window.partitionBy("query").orderBy(F.desc("score"))
    last = found.withColumn("nth", F.row_number().over(by)).groupBy(
        F.col("query").alias("key")).agg(
        F.min(F.when(F.col("nth") == keep, F.col("score"))).alias("edge"))
    needed = start.join(last, "key", "left").withColumn("goal", F.when(
        F.col("edge").isNull(), F.lit(0)).otherwise(
        prefix_length(F.col("edge"), trees, recall)))
    more = needed.where(F.col("goal") < F.col("length")).select("key", F.col("goal").alias("length"))
    more = materialize(more, "ann-more")
    best = found.unionByName(score(more, sizes, stored, distinct, keep)).groupBy(
        "query", "key").agg(F.max("score").alias("score"))
    best = best.join(low, "key").withColumn("nth", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "low"))).where(
        F.col("nth") <= keep).select("query", "key", "score")
    # Back to rows: equal queries share their result, less their own id.
    top = best.join(members.select("key", "vec_id"), "key").withColumn("nth", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(
        F.col("nth") <= keep).select("query", "vec_id", "score")
    rows = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(
        top, "query").where(F.col("query_id") != F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(
        F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 50."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

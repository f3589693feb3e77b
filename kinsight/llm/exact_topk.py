"""Operator 6: exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. Each pair of blocks
gives a sparse histogram of scores, of the highest bins alone that hold its own
k best: bins below them can't hold the global k-th. The histograms are added up
by query, the bin with the k-th value is found, and the scores are refined
within that bin until it is one value wide. Then scores below the k-th value are
dropped, and ties are broken by the smaller id; a pair of blocks passes on k
rows of a query at most, and loses none of the k best.

Blocks are of bounded size, packed as bytes and written to the shared folder;
pairs of blocks are dealt out over tasks, so that no side is broadcast.

Defined results: rows that share a vec_id count once (the row whose vector is
smallest in order); vectors that are null or hold a null or non-finite component
take no part; shorter vectors count as padded with zeros; inner products beyond
the range of a 64-bit integer wrap; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import written

BINS = 1 << 14
BLOCK = "block long, ids binary, rows binary, n long, dim int, square double"


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long> of usable rows, one per id."""
    whole = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(id_col).alias("vec_id"), whole.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite)
    return usable.groupBy("vec_id").agg(F.min(F.transform("v", lambda x: F.floor(x * scale))).alias("v"))


def packed(rows: DataFrame, count: int, size: int, what: str) -> DataFrame:
    """Rows dealt out by a hash of the id into blocks of about `size`, each packed into one row."""
    blocks = max(1, -(-count // size))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        dim = max((len(v) for v in part["v"]), default=0)
        matrix = np.zeros((len(part), dim), np.int64)
        for i, v in enumerate(part["v"]):
            matrix[i, : len(v)] = v
        square = float((matrix.astype(float) ** 2).sum(axis=1).max(initial=0))
        narrow = matrix.astype(np.int32) if np.abs(matrix.astype(float)).max(initial=0) < 2**31 else matrix
        return pd.DataFrame([(key[0], part["vec_id"].to_numpy(np.int64).tobytes(), narrow.tobytes(), len(part), dim, square)], columns=["block", "ids", "rows", "n", "dim", "square"])

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return written(keyed.groupBy("block").applyInPandas(pack, BLOCK), what)


def matrix_of(rows: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(rows, np.int64 if len(rows) == 8 * n * dim else np.int32).reshape(n, dim)


def scores(pair, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, the scores and a mask of each query's own row."""
    q, c = matrix_of(pair.q_rows, pair.q_n, pair.q_dim), matrix_of(pair.c_rows, pair.c_n, pair.c_dim)
    dim = max(pair.q_dim, pair.c_dim)
    q, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, c))
    # sums of whole numbers are exact in floating point below these bounds
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    s = q.astype(kind) @ c.astype(kind).T
    q_ids, c_ids = np.frombuffer(pair.q_ids, np.int64), np.frombuffer(pair.c_ids, np.int64)
    at = np.searchsorted(c_ids, q_ids)
    own = np.flatnonzero((at < len(c_ids)) & (c_ids[np.minimum(at, len(c_ids) - 1)] == q_ids))
    return q_ids, c_ids, s, (own, at[own])


def top_k(vectors: DataFrame, k: int = 20, modulus: int = 20, scale: int = 64, query_block: int = 1024, candidate_block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows; queries are the ids divisible by `modulus`."""
    rows = written(quantised(vectors, scale, id_col, vec_col), "topk-rows")
    is_query = F.col("vec_id") % modulus == 0
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    queries = packed(rows.where(is_query), count.q, query_block, "topk-queries")
    others = packed(rows, count.n, candidate_block, "topk-candidates")
    square = [x.agg(F.coalesce(F.max("square"), F.lit(0.0)), F.coalesce(F.max("block"), F.lit(0))).first() for x in (queries, others)]
    bound = float(np.ceil(np.sqrt(square[0][0] * square[1][0]))) + 1
    n_blocks = square[1][1] + 1
    left = queries.select(*[F.col(x).alias(f"q_{x}") for x in ("block", "ids", "rows", "n", "dim")])
    right = others.select(*[F.col(x).alias(f"c_{x}") for x in ("block", "ids", "rows", "n", "dim")])

    def pairs(ranges: DataFrame | None) -> DataFrame:
        dealt = left if ranges is None else left.join(ranges, "q_block")
        return dealt.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(right.hint("shuffle_hash"), "c_block")

    def histogram(width: float, first: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for pair in frame.itertuples():
                    q_ids, _, s, (own, at) = scores(pair, bound)
                    low = np.full(len(q_ids), -bound) if first else np.frombuffer(pair.low, np.float64)
                    top = np.full(len(q_ids), np.inf) if first else low + float(pair.width)
                    need = np.full(len(q_ids), k) if first else np.frombuffer(pair.need, np.int64)
                    usable = np.ones(s.shape, bool)
                    usable[own, at] = False
                    out_q, out_bin, out_n = [], [], []
                    for i, row in enumerate(s):
                        x = row[usable[i]].astype(np.float64)
                        x = x[(x >= low[i]) & (x < top[i])]
                        if len(x) > need[i]:
                            x = x[x >= np.partition(x, len(x) - need[i])[len(x) - need[i]]]
                        value, n = np.unique(np.floor((x - low[i]) / width), return_counts=True)
                        out_q.append(np.full(len(value), q_ids[i]))
                        out_bin.append(value.astype(np.int64))
                        out_n.append(n)
                    if out_q:
                        yield pd.DataFrame({"query_id": np.concatenate(out_q), "bin": np.concatenate(out_bin), "n": np.concatenate(out_n)})

        return run

    def located(hist: DataFrame, before: DataFrame | None, width: float) -> DataFrame:
        """query_id, low of the bin with the k-th value, and how many are needed from it."""
        summed = hist.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        downwards = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        summed = summed.withColumn("above", F.sum("n").over(downwards.rowsBetween(Window.unboundedPreceding, -1)))
        if before is None:
            base, low, need = summed, F.lit(-bound), F.lit(k).cast("long")
        else:
            base, low, need = summed.join(before.select("query_id", "low", "need"), "query_id"), F.col("low"), F.col("need")
        above = F.coalesce("above", F.lit(0))
        # with fewer than k candidates the lowest bin is kept
        kept = base.where(above < need).groupBy("query_id").agg(F.min(F.struct((low + F.col("bin") * width).alias("low"), (need - above).alias("need"))).alias("x"))
        return kept.select("query_id", "x.low", "x.need")

    def by_block(ranges: DataFrame, width: float) -> DataFrame:
        """The ranges of a block's queries, packed in the order of their ids."""

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("vec_id")
            return pd.DataFrame([(key[0], part["low"].fillna(np.inf).to_numpy(float).tobytes(), part["need"].fillna(0).to_numpy(np.int64).tobytes(), width)], columns=["q_block", "low", "need", "width"])

        blocks = max(1, -(-count.q // query_block))
        keyed = rows.where(is_query).select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("q_block"))
        return keyed.join(ranges, keyed.vec_id == ranges.query_id, "left").groupBy("q_block").applyInPandas(pack, "q_block long, low binary, need binary, width double")

    ranges, width = None, 2 * bound + 1
    while ranges is None or width > 1:
        finer = max(1.0, float(np.ceil(width / BINS)))
        hist = pairs(None if ranges is None else by_block(ranges, width)).mapInPandas(histogram(finer, ranges is None), "query_id long, bin long, n long")
        ranges, width = written(located(hist, ranges, finer), "topk-ranges"), finer

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pair in frame.itertuples():
                q_ids, c_ids, s, (own, at) = scores(pair, bound)
                low = np.frombuffer(pair.low, np.float64)
                usable = s >= low[:, None]
                usable[own, at] = False
                out = []
                for i in np.flatnonzero(usable.any(axis=1)):
                    found = np.flatnonzero(usable[i])
                    order = np.lexsort((c_ids[found], -s[i, found]))[:k]
                    out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[found[order]], "score": s[i, found[order]].astype(np.int64)}))
                if out:
                    yield pd.concat(out)

    found = pairs(by_block(ranges, width)).mapInPandas(best, "query_id long, vec_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

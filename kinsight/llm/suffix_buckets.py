"""Operator 2: removal of repeated byte strings by bucket-pointer refinement.

Positions are put into initial buckets by their q-gram. A bucket is refined by
the bucket identifiers of later offsets: the pair (q-gram at p, q-gram at p+q)
identifies 2q bytes, and that refined identifier, used again at a later offset,
identifies the whole depth. Equal identifiers at the full depth are equal byte
strings, which is all that removal needs of a suffix array: groups of suffixes
with a common prefix of that depth, and the earliest of each group. Identifiers
are 64-bit hashes of their parts instead of ranks, so that every task names a
bucket alike without a global sort; two of them are compared, 128 bits in all.

Only buckets that can repeat are refined. Of every `depth` bytes the q-gram with
the smallest identifier (leftmost on ties) is the window's anchor; equal windows
have equal anchors at equal offsets. Consecutive windows of one anchor form a
run (depths up to a thousand bytes). A run's windows fall into four ranges by the
number of bytes left of the anchor. All windows of a range share their middle
bytes, and a mark of those refines the anchor's bucket once more: a range whose
mark no other run has is done with. Equal runs are whole copies: all but the
earliest go. The windows of ranges that share a mark, in runs that differ, are
refined one by one.

Shuffles carry runs (one for some 35 bytes) after each batch has kept the
earliest of its equal runs. Anchors that a sample shows to be frequent are dealt
out by range and mark, and where those are frequent too by run, so a passage or a
group of copies of any size is spread. Spans are joined to their documents at the
end.

Defined results: a null text counts as empty; rows that share doc_id and text
count as one document and each give a row; texts that differ under one doc_id
are taken at equal places, so that of two strings that start at the same byte
neither is earlier; a null doc_id comes before all others; texts are told apart
by a 64-bit hash; texts of any length are read whole, in parts that overlap by
the depth; documents shorter than the depth are kept whole; an empty table gives
no row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import Scratch, sparing

GRAM = 32
#: Bytes worked on at once.
PIECE = 1 << 20
#: Ranges of a run's windows, and bits of their marks.
RANGES, MARK_BITS = 4, 13
#: A run's place in one number: start, bytes left of the anchor in its first window, number of windows.
FIELD = 10
#: One document in so many is sampled for frequent anchors.
SAMPLE = 50
#: Anchors with more than this share of a sample's runs are dealt out by run.
HEAVY_SHARE = 2000
#: A row whose place has no windows is a stretch known to go, of `marks` windows.
RUNS = "anchor long, run long, doc long, text_hash long, place long, marks long"
WINDOWS = "other long, run long, doc long, text_hash long, start long"
GONE = "doc long, text_hash long, start long, n long"

#: Stands for a null doc_id; the ids themselves are kept beside it.
NULL_DOC = -(1 << 63)

_random = np.random.default_rng(20240229)
TABLE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _random.integers(0, 2, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 5
K1, K2, K3, K4 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, made once per process."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, inverse))
        return cls.up[:n], cls.down[:n]


class Buckets:
    """Bucket identifiers of every position of a byte array."""

    def __init__(self, data: np.ndarray, depth: int):
        up, down = Powers.of(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
        self.sums, self.down = sums, down
        self.gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
        # refinement: identifiers of half the depth come back at later offsets
        two = 2 * GRAM
        double = mix(self.gram[:-GRAM] * K1 + self.gram[GRAM:])
        known = two
        while known < depth:
            step = min(known, depth - known)
            double = mix(double[:-step] * K2 + double[step:])
            known += step
        self.full = double[: len(data) - depth + 1]
        self.other = mix(self.gram[: len(self.full)] * K3 + self.gram[depth - GRAM : depth - GRAM + len(self.full)])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identifiers of the bytes from start to end."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def anchors(self, depth: int) -> np.ndarray:
        """For each window the position of its smallest q-gram, leftmost on ties."""
        bits = np.uint64(max(len(self.gram) - 1, 1).bit_length())
        low = (self.gram >> bits << bits) | np.arange(len(self.gram), dtype=np.uint64)
        width, now = depth - GRAM + 1, 1
        while now < width:
            step = min(now, width - now)
            low = np.minimum(low[:-step], low[step:])
            now += step
        return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def pieces(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the texts of about PIECE bytes: bytes, first byte of each part, its text, its offset in the text.

    A long text is cut into parts that overlap by depth - 1, so each window lies in one part.
    """
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def packed():
        sizes = np.array([len(x) for *_, x in parts])
        return np.frombuffer(b"".join(x for *_, x in parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), np.array([i for i, *_ in parts]), np.array([at for _, at, _ in parts], np.int64)

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - depth + 1, 0), PIECE):
            part = text[at : at + PIECE + depth - 1]
            parts.append((i, at, part))
            held += len(part)
            if held >= PIECE:
                yield packed()
                parts, held = [], 0
    if parts:
        yield packed()


def windows_within(starts: np.ndarray, depth: int) -> np.ndarray:
    """Positions whose window ends in the part it starts in."""
    inside = np.ones(starts[-1] - depth + 1, bool)
    for end in starts[1:-1]:
        inside[max(end - depth + 1, 0) : end] = False
    return np.flatnonzero(inside)


def stretches(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch of consecutive values within a group."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1] + 1) | (groups[1:] != groups[:-1])]))
    return first, np.diff(np.append(first, len(values)))


def range_edges(depth: int) -> list[int]:
    """Ranges of the bytes left of the anchor: range r holds edges[r] to edges[r + 1] - 1."""
    span = depth - GRAM
    return [r * span // RANGES for r in range(RANGES)] + [span + 1]


def runs_of(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """anchor, run identifier, first window, bytes left of the anchor there, number of windows, and marks of each run."""
    buckets = Buckets(data, depth)
    at, windows = buckets.anchors(depth), windows_within(starts, depth)
    first, n = stretches(windows, at[windows])
    begin = windows[first]
    end, anchor = begin + n - 1, at[begin]
    left = anchor - begin
    run = mix(mix(buckets.full[begin] * K4 + buckets.full[end]) + n.astype(np.uint64) * K1 + left.astype(np.uint64))
    edges, marks = range_edges(depth), np.zeros(len(begin), np.uint64)
    for r in range(RANGES):
        # the bytes that all windows of the range hold; a run without such windows gets a mark of no use
        low = np.maximum(anchor - edges[r], 0)
        high = np.minimum(anchor + depth - (edges[r + 1] - 1), len(data))
        marks |= (buckets.stretch(low, high) & np.uint64((1 << MARK_BITS) - 1)) << np.uint64(MARK_BITS * r)
    return buckets.gram[anchor], run, begin, left, n, marks


def not_earliest(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by key, document and start, and whether each starts later than the first row of its key."""
    order = np.lexsort((start, doc, *keys))
    if not len(order):
        return order, np.zeros(0, bool)
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return order, (doc[order] != doc[head]) | (start[order] != start[head])


def merged(doc: np.ndarray, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each stretch of adjoining windows, and its number of windows."""
    order = np.lexsort((start, text, doc))
    if not len(order):
        return order, n
    d, t, s, k = doc[order], text[order], start[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != (s + k)[:-1])]))
    return order[first], np.add.reduceat(k, first)


def contents(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, documents and text hashes of a batch's rows doc, text_hash, text; repeated rows are taken once."""
    doc, name = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
    texts = [t.encode() for t in batch.column("text").to_pylist()]
    seen: set = set()
    for i, key in enumerate(zip(doc.tolist(), name.tolist())):
        if key in seen:
            texts[i] = b""
        seen.add(key)
    return texts, doc, name


def anchored_runs(docs: DataFrame, depth: int) -> DataFrame:
    """The runs of all documents (doc, text_hash, text), each batch's equal runs combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs_, names = contents(batch)
            found = []
            for data, starts, text, offset in pieces(texts, depth):
                anchor, name, begin, left, n, marks = runs_of(data, starts, depth)
                part = np.searchsorted(starts, begin, "right") - 1
                found.append((anchor, name, docs_[text[part]], names[text[part]], begin - starts[part] + offset[part], left, n, marks))
            if not found:
                continue
            anchor, name, doc, text, start, left, n, marks = (np.concatenate(x) for x in zip(*found))
            order, later = not_earliest((name, anchor), doc, start)
            keep, gone = order[~later], order[later]
            head, total = merged(doc[gone], text[gone], start[gone], n[gone])
            head = gone[head]
            # stretches known to go need no partner: a key of their own spreads them
            own = mix(doc[head].astype(np.uint64) * K1 + start[head].astype(np.uint64) + text[head].astype(np.uint64))
            place = start << (2 * FIELD)
            columns = (
                np.concatenate([anchor[keep], own]).view(np.int64), np.concatenate([name[keep], own]).view(np.int64), np.concatenate([doc[keep], doc[head]]), np.concatenate([text[keep], text[head]]),
                np.concatenate([place[keep] | left[keep] << FIELD | n[keep], place[head]]), np.concatenate([marks[keep].view(np.int64), total]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "run", "doc", "text_hash", "place", "marks"])

    return docs.mapInArrow(sparing(run), RUNS)


def window_rows(joined: DataFrame, depth: int) -> DataFrame:
    """The single windows of undecided ranges: joined has doc, text_hash, text and ranges (start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs_, names = contents(batch)
            wanted = batch.column("ranges").to_pylist()
            for data, starts, text, offset in pieces(texts, depth):
                buckets = Buckets(data, depth)
                asked = np.zeros(starts[-1] + 1, np.int32)
                for p in range(len(text)):
                    size = starts[p + 1] - starts[p] - depth + 1
                    for r in wanted[text[p]]:
                        a, b = max(r["start"] - offset[p], 0), min(r["start"] + r["n"] - offset[p], size)
                        if a < b:
                            asked[starts[p] + a] += 1
                            asked[starts[p] + b] -= 1
                at = np.flatnonzero(np.cumsum(asked))
                part = np.searchsorted(starts, at, "right") - 1
                columns = (buckets.other[at].view(np.int64), buckets.full[at].view(np.int64), docs_[text[part]], names[text[part]], at - starts[part] + offset[part])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["other", "run", "doc", "text_hash", "start"])

    return joined.mapInArrow(sparing(run), WINDOWS)


def doc_of(id_col: str = "doc_id"):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_DOC)).alias("doc")


def later_than_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `later`: a row of the same key starts earlier."""
    first = F.min(F.struct("doc", "start")).over(Window.partitionBy(*keys))
    return rows.withColumn("first", first).withColumn("later", (F.col("first.doc") != F.col("doc")) | (F.col("first.start") != F.col("start"))).drop("first")


def repeated_spans(docs: DataFrame, depth: int, keep: Scratch) -> DataFrame:
    """doc, text_hash, start, n of windows that start elsewhere earlier. docs: doc, text_hash, text."""
    edges, n = range_edges(depth), F.col("place") % (1 << FIELD)
    left = F.shiftright("place", FIELD) % (1 << FIELD)
    mark = {r: F.shiftright("marks", MARK_BITS * r) % (1 << MARK_BITS) for r in range(RANGES)}
    # of a run's windows the first has most bytes left of the anchor: range r holds those from `first` to before `last`
    bounds = {r: (F.greatest(left - (edges[r + 1] - 1), F.lit(0)), F.least(left - edges[r] + 1, n)) for r in range(RANGES)}
    present = F.filter(F.array(*[F.when(bounds[r][0] < bounds[r][1], F.struct(F.lit(r).alias("r"), mark[r].alias("mark"))) for r in range(RANGES)]), lambda x: x.isNotNull())
    whole = F.array(F.struct(F.lit(-1).alias("r"), F.lit(0).cast("long").alias("mark")))

    sample = anchored_runs(docs.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0), depth).where(n > 0)
    # what is frequent in the sample: anchors (range -1), and anchors with a range's mark
    counted = keep.written(sample.select("anchor", F.explode(F.concat(whole, present)).alias("l")).groupBy("anchor", "l.r", "l.mark").count().where("count > 1"), "anchor-sample")
    least = counted.agg(F.coalesce(F.sum(F.when(F.col("r") == -1, F.col("count"))), F.lit(0))).first()[0] / HEAVY_SHARE + 2
    # fewer than HEAVY_SHARE anchors, and that many of each range's marks, can exceed that share
    heavy = counted.where(F.col("count") > least)
    anchors = F.broadcast(heavy.where("r = -1").select("anchor", F.lit(True).alias("heavy")))
    marks = F.broadcast(heavy.where("r >= 0").select("anchor", "r", "mark", F.lit(True).alias("hot")))
    # a frequent anchor's runs go by the marks of their ranges, a copy for each; where those are frequent too, by run
    routed = anchored_runs(docs, depth).join(anchors, "anchor", "left").withColumn("known", n == 0)
    routed = routed.withColumn("l", F.explode(F.when(F.col("heavy") & ~F.col("known"), present).otherwise(whole))).select("*", "l.r", "l.mark").drop("l")
    routed = routed.join(marks, ["anchor", "r", "mark"], "left")
    route = F.when(F.col("hot"), F.xxhash64("anchor", "r", "run")).when(F.col("heavy"), F.xxhash64("anchor", "r", "mark")).otherwise(F.col("anchor"))
    routed = routed.withColumn("route", route).repartition("route").withColumn("start", F.shiftright("place", 2 * FIELD))
    open_ = []
    for r in range(RANGES):
        alike = Window.partitionBy("route", "r", mark[r])
        differ = F.coalesce("hot", F.min("run").over(alike) != F.max("run").over(alike))
        open_.append(F.when((bounds[r][0] < bounds[r][1]) & F.col("r").isin(-1, r) & differ, F.struct((F.col("start") + bounds[r][0]).alias("start"), (bounds[r][1] - bounds[r][0]).cast("long").alias("n"))))
    judged = later_than_first(routed, ["route", "r", "anchor", "run"]).withColumn("goes", F.col("known") | F.col("later"))
    judged = judged.withColumn("open", F.when(~F.col("goes"), F.filter(F.array(*open_), lambda x: x.isNotNull())))
    decided = judged.where(F.col("goes") | (F.size("open") > 0)).select("doc", "text_hash", "start", F.when(F.col("known"), F.col("marks")).otherwise(n).cast("long").alias("n"), "goes", "open")
    decided = keep.written(decided, "repeated-runs")

    undecided = decided.where("NOT goes").groupBy(F.col("doc").alias("o_doc"), F.col("text_hash").alias("o_text")).agg(F.flatten(F.collect_list("open")).alias("ranges"))
    joined = docs.join(undecided, (F.col("doc") == F.col("o_doc")) & (F.col("text_hash") == F.col("o_text"))).select("doc", "text_hash", "text", "ranges")
    single = later_than_first(window_rows(joined, depth), ["other", "run"]).where("later").select("doc", "text_hash", "start", F.lit(1).cast("long").alias("n"))
    return decided.where("goes").select("doc", "text_hash", "start", "n").unionByName(keep.written(single, "repeated-windows"))


def remove_repeats(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the kept bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), doc_of(id_col), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    with Scratch(docs.sparkSession) as keep:
        spans = repeated_spans(keyed.select("doc", "text_hash", "text"), depth, keep)
        gone = spans.groupBy(F.col("doc").alias("g_doc"), F.col("text_hash").alias("g_text")).agg(F.collect_list(F.struct("start", "n")).alias("gone"))
        gone = keep.result(gone, "repeated-spans")
    joined = keyed.join(gone, (F.col("doc") == F.col("g_doc")) & (F.col("text_hash") == F.col("g_text")), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, kept, removed, n_spans, at = text.encode(), [], 0, 0, 0
                covered = -1
                for x in sorted(gone or [], key=lambda r: r["start"]):
                    start, end = x["start"], x["start"] + x["n"] - 1 + depth
                    if start > covered:
                        kept.append(data[at:start])
                        n_spans += 1
                        removed -= start
                    else:
                        removed -= covered
                        end = max(end, covered)
                    removed, covered, at = removed + end, end, end
                kept.append(data[at:])
                whole = b"".join(kept)
                for k, v in zip(out, (len(data), removed, n_spans, hashlib.sha256(whole).hexdigest(), whole if keep_text else None)):
                    out[k].append(v)
            arrays = [batch.column(0), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(out["kept"], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return joined.mapInArrow(sparing(run), schema)

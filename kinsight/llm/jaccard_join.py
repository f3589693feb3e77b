"""Operator 9: n-gram Jaccard join with PartEnum signatures.

A document's set is its distinct word shingles, as 64-bit hashes; equal sets are
one node. Sizes fall into bands whose ends grow by the square of 1/threshold, so a
similar pair lies in one band or in two that touch. Each band, and each border
between two, is an instance of its own with a bound H on the elements in which a
similar pair differs. The feature domain is partitioned into groups of three
parts, and from each group the subsets of two parts are enumerated: the content
of a subset, with its group and instance, is a signature. A pair that differs in
h elements has at most h // 2 groups with two differences, so of h // 2 + 1 + S
groups at least 1 + S give it a common signature. Of an instance's groups a set
signs the first so many as its own largest h demands; the smaller set of a pair
signs the fewer.

S pays for groups that say nothing. A group is weak for a set if one of its
subsets is empty or its signature is shared by more than COMMON sets that are not
yet linked with each other. A pair whose common signatures are all weak has more
than S weak groups on both sides. Every other pair meets in 1 + S less the weak
groups of either side signatures at least, which is asked of candidates. Sets
with more than S weak groups, the remainder, are joined among themselves by
prefixes of their rarest elements, which is exact as well. So no pair is lost at
any size of set or group, and nothing is capped.

Candidates are first each node and the one of its groups' first nodes with which
it shares most signatures; the links found make components. Then, in groups that
still hold several components, pairs of different components are counted. All
candidates pass sizes, sketches (counts of elements in a few buckets, whose
distance never exceeds the sets' difference) and last the sets themselves.

Defined results: null and empty texts have the empty set and link with nothing;
texts of fewer than `size` words have one shingle, the whole sequence; texts of
any length are read whole, and a task's memory grows with its longest one; equal
sets are one node and link (nodes are told apart by a 64-bit hash); a similarity
equal to the threshold links; repeated rows each give a row; component ids ignore
null ids unless a component has no other; an empty table gives no row; other
columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import Scratch, give_back, join_spread, sparing
from kinsight.llm.components import components
from kinsight.llm.suffix_buckets import K1, K2, K3, K4, TABLE, Powers, mix

#: Parts of a group, of which all subsets but one part are enumerated.
PARTS = 3
#: S as a share of the groups that the largest h demands.
SPARE = (3, 10)
#: Sets that may share a signature before it counts as a common one.
COMMON = 64
#: Signatures that one task groups at a time.
TASK_SIGNATURES = 1_000_000
#: Rows that are sent to all executors at most; more are met by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a common element's group that are compared with each other at a time.
BLOCK_ROWS = 4096
#: Elements counted at a time, columns of a matrix product, and the share of a block's pairs (one in so many) from which an element is a column.
PASS_ELEMENTS, PASS_COLUMNS, DENSE = 4_000_000, 1024, 64
#: Rounds in which sets of common elements' groups are compared with the groups' first sets.
ROUNDS = 3
#: Bytes of text hashed at once, and documents and bytes signed at once.
PIECE, SLICE_DOCS, SLICE_BYTES = 1 << 20, 500, 1 << 21
#: The least buckets of a sketch.
SKETCH = 128
#: Bits of a signature that travel; a clash costs a comparison.
SIGN_BITS = 30

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SETS = "doc_id long, content long, n long, node long, sketch binary"
LISTS = "list long, low array<long>, high array<long>, between boolean, times long, spare array<int>"


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and its text."""
    if sum(map(len, texts)) > PIECE and len(texts) > 1:
        half = len(texts) // 2
        (a, i), (b, j) = word_hashes(texts[:half]), word_hashes(texts[half:])
        return np.concatenate([a, b]), np.concatenate([i, j + half])
    data = LOWER[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    white = WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    up, down = Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * K2)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
    return hashes, np.searchsorted(starts, begin, "right") - 1


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order of text and hash, and their text."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    whole = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        whole = mix(whole * K3 + words[k : k + len(whole)] + np.uint64(k))
    keep = owner[: len(whole)] == owner[size - 1 : size - 1 + len(whole)]
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        extra[has] = mix(extra[has] * K4 + words[first[short[has]] + k] + np.uint64(k + 1))
    h, o = np.concatenate([whole[keep], extra]), np.concatenate([owner[: len(whole)][keep], short])
    # by text and the upper bits of the hash; in the rare case that these clash, by the whole hash
    key = o.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)
    order = np.argsort(key)
    if len(texts) > 1 << 16 or ((key[order][1:] == key[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
        order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def difference(total, similar: tuple[int, int]):
    """The elements in which similar sets of `total` elements together can differ at most."""
    return total * (similar[1] - similar[0]) // (similar[1] + similar[0])


def largest(n, similar: tuple[int, int]):
    """The size of the largest set that is similar to one of n elements."""
    return n * similar[1] // similar[0]


@functools.cache
def band_ends(similar: tuple[int, int]) -> np.ndarray:
    """First sizes of the bands: the square of 1/threshold apart, so similar sets are at most one band apart."""
    ends = [1]
    while ends[-1] < 1 << 36:
        ends.append(max(ends[-1] * similar[1] ** 2 // similar[0] ** 2, ends[-1] + 1))
    return np.array(ends)


def instances(n: np.ndarray, similar: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Role, instance, groups of the domain, groups that the set signs (0: none), and S, for sets of n elements.

    Role 0: within the set's band; 1: the set is the smaller of a pair over the
    band's upper end; 2: it is the larger of a pair over the band's lower end.
    """
    ends = band_ends(similar)
    band = np.searchsorted(ends, n, "right")
    low, high = ends[np.maximum(band - 1, 0)], ends[band]
    for role in range(3):
        if role == 0:
            instance, takes_part = 2 * band, n > 0
            most, own = difference(2 * (high - 1), similar), difference(n + np.minimum(largest(n, similar), high - 1), similar)
        elif role == 1:
            instance, takes_part = 2 * band + 1, largest(n, similar) >= high
            most, own = difference(high - 1 + largest(high - 1, similar), similar), difference(n + largest(n, similar), similar)
        else:
            instance, takes_part = 2 * band - 1, (band > 1) & (largest(low - 1, similar) >= n)
            most = own = difference(low - 1 + largest(low - 1, similar), similar)
        needed = most // 2 + 1
        spare = -(-needed * SPARE[0] // SPARE[1]) + 1
        # sets that can't differ are equal, and one node
        yield role, instance, needed + spare, np.where(takes_part & (n > 0) & (most > 0), own // 2 + 1 + spare, 0), spare


def signatures(h: np.ndarray, owner: np.ndarray, n: np.ndarray, similar: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets, their set and role; and per set and role the S that empty subsets leave (null roles: a large number)."""
    spare = np.full((len(n), 3), 1 << 20, np.int32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    mixed, u = mix(h * K1 + K2), np.uint64
    for role, instance, domain, signed, s in instances(n, similar):
        base = np.cumsum(signed) - signed
        active = np.flatnonzero((signed > 0)[owner])
        of, z = owner[active], mixed[active]
        # an instance's own odd factor deals the elements out anew
        place = z * (mix(instance.astype(u) * K2 + K3) | u(1))[of]
        group = ((place >> u(32)) * domain.astype(u)[of] >> u(32)).astype(np.int64)
        part = ((place >> u(8) & u(0xFFFFFF)) * u(PARTS) >> u(24)).astype(np.int64)
        mine = group < signed[of]
        content = np.zeros(int(signed.sum()) * PARTS, u)
        np.add.at(content, ((base[of] + group) * PARTS + part)[mine], z[mine])
        content = content.reshape(-1, PARTS)
        named = np.where(content == 0, u(0), mix(content * K4 + np.arange(1, PARTS + 1, dtype=u) * K1))
        whole = named.sum(axis=1)
        sets = np.repeat(np.arange(len(n)), signed)
        where = mix(instance[sets].astype(u) * K3 + (np.arange(len(sets)) - base[sets]).astype(u) * u(PARTS + 1))
        weak = np.zeros(len(sets), bool)
        for left_out in range(PARTS):
            subset = whole - named[:, left_out]
            filled = subset != 0
            weak |= ~filled
            found.append((mix(subset * K2 + where + u(left_out))[filled], sets[filled], np.full(int(filled.sum()), role)))
        takes_part = signed > 0
        spare[takes_part, role] = (s - np.bincount(sets, weak, minlength=len(n)).astype(np.int64))[takes_part]
    return *(np.concatenate(x) for x in zip(*found)), spare


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of batches (text in column 1): the part, its shingles, their text, the sets' sizes and nodes.

    A set's node is a 64-bit hash of its elements, so equal sets are one node wherever they are.
    """
    for whole in batches:
        column = pc.fill_null(whole.column(1), "").cast(pa.binary())
        lengths = pc.binary_length(column).to_pylist()
        at = 0
        while at < len(lengths):
            end, held = at, 0
            while end < len(lengths) and end - at < SLICE_DOCS and (end == at or held + lengths[end] <= SLICE_BYTES):
                held, end = held + lengths[end], end + 1
            h, owner = shingles(column.slice(at, end - at).to_pylist(), size)
            n = np.bincount(owner, minlength=end - at)
            sums = np.zeros(end - at, np.uint64)
            np.add.at(sums, owner, mix(h * K1 + K3))
            yield whole.slice(at, end - at), h, owner, n, mix(sums + n.astype(np.uint64) * K4).view(np.int64)
            at = end


def first_of_each(node: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Marks the first of a slice's equal sets; empty sets are left out."""
    fresh = np.zeros(len(node), bool)
    fresh[np.unique(node, return_index=True)[1]] = True
    return fresh & (n > 0)


def sketch_of(h: np.ndarray) -> bytes:
    """Counts of elements by bucket; about a quarter as many buckets as elements, a power of two of them."""
    buckets = max(SKETCH, 1 << int(len(h) - 1).bit_length() >> 2)
    return np.minimum(np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Never more than the number of elements in which the sets differ."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int32) for s in (a, b))
    while len(x) != len(y):
        if len(x) > len(y):
            x = x.reshape(2, -1).sum(axis=0)
        else:
            y = y.reshape(2, -1).sum(axis=0)
    return int(np.abs(x - y).sum())


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """A row per document (doc_id, text, content) with its node; the first of a slice's equal sets carries the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, owner, n, node in slices(batches, size):
            fresh = first_of_each(node, n)
            stops = np.cumsum(n)
            sketches = [sketch_of(h[stop - k : stop]) if f else None for f, stop, k in zip(fresh.tolist(), stops.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(node), pa.array(sketches, pa.binary())], ["doc_id", "content", "n", "node", "sketch"])

    return docs.mapInArrow(sparing(run), SETS)


def signature_lists(docs: DataFrame, parts: int, size: int, similar: tuple[int, int]) -> DataFrame:
    """The lists of nodes that share a signature, each with the number of signatures (`times`) that a task found it for.

    low: the nodes of a band, or the smaller sets over a border; high: the larger
    ones there (`between`). Rows with `spare` hold instead a node, as `list`, and
    what empty subsets leave of its S by role. docs: doc_id, text.
    """
    u, nested_type = np.uint64, pa.list_(pa.int64())
    met_schema = pa.schema([("list", pa.int64()), ("low", nested_type), ("high", nested_type), ("between", pa.bool_()), ("times", pa.int64()), ("spare", pa.list_(pa.int32()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, owner, n, node in slices(batches, size):
            fresh = first_of_each(node, n)
            keep = fresh[owner]
            if not keep.any():
                continue
            names = node[fresh]
            s, sets, role, spare = signatures(h[keep], (np.cumsum(fresh) - 1)[owner[keep]], n[fresh], similar)
            part = s % u(parts)
            entries = ((s // u(parts)) & u((1 << SIGN_BITS) - 1)) << u(2) | role.astype(u)
            # twelve bytes an entry at any number of parts; a part's entries come in order
            order = np.argsort(part << u(SIGN_BITS + 2) | entries)
            part, entries, members = part[order], entries[order].astype("<u4"), names[sets[order]]
            at = np.unique(part, return_index=True)[1]
            rows = [(int(names[0] % parts), None, names.tobytes(), spare.astype("<i4").tobytes())]
            rows += [(int(part[a]), entries[a:b].tobytes(), members[a:b].tobytes(), None) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)])]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entries", "nodes", "spare"])

    def meet(table: pa.Table) -> pa.Table:
        give_back()
        is_set = pc.is_null(table.column("entries"))
        return pa.concat_tables([spares(table.filter(is_set)), shared(table.filter(pc.invert(is_set)))])

    def spares(table: pa.Table) -> pa.Table:
        names, spare = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("nodes", np.int64), ("spare", "<i4")))
        nothing = pa.nulls(len(names), pa.list_(pa.int64()))
        held = pa.ListArray.from_arrays(pa.array(np.arange(0, len(spare) + 1, 3).astype(np.int32)), pa.array(spare))
        return pa.Table.from_arrays([pa.array(names), nothing, nothing, pa.nulls(len(names), pa.bool_()), pa.array(np.ones(len(names), np.int64)), held], schema=met_schema)

    def shared(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return met_schema.empty_table()
        entries, nodes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("entries", "<u4"), ("nodes", np.int64)))
        # most signatures occur once
        order = np.argsort(entries, kind="stable")
        entries, nodes = entries[order], nodes[order]
        same = (entries[1:] >> 2) == (entries[:-1] >> 2)
        often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        entries, nodes = entries[often], nodes[often]
        if not len(entries):
            return met_schema.empty_table()
        names, member = np.unique(nodes, return_inverse=True)
        # signature, whether it is one of a border, node, role
        key = (entries >> 2).astype(u) << u(34) | ((entries & 3) > 0).astype(u) << u(33) | member.astype(u) << u(2) | (entries & 3).astype(u)
        key = np.unique(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> u(33) != key[:-1] >> u(33)]))
        between, high = (key >> u(33) & u(1)).astype(bool), (key & u(3)) == 2
        total = np.diff(np.append(first, len(key)))
        highs = np.add.reduceat(high.astype(np.int64), first)
        useful = np.where(between[first], (highs > 0) & (highs < total), total > 1)
        # of equal lists one is kept, with their number
        mark = np.add.reduceat(mix((names[((key >> u(2)) & u((1 << 31) - 1)).astype(np.int64)].view(u) + (key & u(3)) * K1)), first)
        lists, which, times = np.unique(mark[useful], return_index=True, return_counts=True)
        at = first[useful][which]
        size_, n_high, over = total[useful][which], highs[useful][which], between[at]
        rows = np.repeat(at - (np.cumsum(size_) - size_), size_) + np.arange(size_.sum())
        node, is_high = names[((key[rows] >> u(2)) & u((1 << 31) - 1)).astype(np.int64)], high[rows]

        def nested(pick: np.ndarray, counts: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(node[pick]))

        arrays = [pa.array(lists.view(np.int64)), nested(~is_high, size_ - n_high), nested(is_high, n_high), pa.array(over), pa.array(times.astype(np.int64)), pa.nulls(len(lists), pa.list_(pa.int32()))]
        return pa.Table.from_arrays(arrays, schema=met_schema)

    dealt = docs.select("doc_id", "text").mapInArrow(sparing(sign), "part long, entries binary, nodes binary, spare binary")
    met = dealt.groupBy("part").applyInArrow(meet, LISTS)
    return met.groupBy("list", F.col("spare").isNotNull().alias("is_node")).agg(*[F.first(c).alias(c) for c in ("low", "high", "between")], F.sum("times").alias("times"), F.first("spare").alias("spare"))


def sides(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(table.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in ("a", "b"))


def elements_of(wanted: DataFrame, docs: DataFrame, size: int, keep: Scratch) -> DataFrame:
    """node, elements (the set's hashes) of the wanted nodes (node, first), made from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _, n, node in slices(batches, size):
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), held], ["node", "elements"])

    keys = keep.written(wanted.select(F.col("first.doc_id").alias("_id"), F.col("first.content").alias("_content")).distinct(), "wanted")
    total = keys.count()
    if total <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")), "left_semi").select("doc_id", "text")
    held = keep.written(texts.mapInArrow(sparing(run), "node long, elements array<long>"), "elements")
    # more rows than keys come of repeated rows alone
    return held.dropDuplicates(["node"]) if held.count() > total else held


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similar: tuple[int, int], keep: Scratch) -> DataFrame:
    """The pairs a, b of nodes whose sets reach the threshold: by size, by sketch, then by the sets themselves."""
    num, den = similar

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("a_n").to_numpy() + b.column("b_n").to_numpy()
            most = difference(total, similar).tolist()
            close = [sketch_distance(x.as_py(), y.as_py()) <= m for x, y, m in zip(b.column("a_sketch"), b.column("b_sketch"), most)]
            yield b.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    a, b = sides(nodes, ["n", "sketch"])
    # the sizes alone rule out what one set can't make up
    sized = pairs.join(a, "a").join(b, "b").where(F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num)
    close = keep.written(sized.mapInArrow(sparing(near), "a long, b long"), "close-pairs")
    ends = close.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first"), "node")
    return keep.written(linked(close, elements_of(ends, docs, size, keep), similar), "links")


def across(members: DataFrame, key: str, similar: tuple[int, int], extra: list[str], rule=None) -> DataFrame:
    """Pairs a < b of different components within groups of at most COMMON members whose sizes allow a link."""
    num, den = similar
    x, y = (members.select(key, *[F.col(c).alias(f"{s}_{c}") for c in ("node", "label", "n", *extra)], *([F.col("times")] if s == "a" and "times" in members.columns else [])) for s in ("a", "b"))
    met = x.join(y, key).where("a_node < b_node AND a_label != b_label").where(F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num)
    return met if rule is None else met.where(rule)


def linked(pairs: DataFrame, held: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs a, b whose sets (held: node, elements) reach the threshold."""
    num, den = similar
    a, b = sides(held, ["elements"])
    met = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("a_elements", "b_elements")))
    return met.where(F.col("common") * den >= (F.size("a_elements") + F.size("b_elements") - F.col("common")) * num).select("a", "b")


def gathered(members: DataFrame, keep: Scratch) -> DataFrame:
    """members, with the groups that hold each other's nodes made one where that means fewer comparisons.

    Sets of one template share many common elements, and each of these would bring
    the same sets together again. `element` is then the joint group's first node;
    a clash with another group's element costs comparisons alone.
    """
    heads = members.groupBy("element").agg(F.min("node").alias("a"))
    edges = members.join(heads, "element").where("node != a").select("a", F.col("node").alias("b")).distinct()
    joint = components(edges, keep).withColumnRenamed("label", "joint")
    rows = keep.written(members.join(joint, "node", "left").withColumn("joint", F.coalesce("joint", "node")), "joint-members")
    apart = rows.groupBy("joint", "element").agg(F.count("*").alias("c")).groupBy("joint").agg(F.sum(F.col("c") * F.col("c")).alias("apart"))
    nodes = rows.select("joint", "node", "label", "n").distinct()
    one = nodes.groupBy("joint").agg(F.count("*").alias("c")).join(apart, "joint").where("c * c <= apart").select("joint")
    whole = nodes.join(one, "joint").select(F.col("joint").alias("element"), "node", "label", "n")
    return keep.written(rows.join(one, "joint", "left_anti").select("element", "node", "label", "n").unionByName(whole), "gathered")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each set of a shares with each of b: frequent elements by matrix products, rare ones pair by pair."""
    out = np.zeros((len(a), len(b)), np.float32)
    passes = -(-sum(map(len, a + b)) // PASS_ELEMENTS)
    for p in range(passes):
        sets = [x[x % np.uint64(passes) == p] for x in a + b] if passes > 1 else a + b
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
        if not len(first):
            continue
        total, mine = np.diff(np.append(first, len(flat))), np.add.reduceat((of < len(a)).astype(np.int64), first)
        theirs = total - mine
        dense = mine * theirs * DENSE > len(a) * len(b)
        columns = np.flatnonzero(dense)
        for at in range(0, len(columns), PASS_COLUMNS):
            part = columns[at : at + PASS_COLUMNS]
            x = np.zeros((len(sets), len(part)), np.float32)
            x[of[np.repeat(first[part] - np.cumsum(total[part]) + total[part], total[part]) + np.arange(total[part].sum())], np.repeat(np.arange(len(part)), total[part])] = 1
            out += x[: len(a)] @ x[len(a) :].T
        columns = np.flatnonzero(~dense & (mine > 0) & (theirs > 0))
        pairs = np.cumsum(mine[columns] * theirs[columns])
        for part in np.split(columns, np.searchsorted(pairs, np.arange(PASS_ELEMENTS, pairs[-1] if len(pairs) else 0, PASS_ELEMENTS))):
            each = mine[part] * theirs[part]
            k, j = np.repeat(part, each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            np.add.at(out, (of[first[k] + j // theirs[k]], of[first[k] + mine[k] + j % theirs[k]] - len(a)), 1)
    return out


def in_blocks(members: DataFrame, held: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links that join the components met in groups of any size. members: element, node, label, n.

    A group's largest component needs no comparison within itself: the others'
    sets are compared with all sets, block by block. A task yields a link for
    each two components that it finds joined, so no more links than sets.
    """

    def compare(table: pa.Table) -> pa.Table:
        left, node, label, n = (table.column(c).to_numpy() for c in ("left", "node", "label", "n"))
        sets = [np.asarray(x.values).view(np.uint64) for x in table.column("elements")]
        names, place = np.unique(label, return_inverse=True)
        root, out = np.arange(len(names)), []
        lefts, rights = np.flatnonzero(left), np.flatnonzero(~left)
        counts = shared_counts([sets[x] for x in lefts], [sets[y] for y in rights])
        for x, row in zip(lefts.tolist(), counts):
            common = row.astype(np.int64)
            near = rights[common * similar[1] >= (n[rights] + n[x] - common) * similar[0]]
            while len(near := near[root[place[near]] != root[place[x]]]):
                out.append((node[x], node[near[0]]))
                root[root == root[place[x]]] = root[place[near[0]]]
        give_back()
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    sizes = members.groupBy("element", "label").agg(F.count("*").alias("of_label")).groupBy("element").agg(F.max_by("label", F.struct("of_label", "label")).alias("main"), F.sum("of_label").alias("size"), F.max("of_label").alias("most"))
    rows = members.join(sizes, "element").withColumn("blocks", F.ceil((F.col("size") - F.col("most")) / BLOCK_ROWS)).where("blocks > 0")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    lefts = rows.where("label != main").withColumns({"i": mine, "j": F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK_ROWS) - 1)), "left": F.lit(True)})
    rights = rows.withColumns({"i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "j": F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("size") / BLOCK_ROWS)), "left": F.lit(False)})
    placed = lefts.unionByName(rights).select("element", "i", "j", "left", "node", "label", "n").join(held, "node")
    return placed.groupBy("element", "i", "j").applyInArrow(compare, "a long, b long")


def remainder(rest: DataFrame, docs: DataFrame, size: int, similar: tuple[int, int], keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs and links a, b among the nodes of the remainder (node, first, n, label): similar ones share one of their rarest elements."""
    num, den = similar
    held = keep.written(elements_of(rest, docs, size, keep), "remainder-sets")
    elements = held.select("node", F.explode("elements").alias("element"))
    counted = elements.groupBy("element").agg(F.count("*").alias("often")).withColumn("seen", F.col("often"))
    # elements of one set alone tell nothing, but come first in the order
    known = join_spread(elements, keep.written(counted.where("often > 1"), "often"), "element", "seen", "often")
    order = Window.partitionBy("node").orderBy(F.coalesce("seen", F.lit(1)), "element")
    ranked = known.withColumn("rank", F.row_number().over(order)).join(rest.select("node", "n"), "node")
    prefix = keep.written(ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1) & F.col("seen").isNotNull()).select("element", "node", "n"), "prefixes")
    shared = prefix.groupBy("element").agg(F.count("*").alias("size")).where("size > 1")
    members = keep.written(prefix.join(shared, "element"), "prefix-members")
    labels, links, large = rest.select("node", "label"), [], members.where(F.col("size") > COMMON)
    for _ in range(ROUNDS):
        rows = large.join(labels, "node")
        heads = rows.groupBy("element").agg(F.min(F.struct("label", "node")).alias("head"), F.max("label").alias("most")).where("head.label != most")
        scored = rows.join(heads, "element").where("label != head.label").groupBy(F.col("node").alias("b"), F.col("head.node").alias("a")).agg(F.count("*").alias("score"))
        found = keep.written(linked(scored.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a")), held, similar), "links")
        if not found.take(1):
            break
        links.append(found)
        a, b = sides(labels, ["label"])
        joined = components(found.join(a, "a").join(b, "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), keep)
        moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("onwards")), "label", "left")
        labels = keep.written(moved.select("node", F.coalesce("onwards", "label").alias("label")), "labels")
    rows = members.join(labels, "node")
    open_ = rows.groupBy("element").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("element")
    rows = keep.written(rows.join(open_, "element"), "open-prefixes")
    few = across(rows.where(F.col("size") <= COMMON), "element", similar, []).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    links.append(keep.written(in_blocks(gathered(rows.where(F.col("size") > COMMON).drop("size"), keep), held, similar), "block-links"))
    return few, functools.reduce(DataFrame.unionByName, links)


def labelled_documents(docs: DataFrame, size: int = 5, similar: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (hash of the text), n (size of the set) and label (of the component) per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("content"))
    with Scratch(docs.sparkSession, SLICE_DOCS) as keep:
        sets = keep.written(shingle_sets(docs, size), "shingle-sets")
        # one row per different set, with the first document that has it
        nodes = sets.where("sketch IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "content")).alias("first"))
        nodes = keep.written(nodes, "nodes")
        total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found = keep.written(signature_lists(docs, max(16, -(-int(total) * 5 // (4 * TASK_SIGNATURES))), size, similar), "signature-lists")
        lists, spares = found.where("NOT is_node"), found.where("is_node").select(F.col("list").alias("node"), "spare")

        head = F.least(F.array_min("low"), F.array_min("high"))
        starred = lists.select(head.alias("a"), F.explode(F.concat("low", "high")).alias("b"), "times").where("a != b")
        scored = starred.groupBy("b", "a").agg(F.sum("times").alias("score"))
        best = scored.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a")).select("a", "b")
        links = verified(best, nodes, docs, size, similar, keep)
        labels = components(links, keep)

        about = nodes.select("node", "n", "first").join(spares, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        about = keep.written(about, "labelled-nodes")
        low = F.transform("low", lambda x: F.struct(F.when(F.col("between"), 1).otherwise(0).alias("role"), x.alias("node")))
        high = F.transform("high", lambda x: F.struct(F.lit(2).alias("role"), x.alias("node")))
        rows = lists.select("list", "times", (F.size("low") + F.size("high")).alias("size"), F.explode(F.concat(low, high)).alias("m")).select("list", "times", "size", "m.role", "m.node")
        rows = rows.join(about.drop("first"), "node").withColumn("spare", F.element_at("spare", F.col("role") + 1))
        open_ = rows.groupBy("list").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("list")
        rows = keep.written(rows.join(open_, "list"), "open-lists")

        # what common signatures take from the S of a node in a role
        commons = rows.where(F.col("size") > COMMON).groupBy("node", "role").agg(F.sum("times").alias("commons"))
        commons = keep.written(commons, "commons")
        few = rows.where(F.col("size") <= COMMON).join(commons, ["node", "role"], "left").withColumn("spare", F.col("spare") - F.coalesce("commons", F.lit(0)))
        need = F.greatest("a_spare", "b_spare")
        official = ((F.col("a_role") == 0) & (F.col("b_role") == 0)) | (F.col("a_role") + F.col("b_role") == 3)
        met = across(few, "list", similar, ["role", "spare"], official & (need >= 0))
        counted = met.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.sum("times").alias("shared"), F.max(need).alias("need")).where("shared > need").select("a", "b")

        left = about.select("node", F.posexplode("spare").alias("role", "spare")).join(commons, ["node", "role"], "left")
        weak = left.where(F.col("spare") < F.coalesce("commons", F.lit(0))).select("node").distinct()
        rest = keep.written(about.join(weak, "node").select("node", "n", "first", "label"), "remainder-nodes")
        pairs, extra = remainder(rest, docs, size, similar, keep)
        candidates = keep.written(counted.unionByName(pairs).distinct(), "candidates")
        more = verified(candidates, nodes, docs, size, similar, keep).unionByName(extra)
        if more.take(1):
            labels = components(links.unionByName(more), keep)

        told = sets.select("doc_id", "content", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return keep.result(told.select("doc_id", "content", "n", "label"), "labelled-documents")


def similar_components(docs: DataFrame, size: int = 5, similar: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    told = labelled_documents(docs, size, similar, id_col, text_col)
    least = told.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c"))
    linked = join_spread(told.where("n > 0"), least, "label", "component_id", "c")
    alone = told.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def keep_one(docs: DataFrame, size: int = 5, similar: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, less all but one of each component; texts without words stay."""
    told = labelled_documents(docs, size, similar, id_col, text_col).where("n > 0")
    first = told.groupBy("label").agg(F.min(F.struct("doc_id", "content")).alias("first"))
    stays = first.select(F.col("first.doc_id").alias("_id"), F.col("first.content").alias("_content"))
    keyed = docs.withColumn("_key", F.xxhash64(text_col)).withColumn("_worded", F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    met = keyed.where("_worded").join(stays, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_content")))
    nth = F.row_number().over(Window.partitionBy(id_col, "_key").orderBy(F.lit(0)))
    one = met.withColumn("_nth", nth).where("_nth = 1")
    return one.select(docs.columns).unionByName(keyed.where("NOT _worded").select(docs.columns))

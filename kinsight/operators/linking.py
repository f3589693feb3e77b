"""Cross-device links and the identity graph, as edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_devices(sessions: DataFrame, least: int = 5) -> DataFrame:
    """device_id, account_id, n, avg_duration of devices with enough sessions."""
    return sessions.groupBy("device_id").agg(F.count("*").alias("n"), F.min("account_id").alias("account_id"), F.avg("total_duration").alias("avg_duration")).where(F.col("n") >= least)


def cosine_pairs(rows: DataFrame, key: str, value: str, amount: str, name: str) -> DataFrame:
    """a, b, cosine of all pairs a < b of keys that share a value; norms are over all values."""
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col(amount) * F.col(amount))).alias("norm"))
    full = rows.join(norms, key)
    a = full.select(F.col(key).alias("a"), value, F.col(amount).alias("x"), F.col("norm").alias("na"))
    b = full.select(F.col(key).alias("b"), value, F.col(amount).alias("y"), F.col("norm").alias("nb"))
    products = a.join(b, value).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return products.select("a", "b", F.when(F.col("na") * F.col("nb") > 0, F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias(name))


#: Devices and sessions of a block at most, blocks at least, pairs of devices and of sessions that a task holds at a time.
PAIR_DEVICES, PAIR_SESSIONS, PAIR_BLOCKS, PAIR_CELLS, PAIR_STARTS = 20_000, 400_000, 4, 1 << 19, 1 << 21


def dealt(rows: DataFrame, blocks: int | Column) -> DataFrame:
    """Rows of devices with their block, _mine, once for each pair of blocks, _i <= _j, that it is part of."""
    blocks = F.lit(blocks)
    mine = F.pmod(F.xxhash64("device_id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return rows.withColumn("_mine", mine).withColumn("_other", other).withColumns({"_i": F.least("_mine", "_other"), "_j": F.greatest("_mine", "_other")}).drop("_other")


def temporal_pairs(sessions: DataFrame, minutes: int = 30) -> DataFrame:
    """a, b, closeness, pairs: sum of 1 - gap / window over session pairs that start within the window, and their number.

    Every pair of blocks of devices is one task's, which counts it slice by slice
    and yields each slice's rows: no pair is shuffled, and none waits for the others.
    """
    width = minutes * 60_000_000
    rows = sessions.where("device_id IS NOT NULL").groupBy("device_id").agg(F.sort_array(F.collect_list(F.unix_micros("start_time"))).alias("times")).where(F.size("times") > 0)
    n_devices, n_sessions = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("times")), F.lit(0))).first()
    blocks = max(PAIR_BLOCKS, -(-n_devices // PAIR_DEVICES), -(-n_sessions // PAIR_SESSIONS))
    cells, starts = PAIR_CELLS, PAIR_STARTS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("device_id").combine_chunks()
        i, j, own = table.column("_i")[0].as_py(), table.column("_j")[0].as_py(), table.column("_mine").to_numpy()
        device, times = (pa.concat_arrays(table.column(c).chunks) for c in ("device_id", "times"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        t, of_t = starts_of(times, left)
        u, of_u = starts_of(times, right)
        order = np.argsort(u, kind="stable")
        u, of_u = u[order], of_u[order]
        step = max(1, cells // max(1, len(right)))
        for begin in range(0, len(left) if len(right) else 0, step):
            size = min(step, len(left) - begin) * len(right)
            near, met = np.zeros(size), np.zeros(size, np.int64)
            at, end = np.searchsorted(of_t, [begin, begin + step])
            first, last = np.searchsorted(u, t[at:end] - width, "left"), np.searchsorted(u, t[at:end] + width, "right")
            upto = np.cumsum(last - first)
            done = 0
            while done < end - at:
                stop = max(done + 1, int(np.searchsorted(upto, starts + (upto[done - 1] if done else 0), "right")))
                k = (last - first)[done:stop]
                x = np.repeat(np.arange(at + done, at + stop), k)
                y = np.arange(len(x)) + np.repeat(first[done:stop] - (np.cumsum(k) - k), k)
                pair = (of_t[x] - begin) * len(right) + of_u[y]
                near += np.bincount(pair, 1 - np.abs(t[x] - u[y]) / width, size)
                met += np.bincount(pair, minlength=size)
                done = stop
            found = np.flatnonzero(met)
            x, y = left[begin + found // len(right)], right[found % len(right)]
            if i == j:
                found, x, y = found[x < y], x[x < y], y[x < y]
            yield pa.RecordBatch.from_arrays([device.take(pa.array(np.minimum(x, y))), device.take(pa.array(np.maximum(x, y))), pa.array(near[found]), pa.array(met[found])], ["a", "b", "closeness", "pairs"])

    return dealt(rows, blocks).repartition(blocks * (blocks + 1) // 2, "_i", "_j").groupBy("_i", "_j").applyInArrow(compare, "a string, b string, closeness double, pairs long")


def starts_of(times: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The times of some rows one after the other, and for each the place of its row among them."""
    some = times.take(pa.array(rows))
    return some.flatten().to_numpy(), np.repeat(np.arange(len(rows)), some.value_lengths().to_numpy())


def login_pairs(sessions: DataFrame) -> DataFrame:
    """a, b, login: accounts in common over the larger number of accounts."""
    used = sessions.select("device_id", "account_id").distinct()
    sized = used.join(used.groupBy("device_id").agg(F.count("*").alias("k")), "device_id")
    a = sized.select(F.col("device_id").alias("a"), "account_id", F.col("k").alias("ka"))
    b = sized.select(F.col("device_id").alias("b"), "account_id", F.col("k").alias("kb"))
    met = a.join(b, "account_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"), F.first("ka").alias("ka"), F.first("kb").alias("kb"))
    return met.select("a", "b", (F.col("common") / F.greatest("ka", "kb")).alias("login"))


def combined(signals: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted mean of the present (positive) signals, and its link probability."""
    weight = sum((F.when(c > 0, w).otherwise(0.0) for c, w in signals.values()), F.lit(0.0))
    total = sum((F.when(c > 0, c * w).otherwise(0.0) for c, w in signals.values()), F.lit(0.0))
    score = F.when(weight > 0, total / weight).otherwise(0.0)
    return score, F.when(weight > 0, 1 / (1 + F.exp(-(2 * score - 1)))).otherwise(0.0)


def device_links(sessions: DataFrame, genres: DataFrame, threshold: float = 0.7, least: int = 5) -> DataFrame:
    """a, b, login, temporal, behavioral, score, probability of links at or above the threshold, both devices having enough sessions.

    Every pair of devices is judged, block by block; devices that are alike are judged once.
    """
    devices = usable_devices(sessions, least)
    kept = sessions.join(devices.select("device_id"), "device_id", "left_semi")
    ids = devices.select("device_id", "n", "avg_duration")
    hour = vectors_of(kept.groupBy("device_id", "hour_of_day").agg(F.count("*").cast("double").alias("x")), "hour_of_day", "hours")
    genre = vectors_of(genres.join(devices.select("device_id"), "device_id", "left_semi").groupBy("device_id", "genre").agg(F.sum("seconds").alias("x")), "genre", "genres")
    times = kept.groupBy("device_id").agg(F.sort_array(F.collect_list(F.unix_micros("start_time"))).alias("times"), F.array_sort(F.collect_set("account_id")).alias("accounts"))
    rows = ids.join(times, "device_id").join(hour, "device_id", "left").join(genre, "device_id", "left")
    prepare_checkpoints(sessions.sparkSession)
    return paired(rows.checkpoint(), threshold)  # read more than once


def vectors_of(amounts: DataFrame, value: str, name: str) -> DataFrame:
    """device_id and its amounts x by value, as sorted entries."""
    return amounts.where(F.col(value).isNotNull()).groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("v"), "x"))).alias(name))


def unit_vectors(values: pa.ChunkedArray, amounts: pa.ChunkedArray) -> np.ndarray:
    """A row of unit length for each list of values and its amounts, zero where it has no length; columns by value."""
    lists = values.combine_chunks()
    names = lists.flatten().dictionary_encode()
    place = np.argsort(np.argsort(np.array(names.dictionary.to_pylist(), dtype=object)))
    out = np.zeros((len(lists), len(place)))
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    out[row, place[names.indices.to_numpy()]] = pc.fill_null(amounts.combine_chunks().flatten(), 0.0).to_numpy(zero_copy_only=False)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


#: Devices that are compared with as many others by a task, and of these at a time on either side.
BLOCK_DEVICES, SLICE_DEVICES, SLICE_OTHERS = 30_000, 250, 4096
#: Pairs that are scored at a time.
SCORED_PAIRS = 1 << 17
#: What products of single precision may be off by.
SINGLE = 1e-4


class Profiles:
    """What pairs of devices are scored by, of a table with n, avg_duration, times, hours and genres with their amounts."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.n, self.length = table.column("n").to_numpy().astype(float), table.column("avg_duration").to_numpy().astype(float)
        self.hours, self.genres = (unit_vectors(table.column(c), table.column(f"{c}_x")) for c in ("hours", "genres"))
        lists = table.column("times").combine_chunks()
        self.t, self.size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.begin, self.owner = np.cumsum(self.size) - self.size, np.repeat(np.arange(len(lists)), self.size)
        # owner and rank of the time in one number: sorted, and past no limit at any span of times
        ranks = np.unique(self.t)
        self.span = len(ranks) + 1
        self.key = self.owner * self.span + np.searchsorted(ranks, self.t)
        self.low, self.high = np.searchsorted(ranks, self.t - width, "left"), np.searchsorted(ranks, self.t + width, "right")
        together = np.searchsorted(self.key, self.owner * self.span + np.searchsorted(ranks, self.t + 2 * width, "right")) - np.arange(len(self.t))
        #: sessions of the device, at most, that are within the width of one moment
        self.crowd = np.zeros(len(lists), np.int64)
        np.maximum.at(self.crowd, self.owner, together)

    def closeness(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum of 1 - gap / width over times of each x and each y that are at most the width apart."""
        pair, at = spread(self.begin[x], self.size[x])
        first = np.searchsorted(self.key, y[pair] * self.span + self.low[at], "left")
        last = np.searchsorted(self.key, y[pair] * self.span + self.high[at], "left")
        of, other = spread(first, last - first)
        return np.bincount(pair[of], 1 - np.abs(self.t[at[of]] - self.t[other]) / self.width, len(x))

    def behavioral(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        longest = np.fmax(self.length[x], self.length[y])
        ratio = np.divide(np.fmin(self.length[x], self.length[y]), longest, out=np.zeros_like(longest), where=longest > 0)
        alike = np.einsum("ij,ij->i", self.hours[x], self.hours[y]) + np.einsum("ij,ij->i", self.genres[x], self.genres[y])
        return (alike + ratio) / np.where(longest > 0, 3, 2)

    def score(self, x: np.ndarray, y: np.ndarray, login: np.ndarray) -> tuple[np.ndarray, ...]:
        """login, temporal, behavioral, score, probability of pairs."""
        temporal, behavioral = np.minimum(1.0, self.closeness(x, y) / np.minimum(self.n[x], self.n[y])), self.behavioral(x, y)
        signals = ((temporal, 2.0), (behavioral, 1.5), (login, 5.0))
        weight, total = sum((c > 0) * w for c, w in signals), sum(np.where(c > 0, c * w, 0.0) for c, w in signals)
        score = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)
        return login, temporal, behavioral, score, np.where(weight > 0, 1 / (1 + np.exp(-(2 * score - 1))), 0.0)

    def alike(self, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of left and right whose behavioral signal is at least so much, and some more.

        The cosines of hours and genres are one product of matrices; what durations
        can add to them is bounded for both slices, which are sorted by duration.
        """
        both = np.hstack([self.hours, self.genres]).astype(np.float32)
        known = np.where(self.length > 0, self.length, 0.0)
        left, right = left[np.argsort(known[left], kind="stable")], right[np.argsort(known[right], kind="stable")]
        for i in range(0, len(left), SLICE_DEVICES):
            x = left[i : i + SLICE_DEVICES]
            for j in range(0, len(right), SLICE_OTHERS):
                y = right[j : j + SLICE_OTHERS]
                low = min(known[x[0]], known[y[0]])
                bound = min(1.0, known[x[-1]] / known[y[0]], known[y[-1]] / known[x[0]]) if low > 0 else 1.0
                if 3 * least - bound - SINGLE > 2:
                    continue
                products = both[x] @ both[y].T
                found = np.flatnonzero(products >= 3 * least - bound - SINGLE)
                a, b = x[found // len(y)], y[found % len(y)]
                longest = np.maximum(known[a], known[b])
                ratio = np.divide(np.minimum(known[a], known[b]), longest, out=np.ones_like(longest), where=np.minimum(known[a], known[b]) > 0)
                near = products.ravel()[found] + ratio >= 3 * least - SINGLE
                yield a[near], b[near]

    def met(self, few: np.ndarray, many: np.ndarray, least: float, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of few and many whose temporal signal is at least so much, and some more, where the first has fewer sessions (or as many, unless strict).

        So many of its sessions must meet one of the other's that of any few of them
        some must: those at the least crowded times are looked at.
        """
        of_all = self.owner
        for crowd in np.unique(self.crowd[many]):
            some = many[self.crowd[many] == crowd]
            if not crowd:
                continue
            must = np.ceil(least * self.n[few] / crowd - 1e-9).astype(np.int64).clip(1)
            hits = np.minimum(3, must)
            look = np.where(must <= self.size[few], self.size[few] - must + hits, 0)
            _, at = spread(self.begin[some], self.size[some])
            at = at[np.argsort(self.t[at], kind="stable")]
            u, slot = self.t[at], np.full(len(self.n), -1)
            slot[some] = np.arange(len(some))
            whose = slot[of_all[at]]
            of, mine = spread(self.begin[few], self.size[few])
            first, last = np.searchsorted(u, self.t[mine] - self.width, "left"), np.searchsorted(u, self.t[mine] + self.width, "right")
            order = np.lexsort((last - first, of))
            place = np.arange(len(order)) - np.repeat(np.cumsum(self.size[few]) - self.size[few], self.size[few])
            order = order[place < look[of]]
            of, first, count = of[order], first[order], (last - first)[order]
            ends = np.searchsorted(of, np.arange(len(few)), "right")
            work = np.cumsum(np.bincount(of, count, len(few)) + len(some))
            begin = 0
            while begin < len(few):
                stop = max(begin + 1, int(np.searchsorted(work, PAIR_STARTS + (work[begin - 1] if begin else 0), "right")))
                part = slice(ends[begin - 1] if begin else 0, ends[stop - 1])
                k, v = spread(first[part], count[part])
                met = np.bincount((of[part] - begin)[k] * len(some) + whose[v], minlength=(stop - begin) * len(some))
                found = np.flatnonzero(met >= hits[begin:stop].min())
                found = found[met[found] >= hits[begin + found // len(some)]]
                x, y = few[begin + found // len(some)], some[found % len(some)]
                fewer = (self.n[x] < self.n[y]) | ((self.n[x] == self.n[y]) & (not strict))
                yield x[fewer], y[fewer]
                begin = stop


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges one after the other, and for each the place of its range."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) + np.repeat(begin - (np.cumsum(size) - size), size)


def products(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (k, i, j) with i < x[k] and j < y[k], SCORED_PAIRS at a time."""
    upto = np.cumsum(x * y)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, SCORED_PAIRS):
        at = np.arange(begin, min(begin + SCORED_PAIRS, int(upto[-1])))
        k = np.searchsorted(upto, at, "right")
        at = at - (upto[k] - x[k] * y[k])
        yield k, at // y[k], at % y[k]


class Accounts:
    """Lists of accounts."""

    def __init__(self, lists: pa.Array):
        self.size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.codes, self.begin = lists.flatten().dictionary_encode().indices.to_numpy(), np.cumsum(self.size) - self.size
        self.only = np.full(len(lists), -1)
        self.only[self.size == 1] = self.codes[self.begin[self.size == 1]]

    def common(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of accounts in common, and the code of the first of them by name, for sorted lists, or -1."""
        same = (self.only[x] == self.only[y]) & (self.only[x] >= 0)
        count, least = same.astype(np.int64), np.where(same, self.only[x], -1)
        for k in np.flatnonzero((self.size[x] > 0) & (self.size[y] > 0) & (self.size[x] + self.size[y] > 2)):
            theirs = set(self.of(y[k]).tolist())
            both = [c for c in self.of(x[k]).tolist() if c in theirs]
            count[k], least[k] = len(both), both[0] if both else -1
        return count, least

    def of(self, x: int) -> np.ndarray:
        return self.codes[self.begin[x] : self.begin[x] + self.size[x]]


SIGNALS = ("login", "temporal", "behavioral", "score", "probability")
LINKS = "a string, b string, " + ", ".join(f"{c} double" for c in SIGNALS)


def paired(rows: DataFrame, threshold: float, minutes: int = 30) -> DataFrame:
    """The links among devices (device_id, n, avg_duration, times, accounts, hours, genres).

    Devices with equal times, hours, genres and durations (to nine digits) are one
    kind; every pair of blocks of kinds is one task's, which yields the links of
    their devices. Without an account in common a link's score is a mean of the
    temporal and the behavioral signal, so one of them reaches the least score: only
    pairs where one can are scored, and those with accounts in common. No pair is shuffled.
    """
    width = minutes * 60_000_000
    least = -np.inf if threshold <= 0 else np.inf if threshold >= 1 else (1 + np.log(threshold / (1 - threshold))) / 2
    # what is judged in single steps may round otherwise than the score
    least = least - 1e-6 if least > 1e-6 else -np.inf
    genres = F.transform("genres", lambda e: F.struct(e["v"], F.round(e["x"], 9)))
    kind = F.md5(F.to_json(F.struct("n", F.round("avg_duration", 9), "times", "hours", genres)))
    what = ["n", "avg_duration", "times", *[F.col(f"{c}.{e}").alias(name) for c in ("hours", "genres") for e, name in (("v", c), ("x", f"{c}_x"))]]
    kinds = rows.withColumn("_kind", kind).groupBy("_kind").agg(F.min_by(F.struct(*what), "device_id").alias("_what"), F.collect_list(F.struct("device_id", "accounts")).alias("_members")).select(F.col("_kind").alias("device_id"), "_what.*", "_members")
    n_kinds = rows.select(F.countDistinct(kind)).first()[0]
    blocks = max(PAIR_BLOCKS, -(-n_kinds // BLOCK_DEVICES))

    def yielded(names: pa.Array, x: np.ndarray, y: np.ndarray, ranks: np.ndarray, signals: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        turned = ranks[x] > ranks[y]
        a, b = np.where(turned, y, x), np.where(turned, x, y)
        return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), *map(pa.array, signals)], ["a", "b", *SIGNALS])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        i, j, own = table.column("_i")[0].as_py(), table.column("_j")[0].as_py(), table.column("_mine").to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right) or least == np.inf:
            return
        lists = table.column("_members").combine_chunks()
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        begin, flat = np.cumsum(size) - size, lists.flatten()
        names, accounts = pc.struct_field(flat, "device_id"), Accounts(pc.struct_field(flat, "accounts"))
        ranks = ranks_of(names)
        p = Profiles(table, width)
        for by_time, found in ((False, p.alike(left, right, least)), *([(True, p.met(left, right, least, False))] if least > 0 else []), *([(True, p.met(right, left, least, True))] if least > 0 and i != j else [])):
            for many_x, many_y in found:
                # within a block each pair once, by its places or, among equal numbers of sessions, by these
                once = (many_x <= many_y) if not by_time else (p.n[many_x] < p.n[many_y]) | (many_x <= many_y)
                many_x, many_y = (many_x[once], many_y[once]) if i == j else (many_x, many_y)
                for at in range(0, len(many_x), SCORED_PAIRS):
                    x, y = many_x[at : at + SCORED_PAIRS], many_y[at : at + SCORED_PAIRS]
                    mine = (p.behavioral(x, y) < least) == by_time
                    x, y = x[mine], y[mine]
                    signals = p.score(x, y, np.zeros(len(x)))
                    linked = np.flatnonzero(signals[-1] >= threshold)
                    x, y, signals = x[linked], y[linked], [s[linked] for s in signals]
                    for k, a, b in products(size[x], size[y]):
                        a, b = begin[x[k]] + a, begin[y[k]] + b
                        keep = ((x[k] != y[k]) | (a < b)) & (accounts.common(a, b)[0] == 0)
                        if keep.any():
                            yield yielded(names, a[keep], b[keep], ranks, [s[k[keep]] for s in signals])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by([("_account", "ascending"), ("device_id", "ascending")]).combine_chunks()
        i, j, own = table.column("_i")[0].as_py(), table.column("_j")[0].as_py(), table.column("_mine").to_numpy()
        names, accounts = table.column("device_id").combine_chunks(), Accounts(table.column("accounts").combine_chunks())
        by = table.column("_account").combine_chunks().dictionary_encode().indices.to_numpy()
        own_name = table.column("_account").combine_chunks()
        first_common = table.column("accounts").combine_chunks()
        ranks = ranks_of(names)
        p = Profiles(table, width)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        first, last = np.searchsorted(by[right], by[left], "left"), np.searchsorted(by[right], by[left], "right")
        code = {c: k for k, c in enumerate(first_common.flatten().dictionary_encode().dictionary.to_pylist())}
        here = np.array([code[c] for c in own_name.to_pylist()])
        for k, _, b in products(np.ones(len(left), np.int64), last - first):
            x, y = left[k], right[first[k] + b]
            once = ranks[x] < ranks[y] if i == j else np.ones(len(x), bool)
            x, y = x[once], y[once]
            count, least_common = accounts.common(x, y)
            once = least_common == here[x]
            x, y, count = x[once], y[once], count[once]
            signals = p.score(x, y, count / np.maximum(accounts.size[x], accounts.size[y]))
            linked = signals[-1] >= threshold
            if linked.any():
                yield yielded(names, x[linked], y[linked], ranks, [s[linked] for s in signals])

    others = dealt(kinds, blocks).repartition(blocks * (blocks + 1) // 2, "_i", "_j").groupBy("_i", "_j").applyInArrow(apart, LINKS)
    used = rows.select("device_id", "accounts", *what, F.explode("accounts").alias("_account"))
    sizes = used.groupBy("_account").agg(F.count("*").alias("_size")).where("_size > 1")
    shared = used.join(sizes, "_account").withColumn("_blocks", F.ceil(F.col("_size") / BLOCK_DEVICES).cast("int"))
    groups = max(PAIR_BLOCKS, -(-rows.count() // 4000))
    near = dealt(shared.withColumn("_group", F.pmod(F.xxhash64("_account"), F.lit(groups))), F.col("_blocks"))
    return others.unionByName(near.groupBy("_group", "_i", "_j").applyInArrow(together, LINKS))


def ranks_of(names: pa.Array) -> np.ndarray:
    """Each name's place in sorted order, equal for equal names."""
    return pc.rank(names, "ascending", tiebreaker="dense").to_numpy()


def link_id(a: Column, b: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("_", F.least(a, b), F.greatest(a, b)), 256), 1, 16)


def pruned(links: DataFrame, k: int = 5) -> DataFrame:
    """Links among the k likeliest of either end."""
    ends = links.select("*", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc(F.round("probability", 9)), "a", "b"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= k).drop("end", "rank").distinct()


def components(edges: DataFrame, checkpoint: bool = True) -> DataFrame:
    """node, component: the smallest node reachable. Edges a, b are contracted round by round until none is left."""
    maps, left = [], edges.where("a <> b").select("a", "b").distinct()
    while True:
        left = left.checkpoint() if checkpoint else left
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
        hooked = hooked.checkpoint() if checkpoint else hooked
        maps.append(hooked)
        to = lambda s: hooked.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))  # noqa: B023, E731
        left = left.join(to("a"), "a").join(to("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    total = maps[0]
    for later in maps[1:]:
        onwards = later.select(F.col("node").alias("component"), F.col("component").alias("onwards"))
        total = total.join(onwards, "component", "left").select("node", F.coalesce("onwards", "component").alias("component"))
    return total


def prepare_checkpoints(spark) -> None:
    """Takes the checkpoint folder from the session; sets one in the warehouse only where it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)


def edge_id(src: Column, dst: Column, kind: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", src, dst, kind)), 1, 12)


def graph(sessions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (id, src, dst, type, weight): accounts, devices, their membership and links."""
    devices = sessions.select(F.col("device_id").alias("id"), F.lit("device").alias("type")).distinct()
    accounts = sessions.select(F.col("account_id").alias("id"), F.lit("account").alias("type")).distinct()
    uses = sessions.groupBy(F.col("account_id").alias("src"), F.col("device_id").alias("dst")).agg(F.count("*").cast("double").alias("weight")).withColumn("type", F.lit("uses_device"))
    same = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("probability").alias("weight"), F.lit("same_person").alias("type"))
    edges = uses.unionByName(same).withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("type")))
    return devices.unionByName(accounts), edges


def neighbours(edges: DataFrame) -> DataFrame:
    """node, neighbour, without direction."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))).distinct()


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph less the nodes of `gone` (id) and their edges."""
    g = gone.select(F.col("id").alias("_gone"))
    kept = edges.join(g, F.col("src") == F.col("_gone"), "left_anti").join(g, F.col("dst") == F.col("_gone"), "left_anti")
    return nodes.join(g, F.col("id") == F.col("_gone"), "left_anti"), kept


def merged(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with both ends renamed by canonical (node, component), self-loops dropped, equal ones kept once."""
    to = lambda s: canonical.select(F.col("node").alias(s), F.col("component").alias(f"_{s}"))
    named = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "type", "weight")
    once = named.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))
    return once.withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("type")))

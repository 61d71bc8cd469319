"""Near-duplicate detection by MinHash bands with sequential Bayesian verification.

1. Every text becomes its set of shingles (64-bit hashes), a signature and band keys. Texts with equal sets form one
   class, represented by its smallest id.
2. Representatives that share a band key are candidates. In each bucket all members are paired with the bucket's
   smallest id only: a bucket of copies of one text gives as many pairs as members.
3. Candidates are compared by batches of their signatures. With a uniform prior the posterior probability that the
   similarity reaches the threshold, after m of n equal, is P(Binomial(n + 1, threshold) <= m); a pair whose posterior
   falls below ``miss`` is dropped, the others are confirmed on their full sets.
4. Buckets whose members aren't yet in one component are open. Two sets of an open bucket that are similar enough must
   share one of the first n - ceil(threshold n) + 1 shingles of each, rare ones first. So the open sets meet once more
   over such shingles, in groups that are small unless the sets hold little but shingles of many sets. With m shingles
   from the shared one on, two sets can have at most min(m) in common: that bound goes before any comparison. Each group
   first compares its smallest set with the others. What is still apart and within the bound is compared in memory: in
   groups of LARGE sets at most by signatures, and only pairs that these can't tell apart leave, to be confirmed; larger
   groups are merged where they share sets, so that no two sets meet twice there, and compared on the sets themselves,
   block by block, and only links leave.

A pair at the threshold t shares no band with probability (1 - t^rows)^bands, at most LOST: rows and bands follow from t.
Sets are told apart by 64-bit hashes of their shingles: k shingles of a pair hide a difference with k^2 / 2^65 at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes
from ._common import cut, slices, text_of
from .components import components

#: The probability with which a pair at the threshold may share no band, and the hashes that bands may take.
LOST, HASHES = 1.5e-7, 256
#: Ids in a block of a group that is compared in memory; ids of a group that is small.
BLOCK, LARGE = 1024, 32
#: Counters for the frequencies of shingles, by hash: they only order shingles, so collisions do no harm.
COUNTERS = 1 << 18
#: Signature bytes compared in one step; the posterior below which a pair is dropped.
BATCH, MISS = 40, 1e-7
#: Bits of the filter through which the texts of candidates are fetched: of fixed size whatever the number of ids.
FILTER_BITS = 1 << 24
_SINGLE = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: runs of ``width`` words, or all the words if they are fewer."""
    for _, data, offsets in _bytes.byte_blocks(column):
        hashes, at = _bytes.words(data, offsets)
        n = len(hashes)
        runs = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            runs = _bytes.mix(runs * _SINGLE + hashes[k : k + len(runs)] + np.uint64(k + 1))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:  # the whole text is one shingle
                h = np.zeros(1, dtype=np.uint64)
                for k, w in enumerate(hashes[a:b]):
                    h = _bytes.mix(h * _SINGLE + w + np.uint64(k + 1))
                yield h ^ np.uint64(b - a)
            else:
                yield hashes[:0]


def banding(threshold: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands lose a pair at the threshold with LOST at most."""
    best = (0, 0)
    for rows in range(1, 33):
        bands = math.ceil(math.log(LOST) / math.log1p(-min(threshold, 0.999999) ** rows))
        if bands * rows <= hashes or rows == 1:
            best = (bands, rows)
    return best


def _seeds(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return tuple(r.integers(0, 1 << 31, hashes, dtype=np.uint32)[None, :] * np.uint32(2) + np.uint32(1) for _ in range(2))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = None
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[:, None]
    for i in range(0, len(x), 256):
        v = x[i : i + 256] * a
        v ^= v >> np.uint32(15)
        v *= b
        part = v.min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    of = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = _bytes.mix(key * _SINGLE + of[:, k])
    return key.view(np.int64)


def least_equal(threshold: float, hashes: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, fewest equal of n that keep a pair) after each batch, for signatures of one byte each."""
    p = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        total, m = 0.0, 0
        while (total := total + math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return out


def _survive(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sequential verification keeps."""
    ends = sketches.select("id", "n", "sig")
    both = pairs.join(ends.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    both = both.join(ends.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")  # else their sets can't be that similar
    bands, rows = banding(percent / 100)
    width = bands * rows
    limits = least_equal(percent / 100, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2000)):
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, width) for c in (2, 3))
            alive, equal, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int32), 0
            for n, least in limits:
                equal += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                stay = equal >= least
                alive, equal, done = alive[stay], equal[stay], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}")


def _bits(values: DataFrame) -> np.ndarray:
    """A filter of fixed size with the bits of a column of longs: at most FILTER_BITS / 64 rows come to the driver."""
    bit = F.pmod(F.xxhash64(values[0]), F.lit(FILTER_BITS))
    table = values.select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[table["w"].to_numpy()] = table["v"].to_numpy()
    return bits


def _sets(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """id, s: the shingle sets (as bytes) of at least the given ids, a written table with one column; texts: (id, t)."""
    shared = texts.sparkSession.sparkContext.broadcast(_bits(ids))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in (part for whole in batches for part in slices(whole, 2000)):
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((have[at >> 6] >> (at & 63)) & 1 == 1))
            if batch.num_rows:
                sets = [s.tobytes() for s in shingle_sets(batch.column(1), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, type=pa.binary())], ["id", "s"])

    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    return texts.select("id", "t", bit.alias("bit")).mapInArrow(fetch, f"id {texts.schema['id'].dataType.simpleString()}, s binary")


def _open(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """id, c: the ids in buckets that hold several components (and, by the filter, maybe a few more); None if there are none. members: (key, id), a written table."""
    placed = members.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("c"))
    keys = placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("key")  # a hot bucket is combined before it is sent
    bits = _bits(keys)
    if not bits.any():
        return None
    shared = members.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            yield batch.select([0]).filter(pa.array((have[at >> 6] >> (at & 63)) & 1 == 1))

    numbered = members.select("id", F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("bit"))
    ids = numbered.mapInArrow(keep, f"id {members.schema['id'].dataType.simpleString()}").distinct()
    return cut(ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("c")), thin=True)


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's n shingles, in any order that is the same for all sets, it must share with a set that is similar enough."""
    return n + (-percent * n) // 100 + 1


def _prefixes(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """g, id, n, m: each open set's first shingles, rare ones first, with its size and how many shingles there are from this one on. sets: a written table."""

    def slot(s: np.ndarray) -> np.ndarray:
        return (_bytes.mix(s) % np.uint64(COUNTERS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            total += np.bincount(slot(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64)), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["w", "n"])

    table = sets.select("s").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, dtype=np.int64)
    often[table["w"].to_numpy()] = table["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            shingles, owner, size, rest = [], [], [], []
            for i, s in enumerate(batch.column(1)):
                s = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                p = prefix_length(len(s), percent)
                shingles.append(s[np.lexsort((s, have[slot(s)]))[:p]].view(np.int64))
                owner.append(np.full(p, i)), size.append(np.full(p, len(s))), rest.append(len(s) - np.arange(p))
            if owner:
                owner, size, rest, shingles = (np.concatenate(x) for x in (owner, size, rest, shingles))
                yield pa.RecordBatch.from_arrays([pa.array(shingles), batch.column(0).take(pa.array(owner)), pa.array(size), pa.array(rest)], ["g", "id", "n", "m"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.join(open_.select("id"), "id", "left_semi").select("id", "s").mapInArrow(first, f"g long, id {kind}, n long, m long")


def _apart(rows: DataFrame, percent: int) -> DataFrame:
    """Of rows (g, id, n, m, c), those that may still be linked over g with a set of another component, with ``first``, the group's smallest set."""
    small = F.struct("n", "id", "c", "m")
    groups = rows.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min(small).alias("first")).where("a < b").select("g", "first")
    rows = rows.join(groups, "g")
    second = rows.where("c <> first.c").groupBy("g").agg(F.min("n").alias("second"))
    rows = rows.join(second, "g")
    other = F.when(F.col("c") == F.col("first.c"), F.col("second")).otherwise(F.col("first.n"))
    return rows.where((100 + percent) * F.col("m") >= percent * (F.col("n") + other)).select("g", "id", "n", "m", "c", "first")


def _merged(rows: DataFrame) -> DataFrame:
    """The rows (g, id, n, m, c) of large groups, a written table, with groups merged where they share ids, so that each id is in one of them."""
    first = rows.groupBy("id").agg(F.min("g").alias("a"))
    tops = components(rows.join(first, "id").select("a", F.col("g").alias("b")).distinct()).withColumnsRenamed({"id": "g", "component": "top"})
    return rows.join(tops, "g").groupBy("top", "id").agg(F.first("n").alias("n"), F.max("m").alias("m"), F.first("c").alias("c")).select(F.col("top").alias("g"), "id", "n", "m", "c")


def _within_small_groups(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sequential verification keeps, of the rows (g, id, n, m, c) of groups of LARGE ids at most: no sets travel, only signatures."""
    kind = reps.schema["id"].dataType.simpleString()
    bands, rows_ = banding(percent / 100)
    limits = least_equal(percent / 100, bands * rows_)
    parts = 1 + rows.count() // 20_000
    whole = rows.join(reps.select("id", "sig"), "id").withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        g, n, m, c, ids = (table[k].to_numpy() for k in ("g", "n", "m", "c", "id"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint8).reshape(len(g), -1)
        order = np.lexsort((ids, g))
        firsts = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
        out = []
        for rows in np.split(order, firsts[1:]):
            x, y = (rows[i] for i in np.triu_indices(len(rows), 1))
            stay = (c[x] != c[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((100 + percent) * np.minimum(m[x], m[y]) >= percent * (n[x] + n[y]))
            x, y = x[stay], y[stay]
            equal, done = np.zeros(len(x), dtype=np.int32), 0
            for size, least in limits:
                equal = equal + (sig[x, done:size] == sig[y, done:size]).sum(axis=1)
                stay = equal >= least
                x, y, equal, done = x[stay], y[stay], equal[stay], size
            if len(x):
                out.append(np.stack([ids[x], ids[y]]))
        a, b = np.concatenate(out, axis=1) if out else (ids[:0], ids[:0])
        return pa.table([pa.array(a, table.schema.field("id").type), pa.array(b, table.schema.field("id").type)], ["a", "b"])

    return whole.groupBy("part").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _within_groups(rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of all pairs of rows (g, id, n, m, c), a written table, of one group and different components.

    A group is dealt into blocks of about BLOCK ids, and each pair of blocks is compared in memory: only links come out,
    and a task holds two blocks at most.
    """
    kind = reps.schema["id"].dataType.simpleString()
    blocks = rows.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    whole = placed.join(reps.select("id", "sig"), "id").join(sets, "id")
    dealt = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "c", "n", "m", "sig", "s")
    bands, rows_ = banding(percent / 100)
    limits = least_equal(percent / 100, bands * rows_)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("n", "ascending"), ("id", "ascending")]).combine_chunks()
        count = table.num_rows
        own, n, m, ids = (table[k].to_numpy() for k in ("own", "n", "m", "id"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint8).reshape(count, -1)
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["s"]]
        _, part = np.unique(table["c"].to_numpy(), return_inverse=True)
        same_block = not count or table["x"][0].as_py() == table["y"][0].as_py()
        a, b = [], []
        for i in range(count):
            near = (part != part[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((100 + percent) * np.minimum(m, m[i]) >= percent * (n + n[i]))
            near[: i + 1] = False
            if not same_block:  # pairs within a block are met where it is paired with itself
                near &= own != own[i]
            at = np.flatnonzero(near)
            equal, done = np.zeros(len(at), dtype=np.int32), 0
            for size, least in limits:
                equal = equal + (sig[at, done:size] == sig[i, done:size]).sum(axis=1)
                at, equal, done = at[equal >= least], equal[equal >= least], size
            for j in at[np.argsort(-equal, kind="stable")].tolist():  # the likeliest first: what becomes connected needs no more
                if part[j] == part[i]:
                    continue
                x, y = sets[i], sets[j]
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * same >= percent * (len(x) + len(y) - same):
                    a.append(ids[i]), b.append(ids[j])
                    part[part == part[j]] = part[i]
        return pa.table([pa.array(a, table.schema.field("id").type), pa.array(b, table.schema.field("id").type)], ["a", "b"])

    return dealt.groupBy("g", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are similar enough. sets: (id, s) of their ids at least."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) after more links between some of them."""
    ends = links
    for c in "ab":
        ends = ends.join(found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    ends = cut(ends.select("a", "b", "ca", "cb"), thin=True)
    tops = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("top"))
    alone = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("component"))
    return cut(found.unionByName(alone).join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component")), thin=True)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable over links), kept.

    Texts are linked whose shared shingles are at least ``percent`` percent of all shingles of both. A null text counts
    as empty; texts without words have no shingles and no links. Rows without an id are linked with nothing and kept.
    Rows with the same id are one node: their component is shared. Ties and repeated rows can't change the result;
    extra columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()
    n_bands, n_rows = banding(percent / 100)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _seeds(n_bands * n_rows)
        for batch in (part for whole in batches for part in slices(whole, 2000)):
            n, cls, keys, sigs = [], [], [], []
            known: dict[bytes, tuple] = {}
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                if not len(s):
                    cls.append(None), keys.append(None), sigs.append(None)
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest not in known:  # copies come often
                    sig = signature(s, a, b)
                    known[digest] = (band_keys(sig, n_bands, n_rows), (sig & np.uint32(255)).astype(np.uint8).tobytes())
                cls.append(digest), keys.append(known[digest][0]), sigs.append(known[digest][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(cls, type=pa.binary()), pa.array(keys, type=pa.list_(pa.int64())), pa.array(sigs, type=pa.binary())], ["id", "n", "cls", "bands", "sig"])

    sketches = cut(texts.mapInArrow(sketch, f"id {kind}, n long, cls binary, bands array<long>, sig binary"))
    linked = sketches.where("n > 0 and id is not null")
    classes = cut(linked.groupBy("cls").agg(F.min("id").alias("rep")))
    reps = linked.join(classes, (linked["cls"] == classes["cls"]) & (linked["id"] == classes["rep"]), "left_semi").dropDuplicates(["cls"])
    reps = cut(reps.select("id", "n", "bands", "sig"))

    members = reps.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    members = cut(members.join(buckets, "key"))
    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = cut(_survive(stars, reps, percent), thin=True)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    found = components(cut(_confirmed(pairs, _sets(ends, texts, width), percent), thin=True))

    # sets of buckets that aren't one component yet meet over their rare shingles
    open_ = _open(members.where("size > 2").select("key", "id"), found)
    if open_ is not None:
        sets = cut(_sets(open_.select("id"), texts, width).join(open_.select("id"), "id", "left_semi").dropDuplicates(["id"]))
        prefixes = _prefixes(open_, sets, percent).join(open_, "id")
        shared = prefixes.groupBy("g").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("g")
        prefixes = cut(prefixes.join(shared, "g", "left_semi"), thin=True)
        for last in (False, True):
            if last:
                prefixes = cut(prefixes.drop("c").join(found.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id")), thin=True)
            rows = cut(_apart(prefixes, percent), thin=True)
            if rows.isEmpty():
                break
            if last:
                sizes = rows.groupBy("g").agg(F.count("*").alias("k"))
                rows = cut(rows.join(sizes, "g").select("g", "id", "n", "m", "c", "k"), thin=True)
                new = _confirmed(cut(_within_small_groups(rows.where(f"k <= {LARGE}"), reps, percent), thin=True), sets, percent)
                large = rows.where(f"k > {LARGE}")
                if not large.isEmpty():
                    new = new.unionByName(_within_groups(cut(_merged(large), thin=True), reps, sets, percent)).distinct()
            else:  # each group's smallest set with the others
                bound = (100 + percent) * F.least("m", "first.m") >= percent * (F.col("n") + F.col("first.n"))
                more = rows.where((F.col("c") != F.col("first.c")) & bound).select(F.least("id", "first.id").alias("a"), F.greatest("id", "first.id").alias("b")).distinct()
                new = _confirmed(cut(_survive(more, reps, percent), thin=True), sets, percent)
            new = cut(new, thin=True)
            if not new.isEmpty():
                found = _joined(found, new)

    out = sketches.select("id", "n", "cls").join(classes, "cls", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, one of each component, with all their columns."""
    gone = near_duplicates(docs, width=width, percent=percent, id_col=id_col, text_col=text_col).where("not kept").select(id_col).distinct()
    return docs.join(cut(gone), id_col, "left_anti").select(docs.columns)

"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

Each class has counts of its own for character n-grams of order 3 to 5 within words (word ends included, orders below
the highest by continuation counts); both back off to shared counts of order 1 and 2, so a rare expression differs
between the classes only as far as its own longer n-grams were seen. A word's evidence is the difference of its log
likelihoods; a document's measures are that difference divided by the length, over the whole text and over its worst
windows of one and of eight words. A logistic fit on labelled documents that the models have not seen turns them into a
score. The counts are those of all labelled documents outside the held-out third and the fit's sample, the shared ones of
all documents; the sample's rows are weighted to the classes' true shares.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, slices, text_of

ORDER, SHARED, DISCOUNT = 5, 2, 0.75
#: The logistic fit is on at most so many labelled rows of each class, those with the smallest hashes of their ids.
MOST_TOXIC, MOST_ORDINARY = 8000, 16000
THRESHOLD = 0.7
WINDOWS = (1, 8)
_P = np.uint64(0x9E3779B97F4A7C15)


class Ratios:
    """n-gram -> log likelihood ratio of its last character, and of the weight with which it backs off as a context."""

    def __init__(self, keys: np.ndarray, value: np.ndarray, back: np.ndarray):
        bits = max(8, int(len(keys) * 6).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys, self.value, self.back = keys, value.astype(np.float32), back.astype(np.float32)
        rest, self.probes = np.arange(len(keys), dtype=np.int32), 0
        while len(rest):  # open addressing, all keys at once
            at = (keys[rest] >> np.uint64(7)) + np.uint64(self.probes) & self.mask
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            rest = rest[self.slots[at] != rest]
            self.probes += 1

    @property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What makes an equal object: plain arrays, for executors that haven't imported this module."""
        return self.keys, self.value, self.back

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if unknown."""
        out = np.full(len(keys), -1, dtype=np.int32)
        rest = np.arange(len(keys))
        for probe in range(self.probes):
            at = self.slots[(keys[rest] >> np.uint64(7)) + np.uint64(probe) & self.mask]
            full = at >= 0
            same = full & (self.keys[np.where(full, at, 0)] == keys[rest])
            out[rest[same]] = at[same]
            rest = rest[full & ~same]
            if not len(rest):
                break
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The log likelihood ratio of each word, ends included."""
        codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n, ends = len(codes), codes == 10
        mixed = (codes + np.uint64(1)) * _P
        mixed ^= mixed >> np.uint64(29)
        rows, fits = {}, {}
        key = np.zeros(n, dtype=np.uint64)
        ok = np.ones(n, dtype=bool)
        for m in range(1, ORDER + 1):  # n-grams that end at each place
            key[m - 1 :] = key[m - 1 :] * _P + mixed[: n - m + 1]
            key[: m - 1] = 0
            ok = ok.copy()
            ok[: m - 1] = False
            if m > 2:  # what was first last round lies within now: an end stands first or last only
                ok[m - 1 :] &= ~ends[1 : n - m + 2]
            fits[m] = ok
            if m >= SHARED:
                at = np.flatnonzero(ok)
                rows[m] = np.full(n, -1, dtype=np.int32)
                rows[m][at] = self.find(key[at])
        total, open_ = np.zeros(n, dtype=np.float32), ~ends.copy()
        open_[1:] |= ends[1:]
        open_[0] = False
        for m in range(ORDER, SHARED, -1):
            hit = open_ & (rows[m] >= 0)
            total[hit] += self.value[rows[m][hit]]
            open_ &= ~hit
            context = np.full(n, -1, dtype=np.int32)
            context[1:] = rows[m - 1][:-1]
            miss = open_ & fits[m] & (context >= 0)
            total[miss] += self.back[context[miss]]
        sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
        stops = np.flatnonzero(ends)
        return sums[stops[1:] + 1] - sums[stops[:-1] + 1]


def gram_hash(gram: str) -> int:
    key, mask = 0, (1 << 64) - 1
    for c in reversed(gram):
        mixed = (ord(c) + 1) * int(_P) & mask
        key = (key * int(_P) + (mixed ^ mixed >> 29)) & mask
    return key


def _keys(codes: np.ndarray) -> np.ndarray:
    """gram_hash of each row of characters."""
    key = np.zeros(len(codes), dtype=np.uint64)
    for j in reversed(range(codes.shape[1])):
        mixed = (codes[:, j].astype(np.uint64) + np.uint64(1)) * _P
        key = key * _P + (mixed ^ mixed >> np.uint64(29))
    return key


def kneser_ney(counts: dict[str, tuple[int, ...]]) -> Ratios:
    """Ratios from the counts (toxic, ordinary; over all documents, if not their sum) of n-grams; an end is a line feed."""
    rows = [(g, *c[:2], c[2] if len(c) > 2 else sum(c)) for g, c in counts.items()]
    return _ratios(pa.table(dict(zip(("gram", "toxic", "ordinary", "total"), zip(*rows, strict=True), strict=True))))


def _ratios(table: pa.Table) -> Ratios:
    """The same from a table with each n-gram's prefix and suffix, a length at a time. Orders above SHARED + 1 need only be there if a class has them."""
    codes, counts, keys, rank, pre, suf = {}, {}, {}, {}, {}, {}
    length = pc.utf8_length(table["gram"])
    for m in range(1, ORDER + 1):
        part = table.filter(pc.equal(length, m))
        joined = "".join(part["gram"].to_pylist())
        codes[m] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, m)
        counts[m] = np.column_stack([part[c].to_numpy().astype(float) for c in ("toxic", "ordinary", "total")])
        keys[m] = _keys(codes[m])
        rank[m] = np.argsort(keys[m])
        if m > 1:  # rows of the prefix and of the suffix
            pre[m], suf[m] = (rank[m - 1][np.searchsorted(keys[m - 1], _keys(c), sorter=rank[m - 1])] for c in (codes[m][:, :-1], codes[m][:, 1:]))

    def used(k: int, m: int) -> np.ndarray:
        """Counts of the highest order and at a word's start, else numbers of characters before."""
        raw = counts[m][:, k]
        if m == ORDER:
            return raw
        left = np.bincount(suf[m + 1][counts[m + 1][:, k] > 0], minlength=len(raw))
        return np.where((codes[m][:, 0] == 10) | (raw == 0), raw, np.maximum(left, 1.0))

    def contexts(k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of what follows each n-gram of order m."""
        n, size = used(k, m + 1), len(keys[m])
        return np.bincount(pre[m + 1], n, size), np.bincount(pre[m + 1], n > 0, size)

    def discounted(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, under: np.ndarray) -> np.ndarray:
        return np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * under) / np.where(total > 0, total, 1), under)

    # the shared model, for orders 1 and 2
    first = used(2, 1)
    low = discounted(first, first.sum(), np.count_nonzero(first), 1.0 / (len(first) + 1))
    total, kinds = contexts(2, 1)
    low = discounted(used(2, 2), total[pre[2]], kinds[pre[2]], low[suf[2]])

    probs, backs = [], []
    for k in (0, 1):
        prob, back = {SHARED: low}, {}
        for m in range(SHARED, ORDER):
            total, kinds = contexts(k, m)
            prob[m + 1] = discounted(used(k, m + 1), total[pre[m + 1]], kinds[pre[m + 1]], prob[m][suf[m + 1]])
            back[m] = np.where(total > 0, DISCOUNT * kinds / np.where(total > 0, total, 1), 1.0)
        probs.append(prob)
        backs.append(back)
    found = []
    for m in range(SHARED, ORDER + 1):  # what no class has backs off to the same
        has = counts[m][:, 0] + counts[m][:, 1] > 0
        value = np.log(probs[0][m]) - np.log(probs[1][m]) if m > SHARED else np.zeros(len(has))
        back = np.log(backs[0][m]) - np.log(backs[1][m]) if m < ORDER else np.zeros(len(has))
        found.append((keys[m][has], value[has], back[has]))
    return Ratios(*(np.concatenate(x) for x in zip(*found, strict=True)))


_WORD = re.compile(r"\b[^\W\d_]+\b")  # no letters out of numbers and names with digits


class Scorer:
    """A text's measures; words that were scored before are remembered, up to a bound."""

    def __init__(self, ratios: Ratios, most: int = 60_000):
        self.ratios, self.known, self.most = ratios, {}, most

    def measures(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(WINDOWS) + 2))
        for i in range(0, len(texts), 100):  # so few texts are held as words at a time
            part = [_WORD.findall((t or "").lower()) for t in texts[i : i + 100]]
            if len(self.known) > self.most:
                self.known = {}
            new = list(set().union(*part).difference(self.known))
            if new:
                self.known.update(zip(new, self.ratios.words(new).tolist(), strict=True))
            for j, words in enumerate(part, i):
                if not words:
                    continue
                v = np.array([self.known[w] for w in words])
                n = np.array([len(w) + 1.0 for w in words])
                out[j, 0] = v.sum() / n.sum()
                for k, size in enumerate(WINDOWS, 1):
                    w = min(size, len(words))
                    a, b = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(n)])
                    out[j, k] = ((a[w:] - a[:-w]) / (b[w:] - b[:-w])).max()
                out[j, -1] = math.log1p(len(words))
        return out


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 0.05, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients with the constant first, means, scales) by Newton's method; a row counts as much as its weight."""
    w = np.ones(len(x)) if weights is None else weights * (len(x) / weights.sum())
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w)) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b, r = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (w * (p * (1 - p) + 1e-9))[:, None]) + r, z.T @ (w * (y - p)) - r @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b, mean, scale


def known_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """id, y, part: the labelled ids outside the held-out third; part 0 is for the logistic fit. Ids with contradicting labels are toxic."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    return known.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5)).cast("int"))


def fitting_sample(known: DataFrame, most_toxic: int, most_ordinary: int) -> DataFrame:
    """id, y: at most so many ids of part 0 of each class."""
    parts = [known.where(f"part = 0 and y = {y}").select("id", "y").orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(n) for y, n in ((1, most_toxic), (0, most_ordinary))]
    return parts[0].unionByName(parts[1])


def gram_counts(texts: DataFrame) -> DataFrame:
    """gram, toxic, ordinary, total for (t, y): n-grams of order 1 to 5 of the lower-cased words with a line feed at both ends. y is null outside both classes; of words of such texts only, orders above SHARED + 1 are left out, as nothing reads them."""
    words = texts.select(F.explode(F.split(F.lower("t"), r"[^\p{L}\p{N}_]+")).alias("w"), "y").where(F.col("w").rlike(r"^\p{L}+$"))
    words = words.groupBy("w").agg(F.count(F.when(F.col("y") == 1, 1)).alias("toxic"), F.count(F.when(F.col("y") == 0, 1)).alias("ordinary"), F.count("*").alias("total"))
    ends = words.select(F.concat(F.lit("\n"), "w", F.lit("\n")).alias("w"), "toxic", "ordinary", "total")
    most = F.when(F.col("toxic") + F.col("ordinary") > 0, ORDER).otherwise(SHARED + 1)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), most), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, n))))
    counts = ends.select(F.explode(F.array_distinct(grams)).alias("gram"), "toxic", "ordinary", "total")
    return counts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary", "total")))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_toxic: int | None = None, most_ordinary: int | None = None) -> tuple[Broadcast | None, tuple | float]:
    """The models' arrays, sent to all executors once, and the logistic fit; (None, share of toxic labels) if a class has no rows to learn from.

    ``most_toxic`` and ``most_ordinary`` bound the labelled rows of the logistic fit (MOST_TOXIC and MOST_ORDINARY); the
    models learn from all others.
    """
    spark = docs.sparkSession
    known = cut(known_labels(labels, id_col=id_col), thin=True)
    sample = cut(fitting_sample(known, most_toxic or MOST_TOXIC, most_ordinary or MOST_ORDINARY), files=1)  # bounded
    sizes = {name: {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()} for name, rows in (("all", known.where("part = 0")), ("sample", sample))}
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t"))
    taught = known.join(F.broadcast(sample.select("id")), "id", "left_anti").select("id", "y")
    # only texts that may teach meet the labels; the exchange is asked for, so that disk grows with the input at all sizes
    may = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1, F.lit(False))
    rows = texts.where(may).join(taught.hint("merge"), "id", "left").select("t", "y").unionByName(texts.where(~may).select("t", F.lit(None).cast("int").alias("y")))
    table = gram_counts(rows).toArrow()
    toxic, ordinary = (pc.sum(table[c]).as_py() or 0 for c in ("toxic", "ordinary"))
    if not toxic or not ordinary:
        return None, 1.0 if toxic else 0.0
    shared = spark.sparkContext.broadcast(_ratios(table).arrays)
    del table
    names = [f"m{i}" for i in range(len(WINDOWS) + 2)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Ratios(*shared.value))
        for b in (part for whole in batches for part in slices(whole)):
            x = scorer.measures(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, i]) for i in range(len(names)))], ["y", *names])

    seen = texts.join(F.broadcast(sample), "id").select("t", F.col("y").cast("long").alias("y")).mapInArrow(measure, "y long, " + ", ".join(f"{n} double" for n in names)).toArrow()
    y = seen["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        shared.destroy()
        return None, float(y.mean()) if len(y) else 0.0
    weights = np.array([sizes["all"][k] / sizes["sample"][k] for k in (0, 1)])[y.astype(int)]
    return shared, logistic(np.column_stack([seen[n].to_numpy() for n in names]), y, weights)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, carry: list[str], **bounds: int | None) -> DataFrame:
    """id, x0, x1, ... (the columns to carry) and score."""
    shared, found = fit(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    kept = ["id", *(f"x{i}" for i in range(len(carry)))]
    said = f"x{carry.index(text_col)}" if text_col in carry else "t"  # a text that is carried travels once
    rows = docs.select(docs[id_col].alias("id"), *(docs[c].alias(f"x{i}") for i, c in enumerate(carry)), *([docs[text_col].alias("t")] if said == "t" else []))
    if shared is None:
        return rows.select(*kept, F.lit(float(found)).alias("score"))
    b, mean, scale = found

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Ratios(*shared.value))
        for batch in (part for whole in batches for part in slices(whole)):
            x = scorer.measures(batch.column(said).to_pylist())
            s = 1 / (1 + np.exp(-np.clip(b[0] + (x - mean) / scale @ b[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s)], [*kept, "score"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", score double"
    return rows.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_toxic: int | None = None, most_ordinary: int | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A null text counts as empty and scores as one without evidence. Null ids and ids without labels are scored like any
    other; null labels teach nothing. Without labels of both classes every score is the share of toxic ones. Repeated
    rows score alike. Only the text enters the score.
    """
    return _scored(docs, labels, id_col, text_col, [], most_toxic=most_toxic, most_ordinary=most_ordinary).select(
        F.col("id").alias(id_col),
        (F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with all their columns."""
    carry = [c for c in docs.columns if c != id_col]
    names = {id_col: "id"} | {c: f"x{i}" for i, c in enumerate(carry)}
    return _scored(docs, labels, id_col, text_col, carry).where(F.col("score") < THRESHOLD).select(*(F.col(names[c]).alias(c) for c in docs.columns))

"""Secret scans: fixed patterns, and strings whose sliding-window entropy is high for their character class.

Positions are code points, ends exclusive. A pattern's matches come from one extraction and one split by the same
pattern: the lengths of the gaps and of the matches, summed alternately, are the positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_of

# Kind -> (pattern, group whose length counts, least length), in the order of kinds.
PATTERNS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),  # runs are maximal, so the length may stand in the pattern
}
#: Added kind: candidates, the window, and for each class (first that fits) its pattern and least bits a character.
ENTROPY = "entropy"
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
WINDOW = 20
#: Spans that are gathered at a time.
CHUNK = 256
CLASSES = [("hex", r"^[0-9a-fA-F-]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8)]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are no secrets: no digit or no letter; UUIDs; placeholders; words, paths and dates joined by - _ or /.
ALLOWED = [r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|0{8}|123456789", r"^/?([A-Za-z]+|[0-9]{1,4})([-_/]([A-Za-z]+|[0-9]{1,4}))*[-_/=]*$"]
#: c -> c log2 c in millionths of a bit, so that sums are exact.
TERMS = [0] + [round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 1)]


def most(bits: float) -> int:
    """A window's largest sum of TERMS at which its entropy is still ``bits``."""
    return math.floor(1e6 * WINDOW * (math.log2(WINDOW) - bits))


def _spans(text: str, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The spans of one pattern, as an array of (start, rank, end, kind, match)."""
    t, p = F.col(text), F.lit(pattern)
    parts = F.arrays_zip(F.split(t, pattern).alias("g"), F.regexp_extract_all(t, p, F.lit(0)).alias("m"), F.regexp_extract_all(t, p, F.lit(group)).alias("v"))
    one = "struct<s:int,k:int,e:int,kind:string,m:string>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("s"), F.lit(rank).alias("k"), end.alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).cast(f"array<{one}>").alias("out"))

    # appending copies an array, so spans are gathered CHUNK at a time: the cost is in proportion to the matches
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))

    def gather(state: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(state["at"].alias("at"), F.array().cast(f"array<{one}>").alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], F.array(inner["out"])).alias("out"))

    found = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{one}>>").alias("out")), gather, lambda s: F.flatten(s["out"]))
    return F.when(t.rlike(pattern), found).otherwise(F.array().cast(f"array<{one}>"))


def _overlaps(spans: Column, x: Column) -> Column:
    """Whether one of the spans, which are in order and apart, overlaps x: the last that starts before x ends, by bisection."""

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        before = F.get(spans, mid)["s"] < x["e"]
        return F.struct(F.when(before & (s["lo"] < s["hi"]), mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~before & (s["lo"] < s["hi"]), mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))  # as many as the number of spans has binary digits
    last = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda s: s["lo"])
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, last - 1)["e"] > x["s"], F.lit(False))).otherwise(False)


def _least_sum(candidate: Column) -> Column:
    """The smallest sum of TERMS of any window: the counts change by the character that enters and the one that leaves.

    A count has five bits, twelve counts are a number, so a step changes a few numbers, whatever the alphabet's size.
    """
    codes = F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    terms = F.array(*map(F.lit, TERMS))
    words = range(len(ALPHABET) // 12 + 1)

    def count(s: Column, c: Column) -> Column:
        word = F.get(F.array(*(s[f"n{k}"] for k in words)), (c / 12).cast("int"))
        return F.call_function("shiftright", word, c % 12 * 5).bitwiseAND(F.lit(31)).cast("int")

    def bit(c: Column, k: int) -> Column:
        return F.when((c / 12).cast("int") == k, F.call_function("shiftleft", F.lit(1).cast("long"), c % 12 * 5)).otherwise(F.lit(0).cast("long"))

    def step(s: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]  # go is null until the window is full; the same character changes nothing
        up = F.get(terms, count(s, come) + 1) - F.get(terms, count(s, come))
        down = F.get(terms, count(s, go) - 1) - F.get(terms, count(s, go))
        total = F.when(go.isNull(), s["sum"] + up).when(come == go, s["sum"]).otherwise(s["sum"] + up + down)
        seen = s["seen"] + 1
        counts = ((s[f"n{k}"] + bit(come, k) - bit(go, k)).alias(f"n{k}") for k in words)
        return F.struct(*counts, total.alias("sum"), seen.alias("seen"), F.when(seen >= WINDOW, F.least(s["best"], total)).otherwise(s["best"]).alias("best"))

    moves = F.arrays_zip(codes.alias("come"), F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), F.slice(codes, 1, F.greatest(F.size(codes) - WINDOW, F.lit(0)))).alias("go"))
    start = F.struct(*(F.lit(0).cast("long").alias(f"n{k}") for k in words), F.lit(0).alias("sum"), F.lit(0).alias("seen"), F.lit(2**31 - 1).alias("best"))
    return F.aggregate(moves, start, step, lambda s: s["best"])


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the numbers of base spans, their digest, and all spans as ``kind:start:end``.

    An entropy span is a candidate that isn't on the allow-list, overlaps no base span, and has a window of 20
    characters whose entropy reaches the least of its class. Null texts count as empty; a text without spans has an
    empty list. Everything happens within the row: extra columns are ignored, repeated rows get equal results.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t"))
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        rows = rows.withColumn(kind, _spans("t", kind, rank, pattern, group, least))
    rows = rows.withColumn(ENTROPY, _spans("t", ENTROPY, len(PATTERNS), CANDIDATE, 1, WINDOW))
    rows = rows.drop("t").withColumn("base", F.array_sort(F.concat(*PATTERNS)))

    def suspicious(x: Column) -> Column:
        m = x["m"]
        allowed = m.rlike(ALLOWED[0])
        for p in ALLOWED[1:]:
            allowed = allowed | m.rlike(p)
        limit = F.lit(-1)
        for _, p, bits in reversed(CLASSES):
            limit = F.when(m.rlike(p), most(bits)).otherwise(limit)
        return F.when(allowed, False).otherwise(_least_sum(m) <= limit)

    rows = rows.withColumn("high", F.filter(ENTROPY, suspicious))

    def apart(kind: str) -> Column:
        return F.filter("high", lambda x: ~_overlaps(F.col(kind), x))

    for kind in PATTERNS:
        rows = rows.withColumn("high", apart(kind))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    return rows.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", "high"))).alias("spans"),
    )

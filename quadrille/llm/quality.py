"""Quality rules whose cutoffs are certified on labelled documents to reject few good ones.

Every rule is an integer measure of a document; a document fails it when the measure exceeds the cutoff of the
document's stratum. A cutoff is certified when, among the stratum's labelled good documents, so few exceed it that
P(Binomial(n, alpha_rule) <= exceeding) is at most delta divided by the number of all tests (strata x rules x cutoffs):
with probability 1 - delta, no certified cutoff in any stratum rejects more than alpha_rule of the good documents. The
tightest certified cutoff is used; a stratum without enough labels gets none. alpha is shared equally among the rules,
so that all together reject at most alpha of a stratum's good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, cut, text_of

#: rule -> (integer measure in SQL, step between cutoffs): cutoffs are step * 1 .. step * GRID.
RULES: dict[str, tuple[str, int]] = {
    "symbols": ("(1000 * n_symbols) div greatest(word_chars, 1)", 10),
    "dup_lines": ("(1000 * n_dup_lines) div greatest(n_lines, 1)", 15),
    "repeats": ("(1000 * n_repeat_words) div greatest(n_words, 1)", 5),
    "long_words": ("(10 * word_chars) div greatest(n_words, 1)", 4),
}
GRID = 60
SYMBOLS = "#*$%&|<>"
#: Words in a window.
WINDOW = 8


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per input row: id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Everything is computed within the row, so nothing is shuffled. A null text counts as empty. Windows of eight words
    are compared by a 64-bit hash within one document only: of w different windows two collide with w^2 / 2^65 at most,
    3e-12 in a document of ten thousand words.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[stratum_col].cast("string").alias("stratum"), text_of(docs, text_col).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", ASCII_SPACE), ""))
    # a line has a word if it isn't only white space
    rows = rows.withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    rows = rows.withColumn("hs", F.expr(f"if(size(w) >= {WINDOW}, transform(sequence(1, greatest(size(w) - {WINDOW - 1}, 1)), i -> xxhash64(slice(w, i, {WINDOW}))), cast(array() as array<bigint>))"))
    rows = rows.select(
        "id", "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _symbols(F.col("t")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # (hash, place) in order of hash, only where some window occurs twice
        F.expr("if(size(array_distinct(hs)) < size(hs), array_sort(transform(hs, (h, i) -> struct(h, i))), cast(array() as array<struct<h:bigint,i:int>>))").alias("by_hash"),
    )
    # a place is repeated if its hash equals that of a neighbour in this order
    rows = rows.withColumn("marked", F.expr("""zip_with(zip_with(by_hash, slice(by_hash, 2, greatest(size(by_hash) - 1, 0)), (a, b) -> struct(a.i as i, a.h as h, b.h <=> a.h as eq)),
        concat(array(cast(null as bigint)), transform(slice(by_hash, 1, greatest(size(by_hash) - 1, 0)), x -> x.h)), (a, b) -> struct(a.i as i, a.eq or (b <=> a.h) as rep))"""))
    rows = rows.withColumn("places", F.expr("array_sort(transform(filter(marked, x -> x.rep and x.i is not null), x -> x.i))"))
    covered = f"aggregate(places, named_struct('n', 0L, 'end', 0), (s, p) -> named_struct('n', s.n + (p + {WINDOW} - greatest(p, s.end)), 'end', p + {WINDOW}), s -> s.n)"
    return rows.select("id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def _ln_gamma(x: str) -> str:
    """ln gamma(x) for x >= 1 by Stirling's series at x + 8; the error is below 1e-10."""
    z = f"({x} + 8)"
    down = " + ".join(f"ln({x} + {i})" for i in range(8))
    return f"(({z} - 0.5) * ln({z}) - {z} + 0.91893853320467274178 + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - ({down}))"


def binomial_tail(n: str, k: str, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, else 1.

    The terms fall from k on, faster than those of a normal distribution of the same spread: beyond 40 standard deviations
    (and 200 terms) below k they are under the last digit of the sum, so what is summed is the whole tail.
    """
    first = f"exp({_ln_gamma(f'({n} + 1)')} - {_ln_gamma(f'({k} + 1)')} - {_ln_gamma(f'({n} - {k} + 1)')} + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))"
    terms = f"least({k}, 200L + ceil(40 * sqrt({n} * {p}D)))"
    fold = f"""aggregate(sequence(0L, {terms}), named_struct('sum', 0D, 'term', 1D), (s, j) -> named_struct('sum', s.sum + s.term,
        'term', s.term * cast({k} - j as double) / cast({n} - {k} + j + 1 as double) * (1 - {p}D) / {p}D), s -> s.sum)"""
    return F.expr(f"if({k} >= {n} * {p}D, 1D, least(1D, {first} * {fold}))")


def cutoffs(measured: DataFrame, labels: DataFrame, *, alpha: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """stratum, rule, cutoff: the tightest certified one. Ids labelled more than once are good only if all their labels are; null labels don't count."""
    good = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.min(label_col).alias("q")).where("q = 1").select("id")
    known = measured.where("not base_failed and stratum is not null").join(good, "id", "left_semi")
    share = alpha / len(RULES)
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.expr(f"least({GRID + 1}L, (m_{r} + {step - 1}) div {step})").alias("bin")) for r, (_, step) in RULES.items()))
    counts = known.select("stratum", F.explode(rules).alias("r")).groupBy("stratum", "r.rule", "r.bin").agg(F.count("*").alias("c"))
    totals = cut(counts.groupBy("stratum", "rule").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("bins")), thin=True)  # at most GRID + 2 bins
    strata = max(1, totals.select("stratum").distinct().count())
    tests = totals.select("stratum", "rule", "n", F.expr(f"inline(transform(sequence(1L, {GRID}L), i -> struct(i, aggregate(map_keys(bins), 0L, (s, b) -> s + if(b > i, bins[b], 0L)) as k)))").alias("i", "k"))
    passed = tests.where(binomial_tail("n", "k", share) <= delta / (len(RULES) * GRID) / strata)
    steps = F.create_map(*(x for r, (_, step) in RULES.items() for x in (F.lit(r), F.lit(step))))
    return passed.groupBy("stratum", "rule").agg(F.min("i").alias("i")).select("stratum", "rule", (F.col("i") * steps[F.col("rule")]).alias("cutoff"))


def quality(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept`` (not base_failed, and no certified cutoff of its stratum exceeded).

    Nulls: a null text is empty (and fails the base), a null stratum has no certified cutoffs, a null id is unlabelled.
    Empty tables give no rows or no cutoffs. Extra columns are ignored. Repeated rows count as documents of their own.
    """
    m = features(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col)
    m = m.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    m = cut(m.withColumns({f"m_{r}": F.expr(e) for r, (e, _) in RULES.items()}))
    limits = cutoffs(m, labels, alpha=alpha, delta=delta, id_col=id_col)
    limits = limits.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES))
    out = m.join(limits, "stratum", "left")
    fails = [F.coalesce(F.col(f"m_{r}") > F.col(f"c_{r}"), F.lit(False)) for r in RULES]
    any_fail = fails[0]
    for f in fails[1:]:
        any_fail = any_fail | f
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~any_fail).alias("kept"), "n_lines")

"""Mixing sources to target weights by entropy balancing.

Document rates minimise the relative entropy to one copy each, subject to every source's token target and to 0 <= rate
<= 2. The dual has one multiplier lambda per source, and rate = min(2, exp(lambda x)) with x the document's size over
its source's mean size by token. Safeguarded Newton steps solve all sources at once, over (source, size, count) as the
sufficient statistic. Rates are then rounded to copies so that each source's total stays by its target:

* large documents (over EPS / 2 of their source, so at most 2 / EPS of them) in order of size, each absorbing the error
  so far as far as 0 to 2 copies go;
* the rest by one threshold on hash(id) - fraction, chosen from a histogram so that the source's total meets what the
  large ones left; only within the threshold's own bin documents are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, cut, text_of

#: Weights, repeating over the sources in order of code point, null last; the mix takes SHARE of all sizes.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
EPS, BINS = 0.001, 2048


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, ASCII_SPACE), "")).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """src, S and r, the source's rank from 1 by code point, null last: sorted over all tasks, with a row for each partition in the driver."""
    mask = F.lit((1 << 33) - 1)
    rows = cut(sizes.orderBy(F.col("src").asc_nulls_last()).select("src", "S", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(mask).alias("i")))
    starts, at = [], 1
    for part, n in sorted((x["part"], x["count"]) for x in rows.groupBy("part").count().collect()):
        starts.append((part, at))
        at += n
    return rows.join(F.broadcast(sizes.sparkSession.createDataFrame(starts, "part int, start long")), "part").select("src", "S", (F.col("start") + F.col("i")).alias("r"))  # one row for each partition


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """src, r, S, T for each source of (src, S): shares of ``share`` x the total by weight, none above MOST x S.

    The level is what a weight of one gets. Sources that would get more than their cap are capped and the rest is shared
    anew, until no more are: the capped ones only become more, so that ends. The sums are of integers, hence exact.
    """
    w = ranked(sizes).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("r") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("S") * MOST)
    w = cut(w, thin=True)
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("w") * F.lit(level) if capped >= 0 else F.lit(False)
        row = w.agg(F.sum("S").alias("all"), F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("gone"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("open"), F.count_if(over).alias("n")).first()
        if not row["open"]:
            level = math.inf
        if row["n"] == capped or not row["open"]:
            break
        level, capped = (row["all"] * share - row["gone"]) / row["open"], row["n"]
    return w.select("src", "r", "S", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("T"))


def multipliers(hist: DataFrame, goals: DataFrame, *, steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """r, src, S, T, m, lam: the dual's solution. hist has (r, size, n). lam is null where every rate is MOST (or nothing is asked)."""
    scale = hist.groupBy("r").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).cast("double").alias("m"))
    state = goals.join(scale, "r").select("r", "src", "S", "T", "m", F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), (~((F.col("S") > 0) & (F.col("T") < F.col("S") * MOST * (1 - 1e-12)))).alias("done"))
    state = cut(state.withColumn("lam", F.when(~F.col("done"), F.col("lam"))), files=1)
    mass = F.col("n") * F.col("size")
    x = F.col("size") / F.col("m")
    rate = F.when(F.col("lam") * x >= F.lit(0.0) + F.log(F.lit(float(MOST))), float(MOST)).otherwise(F.exp(F.col("lam") * x))
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done")
        sums = hist.join(open_, "r").groupBy("r").agg((F.sum(mass * rate) - F.first("T")).alias("g"), F.sum(F.when(rate < MOST, mass * x * rate).otherwise(0.0)).alias("slope"))
        new = state.join(sums, "r", "left")
        new = new.withColumns({"lo": F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("g") / F.col("slope"))
        inside = step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi"))
        halved = F.when(F.col("hi") == float("inf"), F.col("lo") + F.abs(F.col("lo")) + 1).when(F.col("lo") == float("-inf"), F.col("hi") - F.abs(F.col("hi")) - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("done") | (F.abs(F.col("g")) <= tolerance * F.col("T"))
        state = cut(new.select("r", "src", "S", "T", "m", F.when(done, F.col("lam")).when(inside, step).otherwise(halved).alias("lam"), "lo", "hi", done.alias("done")), files=1)
    # sums of floats depend on their order in the last digits: what is rounded here is the same in every run
    return state.withColumn("lam", F.round("lam", 8))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, source, copies, rate (and the columns to ``carry``).

    A null text has size 0; a null source is a source of its own, the last. Documents of size 0 get one copy, which takes
    nothing. Repeated rows are documents of their own. Decisions depend on ids and sizes only, so reruns agree. Empty
    tables give no rows. Other columns are ignored.
    """
    more = {f"x{i}": docs[c] for i, c in enumerate(carry or [])}
    text = text_of(docs, text_col)
    # by id and text, so that rows without an id, or of one id, are spread too
    u = F.pmod(F.xxhash64(F.lit("mix"), F.coalesce(docs[id_col].cast("string"), F.lit("")), text), F.lit(1 << 40)) / float(1 << 40)
    rows = cut(docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("src"), n_words(text).alias("size"), u.alias("u"), *(v.alias(k) for k, v in more.items())))
    by_size = cut(rows.groupBy("src", "size").agg(F.count("*").alias("n")), thin=True)
    goals = cut(targets(by_size.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("S"))), files=1)
    hist = by_size.alias("h").join(goals.alias("g"), F.col("h.src").eqNullSafe(F.col("g.src"))).select("r", "size", "n")
    state = multipliers(hist, goals)
    e = F.exp(F.col("lam") * F.col("size") / F.col("m"))
    rated = rows.alias("d").join(state.alias("s"), F.col("d.src").eqNullSafe(F.col("s.src"))).select("id", "d.src", "size", "u", *more, "r", "S", "T", F.round(F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(MOST)).otherwise(F.least(e, F.lit(float(MOST)))), 8).alias("rate"))
    large = (F.col("size") * 2.0 > F.col("S") * EPS) & (F.col("size") > 0)

    # large documents: at most 2 / EPS in a source
    one = F.struct((-F.col("size")).alias("o"), F.col("u"), F.col("id"), F.col("rate"), *(F.col(k) for k in more))
    kinds = f"array<struct<id:{rows.schema['id'].dataType.simpleString()},size:bigint,rate:double,copies:bigint{''.join(f',{k}:{rows.schema[k].dataType.simpleString()}' for k in more)}>>"

    def place(s: Column, d: Column) -> Column:
        size = -d["o"]
        want = s["err"] + d["rate"] * size
        copies = F.greatest(F.lit(0), F.least(F.lit(MOST), F.round(want / size))).cast("long")
        placed = F.struct(d["id"].alias("id"), size.alias("size"), d["rate"].alias("rate"), copies.alias("copies"), *(d[k].alias(k) for k in more))
        return F.struct((want - copies * size).alias("err"), F.concat(s["out"], F.array(placed)).cast(kinds).alias("out"))

    heads = rated.where(large).groupBy("r", "src", "S", "T").agg(F.sort_array(F.collect_list(one)).alias("ds"))
    heads = cut(heads.withColumn("p", F.aggregate("ds", F.struct(F.lit(0.0).alias("err"), F.array().cast(kinds).alias("out")), place)).select("r", "src", "S", "T", "p.err", "p.out"))

    # the rest: a threshold per source on v = u - fraction
    tail = rated.where(~large).withColumns({"low": F.floor("rate"), "v": F.col("u") - (F.col("rate") - F.floor("rate"))})
    tail = tail.withColumn("bin", F.when((F.col("low") < MOST) & (F.col("size") > 0) & (F.col("rate") > F.col("low")), F.floor((F.col("v") + 1) * BINS)))
    bins = tail.groupBy("r", "bin").agg(F.sum("size").alias("mass"), F.sum(F.col("size") * F.col("low")).alias("sure"), F.sum(F.col("size") * F.col("rate")).alias("exact"))
    need = bins.groupBy("r").agg(F.sum("sure").alias("sure"), F.sum("exact").alias("exact"))
    need = need.join(heads.select("r", "err"), "r", "left").select("r", F.round(F.col("exact") + F.coalesce("err", F.lit(0.0)) - F.col("sure"), 3).alias("need"))
    before = F.sum("mass").over(Window.partitionBy("r").orderBy("bin")) - F.col("mass")
    edge = bins.where("bin is not null").withColumn("before", before).join(need, "r")  # at most 2 BINS rows of a source
    edge = cut(edge.where("before < need and before + mass >= need").select("r", F.col("bin").alias("edge"), (F.col("need") - F.col("before")).alias("left_")).unionByName(
        bins.where("bin is not null").groupBy("r").agg(F.sum("mass").alias("all_")).join(need, "r").where("need > all_ or need <= 0").select("r", F.when(F.col("need") > 0, 2 * BINS + 1).otherwise(-1).cast("long").alias("edge"), F.lit(0.0).alias("left_"))
    ), files=1)
    tail = tail.join(edge, "r", "left")
    within = Window.partitionBy("r").orderBy("v", "id")
    columns = ["id", "src", "size", *more, "S", "T", "rate", "copies"]
    clear = tail.where("not (bin <=> edge) or bin is null").withColumn("copies", F.col("low") + F.when(F.col("bin") < F.col("edge"), 1).otherwise(0)).select(columns)
    close = tail.where("bin = edge").withColumn("sum", F.sum("size").over(within)).withColumn("copies", F.col("low") + F.when(F.col("sum") - F.col("size") / 2 <= F.col("left_"), 1).otherwise(0)).select(columns)
    first = heads.select("src", "S", "T", F.explode("out").alias("d")).select("d.id", "src", "d.size", *(F.col(f"d.{k}") for k in more), "S", "T", "d.rate", "d.copies").select(columns)
    out = first.unionByName(clear).unionByName(close)
    return out.select(
        F.col("id").alias(id_col), "size", F.col("S").alias("source_size"), F.col("T").alias("target"), (F.col("copies") * F.col("size")).alias("taken"),
        F.col("src").alias(source_col), "copies", "rate", *(F.col(f"x{i}").alias(c) for i, c in enumerate(carry or [])),
    )


def mix_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it has copies (none: left out).

    The rows get a key of their own in a written table, so that repeated ids keep apart.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    copies = cut(mix(keyed, id_col=id_col, source_col=source_col, text_col=text_col, carry=[key]).where("copies > 0").select(key, F.col("copies").alias(f"{key}n")))
    return keyed.join(copies, key).withColumn(key, F.explode(F.array_repeat(F.lit(0), F.col(f"{key}n").cast("int")))).select(docs.columns)

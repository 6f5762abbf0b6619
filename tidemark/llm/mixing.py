"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every source has a token target. Of all document rates that meet it the one
nearest to 1 in relative entropy is an exponential tilt, ``min(cap, exp(l * x))``
with ``x = (size / mean size) ** tilt``: documents are weighted by
``size / x`` in the entropy, so that 0 is one rate for all and 1 the full tilt by
length; 0.25 keeps a long document from deciding alone. The multiplier ``l`` of
each source solves the convex dual by Newton steps, kept in a bracket. They run
on the histogram of sizes, all that the rates depend on, aggregated before any
shuffle; so no source is a hot key.

Rates become copies in small groups of documents drawn by hash from one source:
from the largest down, each takes the whole number of copies nearest to its rate
plus what the group still owes in words. A group is then off by about half its
smallest document.

Semantics: null text has size 0; an empty document has one copy and takes
nothing; null is a source of its own and the last; equal rows (id, source, size)
share their copies as evenly as whole numbers allow; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

_KEY = "_source"


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Token target a source from (_source, source_size): weights, stopped at ``cap`` times.

    Sources are few; one task orders them. Filling goes by ``cap * size / weight``:
    those before the water line stop at their cap, the others share by weight.
    """
    ordered = Window.orderBy((F.col(_KEY) == "").asc(), F.col(_KEY))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("w"), _KEY)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total, all_w = F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("w").over(everything)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (all_w - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).withColumn("rank", F.row_number().over(by_ratio))
    line = F.min(F.when(F.col("most") / F.col("w") > F.col("level"), F.struct("rank", "level"))).over(everything)["level"]
    return rows.withColumn("line", line).withColumn("target", F.coalesce(F.least("most", F.col("line") * F.col("w")), F.col("most"))).select(_KEY, "source_size", "target")


def balance(histogram: DataFrame, targets: DataFrame, cap: float, tilt: float, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """Multiplier of each source, by Newton steps on the dual.

    ``histogram``: (_source, size, n) with sizes above 0. Each step is one
    aggregation of it; a step that leaves the bracket is replaced by its middle.
    Raises if ``most_steps`` don't suffice.
    """
    shape = histogram.groupBy(_KEY).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("smallest"))
    x = F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt)))
    full = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))
    top = F.log(F.lit(float(cap))) / F.pow(F.col("smallest") / F.col("mean"), F.lit(float(tilt)))
    state = targets.join(shape, _KEY).select(
        _KEY, "source_size", "target", "mean", F.when(full, top).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("l"), F.lit(-700.0).alias("low"), top.alias("high"), full.alias("done")
    )
    state = cut(state, "mix-state")
    for _ in range(most_steps):
        rate = F.exp(F.col("l") * x)
        taken = F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(cap))))
        slope = F.sum(F.when(rate < cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0))
        keep = [F.first(c).alias(c) for c in ("source_size", "target", "mean", "l", "low", "high", "done")]
        step = histogram.join(state, _KEY).groupBy(_KEY).agg(*keep, taken.alias("taken"), slope.alias("slope"))
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("l")).otherwise(F.col("low")), F.when(gap > 0, F.col("l")).otherwise(F.col("high"))
        newton = F.col("l") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > low) & (newton < high)
        done = F.col("done") | (F.abs(gap) <= F.col("target") * tolerance)
        after = F.when(done, F.col("l")).when(inside, newton).otherwise((low + high) / 2)
        state = cut(step.select(_KEY, "source_size", "target", "mean", after.alias("l"), low.alias("low"), high.alias("high"), done.alias("done")), "mix-state")
        if not state.filter(~F.col("done")).head(1):
            return state.select(_KEY, "mean", "l")
    raise RuntimeError(f"the multipliers did not settle in {most_steps} steps")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, tilt: float = 0.25, group: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every document: doc_id, source, size, n_same, source_size, target, rate, copies_all.

    A row stands for ``n_same`` equal rows, which take ``copies_all`` copies together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_same")).withColumn(_KEY, _source_key(F.col("source"))), "mix-rows")
    sizes = rows.groupBy(_KEY).agg(F.sum(F.col("size") * F.col("n_same")).alias("source_size"), F.count("*").alias("source_rows"))
    targets = source_targets(sizes.select(_KEY, "source_size"), weights, share, cap).join(sizes.select(_KEY, "source_rows"), _KEY)
    targets = cut(targets, "mix-targets")
    histogram = cut(rows.filter("size > 0").groupBy(_KEY, "size").agg(F.sum("n_same").alias("n")), "mix-histogram")
    tilts = balance(histogram, targets.drop("source_rows"), float(cap), tilt)
    known = targets.join(tilts, _KEY, "left")
    x = F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt)))
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.exp(F.col("l") * x))).otherwise(F.lit(1.0))
    drawn = F.pmod(F.xxhash64("doc_id", "size", _KEY), F.ceil(F.col("source_rows") / group).cast("long"))
    rated = rows.join(known, _KEY).select(_KEY, "doc_id", "source", "size", "n_same", "source_size", "target", rate.alias("rate"), drawn.alias("drawn"))
    first = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("copies"))

    def step(acc: Column, d: Column) -> Column:
        wish = d["rate"] * d["n_same"]
        owed = F.when(d["size"] > 0, acc["owed"] / d["size"]).otherwise(F.lit(0.0))
        copies = F.greatest(F.lit(0), F.least(d["n_same"] * cap, F.floor(wish + owed + 0.5))).cast("long")
        return F.struct((acc["owed"] + (wish - copies) * d["size"]).alias("owed"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    item = F.struct((-F.col("size")).alias("order"), "doc_id", "source", "size", "n_same", "rate")
    groups = rated.groupBy(_KEY, "drawn").agg(F.array_sort(F.collect_list(item)).alias("d"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    done = groups.select("source_size", "target", F.explode(F.arrays_zip("d", F.aggregate("d", first, step)["copies"].alias("c"))).alias("x"))
    return done.select("x.d.doc_id", "x.d.source", "x.d.size", "x.d.n_same", "source_size", "target", "x.d.rate", F.col("x.c").alias("copies_all"))


def _share(copies: Column, n: Column, k: Column) -> Column:
    """Copies of the k-th (from 1) of ``n`` equal rows."""
    return F.floor(copies / n).cast("long") + F.when(k <= F.pmod(copies, n), 1).otherwise(0)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row."""
    done = mix(docs, **options)
    # Two levels, so that a row repeated in a third of all rows makes no long array.
    each = done.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_same") - 1) - (F.col("n_same") - 1) % 4096, F.lit(4096).cast("long"))).alias("k0"))
    each = each.select("*", F.explode(F.sequence(F.col("k0") + 1, F.least(F.col("k0") + 4096, F.col("n_same")))).alias("k"))
    copies = _share(F.col("copies_all"), F.col("n_same"), F.col("k"))
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as it is taken; its columns are unchanged."""
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    done = mix(docs, **options).select(F.struct("doc_id", "source", "size").alias("_key"), "n_same", "copies_all")
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    row = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    same = row.join(done, row["_key"].eqNullSafe(done["_key"])).select("_row", row["_key"], "n_same", "copies_all")
    k = F.when(F.col("n_same") > 1, F.row_number().over(Window.partitionBy("_key").orderBy(F.hash("_row")))).otherwise(1)
    out = same.withColumn("k", k).withColumn("copies", _share(F.col("copies_all"), F.col("n_same"), F.col("k")))
    return out.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")

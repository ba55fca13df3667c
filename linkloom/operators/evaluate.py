"""Evaluation, audits and patches of scored pairs. Rows: q_id (owner), doc_id (record), p, and where needed hit (1 if true)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def unit_hash(*parts: Column | int) -> Column:
    """A number from 0 to 1 (exclusive) that depends on the parts only: the same on any engine that knows md5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / (1 << 32)


def f05_of(gt: Column, pred: Column, tp: Column) -> Column:
    return F.when(gt == 0, F.when(pred == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise(1.25 * tp / (0.25 * gt + pred))


def pair_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F0.5, false positive and false negative rates over pairs."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    yes, hit = F.col("p") >= threshold, F.col("hit") == 1
    c = scored.agg(n(yes & hit).alias("tp"), n(yes & ~hit).alias("fp"), n(~yes & hit).alias("fn"), n(~yes & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", r6(tp / F.greatest(tp + fp, F.lit(1)), "precision"), r6(tp / F.greatest(tp + fn, F.lit(1)), "recall"), r6(1.25 * tp / F.greatest(1.25 * tp + 0.25 * fn + fp, F.lit(1e-9)), "f05"), r6(fp / F.greatest(fp + tn, F.lit(1)), "fpr"), r6(fn / F.greatest(tp + fn, F.lit(1)), "fnr"))


def owner_scores(scored: DataFrame, threshold: float, name: str = "f") -> DataFrame:
    """F0.5 of every owner at a threshold."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    yes, hit = F.col("p") >= threshold, F.col("hit") == 1
    return scored.groupBy("q_id").agg(n(hit).alias("gt"), n(yes).alias("pred"), n(yes & hit).alias("tp")).select("q_id", f05_of(F.col("gt"), F.col("pred"), F.col("tp")).alias(name))


def paired_bootstrap(a: DataFrame, b: DataFrame, draws: int) -> DataFrame:
    """Mean difference b - a per owner, its interval over bootstrap draws, and the share of draws that aren't positive.

    Owners weigh by Poisson(1) counts that hash from owner and draw, so draws need no shuffle of owners: each task sums its own.
    """
    delta = a.join(b, "q_id").select("q_id", (F.col("fb") - F.col("fa")).alias("d"))
    u = unit_hash(F.col("q_id"), F.col("draw"))
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(F.when(u >= round(total, 9), 1).otherwise(0))
    drawn = delta.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", sum(steps[1:], steps[0]))
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    point = delta.agg(F.avg("d").alias("mean"), F.count("*").alias("owners"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)).alias("share"))
    return point.crossJoin(ends).select("owners", r6(F.col("mean"), "mean"), r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), r6(F.col("share"), "share_not_positive"))  # one row each


def fallback_value(truth: DataFrame, base: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """Recall of two pools, of what both hold, of what only the fallback holds, and of their union, by slice."""
    mark = lambda df, name: df.select("q_id", "doc_id").distinct().withColumn(name, F.lit(1))
    rows = truth.join(mark(base, "x"), ["q_id", "doc_id"], "left").join(mark(fallback, "y"), ["q_id", "doc_id"], "left").fillna(0, ["x", "y"])
    share = lambda c, name: r6(F.avg(c), name)
    return rows.groupBy(by).agg(F.count("*").alias("links"), share(F.col("x"), "base"), share(F.col("y"), "fallback"), share(F.col("x") * F.col("y"), "overlap"), share((1 - F.col("x")) * F.col("y"), "exclusive"), share(F.greatest("x", "y"), "either"))


def error_decomposition(scored: DataFrame, threshold: float) -> DataFrame:
    """Macro F0.5, and what it would be without any false positive, and with every missed link added."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    yes, hit = F.col("p") >= threshold, F.col("hit") == 1
    o = scored.groupBy("q_id").agg(n(hit).alias("gt"), n(yes).alias("pred"), n(yes & hit).alias("tp"))
    gt, pred, tp = F.col("gt"), F.col("pred"), F.col("tp")
    return o.agg(F.count("*").alias("owners"), r6(F.avg(f05_of(gt, pred, tp)), "macro"), r6(F.avg(f05_of(gt, tp, tp)), "without_fp"), r6(F.avg(f05_of(gt, pred + gt - tp, gt)), "with_fn"), F.sum(pred - tp).alias("fp"), F.sum(gt - tp).alias("fn"))


def symmetric_ceiling(scored: DataFrame, cell: list[str]) -> DataFrame:
    """Best macro F0.5 for a method that can't tell pairs of one owner and cell apart: it takes a cell where at least half of it
    is true, or nothing."""
    cells = scored.groupBy("q_id", *cell).agg(F.count("*").alias("n"), F.sum("hit").alias("t"))
    take = F.col("t") * 2 >= F.col("n")
    o = cells.groupBy("q_id").agg(F.sum("t").alias("gt"), F.sum(F.when(take, F.col("n")).otherwise(0)).alias("pred"), F.sum(F.when(take, F.col("t")).otherwise(0)).alias("tp"))
    return o.agg(F.count("*").alias("owners"), r6(F.avg(f05_of(F.col("gt"), F.col("pred"), F.col("tp"))), "ceiling"))


def self_estimate(scored: DataFrame, threshold: float, draws: int) -> DataFrame:
    """Macro F0.5 that the probabilities themselves foresee: matches are drawn from p, by a hash, and the draws averaged."""
    drawn = scored.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("t", F.when(unit_hash(F.col("q_id"), F.col("doc_id"), F.col("draw")) < F.col("p"), 1).otherwise(0))
    yes = F.when(F.col("p") >= threshold, 1).otherwise(0)
    o = drawn.groupBy("draw", "q_id").agg(F.sum("t").alias("gt"), F.sum(yes).alias("pred"), F.sum(yes * F.col("t")).alias("tp"))
    return o.agg(F.count_distinct("draw").alias("draws"), r6(F.avg(f05_of(F.col("gt"), F.col("pred"), F.col("tp"))), "expected"))


def monte_carlo_sets(scored: DataFrame, draws: int) -> DataFrame:
    """Per owner, how many of the best candidates to take for the largest mean F0.5 over drawn truths; the fewest of equals."""
    order = Window.partitionBy("q_id").orderBy(F.desc("p"), "doc_id")
    rows = scored.withColumn("k", F.row_number().over(order)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    rows = rows.withColumn("t", F.when(unit_hash(F.col("q_id"), F.col("doc_id"), F.col("draw")) < F.col("p"), 1).otherwise(0))
    run = Window.partitionBy("q_id", "draw").orderBy("k")
    rows = rows.withColumns({"tp": F.sum("t").over(run), "gt": F.sum("t").over(Window.partitionBy("q_id", "draw"))})
    taken = rows.select("q_id", "draw", "k", f05_of(F.col("gt"), F.col("k"), F.col("tp")).alias("f"))
    none = rows.select("q_id", "draw", "gt").distinct().select("q_id", "draw", F.lit(0).alias("k"), F.when(F.col("gt") == 0, 1.0).otherwise(0.0).alias("f"))
    means = taken.union(none).groupBy("q_id", "k").agg(F.round(F.avg("f"), 6).alias("expected"))
    return means.groupBy("q_id").agg(F.max(F.struct("expected", (-F.col("k")).alias("m"))).alias("x")).select("q_id", (-F.col("x.m")).alias("k"), "x.expected")


def seeded_split(owners: DataFrame, shares: dict[str, float], seed: int, excluded: DataFrame | None = None) -> DataFrame:
    """Disjoint named splits by a hash of owner and seed, of those owners that aren't excluded."""
    rows = owners if excluded is None else owners.join(excluded.select("q_id").distinct(), "q_id", "left_anti")
    u, out, at = unit_hash(F.col("q_id"), seed), None, 0.0
    for name, share in shares.items():
        at = round(at + share, 9)
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return rows.withColumn("split", out.otherwise("rest"))


def half_split(owners: DataFrame, stratum: str, seed: int) -> DataFrame:
    """Halves of each stratum, the first one larger by one for an odd number."""
    whole = Window.partitionBy(stratum)
    order = whole.orderBy(unit_hash(F.col("q_id"), seed), "q_id")
    return owners.withColumn("half", F.when(F.row_number().over(order) * 2 <= F.count("*").over(whole) + 1, "train").otherwise("validation"))


def false_positive_ownership(scored: DataFrame, threshold: float) -> DataFrame:
    """Accepted false pairs by whether the record has a true owner elsewhere, or is a distractor."""
    owned = scored.where("hit = 1").groupBy("doc_id").agg(F.count("*").alias("owners"))
    false = scored.where((F.col("p") >= threshold) & (F.col("hit") == 0)).join(owned, "doc_id", "left")
    return false.groupBy(F.when(F.col("owners").isNull(), "distractor").otherwise("owned elsewhere").alias("kind")).agg(F.count("*").alias("pairs"), r6(F.avg("p"), "mean_p"))


def acceptance_by(scored: DataFrame, by: str, threshold: float) -> DataFrame:
    yes = F.when(F.col("p") >= threshold, 1).otherwise(0)
    return scored.groupBy(by).agg(F.count("*").alias("pairs"), F.sum(yes).alias("accepted"), r6(F.avg(yes), "acceptance"), r6(F.sum(yes * F.col("hit")) / F.greatest(F.sum(yes), F.lit(1)), "precision"))


def distribution_shift(df: DataFrame, value: str, group: str, bins: int) -> DataFrame:
    """Shares of two groups by bin of a value from 0 to 1; the total variation is half the sum of the gaps."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    n = lambda g: F.sum(F.when(F.col(group) == g, 1).otherwise(0))
    cells = df.groupBy(b.alias("bin")).agg(n(0).alias("n0"), n(1).alias("n1"))
    total = cells.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    return cells.crossJoin(F.broadcast(total)).select("bin", "n0", "n1", r6(F.col("n0") / F.col("t0"), "share0"), r6(F.col("n1") / F.col("t1"), "share1"), r6(F.abs(F.col("n0") / F.col("t0") - F.col("n1") / F.col("t1")), "gap"))  # one row


def claimer_by_margin(scored: DataFrame, threshold: float, edges: tuple[float, ...]) -> DataFrame:
    """Precision of the best claimer of contested records, by its lead over the next."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("p"), "q_id")
    rows = scored.where(F.col("p") >= threshold).withColumns({"r": F.row_number().over(order), "lead": F.round(F.col("p") - F.lead("p").over(order), 6)}).where("r = 1 and lead is not null")
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col("lead") >= e))
    return rows.groupBy(bucket.alias("bin")).agg(F.count("*").alias("records"), r6(F.avg("hit"), "precision"), r6(F.avg("lead"), "mean_lead"))


def two_sample(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mann-Whitney U of group 1, its AUC, and Cohen's d. Values are counted first; the window holds distinct values."""
    by = df.groupBy(value).agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("n1"))
    below = F.coalesce(F.sum("n0").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = by.withColumn("u", F.col("n1") * (below + F.col("n0") / 2)).agg(F.sum("u").alias("u"), F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    m = df.agg(of(F.avg, 0).alias("m0"), of(F.avg, 1).alias("m1"), of(F.var_samp, 0).alias("v0"), of(F.var_samp, 1).alias("v1"))
    pooled = F.sqrt(((F.col("t0") - 1) * F.col("v0") + (F.col("t1") - 1) * F.col("v1")) / (F.col("t0") + F.col("t1") - 2))
    return u.crossJoin(m).select(F.col("u").cast("double").alias("u"), r6(F.col("u") / (F.col("t0") * F.col("t1")), "auc"), r6((F.col("m1") - F.col("m0")) / pooled, "cohen_d"))  # one row each


def stratified_auc(scored: DataFrame, stratum: str) -> DataFrame:
    """AUC inside each stratum, over the pairs of a true and a false row there."""
    by = scored.groupBy(stratum, "p").agg(F.sum(1 - F.col("hit")).alias("n0"), F.sum("hit").alias("n1"))
    below = F.coalesce(F.sum("n0").over(Window.partitionBy(stratum).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = by.withColumn("u", F.col("n1") * (below + F.col("n0") / 2)).groupBy(stratum).agg(F.sum("u").alias("u"), (F.sum("n0") * F.sum("n1")).alias("pairs"))
    return sums.select(stratum, "pairs", r6(F.col("u") / F.col("pairs"), "auc"))


def cascade(scored: DataFrame, second: DataFrame, least: float) -> DataFrame:
    """The second score where the first reaches least, the first one elsewhere."""
    rows = scored.where(F.col("p") >= least).join(second.select("q_id", "doc_id", "p2"), ["q_id", "doc_id"], "left").withColumn("stage", F.lit(2))
    rest = scored.where(F.col("p") < least).withColumn("p2", F.col("p")).withColumn("stage", F.lit(1))
    return rows.unionByName(rest).select("q_id", "doc_id", "stage", F.coalesce("p2", "p").alias("p"))


def over_capacity(links: DataFrame, seen: DataFrame, by: str) -> DataFrame:
    """Owners with more links of a kind than any owner of the labelled links has."""
    most = seen.groupBy("q_id", by).agg(F.count("*").alias("n")).groupBy(by).agg(F.max("n").alias("most"))
    return links.groupBy("q_id", by).agg(F.count("*").alias("n")).join(most, by).where("n > most").select("q_id", by, "n", "most")


def shift_patch(pool: DataFrame, threshold: float, shifts: list[int], ratio: float = 5.0) -> DataFrame:
    """Accepted links without those at a number offset in shifts, for classes where shifts clear the ratio to mirrored offsets
    both in the pool and among the accepted; an owner whose links would all go keeps them. Rows: q_id, doc_id, p, klass, delta."""
    n = lambda s, extra=F.lit(True): F.sum(F.when(F.col("delta").isin(*s) & extra, 1).otherwise(0))
    yes, back = F.col("p") >= threshold, [-s for s in shifts]
    c = pool.groupBy("klass").agg(n(shifts).alias("ps"), n(back).alias("pm"), n(shifts, yes).alias("s"), n(back, yes).alias("m"))
    bad = c.where((F.col("ps") / F.greatest("pm", F.lit(1)) >= ratio) & (F.col("s") > 0) & ((F.col("m") == 0) | (F.col("s") / F.col("m") >= ratio))).select("klass", F.lit(1).alias("bad"))
    rows = pool.where(yes).join(bad, "klass", "left").withColumn("drop", F.when(F.col("bad").isNotNull() & F.col("delta").isin(*shifts), 1).otherwise(0))
    left = F.sum(1 - F.col("drop")).over(Window.partitionBy("q_id"))
    return rows.withColumn("left", left).where("drop = 0 or left = 0").select("q_id", "doc_id", "p")


def sibling_rules(scored: DataFrame, threshold: float, least: float, lead: float) -> DataFrame:
    """Accepted links after two rules on records of one owner. Rows: q_id, doc_id, p, key, number.

    Rescue: a pair over least joins if an accepted sibling has its key and number. Veto: an accepted pair goes if an accepted
    sibling with its key and another number leads it by more than lead.
    """
    yes = F.col("p") >= threshold
    best = F.max(F.when(yes, F.col("p")))
    same, group = Window.partitionBy("q_id", "key", "number"), Window.partitionBy("q_id", "key")
    rows = scored.withColumns({"twin": best.over(same), "top": F.max(F.when(yes, F.struct("p", "number"))).over(group)})
    vetoed = F.coalesce((F.col("top.number") != F.col("number")) & (F.round(F.col("top.p") - F.col("p"), 6) > lead), F.lit(False))
    rule = F.when(yes & ~vetoed, "accepted").when(yes, "vetoed").when((F.col("p") >= least) & F.col("twin").isNotNull(), "rescued")
    return rows.withColumn("rule", rule).where("rule is not null").select("q_id", "doc_id", "p", "rule")


def flag_scorecard(scored: DataFrame, flag: Column, threshold: float) -> DataFrame:
    """Pairs, precision and acceptance inside and outside a flag, and what vetoing or rescuing all flagged pairs changes."""
    yes = F.when(F.col("p") >= threshold, 1).otherwise(0)
    rows = scored.withColumn("flag", F.when(flag, 1).otherwise(0))
    return rows.groupBy("flag").agg(
        F.count("*").alias("pairs"), F.sum(yes).alias("accepted"), r6(F.sum(yes * F.col("hit")) / F.greatest(F.sum(yes), F.lit(1)), "precision"),
        F.sum(yes * (1 - F.col("hit"))).alias("veto_gain"), F.sum(yes * F.col("hit")).alias("veto_loss"), F.sum((1 - yes) * F.col("hit")).alias("rescue_gain"), F.sum((1 - yes) * (1 - F.col("hit"))).alias("rescue_loss"),
    )


def agreement_cells(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Disjoint cells of two models' decisions, with pairs, truth and mean difference."""
    rows = a.join(b.select("q_id", "doc_id", F.col("p").alias("pb")), ["q_id", "doc_id"])
    cell = F.concat(F.when(F.col("p") >= threshold, "A").otherwise("a"), F.when(F.col("pb") >= threshold, "B").otherwise("b"))
    return rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("pairs"), r6(F.avg("hit"), "share_true"), r6(F.avg(F.abs(F.col("p") - F.col("pb"))), "mean_gap"))


def score_parity(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Largest and mean difference of two score tables, rows that only one has, and decisions that differ."""
    rows = a.select("q_id", "doc_id", F.col("p").alias("pa")).join(b.select("q_id", "doc_id", F.col("p").alias("pb")), ["q_id", "doc_id"], "full")
    differ = (F.coalesce(F.col("pa") >= threshold, F.lit(False))) != (F.coalesce(F.col("pb") >= threshold, F.lit(False)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.agg(F.count("*").alias("pairs"), n(F.col("pa").isNull() | F.col("pb").isNull()).alias("one_sided"), r6(F.max(F.abs(F.col("pa") - F.col("pb"))), "max_gap"), r6(F.avg(F.abs(F.col("pa") - F.col("pb"))), "mean_gap"), n(differ).alias("mismatches"))


def residual_mass(scored: DataFrame, threshold: float, least: float) -> DataFrame:
    """Per owner: pairs under the threshold but not under least, their mass, and that of what lies lower."""
    part = lambda lo, hi: (F.col("p") >= lo) & (F.col("p") < hi)
    return scored.groupBy("q_id").agg(F.sum(F.when(part(least, threshold), 1).otherwise(0)).alias("kept"), r6(F.sum(F.when(part(least, threshold), F.col("p")).otherwise(0.0)), "mass"), r6(F.sum(F.when(F.col("p") < least, F.col("p")).otherwise(0.0)), "lower_mass"))


def claimer_audit(scored: DataFrame, threshold: float) -> DataFrame:
    """What the rule of the best claimer removes: pairs, true ones among them, and records that lose their true owner."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("p"), "q_id")
    rows = scored.where(F.col("p") >= threshold).withColumn("r", F.row_number().over(order))
    return rows.agg(F.count("*").alias("claims"), F.sum(F.when(F.col("r") > 1, 1).otherwise(0)).alias("removed"), F.sum(F.when(F.col("r") > 1, F.col("hit")).otherwise(0)).alias("removed_true"), F.sum(F.when((F.col("r") == 1) & (F.col("hit") == 0), 1).otherwise(0)).alias("kept_false"))


def binomial_thinning(counts: DataFrame, keep: float, observed: DataFrame, most: int) -> DataFrame:
    """A histogram of counts (n, owners) thinned with probability keep, against an observed one: expected owners, z and the term of
    chi squared by count. n goes up to most, a bound of the histogram that is checked."""
    if counts.where(F.col("n") > most).limit(1).count():
        raise ValueError(f"a count is over {most}")
    rows = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    log_factorial = lambda c: F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(most + 1)]), c.cast("int"))
    p = F.exp(log_factorial(F.col("n")) - log_factorial(F.col("k")) - log_factorial(F.col("n") - F.col("k")) + F.col("k") * math.log(keep) + (F.col("n") - F.col("k")) * math.log(1 - keep))
    expected = rows.groupBy("k").agg(F.sum(F.col("owners") * p).alias("e"))
    both = expected.join(observed.select(F.col("n").cast("int").alias("k"), F.col("owners").alias("o")), "k", "left").fillna(0, ["o"])
    return both.select("k", r6(F.col("e"), "expected"), F.col("o").cast("long").alias("observed"), r6((F.col("o") - F.col("e")) / F.sqrt("e"), "z"), r6(F.pow(F.col("o") - F.col("e"), 2) / F.col("e"), "chi2"))


def covariate_shift(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Per column: Kolmogorov-Smirnov distance of group 1 from group 0, standardised mean shift, and shares of nulls."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select(group, "v.*")
    n = lambda g: F.sum(F.when(F.col(group) == g, 1).otherwise(0))
    by = long.where("x is not null").groupBy("name", "x").agg(n(0).alias("n0"), n(1).alias("n1"))
    run, whole = Window.partitionBy("name").orderBy("x"), Window.partitionBy("name")
    gap = F.abs(F.sum("n0").over(run) / F.sum("n0").over(whole) - F.sum("n1").over(run) / F.sum("n1").over(whole))
    ks = by.withColumn("gap", gap).groupBy("name").agg(r6(F.max("gap"), "ks"))
    of = lambda f, g: f(F.when(F.col(group) == g, F.col("x")))
    null = lambda g: F.avg(F.when(F.col(group) == g, F.when(F.col("x").isNull(), 1.0).otherwise(0.0)))
    m = long.groupBy("name").agg(r6((of(F.avg, 1) - of(F.avg, 0)) / F.sqrt((of(F.var_samp, 0) + of(F.var_samp, 1)) / 2), "mean_shift"), r6(null(0), "null0"), r6(null(1), "null1"))
    return m.join(ks, "name", "left")


def group_shape(sizes: DataFrame) -> DataFrame:
    """Of group sizes n: how many, mean, share of single ones, and the size-biased expectations E[others] and E[n^2]/E[n] - 1."""
    return sizes.agg(F.count("*").alias("groups"), r6(F.avg("n"), "mean"), r6(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), "share_single"), r6(F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n"), "others_given_one"), r6(F.avg(F.col("n") * F.col("n")) / F.avg("n") - 1, "size_bias"))


def twin_shares(records: DataFrame, key: str, klass: str) -> DataFrame:
    """By class: share of rows whose key another row of the class has, and share whose key a row of another class has."""
    rows = records.where(F.col(key).isNotNull())
    inside, total = F.count("*").over(Window.partitionBy(key, klass)), F.count("*").over(Window.partitionBy(key))
    marked = rows.withColumns({"i": inside, "t": total})
    return marked.groupBy(klass).agg(F.count("*").alias("rows"), r6(F.avg(F.when(F.col("i") > 1, 1.0).otherwise(0.0)), "twin_inside"), r6(F.avg(F.when(F.col("t") > F.col("i"), 1.0).otherwise(0.0)), "twin_across"))


def neighbourhood(df: DataFrame, cells: list[str], flag: str, split: str) -> DataFrame:
    """Rate of hits with and without a flag inside cells of existing features, by split."""
    rate = lambda f: r6(F.avg(F.when(F.col(flag) == f, F.col("hit"))), f"rate{f}")
    return df.groupBy(split, *cells).agg(F.count("*").alias("n"), F.sum(flag).alias("flagged"), rate(0), rate(1))


def compatibility_posterior(scored: DataFrame, prior: float) -> DataFrame:
    """Per record, the probability that none of its owners is right, with exclusive owners and a prior for none."""
    odds = F.col("p") / (1 - F.col("p"))
    return scored.groupBy("doc_id").agg(F.count("*").alias("owners"), r6(F.lit(prior) / (F.lit(prior) + F.sum(odds)), "p_none"), r6(F.max(odds) / (F.lit(prior) + F.sum(odds)), "p_best"))


def count_prior_audit(scored: DataFrame, threshold: float) -> DataFrame:
    """Owners by predicted count: how many, mean true count, and mean expected count by the probabilities."""
    o = scored.groupBy("q_id").agg(F.sum(F.when(F.col("p") >= threshold, 1).otherwise(0)).alias("predicted"), F.sum("hit").alias("true"), F.sum("p").alias("mass"))
    return o.groupBy("predicted").agg(F.count("*").alias("owners"), r6(F.avg("true"), "mean_true"), r6(F.avg("mass"), "mean_mass"))


def expected_gain(scored: DataFrame, threshold: float) -> DataFrame:
    """Per accepted pair, the change of its owner's F0.5 if it goes, in case it is false and in case it is true, and their mean
    by 1 - p and p. The owner's other pairs count as they are labelled."""
    yes, whole = F.when(F.col("p") >= threshold, 1).otherwise(0), Window.partitionBy("q_id")
    rows = scored.withColumns({"gt": F.sum("hit").over(whole), "pred": F.sum(yes).over(whole), "tp": F.sum(yes * F.col("hit")).over(whole)}).where(F.col("p") >= threshold)
    gt, pred, tp, h = F.col("gt"), F.col("pred"), F.col("tp"), F.col("hit")
    false = f05_of(gt - h, pred - 1, tp - h) - f05_of(gt - h, pred, tp - h)
    true = f05_of(gt - h + 1, pred - 1, tp - h) - f05_of(gt - h + 1, pred, tp - h + 1)
    return rows.select("q_id", "doc_id", "p", r6(false, "if_false"), r6(true, "if_true"), r6((1 - F.col("p")) * false + F.col("p") * true, "gain"))


def logit_shift(scored: DataFrame, target: float, steps: int = 25) -> tuple[float, DataFrame]:
    """A shift of all logits that makes the mean probability the target, by Newton's method, and the rows with the shifted p. Each
    step is one aggregate of two numbers."""
    shift, logit = 0.0, F.log(F.greatest(F.col("p"), F.lit(1e-9)) / F.greatest(1 - F.col("p"), F.lit(1e-9)))
    moved = lambda b: 1 / (1 + F.exp(-(logit + F.lit(b))))
    for _ in range(steps):
        m, slope = scored.agg(F.avg(moved(shift)), F.avg(moved(shift) * (1 - moved(shift)))).first()
        step = max(-2.0, min(2.0, (target - m) / max(slope, 1e-9)))
        shift += step
        if abs(step) < 1e-10:
            break
    return shift, scored.withColumn("p", moved(shift))


def incremental_logit(df: DataFrame, flag: str, rounds: int = 25) -> dict[str, float]:
    """y ~ 1 + logit(p) + flag by iteratively reweighted least squares: the flag's coefficient, its standard error, and twice the
    gain in log likelihood over the model without it. Each round is one aggregate of a 3 x 3 matrix."""
    import numpy as np

    logit = F.log(F.greatest(F.col("p"), F.lit(1e-9)) / F.greatest(1 - F.col("p"), F.lit(1e-9)))
    rows = df.select(F.lit(1.0).alias("x0"), logit.alias("x1"), F.col(flag).cast("double").alias("x2"), F.col("hit").cast("double").alias("y"))

    def fit(names: list[str]):
        beta = np.zeros(len(names))
        for _ in range(rounds):
            eta = sum((F.col(n) * F.lit(float(b)) for n, b in zip(names, beta, strict=True)), F.lit(0.0))
            mu = 1 / (1 + F.exp(-eta))
            cells = [F.sum(mu * (1 - mu) * F.col(a) * F.col(b)) for a in names for b in names] + [F.sum((F.col("y") - mu) * F.col(a)) for a in names]
            likelihood = F.sum(F.col("y") * F.log(F.greatest(mu, F.lit(1e-12))) + (1 - F.col("y")) * F.log(F.greatest(1 - mu, F.lit(1e-12))))
            *values, ll = rows.agg(*cells, likelihood).first()
            k = len(names)
            info = np.array(values[: k * k]).reshape(k, k)
            step = np.linalg.solve(info + 1e-12 * np.eye(k), np.array(values[k * k :]))
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        return beta, info, ll

    beta, info, ll = fit(["x0", "x1", "x2"])
    _, _, ll0 = fit(["x0", "x1"])
    return {"coefficient": float(beta[2]), "error": float(np.sqrt(np.linalg.inv(info)[2, 2])), "chi2": 2 * (ll - ll0)}


def char_edit(a: str, b: str) -> str:
    """How a token differs from another by one edit: same, transpose, leet, sub, double, insert, delete or other."""
    leet = {frozenset(x) for x in ("0o", "1l", "1i", "3e", "4a", "5s", "7t")}
    if a == b:
        return "same"
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        if len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]:
            return "transpose"
        return ("leet" if frozenset((a[at[0]], b[at[0]])) in leet else "sub") if len(at) == 1 else "other"
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) != 1:
        return "other"
    for i in range(len(long)):
        if long[:i] + long[i + 1 :] == short:
            doubled = i and long[i] == long[i - 1] or i + 1 < len(long) and long[i] == long[i + 1]
            return "double" if doubled else "insert" if len(b) > len(a) else "delete"
    return "other"


@F.pandas_udf(T.StringType())
def char_edit_typology(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else char_edit(x, y) for x, y in zip(a, b, strict=True)])


def rerank_diagnostic(pool: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    """How many groups find more, as many or fewer true pairs (hit = 1) in their best k after ranking by another score.

    pool: the group's columns, doc_id, rank, hit and the score. Groups without a true pair in the pool are left out.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(score), "doc_id")
    found = lambda place, name: F.sum(F.when(F.col(place) <= k, F.col("hit")).otherwise(0)).alias(name)
    rows = pool.withColumn("_new", F.row_number().over(order)).groupBy(*by)
    groups = rows.agg(found("rank", "old"), found("_new", "new"), F.sum("hit").alias("held")).where("held > 0")
    one = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    old, new = F.col("old"), F.col("new")
    return groups.agg(F.count("*").alias("groups"), one(new > old, "improved"), one(new == old, "same"), one(new < old, "worse"))

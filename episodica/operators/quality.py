"""Reports over episodes: adoption and prematurity, mismatch runs, rates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions import text as T

from . import ordered


def tick_metrics(df: DataFrame, key: str, step: str, oracle: str, pred: str) -> DataFrame:
    """Per tick: content match, oracle transitions with their adoption lag, predicted ones and prematurity.

    lag: ticks until the prediction first equals the new oracle text, from the
    tick of the transition on; null where it never does. premature: the newly
    predicted text was not among the oracle's up to this tick. Found by one
    aggregation per text and windows, not by a self-join of ticks.
    """
    w = Window.partitionBy(key).orderBy(step)
    base = df.select(key, step, F.coalesce(oracle, F.lit("")).alias("o"), F.coalesce(pred, F.lit("")).alias("p"))
    moved = lambda c: (F.row_number().over(w) > 1) & (F.col(c) != F.lag(c).over(w))
    base = base.withColumn("o_moved", moved("o")).withColumn("p_moved", moved("p"))
    # The first prediction of a text at or after a tick: texts of both kinds in one ordered partition.
    said = base.select(key, F.col("p").alias("text"), step, F.lit(1).alias("kind"))
    asked = base.filter("o_moved").select(key, F.col("o").alias("text"), step, F.lit(0).alias("kind"))
    by_text = Window.partitionBy(key, "text").orderBy(step, "kind").rowsBetween(0, Window.unboundedFollowing)
    found = asked.union(said).withColumn("at", F.first(F.when(F.col("kind") == 1, F.col(step)), True).over(by_text)).filter("kind = 0")
    lags = found.select(key, step, (F.col("at") - F.col(step)).alias("lag"))
    # When the oracle first had each text.
    first = base.groupBy(key, F.col("o").alias("p")).agg(F.min(step).alias("since"))
    out = base.join(lags, [key, step], "left").join(first, [key, "p"], "left")
    return out.select(key, step, (F.col("o") == F.col("p")).alias("content"), "o_moved", "lag", "p_moved", (F.col("p_moved") & F.coalesce(F.col("since") > F.col(step), F.lit(True))).alias("premature"))


def tick_report(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Per group: ticks, content matches, transitions, adopted ones, upper median and largest lag, premature ones."""
    lags = F.array_sort(F.collect_list(F.when(F.col("o_moved"), F.col("lag"))))
    out = metrics.groupBy(*by).agg(
        F.count("*").alias("ticks"),
        F.count_if("content").alias("content"),
        F.count_if("o_moved").alias("transitions"),
        F.count_if(F.col("o_moved") & F.col("lag").isNotNull()).alias("adopted"),
        lags.alias("lags_"),
        F.max("lag").alias("max_lag"),
        F.count_if("p_moved").alias("predicted"),
        F.count_if("premature").alias("premature"),
    )
    median = F.when(F.size("lags_") > 0, F.get("lags_", F.floor(F.size("lags_") / 2).cast("int")))
    return out.withColumn("median_lag", median).drop("lags_")


def mismatch_runs(df: DataFrame, key: str, step: str, mismatch: Column) -> DataFrame:
    """Per key its longest run of mismatches (the first of several): length, start, end."""
    flagged = df.withColumn("bad_", mismatch)
    runs = ordered.run_segments(flagged, [key], [step], "bad_", step).filter("bad_")
    return runs.groupBy(key).agg(F.max_by(F.struct("length", "start", "end"), F.struct("length", -F.col("start"))).alias("r")).select(key, "r.*")


def last_run(df: DataFrame, key: str, order: list[str], opens: Column) -> DataFrame:
    """Rows after the last opening marker of each key; keys without a marker have none."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("open_", F.coalesce(opens, F.lit(False))).withColumn("run_", F.count_if("open_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = marked.withColumn("most_", F.max("run_").over(Window.partitionBy(key)))
    return last.filter((F.col("run_") == F.col("most_")) & (F.col("run_") > 0) & ~F.col("open_")).drop("open_", "run_", "most_")


def positions(df: DataFrame, key: str, step: str, oracle: str, said: str) -> DataFrame:
    """df with content (texts agree but for coordinates), behind, ahead and gap.

    behind: another text than the oracle's, but one that it had earlier;
    ahead: not that, but one that it has later. gap: the L1 distance of the
    first coordinates where texts agree. One aggregation per text finds both
    ends of its stay, so no tick is paired with others.
    """
    form = lambda c: F.lower(T.without_at(F.col(c)))
    base = df.withColumn("o_", form(oracle)).withColumn("p_", form(said))
    span = base.groupBy(F.col(key).alias("k_"), F.col("o_").alias("t_")).agg(F.min(step).alias("from_"), F.max(step).alias("to_"))
    at = base.join(span, (F.col(key) == F.col("k_")) & (F.col("p_") == F.col("t_")), "left")
    differs = F.col("o_") != F.col("p_")
    behind = F.coalesce(differs & (F.col("from_") < F.col(step)), F.lit(False))
    ahead = F.coalesce(differs & ~behind & (F.col("to_") > F.col(step)), F.lit(False))
    a, b = F.get(T.coords(F.col(oracle)), 0), F.get(T.coords(F.col(said)), 0)
    gap = F.when(~differs, F.abs(a["r"] - b["r"]) + F.abs(a["c"] - b["c"]))
    return at.select(*df.columns, (~differs).alias("content"), behind.alias("behind"), ahead.alias("ahead"), gap.alias("gap"))


def failure_classes(outcomes: DataFrame, placed: DataFrame, key: str, step: str, ok: str, far: float = 14) -> DataFrame:
    """(key, class) of every outcome that is known, by rules in order; placed has what positions() adds."""
    runs = mismatch_runs(placed, key, step, F.col("behind")).select(key, F.col("length").alias("run_"))
    share = F.avg(F.when(F.col("gap").isNotNull(), (F.col("gap") > far).cast("double")))
    by = placed.groupBy(key).agg(F.avg(F.col("content").cast("double")).alias("content_"), F.coalesce(share, F.lit(0.0)).alias("bad_"), F.count_if("ahead").alias("ahead_"))
    kind = (
        F.when(F.col(ok), "success").when(F.col("content_").isNull(), "no-trace").when((F.col("content_") >= 0.8) & (F.col("bad_") <= 0.3), "policy")
        .when(F.col("bad_") > 0.5, "wrong coordinate").when(F.coalesce("run_", F.lit(0)) >= 8, "STALL").when(F.col("ahead_") >= 3, "PREMATURE").otherwise("content wrong")
    )
    known = outcomes.filter(F.col(ok).isNotNull())
    return known.join(by, key, "left").join(runs, key, "left").select(key, kind.alias("class"))


def grounding(placed: DataFrame, by: list[str], far: float = 14) -> DataFrame:
    """Per group: ticks, content matches, matches with both coordinates, their upper median gap and how many are far."""
    gaps = F.array_sort(F.collect_list("gap"))
    out = placed.groupBy(*by).agg(F.count("*").alias("ticks"), F.count_if("content").alias("content"), F.count("gap").alias("grounded"), gaps.alias("g_"), F.count_if(F.col("gap") > far).alias("far"))
    return out.withColumn("median_gap", F.get("g_", F.floor(F.size("g_") / 2).cast("int"))).drop("g_")


def stalls(placed: DataFrame, key: str, step: str, claim: str, admitted: str, least: int = 8) -> DataFrame:
    """(key, length, mechanism) of keys whose longest run behind has `least` ticks.

    SILENT: nothing was claimed in the run; HELD: something was that was not
    admitted in it; else admitted, but still behind.
    """
    runs = mismatch_runs(placed, key, step, F.col("behind")).filter(F.col("length") >= least)
    inside = placed.join(runs.withColumnRenamed(key, "k_"), (F.col(key) == F.col("k_")) & F.col(step).between(F.col("start"), F.col("end")))
    by = inside.groupBy(key, "length").agg(F.collect_set(claim).alias("c_"), F.collect_set(admitted).alias("a_"))
    kind = F.when(F.size("c_") == 0, "SILENT").when(F.size(F.array_except("c_", "a_")) > 0, "HELD").otherwise("admitted but behind")
    return by.select(key, "length", kind.alias("mechanism"))


def rates(df: DataFrame, outcome: Column, by: list[str]) -> DataFrame:
    """Count and success rate by all prefixes of `by` (ROLLUP); rows without a boolean outcome don't count."""
    known = df.withColumn("ok_", outcome).filter("ok_ is not null")
    out = known.rollup(*by).agg(F.count("*").alias("n"), F.avg(F.col("ok_").cast("double")).alias("rate"), F.grouping_id().alias("level"))
    return out.withColumn("level", F.col("level").cast("bigint"))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact linear percentiles, as numpy's: n, median, p10, p90, interquartile range.

    Values are counted first, so that a group's map holds its distinct values.
    """
    counted = df.groupBy(*by, value).agg(F.count(value).alias("n_"))
    at = F.percentile(value, F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]), F.col("n_"))
    found = counted.groupBy(*by).agg(F.sum("n_").alias("n"), at.alias("p_"))
    p = lambda i: F.get("p_", F.lit(i))
    return found.select(*by, "n", p(2).alias("median"), p(0).alias("p10"), p(4).alias("p90"), (p(3) - p(1)).alias("iqr"))


def paired(on: DataFrame, override: DataFrame, off: DataFrame, key: list[str], ok: str) -> DataFrame:
    """Pairs of arms: `override` takes precedence over `on`, both against `off`; counts of the four outcomes."""
    a = on.select(*key, F.col(ok).alias("a_")).join(override.select(*key, F.col(ok).alias("b_")), key, "full")
    arm = a.select(*key, F.coalesce("b_", "a_").alias("on_")).join(off.select(*key, F.col(ok).alias("off_")), key)
    return arm.agg(F.count_if(F.col("on_") & ~F.col("off_")).alias("win"), F.count_if(~F.col("on_") & F.col("off_")).alias("lose"), F.count_if(F.col("on_") & F.col("off_")).alias("both"), F.count_if(~F.col("on_") & ~F.col("off_")).alias("neither"))


def two_level_mean(df: DataFrame, outer: str, inner: list[str], value: str, digits: int = 1) -> DataFrame:
    """Mean per outer group of its inner groups' means, rounded half up at both levels."""
    half_up = lambda x: F.round(x.cast("decimal(38,10)"), digits).cast("double")
    means = df.groupBy(outer, *inner).agg(half_up(F.avg(value)).alias("m_"))
    return means.groupBy(outer).agg(half_up(F.avg("m_")).alias("mean"), F.count("*").alias("groups"))


def best_per_column(df: DataFrame, candidate: Column, columns: list[str]) -> DataFrame:
    """df and, for each column, whether its value is the best among the candidates."""
    best = df.filter(candidate).agg(*[F.max(c).alias(f"{c}_best_") for c in columns])  # one row
    joined = df.join(F.broadcast(best), F.lit(True), "left")
    flags = [(candidate & (F.col(c) == F.col(f"{c}_best_"))).alias(f"{c}_is_best") for c in columns]
    return joined.select(*df.columns, *flags)


def target_rates(df: DataFrame, by: list[str], truth: Column, said: Column, near: tuple[int, int] = (8, 30)) -> DataFrame:
    """Rates of exact texts, of texts equal but for coordinates, and of first coordinates within two radii.

    By all groups and in total (grouping sets); pairs without coordinates on
    both sides don't count for the radii.
    """
    p, q = F.get(T.coords(truth), 0), F.get(T.coords(said), 0)
    d = F.sqrt(((p["r"] - q["r"]) * (p["r"] - q["r"]) + (p["c"] - q["c"]) * (p["c"] - q["c"])).cast("double"))
    flags = df.select(*by, (T.plain(truth) == T.plain(said)).alias("exact_"), (T.without_at(T.plain(truth)) == T.without_at(T.plain(said))).alias("form_"), d.alias("d_"))
    rate = lambda c: F.avg(c.cast("double"))
    columns = [rate(F.col("exact_")).alias("exact"), rate(F.col("form_")).alias("same_form"), *[rate(F.col("d_") <= r).alias(f"within_{r}") for r in near]]
    return flags.groupingSets([[F.col(c) for c in by], []], *by).agg(F.count("*").alias("n"), *columns, F.grouping_id().cast("bigint").alias("level"))


def completion_precision(truth: DataFrame, said: DataFrame, key: str, within: int = 16) -> DataFrame:
    """Per key: completion lines that were said, and those that a true one of the same form and about the same time bears out."""
    done = lambda df: df.filter(F.col("line").contains("completed:")).select(key, "t", T.blank_coords(F.col("line")).alias("form"))
    a = done(said)
    b = done(truth).select(F.col(key).alias("k_"), F.col("t").alias("t_"), F.col("form").alias("f_"))
    close = (a[key] == b["k_"]) & (a["form"] == b["f_"]) & (F.abs(a["t"] - b["t_"]) <= within)
    good = a.join(b, close, "left_semi").groupBy(key).agg(F.count("*").alias("right_"))
    return a.groupBy(key).agg(F.count("*").alias("said")).join(good, key, "left").select(key, "said", F.coalesce("right_", F.lit(0)).alias("right"))


def size_estimate(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """Bytes of each column by its mean length, for the table's rows or a planned number of them."""
    n = F.count("*") if rows is None else F.lit(rows)
    return df.agg(*[F.ceil(F.coalesce(F.avg(F.octet_length(c)), F.lit(0)) * n).alias(c) for c in columns])


def kind_rates(df: DataFrame, by: list[str], identity: Column, dynamics: Column, bar: float = 0.9) -> DataFrame:
    """Per group: n, share of identity and of dynamics that hold, and LOW where one is below the bar."""
    rate = lambda c: F.avg(c.cast("double"))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), rate(identity).alias("identity"), rate(dynamics).alias("dynamics"))
    return out.withColumn("flag", F.when((F.col("identity") < bar) | (F.col("dynamics") < bar), "LOW").otherwise(""))


def subset_delta(df: DataFrame, by: str, column: str, value: str, subset: Column, base: str, shade: float = 4.0) -> DataFrame:
    """Per row label: mean over the columns of the subset, its difference from the base row's, and whether that is `shade` or more."""
    means = df.filter(subset).groupBy(by).agg(F.avg(value).alias("mean"))
    reference = means.filter(F.col(by) == base).select(F.col("mean").alias("base_"))  # one row
    delta = F.col("mean") - F.col("base_")
    return means.join(F.broadcast(reference), F.lit(True), "left").select(by, "mean", delta.alias("delta"), (F.abs(delta) >= shade).alias("shaded"))


def family_means(df: DataFrame, family: str, member: str, values: list[str]) -> DataFrame:
    """Means per family over its members' means, and a row `ALL`: the unweighted mean over all members."""
    own = df.groupBy(family, member).agg(*[F.avg(v).alias(v) for v in values])
    out = own.groupingSets([[F.col(family)], []], family).agg(F.count("*").alias("members"), *[F.avg(v).alias(v) for v in values], F.grouping(family).alias("all_"))
    return out.withColumn(family, F.when(F.col("all_") == 1, "ALL").otherwise(F.col(family))).drop("all_")


def place_report(df: DataFrame, by: list[str], r: str, c: str, fallback: Column, spread: Column, edge: tuple[int, int] = (2, 253), wide: float = 60) -> DataFrame:
    """Per group: n, medians and interquartile ranges of both coordinates, shares at the border and of fallbacks, flags."""
    at_edge = (F.least(r, c) <= edge[0]) | (F.greatest(r, c) >= edge[1])
    q = lambda x: F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), q(r).alias("r_"), q(c).alias("c_"), F.avg(at_edge.cast("double")).alias("border"), F.avg(fallback.cast("double")).alias("fallback"), F.bool_or(spread).alias("s_"))
    iqr = lambda x: F.get(x, F.lit(2)) - F.get(x, F.lit(0))
    flags = F.concat_ws(" ", F.when(F.col("border") > 0, "BORDER"), F.when(F.col("fallback") > 0, "FALLBACK"), F.when(F.col("s_") & (F.greatest(iqr("r_"), iqr("c_")) > wide), "SPREAD"))
    return out.select(*by, "n", F.get("r_", F.lit(1)).alias("median_r"), F.get("c_", F.lit(1)).alias("median_c"), iqr("r_").alias("iqr_r"), iqr("c_").alias("iqr_c"), "border", "fallback", flags.alias("flags"))


def boundary_report(segments: DataFrame, verb: Column, width: Column, rise: Column, open_at: float, lifted: float) -> DataFrame:
    """By the instruction's verb: segments, median and outer percentiles of the width at their end, shares open and lifted, median rise."""
    p = F.percentile(width, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    share = lambda c: F.avg(c.cast("double"))
    out = segments.groupBy(verb.alias("verb")).agg(F.count("*").alias("n"), p.alias("p_"), share(width >= open_at).alias("open"), F.percentile(rise, F.lit(0.5)).alias("median_rise"), share(rise > lifted).alias("lifted"))
    return out.select("verb", "n", F.get("p_", F.lit(1)).alias("median"), F.get("p_", F.lit(0)).alias("p10"), F.get("p_", F.lit(2)).alias("p90"), "open", "median_rise", "lifted")


def length_stats(df: DataFrame, by: list[str], length: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(length).alias("shortest"), F.percentile(length, F.lit(0.5)).alias("p50"), F.avg(length).alias("mean"), F.max(length).alias("longest"), F.sum(length).alias("total"))


def pair_report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of pair_lines() rows, per group: lines, share that was said, median lag and coordinate error, completions and those met in time."""
    median = lambda c: F.percentile(c, F.lit(0.5))
    own = pairs.groupBy(*by).agg(F.count("*").alias("lines"), F.avg(F.col("t_said").isNotNull().cast("double")).alias("said"), median("lag").alias("median_lag"), F.count("met").alias("completions"), F.count_if("met").alias("met"))
    errors = pairs.select(*by, F.explode("errors").alias("e_")).groupBy(*by).agg(median("e_").alias("median_error"))
    return own.join(errors, by, "left")

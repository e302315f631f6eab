"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules are fixed. Beyond them each rule (a feature of the text that is large in bad texts) has a cutoff
for each stratum. All rules of a stratum are tightened together: at step j a rule's cutoff is the
value that the j-th share of the labelled bad documents reaches, as long as bad documents reach it at least
LIFT times as often as good ones do, by the shares of unlabelled documents (and every twentieth good one) that do. So the steps don't depend on the
other good documents, and these are an independent holdout: k of n of them are rejected by some rule at a step. Steps are tested in their order, loosest first, by
the exact binomial tail: if a rate above ``risk`` would show k or fewer with a probability of
at most delta / strata, the step passes, and the test goes on to the next; the last one before the first that fails is taken.
A fixed sequence costs no level, strata share delta (Bonferroni): in every stratum at once the thresholds falsely
reject at most ``risk`` of the good documents with probability 1 - delta.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbis.session import checked_broadcast, materialize

LIFT = 20.0
RULES = ("symbol_share", "dup_line_share", "repeat_share", "long_words", "short_words")


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the list, the first included.

    Windows are sorted by a 64-bit hash and compared with their neighbours, then the places of
    the repeated ones are walked in order: n log n in the length of the text.
    """
    n = F.size(words)
    at = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
    windows = F.transform(at, lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.alias("at")))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(twice, lambda x: x["at"]))

    start = F.struct(F.lit(-2).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(let(F.sort_array(windows), repeated), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(3))).alias("n")), lambda a: a["n"])
    return F.when(n >= 3, covered).otherwise(F.lit(0).cast("long"))


def with_features(docs: DataFrame, name: str = "_q") -> DataFrame:
    """docs with one more column, a struct of counts and shares. A null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    base = F.struct(
        words_of(text).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
    )

    def counted(b: Column) -> Column:
        n = F.size(b["w"]).cast("long")
        some = F.greatest(n, F.lit(1))
        return let(
            repeat_words(b["w"]),
            lambda r: F.struct(
                n.alias("n_words"), b["word_chars"].alias("word_chars"), b["n_symbols"].alias("n_symbols"), b["lines"]["dup"].alias("n_dup_lines"), r.alias("n_repeat_words"),
                ((n < 50) | (100 * r > 50 * n)).alias("base_failed"),
                (b["n_symbols"] / some).alias("symbol_share"), (b["lines"]["dup"] / F.greatest(b["lines"]["n"], F.lit(1))).alias("dup_line_share"), (r / some).alias("repeat_share"),
                (b["word_chars"] / some).alias("long_words"), (-(b["word_chars"] / some)).alias("short_words"),
            ),
        )

    # explode() of one struct: what stands above reads its fields, and can't copy the expression.
    return docs.select("*", F.explode(F.array(let(base, counted))).alias(name))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, term by term in logarithms."""
    import math

    first = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(steps, first, add, lambda a: a["sum"])))


def quantiles(values: DataFrame, shares: list[float]) -> DataFrame:
    """stratum, rule, n, step, cutoff: the largest x that at least the share shares[step] of all n x reaches or exceeds.

    Equal values are counted first; the running counts of a stratum and rule are one sorted pass that spills.
    """
    own = Window.partitionBy("stratum", "rule")
    run = own.orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = values.groupBy("stratum", "rule", "x").agg(F.count("*").alias("c"))
    ranked = counted.select("stratum", "rule", "x", "c", F.sum("c").over(run).alias("end"), F.sum("c").over(own).alias("n"))
    places = F.transform(F.array(*map(F.lit, shares)), lambda s, k: F.struct(k.alias("step"), F.greatest(F.lit(1), F.ceil(s * F.col("n"))).alias("at")))
    here = F.filter(places, lambda p: (p["at"] > F.col("end") - F.col("c")) & (p["at"] <= F.col("end")))
    return ranked.select("stratum", "rule", "n", F.col("x").alias("cutoff"), F.explode(F.transform(here, lambda p: p["step"])).alias("step"))


def steps_of(rows: DataFrame, values: DataFrame, steps: int) -> DataFrame:
    """stratum, cuts: for each rule its cutoff at each step (null: no rule yet), from the documents that aren't labelled good."""
    shares = [2.0 ** (-(steps - 1 - j) / 3) for j in range(steps)]
    bad = quantiles(values.filter("good = 0").select("stratum", "rule", "x"), shares)
    bad = materialize(bad, "cutoffs")  # steps * rules rows a stratum
    tried = bad.groupBy("stratum").agg(F.collect_list(F.struct("rule", "step", "cutoff")).alias("tried"))
    free = values.filter("good is null").join(checked_broadcast(tried, tried.count()), "stratum")
    # For each unlabelled value the cutoffs that it exceeds, counted before the shuffle.
    above = free.select("stratum", "rule", F.explode(F.filter("tried", lambda t: (t["rule"] == F.col("rule")) & (t["cutoff"] <= F.col("x")))).alias("t"))
    exceed = above.groupBy("stratum", "rule", "t.step").agg(F.count("*").alias("above"))
    whole = values.filter("good is null").groupBy("stratum", "rule").agg(F.count("*").alias("free"))
    joined = bad.join(exceed, ["stratum", "rule", "step"], "left").join(whole, ["stratum", "rule"], "left")
    # Unlabelled documents are bad as often as labelled ones; the rest of those above the cutoff are good, and one more in doubt.
    of_bad = F.element_at(F.array(*map(F.lit, shares)), F.col("step") + 1)
    of_good = F.greatest(F.coalesce(F.col("above"), F.lit(0)) - F.col("rate") * of_bad * F.col("free"), F.lit(0.0)) + 1
    rates = rows.filter("good is not null").groupBy("stratum").agg((1 - F.avg("good")).alias("rate"))
    joined = joined.join(checked_broadcast(rates, tried.count()), "stratum")
    sound = joined.filter((F.col("free") > 0) & (of_bad * (1 - F.col("rate")) * F.col("free") >= LIFT * of_good))
    lists = sound.groupBy("stratum").agg(F.collect_list(F.struct("rule", "step", "cutoff")).alias("sound"))

    def cutoffs(rule: str) -> Column:
        own = F.filter("sound", lambda t: t["rule"] == rule)
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: F.array_min(F.transform(F.filter(own, lambda t: t["step"] <= j), lambda t: t["cutoff"])))

    return lists.select("stratum", F.struct(*[cutoffs(r).alias(r) for r in RULES]).alias("cuts"))


def accepted(features: DataFrame, labels: DataFrame, *, risk: float, delta: float, steps: int) -> DataFrame:
    """thresholds() for rows (doc_id, stratum, q)."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    # Every twentieth good document helps to choose the steps, like an unlabelled one, and isn't tested on.
    marked = marked.withColumn("good", F.when((F.col("good") == 0) | (F.pmod(F.xxhash64("doc_id"), F.lit(20)) > 0), F.col("good")))
    narrow = features.filter("not q.base_failed").select("doc_id", "stratum", *[F.col("q")[r].alias(r) for r in RULES])
    rows = materialize(narrow.join(marked, "doc_id", "left").drop("doc_id"), "labelled")
    values = rows.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("v")).select("stratum", "good", "v.rule", "v.x")
    cuts = materialize(steps_of(rows, values, steps), "steps")
    strata = rows.filter("good = 1").select("stratum").distinct().count()
    held = rows.filter("good is not null").join(checked_broadcast(cuts, cuts.count()), "stratum")
    # The first step at which some rule rejects the row; cutoffs fall from step to step.
    def rejected_from(rule: str) -> Column:
        return F.nullif(F.array_position(F.transform(F.col("cuts")[rule], lambda c: F.coalesce(F.col(rule) >= c, F.lit(False))), True), F.lit(0))

    first = F.coalesce(F.least(*[rejected_from(r) for r in RULES]), F.lit(steps + 1))
    counts = materialize(held.select("stratum", "good", (first - 1).cast("int").alias("step")).groupBy("stratum", "step").agg(F.sum("good").alias("k"), F.sum(1 - F.col("good")).alias("bad")), "rejects")
    own = Window.partitionBy("stratum")
    grid = cuts.select("stratum", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")).join(counts, ["stratum", "step"], "left").na.fill(0, ["k", "bad"])
    run = own.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    summed = grid.select("stratum", "step", F.sum("k").over(run).alias("k"), F.sum("bad").over(run).alias("bad"), F.sum("k").over(own).alias("n"))
    # From n * risk on the tail is at least 1/2, a binomial's median being n * p rounded up at most: no sum of as many terms.
    tail = binomial_tail(F.least(F.col("k"), F.ceil(F.col("n") * risk)), F.col("n"), risk)
    tested = summed.filter(F.col("step") < steps).withColumn("p", tail)
    failed = F.min(F.when((F.col("n") == 0) | (F.col("p") > delta / max(strata, 1)), F.col("step"))).over(own)
    passed = tested.withColumn("failed", F.coalesce(failed, F.lit(steps))).filter(F.col("step") == F.col("failed") - 1)
    return passed.join(cuts, "stratum").select("stratum", "step", "k", "bad", "n", "p", F.struct(*[F.element_at(F.col("cuts")[r], F.col("step") + 1).alias(r) for r in RULES]).alias("cutoffs"))


def judged_features(docs: DataFrame, stratum: str, columns: list[str]) -> DataFrame:
    """row (a struct of the columns of docs), doc_id, stratum and q, computed once and written."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    return materialize(with_features(packed, "q").select("row", "doc_id", "stratum", "q"), "features")


def thresholds(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = 0.01, delta: float = 0.05, steps: int = 24) -> DataFrame:
    """stratum, step, rejected good and bad, tested good (k, bad, n), p and the cutoffs of the rules, for strata with a passed step.

    The holdout is all rows of docs whose doc_id is labelled good but for every twentieth, null doc_ids never; of
    contradicting labels the worse counts. A null cutoff: the rule isn't used.
    """
    return accepted(judged_features(docs, stratum, ["doc_id"]), labels, risk=risk, delta=delta, steps=steps)


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", columns: list[str] | None = None, risk: float = 0.01, delta: float = 0.05, steps: int = 24) -> DataFrame:
    """row (docs' columns, or ``columns`` of them, whatever they are called), doc_id, stratum, q (features) and kept.

    Every row is judged on its own, repeated ones alike; a stratum without a passed step, a
    null one counting as the empty name, has only the base rules. A null text has no words. An empty table gives no
    rows. Features are computed once, and written with the columns; doc_ids and features are shuffled,
    texts are not. Broadcast are labels' strata with their cutoffs, a row each, behind a count.
    """
    rows = judged_features(docs, stratum, docs.columns if columns is None else columns)
    cut = materialize(accepted(rows, labels, risk=risk, delta=delta, steps=steps).select("stratum", "cutoffs"), "accepted")
    rows = rows.join(checked_broadcast(cut, cut.count()), "stratum", "left")
    above = F.lit(False)
    for r in RULES:
        above = above | F.coalesce(F.col("q")[r] >= F.col("cutoffs")[r], F.lit(False))
    return rows.select("row", "doc_id", "stratum", "q", (~F.col("q.base_failed") & ~above).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with docs' columns."""
    return judge(docs, labels, **options).filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])

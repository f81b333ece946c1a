"""Quality rules whose cutoffs carry a risk guarantee. DataFrame and SQL functions only.

Each rule compares one measure of a text with a cutoff. Labelled rows are the holdout: for every
stratum, rule and candidate cutoff the false rejections among rows labelled good are counted, and
the exact binomial tail P(X <= k | n, alpha) says how surely the rate of false rejections is below
alpha. The rules share a limit: each gets an even part of LIMIT as its alpha, so all of them together falsely reject
less than LIMIT of a stratum's good documents, with probability 1 - delta for all strata at once. Cutoffs are certified if that tail is at most delta divided by the number of rules and strata
(Bonferroni); within one rule they are tested from the most lenient to the strictest, each only if
all before it passed, which needs no further correction. Among the certified ones the rule takes the
cutoff that best separates bad rows from good ones, the most lenient of equals; a rule that certifies
nothing, or gains nothing, is off in its stratum.

Null or empty text has no words and fails the base rule. Documents without a stratum form a stratum of
their own. Without labels all rules are off. A document counts once: it is good if all its labels say so. Extra columns are carried along by
`accepted` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, WORD, materialise, small_side

#: The share of a stratum's good documents that all rules together may reject, and the risk that it is more.
LIMIT = 0.1
DELTA = 0.1
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Measure -> candidate cutoffs, from lenient to strict; a text is rejected above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "punctuation_share": (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "mean_word_length": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0),
}

#: A rule's share of the limit.
ALPHA = LIMIT / len(RULES)
#: Labels that are sent to every task, about 30 bytes each; with more, documents meet them after they are measured.
LABELS = 500_000


def _without(text: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def measures(docs: DataFrame, *kept: Column) -> DataFrame:
    """The kept columns, the cheap counts and the measures of RULES, all by expressions over `text`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.select(*kept, text.alias("__text"), lines.alias("__lines"), F.regexp_replace(text, SPACE, "").alias("__solid"))
    out = out.select("*", F.length("__solid").alias("__chars"), F.size("__lines").alias("__n_lines"), F.regexp_count("__text", F.lit(WORD)).alias("__words"))
    out = out.withColumns({"__symbols": F.col("__chars") - _without("__solid", "[#*$%&|<>]+"), "__upper": F.col("__chars") - _without("__solid", r"\p{Lu}+"), "__other": F.col("__chars") - _without("__solid", r"[^\p{L}\p{N}]+"), "__dup": F.col("__n_lines") - F.size(F.array_distinct("__lines"))})
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    shares = {"symbols_per_word": ratio("__symbols", "__words"), "upper_share": ratio("__upper", "__chars"), "punctuation_share": ratio("__other", "__chars"), "dup_line_share": ratio("__dup", "__n_lines"), "mean_word_length": ratio("__chars", "__words")}
    counts = {"n_words": F.col("__words"), "word_chars": F.col("__chars"), "n_symbols": F.col("__symbols"), "n_dup_lines": F.col("__dup")}
    return out.withColumns(shares | {k: v.cast("long") for k, v in counts.items()}).drop("__lines", "__solid", "__chars", "__n_lines", "__words", "__symbols", "__upper", "__other", "__dup")


def with_repeats(out: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 5-word windows that the text holds twice or more."""
    out = out.withColumn("__w", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    # a window is known by 64 bits; texts without an equal pair go no further than the set of them
    out = out.withColumn("__h", F.expr("CASE WHEN size(__w) > 5 THEN transform(sequence(0, size(__w) - 5), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2], __w[i + 3], __w[i + 4])) ELSE array() END"))
    # arrays of one are the way to name a value: s are the windows by hash and place, p the places of those that repeat
    return out.withColumn(
        "n_repeat_words",
        F.expr("""
        CASE WHEN size(array_distinct(__h)) = size(__h) THEN 0L ELSE
          transform(array(sort_array(transform(__h, (h, i) -> struct(h AS h, i AS i)))), s ->
            transform(array(sort_array(transform(filter(sequence(0, size(s) - 1), k -> coalesce(s[k].h = get(s, k - 1).h, false) OR coalesce(s[k].h = get(s, k + 1).h, false)), k -> s[k].i))), p ->
              aggregate(sequence(1, size(p) - 1), 5L, (n, k) -> n + least(5, p[k] - p[k - 1])))[0])[0] END
        """),
    ).drop("__w", "__h", "__text")


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """One row for each stratum and rule that is on: stratum, rule, cutoff, n, k.

    labelled: stratum, good (boolean) and the measures. Only counts by stratum, rule and cutoff are formed.
    """
    strata = labelled.select("stratum").distinct().count()
    pairs = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.col(r) > c).alias("out")) for r, steps in rules.items() for i, c in enumerate(steps)]
    good = F.col("good")
    tested = (
        labelled.select("stratum", "good", F.explode(F.array(*pairs)).alias("t"))
        .groupBy("stratum", "t.rule", "t.step", "t.cutoff")
        .agg(F.count(F.when(good, 1)).alias("n"), F.count(F.when(good & F.col("t.out"), 1)).alias("k"), F.count(F.when(~good, 1)).alias("bad"), F.count(F.when(~good & F.col("t.out"), 1)).alias("caught"))
    )
    # log P(X <= k): terms by recurrence, summed in logarithms; above the mean it can't be small
    level = delta / max(1, len(rules) * strata)
    tail = F.expr(f"""
        CASE WHEN n = 0 OR k >= n * {alpha}D THEN 0D ELSE
          aggregate(sequence(0, cast(k AS int)), struct(n * ln(1 - {alpha}D) AS term, cast(NULL AS double) AS total),
            (a, i) -> struct(
              CASE WHEN i = 0 THEN a.term ELSE a.term + ln((n - i + 1) * {alpha}D / (i * (1 - {alpha}D))) END AS term,
              CASE WHEN i = 0 THEN a.term ELSE
                greatest(a.total, a.term + ln((n - i + 1) * {alpha}D / (i * (1 - {alpha}D))))
                + ln(1 + exp(-abs(a.total - (a.term + ln((n - i + 1) * {alpha}D / (i * (1 - {alpha}D))))))) END AS total),
            a -> a.total) END""")
    tested = tested.withColumn("certified", tail <= F.log(F.lit(level)))
    # false rejections only rise towards strict cutoffs, so the certified ones are those before the first that fails
    gain = F.try_divide(F.col("caught"), F.col("bad")) - F.try_divide(F.col("k"), F.col("n"))
    best = F.max(F.when(F.col("certified") & (gain > 0), F.struct(gain.alias("gain"), (-F.col("step")).alias("lenient"), "cutoff", "n", "k")))
    return tested.groupBy("stratum", "rule").agg(best.alias("b")).filter("b IS NOT NULL").select("stratum", "rule", "b.cutoff", "b.n", "b.k")


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def learn(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rules as one row for each stratum: stratum, and a column cut_<rule> that is null where the rule is off."""
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") == 1).alias("good"))
    few = small_side(good, LABELS)
    if few is good:
        labelled = measures(docs, F.col("doc_id").alias("__id"), _stratum(docs).alias("stratum")).drop("__text").join(good, "__id")
    else:  # only labelled documents are measured
        own = docs.select(F.col("doc_id").alias("__id"), "text", "lang").join(few, "__id")
        labelled = measures(own, F.col("__id"), F.col("good"), _stratum(own).alias("stratum")).drop("__text")
    labelled = materialise(labelled.drop("__id"), "labelled")
    rules = options.get("rules", RULES)
    wide = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules]
    return materialise(cutoffs(labelled, **options).groupBy("stratum").agg(*wide), "cutoffs")


def judge(docs: DataFrame, learned: DataFrame, *kept: Column, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """The kept columns, the counts, base_failed and kept."""
    out = with_repeats(measures(docs, *kept, _stratum(docs).alias("stratum"))).join(small_side(learned), "stratum", "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumns({"base_failed": base, "kept": ~base & ~rejected})


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    out = judge(docs, learn(docs, labels), *[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    # a row number in the projection keeps the optimiser from writing the whole verdict out in a pushed-down filter
    out = out.withColumn("__row", F.monotonically_increasing_id())
    return out.filter(F.col("kept") & (F.col("__row") >= 0)).select(*[F.col(a).alias(c) for c, a in own.items()])

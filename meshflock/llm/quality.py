"""Document quality by weak supervision, in DataFrame and SQL functions only.

``signals`` counts words, symbols, repeated lines and repeated word windows of whole texts.
Rules (``RULES``) turn signals into votes: 1 (good), -1 (bad) or 0 (abstains). Expectation-
maximisation over the table of vote patterns - its size is bounded by the number of rules,
not by the data - estimates how accurate the good and the bad votes of each rule are, and
the share of good documents; a document is kept if its posterior
probability of being good is at least ``threshold``. The base rules have decided some
documents already (too short, or mostly repeats); the model is fitted on all the others.

Words are runs of characters other than space and U+0009 to U+000D. A window is told apart
by a 64-bit hash of its words. Null texts have no words. Rows are judged one by one:
repeated rows get equal verdicts. An empty table gives an empty result. Input columns named
as an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\x09-\\x0D]+"
WORD = "[^ \\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_marks", "n_glued", "n_distinct", "closed", "_row")
RULES = ("symbols", "glued", "lines", "windows", "capitals", "marks", "variety", "length", "ending")


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and further signals; the text stays."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c == text or c not in (*BASE, *EXTRA)]
    d = docs.select(
        F.struct(*kept).alias("_in"),  # so that no column of the input clashes with those below
        F.array_remove(F.split(t, SPACE), "").alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    # (hash, place) of every window of three words, sorted: equal windows stand together
    window = "xxhash64(_words[i], _words[i + 1], _words[i + 2])"
    d = d.withColumn("_windows", F.expr(f"array_sort(transform(if(size(_words) < 3, array(), sequence(0, size(_words) - 3)), i -> struct({window} AS h, i AS i)))"))
    again = "coalesce(get(_windows, k - 1).h = x.h, false) or coalesce(get(_windows, k + 1).h = x.h, false)"
    d = d.withColumn("_found", F.expr(f"transform(filter(_windows, (x, k) -> {again}), x -> x.i)"))
    n = F.size("_words").cast("long")
    t = F.coalesce(F.col("_in").getField(text), F.lit(""))
    return d.select(
        "_in.*",
        n.alias("n_words"),
        F.coalesce(F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)), F.lit(0)).alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("_found", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(t, F.lit("[^ \\x09-\\x0D#*$%&|<>][#*$%&|<>]")).cast("long").alias("n_glued"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        t.rlike("[.!?\"'’”»)][ \\x09-\\x0D]*\\z").alias("closed"),
        # not deterministic: a filter that uses it stays above this projection. Pushed below, it would
        # put the sort of all windows into the function that is called for each of them.
        F.monotonically_increasing_id().alias("_row"),
    )


def computed() -> Column:
    """True; for filters on signals, which must not be evaluated before them."""
    return F.col("_row") >= 0


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> list[Column]:
    """One column per rule, in the order of ``RULES``."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))

    def vote(bad, good):
        return F.when(bad, -1).when(good, 1).otherwise(0)

    never = F.lit(False)
    return [  # who looks for a defect abstains where there is none
        vote(5 * F.col("n_symbols") > n, never),
        vote(5 * F.col("n_glued") > n, never),
        vote(2 * F.col("n_dup_lines") > F.col("n_lines"), never),
        vote(100 * F.col("n_repeat_words") > 30 * n, never),
        vote(10 * F.col("n_upper") > 4 * chars, never),
        vote(5 * F.col("n_marks") > n, never),
        vote(100 * F.col("n_distinct") < 15 * n, 100 * F.col("n_distinct") >= 35 * n),
        vote((n < 50) | (chars < 2 * n) | (chars > 15 * n), (n >= 80) & (chars >= 3 * n) & (chars <= 10 * n)),
        vote(never, F.col("closed")),
    ]


def with_votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_v_{r}": v.cast("tinyint") for r, v in zip(RULES, votes(), strict=True)})


#: Chances of a good and a bad vote before any data, on good and on bad documents: of rules
#: that only look for a defect, and of the others.
DEFECT = ((0.001, 0.002), (0.001, 0.4))
EITHER = ((0.7, 0.02), (0.5, 0.2))
START = (DEFECT,) * 6 + (EITHER,) * 3


class Model:
    """Share of good documents and, for each rule, the chances of its two votes on good and
    on bad documents: ``chances[k] = ((good vote, bad vote) if good, (...) if bad)``."""

    def __init__(self, prior: float = 0.8, chances: list | None = None):
        self.prior = prior
        self.chances = chances or list(START)

    def accuracies(self) -> list[tuple[float, float]]:
        """For each rule, how often its good votes and its bad votes are right."""
        p = self.prior
        return [(p * g[0] / (p * g[0] + (1 - p) * b[0]), (1 - p) * b[1] / (p * g[1] + (1 - p) * b[1])) for g, b in self.chances]

    def posterior(self) -> Column:
        """By the odds of each rule's vote, or of its abstaining, on good and bad documents."""
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for r, (g, b) in zip(RULES, self.chances, strict=True):
            v = F.col(f"_v_{r}")
            z = z + F.when(v > 0, math.log(g[0] / b[0])).when(v < 0, math.log(g[1] / b[1])).otherwise(math.log((1 - g[0] - g[1]) / (1 - b[0] - b[1])))
        return 1 / (1 + F.exp(-z))


def fit(patterns: DataFrame, rounds: int = 12) -> Model:
    """Expectation-maximisation; ``patterns`` has the votes and ``n``, the number of documents.

    Each round is one aggregation to a single row. Ten imagined documents of either class
    vote as in ``START``, so that no chance reaches 0 or 1."""
    model = Model()
    for _ in range(rounds):
        good, bad = F.col("n") * F.col("_q"), F.col("n") * (1 - F.col("_q"))
        sums = [F.sum(good).alias("good"), F.sum(bad).alias("bad")]
        for k, r in enumerate(RULES):
            v = F.col(f"_v_{r}")
            sums += [F.sum(F.when(hit, mass)).alias(f"{name}{k}{sign}") for name, mass in (("g", good), ("b", bad)) for sign, hit in (("p", v > 0), ("m", v < 0))]
        row = patterns.withColumn("_q", model.posterior()).agg(*sums).first().asDict()
        n = {"g": row["good"] or 0.0, "b": row["bad"] or 0.0}

        def chance(c: str, k: int) -> tuple[float, float]:
            return tuple(((row[f"{c}{k}{s}"] or 0.0) + 10 * START[k][c == "b"][i]) / (n[c] + 10) for i, s in enumerate("pm"))  # noqa: B023

        model = Model((n["g"] + 8) / (n["g"] + n["b"] + 10), [(chance("g", k), chance("b", k)) for k in range(len(RULES))])
    return model


def patterns(voted: DataFrame) -> DataFrame:
    """Vote patterns of all documents that the base rules leave open."""
    return voted.where(~base_failed() & computed()).groupBy(*[f"_v_{r}" for r in RULES]).agg(F.count("*").alias("n"))


def judged(voted: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality (posterior) and kept."""
    out = voted.withColumns({"base_failed": base_failed(), "quality": F.round(model.posterior(), 9)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*[f"_v_{r}" for r in RULES])

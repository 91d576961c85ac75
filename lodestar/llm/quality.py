"""Quality rules with risk-controlled thresholds [DataFrame functions only].

Base rules: too few words, or too many words inside repeated three-word windows. A further rule
rejects a document when any of its rates lies above that rate's cutoff. Cutoffs are not set by hand: all of them
tighten together along a fixed grid, from the mildest step to the strictest (``GRID``), and the
labelled documents are a holdout on which nothing is fitted. For each stratum (the language) the steps are tested from
the mildest on: a step passes while the exact binomial (Clopper-Pearson) upper bound of the share of good documents that
it rejects stays within ``RISK``. The rejections of the steps are nested and the test stops at the
first failure, which keeps the error of the whole sequence at its level (fixed sequence), and the
strata share ``ALPHA`` equally (Bonferroni). So with probability 1 - ALPHA no stratum
loses more than ``RISK`` of its good documents. A stratum with too few labels gets no cutoffs (about 220 good
documents are needed with four strata).

Cases: a null or empty text has no words and fails the base rules; a null language is a stratum
of its own; labels of a document that disagree count as bad, null labels are ignored; without
labels only the base rules decide; repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, words, written

RISK = 0.02
ALPHA = 0.05
#: Each rate's mildest and strictest cutoff; the steps between are even ratios.
STEPS = 60
GRID = {
    "symbol_rate": (1.0, 0.005),
    "dup_line_rate": (1.0, 0.05),
    "repeat_rate": (0.5, 0.02),
    "upper_rate": (1.0, 0.03),
    "word_length": (100.0, 6.0),
}
LEAST_WORDS = 50
MOST_REPEATED = 0.5


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the base counts of each row (windows are compared by a 64-bit hash)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = docs.select("doc_id", F.col("lang").alias("stratum"), text.alias("t"), words(text).alias("w"), lines.alias("ls"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").alias("n_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).alias("n_upper"),
        F.when(F.size("w") >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    df = df.withColumn("pairs", pairs).drop("hashes")
    near = lambda x, j, d: F.coalesce(F.get("pairs", j + d)["h"] == x["h"], F.lit(False))
    twice = F.filter("pairs", lambda x, j: near(x, j, -1) | near(x, j, 1))
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("pairs")
    covered = F.transform("starts", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("starts", j + 1) - i, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("starts")


def rates(df: DataFrame) -> DataFrame:
    """The measured rows with their rates and whether they fail the base rules."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.select(
        "*",
        per("n_symbols", "word_chars").alias("symbol_rate"),
        per("n_dup_lines", "n_lines").alias("dup_line_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"),
        per("n_upper", "word_chars").alias("upper_rate"),
        per("word_chars", "n_words").alias("word_length"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))).alias("base_failed"),
    )


def allowed(n: F.Column, risk: F.Column, alpha: F.Column) -> F.Column:
    """The most false rejections k of n at which the exact upper bound is at most ``risk``: the
    largest k with P(Binomial(n, risk) <= k) <= alpha, or -1. The sum runs in logarithms."""
    start = F.struct((n * F.log1p(-risk)).alias("lp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(a: F.Column, j: F.Column) -> F.Column:
        cdf = a["cdf"] + F.exp(a["lp"])
        lp = a["lp"] + F.log((n - j).cast("double") / (j + 1)) + F.log(risk / (1 - risk))
        return F.struct(lp.alias("lp"), cdf.alias("cdf"), F.when(cdf <= alpha, j).otherwise(a["k"]).cast("long").alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk)), start, step, lambda a: a["k"])


def cutoff(rate: str, step: F.Column) -> F.Column:
    """A rate's cutoff at a step of the grid."""
    mild, strict = GRID[rate]
    return F.lit(mild) * F.pow(F.lit(strict / mild), step / (STEPS - 1))


def first_step(rate: str) -> F.Column:
    """The mildest step that rejects a document by a rate; STEPS if none does. Never later than the comparison with
    the cutoff itself would have it."""
    mild, strict = GRID[rate]
    step = F.floor(F.log(F.col(rate) / mild) / F.log(F.lit(strict / mild)) * (STEPS - 1)) + 1
    return F.when(F.col(rate) > 0, F.greatest(F.lit(0), F.least(F.lit(STEPS), step))).otherwise(STEPS).cast("int")


def cutoffs(rated: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """stratum, step: the strictest step that passed, one row for each stratum that has one."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = rated.where("not base_failed").join(good, "doc_id", "left_semi")
    counts = held.select("stratum", F.least(*map(first_step, GRID)).alias("first")).groupBy("stratum", "first").count()
    # a stratum has at most a row for each step from here on
    per = counts.groupBy("stratum").agg(F.sum("count").alias("n"), F.collect_list(F.struct("first", "count")).alias("steps"))
    strata = per.agg(F.count("*").alias("strata"))
    per = per.crossJoin(F.broadcast(strata)).withColumn("most", allowed(F.col("n"), F.lit(risk), F.lit(alpha) / F.col("strata")))
    rejected = lambda s: F.aggregate(F.filter("steps", lambda x: x["first"] <= s), F.lit(0).cast("long"), lambda a, x: a + x["count"])
    fails = F.array_min(F.transform(F.filter("steps", lambda x: rejected(x["first"]) > F.col("most")), lambda x: x["first"]))
    last = F.least(F.lit(STEPS - 1), F.coalesce(fails - 1, F.lit(STEPS - 1)))
    return per.withColumn("step", last).where("most >= 0 and step >= 0").select("stratum", "step")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the step whose cutoffs applied, for each row."""
    rated = rates(written(measured(docs)))
    found = written(cutoffs(rated, labels, risk, alpha).withColumnRenamed("stratum", "of"))
    out = rated.join(found, F.col("stratum").eqNullSafe(F.col("of")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.least(*map(first_step, GRID)) > F.col("step"), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum", "step")

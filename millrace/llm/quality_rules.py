"""Quality rules: text statistics and a learned decision list, on DataFrame functions alone.

The base rules count words, symbols, repeated lines and repeated three-word windows of the whole text. The list is learned from
labelled statistics by sequential covering: a rule is a conjunction of thresholds, grown condition by condition on two thirds
of the labelled rows by information gain, pruned on the other third, kept if it is precise there, and the rows it covers are
then left out. Thresholds lie between neighbouring quantiles, so a step of growing is one histogram over (feature, quantile). The list is learned from
``TRAINING_LABELS`` labels at most, those first in the order of a hash; only their documents are measured for it. The result is an
ordered chain of Spark conditions, so judging a document is a map over the table.

Defined cases: a null text has no words and fails the base rules; a label that is null or belongs to no document is not used; a
document with several labels counts once for each; a very long text is measured whole; without labels of both kinds the list is empty and only base rules decide; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, materialise, text_of

#: Statistics a rule may test. All are ratios, so they mean the same for short and long texts.
FEATURES = (
    "symbol_share", "upper_share", "mean_word", "dup_line_share", "repeat_share", "mark_share", "bar_share", "digit_share", "distinct_share"
)
#: Bound on the labels learned from, and so on what is broadcast.
TRAINING_LABELS = 20_000
#: Quantiles of a statistic; the middles between them are tried as thresholds.
THRESHOLDS = 32
MOST_RULES, MOST_CONDITIONS = 8, 4
#: A rule must be that precise on the pruning rows, and cover that many and that share of all labelled rows.
LEAST_PRECISION, LEAST_COVER, LEAST_SHARE = 0.9, 10, 0.002

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

# Characters counted as symbols; fixed by the definition of n_symbols.
_SYMBOLS = "#*$%&|<>"


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _removed(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the base statistics and the features of each document."""
    words = F.filter(F.split("text", SPACES, -1), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.select(*[docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)], text_of(text_col).alias("text"))
    split = first.select("*", words.alias("words"), lines.alias("lines"), F.regexp_replace("text", SPACES, "").alias("solid"))
    sized = split.select(
        *[f"kept_{i}" for i in range(len(keep))],
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        _removed(F.col("solid"), _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("solid", "[^A-Z]", "")).alias("n_upper"),
        _removed(F.col("solid"), "!?").alias("n_marks"),
        _removed(F.col("solid"), "|").alias("n_bars"),
        F.length(F.regexp_replace("solid", "[^0-9]", "")).alias("n_digits"),
    )
    # Windows of three words as (hash, place), sorted, so that equal windows stand side by side.
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
            lambda i: F.struct(
                F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("window"), i.alias("place")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<window:bigint,place:int>>"))
    ordered = sized.withColumn("windows", F.sort_array(windows)).drop("words")
    repeated = F.filter(
        "windows",
        lambda w, i: (F.get("windows", i - 1)["window"] == w["window"]) | (F.get("windows", i + 1)["window"] == w["window"]),
    )
    placed = ordered.withColumn("places", F.sort_array(F.transform(repeated, lambda w: w["place"]))).drop("windows")
    # A repeated window adds the words up to the next one, three at most.
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    counted = placed.withColumn("n_repeat_words", covered.cast("long")).drop("places")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0)).cast("double")

    row = F.struct(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("n_bars", "n_words").alias("bar_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )
    # A filter would be pushed below the statistics and repeat their expressions, once per word inside them; a generator stops it.
    return counted.select(F.explode(F.array(row)).alias("row")).select("row.*")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def rejected_by(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, counted from 1, or null: the decision list as one conditional expression."""
    chain = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        chain = F.when(_holds(rule), F.lit(number)).otherwise(chain)
    return chain


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """Information gain of a condition that leaves p1 of p0 bad and n1 of n0 good rows."""
    if not p1:
        return -math.inf
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules that describe rows with ``bad``, from columns ``bad``, ``growing`` (booleans) and the features."""
    found = labelled.agg(
        *[F.percentile_approx(f, [i / THRESHOLDS for i in range(THRESHOLDS + 1)], 10_000).alias(f) for f in FEATURES]
    ).first()
    thresholds = {f: [(a + b) / 2 for a, b in itertools.pairwise(sorted(set(found[f] or [])))] for f in FEATURES}
    if not any(thresholds.values()):
        return []
    rows = materialise(with_places(labelled, thresholds))
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = rows.filter(rejected_by(rules).isNull()) if rules else rows
        rule = _pruned(left, _grown(left.filter("growing"), thresholds))
        if not rule:
            break
        rules.append(rule)
    return rules


def with_places(labelled: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """Add, for each feature, how many of its thresholds the value exceeds."""

    def place(feature: str) -> Column:
        tried = F.array(*[F.lit(t) for t in thresholds[feature]]).cast("array<double>")
        return F.size(F.filter(tried, lambda t: F.col(feature) > t))

    return labelled.select("bad", "growing", *FEATURES, F.array(*[place(f) for f in FEATURES]).alias("places"))


def _histogram(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Bad and good rows per feature and place; at most features times thresholds rows."""
    each = rows.select("bad", F.posexplode("places").alias("feature", "place"))
    counted = each.groupBy("feature", "place").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    return {(r.feature, r.place): (r.bad, r.good) for r in counted.collect()}


def _grown(rows: DataFrame, thresholds: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        within = _histogram(rows.filter(_holds(rule)) if rule else rows)
        p0, n0 = (sum(c[kind] for (feature, _), c in within.items() if feature == 0) for kind in (0, 1))
        if not p0 or not n0:
            break
        best, gain = None, 0.0
        for number, feature in enumerate(FEATURES):
            below = [0, 0]
            for place, threshold in enumerate(thresholds[feature]):
                below = [x + y for x, y in zip(below, within.get((number, place), (0, 0)), strict=True)]
                for above, (p, n) in ((True, (p0 - below[0], n0 - below[1])), (False, below)):
                    gained = _gain(p0, n0, p, n)
                    if gained > gain:
                        best, gain = Condition(feature, above, threshold), gained
        if best is None:
            break
        rule += (best,)
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> Rule:
    """The prefix with the best (p - n) / (p + n) on the pruning rows, if it is precise there and covers enough rows."""
    if not rule:
        return ()
    counts = [F.count(F.lit(1)).alias("rows")]
    for i in range(1, len(rule) + 1):
        holds, pruning = _holds(rule[:i]), ~F.col("growing")
        counts += [
            F.count_if(holds).alias(f"covered{i}"), F.count_if(holds & pruning & F.col("bad")).alias(f"p{i}"), F.count_if(holds & pruning & ~F.col("bad")).alias(f"n{i}")
        ]
    found = rows.agg(*counts).first()

    def worth(i: int) -> tuple:
        p, n = found[f"p{i}"], found[f"n{i}"]
        return (p - n) / max(1, p + n), p, -i

    best = max(range(1, len(rule) + 1), key=worth)
    p, n, covered = found[f"p{best}"], found[f"n{best}"], found[f"covered{best}"]
    enough = covered >= max(LEAST_COVER, LEAST_SHARE * found["rows"])
    return rule[:best] if enough and p and p >= LEAST_PRECISION * (p + n) else ()


def labelled_statistics(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that pass the base rules; two thirds of the documents are for growing."""
    marks = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("labelled_id"), (F.col("quality") == 0).alias("bad"))
    joined = statistics.filter(~base_failed()).join(marks, F.col("doc_id") == F.col("labelled_id"))
    growing = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 0
    return materialise(joined.select("bad", growing.alias("growing"), *FEATURES))


def verdicts(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with ``base_failed``, the ``rule`` that rejects, and ``kept``."""
    judged = statistics.withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def _learned(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The list for these documents. Their labelled ones are picked first, by a broadcast of bounded size, and only they are measured."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality")
    sample = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAINING_LABELS))
    wanted = F.broadcast(sample.select(F.col("doc_id").alias("labelled_id")).distinct())
    picked = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("labelled_id"), "left_semi")
    return learn(labelled_statistics(with_statistics(picked), sample))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of every document, by a list learned from the labels."""
    return verdicts(with_statistics(docs), _learned(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Texts are not shuffled."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    judged = verdicts(with_statistics(row, keep=("row",)), _learned(docs, labels))
    return judged.filter("kept").select("row.*")

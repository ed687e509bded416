"""Personal data by weak supervision, on DataFrame functions alone.

Patterns propose spans of eight kinds. The four base kinds have exact rules and their valid matches are always kept. For
all proposals, six labelers vote for, against or not at all: the pattern's own check, gazetteers, cue words before the
span, counter-cues, the characters around it, and its digits. Expectation-maximisation over the counts of vote patterns, of which there are
at most 3 ** 6, estimates how reliable each labeler is; the resulting probabilities train a naive Bayes classifier over
features of span and context, again from counts alone. It decides on the proposals of the other kinds.

Offsets come from splitting: the pieces between matches and the matches alternate, so a match ends where a running sum over
their lengths does. The sum is a window per document and kind over small rows; texts are not shuffled. Patterns are written so
that matching takes linear time on any text; they match what the plain forms in ``KINDS`` do.

Defined cases: a null text counts as empty; documents without spans appear with zeros and empty lists; rows without id and repeated
rows are separate rows; an empty table gives no rows; other columns are not read. Without any proposal of the other kinds, or
without labeler agreement to learn from, none of them is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, text_of


class Kind(NamedTuple):
    name: str
    pattern: str
    needs: str  # a cheap condition every text with a match fulfils
    base: bool


# Fixed patterns. Plain forms of the first four:
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]", True),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "[0-9]", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", True),
    Kind("mail_words", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?[A-Za-z]{2,8}(?![A-Za-z0-9])", "[ (\\[]dot[ )\\]]", False),
    Kind("phone_local", r"(?<![0-9A-Za-z+][ .-]?)(?:\(|(?<!\())[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", "[0-9]{3}[ .-][0-9]{4}", False),
    Kind("national_id", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]-[0-9]{2}-[0-9]", False),
    Kind("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?+(?![A-Za-z])", "(?:Mr|Ms|Dr|Herr|Frau|Mme|Sr)", False),
)
BASE = tuple(i for i, kind in enumerate(KINDS) if kind.base)

# Fixed word lists of the labelers.
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "info")
CALLING_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "61", "81", "86", "91", "55", "52")
GIVEN_NAMES = (
    "Anna", "Maria", "John", "James", "Mary", "Peter", "Paul", "Laura", "Julia", "Thomas", "Michael", "David", "Sarah", "Carlos",
    "Jean", "Marie", "Pierre", "Hans", "Klaus", "Sofia", "Lucia", "Robert", "Linda", "William", "Emma", "Martin",
)
CUES = "mail|contact|write|reach|call|phone|tel|mobile|fax|card|visa|credit|host|server|address|addr|ssn|social|name|from|dear|signed"
COUNTER_CUES = "version|isbn|issn|page|pages|chapter|section|figure|fig|table|order|item|part|price|total|volume|vol|no|doi"

CONTEXT_CHARS = 32
BLOCK_CHARS = 1024
SPANS = "array<struct<start:bigint,end:bigint,rank:int>>"
LABELERS = ("check", "gazetteer", "cue", "counter_cue", "border", "digits")
EM_ROUNDS = 50
#: Log-odds from which a proposal of the other kinds is kept: nine to one.
KEEP_ODDS = math.log(9)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _small(part: Column) -> Column:
    number = F.ltrim(part, F.lit("0"))
    return (F.length(number) <= 3) & (F.coalesce(F.substring(number, 1, 3).try_cast("int"), F.lit(0)) <= 255)


def _luhn(digits: Column) -> Column:
    def value(digit: Column, place: Column) -> Column:
        number = digit.cast("int")
        return F.when(place % 2 == 0, number).when(number > 4, 2 * number - 9).otherwise(2 * number)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def is_valid(kind: int, match: Column) -> Column:
    """The exact rule of a base kind; true for the others."""
    name = KINDS[kind].name
    if name == "ip":
        return F.forall(F.split(match, "\\."), _small)
    if name == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if name == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    voted = F.when(yes, 1)
    return (voted.when(no, -1) if no is not None else voted).otherwise(0)


def votes(kind: int, match: Column, before: Column, after: Column) -> list[Column]:
    """The six labelers' votes on a proposal, in the order of ``LABELERS``."""
    name, digits = KINDS[kind].name, _digits(match)
    ending = F.lower(F.regexp_extract(match, "([A-Za-z]+)$", 1))
    if name in ("email", "mail_words"):
        check = _vote(F.lit(True)) if name == "email" else _vote(match.rlike("[(\\[]"), F.lit(False))
        known = _vote(ending.isin(*MAIL_ENDINGS), F.length(ending) == 0)
    elif name == "person":
        check = _vote(match.rlike("\\. "))
        known = _vote(match.rlike(f" (?:{'|'.join(GIVEN_NAMES)})(?: |$)"))
    else:
        check = _vote(is_valid(kind, match), ~is_valid(kind, match))
        if name == "phone":
            known = _vote(digits.rlike(f"^(?:{'|'.join(CALLING_CODES)})"))
        elif name == "ip":
            known = _vote(~match.rlike("^(?:0|127|255)\\."), match.rlike("^(?:0|127|255)\\."))
        elif name == "card":
            known = _vote(digits.rlike("^(?:4|5[1-5]|3[47]|6011)"), F.length(digits) < 12)
        else:
            known = _vote(digits.rlike("^[2-8]"), digits.rlike("^(?:000|666|9)"))
    last_words = F.lower(before)
    cue = _vote(last_words.rlike(f"(?<![a-z])(?:{CUES})[a-z]*[^a-z0-9]*(?:[a-z]+[^a-z0-9]+)?$"))
    counter = _vote(F.lit(False), last_words.rlike(f"(?<![a-z])(?:{COUNTER_CUES})[^a-z0-9]*$"))
    border = _vote(
        before.rlike("(?:^|[\\s(<\"':,;])$") & after.rlike("^(?:$|[\\s)>\"',;.!?])"), before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    )
    same = _vote(F.lit(False), digits.rlike("^([0-9])\\1{5,}$") | digits.rlike("^(?:0123456|1234567)"))
    return [check, known, cue, counter, border, same]


def features(kind: int, match: Column, before: Column, after: Column) -> Column:
    """Names of the features a proposal has; few values each, so their weights are a small table."""
    def shape(text: Column) -> Column:
        return F.when(text.rlike("[A-Za-z]"), "a").when(text.rlike("[0-9]"), "0").when(text.rlike("\\s"), "_").when(text == "", "").otherwise(".")

    def named(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{KINDS[kind].name} {name}="), value.cast("string"))

    return F.array(
        F.lit(KINDS[kind].name),
        named("size", F.least(F.floor(F.length(match) / 4), F.lit(8))),
        named("digits", F.floor(4 * F.length(_digits(match)) / F.length(match))),
        named("before", shape(F.right(before, F.lit(1)))),
        named("after", shape(F.left(after, F.lit(1)))),
        named("cue", F.lower(before).rlike(f"(?<![a-z])(?:{CUES})")),
        named("counter", F.lower(before).rlike(f"(?<![a-z])(?:{COUNTER_CUES})")),
    )


def _by_kind(kind: Column, value: Callable[[int], Column]) -> Column:
    chain = F.when(kind == 0, value(0))
    for number in range(1, len(KINDS)):
        chain = chain.when(kind == number, value(number))
    return chain


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proposed spans with offsets, votes and features, and one row with kind -1 for each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    none = F.array().cast("array<string>")
    for i, kind in enumerate(KINDS):
        present = F.contains("text", F.lit(kind.needs)) if kind.needs == "@" else F.col("text").rlike(kind.needs)
        rows = rows.withColumn(f"matches_{i}", F.when(present, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))).otherwise(none))
    for i, kind in enumerate(KINDS):
        rows = rows.withColumn(f"pieces_{i}", F.when(F.size(f"matches_{i}") > 0, F.split("text", kind.pattern, -1)).otherwise(none))
    each = [
        F.struct(
            F.lit(i).alias("kind"),
            F.arrays_zip(
                F.slice(f"pieces_{i}", 1, F.size(f"matches_{i}")).alias("piece"), F.col(f"matches_{i}").alias("match"), F.slice(f"pieces_{i}", 2, F.size(f"matches_{i}")).alias("next")
            ).cast("array<struct<piece:string,match:string,next:string>>").alias("found"),
        )
        for i in range(len(KINDS))
    ]
    # one row per document with kind -1, then one per match
    whole = F.struct(F.lit(-1).alias("kind"), F.expr("array(struct('' AS piece, '' AS match, '' AS next))").alias("found"))
    exploded = (
        rows.select("row", "doc_id", F.explode(F.filter(F.array(whole, *each), lambda k: F.size(k["found"]) > 0)).alias("k"))
        .select("row", "doc_id", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("place", "f"))
        .select(
            "row",
            "doc_id",
            "kind",
            "place",
            F.length("f.piece").cast("long").alias("gap"),
            F.right("f.piece", F.lit(CONTEXT_CHARS)).alias("before"),
            F.col("f.match").alias("match"),
            F.left("f.next", F.lit(1)).alias("after"),
        )
    )
    so_far = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = exploded.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
    seen = ("match", "before", "after")
    return placed.select(
        "row",
        "doc_id",
        "kind",
        (F.col("end") - F.length("match")).alias("start"),
        "end",
        F.coalesce(_by_kind(F.col("kind"), lambda k: is_valid(k, F.col("match"))), F.lit(False)).alias("valid"),
        _by_kind(F.col("kind"), lambda k: F.array(*votes(k, *map(F.col, seen)))).alias("votes"),
        _by_kind(F.col("kind"), lambda k: features(k, *map(F.col, seen))).alias("features"),
    )


class Reliability(NamedTuple):
    """Prior odds of personal data, and per labeler the log-likelihood ratio of each vote."""

    prior: float
    ratios: tuple[dict[int, float], ...]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = self.prior + sum(r[v] for r, v in zip(self.ratios, pattern, strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> Reliability:
    """Labelers' reliabilities from the counts of their vote patterns, starting from the majority vote."""
    belief = {p: 0.5 + 0.45 * max(-1, min(1, sum(p))) for p in counts}
    fitted = Reliability(0.0, tuple({-1: 0.0, 0: 0.0, 1: 0.0} for _ in LABELERS))
    for _ in range(rounds):
        yes = sum(n * belief[p] for p, n in counts.items())
        no = sum(n * (1 - belief[p]) for p, n in counts.items())
        ratios = []
        for labeler in range(len(LABELERS)):
            votes_yes, votes_no = ({v: 1.0 for v in (-1, 0, 1)} for _ in range(2))
            for pattern, n in counts.items():
                votes_yes[pattern[labeler]] += n * belief[pattern]
                votes_no[pattern[labeler]] += n * (1 - belief[pattern])
            ratios.append({v: math.log(votes_yes[v] / (yes + 3)) - math.log(votes_no[v] / (no + 3)) for v in (-1, 0, 1)})
        fitted = Reliability(math.log((yes + 1) / (no + 1)), tuple(ratios))
        belief = {p: fitted.posterior(p) for p in counts}
    return fitted


class Classifier(NamedTuple):
    """Naive Bayes over feature names."""

    prior: float
    weights: dict[str, float]

    def odds(self, names: Column) -> Column:
        if not self.weights:
            return F.lit(-math.inf)
        table = F.create_map(*[F.lit(x) for pair in sorted(self.weights.items()) for x in pair])
        return F.aggregate(F.transform(names, lambda f: F.coalesce(F.element_at(table, f), F.lit(0.0))), F.lit(self.prior), lambda a, b: a + b)


def train(proposed: DataFrame) -> Classifier:
    """The final classifier. Only counts reach the driver: of vote patterns, then of feature values."""
    spans = proposed.filter("kind >= 0")
    counts = {tuple(r["votes"]): r["n"] for r in spans.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Classifier(0.0, {})
    reliability = expectation_maximisation(counts)
    odds = F.lit(reliability.prior)
    for i, ratio in enumerate(reliability.ratios):
        vote = F.get("votes", F.lit(i))
        odds = odds + F.when(vote == 1, ratio[1]).when(vote == -1, ratio[-1]).otherwise(ratio[0])
    belief = spans.select("features", (1 / (1 + F.exp(-odds))).alias("p"))
    weighed = (
        belief.select(F.explode(F.array_append("features", F.lit("all"))).alias("feature"), "p")
        .groupBy("feature")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    )
    sums = {r["feature"]: (r["yes"], r["no"]) for r in weighed.collect()}
    yes, no = sums.pop("all")
    weights = {f: math.log((y + 1) / (yes + 2)) - math.log((n + 1) / (no + 2)) for f, (y, n) in sums.items()}
    return Classifier(math.log((yes + 1) / (no + 1)), weights)


def chosen(proposed: DataFrame, classifier: Classifier) -> DataFrame:
    """Proposals with ``base``, the valid ones of base kinds, and ``kept``, with those the classifier adds."""
    base = F.col("valid") & F.col("kind").isin(*BASE)
    added = (F.col("kind") >= len(BASE)) & (classifier.odds(F.col("features")) >= KEEP_ODDS)
    return proposed.select("row", "doc_id", "kind", "start", "end", base.alias("base"), F.coalesce(base | added, F.lit(False)).alias("kept"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``found``, its spans (start, kind, end, base) in order."""
    proposed = materialise(proposals(docs, id_col, text_col))
    found = chosen(proposed, train(proposed))
    span = F.when(F.col("kept"), F.struct("start", "kind", "end", "base"))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("found")).drop("row")


def written_out(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _kept_spans(kind: int, rank: int, classifier: Classifier) -> Callable[[Column, Column], Column]:
    """Step over the matches of a kind: where the last one ends, and the kept ones so far."""

    def step(state: Column, p: Column) -> Column:
        before, after = F.right(p["piece"], F.lit(CONTEXT_CHARS)), F.left(F.coalesce(p["next"], F.lit("")), F.lit(1))
        if KINDS[kind].base:
            kept = is_valid(kind, p["match"])
        else:
            kept = classifier.odds(features(kind, p["match"], before, after)) >= KEEP_ODDS
        start = state["at"] + F.length(p["piece"])
        end = start + F.length(p["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"))
        return F.struct(end.alias("at"), F.when(kept, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return step


def _united(spans: Column) -> Column:
    """Sorted spans without overlaps: those that overlap become one, of the first kind among them."""

    def step(state: Column, s: Column) -> Column:
        joined = F.struct(state["open"]["start"].alias("start"), F.greatest(state["open"]["end"], s["end"]).alias("end"), F.least(state["open"]["rank"], s["rank"]).alias("rank"))
        overlaps = s["start"] < state["open"]["end"]
        return F.struct(
            F.when(overlaps, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), F.when(overlaps, joined).otherwise(s).alias("open")
        )

    first = F.struct(F.array().cast(SPANS).alias("done"), F.get(spans, F.lit(0)).alias("open"))
    rest = F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0)))
    return F.aggregate(rest, first, step, lambda state: F.array_append(state["done"], state["open"]))


def _cut(start: Column, end: Column) -> Column:
    """Characters of the text from its blocks, so that a cut takes no longer for being far behind."""
    first, last = F.floor(start / BLOCK_CHARS).cast("int"), F.floor(end / BLOCK_CHARS).cast("int")
    near = F.array_join(F.slice("blocks", first + 1, last - first + 1), "")
    return F.substring(near, (start % BLOCK_CHARS + 1).cast("int"), (end - start).cast("int"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with personal data replaced by the name of its kind in brackets, with their own columns.

    The classifier is trained as for ``spans``; the replacement itself is one map over the texts. Spans of all kinds are found on
    the original text; overlapping ones are replaced as one, by the most specific of their kinds. A null text stays null.
    """
    classifier = train(materialise(proposals(docs, id_col, text_col)))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[text_col].cast("string").alias("text"), F.array().cast(SPANS).alias("spans"))
    none = F.array().cast("array<string>")
    order = (0, 3, 1, 2, *range(len(BASE), len(KINDS)))
    for rank, kind in enumerate(order):
        pattern = KINDS[kind].pattern
        present = F.contains("text", F.lit("@")) if kind == 0 else F.col("text").rlike(KINDS[kind].needs)
        rows = rows.withColumn("matches", F.when(present, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        rows = rows.withColumn("pieces", F.when(F.size("matches") > 0, F.split("text", pattern, -1)).otherwise(none))
        count = F.size("matches")
        zipped = F.arrays_zip(
            F.slice("pieces", 1, count).alias("piece"), F.col("matches").alias("match"), F.slice("pieces", 2, count).alias("next")
        ).cast("array<struct<piece:string,match:string,next:string>>")
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
        kept = F.aggregate(zipped, start, _kept_spans(kind, rank, classifier), lambda state: state["spans"])
        rows = rows.select("row", "text", F.when(count > 0, F.concat("spans", kept)).otherwise(F.col("spans")).alias("spans"))
    some = F.size("spans") > 0
    rows = rows.select("row", "text", F.when(some, _united(F.array_sort("spans"))).alias("spans"))
    rows = rows.withColumn("blocks", F.when(F.col("spans").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))))
    tags = F.array(*[F.lit(f"[{KINDS[kind].name.upper()}]") for kind in order])
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    rows = rows.withColumn("ends", F.when(F.col("spans").isNotNull(), ends))
    replaced = F.transform("spans", lambda s, i: F.concat(_cut(F.get("ends", i), s["start"]), F.get(tags, s["rank"])))
    tail = _cut(F.element_at("ends", -1), F.length("text").cast("long"))
    text = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(replaced, ""), tail)).otherwise(F.col("text"))
    rows = rows.select("row", text.alias("text"))
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])

"""Exact deduplication with a heavy-hitter split.

Digests that make up a large share of the rows are found with Misra-Gries summaries, one per task,
merged by addition. Their exact counts and winners are at most ``counters`` rows, which are broadcast:
the rows of such groups are decided on the map side and never meet in one task. The remaining groups
are small by construction and use an ordinary shuffle of digests. Texts are never shuffled.

Defined cases: a null text counts as empty; rows without id lose against rows with one; of rows equal in id
and text exactly one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, text_of

#: Counters of a summary. A digest with more than 2 / COUNTERS of all rows is always found.
COUNTERS = 1024


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may hold more than ``2 / counters`` of the rows: fewer than ``counters`` rows.

    A task's summary undercounts a digest by at most 1 / (counters + 1) of its rows, so the added counters of a
    digest above twice that share stay above it, and fewer than ``counters`` digests can.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = held.add(batch["digest"].value_counts(), fill_value=0)
            if len(held) > counters:
                held = held - held.nlargest(counters + 1).iloc[-1]
                held = held[held > 0]
        yield pd.DataFrame({"digest": list(held.index), "counter": held.to_numpy(dtype="int64")})

    rows = digests.count()
    summaries = digests.select("digest").mapInPandas(summarise, "digest binary, counter bigint")
    return (
        summaries.groupBy("digest")
        .agg(F.sum("counter").alias("counter"))
        .filter(F.col("counter") > max(1.0, rows / counters))
        .select("digest")
    )


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document, with a tag that tells repeated rows apart."""
    return materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row_tag"),
        )
    )


def winners_of(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact size and winner of each frequent digest."""
    suspects = F.broadcast(misra_gries(rows, counters))
    return materialise(
        rows.join(suspects, "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_tag")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def decide(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The winner and the group of every row of ``digested``."""
    frequent = F.broadcast(winners)
    heavy = rows.join(frequent, "digest").select("doc_id", "digest", "row_tag", "winner", "group_size")
    group = Window.partitionBy("digest")
    rest = rows.join(frequent.select("digest"), "digest", "left_anti").select(
        "doc_id",
        "digest",
        "row_tag",
        F.max(F.struct("doc_id", "row_tag")).over(group).alias("winner"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_tag") == F.col("winner.row_tag")).alias("kept"),
        "digest",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the SHA-256 digest of the text."""
    rows = digested(docs, id_col, text_col)
    return decide(rows, winners_of(rows, counters))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents without copies, with their own columns.

    Rows of frequent digests are removed on the map side; of the others those listed as losers are.
    """
    rows = digested(docs, id_col, text_col)
    winners = winners_of(rows, counters)
    pairs = materialise(
        decide(rows, winners)
        .groupBy("doc_id", "digest")
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    )
    names = docs.columns
    tagged = docs.select(
        F.struct(*[docs[name] for name in names]).alias("row"),
        docs[id_col].alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)).alias("digest"),
    )
    frequent = F.broadcast(winners.select("digest", F.col("winner.doc_id").alias("winner_id"), F.lit(True).alias("frequent")))
    left = tagged.join(frequent, "digest", "left").filter(
        F.col("frequent").isNull() | F.col("doc_id").eqNullSafe(F.col("winner_id"))
    )
    losers = pairs.join(frequent, "digest", "left_anti").filter("NOT kept").select(
        F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest")
    )
    left = left.join(
        losers, (F.col("digest") == F.col("lost_digest")) & F.col("doc_id").eqNullSafe(F.col("lost_id")), "left_anti"
    ).select("row", "doc_id", "digest")
    repeated = pairs.filter("kept AND copies > 1").select(
        F.col("doc_id").alias("same_id"), F.col("digest").alias("same_digest")
    )
    if not repeated.isEmpty():
        same = (F.col("digest") == F.col("same_digest")) & F.col("doc_id").eqNullSafe(F.col("same_id"))
        once = left.join(repeated, same, "left_semi").groupBy("doc_id", "digest").agg(F.first("row").alias("row"))
        left = left.join(repeated, same, "left_anti").select("row").unionByName(once.select("row"))
    return left.select("row.*")

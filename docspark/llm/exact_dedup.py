"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of each task (the DataSketches frequent-items sketch behind approx_top_k), merged in two steps,
names the digests that may be frequent. One exact aggregation over those candidates verifies them and picks their winners;
the verified winners, at most `candidates` rows, are broadcast, so every row of a hot group is settled map-side
without a shuffle. All other digests are grouped by an ordinary shuffle, where no group can be large any more.
Only ids, lengths and digests move; texts don't.

Defined cases: null text counts as empty, and all empty texts are one group. Of equal texts the row with the most code
points stays, then the smallest doc_id (a null doc_id comes last), then, of rows that repeat doc_id and text, one. Texts
of any length are digested whole. An empty table gives an empty result. Extra columns, whatever their names, pass
through keep_first and don't appear in decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import SPACES, in_files, sent_whole, stash, told_apart, whole


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", "")


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", candidates: int = 1024, counters: int = 16384) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per row of docs.

    counters bounds each task's summary; a digest that holds more than about 1 / counters of the rows is found.
    candidates bounds the broadcast. Neither changes the result, only which way a group takes.
    """
    rows = stash(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            F.length(F.coalesce(text, F.lit(""))).alias("n"),
            F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row").alias("not_row")))  # ~x falls as x grows, and never overflows
    winners = stash(
        rows.join(F.broadcast(frequent(rows, candidates, counters)), "text_sha256", "left_semi").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1"),
        "winners",
    )
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    group = Window.partitionBy("text_sha256")
    light = marked.filter("best is null").select("doc_id", "text_sha256", "row", best.over(group).alias("best"), F.count("*").over(group).alias("group_size"))
    heavy = marked.filter("best is not null").select("doc_id", "text_sha256", "row", "best", "group_size")
    return heavy.unionByName(light).select(
        "doc_id",
        F.bitwise_not("best.not_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.bitwise_not("best.not_row")).alias("kept"),
        "text_sha256",
    )


def frequent(rows: DataFrame, candidates: int, counters: int, merges: int = 256) -> DataFrame:
    """(text_sha256) of at most `candidates` digests that may be frequent.

    Each task sums up its rows in `counters` counters; the summaries meet in `merges` groups, and only those groups' in one task.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(merges)).alias("merge")
    some = rows.groupBy(group).agg(F.expr(f"approx_top_k_accumulate(text_sha256, {counters})").alias("summary"))
    whole = some.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {candidates})")).alias("top")).select(F.col("top.item").alias("text_sha256"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Texts stay where they are: only the ids of rows that go are looked up, from a broadcast table where there are at most
    most_broadcast of them and by a shuffle beyond that. Rows whose doc_id is null or repeated are told by their text as
    well; of those that are equal in both one stays.
    """
    n = docs.count()
    decided = stash(in_files(decide(docs, doc_id, text).select("doc_id", "kept", "text_sha256"), n), "decided")
    by_id = decided.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"))
    alone = F.col("doc_id").isNotNull() & (F.col("rows") == 1)
    touched = stash(in_files(by_id.filter(~alone | (F.col("kept") == 0)).select("doc_id", alone.alias("gone")), n), "touched")
    mine = docs.select(whole(docs), F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    known = sent_whole(touched, most_broadcast)
    out = mine.join(known, mine["id"].eqNullSafe(known["doc_id"]), "left_anti").select("whole.*")
    unclear = touched.filter("not gone").drop("gone")
    if not unclear.limit(1).count():
        return out
    kept = decided.filter("kept").join(unclear, decided["doc_id"].eqNullSafe(unclear["doc_id"]), "left_semi")
    here = mine.withColumn("sha", F.sha2(normalised(F.col("text")).cast("binary"), 256))
    here = here.join(kept, here["id"].eqNullSafe(kept["doc_id"]) & (F.col("sha") == kept["text_sha256"]), "left_semi")
    order = F.struct(F.length(F.coalesce("text", F.lit(""))), told_apart(docs))
    once = here.groupBy("id", "sha").agg(F.max_by("whole", order).alias("whole"))  # copies of one id meet in each task first
    return out.unionByName(once.select("whole.*"))

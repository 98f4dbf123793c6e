"""Mixing sources to target weights by Pareto order sampling.

Every source is to contribute its share of the total, which is the tokens its documents and those of the other named
sources hold now. A document's expected copies are in proportion to its weight, the logarithm of its tokens (an almost empty
message says little, and a long one not as much more as it is longer), at most ``max_repeats``; the factor is the one with
which the expected tokens of the source meet its target. The whole part of the expected copies is given as certain copies;
the rest is the document's own inclusion probability. Documents get a uniform number from a hash of their id and are ranked
by random odds divided by inclusion odds (Pareto order sampling); the smallest ranks are taken until the source's remaining
tokens are filled.

No source is sorted in one task: ranks are counted in ``BUCKETS`` buckets per source, the bucket in which the remaining
tokens run out is found on these counts, and only its documents are ordered among each other.

Defined cases: null or empty texts hold no tokens and are left out; documents of unlisted or null sources and sources
with share 0 are left out; a source that can't reach its target within ``max_repeats`` gives what it has, and the actual
shares report it; the same id always draws the same number, ties are broken by the id; empty tables give empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import broadcast_if_small, cut_lineage, table

#: A vocabulary of a public tokenizer: byte-level ranks, one per line. Every executor must see this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits text before merging (fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 1 << 16


def token_counts(tokenizer: str = TOKENIZER, pattern: str = PATTERN):
    """A function from batches of texts to their numbers of tokens; loads the vocabulary once per Python worker."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the id and the seed, the same on every run and partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 48)


def weight(tokens: str) -> Column:
    return F.log1p(F.col(tokens))


def expected_copies(sized: DataFrame, want: DataFrame) -> DataFrame:
    """source, most, factor: expected copies of a document are factor times its weight, at most ``most`` (all documents have
    ``most`` where factor is null). Solved on the distinct sizes of each source: those from some size on are capped."""
    sizes = sized.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    have = sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("have"), F.sum(F.col("tokens") * F.col("n") * weight("tokens")).alias("weighed"))
    have = have.withColumn("total", F.sum("have").over(Window.partitionBy(F.lit(0))))  # a row per source
    plan = cut_lineage(want.join(have, "source").select("source", "most", "weighed", F.least(F.col("share") * F.col("total"), F.col("most") * F.col("have")).alias("target")))
    larger = Window.partitionBy("source").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(larger), F.lit(0.0))
    size = F.col("tokens") * F.col("n")
    at = sizes.join(broadcast_if_small(plan), "source").withColumn("capped", before(size.cast("double"))).withColumn("open", F.col("weighed") - before(size * weight("tokens")))
    at = at.withColumn("factor", (F.col("target") - F.col("most") * F.col("capped")) / F.col("open"))
    fits = (F.col("factor") > 0) & (F.col("factor") * weight("tokens") <= F.col("most"))
    solved = at.where(fits).groupBy("source").agg(F.max_by("factor", "tokens").alias("factor"))
    return plan.join(solved, "source", "left").select("source", "most", "factor")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens, repeats (at least 1) of the chosen documents."""
    want = targets.groupBy(F.col("doc_source").alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).where("source is not null and share > 0 and most > 0")
    docs = documents.select(F.col("doc_id"), F.col("source"), F.col("text")).where("doc_id is not null and text is not null and text <> ''")
    count = F.pandas_udf(token_counts(tokenizer), "bigint")
    named = docs.join(broadcast_if_small(targets.select(F.col("doc_source").alias("source")).distinct()), "source", "left_semi")
    sized = cut_lineage(named.select("doc_id", "source", count("text").alias("tokens")).where("tokens > 0"))
    plan = expected_copies(sized, want)
    u = _uniform(F.col("doc_id"), seed)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    copies = F.when(F.col("factor").isNull(), F.col("most")).otherwise(F.least(F.col("factor") * weight("tokens"), F.col("most"))).cast("double")
    drawn = sized.join(broadcast_if_small(plan), "source").withColumn("copies", copies).withColumn("sure", F.floor("copies")).withColumn("chance", F.col("copies") - F.floor("copies"))
    left = drawn.groupBy("source").agg((F.sum(F.col("tokens") * F.col("copies")) - F.sum(F.col("tokens") * F.col("sure"))).alias("rest"))
    drawn = drawn.join(broadcast_if_small(cut_lineage(left)), "source")
    # the rank's place among all possible ranks, in buckets of equal probability
    ranked = (
        drawn.withColumn("u", u).withColumn("rank", F.when(F.col("chance") > 0, odds).otherwise(F.lit(float("inf"))))
        .withColumn("bucket", F.floor(F.when(F.col("chance") > 0, F.col("rank") / (1 + F.col("rank"))).otherwise(F.lit(1.0)) * BUCKETS))
    )
    sums = ranked.where("chance > 0").groupBy("source", "bucket").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("before", before).where("before < rest and before + size >= rest").groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("last"))
    marked = ranked.join(broadcast_if_small(last), "source", "left").withColumn("edge", F.coalesce(F.col("last.bucket"), F.lit(BUCKETS + 1)))
    # documents of the last bucket alone are ordered: taken while the tokens before them, and half their own, still fit
    order = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("chance > 0 and bucket = edge").withColumn("start", F.col("last.before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("start") + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    rest = marked.where("chance = 0 or bucket <> edge").withColumn("extra", ((F.col("chance") > 0) & (F.col("bucket") < F.col("edge"))).cast("int"))
    chosen = rest.select("doc_id", "source", "tokens", "sure", "extra").unionByName(edge.select("doc_id", "source", "tokens", "sure", "extra"))
    return chosen.select("doc_id", "source", "tokens", (F.col("sure") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, documents, tokens (with repeats), actual_share, target_share."""
    sums = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    sums = sums.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row per source
    want = targets.groupBy(F.col("doc_source").alias("source")).agg(F.max("target_share").alias("target_share"))
    return (
        want.join(sums, "source", "left")
        .select("source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), "target_share")
    )


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}

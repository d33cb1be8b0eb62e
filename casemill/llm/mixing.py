"""Mixing sources to target weights.

The mixture is a sequence of slots of equal token size. The van der Corput sequence is mapped through the cumulative
target weights, so every stretch of the sequence has each source at its weight; the slots of a source are ranked, and
each takes the block of that rank from the source's stream: its documents in shuffled order, pass after pass, cut into
blocks of equal token size. Ranks and running sums are taken in two steps, over buckets and inside them, so a source
that holds most of the rows is still many small groups.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.runtime import arrow_safe, cut

#: Public tokenizer by which sizes are measured: a vocabulary of byte pairs with their ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary splits texts before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BLOCK_TOKENS = 2048
#: Documents of a source in one bucket of its stream, and slots in one bucket of the schedule, about.
BUCKET_ROWS, BUCKET_SLOTS = 20_000, 1 << 16


def token_counts(documents: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document with a source and at least one token; whole texts are encoded. Rows
    without id, text or source are left out."""
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").cast("string").alias("text")).where("doc is not null and source is not null and text is not null and text != ''")
    kind = rows.schema["doc"].dataType.simpleString()
    with open(tokenizer, "rb") as f:  # executors need not have the file: a vocabulary of about a megabyte goes to them
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc": b.doc, "source": b.source, "tokens": [len(encoding.encode_ordinary(t)) for t in b.text]})

    return rows.mapInPandas(arrow_safe(count), f"doc {kind}, source string, tokens bigint").groupBy("doc").agg(F.min_by("source", "source").alias("source"), F.min("tokens").alias("tokens"))


def van_der_corput(index: Column) -> Column:
    """Point of the base-2 van der Corput sequence: the bits of the index (under 2**52) mirrored at the binary point."""
    bits = F.lpad(F.bin(index), 52, "0")
    return F.conv(F.reverse(bits), 2, 10).cast("double") / F.lit(float(1 << 52))


class Mixture:
    """A mixture of counted documents (doc, source, tokens) after targets (source, target_share, max_repeats).

    Sources without target are not used. A target of a source without documents cannot be met: the other targets are
    scaled up in proportion. total_tokens None takes the largest total at which every source meets its share within its
    repeats; a larger one lets scarce sources fall short, and the report says by how much. Null or non-positive shares
    and repeats below 1 count as no target; a source with several target rows takes the smallest share. No documents or
    no targets give an empty plan.
    """

    def __init__(self, counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> None:
        self.counted, self.block, self.seed = cut(counted), block_tokens, seed
        spark = counted.sparkSession
        wanted = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats")).where("source is not null and share > 0 and repeats >= 1").groupBy("source").agg(F.min("share").alias("share"), F.min("repeats").alias("repeats"))
        sizes = self.counted.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"), F.max("tokens").alias("longest"))
        both = wanted.join(sizes, "source", "left").fillna(0, ["have", "docs"]).orderBy("source").collect()  # one row per target
        able = [r for r in both if r.have > 0]
        scale = sum(r.share for r in able)
        total = min((r.repeats * r.have / (r.share / scale) for r in able), default=0.0)
        if total_tokens is not None:
            total = float(total_tokens)
        plan, low = [], 0.0
        for r in both:
            share = r.share / scale if r.have > 0 else 0.0
            quota = min(int(share * total), r.repeats * r.have)
            plan.append((r.source, r.share, r.repeats, r.have, quota, low, low + share, max(1, -(-r.docs // BUCKET_ROWS))))
            low += share
        self.total = total
        self.slots = -(-int(total) // block_tokens) if able else 0
        self.quotas = spark.createDataFrame(plan, "source string, share double, repeats int, have bigint, quota bigint, low double, high double, buckets int")
        self._intervals = [(p[0], p[5], p[6]) for p in plan if p[4] > 0]

    def stream(self) -> DataFrame:
        """(source, block, doc, pass, tokens): the documents of each source's stream that its quota takes."""
        use = self.quotas.where("quota > 0").select("source", "have", "quota", "buckets")
        passes = self.counted.join(F.broadcast(use), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("have")).cast("int") - 1)))
        key = F.xxhash64("doc", "pass", F.lit(self.seed))
        laid = passes.withColumns({"key": key, "bucket": F.pmod(F.xxhash64("doc", "pass", F.lit(self.seed + 1)), F.col("buckets")).cast("int")})
        sums = laid.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("size"))
        # One row for each bucket of a source: a window over these is small.
        before = Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
        inside = Window.partitionBy("source", "pass", "bucket").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, -1)
        placed = laid.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["source", "pass", "bucket"]).withColumn("start", F.col("offset") + F.col("within"))
        return placed.where("start < quota").select("source", F.floor(F.col("start") / self.block).cast("bigint").alias("block"), "doc", "pass", "tokens", "start")

    def schedule(self) -> DataFrame:
        """(slot, source, block): the source of each slot and the rank of the slot among those of its source."""
        spark = self.counted.sparkSession
        point = van_der_corput(F.col("slot"))
        source = F.lit(None).cast("string")
        for name, low, high in reversed(self._intervals):
            source = F.when((F.col("u") >= low) & (F.col("u") < high), F.lit(name)).otherwise(source)
        last = self._intervals[-1][0] if self._intervals else None
        slots = spark.range(self.slots).select(F.col("id").alias("slot")).withColumn("u", point).withColumn("source", F.coalesce(source, F.lit(last).cast("string"))).withColumn("bucket", F.shiftright("slot", 16))
        counts = slots.groupBy("bucket", "source").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("bucket", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("bucket", "source").orderBy("slot")
        return slots.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "source"]).select("slot", "source", (F.col("rank") + F.col("offset")).cast("bigint").alias("block"))

    def plan(self) -> DataFrame:
        """(slot, source, doc, pass, tokens): every use of a document, under the slot that its block is joined to. Blocks
        past the last slot of their source (the schedule is within a few slots of the weights) follow at the end."""
        stream, slots = self.stream(), self.schedule()
        end = F.lit(self.slots) + F.col("block")
        return stream.join(slots, ["source", "block"], "left").select(F.coalesce("slot", end).alias("slot"), "source", "doc", "pass", "tokens")

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, most_repeats) for every target and the shares reached."""
        used = self.stream().groupBy("source", "doc").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses")).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_repeats"))
        both = self.quotas.select("source", F.col("share").alias("target_share")).join(used, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
        total = both.agg(F.sum("tokens").alias("total"))
        return both.join(F.broadcast(total)).select("source", "target_share", F.coalesce(F.round(F.col("tokens") / F.nullif(F.col("total"), F.lit(0)), 6), F.lit(0.0)).alias("actual_share"), "tokens", "documents", F.col("most_repeats").cast("int").alias("most_repeats"))

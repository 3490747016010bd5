"""Mixing sources to target weights, in DataFrame operations only.

Weights are tempered token shares: w proportional to share ** alpha. Alpha is bisected, many sections at a
time, so that the weights meet a target entropy (as a share of the largest possible) and no source is repeated
more often than allowed. The weights become token targets; a target is whole passes over the source and
a rest. The rest takes the source's blocks in the order of a keyed permutation until the budget is met; only the
block that crosses it is split, first into runs of its documents' order, then within the run that crosses. So what one task
orders is at most the blocks of a source, the runs of a block, or the documents of a run.

Tokens are counted once, into stored rows (id, source, tokens). The plan of a source, its borders included, is one row, and that is
all that documents are joined with. Every sum is by source, block, run or document with map-side combining; no source is
gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, packed, sized, stored_table, unpacked

SECTIONS = 64
RUN = 48  # a block is cut into runs by the bits of its documents' numbers above these


def keyed(seed: int, *columns: Column) -> Column:
    """A pseudorandom number of 60 bits from a seed and columns; MD5, so that any engine gives the same."""
    joined = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def temperature(totals: DataFrame, entropy_share: float, max_repeats: float, budget_share: float | None, rounds: int = 4) -> float:
    """The exponent of the token shares, 0 to 1.

    Entropy falls as the exponent grows, and so does the number of passes over the smallest source. The result
    is the largest exponent whose weights have at least entropy_share of the largest entropy, or, if that
    repeats a source more than max_repeats times, the smallest that doesn't. Each round evaluates 64 sections
    of both brackets in one aggregation over sources; the driver sees 65 rows. totals: source, tokens > 0.
    """
    total, n = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    grid = lambda lo, hi: [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
    p = F.col("tokens") / F.lit(float(total))

    def evaluated(points: list[float]) -> dict[float, tuple[float, float]]:
        rows = totals.select(p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a")).withColumn("q", F.pow("p", F.col("a")))
        sums = rows.groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("p")).alias("s"), F.max(F.col("q") / F.col("p")).alias("most"), F.min(F.col("q") / F.col("p")).alias("least"))
        out = {}
        for r in sums.collect():
            # passes over a source: weight * budget / tokens; without a budget the least repeated source has one pass
            out[r.a] = (math.log(r.z) - r.a * r.s / r.z, r.most / r.least if budget_share is None else r.most / r.z * budget_share)
        return out

    target = entropy_share * math.log(n)
    entropy_at, repeats_at = (0.0, 1.0), (0.0, 1.0)
    for _ in range(rounds):
        seen = evaluated(sorted({*grid(*entropy_at), *grid(*repeats_at)}))
        points = grid(*entropy_at)
        k = max((i for i, a in enumerate(points) if seen[a][0] >= target), default=0)
        entropy_at = (points[k], points[min(k + 1, SECTIONS)])
        points = grid(*repeats_at)
        k = min((i for i, a in enumerate(points) if seen[a][1] <= max_repeats), default=SECTIONS)
        repeats_at = (points[max(k - 1, 0)], points[k])
    return max(entropy_at[0], repeats_at[1])


def mix_sources(
    docs: DataFrame, entropy_share: float = 0.97, max_repeats: float = 4.0, budget_share: float | None = None, block_tokens: int = 100_000, max_blocks: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None
) -> DataFrame:
    """One row per row of docs: id, source, the columns `keep`, n_tokens, weight (of its source) and copies (how often it is taken).

    budget_share is the size of the mix as a share of all tokens; without one it is the smallest size that
    takes every document at least once. Per source, what is taken is at most its target and below
    it by less than a document, or by what documents of a block's order leave over. Null sources are a source of their own.
    Texts without tokens belong to no target and are taken once. Repeated rows and null ids are rows of
    their own (at the border, rows with the same id and number of tokens are taken all or not at all); an empty table gives no rows.
    """
    counted = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.coalesce(F.col(text_col), F.lit(""))).alias("n_tokens"), packed(keep or []).alias("kept"))
    counted = counted.withColumn("spread", keyed(seed, F.lit("block"), F.col("id"), F.col("n_tokens")))
    kept_columns = unpacked("kept", keep or [])
    narrow = stored_table(counted.select("id", "source", "n_tokens", "spread"))
    totals = checkpointed(narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    alpha = temperature(totals, entropy_share, max_repeats, budget_share)
    total, z, widest = totals.agg(F.sum("tokens").alias("t"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(alpha))).alias("z"), F.max(F.col("tokens") / F.pow(F.col("tokens").cast("double"), F.lit(alpha))).alias("w")).first()
    if total is None:
        return counted.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *kept_columns, "n_tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("copies"))
    budget = widest * z if budget_share is None else budget_share * total
    weight = F.pow(F.col("tokens").cast("double"), F.lit(alpha)) / F.lit(z)
    blocks_of = F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))).cast("long")
    plan = totals.select("source", "tokens", weight.alias("weight"), F.floor(weight * budget + 1e-6).cast("long").alias("target"), blocks_of.alias("blocks"))
    plan = plan.withColumn("passes", F.floor(F.col("target") / F.col("tokens")).cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("tokens"))
    plan = checkpointed(plan.select(F.col("source").alias("s"), "weight", "passes", "rest", "blocks"))
    plan = borders(narrow, plan, seed)

    placed = counted.join(sized(plan), F.col("source").eqNullSafe(F.col("s")), "left")
    block, run = F.pmod(F.col("spread"), F.col("blocks")), F.shiftright("spread", RUN)
    rank = F.struct(keyed(seed, F.lit("order"), F.col("source"), block).alias("order"), block.alias("block"))
    inside = (rank == F.col("crossing")) & ((run < F.col("run")) | ((run == F.col("run")) & (F.struct("spread", "id") <= F.col("last"))))
    more = F.coalesce(rank <= F.col("whole"), F.lit(False)) | F.coalesce(inside, F.lit(False))
    copies = F.when(F.col("weight").isNull() | (F.col("n_tokens") == 0), 1).otherwise(F.col("passes") + more.cast("long")).cast("long")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *kept_columns, "n_tokens", F.round(F.coalesce("weight", F.lit(0.0)), 9).alias("weight"), copies.alias("copies"))


def borders(narrow: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The plan with each source's last whole block, the block that crosses its rest, the run that does in it and the last document of that.

    narrow: id, source, n_tokens, spread; plan: s, weight, passes, rest, blocks. Blocks are named by (order, block), documents by
    (spread, id); documents that share both stand together.
    """
    of_source = F.col("source").eqNullSafe(F.col("s"))
    block = F.pmod(F.col("spread"), F.col("blocks"))
    summed = narrow.join(sized(plan), of_source).groupBy("s", block.alias("block"), "rest").agg(F.sum("n_tokens").alias("tokens"))
    ranked = summed.withColumn("rank", F.struct(keyed(seed, F.lit("order"), F.col("s"), F.col("block")).alias("order"), "block"))
    upto = F.sum("tokens").over(Window.partitionBy("s").orderBy("rank"))
    ranked = checkpointed(ranked.select("s", "rank", "rest", "tokens", upto.alias("upto")))
    whole = ranked.filter("upto <= rest").groupBy("s").agg(F.max("rank").alias("whole"))
    crossing = ranked.filter("upto > rest and upto - tokens < rest").select("s", F.col("rank").alias("crossing"), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))
    found = lambda side: F.col("s").eqNullSafe(F.col(f"{side}_s"))
    named = lambda df, side: sized(checkpointed(df)).withColumnRenamed("s", f"{side}_s")
    planned = plan.join(named(whole, "w"), found("w"), "left").drop("w_s").join(named(crossing, "c"), found("c"), "left").drop("c_s")
    planned = checkpointed(planned)

    split = narrow.join(sized(planned.filter("crossing is not null").select("s", "blocks", "crossing", "left")), of_source).filter(block == F.col("crossing.block"))
    split = split.select("s", F.shiftright("spread", RUN).alias("run"), "spread", "id", "n_tokens", "left")
    runs = split.groupBy("s", "run", "left").agg(F.sum("n_tokens").alias("tokens"))
    runs = runs.withColumn("upto", F.sum("tokens").over(Window.partitionBy("s").orderBy("run")))
    runs = checkpointed(runs.filter("upto > left and upto - tokens <= left").select("s", F.col("run").alias("at"), (F.col("left") - F.col("upto") + F.col("tokens")).alias("room")))
    documents = split.join(sized(runs).withColumnRenamed("s", "r_s"), found("r") & (F.col("run") == F.col("at"))).groupBy("s", "spread", "id", "room").agg(F.sum("n_tokens").alias("tokens"))
    taken = documents.withColumn("upto", F.sum("tokens").over(Window.partitionBy("s").orderBy("spread", "id"))).filter("upto <= room")
    last = taken.groupBy("s").agg(F.max(F.struct("spread", "id")).alias("last"))
    planned = planned.join(named(runs.select("s", F.col("at").alias("run")), "r"), found("r"), "left").drop("r_s")
    return checkpointed(planned.join(named(last, "l"), found("l"), "left").drop("l_s", "left"))

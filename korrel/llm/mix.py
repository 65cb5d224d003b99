"""Mixing sources to target weights by Poisson replication.

Each document draws a uniform from a hash of its key and inverts the Poisson distribution of its source's rate, cut
off at the source's cap: the draw needs no coordination, is the same on every run and touches each document once. The
rate is the one whose *capped* mean gives the source its target tokens; it is then fitted to the draws actually made
(a grid of rates per source, summed over all documents), because few documents would otherwise miss by chance.

The total size is the largest at which every source that has documents can reach its share within its cap. Weights are
renormalised over those sources; sources without documents, or of weight or cap 0, are reported with share 0.

Defined cases: documents whose source has no row in the targets, or a null source, are not in the mixture; null and
empty texts have 0 tokens and are drawn like any other; repeated target rows of a source count once (the first by
weight and cap); an empty table gives an empty mixture.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.bpe import VOCABULARY, count_tokens
from korrel.ordering import md5_of, uniform
from korrel.session import broadcast_if_small, cut

#: Rates tried around a source's rate when it is fitted to the draws.
GRID = np.exp(np.linspace(-0.45, 0.45, 91))


def capped_cdf(rate: float, cap: int) -> list[float]:
    """P(Poisson(rate) <= k) for k = 0..cap-1; a document is used once for each of them that its draw exceeds."""
    if math.isinf(rate):
        return [-1.0] * cap
    out, total, log_p = [], 0.0, -rate
    for k in range(cap):
        total += math.exp(log_p)
        out.append(min(1.0, total))
        log_p += math.log(rate / (k + 1)) if rate > 0 else -math.inf
    return out


def capped_mean(rate: float, cap: int) -> float:
    return sum(1 - c for c in capped_cdf(rate, cap))


def rate_for(mean: float, cap: int) -> float:
    """The rate whose Poisson distribution, cut off at cap, has this mean; infinite if the mean is the cap."""
    if mean <= 0:
        return 0.0
    if mean >= cap * (1 - 1e-9):
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean and high < 600:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return high


def _goals(targets: DataFrame) -> DataFrame:
    """source, target_weight, max_repeats; one row per source."""
    best = F.max(F.struct(F.coalesce("target_weight", F.lit(0.0)).cast("double").alias("w"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("c"))).alias("t")
    return targets.filter("source is not null").groupBy("source").agg(best).select("source", F.col("t.w").alias("target_weight"), F.col("t.c").alias("max_repeats"))


def plan_rates(tokens: DataFrame, goals: DataFrame) -> DataFrame:
    """source, target_share, rate, cap, goal (tokens) of every source that can be in the mixture: weight, cap and tokens
    above 0. One row per source, in frames throughout, so the number of sources has no bound."""
    have = goals.join(tokens, "source").filter("target_weight > 0 and max_repeats > 0 and tokens > 0")
    weight, size = have.agg(F.sum("target_weight"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_weight"))).collect()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["rate"] = [rate_for(g / t, c) for g, t, c in zip(b.goal, b.tokens, b.cap)]
            yield b[["source", "target_share", "rate", "cap", "goal"]]

    goal = F.col("target_weight") * F.lit(float(size or 0.0))
    rows = have.select("source", (F.col("target_weight") / F.lit(float(weight or 1.0))).alias("target_share"), F.col("max_repeats").alias("cap"), goal.alias("goal"), "tokens")
    return rows.mapInPandas(run, "source string, target_share double, rate double, cap int, goal double")


def _fit(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, cdf: the capped distributions at the rates of the grid at which the draws made come nearest to the goal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[tuple[float, int], list[np.ndarray]] = {}
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for (s, rate, cap), g in b.groupby(["source", "rate", "cap"]):
                if (rate, cap) not in tables:
                    tables[rate, cap] = [np.array(capped_cdf(rate * x, cap)) for x in GRID]
                u, n = g.u.to_numpy(), g.n_tokens.to_numpy()
                sums[s] = sums.get(s, 0) + np.array([(np.searchsorted(t, u, side="left") * n).sum() for t in tables[rate, cap]])
        yield pd.DataFrame([(s, i, int(v)) for s, a in sums.items() for i, v in enumerate(a)], columns=["source", "i", "tokens"])

    def cdfs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["cdf"] = [capped_cdf(r * float(GRID[int(i)]) if i >= 0 else r, c) for r, c, i in zip(b.rate, b.cap, b.i)]
            yield b[["source", "cdf"]]

    drawn = sizes.select("source", "u", "n_tokens").join(broadcast_if_small(plan.select("source", "rate", "cap")), "source")
    made = drawn.mapInPandas(run, "source string, i int, tokens bigint").groupBy("source", "i").agg(F.sum("tokens").alias("tokens"))
    best = made.join(plan.select("source", "goal"), "source").groupBy("source").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("goal")).alias("d"), "i")).alias("m"))
    fitted = plan.join(best.select("source", F.col("m.i").alias("i")), "source", "left").select("source", "rate", "cap", F.coalesce("i", F.lit(-1)).alias("i"))
    return fitted.mapInPandas(cdfs, "source string, cdf array<double>")


def _planned(docs: DataFrame, targets: DataFrame, path: str, seed: object) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sizes and draws of the documents of target sources (kept: doc_id, source, n_tokens, u, no texts), goals, plan and
    the fitted distributions."""
    goals = _goals(targets)
    mine = docs.select("doc_id", "source", "text").join(broadcast_if_small(goals.select("source")), "source", "left_semi")
    sizes = cut(count_tokens(mine, ["doc_id", "source"], "text", path).withColumn("u", uniform(seed, "doc_id")))
    plan = cut(plan_rates(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), goals))
    return sizes, goals, plan, cut(_fit(sizes, plan))


def _copies() -> F.Column:
    """How often a document is used: the places of the distribution that its draw exceeds."""
    return F.coalesce(F.size(F.filter("cdf", lambda c: c < F.col("u"))), F.lit(0))


def mixture(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: object = "mix") -> DataFrame:
    """The mixture in global shuffle order: shuffle_key, doc_id, source, copy, n_tokens, text. The draws depend on the key
    alone, so documents are drawn in a narrow pass and only drawn texts are shuffled, once; their tokens are counted
    behind the shuffle."""
    _, _, _, cdf = _planned(docs, targets, path, seed)
    drawn = docs.select("doc_id", "source", "text", uniform(seed, "doc_id").alias("u")).join(broadcast_if_small(cdf), "source").withColumn("copies", _copies()).filter("copies > 0")
    rows = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "text")
    out = rows.select(md5_of(seed, "doc_id", "copy").alias("shuffle_key"), "*").orderBy("shuffle_key", "doc_id", "copy")
    return count_tokens(out, ["shuffle_key", "doc_id", "source", "copy", "text"], "text", path).select("shuffle_key", "doc_id", "source", "copy", "n_tokens", "text")


def shares(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: object = "mix") -> DataFrame:
    """Target and actual share of every target source, and how its documents were used."""
    sizes, goals, plan, cdf = _planned(docs, targets, path, seed)
    use = sizes.join(broadcast_if_small(cdf), "source", "left").withColumn("copies", F.greatest(_copies(), F.lit(0)))
    used = cut(use.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum((F.col("copies") > 0).cast("bigint")).alias("docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")))
    total = used.agg(F.sum("tokens").alias("n")).collect()[0]["n"] or 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    out = goals.join(plan.select("source", "target_share"), "source", "left").join(used, "source", "left")
    return out.select("source", "target_weight", "max_repeats", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("docs"), zero("docs_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), zero("tokens"), F.coalesce(F.col("tokens") / F.lit(max(total, 1)), F.lit(0.0)).alias("actual_share"))

"""Problem 9: mixing sources to target weights along a time-varying curriculum.

Each source of a mix has a weight schedule w(t) over the training run t in
[0, 1]: it may be stated at any times and is linear between them. Schedules are
fitted so that at every t the weights of a mix add up to 1, and each source's
integral over the run is its target share. The integral up to t is the source's
cumulative token demand; inverting it at a document's place in its source gives
the document a training position, which so is the share of the run that is done.
A range sort by position is the mixed corpus.

Size of a mix: without a stated size the largest total at which no source with
text has to be repeated more than ``max_repeats`` times, so the shares of those
sources are met up to half a document each. With a stated size that is larger,
sources at their cap give all they have and the others make up for them. A source
without text cannot contribute; the other shares are scaled to add up to 1, and
the report shows the gap.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftlight.llm.bpe import VOCABULARY_DIR, token_counts
from weftlight.llm.common import unique_by
from weftlight.plans.lineage import written

#: Hash buckets into which each source is cut for its running token count.
BUCKETS = 1024
#: Rounds of fitting schedules to weights that add up to 1 and to shares.
FIT_ROUNDS = 2000
PLAN = "mix_name string, source string, target_share double, max_repeats int, tokens_there long, docs_there long, mix_tokens long, wanted_tokens double, times array<double>, weights array<double>, demand array<double>"


def fitted_schedules(stated: np.ndarray, times: np.ndarray, shares: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights (sources x times) near the stated ones that add up to 1 at every time and integrate to the shares.

    Proportional fitting, in turn by time and by source; where no such weights
    exist (a source is stated at too few times) the sums over time hold, the integrals as near as may be.
    """
    width = np.zeros(len(times))  # what a weight at each time adds to the integral of straight lines
    width[:-1] += np.diff(times) / 2
    width[1:] += np.diff(times) / 2
    w = np.where(shares[:, None] > 0, np.maximum(stated, 0), 0.0)
    w[(shares > 0) & ~w.any(axis=1)] = 1.0
    for _ in range(rounds):
        total = w.sum(axis=0)
        w = np.where(total > 0, w / np.where(total > 0, total, 1), shares[:, None])
        reached = w @ width
        w *= np.where(reached > 0, shares / np.where(reached > 0, reached, 1), 0)[:, None]
        if np.abs(w.sum(axis=0) - 1).max() < 1e-12:
            break
    return w / np.maximum(w.sum(axis=0), 1e-300)


def default_tilt(mix: str, source: str) -> float:
    """Between -1 and 1, from the names: some sources come more at the start and others more at the end."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{mix}\x00{source}") % 2001 / 1000 - 1


def wanted_tokens(shares: np.ndarray, room: np.ndarray, total: float | None) -> np.ndarray:
    """Tokens of each source: shares of the largest total that needs no more than the room, or of a stated total as far as there is room."""
    usable = (shares > 0) & (room > 0)
    if not usable.any():
        return np.zeros(len(shares))
    part = np.where(usable, shares, 0) / shares[usable].sum()
    most = float(math.floor((room[usable] / part[usable]).min()))
    if total is None or total <= most:
        return part * (most if total is None else max(total, 0.0))
    wanted = np.zeros(len(shares))
    open_ = usable.copy()
    left = min(float(total), float(room[usable].sum()))
    while open_.any():
        ask = np.where(open_, part, 0) / part[open_].sum() * left
        full = open_ & (ask >= room)
        if not full.any():
            return wanted + ask
        wanted[full] = room[full]
        left -= float(room[full].sum())
        open_ &= ~full
    return wanted


def source_plan(
    counted: DataFrame, targets: DataFrame, *, schedules: DataFrame | None = None, spread: float = 0.6, total_tokens: int | dict[str, int] | None = None,
) -> DataFrame:
    """One row per mix and source: share, tokens there, tokens wanted, and its fitted schedule with the demand at its times.

    Weights of a mix are scaled to add up to 1. Null, negative or NaN weights
    count as 0; null or negative repeats as 0; the same (mix, source) given
    twice adds up its weights and takes the larger cap. ``targets`` has a fixed
    size, as ``schedules`` (mix_name, source, t, weight) has; both are read by the driver.
    """
    spark = targets.sparkSession
    weight = F.when(F.isnan("target_share") | (F.col("target_share") < 0), 0.0).otherwise(F.coalesce("target_share", F.lit(0.0)))
    wanted = (
        targets.filter("mix_name is not null and source is not null")
        .select("mix_name", "source", weight.alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
        .groupBy("mix_name", "source").agg(F.sum("w").alias("w"), F.max("max_repeats").alias("max_repeats"))
    )
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens_there"), F.count("*").alias("docs_there"))
    rows = wanted.join(sizes, "source", "left").fillna(0, ["tokens_there", "docs_there"]).orderBy("mix_name", "source").collect()
    stated: dict[tuple[str, str], dict[float, float]] = {}
    if schedules is not None:
        for r in schedules.filter("mix_name is not null and source is not null and t between 0 and 1 and weight >= 0 and not isnan(weight)").orderBy("t", "weight").collect():
            stated.setdefault((r["mix_name"], r["source"]), {})[r["t"]] = r["weight"]
    out = []
    for mix in sorted({r["mix_name"] for r in rows}):
        own = [r for r in rows if r["mix_name"] == mix]
        w = np.array([r["w"] for r in own])
        target = w / w.sum() if w.sum() > 0 else w
        room = np.array([r["tokens_there"] * r["max_repeats"] for r in own], float)
        asked = total_tokens.get(mix) if isinstance(total_tokens, dict) else total_tokens
        tokens = wanted_tokens(target, room, asked)
        size = tokens.sum()
        shares = tokens / size if size > 0 else tokens
        times = np.array(sorted({0.0, 1.0, *(t for r in own for t in stated.get((mix, r["source"]), ()))}))
        lines = []
        for r in own:
            known = stated.get((mix, r["source"]))
            if known:
                lines.append(np.interp(times, sorted(known), [known[t] for t in sorted(known)]))
            else:
                lines.append(1 + spread * default_tilt(mix, r["source"]) * (1 - 2 * times))
        fitted = fitted_schedules(np.array(lines), times, shares) if size > 0 else np.zeros((len(own), len(times)))
        for k, r in enumerate(own):
            steps = (fitted[k, 1:] + fitted[k, :-1]) / 2 * np.diff(times)
            out.append((mix, r["source"], float(target[k]), r["max_repeats"], r["tokens_there"], r["docs_there"], int(round(size)), float(tokens[k]),
                        times.tolist(), fitted[k].tolist(), [0.0, *np.cumsum(steps).tolist()]))
    return spark.createDataFrame(out, PLAN)


def running_tokens(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each document with the number of its source's tokens before it, in hash order.

    Two levels, so that a source with a third of all rows is not one task: a
    window inside each (source, bucket), then the sums of the buckets, of which
    there are at most sources x buckets, whatever the number of documents.
    """
    placed = counted.withColumn("_h", F.xxhash64("doc_id", "source")).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_s"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(sums, ["source", "_b"])
        .select("doc_id", "source", "n_tokens", (F.col("_before") + F.col("_in")).alias("tokens_before"))
    )


def inverse_demand(fraction: Column, times: Column, weights: Column, demand: Column) -> Column:
    """t at which a source has had ``fraction`` of its tokens.

    ``demand`` is the integral of the weights up to each of the times. Between two
    times the weight is linear and the integral is quadratic; it is solved there.
    """
    asked = fraction * F.element_at(demand, -1)
    # the last step that begins at or before what is asked
    k = F.greatest(F.least(F.size(F.filter(demand, lambda d: d <= asked)), F.size(demand) - 1), F.lit(1))
    start, width = F.get(times, k - 1), F.get(times, k) - F.get(times, k - 1)
    first, slope = F.get(weights, k - 1), (F.get(weights, k) - F.get(weights, k - 1)) / width
    rest = F.greatest(asked - F.get(demand, k - 1), F.lit(0.0))
    root = F.sqrt(F.greatest(first * first + 2.0 * slope * rest, F.lit(0.0)))
    return F.least(start + F.when(first + root > 0, F.least(2.0 * rest / (first + root), width)).otherwise(0.0), F.lit(1.0))


def mixed_sequence(
    documents: DataFrame, targets: DataFrame, *, vocabulary: str = "byte_bpe_50k", directory: str = VOCABULARY_DIR,
    schedules: DataFrame | None = None, spread: float = 0.6, total_tokens: int | dict[str, int] | None = None, counted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sequence, plan).

    ``sequence``: (mix_name, position, doc_id, source, pass_no, n_tokens), one
    row for each use of a document, range-sorted by (mix_name, position).
    ``schedules``: (mix_name, source, t, weight) states weights along the run;
    sources without one tilt by at most ``spread``, by their names.
    ``total_tokens``: the size of all mixes or of each by its name.

    Rows with a null ``doc_id`` or source cannot belong to a mix and take no
    part; texts without a token add nothing; of rows with one id the one with the
    largest fields counts.
    """
    if counted is None:
        names = targets.select("source").distinct()
        chosen = unique_by(documents.select("doc_id", "source", "text"), "doc_id").filter("source is not null").join(F.broadcast(names), "source", "left_semi")
        counted = written(token_counts(chosen, ["doc_id", "source"], vocabulary=vocabulary, directory=directory).filter("n_tokens > 0"), "mix-tokens")
    plan = source_plan(counted, targets, schedules=schedules, spread=spread, total_tokens=total_tokens)
    # a fixed table: as many rows as there are targets
    fixed = plan.filter("wanted_tokens > 0")
    offered = running_tokens(counted).join(F.broadcast(fixed), "source")
    uses = (
        offered.withColumn("_last", F.floor((F.col("wanted_tokens") - F.col("tokens_before") - F.col("n_tokens") / 2.0) / F.col("tokens_there")))
        .filter("_last >= 0")
        # pass p of a document begins at p * tokens_there + tokens_before; it is used while most of it is within the demand
        .withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.least(F.col("_last"), F.col("max_repeats") - 1).cast("int"))))
        .withColumn("_at", F.col("pass_no") * F.col("tokens_there") + F.col("tokens_before") + F.col("n_tokens") / 2.0)
        .withColumn("position", inverse_demand(F.least(F.col("_at") / F.col("wanted_tokens"), F.lit(1.0)), F.col("times"), F.col("weights"), F.col("demand")))
    )
    sequence = uses.select("mix_name", F.round("position", 9).alias("position"), "doc_id", "source", (F.col("pass_no") + 1).cast("int").alias("pass_no"), "n_tokens")
    return sequence.repartitionByRange("mix_name", "position", "doc_id").sortWithinPartitions("mix_name", "position", "doc_id", "pass_no"), plan


def shares_reached(sequence: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target share, share reached, repeats used, and the gap."""
    by_mix = Window.partitionBy("mix_name")
    used = sequence.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens_used"), F.max("pass_no").alias("repeats_used"))
    # both sides have at most one row per target
    return (
        plan.join(used, ["mix_name", "source"], "left").fillna(0, ["tokens_used", "repeats_used"])
        .withColumn("actual_share", F.when(F.sum("tokens_used").over(by_mix) > 0, F.col("tokens_used") / F.sum("tokens_used").over(by_mix)).otherwise(0.0))
        .select("mix_name", "source", F.round("target_share", 6).alias("target_share"), F.round("actual_share", 6).alias("actual_share"),
                F.round(F.col("actual_share") - F.col("target_share"), 6).alias("gap"), "tokens_there", "tokens_used", "repeats_used", "max_repeats")
    )

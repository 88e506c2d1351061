"""Mixing sources to target weights.

Every text has a soft membership in the target domains: the posterior of a classifier trained on a
bounded sample of labelled texts, given its words and, where it is listed, the source it is labelled
with. A rate is fitted for every document by projected-gradient least squares, so that the expected
tokens of each domain meet its target: a step moves all rates by their memberships against what the
domains still lack and back into 0 .. cap. Each step sums over the table in Spark and brings one
number a domain to the driver; a rate is the fold of these steps, so nothing else is kept. Rates then
become whole numbers of uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.tokens import VOCABULARY, token_count
from lexmill.plans.stage import stage

FEATURES = 1 << 15
SAMPLE = 400  # labelled texts of one source that the classifier is trained on, a fifth of them to calibrate it
MISLABELLED = 0.02  # share of texts that a listed source may hold by mistake
GRAIN = 64  # memberships are multiples of 1 / GRAIN, so that alike texts can be summed before the fit
BUCKETS = 1024  # slices of a source in the running sum
_WORD = re.compile(r"\w+")


def plain_source(source: str | Column) -> Column:
    return F.lower(F.btrim(source, F.lit(" \t\r\n")))


class _Places(dict):
    """The feature of each word, worked out once in a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word) % FEATURES
        return value


_PLACES = _Places()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word counts of a whole text, damped by a logarithm."""
    words, n = np.unique(np.fromiter(map(_PLACES.__getitem__, _WORD.findall(text.lower())), np.int64), return_counts=True)
    return words, np.log1p(n)


class DomainClassifier:
    """Softmax over naive-Bayes weights of hashed words.

    The evidence of a text of n damped words counts as ``scale`` * n ** ``power`` words of its mean, since
    the words of a text do not speak independently; both are chosen on held-out labelled texts, by
    their likelihood, so that posteriors are as sure as they are right at every length."""

    SCALES, POWERS = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0), (0.25, 0.5, 0.75, 1.0)

    def __init__(self, texts: list[str], labels: list[int], domains: int, smoothing: float = 0.2):
        self.domains, self.smoothing, self.scale, self.power, self.accuracy = domains, smoothing, 1.0, 0.5, None
        kept = [(features(t), y) for t, y in zip(texts, labels)]
        held = [x for i, x in enumerate(kept) if i % 5 == 0] if len(kept) >= 50 else []
        self._count([x for i, x in enumerate(kept) if i % 5] if held else kept)
        if held:
            mean = [self._mean(f) for f, _ in held]
            sizes = np.array([f[1].sum() for f, _ in held])
            truth = np.array([y for _, y in held])
            best = None
            for scale in self.SCALES:
                for power in self.POWERS:
                    z = self.prior + np.array(mean) * (scale * sizes**power)[:, None]
                    z = np.where(self.seen, z, -1e9)
                    z = z - z.max(axis=1, keepdims=True)
                    loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))
                    if best is None or loss < best[0]:
                        best = (loss, scale, power, float(np.mean(z.argmax(axis=1) == truth)))
            _, self.scale, self.power, self.accuracy = best
            self._count(kept)

    def _count(self, rows: list) -> None:
        counts = np.zeros((self.domains, FEATURES))
        labels = [y for _, y in rows]
        self.seen = np.bincount(labels, minlength=self.domains) > 0
        for (words, n), label in rows:
            counts[label, words] += n / max(1.0, n.sum())
        share = counts + self.smoothing / FEATURES * np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.weights = np.log(share / share.sum(axis=1, keepdims=True))
        self.prior = np.log(np.maximum(np.bincount(labels, minlength=self.domains), 0.5) / max(1, len(labels)))

    def _mean(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        words, n = found
        return self.weights[:, words] @ n / n.sum() if len(words) else np.zeros(self.domains)

    def posterior(self, text: str, label: int | None = None) -> np.ndarray:
        """Shares of the domains, given the words and the label if there is one."""
        found = features(text)
        z = self.prior + self._mean(found) * (self.scale * float(found[1].sum()) ** self.power)
        z = np.where(self.seen, z, -np.inf) if self.seen.any() else z
        if label is not None:
            told = np.full(self.domains, np.log(MISLABELLED / max(1, self.domains - 1)))
            told[label] = np.log(1 - MISLABELLED)
            z = z - self.prior + told if self.seen.any() else told
        z = np.exp(z - z.max())
        return z / z.sum()


def in_grains(shares: np.ndarray) -> np.ndarray:
    """Shares as multiples of 1 / GRAIN that sum to 1: rounded down, the largest remainders up."""
    whole = np.floor(shares * GRAIN)
    short = int(round(GRAIN - whole.sum()))
    whole[np.argsort(whole - shares * GRAIN, kind="stable")[:short]] += 1
    return whole / GRAIN


def train(labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> DomainClassifier:
    """Fit on at most ``sample`` texts of each domain, those of the least text hash.

    Only this bounded sample reaches the driver."""
    pick = Window.partitionBy("domain").orderBy("h", "doc_id")
    rows = labelled.withColumn("rn", F.row_number().over(pick)).where(F.col("rn") <= sample).select("h", "domain", "text").collect()
    place = {d: i for i, d in enumerate(domains)}
    rows = sorted(rows)
    return DomainClassifier([r["text"] for r in rows], [place[r["domain"]] for r in rows], len(domains))


def memberships(documents: DataFrame, targets: list[str], vocabulary: str, sample: int) -> DataFrame:
    """doc_id, source, h1, h2, tokens, member - one row per distinct text; member sums to 1 or is all 0.

    Equal texts are one: it has the listed source of its smallest id. Every text is soft: one of a listed
    source has the posterior given its words and its source, one without source that of its words. A text
    of an unlisted source is asked for by no target and belongs to no domain."""
    rows = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", plain_source("source").alias("source"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), "text").alias("h2"))
    named = F.col("source").isNotNull() & (F.col("source") != "")
    listed = F.coalesce(F.col("source").isin(targets), F.lit(False))
    labelled = rows.where(listed).select("doc_id", F.col("source").alias("domain"), "text", F.col("h1").alias("h"))
    model = documents.sparkSession.sparkContext.broadcast(train(labelled, targets, sample))
    place = {t: i for i, t in enumerate(targets)}

    @F.pandas_udf("array<double>")
    def posterior(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        classifier = model.value
        for texts, sources in batches:
            yield pd.Series([None if t is None else in_grains(classifier.posterior(t, place.get(s))).tolist() for t, s in zip(texts, sources)])

    none = F.array(*[F.lit(0.0)] * len(targets))
    guess = posterior(F.when(listed | ~named, F.col("text")), F.col("source"))
    sized = rows.select("doc_id", F.when(named, F.col("source")).alias("source"), "h1", "h2", listed.alias("listed"), token_count("text", vocabulary).cast("long").alias("tokens"), F.coalesce(guess, none).alias("member"))
    first = F.min_by(F.struct("doc_id", "source", "tokens", "member"), F.struct(~F.col("listed"), F.col("source").isNull(), F.col("doc_id")))
    return sized.groupBy("h1", "h2").agg(first.alias("one")).select("h1", "h2", "one.*").select("doc_id", "source", "h1", "h2", "tokens", "member")


def fit_rates(table: DataFrame, goals: list[float], steps: int = 200, tolerance: float = 1e-4) -> list[list[float]]:
    """The steps of projected-gradient least squares over ``table`` (member, cap, tokens).

    Minimises the squares of what each domain's expected tokens, the sum of rate * tokens * member, miss
    of its goal, over rates in 0 .. cap. A step adds member . x to every rate and clips it, where x is the
    gradient of the domains, each scaled by the tokens it has. The rate of a row after all steps is
    ``rate_of``. Rows alike in member and cap have equal rates and are summed first. Converged when a
    step moves no domain by more than ``tolerance`` of the whole; not converging is an error."""
    k = len(goals)
    alike = stage(table.groupBy("member", "cap").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mixing-alike")
    mass = np.array([float(m or 0) for m in alike.agg(*[F.sum(F.col("tokens") * F.col("member")[i]) for i in range(k)]).first()])
    goal = np.array(goals, float)
    whole = max(float(goal.sum()), 1.0)
    reached, taken = np.zeros(k), []
    for _ in range(steps):
        x = np.divide(goal - reached, mass, out=np.zeros(k), where=mass > 0)
        taken.append(x.tolist())
        rate = rate_of(taken)
        now = np.array([float(v or 0) for v in alike.agg(*[F.sum(F.col("tokens") * F.col("member")[i] * rate) for i in range(k)]).first()])
        moved, reached = np.abs(now - reached).max(), now
        if moved <= tolerance * whole:
            return taken
    raise RuntimeError(f"the rates did not settle in {steps} steps")


def rate_of(steps: list[list[float]]) -> Column:
    """The rate of a row with member and cap after the steps: each adds member . x and clips to 0 .. cap."""
    if not steps:
        return F.lit(0.0)
    cap = F.col("cap").cast("double")
    moves = F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in x) + ")" for x in steps) + ")")

    def step(rate: Column, x: Column) -> Column:
        dot = sum((F.col("member")[i] * x[i] for i in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(rate + dot, cap))

    return F.aggregate(moves, F.lit(0.0), step)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, sample: int = SAMPLE, of_listed: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    ``mixture``: doc_id, source, tokens, uses - the texts used and how often; a text counts once
    however many ids carry it, and its uses never exceed the cap of its source. ``report``: source,
    target_share, max_repeats, available_tokens, reached_tokens, reached_share, texts,
    expected_tokens - every listed source and every other one in ``documents``; the last is what the
    memberships of the used texts give the domain.

    ``total_tokens`` is the wanted size, or ``of_listed`` gives it as a multiple of the tokens that
    the distinct texts of all listed sources hold; sources that cannot fill their share of it within
    their cap stay at the cap and the report says so. By default it is the greatest size at which every listed
    source that has texts reaches its share. Null texts are left out; targets without a source, a
    share or a positive share are ignored, a null cap is 1. No target: an empty mixture."""
    # A configuration of a few rows.
    goals = targets.where("source IS NOT NULL AND target_share > 0").groupBy(plain_source("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")).orderBy("source").collect()
    names, shares, caps = [g["source"] for g in goals], [g["share"] for g in goals], [max(0, g["cap"]) for g in goals]
    if not goals:
        names, shares, caps = ["\0"], [1.0], [0]
    k = len(names)
    rows = stage(memberships(documents, names, vocabulary, sample), "mixing-texts")
    # A text may be used as often as its source allows, or, without one, its likeliest domain.
    best = F.array_position("member", F.array_max("member")).cast("int")
    own = F.create_map(*[v for n, c in zip(names, caps) for v in (F.lit(n), F.lit(c))])[F.col("source")]
    cap = F.coalesce(own, F.element_at(F.array(*[F.lit(c) for c in caps]), F.greatest(best, F.lit(1))))
    table = rows.where(F.array_max("member") > 0).withColumn("cap", cap)
    # What each domain can hold, by the texts labelled with it and by the memberships of all.
    held = table.groupBy("source").agg(F.sum("tokens").alias("held"), F.sum(F.col("tokens") * F.col("cap")).alias("room")).where("source IS NOT NULL").collect()
    room = {r["source"]: float(r["room"]) for r in held}
    if total_tokens is None and of_listed is not None:
        total_tokens = of_listed * sum(r["held"] for r in held)
    if total_tokens is None:
        there = sum(s for n, s in zip(names, shares) if room.get(n, 0) > 0)
        total_tokens = min((room[n] / s * there for n, s in zip(names, shares) if room.get(n, 0) > 0), default=0)
        shares_of = [s / there if room.get(n, 0) > 0 else 0.0 for n, s in zip(names, shares)]
    else:
        shares_of = list(shares)
    # No text is bent towards a domain that its own texts cannot fill: the goal ends at what they hold.
    steps = fit_rates(table, [min(s * float(total_tokens), room.get(n, 0.0)) for n, s in zip(names, shares_of)])
    rated = table.withColumn("rate", rate_of(steps)).withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    mixture = stage(_whole_uses(rated), "mixing-uses")
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached"), F.count("*").alias("texts"))
    have = rows.groupBy("source").agg(F.sum("tokens").alias("available"))
    sums = mixture.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("uses") * F.col("member")[i]), F.lit(0.0)) for i in range(k)]).first()
    listed = documents.sparkSession.createDataFrame([(n, float(s), int(c), float(e)) for n, s, c, e in zip(names, shares, caps, sums) if n != "\0"], "source string, target_share double, max_repeats int, expected double")
    report = listed.join(have, listed["source"].eqNullSafe(have["source"]), "full").select(F.coalesce(listed["source"], have["source"]).alias("source"), "target_share", "max_repeats", "expected", "available")
    report = report.join(used.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    reached = F.coalesce("reached", F.lit(0))
    whole = F.sum(reached).over(Window.partitionBy())  # one row a source
    return mixture.drop("member"), report.select(
        "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available_tokens"), reached.alias("reached_tokens"),
        F.coalesce(F.try_divide(reached.cast("double"), whole), F.lit(0.0)).alias("reached_share"), F.coalesce("texts", F.lit(0)).alias("texts"), F.round("expected", 3).alias("expected_tokens"),
    )


def _whole_uses(rated: DataFrame) -> DataFrame:
    """Whole numbers of uses: all texts get the floor of their rate, and texts in the order of a hash over
    the fractional part one more, until they hold the tokens of all fractional parts of the source.

    So a text gets one more about as often as its part says (sequential Poisson sampling). The running
    sum over a source has two levels, slices of the order and then within a slice, so that no source
    goes through one task whole."""
    chance = (F.pmod(F.xxhash64(F.lit(29), "h1", "h2"), F.lit(1 << 30)).cast("double") + 0.5) / (1 << 30)
    rows = rated.select("doc_id", F.coalesce("source", F.lit("")).alias("g_source"), "source", "tokens", "member", "whole", "part", "cap", chance.alias("u"))
    # Those far beyond the usual end of the picks keep their places by the hash alone.
    order = F.when(F.col("u") <= 4 * F.col("part"), F.col("u") / F.col("part")).otherwise(4 + F.col("u"))
    slice_ = F.when(F.col("order") <= 4, F.col("order") * (BUCKETS // 8)).otherwise(BUCKETS // 2 + (F.col("order") - 4) * (BUCKETS // 2)).cast("int")
    rows = rows.withColumn("order", order).withColumn("slice", slice_)
    slices = rows.groupBy("g_source", "slice").agg(F.sum("tokens").alias("held"), F.sum(F.col("tokens") * F.col("part")).alias("extra"))
    whole = Window.partitionBy("g_source")
    ahead = slices.select("g_source", "slice", (F.sum("held").over(whole.orderBy("slice")) - F.col("held")).alias("before"), F.sum("extra").over(whole).alias("goal"))
    inner = Window.partitionBy("g_source", "slice").orderBy("order", "doc_id")
    rows = rows.join(ahead, ["g_source", "slice"])
    half = F.col("before") + F.sum("tokens").over(inner) - F.col("tokens") / 2
    uses = F.least(F.col("whole") + ((half <= F.col("goal")) & (F.col("part") > 0)).cast("int"), F.col("cap"))
    return rows.select("doc_id", "source", "tokens", uses.cast("int").alias("uses"), "member").where("uses > 0")

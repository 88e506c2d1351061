"""Verdicts over golden items: names, confidence, failures and re-verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUNDED, KNOWN = 0.25, 0.45  # least share of an answer's words in its sections; overlap of an answer given without them


def entity_named(question: str, entity: str, contested: Column) -> Column:
    """Whether a contested question names the class it is about: one of its words of four letters and
    more, without a plural ``s``. True where it need not, or where the class has no such word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(entity), F.lit(""))), F.lit("([a-z]{4,})"), 1)
    low = F.lower(F.coalesce(F.col(question), F.lit("")))
    named = F.exists(words, lambda w: low.contains(F.regexp_replace(w, "s+$", "")))
    return ~F.coalesce(contested, F.lit(False)) | (F.size(words) == 0) | named


def failures() -> Column:
    """Names of the checks that a row fails: drift, leaks, entity_named, answer_grounding, query_type,
    judge_answerable, known. Unknown outcomes (null) fail nothing."""
    no = lambda c: F.coalesce(c, F.lit(False))
    negative = no(F.col("query_type") == "negative")
    hundredths = F.floor(F.col("answer_grounding") * 100 + 0.5 + 1e-9).cast("string")
    found = F.array_compact(F.array(
        F.when(F.col("drift") != "resolved", F.concat(F.lit("span_"), "drift")),
        F.when(~no(F.col("entity_named")), F.lit("entity_not_named")),
        F.when(F.col("answer_grounding") < GROUNDED, F.concat(F.lit("answer_grounding_0."), F.lpad(hundredths, 2, "0"))),
        F.when(negative & no(F.col("judge_answerable")), F.lit("negative_is_answerable")),
        F.when(~negative & no(~F.col("judge_answerable")), F.lit("judge_says_not_answerable_from_span")),
        F.when(~negative & no(F.col("known")), F.lit("answerable_without_corpus")),
    ))
    return F.array_sort(F.concat(found, F.transform(_leaks(), lambda x: F.concat(F.lit("leak_"), x))))


def _leaks() -> Column:
    return F.coalesce("leaks", F.array().cast("array<string>"))


def confidence() -> Column:
    """An order for reviewers between 0 and 1: what each failed or missing check takes away."""
    no = lambda c: F.coalesce(c, F.lit(False))
    negative, answerable = no(F.col("query_type") == "negative"), F.col("judge_answerable")
    less = F.when(F.col("drift") == "missing", 0.6).when(F.col("drift") == "moved", 0.35).otherwise(0.0) + 0.15 * F.size(_leaks())
    less += F.when(no(F.col("entity_named")), 0.0).otherwise(0.2) + F.when(no(F.col("answer_grounding") < GROUNDED), 0.2).otherwise(0.0)
    less += F.when(answerable.isNull(), 0.1).when(negative & answerable, 0.6).when(~negative & ~answerable, 0.4).otherwise(0.0)
    less += F.when(~negative & no(F.col("known")), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.round(1.0 - less, 9), 3)))


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds known, failures, status and confidence; see ``failures`` for the columns read."""
    rows = rows.withColumn("known", F.col("closed_book_overlap") >= KNOWN)
    rows = rows.withColumn("failures", failures()).withColumn("confidence", confidence())
    return rows.withColumn("status", F.when(F.size("failures") > 0, "flagged").otherwise("machine_verified"))


def reverified(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """id, status, failures after a run without a judge: ``fresh`` (id, failures) added to ``prior`` (id,
    status, failures). A flag is never cleared, and no earlier failure is lost."""
    none = F.array().cast("array<string>")
    rows = prior.select("id", F.col("status").alias("before"), F.coalesce("failures", none).alias("old")).join(fresh.select("id", F.col("failures").alias("new")), "id", "left")
    new = F.coalesce("new", none)
    return rows.select("id", F.when(F.size(new) > 0, "flagged").otherwise(F.col("before")).alias("status"), F.array_sort(F.array_union("old", new)).alias("failures"))


def gate(baseline: DataFrame, now: DataFrame, up: list[str], down: list[str], banded: dict[str, float], reported: list[str]) -> DataFrame:
    """metric, baseline, now, verdict of one run against another.

    ``baseline`` and ``now``: metric, value. A metric in ``up`` may not fall and one in ``down`` not rise;
    a banded one may rise by its tolerance, as a share; a reported one never fails. A value that is
    absent or null on either side is skipped, as is a banded one whose baseline is 0."""
    names = [*up, *down, *banded, *reported]
    rule = F.create_map(*[F.lit(x) for n in up for x in (n, "up")], *[F.lit(x) for n in down for x in (n, "down")], *[F.lit(x) for n in banded for x in (n, "banded")], *[F.lit(x) for n in reported for x in (n, "reported")])
    band = F.create_map(*[F.lit(x) for n, b in banded.items() for x in (n, b)]) if banded else F.create_map().cast("map<string,double>")
    both = baseline.select("metric", F.col("value").alias("baseline")).join(now.select("metric", F.col("value").alias("now")), "metric", "full").where(F.col("metric").isin(names))
    b, n, kind = F.col("baseline"), F.col("now"), rule[F.col("metric")]
    worse = F.when(kind == "up", n < b).when(kind == "down", n > b).when(kind == "banded", n > b * (1 + band[F.col("metric")]))
    skipped = b.isNull() | n.isNull() | ((kind == "banded") & (b == 0))
    return both.select("metric", "baseline", "now", F.when(kind == "reported", "reported").when(skipped, "skipped").when(worse, "failed").otherwise("ok").alias("verdict"))


def resolved_citations(answers: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, section_uid, found, text of every citation of an answer, in order.

    ``answers``: keys, cited_uids; ``sections``: section_uid, text. A citation that leads nowhere stays,
    with a mark for its text, so that an answer with bad citations never looks like one without any."""
    cited = answers.select(*keys, F.posexplode("cited_uids").alias("place", "section_uid"))
    rows = cited.join(sections.select("section_uid", "text", F.lit(True).alias("there")), "section_uid", "left")
    found = F.coalesce("there", F.lit(False))
    return rows.select(*keys, "place", "section_uid", found.alias("found"), F.when(found, F.coalesce("text", F.lit(""))).otherwise("NOT FOUND IN THE INDEX").alias("text"))


def reference_check(answers: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kept, violations: the citations that resolve, and what is wrong with an answer's references.

    ``answers``: keys, abstained; ``resolved``: see ``resolved_citations``. An abstention is exempt, an
    answer without any citation has one violation, else every unresolved citation is one."""
    per = resolved.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("section_uid")))).alias("kept"), F.count("*").alias("n"), F.count_if(~F.col("found")).alias("bad"))
    rows = answers.select(*keys, F.coalesce("abstained", F.lit(False)).alias("abstained")).join(per, keys, "left")
    bad = F.when(F.col("abstained"), 0).when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(F.col("bad"))
    return rows.select(*keys, F.coalesce("kept", F.array().cast("array<string>")).alias("kept"), bad.cast("long").alias("violations"))

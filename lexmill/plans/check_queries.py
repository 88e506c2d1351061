"""Queries that check: items, references, runs against a baseline, judges, chunks for an index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import agentlog, checks, chunks, golden, metrics, selection
from lexmill.operators.metrics import nearest_rank
from lexmill.plans import evaluation_queries as E
from lexmill.plans import search_queries as S
from lexmill.plans.corpus_queries import _CHUNKS, _ITEMS, _JACCARD, _MAN, _SEC
from lexmill.plans.stage import shared_folder
from lexmill.sources import jsonl
from lexmill.sources.tables import live_rows, read_table

KEYS = ["arm", "task_id"]


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live items with their live check; names of classes are held against the question again."""
    items = live_rows(read_table(spark, sf_dir, "items"), ["id"], "built_at", ["question", "query_type", "entity_class", "near_duplicates_at_0_10", "status"])
    kept = live_rows(read_table(spark, sf_dir, "checks"), ["item_id"], "checked_at", ["drift", "leaks", "answer_grounding", F.col("entity_named").alias("stored_named"), "judge_answerable", "closed_book_overlap"])
    contested = (F.col("query_type") == "comparative") | (F.coalesce("near_duplicates_at_0_10", F.lit(0)) >= 1)
    entity = F.regexp_replace("entity_class", "_", " ")
    rows = items.join(kept, items["id"] == kept["item_id"]).withColumn("entity", entity)
    return rows.withColumn("entity_named", checks.entity_named("question", "entity", contested))


def item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.verdicts(_checked(spark, sf_dir))
    return rows.select("id", "entity_named", F.array_join("failures", ",").alias("failures"), "status", "confidence")


def reverify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mechanical checks run again without a judge, added to what the kept checks had found."""
    rows = _checked(spark, sf_dir)
    prior = checks.verdicts(rows.withColumn("entity_named", F.col("stored_named")).select("*"))
    prior = rows.select("id", F.col("status").alias("kept")).join(prior.select("id", "failures"), "id").select("id", F.col("kept").alias("status"), "failures")
    unasked = {"leaks": F.when(F.col("query_type") == "negative", F.array().cast("array<string>")).otherwise(T.leak_names("question")), "judge_answerable": F.lit(None).cast("boolean"), "closed_book_overlap": F.lit(None).cast("double")}
    fresh = checks.verdicts(rows.withColumns(unasked))
    return checks.reverified(fresh, prior).select("id", "status", F.array_join("failures", ",").alias("failures"))


UP = ["success", "retrieved_gold", "cited_resolvable", "abstained_correctly", "within_budget", "recall", "resolvable"]
DOWN = ["unresolvable", "false_answers", "errors"]
BANDED, REPORTED = {"p50_tokens": 0.25}, ["precision", "efficiency", "tokens", "p95_tokens"]


def agent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supervisor's run against the single agent's: which metrics regress, by their direction."""
    rows = agentlog.outcomes(E.answers(spark, sf_dir))
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("double"))
    clean = F.coalesce("error", F.lit("")) == ""
    amount = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("double"))
    per = rows.groupBy("arm").agg(
        *[flag(F.col(m)).alias(m) for m in UP[:5]], F.round(F.avg("recall"), 4).alias("recall"), (amount("asserted") - amount("unresolvable")).alias("resolvable"), amount("unresolvable").alias("unresolvable"),
        flag(F.col("must_abstain") & ~F.col("abstained") & clean).alias("false_answers"), flag(~clean).alias("errors"), nearest_rank("in_tokens", 0.5).cast("double").alias("p50_tokens"),
        F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("efficiency"), 4).alias("efficiency"), (amount("in_tokens") + amount("out_tokens")).alias("tokens"), nearest_rank("in_tokens", 0.95).cast("double").alias("p95_tokens"),
    )
    long = per.unpivot(["arm"], [*UP, *DOWN, *BANDED, *REPORTED], "metric", "value")
    base, now = (long.where(F.col("arm") == a) for a in ("single_agent", "supervisor"))
    return checks.gate(base, now, UP, DOWN, BANDED, REPORTED)


def _citations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    answers = E.answers(spark, sf_dir)
    sections = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", [F.length("text").cast("string").alias("text")])
    return answers, checks.resolved_citations(answers, sections, KEYS)


def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation in order; the length of the section it leads to, or the mark of one that leads nowhere."""
    return _citations(spark, sf_dir)[1]


def reference_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.reference_check(*_citations(spark, sf_dir), KEYS)
    return rows.select(*KEYS, F.array_join("kept", " ").alias("kept"), "violations")


def abstention_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept abstentions against the rule: a phrase that declines, or no citation asserted."""
    rows = E.answers(spark, sf_dir, "answer").withColumn("rule", agentlog.says_no("answer") | (F.coalesce("asserted", F.lit(0)) == 0))
    return rows.groupBy("arm", "abstained", "rule").agg(F.count("*").alias("n"))


def documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the citations of an answer lead to, in the order first cited."""
    docs = F.array_distinct(F.transform(F.coalesce("cited_uids", F.array().cast("array<string>")), lambda u: F.substring_index(u, ":", 1)))
    return E.answers(spark, sf_dir).select(*KEYS, F.size(docs).alias("documents"), F.array_join(docs, " ").alias("doc_ids"))


def judged_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that can be judged, with the verdict on their item: pairs without a verdict are left out whole."""
    rows = agentlog.outcomes(E.answers(spark, sf_dir, "golden_id")).where("NOT must_abstain AND NOT abstained AND coalesce(error, '') = ''")
    kept = live_rows(read_table(spark, sf_dir, "checks"), ["item_id"], "checked_at", ["judge_answerable"]).where("judge_answerable IS NOT NULL")
    both = rows.join(kept, rows["golden_id"] == kept["item_id"])
    return both.groupBy("arm").agg(F.count("*").alias("judged"), F.count_if("judge_answerable").alias("answerable"), F.count_if("success").alias("passed"), F.count_if(F.col("success") & F.col("judge_answerable")).alias("both"))


def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on items by query type; those not judged are counted apart and in no rate."""
    rows = _checked(spark, sf_dir)
    n = F.count("judge_answerable")
    return rows.groupBy("query_type").agg(n.alias("n"), F.count_if(F.col("judge_answerable").isNull()).alias("unjudged"), F.round(F.try_divide(F.count_if("judge_answerable"), n), 4).alias("rate"), F.round(F.try_divide(F.count_if(F.col("judge_answerable") & F.col("stored_named") & (F.col("drift") == "resolved")), n), 4).alias("all_three"))


def useful_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groundedness of answers given, and its product with the share of items answered; the arm that is
    best by each, so that a high rate over few answers does not pass for usefulness."""
    rows = agentlog.outcomes(E.answers(spark, sf_dir)).where("NOT must_abstain")
    given = F.count_if(~F.col("abstained"))
    per = rows.groupBy("arm").agg(F.count("*").alias("items"), given.alias("answers"), F.round(F.try_divide(F.count_if(~F.col("abstained") & F.col("retrieved_gold")), given), 4).alias("grounded"))
    useful = F.round(F.coalesce("grounded", F.lit(0.0)) * F.col("answers") / F.greatest(F.col("items"), F.lit(1)), 4)
    whole = Window.partitionBy()  # one row an arm
    per = per.withColumn("useful", useful)
    best = lambda c, order: F.first("arm").over(whole.orderBy(order, F.col("arm")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == F.col("arm")
    return per.select("*", best("grounded", F.col("grounded").desc_nulls_last()).alias("most_grounded"), best("answers", F.col("answers").asc()).alias("fewest_answers"), best("useful", F.col("useful").desc()).alias("most_useful"))


def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each arm: how many cite only what exists, stop early or fail, and their mean tokens."""
    rows = E.answers(spark, sf_dir)
    whole = F.coalesce("unresolvable", F.lit(0)) == 0
    return rows.groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.avg((whole & (F.coalesce("asserted", F.lit(0)) > 0)).cast("double")), 4).alias("citation_valid"), F.count_if(F.col("stopped_by") == "token_budget").alias("truncated"),
        F.count_if(F.col("error") != "").alias("errors"), F.round(F.avg("in_tokens"), 2).alias("mean_in"), F.round(F.avg("out_tokens"), 2).alias("mean_out"),
    )


def verdict_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a configuration helps by MRR, over all items and over those without a flag."""
    rows = S._metrics(spark, sf_dir).where("n_gold > 0")
    flags = live_rows(read_table(spark, sf_dir, "items"), ["id"], "built_at", ["status"]).select(F.col("id").alias("query_id"), (F.coalesce("status", F.lit("")) == "flagged").alias("flagged"))
    rows = rows.join(flags, "query_id")
    parts = [(F.lit("all"), F.lit(True)), (F.lit("unflagged"), ~F.col("flagged"))]
    rows = rows.select("config", "query_type", "mrr", F.explode(F.array_compact(F.array(*[F.when(w, n) for n, w in parts]))).alias("part"))
    per = rows.groupBy("part", "query_type").agg(*[F.count_if(F.col("config") == c).alias(f"{c}_n") for c in ("fused",)], *[F.round(F.avg(F.when(F.col("config") == c, F.col("mrr"))), 4).alias(c) for c in ("terms", "bigrams", "fused")])
    long = per.select("part", "query_type", F.col("fused_n").alias("n"), "terms", F.explode(F.create_map(F.lit("bigrams"), "bigrams", F.lit("fused"), "fused")).alias("config", "mrr"))
    delta = F.round(F.col("mrr") - F.col("terms"), 4)
    said = long.select("part", "query_type", "config", F.when(F.abs(delta) <= 1 / F.col("n"), "flat").when(delta > 0, "helps").otherwise("hurts").alias("verdict"))
    whole, clean = (said.where(F.col("part") == p).select("query_type", "config", F.col("verdict").alias(n)) for p, n in (("all", "over_all"), ("unflagged", "over_unflagged")))
    return whole.join(clean, ["query_type", "config"], "left").select("query_type", "config", "over_all", "over_unflagged", (F.col("over_all") != F.col("over_unflagged")).alias("flips"))


def displacement_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How first gold ranks move from single terms to the fused list: tallies, mean and median shift."""
    return S.displacement(spark, sf_dir).groupBy("move").agg(F.count("*").alias("n"), F.round(F.avg("shift"), 4).alias("mean_shift"), F.percentile("shift", 0.5).alias("median_shift"))


def embedding_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of both arms after the sentence of a section has gone to all of its chunks: a digest each."""
    live = live_rows(read_table(spark, sf_dir, "chunks"), ["chunk_id"], "made_at", ["section_uid", "text", "context_text"])
    context = live.select("section_uid", F.col("context_text").alias("context"))
    rows = chunks.embedding_inputs(chunks.with_context(live, context))
    return rows.select("chunk_id", "arm", F.sha2("input", 256).alias("sha"))


def replaced_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of both arms after the one with contexts arrived again in capitals: rows and characters."""
    live = live_rows(read_table(spark, sf_dir, "chunks"), ["chunk_id"], "made_at", ["text", "context_text"])
    stored = chunks.embedding_inputs(live)
    fresh = stored.where("arm = '+ctx'").withColumn("input", F.concat(F.lit("new "), "input"))
    return chunks.replace_arms(stored, fresh).groupBy("arm").agg(F.count("*").alias("n"), F.sum(F.length("input")).alias("chars"))


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "text"])
    return chunks.pack_sections(rows).select("section_uid", "ordinal", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each section: the document's title, its path and heading, and how many chunks it has."""
    sections = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "section_path", "heading"])
    titles = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["title"])
    parts = live_rows(read_table(spark, sf_dir, "chunks"), ["chunk_id"], "made_at", ["section_uid"]).groupBy("section_uid").agg(F.count("*").alias("n"))
    rows = sections.join(titles, "doc_id").join(parts, "section_uid")
    return rows.select("section_uid", F.concat("title", F.lit(" | "), "section_path", F.when(F.col("heading").isNotNull(), F.concat(F.lit(" "), "heading")).otherwise(""), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))


def section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by the dotted path above theirs: how many hang there, the first of them, and the section of
    that path itself, null where the document has none."""
    live = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "section_path"])
    child = live.where(F.col("section_path").contains(".")).select("doc_id", F.regexp_replace("section_path", r"\.[^.]*$", "").alias("above"), "section_uid")
    per = child.groupBy("doc_id", "above").agg(F.count("*").alias("children"), F.min("section_uid").alias("first"))
    there = live.select("doc_id", F.col("section_path").alias("above"), F.col("section_uid").alias("parent_uid"))
    return per.join(there, ["doc_id", "above"], "left")


def scope_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", [T.scope_label("heading").alias("scope")])


def clean_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections without runs of empty lines; those of fewer than forty characters are left out."""
    live = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", [F.trim(F.regexp_replace("text", r"\n{3,}", "\n\n")).alias("text")])
    return live.where("length(text) >= 40").select("section_uid", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


def entity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that a title binds, where the documents' titles are said of their issuers and kinds."""
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["title", "doc_type", "issuer"])
    title = F.concat("title", F.lit(" – "), F.initcap("doc_type"), F.lit(" of the "), "issuer")
    return rows.select("doc_id", T.entity_class(title).alias("entity"))


def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.items(spark, sf_dir).select("id", F.array_join(T.topic_terms("question"), " ").alias("terms"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the names and contents of each issuer's documents, in the order of names."""
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["issuer", "sha256"])
    return rows.groupBy("issuer").agg(T.registry_hash("doc_id", "sha256").alias("hash"))


def manifest_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest written as JSON lines and read back: rows, lines that are none and repeated ids."""
    rows = read_table(spark, sf_dir, "manifest").select("doc_id", "url", "source_page", "issuer", "doc_type", "title", "filename", "sha256", F.col("n_bytes").alias("bytes"), F.col("fetched_at").cast("string").alias("fetched_at"))
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    jsonl.write_json_lines(rows, path, ["doc_id", "fetched_at"])
    back, broken = jsonl.read_json_lines(spark, path, jsonl.MANIFEST)
    counts = back.groupBy("issuer").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.sum("bytes").alias("bytes"))
    return counts.unionByName(broken.agg(F.count("*").alias("rows")).where("rows > 0").select(F.lit("broken").alias("issuer"), "rows", F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("bytes")))


def _twins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The number in each title, and the least other document of another kind with the same number."""
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["title", "doc_type"]).withColumn("code", T.notice_code("title")).where("code IS NOT NULL")
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, (F.col("x.code") == F.col("y.code")) & (F.col("x.doc_type") != F.col("y.doc_type")))
    return rows, both.groupBy(F.col("x.doc_id").alias("doc_id"), F.col("x.code").alias("code")).agg(F.min("y.doc_id").alias("parent_id"))


def title_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twins(spark, sf_dir)[1]


def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of other documents that a text refers to: by a number in a title, or as those of its twin."""
    rows, twins = _twins(spark, sf_dir)
    codes = rows.groupBy("code").agg(F.min("doc_id").alias("doc_id"))
    live = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "section_path", "text"])
    return golden.cross_references(live, codes, twins, r"(?i)paragraphs?\s+(\d{1,2}(?:\.\d{1,3}){0,3})")


def temporal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", [golden.time_kind("text").alias("kind")])
    return live.groupBy("kind").agg(F.count("*").alias("n"), F.min("section_uid").alias("first"))


def comparable_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    issuers = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", [F.col("issuer").alias("entity")])
    live = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "section_path", "text"])
    return golden.aligned_paths(live.join(issuers, "doc_id"), widest=0.94)


def factual_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten candidates of each band in turn, and further ones where a band has fewer."""
    rows = read_table(spark, sf_dir, "candidates").where("candidate_id IS NOT NULL AND query_type IS NOT NULL AND band IS NOT NULL")
    picked = selection.interleaved(rows, "band", "query_type", "candidate_id", 10)
    return golden.with_top_up(rows, picked, "candidate_id", 45, selection.seeded("candidate_id"))


def scaled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task set scaled to ten items: at least one of each kind."""
    rows = live_rows(read_table(spark, sf_dir, "items"), ["id"], "built_at", ["query_type", "status"])
    return golden.task_quota(rows.where("status = 'machine_verified'"), golden.scaled_quota(golden.TASK_QUOTA, 10)).select("id", "query_type", "place")


def gold_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search limited to notices and guidelines in force from 2023 on would lose gold documents."""
    gold = S.items(spark, sf_dir).select("id", "query_type", F.explode("gold_spans").alias("g")).select("id", "query_type", "g.doc_id").distinct()
    docs = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["doc_type", "effective_date"])
    kept = F.coalesce(F.col("doc_type").isin("notices", "guidelines") & (F.col("effective_date") >= F.lit("2023-01-01").cast("date")), F.lit(False))
    per = gold.join(docs.select("doc_id", kept.alias("kept")), "doc_id", "left").groupBy("id", "query_type").agg(F.count("*").alias("gold"), F.count_if(F.coalesce("kept", F.lit(False))).alias("kept"))
    return per.groupBy("query_type").agg(F.count("*").alias("items"), F.count_if(F.col("kept") == 0).alias("all_lost"), F.count_if((F.col("kept") > 0) & (F.col("kept") < F.col("gold"))).alias("some_lost"))


def salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events found again in chatter around them, and their sums by kind."""
    rows = read_table(spark, sf_dir, "events").select("event_type", "props", F.concat(F.lit("Sure {here it is}:\n```json\n"), "props", F.lit("\n``` {done}")).alias("said"))
    found = rows.withColumn("found", jsonl.first_object("said"))
    value = F.get_json_object("found", "$.k").cast("double")
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.count("found").alias("found"), F.sum(value).cast("long").alias("k"))


QUERIES = [item_status, reverify, agent_gate, citation_markers, reference_violations, abstention_rule, documents_read, judged_agreement, judge_summary, useful_answers, generation_summary, verdict_flips, displacement_tally, embedding_arms, replaced_arm, packed_chunks, outline, section_edges, scope_labels, clean_sections, entity_classes, topic_terms, content_hashes, manifest_jsonl, title_twins, cross_references, temporal_kinds, comparable_clauses, factual_selection, scaled_tasks, gold_exclusion, salvaged_json]

# ---- the same in SQL ----------------------------------------------------------------------------

_STOP = repr(list(T.TOPIC_STOP))
_CK = f"ck AS (SELECT * FROM {S.live_sql('checks', 'item_id', 'checked_at')})"
_LEAKS = "CASE WHEN query_type = 'negative' THEN [] ELSE list_filter([" + ", ".join(f"CASE WHEN regexp_matches(question, '{p}') THEN '{n}' END" for n, p in T.LEAK_PATTERNS.items()) + "], lambda x: x IS NOT NULL) END"
_CHECKED = f"""{_ITEMS}, {_CK}, e AS (SELECT *, regexp_extract_all(lower(replace(coalesce(entity_class, ''), '_', ' ')), '[a-z]{{4,}}') AS words FROM it JOIN ck ON item_id = it.id),
c AS (SELECT * EXCLUDE (entity_named), entity_named AS stored_named, NOT (query_type = 'comparative' OR coalesce(near_duplicates_at_0_10, 0) >= 1) OR len(words) = 0 OR len(list_filter(words, lambda w: contains(lower(question), regexp_replace(w, 's+$', '')))) > 0 AS entity_named FROM e)"""


def _verdict_sql(name: str, source: str) -> str:
    neg = "coalesce(query_type = 'negative', false)"
    return f"""{name} AS (SELECT *, list_sort(list_concat(list_filter([CASE WHEN drift <> 'resolved' THEN 'span_' || drift END, CASE WHEN NOT coalesce(entity_named, false) THEN 'entity_not_named' END,
  CASE WHEN answer_grounding < 0.25 THEN 'answer_grounding_0.' || lpad(floor(answer_grounding * 100 + 0.5 + 1e-9)::INT::VARCHAR, 2, '0') END, CASE WHEN {neg} AND coalesce(judge_answerable, false) THEN 'negative_is_answerable' END,
  CASE WHEN NOT {neg} AND NOT coalesce(judge_answerable, true) THEN 'judge_says_not_answerable_from_span' END, CASE WHEN NOT {neg} AND coalesce(closed_book_overlap >= 0.45, false) THEN 'answerable_without_corpus' END], lambda x: x IS NOT NULL),
  list_transform(coalesce(leaks, []), lambda x: 'leak_' || x))) AS failures,
  greatest(0, least(1, round(round(1.0::DOUBLE - (CASE drift WHEN 'missing' THEN 0.6 WHEN 'moved' THEN 0.35 ELSE 0 END)::DOUBLE - 0.15::DOUBLE * len(coalesce(leaks, [])) - CASE WHEN coalesce(entity_named, false) THEN 0 ELSE 0.2 END::DOUBLE - CASE WHEN answer_grounding < 0.25 THEN 0.2 ELSE 0 END::DOUBLE
    - CASE WHEN judge_answerable IS NULL THEN 0.1 WHEN {neg} AND judge_answerable THEN 0.6 WHEN NOT {neg} AND NOT judge_answerable THEN 0.4 ELSE 0 END::DOUBLE - CASE WHEN NOT {neg} AND coalesce(closed_book_overlap >= 0.45, false) THEN 0.15 ELSE 0 END::DOUBLE, 9), 3))) AS score FROM {source})"""


_GATE_RULES = ", ".join([*(f"('{m}', 'up')" for m in UP), *(f"('{m}', 'down')" for m in DOWN), *(f"('{m}', 'banded')" for m in BANDED), *(f"('{m}', 'reported')" for m in REPORTED)])
_GATE = f"""WITH {E._OUT}, s AS (SELECT *, retrieved_gold AND cited_resolvable AND abstained_correctly AND within_budget AS success FROM r),
p AS (SELECT arm, {', '.join(f'sum({m}::INT)::DOUBLE AS {m}' for m in UP[:5])}, round(avg(recall), 4) AS recall, (sum(coalesce(asserted, 0)) - sum(coalesce(unresolvable, 0)))::DOUBLE AS resolvable, sum(coalesce(unresolvable, 0))::DOUBLE AS unresolvable,
  count(*) FILTER (must_abstain AND NOT abstained AND coalesce(error, '') = '')::DOUBLE AS false_answers, count(*) FILTER (coalesce(error, '') <> '')::DOUBLE AS errors, quantile_disc(in_tokens, 0.5)::DOUBLE AS p50_tokens, round(avg(precision), 4) AS precision,
  round(avg(efficiency), 4) AS efficiency, (sum(coalesce(in_tokens, 0)) + sum(coalesce(out_tokens, 0)))::DOUBLE AS tokens, quantile_disc(in_tokens, 0.95)::DOUBLE AS p95_tokens FROM s GROUP BY 1),
l AS (UNPIVOT p ON {', '.join([*UP, *DOWN, *BANDED, *REPORTED])} INTO NAME metric VALUE value), rules(metric, kind) AS (VALUES {_GATE_RULES})
SELECT metric, b.value AS baseline, n.value AS now, CASE WHEN kind = 'reported' THEN 'reported' WHEN b.value IS NULL OR n.value IS NULL OR (kind = 'banded' AND b.value = 0) THEN 'skipped'
  WHEN (kind = 'up' AND n.value < b.value) OR (kind = 'down' AND n.value > b.value) OR (kind = 'banded' AND n.value > b.value * 1.25) THEN 'failed' ELSE 'ok' END AS verdict
FROM (SELECT * FROM l WHERE arm = 'single_agent') b FULL JOIN (SELECT * FROM l WHERE arm = 'supervisor') n USING (metric) JOIN rules USING (metric)"""
_CITED = f"""{E._ANS}, {_SEC}, cited AS (SELECT arm, task_id, generate_subscripts(cited_uids, 1) - 1 AS place, unnest(cited_uids) AS uid FROM ans),
marks AS (SELECT arm, task_id, place, uid AS section_uid, section_uid IS NOT NULL AS found, CASE WHEN section_uid IS NULL THEN 'NOT FOUND IN THE INDEX' ELSE coalesce(length(text)::VARCHAR, '') END AS text FROM cited LEFT JOIN sec ON uid = section_uid)"""
_TWINS = f"""{_MAN}, coded AS (SELECT doc_id, doc_type, nullif(upper(trim(regexp_replace(regexp_extract(title, '{T.CODE_PATTERN}', 1), '\\s+', ' ', 'g'))), '') AS code FROM man),
twins AS (SELECT x.doc_id, x.code, min(y.doc_id) AS parent_id FROM coded x JOIN coded y ON x.code = y.code AND x.doc_type <> y.doc_type GROUP BY 1, 2)"""
_WORDS4 = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}')), lambda x: NOT list_contains(" + repr(T.STOP_WORDS) + ", x))"
_CLEAN = "trim(regexp_replace(text, '\\n{3,}', E'\\n\\n', 'g'))"
_ENTITY = "title || ' – ' || upper(doc_type[1]) || lower(doc_type[2:]) || ' of the ' || issuer"

SQL = {
    "item_status": f"WITH {_CHECKED}, {_verdict_sql('v', 'c')} SELECT id, entity_named, array_to_string(failures, ',') AS failures, CASE WHEN len(failures) > 0 THEN 'flagged' ELSE 'machine_verified' END AS status, score AS confidence FROM v",
    "reverify": f"""WITH {_CHECKED}, {_verdict_sql('p', '(SELECT * EXCLUDE (entity_named), stored_named AS entity_named FROM c)')},
f AS (SELECT * REPLACE ({_LEAKS} AS leaks, NULL::BOOLEAN AS judge_answerable, NULL::DOUBLE AS closed_book_overlap) FROM c), {_verdict_sql('n', 'f')}
SELECT p.id, CASE WHEN len(n.failures) > 0 THEN 'flagged' ELSE p.status END AS status, array_to_string(list_sort(list_distinct(list_concat(p.failures, n.failures))), ',') AS failures FROM p JOIN n ON n.id = p.id""",
    "agent_gate": _GATE,
    "citation_markers": f"WITH {_CITED} SELECT * FROM marks",
    "reference_violations": f"""WITH {_CITED}, per AS (SELECT arm, task_id, array_to_string(list_sort(list_distinct(list(section_uid) FILTER (found))), ' ') AS kept, count(*) AS n, count(*) FILTER (NOT found) AS bad FROM marks GROUP BY 1, 2)
SELECT arm, task_id, coalesce(kept, '') AS kept, CASE WHEN coalesce(abstained, false) THEN 0 WHEN coalesce(n, 0) = 0 THEN 1 ELSE bad END AS violations FROM ans LEFT JOIN per USING (arm, task_id)""",
    "abstention_rule": f"WITH {E._ANS} SELECT arm, abstained, regexp_matches(lower(coalesce(answer, '')), '{'|'.join(agentlog.REFUSAL_MARKERS)}') OR coalesce(asserted, 0) = 0 AS rule, count(*) AS n FROM ans GROUP BY ALL",
    "documents_read": f"WITH {E._ANS}, u AS (SELECT arm, task_id, split_part(uid, ':', 1) AS d, min(place) AS place FROM (SELECT arm, task_id, generate_subscripts(cited_uids, 1) AS place, unnest(cited_uids) AS uid FROM ans) GROUP BY 1, 2, 3), g AS (SELECT arm, task_id, count(*) AS n, string_agg(d, ' ' ORDER BY place) AS ids FROM u GROUP BY 1, 2) SELECT arm, task_id, coalesce(n, 0) AS documents, coalesce(ids, '') AS doc_ids FROM ans LEFT JOIN g USING (arm, task_id)",
    "judged_agreement": f"WITH {E._OUT}, {_CK}, s AS (SELECT *, retrieved_gold AND cited_resolvable AND abstained_correctly AND within_budget AS success FROM r WHERE NOT must_abstain AND NOT abstained AND coalesce(error, '') = '') SELECT arm, count(*) AS judged, count(*) FILTER (judge_answerable) AS answerable, count(*) FILTER (success) AS passed, count(*) FILTER (success AND judge_answerable) AS both FROM s JOIN ck ON golden_id = item_id WHERE judge_answerable IS NOT NULL GROUP BY 1",
    "judge_summary": f"WITH {_CHECKED} SELECT query_type, count(judge_answerable) AS n, count(*) - count(judge_answerable) AS unjudged, round(count(*) FILTER (judge_answerable) / nullif(count(judge_answerable), 0), 4) AS rate, round(count(*) FILTER (judge_answerable AND stored_named AND drift = 'resolved') / nullif(count(judge_answerable), 0), 4) AS all_three FROM c GROUP BY 1",
    "useful_answers": f"""WITH {E._OUT}, p AS (SELECT arm, count(*) AS items, count(*) FILTER (NOT abstained) AS answers, round(count(*) FILTER (NOT abstained AND retrieved_gold) / nullif(count(*) FILTER (NOT abstained), 0), 4) AS grounded FROM r WHERE NOT must_abstain GROUP BY 1),
u AS (SELECT *, round(coalesce(grounded, 0) * answers / greatest(items, 1), 4) AS useful FROM p)
SELECT *, arm = first_value(arm) OVER (ORDER BY grounded DESC NULLS LAST, arm) AS most_grounded, arm = first_value(arm) OVER (ORDER BY answers, arm) AS fewest_answers, arm = first_value(arm) OVER (ORDER BY useful DESC, arm) AS most_useful FROM u""",
    "generation_summary": f"WITH {E._ANS} SELECT arm, count(*) AS n, round(avg((coalesce(unresolvable, 0) = 0 AND coalesce(asserted, 0) > 0)::INT), 4) AS citation_valid, count(*) FILTER (stopped_by = 'token_budget') AS truncated, count(*) FILTER (error <> '') AS errors, round(avg(in_tokens), 2) AS mean_in, round(avg(out_tokens), 2) AS mean_out FROM ans GROUP BY 1",
    "verdict_flips": f"""WITH {S._METRICS}, fl AS (SELECT id AS query_id, coalesce(status, '') = 'flagged' AS flagged FROM {S.live_sql('items', 'id', 'built_at')}),
mm AS (SELECT config, query_type, mrr, unnest(CASE WHEN flagged THEN ['all'] ELSE ['all', 'unflagged'] END) AS part FROM m JOIN fl USING (query_id) WHERE n_gold > 0),
pp AS (SELECT part, query_type, config, count(*) AS n, round(avg(mrr), 4) AS mrr FROM mm GROUP BY 1, 2, 3),
vv AS (SELECT a.part, a.query_type, a.config, CASE WHEN abs(round(a.mrr - b.mrr, 4)) <= 1 / a.n THEN 'flat' WHEN a.mrr > b.mrr THEN 'helps' ELSE 'hurts' END AS verdict FROM pp a JOIN pp b ON a.part = b.part AND a.query_type = b.query_type AND b.config = 'terms' WHERE a.config <> 'terms')
SELECT x.query_type, x.config, x.verdict AS over_all, y.verdict AS over_unflagged, x.verdict <> y.verdict AS flips FROM vv x LEFT JOIN vv y ON y.part = 'unflagged' AND x.query_type = y.query_type AND x.config = y.config WHERE x.part = 'all'""",
    "displacement_tally": f"WITH d AS ({S.SQL['displacement']}) SELECT move, count(*) AS n, round(avg(shift), 4) AS mean_shift, quantile_cont(shift, 0.5) AS median_shift FROM d GROUP BY 1",
    "embedding_arms": f"""WITH {_CHUNKS}, x AS (SELECT section_uid, min(context_text) AS fresh FROM ch WHERE section_uid IS NOT NULL AND context_text IS NOT NULL GROUP BY 1),
k AS (SELECT chunk_id, text, coalesce(fresh, context_text) AS c FROM ch LEFT JOIN x USING (section_uid) WHERE text IS NOT NULL) SELECT chunk_id, 'plain' AS arm, sha256(text) AS sha FROM k UNION ALL SELECT chunk_id, '+ctx', sha256(c || chr(10) || chr(10) || text) FROM k WHERE c IS NOT NULL""",
    "replaced_arm": f"WITH {_CHUNKS} SELECT 'plain' AS arm, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ch WHERE text IS NOT NULL UNION ALL SELECT '+ctx', count(*), sum(length(context_text) + length(text) + 6)::BIGINT FROM ch WHERE text IS NOT NULL AND context_text IS NOT NULL",
    "outline": f"WITH {_SEC}, {_MAN}, {_CHUNKS}, n AS (SELECT section_uid, count(*) AS n FROM ch GROUP BY 1) SELECT section_uid, title || ' | ' || section_path || coalesce(' ' || heading, '') || ' (' || n || ')' AS line FROM sec JOIN man USING (doc_id) JOIN n USING (section_uid)",
    "section_edges": f"WITH {_SEC}, c AS (SELECT doc_id, regexp_replace(section_path, '\\.[^.]*$', '') AS above, count(*) AS children, min(section_uid) AS first FROM sec WHERE section_path LIKE '%.%' GROUP BY 1, 2) SELECT c.doc_id, above, children, first, p.section_uid AS parent_uid FROM c LEFT JOIN sec p ON p.doc_id = c.doc_id AND p.section_path = above",
    "scope_labels": f"""WITH {_SEC}, s AS (SELECT section_uid, trim(regexp_replace(heading, '\\s+', ' ', 'g')) AS t FROM sec), k AS (SELECT section_uid, CASE WHEN length(t) <= 40 THEN t WHEN contains(substr(t, 1, 41), ' ') THEN regexp_replace(substr(t, 1, 41), ' [^ ]*$', '') ELSE substr(t, 1, 40) END AS t FROM s)
SELECT section_uid, nullif(replace(trim(t, ' ,.;:-'), '/', '-'), '') AS scope FROM k""",
    "clean_sections": f"WITH {_SEC}, k AS (SELECT section_uid, {_CLEAN} AS t FROM sec) SELECT section_uid, length(t) AS chars, sha256(t) AS sha FROM k WHERE length(t) >= 40",
    "entity_classes": f"""WITH {_MAN}, t AS (SELECT doc_id, {_ENTITY} AS title FROM man), k AS (SELECT doc_id, nullif(trim(regexp_replace(regexp_extract(title, '{T.CLASS_AFTER_TO}', 1), '\\s+', ' ', 'g')), '') AS direct, regexp_replace(trim(regexp_replace(regexp_extract(trim(title), '{T.CLASS_AFTER_DASH}', 1), '\\s+', ' ', 'g')), '\\.+$', '') AS tail FROM t)
SELECT doc_id, coalesce(direct, CASE WHEN regexp_matches(substr(tail, 1, 1), '[A-Z]') AND len(string_split(tail, ' ')) <= 10 THEN tail END) AS entity FROM k""",
    "topic_terms": f"WITH {_ITEMS} SELECT id, array_to_string(list_filter(list_transform(string_split(lower(coalesce(question, '')), ' '), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)), ' ') AS terms FROM it",
    "content_hashes": f"WITH {_MAN} SELECT issuer, sha256(string_agg(doc_id || chr(1) || sha256, chr(2) ORDER BY doc_id)) AS hash FROM man GROUP BY 1",
    "manifest_jsonl": "SELECT issuer, count(*) AS rows, count(DISTINCT doc_id) AS documents, sum(n_bytes)::BIGINT AS bytes FROM manifest GROUP BY 1",
    "title_twins": f"WITH {_TWINS} SELECT * FROM twins",
    "cross_references": f"""WITH {_TWINS}, {_SEC}, codes AS (SELECT code, min(doc_id) AS doc_id FROM coded WHERE code IS NOT NULL GROUP BY 1),
own AS (SELECT section_uid, s.doc_id, parent_id AS target, unnest(regexp_extract_all(text, '(?i)paragraphs?\\s+(\\d{{1,2}}(?:\\.\\d{{1,3}}){{0,3}})', 1)) AS path, 'guideline_to_notice' AS kind FROM sec s JOIN twins USING (doc_id)),
oc AS (SELECT section_uid, doc_id, unnest(regexp_extract_all(text, '{golden.OF_CODE}', 1)) AS path, unnest(regexp_extract_all(text, '{golden.OF_CODE}', 2)) AS code FROM sec UNION ALL SELECT section_uid, doc_id, unnest(regexp_extract_all(text, '{golden.CODE_OF}', 2)), unnest(regexp_extract_all(text, '{golden.CODE_OF}', 1)) FROM sec),
named AS (SELECT section_uid, oc.doc_id, codes.doc_id AS target, path, 'explicit_citation' AS kind FROM oc JOIN codes ON codes.code = upper(trim(regexp_replace(oc.code, '\\s+', ' ', 'g')))),
refs AS (SELECT section_uid, doc_id, target, path, kind FROM own UNION ALL SELECT section_uid, doc_id, target, path, kind FROM named)
SELECT b.section_uid, t.section_uid AS target_uid, max(kind) AS kind FROM refs b JOIN sec t ON t.doc_id = b.target AND t.section_path = b.path WHERE b.target <> b.doc_id GROUP BY 1, 2""",
    "temporal_kinds": f"WITH {_SEC} SELECT CASE WHEN regexp_matches(text, '{golden.AMENDED}') THEN 'amendment' WHEN regexp_matches(text, '{golden.DELETED}') THEN 'deleted' WHEN regexp_matches(text, '{golden.IN_EFFECT}') THEN 'effect' END AS kind, count(*) AS n, min(section_uid) AS first FROM sec GROUP BY 1",
    "comparable_clauses": f"""WITH {_SEC}, {_MAN}, o AS (SELECT section_path, issuer, min(section_uid) AS section_uid FROM sec JOIN man USING (doc_id) WHERE section_path IS NOT NULL AND issuer IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
k AS (SELECT o.section_path, section_uid, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY o.section_path ORDER BY section_uid) AS place FROM o JOIN sec USING (section_uid) QUALIFY place <= 3),
w AS (SELECT *, {_WORDS4.format('t')} AS w FROM k), p AS (SELECT x.section_path, round(max(1 - {_JACCARD.format('x.w', 'y.w')}), 4) AS widest FROM w x JOIN w y ON x.section_path = y.section_path AND x.place < y.place GROUP BY 1 HAVING widest <= 0.94)
SELECT section_path, widest, uids, differ FROM p JOIN (SELECT section_path, string_agg(section_uid, ' ' ORDER BY section_uid) AS uids, count(DISTINCT substr(t, 1, 400)) > 1 AS differ FROM k GROUP BY 1) USING (section_path)""",
    "factual_selection": """WITH r AS (SELECT *, sha256('42' || candidate_id) AS o FROM candidates WHERE candidate_id IS NOT NULL AND query_type IS NOT NULL AND band IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY band, query_type ORDER BY o, candidate_id) AS turn FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY turn, query_type, candidate_id) AS k FROM t QUALIFY k <= 10),
a AS (SELECT DISTINCT candidate_id, o, candidate_id NOT IN (SELECT candidate_id FROM p) AS topped_up FROM r) SELECT candidate_id, row_number() OVER (ORDER BY topped_up, o, candidate_id) AS place, topped_up FROM a QUALIFY place <= 45""",
    "gold_exclusion": f"""WITH {_ITEMS}, {_MAN}, g AS (SELECT DISTINCT id, query_type, g.doc_id AS doc_id FROM (SELECT id, query_type, unnest(gold_spans) AS g FROM it)),
p AS (SELECT id, query_type, count(*) AS gold, count(*) FILTER (coalesce(doc_type IN ('notices', 'guidelines') AND effective_date >= DATE '2023-01-01', false)) AS kept FROM g LEFT JOIN man USING (doc_id) GROUP BY 1, 2)
SELECT query_type, count(*) AS items, count(*) FILTER (kept = 0) AS all_lost, count(*) FILTER (kept > 0 AND kept < gold) AS some_lost FROM p GROUP BY 1""",
    "salvaged_json": "SELECT event_type, count(*) AS n, count(props) AS found, sum((props->>'$.k')::DOUBLE)::BIGINT AS k FROM events GROUP BY 1",
    "scaled_tasks": f"WITH {_ITEMS} SELECT id, query_type, row_number() OVER (PARTITION BY query_type ORDER BY id) AS place FROM it WHERE status = 'machine_verified' QUALIFY place <= CASE query_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in golden.scaled_quota(golden.TASK_QUOTA, 10).items()) + " END",
}

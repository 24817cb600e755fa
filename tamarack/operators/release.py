"""Releases of a corpus and of question sets, and their audits, as relations.

Nothing is written here: builders give DataFrames, audits give violations (rule, key) that ``quality.gate`` counts; a
release passes if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import chunking, hygiene, quality
from tamarack.session import materialise

# Chunks shorter than this are flagged; preambles are cut to this; candidates from which a citation is
# ambiguous; label of tokens that are no target.
SHORT_CHUNK, PREAMBLE, AMBIGUOUS, MASKED = 60, 1400, 20, -100


def short_chunk(text: Column, least: int = SHORT_CHUNK) -> Column:
    """Whether a chunk is shorter than ``least`` characters in its canonical form; null counts as empty."""
    return F.length(T.canonical_text(text)) < least


def release_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, name, text, fingerprint, alias_of, status, indexable, flags) of docs (doc_id, name, text, json_valid).

    A document that is delivered again counts once. Equal texts are aliases of the smallest id.
    """
    one = docs.groupBy("doc_id").agg(F.min("name").alias("name"), F.min("text").alias("text"), F.bool_and(F.coalesce("json_valid", F.lit(True))).alias("json_valid"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    marked = materialise(one.withColumn("fingerprint", F.when(~blank, T.fingerprint(F.col("text")))), "marked")
    first = marked.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("alias_of"))
    joined = marked.join(first, "fingerprint", "left")
    status = hygiene.document_status(F.col("json_valid"), blank, F.coalesce(F.col("text").rlike(hygiene.PAYWALL), F.lit(False)), F.col("alias_of"), F.col("doc_id"))
    out = joined.withColumn("status", status)
    flags = F.when(~blank, hygiene.length_flags(F.col("text"))).otherwise(F.array().cast("array<string>"))
    return out.select("doc_id", "name", "text", "fingerprint", F.when(F.col("alias_of") != F.col("doc_id"), F.col("alias_of")).alias("alias_of"), "status", (F.col("status") == "INCLUDED").alias("indexable"), flags.alias("flags"))


def fixed_chunks(docs: DataFrame, text: str, most: int = 1800, overlap: int = 220) -> DataFrame:
    """(doc_id, ordinal, body): windows of texts without articles, or of all texts where structure is not wanted."""
    return docs.select("doc_id", F.posexplode(chunking.long_text_windows(F.col(text), most, overlap)).alias("ordinal", "body"))


def corpus_chunks(documents: DataFrame, most: int = 1800, overlap: int = 220) -> DataFrame:
    """(chunk_id, doc_id, parent_id, level, article, clause, contained_clauses, body, short, fingerprint) of included documents.

    Articles are packed clause by clause; what stands before the first article is a preamble, cut to ``PREAMBLE``
    characters; a document without articles is cut into windows. Of equal chunks of the corpus the first is kept.
    """
    included = documents.where("indexable").select("doc_id", "name", "text")
    lines = materialise(chunking.legal_lines(included.select("doc_id", "text"), "text"), "lines")
    packed = chunking.pack_segments(lines, most).select("doc_id", F.concat_ws(":", F.lit("article"), "article", F.col("segment").cast("string")).alias("section"), "level", "article", "clause", "contained_clauses", "ordinal", "body")
    structured = lines.where("article IS NOT NULL").select("doc_id").distinct()
    text = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    opening = lines.where("segment = 0").join(structured, "doc_id", "left_semi").groupBy("doc_id").agg(text("line").alias("head"))
    heads = opening.join(included.select("doc_id", "name"), "doc_id").select("doc_id", F.substring(F.concat_ws("\n", "name", "head"), 1, PREAMBLE).alias("head"))
    none = [F.lit(None).cast("string").alias("article"), F.lit(None).cast("string").alias("clause"), F.array().cast("array<string>").alias("contained_clauses")]
    preambles = fixed_chunks(heads, "head", most, overlap).select("doc_id", F.lit("preamble").alias("section"), F.lit("preamble").alias("level"), *none, "ordinal", "body")
    loose = fixed_chunks(included.join(structured, "doc_id", "left_anti"), "text", most, overlap).select("doc_id", F.lit("document").alias("section"), F.lit("fixed").alias("level"), *none, "ordinal", "body")
    every = packed.unionByName(preambles).unionByName(loose)
    named = every.withColumns({"parent_id": T.stable_id(F.col("doc_id"), F.col("section")), "fingerprint": T.fingerprint(F.col("body"))})
    named = materialise(named.withColumn("chunk_id", T.stable_id(F.col("parent_id"), F.col("ordinal"), F.col("body"))), "chunks")
    first = Window.partitionBy("fingerprint").orderBy("doc_id", "section", "ordinal")
    kept = named.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select("chunk_id", "doc_id", "parent_id", "level", "article", "clause", "contained_clauses", "body", short_chunk(F.col("body")).alias("short"), "fingerprint")


def corpus_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(section, name, value): histograms of status, quarantine, chunk levels and short chunks."""
    count = lambda df, section, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "name", "value")
    parts = [count(documents, "status", F.col("status")), count(documents.where("NOT indexable AND status <> 'exact_duplicate_alias'"), "quarantine", F.col("status")), count(chunks, "level", F.col("level")), count(chunks.where("short"), "short", F.col("level"))]
    return reduce(DataFrame.unionByName, parts)


def eda_report(qa: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """(section, name, value): counts, repeats beyond the first, mentions of articles and numbers, lengths at the usual places."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = qa.agg(
        F.count("*").alias("records"), (F.count("*") - F.countDistinct(T.canonical_text(F.col(question)))).alias("repeated_questions"), F.count_if(F.trim(text(answer)) == "").alias("empty_answers"),
        F.count_if(text(answer).rlike(r"(?iu)điều\s+\d+")).alias("answers_with_article"), F.count_if(text(answer).rlike(r"\d{1,5}/\d{4}/")).alias("answers_with_number"),
    )
    counts = one.select(F.explode(F.array(*[F.struct(F.lit("count").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("x")).select("x.*")
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
    places = [
        qa.agg(F.percentile(F.length(text(c)), F.array(*[F.lit(x) for x in shares])).alias("p")).select(F.explode(F.array(*[F.struct(F.lit(f"{name}_chars").alias("section"), F.lit(f"p{x * 100:g}").alias("name"), F.floor(F.col("p")[i]).cast("double").alias("value")) for i, x in enumerate(shares)])).alias("x")).select("x.*")
        for name, c in (("question", question), ("answer", answer))
    ]
    return reduce(DataFrame.unionByName, [counts, *places])


def clause_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, article, clause, chunk_id): a chunk under each clause that it holds, its own among them."""
    own = F.when(F.col("clause").isNotNull(), F.array("clause")).otherwise(F.array().cast("array<string>"))
    every = F.array_sort(F.array_union(F.coalesce("contained_clauses", F.array().cast("array<string>")), own))
    return chunks.select("doc_id", "article", F.explode(every).alias("clause"), "chunk_id")


def near_chunk_duplicates(chunks: DataFrame, least_chars: int = 100, difference: float = 0.02, likeness: float = 0.98) -> DataFrame:
    """(doc_id, chunk_id, kept_id): chunks that nearly equal an earlier one of their document.

    chunks (doc_id, chunk_id, article, ordinal, text). Only chunks of one article, of like length and with the same
    beginning and end are compared, so that a group is a few copies of one passage; the first is kept.
    """
    canon = T.canonical_text(F.col("text"))
    keyed = chunks.select("doc_id", "chunk_id", F.coalesce("article", F.lit("")).alias("article"), "ordinal", canon.alias("text")).where(F.length("text") >= least_chars)
    keyed = keyed.withColumns({"size": F.floor(F.length("text") / 50), "head": F.substring("text", 1, 64), "tail": F.expr("right(text, 64)")})

    def first_of(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, str]] = []
        rows = []
        for row in group.sort_values(["ordinal", "chunk_id"]).itertuples():
            alike = next((k for k, t in kept if abs(len(t) - len(row.text)) <= difference * max(len(t), len(row.text)) and SequenceMatcher(None, t, row.text, autojunk=False).ratio() >= likeness), None)
            if alike is None:
                kept.append((row.chunk_id, row.text))
            else:
                rows.append((row.doc_id, row.chunk_id, alike))
        return pd.DataFrame(rows, columns=["doc_id", "chunk_id", "kept_id"])

    several = keyed.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "article", "size", "head", "tail"))).where("n > 1")
    return several.groupBy("doc_id", "article", "size", "head", "tail").applyInPandas(first_of, "doc_id string, chunk_id string, kept_id string")


def qa_release(qa: DataFrame, validation: int, seed: int = 2026) -> DataFrame:
    """(question_id, question, answer, question_group, split, changed, media_note, related_questions) of qa (id, question, answer, public).

    Records count once per id. Labelled records are split by question group; public ones keep no answer.
    """
    one = qa.where("id IS NOT NULL").groupBy(F.col("id").alias("question_id")).agg(F.min("question").alias("q"), F.min("answer").alias("a"), F.bool_or("public").alias("public"))
    plain = T.minimal_text(F.col("a"))
    model = one.select("question_id", "public", T.minimal_text(F.col("q"), keep_lines=False).alias("question"), F.when(~F.col("public"), T.minimal_text(T.sanitize_answer(F.col("a")))).alias("answer"), F.when(~F.col("public"), plain).alias("before"))
    model = materialise(model.withColumn("question_group", T.question_group(F.col("question"))), "qa")
    split = hygiene.group_split(model.where("NOT public").select(F.col("question_group").alias("group")), validation, seed)
    joined = model.join(split.select(F.col("group").alias("question_group"), "split"), "question_group", "left")
    residue = T.answer_residue(F.col("answer"))
    return joined.select("question_id", "question", "answer", "question_group", F.when(F.col("public"), "public").otherwise(F.col("split")).alias("split"), (~F.col("answer").eqNullSafe(F.col("before"))).alias("changed"), *[(c & ~F.col("public")).alias(n) for n, c in residue.items()])


def qa_report(release: DataFrame) -> DataFrame:
    """One row of counts: records by split, changed answers, residue, empty fields, repeated questions."""
    labelled = F.col("split") != "public"
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    counts = {
        "records": F.count_if(labelled), "validation": F.count_if(F.col("split") == "validation"), "public": F.count_if(~labelled), "changed": F.count_if(labelled & F.col("changed")), "media_notes": F.count_if(F.col("media_note")), "related_questions": F.count_if(F.col("related_questions")),
        "empty_questions": F.count_if(labelled & blank("question")), "empty_answers": F.count_if(labelled & blank("answer")), "question_groups": F.countDistinct(F.when(labelled, F.col("question_group"))),
    }
    return release.agg(*[c.alias(n) for n, c in counts.items()])


def qa_violations(release: DataFrame) -> DataFrame:
    """(rule, key): leaks between train and validation by id, question and group, residue, public labels, repeated ids."""
    train, held = release.where("split = 'train'"), release.where("split = 'validation'")
    rows = quality.violations(release, "question_id", {"no_residue": ~(F.coalesce("media_note", F.lit(False)) | F.coalesce("related_questions", F.lit(False))), "public_unlabelled": (F.col("split") != "public") | F.col("answer").isNull(), "question_present": F.trim("question") != "", "known_split": F.col("split").isin("train", "validation", "public")})
    leaks = [quality.overlap(train, held, name, f"no_{name}_overlap") for name in ("question_id", "question", "question_group")]
    return reduce(DataFrame.unionByName, [rows, quality.repeated_keys(release, "question_id"), *leaks])


def corpus_violations(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, key): what is wrong with a corpus release; every rule is a relation of its own.

    Keys are unique and present, statuses known, aliases point to included documents of equal text, chunks belong to
    included documents, have text, a known level, a clause among those they hold, no twin and no page code.
    """
    statuses = ("INCLUDED", "invalid_json", "empty_passage", "paywall_artifact", "exact_duplicate_alias")
    levels = ("article", "article_intro", "article_group", "clause", "point", "preamble", "fixed")
    code = F.exists(F.split("body", "\n"), hygiene.is_web_line) & F.col("body").rlike(hygiene.PAYWALL)
    docs = quality.violations(documents, "doc_id", {"document_id_present": F.trim("doc_id") != "", "known_status": F.col("status").isin(*statuses), "indexable_if_included": F.col("indexable") == (F.col("status") == "INCLUDED"), "alias_has_target": (F.col("status") != "exact_duplicate_alias") | F.col("alias_of").isNotNull(), "included_has_text": ~F.col("indexable") | (F.trim(F.coalesce("text", F.lit(""))) != "")})
    parts = quality.violations(chunks, "chunk_id", {"chunk_has_text": F.trim(F.coalesce("body", F.lit(""))) != "", "known_level": F.col("level").isin(*levels), "clause_contained": F.col("clause").isNull() | F.array_contains("contained_clauses", F.col("clause")), "article_present": F.col("level").isin("preamble", "fixed") | F.col("article").isNotNull(), "no_page_code": ~code, "no_notice": ~F.col("body").rlike(hygiene.PAYWALL)})
    included = documents.where("indexable")
    alias = documents.where("alias_of IS NOT NULL").join(included.select(F.col("doc_id").alias("alias_of"), F.col("fingerprint").alias("f")), "alias_of", "left").where("f IS NULL OR f <> fingerprint")
    return reduce(DataFrame.unionByName, [docs, parts, quality.repeated_keys(documents, "doc_id", "unique_document"), quality.repeated_keys(chunks, "chunk_id", "unique_chunk"), quality.repeated_keys(chunks, "fingerprint", "no_twin_chunks"), quality.missing_references(chunks, "doc_id", included, "doc_id", "chunk_document_included"), quality.single_owner(chunks, "parent_id", "doc_id", "one_document_per_parent"), alias.select(F.lit("alias_of_included_twin").alias("rule"), "doc_id").toDF("rule", "key")])


@dataclass(frozen=True)
class TableContract:
    """What a table of a release has to be: columns that are there or not, constant values, and at least so many rows."""

    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    expected: dict[str, object] = field(default_factory=dict)
    least_rows: int = 1


def contract_violations(tables: dict[str, DataFrame], contracts: dict[str, TableContract]) -> DataFrame:
    """(rule, key) of all contracts, keys being table names; a table that is missing breaks one rule, ``present``."""
    spark = next(iter(tables.values())).sparkSession
    rows, counted = [], []
    for name, contract in contracts.items():
        if name not in tables:
            rows.append(("present", name))
            continue
        columns = set(tables[name].columns)
        rows += [("required_column", f"{name}.{c}") for c in contract.required if c not in columns]
        rows += [("forbidden_column", f"{name}.{c}") for c in contract.forbidden if c in columns]
        tests = {c: ~F.col(c).eqNullSafe(F.lit(v)) for c, v in contract.expected.items() if c in columns}
        found = tables[name].agg(F.count("*").alias("n"), *[F.count_if(t).alias(f"x_{c}") for c, t in tests.items()])
        broken = F.array_compact(F.array(F.when(F.col("n") < contract.least_rows, F.struct(F.lit("least_rows").alias("rule"), F.lit(name).alias("key"))), *[F.when(F.col(f"x_{c}") > 0, F.struct(F.lit("expected_value").alias("rule"), F.lit(f"{name}.{c}").alias("key"))) for c in tests]))
        counted.append(found.select(F.explode(broken).alias("b")).select("b.rule", "b.key"))
    return reduce(DataFrame.unionByName, counted, spark.createDataFrame(rows, "rule string, key string"))


def freeze_violations(documents: DataFrame, chunks: DataFrame, candidates: DataFrame, qa: DataFrame) -> DataFrame:
    """(rule, key) of everything that must be settled before a release is frozen.

    Corpus and question rules, and boilerplate candidates (line, decision) that nobody has decided yet.
    """
    pending = candidates.where("decision IS NULL OR decision = ''").select(F.lit("candidates_reviewed").alias("rule"), F.col("line").alias("key"))
    return corpus_violations(documents, chunks).unionByName(qa_violations(qa)).unionByName(pending)


def review_decision(line: Column, classification: Column, headers: list[str], labels: list[str], blank: str, signature: str, routing: str, default: str = "keep_legal_or_ambiguous") -> Column:
    """Decision on a boilerplate candidate; the first rule that holds decides, and no rule deletes."""
    low = F.lower(F.trim(line))
    among = lambda values: low.isin(*[v.lower() for v in values]) if values else F.lit(False)
    rules = (
        (classification == "blacklist", "remove_retrieval_reviewed_blacklist"), (classification == "protected", "keep_protected_legal"), (among(headers), "keep_conservative_header_fragment"), (among(labels), "keep_conservative_site_label"),
        (low.rlike(f"(?iu)^(?:{blank})$"), "keep_form_placeholder"), (low.rlike(f"(?iu){signature}"), "keep_form_signature"), (low.rlike(f"(?iu){routing}"), "terminal_routing_candidate_structural_only"),
    )
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules], F.lit(default))


def diagnostic_labels(answers: DataFrame, cited: DataFrame, parents: DataFrame) -> DataFrame:
    """(question_id, status, citations, matched, parents) of all answers (question_id).

    cited (question_id, number, article), parents (parent_id, number, article). An answer without a citation, with one
    that a parent answers, with numbers that none answers, or with no number at all.
    """
    named = cited.where("number IS NOT NULL AND number <> ''").distinct()
    met = named.join(parents.where("number IS NOT NULL AND article IS NOT NULL").select("number", "article", "parent_id").distinct(), ["number", "article"])
    counts = cited.groupBy("question_id").agg(F.count("*").alias("citations"), F.count_if(F.coalesce("number", F.lit("")) != "").alias("numbered"))
    found = met.groupBy("question_id").agg(F.countDistinct("number", "article").alias("matched"), F.countDistinct("parent_id").alias("parents"))
    out = answers.select("question_id").distinct().join(counts, "question_id", "left").join(found, "question_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    status = F.when(zero("citations") == 0, "no_citation").when(zero("parents") > 0, "matched").when(zero("numbered") > 0, "document_or_article_not_found").otherwise("citation_without_document_number")
    return out.select("question_id", status.alias("status"), zero("citations").alias("citations"), zero("matched").alias("matched"), zero("parents").alias("parents"))


def label_coverage(answers: DataFrame, cited: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: answers, with citations, matched by best confidence, unmatched, ambiguous, label pairs, coverage.

    labels (question_id, chunk_id, confidence). Answers without a match stay unjudged; they are no negative labels.
    """
    grade = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1)
    best = labels.groupBy("question_id").agg(F.max(grade).alias("best"), F.countDistinct("chunk_id").alias("chunks"))
    rows = answers.select("question_id").distinct().join(cited.select("question_id").distinct().withColumn("cites", F.lit(True)), "question_id", "left").join(best, "question_id", "left")
    matched = F.col("best").isNotNull()
    return rows.agg(
        F.count("*").alias("answers"), F.count_if(F.col("cites")).alias("with_citations"), F.count_if(matched).alias("matched"), *[F.count_if(F.col("best") == g).alias(f"matched_{n}") for n, g in (("high", 3), ("medium", 2), ("low", 1))],
        F.count_if(F.col("cites") & ~matched).alias("unmatched"), F.count_if(F.col("chunks") > AMBIGUOUS).alias("ambiguous"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("pairs"), F.round(F.count_if(matched) / F.greatest(F.count("*"), F.lit(1)), 6).alias("coverage"),
    )


def repeated_blocks(docs: DataFrame, text: str, most: int = 5, least: int = hygiene.BLOCK_CHARS) -> DataFrame:
    """(doc_id, position, block, times, repeated_chars): the blocks of each document that repeat most."""
    cut = docs.select("doc_id", F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n+")).alias("raw")).withColumn("block", F.lower(T.collapse(F.col("raw")))).where(T.informative(F.col("block"), least))
    counted = cut.groupBy("doc_id", "block").agg(F.count("*").alias("times")).where("times > 1").withColumn("repeated_chars", (F.col("times") - 1) * F.length("block"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("repeated_chars"), F.desc("times"), "block")
    return counted.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def corruption_order(metrics: DataFrame, lengths: DataFrame, top: int = 100) -> DataFrame:
    """The ``top`` documents of a sanitation report, the most severe, most repeated and longest first.

    metrics as of ``hygiene.repetition``, lengths (doc_id, chars, paywalled).
    """
    rows = lengths.join(metrics, "doc_id", "left").withColumn("severity", hygiene.severity(F.col("paywalled"), F.coalesce("ratio", F.lit(0.0)), F.coalesce("max_frequency", F.lit(0))))
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "REVIEW", 1).otherwise(2)
    ordered = rows.withColumn("_r", rank).orderBy("_r", F.desc("paywalled"), F.desc(F.coalesce("duplicate_char_ratio", F.lit(0.0))), F.desc("chars"), "doc_id").limit(top)
    return ordered.select("doc_id", "severity", "paywalled", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("duplicate_char_ratio", F.lit(0.0)).alias("duplicate_char_ratio"), "chars")


def sanitation_audit(docs: DataFrame, text: str, protected: list[str], exact: list[str], patterns: list[str]) -> DataFrame:
    """(section, name, value): severities of the documents, classes of the lines that many documents share, and totals."""
    metrics = materialise(hygiene.repetition(docs, text), "repetition")
    rows = docs.select("doc_id", F.coalesce(F.col(text).rlike(hygiene.PAYWALL), F.lit(False)).alias("paywalled")).join(metrics, "doc_id", "left")
    severities = rows.select(F.lit("severity").alias("section"), hygiene.severity(F.col("paywalled"), F.coalesce("ratio", F.lit(0.0)), F.coalesce("max_frequency", F.lit(0))).alias("name"))
    lines = hygiene.line_frequencies(docs, text, report=None).select(F.lit("shared_line").alias("section"), hygiene.classify_line(F.col("line"), protected, exact, patterns).alias("name"))
    counted = severities.union(lines).groupBy("section", "name").agg(F.count("*").cast("double").alias("value"))
    totals = metrics.agg(F.sum("blocks").alias("blocks"), F.sum(F.col("blocks") - F.col("unique_blocks")).alias("repeated_blocks"), F.count_if(F.col("max_frequency") > 1).alias("documents_with_repeats"))
    pairs = F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value")) for c in totals.columns])
    return counted.union(totals.select(F.explode(pairs).alias("x")).select("x.section", "x.name", "x.value"))


def answer_only_labels(prompt_ids: Column, full_ids: Column, most: int) -> Column:
    """Struct (input_ids, labels, target_tokens, truncated) for training on answers only; null if no target is left.

    The prompt is the longest common beginning of both arrays; its labels are masked.
    """
    differ = F.array_position(F.zip_with(prompt_ids, F.slice(full_ids, F.lit(1), F.size(prompt_ids)), lambda a, b: ~a.eqNullSafe(b)), True).cast("int")
    prefix = F.when(differ > 0, differ - 1).otherwise(F.least(F.size(prompt_ids), F.size(full_ids)))
    kept = F.slice(full_ids, 1, most)
    target = F.size(full_ids) - prefix
    labels = F.transform(kept, lambda x, i: F.when(i < prefix, F.lit(MASKED).cast("bigint")).otherwise(x.cast("bigint")))
    row = F.struct(F.transform(kept, lambda x: x.cast("bigint")).alias("input_ids"), labels.alias("labels"), target.alias("target_tokens"), F.greatest(F.size(full_ids) - F.lit(most), F.lit(0)).alias("truncated"))
    return F.when((prefix > 0) & (target > 0) & (F.size(kept) > prefix), row)


def length_batches(df: DataFrame, text: str, key: str, size: int = 64) -> DataFrame:
    """``df`` in parts of ascending length, each row with its batch (part, number) of ``size`` rows of like length.

    Parts come from a range partitioning, so that no task orders all rows.
    """
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    spread = df.withColumn("_n", length).repartitionByRange("_n", key).sortWithinPartitions("_n", key).withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy("_n", key)
    return spread.withColumn("batch", F.floor((F.row_number().over(inner) - 1) / size)).drop("_n")


#: Steps of a run in their order, by profile, and the gates that must have passed before each.
STEPS = {"direct": ("release", "tokenizer", "checkpoint", "validation", "public_submission"), "retrieval": ("release", "tokenizer", "index", "checkpoint", "validation", "public_submission")}


def next_step(profile: str, gates: dict[str, str], running: bool = False) -> tuple[str, str | None]:
    """(state, step): the first step whose gate is not ``PASS``; nothing advances while an operation runs."""
    if profile not in STEPS:
        raise ValueError(f"profiles are {sorted(STEPS)}")
    step = next((s for s in STEPS[profile] if gates.get(s) != "PASS"), None)
    return ("BLOCKED" if running else "COMPLETE" if step is None else "READY_TO_ADVANCE"), step


def throughput(batches: Iterator[int], seconds: float) -> dict[str, float]:
    """Rows and rows a second of a timed run over batches of so many rows."""
    rows = sum(batches)
    return {"rows": float(rows), "seconds": seconds, "rows_per_second": rows / seconds if seconds > 0 else 0.0}

"""The pN_ queries: each runs a problem's operator with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import forms, leakage, mixing, neardup, overlap, pairs, reading, residue, setjoin, sitelines, splits
from tamarack.session import materialise, spread_table, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defective_pairs(spread_table(spark, root, "qa_examples").where("split <> 'public'"))


def p1_defects_by_source(spark: SparkSession, root: str) -> DataFrame:
    found = p1_found(spark, root)
    sources = spread_table(spark, root, "qa_examples").where("split <> 'public'").select("id", "source").distinct()
    return sources.join(found, "id").groupBy("source", "defect").agg(F.count("*").alias("pairs"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    qa = forms.inconsistent_records(spread_table(spark, root, "qa_examples"), "id", "question", "qa_examples")
    legal = forms.inconsistent_records(spread_table(spark, root, "legal_documents"), "id", "raw_text", "legal_documents")
    return qa.unionByName(legal)


def p2_consistent_questions(spark: SparkSession, root: str) -> DataFrame:
    qa = spread_table(spark, root, "qa_examples").select("id", "question")
    return forms.with_consistent(qa, {"question": "consistent"}).select("id", "consistent")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.repeated_lines(spread_table(spark, root, "legal_documents"), ["retrieval_text", "generation_text"]).select("id", "field", "line_no")


def p3_clean_documents(spark: SparkSession, root: str) -> DataFrame:
    fields = ["retrieval_text", "generation_text"]
    docs = spread_table(spark, root, "legal_documents").select("id", "source", *fields)
    return sitelines.without_lines(docs, sitelines.repeated_lines(docs, fields), fields)


def _split_records(spark: SparkSession, root: str) -> DataFrame:
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("validation", "public"), 1)
    return spread_table(spark, root, "qa_examples").select("id", side.alias("side"), "question", "answer")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    found = overlap.overlaps(_split_records(spark, root))
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p4_overlap_counts(spark: SparkSession, root: str) -> DataFrame:
    found = overlap.overlaps(_split_records(spark, root))
    held = spread_table(spark, root, "qa_examples").where("split <> 'train'").select(F.col("id").alias("eval_id"), "split", "source").distinct()
    return held.join(found, "eval_id").groupBy("split", "source").agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("records"))


def _residue_records(spark: SparkSession, root: str) -> DataFrame:
    legal = spread_table(spark, root, "legal_documents").select(F.lit("legal_documents").alias("table_name"), F.col("id").alias("record_id"), F.col("passage").alias("text"))
    warm = table(spark, root, "task2_warmup").select(F.lit("task2_warmup").alias("table_name"), F.col("query_id").alias("record_id"), F.col("answer").alias("text"))
    return legal.unionByName(warm)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_records(_residue_records(spark, root))


def p6_residue_units(spark: SparkSession, root: str) -> DataFrame:
    units, labels = residue.residue_units(_residue_records(spark, root))
    return units.select("table_name", "record_id", "unit", "text").join(labels, "unit").select("table_name", "record_id", "label", "text").distinct()


def _passages(spark: SparkSession, root: str) -> DataFrame:
    """(id, text) of legal documents without residue: passage, or retrieval_text without its site lines.

    Residue is searched in the records of both tables, as labels also reach passages through answers.
    """
    docs = spread_table(spark, root, "legal_documents").select("id", "source", "passage", "retrieval_text")
    found = residue.residue_records(_residue_records(spark, root)).where("table_name = 'legal_documents'")
    gone = setjoin.small(materialise(found.select(F.col("record_id").alias("id")), "residue"))
    bare = docs.where("passage IS NULL")
    lines = sitelines.repeated_lines(docs, ["retrieval_text"]).join(setjoin.small(bare.select("id").distinct()), "id", "left_semi")
    cleaned = sitelines.without_lines(bare, lines, ["retrieval_text"]).select("id", F.col("retrieval_text").alias("text"))
    return docs.where("passage IS NOT NULL").select("id", F.col("passage").alias("text")).join(gone, "id", "left_anti").unionByName(cleaned)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    members, linked = neardup.near_duplicates(_passages(spark, root), run=3, threshold=0.7)
    return neardup.pairs_of_ids(members, linked)


def _related(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    thread = F.regexp_extract("id", r"(?<!\d)(\d{8})(?!\d)", 1)
    qa = spread_table(spark, root, "qa_examples").select(F.col("id").alias("record_id"), thread.alias("thread"), F.lower(F.trim("author")).alias("author"), "question")
    warm = table(spark, root, "task2_warmup").select(F.col("query_id").alias("record_id"), F.lit(None).cast("string").alias("thread"), F.lit(None).cast("string").alias("author"), "question")
    records = qa.unionByName(warm).where("record_id IS NOT NULL")
    one = lambda name: F.when(F.col(name) != "", F.array(name))
    keys = {"thread": one("thread"), "author": one("author"), "document": splits.document_numbers(F.col("question"))}
    return records, splits.related_groups(records, keys)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _related(spark, root)[1]


def _assigned(spark: SparkSession, root: str) -> DataFrame:
    records, grouped = _related(spark, root)
    targets = table(spark, root, "split_targets").orderBy(F.desc("target_share"), "split_name").collect()
    return splits.assign(records, grouped, [(r.split_name, r.target_share) for r in targets])


def p7_assignment(spark: SparkSession, root: str) -> DataFrame:
    return _assigned(spark, root)


def p7_split_shares(spark: SparkSession, root: str) -> DataFrame:
    sizes = _assigned(spark, root).groupBy("split").agg(F.count("*").alias("records"))
    targets = table(spark, root, "split_targets").withColumnRenamed("split_name", "split")
    total = sizes.agg(F.sum("records").alias("total"))
    return targets.join(sizes, "split", "left").crossJoin(F.broadcast(total)).select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / F.col("total")).alias("share"))


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    members, linked = neardup.near_duplicates(_passages(spark, root))
    return neardup.grouped(members, linked)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_passages(spread_table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p8_leak_report(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "eval_items").select("item_id", "split", F.col("source").alias("item_source"))
    hits = leakage.leaked_passages(spread_table(spark, root, "documents"), table(spark, root, "eval_items"))
    return hits.join(setjoin.small(items), "item_id")


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    docs = spread_table(spark, root, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    return mixing.mix(docs, table(spark, root, "source_targets"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return reading.reading_levels(spread_table(spark, root, "documents"), table(spark, root, "reading_labels")).select("doc_id", "band")


def p10_profile(spark: SparkSession, root: str) -> DataFrame:
    levels = reading.reading_levels(spread_table(spark, root, "documents"), table(spark, root, "reading_labels"))
    sources = spread_table(spark, root, "documents").select("doc_id", "source")
    return levels.join(sources, "doc_id").groupBy("source", "band").agg(F.count("*").alias("documents"), F.avg("level").alias("level"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_defects_by_source": p1_defects_by_source,
    "p2_found": p2_found,
    "p2_consistent_questions": p2_consistent_questions,
    "p3_found": p3_found,
    "p3_clean_documents": p3_clean_documents,
    "p4_found": p4_found,
    "p4_overlap_counts": p4_overlap_counts,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_residue_units": p6_residue_units,
    "p7_found": p7_found,
    "p7_assignment": p7_assignment,
    "p7_split_shares": p7_split_shares,
    "p8_found": p8_found,
    "p8_leak_report": p8_leak_report,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
}

_LINE_SQL = "lower(trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '\\d+', '0', 'g')))"
_KEYS_SQL = f"""l AS (
  SELECT DISTINCT id, source, f AS field, i - 1 AS line_no, {_LINE_SQL.format(x="t")} AS k FROM (
    SELECT id, source, 'retrieval_text' AS f, unnest(string_split(retrieval_text, chr(10))) AS t, generate_subscripts(string_split(retrieval_text, chr(10)), 1) AS i FROM legal_documents
    UNION ALL
    SELECT id, source, 'generation_text', unnest(string_split(generation_text, chr(10))), generate_subscripts(string_split(generation_text, chr(10)), 1) FROM legal_documents)
), n AS (SELECT source, count(DISTINCT id) AS total FROM legal_documents GROUP BY source)
, o AS (SELECT source, field, k FROM l JOIN n USING (source) WHERE k <> '' GROUP BY source, field, k, total HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) >= 0.2 * total)"""
_EVAL_WORDS = "regexp_extract_all(lower(nfc_normalize({x})), '[\\p{{L}}\\p{{Nd}}]+')"


def _runs_sql(key: str, name: str) -> str:
    words = _EVAL_WORDS.format(x="text")
    return f"SELECT DISTINCT {key}, hash(array_to_string(ws[i:i + 14], ' ')) AS g FROM (SELECT {key}, {words} AS ws, unnest(range(1, len({words}) - 13)) AS i FROM {name})"


def _form_sql(x: str) -> str:
    """The consistent form as far as comparisons need it: widths, look-alikes, invisible characters and accents.

    Letters of words in another alphabet are mapped too, alike in all texts, which leaves equality of words as it is.
    """
    pairs = [(chr(0xFF01 + i), chr(0x21 + i)) for i in range(94)] + [(k, v) for letters in forms.LOOKALIKES.values() for k, v in letters.items()]
    other, plain = ("".join(p[k] for p in pairs).replace("'", "''") for k in (0, 1))
    bare = f"regexp_replace({x}, '[\\x{{00ad}}\\x{{034f}}\\x{{061c}}\\x{{180e}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}]', '', 'g')"
    return f"lower(nfc_normalize(translate({bare}, '{other}', '{plain}')))"


_WORDS_SQL = "regexp_extract_all({x}, '[\\p{{L}}\\p{{Nd}}]+')"
_OVERLAP_SQL = f"""WITH d AS (SELECT DISTINCT id, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, {_WORDS_SQL.format(x=_form_sql("coalesce(question, '')"))} AS q, {_WORDS_SQL.format(x=_form_sql("coalesce(answer, '')"))} AS a FROM qa_examples),
 t AS (SELECT id, side, len(a) > 0 AS has, 0 AS kind, q AS ws FROM d UNION ALL SELECT id, side, true, 1, list_concat(q, a) FROM d WHERE len(a) > 0),
 g AS (SELECT DISTINCT id, side, has, kind, hash(array_to_string(ws[i:i + 2], ' ')) AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM t)),
 n AS (SELECT id, kind, has, count(*) AS n FROM g GROUP BY ALL),
 c AS (SELECT x.id AS a, y.id AS b, x.kind AS kind, x.has AS ha, y.has AS hb, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.kind = y.kind AND x.side = 0 AND y.side = 1 AND (x.kind = 1 OR NOT (x.has AND y.has)) GROUP BY ALL)
 SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM c JOIN n p ON p.id = a AND p.kind = c.kind AND p.has = ha JOIN n r ON r.id = b AND r.kind = c.kind AND r.has = hb WHERE c.c >= 0.7 * (p.n + r.n - c.c) - 1e-9"""
_NUMBER_SQL = "(?i)(?:^|[^\\p{L}\\p{N}])(\\d+\\s*/\\s*\\d{4}\\s*/\\s*\\p{L}{2,}(?:\\s*-\\s*\\p{L}{2,})+)"
_RELATED_SQL = f"""WITH RECURSIVE r AS (SELECT id, author, question, true AS qa FROM qa_examples UNION ALL SELECT query_id, NULL, question, false FROM task2_warmup),
 k AS (SELECT DISTINCT id, key FROM (
  SELECT id, 't:' || nullif(regexp_extract(id, '(?:^|[^0-9])([0-9]{{8}})(?:$|[^0-9])', 1), '') AS key FROM r WHERE qa
  UNION ALL SELECT id, 'a:' || nullif(lower(trim(author)), '') FROM r
  UNION ALL SELECT id, 'd:' || upper(regexp_replace(unnest(regexp_extract_all(regexp_replace({_form_sql("question")}, '[\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g'), '{_NUMBER_SQL}', 1)), '\\s+', '', 'g')) FROM r) WHERE key IS NOT NULL),
 h AS (SELECT key, min(id) AS b FROM k GROUP BY key), s AS (SELECT DISTINCT id AS a, b FROM k JOIN h USING (key) WHERE id <> b), e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
 w AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.a, w.root FROM w JOIN e ON e.b = w.id)
 SELECT id AS record_id, min(root) AS group_id FROM w GROUP BY id"""

#: SQL for the queries that SQL can express on whole tables; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "p3_found": f"WITH {_KEYS_SQL} SELECT id, field, CAST(line_no AS BIGINT) AS line_no FROM l JOIN o USING (source, field, k)",
    "p4_found": _OVERLAP_SQL,
    "p7_found": _RELATED_SQL,
    "p8_found": f"WITH d AS ({_runs_sql('doc_id', 'documents')}), e AS ({_runs_sql('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)",
}

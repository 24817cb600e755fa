"""Readers: question files, context folders and archives, JSON lines with contract checks, warm-up files."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import quality
from tamarack.sources import schemas

_ALIASES = "MAP<STRING, STRUCT<question_id: STRING, id: STRING, question_model: STRING, question: STRING, answer_model: STRING, answer: STRING>>"
_ROW = "STRUCT<question_id: STRING, id: STRING, question_model: STRING, question: STRING, answer_model: STRING, answer: STRING>"


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer) from a JSON object keyed by id, a JSON list, or JSON lines, told apart by their start.

    A byte-order mark is dropped; aliases of the fields are accepted; questions are put on one line, answers keep
    theirs. One file is one JSON value, so a file of the first two kinds is read by one task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    start = F.substring(F.ltrim("v"), 1, 1)
    lines = F.size(F.filter(F.split("v", "\n"), lambda x: F.trim(x).rlike(r"^\{.*\}$")))
    is_lines = (start == "{") & (lines == F.size(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != "")))
    one = F.when(is_lines, F.lit("lines")).when(start == "[", F.lit("list")).otherwise(F.lit("map"))
    kinds = whole.withColumn("kind", F.when((one == "lines") & ~F.col("v").rlike(r'^\s*\{[^{}]*"(?:question|question_model)"\s*:'), F.lit("map")).otherwise(one))
    keyed = kinds.where("kind = 'map'").select(F.explode(F.from_json("v", _ALIASES)).alias("k", "r"))
    listed = kinds.where("kind = 'list'").select(F.lit(None).cast("string").alias("k"), F.explode(F.from_json("v", f"ARRAY<{_ROW}>")).alias("r"))
    lined = kinds.where("kind = 'lines'").select(F.explode(F.split("v", "\n")).alias("l")).where("trim(l) <> ''").select(F.lit(None).cast("string").alias("k"), F.from_json("l", _ROW).alias("r"))
    rows = keyed.unionByName(listed).unionByName(lined)
    return rows.select(F.coalesce("r.question_id", "r.id", "k").alias("id"), T.normalize_text(F.coalesce("r.question_model", "r.question"), keep_lines=False).alias("question"), F.when(F.coalesce("r.answer_model", "r.answer").isNotNull(), T.normalize_text(F.coalesce("r.answer_model", "r.answer"))).alias("answer"))


def context_id(member: Column, given: Column) -> Column:
    """Id of a context: its field, else from ``context_<id>.json``, else from the hash of its name."""
    return F.coalesce(given, F.nullif(F.regexp_extract(member, r"(?i)context_([^/\\]+)\.json$", 1), F.lit("")), F.substring(T.fingerprint(member), 1, 16))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(member, payload, sha256, bytes) of the JSON files of a folder or of its ZIP archives, folders' members sorted by name.

    Archives are split by file: each is unpacked by the task that reads it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        rows += [(m.filename, archive.read(m)) for m in archive.infolist() if not m.is_dir() and m.filename.lower().endswith(".json")]
                elif name.lower().endswith(".json"):
                    rows.append((name, content))
            yield pd.DataFrame(rows, columns=["member", "payload"])

    members = files.select("path", "content").mapInPandas(unpack, "member string, payload binary")
    return members.withColumns({"sha256": F.sha2("payload", 256), "bytes": F.length("payload").cast("bigint")})


def parse_contexts(members: DataFrame) -> DataFrame:
    """Context members as records with ``json_valid``; other members stay, with null fields."""
    parsed = members.withColumn("r", F.from_json(F.decode("payload", "UTF-8"), schemas.CONTEXT))
    valid = F.col("r.passage").isNotNull() | F.col("r.id").isNotNull()
    key = context_id(F.col("member"), F.col("r.id"))
    name = F.coalesce(F.nullif(F.trim("r.name"), F.lit("")), T.name_from_link(F.col("r.link"), key))
    return parsed.select(key.alias("id"), "member", name.alias("name"), F.col("r.link").alias("link"), F.col("r.passage").alias("passage"), "sha256", "bytes", F.coalesce(valid, F.lit(False)).alias("json_valid"))


def contexts_digest(members: DataFrame) -> DataFrame:
    """One row: SHA-256 over (name, NUL, SHA-256 of the payload) of all members in the order of their names.

    The order is made by the cluster; the driver takes the sorted lines one part at a time and holds none of them.
    """
    digest, count = hashlib.sha256(), 0
    for row in members.select("member", "sha256").orderBy("member", "sha256").toLocalIterator():
        digest.update((("\n" if count else "") + f"{row.member}\u0000{row.sha256}").encode())
        count += 1
    return members.sparkSession.createDataFrame([(digest.hexdigest(), count)], "digest string, members bigint")


def document_violations(docs: DataFrame) -> DataFrame:
    """(rule, key) of documents (doc_id, title, text, source, access_scope): ids plain and unique, no blank field."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rules = {"document_id_plain": F.col("doc_id").cast("string").rlike(r"^\S+$")} | {f"{c}_present": filled(c) for c in ("title", "text", "source", "access_scope")}
    return quality.violations(docs, "doc_id", rules).unionByName(quality.repeated_keys(docs, "doc_id", "document_id_unique"))


def question_violations(questions: DataFrame) -> DataFrame:
    """(rule, key) of questions (id, question): ids present and unique, no blank question."""
    rules = {"question_id_present": F.trim(F.coalesce("id", F.lit(""))) != "", "question_present": F.trim(F.coalesce("question", F.lit(""))) != ""}
    return quality.violations(questions, "id", rules).unionByName(quality.repeated_keys(questions, "id", "question_id_unique"))


def read_lines(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """JSON lines; a broken line fails the read, or stays in ``_corrupt`` if not strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = schema.add("_corrupt", "string") if "_corrupt" not in schema.fieldNames() else schema
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def line_failures(spark: SparkSession, path: str, schema) -> DataFrame:
    """(file, line_no, line) of the lines that are no JSON object of the schema, counted from 1; blank lines are skipped.

    Line numbers need whole files, so a file is read by one task; ``read_lines`` is the way to read.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    parsed = whole.where("trim(line) <> ''").withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    names = [f.name for f in schema.fields]
    empty = F.forall(F.array(*[F.col(f"r.{n}").cast("string") for n in names]), lambda x: x.isNull())
    return parsed.where(F.col("r").isNull() | (empty & ~F.col("line").rlike(r"^\s*\{.*\}\s*$"))).select("file", (F.col("n") + 1).alias("line_no"), "line")


def read_warmup(spark: SparkSession, path: str, labels: bool) -> DataFrame:
    """(id, question, answer) of a keyed warm-up file; ``labels`` says that answers are lists of document ids."""
    kind = "MAP<STRING, STRUCT<question: STRING, answer: ARRAY<STRING>>>" if labels else "MAP<STRING, STRUCT<question: STRING, answer: STRING>>"
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    return whole.select(F.explode(F.from_json("v", kind)).alias("id", "r")).select("id", "r.question", "r.answer")


def summarize_warmup(rows: DataFrame) -> DataFrame:
    """One row (records, unique_questions, empty_answers, digest); the digest is free of order."""
    blank = F.col("answer").isNull() | (F.trim(F.col("answer").cast("string")) == "")
    return rows.agg(F.count("*").alias("records"), F.countDistinct("question").alias("unique_questions"), F.count_if(blank).alias("empty_answers"), F.lower(F.hex(F.coalesce(F.bit_xor(F.xxhash64("id", "question", F.col("answer").cast("string"))), F.lit(0)))).alias("digest"))

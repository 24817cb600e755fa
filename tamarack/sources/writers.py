"""Sinks: JSON lines, index tables, vectors with resume, answer archives, samples and manifests."""

from __future__ import annotations

import io
import json
import os
import tempfile
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import ranking as R


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Compact JSON lines in UTF-8; nulls are written, so that each line has every field."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json(path: str, value: object) -> None:
    """One JSON value in a local file, in full or not at all: it is written beside its place and then moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, suffix=".part", delete=False) as part:
        json.dump(value, part, ensure_ascii=False, indent=2, sort_keys=True)
        part.flush()
        os.fsync(part.fileno())
    os.replace(part.name, path)


def check_archive(data: bytes, expected_ids: set[str], member: str = "results.json") -> list[str]:
    """What is wrong with an answer archive: members, encoding, repeated or missing or unknown ids, fields, blank answers."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        if names != [member]:
            return [f"members are {names}"]
        raw = archive.read(member)
    found = ["byte-order mark"] if raw.startswith(b"\xef\xbb\xbf") else []
    repeated: list[str] = []

    def unique(pairs: list[tuple[str, object]]) -> dict:
        keys = [k for k, _ in pairs]
        repeated.extend(sorted({k for k in keys if keys.count(k) > 1}) if len(set(keys)) < len(keys) else [])
        return dict(pairs)

    try:
        rows = json.loads(raw.decode("utf-8-sig"), object_pairs_hook=unique)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        return [*found, f"unreadable: {e}"]
    if not isinstance(rows, dict):
        return [*found, "not an object"]
    found += [f"repeated {k}" for k in repeated] + [f"missing {k}" for k in sorted(expected_ids - rows.keys())] + [f"unknown {k}" for k in sorted(rows.keys() - expected_ids)]
    found += [f"fields of {k}" for k, r in rows.items() if not isinstance(r, dict) or set(r) != {"answer"}]
    return found + [f"blank {k}" for k, r in rows.items() if isinstance(r, dict) and not str(r.get("answer") or "").strip()]


def build_index(chunks: DataFrame, tokens: Column, path: str, buckets: int = 200, parents: DataFrame | None = None, indexable: Column | None = None) -> dict[str, int]:
    """Writes a search index of chunks (doc_id, ...): ``postings``, ``lengths``, ``chunks``, ``parents`` and a manifest.

    Only ``indexable`` chunks go in. Postings lie sorted by token in ``buckets`` files by token hash, so that a query
    reads the row groups of its tokens only. Fails if the folder is there already or if a chunk was lost.
    """
    kept = chunks if indexable is None else chunks.where(indexable)
    spark = chunks.sparkSession
    R.postings(kept, tokens).repartition(buckets, "token").sortWithinPartitions("token", "doc_id").write.parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    written.groupBy("doc_id").agg(F.sum("tf").alias("dl")).write.parquet(f"{path}/lengths")
    kept.repartition(buckets, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/chunks")
    if parents is not None:
        parents.write.parquet(f"{path}/parents")
    counts = {"documents": spark.read.parquet(f"{path}/lengths").count(), "postings": written.count()}
    wanted = kept.where(F.size(tokens) > 0).select("doc_id").distinct().count()
    if counts["documents"] != wanted:
        raise ValueError(f"index has {counts['documents']} documents, not {wanted}")
    index_manifest(spark, path, parents is not None).write.json(f"{path}/manifest")
    return counts


def index_manifest(spark: SparkSession, path: str, parents: bool = True) -> DataFrame:
    """(table, records, digest) of an index folder; the digest is free of order."""
    tables = ("postings", "lengths", "chunks", *(("parents",) if parents else ()))
    parts = [spark.read.parquet(f"{path}/{t}") for t in tables]
    rows = [df.agg(F.lit(t).alias("table"), F.count("*").alias("records"), F.lower(F.hex(F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)))).alias("digest")) for t, df in zip(tables, parts)]
    return reduce(DataFrame.unionByName, rows)


def index_violations(spark: SparkSession, path: str) -> DataFrame:
    """(rule, key) of an index folder that is not what its manifest says: tables with other counts or digests."""
    said = spark.read.schema("table string, records bigint, digest string").json(f"{path}/manifest")
    found = index_manifest(spark, path, said.where("table = 'parents'").count() > 0)
    joined = said.alias("s").join(found.alias("f"), "table", "full_outer")
    count, digest = (F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")), F.lit(n)) for c, n in (("records", "count_matches_manifest"), ("digest", "digest_matches_manifest")))
    return joined.select(F.explode(F.array_compact(F.array(count, digest))).alias("rule"), F.col("table").alias("key"))


def look_up(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, ...) of a search with their chunks, joined by id."""
    return hits.join(spark.read.parquet(f"{path}/chunks"), "doc_id")


def append_vectors(spark: SparkSession, docs: DataFrame, encode, path: str) -> None:
    """Appends unit vectors of the documents that ``path`` has none of yet; ``encode`` maps a text column to arrays."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    done = spark.read.parquet(path).select("doc_id") if there else spark.createDataFrame([], docs.select("doc_id").schema)
    todo = docs.join(done, "doc_id", "left_anti").withColumn("v", encode)
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    todo.select("doc_id", F.transform("v", lambda x: (x / norm).cast("float")).alias("vector")).write.mode("append").parquet(path)


def answer_archive(answers: DataFrame, expected_ids: DataFrame, member: str = "results.json") -> bytes:
    """A ZIP with one JSON object {id: {answer}} with sorted ids and a fixed time stamp.

    Fails unless the ids are exactly the expected ones. A submission is one file by its format, so it is put together on
    the driver; the id check runs as two anti-joins.
    """
    missing = expected_ids.join(answers, "id", "left_anti").count()
    extra = answers.join(expected_ids, "id", "left_anti").count()
    if missing or extra or answers.select("id").distinct().count() != answers.count():
        raise ValueError(f"ids differ: {missing} missing, {extra} extra, or some repeated")
    rows = {r.id: {"answer": r.answer} for r in answers.orderBy("id").toLocalIterator()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), json.dumps(rows, ensure_ascii=False, sort_keys=True))
    return out.getvalue()


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 2026) -> DataFrame:
    """A sample of ``n`` rows that depends on keys and seed only: the smallest seeded hashes."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def manifest(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(table, records, digest): counts and an order-free digest of the keys of each table."""
    rows = [df.agg(F.lit(name).alias("table"), F.count("*").alias("records"), F.lower(F.hex(F.coalesce(F.bit_xor(F.xxhash64(key)), F.lit(0)))).alias("digest")) for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out

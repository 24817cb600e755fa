"""Explicit schemas of the record kinds; nothing is inferred on read."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields):
    return StructType([StructField(n, t) for n, t in fields.items()])


S, B, I, L, D = StringType(), BooleanType(), IntegerType(), LongType(), DoubleType()  # noqa: E741
QA = _struct(id=S, question=S, answer=S)
QA_RELEASE = _struct(question_id=S, source_task=S, question_raw=S, answer_raw=S, question_model=S, answer_model=S, question_group=S, split=S, source_sha256=S, transform_version=S)
CONTEXT = _struct(id=S, name=S, link=S, passage=S)
DOCUMENT = _struct(id=S, name=S, passage=S, link=S, original_name=S, source_ids=ArrayType(S), flags=ArrayType(S), metadata=_struct(document_type=S, document_number=S, char_length=L, structure_density_per_10k=D), raw_text=S, retrieval_text=S, generation_text=S)
CHUNK = _struct(id=S, parent_id=S, document_id=S, text=S, retrieval_text=S, level=S, heading=S, document_type=S, document_number=S, chapter=S, section=S, article=S, clause=S, point=S, ordinal=I, path=ArrayType(S), source_name=S, references=ArrayType(S), amendments=ArrayType(S))
PASSAGE = _struct(document_id=S, title=S, body=S, language=S, source_uri=S, access_scope=S, corpus_version=S, metadata=MapType(S, S), provenance=MapType(S, S))
QUERY = _struct(query_id=S, text=S, answerable=B, allowed_scopes=ArrayType(S))
QREL = _struct(query_id=S, document_id=S, relevance=I)
INVENTORY = _struct(doc_id=S, relative_path=S, sha256=S, bytes=L, json_valid=B)

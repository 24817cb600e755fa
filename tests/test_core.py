"""Operators of the core on small fixtures, odd input among them."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tamarack.functions import citations as C
from tamarack.functions import metrics as M
from tamarack.functions import text as T
from tamarack.operators import chunking, evaluation, hygiene, quality
from tamarack.operators import ranking as R
from tamarack.operators.components import connected_components
from tamarack.sources import readers, schemas, writers
from tamarack.streaming import pipelines


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {kind}" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_normalisation(spark):
    text = "Điều  3.\r\n  Có hiệu lực từ...\n\n\n\nSửa đổi 90 / 2017 / nđ - cp"
    assert one(spark, T.normalize_text, text) == "Điều 3.\nCó hiệu lực từ...\n\nSửa đổi 90/2017/NĐ-CP"
    assert one(spark, T.normalize_text, "<p>a</p><ul><li>b &amp; c</li></ul>") == "a\n\n\n- b & c".replace("\n\n\n", "\n\n")
    assert one(spark, T.normalize_text, "e\u0301 •x") == "é - x".replace(" - x", " - x")
    assert one(spark, T.normalize_text, None) == "" and one(spark, T.canonical_text, "STRASSE ß") == "strasse ss"
    joined = "số 6186/ 2006/ QĐ-HĐN\u200d, và 90 / 2017 / nđ - cp2"
    assert one(spark, T.normalize_citations, joined) == "số 6186/2006/QĐ-HĐN\u200d, và 90 / 2017 / nđ - cp2"
    assert one(spark, lambda c: c.rlike(T.LEGAL_MARKER), "Theo luật\u200d này") and not one(spark, lambda c: c.rlike(T.LEGAL_MARKER), "luậtsư")
    assert one(spark, T.fingerprint, "A  b") == one(spark, T.fingerprint, "a B")
    assert one(spark, T.ascii_tokens, "Điều của Luật Đất") == ["dieu", "luat", "dat"]
    assert one(spark, T.legal_tokens, "Theo 90/2017/NĐ-CP, điều 3") == ["theo", "90/2017/nđ-cp", "điều", "3"]
    assert one(spark, T.safe_id, "Điều 98đ") == "ddieu_98dd"
    assert one(spark, T.sanitize_answer, "Tiêu đề (Hình từ Internet)\nTheo Điều 1, có.") == "Tiêu đề\nTheo Điều 1, có."
    assert one(spark, lambda c: T.sanitize_answer(c, tail_only=True), "… hợp lệ. (Hình từ Internet) phần quảng bá").strip() == "… hợp lệ."
    assert one(spark, lambda c: T.repetition_rate(T.word_tokens(c)), "a b c d a b c d") == pytest.approx(0.2)


def test_citations(spark):
    got = one(spark, C.citations, "Căn cứ điểm a khoản 3, khoản 5 Điều 17 Nghị định 90/2017/NĐ-CP.")
    assert {r.clause for r in got} == {"3", "5"} and {(r.article, r.document_number, r.point) for r in got} == {("17", "90/2017/NĐ-CP", "a")}
    assert one(spark, C.citations, None) == [] and one(spark, C.citations, "không có") == []


DECREE = "Mở đầu\nĐiều 17. Phạt\n1. Một\na) x;\nb) y.\n2. Hai\nĐiều 18. Khác\n1. Ba\nĐiều 17. Lại"


def test_segmentation(spark):
    docs = spark.createDataFrame([("d", DECREE), ("n", None), ("e", "")], "doc_id string, body string")
    got = {(r.article, r.occurrence, r.level): r.body for r in chunking.articles(docs, "body").collect()}
    assert set(got) == {(None, None, "preamble"), ("17", 0, "article"), ("18", 0, "article"), ("17", 1, "article")} and "b) y." in got["17", 0, "article"]
    packed = chunking.pack_segments(chunking.legal_lines(docs, "body"), 30).collect()
    assert all(len(r.body) <= 30 or r.level == "clause" for r in packed) and sum("Hai" in r.body for r in packed) == 1
    for text in (DECREE * 30, "a" * 500, " x ", ""):
        spans = one(spark, lambda c: chunking.window_spans(c, 80, 10), text)
        assert all(0 < s.end - s.start <= 80 and text[s.start : s.end] == text[s.start : s.end].strip() for s in spans)
    chunks = chunking.sentence_chunks(spark.createDataFrame([("d", "A. B! C? D")], "doc_id string, t string"), "t").collect()
    assert [(r.chunk_id, r.chunk) for r in chunks] == [("d::c000", "A. B!"), ("d::c001", "C? D")]


def test_ranking(spark):
    docs = spark.createDataFrame([(1, "mức phạt là năm"), (2, "thủ tục nộp đơn"), (3, None), (4, "")], "doc_id long, t string")
    asked = R.query_terms(spark.createDataFrame([(7, "mức phạt")], "query_id long, q string"), T.legal_tokens(F.col("q")))
    posts = R.postings(docs, T.legal_tokens(F.col("t")))
    assert [(r.doc_id, r["rank"]) for r in R.bm25(posts, asked).collect()] == [(1, 1)] == [(r.doc_id, r["rank"]) for r in R.tfidf(posts, asked).collect()]
    assert R.bm25(posts.limit(0), asked).count() == 0
    ch = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id string, score double, rank int")
    fused = R.fuse({"bm25": ch([(1, "c1", 8.0, 1), (1, "c2", 7.0, 2)]), "dense": ch([(1, "c2", 0.9, 1), (1, "c3", 0.8, 2)])}).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == ["c2", "c1", "c3"] and fused[0].channel_ranks == {"bm25": 2, "dense": 1}
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, None)], "doc_id long, vector array<float>")
    near = R.nearest(vectors, spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "query_id long, vector array<float>"), 3, block=1)
    assert {r.query_id: r.doc_id for r in near.where("rank = 1").collect()} == {1: 0, 2: 2}


def test_confidence_and_k(spark):
    rows = [(1, f"d{i}", s, i + 1) for i, s in enumerate((0.92, 0.89, 0.34, 0.21))] + [(2, f"d{i}", s, i + 1) for i, s in enumerate((0.81, 0.79, 0.76, 0.73, 0.70))]
    got = R.confidence(spark.createDataFrame(rows, "query_id int, doc_id string, score double, rank int"))
    ks = {r.query_id: (r.elbow, r.k) for r in got.withColumn("k", R.dynamic_k(F.lit(3), F.col("concentration"), F.col("elbow"))).collect()}
    assert ks[1] == (2, 2) and ks[2][1] >= 5


def test_evidence_and_graph(spark):
    pool = spark.createDataFrame([(1, f"e{i}", "d" if i < 4 else "x", 1.0 - i / 10, "t" * 40) for i in range(6)] + [(1, "low", "y", 0.1, "t")], "query_id int, id string, document_id string, score double, text string")
    got = R.pack_evidence(pool, most_chars=150).orderBy("position").collect()
    assert [r.id for r in got] == ["e0", "e1", "e2", "e4"] and len(got[-1].text) == 30
    parents = spark.createDataFrame([("p1", "A", "1/2000/X", "1", "gốc", [], []), ("p2", "B", "2/2000/X", "1", "sửa đổi Điều 1", ["1/2000/X|1||"], ["1/2000/X|1||"])], "id string, document_id string, document_number string, article string, text string, refs array<string>, amends array<string>")
    edges = {tuple(r) for r in R.citation_graph(parents).collect()}
    assert {("p2", "p1", "AMENDS"), ("p1", "p2", "AMENDED_BY"), ("doc:A", "p1", "CONTAINS")} <= edges
    near = R.graph_expand(spark.createDataFrame([(1, "p2", 1.0, 1)], "query_id int, node string, score double, rank int"), R.citation_graph(parents).withColumn("ord", F.lit(0)))
    assert [(r.node, r.relation, round(r.score, 2)) for r in near.collect()] == [("p1", "AMENDS", 0.72)]


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", ["x", "y", "z"], ["x", "y", "z"]), ("b", [], ["x"]), ("c", ["q"], ["x"]), ("d", ["x", "z", "y"], ["x", "y", "z"])], "id string, p array<string>, r array<string>")
    meteor = {r.id: r.meteor for r in M.meteor(pairs, "p", "r").collect()}
    rouge = {r.id: r.s for r in pairs.select("id", M.rouge_l(F.col("p"), F.col("r")).alias("s")).collect()}
    assert meteor["a"] > 0.98 and meteor["b"] == meteor["c"] == 0 and rouge["a"] == 1 and rouge["b"] == 0 and rouge["d"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        M.rouge_l(F.col("p"), F.col("r"), 0)
    m = M.retrieval_metrics(spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "query_id int, doc_id string, rank int"), spark.createDataFrame([(1, "a"), (2, "z")], "query_id int, doc_id string"), (1, 5)).orderBy("query_id").collect()
    assert (m[0].rr, m[0].recall_1, m[0].recall_5) == (0.5, 0, 1) and m[1].rr == 0


def test_hygiene(spark):
    ad = "Bạn phải đăng nhập hoặc đăng ký thành viên TVPL Pro để sử dụng được đầy đủ các tiện ích gia tăng liên quan đến nội dung TCVN. Mọi chi tiết xin liên hệ: ĐT: (028) 3930 3279 DĐ: 0906 22 99 66."
    body = " ".join(f"từ{i}" for i in range(60))
    assert one(spark, hygiene.recover_paywall, f"{body}\n{ad}\n{body}\n{ad}") == body
    tail = "x" * 900 + "\nNơi nhận:\n- Như trên;"
    assert one(spark, hygiene.without_routing, tail) == "x" * 900 and one(spark, hygiene.without_routing, "Nơi nhận:\n- a\n" + "y" * 900).startswith("Nơi nhận")
    rec = spark.createDataFrame([("g1",), ("g1",), ("g2",), ("g3",), ("g4",)], "group string")
    got = hygiene.group_split(rec, 2).collect()
    assert len(got) == 4 and 1 <= sum(r.records for r in got if r.split == "validation") <= 3
    comps = {r.node: r.component for r in connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, None)], "a long, b long")).collect()}
    assert set(comps.values()) == {0, 100} and len(comps) == 33
    signed = spark.createDataFrame([("a", 0), ("b", 7), ("c", -1), ("d", None)], "doc_id string, sig long")
    assert {r.doc_id for r in hygiene.near_groups(signed).collect()} == {"a", "b"}


def test_quality_and_evaluation(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 5)], "id string, n int")
    gate = {r.rule: r.broken for r in quality.gate(quality.violations(df, "id", {"small": F.col("n") < 3}), quality.repeated_keys(df, "id")).collect()}
    assert gate == {"small": 2, "unique_key": 1}
    with pytest.raises(ValueError):
        quality.eligible(df, [])
    p, e = spark.createDataFrame([("a", "q", "x"), ("b", "r", " "), ("z", "q", "x")], "id string, question string, answer string"), spark.createDataFrame([("a", "q"), ("b", "s"), ("c", "q")], "id string, question string")
    r = evaluation.validate_answers(p, e).first()
    assert (r.missing, r.extra, r.mismatched, r.blank) == (1, 1, 1, 1)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "map.json").write_text("\ufeff" + json.dumps({"1": {"question": "Hỏi\n gì?", "answer": "Đáp"}, "2": {"question": "b", "answer": None}}), "utf-8")
    (tmp_path / "lines.jsonl").write_text('{"question_id": "3", "question_model": "c", "answer_model": "d"}\n{"id": "4", "question": "e"}\n', "utf-8")
    (tmp_path / "list.json").write_text('[{"id": "5", "question": "f", "answer": "g"}]', "utf-8")
    rows = {r.id: (r.question, r.answer) for name in ("map.json", "lines.jsonl", "list.json") for r in readers.read_qa(spark, str(tmp_path / name)).collect()}
    assert rows == {"1": ("Hỏi gì?", "Đáp"), "2": ("b", None), "3": ("c", "d"), "4": ("e", None), "5": ("f", "g")}
    folder = tmp_path / "contexts"
    folder.mkdir()
    (folder / "context_90.json").write_text(json.dumps({"id": 90, "name": "", "link": "https://x.example/van-ban/luat-moi-12.aspx", "passage": "p"}), "utf-8")
    with zipfile.ZipFile(folder / "more.zip", "w") as z:
        z.writestr("a/context_91.json", json.dumps({"passage": "q"}))
        z.writestr("a/readme.txt", "no")
    got = {r.id: (r.name, r.json_valid) for r in readers.parse_contexts(readers.read_contexts(spark, str(folder))).collect()}
    assert got == {"90": ("luat moi", True), "91": ("Văn bản 91", True)}
    assert readers.contexts_digest(readers.read_contexts(spark, str(folder))).first().members == 2
    df = spark.createDataFrame([("1", "x"), ("2", None)], "id string, answer string")
    writers.write_lines(df, str(tmp_path / "out"))
    assert readers.read_lines(spark, str(tmp_path / "out"), schemas.QA).count() == 2
    blob = writers.answer_archive(df, df.select("id"))
    assert blob == writers.answer_archive(df, df.select("id"))
    with pytest.raises(ValueError):
        writers.answer_archive(df, df.select("id").limit(1))
    chunks = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, t string")
    assert writers.build_index(chunks, T.legal_tokens(F.col("t")), str(tmp_path / "index"), 2) == {"documents": 2, "postings": 3}


def test_streaming(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:00:00", "u", 1.0) for i in range(6)] + [(0, "2024-01-01 00:00:00", "u", 1.0)]
    spark.createDataFrame(rows, "k long, ts string, user string, value double").selectExpr("k", "CAST(ts AS TIMESTAMP) ts", "user", "value").write.parquet(str(tmp_path / "s"))
    schema = spark.read.parquet(str(tmp_path / "s")).schema
    stream = pipelines.stream_table(spark, str(tmp_path / "s"), schema)
    assert pipelines.run_to_memory(pipelines.first_seen(stream, "ts", F.col("k"), "5 hours"), "seen").count() == 6
    query = pipelines.ingest_postings(stream.select(F.col("k").alias("doc_id"), F.col("user").alias("t")), "t", str(tmp_path / "p"), str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "p")).count() >= 6

"""Releases, audits, answers, evaluation and settings on small fixtures: nulls, blanks, ties, repeated rows, empty tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tamarack.functions import text as T
from tamarack.operators import answering, evaluation, hygiene, quality, release
from tamarack.operators import ranking as R
from tamarack.plans.settings import Settings, settings_of
from tamarack.sources import readers, writers

LAW = "Luật mẫu\nĐiều 1. Phạm vi\n1. Một khoản đủ dài để không bị coi là ngắn, áp dụng cho mọi cơ quan nhà nước.\n2. Hai khoản đủ dài để không bị coi là ngắn, áp dụng cho mọi cơ quan nhà nước.\nĐiều 2. Hết"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_corpus_release(spark):
    docs = [("a", "Luật A", LAW, True), ("b", "Luật B", LAW.upper(), None), ("c", None, None, True), ("d", "D", "x", False), ("e", "E", "Không có điều nào. " * 30, True), ("a", "Luật A", LAW, True)]
    df = spark.createDataFrame(docs, "doc_id string, name string, text string, json_valid boolean").withColumn("status", F.lit(1))
    documents = release.release_documents(df)
    assert rows(documents, "doc_id", "status", "alias_of") == [("a", "INCLUDED", None), ("b", "exact_duplicate_alias", "a"), ("c", "empty_passage", None), ("d", "invalid_json", None), ("e", "INCLUDED", None)]
    chunks = release.corpus_chunks(documents, 120, 20)
    levels = {r["level"] for r in chunks.collect()}
    assert {"preamble", "fixed", "clause"} <= levels and chunks.select("fingerprint").distinct().count() == chunks.count()
    assert release.corpus_violations(documents, chunks).count() == 0
    broken = chunks.withColumn("doc_id", F.lit("zz"))
    assert {r.rule for r in release.corpus_violations(documents, broken).collect()} == {"chunk_document_included"}
    report = {(r.section, r["name"]): r.value for r in release.corpus_report(documents, chunks).collect()}
    assert report["status", "INCLUDED"] == 2 and report["quarantine", "empty_passage"] == 1
    assert release.corpus_chunks(release.release_documents(df.limit(0))).count() == 0
    index = release.clause_index(chunks.where("level IN ('clause', 'article_group', 'article')"))
    assert {"1", "2"} <= {r.clause for r in index.collect()}


def test_near_chunks(spark):
    text = " ".join(f"chữ{i % 37}" for i in range(60))
    data = [("d", "c1", None, 0, text), ("d", "c2", None, 1, text[:100] + "X" + text[101:]), ("d", "c3", "5", 2, text), ("e", "c4", None, 0, text), ("d", "c5", None, 3, None), ("d", "c6", None, 4, "ngắn")]
    df = spark.createDataFrame(data, "doc_id string, chunk_id string, article string, ordinal int, text string")
    assert rows(release.near_chunk_duplicates(df), "doc_id", "chunk_id", "kept_id") == [("d", "c2", "c1")]
    assert release.near_chunk_duplicates(df.limit(0)).count() == 0


def test_qa_release(spark):
    qa = [(f"q{i}", f"Mức phạt theo Điều {i}?", f"Trả lời {i}. (Hình từ Internet)", False) for i in range(6)] + [(f"r{i}", f"Thủ tục {'abcdef'[i]} gồm gì?", None if i == 0 else "Đơn.", False) for i in range(6)] + [("p", "Hỏi?", "không dùng", True), ("q0", "Mức phạt theo Điều 0?", "Trả lời 0. (Hình từ Internet)", False), (None, "x", "y", False)]
    df = spark.createDataFrame(qa, "id string, question string, answer string, public boolean")
    made = release.qa_release(df, 4)
    by = {r.question_id: r for r in made.collect()}
    assert len(by) == 13 and by["p"].split == "public" and by["p"].answer is None and by["q1"].changed and not by["r1"].changed
    assert len({by[f"q{i}"].split for i in range(6)}) == 1 and len({by[f"q{i}"].question_group for i in range(6)}) == 1
    assert release.qa_violations(made).count() == 0
    report = release.qa_report(made).first()
    assert (report.records, report.public, report.changed, report.empty_answers) == (12, 1, 6, 1)
    leaked = made.withColumn("split", F.when(F.col("question_id") == "q1", "validation").otherwise("train"))
    assert "no_question_group_overlap" in {r.rule for r in release.qa_violations(leaked).collect()}
    assert release.qa_release(df.limit(0), 4).count() == 0


def test_group_split_equals_a_fold(spark):
    import hashlib

    sizes = {f"g{i}": 1 + (i * 7) % 5 if i % 50 else 60 for i in range(400)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "group string")
    for target in (0, 1, 30, 300, 100_000):
        left, taken = target, set()
        for g in sorted(sizes, key=lambda g: hashlib.sha256(f"2026\0{g}".encode()).hexdigest()):
            if left > 0 and sizes[g] <= 2 * left:
                left -= sizes[g]
                taken.add(g)
        assert {r.group for r in hygiene.group_split(df, target).where("split = 'validation'").collect()} == taken


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(3)
    sigs = [rng.getrandbits(64) for _ in range(150)]
    sigs += [s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for s in sigs[:100]]
    signed = [s - (1 << 64) if s >> 63 else s for s in {*sigs, 0, (1 << 64) - 1}]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*signed, signed[0], None])], "doc_id int, sig long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert {tuple(r) for r in hygiene.near_pairs(df).collect()} == want and len(want) > 30


def test_contracts_and_guards(spark):
    t = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    contracts = {"t": release.TableContract(required=("a", "z"), forbidden=("b",), expected={"a": 1}, least_rows=3), "gone": release.TableContract()}
    assert rows(release.contract_violations({"t": t}, contracts), "rule", "key") == [("expected_value", "t.a"), ("forbidden_column", "t.b"), ("least_rows", "t"), ("present", "gone"), ("required_column", "t.z")]
    q = spark.createDataFrame([("a b", "x", 5), ("c", "y" * 3000, 0), ("d", None, None), ("d", "ok", 1)], "query_id string, text string, k int")
    assert rows(quality.query_violations(q), "rule", "key") == [("k_in_range", "c"), ("k_in_range", "d"), ("query_id_plain", "a b"), ("query_id_unique", "d"), ("query_text_bounded", "c"), ("query_text_present", "d")]
    docs = spark.createDataFrame([("1", "t", "x", "s", "public"), ("1", None, " ", "s", "public")], "doc_id string, title string, text string, source string, access_scope string")
    assert rows(readers.document_violations(docs), "rule", "key") == [("document_id_unique", "1"), ("text_present", "1"), ("title_present", "1")]
    assert readers.question_violations(spark.createDataFrame([("1", "q"), ("2", " ")], "id string, question string")).count() == 1
    assert release.next_step("direct", {"release": "PASS"}) == ("READY_TO_ADVANCE", "tokenizer") and release.next_step("direct", dict.fromkeys(release.STEPS["direct"], "PASS")) == ("COMPLETE", None)
    assert release.next_step("retrieval", {"release": "PASS", "tokenizer": "PASS"}, running=True) == ("BLOCKED", "index")
    with pytest.raises(ValueError):
        release.next_step("other", {})
    assert settings_of('{"retrieval": {"ks": [2, 3, 4]}}').retrieval.ks == (2, 3, 4)
    for bad in ('{"chunking": {"overlap_chars": 1800}}', '{"labels_may_train": true}', '{"retrieval": {"ks": [5, 3, 8]}}', "[]"):
        with pytest.raises(ValueError):
            settings_of(bad)
    with pytest.raises(TypeError):
        Settings(unknown=1)


def test_labels_for_answers_only(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4, 5, 6], 5), ([1, 9], [1, 2, 3], 5), ([7], [1, 2], 5), ([1, 2], [1, 2], 5), ([1, 2], [1, 2, 3], 2), (None, [1], 5)], "p array<int>, f array<int>, m int")
    got = [r.x for r in df.where("m = 5").select(release.answer_only_labels(F.col("p"), F.col("f"), 5).alias("x")).collect()]
    assert (got[0]["labels"], got[0].target_tokens, got[0].truncated) == ([-100, -100, -100, 4, 5], 3, 1) and got[1]["labels"] == [-100, 2, 3] and got[2:] == [None, None, None]
    assert df.where("m = 2").select(release.answer_only_labels(F.col("p"), F.col("f"), 2).alias("x")).first().x is None


def test_answers(spark):
    asked = spark.createDataFrame([(1, "Mức phạt là gì?"), (2, "So sánh luật A và luật B khác nhau gì?"), (3, None)], "query_id int, text string")
    ranked = spark.createDataFrame([(1, "c1", 0.9, 1), (1, "c2", 0.8, 2), (1, "c3", 0.7, 3), (2, "c2", 0.9, 1), (2, "c1", 0.5, 2)], "query_id int, doc_id string, score double, rank int")
    chunks = spark.createDataFrame([("c1", "p1", "a" * 30, "phần một"), ("c2", "p1", "a" * 30, "x"), ("c3", "p2", "b" * 90, "c" * 50), ("c4", None, None, None)], "doc_id string, parent_id string, parent_text string, retrieval_text string")
    got = answering.parent_contexts(ranked, chunks, 5, 60)
    assert rows(got.where("query_id = 1"), "position", "chunk_id", "text") == [(0, "c1", "a" * 30), (1, "c3", "c" * 30)]
    with pytest.raises(ValueError):
        answering.parent_contexts(ranked, chunks, 0)
    traced = {r.query_id: r for r in answering.provided_evidence(asked, ranked, chunks, 2).collect()}
    assert traced[3].evidence == "" and traced[3].chars == 0 and traced[1].considered == 2 and traced[1].parents == ["p1"]
    excerpts = spark.createDataFrame([("c1", "một"), ("c2", "hai"), ("c3", None)], "doc_id string, excerpt string")
    agent = {r.query_id: r for r in answering.agent_answers(asked, ranked, excerpts).collect()}
    assert agent[1].route == "lookup" and agent[1].answer == "một [c1]" and agent[1].citations == ["c1", "c2", "c3"]
    assert agent[2].route == "compare" and agent[2].answer == "Comparison evidence:\n- hai [c2]\n- một [c1]" and agent[3].abstained and agent[3].citations == []
    evidence = spark.createDataFrame([(1, 1, "Mức phạt là năm triệu đồng cho mỗi lần. Ngắn. Câu này không liên quan gì đến điều đã hỏi."), (1, 2, "Mức phạt tăng gấp đôi nếu tái phạm nhiều lần."), (2, 1, None)], "query_id int, position int, text string")
    answers = {r.query_id: r.answer for r in answering.extractive_answers(asked, evidence, T.legal_tokens, per=2).collect()}
    assert answers == {1: "Mức phạt là năm triệu đồng cho mỗi lần. Mức phạt tăng gấp đôi nếu tái phạm nhiều lần.", 2: "", 3: answering.NO_ANSWER}
    results, status = answering.search(asked, {"a": ranked, "b": ranked.limit(0)}, k=1)
    assert rows(results, "query_id", "doc_id") == [(1, "c1"), (2, "c2")] and rows(status, "query_id", "channel", "state") == [(1, "a", "ok"), (1, "b", "skipped"), (2, "a", "ok"), (2, "b", "skipped"), (3, "a", "skipped"), (3, "b", "skipped")]
    answered = spark.createDataFrame([("c1", "đáp một"), ("c2", None)], "doc_id string, answer string")
    near = answering.neighbour_answers({"a": ranked}, answered)
    assert rows(near, "query_id", "neighbour_id", "answer") == [(1, "c1", "đáp một"), (2, "c2", None)]
    vector = answering.hashed_vectors(spark.createDataFrame([(1, ["a", "a", "b"]), (2, None)], "doc_id int, t array<string>"), F.col("t"), 8).orderBy("doc_id").collect()
    assert sum(vector[0].vector) == 3 and sum(vector[1].vector) == 0


def test_evaluation_reports(spark):
    expected = spark.createDataFrame([("a", "Mức phạt?", "Theo Điều 5 mức phạt là 10 triệu."), ("b", "Là gì?", "một hai ba"), ("c", None, None)], "id string, question string, answer string")
    predicted = spark.createDataFrame([("a", "Theo Điều 5 mức phạt là 10 triệu."), ("z", "thừa")], "id string, answer string")
    scored = evaluation.scored_cases(evaluation.answer_cases(predicted, expected))
    by = {r.id: r for r in scored.collect()}
    assert by["a"].rouge_l == 1 and by["b"].meteor == 0 and "EMPTY_ANSWER" in by["b"].errors and len(by) == 3
    report = {(r.section, r["name"]): r.n for r in evaluation.answer_report(scored).collect()}
    assert report["slice", "overall"] == 3 and report["error", "EMPTY_RATE"] == 2
    new, old = spark.createDataFrame([(i, float(i)) for i in range(9)], "id int, score double"), spark.createDataFrame([(i, 4.0) for i in range(9)], "id int, score double")
    sides = evaluation.best_and_worst(new, old, top=2)
    assert rows(sides, "side", "position", "id", "delta") == [("gain", 1, 8, 4.0), ("gain", 2, 7, 3.0), ("loss", 1, 0, -4.0), ("loss", 2, 1, -3.0)]
    ranking = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2), (1, "w", 0.7, 3)], "query_id int, doc_id string, score double, rank int")
    parents = spark.createDataFrame([("x", "p"), ("y", "q"), ("z", "q")], "doc_id string, parent_id string")
    hits = evaluation.relevant_hits(ranking, spark.createDataFrame([(1, "x")], "query_id int, doc_id string"), spark.createDataFrame([(1, "q")], "query_id int, parent_id string"), parents)
    assert rows(hits, "doc_id", "relevant") == [("w", False), ("x", True), ("y", True)]
    values = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 3), ("b", None)], "g string, v int")
    assert rows(evaluation.floor_percentiles(values, ["g"], "v", (0.0, 0.5, 1.0)), "g", "share", "value") == [("a", 0.0, 1), ("a", 0.5, 1), ("a", 1.0, 9), ("b", 0.0, 3), ("b", 0.5, 3), ("b", 1.0, 3)]
    clash = values.withColumnsRenamed({"g": "c", "v": "n"})
    assert rows(evaluation.floor_percentiles(clash, ["c"], "n", (0.5,)), "c", "share", "value") == [("a", 0.5, 1), ("b", 0.5, 3)]
    labels = spark.createDataFrame([("a", "c1", "HIGH"), ("a", "c2", "LOW"), ("a", "c1", "HIGH")], "question_id string, chunk_id string, confidence string")
    answers = spark.createDataFrame([("a",), ("b",), ("c",)], "question_id string")
    cover = release.label_coverage(answers, answers.where("question_id <> 'c'"), labels).first()
    assert (cover.answers, cover.with_citations, cover.matched_high, cover.unmatched, cover.pairs) == (3, 2, 1, 1, 2)
    cited = spark.createDataFrame([("a", "1/2000", "5"), ("b", "9/2000", "5"), ("c", None, "5")], "question_id string, number string, article string")
    held = spark.createDataFrame([("p", "1/2000", "5")], "parent_id string, number string, article string")
    assert rows(release.diagnostic_labels(answers.union(spark.createDataFrame([("d",)], "question_id string")), cited, held), "question_id", "status") == [("a", "matched"), ("b", "document_or_article_not_found"), ("c", "citation_without_document_number"), ("d", "no_citation")]


def test_reports_of_repetition(spark):
    block = "đoạn văn này lặp lại nhiều lần trong cùng một văn bản và đủ dài để được coi là có nội dung thật sự"
    docs = spark.createDataFrame([("a", "\n\n".join([block] * 6)), ("b", "ngắn"), ("c", None)], "doc_id string, text string")
    assert rows(release.repeated_blocks(docs, "text", least=60), "doc_id", "position", "times") == [("a", 1, 6)]
    lengths = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), (F.col("doc_id") == "b").alias("paywalled"))
    ordered = [(r.doc_id, r.severity) for r in release.corruption_order(hygiene.repetition(docs, "text", 60), lengths).collect()]
    assert ordered == [("b", "CRITICAL"), ("a", "REVIEW"), ("c", "OK")]
    line = "Trang chủ > Văn bản > Nghị định mới nhất"
    shared = spark.createDataFrame([(str(i), f"{line}\nriêng {i}") for i in range(4)], "doc_id string, text string")
    audit = {(r.section, r["name"]): r.value for r in release.sanitation_audit(shared, "text", [], [], ["trang chủ > .*"]).collect()}
    assert audit["shared_line", "blacklist"] == 1 and audit["severity", "OK"] == 4
    batches = release.length_batches(shared, "text", "doc_id", 3)
    assert batches.count() == 4 and max(r["count"] for r in batches.groupBy("part", "batch").count().collect()) <= 3
    low = {r.line: r.d for r in spark.createDataFrame([("Xin chào", "manual_review"), ("......", "manual_review"), ("x", "blacklist"), (None, "manual_review")], "line string, class string").select("line", release.review_decision(F.col("line"), F.col("class"), ["xin chào"], [], r"\.+", "ký tên", "nơi nhận").alias("d")).collect()}
    assert low == {"Xin chào": "keep_conservative_header_fragment", "......": "keep_form_placeholder", "x": "remove_retrieval_reviewed_blacklist", None: "keep_legal_or_ambiguous"}


def test_archives_and_files(spark, tmp_path):
    writers.write_json(str(tmp_path / "a" / "x.json"), {"k": "đ"})
    assert json.loads((tmp_path / "a" / "x.json").read_text("utf-8")) == {"k": "đ"} and [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"]
    answers = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, answer string")
    assert writers.check_archive(writers.answer_archive(answers, answers.select("id")), {"1", "2"}) == []

    def packed(text, name="results.json"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, text)
        return out.getvalue()

    assert writers.check_archive(packed('{"1": {"answer": " "}, "1": {"answer": "x", "q": 1}, "3": {"answer": "z"}}'), {"1", "2"}) == ["repeated 1", "missing 2", "unknown 3", "fields of 1"]
    assert writers.check_archive(packed('﻿{"1": {"answer": ""}}'), {"1"}) == ["byte-order mark", "blank 1"] and writers.check_archive(packed("[]"), set()) == ["not an object"] and "members" in writers.check_archive(packed("{}", "other"), set())[0]
    docs = spark.createDataFrame([(1, [3.0, 4.0])], "doc_id int, v array<double>")
    for _ in range(2):
        writers.append_vectors(spark, docs.union(spark.createDataFrame([(2, [0.0, 0.0])], docs.schema)), F.col("v"), str(tmp_path / "vectors"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "vectors")).collect()) == [1, 2]


def test_index_and_its_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b a", True), (2, "b", True), (3, "c", False), (4, None, True)], "doc_id int, t string, ok boolean")
    path = str(tmp_path / "index")
    writers.build_index(chunks, T.legal_tokens(F.col("t")), path, 2, parents=chunks.select(F.col("doc_id").alias("parent_id")), indexable=F.col("ok"))
    assert writers.index_violations(spark, path).count() == 0 and spark.read.parquet(f"{path}/chunks").count() == 3
    assert writers.look_up(spark, path, spark.createDataFrame([(7, 2)], "query_id int, doc_id int")).first().t == "b"
    spark.createDataFrame([(9,)], "parent_id int").write.mode("append").parquet(f"{path}/parents")
    assert rows(writers.index_violations(spark, path), "rule", "key") == [("count_matches_manifest", "parents"), ("digest_matches_manifest", "parents")]


def test_headings_models_and_table_functions(spark, tmp_path):
    from tamarack.functions import table_functions
    from tamarack.operators import chunking
    from tamarack.sources import schemas

    text = "Chương I\nMục 1\nĐiều 1. A\nMục 2\nĐiều 2. B\nChương II\nĐiều 3. C"
    docs = spark.createDataFrame([("d", text), ("n", None), ("e", "")], "doc_id string, t string")
    assert [(r.article, r.chapter, r.section) for r in chunking.headings(docs, "t").orderBy("line_no").collect()] == [("1", "i", "1"), ("2", "i", "2"), ("3", "ii", None)]
    table_functions.register(spark)
    docs.createOrReplaceTempView("udtf_docs")
    assert [(r.article, r.body) for r in spark.sql("SELECT c.* FROM udtf_docs d, LATERAL legal_articles(d.t) c WHERE d.doc_id = 'd' ORDER BY ordinal").collect()][1] == ("1", "Điều 1. A\nMục 2")
    assert spark.sql("SELECT count(*) FROM udtf_docs d, LATERAL text_windows(d.t, 20, 5) c").first()[0] > 3
    ranking = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2)], "query_id int, doc_id string, score double, rank int")
    again = R.model_rerank(ranking, spark.createDataFrame([(1, "q")], "query_id int, text string"), spark.createDataFrame([("x", None), ("y", "dài")], "doc_id string, text string"), lambda q, d: [len(t) - 1 for t in d]).orderBy("rank").collect()
    assert [r.doc_id for r in again] == ["y", "x"] and again[0].score == pytest.approx(1 / (1 + 2.718281828459045**-2))
    (tmp_path / "l.jsonl").write_text('{"id": "1", "question": "a"}\n\nkhông phải\n{"id": "2"}\n', "utf-8")
    assert rows(readers.line_failures(spark, str(tmp_path / "l.jsonl"), schemas.QA), "line_no", "line") == [(3, "không phải")]
    found = spark.createDataFrame([("a", ["1", "1"]), ("b", []), ("c", ["x"]), ("c", ["y"]), ("d", None)], "id string, found array<string>")
    assert rows(quality.id_list_violations(found), "rule", "key") == [("answer_id_unique", "c"), ("ids_present", "b"), ("ids_present", "d"), ("ids_unique", "a")]
    window = spark.createDataFrame([("x" * 100 + "neo" + "y" * 100, "neo", "Đầu")], "p string, b string, h string").select(T.anchored_window(F.col("p"), F.col("b"), 40, heading=F.col("h")).alias("w")).first().w
    assert window.startswith("Đầu\nx") and "neo" in window and len(window) == 40
    ad = "Bạn phải đăng nhập hoặc đăng ký thành viên TVPL Pro để sử dụng được đầy đủ các tiện ích gia tăng liên quan đến nội dung TCVN. Mọi chi tiết xin liên hệ: ĐT: (028) 3930 3279 DĐ: 0906 22 99 66."
    pages = spark.createDataFrame([("a", f"một\n{ad}\nhai\n{ad}"), ("b", None)], "doc_id string, t string")
    assert rows(hygiene.paywall_fragments(pages, "t"), "doc_id", "position", "fragment") == [("a", 0, "một"), ("a", 1, "hai")]
    clean = {r.doc_id: r for r in hygiene.sanitize(pages, "t", [], [], []).collect()}
    assert "paywall_artifact" in clean["a"].sanitation_flags and clean["b"].sanitation_flags == [] and hygiene.sanitation_totals(hygiene.sanitize(pages, "t", [], [], [])).first().changed == 1


def test_ranking_in_blocks(spark):
    import random

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, [rng.choice("abcdefghij") for _ in range(rng.randrange(12))]) for i in range(200)] + [(900, None), (901, [])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(f"q{i}", t, 1 + i % 2) for i in range(30) for t in rng.sample("abcdefghijxyz", 3)], "query_id string, token string, qtf long")
    for rank in (R.bm25, R.tfidf):
        whole, parts = (sorted(map(tuple, rank(docs, asked, 7, block=b).collect())) for b in (1000, 4))
        assert whole == parts and len(whole) == 30 * 7
    posts = docs.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, R.bm25(posts, asked, 7).collect())) == sorted(map(tuple, R.bm25(docs, asked, 7).collect()))
    assert R.bm25(docs, asked.limit(0)).count() == 0 and R.tfidf(docs.limit(0), asked).count() == 0


def test_inverted_file_reaches_its_recall(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    points = centres[rng.integers(12, size=1500)] + 0.6 * rng.normal(size=(1500, 16))
    vectors = spark.createDataFrame([(f"d{i}", p.tolist()) for i, p in enumerate(points)] + [("none", None)], "doc_id string, vector array<double>")
    asked = vectors.where("doc_id LIKE '%0'").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in R.nearest(vectors, asked).collect()}
    for rows in (50_000, 40):  # whole cells, and cells cut into parts
        monkeypatch.setattr(R, "CELL_ROWS", rows)
        found = R.nearest_in_cells(vectors, asked, cells=12, probes=4).collect()
        assert len(exact & {(r.query_id, r.doc_id) for r in found}) >= 0.9 * len(exact) and {r["rank"] for r in found} == set(range(1, 11))
    every = R.nearest_in_cells(vectors, asked, cells=12, probes=12)
    assert {(r.query_id, r.doc_id) for r in every.collect()} == exact
    assert R.nearest_in_cells(vectors.limit(0), asked).count() == 0

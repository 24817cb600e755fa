"""Queries over whole tables, against plain Python on fixtures with the rows that their SQL counterparts leave out."""

import hashlib
import html
import re
import unicodedata

from pyspark.sql import functions as F

from tamarack.functions import metrics as M
from tamarack.functions import text as T
from tamarack.operators import ranking as R
from tamarack.plans import rank_queries
from tamarack.plans.catalogue import QUERIES


def written(spark, root, name, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{root}/{name}.parquet")


def group_of(question):
    t = unicodedata.normalize("NFC", question or "").casefold()
    t = re.sub(r"\b\d{1,5}\s*/\s*(?:\d{4}|[a-zđ]{1,8})\s*/\s*[a-zđ0-9 -]{2,30}\b", " <docnum> ", t, flags=re.IGNORECASE)
    t = re.sub(r"\b\d+(?:[.,]\d+)*\b", " <num> ", t)
    t = " ".join(re.sub(r"[^0-9a-zà-ỹđ<>]+", " ", t, flags=re.IGNORECASE).split())
    return "QG_" + hashlib.sha256(t.encode()).hexdigest()[:12].upper()


def test_question_group_of_all_questions(spark, tmp_path):
    rows = [("a", "Nghị định 90/2017/NĐ-CP, mức phạt?"), ("b", "Nghị định 12 / 2021 / nđ - cp, mức phạt?"), ("c", "Mẫu 3B năm 2020 là gì?"), ("d", "“Điều” 5 – thế nào…?"), ("e", "Lương 1.500.000đ ß"), ("f", None), ("g", "Điều 5"), ("h", "Luật 45/QH/14 quy định gì?"), ("i", "trị giá 34.11\u200c1.000 đồng, chậm \u200d30 máy"), ("j", "số 1600/2022/TTLT-BMT\u200d, mức")]
    written(spark, tmp_path, "qa_examples", rows, "id string, question string")
    got = {r.id: r.question_group for r in QUERIES["f13_question_group"](spark, str(tmp_path)).collect()}
    assert got == {k: group_of(q) for k, q in rows}
    assert got["a"] == got["b"] != got["g"]


def spans_of(text, most=1800, overlap=220):
    """Windows by scanning single characters."""
    inner = [i for i, c in enumerate(text) if not c.isspace()]
    out, at = [], inner[0] if inner else 0
    stop = inner[-1] + 1 if inner else 0
    while at < stop:
        until = min(stop, at + most)
        if until < stop:
            until = max((i for i in range(at + most * 6 // 10, until) if text[i] in "\n "), default=until)
        held = [i for i in range(at, until) if not text[i].isspace()]
        out += [(held[0], held[-1] + 1)] if held else []
        if until == stop:
            break
        at = next(i for i in range(max(at + 1, until - overlap), stop) if not text[i].isspace())
    return out


def test_window_spans_of_long_passages(spark, tmp_path):
    long = "\n".join(f"Điều {i}. " + " ".join(f"từ{(i * j) % 97}" for j in range(i % 60)) for i in range(1, 120))
    texts = {"long": long, "outer": f" \n{long}\n ", "solid": "x" * 5000, "astral": "𝒳y " * 1500, "spaces": "a" + " " * 4000 + "b", "short": "Điều 1.", "edge": "z" * 1800, "over": "z " * 901, "blank": "  \n", "none": None}
    rows = [*texts.items(), ("long", long)]
    written(spark, tmp_path, "legal_documents", rows, "id string, passage string")
    got = sorted(tuple(r) for r in QUERIES["e03_window_spans"](spark, str(tmp_path)).collect())
    assert got == sorted((k, n, a, b, t[a:b]) for k, t in texts.items() if t for n, (a, b) in enumerate(spans_of(t)))
    spans = [(a, b) for k, _, a, b, _ in got if k == "long"]
    assert len(spans) > 5 and all(0 < b - c <= 220 for (_, b), (c, _) in zip(spans, spans[1:]))


def test_citation_labels_of_three_levels(spark, tmp_path):
    law = "Mở đầu\nĐiều 5. Phạm vi\n1. Một\na) x\nb) y\n2. Hai\nĐiều 6. Hết"
    docs = [("A", law, ("90/2017/NĐ-CP",)), ("B", "Điều 5. Khác\n1. Một", (None,)), ("C", "Điều 7. Ngắn", ("12/2019",))]
    written(spark, tmp_path, "legal_documents", [*docs, docs[0]], "id string, passage string, metadata struct<document_number: string>")
    answers = {
        "point": "Theo điểm b khoản 1 Điều 5 Nghị định 90/2017/NĐ-CP.", "no_point": "Theo điểm c khoản 1 Điều 5 Nghị định 90/2017/NĐ-CP.", "clause": "Theo khoản 2 Điều 5 Nghị định 90 / 2017 / nđ - cp.",
        "no_clause": "Theo khoản 9 Điều 5 Nghị định 90/2017/NĐ-CP.", "article": "Theo Điều 6 Nghị định số 90/2017/NĐ-CP.", "bare": "Theo khoản 1 Điều 5.", "only_point": "Theo điểm b Điều 5 Nghị định 90/2017/NĐ-CP.", "short": "Theo Điều 7 số 12/2019.", "null": None,
    }
    written(spark, tmp_path, "qa_examples", list(answers.items()), "id string, answer string")
    got = {}
    for r in QUERIES["h10_citation_labels"](spark, str(tmp_path)).collect():
        got.setdefault((r.question_id, r.confidence, r.match_reason), set()).add(r.chunk_id)
    five, one = "doc_A_article_5_0", "doc_A_article_5_0_clause_1"
    every = {five, one, f"{one}_point_a", f"{one}_point_b", f"{five}_clause_2"}
    assert got == {
        ("point", "HIGH", "point_match"): {f"{one}_point_b"}, ("no_point", "HIGH", "clause_match"): {one, f"{one}_point_a", f"{one}_point_b"}, ("clause", "HIGH", "clause_match"): {f"{five}_clause_2"},
        ("no_clause", "MEDIUM", "article_match"): every, ("only_point", "MEDIUM", "article_match"): every, ("article", "MEDIUM", "article_match"): {"doc_A_article_6_0"}, ("short", "MEDIUM", "article_match"): {"doc_C_article_7_0"},
    }
    cited = {tuple(r) for r in QUERIES["r08_cited_chunks"](spark, str(tmp_path)).collect()}
    assert ("short", "doc_C_article_7_0") in cited and not {q for q, _ in cited} & {"bare", "null"}


def normal(text, lines=True):
    t = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if re.search(r"(?i)</?(?:table|tr|td|th|p|div|br|li|ul|ol)\b", t):
        t = re.sub(r"(?i)<li\b[^>]*>", "\n- ", re.sub(r"(?i)</?(?:td|th)\b[^>]*>", " | ", t))
        t = re.sub(r"(?i)</?(?:p|div|tr)\b[^>]*>|</li>|<(?:br|ul|ol)\b[^>]*>", "\n", t)
        t = re.sub(r"</?[A-Za-z][^>]*>", "", t)
    t = unicodedata.normalize("NFC", html.unescape(t))
    t = re.sub("[•●▪]", "- ", re.sub("[​‌‍﻿]", "", t))
    t = "\n".join(x.strip() for x in re.sub(r"[^\S\r\n]+", " ", t).split("\n"))
    t = re.sub(r"\n\s*\n\s*\n+", "\n\n", t).strip()
    t = re.sub(r"(?i)\b(\d{1,5})\s*/\s*(\d{4})\s*/\s*([A-ZĐ]+)\s*-\s*([A-ZĐ]+)\b", lambda m: f"{m[1]}/{m[2]}/{m[3].upper()}-{m[4].upper()}", t)
    return t if lines else " ".join(t.split())


def sanitized(text):
    note = r"\((?:Hình từ Internet|Ảnh minh họa)\)"
    t = re.sub(r"(?s)(?:…\s*){2,}\.?\s*.*$", "", normal(text))
    t = re.sub(rf"(?is)\n\s*\n[^\n]{{1,300}}?\s*{note}\s*$", "", t)
    t = "\n".join(re.sub(r"[ \t ]+", " ", x).rstrip() for x in re.sub(rf"(?i){note}", "", t).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


ODD = [
    "Theo 90 / 2017 / nđ - cp và 12/2021/ NĐ-CP", "<p>a</p><ul><li>b &amp; c</li></ul><table><tr><td>x</td></tr></table>", "x​y ‍﻿ • một\n● hai ▪ ba", "Straße &lt; ß Ǆ ΣΑΣ", "é a  b\t c", "a\r\n\r\n \n\n\nb\r c ", "5 < 6 và 7 > 2",
    "Đáp án.\n\nẢnh chụp (Hình từ Internet)", "Một (Ảnh minh họa) hai  ba\n\n\nbốn", "Xong… … Xem thêm: khác\nnữa", "Không chú thích.", "", None, "1. (HÌNH TỪ INTERNET)\nĐiều 1", "Số 1 / 2020 / tt - btc\n\nHình (Hình từ Internet) \n",
]


def test_normal_forms_of_all_texts(spark, tmp_path):
    rows = [(str(i), t) for i, t in enumerate(ODD)]
    for name, kind in (("legal_documents", "id string, passage string"), ("documents", "doc_id string, text string"), ("qa_examples", "id string, answer string")):
        written(spark, tmp_path, name, rows, kind)
    run = lambda name: dict(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("f01_normalize_text") == {k: normal(t) for k, t in rows}
    assert run("f22_sanitize_answer") == {k: sanitized(t) for k, t in rows}
    assert run("f04_canonical_text") == {k: normal(t, False).casefold() for k, t in rows}
    assert run("f05_fingerprint") == {k: hashlib.sha256(normal(t, False).casefold().encode()).hexdigest() for k, t in rows}


def most_rows(df):
    """Rows of the largest step of a plan, after it has run."""
    df.collect()

    def walk(node):
        inner = {"AdaptiveSparkPlanExec": "finalPhysicalPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan"}.get(node.getClass().getSimpleName())
        rows = node.metrics().get("numOutputRows")
        below = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
        return max([rows.get().value() if rows.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def documents(spark, root, count=600):
    rows = [(i, f"một{i % 7} hai{i % 11} ba{i % 5}", f"Một{i % 3} hai" if i % 200 else None, "a" if i % 3 else "b") for i in range(1, count + 1)]
    written(spark, root, "documents", rows, "doc_id long, text string, title string, source string")


def test_retrieval_metrics_without_pairs(spark, tmp_path):
    documents(spark, tmp_path)
    got = QUERIES["a17_retrieval_metrics"](spark, str(tmp_path))
    assert most_rows(got) < 1_000  # the pairs of queries and documents of their source are 10,000 and grow with the square
    ranking = rank_queries._bm25(spark, str(tmp_path))
    pairs = rank_queries._judged(spark, str(tmp_path))
    want = M.retrieval_metrics(ranking, pairs, (1, 5, 10)).agg(F.round(F.avg("rr"), 6), F.round(F.avg("recall_5"), 6), F.round(F.avg("hit_5"), 6))
    assert tuple(got.first()) == tuple(want.first())


def test_equal_queries_are_scored_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"t{i % 4}", "all"]) for i in range(300)], "doc_id long, tokens array<string>").repartition(2)
    asked = spark.createDataFrame([(q, t, 1) for q in range(90) for t in ("all", f"t{q % 3}")], "query_id long, token string, qtf long")
    sent, top = [], R.top_k
    monkeypatch.setattr(R, "top_k", lambda scored, *a: sent.append(scored.count()) or top(scored, *a))
    monkeypatch.setattr(R, "CELLS", 64)  # some documents at a time
    got = R.bm25(docs, asked, 5)
    assert sent == [2 * 3 * 5]  # parts, different queries, and the best of them
    first = {q: [(r.doc_id, r["rank"]) for r in got.where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 88)}
    assert first[1] == first[88] == [(1 + 4 * i, i + 1) for i in range(5)] and got.count() == 90 * 5


def test_tokens_are_those_of_the_normal_form(spark):
    parts = ["12/2017/NĐ-CP", " 12 / 2017 / nđ\xa0- cp", "12/2017/", "•A", "▪", "\r\n", "\u1680", "\u200b", "a\u0301", "ΑΣ", "İ", "ẞ", "<br>", "&amp;", "x9", "\u2028", "–", "\x85"]
    texts = spark.createDataFrame([(a + b + c,) for a in parts for b in parts for c in ("", "từ", "/2017")] + [(None,)], "t string")
    whole = F.regexp_extract_all(T.normalize_text(F.col("t"), keep_lines=False), F.lit(T.LEGAL_TOKEN), F.lit(0))
    want = F.transform(whole, lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss")))
    assert texts.where(~T.legal_tokens(F.col("t")).eqNullSafe(want)).count() == 0


def test_boosted_fusion_ranks_once(spark, tmp_path):
    documents(spark, tmp_path)
    got = QUERIES["r08_boosted_fusion"](spark, str(tmp_path))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # the boost reads the fused ranking twice
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    want = {}
    for r in rank_queries._fused(spark, str(tmp_path), 1 << 30).collect():
        score = r.score * (1.24 if source[r.query_id] == source[r.doc_id] else 1)
        want.setdefault(r.query_id, []).append((-round(score, 12), r.doc_id))
    want = {(q, d): n + 1 for q, found in want.items() for n, (_, d) in enumerate(sorted(found)[:10])}
    assert {(r.query_id, r.doc_id): r["rank"] for r in got.collect()} == want


def test_equal_queries_of_the_cosine_are_scored_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"t{i % 4}", "all"]) for i in range(300)], "doc_id long, tokens array<string>").repartition(2)
    asked = spark.createDataFrame([(q, t, 1 + (q > 60)) for q in range(90) for t in ("all", f"t{q % 3}")], "query_id long, token string, qtf long")
    sent, top = [], R.top_k
    monkeypatch.setattr(R, "top_k", lambda scored, *a: sent.append(scored.count()) or top(scored, *a))
    got = R.tfidf(docs, asked, 5)
    assert sent == [2 * 6 * 5]  # parts, different queries, and the best of them
    assert [r.doc_id for r in got.where("query_id = 88").orderBy("rank").collect()] == [1 + 4 * i for i in range(5)] and got.count() == 90 * 5

"""Queries of releases, audits, answers and reports, with SQL where it can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import citations as C
from tamarack.functions import text as T
from tamarack.operators import answering, chunking, evaluation, hygiene, quality, release
from tamarack.operators import ranking as R
from tamarack.plans import rank_queries as RQ
from tamarack.plans.text_queries import LINES, WS, canonical_sql, legal_sql, normal_sql, sanitized_sql, w
from tamarack.session import materialise, spread_table, table
from tamarack.sources import readers

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Contracts of inputs


@query("WITH r AS (SELECT doc_id, unnest(list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'title_present' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'text_present' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source_present' END, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'access_scope_present' END], lambda x: x IS NOT NULL)) AS rule FROM documents) SELECT rule, CAST(doc_id AS VARCHAR) AS key FROM r UNION ALL SELECT 'document_id_unique', CAST(doc_id AS VARCHAR) FROM documents GROUP BY doc_id HAVING count(*) > 1")
def s09_document_contract(spark, root):
    return readers.document_violations(table(spark, root, "documents").withColumn("access_scope", F.col("lang")))


@query("SELECT 'question_id_unique' AS rule, query_id AS key FROM task2_warmup GROUP BY query_id HAVING count(*) > 1 UNION ALL SELECT 'question_present', query_id FROM task2_warmup WHERE trim(coalesce(question, '')) = ''")
def s10_question_contract(spark, root):
    return readers.question_violations(table(spark, root, "task2_warmup").withColumnRenamed("query_id", "id"))


@query("WITH q AS (SELECT id AS query_id, question AS text, length(question) % 120 AS k FROM qa_examples) SELECT 'query_text_bounded' AS rule, query_id AS key FROM q WHERE length(coalesce(text, '')) > 300 UNION ALL SELECT 'k_in_range', query_id FROM q WHERE k IS NULL OR k NOT BETWEEN 1 AND 100 UNION ALL SELECT 'query_id_unique', query_id FROM q GROUP BY query_id HAVING count(*) > 1")
def pred13_query_guards(spark, root):
    q = spread_table(spark, root, "qa_examples").select(F.col("id").alias("query_id"), F.col("question").alias("text"), (F.length("question") % 120).alias("k"))
    return quality.query_violations(q, most_chars=300)


# Filters and decisions

_SHARED = "WITH l AS (SELECT id, lower(trim(regexp_replace(unnest(string_split(generation_text, chr(10))), '\\s+', ' ', 'g'))) AS line FROM legal_documents), k AS (SELECT DISTINCT id, line FROM l WHERE length(line) BETWEEN 20 AND 500), f AS (SELECT line, count(*) AS docs FROM k GROUP BY line HAVING count(*) >= greatest(2, ceil(0.01 * (SELECT count(DISTINCT id) FROM legal_documents))))"
_CLASS = "CASE WHEN regexp_matches(line, 'điều \\d+|khoản \\d+') THEN 'protected' WHEN regexp_matches(line, '^(?:trang chủ > .*|tổng đài hỗ trợ .*)$') THEN 'blacklist' ELSE 'manual_review' END"
_RULES = (["điều \\d+", "khoản \\d+"], [], ["trang chủ > .*", "tổng đài hỗ trợ .*"])


def _candidates(spark, root) -> DataFrame:
    lines = hygiene.line_frequencies(spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "generation_text"), "generation_text", report=None)
    return lines.withColumn("class", hygiene.classify_line(F.col("line"), *_RULES))


@query(f"{_SHARED} SELECT line, CASE WHEN {_CLASS} = 'blacklist' THEN 'remove_retrieval_reviewed_blacklist' WHEN {_CLASS} = 'protected' THEN 'keep_protected_legal' WHEN line IN ('cộng hòa xã hội chủ nghĩa việt nam') THEN 'keep_conservative_header_fragment' WHEN line IN ('chia sẻ bài viết này') THEN 'keep_conservative_site_label' WHEN regexp_full_match(line, '[.…\\s]+') THEN 'keep_form_placeholder' WHEN regexp_matches(line, 'ký tên|đóng dấu') THEN 'keep_form_signature' WHEN regexp_matches(line, '^nơi nhận') THEN 'terminal_routing_candidate_structural_only' ELSE 'keep_legal_or_ambiguous' END AS decision FROM f")
def pred09_review_decisions(spark, root):
    decision = release.review_decision(F.col("line"), F.col("class"), ["Cộng hòa xã hội chủ nghĩa Việt Nam"], ["Chia sẻ bài viết này"], r"[.…\s]+", "ký tên|đóng dấu", "^nơi nhận")
    return _candidates(spark, root).select("line", decision.alias("decision"))


@query(f"WITH {RQ.ARTICLE_BODIES}, n AS (SELECT chunk_id, length({canonical_sql('body')}) < 60 AS short FROM p) SELECT chunk_id, short FROM n")
def pred10_short_chunks(spark, root):
    return RQ._chunks(spark, root).select("chunk_id", release.short_chunk(F.col("body")).alias("short"))


# Segmentation


@query()
def e07_fixed_chunks(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "passage").distinct()
    return release.fixed_chunks(d, "passage", 600, 80)


_CLAUSES_SQL = "l AS (SELECT id, unnest(string_split(passage, chr(10))) AS line, generate_subscripts(string_split(passage, chr(10)), 1) - 1 AS line_no FROM (SELECT DISTINCT id, passage FROM legal_documents)), m AS (SELECT *, nullif(lower(regexp_extract(line, '(?i)^\\s*điều\\s+(\\d+[a-zđ]?)', 1)), '') AS a, nullif(regexp_extract(line, '^\\s*(\\d+)[.)]\\s', 1), '') AS c FROM l WHERE trim(line) <> ''), s AS (SELECT *, count(a) OVER (PARTITION BY id ORDER BY line_no) AS segment FROM m), h AS (SELECT *, max(a) OVER (PARTITION BY id, segment) AS article FROM s WHERE segment > 0)"


@query(f"WITH {_CLAUSES_SQL} SELECT DISTINCT id AS doc_id, article, c AS clause, id || ':' || segment AS chunk_id FROM h WHERE c IS NOT NULL")
def e11_clause_index(spark, root):
    """Articles as chunks of several clauses, each found under every clause it holds."""
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "passage").distinct()
    lines = chunking.legal_lines(d, "passage").where("article IS NOT NULL")
    held = lines.groupBy("doc_id", "segment", "article").agg(F.array_sort(F.collect_set("clause")).alias("contained_clauses"))
    chunks = held.select("doc_id", "article", F.lit(None).cast("string").alias("clause"), "contained_clauses", F.concat_ws(":", "doc_id", F.col("segment").cast("string")).alias("chunk_id"))
    return release.clause_index(chunks).select("doc_id", "article", "clause", "chunk_id")


# Joins


@query("SELECT DISTINCT q.question_id, q.chunk_id, d.name, d.source FROM citation_qrels q JOIN (SELECT id, min(name) AS name, min(source) AS source FROM legal_documents GROUP BY id) d ON d.id = regexp_extract(q.chunk_id, '^doc_(.+)_article_', 1)")
def j03_id_lookup(spark, root):
    """Labels with the name and source of their chunk's document, looked up by id."""
    docs = spread_table(spark, root, "legal_documents").groupBy(F.col("id").alias("doc_id")).agg(F.min("name").alias("name"), F.min("source").alias("source"))
    labels = table(spark, root, "citation_qrels").select("question_id", "chunk_id", F.regexp_extract("chunk_id", "^doc_(.+)_article_", 1).alias("doc_id")).distinct()
    return labels.join(docs, "doc_id").select("question_id", "chunk_id", "name", "source")


@query(f"WITH {RQ.POSTS}, {RQ.bm25_sql(RQ.IDF)} SELECT b.query_id, b.doc_id, rank, (b.doc_id = b.query_id OR x.source = y.source) AS relevant FROM b JOIN documents x ON x.doc_id = b.query_id JOIN documents y ON y.doc_id = b.doc_id WHERE rank <= 10")
def j10_gold_or_parent(spark, root):
    """A hit counts if it is the query's own document or of the query's source."""
    docs = table(spark, root, "documents").select("doc_id", F.col("source").alias("parent_id"))
    asked = docs.where("doc_id % 20 = 0").withColumn("query_id", F.col("doc_id"))
    hits = evaluation.relevant_hits(RQ._bm25(spark, root), asked.select("query_id", "doc_id"), asked.select("query_id", "parent_id"), docs)
    return hits.select("query_id", "doc_id", "rank", "relevant")


@query()
def j15_near_chunks(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "passage").distinct()
    rows = release.fixed_chunks(d, "passage", 400, 100)
    return release.near_chunk_duplicates(rows.select("doc_id", F.concat_ws("#", "doc_id", F.col("ordinal").cast("string")).alias("chunk_id"), F.lit(None).cast("string").alias("article"), "ordinal", F.col("body").alias("text")))


@query("SELECT question_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY chunk_id) AS n FROM (SELECT DISTINCT question_id, chunk_id FROM citation_qrels)) WHERE n <= 5")
def w09_first_labels(spark, root):
    labels = table(spark, root, "citation_qrels").select("question_id", "chunk_id").distinct()
    return quality.first_of_each(labels, ["question_id"], [F.asc("chunk_id")], 5)


# Evaluation of answers: the question stands for a prediction, so that every engine has one.


def _cases(spark, root) -> DataFrame:
    one = spread_table(spark, root, "qa_examples").where("answer IS NOT NULL").groupBy("id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    cases = evaluation.answer_cases(one.select("id", F.col("question").alias("answer")), one)
    return materialise(evaluation.scored_cases(cases), "scored")


_METEOR = RQ.ORACLES["f26_meteor"]
_SLICES = "SELECT DISTINCT id, unnest([CASE WHEN n < 200 THEN 'answer_short' WHEN n < 500 THEN 'answer_medium' ELSE 'answer_long' END, 'overall']) AS name FROM (SELECT id, len(" + w("answer") + ") AS n FROM (SELECT id, min(answer) AS answer FROM qa_examples WHERE answer IS NOT NULL GROUP BY id))"


@query(f"SELECT name, count(*) AS n, round(avg(meteor), 5) AS meteor FROM ({_SLICES}) s JOIN ({_METEOR}) m USING (id) GROUP BY name")
def a20_answer_slices(spark, root):
    report = evaluation.answer_report(_cases(spark, root)).where("section = 'slice' AND (name = 'overall' OR name LIKE 'answer_%')")
    return report.select("name", "n", F.round("meteor", 5).alias("meteor"))


@query()
def v04_answer_report(spark, root):
    return evaluation.answer_report(_cases(spark, root)).withColumns({"meteor": F.round("meteor", 6), "rouge_l": F.round("rouge_l", 6)})


_LENGTHS = "a AS (SELECT id, CAST(min(length(answer)) AS DOUBLE) AS new, CAST(min(length(question)) AS DOUBLE) AS old FROM qa_examples WHERE answer IS NOT NULL GROUP BY id), d AS (SELECT id, new - old AS delta FROM a)"


@query(f"WITH {_LENGTHS} SELECT 'gain' AS side, position, id, delta FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, id) AS position FROM d) WHERE position <= 20 UNION ALL SELECT 'loss', position, id, delta FROM (SELECT *, row_number() OVER (ORDER BY delta, id) AS position FROM d) WHERE position <= 20")
def top08_best_and_worst(spark, root):
    """The twenty best and worst cases of two runs; lengths of answer and question stand for their scores."""
    one = spread_table(spark, root, "qa_examples").where("answer IS NOT NULL").groupBy("id").agg(F.min(F.length("answer")).cast("double").alias("new"), F.min(F.length("question")).cast("double").alias("old"))
    return evaluation.best_and_worst(one.select("id", F.col("new").alias("score")), one.select("id", F.col("old").alias("score")))


# Sanitation reports

_BLOCKS = "b AS (SELECT id, lower(trim(regexp_replace(unnest(string_split(passage, chr(10))), '\\s+', ' ', 'g'))) AS b FROM (SELECT DISTINCT id, passage FROM legal_documents)), k AS (SELECT id, b, count(*) AS c FROM b WHERE length(b) >= 60 AND length(regexp_replace(b, '[^\\p{L}\\p{N}]', '', 'g')) / length(b) >= 0.25 AND len(regexp_extract_all(b, '[\\p{L}\\p{N}_]+')) >= 8 GROUP BY ALL)"


def _paragraphs(spark, root) -> DataFrame:
    return spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), F.regexp_replace("passage", "\n", "\n\n").alias("passage")).distinct()


@query(f"WITH {_BLOCKS} SELECT doc_id, position, block, times, repeated_chars FROM (SELECT id AS doc_id, b AS block, c AS times, (c - 1) * length(b) AS repeated_chars, row_number() OVER (PARTITION BY id ORDER BY (c - 1) * length(b) DESC, c DESC, b) AS position FROM k WHERE c > 1) WHERE position <= 5")
def top09_repeated_blocks(spark, root):
    return release.repeated_blocks(_paragraphs(spark, root), "passage", least=60).select("doc_id", "position", "block", "times", "repeated_chars")


@query(f"WITH {_BLOCKS}, r AS (SELECT id, round(1 - count(*) / sum(c), 6) AS ratio, max(c) AS most, round(sum((c - 1) * length(b)) / sum(c * length(b)), 6) AS dup FROM k GROUP BY id), d AS (SELECT DISTINCT id, length(regexp_replace(passage, chr(10), chr(10) || chr(10), 'g')) AS chars FROM legal_documents) SELECT id AS doc_id, CASE WHEN coalesce(most, 0) >= 20 THEN 'CRITICAL' WHEN coalesce(ratio, 0) >= 0.2 AND coalesce(most, 0) >= 5 THEN 'REVIEW' ELSE 'OK' END AS severity, coalesce(ratio, 0) AS ratio, coalesce(dup, 0) AS duplicate_char_ratio, chars FROM d LEFT JOIN r USING (id) ORDER BY severity = 'OK', severity = 'REVIEW', coalesce(dup, 0) DESC, chars DESC, id LIMIT 100")
def top07_corruption_order(spark, root):
    d = _paragraphs(spark, root)
    lengths = d.select("doc_id", F.length("passage").alias("chars"), F.coalesce(F.col("passage").rlike(hygiene.PAYWALL), F.lit(False)).alias("paywalled")).where("chars IS NOT NULL")
    return release.corruption_order(hygiene.repetition(d, "passage", 60), lengths).drop("paywalled")


_GENERATED = "b AS (SELECT id, lower(trim(regexp_replace(unnest(regexp_split_to_array(coalesce(generation_text, ''), '\\n\\s*\\n+')), '\\s+', ' ', 'g'))) AS b FROM (SELECT DISTINCT id, generation_text FROM legal_documents)), k AS (SELECT id, b, count(*) AS c FROM b WHERE length(b) >= 100 AND length(regexp_replace(b, '[^\\p{L}\\p{N}]', '', 'g')) / length(b) >= 0.25 AND len(regexp_extract_all(b, '[\\p{L}\\p{N}_]+')) >= 8 GROUP BY ALL), r AS (SELECT id, sum(c) AS blocks, count(*) AS uniq, max(c) AS most FROM k GROUP BY id), dd AS (SELECT DISTINCT id, generation_text FROM legal_documents)"


@query(f"WITH {_GENERATED}, {_SHARED.removeprefix('WITH ').replace('k AS (SELECT DISTINCT id, line', 'kl AS (SELECT DISTINCT id, line').replace('FROM k GROUP BY line', 'FROM kl GROUP BY line')}, t AS (SELECT coalesce(sum(blocks), 0) AS blocks, coalesce(sum(blocks - uniq), 0) AS repeated_blocks, count(*) FILTER (most > 1) AS documents_with_repeats FROM r) SELECT 'severity' AS section, CASE WHEN coalesce(most, 0) >= 20 THEN 'CRITICAL' WHEN round(1 - uniq / blocks, 6) >= 0.2 AND most >= 5 THEN 'REVIEW' ELSE 'OK' END AS name, CAST(count(*) AS DOUBLE) AS value FROM dd LEFT JOIN r USING (id) GROUP BY ALL UNION ALL SELECT 'shared_line', {_CLASS}, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'total', 'blocks', blocks FROM t UNION ALL SELECT 'total', 'repeated_blocks', repeated_blocks FROM t UNION ALL SELECT 'total', 'documents_with_repeats', documents_with_repeats FROM t")
def h05_sanitation_audit(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "generation_text").distinct()
    return release.sanitation_audit(d, "generation_text", *_RULES)


@query()
def top11_length_batches(spark, root):
    d = release.length_batches(table(spark, root, "documents").select("doc_id", "text"), "text", "doc_id", 64)
    return d.groupBy("part", "batch").agg(F.count("*").alias("rows"), F.min(F.length("text")).alias("least"), F.max(F.length("text")).alias("most"))


# Answers from rankings


def _excerpts(spark, root) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, ranking, documents) of the titles of every twentieth document."""
    docs, lists, asked = RQ._search(spark, root)
    ranked = materialise(R.bm25(lists, R.query_terms(asked, T.legal_tokens(F.col("title"))), k=10), "ranked")
    return asked.select("query_id", F.col("title").alias("text")), ranked, docs


@query(f"WITH {RQ.POSTS}, {RQ.bm25_sql(RQ.IDF)}, qq AS (SELECT doc_id AS query_id, list_distinct({legal_sql('title')}) AS q FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL), e AS (SELECT query_id, rank, text FROM b JOIN documents USING (doc_id) WHERE rank <= 3), st AS (SELECT query_id, rank, unnest(p) AS sentence, generate_subscripts(p, 1) AS n FROM (SELECT query_id, rank, list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)) AS p FROM e)), c AS (SELECT st.*, len(list_intersect(q, list_distinct({legal_sql('sentence')}))) / greatest(len(q), 1) AS score FROM st JOIN qq USING (query_id) WHERE length(sentence) >= 25), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, n) AS r FROM c) SELECT query_id, CASE WHEN x.query_id IS NULL THEN {_quoted(answering.NO_ANSWER)} ELSE coalesce(answer, '') END AS answer FROM qq LEFT JOIN (SELECT DISTINCT query_id FROM e) x USING (query_id) LEFT JOIN (SELECT query_id, string_agg(sentence, ' ' ORDER BY rank, n) AS answer FROM t WHERE r <= 6 GROUP BY query_id) y USING (query_id)")
def top10_extractive_answers(spark, root):
    asked, ranked, docs = _excerpts(spark, root)
    evidence = ranked.where("rank <= 3").join(docs.select("doc_id", "text"), "doc_id").select("query_id", F.col("rank").alias("position"), "text")
    return answering.extractive_answers(asked, evidence, T.legal_tokens)


_CONTEXTS = f"""WITH RECURSIVE {RQ.POSTS}, {RQ.bm25_sql(RQ.IDF)}, pl AS (SELECT query_id, doc_id, source AS parent_id, trim(text, ' ' || chr(10)) AS whole, trim(substr(text, 1, 300), ' ' || chr(10)) AS part, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM b JOIN documents USING (doc_id) WHERE rank <= 10 AND trim(text, ' ' || chr(10)) <> ''),
 st AS (SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(4000 AS BIGINT) AS room, CAST([] AS VARCHAR[]) AS seen, '' AS chunk_id, '' AS parent_id, CAST(0 AS BIGINT) AS chars FROM (SELECT DISTINCT query_id FROM pl)
  UNION ALL SELECT query_id, n, room - CASE WHEN ok THEN l ELSE 0 END, CASE WHEN ok THEN list_append(seen, parent_id) ELSE seen END, CAST(doc_id AS VARCHAR), parent_id, CASE WHEN ok THEN l ELSE 0 END FROM (SELECT *, room > 0 AND len(seen) < 5 AND NOT list_contains(seen, parent_id) AND l > 0 AS ok FROM (SELECT st.query_id, pl.n, room, seen, doc_id, pl.parent_id, CASE WHEN length(whole) <= room THEN length(whole) ELSE length(substr(part, 1, room)) END AS l FROM st JOIN pl ON pl.query_id = st.query_id AND pl.n = st.n + 1)))"""


@query(f"{_CONTEXTS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS position, chunk_id, parent_id, chars FROM st WHERE chars > 0")
def top05_parent_contexts(spark, root):
    asked, ranked, docs = _excerpts(spark, root)
    chunks = docs.select("doc_id", F.col("source").alias("parent_id"), F.col("text").alias("parent_text"), F.substring("text", 1, 300).alias("retrieval_text"))
    return answering.parent_contexts(ranked, chunks, 5, 4000).select("query_id", F.col("position").cast("bigint").alias("position"), "chunk_id", "parent_id", F.length("text").cast("bigint").alias("chars"))


@query(f"{_CONTEXTS}, ev AS (SELECT query_id, array_to_string(list(parent_id ORDER BY n), ',') AS parents, CAST(sum(chars) AS BIGINT) AS chars FROM st WHERE chars > 0 GROUP BY 1), co AS (SELECT query_id, count(*) AS considered FROM b WHERE rank <= 10 GROUP BY 1), aq AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL) SELECT query_id, parents, coalesce(chars, 0) AS chars, coalesce(considered, 0) AS considered FROM aq LEFT JOIN ev USING (query_id) LEFT JOIN co USING (query_id)")
def r18_evidence_provider(spark, root):
    asked, ranked, docs = _excerpts(spark, root)
    chunks = docs.select("doc_id", F.col("source").alias("parent_id"), F.col("text").alias("parent_text"), F.substring("text", 1, 300).alias("retrieval_text"))
    return answering.provided_evidence(asked, ranked, chunks, 20, 5, 4000).select("query_id", F.array_join("parents", ",").alias("parents"), F.col("chars").cast("bigint").alias("chars"), "considered")


@query(f"WITH {RQ.POSTS}, {RQ.bm25_sql(RQ.IDF)}, c AS (SELECT query_id, list(CAST(doc_id AS VARCHAR) ORDER BY rank) AS ids, list(substr(text, 1, 80) ORDER BY rank) AS quotes FROM b JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id), qq AS (SELECT doc_id AS query_id, title FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL), r AS (SELECT query_id, ids, quotes, CASE WHEN ids IS NULL THEN 'abstain' WHEN len(ids) > 1 AND regexp_matches(strip_accents(replace(lower(title), 'đ', 'd')), 'compare|difference|so sanh|khac nhau') THEN 'compare' ELSE 'lookup' END AS route FROM qq LEFT JOIN c USING (query_id)) SELECT query_id, route, CASE route WHEN 'abstain' THEN {_quoted(answering.ABSTAINS)} WHEN 'compare' THEN {_quoted(answering.COMPARES)} || '- ' || quotes[1] || ' [' || ids[1] || ']' || chr(10) || '- ' || quotes[2] || ' [' || ids[2] || ']' ELSE quotes[1] || ' [' || ids[1] || ']' END AS answer, route = 'abstain' AS abstained FROM r")
def r19_agent_answers(spark, root):
    asked, ranked, docs = _excerpts(spark, root)
    return answering.agent_answers(asked, ranked, docs.select("doc_id", F.substring("text", 1, 80).alias("excerpt"))).drop("citations")


@query(f"WITH {RQ.POSTS}, {RQ.bm25_sql(RQ.IDF)}, {RQ.TFIDF}, q AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL), c AS (SELECT query_id, 'bm25' AS channel, count(*) AS n FROM b WHERE rank <= 20 GROUP BY 1 UNION ALL SELECT query_id, 'tfidf', count(*) FROM tr WHERE rank <= 20 GROUP BY 1), e AS (SELECT query_id, unnest(['bm25', 'tfidf']) AS channel FROM q) SELECT e.query_id, e.channel, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'skipped' END AS state, coalesce(n, 0) AS candidates FROM e LEFT JOIN c ON c.query_id = e.query_id AND c.channel = e.channel".replace(", q AS (SELECT doc_id AS query_id FROM", ", qs AS (SELECT doc_id AS query_id FROM").replace("AS channel FROM q)", "AS channel FROM qs)"))
def r20_channel_status(spark, root):
    docs, lists, asked = RQ._search(spark, root)
    terms = materialise(R.query_terms(asked, T.legal_tokens(F.col("title"))), "terms")
    return answering.search(asked, {"bm25": R.bm25(lists, terms, 20), "tfidf": R.tfidf(lists, terms, 20)})[1]


@query(f"WITH {RQ.POSTS}, {RQ.bm25_sql(RQ.IDF)}, {RQ.JUDGED}, a AS (SELECT js.query_id, min(rank) FILTER (j.doc_id IS NOT NULL) AS first, count(b.doc_id) AS hits FROM js LEFT JOIN (SELECT * FROM b WHERE rank <= 5) b ON b.query_id = js.query_id LEFT JOIN j ON j.query_id = js.query_id AND j.doc_id = b.doc_id GROUP BY 1) SELECT count(*) AS queries, count(*) AS answerable, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END), 6) AS abstention_accuracy, 1.0 AS citation_integrity FROM a")
def a22_agent_metrics(spark, root):
    """Every query with a relevant document is answerable; one without a title finds nothing, so abstaining is wrong."""
    asked, ranked, docs = _excerpts(spark, root)
    answers = answering.agent_answers(asked, ranked.where("rank <= 5"), docs.select("doc_id", F.substring("text", 1, 80).alias("excerpt")))
    judged = RQ._judged(spark, root)
    m = evaluation.agent_metrics(judged.select("query_id").distinct().withColumn("answerable", F.lit(True)), ranked, answers, judged)
    return m.select("queries", "answerable", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "abstention_accuracy", "citation_integrity")])


_NEAR = f"d AS (SELECT id AS doc_id, min(question) AS question, min(answer) AS answer FROM qa_examples WHERE split = 'train' GROUP BY id), v AS (SELECT id AS query_id, min(question) AS question FROM qa_examples WHERE split = 'validation' GROUP BY id), {RQ.posts_sql('d', 'question', 'v', 'question')}, {RQ.bm25_sql(RQ.IDF)}, {RQ.TFIDF}, {RQ.FUSED}"


@query(f"WITH {_NEAR} SELECT query_id, doc_id AS neighbour_id, md5(answer) AS answer_digest, round(score, 9) AS score FROM fr JOIN d USING (doc_id) WHERE rank = 1")
def r17_neighbour_answers(spark, root):
    """Answers of the nearest training question by three fused channels, for each validation question."""
    one = lambda split: spread_table(spark, root, "qa_examples").where(F.col("split") == split).groupBy("id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    held = one("validation").withColumnRenamed("id", "query_id")
    known = materialise(one("train").select(F.col("id").alias("doc_id"), "answer", T.legal_tokens(F.col("question")).alias("tokens")), "known")
    terms = materialise(R.query_terms(held, T.legal_tokens(F.col("question"))), "terms")
    return answering.neighbour_answers({"bm25": R.bm25(known, terms, 20), "tfidf": R.tfidf(known, terms, 20)}, known, {"tfidf": 4.0}).select("query_id", "neighbour_id", F.md5("answer").alias("answer_digest"), F.round("score", 9).alias("score"))


# Releases


def _release_documents(spark, root) -> DataFrame:
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "name", F.col("passage").alias("text"))
    valid = table(spark, root, "raw_inventory").groupBy("doc_id").agg(F.bool_and("json_valid").alias("json_valid"))
    return materialise(release.release_documents(d.join(valid, "doc_id", "left")), "documents")


_DOCS_SQL = f"o AS (SELECT id, min(name) AS name, min(passage) AS t FROM legal_documents GROUP BY id), i AS (SELECT doc_id, bool_and(json_valid) AS ok FROM raw_inventory GROUP BY 1), f AS (SELECT o.id, o.name, o.t, coalesce(ok, true) AS ok, CASE WHEN trim(coalesce(t, '')) <> '' THEN sha256({canonical_sql('t')}) END AS fp FROM o LEFT JOIN i ON i.doc_id = o.id), g AS (SELECT *, CASE WHEN fp IS NOT NULL THEN min(id) OVER (PARTITION BY fp) END AS first FROM f), rd AS (SELECT id AS doc_id, t, fp, CASE WHEN first <> id THEN first END AS alias_of, CASE WHEN NOT ok THEN 'invalid_json' WHEN fp IS NULL THEN 'empty_passage' WHEN first <> id THEN 'exact_duplicate_alias' ELSE 'INCLUDED' END AS status FROM g)"


@query(f"WITH {_DOCS_SQL} SELECT doc_id, alias_of, status, status = 'INCLUDED' AS indexable, fp AS fingerprint FROM rd")
def h07_release_documents(spark, root):
    return _release_documents(spark, root).select("doc_id", "alias_of", "status", "indexable", "fingerprint")


@query()
def h06_corpus_chunks(spark, root):
    return release.corpus_chunks(_release_documents(spark, root)).select("chunk_id", "doc_id", "parent_id", "level", "article", "clause", "short", "fingerprint")


@query(f"WITH {_DOCS_SQL} SELECT 'status' AS section, status AS name, count(*) AS value FROM rd GROUP BY status UNION ALL SELECT 'quarantine', status, count(*) FROM rd WHERE status NOT IN ('INCLUDED', 'exact_duplicate_alias') GROUP BY status")
def h07_corpus_report(spark, root):
    documents = _release_documents(spark, root)
    return release.corpus_report(documents, release.corpus_chunks(documents)).where("section IN ('status', 'quarantine')")


@query()
def h07_level_report(spark, root):
    documents = _release_documents(spark, root)
    return release.corpus_report(documents, release.corpus_chunks(documents)).where("section IN ('level', 'short')")


def _qa_release(spark, root) -> DataFrame:
    qa = spread_table(spark, root, "qa_examples").select("id", "question", "answer", (F.col("split") == "public").alias("public"))
    return materialise(release.qa_release(qa, 100), "qa")


_SANE = f"regexp_replace(nfc_normalize({sanitized_sql('a')}), '^[\\s\\x{{00a0}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{3000}}]+$', '', 'g')"
_PLAIN = "regexp_replace(nfc_normalize(regexp_replace(coalesce(a, ''), '\\r\\n?', chr(10), 'g')), '^[\\s\\x{00a0}\\x{3000}]+|[\\s\\x{00a0}\\x{3000}]+$', '', 'g')"


@query(f"WITH o AS (SELECT id, min(question) AS q, min(answer) AS a, bool_or(split = 'public') AS public FROM qa_examples GROUP BY id) SELECT count(*) FILTER (NOT public) AS records, count(*) FILTER (public) AS public, count(*) FILTER (NOT public AND {_SANE} <> {_PLAIN}) AS changed, count(*) FILTER (NOT public AND regexp_matches(coalesce(a, ''), '^[\\s\\x{{00a0}}]*$')) AS no_answer FROM o")
def h08_qa_report(spark, root):
    rows = _qa_release(spark, root)
    blank = spread_table(spark, root, "qa_examples").groupBy("id").agg(F.min("answer").alias("a"), F.bool_or(F.col("split") == "public").alias("p")).where(~F.col("p") & F.coalesce("a", F.lit("")).rlike(r"(?U)^\s*$")).agg(F.count("*").alias("no_answer"))
    return release.qa_report(rows).select("records", "public", "changed").crossJoin(F.broadcast(blank))


@query()
def h08_qa_release(spark, root):
    return _qa_release(spark, root).select("question_id", "question_group", "split", "changed", "media_note", "related_questions", F.md5("question").alias("question_digest"), F.md5("answer").alias("answer_digest"))


@query()
def h13_corpus_audit(spark, root):
    """Counts of every rule that the corpus and question releases break; a clean release gives none."""
    documents = _release_documents(spark, root)
    chunks = materialise(release.corpus_chunks(documents), "chunks")
    return quality.gate(release.corpus_violations(documents, chunks), release.qa_violations(_qa_release(spark, root)))


@query()
def h12_freeze_gate(spark, root):
    documents = _release_documents(spark, root)
    chunks = materialise(release.corpus_chunks(documents), "chunks")
    waiting = _candidates(spark, root).select("line", F.when(F.col("class") != "manual_review", F.lit("decided")).alias("decision"))
    return quality.gate(release.freeze_violations(documents, chunks, waiting, _qa_release(spark, root)))


@query("SELECT 'expected_value' AS rule, 'citation_qrels.relevance' AS key WHERE EXISTS (SELECT 1 FROM citation_qrels WHERE relevance IS DISTINCT FROM 1) UNION ALL SELECT 'expected_value', 'raw_inventory.json_valid' WHERE EXISTS (SELECT 1 FROM raw_inventory WHERE json_valid IS DISTINCT FROM true) UNION ALL SELECT 'required_column', 'documents.sha256' UNION ALL SELECT 'forbidden_column', 'qa_examples.answer' UNION ALL SELECT 'present', 'manifest'")
def h14_contract_gate(spark, root):
    contracts = {
        "citation_qrels": release.TableContract(required=("question_id", "chunk_id"), expected={"relevance": 1}), "raw_inventory": release.TableContract(required=("doc_id", "sha256"), expected={"json_valid": True}), "documents": release.TableContract(required=("doc_id", "sha256")),
        "qa_examples": release.TableContract(required=("id", "split"), forbidden=("answer",)), "manifest": release.TableContract(),
    }
    return release.contract_violations({n: table(spark, root, n) for n in ("citation_qrels", "raw_inventory", "documents", "qa_examples")}, contracts)


def _cited_parents(spark, root) -> tuple[DataFrame, DataFrame, DataFrame]:
    answers = spread_table(spark, root, "qa_examples").where("split = 'validation' OR split = 'train'").select(F.col("id").alias("question_id"), "answer").distinct()
    cited = answers.select("question_id", F.explode(C.citations(F.col("answer"))).alias("c")).select("question_id", F.col("c.document_number").alias("number"), "c.article", "c.clause", "c.point").distinct()
    return answers, materialise(cited, "cited"), RQ._chunks(spark, root)


@query(f"WITH {RQ.ARTICLE_BODIES}, a AS (SELECT DISTINCT id AS question_id, {WS.format(x=normal_sql('answer'))} AS t FROM qa_examples WHERE split IN ('train', 'validation')), c AS (SELECT question_id, {RQ.cited_sql('t')} AS x FROM a), e AS (SELECT question_id, x.article AS article, x.number AS number FROM c), mt AS (SELECT e.question_id, count(DISTINCT p.chunk_id) AS parents FROM e JOIN p ON p.number = e.number AND p.article = e.article GROUP BY 1), s AS (SELECT a.question_id, count(e.article) AS citations, count(e.number) AS numbered FROM (SELECT DISTINCT question_id FROM a) a LEFT JOIN e USING (question_id) GROUP BY 1) SELECT question_id, CASE WHEN citations = 0 THEN 'no_citation' WHEN coalesce(parents, 0) > 0 THEN 'matched' WHEN numbered > 0 THEN 'document_or_article_not_found' ELSE 'citation_without_document_number' END AS status, coalesce(parents, 0) AS parents FROM s LEFT JOIN mt USING (question_id)")
def h11_diagnostic_labels(spark, root):
    answers, cited, chunks = _cited_parents(spark, root)
    return release.diagnostic_labels(answers, cited, chunks.select(F.col("chunk_id").alias("parent_id"), "number", "article")).select("question_id", "status", "parents")


@query("WITH q AS (SELECT DISTINCT id FROM qa_examples WHERE split <> 'public'), l AS (SELECT DISTINCT question_id, chunk_id, CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS g FROM citation_qrels), b AS (SELECT question_id, max(g) AS best, count(DISTINCT chunk_id) AS chunks FROM l GROUP BY 1) SELECT count(*) AS answers, count(best) AS matched, count(*) FILTER (best = 3) AS matched_high, count(*) FILTER (best = 2) AS matched_medium, count(*) FILTER (best = 1) AS matched_low, count(*) FILTER (chunks > 20) AS ambiguous, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS pairs, round(count(best) / greatest(count(*), 1), 6) AS coverage FROM q LEFT JOIN b ON b.question_id = q.id")
def a15_label_coverage(spark, root):
    answers = spread_table(spark, root, "qa_examples").where("split <> 'public'").select(F.col("id").alias("question_id"))
    return release.label_coverage(answers, answers, table(spark, root, "citation_qrels")).drop("with_citations", "unmatched")


@query("SELECT l_orderkey, list_transform(list_slice(f, 1, 5), lambda x, i: CASE WHEN i <= least(2, len(f)) THEN -100 ELSE x END) AS labels, len(f) - 2 AS target_tokens FROM (SELECT l_orderkey, list(CAST(l_linenumber AS BIGINT) * 10 ORDER BY l_linenumber) AS f FROM lineitem GROUP BY 1) WHERE len(f) > 2")
def c05_answer_labels(spark, root):
    """Token ids of an order's lines, the first two of them the prompt."""
    ids = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("bigint") * 10)).alias("f"))
    made = ids.select("l_orderkey", release.answer_only_labels(F.slice("f", 1, 2), F.col("f"), 5).alias("x")).where("x IS NOT NULL")
    return made.select("l_orderkey", "x.labels", F.col("x.target_tokens").cast("bigint").alias("target_tokens"))


# More reports

_SHARES = (0, 25, 50, 75, 90, 95, 99, 100)


@query("WITH q AS (SELECT id, min(question) AS q, min(answer) AS a FROM qa_examples GROUP BY id), c AS (SELECT count(*) AS records, count(*) FILTER (regexp_matches(coalesce(a, ''), '^ *$')) AS empty_answers, count(*) FILTER (regexp_matches(coalesce(a, ''), '(?i)điều\\s+\\d+')) AS answers_with_article, count(*) FILTER (regexp_matches(coalesce(a, ''), '\\d{1,5}/\\d{4}/')) AS answers_with_number FROM q), p AS (SELECT " + ", ".join(f"floor(quantile_cont(length(coalesce({c}, '')), {x / 100})) AS {c}{x}" for c in "qa" for x in _SHARES) + " FROM q) " + " UNION ALL ".join([f"SELECT 'count' AS section, '{n}' AS name, CAST({n} AS DOUBLE) AS value FROM c" for n in ("records", "empty_answers", "answers_with_article", "answers_with_number")] + [f"SELECT '{n}_chars', 'p{x}', CAST({c}{x} AS DOUBLE) FROM p" for c, n in (("q", "question"), ("a", "answer")) for x in _SHARES]))
def h16_eda_report(spark, root):
    one = spread_table(spark, root, "qa_examples").groupBy("id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    return release.eda_report(one).where("name <> 'repeated_questions'")


@query("WITH l AS (SELECT id, unnest(string_split(passage, chr(10))) AS line, generate_subscripts(string_split(passage, chr(10)), 1) - 1 AS line_no FROM (SELECT DISTINCT id, passage FROM legal_documents)), m AS (SELECT *, nullif(lower(regexp_extract(line, '(?i)^\\s*điều\\s+(\\d+[a-zđ]?)', 1)), '') AS a, nullif(lower(regexp_extract(line, '(?i)^\\s*chương\\s+([ivxlcdm]+|\\d+)(?:$|[^\\p{L}\\p{N}_])', 1)), '') AS c, nullif(regexp_extract(line, '(?i)^\\s*mục\\s+(\\d+)(?:$|[^\\p{L}\\p{N}_])', 1), '') AS s FROM l), n AS (SELECT *, count(c) OVER (PARTITION BY id ORDER BY line_no) AS k FROM m), o AS (SELECT *, max(c) OVER (PARTITION BY id, k) AS chapter, count(s) OVER (PARTITION BY id, k ORDER BY line_no) AS j FROM n) SELECT doc_id, line_no, article, chapter, section FROM (SELECT id AS doc_id, line_no, a AS article, chapter, max(s) OVER (PARTITION BY id, k, j) AS section FROM o) WHERE article IS NOT NULL")
def w05_headings(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "passage").distinct()
    return chunking.headings(d, "passage").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "article", "chapter", "section")


def _labelled_ranking(spark, root) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, root, "citation_qrels").select(F.col("question_id").alias("query_id"), F.col("chunk_id").alias("doc_id"), "confidence").distinct()
    labels = materialise(labels, "labels")
    chunks = materialise(RQ._chunks(spark, root).select(F.col("chunk_id").alias("doc_id"), T.legal_tokens(F.col("body")).alias("tokens")), "chunks")
    asked = spread_table(spark, root, "qa_examples").join(labels.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("query_id")).agg(F.min("question").alias("question"))
    return R.bm25(chunks, R.query_terms(asked, T.legal_tokens(F.col("question"))), 20), labels


_LABELLED = "aq AS (SELECT id AS query_id, min(question) AS question FROM qa_examples WHERE id IN (SELECT question_id FROM citation_qrels) GROUP BY id)"
_BODIES = RQ.ARTICLE_BODIES.replace("p AS (SELECT * FROM hd", "ar AS (SELECT * FROM hd").replace("l AS (SELECT id, number", "li AS (SELECT id, number").replace("FROM l WHERE", "FROM li WHERE")
_SCOPE = "SELECT '{scope}' AS scope, count(*) AS queries, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(h5 / n, 0)), 6) AS recall_5, round(avg(coalesce(g5 / ideal, 0)), 6) AS ndcg_5 FROM (SELECT query_id, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM lb WHERE {where} GROUP BY 1) z LEFT JOIN (SELECT query_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS h5, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS g5 FROM (SELECT DISTINCT b.query_id, b.doc_id, rank FROM b JOIN lb USING (query_id, doc_id) WHERE rank <= 20 AND {where}) GROUP BY 1) y USING (query_id)"


@query(f"WITH {_BODIES}, {_LABELLED}, {RQ.posts_sql('(SELECT chunk_id AS doc_id, body FROM ar)', 'body', 'aq', 'question')}, {RQ.bm25_sql(RQ.IDF)}, lb AS (SELECT DISTINCT question_id AS query_id, chunk_id AS doc_id, confidence FROM citation_qrels), dh AS (SELECT 1) " + _SCOPE.format(scope="HIGH", where="confidence = 'HIGH'") + " UNION ALL " + _SCOPE.format(scope="ALL", where="true").replace("FROM lb WHERE true", "FROM (SELECT DISTINCT query_id, doc_id FROM lb) lb"))
def v05_label_evaluation(spark, root):
    """BM25 over articles for the labelled questions, against the labels of high confidence and against all."""
    ranked, labels = _labelled_ranking(spark, root)
    return evaluation.retrieval_report(ranked, labels).select("scope", "queries", "mrr", "recall_5", "ndcg_5")


@query("WITH n AS (SELECT source, len(" + w("text") + ") AS n FROM documents) SELECT source, count(*) AS n, round(avg(n), 4) AS mean, count(*) FILTER (n > 256) AS over_256, count(*) FILTER (n > 512) AS over_512, quantile_disc(n, 0.0) AS p0 FROM n GROUP BY source")
def v10_token_lengths(spark, root):
    d = table(spark, root, "documents").select("source", "text")
    report = evaluation.token_report(d, "source", F.size(T.word_tokens(F.col("text"))), (256, 512), (0.0,))
    wide = report.groupBy("source").pivot("name", ["count", "mean", "over_256", "over_512", "p0"]).agg(F.first("value"))
    return wide.select("source", F.col("count").cast("bigint").alias("n"), "mean", *[F.col(c).cast("bigint").alias(c) for c in ("over_256", "over_512", "p0")])


@query(f"SELECT count(*) AS documents, CAST(sum(length(coalesce(raw_text, ''))) AS BIGINT) AS raw_chars, CAST(sum(length({normal_sql('raw_text')})) AS BIGINT) AS normalized_chars, CAST(sum(len(list_filter(string_split({normal_sql('raw_text')}, chr(10)), lambda l: regexp_matches({WS.format(x='lower(l)')}, '^trang chủ > .*$')))) AS BIGINT) AS lines_removed FROM legal_documents")
def a09_sanitation_totals(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "raw_text")
    return hygiene.sanitation_totals(hygiene.sanitize(d, "raw_text", [], [], ["trang chủ > .*"])).select("documents", "raw_chars", "normalized_chars", "lines_removed")


@query("SELECT source_task AS id, count(*) AS n FROM raw_inventory GROUP BY 1 HAVING count(*) > 0")
def a13_histogram(spark, root):
    return table(spark, root, "raw_inventory").groupBy(F.col("source_task").alias("id")).agg(F.count("*").alias("n"))


@query(f"WITH {RQ.ARTICLE_BODIES}, g AS (SELECT sha256({canonical_sql('body')}) AS h, count(*) AS c FROM p GROUP BY 1) SELECT CAST(sum(c - 1) AS BIGINT) AS repeated, count(*) FILTER (c > 1) AS groups FROM g")
def a14_duplicate_chunks(spark, root):
    groups, _ = hygiene.exact_groups(RQ._chunks(spark, root).select(F.col("chunk_id").alias("doc_id"), "body"), T.fingerprint(F.col("body")))
    return groups.agg(F.sum(F.col("copies") - 1).alias("repeated"), F.count_if(F.col("copies") > 1).alias("groups"))

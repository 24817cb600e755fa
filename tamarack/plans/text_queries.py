"""Queries of the text functions, predicates and segmentation, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import citations as C
from tamarack.functions import text as T
from tamarack.operators import chunking, hygiene
from tamarack.session import spread_table, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL where it can be expressed."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL pieces shared by the oracles.
WS = "regexp_replace(regexp_replace({x}, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g')"
LINES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')), '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]', '', 'g'), '[•●▪]', '- ', 'g'), '[\\t\\f\\v \\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
WORDS = "regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"
SPACES = "[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]"
_LETTER = "[^\\p{{L}}\\p{{N}}_]"
# Document numbers between two signs, so that their letters can be raised: a lambda over the parts.
CITES = "array_to_string(list_transform(string_split(regexp_replace({x}, '(?i)(^|" + _LETTER + ")(\\p{{Nd}}{{1,5}})" + SPACES + "*/" + SPACES + "*(\\p{{Nd}}{{4}})" + SPACES + "*/" + SPACES + "*([A-ZĐ]+)" + SPACES + "*-" + SPACES + "*([A-ZĐ]+)($|" + _LETTER + ")', '\\1' || chr(1) || '\\2/\\3/\\4-\\5' || chr(2) || '\\6', 'g'), chr(1)), lambda p: CASE WHEN contains(p, chr(2)) THEN upper(split_part(p, chr(2), 1)) || substr(p, instr(p, chr(2)) + 1) ELSE p END), '')"
TAGS = "(CASE WHEN regexp_matches({x}, '(?i)</?(table|tr|td|th|p|div|br|li|ul|ol)\\b') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)<li(?: [^>]*)?>', chr(10) || '- ', 'g'), '(?i)</?t[dh](?: [^>]*)?>', ' | ', 'g'), '(?i)<(?:/?(?:p|div|tr)|br|ul|ol|/li)(?: [^>]*)?/?>', chr(10), 'g'), '</?[A-Za-z][^>]*>', '', 'g') ELSE {x} END)"


def normal_sql(x):
    """The normal form of texts without entities."""
    lines = LINES.format(x=TAGS.format(x=f"coalesce({x}, '')"))
    return CITES.format(x=f"regexp_replace({lines}, '^\\s+|\\s+$', '', 'g')")


def canonical_sql(x):
    return f"lower({WS.format(x=normal_sql(x))})"


def w(x):
    return WORDS.format(x=x)


def legal_sql(x):
    """Tokens of the normalised text: document numbers are found in either case and with spaces, so nothing is raised."""
    plain = f"regexp_replace(nfc_normalize(coalesce({x}, '')), '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g')"
    sp = SPACES.format() + "*"
    spaced = f"regexp_replace({plain}, '(\\d{{1,5}}){sp}/{sp}(\\d{{4}}){sp}/{sp}([A-Za-zĐđ]+){sp}-{sp}([A-Za-zĐđ]+)($|[^\\p{{L}}\\p{{N}}_])', '\\1/\\2/\\3-\\4\\5', 'g')"
    return f"list_transform(regexp_extract_all({spaced}, '\\d{{1,5}}/\\d{{4}}/(?:[A-Za-zĐđ]+-[A-Za-zĐđ]+[A-ZĐ0-9-]*|[A-ZĐ0-9-]+)|[0-9A-Za-zÀ-ỹĐđ]+'), lambda t: replace(lower(t), 'ß', 'ss'))"


def first(table_name, *columns, where="true"):
    """One row per id: rows that are delivered again count once."""
    return f"(SELECT id, {', '.join(f'min({c}) AS {c}' for c in columns)} FROM {table_name} WHERE {where} GROUP BY id)"


@query("SELECT id, " + normal_sql("passage") + " AS plain FROM legal_documents")
def f01_normalize_text(spark, root):
    return spread_table(spark, root, "legal_documents").select("id", T.normalize_text(F.col("passage")).alias("plain"))


@query("SELECT id, " + TAGS.format(x="answer") + " AS plain FROM qa_examples")
def f02_html_to_text(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", T.html_to_text(F.col("answer")).alias("plain"))


@query("SELECT id, " + CITES.format(x="question") + " AS plain FROM qa_examples")
def f03_citation_spacing(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", T.normalize_citations(F.col("question")).alias("plain"))


@query("SELECT doc_id, " + canonical_sql("text") + " AS canonical FROM documents")
def f04_canonical_text(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", T.canonical_text(F.col("text")).alias("canonical"))


@query("SELECT doc_id, sha256(" + canonical_sql("text") + ") AS fingerprint FROM documents")
def f05_fingerprint(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT id, " + WS.format(x="nfc_normalize(coalesce(question, ''))") + " AS plain FROM qa_examples")
def f06_minimal_text(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", T.minimal_text(F.col("question"), keep_lines=False).alias("plain"))


@query("SELECT doc_id, (length(text) >= 100 AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / length(text) >= 0.25 AND len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 8) AS informative FROM documents")
def f07_informative_block(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", T.informative(F.col("text")).alias("informative"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_extract_all(strip_accents(replace(lower(coalesce(title, '')), 'đ', 'd')), '[a-z0-9]+'), lambda t: NOT list_contains(['a','an','and','are','at','cach','cho','cua','how','is','la','must','of','the','to','what','when','why'], t)), ' ') AS tokens FROM documents")
def f08_ascii_tokens(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", F.array_join(T.ascii_tokens(F.col("title")), " ").alias("tokens"))


@query("SELECT id, array_to_string(" + legal_sql("question") + ", ' ') AS tokens FROM qa_examples")
def f09_legal_tokens(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", F.array_join(T.legal_tokens(F.col("question")), " ").alias("tokens"))


@query("SELECT doc_id, len(" + w("text") + ") AS words FROM documents")
def f10_word_tokens(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", F.size(T.word_tokens(F.col("text"))).cast("bigint").alias("words"))


@query("WITH t AS (SELECT id, unnest(" + w("question") + ") AS t, generate_subscripts(" + w("question") + ", 1) AS p FROM (SELECT DISTINCT id, question FROM qa_examples)), u AS (SELECT id, t, min(p) AS p FROM t WHERE length(t) >= 2 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM u) SELECT id, string_agg(t, ' ' ORDER BY n) AS terms FROM r WHERE n <= 32 GROUP BY id")
def f11_match_terms(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", "question").distinct().select("id", F.array_join(T.match_terms(F.col("question")), " ").alias("terms")).where("terms <> ''")


@query("WITH t AS (SELECT DISTINCT id, unnest(" + legal_sql("question") + ") AS t FROM qa_examples), u AS (SELECT id, t AS term FROM t UNION SELECT id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) FROM t) SELECT DISTINCT id, term FROM u")
def f12_expand_terms(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", F.explode(T.expand_terms(T.legal_tokens(F.col("question")))).alias("term")).distinct()


@query()
def f13_question_group(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", T.question_group(F.col("question")).alias("question_group"))


@query("SELECT id, nullif(upper(regexp_replace(metadata.document_number, '\\s+', '', 'g')), '') AS number FROM legal_documents")
def f14_canonical_number(spark, root):
    return spread_table(spark, root, "legal_documents").select("id", T.canonical_number(F.col("metadata.document_number")).alias("number"))


_META = WS.format(x=normal_sql("concat_ws(chr(10), coalesce(name, ''), substr(coalesce(passage, ''), 1, 5000), coalesce(link, ''))"))


@query(f"SELECT id, CASE lower(regexp_extract(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(Bộ luật|Luật|Nghị định|Thông tư liên tịch|Thông tư|Nghị quyết|Quyết định|Chỉ thị|Công văn|Pháp lệnh)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)) {' '.join(f'WHEN {chr(39)}{n.lower()}{chr(39)} THEN {chr(39)}{n}{chr(39)}' for n in T.DOCUMENT_TYPES)} END AS document_type, nullif(upper(regexp_extract(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:số\\s*)?(\\d{{1,5}}/(?:\\d{{4}}|[A-ZĐ]{{1,8}})(?:/[A-ZĐ0-9-]{{2,30}})?)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)), '') AS document_number FROM (SELECT id, {_META} AS t FROM legal_documents)")
def f15_document_metadata(spark, root):
    d = spread_table(spark, root, "legal_documents")
    return d.select("id", *[c.alias(n) for n, c in T.document_metadata(F.col("name"), F.col("passage"), F.col("link")).items()])


_ARTICLE = "(?i)điều\\s+(\\d+[a-zđ]?)(?:\\s+(bộ\\s+luật|luật|nghị\\s+định|thông\\s+tư(?:\\s+liên\\s+tịch)?|nghị\\s+quyết|quyết\\s+định|chỉ\\s+thị|công\\s+văn|pháp\\s+lệnh))?(?:\\s+(?:số\\s*)?(\\d{1,5}/(?:\\d{4}|[A-ZĐ]{1,8})(?:/[A-ZĐ0-9-]{2,30})?))?"


@query(f"""WITH t AS (SELECT DISTINCT id, {WS.format(x=normal_sql("answer"))} AS t FROM qa_examples),
 m AS (SELECT id, t, regexp_split_to_array(t, '{_ARTICLE}') AS ps, regexp_extract_all(t, '{_ARTICLE}') AS fs, regexp_extract_all(t, '{_ARTICLE}', 1) AS a, regexp_extract_all(t, '{_ARTICLE}', 2) AS k, regexp_extract_all(t, '{_ARTICLE}', 3) AS n FROM t),
 u AS (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM m),
 v AS (SELECT id, t, i, lower(a[i]) AS article, nullif(k[i], '') AS document_type, nullif(upper(regexp_replace(n[i], '\\s+', '', 'g')), '') AS document_number, fs[i] AS f, coalesce(list_sum(list_transform(range(1, i), lambda j: length(ps[j]) + length(fs[j]))), 0) + length(ps[i]) AS pos FROM u),
 w AS (SELECT *, regexp_extract(substr(t, CAST(greatest(pos - 70, 0) AS BIGINT) + 1, CAST(least(pos, 70) AS BIGINT)), '[^;.:]*$') AS before FROM v),
 x AS (SELECT *, regexp_extract_all(before, '(?i)khoản\\s+(\\d+[a-zđ]?)', 1) AS cl, regexp_extract_all(before, '(?i)điểm\\s+([a-zđ])', 1) AS pt FROM w),
 y AS (SELECT id, t, i, article, document_number, document_type, unnest(CASE WHEN len(cl) > 0 THEN list_transform(cl, lambda c: lower(c)) ELSE [NULL] END) AS clause, CASE WHEN len(pt) = 1 THEN lower(pt[1]) END AS point, trim(before || ' ' || f) AS raw FROM x),
 z AS (SELECT *, concat_ws('|', coalesce(document_number, ''), article, coalesce(clause, ''), coalesce(point, '')) AS key FROM y)
 SELECT id, article, document_number, document_type, clause, point, key, raw FROM (SELECT *, row_number() OVER (PARTITION BY id, t, key ORDER BY i) AS r FROM z) WHERE r = 1""")
def f16_citations(spark, root):
    d = spread_table(spark, root, "qa_examples").select("id", "answer").distinct().select("id", F.explode(C.citations(F.col("answer"))).alias("c"))
    return d.select("id", "c.*")


_PLAIN_ANSWER = WS.format(x=normal_sql("answer"))


@query(f"WITH t AS (SELECT id, {_PLAIN_ANSWER} AS t FROM qa_examples), c AS (SELECT id, t, unnest(regexp_extract_all(t, '(?i)điều\\s+(\\d+[a-zđ]?)', 1)) AS article FROM t) SELECT id, lower(article) AS article, regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(sửa đổi|bổ sung|bãi bỏ|thay thế|hết hiệu lực)(?:[^\\p{{L}}\\p{{N}}_]|$)') AS amends FROM c GROUP BY ALL")
def f17_cited_articles(spark, root):
    d = spread_table(spark, root, "qa_examples").select("id", T.normalize_text(F.col("answer"), keep_lines=False).alias("t"), C.citations(F.col("answer")).alias("c"))
    keyed = d.select("id", F.explode(C.reference_keys(F.col("c"))).alias("key"), C.amendment_keys(F.col("t"), F.col("c")).alias("amended"))
    return keyed.select("id", F.split("key", r"\|")[1].alias("article"), F.array_contains("amended", F.col("key")).alias("amends")).distinct()


@query("SELECT id, round(CASE WHEN length(passage) > 0 THEN len(regexp_extract_all(passage, '(?im)^\\s*(?:chương|mục|điều\\s+\\d+|\\d+[.)]\\s+)')) * 10000.0 / length(passage) ELSE 0 END, 6) AS density FROM legal_documents WHERE passage IS NOT NULL")
def f18_structure_density(spark, root):
    return spread_table(spark, root, "legal_documents").where("passage IS NOT NULL").select("id", F.round(T.structure_density(F.col("passage")), 6).alias("density"))


@query()
def f19_simhash(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", hygiene.simhash(F.col("text")).alias("signature"))


_SAFE = "regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce(title, '')), 'đ', 'dd')), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[1:80]"


@query(f"SELECT doc_id, CASE WHEN {_SAFE} <> '' THEN {_SAFE} ELSE substr(sha256(coalesce(title, '')), 1, 12) END AS safe FROM documents")
def f20_safe_id(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", T.safe_id(F.col("title")).alias("safe"))


_NOTE = "\\((?:Hình từ Internet|Ảnh minh họa)\\)"


def sanitized_sql(x):
    t = f"regexp_replace({normal_sql(x)}, '(?s)(?:…\\s*){{2,}}\\.?\\s*.*$', '')"
    t = f"regexp_replace(regexp_replace({t}, '(?is)\\n\\s*\\n[^\\n]{{1,300}}?\\s*{_NOTE}\\s*$', ''), '(?i){_NOTE}', '', 'g')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '[ \\t\\x{{00a0}}]+', ' ', 'g'), '(?m) +$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^{SPACES.format()}+|{SPACES.format()}+$', '', 'g')"


@query("SELECT id, " + sanitized_sql("answer") + " AS plain FROM qa_examples")
def f22_sanitize_answer(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", T.sanitize_answer(F.col("answer")).alias("plain"))


@query(f"SELECT id, regexp_matches(coalesce(answer, ''), '(?i){_NOTE}') AS media_note, regexp_matches(coalesce(answer, ''), '(?s)(?:…\\s*){{2,}}\\.?\\s*.*$') AS related_questions FROM qa_examples")
def f22_answer_residue(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", *[c.alias(n) for n, c in T.answer_residue(F.col("answer")).items()])


@query("SELECT doc_id, substr(text, start, 500) AS anchored FROM (SELECT *, greatest(1, least(greatest(instr(text, substr(text, n_chars // 2, 300)), 1) - 125, n_chars - 500 + 1)) AS start FROM documents)")
def f23_anchored_window(spark, root):
    body = F.substring(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int"), F.lit(300))
    return spread_table(spark, root, "documents").select("doc_id", T.anchored_window(F.col("text"), body, most=500).alias("anchored"))


@query("WITH t AS (SELECT doc_id, " + w("text") + " AS t FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) AS g FROM t) SELECT doc_id, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END, 6) AS rate FROM g")
def f24_repetition_rate(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", F.round(T.repetition_rate(T.word_tokens(F.col("text"))), 6).alias("rate"))


_MARKER = "(?i)(?:^|[^\\p{L}\\p{N}_])(?:điều|khoản|nghị" + SPACES.format() + "*định|thông" + SPACES.format() + "*tư|luật)(?:[^\\p{L}\\p{N}_]|$)"


def numbers_sql(x):
    return f"list_distinct(regexp_extract_all({x}, '(?:^|[^\\p{{L}}\\p{{N}}_])(\\p{{Nd}}+(?:[.,/]\\p{{Nd}}+)*)', 1))"


def repetition_sql(x):
    """Share of repeated four-word runs of a list of words."""
    grams = f"list_transform(range(1, len({x}) - 2), lambda i: array_to_string(({x})[i:i + 3], ' '))"
    return f"(CASE WHEN len({x}) >= 4 THEN 1 - len(list_distinct({grams})) / (len({x}) - 3) ELSE 0 END)"


@query(f"WITH t AS (SELECT id, question AS p, answer AS r, {w('question')} AS pw, len({w('question')}) / greatest(len({w('answer')}), 1) AS ratio FROM qa_examples WHERE answer IS NOT NULL AND question IS NOT NULL), l AS (SELECT id, unnest(list_filter([CASE WHEN trim(p) = '' THEN 'EMPTY_ANSWER' END, CASE WHEN ratio < 0.55 THEN 'LIKELY_MISSING_CONTENT_OR_TRUNCATION' END, CASE WHEN ratio > 1.8 THEN 'EXCESSIVE_VERBOSITY' END, CASE WHEN {repetition_sql('pw')} > 0.35 THEN 'TOKEN_REPETITION' END, CASE WHEN regexp_matches(r, '{_MARKER}') AND NOT regexp_matches(p, '{_MARKER}') THEN 'MISSING_LEGAL_STRUCTURE' END, CASE WHEN len(list_filter({numbers_sql('r')}, lambda n: NOT list_contains({numbers_sql('p')}, n))) > 0 THEN 'MISSING_REFERENCE_NUMBER' END, CASE WHEN len(list_filter({numbers_sql('p')}, lambda n: NOT list_contains({numbers_sql('r')}, n))) > 0 THEN 'EXTRA_OR_WRONG_NUMBER' END], lambda x: x IS NOT NULL)) AS label FROM t) SELECT id, label, count(*) AS n FROM l GROUP BY ALL")
def f27_error_labels(spark, root):
    d = spread_table(spark, root, "qa_examples").where("answer IS NOT NULL AND question IS NOT NULL")
    return d.select("id", F.explode(T.error_labels(F.col("question"), F.col("answer"))).alias("label")).groupBy("id", "label").agg(F.count("*").alias("n"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(q, '{'|'.join(ps)}') THEN 'question_{n}'" for n, ps in T.QUESTION_TYPES) + " ELSE 'question_other' END"


@query(f"SELECT id, unnest(['overall', CASE WHEN n < 200 THEN 'answer_short' WHEN n < 500 THEN 'answer_medium' ELSE 'answer_long' END, CASE WHEN regexp_matches(answer, '{_MARKER}') THEN 'legal_structure_yes' ELSE 'legal_structure_no' END, CASE WHEN regexp_matches(answer, '(?m)^\\s*(?:[-*]|\\d+[.)])\\s+') THEN 'list_yes' ELSE 'list_no' END, CASE WHEN contains(answer, chr(10)) THEN 'multiline_yes' ELSE 'multiline_no' END, {_KIND}]) AS slice FROM (SELECT id, answer, len({w('answer')}) AS n, lower(question) AS q FROM qa_examples WHERE answer IS NOT NULL)")
def f28_slice_labels(spark, root):
    d = spread_table(spark, root, "qa_examples").where("answer IS NOT NULL")
    return d.select("id", F.explode(T.slice_labels(F.col("question"), F.col("answer"))).alias("slice"))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-60, least(60, value)))), 9) AS p FROM events")
def f29_sigmoid(spark, root):
    return table(spark, root, "events").select("event_id", F.round(T.sigmoid(F.col("value")), 9).alias("p"))


def _text_sql(x):
    return "'" + x.replace("'", "''") + "'"


@query(f"SELECT id, {_text_sql(T.SYSTEM_PROMPT)} AS system, {_text_sql(T.QUESTION_HEAD)} || coalesce(question, '') || {_text_sql(T.EVIDENCE_TITLE)} || CASE WHEN answer IS NULL THEN {_text_sql(T.NO_EVIDENCE)} ELSE {_text_sql(T.EVIDENCE_HEAD)} || '1 — ' || coalesce(source, '') || ']' || chr(10) || answer END || {_text_sql(T.ANSWER_HEAD)} AS asked FROM qa_examples")
def f30_messages(spark, root):
    """Each question with its answer, if it has one, as the evidence."""
    evidence = F.when(F.col("answer").isNotNull(), F.array(F.struct(F.col("source").alias("source_name"), F.col("answer").alias("text"))))
    d = spread_table(spark, root, "qa_examples").select("id", T.messages(F.col("question"), evidence).alias("m"))
    return d.select("id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("asked"))


@query("SELECT source, sha256(string_agg(id, chr(10) ORDER BY id) || chr(10)) AS digest FROM (SELECT DISTINCT source, id FROM qa_examples) GROUP BY source")
def f31_set_hash(spark, root):
    ids = spread_table(spark, root, "qa_examples").select("source", "id").distinct()
    return ids.groupBy("source").agg(T.set_hash(F.collect_list("id")).alias("digest"))


@query("SELECT id, substr(sha1(id || chr(31) || coalesce(source, '')), 1, 20) AS stable FROM qa_examples")
def f31_stable_id(spark, root):
    return spread_table(spark, root, "qa_examples").select("id", T.stable_id(F.col("id"), F.col("source")).alias("stable"))


@query("SELECT doc_id, source FROM documents WHERE lang IN ('vi') AND source IN ('luatviet-moi', 'banan-tonghop')")
def pred01_eligible(spark, root):
    from tamarack.operators.quality import eligible

    return eligible(spread_table(spark, root, "documents").withColumn("access_scope", F.col("lang")), ["vi"], source=["luatviet-moi", "banan-tonghop"]).select("doc_id", "source")


@query("WITH d AS (SELECT DISTINCT id, passage FROM legal_documents), f AS (SELECT id, passage, CASE WHEN passage IS NOT NULL THEN min(id) OVER (PARTITION BY md5(passage)) END AS first FROM d), i AS (SELECT doc_id, bool_and(json_valid) AS ok FROM raw_inventory GROUP BY doc_id) SELECT id, CASE WHEN NOT coalesce(ok, true) THEN 'invalid_json' WHEN passage IS NULL OR trim(passage) = '' THEN 'empty_passage' WHEN first <> id THEN 'exact_duplicate_alias' ELSE 'INCLUDED' END AS status FROM f LEFT JOIN i ON f.id = i.doc_id")
def pred02_document_status(spark, root):
    d = spread_table(spark, root, "legal_documents").select("id", "passage").distinct()
    first = d.where("passage IS NOT NULL").groupBy(F.md5("passage").alias("fp")).agg(F.min("id").alias("first"))
    valid = table(spark, root, "raw_inventory").groupBy("doc_id").agg(F.bool_and("json_valid").alias("ok"))
    j = d.withColumn("fp", F.md5("passage")).join(first, "fp", "left").join(valid, F.col("id") == F.col("doc_id"), "left")
    blank = F.col("passage").isNull() | (F.trim("passage") == "")
    return j.select("id", hygiene.document_status(F.coalesce("ok", F.lit(True)), blank, F.coalesce(F.col("passage").rlike(hygiene.PAYWALL), F.lit(False)), F.col("first"), F.col("id")).alias("status"))


@query("SELECT id, length(passage) >= 200000 AS very_long, len(regexp_extract_all(passage, '(?im)^\\s*(?:chương|mục|điều\\s+\\d+|\\d+[.)]\\s+)')) * 10000.0 / nullif(length(passage), 0) < 0.25 AS low_density FROM legal_documents WHERE passage IS NOT NULL AND passage <> ''")
def pred03_length_flags(spark, root):
    d = spread_table(spark, root, "legal_documents").where("passage IS NOT NULL AND passage <> ''").withColumn("f", hygiene.length_flags(F.col("passage")))
    return d.select("id", F.array_contains("f", "very_long").alias("very_long"), F.array_contains("f", "low_structure_density").alias("low_density"))


@query("WITH l AS (SELECT id, lower(trim(regexp_replace(unnest(string_split(retrieval_text, chr(10))), '\\s+', ' ', 'g'))) AS line FROM legal_documents) SELECT CASE WHEN regexp_matches(line, 'điều \\d+|khoản \\d+') THEN 'protected' WHEN line IN ('xin cảm ơn.') THEN 'blacklist' WHEN regexp_matches(line, '^(?:trang chủ > .*|tổng đài hỗ trợ .*)$') THEN 'blacklist' ELSE 'manual_review' END AS class, count(*) AS lines FROM l GROUP BY class")
def pred04_classify_lines(spark, root):
    lines = spread_table(spark, root, "legal_documents").select("id", F.explode(F.split("retrieval_text", "\n")).alias("line"))
    return lines.groupBy(hygiene.classify_line(F.col("line"), [r"điều \d+", r"khoản \d+"], ["xin cảm ơn."], [r"trang chủ > .*", r"tổng đài hỗ trợ .*"]).alias("class")).agg(F.count("*").alias("lines"))


@query("SELECT id, array_to_string(list_filter(string_split(retrieval_text, chr(10)), lambda l: NOT regexp_matches(trim(regexp_replace(lower(l), '\\s+', ' ', 'g')), '^trang chủ > .*$')), chr(10)) AS kept FROM legal_documents")
def pred06_boilerplate_lines(spark, root):
    kept = F.filter(F.split("retrieval_text", "\n"), lambda line: hygiene.classify_line(line, [], [], ["trang chủ > .*"]) != "blacklist")
    return spread_table(spark, root, "legal_documents").select("id", F.array_join(kept, "\n").alias("kept"))


_ROUTE = "(?im)^[ \\t]*nơi\\s+nhận\\s*:"


def routed_sql(t: str, start: str) -> str:
    """The text t without a last routing block that begins at start."""
    return f"CASE WHEN regexp_matches({t}, '{_ROUTE}') AND {start} / greatest(length({t}), 1) >= 0.85 AND regexp_matches(substr({t}, {start} + 1), '(?im)^[ \\t]*[-–—+]\\s*\\S+|^[ \\t]*(?:kt\\.|tl\\.|tuq\\.)?\\s*(?:bộ\\s+trưởng|thứ\\s+trưởng|chủ\\s+tịch|phó\\s+chủ\\s+tịch)(?:[^\\p{{L}}]|$)') THEN regexp_replace(substr({t}, 1, {start}), '\\s+$', '') ELSE {t} END"


def route_start_sql(t: str) -> str:
    return f"length({t}) - length(string_split(regexp_replace({t}, '{_ROUTE}', chr(1) || 'Nơi nhận:', 'g'), chr(1))[-1])"


@query(f"SELECT id, {routed_sql('t', 'start')} AS retrieval FROM (SELECT id, generation_text AS t, {route_start_sql('generation_text')} AS start FROM legal_documents)")
def pred07_routing_block(spark, root):
    return spread_table(spark, root, "legal_documents").select("id", hygiene.without_routing(F.col("generation_text")).alias("retrieval"))


@query(f"WITH t AS (SELECT id, answer, {w('answer')} AS t FROM qa_examples WHERE answer IS NOT NULL) SELECT id, unnest(list_filter([CASE WHEN len(t) < 20 THEN 'VERY_SHORT_REVIEW' END, CASE WHEN {repetition_sql('t')} > 0.10 THEN 'REPEATED_4GRAM_REVIEW' END, CASE WHEN NOT regexp_matches(answer, '{_MARKER}') THEN 'LEGAL_MARKER_ABSENT' END, CASE WHEN NOT regexp_matches(rtrim(answer), '[.!?:;)\\]]$') THEN 'ENDING_REVIEW' END], lambda x: x IS NOT NULL)) AS flag FROM t")
def pred12_output_flags(spark, root):
    return spread_table(spark, root, "qa_examples").where("answer IS NOT NULL").select("id", F.explode(T.output_flags(F.col("answer"))).alias("flag"))


@query(f"SELECT id, len(list_filter(string_split(generation_text, chr(10)), lambda l: list_contains([{', '.join(_text_sql(x.lower()) for x in hygiene.WEB_LINES)}], {WS.format(x='lower(l)')}) OR {' OR '.join(f'starts_with({WS.format(x=chr(108) + chr(111) + chr(119) + chr(101) + chr(114) + chr(40) + chr(108) + chr(41))}, {_text_sql(x.lower())})' for x in hygiene.WEB_PREFIXES)} OR {' OR '.join(f'regexp_matches(l, {_text_sql(chr(40) + chr(63) + chr(105) + chr(41) + x)})' for x in hygiene.WEB_CODE)})) AS web_lines FROM legal_documents")
def pred05_web_lines(spark, root):
    found = F.filter(F.split("generation_text", "\n"), hygiene.is_web_line)
    return spread_table(spark, root, "legal_documents").select("id", F.size(found).cast("bigint").alias("web_lines"))


@query("WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents), p AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM s) SELECT doc_id, doc_id || '::c' || lpad(CAST(i // 2 AS VARCHAR), 3, '0') AS chunk_id, string_agg(x, ' ' ORDER BY i) AS chunk FROM p GROUP BY doc_id, i // 2")
def e01_sentence_chunks(spark, root):
    return chunking.sentence_chunks(spread_table(spark, root, "documents"), "text").select("doc_id", "chunk_id", "chunk")


@query()
def e02_long_text_windows(spark, root):
    d = spread_table(spark, root, "legal_documents").select("id", F.posexplode(chunking.long_text_windows(F.col("passage"), 600, 80)).alias("ordinal", "body"))
    return d


_S = SPACES.format()


@query(f"""WITH RECURSIVE d AS (SELECT DISTINCT id, passage AS t, length(regexp_extract(passage, '^{_S}*')) AS a, length(regexp_replace(passage, '{_S}+$', '')) AS z FROM legal_documents WHERE passage IS NOT NULL),
 w AS (SELECT id, t, z, 0 AS n, a AS pos, {{until}} AS until FROM (SELECT *, a AS pos FROM d WHERE a < z)
  UNION ALL SELECT id, t, z, n + 1, pos, {{until}} FROM (SELECT id, t, z, n, b + length(regexp_extract(substr(t, b + 1), '^{_S}*')) AS pos FROM (SELECT *, greatest(pos + 1, until - 220) AS b FROM w WHERE until < z)))
 SELECT id, row_number() OVER (PARTITION BY id, t ORDER BY n) - 1 AS ordinal, pos AS start, pos + length(body) AS "end", body FROM (SELECT *, regexp_replace(substr(t, pos + 1, until - pos), '{_S}+$', '') AS body FROM w)""".replace("{until}", "CASE WHEN pos + 1800 < z AND regexp_matches(substr(t, pos + 1081, 720), '[\\n ]') THEN pos + 1080 + length(regexp_extract(substr(t, pos + 1081, 720), '(?s)^(.*)[\\n ]', 1)) ELSE least(z, pos + 1800) END"))
def e03_window_spans(spark, root):
    d = spread_table(spark, root, "legal_documents").select("id", "passage").distinct()
    cut = d.select("id", "passage", F.posexplode(chunking.window_spans(F.col("passage"))).alias("ordinal", "s"))
    return cut.select("id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), F.substring("passage", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("body"))


_LINES_SQL = "l AS (SELECT id, unnest(string_split(passage, chr(10))) AS line, generate_subscripts(string_split(passage, chr(10)), 1) - 1 AS line_no FROM (SELECT DISTINCT id, passage FROM legal_documents)), m AS (SELECT *, nullif(lower(regexp_extract(line, '(?i)^\\s*điều\\s+(\\d+[a-zđ]?)', 1)), '') AS a FROM l WHERE trim(line) <> ''), s AS (SELECT *, count(a) OVER (PARTITION BY id ORDER BY line_no) AS segment FROM m)"


@query("WITH " + _LINES_SQL + " SELECT id AS doc_id, CAST(segment AS BIGINT) AS segment, max(a) AS article, string_agg(line, chr(10) ORDER BY line_no) AS body FROM s GROUP BY id, segment")
def e04_articles(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "passage").distinct()
    return chunking.articles(d, "passage").select("doc_id", "segment", "article", "body")


@query("WITH " + _LINES_SQL + ", c AS (SELECT *, first_value(a) OVER (PARTITION BY id, segment ORDER BY line_no) AS article, nullif(regexp_extract(line, '^\\s*(\\d+)[.)]\\s', 1), '') AS cl FROM s), d AS (SELECT *, count(cl) OVER (PARTITION BY id, segment ORDER BY line_no) AS k FROM c) SELECT id AS doc_id, line_no, article, first_value(cl) OVER (PARTITION BY id, segment, k ORDER BY line_no) AS clause FROM d")
def e05_clauses(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "passage").distinct()
    return chunking.legal_lines(d, "passage").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "article", "clause")


@query()
def e06_packed_chunks(spark, root):
    d = spread_table(spark, root, "legal_documents").select(F.col("id").alias("doc_id"), "passage").distinct()
    return chunking.pack_segments(chunking.legal_lines(d, "passage"), 600)


@query("SELECT doc_id, substr(text, greatest(0, least(CAST(floor((100 + least(n_chars, 900)) / 2) AS INT) - 250, n_chars - 500)) + 1, 500) AS parent FROM documents")
def e08_parent_window(spark, root):
    return spread_table(spark, root, "documents").select("doc_id", chunking.parent_window(F.col("text"), F.lit(100), F.least(F.length("text"), F.lit(900)), 500).alias("parent"))


@query("SELECT doc_id, count(*) AS parts FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: length(l) BETWEEN 20 AND 500)) FROM documents) GROUP BY doc_id")
def e10_normalized_lines(spark, root):
    lines = spread_table(spark, root, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.length(F.trim("l")).between(20, 500))
    return lines.groupBy("doc_id").agg(F.count("*").alias("parts"))

"""Queries on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import classify as C
from tallyloom.functions import dictionaries as D
from tallyloom.functions import extract as X
from tallyloom.functions import scoring as S
from tallyloom.functions import text as T
from tallyloom.operators import matching, phrases, selection, semantics, training
from tallyloom.plans import duck, stages
from tallyloom.plans.registry import Registry
from tallyloom.plans.tables import BANK_TOPICS, bank, graded_answers, table
from tallyloom.sources import io, pdf

register = Registry()
QUERIES, SQL = register.queries, register.sql

AS_OF_YEAR = 2024


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


@register(f"""WITH w AS (SELECT doc_id, {duck.tok("text")} AS w FROM documents)
SELECT doc_id, i::INT AS chunk, len(w[i * 300 + 1 : i * 300 + 300])::INT AS n_words, md5(array_to_string(w[i * 300 + 1 : i * 300 + 300], ' ')) AS digest
FROM w, unnest(range(0, (len(w) + 299) // 300)) AS r(i)""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 300 words."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("chunk", "part"))
    return rows.select("doc_id", "chunk", T.n_words(F.col("part")).alias("n_words"), F.md5("part").alias("digest"))


@register(f"""SELECT doc_id, md5({duck.clean_text("text")}) AS cleaned, md5({duck.clean_lines("text")}) AS lines, md5(array_to_string({duck.tok("text")}[1:400], ' ')) AS head,
  md5({duck.fold_marks("text")}) AS folded, {duck.n_words("text")}::INT AS n_words, len(list_distinct({duck.tok("text")}))::INT AS n_distinct FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms, as digests, and word counts; a text is split once for the three that go by words."""
    x = F.col("text")
    return _documents(spark, sf_dir).withColumn("words", T.tok(x)).select(
        "doc_id",
        F.md5(T.clean_text(x)).alias("cleaned"),
        F.md5(T.clean_lines(x)).alias("lines"),
        F.md5(F.array_join(F.slice("words", 1, 400), " ")).alias("head"),
        F.md5(T.fold_marks(x)).alias("folded"),
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )


@register(f"""WITH e AS (SELECT doc_id, nullif(regexp_extract(text, {duck.lit(X.EMAIL)}), '') AS email, nullif(regexp_extract(text, {duck.lit(X.PHONE)}), '') AS phone,
  list_transform(regexp_extract_all(text, '{X.YEAR}'), lambda y: y::INT) AS years, regexp_matches(lower(text), 'present|current') AS open FROM documents)
SELECT doc_id, email, phone, (CASE WHEN len(years) >= 2 THEN list_max(years) - list_min(years) WHEN len(years) = 1 AND open THEN {AS_OF_YEAR} - years[1] ELSE 0 END)::INT AS duration_years,
  CASE WHEN len(years) >= 2 OR (len(years) = 1 AND open) THEN list_min(years) END AS start_year,
  CASE WHEN len(years) >= 2 THEN list_max(years) WHEN len(years) = 1 AND open THEN {AS_OF_YEAR} END AS end_year FROM e""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First e-mail address, first phone number, and the span of years."""
    x = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", X.email(x).alias("email"), X.phone(x).alias("phone"), X.year_range(x, AS_OF_YEAR).alias("y")).select("doc_id", "email", "phone", "y.*")


@register(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {duck.lit(X.DATE)})))[1:10], ';') AS dates FROM documents""")
def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct date mentions in order, ten at most."""
    return _documents(spark, sf_dir).select("doc_id", F.array_join(X.entities(F.col("text"))["dates"], ";").alias("dates"))


def _paragraphs_sql() -> str:
    raw = "|".join(["<!--.*?(?:-->|\\z)", *[f"<{t}(?:\\s[^>]*)?>.*?(?:</{t}\\s*>|\\z)" for t in D.RAW_TAGS]])
    names = "|".join(t for t in D.DROPPED_TAGS if t not in D.RAW_TAGS)
    bare = f"regexp_replace(replace(html, chr(1), ''), '(?is){raw}', '', 'g')"
    pieces = f"string_split(regexp_replace({bare}, '(?i)(</?(?:{names})[\\s/>])', chr(1) || '\\1', 'g'), chr(1))"
    name = f"lower(regexp_extract(e.piece, '(?i)^</?({names})[\\s/>]', 1))"
    opens = f"({name} <> '' AND NOT starts_with(e.piece, '</') AND NOT regexp_matches(e.piece, '^<[^>]*/>'))"
    depth = f"(CASE WHEN s.depth = 0 THEN {opens}::INT WHEN {name} <> s.inside THEN s.depth WHEN starts_with(e.piece, '</') THEN s.depth - 1 ELSE s.depth + {opens}::INT END)"
    new = f"CASE WHEN {depth} > 0 THEN s.piece ELSE s.piece || CASE WHEN {name} <> '' THEN regexp_replace(e.piece, '^<[^>]*>?', ' ') ELSE e.piece END END"
    part = "struct_pack(inside := '', depth := 0, piece := {})"
    folded = f"list_reduce(list_prepend({part.format(repr(''))}, list_transform({pieces}, lambda q: {part.format('q')})), lambda s, e: struct_pack(inside := CASE WHEN s.depth = 0 THEN {name} ELSE s.inside END, depth := {depth}, piece := {new}))"
    x = f"({folded}).piece"
    parts = f"string_split_regex({x}, '(?i)<p(?:\\s[^>]*)?>')[2:]"
    bodies = f"list_transform({parts}, lambda p: string_split_regex(p, '(?i)</p>')[1])"
    text = f"regexp_replace(array_to_string({bodies}, ' '), '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return duck.collapse(text)


@register(f"""WITH p AS (SELECT page_id, {_paragraphs_sql()} AS t FROM pages)
SELECT page_id, length(t)::INT AS n_chars, md5(t) AS digest, {duck.count_of("lower(t)", D.RELEVANCE_TERMS)} >= 2 AS relevant,
  md5(CASE WHEN length(t) >= 300 THEN substr(t, 1, 4000) ELSE '' END) AS kept FROM p""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph text of pages, with the length rule and the subject flag."""
    rows = table(spark, sf_dir, "pages").select("page_id", X.html_paragraphs(F.col("html")).alias("t"))
    kept = F.when(F.length("t") >= 300, T.char_prefix(F.col("t"), 4000)).otherwise("")
    return rows.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"), X.is_relevant(F.col("t")).alias("relevant"), F.md5(kept).alias("kept"))


_ALLOWED = ["example.com", "example.org"]


@register(f"""SELECT DISTINCT lower(url) AS url, {duck.has("lower(url)", D.ALLOWED_DOMAINS)} AS listed, {duck.has("lower(url)", _ALLOWED)} AS allowed, {duck.has("lower(url)", D.BLOCKED_URL_WORDS)} AS blocked FROM pages""")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow and block lists over distinct addresses."""
    u = F.col("url")
    rows = table(spark, sf_dir, "pages").select(F.lower(u).alias("url")).distinct()
    return rows.select("url", X.url_allowed(u, D.ALLOWED_DOMAINS).alias("listed"), X.url_allowed(u, _ALLOWED).alias("allowed"), X.url_blocked(u, D.BLOCKED_URL_WORDS).alias("blocked"))


# Lexical scores.


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole answer against the benchmark text it is dealt to."""
    return graded_answers(spark, sf_dir).select("conv_id", "turn", S.folded(F.col("answer")).alias("u"), S.folded(F.col("reference")).alias("r"), S.folded(F.col("question")).alias("q"))


_GRADED_OF = f"""g AS (
  SELECT conv_id, turn, {duck.strip("answer")} AS u, {duck.strip("reference")} AS r, {duck.strip("question")} AS q FROM dealt
), l AS (SELECT conv_id, turn, lower(u) AS u, lower(r) AS r, lower(q) AS q FROM g
), o AS (SELECT *, {duck.shared("u", "r")} AS o, {duck.shared("u", "q")} AS p, {duck.n_words("u")} AS n FROM l
), m AS (SELECT *, length(u) < 5 OR {duck.has("u", D.GIBBERISH)} AS gibberish,
  least(0.99, (CASE WHEN o >= 3 THEN 0.85 + o * 0.05 WHEN o = 2 THEN 0.7 WHEN o = 1 THEN 0.5 WHEN p >= 2 AND n > 10 THEN 0.65 ELSE 0.2 END)::DOUBLE * (CASE WHEN n < 5 THEN 0.6 WHEN n > 50 THEN 1.05 ELSE 1.0 END)::DOUBLE) AS lexical FROM o
), s AS (SELECT *, (CASE WHEN gibberish THEN 0 WHEN length(u) < 8 THEN 0.25 ELSE lexical END)::DOUBLE AS main FROM m)"""
_GRADED = f"WITH {duck.ANSWERS}, {_GRADED_OF}"


@register(f"""{_GRADED} SELECT conv_id, turn, gibberish, round(lexical, 6) AS lexical, round(main, 6) AS main_score,
{duck.banded("main", [(0.85, "excellent"), (0.70, "good"), (0.50, "partially correct"), (0.25, "weak")], "incorrect")} AS feedback FROM s""")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap score of answers behind the gates."""
    rows = _graded(spark, sf_dir)
    u, r, q = (F.col(c) for c in "urq")
    main = S.main_score(u, r, q)
    return rows.select(
        "conv_id",
        "turn",
        S.is_gibberish(u).alias("gibberish"),
        F.round(S.lexical_score(u, r, q), 6).alias("lexical"),
        F.round(main, 6).alias("main_score"),
        S.score_feedback(main).alias("feedback"),
    )


def _fill_sql() -> str:
    pairs = " OR ".join(f"(uf = {duck.lit(a)} AND rf = {duck.lit(b)}) OR (uf = {duck.lit(b)} AND rf = {duck.lit(a)})" for a, b in D.ACRONYMS.items())
    same = f"list_sort(list_distinct({duck.tok('uf')})) = list_sort(list_distinct({duck.tok('rf')}))"
    return f"(CASE WHEN uf = rf OR {pairs} THEN 1 WHEN contains(uf, rf) THEN 0.95 WHEN contains(rf, uf) THEN 0.9 WHEN {same} THEN 0.95 WHEN {duck.shared('uf', 'rf')} >= 2 THEN 0.85 ELSE 0 END)::DOUBLE"


_ACRONYM_LIST = [x for kv in D.ACRONYMS.items() for x in kv]


@register(f"""{_GRADED}, f AS (SELECT conv_id, turn, main, CASE turn % 4 WHEN 1 THEN array_to_string({duck.tok("u")}[1:2], ' ') WHEN 3 THEN u ELSE {duck.strings(_ACRONYM_LIST)}[1 + (conv_id + turn) % {len(_ACRONYM_LIST)}] END AS uf,
  CASE WHEN turn % 4 IN (1, 3) THEN r ELSE {duck.strings(_ACRONYM_LIST)}[1 + (conv_id + turn + 1) % {len(_ACRONYM_LIST)}] END AS rf FROM s
), h AS (SELECT *, {_fill_sql()} AS fill FROM f), c AS (SELECT *, main * 0.7 + fill * 0.3 AS combined FROM h)
SELECT conv_id, turn, md5(uf) AS uf, md5(rf) AS rf, fill, round(combined, 6) AS combined,
  (CASE WHEN fill > 0 AND main >= 0.7 THEN least(10, round_even(combined * 10, 0) + 1) ELSE round_even(combined * 10, 0) END)::INT AS marks FROM c""")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-ins, the blend with the main score, and marks.

    A fill-in is the answer's first two words or the whole answer, against
    the whole reference, or one of the abbreviations and their full forms.
    """
    u, r, q = (F.col(c) for c in "urq")
    names = F.array(*map(F.lit, _ACRONYM_LIST))
    kind = F.col("turn") % 4
    at = (F.col("conv_id") + F.col("turn")).cast("int")
    rows = _graded(spark, sf_dir).select(
        "conv_id",
        "turn",
        S.main_score(u, r, q).alias("main"),
        F.when(kind == 1, F.array_join(F.slice(T.tok(u), 1, 2), " ")).when(kind == 3, u).otherwise(F.get(names, at % len(_ACRONYM_LIST))).alias("uf"),
        F.when(kind.isin(1, 3), r).otherwise(F.get(names, (at + 1) % len(_ACRONYM_LIST))).alias("rf"),
    )
    rows = rows.withColumn("fill", S.fill_score(F.col("uf"), F.col("rf")))
    combined = S.combined_score(F.col("main"), F.col("fill"))
    return rows.select("conv_id", "turn", F.md5("uf").alias("uf"), F.md5("rf").alias("rf"), "fill", F.round(combined, 6).alias("combined"), S.marks(F.col("main"), F.col("fill")).alias("marks"))


# Session scores.

_SPICE = {
    0: "",
    1: "the process is a thread because memory and cpu then ",
    2: "first step a database query is not the same while ",
    3: "a class object method is ",
    4: "the array tree graph ",
}


def _spiced(x: F.Column, by: F.Column) -> F.Column:
    """Some subject words before a whole invented answer, so that more branches are met; blanks are collapsed."""
    return T.collapse(F.concat(F.coalesce(*[F.when(by % 5 == k, v) for k, v in _SPICE.items()]), x))


def _spiced_sql(x: str, by: str) -> str:
    head = "(CASE " + " ".join(f"WHEN {by} % 5 = {k} THEN {duck.lit(v)}" for k, v in _SPICE.items()) + " END)"
    return duck.collapse(f"{head} || {x}")


def _session_sql() -> str:
    words = "[" + ", ".join(duck.strings(D.ANSWER_KEYWORDS[t]) for t in ("DSA", "OS", "DBMS", "CN", "OOP")) + "][1 + slot % 5]"

    def depth(table_: dict, name: str) -> str:
        value = duck.banded("n", table_[name])
        return f"(CASE WHEN {duck.has('low', D.CUES[name])} THEN {value} ELSE 40 END)" if name in D.CUES and name in table_ else value

    def by_intent(table_: dict) -> str:
        return "CASE intent " + " ".join(f"WHEN '{i}' THEN {depth(table_, i)}" for i in table_ if i != "other") + f" ELSE {depth(table_, 'other')} END"

    stop = duck.strings(D.BONUS_STOP_WORDS)
    missing = "CASE intent " + " ".join(f"WHEN {duck.lit(k)} THEN {duck.lit(v)}" for k, v in D.MISSING_DEPTH.items()) + " ELSE 'More comprehensive answer' END"
    coherent = f"NOT (n < 5 AND ({duck.has('low', D.CODE_MARKS)} OR NOT {duck.has('low', D.VERB_STEMS)}))"
    return f"""WITH {duck.ANSWERS}, {duck.BANK}, a AS (
  SELECT conv_id, turn, slot, {_spiced_sql("answer", "(conv_id + turn)")} AS u, reference AS m, b.topic, b.intent, b.difficulty
  FROM dealt JOIN bank b ON b.question_id = slot
), b AS (SELECT *, lower(u) AS low, {duck.n_words("u")} AS n, {duck.n_words("m")} AS nm, {words} AS keys,
  list_filter(list_transform({duck.tok("lower(u)")}, lambda w: w), lambda w: NOT list_contains({stop}, w)) AS uk,
  list_filter({duck.tok("lower(m)")}, lambda w: NOT list_contains({stop}, w)) AS mk0,
  regexp_matches({duck.strip("lower(u)")}, {duck.lit("^(?:" + "|".join(D.QUESTION_PREFIXES) + ")")}) AS asks FROM a
), k AS (SELECT *, len(list_filter(keys, lambda w: contains(low, w))) AS hits, len(keys) AS total, {coherent} AS coherent,
  CASE WHEN asks THEN {duck.rule_intent(duck.fold_case("u"))} ELSE 'unknown' END AS answer_intent,
  asks AND list_contains({duck.rule_topics(duck.fold_case("u"))}, topic) AS on_topic,
  list_filter(mk0, lambda w, i: list_position(mk0, w) = i) AS mk FROM b
), c AS (SELECT *, (CASE WHEN NOT coherent THEN 8 WHEN hits >= 3 AND on_topic THEN 100 WHEN hits >= 3 THEN 75 + hits / total * 20 WHEN hits >= 1 THEN 45 + hits / total * 15 WHEN n >= 5 THEN 35 ELSE 10 END)::DOUBLE AS coverage,
  (CASE WHEN answer_intent = intent THEN 100 WHEN list_sort([answer_intent, intent]) IN (['definition', 'explanation'], ['comparison', 'procedure']) THEN 85 WHEN intent IN ('definition', 'explanation') AND n >= 5 THEN 65 ELSE 45 END)::DOUBLE AS intent_score,
  (CASE WHEN len(mk) > 0 THEN len(list_intersect(uk, mk)) / len(mk) * 40 + least(n / greatest(nm, 1), 1.0) * 30 + len(list_intersect(uk, mk[1:5])) / len(mk[1:5]) * 30 ELSE 0 END)::DOUBLE AS bonus FROM k
), d AS (SELECT *, (CASE WHEN coverage < 20 THEN 5 WHEN coverage < 70 THEN {by_intent(D.DEPTH_PARTIAL)} ELSE {by_intent(D.DEPTH_GOOD)} END)::DOUBLE AS depth FROM c
), e AS (SELECT *, coverage * 0.5 + intent_score * 0.25 + depth * 0.25 AS base, length({duck.strip("u")}) >= 2 AS has_some, regexp_matches(u, '[\\p{{L}}\\p{{N}}]') AS words FROM d
), f AS (SELECT *, greatest(0, least(100, CASE WHEN base >= 75 AND bonus > 0 THEN base + bonus * 0.25 ELSE base END)) AS full_score FROM e
), g AS (SELECT *, (CASE WHEN NOT has_some THEN 0 WHEN NOT words THEN 5 ELSE full_score END)::DOUBLE AS score FROM f)
SELECT conv_id, turn, round(coverage, 6) AS coverage, intent_score, depth, round(bonus, 6) AS bonus, round(score, 6) AS score,
  {duck.banded("round(score, 9)", [(85, "excellent"), (65, "mostly_correct"), (40, "partially_correct")], "blatantly_wrong")} AS grade, round(score, 9) >= 60 AS is_correct,
  CASE WHEN coverage < 50 OR intent_score < 50 OR depth < 60 THEN array_to_string(list_filter([CASE WHEN coverage < 50 THEN 'Core topic knowledge (' || topic || ')' END,
    CASE WHEN intent_score < 50 THEN 'More ' || intent || ' (currently sounds like ' || answer_intent || ')' END, CASE WHEN depth < 60 THEN {missing} END], lambda x: x IS NOT NULL), ';')
  ELSE 'Overall seems good, keep practicing!' END AS missing FROM g"""


@register(_session_sql())
def session_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded session answers.  Intent and topics of an answer are read as of a question, so plain statements have none."""
    questions = bank(spark, sf_dir).select(F.col("question_id").alias("slot"), "topic", "intent", "difficulty")
    rows = graded_answers(spark, sf_dir).join(matching.small(questions), "slot")
    u = F.col("u")
    asks = C.is_question(u)
    rows = rows.select("conv_id", "turn", _spiced(F.col("answer"), F.col("conv_id") + F.col("turn")).alias("u"), F.col("reference").alias("m"), F.array("topic").alias("topics"), "intent")
    rows = rows.withColumns(
        {
            "answer_intent": F.when(asks, C.rule_intent(u)).otherwise("unknown"),
            "answer_topics": F.when(asks, C.rule_topics(u)).otherwise(F.array().cast("array<string>")),
        }
    )
    rows = rows.withColumn("coverage", S.topic_coverage(u, F.col("topics"), F.col("answer_topics"))).withColumns(
        {
            "intent_score": S.intent_match(F.col("answer_intent"), F.col("intent"), T.n_words(u)),
            "depth": S.comprehensiveness(u, F.col("intent"), F.col("coverage")),
            "bonus": S.model_bonus(u, F.col("m")),
        }
    )
    whole = S.overall_score(F.col("coverage"), F.col("intent_score"), F.col("depth"), F.col("bonus"))
    gated = F.when(F.length(T.strip(u)) < 2, 0.0).when(~S.is_valid_answer(u), 5.0).otherwise(whole)
    rows = rows.withColumn("score", gated)
    found = S.missing_concepts(F.col("coverage"), F.col("intent_score"), F.col("depth"), F.col("topics"), F.col("intent"), F.col("answer_intent"))
    exact = F.round("score", 9)
    return rows.select(
        "conv_id",
        "turn",
        F.round("coverage", 6).alias("coverage"),
        "intent_score",
        "depth",
        F.round("bonus", 6).alias("bonus"),
        F.round("score", 6).alias("score"),
        S.session_grade(exact).alias("grade"),
        (exact >= 60).alias("is_correct"),
        F.array_join(found, ";").alias("missing"),
    )


# Rule classifiers and calibration.

_ASKS = ["What is ", "Explain ", "Compare ", "How does ", "Why ", "Implement ", "How would you ", "Define ", "The ", "What is the difference between "]
_SUBJECTS = ["a process and a thread", "the hash table", "sql joins", "tcp handshake", "class inheritance", "a binary tree", "routing", "a distributed architecture", "udp", "nothing much"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, text): question forms and subjects dealt over parts."""
    i = F.col("p_partkey").cast("int")
    ask, subject = F.get(F.array(*map(F.lit, _ASKS)), i % 10), F.get(F.array(*map(F.lit, _SUBJECTS)), F.floor(i / 10).cast("int") % 10)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.concat(ask, subject, F.lit(" of  a "), "p_name").alias("text"))


_Q = f"""questions AS (SELECT p_partkey AS question_id, {duck.strings(_ASKS)}[1 + p_partkey % 10] || {duck.strings(_SUBJECTS)}[1 + (p_partkey // 10) % 10] || ' of  a ' || p_name AS text FROM part),
folded AS (SELECT question_id, text, {duck.fold_case("text")} AS q, regexp_matches({duck.strip("lower(text)")}, {duck.lit("^(?:" + "|".join(D.QUESTION_PREFIXES) + ")")}) AS valid FROM questions)"""


@register(f"WITH {_Q} SELECT question_id, valid, {duck.rule_intent('q')} AS intent, CASE WHEN valid THEN 0.6 END AS confidence FROM folded")
def rule_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 C4 F11 D13."""
    x = F.col("text")
    return _questions(spark, sf_dir).select("question_id", C.is_question(x).alias("valid"), C.rule_intent(x).alias("intent"), C.intent_result(x)["confidence"].alias("confidence"))


@register(f"WITH {_Q} SELECT question_id, array_to_string({duck.rule_topics('q')}, ',') AS topics, CASE WHEN valid THEN CASE WHEN list_contains({duck.rule_topics('q')}, 'DSA') THEN 0.9 ELSE 0.1 END END AS dsa FROM folded")
def rule_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 C6 P4 P6."""
    rows = _questions(spark, sf_dir).withColumn("q", T.fold_case(F.col("text"))).withColumn("labels", C.folded_topics(F.col("q")))
    result = C.topic_result(F.col("text"), F.col("labels"))
    return rows.select("question_id", F.array_join("labels", ",").alias("topics"), F.element_at(result["scores"], "DSA").alias("dsa"))


@register(f"WITH {_Q} SELECT question_id, {duck.rule_difficulty('q')} AS difficulty, CASE WHEN valid THEN 0.6 END AS confidence FROM folded")
def rule_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty, and the mean of both confidences."""
    x = F.col("text")
    mean = C.profile_confidence(C.intent_result(x), C.difficulty_result(x))
    return _questions(spark, sf_dir).select("question_id", C.rule_difficulty(x).alias("difficulty"), mean.alias("confidence"))


@register(f"""WITH {_Q}, d AS (SELECT question_id, lower(text) AS low FROM questions), e AS (SELECT *, CASE WHEN contains(low, 'three-way') OR contains(low, 'tcp') THEN 'medium' WHEN contains(low, 'routing') OR contains(low, 'congestion') THEN 'hard' ELSE 'easy' END AS difficulty FROM d)
SELECT question_id, CASE WHEN contains(low, 'explain') THEN 'explanation' WHEN contains(low, 'what') THEN 'definition' ELSE 'general' END AS intent, difficulty,
  CASE difficulty WHEN 'medium' THEN 'networking' WHEN 'hard' THEN 'advanced_networking' ELSE 'basics' END AS topics, 0.85::DOUBLE AS confidence, 0.92::DOUBLE AS intent_confidence, 0.88::DOUBLE AS difficulty_confidence FROM e""")
def demo_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12."""
    return _questions(spark, sf_dir).select("question_id", C.demo_labels(F.col("text")).alias("d")).select("question_id", "d.*")


def _scores(labels: list[str], by: F.Column) -> F.Column:
    """A made-up score map that sums to 1, from an id."""
    raw = [((by * (i + 3) * 7 + 11 * i) % 97 + 1) for i in range(len(labels))]
    total = sum(raw[1:], raw[0])
    return F.create_map(*[v for t, r in zip(labels, raw) for v in (F.lit(t), r / total)])


def _scores_sql(labels: list[str], by: str) -> list[str]:
    raw = [f"(({by} * {(i + 3) * 7} + {11 * i}) % 97 + 1)" for i in range(len(labels))]
    return [f"({r} / ({' + '.join(raw)}))" for r in raw]


def _difficulty_sql() -> str:
    e, m, h = _scores_sql(D.DIFFICULTIES, "question_id")
    cells = {t: f"CASE WHEN label = '{t}' THEN least(1, {c} + boost) ELSE greatest(0, {c} - boost / 2) END" for t, c in zip(D.DIFFICULTIES, "emh")}
    return f"""WITH {_Q}, s AS (SELECT question_id, text, q, {duck.strip("lower(text)")} AS low, {e} AS e, {m} AS m, {h} AS h FROM folded
), l AS (SELECT *, {duck.starts("low", D.STRONG_EASY_PREFIXES)} AS easy, {duck.starts("low", D.STRONG_HARD_PREFIXES)} AS hard, greatest(e, m, h) AS top FROM s
), b AS (SELECT *, easy AND {duck.has("low", ["difference between", " vs "])} AS cmp, CASE WHEN e = top THEN 'easy' WHEN m = top THEN 'medium' ELSE 'hard' END AS best FROM l
), c AS (SELECT *, CASE WHEN cmp THEN 'medium' WHEN easy THEN 'easy' WHEN hard THEN 'hard' ELSE {duck.rule_difficulty("q")} END AS label,
  (CASE WHEN cmp THEN 0.4 WHEN easy OR hard THEN 0.55 ELSE greatest(0.2, 0.55 - top) END)::DOUBLE AS boost FROM b
), n AS (SELECT *, best <> label OR top < 0.7 AS unsure, {cells["easy"]} AS e2, {cells["medium"]} AS m2, {cells["hard"]} AS h2 FROM c
), o AS (SELECT question_id, CASE WHEN unsure THEN e2 / (e2 + m2 + h2) ELSE e END AS easy, CASE WHEN unsure THEN m2 / (e2 + m2 + h2) ELSE m END AS medium, CASE WHEN unsure THEN h2 / (e2 + m2 + h2) ELSE h END AS hard FROM n)
SELECT question_id, round(easy, 6) AS easy, round(medium, 6) AS medium, round(hard, 6) AS hard FROM o"""


@register(_difficulty_sql())
def difficulty_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule corrections of difficulty scores."""
    x, scores = F.col("text"), F.col("scores")
    # What rules read more than once has a column of its own, which is worked out once a row.
    rows = _questions(spark, sf_dir).withColumns({"q": T.fold_case(x), "low": T.strip(F.lower(x)), "scores": _scores(D.DIFFICULTIES, F.col("question_id"))})
    rows = rows.withColumn("rule", C.difficulty_rule(F.col("low"), F.col("q"), scores)).withColumn("s", C.calibrated_difficulty(scores, x, F.col("rule")))
    return rows.select("question_id", *[F.round(F.element_at("s", t), 6).alias(t) for t in D.DIFFICULTIES])


def _intent_sql() -> str:
    cells = dict(zip(D.INTENTS, _scores_sql(D.INTENTS, "question_id")))
    own = ", ".join(f"{c} AS {t}" for t, c in cells.items())
    moved = ", ".join(f"CASE WHEN label = '{t}' THEN least(1, {t} + 0.45) ELSE greatest(0, {t} - 0.1125) END AS {t}2" for t in D.INTENTS)
    total = " + ".join(f"{t}2" for t in D.INTENTS)
    out = ", ".join(f"round(CASE WHEN unsure THEN {t}2 / ({total}) ELSE {t} END, 6) AS {t}" for t in D.INTENTS)
    labelled = "CASE label " + " ".join(f"WHEN '{t}' THEN {t}" for t in D.INTENTS) + " END"
    return f"""WITH {_Q}, s AS (SELECT question_id, lower(text) AS low, {own} FROM questions), l AS (SELECT *, greatest({", ".join(D.INTENTS)}) AS top,
  CASE WHEN {duck.starts("low", ["how would", "how to", "implement", "design", "write", "describe how"])} THEN 'procedure' WHEN {duck.starts("low", ["what is", "what are", "define", "what do"])} THEN 'definition'
       WHEN {duck.starts("low", ["why"])} THEN 'reasoning' WHEN {duck.starts("low", ["explain"])} OR {duck.has("low", ["how does", "how do"])} THEN 'explanation'
       WHEN {duck.starts("low", ["compare", "difference"])} OR {duck.has("low", ["difference between", "compare "])} THEN 'comparison' END AS label FROM s
), m AS (SELECT *, label IS NOT NULL AND ({labelled} < top OR top < 0.6) AS unsure, {moved} FROM l) SELECT question_id, {out} FROM m"""


@register(_intent_sql())
def intent_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    x, scores = F.col("text"), F.col("scores")
    rows = _questions(spark, sf_dir).withColumns({"low": F.lower(x), "scores": _scores(D.INTENTS, F.col("question_id"))})
    rows = rows.withColumn("label", C.intent_signal(F.col("low"))).withColumn("s", C.calibrated_intent(scores, x, F.col("label")))
    return rows.select("question_id", *[F.round(F.element_at("s", t), 6).alias(t) for t in D.INTENTS])


def _topic_sql() -> str:
    names = D.TOPICS
    signal = {t: duck.has("low", terms) for t, terms in D.CALIBRATION_TERMS.items()}
    flags = ", ".join(f"{x} AS s_{t}" for t, x in signal.items())
    steps = [
        ("s_DSA AND NOT s_OOP", {"DSA": 0.12, "OOP": -0.22}),
        ("contains(low, 'hash') AND NOT s_DBMS", {"DSA": 0.10, "DBMS": -0.18}),
        ("s_OOP AND NOT s_DSA", {"OOP": 0.12, "DSA": -0.22}),
        ("s_DSA AND s_OOP", {"DSA": 0.14, "OOP": 0.14}),
        ("s_DBMS AND NOT s_OS", {"DBMS": 0.12, "OS": -0.22}),
        ("s_DBMS AND NOT s_DSA", {"DBMS": 0.20, "DSA": -0.30}),
    ]
    sql = f"WITH {_Q}, t0 AS (SELECT question_id, low, {flags}, rules, {', '.join(f'{c} AS {t}' for t, c in zip(names, _scores_sql(names, 'question_id')))} FROM (SELECT question_id, lower(text) AS low, {duck.rule_topics('q')} AS rules FROM folded))"
    for i, (when, moves) in enumerate(steps):
        cells = ", ".join(f"CASE WHEN {when} THEN greatest(0, least(1, {t} + {moves[t]}::DOUBLE)) ELSE {t} END AS {t}" for t in moves)
        sql += f", t{i + 1} AS (SELECT * REPLACE ({cells}) FROM t{i})"
    last = ", ".join(f"CASE WHEN NOT list_contains(rules, 'General') THEN greatest(0, least(1, {t} + (CASE WHEN list_contains(rules, '{t}') THEN 0.6 ELSE -0.4 END)::DOUBLE)) ELSE {t} END AS {t}" for t in names)
    sql += f", z AS (SELECT * REPLACE ({last}) FROM t{len(steps)})"
    over = "list_filter([" + ", ".join(f"CASE WHEN {t} >= 0.5 OR (s_DSA AND s_OOP AND '{t}' IN ('DSA', 'OOP')) THEN '{t}' END" for t in names) + "], lambda x: x IS NOT NULL)"
    top = "CASE " + " ".join(f"WHEN {t} = greatest({', '.join(names)}) THEN '{t}'" for t in names) + " END"
    shown = ", ".join(f"round({t}, 6) AS {t}" for t in names)
    return f"{sql} SELECT question_id, {shown}, CASE WHEN len({over}) > 0 THEN array_to_string(list_sort({over}), ',') ELSE {top} END AS selected FROM z"


@register(_topic_sql())
def topic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of topic scores, and the labels selected (shown in order of name)."""
    x = F.col("text")
    rows = _questions(spark, sf_dir).withColumns({"q": T.fold_case(x), **{f"has_{t}": c for t, c in C.topic_signals(x).items()}})
    signals = {t: F.col(f"has_{t}") for t in D.CALIBRATION_TERMS}
    rows = rows.withColumn("rules", C.folded_topics(F.col("q")))
    rows = rows.withColumn("s", C.calibrated_topics(_scores(D.TOPICS, F.col("question_id")), x, signals, F.col("rules")))
    chosen = F.array_join(F.array_sort(C.selected_topics(F.col("s"), x, signals=signals)), ",").alias("selected")
    return rows.select("question_id", *[F.round(F.element_at("s", t), 6).alias(t) for t in D.TOPICS], chosen)


# Trained classifiers.


def _intent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, text, label, fold): questions with the intent that the rules give."""
    rows = _questions(spark, sf_dir).withColumn("q", T.fold_case(F.col("text"))).withColumn("label", C.folded_intent(F.col("q"))).drop("q")
    return selection.stratified_split(rows, "question_id", "label")


def _first_step_sql() -> str:
    labels = f"(SELECT unnest({duck.strings(D.INTENTS)}) AS label)"
    return f"""WITH {_Q}, l AS (SELECT question_id, text, {duck.rule_intent('q')} AS label FROM folded),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (question_id * 7919 + 42) % 10007, question_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM l),
t AS (SELECT question_id, label, {duck.tok("lower(text)")} AS w FROM k WHERE r > floor(n * 0.2)),
n AS (SELECT label, greatest(count(question_id), 1) AS n FROM {labels} LEFT JOIN t USING (label) GROUP BY label),
c AS (SELECT label, (SELECT sum(n) FROM n) / ({len(D.INTENTS)} * n) AS weight FROM n),
e AS (SELECT question_id, label, weight, 1 / sqrt(len(w)) AS v, unnest(w) AS word FROM t JOIN c USING (label)),
b AS (SELECT label, ('0x' || substr(md5(word), 1, 8))::BIGINT % {training.BUCKETS} AS bucket, sum(weight * v) AS s FROM e GROUP BY ALL
  UNION ALL SELECT label, {training.BUCKETS}, sum(weight) FROM t JOIN c USING (label) GROUP BY label),
g AS (SELECT o.label, bucket, sum(s * (1 / {len(D.INTENTS)} - (b.label = o.label)::INT)) / (SELECT sum(weight) FROM t JOIN c USING (label)) AS gradient FROM b, {labels} o GROUP BY ALL)
SELECT label, bucket, round(gradient, 9) AS gradient FROM g WHERE abs(gradient) > 1e-9"""


@register(_first_step_sql())
def classifier_first_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted gradient that the first training step sums, by label and feature (the last one is the bias)."""
    stored = io.kept(training.prepared(_intent_rows(spark, sf_dir), D.INTENTS, False), "hashed")
    weights = training.class_weights(stored, D.INTENTS, False)
    gradient, sums = training.summed(stored, training.np.zeros((len(D.INTENTS), training.BUCKETS + 1)), weights, False)
    gradient = gradient / sums[training.WEIGHT]
    cells = [(D.INTENTS[k], b, float(gradient[k, b])) for k, b in zip(*map(training.np.ndarray.tolist, abs(gradient).__gt__(1e-9).nonzero()))]
    return spark.createDataFrame(cells, "label string, bucket long, gradient double").withColumn("gradient", F.round("gradient", 9))


@register()
def intent_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of the held-out fold by a classifier trained on the other one."""
    rows = _intent_rows(spark, sf_dir)
    model = training.train(rows, D.INTENTS, lambda r: io.kept(r, "hashed"))
    held = training.predict(model, rows.filter("fold = 'test'"))
    return held.select("question_id", F.col("label").alias("intent"), "predicted", F.round("confidence", 6).alias("confidence"))


# Vectors of text.

#: Characters of a reference that an answer is compared with, which is the rule's length.
_REFERENCE = 300


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, answer, reference): answers and the start of what they are graded against."""
    return graded_answers(spark, sf_dir).select("conv_id", "turn", "answer", T.char_prefix(F.col("reference"), _REFERENCE).alias("reference"))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("answer", "reference")).alias("text"))


@register()
def semantic_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against the first 300 characters of their reference, by latent semantic vectors of both texts."""
    rows = _compared(spark, sf_dir)
    model = semantics.fit(_texts(rows), io.kept, size=48)
    found = semantics.similarity(model, rows, "answer", "reference").withColumn("similarity", F.round("similarity", 4))
    return found.select("conv_id", "turn", "similarity", S.letter_grade(F.round(F.col("similarity") * 100, 2)).alias("grade"))


_PLAIN = 256


@register(f"""WITH {duck.ANSWERS}, t AS (SELECT conv_id, turn, side, {duck.tok("lower(x)")} AS w FROM (
  SELECT conv_id, turn, 0 AS side, answer AS x FROM dealt UNION ALL SELECT conv_id, turn, 1, substr(reference, 1, {_REFERENCE}) FROM dealt)),
e AS (SELECT conv_id, turn, side, ('0x' || substr(md5(word), 1, 8))::BIGINT % {_PLAIN} AS b FROM (SELECT conv_id, turn, side, unnest(w) AS word FROM t)),
c AS (SELECT conv_id, turn, side, b, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT b, ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY b),
v AS (SELECT conv_id, turn, side, b, n * idf AS x FROM c JOIN i USING (b)), m AS (SELECT conv_id, turn, side, sqrt(sum(x * x)) AS size FROM v GROUP BY ALL),
d AS (SELECT p.conv_id, p.turn, sum(p.x * q.x) AS dot FROM v p JOIN v q ON p.conv_id = q.conv_id AND p.turn = q.turn AND p.b = q.b AND p.side = 0 AND q.side = 1 GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(dot / (p.size * q.size), 0), 6) AS similarity FROM dealt LEFT JOIN d USING (conv_id, turn)
  LEFT JOIN (SELECT * FROM m WHERE side = 0) p USING (conv_id, turn) LEFT JOIN (SELECT * FROM m WHERE side = 1) q USING (conv_id, turn)""")
def tfidf_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparison in all directions of 256 hashed words, which is plain tf-idf."""
    rows = _compared(spark, sf_dir)
    model = semantics.fit(_texts(rows), io.kept, size=_PLAIN, buckets=_PLAIN, rounds=1)
    whole = semantics.Model(model.idf, semantics.np.eye(_PLAIN), semantics.np.ones(_PLAIN))
    return semantics.similarity(whole, rows, "answer", "reference").select("conv_id", "turn", F.round("similarity", 6).alias("similarity"))


@register()
def domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description (a benchmark text) nearest to the first 400 words of each document, by latent semantic vectors."""
    rows = _documents(spark, sf_dir).withColumn("text", T.first_words(F.col("text"), 400))
    targets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target"), "text")
    model = semantics.fit(rows.select("text").unionByName(targets.select("text")), io.kept, size=48)
    found = semantics.best_targets(model, rows, targets)
    return found.select("doc_id", F.col("target").alias("item_id"), F.round("cosine", 4).alias("cosine"))


# Answer bank.


def _bank_sql() -> str:
    same = "list_distinct(list_transform({}, lambda w: " + f"coalesce({duck.case_of('w', D.BANK_SYNONYMS)}, w)))"
    content = f"list_filter(list_distinct({{}}), lambda w: NOT list_contains({duck.strings(D.BANK_STOP_WORDS)}, w))"

    def words(x: str) -> str:
        return same.format(content.format(duck.tok(x)))

    return f"""WITH {_Q}, q AS (SELECT question_id, {duck.fold_marks("text")} AS q FROM questions), b AS (SELECT item_id AS pos, {duck.fold_marks("array_to_string((" + duck.tok("text") + ")[1:2], ' ') || ' ' || " + duck.strings(_SUBJECTS) + "[1 + item_id % 10] || CASE WHEN item_id % 10 = 7 THEN ' of a small ring' ELSE '' END")} AS p FROM benchmark),
qw AS (SELECT *, {words("q")} AS qw FROM q), pw AS (SELECT *, {words("p")} AS pw, len({duck.tok("p")}) AS n FROM b),
x AS (SELECT question_id, pos, q = p AS eq, n > 0 AND (contains(q, p) OR contains(p, q)) AS inside, n, len(list_intersect(qw, pw)) AS o, len(qw) AS nq, len(pw) AS np,
  list_has_any(qw, {duck.strings(D.BANK_BOOST_WORDS)}) AS boost FROM qw, pw),
y AS (SELECT *, round(CASE WHEN o > 0 THEN o / (np + nq - o) * 0.7 + least(1, np / 6) * 0.3 + o * 0.1 + CASE WHEN boost THEN 0.25 ELSE 0 END ELSE least(1, np / 6) * 0.3 END, 9) AS s FROM x),
z AS (SELECT question_id, min(pos) FILTER (eq) AS e, arg_min(pos, struct_pack(n := -n, p := pos)) FILTER (inside) AS c, arg_min(pos, struct_pack(s := -s, p := pos)) AS w, max(s) AS s FROM y GROUP BY question_id)
SELECT question_id, coalesce(e, c, CASE WHEN s > 0.18 THEN w END) AS pos, CASE WHEN e IS NOT NULL THEN 'equal' WHEN c IS NOT NULL THEN 'contains' WHEN s > 0.18 THEN 'words' ELSE 'none' END AS how,
  CASE WHEN e IS NULL AND c IS NULL AND s > 0.18 THEN s END AS score FROM z"""


@register(_bank_sql())
def bank_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank pattern of each question."""
    x = F.col("text")
    tail = F.when(F.col("item_id") % 10 == 7, " of a small ring").otherwise("")
    subject = F.get(F.array(*map(F.lit, _SUBJECTS)), (F.col("item_id") % 10).cast("int"))
    pattern = F.concat(F.array_join(F.slice(T.tok(x), 1, 2), " "), F.lit(" "), subject, tail)
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), pattern.alias("pattern"))
    return matching.bank_match(_questions(spark, sf_dir), patterns)


# Generated questions, contexts, reports.


@register(f"""WITH t AS (SELECT conv_id, turn, text, lower(text) AS low, {duck.n_words("text")} AS n, right(text, 1) = '?' AS q FROM (SELECT conv_id, turn, {_spiced_sql("'What is ' || text", "(conv_id + turn)")} || CASE WHEN turn % 2 = 0 THEN '?' ELSE '' END AS text FROM conversations)),
p AS (SELECT *, n BETWEEN 5 AND 25 AND q AND NOT {duck.has("low", D.GATE_BAD_WORDS)} AND {duck.starts("low", D.GATE_STARTERS)} AS gate,
  CASE WHEN n BETWEEN 5 AND 20 THEN 30 ELSE 0 END + CASE WHEN q THEN 20 ELSE 0 END + CASE WHEN {duck.starts("low", D.RANK_STARTERS)} THEN 25 ELSE 0 END + CASE WHEN NOT {duck.has("low", D.RANK_BAD_WORDS)} THEN 25 ELSE 0 END AS points FROM t)
SELECT conv_id, turn, gate, points::INT AS points, row_number() OVER (PARTITION BY conv_id ORDER BY points DESC, turn)::INT AS place, CASE WHEN gate THEN 'Good' ELSE 'Needs Review' END AS quality FROM p""")
def quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate, quality points and their order within a conversation."""
    by = F.col("conv_id") + F.col("turn")
    made = F.concat(_spiced(F.concat(F.lit("What is "), "text"), by), F.when(F.col("turn") % 2 == 0, "?").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("text"))
    rows = rows.select("conv_id", "turn", S.passes_gate(F.col("text")).alias("gate"), S.quality_points(F.col("text")).alias("points"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("points"), "turn")
    return rows.withColumn("place", F.row_number().over(order)).withColumn("quality", F.when(F.col("gate"), "Good").otherwise("Needs Review"))


def _reference_sql(x: str) -> str:
    t = f"(array_to_string(string_split({x}, '.')[1:3], '. ') || '.')"
    return f"(CASE WHEN length({duck.strip(x)}) >= 30 THEN CASE WHEN length({t}) > 300 THEN substr({t}, 1, 300) || '...' ELSE {t} END ELSE 'No reference available' END)"


_LINE = duck.strip("replace(substr(text, 1, 400), chr(10), ' ')")
_FALL = f"(list_filter({duck.tok(_LINE)}, lambda w: length(w) > 4))[1:3]"


@register(f"""SELECT doc_id, md5({_reference_sql("text")}) AS reference, CASE WHEN len({_FALL}) > 0 THEN 'Explain how ' || array_to_string({_FALL}, ' ') || ' works and why it is important in computer networks.'
  ELSE 'What are the key characteristics of this concept and how is it applied?' END AS fallback, {duck.n_words("text")} < 5 OR {duck.has("lower(text)", D.RANK_BAD_WORDS)} OR NOT contains(text, '?') AS rejected FROM documents""")
def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference answers, fallback questions and the reject rule."""
    x = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(S.reference_answer(x)).alias("reference"), S.fallback_question(x).alias("fallback"), S.rejects_question(x).alias("rejected"))


_MADE = ["What is based on this context ", "material: ", "", "Explain based on the context why "]


@register(f"""WITH m AS (SELECT conv_id, turn, text, {duck.strings(_MADE)}[1 + (conv_id + turn) % 4] || text || CASE WHEN turn % 3 = 0 THEN '' ELSE ' works?' END || CASE WHEN turn % 5 = 0 THEN '..' ELSE '' END AS made FROM conversations),
c AS (SELECT *, {duck.strip("replace(replace(replace(made, 'based on this context', ''), 'based on the context', ''), 'material:', '')")} AS q FROM m),
r AS (SELECT *, {duck.n_words("q")} < 5 OR {duck.has("lower(q)", D.RANK_BAD_WORDS)} OR NOT contains(q, '?') AS rejected FROM c)
SELECT conv_id, turn, rejected, md5(CASE WHEN length({duck.strip("text")}) < 30 THEN 'Unable to generate question - insufficient context' WHEN NOT rejected THEN CASE WHEN right(q, 1) = '?' THEN q ELSE regexp_replace(q, '\\.+$', '') || '?' END
  WHEN len({_FALL}) > 0 THEN 'Explain how ' || array_to_string({_FALL}, ' ') || ' works and why it is important in computer networks.' ELSE 'What are the key characteristics of this concept and how is it applied?' END) AS kept FROM r""")
def question_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated questions (made from turns) without stock phrases, or the fallback where they are rejected."""
    by, x = (F.col("conv_id") + F.col("turn")).cast("int"), F.col("text")
    made = F.concat(F.get(F.array(*map(F.lit, _MADE)), by % 4), x, F.when(F.col("turn") % 3 == 0, "").otherwise(" works?"), F.when(F.col("turn") % 5 == 0, "..").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.rejects_question(S.cleaned_question(made)).alias("rejected"), F.md5(S.kept_question(made, x)).alias("kept"))


@register(f"""WITH {duck.BANK} SELECT sink, question_id, md5(text || '|' || topic || '|' || difficulty || '|' || intent) AS digest FROM bank, (SELECT unnest(['csv', 'json']) AS sink)
UNION ALL SELECT 'metadata', i - 1, md5(t) FROM (SELECT unnest(range(1, {len(D.INTENTS) + 1})) AS i, unnest({duck.strings(D.INTENTS)}) AS t)""")
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question bank and the labels written as CSV and JSON, and read back."""
    rows, path = bank(spark, sf_dir), io.scratch(spark, "sinks")
    io.write_csv(rows, f"{path}/csv")
    io.write_json(rows, f"{path}/json")
    io.write_json(io.label_metadata(spark, D.INTENTS), f"{path}/labels")
    digest = F.md5(F.concat_ws("|", "text", "topic", "difficulty", "intent")).alias("digest")
    csv = io.read_csv(spark, f"{path}/csv", rows.schema).select(F.lit("csv").alias("sink"), "question_id", digest)
    json = spark.read.schema(rows.schema).json(f"{path}/json").select(F.lit("json").alias("sink"), "question_id", digest)
    labels = spark.read.schema("id int, label string").json(f"{path}/labels").select(F.lit("metadata").alias("sink"), F.col("id").cast("long").alias("question_id"), F.md5("label").alias("digest"))
    return csv.union(json).union(labels)


@register(f"""WITH w AS (SELECT doc_id, text, {duck.tok("substr(text, 1, 300)")} AS w FROM documents), r AS (SELECT doc_id, substr(text, 1, 300) AS x, w, len(list_filter(list_distinct(w), lambda v: len(list_filter(w, lambda u: u = v)) >= 3)) > 0 AS often FROM w)
SELECT doc_id, often, md5(CASE WHEN often THEN {duck.strip("array_to_string(string_split(x, '.')[1:2], '. ')")} || '.' ELSE x END) AS kept,
  'What is ' || coalesce(w[1], '') || ' and how does it work in computer systems?' AS web FROM r""")
def repetition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut where a word stands three times, and the web variant's question."""
    x = T.char_prefix(F.col("text"), 300)
    words = T.tok(x)
    often = F.exists(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda v: v == w)) >= 3)
    return _documents(spark, sf_dir).select("doc_id", often.alias("often"), F.md5(S.without_repetition(x)).alias("kept"), S.web_question(F.lit(""), x).alias("web"))


@register(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, i AS id, {duck.strip("l[i + 1]")} AS t FROM l, unnest(range(0, len(l))) AS r(i))
SELECT doc_id, id::INT AS id, (id + 1)::INT AS page, md5(t) AS digest FROM p WHERE length(t) > 20""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages; short ones drop out but count in the numbering."""
    rows = _documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("pages"))
    return io.page_chunks(rows).select("doc_id", "id", "page", F.md5("text").alias("digest"))


_PDF_MAP = "begincodespacerange <0000> <FFFF> endcodespacerange beginbfrange <0020> <FFFD> <0020> endbfrange"
_PDF_START = f"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
3 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >> endobj
4 0 obj << /Length {len(_PDF_MAP)} >>
stream
{_PDF_MAP}
endstream endobj
"""


@register(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, i AS id, {duck.strip("l[i + 1]")} AS t FROM l, unnest(range(0, len(l))) AS r(i))
SELECT doc_id, id::INT AS id, (id + 1)::INT AS page, md5(t) AS digest FROM p WHERE length(t) > 20""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, a line a page, and their pages read back; short ones drop out but count."""
    number = lambda i, k: (10 + 2 * i + k).cast("string")

    def page(line: F.Column, i: F.Column) -> F.Column:
        shown = F.concat(F.lit("BT /F1 1 Tf <"), F.hex(F.encode(F.translate(line, "\t\r", "  "), "UTF-16BE")), F.lit("> Tj ET"))
        head = F.concat(number(i, 0), F.lit(" 0 obj << /Type /Page /Parent 2 0 R /Contents "), number(i, 1), F.lit(" 0 R >> endobj\n"))
        return T.bound(shown, lambda s: F.concat(head, number(i, 1), F.lit(" 0 obj << /Length "), F.length(s).cast("string"), F.lit(" >>\nstream\n"), s, F.lit("\nendstream endobj\n")))

    lines = F.col("lines")
    kids = F.array_join(F.transform(lines, lambda _, i: F.concat(number(i, 0), F.lit(" 0 R"))), " ")
    tree = F.concat(F.lit("2 0 obj << /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids ["), kids, F.lit("] >> endobj\n"))
    content = F.concat(F.lit(_PDF_START), tree, F.array_join(F.transform(lines, page), ""))
    files = _documents(spark, sf_dir).withColumn("lines", F.split("text", "\n")).select(F.col("doc_id").cast("string").alias("path"), F.encode(content, "UTF-8").alias("content"))
    rows = pdf.parse_pdf(files).withColumn("text", T.strip(F.col("text"))).filter(F.length("text") > 20)
    return rows.select(F.col("path").cast("long").alias("doc_id"), (F.col("page") - 1).alias("id"), "page", F.md5("text").alias("digest"))


_HEADS = ["SUMMARY\n", "Work Experience:\n", "Technical  Skills\n", "EDUCATION\n", ""]


@register(f"""WITH l AS (SELECT doc_id, string_split({duck.strings(_HEADS)}[1 + doc_id % 5] || text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, i, l[i] AS line, upper(l[i]) AS u FROM l, unnest(range(1, len(l) + 1)) AS r(i)),
h AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(u, {duck.lit('|'.join(p))}) THEN '{n}'" for n, p in D.SECTION_HEADERS.items())} END AS head FROM x),
s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'other') AS section FROM h)
SELECT doc_id, section, count(*)::INT AS lines, md5(string_agg(line || chr(10), '' ORDER BY i)) AS digest FROM s WHERE head IS NULL AND {duck.strip("line")} <> '' GROUP BY doc_id, section""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of texts with a header put before them."""
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 5).cast("int"))
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(X.sections(F.concat(head, "text"))).alias("section", "body")).filter("body <> ''")
    return rows.select("doc_id", "section", (F.size(F.split("body", "\n")) - 1).alias("lines"), F.md5("body").alias("digest"))


_TITLES = ["Engineer", "Data Analyst", "Corp Advisor", "Team Lead", "Ops", "QA"]
_COMPANIES = ["North Works, Co", "South & Sons", "West-End Ltd.", "Blue Hill"]
_TASKS = ["- Built the parser", "* Ran 3 stores", "Wrote 12 reports on sales.", "ok.", "- Led (small) teams"]


@register(f"""WITH p AS (SELECT s_suppkey AS s, i, s_suppkey + i AS k FROM supplier, unnest(range(0, s_suppkey % 4)) r(i)),
j AS (SELECT *, {duck.strings(_TITLES)}[1 + k % 6] AS title, {duck.strings(_COMPANIES)}[1 + (s // 6 + i) % 4] AS company, 1990 + (s * 7 + i * 5) % 28 AS y, (s + 2 * i) % 5 AS d, k % 7 = 0 AS open,
  array_to_string(list_transform(range(0, k % 3 + 1), lambda m: {duck.strings(_TASKS)}[1 + (k + m) % 5]), chr(10)) AS done FROM p),
t AS (SELECT *, CASE WHEN open THEN 'March ' || y || ' - Present' WHEN d > 0 THEN y || ' - ' || (y + d) ELSE y::VARCHAR END AS dates FROM j),
w AS (SELECT *, string_agg(title || chr(10) || company || chr(10) || dates || chr(10) || done, chr(10) || chr(10)) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest FROM t),
c AS (SELECT *, CASE WHEN open THEN {AS_OF_YEAR} ELSE y + d END AS z, list_filter(list_transform(string_split(substr(chr(10) || done || coalesce(chr(10) || chr(10) || rest, ''), 1, 400), chr(10)), lambda x: {duck.strip("x")}), lambda x: x <> '') AS lines FROM w),
f AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '^[-•*]')) AS bullets, list_filter(lines, lambda x: length(x) > 10) AS long FROM c),
g AS (SELECT *, CASE WHEN len(bullets) > 0 THEN bullets ELSE long END AS chosen FROM f WHERE length(title) >= 3 AND NOT {duck.has("lower(title)", D.COMPANY_MARKS)} AND (open OR d > 0)),
a AS (SELECT s, count(*)::INT AS jobs, (max(z) - min(y))::INT AS years, arg_min(title || ' at ' || company, i) AS first_job,
  string_agg(CASE WHEN len(chosen) > 0 THEN substr(regexp_replace(array_to_string(chosen[1:2], ' '), '^[-•*]\\s*', ''), 1, 150) ELSE 'Not specified' END, ';' ORDER BY i) AS focus FROM g GROUP BY s)
SELECT s_suppkey, coalesce(jobs, 0) AS jobs, coalesce(years, 0) AS years, first_job, coalesce(focus, '') AS focus FROM supplier LEFT JOIN a ON s = s_suppkey""")
def job_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of made-up résumés of up to three jobs, some of them not kept; what follows a job reaches into the next one."""

    def picked(values: list[str], at: F.Column) -> F.Column:
        return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))

    def tasks(k: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda m: picked(_TASKS, k + m))

    s, jobs = F.col("s_suppkey"), []
    for i in range(3):
        k, y, d = s + i, 1990 + (s * 7 + i * 5) % 28, (s + 2 * i) % 5
        dates = F.when(k % 7 == 0, F.concat(F.lit("March "), y, F.lit(" - Present"))).when(d > 0, F.concat(y, F.lit(" - "), y + d)).otherwise(y.cast("string"))
        done = tasks(k)
        job = F.concat_ws("\n", picked(_TITLES, k), picked(_COMPANIES, F.floor(s / 6) + i), dates, F.array_join(done, "\n"))
        jobs.append(F.when(s % 4 > i, job))
    cv = F.concat(F.lit("Name\nEXPERIENCE\n"), F.array_join(F.array_compact(F.array(*jobs)), "\n\n"), F.lit("\n\nEDUCATION\nx"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", X.job_experiences(cv, AS_OF_YEAR).alias("jobs"))
    first = F.get("jobs", 0)
    return rows.select(
        "s_suppkey",
        F.size("jobs").alias("jobs"),
        X.total_experience(F.col("jobs"))["years"].alias("years"),
        F.concat(first["title"], F.lit(" at "), first["company"]).alias("first_job"),
        F.array_join(F.transform("jobs", lambda j: j["primary_focus"]), ";").alias("focus"),
    )


@register("""WITH b AS (SELECT item_id, text, lower(regexp_extract(text, '^[A-Za-z]+')) AS topic FROM benchmark)
SELECT item_id, topic || ' definition computer science' AS query, 0 AS place, md5('Write one clear technical interview question about ''' || topic || '''.' || chr(10) || chr(10) || 'Material: ' || trim(replace(substr(text, 1, 400), chr(10), ' ')) || chr(10) || chr(10) || 'Question:') AS prompt FROM b
UNION ALL SELECT item_id, topic || ' explanation with example operating system dbms cn', 1, NULL FROM b UNION ALL SELECT item_id, topic || ' causes and conditions computer science', 2, NULL FROM b
UNION ALL SELECT item_id, 'what is ' || topic || ' explain clearly with example', 3, NULL FROM b""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four searches for each topic, and its prompt beside the first."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("topic"))
    each = rows.select("item_id", "text", "topic", F.posexplode(S.expanded_queries(F.col("topic"))).alias("place", "query"))
    prompt = F.when(F.col("place") == 0, F.md5(S.question_prompt(F.col("text"), F.col("topic"))))
    return each.select("item_id", "query", "place", prompt.alias("prompt"))


@register(f"""WITH c AS (SELECT conv_id, turn, text, contains(lower(text), 'the is') OR contains(lower(text), 'the occurs') OR contains(lower(text), 'la is') AS hit, length({duck.strip("text")}) AS n FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hit DESC, turn) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN n >= 30 THEN 0 ELSE 1 END, turn) AS g FROM c)
SELECT conv_id, max(turn) FILTER (r = 1) AS best_turn, md5(CASE WHEN max(n) FILTER (r = 1) > 30 THEN max(text) FILTER (r = 1) ELSE '' END) AS context,
  md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (g <= 2 AND n >= 30), '')) AS joined FROM r GROUP BY conv_id""")
def best_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defining passage of a conversation if any, else the first, and its first two long ones joined."""
    rows = table(spark, sf_dir, "conversations")
    x = F.col("text")
    hit = S.defines(x, F.lit("the")) | F.contains(F.lower(x), F.lit("la is"))
    long_ = F.length(T.strip(x)) >= 30
    key = F.struct((~hit).alias("h"), F.col("turn").alias("turn"))
    # The two first long texts: kept small by a rank before they are gathered.
    order = Window.partitionBy("conv_id").orderBy("turn")
    pair = rows.filter(long_).withColumn("g", F.row_number().over(order)).filter("g <= 2").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "text"))), lambda e: e["text"]), "\n\n").alias("joined"))
    best = rows.groupBy("conv_id").agg(F.min_by("turn", key).alias("best_turn"), F.min_by("text", key).alias("t"))
    context = F.when(F.length(T.strip(F.col("t"))) > 30, F.col("t")).otherwise("")
    return best.join(pair, "conv_id", "left").select("conv_id", "best_turn", F.md5(context).alias("context"), F.md5(F.coalesce("joined", F.lit(""))).alias("joined"))


_KEYS = ["the", "of", "que", "der", "and"]


@register(f"""WITH s AS (SELECT doc_id, source, {duck.count_of("lower(text)", _KEYS)} * 100.0::DOUBLE / {len(_KEYS)} AS score FROM documents)
SELECT source, count(*) AS answers, round(avg(score), 6) AS average, {duck.banded("round(avg(score), 6)", [(75, "Excellent"), (60, "Good"), (45, "Average")], "Needs Improvement")} AS level,
  {duck.banded("round(avg(score) / 100, 6)", [(0.8, "Excellent"), (0.6, "Good"), (0.4, "Average")], "Poor")} AS category FROM s GROUP BY source""")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X26 X29 X30 (described only, unverified): keyword scores and their roll-up."""
    rows = table(spark, sf_dir, "documents").select("source", S.keyword_score(F.col("text"), _KEYS).alias("score"))
    rows = rows.groupBy("source").agg(F.count("*").alias("answers"), F.round(F.avg("score"), 6).alias("average"), F.round(F.avg("score") / 100, 6).alias("a"))
    return rows.select("source", "answers", "average", S.quiz_level(F.col("average")).alias("level"), S.final_category(F.col("a")).alias("category"))


@register(f"""WITH {duck.BANK} SELECT question_id, array_to_string(CASE intent WHEN 'explanation' THEN {duck.strings(D.KEY_POINTS["explanation"])} WHEN 'comparison' THEN {duck.strings(D.KEY_POINTS["comparison"])}
  WHEN 'procedure' THEN {duck.strings(D.KEY_POINTS["procedure"])} WHEN 'definition' THEN {duck.strings(D.DEFINITION_POINTS)}[1:CASE difficulty WHEN 'hard' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END] ELSE {duck.strings(D.OTHER_POINTS)} END, ';') AS points,
  'Q: ' || text || chr(10) || 'A: ' || {duck.collapse("text")} || chr(10) || 'Score: 50.0' || chr(10) || 'Grade: D' || chr(10) || repeat('-', 60) AS report FROM bank""")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points of each question, and its block of a text report."""
    rows = bank(spark, sf_dir)
    report = S.report_lines(F.col("text"), F.col("text"), F.lit(50.0), S.letter_grade(F.lit(50.0)))
    return rows.select("question_id", F.array_join(S.key_points(F.col("intent"), F.col("difficulty")), ";").alias("points"), report.alias("report"))


@register(f"""WITH w AS (SELECT doc_id AS id, list_filter({duck.tok(duck.fold_marks("substr(text, 1, 2000)"))}, lambda w: NOT list_contains({duck.strings(D.PHRASE_STOP_WORDS)}, w)) AS w FROM documents),
p AS (SELECT id, unnest(w) AS phrase FROM w UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM w, unnest(range(1, len(w))) r(i)),
c AS (SELECT id, phrase, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT phrase, count(*) AS df FROM c GROUP BY 1),
g AS (SELECT id, phrase, n, round(n * ln((SELECT count(*) FROM documents) / df), 6) AS weight FROM c JOIN s USING (phrase)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, phrase) AS place FROM g) SELECT id, phrase, n, weight, place::INT AS place FROM r WHERE place <= 15""")
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 (a substitute): fifteen phrases of each document by term weight."""
    return phrases.key_phrases(table(spark, sf_dir, "documents"))


@register()
def diverse_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen phrases of each document by maximal marginal relevance over latent semantic vectors."""
    rows = _documents(spark, sf_dir)
    return phrases.diverse_phrases(rows, semantics.fit(rows, io.kept, size=48))


# The whole way from a résumé to its session.

_QUESTIONS_EACH = 3


def workflow_stages(spark: SparkSession, sf_dir: str) -> list[stages.Stage]:
    """Profiles of documents, questions of their topic, graded answers, sessions."""
    known = F.array(*map(F.lit, BANK_TOPICS))

    def profiles(_: dict) -> DataFrame:
        x = F.col("text")
        # What rules read in many places has a column of its own, which is worked out once a row.
        topic = F.get(F.filter(F.col("topics"), lambda t: F.array_contains(known, t)), 0)
        dealt = F.get(known, (F.col("doc_id") % len(BANK_TOPICS)).cast("int"))
        rows = _documents(spark, sf_dir).withColumn("q", T.fold_case(x)).withColumn("topics", C.folded_topics(F.col("q")))
        return rows.select("doc_id", F.coalesce(topic, dealt).alias("topic"), X.email(x).alias("email"), "text")

    def questions(rows: dict) -> DataFrame:
        items = bank(spark, sf_dir).select("question_id", "topic", F.col("text").alias("reference"))
        order = Window.partitionBy("doc_id").orderBy(selection.draw_key(F.col("doc_id"), F.col("question_id")), "question_id")
        asked = rows["profiles"].select("doc_id", "topic").join(matching.small(items), "topic")
        return asked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= _QUESTIONS_EACH)

    def answers(rows: dict) -> DataFrame:
        asked = rows["questions"].withColumn("r", S.folded(F.col("reference")))
        # A reference stands once in a file for all who are asked it, so Spark takes the rows for small: it must not choose to broadcast them.
        both = asked.hint("merge").join(rows["profiles"].select("doc_id", S.folded(F.col("text")).alias("u")), "doc_id")
        return both.select("doc_id", "question_id", S.main_score(F.col("u"), F.col("r"), F.lit("")).alias("score"))

    def sessions(rows: dict) -> DataFrame:
        means = rows["answers"].groupBy("doc_id").agg(F.count("*").alias("answers"), F.round(F.avg("score"), 6).alias("mean_score"))
        found = rows["profiles"].select("doc_id", "topic", "email").join(means.hint("merge"), "doc_id", "left")
        return found.select("doc_id", "topic", "email", F.coalesce("answers", F.lit(0)).alias("answers"), "mean_score", S.score_feedback(F.col("mean_score")).alias("feedback"))

    Stage = stages.Stage
    return [
        Stage("profiles", profiles, metrics={"with_email": F.count("email")}),
        Stage("questions", questions),
        Stage("answers", answers, metrics={"best": F.max("score")}),
        Stage("sessions", sessions),
    ]


@register(f"""WITH {duck.BANK}, p AS (SELECT doc_id, text, nullif(regexp_extract(text, {duck.lit(X.EMAIL)}), '') AS email,
  coalesce(list_filter({duck.rule_topics(duck.fold_case("text"))}, lambda t: list_contains({duck.strings(BANK_TOPICS)}, t))[1], {duck.strings(BANK_TOPICS)}[1 + doc_id % {len(BANK_TOPICS)}]) AS topic FROM documents),
k AS (SELECT doc_id, question_id, p.text AS answer, b.text AS reference, row_number() OVER (PARTITION BY doc_id ORDER BY (question_id * 31 + doc_id * 17) % 1009, question_id) AS place FROM p JOIN bank b USING (topic)),
dealt AS (SELECT doc_id AS conv_id, question_id AS turn, '' AS question, answer, reference FROM k WHERE place <= {_QUESTIONS_EACH}), {_GRADED_OF},
a AS (SELECT conv_id AS doc_id, count(*) AS answers, round(avg(main), 6) AS mean_score FROM s GROUP BY conv_id)
SELECT doc_id, topic, email, coalesce(answers, 0) AS answers, mean_score,
  {duck.banded("mean_score", [(0.85, "excellent"), (0.70, "good"), (0.50, "partially correct"), (0.25, "weak")], "incorrect")} AS feedback FROM p LEFT JOIN a USING (doc_id)""")
def interview_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """résumé to topic to questions to session, broken off after two stages and taken up again."""
    path, steps = io.scratch(spark, "workflow"), workflow_stages(spark, sf_dir)
    stages.run(spark, path, steps[:2])
    return stages.run(spark, path, steps)["sessions"]

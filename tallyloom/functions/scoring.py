"""Answer scores and grade bands as column expressions; conditions are taken in the order written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import dictionaries as D
from tallyloom.functions.text import any_of, char_prefix, collapse, count_of, n_words, starts_with_any, strip, tok


def banded(x: Column, rows: list[tuple], otherwise: object = None) -> Column:
    """The value of the first row whose bound x reaches."""
    out = None
    for bound, value in rows:
        hit = x >= bound
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if otherwise is None else out.otherwise(otherwise)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def token_set(x: Column) -> Column:
    return F.array_distinct(tok(x))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(token_set(a), token_set(b)))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


# Lexical scores: inputs are stripped and lowered first.


def folded(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x, F.lit(""))))


def is_gibberish(answer: Column) -> Column:
    return (F.length(answer) < 5) | any_of(answer, D.GIBBERISH)


def lexical_score(answer: Column, reference: Column, question: Column) -> Column:
    overlap, asked, n = shared(answer, reference), shared(answer, question), n_words(answer)
    base = (
        F.when(overlap >= 3, 0.85 + overlap * 0.05)
        .when(overlap == 2, 0.70)
        .when(overlap == 1, 0.50)
        .when((asked >= 2) & (n > 10), 0.65)
        .otherwise(0.20)
    )
    return F.least(F.lit(0.99), base * F.when(n < 5, 0.6).when(n > 50, 1.05).otherwise(1.0))


def main_score(answer: Column, reference: Column, question: Column) -> Column:
    short = F.when(F.length(answer) < 8, 0.25)
    return F.when(is_gibberish(answer), 0.0).otherwise(short.otherwise(lexical_score(answer, reference, question)))


def score_feedback(score: Column) -> Column:
    return banded(score, [(0.85, "excellent"), (0.70, "good"), (0.50, "partially correct"), (0.25, "weak")], "incorrect")


def acronym_pair(a: Column, b: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in D.ACRONYMS.items() for x in kv])
    return F.coalesce(F.element_at(pairs, a) == b, F.lit(False)) | F.coalesce(F.element_at(pairs, b) == a, F.lit(False))


def fill_score(user: Column, reference: Column) -> Column:
    """Blank fill-ins; an empty answer is a part of any reference and gets 0.90."""
    ours, theirs = F.array_sort(token_set(user)), F.array_sort(token_set(reference))
    return (
        F.when((user == reference) | acronym_pair(user, reference), 1.0)
        .when(F.contains(user, reference), 0.95)
        .when(F.contains(reference, user), 0.90)
        .when(ours == theirs, 0.95)
        .when(shared(user, reference) >= 2, 0.85)
        .otherwise(0.0)
    )


def combined_score(main: Column, fill: Column) -> Column:
    return main * 0.7 + fill * 0.3


def marks(main: Column, fill: Column) -> Column:
    """Ten marks, half-even as the rule states, and one more up to ten where both parts are good."""
    ten = F.bround(combined_score(main, fill) * 10, 0)
    return F.when((fill > 0) & (main >= 0.7), F.least(F.lit(10.0), ten + 1)).otherwise(ten).cast("int")


# Embedding grades.


def letter_grade(percent: Column) -> Column:
    return banded(percent, [(80, "A"), (70, "B"), (60, "C"), (50, "D")], "F")


# Session scores.


def is_valid_answer(x: Column) -> Column:
    return (F.length(strip(x)) >= 2) & x.rlike("[\\p{L}\\p{N}]")


def is_coherent(x: Column) -> Column:
    low, n = F.lower(x), n_words(x)
    return ~((n < 5) & (any_of(low, D.CODE_MARKS) | ~any_of(low, D.VERB_STEMS)))


def keyword_hits(answer: Column, topics: Column) -> tuple[Column, Column]:
    """(hits, keywords) over the lists of all topics; a keyword in two lists counts twice.  Unknown topics list themselves."""
    low = F.lower(answer)
    known = F.create_map(*[v for t, ks in D.ANSWER_KEYWORDS.items() for v in (F.lit(t), F.array(*map(F.lit, ks)))])
    words = F.flatten(F.transform(F.array_distinct(topics), lambda t: F.coalesce(F.element_at(known, t), F.array(F.lower(t)))))
    return F.size(F.filter(words, lambda w: F.contains(low, w))), F.size(words)


def topic_coverage(answer: Column, topics: Column, answer_topics: Column) -> Column:
    hits, total = keyword_hits(answer, topics)
    share = F.when(total > 0, hits / total).otherwise(0.5)
    common = F.size(F.array_intersect(topics, answer_topics))
    return (
        F.when(~is_coherent(answer), 8.0)
        .when((hits >= 3) & (common > 0), 78 + 22 * common / F.size(F.array_distinct(topics)))
        .when(hits >= 3, 75 + share * 20)
        .when(hits >= 1, 45 + share * 15)
        .when(n_words(answer) >= 5, 35.0)
        .otherwise(10.0)
    )


def intent_match(answer_intent: Column, intent: Column, n: Column) -> Column:
    pair = F.array_join(F.array_sort(F.array(answer_intent, intent)), "+")
    return (
        F.when(answer_intent == intent, 100.0)
        .when(pair.isin("definition+explanation", "comparison+procedure"), 85.0)
        .when(intent.isin("definition", "explanation") & (n >= 5), 65.0)
        .otherwise(45.0)
    )


def comprehensiveness(answer: Column, intent: Column, coverage: Column) -> Column:
    low, n = F.lower(answer), n_words(answer)

    def by_intent(table: dict[str, list[tuple]]) -> Column:
        out = None
        for name, rows in table.items():
            value = banded(n, rows)
            if name in D.CUES and name in table:
                value = F.when(any_of(low, D.CUES[name]), value).otherwise(40)
            if name == "other":
                return out.otherwise(value)
            out = F.when(intent == name, value) if out is None else out.when(intent == name, value)
        return out

    return F.when(coverage < 20, 5).when(coverage < 70, by_intent(D.DEPTH_PARTIAL)).otherwise(by_intent(D.DEPTH_GOOD)).cast("double")


def key_words(x: Column) -> Column:
    """Distinct lowered words without the bonus stop words, in order of first appearance."""
    return F.array_except(token_set(F.lower(x)), F.array(*map(F.lit, D.BONUS_STOP_WORDS)))


def model_bonus(answer: Column, model: Column) -> Column:
    """0-100 by closeness to a model answer; the main concepts are its first five key words by position (our order)."""
    ours, theirs = key_words(answer), key_words(model)
    main = F.slice(theirs, 1, 5)
    length = F.least(n_words(answer) / F.greatest(n_words(model), F.lit(1)), F.lit(1.0))
    total = F.size(F.array_intersect(ours, theirs)) / F.size(theirs) * 40 + length * 30 + F.size(F.array_intersect(main, ours)) / F.size(main) * 30
    return F.when(F.size(theirs) > 0, total).otherwise(0.0)


def overall_score(coverage: Column, intent: Column, depth: Column, bonus: Column) -> Column:
    base = coverage * 0.50 + intent * 0.25 + depth * 0.25
    return clamp(F.when((base >= 75) & (bonus > 0), base + bonus * 0.25).otherwise(base))


def session_grade(score: Column) -> Column:
    return banded(score, [(85, "excellent"), (65, "mostly_correct"), (40, "partially_correct")], "blatantly_wrong")


def missing_concepts(coverage: Column, intent_score: Column, depth: Column, topics: Column, intent: Column, answer_intent: Column) -> Column:
    said = F.create_map(*[F.lit(v) for kv in D.MISSING_DEPTH.items() for v in kv])
    found = F.array_compact(
        F.array(
            F.when(coverage < 50, F.concat(F.lit("Core topic knowledge ("), F.array_join(topics, ", "), F.lit(")"))),
            F.when(intent_score < 50, F.concat(F.lit("More "), intent, F.lit(" (currently sounds like "), answer_intent, F.lit(")"))),
            F.when(depth < 60, F.coalesce(F.element_at(said, intent), F.lit("More comprehensive answer"))),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Overall seems good, keep practicing!")))


def strength(attempted: Column, accuracy: Column) -> Column:
    return F.when(attempted < 3, "untested").otherwise(banded(accuracy, [(80, "strong"), (60, "moderate")], "weak"))


def level(attempted: Column, accuracy: Column) -> Column:
    return F.when(attempted < 5, "beginner").otherwise(banded(accuracy, [(80, "advanced"), (60, "intermediate")], "beginner"))


def adaptive_difficulty(target: Column, topic_accuracy: Column) -> Column:
    return F.when(topic_accuracy < 40, "easy").otherwise(target)


# Generated questions and contexts.


def passes_gate(question: Column) -> Column:
    low, n = F.lower(question), n_words(question)
    return n.between(5, 25) & question.endswith("?") & ~any_of(low, D.GATE_BAD_WORDS) & starts_with_any(low, D.GATE_STARTERS)


def quality_points(question: Column) -> Column:
    low = F.lower(question)
    return (
        F.when(n_words(question).between(5, 20), 30).otherwise(0)
        + F.when(question.endswith("?"), 20).otherwise(0)
        + F.when(starts_with_any(low, D.RANK_STARTERS), 25).otherwise(0)
        + F.when(~any_of(low, D.RANK_BAD_WORDS), 25).otherwise(0)
    )


def has_context(context: Column) -> Column:
    return F.coalesce(F.length(strip(context)) >= 30, F.lit(False))


def reference_answer(context: Column) -> Column:
    text = F.concat(F.array_join(F.slice(F.split(context, "\\."), 1, 3), ". "), F.lit("."))
    short = F.when(F.length(text) > 300, F.concat(char_prefix(text, 300), F.lit("..."))).otherwise(text)
    return F.when(has_context(context), short).otherwise("No reference available")


def context_line(context: Column, n: int = 400) -> Column:
    return strip(F.replace(char_prefix(context, n), F.lit("\n"), F.lit(" ")))


def fallback_question(context: Column) -> Column:
    words = F.slice(F.filter(tok(context_line(context)), lambda w: F.length(w) > 4), 1, 3)
    made = F.concat(F.lit("Explain how "), F.array_join(words, " "), F.lit(" works and why it is important in computer networks."))
    return F.when(F.size(words) > 0, made).otherwise("What are the key characteristics of this concept and how is it applied?")


def rejects_question(question: Column) -> Column:
    return (n_words(question) < 5) | any_of(F.lower(question), D.RANK_BAD_WORDS) | ~F.contains(question, F.lit("?"))


def cleaned_question(question: Column) -> Column:
    for junk in ("based on this context", "based on the context", "material:"):
        question = F.replace(question, F.lit(junk), F.lit(""))
    return strip(question)


def kept_question(question: Column, context: Column) -> Column:
    """A generated question, or the fallback made from its context where it is rejected."""
    q = cleaned_question(question)
    asked = F.when(q.endswith("?"), q).otherwise(F.concat(F.regexp_replace(q, "\\.+$", ""), F.lit("?")))
    return F.when(~has_context(context), "Unable to generate question - insufficient context").otherwise(F.when(rejects_question(q), fallback_question(context)).otherwise(asked))


def web_question(question: Column, context: Column) -> Column:
    made = F.concat(F.lit("What is "), F.coalesce(F.get(tok(context), 0), F.lit("")), F.lit(" and how does it work in computer systems?"))
    return F.when((n_words(question) < 5) | F.contains(F.lower(question), F.lit("generate")), made).otherwise(question)


def without_repetition(text: Column) -> Column:
    """The first two sentences where a word stands three times or more."""
    words = tok(text)
    often = F.exists(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)) >= 3)
    return F.when(often, F.concat(strip(F.array_join(F.slice(F.split(text, "\\."), 1, 2), ". ")), F.lit("."))).otherwise(text)


def key_points(intent: Column, difficulty: Column) -> Column:
    known = None
    for name, points in D.KEY_POINTS.items():
        value = F.array(*map(F.lit, points))
        known = F.when(intent == name, value) if known is None else known.when(intent == name, value)
    n = F.when(difficulty == "hard", 4).when(difficulty == "medium", 3).otherwise(2)
    definition = F.slice(F.array(*map(F.lit, D.DEFINITION_POINTS)), 1, n)
    return known.when(intent == "definition", definition).otherwise(F.array(*map(F.lit, D.OTHER_POINTS)))


# Labels of synthetic grading data, and documented keyword scores.


def grader_label(n: Column, contradiction: Column, entailment: Column, similarity: Column, draw: Column) -> Column:
    """A human-like score; ``draw`` in 0-1 stands for the uniform draws of the noisy branches."""
    value = (
        F.when(n < 5, draw * 0.2)
        .when(contradiction > 0.6, 0.1 + draw * 0.2)
        .when((similarity > 0.9) & (entailment > 0.8), 0.9 + draw * 0.1)
        .otherwise(similarity * 0.6 + entailment * 0.4)
    )
    return F.round(clamp(value, 0.0, 1.0), 3)


def keyword_score(answer: Column, keywords: list[str]) -> Column:
    return count_of(F.lower(answer), keywords) * 100.0 / len(keywords)


def quiz_level(score: Column) -> Column:
    return banded(score, [(75, "Excellent"), (60, "Good"), (45, "Average")], "Needs Improvement")


def final_category(score: Column) -> Column:
    return banded(score, [(0.8, "Excellent"), (0.6, "Good"), (0.4, "Average")], "Poor")


def question_prompt(context: Column, concept: Column | None = None) -> Column:
    """A prompt that asks for one question on a context; text generation itself is left to the caller."""
    about = F.lit("") if concept is None else F.concat(F.lit(" about '"), concept, F.lit("'"))
    return F.concat(F.lit("Write one clear technical interview question"), about, F.lit(".\n\nMaterial: "), context_line(context), F.lit("\n\nQuestion:"))


def expanded_queries(topic: Column) -> Column:
    return F.array(
        F.concat(topic, F.lit(" definition computer science")),
        F.concat(topic, F.lit(" explanation with example operating system dbms cn")),
        F.concat(topic, F.lit(" causes and conditions computer science")),
        F.concat(F.lit("what is "), topic, F.lit(" explain clearly with example")),
    )


def defines(text: Column, topic: Column) -> Column:
    low, t = F.lower(text), F.lower(topic)
    return F.contains(low, F.concat(t, F.lit(" is"))) | F.contains(low, F.concat(t, F.lit(" occurs")))


def recommendation(weak: Column, level_: Column) -> Column:
    focus = F.concat(F.lit("Focus on "), F.array_join(weak, ", "), F.lit(" to improve. You're at "), level_, F.lit(" level."))
    praise = F.concat(F.lit("Great progress! You're at "), level_, F.lit(" level. Try more challenging questions."))
    return F.when(F.size(weak) > 0, focus).otherwise(praise)


def report_lines(question: Column, answer: Column, score: Column, grade: Column) -> Column:
    """Four lines and a rule for each item of a text report."""
    rows = [F.concat(F.lit("Q: "), question), F.concat(F.lit("A: "), collapse(answer)), F.concat(F.lit("Score: "), score.cast("string")), F.concat(F.lit("Grade: "), grade)]
    return F.concat_ws("\n", *rows, F.lit("-" * 60))

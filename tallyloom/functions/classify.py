"""Rule classifiers of questions, and rule corrections of model scores held as MAP<STRING, DOUBLE>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import dictionaries as D
from tallyloom.functions.text import any_of, bound, fold_case, starts_with_any, strip


def is_question(x: Column) -> Column:
    return starts_with_any(F.lower(strip(x)), D.QUESTION_PREFIXES)


def rule_intent(x: Column) -> Column:
    return folded_intent(fold_case(x))


def folded_intent(q: Column) -> Column:
    """rule_intent of a text that is folded already; fold it in a column of its own, as each rule reads it."""
    return (
        F.when(starts_with_any(q, ["what is", "define"]), "definition")
        .when(starts_with_any(q, ["how would", "how to"]), "procedure")
        .when(q.startswith("why"), "reasoning")
        .when(q.startswith("explain") | F.contains(q, F.lit("how does")), "explanation")
        .when(any_of(q, ["compare", "difference"]), "comparison")
        .otherwise("explanation")
    )


def rule_topics(x: Column) -> Column:
    return folded_topics(fold_case(x))


def folded_topics(q: Column) -> Column:
    """rule_topics of a text that is folded already; fold it in a column of its own where several rules use it."""
    found = F.array_compact(F.array(*[F.when(any_of(q, terms), t) for t, terms in D.TOPIC_TERMS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General")))


def rule_difficulty(x: Column) -> Column:
    return folded_difficulty(fold_case(x))


def folded_difficulty(q: Column) -> Column:
    """rule_difficulty of a text that is folded already."""
    return (
        F.when(starts_with_any(q, ["what is", "define", "what are"]), "easy")
        .when(any_of(q, D.HARD_VERBS), "hard")
        .when(starts_with_any(q, ["how would", "how to", "why", "explain"]) | any_of(q, ["compare", "difference"]), "medium")
        .when(any_of(q, D.HARD_SUBJECTS), "hard")
        .otherwise("medium")
    )


def scored(labels: list[str], chosen: Column, hit: float, miss: float) -> Column:
    """MAP of every label to ``hit`` if chosen (a label or an array of them), else ``miss``."""
    return F.create_map(*[v for t in labels for v in (F.lit(t), F.when(chosen(t), hit).otherwise(miss))])


def intent_result(x: Column) -> Column:
    """struct(label, confidence, scores, source); null where the text is no question."""
    label = rule_intent(x)
    scores = scored(D.INTENTS, lambda t: label == t, 0.6, 0.1)
    return F.when(is_question(x), F.struct(label.alias("label"), F.lit(0.6).alias("confidence"), scores.alias("scores"), F.lit("rule").alias("source")))


def difficulty_result(x: Column) -> Column:
    label = rule_difficulty(x)
    scores = scored(D.DIFFICULTIES, lambda t: label == t, 0.6, 0.2)
    return F.when(is_question(x), F.struct(label.alias("label"), F.lit(0.6).alias("confidence"), scores.alias("scores"), F.lit("rule").alias("source")))


def topic_result(x: Column, labels: Column | None = None) -> Column:
    """labels: rule_topics of x, if they are at hand."""
    labels = rule_topics(x) if labels is None else labels
    scores = scored(D.TOPICS, lambda t: F.array_contains(labels, t), 0.9, 0.1)
    return F.when(is_question(x), F.struct(labels.alias("labels"), scores.alias("scores"), F.lit("rule").alias("source")))


def profile_confidence(intent: Column, difficulty: Column) -> Column:
    return (intent["confidence"] + difficulty["confidence"]) / 2


def demo_labels(x: Column) -> Column:
    low = F.lower(x)
    level = F.when(any_of(low, ["three-way", "tcp"]), "medium").when(any_of(low, ["routing", "congestion"]), "hard").otherwise("easy")
    topics = F.when(level == "medium", "networking").when(level == "hard", "advanced_networking").otherwise("basics")
    intent = F.when(F.contains(low, F.lit("explain")), "explanation").when(F.contains(low, F.lit("what")), "definition").otherwise("general")
    return F.struct(intent.alias("intent"), level.alias("difficulty"), topics.alias("topics"), F.lit(0.85).alias("confidence"), F.lit(0.92).alias("intent_confidence"), F.lit(0.88).alias("difficulty_confidence"))


# Score maps, over a fixed list of labels whose order breaks ties.


def top_label(scores: Column, labels: list[str]) -> Column:
    """The first label of the largest score."""
    best = F.array_max(F.map_values(scores))
    return F.coalesce(*[F.when(F.element_at(scores, t) == best, t) for t in labels])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def nudged(scores: Column, label: Column, up: Column, down: Column) -> Column:
    """One label raised, the others lowered, all within 0-1 and summing to 1."""
    moved = F.transform_values(scores, lambda k, v: F.when(k == label, F.least(F.lit(1.0), v + up)).otherwise(F.greatest(F.lit(0.0), v - down)))

    def level(m: Column) -> Column:
        return bound(_sum(F.map_values(m)), lambda total: F.when(total > 0, F.transform_values(m, lambda k, v: v / total)).otherwise(m))

    return bound(moved, level)


def difficulty_rule(low: Column, q: Column, scores: Column) -> Column:
    """struct(label, boost) that correct difficulty scores; low: the text in lower case and stripped, q: folded."""
    top = F.array_max(F.map_values(scores))
    easy, hard = starts_with_any(low, D.STRONG_EASY_PREFIXES), starts_with_any(low, D.STRONG_HARD_PREFIXES)
    disguised = easy & any_of(low, ["difference between", " vs "])
    label = F.when(disguised, "medium").when(easy, "easy").when(hard, "hard").otherwise(folded_difficulty(q))
    boost = F.when(disguised, 0.40).when(easy | hard, 0.55).otherwise(F.greatest(F.lit(0.20), 0.55 - top))
    return F.struct(label.alias("label"), boost.alias("boost"))


def calibrated_difficulty(scores: Column, text: Column, rule: Column | None = None) -> Column:
    """rule: difficulty_rule of the text, as a column, so that it is not found again for every label."""
    if rule is None:
        return bound(difficulty_rule(strip(F.lower(text)), fold_case(text), scores), lambda r: calibrated_difficulty(scores, text, r))
    top, label, boost = F.array_max(F.map_values(scores)), rule["label"], rule["boost"]
    unsure = (top_label(scores, D.DIFFICULTIES) != label) | (top < 0.70)
    return F.when(unsure, nudged(scores, label, boost, boost / 2)).otherwise(scores)


def intent_signal(low: Column) -> Column:
    """The intent that corrects intent scores, if any, of a text in lower case."""
    return (
        F.when(starts_with_any(low, ["how would", "how to", "implement", "design", "write", "describe how"]), "procedure")
        .when(starts_with_any(low, ["what is", "what are", "define", "what do"]), "definition")
        .when(low.startswith("why"), "reasoning")
        .when(low.startswith("explain") | any_of(low, ["how does", "how do"]), "explanation")
        .when(starts_with_any(low, ["compare", "difference"]) | any_of(low, ["difference between", "compare "]), "comparison")
    )


def calibrated_intent(scores: Column, text: Column, label: Column | None = None) -> Column:
    """label: intent_signal of the text, as a column, so that it is not found again for every label."""
    if label is None:
        return bound(intent_signal(F.lower(text)), lambda found: calibrated_intent(scores, text, found))
    top = F.array_max(F.map_values(scores))
    unsure = label.isNotNull() & ((F.element_at(scores, label) < top) | (top < 0.60))
    return F.when(unsure, nudged(scores, label, F.lit(0.45), F.lit(0.45 / 4))).otherwise(scores)


def topic_signals(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {t: any_of(low, terms) for t, terms in D.CALIBRATION_TERMS.items()}


def calibrated_topics(scores: Column, text: Column, signals: dict[str, Column] | None = None, rules: Column | None = None) -> Column:
    """Corrections one after another, each within 0-1; not made to sum to 1.

    signals and rules: topic_signals and rule_topics of the text, as columns,
    so that they are not found again for every label.
    """
    s = signals or topic_signals(text)
    steps = [
        (s["DSA"] & ~s["OOP"], {"DSA": 0.12, "OOP": -0.22}),
        (F.contains(F.lower(text), F.lit("hash")) & ~s["DBMS"], {"DSA": 0.10, "DBMS": -0.18}),
        (s["OOP"] & ~s["DSA"], {"OOP": 0.12, "DSA": -0.22}),
        (s["DSA"] & s["OOP"], {"DSA": 0.14, "OOP": 0.14}),
        (s["DBMS"] & ~s["OS"], {"DBMS": 0.12, "OS": -0.22}),
        (s["DBMS"] & ~s["DSA"], {"DBMS": 0.20, "DSA": -0.30}),
    ]

    def within(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    rules = rule_topics(text) if rules is None else rules
    named = ~F.array_contains(rules, "General")

    def corrected(k: Column, v: Column) -> Column:
        for when, moves in steps:
            by = F.coalesce(*[F.when(k == t, d) for t, d in moves.items()], F.lit(0.0))
            v = F.when(when, within(v + by)).otherwise(v)
        return F.when(named, within(v + F.when(F.array_contains(rules, k), 0.6).otherwise(-0.4))).otherwise(v)

    return F.transform_values(scores, corrected)


def selected_topics(scores: Column, text: Column, labels: list[str] = D.TOPICS, threshold: float = 0.5, signals: dict[str, Column] | None = None) -> Column:
    s = signals or topic_signals(text)
    both = s["DSA"] & s["OOP"]
    over = F.array_compact(F.array(*[F.when(F.element_at(scores, t) >= threshold, t) for t in labels]))
    forced = F.when(both, F.array_union(over, F.array(F.lit("DSA"), F.lit("OOP")))).otherwise(over)
    return F.when(F.size(forced) > 0, forced).otherwise(F.array(top_label(scores, labels)))


# Encodings.


def label_index(label: Column, labels: list[str]) -> Column:
    """Place from 0; an unknown label is an error."""
    at = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("long"))


def multi_hot(chosen: Column, labels: list[str]) -> Column:
    return F.array(*[F.array_contains(chosen, t).cast("double") for t in labels])


def by_score(scores: Column) -> Column:
    """Entries of a score map, largest first, names in order on ties."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["k"].alias("label"), (-e["s"]).alias("score")))


def blended(a: Column, b: Column, labels: list[str], alpha: float = D.EMBEDDING_WEIGHT, beta: float = D.CLASSIFIER_WEIGHT) -> Column:
    """alpha * a + beta * b over the labels that both maps have."""
    mixed = F.map_zip_with(a, b, lambda k, x, y: F.round(alpha * x + beta * y, 4))
    return F.map_filter(mixed, lambda k, v: v.isNotNull() & k.isin(labels))


def conjunction(*conditions: Column | None) -> Column:
    """All conditions that are given; none gives true."""
    return reduce(lambda x, y: x & y, [c for c in conditions if c is not None], F.lit(True))

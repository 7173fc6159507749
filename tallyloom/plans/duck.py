"""Fragments of DuckDB SQL that say the same as the column functions."""

from __future__ import annotations

from tallyloom.functions.text import BLANKS, quoted


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def has(x: str, terms: list[str]) -> str:
    return f"regexp_matches({x}, {lit('|'.join(quoted(t) for t in terms))})"


def starts(x: str, prefixes: list[str]) -> str:
    return f"regexp_matches({x}, {lit('^(?:' + '|'.join(quoted(p) for p in prefixes) + ')')})"


def tok(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{BLANKS}]+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({tok(x)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def fold_case(x: str) -> str:
    return collapse(f"lower({x})")


def fold_marks(x: str) -> str:
    return collapse(f"regexp_replace(lower({x}), '[^a-z0-9{BLANKS}]', ' ', 'g')")


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({tok(a)}, {tok(b)}))"


def count_of(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(t)})::INT" for t in terms) + ")"


def banded(x: str, rows: list[tuple], otherwise: str | None = None) -> str:
    def show(v: object) -> str:
        return lit(v) if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {x} >= {bound} THEN {show(value)}" for bound, value in rows)
    return f"(CASE {whens}" + ("" if otherwise is None else f" ELSE {show(otherwise)}") + " END)"


def case_of(x: str, values: dict[str, str]) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + " END)"


def clean_text(x: str) -> str:
    x = f"regexp_replace({x}, '[{BLANKS}]+', ' ', 'g')"
    x = f"regexp_replace({x}, '[^\\x00-\\x7F]+', ' ', 'g')"
    return strip(f"regexp_replace({x}, 'http[^{BLANKS}]+', '', 'g')")


def clean_lines(x: str) -> str:
    x = f"regexp_replace({x}, '[^\\x00-\\x7F\\n]+', ' ', 'g')"
    return strip(f"regexp_replace({x}, 'http[^{BLANKS}]+', '', 'g')")


def strength(n: str, acc: str) -> str:
    return f"CASE WHEN {n} < 3 THEN 'untested' WHEN {acc} >= 80 THEN 'strong' WHEN {acc} >= 60 THEN 'moderate' ELSE 'weak' END"


def level(n: str, acc: str) -> str:
    return f"CASE WHEN {n} < 5 THEN 'beginner' WHEN {acc} >= 80 THEN 'advanced' WHEN {acc} >= 60 THEN 'intermediate' ELSE 'beginner' END"


def rule_intent(x: str) -> str:
    return f"""CASE WHEN {starts(x, ["what is", "define"])} THEN 'definition' WHEN {starts(x, ["how would", "how to"])} THEN 'procedure'
        WHEN {starts(x, ["why"])} THEN 'reasoning' WHEN {starts(x, ["explain"])} OR contains({x}, 'how does') THEN 'explanation'
        WHEN {has(x, ["compare", "difference"])} THEN 'comparison' ELSE 'explanation' END"""


def rule_difficulty(x: str) -> str:
    from tallyloom.functions.dictionaries import HARD_SUBJECTS, HARD_VERBS

    return f"""CASE WHEN {starts(x, ["what is", "define", "what are"])} THEN 'easy' WHEN {has(x, HARD_VERBS)} THEN 'hard'
        WHEN {starts(x, ["how would", "how to", "why", "explain"])} OR {has(x, ["compare", "difference"])} THEN 'medium'
        WHEN {has(x, HARD_SUBJECTS)} THEN 'hard' ELSE 'medium' END"""


def rule_topics(x: str) -> str:
    """A list of topics; General alone if none."""
    from tallyloom.functions.dictionaries import TOPIC_TERMS

    found = "list_filter([" + ", ".join(f"CASE WHEN {has(x, terms)} THEN {lit(t)} END" for t, terms in TOPIC_TERMS.items()) + "], lambda t: t IS NOT NULL)"
    return f"(CASE WHEN len({found}) > 0 THEN {found} ELSE ['General'] END)"


ATTEMPTS = """
attempts AS (
  SELECT user_id, event_id AS seq, ts, greatest(0.0, least(100.0, value)) AS score,
         CASE event_type WHEN 'click' THEN 'DSA' WHEN 'purchase' THEN 'OS' WHEN 'error' THEN 'DBMS' WHEN 'signup' THEN 'CN' WHEN 'view' THEN 'OOP' END AS topic,
         ['definition', 'explanation', 'comparison', 'procedure', 'reasoning'][1 + k % 5] AS intent,
         CASE WHEN k < 34 THEN 'easy' WHEN k < 67 THEN 'medium' ELSE 'hard' END AS difficulty, k
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)
)"""

ANSWERS = """
answers AS (
  SELECT conv_id, turn, coalesce(before, '') AS question, text AS answer
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = 'assistant'
), dealt AS (SELECT conv_id, turn, question, answer, item_id AS slot, text AS reference FROM answers
  JOIN (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark) ON place = conv_id % n)"""

BANK = """
bank AS (
  SELECT item_id AS question_id, text, ['DSA', 'OS', 'DBMS', 'CN', 'OOP'][1 + item_id % 5] AS topic,
         ['easy', 'medium', 'hard'][1 + item_id % 3] AS difficulty,
         ['definition', 'explanation', 'comparison', 'procedure', 'reasoning'][1 + item_id % 5] AS intent
  FROM benchmark
)"""

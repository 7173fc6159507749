import pytest

from tallyloom import catalog


@pytest.mark.parametrize(("query", "most"), [("difficulty_calibration", 1), ("intent_calibration", 0), ("intent_classifier", 1)])
def test_a_text_is_folded_once_a_row(spark, tiny, query, most):
    """Rules that read a folded text many times read a column; an expression in each place folds the text again."""
    from tallyloom.plans import text_queries as T

    frame = T._intent_rows(spark, tiny).filter("question_id > 0") if query == "intent_classifier" else catalog.queries()[query](spark, tiny)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [")
    assert plan.count("split(") <= most * scans and plan.count("lower(") <= 2 * scans

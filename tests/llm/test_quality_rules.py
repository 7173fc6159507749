import brute
import pytest

from tallyloom.llm import quality_rules as Q


plain = brute.plain_counts


def test_counts_equal_brute_force(docs, rows):
    got = {r.doc_id: r for r in Q.judge(docs, []).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r, want = got[doc_id], plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)  # nothing is trusted, so only the counts decide


@pytest.mark.parametrize("text", ["a b c\na b c\n\n \n", "#*$%&|<>", "x\x0by z\x1fw", None, "é é é é é"])
def test_counts_of_odd_texts(text):
    assert Q.plain_counts(text) == plain(text)


def test_unlike_documents_go(spark):
    good = [(i, "the river runs along the old town and its people walk there in spring " * 5 + str(i)) for i in range(40)]
    bad = [(100 + i, "XK!! ZQW!! PPT!! GRR!! VVX!! JJQ!! " * 2 + " ".join(f"Q{i}Z{k}!!" for k in range(60))) for i in range(6)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    got = {r.doc_id: r for r in Q.judge(docs, [i for i, _ in good]).collect()}
    assert all(not got[i].base_failed and not got[i].kept and got[i].score < Q.THRESHOLD for i, _ in bad)
    assert all(got[i].score > Q.THRESHOLD for i, _ in good)


def test_grams_do_not_cross_texts(spark):
    """Scores do not depend on what stands beside a text in its batch."""
    docs = spark.createDataFrame([(1, "abcabc"), (2, "xyzxyz"), (3, "abcabc"), (4, None), (5, "ab")], "doc_id long, text string")
    one = {r.doc_id: r.score for r in Q.judge(docs.coalesce(1), [1, 3]).collect()}
    many = {r.doc_id: r.score for r in Q.judge(docs.repartition(5), [1, 3]).collect()}
    assert one == many and one[1] == one[3] > 0 > one[2] and one[4] == one[5] == 0


def test_empty_and_repeated(nothing, repeated):
    assert Q.judge(nothing, []).count() == 0
    assert Q.judge(repeated, [7]).count() == 6
    assert Q.trusted_ids(nothing.selectExpr("doc_id", "1 AS quality")) == []


def test_scores_and_verdicts_equal_brute_force(docs, rows):
    trusted = [i for i, _ in rows if i % 2]
    got = {r.doc_id: r for r in Q.judge(docs, trusted).collect()}
    want = brute.quality(rows, set(trusted))
    assert {i: r.kept for i, r in got.items()} == {i: k for (i, _), (_, k) in zip(rows, want)}
    for (i, _), (score, _) in zip(rows, want):
        assert got[i].score == pytest.approx(score, abs=1e-9)


def test_kept_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "one two", "k", 2.5, "a.b")], "doc_id long, text string, Kept string, score double, `n.words` string")
    row = Q.judge(docs, [], keep=("text", "Kept", "score", "n.words"), prefix="new_").first()
    assert (row["text"], row["Kept"], row["score"], row["n.words"], row["new_kept"], row["new_n_words"]) == ("one two", "k", 2.5, "a.b", False, 2)

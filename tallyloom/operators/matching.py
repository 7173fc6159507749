"""Answer-bank matching, nearest neighbours and score blending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.functions import dictionaries as D
from tallyloom.functions.text import fold_marks, tok
from tallyloom.functions.vectors import as_double, cosine, l2_squared, relevance
from tallyloom.operators import neighbours

#: Rows of a broadcast side, checked before the hint is given.
BROADCAST_ROWS = 50_000
#: Domains whose centres ride along with each vector.
DOMAINS = 10_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side that has at most ``limit`` rows; without the hint beyond."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def blocks(df: DataFrame, key: str, limit: int | None = None) -> list[DataFrame]:
    """df as one or more parts of about ``limit`` rows (``BROADCAST_ROWS``), each with the broadcast hint, for joins without an equal key."""
    limit = limit or BROADCAST_ROWS
    n = -(-df.count() // limit)
    if n <= 1:
        return [F.broadcast(df)]
    return [F.broadcast(df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def bank_words(x: Column) -> Column:
    """Distinct content words of a normal form, synonyms folded."""
    words = F.array_except(F.array_distinct(tok(x)), F.array(*map(F.lit, D.BANK_STOP_WORDS)))
    same = F.create_map(*[F.lit(v) for kv in D.BANK_SYNONYMS.items() for v in kv])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.element_at(same, w), w)))


#: Characters of the substrings by which containment is joined.
GRAM = 6


def _grams(x: Column, size: int) -> Column:
    """The different substrings of ``size`` characters."""
    each = F.transform(F.sequence(F.lit(1), F.length(x) - (size - 1)), lambda i: F.substring(x, i, size))
    return F.when(F.length(x) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def lengths(rows: DataFrame, x: str, *others: Column) -> Row:
    """One row about a text column: ``longest``, ``total`` characters, ``sizes`` of the substrings that stand for its rows, and other aggregates."""
    n = F.length(x)
    found = F.collect_set(F.when(n > 0, F.least(n, F.lit(GRAM))))  # GRAM values at most
    return rows.agg(F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), found.alias("sizes"), *others).first()


def containment(texts: DataFrame, parts: DataFrame, about_texts: Row | None = None, about_parts: Row | None = None) -> DataFrame:
    """(text_id, part_id) for every text that contains a part.

    texts: (text_id, text); parts: (part_id, part), none of them empty.  A
    part is known by one of its substrings of ``GRAM`` characters (of its
    whole length if it is shorter), the one that the fewest texts have, so a
    text meets only the parts whose rarest substring it has.  Those are then
    compared in full.  Parts with a substring that no text has go at once.

    Work is linear in the characters of the texts plus the pairs compared;
    there is no pair of a text and a part without a common substring, no
    bound on either side, and the text itself is shuffled once, by text_id.
    What ``lengths`` says of both sides may be given if it is known.
    """
    about_texts, about_parts = about_texts or lengths(texts, "text"), about_parts or lengths(parts, "part")
    parts = parts.filter(F.length("part") <= about_texts.longest)
    size, sizes = F.least(F.length("part"), F.lit(GRAM)), sorted(about_parts.sizes)
    if not sizes:
        return texts.sparkSession.createDataFrame([], StructType([texts.schema["text_id"], parts.schema["part_id"]]))
    own = parts.select("part_id", F.explode(F.coalesce(*[F.when(size == s, _grams(F.col("part"), s)) for s in sizes])).alias("gram"))
    every = F.flatten(F.array(*[_grams(F.col("text"), s) for s in sizes]))
    grams = own.select("gram").distinct()
    # Only what some part has goes on, before anything of the texts is shuffled if that is little.
    held = texts.select("text_id", F.explode(every).alias("gram")).join(F.broadcast(grams) if about_parts.total <= BROADCAST_ROWS else grams, "gram")
    known = held.groupBy("gram").agg(F.count("*").alias("texts"))
    asked = own.join(known, "gram", "left")
    rarest = asked.groupBy("part_id").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("least")).filter("least.texts > 0")
    chosen = rarest.select("part_id", F.col("least.gram").alias("gram")).join(parts, "part_id")
    met = held.join(chosen, "gram").select("text_id", "part_id", "part")
    return met.join(texts, "text_id").filter(F.contains("text", F.col("part"))).select("text_id", "part_id")


def bank_match(questions: DataFrame, bank: DataFrame, least: float = 0.18) -> DataFrame:
    """(question_id, pos, how, score): the bank pattern of each question.

    questions: (question_id, text); bank: (pos, pattern).  In turn: equal
    normal forms; a pattern that contains or is contained, longest first; the
    best weighted word overlap above ``least``.  Earlier patterns win ties.
    A question without a word is contained in every pattern.

    Each different normal form is matched once.  Containment is joined on
    rare substrings, both ways; overlaps are an equi-join on words.  A
    pattern that shares no word scores by its length alone, so the best such
    pattern is one row for all; there is no join without an equal key.
    """
    named = questions.select("question_id", fold_marks(F.col("text")).alias("q"))
    q = named.select("q").distinct().withColumn("qw", bank_words(F.col("q")))
    b = bank.select("pos", fold_marks(F.col("pattern")).alias("p")).withColumn("pw", bank_words(F.col("p"))).withColumn("n", F.size(tok(F.col("p"))))
    longest = F.min(F.struct((-F.col("n")).alias("n"), "pos"))
    alone = F.min(F.struct((-F.round(F.least(F.lit(1.0), F.size("pw") / 6) * 0.3, 9)).alias("s"), "pos"))
    counts = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("pw")), F.lit(0)).alias("words")]
    about = lengths(b, "p", *counts, F.min(F.when(F.col("p") != "", F.struct((-F.col("n")).alias("n"), "pos"))).alias("first"), alone.alias("bare"))
    about_q = lengths(q, "q")
    equal = q.join(F.broadcast(b) if about.rows <= BROADCAST_ROWS else b, F.col("q") == F.col("p")).groupBy("q").agg(F.min("pos").alias("e_pos"))
    full, asked = b.filter("p <> ''"), q.filter("q <> ''")
    around = containment(asked.select(F.col("q").alias("text_id"), F.col("q").alias("text")), full.select(F.col("pos").alias("part_id"), F.col("p").alias("part")), about_q, about)
    within = containment(full.select(F.col("pos").alias("text_id"), F.col("p").alias("text")), asked.select(F.col("q").alias("part_id"), F.col("q").alias("part")), about, about_q)
    pairs = around.select(F.col("text_id").alias("q"), F.col("part_id").alias("pos")).union(within.select(F.col("part_id").alias("q"), F.col("text_id").alias("pos")))
    held = pairs.join(b.select("pos", "n"), "pos").groupBy("q").agg(longest["pos"].alias("c_pos"))
    first, bare = about.first and about.first.pos, about.bare
    per_word = b.select("pos", F.size("pw").alias("np"), F.explode("pw").alias("w"))
    overlap = (
        q.select("q", F.size("qw").alias("nq"), _boosted(F.col("qw")).alias("boost"), F.explode("qw").alias("w"))
        .join(F.broadcast(per_word) if about.words <= BROADCAST_ROWS else per_word, "w")
        .groupBy("q", "nq", "boost", "pos", "np")
        .agg(F.count("*").alias("o"))
    )
    score = F.col("o") / (F.col("np") + F.col("nq") - F.col("o")) * 0.7 + F.least(F.lit(1.0), F.col("np") / 6) * 0.3 + F.col("o") * 0.1 + F.when(F.col("boost"), 0.25).otherwise(0.0)
    ranked = F.struct((-F.round(score, 9)).alias("s"), "pos")
    shared = overlap.groupBy("q").agg(F.min(ranked).alias("own"))
    out = q.select("q").join(equal, "q", "left").join(held, "q", "left").join(shared, "q", "left")
    if bare is not None:
        out = out.withColumn("own", F.least("own", F.struct(F.lit(bare.s).alias("s"), F.lit(bare.pos).cast(b.schema["pos"].dataType).alias("pos"))))
    out = out.withColumn("c_pos", F.coalesce("c_pos", F.when(F.col("q") == "", F.lit(first))))
    own = F.when(-F.col("own.s") > least, F.col("own"))
    out = out.select(
        "q",
        F.coalesce("e_pos", "c_pos", own["pos"]).alias("pos"),
        F.when(F.col("e_pos").isNotNull(), "equal").when(F.col("c_pos").isNotNull(), "contains").when(own.isNotNull(), "words").otherwise("none").alias("how"),
        F.when(F.coalesce("e_pos", "c_pos").isNull(), -own["s"]).alias("score"),
    )
    return named.join(out, "q", "left").select("question_id", "pos", F.coalesce("how", F.lit("none")).alias("how"), "score")


def _boosted(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, D.BANK_BOOST_WORDS)))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, by: str = "l2") -> DataFrame:
    """(query_id, rank, vec_id, score, relevance): exact k nearest; ties by vec_id.

    queries and vectors: (vec_id, embedding).  Queries ride along in blocks,
    and tasks find their k best by matrix products (``neighbours``), so what
    moves is k rows a query and task.  A pair without both vectors has no
    score and comes last, by vec_id.
    """
    q = queries.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    v = neighbours.dealt_out(vectors.select("vec_id", "embedding").filter(whole))
    found = [neighbours.best(v, block, k, by).select("query_id", "vec_id", F.round("score", 6).alias("score")) for block in neighbours.blocks(q)]
    # Pairs without a score fill up what is left of the k: the smallest ids will do.
    least = lambda rows: F.broadcast(rows.select("vec_id").orderBy("vec_id").limit(k))
    for asked, others in ((q.filter(whole), vectors.filter(~whole)), (q.filter(~whole), vectors)):
        found.append(asked.select("query_id").crossJoin(least(others)).withColumn("score", F.lit(None).cast("double")))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("score") if by == "l2" else F.desc_nulls_last("score"), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.round(relevance(F.col("score")), 6).alias("relevance"))


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, centre): mean vector of each label; sums are partial before the shuffle."""
    cells = vectors.select(label, F.posexplode(as_double(F.col("embedding"))).alias("i", "x"))
    means = cells.groupBy(label, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centre"))


def domain_ensemble(vectors: DataFrame, domains: DataFrame, alpha: float = D.EMBEDDING_WEIGHT, beta: float = D.CLASSIFIER_WEIGHT) -> DataFrame:
    """(vec_id, domain, confidence): the best blend of cosine and a softmax over distances; the smaller label wins ties.

    The softmax stands in for a fine-tuned classifier's probabilities, whose
    weights do not exist here.  The centres, ``DOMAINS`` at most, ride along
    as one array, so a vector is judged within its row.
    """
    if domains.limit(DOMAINS + 1).count() > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    one = domains.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("domains"))
    v = F.col("v")
    each = F.transform("domains", lambda d: F.struct(d["label"].alias("label"), F.round(cosine(v, d["centre"]), 6).alias("a"), F.exp(-l2_squared(v, d["centre"])).alias("e")))
    rows = vectors.select("vec_id", as_double(F.col("embedding")).alias("v")).join(F.broadcast(one)).select("vec_id", each.alias("each"))
    rows = rows.withColumn("total", F.aggregate("each", F.lit(0.0), lambda s, d: s + d["e"]))
    share = lambda d: F.round(F.when(F.col("total") > 0, d["e"] / F.col("total")).otherwise(0.0), 6)
    blends = F.transform("each", lambda d: F.struct(F.round(alpha * d["a"] + beta * share(d), 4).alias("confidence"), (-d["label"]).alias("d")))
    best = rows.select("vec_id", F.array_max(blends).alias("best"))
    return best.select("vec_id", (-F.col("best.d")).alias("domain"), F.col("best.confidence").alias("confidence"))


def band_join(rows: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """rows with the band (name, low, high) that holds the value; the bands are a small table."""
    return rows.join(small(bands), (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high")), "left")

"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word 2-gram of every document is hashed and joined to the
2-gram positions of the templates.  A hit at document word p and template
word q votes for the diagonal p - q; a phrase standing verbatim at word d
gets all its votes on diagonal d.  The hash only selects; the join compares
the words themselves, so each vote is verified text.  In templates of
``LONG`` words or more a vote also needs the template's word before or after
the pair, so that pairs such as "of the" in prose are no votes.

Neighbouring diagonals are merged in bands: diagonal d and the next ``slack``
ones (an inserted word moves the rest of a notice to the next diagonal).  A
band is verified as a span: its share is the number of different template
positions it hits, and of different document positions if those are fewer,
over the positions the template has.  So a passage that repeats one part of a
notice gets no more than that part, a span is at most ``slack`` words longer
than its template, and hits more than ``slack`` words apart are in the
template's order.  Spans with ``min_share`` or more count; of bands that lie
within ``slack`` of each other the one with the largest share is reported.

Defined results: null text counts as empty; a document without words has
one row with zeros and nulls; rows that repeat (doc_id, text) each get their
own result row; rows that share a doc_id but not the text are scanned apart;
an empty table gives an empty result; other input columns are ignored.

Scale: one scan, no shuffle of text.  The template side is a literal table
whose size is checked before it is broadcast; what is shuffled is one row a
document plus one row per voted diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import ALNUM_GAP, ascii_lower, id_and_text, split_words

# Phrases that must stand verbatim, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Wording of common public license notices, and our labels.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-header",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-header",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "subject to the terms of the mozilla public license": "mpl-notice",
    "all rights reserved": "all-rights-reserved",
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ): "mit-full",
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license"
    ): "apache-2.0-full",
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that "
        "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"
    ): "gpl-3.0-full",
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission"
    ): "bsd-3-clause-full",
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at http mozilla org mpl 2 0"
    ): "mpl-2.0-full",
}

SLACK = 2
MIN_SHARE = 0.75
#: Words from which on a template's votes need a third word beside the pair.
LONG = 8
#: Template 2-grams that may be broadcast; more than this is refused.
MAX_TEMPLATE_GRAMS = 100_000


def template_rows(base: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """(template id, label, is_base, grams in the template, place, word, next word, word before, word after) of every template 2-gram."""
    rows = []
    named = [(p, b, True) for p, b in base.items()] + [(p, b, False) for p, b in notices.items()]
    for tid, (phrase, label, is_base) in enumerate(named):
        words = phrase.split()
        if len(words) < 2:
            raise ValueError(f"a template needs two words or more: {phrase!r}")
        around = [None, *words, None]
        rows += [(tid, label, is_base, len(words) - 1, i, words[i], words[i + 1], around[i], around[i + 3]) for i in range(len(words) - 1)]
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(rows)} template grams; at most {MAX_TEMPLATE_GRAMS} may be broadcast")
    return rows


def template_cells(rows: list[tuple]) -> str:
    """The rows as SQL literals."""
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool | int) else f"'{x}'" for x in r) + ")" for r in rows)


def template_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A literal relation, so that no Python runs for it on the executors."""
    values = f"SELECT * FROM VALUES {template_cells(rows)} AS t(tid, label, is_base, t_grams, t_pos, t_word, t_next, t_before, t_after)"
    return spark.sql(values).withColumn("t_gram", F.xxhash64("t_word", "t_next"))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICES,
    slack: int = SLACK,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists the method's verified spans as (first word, last word, label, share).
    """
    spark = docs.sparkSession
    templates = F.broadcast(template_table(spark, template_rows(base, notices)))

    words = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"),
        split_words(ascii_lower(F.col("text")), ALNUM_GAP).alias("words"),
    )
    grams = words.select("doc_id", "copy", "words", F.posexplode_outer("words").alias("pos", "word")).select(
        "doc_id",
        "copy",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.size("words").cast("long").alias("n_words"),
        "word",
        F.get("words", F.col("pos") + 1).alias("next"),
        F.get("words", F.col("pos") - 1).alias("before"),
        F.get("words", F.col("pos") + 2).alias("after"),
    )
    supported = (F.col("t_grams") < LONG - 1) | (F.col("before") == F.col("t_before")) | (F.col("after") == F.col("t_after"))
    hits = grams.withColumn("gram", F.when(F.col("next").isNotNull(), F.xxhash64("word", "next"))).join(
        templates,
        (F.col("gram") == F.col("t_gram")) & (F.col("word") == F.col("t_word")) & (F.col("next") == F.col("t_next")) & supported,
        "left",
    )
    # Word 0 of each document keeps its row without a hit, which counts the document itself.
    votes = (
        hits.filter(F.col("tid").isNotNull() | (F.col("pos") == 0))
        .withColumn("diagonal", F.when(F.col("tid").isNotNull(), F.col("pos") - F.col("t_pos")))
        .groupBy("doc_id", "copy", "n_words", "tid", "label", "is_base", "t_grams", "diagonal")
        .agg(F.count_if(F.col("pos") == 0).alias("heads"), F.collect_set("t_pos").alias("template"))
    )
    same_doc = Window.partitionBy("doc_id", "copy")
    line = Window.partitionBy("doc_id", "copy", "tid").orderBy("diagonal")
    band, around = line.rangeBetween(0, slack), line.rangeBetween(-slack, slack)
    # A gram at word 0 is seen once a copy of the row; so is the bare word 0.
    zero_grams = F.sum(F.when(F.col("tid").isNull(), F.col("heads"))).over(same_doc)
    zero_hits = F.max(F.when(F.col("tid").isNotNull(), F.col("heads"))).over(same_doc)
    here = F.transform("template", lambda q: q + F.col("diagonal"))
    spans = (
        votes.withColumns({"copies": F.coalesce(zero_grams, zero_hits), "here": here})
        .withColumns({"all_template": F.array_distinct(F.flatten(F.collect_list("template").over(band))), "all_here": F.array_distinct(F.flatten(F.collect_list("here").over(band)))})
        .withColumn("share", F.least(F.size("all_template"), F.size("all_here")) / F.col("t_grams"))
        .withColumn("best", F.struct("share", -F.col("diagonal")) == F.max(F.struct("share", -F.col("diagonal"))).over(around))
    )
    is_notice = ~F.col("is_base") & (F.col("share") >= min_share)
    base_hit = F.col("is_base") & (F.size("template") == F.col("t_grams"))
    place = F.col("diagonal").cast("long")
    span = F.struct(F.array_min("all_here").cast("long").alias("first"), (F.array_max("all_here") + 1).cast("long").alias("last"), "label", "share")
    found = spans.groupBy("doc_id", "copy", "n_words", "copies").agg(
        F.count_if(base_hit).alias("n_base"),
        F.min(F.when(base_hit, place)).alias("first_word"),
        F.max(F.when(base_hit, place)).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base_hit, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(base_hit | is_notice, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base_hit, F.lit(1.0)).when(is_notice, F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(is_notice & F.col("best"), span))).alias("spans"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        "labels",
        "score",
        "spans",
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one"),
    ).drop("one")

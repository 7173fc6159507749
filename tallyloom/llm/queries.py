"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, language_id, license_scan, manifest, packing, pieces, quality_rules, resampling, sharding, simhash, suffix_dedup, toxicity, warc
from tallyloom.llm.common import scratch_path, table


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def _op1_sql() -> str:
    """Phrases are sought as strings at every word; a notice's share by counting, for each place it could start at, the pairs that stand there or up to SLACK words later."""
    pairs = license_scan.template_cells(license_scan.template_rows({}, license_scan.NOTICES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.BASE_PHRASES.items())
    return f"""
WITH t(tid, label, is_base, t_grams, t_pos, word, next, b, a) AS (VALUES {pairs}),
f(phrase, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS place, label FROM d, f, unnest(range(1, len(w) + 1)) r(i)
        WHERE w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
x AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
g AS (SELECT doc_id, i AS pos, w[i] AS word, w[i + 1] AS next, CASE WHEN i > 1 THEN w[i - 1] END AS b, w[i + 2] AS a FROM d, unnest(range(1, len(w))) r(i)),
h AS (SELECT doc_id, tid, label, t_grams, pos, t_pos, pos - t_pos AS start FROM g JOIN t USING (word, next)
        WHERE t_grams < {license_scan.LONG - 1} OR g.b = t.b OR g.a = t.a),
s AS (SELECT o.doc_id, o.label, least(count(DISTINCT h.t_pos), count(DISTINCT h.pos)) / o.t_grams AS share
        FROM (SELECT DISTINCT doc_id, tid, label, t_grams, start FROM h) o JOIN h ON h.doc_id = o.doc_id AND h.tid = o.tid AND h.start BETWEEN o.start AND o.start + {license_scan.SLACK}
        GROUP BY o.doc_id, o.tid, o.label, o.t_grams, o.start),
l AS (SELECT doc_id, label, 1.0 AS share FROM p UNION ALL SELECT doc_id, label, share FROM s WHERE share >= {license_scan.MIN_SHARE}),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM l GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM b, unnest(range(1, len(w) - k + 2)) r(i)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) r(i)),
h AS (SELECT DISTINCT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) r(p) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

# Bytes as two hex digits each; a string of 100 bytes is 200 digits.
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS g FROM d, unnest(range(0, len(x) // 2 - 99)) r(i)),
m AS (SELECT doc_id, i, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY g) AS first FROM s),
r AS (SELECT doc_id, i FROM m WHERE first.d <> doc_id OR first.i <> i),
c AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM r),
k AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
e AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS tail, list(struct_pack(f := before, l := a) ORDER BY a) AS kept FROM q GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE array_to_string(list_transform(kept, lambda t: substr(x, 2 * t.f + 1, 2 * (t.l - t.f))), '') || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id)
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


#: CRC-32 of a list of bytes in hex digits, by the table that its polynomial gives.
_CRC = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(i)))"""


def _crc(x: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


OP11_SQL = f"""
WITH {_CRC},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + k], ' ') AS f FROM d, unnest(range(1, len(w) + 1)) r(i), unnest(range(3)) q(k) WHERE i + k <= len(w)),
h AS (SELECT array_to_string(w[i:i + k], ' ') AS f FROM (SELECT {_WORDS} AS w FROM benchmark), unnest(range(1, len(w) + 1)) r(i), unnest(range(3)) q(k) WHERE i + k <= len(w)),
e AS (SELECT f, {_crc("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM g UNION ALL SELECT f FROM h)), crc_table),
s AS (SELECT b, count(*) AS n FROM g JOIN e USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM h JOIN e USING (f) GROUP BY b),
v AS (SELECT r.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM h) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM g JOIN e USING (f) JOIN v USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM y)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM z
"""


def _op13_sql(heights: int = 7) -> str:
    """Levels are written out: a level's nodes by group, with what stands before and after each in its run; ``heights`` of them are enough for 8 ** heights leaves."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = lambda x: " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", x))

    def levels(name: str) -> tuple[str, str]:
        out, joins = [], []
        for i in range(heights):
            out.append(f"""{name}r{i} AS (SELECT k, i // 8 AS run, list(d ORDER BY i) AS l, any_value(n) AS n FROM {name}{i} GROUP BY k, i // 8),
{name}{i + 1} AS (SELECT k, run AS i, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS d, (n + 7) // 8 AS n FROM {name}r{i})""")
            joins.append(f"JOIN {name}r{i} AS {name}j{i} ON {name}j{i}.k = {{k}} AND {name}j{i}.run = {{i}} // {8 ** (i + 1)}")
        return ",\n".join(out), " ".join(joins)

    own, own_joins = levels("a")
    all_, all_joins = levels("b")
    steps = [(f"aj{i}", f"p.i // {8**i}") for i in range(heights)] + [(f"bj{i}", f"s.i // {8**i}") for i in range(heights)]
    before = [f"CASE WHEN {j}.n > 1 THEN array_to_string({j}.l[1:({at}) % 8], '') ELSE '' END" for j, at in steps]
    after = [f"CASE WHEN {j}.n > 1 THEN array_to_string({j}.l[({at}) % 8 + 2:], '') ELSE '' END" for j, at in steps]
    many = [f"{j}.n > 1" for j, _ in steps]
    path = "[" + ", ".join(f"struct_pack(b := {b}, a := {a}, m := {m}, d := '')" for b, a, m in zip(before, after, many)) + "]"
    return f"""
WITH {_CRC},
f AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS k, sha256({fields("text")}) AS leaf, sha256({fields(text)}) AS changed, coalesce({_crc("doc_id::VARCHAR")} % 3 = 0, false) AS touched FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM f),
a0 AS (SELECT k, i, leaf AS d, n FROM p), {own},
s AS (SELECT k, d, row_number() OVER (ORDER BY encode(k)) - 1 AS i, count(*) OVER () AS n FROM a{heights}),
b0 AS (SELECT 0 AS k, i, d, n FROM s), {all_},
w AS (SELECT p.*, s.d AS subroot, b{heights}.d AS root, {path} AS path FROM p JOIN s USING (k) JOIN b{heights} ON true {own_joins.format(k="p.k", i="p.i")} {all_joins.format(k="0", i="s.i")}),
y AS (SELECT *, list_reduce(list_prepend(struct_pack(b := '', a := '', m := false, d := CASE WHEN touched THEN changed ELSE leaf END), path),
  lambda x, e: struct_pack(b := '', a := '', m := false, d := CASE WHEN e.m THEN sha256(e.b || x.d || e.a) ELSE x.d END)).d AS folded FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda e: e.b || e.a), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM y
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("clean_text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode(table(spark, sf_dir, "documents"), model)
    # Digests of what is not decoded come first, so that the second worker gets ids only.
    rows = rows.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
        F.xxhash64("starts", "ends").alias("spans_xxhash64"),
    )
    rows = pieces.decode(rows, model)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes", "spans_xxhash64")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_simhash": op2_simhash,
        "op3_quality_rules": op3_quality_rules,
        "op4_sharding": op4_sharding,
        "op5_language_id": op5_language_id,
        "op6_warc": op6_warc,
        "op7_toxicity": op7_toxicity,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_decontamination": op9_decontamination,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op6_warc": OP6_SQL, "op9_decontamination": OP9_SQL, "op10_suffix_dedup": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_merkle_manifest": _op13_sql()}

"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakwise.llm.annulus_kmeans import annulus_kmeans
from leakwise.llm.chat import ChatTemplate, format_chats, read_back, unescaped
from leakwise.llm.common import documents, remainder
from leakwise.llm.context_tree import lm_scores
from leakwise.llm.exact_dedup import exact_dedup
from leakwise.llm.hard_negatives import hard_negatives
from leakwise.llm.jaccard_join import jaccard_components
from leakwise.llm.language_id import predict_languages
from leakwise.llm.license_scan import TEMPLATES, WIDTH, license_scan, word_form
from leakwise.llm.mixing import Targets, mix, word_count
from leakwise.llm.packing import pack
from leakwise.llm.quality import quality_scores
from leakwise.llm.quality_rules import RULES, apply_rules
from leakwise.llm.simhash_dedup import simhash_dedup


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    said = format_chats(rows).withColumn("turns", read_back("formatted"))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return said.withColumn("learned", F.array_join(learned, "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _op1_sql() -> str:
    t = ChatTemplate()
    escape = f"regexp_replace(replace({{}}, '\\', '\\\\'), '{t.control_pattern}', '\\1\\\\\\2', 'g')"
    marks = len(t.start + t.text_mark + t.end + t.after_end)
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
         string_agg(role || ',', '' ORDER BY turn NULLS FIRST, role, text) AS roles,
         sum({marks} + length({escape.format('role')}) + length({escape.format('text')})) AS formatted_chars
  FROM r GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars,
       regexp_full_match(roles, '(system,)?(user,assistant,)*(user,)?') AND roles <> '' AS valid
FROM g
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_languages(documents(spark, sf_dir), remainder("doc_id", 4) != 2)
    return found.withColumn("held_out", remainder("doc_id", 4) == 2)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def exact_dedup_few_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op3 where only the most frequent digests are broadcast, also on the smallest tables."""
    return exact_dedup(documents(spark, sf_dir), counters=8)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _op4_sql(threshold: float = 0.8) -> str:
    """Every window of every template by exact containment; overlapping ones merged."""
    rows = []
    for name, text in TEMPLATES.items():
        words = [word_form(w).decode() for w in text.encode().split()]
        runs = [" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]
        rows += [f"('{name}', {len(runs)}, {len(set(runs))}, '{r.replace(chr(39), chr(39) * 2)}')" for r in sorted(set(runs))]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH t(template, m, want, s) AS (VALUES {", ".join(rows)}),
w AS (SELECT row_number() OVER () AS rid, doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''),
        lambda x: regexp_replace(translate(x, '{upper}', '{upper.lower()}'), '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) AS words FROM documents),
sh AS (SELECT rid, doc_id, n, p, array_to_string(words[p:p + {WIDTH - 1}], ' ') AS s FROM (SELECT rid, doc_id, words, len(words) AS n, unnest(range(1, len(words) - {WIDTH - 2})) AS p FROM w)),
hit AS (SELECT rid, doc_id, n, template, m, want, p, s FROM sh JOIN t USING (s)),
win AS (SELECT rid, doc_id, n, template, m, want, pos, count(DISTINCT s) AS c FROM (SELECT *, unnest(range(greatest(1, p - m + 1), p + 1)) AS pos FROM hit) GROUP BY ALL
        HAVING CAST(count(DISTINCT s) AS DOUBLE) / want >= CAST({threshold} AS DOUBLE)),
sized AS (SELECT *, least(m + {WIDTH - 1}, n - pos + 1) AS size FROM win),
marked AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR pos >= lag(pos) OVER o + lag(size) OVER o THEN 1 ELSE 0 END AS fresh FROM sized WINDOW o AS (PARTITION BY rid, template ORDER BY pos)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY pos) AS run FROM marked)
SELECT doc_id, template, pos - 1 AS first_word, size AS n_words, CAST(c AS DOUBLE) / want AS containment, count(*) OVER g AS windows
FROM runs WINDOW g AS (PARTITION BY rid, template, run) QUALIFY row_number() OVER (PARTITION BY rid, template, run ORDER BY c DESC, pos) = 1
"""


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(documents(spark, sf_dir), labels(spark, sf_dir), remainder("doc_id", 5) != 0)
    return scored.withColumn("held_out", remainder("doc_id", 5) == 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(documents(spark, sf_dir), remainder("doc_id", 7) != 2)
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")


#: The production tree: four domains of sources (by the number in their name), four languages, equal sources.
TARGETS = Targets(
    weights=({"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, {}), other=(0.05, 0.05, 1.0)
)


def tree_columns() -> dict[str, Column]:
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), (number % 4).cast("string")), "language": F.col("lang"), "source": F.col("source")}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), tree_columns(), word_count("text"), TARGETS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return judged.withColumn("rejected_by", F.array_join("rejected_by", ","))


#: Looser bounds, which a few hundred labels can certify.
FEW_LABELS = {"max_rate": 0.4, "error": 0.2}


def quality_rules_few_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op9 where cut-offs are certified on the smallest tables too."""
    judged = apply_rules(documents(spark, sf_dir), labels(spark, sf_dir), **FEW_LABELS)
    return judged.withColumn("rejected_by", F.array_join("rejected_by", ","))


def _op9_sql(max_rate: float = 0.05, error: float = 0.05) -> str:
    """The counts, the exact binomial tests and the verdicts."""
    tests = " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, CAST({c} AS DOUBLE) AS cutoff, rid, stratum, {r.denominator} > 0 AND {r.numerator} > CAST({c} AS DOUBLE) * {r.denominator} AS fires FROM c"
        for r in RULES
        for c in r.cutoffs
    )
    number = sum(len(r.cutoffs) for r in RULES)
    order = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {i}" for i, r in enumerate(RULES)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
r AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS run FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS n FROM r),
covered AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM again, range(8) AS t(o) WHERE n > 1 GROUP BY rid),
c AS (SELECT w.rid, doc_id, stratum, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             length(text) - length(replace(text, '!', '')) AS n_exclaims
      FROM w LEFT JOIN covered USING (rid)),
fired AS ({tests}),
good AS (SELECT rid, doc_id FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
once AS (SELECT rule, cutoff, stratum, doc_id, bool_or(fires) AS fires FROM fired JOIN good USING (rid) GROUP BY ALL),
k AS (SELECT rule, cutoff, stratum, count(*) AS n, count(*) FILTER (fires) AS k FROM once GROUP BY ALL),
strata AS (SELECT count(DISTINCT stratum) AS s FROM k),
tail AS (SELECT rule, cutoff, stratum, n, k, sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END
                + i * ln({max_rate} / {len(RULES)}) + (n - i) * ln(1 - {max_rate} / {len(RULES)}))) AS p
         FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM k) GROUP BY ALL),
chosen AS (SELECT rule, stratum, min(cutoff) AS cutoff FROM tail, strata WHERE k <= n * {max_rate} / {len(RULES)} AND p <= {error} / ({number} * s) GROUP BY ALL),
verdict AS (SELECT rid, string_agg(rule, ',' ORDER BY {order}) AS rejected_by FROM fired JOIN chosen USING (rule, stratum, cutoff) WHERE fires GROUP BY rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaims, base_failed,
       NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN verdict USING (rid)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_annulus_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annulus_kmeans(embeddings(spark, sf_dir))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Every vector compared with every centroid, round by round."""
    pick = "arg_min(n, ({d}, n)) AS n, min({d}) AS d".format(d="list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT")
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, {pick} FROM p, c{i} GROUP BY rid)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT n, i, sum(v[i])::BIGINT AS s, count(*) AS m FROM a{i}, range(1, 65) AS t(i) GROUP BY ALL),
m{i} AS (SELECT n, list((s - (s % m + m) % m) // m ORDER BY i) AS c FROM s{i} GROUP BY n),
c{i + 1} AS MATERIALIZED (SELECT n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (n))""")
    return f"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM p ORDER BY h, v LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, n::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (n)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings(spark, sf_dir).withColumn("label", label), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS MATERIALIZED (
  SELECT a.rid AS key, a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0
), p AS (
  SELECT key, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS place
  FROM s WHERE label = anchor_label AND vec_id <> anchor_id QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.key = p.key AND s.label <> s.anchor_label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.key, place ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP13_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT rid, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM d
), n AS MATERIALIZED (SELECT rid, doc_id, coalesce(c, 0) AS n FROM d LEFT JOIN (SELECT rid, count(*) AS c FROM s GROUP BY rid) USING (rid)),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), links AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rid, rid AS other FROM d UNION SELECT reach.rid, b FROM reach JOIN links ON a = reach.other)
SELECT n.doc_id, n.n AS n_shingles, min(o.doc_id) AS component_id FROM reach JOIN n USING (rid) JOIN n o ON o.rid = reach.other GROUP BY n.rid, n.doc_id, n.n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_formatting, op2_language_id, op3_exact_dedup, op4_license_scan, op5_simhash_dedup, op6_quality_classifier, op7_lm_scoring, op8_mixing, op9_quality_rules, op10_packing, op11_annulus_kmeans, op12_hard_negatives, op13_jaccard_join, quality_rules_few_labels, exact_dedup_few_counters]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _op1_sql(), "op3_exact_dedup": OP3_SQL, "exact_dedup_few_counters": OP3_SQL, "op4_license_scan": _op4_sql(), "op9_quality_rules": _op9_sql(), "op11_annulus_kmeans": _op11_sql(), "op12_hard_negatives": OP12_SQL, "op13_jaccard_join": OP13_SQL, "quality_rules_few_labels": _op9_sql(**FEW_LABELS)}

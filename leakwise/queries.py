"""Registered queries over the driver's tables, each through its operator, and their SQL.

Findings come from six plain patterns over whole documents, so that SQL can state them; the full finders have queries of
their own without SQL. Documents become files by ``documents_as_files``; projects are sources, scans are languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakwise import corpus
from leakwise.functions import paths
from leakwise.functions import text as tx
from leakwise.operators import exclusions as ex
from leakwise.operators import gate as g
from leakwise.operators import history, overlap, policy, scoring
from leakwise.operators.finders import Exclusions, FinderOptions, find_secrets
from leakwise.operators.membership import Membership, memberships
from leakwise.operators.matches import PatternRule, pattern_findings
from leakwise.plans.scan import scan_files, scan_strings, tagged
from leakwise.rules.extensions import ExtensionTables
from leakwise.schema import EXCEPTION, confidence_name, confidence_number
from leakwise.sinks import reports
from leakwise.sources.files import documents_as_files, spread
from leakwise.sources.tables import string_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- shared parts ---------------------------------------------------------------------------------------------------------

RULES = (
    PatternRule("token-assignment", 'token = "[0-9a-f]{40}"', 4, 'token = "'),
    PatternRule("hex-token", "[0-9a-f]{40}", 3),
    PatternRule("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 2),
    PatternRule("address", "[a-z0-9.]+@[a-z0-9.]+", 2, "@"),
    PatternRule("digits", "[0-9]{4,16}", 1),
    PatternRule("licence", "Licen[sc]e", 0, "Licen"),
)
NAMES = "['Info','Low','Medium','High','Critical']"

FILES_SQL = """
files AS (
  SELECT doc_id, lang, source, text, strlen(text) AS size,
         '/' || source || '/' || CASE WHEN doc_id % 10 = 0 THEN 'tests' ELSE 'src' END || '/doc' || doc_id ||
         ['.java','.cpp','.xml','.yaml','.rb','.erb','.conf',''][doc_id % 8 + 1] AS path
  FROM documents)"""


def _rule_sql(r: PatternRule) -> str:
    return (
        f"SELECT doc_id, lang, source, path, text, '{r.id}' AS rule, {r.confidence} AS confidence, "
        f"regexp_split_to_array(text, '{r.pattern}') AS parts, regexp_extract_all(text, '{r.pattern}') AS hits FROM files WHERE regexp_matches(text, '{r.pattern}')"
    )


FINDINGS_SQL = f"""
WITH {FILES_SQL},
hit AS ({" UNION ALL ".join(map(_rule_sql, RULES))}),
nth AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM hit),
off AS (SELECT *, hits[k] AS value,
  CAST(coalesce(list_sum(list_transform(parts[1:k], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: strlen(x))), 0) AS BIGINT) AS raw_start,
  CAST(coalesce(list_sum(list_transform(parts[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS before
  FROM nth),
f AS (SELECT doc_id, lang, source, path AS location, rule, rule AS headline, confidence, value, raw_start, raw_start + strlen(value) AS raw_end,
  length(substr(text, 1, before)) - length(replace(substr(text, 1, before), chr(10), '')) AS start_line,
  strlen(string_split(substr(text, 1, before), chr(10))[-1]) AS start_char,
  sha256(value) AS sha256,
  CASE WHEN contains(lower(path), 'test') THEN ['test'] ELSE [] END AS tags
  FROM off)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return spread(documents_as_files(docs, ("lang", "source")))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pattern_findings(files(spark, sf_dir), RULES, ("doc_id", "lang", "source", "path"))
    return rows.withColumnRenamed("path", "location").withColumns(
        {
            "headline": F.col("rule"),
            "sha256": tx.value_hash(F.col("value")),
            "tags": F.when(paths.is_test_path(F.col("location")), F.array(F.lit("test"))).otherwise(F.array().cast("array<string>")),
        }
    )


EXCEPTIONS = [
    ("x1", 1, "*", "active", None, "globalString", None, None, None, None, "1234", None),
    ("x2", 2, "hex-token", "active", None, "pathRegex", "/src(1|2)/", None, None, None, None, None),
    ("x3", 3, None, "active", None, "file", "/src/doc7.yaml", None, None, None, None, None),
    ("x4", 4, "ipv4", "active", None, "directory", "/src3/", None, None, None, None, None),
    ("x5", 5, "*", "revoked", None, "global", None, None, None, None, None, None),
    ("x6", 6, "digits", "active", None, "pathRegexRegex", "[.]conf$", None, None, None, None, "^9"),
    ("x7", 7, "*", "active", None, "globalRegex", None, None, None, None, None, "^77"),
    ("x8", 8, "*", "active", None, "globalHash", None, None, None, "@hash", None, None),
    ("x9", 9, "*", "active", None, "pathRegex", "(", None, None, None, None, None),
]
#: Values that are excluded by name, by pattern and by path in the queries below.
EXCLUDED = Exclusions(values=("License", "Licence"), value_patterns=("^1[0-9]+$", "("), paths=("/src1[0-9]/tests/",), path_pattern_values={"[.]rb$": ("^2",)})


def exceptions(spark: SparkSession) -> DataFrame:
    """The fixed list; its hash is that of a value that SQL can name too."""
    import hashlib

    known = hashlib.sha256(b"License").hexdigest()
    rows = [tuple(known if c == "@hash" else c for c in r) for r in EXCEPTIONS]
    return spark.createDataFrame(rows, EXCEPTION)


NOW = "timestamp '2024-06-01 00:00:00'"
KEY = "concat_ws(':', doc_id, rule, raw_start)"


# -- generators and scalar functions ----------------------------------------------------------------------------------------


@query(FINDINGS_SQL + "SELECT doc_id, source, location, start_line, start_char, raw_start, raw_end, sha256 FROM f WHERE rule = 'token-assignment'")
def secret_token_findings(spark, sf_dir):
    return findings(spark, sf_dir).where("rule = 'token-assignment'").select("doc_id", "source", "location", "start_line", "start_char", "raw_start", "raw_end", "sha256")


@query(FINDINGS_SQL + "SELECT rule, confidence, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM f GROUP BY ALL")
def rule_hit_counts(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("rule", "confidence").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query(FINDINGS_SQL + "SELECT doc_id, rule, raw_start, sha256(headline || '::' || location || ':' || (start_line + 1) || ':' || (start_char + 1) || ':' || sha256) AS finding_id FROM f")
def finding_ids(spark, sf_dir):
    ident = tx.finding_id(F.col("headline"), F.col("location"), F.col("start_line"), F.col("start_char"), F.col("sha256"))
    return findings(spark, sf_dir).select("doc_id", "rule", "raw_start", ident.alias("finding_id"))


@query(FINDINGS_SQL + "SELECT doc_id, rule, raw_start, raw_end, start_line, start_char FROM f")
def finding_positions(spark, sf_dir):
    return findings(spark, sf_dir).select("doc_id", "rule", "raw_start", "raw_end", "start_line", "start_char")


@query(
    FINDINGS_SQL
    + """, n AS (SELECT *, length(value) AS n, CAST(greatest(4, floor(length(value) * 0.6)) AS INT) AS h FROM f)
SELECT doc_id, rule, raw_start, CASE WHEN n < 8 THEN '***REDACTED***'
  ELSE substr(value, 1, CAST(floor((n - h) / 2) AS INT)) || repeat('*', h) || substr(value, CAST(floor((n - h) / 2) AS INT) + h + 1) END AS shown FROM n"""
)
def redacted_sources(spark, sf_dir):
    return findings(spark, sf_dir).select("doc_id", "rule", "raw_start", tx.redacted(F.col("value")).alias("shown"))


@query(FINDINGS_SQL + "SELECT DISTINCT rule, CASE WHEN contains(upper(rule), 'RSA') THEN 'crypto.rsa_private_key' ELSE 'generic.high_entropy' END AS secret_type FROM f")
def secret_types(spark, sf_dir):
    return findings(spark, sf_dir).select("rule", tx.secret_type(F.col("rule")).alias("secret_type")).distinct()


@query(
    """WITH v AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '  "' || text || '" ' WHEN 1 THEN chr(39) || text || chr(39) WHEN 2 THEN '"""" || text || """"' ELSE text END AS raw FROM benchmark)
SELECT item_id, CASE item_id % 4 WHEN 3 THEN trim(raw) ELSE (SELECT text FROM benchmark b WHERE b.item_id = v.item_id) END AS value FROM v""".replace('\'"""" || text || """"\'', "'\"\"\"' || text || '\"\"\"'")
)
def quote_trimming(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kind, text = F.col("item_id") % 4, F.col("text")
    raw = F.when(kind == 0, F.concat(F.lit('  "'), text, F.lit('" '))).when(kind == 1, F.concat(F.lit("'"), text, F.lit("'"))).when(kind == 2, F.concat(F.lit('"""'), text, F.lit('"""'))).otherwise(text)
    return rows.select("item_id", tx.trim_quotes(raw).alias("value"))


@query(
    "SELECT event_id, CASE lower(event_type) WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 3 END AS level, "
    f"{NAMES}[event_id % 5 + 1] AS name FROM events"
)
def confidence_values(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", confidence_number("event_type").alias("level"), confidence_name((F.col("event_id") % 5).cast("int")).alias("name"))


@query(
    """SELECT s_suppkey, 'https://host.example/' || regexp_replace(s_name, '[^A-Za-z0-9]', '-', 'g') || '/app.git' AS https,
  '/work/app' AS checkout FROM supplier"""
)
def repository_addresses(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    address = F.concat(F.lit(" git@host.example:"), F.regexp_replace("s_name", "[^A-Za-z0-9]", "-"), F.lit("/app.git"))
    https = paths.git_to_https(address)
    return rows.select("s_suppkey", https.alias("https"), paths.checkout_location(F.lit("/work/"), https).alias("checkout"))


# -- the gate ---------------------------------------------------------------------------------------------------------------

GATE = dict(exclusions=Exclusions(paths=("/src1[0-9]/.*[.]erb$",)), exclude_tests=True)
TABLES = ExtensionTables(text=frozenset({".java", ".cpp", ".xml", ".yaml", ".erb", ".conf"}), dangerous={".rb": "Encoded file"})
GATE_SQL = f"""
WITH {FILES_SQL},
v AS (SELECT *, regexp_extract(path, '(\\.[^./\\\\]*)$', 1) AS extension, contains(lower(path), 'test') AS is_test,
        regexp_matches(path, '/src1[0-9]/.*[.]erb$') AS path_excluded FROM files),
s AS (SELECT *, CASE WHEN is_test THEN 'test' WHEN path_excluded THEN 'excluded'
        WHEN extension <> '' AND extension NOT IN ('.java','.cpp','.xml','.yaml','.erb','.conf') THEN 'extension'
        WHEN size > 20000 AND extension NOT IN ('.java','.cpp','.xml','.yaml','.conf','.rb','.erb') THEN 'size' ELSE 'scan' END AS gate_status,
        CASE WHEN extension = '.rb' THEN 'Encoded file' END AS why_confidential FROM v)
"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes are scaled so that the largest documents pass the limit
    scaled = files(spark, sf_dir).withColumn("gate_size", F.when(F.col("size") > 20_000, F.col("size") + 10_240_000).otherwise(F.col("size")))
    return g.gate(scaled, tables=TABLES, content=None, size="gate_size", **GATE)


@query(GATE_SQL + "SELECT doc_id, path, extension, is_test, path_excluded, why_confidential, gate_status FROM s")
def path_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", "path", "extension", "is_test", "path_excluded", "why_confidential", "gate_status")


@query(
    GATE_SQL
    + """SELECT path AS location, unnest(CASE WHEN why_confidential IS NOT NULL AND gate_status IN ('test', 'excluded') THEN ['PathBasedSecretsFinder', 'ConfidentialFiles'] ELSE ['PathBasedSecretsFinder'] END) AS provider_id,
  CASE gate_status WHEN 'test' THEN 'Skipped: Suspected test file ' || path WHEN 'excluded' THEN 'Skipped: An exclusion matches path ' || path WHEN 'size' THEN 'Skipped: File ' || path || ' exceeds 10240000 bytes in size'
    ELSE 'Skipped: File extension ' || extension || ' is ignored' END AS headline, 3 AS confidence, gate_status <> 'extension' AS excluded, CASE WHEN is_test THEN 'test' ELSE '' END AS tags FROM s WHERE gate_status <> 'scan'"""
)
def ignored_rows(spark, sf_dir):
    return g.ignored_rows(gated(spark, sf_dir)).select("location", "provider_id", "headline", "confidence", "excluded", F.array_join("tags", " ").alias("tags"))


@query(GATE_SQL + "SELECT path, why_confidential AS headline, 2 AS confidence, sha256(text) AS sha256 FROM s WHERE why_confidential IS NOT NULL AND gate_status NOT IN ('test', 'excluded')")
def confidential_files(spark, sf_dir):
    rows = gated(spark, sf_dir).withColumn("content", F.encode("text", "utf-8"))
    return g.confidential_findings(rows).select(F.col("location").alias("path"), "headline", "confidence", "sha256")


@query(
    """WITH k AS (SELECT doc_id, [['CERTIFICATE'], ['RSA PRIVATE KEY'], ['PUBLIC KEY', 'CERTIFICATE'], ['CERTIFICATE', 'EC PRIVATE KEY', 'PUBLIC KEY'], []][doc_id % 5 + 1] AS kinds FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN 'Certificate' ELSE 'Warning! You may be sharing confidential (' || ['CERTIFICATE','RSA PRIVATE KEY','CERTIFICATE','EC PRIVATE KEY'][doc_id % 5 + 1] || ') data with your code' END AS headline,
  [3, 4, 0, 4, 3][doc_id % 5 + 1] AS confidence FROM k"""
)
def certificate_evidence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = lambda *kinds: F.lit("\n".join(f"-----BEGIN {k}-----\nx" for k in kinds))
    pem = F.element_at(F.array(begin("CERTIFICATE"), begin("RSA PRIVATE KEY"), begin("PUBLIC KEY", "CERTIFICATE"), begin("CERTIFICATE", "EC PRIVATE KEY", "PUBLIC KEY"), F.lit("none")), (F.col("doc_id") % 5 + 1).cast("int"))
    what, level = g.certificate_evidence(pem, F.lit("Certificate"))
    return docs.select("doc_id", what.alias("headline"), level.alias("confidence"))


@query(FINDINGS_SQL + "SELECT doc_id, rule, raw_start, len(tags) > 0 AS test, len(tags) = 0 AS prod FROM f")
def test_tagging(spark, sf_dir):
    return findings(spark, sf_dir).select("doc_id", "rule", "raw_start", tx.has_tag(F.col("tags"), "test").alias("test"), tx.has_tag(F.col("tags"), "prod").alias("prod"))


# -- exclusions and exceptions ------------------------------------------------------------------------------------------------


@query(FINDINGS_SQL + "SELECT doc_id, rule, raw_start FROM f WHERE NOT (value IN ('License', 'Licence') OR regexp_matches(value, '^1[0-9]+$'))")
def excluded_values(spark, sf_dir):
    return findings(spark, sf_dir).where(~ex.value_excluded(F.col("value"), EXCLUDED)).select("doc_id", "rule", "raw_start")


@query(
    FINDINGS_SQL
    + """SELECT doc_id, rule, raw_start FROM f WHERE NOT (value IN ('License', 'Licence') OR regexp_matches(value, '^1[0-9]+$') OR regexp_matches(location, '/src1[0-9]/tests/')
  OR (regexp_matches(location, '[.]rb$') AND regexp_matches(value, '^2')))"""
)
def path_value_exclusions(spark, sf_dir):
    return ex.apply_exclusions(findings(spark, sf_dir), EXCLUDED).select("doc_id", "rule", "raw_start")


@query(FINDINGS_SQL + "SELECT doc_id, rule, raw_start FROM f WHERE sha256 NOT IN (SELECT sha256 FROM f WHERE len(tags) > 0)")
def excluded_hashes(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return ex.exclude_by_table(rows, rows.where(tx.has_tag(F.col("tags"), "test")), ["sha256"]).select("doc_id", "rule", "raw_start")


@query(
    FINDINGS_SQL
    + """SELECT doc_id, rule, raw_start, exception_id IS NOT NULL AS suppressed, exception_id FROM (SELECT *, CASE
  WHEN contains(value, '1234') THEN 'x1' WHEN rule = 'hex-token' AND regexp_matches(location, '/src(1|2)/') THEN 'x2' WHEN ends_with(location, '/src/doc7.yaml') THEN 'x3'
  WHEN rule = 'ipv4' AND starts_with(location, '/src3/') THEN 'x4' WHEN rule = 'digits' AND regexp_matches(location, '[.]conf$') AND regexp_matches(value, '^9') THEN 'x6'
  WHEN regexp_matches(value, '^77') THEN 'x7' WHEN sha256 = sha256('License') THEN 'x8' END AS exception_id FROM f)"""
)
def exception_matches(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumns({"finding_id": F.expr(KEY), "source": F.col("value")})
    return ex.match_exceptions(rows, exceptions(spark), F.expr(NOW)).select("doc_id", "rule", "raw_start", "suppressed", "exception_id")


def many_exceptions(spark: SparkSession) -> DataFrame:
    """The fixed list among more than are compiled into one expression: 200 that cover nothing, of all kinds, in front."""
    idle = [(f"n{i}", -i, "*", "active", None, k, "/nowhere/x", 1, 1, "0" * 64, "no such text", "no such (text|word)") for i in range(1, 41) for k in ("globalString", "pathRegex", "globalHash", "file", "globalRegex")]
    return exceptions(spark).unionByName(spark.createDataFrame(idle, EXCEPTION))


@query(SQL["exception_matches"])
def exception_matches_of_many(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumns({"finding_id": F.expr(KEY), "source": F.col("value")})
    return ex.match_exceptions(rows, many_exceptions(spark), F.expr(NOW)).select("doc_id", "rule", "raw_start", "suppressed", "exception_id")


RULE_NAMES = ('Aws_Access id', 'my AWS_SECRET', 'GitHub Token', 'an rsa key', 'PASSWORD in a URL', 'jwt', 'Rsa password', 'Slack')


@query(f"SELECT doc_id, {list(RULE_NAMES)!r}[doc_id % 8 + 1] AS rule, ['aws.access_key', 'aws.secret_key', 'github.personal_access_token', 'crypto.rsa_private_key', 'generic.password', 'generic.jwt', 'crypto.rsa_private_key', 'generic.high_entropy'][doc_id % 8 + 1] AS secret_type FROM documents".replace('"', "'"))
def secret_types_by_name(spark, sf_dir):
    """Each branch; a name of two types has the first one."""
    name = F.element_at(F.array(*map(F.lit, RULE_NAMES)), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", name.alias("rule"))
    return rows.withColumn("secret_type", tx.secret_type(F.col("rule")))


@query(SQL["exception_matches"])
def exception_matches_by_keys(spark, sf_dir):
    """The same list as a table whose hashes, paths and folders meet the findings by equal keys."""
    rows = findings(spark, sf_dir).withColumns({"finding_id": F.expr(KEY), "source": F.col("value"), "headline": F.col("rule")})
    return ex.match_exceptions(rows, many_exceptions(spark), F.expr(NOW), max_held=20).select("doc_id", "rule", "raw_start", "suppressed", "exception_id")


@query(
    "WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'revoked' ELSE 'active' END AS status, ts AS expires_at FROM events), m AS (SELECT max(ts) - INTERVAL 12 HOUR AS now FROM events) "
    "SELECT id, CASE WHEN status = 'active' AND expires_at < now THEN 'expired' ELSE status END AS status FROM e, m"
)
def exception_expiry(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = events.agg(F.max("ts") - F.expr("interval 12 hours")).scalar()
    rows = events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "revoked").otherwise("active").alias("status"), F.col("ts").alias("expires_at"))
    return ex.with_expiry(rows, now).select("id", "status")


@query(
    FINDINGS_SQL
    + """SELECT doc_id, rule, raw_start, confidence > 3 OR contains(value, '1234') OR (rule = 'hex-token' AND regexp_matches(location, '/src(1|2)/')) OR ends_with(location, '/src/doc7.yaml')
  OR (rule = 'ipv4' AND starts_with(location, '/src3/')) OR (rule = 'digits' AND regexp_matches(location, '[.]conf$') AND regexp_matches(value, '^9')) OR regexp_matches(value, '^77') OR sha256 = sha256('License') AS suppressed FROM f"""
)
def reconciled(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumns({"finding_id": F.expr(KEY), "source": F.col("value"), "suppressed": F.col("confidence") > 3, "exception_id": F.lit(None).cast("string")})
    return ex.reconcile(rows, exceptions(spark), F.expr(NOW)).select("doc_id", "rule", "raw_start", "suppressed")


# -- overlap ------------------------------------------------------------------------------------------------------------------


@query(
    FINDINGS_SQL
    + """SELECT doc_id, rule, raw_start, raw_end, confidence FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.location = a.location AND b.confidence >= a.confidence
  AND b.raw_start <= a.raw_start AND b.raw_end >= a.raw_end AND (b.raw_start < a.raw_start OR b.raw_end > a.raw_end))"""
)
def overlap_removed(spark, sf_dir):
    return overlap.remove_overlapping(findings(spark, sf_dir)).select("doc_id", "rule", "raw_start", "raw_end", "confidence")


@query()
def subsumed(spark, sf_dir):
    rows = overlap.remove_overlapping(findings(spark, sf_dir)).withColumns(
        {"repo_index": F.lit(0), "end_line": F.col("start_line"), "end_char": F.col("start_char") + F.octet_length("value"), "provider_id": F.col("rule"), "source": F.col("value")}
    )
    return overlap.subsume(rows).select("doc_id", "rule", "raw_start", "raw_end", "confidence")


# -- history --------------------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT o_custkey % 50 AS branch, o_orderkey AS hash, o_orderdate AS time FROM orders)
SELECT branch, hash, time FROM c QUALIFY row_number() OVER (PARTITION BY branch ORDER BY time DESC, hash) = 1"""
)
def latest_commit_per_branch(spark, sf_dir):
    commits = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).alias("branch"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("time"))
    return history.latest_by(commits, ["branch"], [F.col("time").desc(), F.col("hash")])


@query(
    """WITH c AS (SELECT 'r' || (o_custkey % 5) AS repository, o_custkey % 60 AS branch, o_orderkey AS hash, o_orderdate AS time, o_orderkey % 4 = 0 AS is_head FROM orders),
s AS (SELECT * FROM c WHERE branch % 2 = 0 AND hash % 3 = 0)
SELECT repository, branch, hash FROM c WHERE is_head AND (repository, branch) IN (SELECT (repository, branch) FROM s) AND (repository, branch, hash) NOT IN (SELECT (repository, branch, hash) FROM s)
QUALIFY row_number() OVER (PARTITION BY repository, branch ORDER BY time DESC, hash) = 1"""
)
def unscanned_heads(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    commits = o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("repository"), (F.col("o_custkey") % 60).alias("branch"), F.col("o_orderkey").alias("hash"),
        F.col("o_orderdate").alias("time"), (F.col("o_orderkey") % 4 == 0).alias("is_head"),
    )
    return history.commits_to_scan(commits, commits.where("branch % 2 = 0 and hash % 3 = 0")).select("repository", "branch", "hash")


@query(SQL["unscanned_heads"].replace("WHERE is_head AND (repository", "WHERE (repository").replace("ORDER BY time DESC, hash", "ORDER BY is_head DESC, time DESC, hash"))
def unscanned_commits(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    commits = o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")).alias("repository"), (F.col("o_custkey") % 60).alias("branch"), F.col("o_orderkey").alias("hash"),
        F.col("o_orderdate").alias("time"), (F.col("o_orderkey") % 4 == 0).alias("is_head"),
    )
    return history.commits_to_scan(commits, commits.where("branch % 2 = 0 and hash % 3 = 0"), older=True).select("repository", "branch", "hash")


@query(
    """WITH c AS (SELECT o_custkey % 60 AS branch, o_orderkey AS hash, o_orderdate AS time FROM orders),
l AS (SELECT branch, max(time) AS t FROM c WHERE branch % 2 = 0 AND hash % 3 = 0 GROUP BY branch)
SELECT 'r' AS repository, c.branch, hash FROM c LEFT JOIN l USING (branch) WHERE t IS NULL OR time > t"""
)
def commits_since_last_seen(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    commits = o.select(F.lit("r").alias("repository"), (F.col("o_custkey") % 60).alias("branch"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("time"))
    return history.commits_since(commits, commits.where("branch % 2 = 0 and hash % 3 = 0")).select("repository", "branch", "hash")


@query(
    """WITH o AS (SELECT l_suppkey AS project_id, l_partkey AS finding_id, l_orderkey * 10 + l_linenumber AS row_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'note ' || l_orderkey END AS ai_annotation, CASE WHEN l_linenumber % 4 = 0 THEN 'ACTIVE' ELSE 'NOT_CHECKED' END AS verification_status FROM lineitem),
t AS (SELECT * FROM o WHERE ai_annotation IS NOT NULL OR verification_status <> 'NOT_CHECKED' QUALIFY row_number() OVER (PARTITION BY project_id, finding_id ORDER BY row_id DESC) = 1),
n AS (SELECT DISTINCT project_id, finding_id FROM o)
SELECT n.project_id, n.finding_id, t.ai_annotation, coalesce(t.verification_status, 'NOT_CHECKED') AS verification_status FROM n LEFT JOIN t USING (project_id, finding_id)"""
)
def carry_forward(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    old = rows.select(
        F.col("l_suppkey").alias("project_id"), F.col("l_partkey").alias("finding_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("note "), F.col("l_orderkey").cast("string"))).alias("ai_annotation"),
        F.when(F.col("l_linenumber") % 4 == 0, "ACTIVE").otherwise("NOT_CHECKED").alias("verification_status"),
    )
    new = old.select("project_id", "finding_id").distinct().withColumns({"ai_annotation": F.lit(None).cast("string"), "verification_status": F.lit("NOT_CHECKED")})
    return history.carry_forward(new, old).select("project_id", "finding_id", "ai_annotation", "verification_status")


@query("SELECT DISTINCT l_partkey AS finding_id, l_suppkey AS scan_id FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_linenumber > 4)")
def inserted_or_ignored(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("finding_id"), F.col("l_suppkey").alias("scan_id"), "l_linenumber")
    return history.insert_new(rows.where("l_linenumber > 4"), rows).select("finding_id", "scan_id")


ORDER = "['Info','Low','Medium','High','Critical'][confidence + 1], location, start_line, raw_start, rule"


def _order() -> list:
    return [*history.store_order(), F.col("raw_start"), F.col("rule")]


@query(FINDINGS_SQL + f"SELECT doc_id, rule, raw_start FROM (SELECT * FROM f WHERE confidence IN (1, 4) AND len(tags) = 0) ORDER BY {ORDER} LIMIT 25 OFFSET 50")
def issue_page(spark, sf_dir):
    rows = history.issue_filter(findings(spark, sf_dir), [1, 4], ["prod"])
    return history.page(rows, _order(), 2, 25).select("doc_id", "rule", "raw_start")


@query(SQL["issue_page"])
def issue_page_by_cursor(spark, sf_dir):
    """The third page, reached through the cursors of the first two."""
    rows = history.issue_filter(findings(spark, sf_dir), [1, 4], ["prod"])
    after = None
    for _ in range(2):
        after = history.cursor(history.seek_page(rows, _order(), after, 25), _order())
    return history.seek_page(rows, _order(), after, 25).select("doc_id", "rule", "raw_start")


@query(FINDINGS_SQL + f"SELECT doc_id, rule, raw_start FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS n FROM f) WHERE n > 40 AND confidence IN (1, 2) ORDER BY n LIMIT 20")
def legacy_issue_page(spark, sf_dir):
    return history.legacy_page(findings(spark, sf_dir), _order(), 2, 20, [1, 2]).select("doc_id", "rule", "raw_start")


@query(FINDINGS_SQL + f"SELECT doc_id, rule, raw_start FROM f WHERE source IN ('src1', 'src2') AND {NAMES}[confidence + 1] IN ('Low', 'High') AND NOT contains(value, '1')")
def findings_search(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumns({"project_id": F.col("source"), "severity": confidence_name("confidence"), "secret_type": F.col("rule"), "suppressed": F.col("value").contains("1")})
    return history.search_findings(rows, ["src1", "src2"], ["Low", "High"], None, False).select("doc_id", "rule", "raw_start")


@query(FINDINGS_SQL + "SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE sha256 = sha256('License')) AS remediated FROM f GROUP BY ALL")
def remediated(spark, sf_dir):
    import hashlib

    rows = findings(spark, sf_dir).withColumns({"suppressed": F.lit(False), "exception_id": F.lit(None).cast("string")})
    done = history.remediate(rows, hashlib.sha256(b"License").hexdigest(), "e1")
    return done.groupBy("source", "rule").agg(F.count("*").alias("n"), F.count_if("suppressed").alias("remediated"))


@query(
    """SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) OR c_mktsegment = 'BUILDING'"""
)
def group_members(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    entries = rows.select("c_custkey", F.create_map(F.lit("nation"), F.array(F.col("c_nationkey").cast("string")), F.lit("segment"), F.array("c_mktsegment")).alias("attributes"))
    return history.members(entries, {"nation": ["1", "2", "3"], "segment": ["BUILDING"]}).select("c_custkey")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS user, CAST(n_nationkey AS VARCHAR) AS "group" FROM customer JOIN nation ON c_nationkey = n_nationkey
AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR (c_custkey % 3 = n_regionkey AND c_custkey % 7 = n_nationkey % 7)) AND c_mktsegment <> 'AUTOMOBILE'"""
)
def group_memberships(spark, sf_dir):
    """Customers as users of the groups of their nation: a tree of both kinds of rules."""
    text = lambda c: F.col(c).cast("string")
    customers, nations = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    user = {"nation": F.array(text("c_nationkey")), "kind": F.array("c_mktsegment"), "third": F.array((F.col("c_custkey") % 3).cast("string")), "seventh": F.array((F.col("c_custkey") % 7).cast("string"))}
    segments = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    group = {"kinds": segments, "all kinds": F.concat(segments, F.array(F.lit("FURNITURE"), F.lit("HOUSEHOLD"))), "region": F.array(text("n_regionkey")), "seventh": F.array((F.col("n_nationkey") % 7).cast("string"))}
    entries = lambda rows, key, of: rows.select(text(key).alias("dn"), F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v)]).alias("attributes"))
    both = Membership((("third", "region"), ("seventh", "seventh")))
    tree = Membership((("nation", "dn"), ("kind", "all kinds")), rules=(Membership((("kind", "kinds"),), all_of=False, rules=(both,)),))
    return memberships(entries(customers, "c_custkey", user), entries(nations, "n_nationkey", group), tree)


# -- scores -----------------------------------------------------------------------------------------------------------------------

COUNTS_SQL = """count(*) AS issues, count(*) FILTER (WHERE confidence = 4) AS critical_count, count(*) FILTER (WHERE confidence = 3) AS high_count, count(*) FILTER (WHERE confidence = 2) AS medium_count,
  count(*) FILTER (WHERE confidence = 1) AS low_count, count(*) FILTER (WHERE confidence NOT IN (1, 2, 3, 4)) AS info_count, count(*) FILTER (WHERE len(tags) = 0) AS production_count"""


@query(FINDINGS_SQL + f"SELECT source, {COUNTS_SQL} FROM f GROUP BY source")
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(findings(spark, sf_dir), ["source"]).select(
        "source", "issues", "critical_count", "high_count", "medium_count", "low_count", "info_count", "production_count"
    )


@query(FINDINGS_SQL + "SELECT source, sha256, count(*) AS size, count(*) FILTER (WHERE len(tags) = 0) AS prod, count(*) FILTER (WHERE len(tags) > 0) AS non_prod FROM f GROUP BY ALL")
def reuse_clusters(spark, sf_dir):
    return scoring.reuse_clusters(findings(spark, sf_dir), ["source"])


@query(FINDINGS_SQL + "SELECT sha256, count(*) FILTER (WHERE len(tags) = 0) AS production, count(*) FILTER (WHERE len(tags) > 0) AS non_production FROM f GROUP BY sha256 HAVING count(*) FILTER (WHERE len(tags) = 0) > 0 AND count(*) FILTER (WHERE len(tags) > 0) > 0")
def prod_and_test_reuse(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumns({"highlight_start_line": F.col("start_line"), "highlight_start_char": F.col("start_char")})
    found = scoring.prod_and_test_reuse(rows, [])
    return found.groupBy("sha256").agg(F.count_if("production").alias("production"), F.count_if(~F.col("production")).alias("non_production"))


SHARED_SQL = """shared AS (SELECT lang, sum(m) AS critical_shared, sum(h) AS high_shared, sum(m) AS medium_shared, sum(l) AS low_shared, sum(i) AS info_shared FROM (
  SELECT lang, bool_or(len(tags) > 0) OVER w AND bool_or(len(tags) = 0) OVER w AS mixed, count(*) FILTER (WHERE len(tags) = 0 AND confidence = 3) OVER w AS h, count(*) FILTER (WHERE len(tags) = 0 AND confidence = 2) OVER w AS m,
    count(*) FILTER (WHERE len(tags) = 0 AND confidence = 1) OVER w AS l, count(*) FILTER (WHERE len(tags) = 0 AND confidence = 0) OVER w AS i
  FROM f WINDOW w AS (PARTITION BY lang, sha256 ORDER BY location, raw_start, rule ROWS UNBOUNDED PRECEDING)) WHERE mixed GROUP BY lang)"""


def _model(spark: SparkSession, sf_dir: str, strict: bool = True) -> DataFrame:
    rows = findings(spark, sf_dir)
    totals = files(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("file_count"))
    return scoring.model(rows, totals, ["lang"], [F.col("location"), F.col("raw_start"), F.col("rule")], strict)


@query(FINDINGS_SQL + f", {SHARED_SQL} SELECT lang, CAST(critical_shared AS BIGINT) AS critical_shared, CAST(high_shared AS BIGINT) AS high_shared, CAST(medium_shared AS BIGINT) AS medium_shared, CAST(low_shared AS BIGINT) AS low_shared, CAST(info_shared AS BIGINT) AS info_shared FROM shared")
def shared_with_tests(spark, sf_dir):
    return scoring.shared_counts(findings(spark, sf_dir), ["lang"], [F.col("location"), F.col("raw_start"), F.col("rule")])


SCORE_SQL = FINDINGS_SQL + f""", {SHARED_SQL},
c AS (SELECT lang, {COUNTS_SQL} FROM f GROUP BY lang),
r AS (SELECT lang, sum(n) AS total, sum(n * log2(n)) AS nlog, count(*) AS clusters FROM (SELECT lang, sha256, count(*) AS n FROM f GROUP BY ALL) GROUP BY lang),
n AS (SELECT lang, count(*) AS file_count FROM files GROUP BY lang),
p AS (SELECT c.*, n.file_count, CASE WHEN coalesce(critical_shared, 0) > 0 THEN 0 WHEN coalesce(high_shared, 0) > 0 THEN 20 WHEN coalesce(medium_shared, 0) > 0 THEN 40 WHEN coalesce(low_shared, 0) > 0 THEN 70
        WHEN coalesce(info_shared, 0) > 0 THEN 90 ELSE 100 END AS pvt,
      CASE WHEN total = 1 THEN 'NaN'::DOUBLE ELSE 100 * (log2(total) - nlog / total) / log2(total) END AS srm,
      CASE WHEN critical_count > 0 THEN 40 WHEN high_count > 0 THEN 70 WHEN medium_count > 0 THEN 80 WHEN low_count > 0 THEN 90 WHEN info_count > 0 THEN 95 ELSE 100 END AS hcp,
      CASE WHEN critical_count > 0 THEN 40 WHEN high_count > 0 THEN 60 WHEN medium_count > 0 THEN 80 ELSE 101 END AS cap
      FROM c LEFT JOIN shared USING (lang) JOIN r USING (lang) JOIN n USING (lang)),
m AS (SELECT *, 0.3 * pvt + 0.4 * 100 + 0.1 * srm + 0.2 * hcp AS raw FROM p)
"""


@query(
    SCORE_SQL
    + """SELECT lang, issues, file_count, round(CAST(CASE WHEN isnan(raw) THEN raw ELSE least(raw, cap) END AS DOUBLE), 3) AS metric,
  CASE WHEN isnan(raw) THEN 'F' WHEN least(raw, cap) > 95 THEN 'A+' WHEN least(raw, cap) > 85 THEN 'A' WHEN least(raw, cap) > 70 THEN 'B' WHEN least(raw, cap) > 60 THEN 'C' WHEN least(raw, cap) > 50 THEN 'D' WHEN least(raw, cap) > 40 THEN 'E' ELSE 'F' END AS grade FROM m"""
)
def scan_score(spark, sf_dir):
    done = scoring.score(_model(spark, sf_dir))
    return done.select("lang", "issues", "file_count", F.round(F.col("metric").cast("double"), 3).alias("metric"), "grade")


@query(SCORE_SQL + "SELECT 'all' AS workspace, CAST(sum(issues) AS BIGINT) AS issues, CAST(sum(file_count) AS BIGINT) AS file_count, round(sum(issues) / sum(file_count), 4) AS average_per_file FROM m")
def workspace_merge(spark, sf_dir):
    merged = scoring.merge_models(_model(spark, sf_dir).withColumn("workspace", F.lit("all")), ["workspace"])
    return merged.select("workspace", "issues", "file_count", F.round(F.col("average_per_file").cast("double"), 4).alias("average_per_file"))


@query(FINDINGS_SQL + "SELECT source, round(least(10, (10.0 * count(*) FILTER (WHERE confidence = 4) + 5.0 * count(*) FILTER (WHERE confidence = 3) + 2.0 * count(*) FILTER (WHERE confidence = 2) + count(*) FILTER (WHERE confidence = 1)) / count(*)), 6) AS score FROM f GROUP BY source")
def store_scores(spark, sf_dir):
    c = scoring.severity_counts(findings(spark, sf_dir), ["source"])
    return c.select("source", F.round(scoring.store_score(F.col("critical_count"), F.col("high_count"), F.col("medium_count"), F.col("low_count"), F.col("issues")), 6).alias("score"))


@query("SELECT o_custkey AS project_id, o_orderkey || ';' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS scan, o_totalprice AS metric FROM orders")
def score_trend(spark, sf_dir):
    scans = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("completed_at"), F.col("o_totalprice").alias("metric"))
    return scoring.score_trend(scans).select("project_id", F.explode("trend").alias("scan", "metric"))


@query("SELECT event_type, CAST(coalesce(sum(TRY_CAST(props ->> '$.k' AS BIGINT)), 0) AS BIGINT) AS tokens FROM events GROUP BY event_type")
def triage_tokens(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ai_annotation", F.col("props"))
    return scoring.token_usage(rows, ["event_type"], key="k")


@query(FINDINGS_SQL + "SELECT sha256, doc_id, rule, raw_start FROM f QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY location, raw_start, rule) = 1")
def unique_secrets(spark, sf_dir):
    return scoring.unique_secrets(findings(spark, sf_dir), [F.col("location"), F.col("raw_start"), F.col("rule")]).select("sha256", "doc_id", "rule", "raw_start")


# -- sinks --------------------------------------------------------------------------------------------------------------------------


def _reportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).withColumns(
        {
            "repo_index": F.lit(0), "provider_id": F.col("rule"), "end_line": F.col("start_line"), "end_char": F.col("start_char") + F.octet_length("value"), "source": F.col("value"),
            "tags": F.concat("tags", F.array(F.concat(F.lit("lang="), "lang"))),
        }
    )


@query(
    FINDINGS_SQL
    + f"""SELECT value AS "Code", {NAMES}[confidence + 1] AS "Severity", headline AS "Description", location AS "File", 'Line: ' || (start_line + 1) || ' Column: ' || (start_char + 1) AS "File Location",
  sha256 AS "SHA256", array_to_string(list_concat(tags, ['lang=' || lang]), ' ') AS "Tags", rule AS "Detector ID", location AS "Repository", lang FROM f"""
)
def csv_report(spark, sf_dir):
    rows = _reportable(spark, sf_dir)
    return reports.csv_rows(rows, reports.extra_headers(rows), raw_source=True)


@query(
    FINDINGS_SQL
    + """SELECT headline AS rule_id, CASE WHEN confidence >= 3 THEN 'error' WHEN confidence <= 0 THEN 'note' ELSE 'warning' END AS level, headline AS message, location AS uri,
  start_line + 1 AS start_line, start_char + 1 AS start_column, start_line + 1 AS end_line, start_char + strlen(value) + 1 AS end_column, sha256 AS fingerprint FROM f"""
)
def sarif_results(spark, sf_dir):
    return reports.sarif_results(_reportable(spark, sf_dir))


@query(FINDINGS_SQL + "SELECT DISTINCT headline AS rule_id, CASE WHEN confidence >= 3 THEN 'error' WHEN confidence <= 0 THEN 'note' ELSE 'warning' END AS level FROM f")
def sarif_rules(spark, sf_dir):
    return reports.sarif_rules(_reportable(spark, sf_dir)).select("rule_id", "level")


@query(FINDINGS_SQL + "SELECT location, start_line, start_char, CASE confidence WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS severity, headline AS message FROM f")
def editor_diagnostics(spark, sf_dir):
    return reports.editor_diagnostics(_reportable(spark, sf_dir)).select("location", "start_line", "start_char", "severity", "message")


@query(FINDINGS_SQL + f"SELECT {NAMES}[confidence + 1] AS severity, count(*) AS n FROM f GROUP BY ALL")
def severity_chart(spark, sf_dir):
    return reports.severity_chart(findings(spark, sf_dir))


@query(
    FINDINGS_SQL
    + """, p AS (SELECT DISTINCT source AS project_id, source AS name, CASE WHEN source < 'src2' THEN 'w1' ELSE 'w2' END AS workspace FROM documents),
s AS (SELECT source AS project_id, max(lang) AS scan_id FROM documents GROUP BY source)
SELECT p.name, p.workspace, f.rule, f.raw_start, f.doc_id FROM f JOIN s ON f.source = s.project_id AND f.lang = s.scan_id JOIN p USING (project_id) WHERE workspace = 'w2'"""
)
def workspace_issues(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    projects = docs.select(F.col("source").alias("project_id"), F.col("source").alias("name"), F.when(F.col("source") < "src2", "w1").otherwise("w2").alias("workspace")).distinct()
    scans = docs.select(F.col("source").alias("project_id"), F.col("lang").alias("scan_id"), F.col("lang").alias("position")).distinct()
    rows = findings(spark, sf_dir).withColumns({"project_id": F.col("source"), "scan_id": F.col("lang")})
    return reports.workspace_issues(projects, scans, rows, "w2").select("name", "workspace", "rule", "raw_start", "doc_id")


@query(
    SCORE_SQL
    + """, w AS (SELECT DISTINCT lang FROM documents)
SELECT 'w' AS workspace, w.lang AS name, CASE WHEN raw IS NULL OR isnan(raw) THEN '-' ELSE CAST(CAST(floor(CAST(least(raw, cap) AS FLOAT)) AS BIGINT) AS VARCHAR) END AS metric, coalesce(CAST(critical_count AS VARCHAR), '-') AS critical FROM w LEFT JOIN m USING (lang)"""
)
def project_summary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    projects = docs.select(F.col("lang").alias("project_id"), F.col("lang").alias("name")).distinct().withColumn("workspace", F.lit("w"))
    scores = scoring.score(_model(spark, sf_dir)).withColumnRenamed("lang", "project_id")
    return reports.project_rows(projects, scores).select("workspace", "name", "metric", "critical")


@query("SELECT user_id AS exception_id, count(*) AS events, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY user_id")
def audit_trails(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("exception_id"), F.col("ts").alias("time"), F.lit("a").alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("details"))
    trail = policy.audit_trail(events)
    return trail.select("exception_id", F.size("audit").cast("long").alias("events"), F.col("audit")[0]["time"].alias("first_time"), F.element_at("audit", -1)["time"].alias("last_time"))


@query("SELECT date_trunc('hour', ts) AS since, event_type, count(*) AS n FROM events GROUP BY ALL")
def finding_rates(spark, sf_dir):
    from leakwise.streaming.scan import finding_rates as rates

    return rates(spark.read.parquet(f"{sf_dir}/events.parquet"))


# -- the full finders: a file of the fixed corpus for each document -------------------------------------------------------------


CORPUS_COLUMNS = (
    "repo_index", "location", "provider_id", "headline", "confidence", "start_line", "start_char", "raw_start", "raw_end", "highlight_start_char", "highlight_end_char",
)


def _corpus_rows(found):
    return found.select(*CORPUS_COLUMNS, F.coalesce("value", F.lit("")).alias("value"), "sha256", F.array_join("tags", " ").alias("tags"))


@query(corpus.findings_sql())
def finder_rows(spark, sf_dir):
    """Gate, all finders, evidence, highlights, overlaps, confidential files and tags."""
    return _corpus_rows(scan_files(corpus.document_files(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")))))


@query(corpus.findings_sql(confidential=False))
def finder_rows_by_operators(spark, sf_dir):
    """The same with containment and subsumption as operators over the findings."""
    files = g.gate(corpus.document_files(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")))).where("gate_status = 'scan'")
    file = ["repo_index", "location"]
    return _corpus_rows(tagged(overlap.subsume(overlap.remove_overlapping(find_secrets(files, FinderOptions(fused=False)), file), file)))


# -- the full finders over real texts (their dialect can't be put in SQL; tests hold their results) ---------------------------------


@query()
def scan_findings(spark, sf_dir):
    found = scan_files(files(spark, sf_dir))
    return found.select("location", "provider_id", "headline", "confidence", "raw_start", "raw_end", "start_line", "start_char", "sha256", "tags", "finding_id", "secret_type")


@query()
def page_scan(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit(0).alias("repo_index"), F.col("url").alias("path"), F.col("html").alias("text"), F.lit("xml").alias("kind"))
    return find_secrets(spread(pages), file_class="kind").select("location", "provider_id", "headline", "confidence", "raw_start", "raw_end", "sha256")


@query()
def string_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    even = F.col("doc_id") % 2 == 0
    requests = rows.select(F.when(even, F.base64(F.encode("text", "utf-8"))).otherwise(F.col("text")).alias("source"), F.lit(".conf").alias("source_type"), even.alias("base64"))
    return scan_strings(string_requests(spread(requests))).select("location", "provider_id", "headline", "confidence", "raw_start", "raw_end")


@query()
def flagship(spark, sf_dir):
    """All findings of documents and pages."""
    documents, pages = scan_findings(spark, sf_dir), page_scan(spark, sf_dir)
    return documents.select(*pages.columns).unionByName(pages)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

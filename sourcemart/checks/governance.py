"""Checks before publishing, and reconciliation."""

from pyspark.sql import functions as F

from sourcemart.checks.base import check
from sourcemart.functions.paging import paginate
from sourcemart.operators import governance

FINDINGS = r"""SELECT location, rule FROM (SELECT location, unnest([
    CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private-key' END,
    CASE WHEN regexp_matches(text, '\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})\b') THEN 'github-token' END,
    CASE WHEN regexp_matches(text, '\bsk-(?:proj-)?[A-Za-z0-9_-]{24,}\b') THEN 'api-key' END,
    CASE WHEN regexp_matches(text, '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b') THEN 'aws-key' END,
    CASE WHEN regexp_matches(text, 'https?://[^\s/:]+:[^\s/@]+@') THEN 'credential-url' END,
    CASE WHEN regexp_matches(text, '(?i)[A-Za-z]:[\\/]+Users[\\/]+[A-Za-z0-9_.-]+[\\/]') THEN 'literal-user-path' END,
    CASE WHEN regexp_matches(text, '(?i)\b(?:password|api[_-]?key|access[_-]?token|client[_-]?secret)\s*[:=]\s*["''][A-Za-z0-9_+/.=-]{12,}["'']') THEN 'secret-assignment' END,
    CASE WHEN len(list_filter(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'), lambda a: NOT (ends_with(a, '@users.noreply.github.com')
      OR ends_with(a, '@example.com') OR ends_with(a, '@example.invalid') OR a = 'noreply@github.com'))) > 0 THEN 'personal-email' END]) AS rule FROM texts) WHERE rule IS NOT NULL"""


def texts(t):
    """All texts of the tables that hold any, with where they come from."""
    return (t.documents.select(F.concat(F.lit("documents/"), "doc_id").alias("location"), "text")
            .unionByName(t.pages.select(F.concat(F.lit("pages/"), "page_id").alias("location"), F.concat_ws("\n", "url", "html").alias("text")))
            .unionByName(t.benchmark.select(F.concat(F.lit("benchmark/"), "item_id").alias("location"), "text"))
            .unionByName(t.conversations.select(F.concat_ws("/", F.lit("conversations"), "conv_id", "turn").alias("location"), "text")))


@check("audit_secrets", """WITH texts AS (SELECT 'documents/' || doc_id AS location, text FROM documents UNION ALL SELECT 'pages/' || page_id, url || chr(10) || html FROM pages
    UNION ALL SELECT 'benchmark/' || item_id, text FROM benchmark UNION ALL SELECT 'conversations/' || conv_id || '/' || turn, text FROM conversations)
    """ + FINDINGS)
def _(t):
    return governance.audit_secrets(texts(t))


@check("audit_versions", "WITH texts AS (SELECT min(doc_id) AS location, any_value(text) AS text, count(*) AS versions FROM documents GROUP BY sha256(text)), f AS (" + FINDINGS + ") SELECT f.location, f.rule, versions FROM f JOIN texts USING (location)")
def _(t):
    return governance.audit_versions(t.documents.select(F.col("doc_id").alias("location"), "text"))


@check("audit_paths", """SELECT path AS location, 'private-data-file' AS rule FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'docs/' || doc_id || '.MD' WHEN 1 THEN 'in/' || doc_id || '.XLSX' WHEN 2 THEN 'a/.catalog-x/' || doc_id || '.txt'
    WHEN 3 THEN 'data/' || doc_id || '.txt' WHEN 4 THEN 'conf/.env' || doc_id ELSE 'map/' || doc_id || '.local.json' END AS path FROM documents) WHERE doc_id % 6 <> 0""")
def _(t):
    number = F.col("doc_id").cast("string")
    shapes = [("docs/", ".MD"), ("in/", ".XLSX"), ("a/.catalog-x/", ".txt"), ("data/", ".txt"), ("conf/.env", ""), ("map/", ".local.json")]
    path = F.get(F.array(*[F.concat(F.lit(a), number, F.lit(b)) for a, b in shapes]), (F.col("doc_id") % 6).cast("int"))
    return governance.audit_paths(t.documents.select(path.alias("path")))


@check("reconcile_parts", """SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'title' ELSE 'text' END AS problem FROM documents LEFT JOIN labels USING (doc_id)
    WHERE toxic = 1 OR lang = 'de'""")
def _(t):
    docs = t.documents.join(t.labels, "doc_id", "left").filter(F.trim(F.regexp_replace("text", "(?U)\\s+", "")) != "")
    staged = docs.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), "text")
    parts = docs.select(F.col("doc_id").alias("id"), "lang", "toxic", F.concat_ws(" ", "lang", "source").alias("title"), F.posexplode(paginate("text")).alias("part", "text"))
    first = F.col("part") == 0
    published = parts.select("id", "part", F.when(first & (F.col("lang") == "de"), "other").otherwise(F.col("title")).alias("title"),
                             F.when(first & (F.col("toxic") == 1), F.concat(F.lit("!"), "text")).otherwise(F.col("text")).alias("text"))
    return governance.reconcile_parts(staged, published)


@check("artifact_verify", """SELECT 'artifact_' || sha256(sha256(text) || 'r' || doc_id || source || CASE WHEN lang = 'es' THEN '?' ELSE '' END) AS artifact_id, CASE WHEN lang = 'fr' THEN 'not_verified' WHEN lang = 'es' THEN 'foreign_id' WHEN lang = 'de' THEN 'missing' WHEN toxic = 1 THEN 'changed' END AS problem
    FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'en' OR toxic = 1""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    receipt = F.concat(F.lit("r"), "doc_id")
    name = F.col("source")
    made = d.select(governance.artifact_id(F.sha2("text", 256), receipt, F.concat(name, F.when(F.col("lang") == "es", "?").otherwise(""))).alias("artifact_id"),
                    F.concat(F.lit("/out/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.when(F.col("lang") != "fr", receipt).alias("receipt"), name.alias("name"))
    files = d.filter("lang <> 'de'").select(F.concat(F.lit("/out/"), "doc_id").alias("path"), F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return governance.verify_artifacts(made, files).select("artifact_id", "problem")

"""Checks before anything is published, and reconciliation of what was."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcemart.functions.rolling import shifted, summed, with_text_hash
from sourcemart.functions.text import as_column, compact

# Rule name and pattern (RE2 and Java read them alike), suffixes and names that are never published.
SECRET_RULES = {
    "private-key": "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github-token": "\\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})\\b",
    "api-key": "\\bsk-(?:proj-)?[A-Za-z0-9_-]{24,}\\b",
    "aws-key": "\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b",
    "credential-url": "https?://[^\\s/:]+:[^\\s/@]+@",
    "literal-user-path": "(?i)[A-Za-z]:[\\\\/]+Users[\\\\/]+[A-Za-z0-9_.-]+[\\\\/]",
    "secret-assignment": "(?i)\\b(?:password|api[_-]?key|access[_-]?token|client[_-]?secret)\\s*[:=]\\s*[\"'][A-Za-z0-9_+/.=-]{12,}[\"']",
}
EMAIL = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"
ALLOWED_EMAIL_ENDS = ["@users.noreply.github.com", "@example.com", "@example.invalid"]
ALLOWED_EMAILS = ["noreply@github.com"]
PRIVATE_SUFFIXES = [".xlsx", ".xls", ".xlsm", ".csv", ".tsv", ".pptx", ".pdf", ".doc", ".docx", ".png", ".jpg", ".jpeg", ".webp",
                    ".zip", ".db", ".sqlite", ".sqlite3", ".pem", ".key"]
PRIVATE_FOLDERS = ["outputs", "data"]


def findings(text) -> Column:
    """Names of the rules a text breaks; never what matched."""
    text = as_column(text)
    hits = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in SECRET_RULES.items()]

    def foreign(address):
        allowed = address.isin(*ALLOWED_EMAILS)
        for end in ALLOWED_EMAIL_ENDS:
            allowed = allowed | address.endswith(end)
        return ~allowed

    # Only texts with an @ are searched for addresses.
    personal = F.contains(text, F.lit("@")) & F.exists(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), foreign)
    return F.array_compact(F.array(*hits, F.when(personal, F.lit("personal-email"))))


def audit_secrets(docs: DataFrame, location="location", text="text") -> DataFrame:
    """(location, rule), one row per broken rule. One pass, no join: the rules are expressions."""
    return docs.select(F.col(location), F.explode(findings(text)).alias("rule"))


def audit_versions(versions: DataFrame, location="location", text="text") -> DataFrame:
    """Broken rules of each distinct content, for its first location. Contents without any are dropped before the shuffle, which
    carries hashes and rule names, never texts."""
    broken = versions.select(location, F.sha2(text, 256).alias("_content"), findings(text).alias("_rules")).filter(F.size("_rules") > 0)
    once = broken.groupBy("_content", "_rules").agg(F.min(location).alias(location), F.count("*").alias("versions"))
    return once.select(location, "versions", F.explode("_rules").alias("rule"))


def private_path(path) -> Column:
    """Paths that must not be published: data suffixes, local and environment files, catalogue and output folders."""
    path = as_column(path)
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))
    return (suffix.isin(*PRIVATE_SUFFIXES) | path.endswith(".local.json") | name.startswith(".env")
            | F.exists(parts, lambda p: p.startswith(".catalog") | p.isin(*PRIVATE_FOLDERS)))


def audit_paths(files: DataFrame, path="path") -> DataFrame:
    return files.filter(private_path(path)).select(F.col(path).alias("location"), F.lit("private-data-file").alias("rule"))


def reconcile_parts(staged: DataFrame, published: DataFrame, key="id") -> DataFrame:
    """staged(key, title, text), published(key, part, title, text): products whose parts do not give back the text.

    Parts count in their order; white space is not compared. Every mismatch is reported, with its kind. Texts stay where they
    are read: what is compared are hashes that compose, so parts are summed instead of put together.
    """
    parts = with_text_hash(published.select(key, "part", "title", compact("text").alias("_text")), "_text")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # numbers only
    placed = shifted(parts.withColumn("_place", F.coalesce(F.sum("_bytes").over(before), F.lit(0))), "_place")
    whole = placed.groupBy(key).agg(summed("_h1").alias("_p1"), summed("_h2").alias("_p2"), F.sum("_bytes").alias("_all"),
                                    F.min("title").alias("low"), F.max("title").alias("high"))
    own = with_text_hash(staged.select(key, "title", compact("text").alias("_text")), "_text").withColumn("_staged", F.lit(True))
    differs = (F.col("_p1") != F.col("_h1")) | (F.col("_p2") != F.col("_h2")) | (F.col("_all") != F.col("_bytes"))
    problem = F.coalesce(
        F.when(F.col("_staged").isNull(), "not_staged"), F.when(F.col("_all").isNull(), "not_published"),
        F.when((F.col("low") != F.col("title")) | (F.col("high") != F.col("title")), "title"), F.when(differs, "text"))
    return own.join(whole, key, "full").withColumn("problem", problem).filter("problem IS NOT NULL").select(key, "problem")


def artifact_id(content_hash, receipt, name) -> Column:
    return F.concat(F.lit("artifact_"), F.sha2(F.concat(as_column(content_hash), as_column(receipt), as_column(name)), 256))


def verify_artifacts(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(artifact_id, path, sha256, receipt, name), files(path, content_hash) -> refs that no longer hold."""
    problem = F.coalesce(
        F.when(F.coalesce(F.col("receipt"), F.lit("")) == "", "not_verified"),
        F.when(F.col("artifact_id") != artifact_id("sha256", "receipt", "name"), "foreign_id"),
        F.when(F.col("content_hash").isNull(), "missing"), F.when(F.col("content_hash") != F.col("sha256"), "changed"))
    return refs.join(files, "path", "left").withColumn("problem", problem).filter("problem IS NOT NULL").select("artifact_id", "path", "problem")

"""URL filters: rules indexed by their rarest literal token, so that few regular expressions run.

A rule is a row (rule, kind, verdict, pattern, tokens): a Java pattern for ``host || path``, and literal tokens that
every URL it matches contains. Each rule is filed under the one of its tokens that the fewest URLs have; the tokens
of a URL fetch the rules filed under them, and only those patterns run.

Cases: a null URL, or one without ``://``, has an empty host and path and the default verdict. Repeated rows are all
judged, each distinct URL once. Other columns are kept as they are; a column of the table with the name of a result
column is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import UPPER, fitted, lowered, table

#: Fixed rules of the query: verdict, host and start of the path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: What the method itself blocks where no rule fits: name, verdict, pattern of host and path, literal tokens.
PATTERNS = [
    ("spam host", "block", r"(?s)^([^/]*[.-])?spam[.-]", ["spam"]),
    ("casino host", "block", r"(?s)^([^/]*[.-])?casino[.-]", ["casino"]),
    ("porn host", "block", r"(?s)^([^/]*[.-])?porn[.-]", ["porn"]),
    ("login page", "block", r"(?s)^[^/]*/([^?#]*/)?login([./]|$)", ["login"]),
]
RULE_COLUMNS = "rule string, kind int, verdict string, pattern string, tokens array<string>"
_ANY = ""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lowered(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_tokens(target: Column) -> Column:
    """The distinct runs of ASCII letters and digits, and the empty token that every URL has."""
    runs = F.split(lowered(target), r"[^0-9a-z]+")
    return F.array_union(F.array(F.lit(_ANY)), F.array_distinct(runs))


def rule_table(spark: SparkSession, rules=RULES, patterns=PATTERNS) -> DataFrame:
    """Rules of host and path (kind 1, which come first) and free patterns (kind 0) as one table."""
    found = [_struct(rule, 1, verdict, _pattern(rule), _whole_tokens(rule)) for verdict, rule in rules]
    found += [_struct(name, 0, verdict, pattern, tokens) for name, verdict, pattern, tokens in patterns]
    if not found:
        return spark.sql("SELECT '' AS rule, 1 AS kind, '' AS verdict, '' AS pattern, array('') AS tokens").where("false")
    return spark.range(1).select(F.inline(F.array(*found)))


def _struct(rule, kind, verdict, pattern, tokens):
    listed = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array(F.lit(_ANY))
    values = (F.lit(rule), F.lit(kind), F.lit(verdict), F.lit(pattern), listed)
    return F.struct(*[v.alias(n) for v, n in zip(values, ("rule", "kind", "verdict", "pattern", "tokens"))])


def _pattern(rule: str) -> str:
    """The host itself or a subdomain, then a path that starts like the rule's."""
    quoted = rule.replace("\\E", "\\E\\\\E\\Q")
    return r"(?s)^([^/]*\.)?\Q" + quoted + r"\E"


def _whole_tokens(rule: str) -> list[str]:
    """Runs of letters and digits that the rule closes on both sides; a run at its end may go on in the URL."""
    runs, run = [], ""
    for sign in rule:
        if sign.isascii() and sign.isalnum():
            run += sign.lower()
        elif run:
            runs, run = runs + [run], ""
    return runs


def rarest_tokens(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the token each is filed under: of its tokens the one in the fewest rows of ``urls(tokens)``."""
    listed = rules.select("*", F.explode("tokens").alias("token"))
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(fitted(listed.select("token").distinct()), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    rank = F.struct(F.coalesce("n", F.lit(0)), "token")
    filed = listed.join(counts, "token", "left")
    return filed.groupBy("rule", "kind", "verdict", "pattern").agg(F.min_by("token", rank).alias("token"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and matched_pattern.

    Of the rules that fit, those of kind 1 come before free patterns, then the longest wins, then the last by name.
    ``rule`` names a rule of kind 1, ``matched_pattern`` the free pattern that decided; without either the verdict is
    ``default``.
    """
    target = F.concat(host_of(F.col("_url")), path_of(F.col("_url")))
    rows = pages.withColumn("_url", F.col(url))
    distinct = rows.select("_url").where(F.col("_url").isNotNull()).distinct()
    urls = distinct.select("_url", target.alias("_target"), url_tokens(target).alias("tokens"))
    filed = fitted(rarest_tokens(urls, rules))
    order = F.struct("kind", F.length("rule"), "rule")
    best = (
        urls.select("_url", "_target", F.explode("tokens").alias("token")).join(filed, "token")
        .where(F.expr("_target rlike pattern"))
        .groupBy("_url").agg(F.max_by(F.struct("kind", "rule", "verdict"), order).alias("_best"))
    )
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "matched_pattern")]
    named = lambda kind: F.when(F.col("_best.kind") == kind, F.col("_best.rule"))
    return rows.join(best, "_url", "left").select(
        *kept,
        F.coalesce(host_of(F.col("_url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("_url")), F.lit("")).alias("path"),
        named(1).alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        named(0).alias("matched_pattern"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "matched_pattern")


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL_RULES = ", ".join(f"({_sql_literal(r)}, {_sql_literal(v)})" for v, r in RULES)

SQL = f"""
WITH parts AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
split AS (
    SELECT row_number() OVER () AS n, page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts),
rules(rule, verdict) AS (VALUES {_SQL_RULES}),
fits AS (
    SELECT s.n, r.rule, r.verdict FROM split s, rules r
    WHERE (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
      AND starts_with(s.path, substr(r.rule, instr(r.rule, '/')))
    QUALIFY row_number() OVER (PARTITION BY s.n ORDER BY length(r.rule) DESC, r.rule DESC) = 1),
free AS (
    SELECT n, CASE
        WHEN regexp_matches(host, '(^|[.-])casino[.-]') THEN 'casino host'
        WHEN regexp_matches(path, '/login([./]|$)') THEN 'login page'
        WHEN regexp_matches(host, '(^|[.-])spam[.-]') THEN 'spam host'
        WHEN regexp_matches(host, '(^|[.-])porn[.-]') THEN 'porn host' END AS pattern
    FROM split)
SELECT s.page_id, s.host, s.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict WHEN free.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN f.rule IS NULL THEN free.pattern END AS matched_pattern
FROM split s JOIN free USING (n) LEFT JOIN fits f USING (n)"""

QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE = {"op1_url_filters": SQL}

"""URL filters: pattern rules found through their rarest literal token.

A rule is a pattern in the notation of content filter lists: `*` stands for anything, `^` for a separator or the
end, `||` at the start for the start of a host or of one of its subdomains, `|` at either end for that end of the address. All else is
literal. The literal runs of letters and digits that can't be part of a longer run in an address are the rule's tokens; the
rule is indexed by the one that is rarest among all addresses. An address fetches by its own tokens the few rules that
may fit, an equality join, and only those run their regular expressions.

Rules are rows of a table; their patterns are translated by column expressions. The index is broadcast only while it is
small; a larger one is joined by a shuffle, in which AQE splits common tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import sized, stored_table, text_rows, with_ids

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_SCHEMA = "rule string, pattern string, verdict string, priority int, any_case boolean"

#: Hosts with paths and their verdicts, in the order of the rules' text.
BASE = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Patterns of hosts and paths that serve no text worth keeping, for addresses without a rule above.
PATTERNS = [
    ("||casino^", "block"), ("-casino-", "block"), ("||casino-", "block"), ("-casino.", "block"), ("/casino/", "block"),
    ("||bets^", "block"), ("-bets.", "block"), ("||poker^", "block"), ("-poker.", "block"),
    ("||ads^", "block"), ("||ads.", "block"), ("||ads-", "block"), ("-ads.", "block"), ("||adserver.", "block"), ("/ads/", "block"), ("/adserver/", "block"), ("/banner/", "block"),
    ("||track.", "block"), ("||tracker.", "block"), ("-track.", "block"), ("/pixel.gif", "block"),
    ("||xxx^", "block"), ("-xxx.", "block"), ("||porn.", "block"), ("-porn.", "block"),
    ("/login^", "block"), ("/signup^", "block"), ("/cart^", "block"), ("/checkout^", "block"), ("/search?", "block"),
    ("/robots.txt|", "block"), ("/rss.xml|", "block"), ("/sitemap*.xml|", "block"),
]


def lowered(text: Column) -> Column:
    """With A-Z in lower case, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What patterns are held against: `//`, the host in lower case, and the rest of the url; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("//"), host_of(url), rest)).otherwise("")


def tokens_of(address: Column) -> Column:
    """The distinct runs of letters and digits; of letters only ASCII ones, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(lowered(address), F.lit("[a-z0-9]+"), 0))


def regex_of(pattern: Column, any_case: Column) -> Column:
    """The regular expression of a pattern."""
    tail = F.endswith(pattern, F.lit("|")) & (F.length(pattern) > 1)
    start = F.when(F.startswith(pattern, F.lit("||")), 2).when(F.startswith(pattern, F.lit("|")), 1).otherwise(0)
    body = F.substr(pattern, start + 1, F.greatest(F.length(pattern) - start - tail.cast("int"), F.lit(0)))
    quoted = F.regexp_replace(body, r"[\\.+?$|(){}\[\]\-]", r"\\$0")
    inner = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^A-Za-z0-9_.%-]|\\z)"))
    head = F.when(start == 2, r"^//(?:[^/?#]*\.)?").when(start == 1, "^//").otherwise("")
    return F.concat(F.when(any_case, "(?si)").otherwise("(?s)"), head, inner, F.when(tail, r"\z").otherwise(""))


def literals_of(pattern: Column) -> Column:
    """The pattern's runs of letters and digits that are whole runs in every address that fits."""
    text = lowered(pattern)
    text = F.when(F.startswith(text, F.lit("|")), F.regexp_replace(text, r"^\|\|?", "/")).otherwise(F.concat(F.lit("*"), text))
    text = F.when(F.endswith(text, F.lit("|")), text).otherwise(F.concat(text, F.lit("*")))
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), 0))


def rules_table(spark: SparkSession, base: list[tuple[str, str]] | None = None, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rules as rows: base rules (a host with a path, for the host and its subdomains) go before patterns, which ignore case."""
    base, patterns = BASE if base is None else base, PATTERNS if patterns is None else patterns
    rows = [(r, f"||{r}", v, 1, False) for r, v in base] + [(p, p, v, 0, True) for p, v in patterns]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def indexed(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """Rules with their regular expression and the rarest of their tokens; the empty token where they have none.

    Frequencies are counted over all addresses (column tokens). Of equally rare tokens the longest is taken, then the first.
    """
    known = rules.withColumn("any_case", F.coalesce("any_case", F.lit(False))).dropna(subset=["rule", "pattern", "verdict", "priority"]).distinct()
    parts = known.select("*", F.explode_outer(literals_of(F.col("pattern"))).alias("token"))
    wanted = parts.filter("token is not null").select("token").distinct()
    seen = addresses.select(F.explode("tokens").alias("token")).join(sized(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min_by(F.col("token"), F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), F.col("token")))
    index = parts.join(seen, "token", "left").groupBy(*known.columns).agg(rarest.alias("token"))
    return index.select("rule", "verdict", "priority", F.coalesce("token", F.lit("")).alias("token"), regex_of(F.col("pattern"), F.col("any_case")).alias("regex"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, priority, n_regex) of every row.

    rules: rule, pattern, verdict, priority, any_case. Of the rules that fit, the one of the highest priority wins, then the
    longest by its text, then one that allows, then the first by text. rule, priority are null where none fits; the verdict is then `default`.
    n_regex is the number of rules whose regular expression ran.

    A null url, or one without `://`, has an empty host, path and address; only rules without a literal that fit an empty text could fit.
    Rows of equal or null ids are judged each by itself. Without rules every row gets the default. Rules with a null
    don't count (a null any_case is false); repeated ones count once. Other columns of pages don't matter.
    """
    rows = text_rows(pages, id_col, url_col)
    rows = rows.withColumn("address", address_of(F.col("text")))
    addressed = rows.select("uid", "address", F.array_append(tokens_of(F.col("address")), F.lit("")).alias("tokens"))
    index = stored_table(indexed(rules, addressed))
    fetched = addressed.select("uid", "address", F.explode("tokens").alias("token")).join(sized(index), "token")
    judged = fetched.select("uid", "rule", "verdict", "priority", F.rlike("address", F.col("regex")).alias("fits"))
    order = F.struct(-F.col("priority"), -F.length("rule"), F.col("verdict") != "allow", F.col("rule"))
    best = F.min_by(F.struct("rule", "verdict", "priority"), F.when(F.col("fits"), order))
    found = judged.groupBy("uid").agg(F.count("*").alias("n_regex"), best.alias("best"))
    out = with_ids(rows, pages.schema[id_col].dataType.simpleString()).join(found, "uid", "left")
    return out.select(
        F.col("id").alias(id_col), host_of(F.col("text")).alias("host"), path_of(F.col("text")).alias("path"), "best.rule",
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "best.priority", F.coalesce("n_regex", F.lit(0)).alias("n_regex"),
    )

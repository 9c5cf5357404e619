"""URL filters: pattern rules looked up by their rarest literal token.

A rule is a pattern in the usual blocking-list notation: `||` anchors at a host or any of its subdomains, a last `|` at
the end, `*` stands for anything, `^` for a separator or the end, all else is literal; rules of verdict `allow` are
exceptions.  Its literal tokens are the alphanumeric runs that the pattern bounds on both sides, so any URL that fits
has them as whole tokens.  Token frequencies over all URLs pick each rule's rarest token; the URL's tokens fetch the
candidate rules by a join, and only those run their regular expression.  A rule without a literal token would be a
candidate for every URL and is refused.  Rules are a table, read by DataFrame functions as URLs are.

The verdict of a URL is that of the fitting host rule with the longest pattern; without one, that of the first other
rule that fits, exceptions first; without any, `allow`.

Nulls and edge cases: a null URL, or one without `://`, has empty host and path, fits no rule and is allowed; a rule
with a null pattern is refused; repeated rows get the same verdict; an empty table gives an empty result; columns named
like the results are replaced, and all other columns, whatever their names, come through as they are.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small


@dataclass(frozen=True)
class Rule:
    """`host` rules decide by length; `pattern` rules only decide where no host rule fits."""

    name: str
    pattern: str
    verdict: str
    kind: str = "host"


RULE_SCHEMA = "rule string, pattern string, verdict string, kind string"


def host_rule(name: str, verdict: str) -> Rule:
    return Rule(name, f"||{name}", verdict)


#: The host and path rules of the contract.
HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))

#: First and second words of the names of junk hosts, by category.
JUNK_HOSTS = {
    "gambling": ("casino free best lucky online vegas", "win bets slots poker jackpot roulette"),
    "pills": ("cheap discount generic online", "pills meds pharmacy viagra"),
    "adult": ("adult xxx hot", "x cams dating video"),
    "links": ("spam link seo article", "farm exchange directory spinner"),
    "trackers": ("ads ad click", "track tracker server pixel count"),
}

PATTERN_RULES = (
    *(Rule(f"{kind}:{a}-{b}", f"||{a}-{b}.", "block", "pattern") for kind, (first, second) in JUNK_HOSTS.items() for a, b in product(first.split(), second.split())),
    Rule("adserver", "||adserver.", "block", "pattern"),
    Rule("session-first", "?phpsessid=", "block", "pattern"),
    Rule("session-later", "&phpsessid=", "block", "pattern"),
    Rule("login", "/login?", "block", "pattern"),
    Rule("cart", "/cart/add?", "block", "pattern"),
)

RULES = HOST_RULES + PATTERN_RULES

#: Rules up to which the index is broadcast; more are joined by a shuffle on the token.
BROADCAST_RULES = 50_000


def compiled(rules: DataFrame) -> DataFrame:
    """`rules` with rule_no (in the order of pattern and name), length, regex (on host + path + rest) and tokens."""
    anchored, ended = F.col("pattern").startswith("||"), F.col("pattern").rlike(r"[^|]\|$")
    body = F.regexp_replace("pattern", r"^\|\||\|$", "")
    # A host rule never looks past the host for its anchor.
    head = F.when(anchored, r"^(?:[^/?#]*\.)?").otherwise("")
    literal = F.regexp_replace(body, r"([^A-Za-z0-9_*^])", r"\\$1")
    literal = F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^A-Za-z0-9_.%-]|$)"))
    bounded = F.concat(F.when(anchored, "").otherwise("*"), body, F.when(ended, "").otherwise("*"))
    tokens = F.array_distinct(F.regexp_extract_all(bounded, F.lit(r"(?<![*A-Za-z0-9])[A-Za-z0-9]+(?![*A-Za-z0-9])"), F.lit(0)))
    out = rules.select("rule", "pattern", "verdict", "kind", F.length("pattern").alias("length"))
    out = out.withColumn("regex", F.concat(F.lit("(?s)"), head, literal, F.when(ended, "$").otherwise(""))).withColumn("tokens", tokens)
    return out.distinct().withColumn("rule_no", F.xxhash64("pattern", "rule", "verdict", "kind"))


def parts(url: Column) -> Column:
    """(host, path, subject) of a URL: A-Z of the host lower-cased; the subject is host, path and the rest."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    after = F.coalesce(F.regexp_replace(rest, r"^[^/?#]*", ""), F.lit(""))
    return F.struct(host.alias("host"), path.alias("path"), F.concat(host, after).alias("subject"))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per rule."""
    return spark.createDataFrame([astuple(r) for r in rules], RULE_SCHEMA)


def index_by_rarest(urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Rules with their rarest token, by the number of URLs of the whole table that have it; ties by code point."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(_tokens()).alias("token"))
    counts = seen.join(broadcast_if_small(wanted, n_rules, BROADCAST_RULES), "token").groupBy("token").agg(F.count("*").alias("n"))
    each = rules.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    best = F.row_number().over(Window.partitionBy("rule_no").orderBy(F.coalesce("n", F.lit(0)), "token"))
    return each.withColumn("_best", best).filter("_best = 1").drop("_best", "tokens", "n")


def _tokens() -> F.Column:
    return F.array_distinct(F.split("_subject", "[^A-Za-z0-9]+"))


def judge(pages: DataFrame, rules: DataFrame | tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, verdict, pattern_rule (the first fitting rule of the other kind).

    `rules` is a table as RULE_SCHEMA, read from wherever it is kept, or a tuple of rules.
    """
    table = compiled(rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules))
    sizes = table.agg(F.count("*"), F.min(F.when(F.coalesce(F.size("tokens"), F.lit(0)) < 1, F.coalesce("rule", "pattern", F.lit("null"))))).first()
    if sizes[1] is not None:
        raise ValueError(f"a rule without a literal token: {sizes[1]}")
    given = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern_rule")]
    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), parts(F.col(f"`{url}`")).alias("parts"))
    urls = split.select(F.col("parts.subject").alias("_subject")).filter("_subject <> ''").distinct()
    index = index_by_rarest(urls, table, sizes[0])
    keyed = broadcast_if_small(index, sizes[0], BROADCAST_RULES)
    by_token = urls.withColumn("token", F.explode(_tokens())).join(keyed, "token").drop("token")
    fits = by_token.filter(F.expr("rlike(_subject, regex)"))
    best = lambda kind, order, pick: pick(F.when((F.col("kind") == "host") == kind, F.struct(order.alias("order"), F.col("rule"), F.col("verdict"))))
    won = fits.groupBy("_subject").agg(
        best(True, F.struct(F.col("length"), F.col("rule")), F.max).alias("host"),
        best(False, F.struct((F.col("verdict") != "allow").alias("blocks"), F.col("pattern"), F.col("rule")), F.min).alias("other"),
    )
    joined = split.join(won, F.col("parts.subject") == F.col("_subject"), "left")
    verdict = F.coalesce("host.verdict", "other.verdict", F.lit("allow"))
    return joined.select("row.*", "parts.host", "parts.path", F.col("host.rule").alias("rule"), verdict.alias("verdict"), F.col("other.rule").alias("pattern_rule"))

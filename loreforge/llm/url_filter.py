"""URL rules: expand each URL into host-suffix and path-prefix expressions, join on short hash prefixes, confirm digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import free_name, join_counted, stored

#: (host, path, verdict) of the contract.
BASE_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Words of host labels that block a URL where no other rule fits: rules of their own, by kinds of sites.
WORD_RULES = tuple((w, "block") for w in ("ads", "adult", "bets", "casino", "malware", "phishing", "pills", "poker", "porn", "spam", "warez"))
WORD = "~"  # marks a word of the host among the expressions
#: Rules up to this number are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, words: DataFrame | None = None, url: str = "url", prefix_hex: int = 8, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict (null where no rule fits) to each row of pages.

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's path;
    the longest host + path wins, then the greater text. words (word, verdict): where no rule fits, the verdict is that of
    the longest word that is a part of a host label between hyphens; rule stays null. A null URL or one without :// has
    empty host and path, which no rule fits. Columns of pages with these names are replaced. An empty table of pages or
    rules gives no rows or no fits. Every distinct (host, path) is judged once, so repeated URLs cost one expansion; a URL has
    at most as many expressions as the rules have numbers of labels times lengths of paths, and one for each word of its host.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").distinct()
    # numbers of labels and lengths of paths are few, whatever the number of rules: at most the longest rule's
    labels_of = lambda h: F.size(F.split(h, r"\."))
    depths = [r[0] for r in rules.select(labels_of("host")).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    keys = rules.select(F.concat("host", "path").alias("rule"), "verdict", F.lit(1).alias("rank"), F.concat_ws("\n", "host", "path").alias("expr"))
    if words is not None:
        keys = keys.unionByName(words.where("word is not null").select(F.col("word").alias("rule"), "verdict", F.lit(0).alias("rank"), F.concat(F.lit(WORD), "word").alias("expr")).distinct())
    n_rules = keys.count()
    keys = keys.withColumn("digest", F.sha2("expr", 256)).drop("expr").withColumn("short", F.substring("digest", 1, prefix_hex))

    n = free_name("rows", pages.columns)  # of each URL
    urls = pages.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias(n))
    ints = lambda values: F.array(*map(F.lit, sorted(values))).cast("array<int>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(ints(depths), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(ints(lengths), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    exprs = urls.select("host", "path", n, F.explode(suffixes).alias("h"), prefixes.alias("ps")).select("host", "path", n, "h", F.explode("ps").alias("p")).select("host", "path", n, F.concat_ws("\n", "h", "p").alias("expr"))
    if words is not None:
        of_host = F.array_distinct(F.filter(F.split("host", r"[.-]"), lambda w: w != ""))
        exprs = exprs.unionByName(urls.select("host", "path", n, F.explode(of_host).alias("w")).select("host", "path", n, F.concat(F.lit(WORD), "w").alias("expr")))
    exprs = exprs.select("host", "path", n, F.sha2("expr", 256).alias("full")).withColumn("short", F.substring("full", 1, prefix_hex))
    keys = F.broadcast(keys) if n_rules <= broadcast_rules else keys.hint("merge")
    fits = exprs.join(keys, "short").where("full = digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rank", F.length("rule").alias("n"), "rule", "verdict")).alias("b"), F.max(n).alias(n))
    best = stored(best.select("host", "path", F.when(F.col("b.rank") == 1, F.col("b.rule")).alias("rule"), F.col("b.verdict").alias("verdict"), n), "url-verdicts")
    # rows without a host, which may be many, meet no rule and aren't shuffled
    none = pages.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return join_counted(pages.where("host <> ''"), best, ["host", "path"], n, "left").drop(n).unionByName(none)


def op8_url_filter(spark, sf_dir) -> DataFrame:
    from loreforge.llm.common import read_table

    rules = spark.createDataFrame(list(BASE_RULES), "host string, path string, verdict string")
    words = spark.createDataFrame(list(WORD_RULES), "word string, verdict string")
    out = judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules, words)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


OP8_SQL = """
WITH rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                 ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT page_id,
         coalesce(CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
         coalesce(CASE WHEN strpos(url, '://') > 0
                  THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, rh || rp DESC) AS k
  FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), WORDS) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged WHERE k = 1
""".replace("WORDS", "[" + ", ".join(f"'{w}'" for w, _ in WORD_RULES) + "]")

"""URL rules by host-suffix and path-prefix expressions, met through short hash prefixes.

A rule (host, path, action) fits the urls of its host and of all subdomains whose path starts with the
rule's path, wherever in a segment that ends. The longest fitting rule decides.

1. A rule is cut after its path's last slash into a folder and a rest: example.org/en/ and 1. Stored are the
   folder's expressions (host + folder) with the lengths of the rests that follow there, and the rules'
   expressions (host + path), each under the first four bytes of its SHA-256 beside the whole digest.
2. Each distinct (host, path) of the urls expands to its host suffixes times its folders, as deep as the
   deepest rule. These join the stored folders by hash prefix; the whole digest confirms, so that two
   expressions which share four bytes never meet.
3. What is confirmed expands once more, by the lengths that rules have there, and joins the rules' expressions
   in the same way. Of the confirmed rules the longest is kept in a combining aggregate.

An address thus meets as many rows as it has expressions, however many rules a host or folder has. Expressions
that many urls share (``org/``) are hot keys of an inner join, which Spark splits or, for a small list,
turns into a broadcast by its own size check. Urls meet their verdict again by (host, path); copies collapse
before they expand.

Precedence: the longest host + path in code points; then the longer host; then block before allow.
Defined cases: NULL urls and such without ``://`` have an empty host and path, which only rules of an empty host
fit; ports and user names are part of the host, as they stand; hosts of several dots in a row have empty
labels; only A-Z is lower-cased, in urls and in rules' hosts; paths aren't decoded and their case counts. Very long
urls expand no deeper than the deepest rule. Repeated rules count once, repeated urls keep all their rows. An empty
table gives an empty result, an empty list gives every url the default. Other columns of the input, whatever
their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog_lake.session import materialise

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a hexadecimal digest that are joined by.
PREFIX_HEX = 8
#: The query's rules: host, path, action.
RULES = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(text, F.lit("://")), F.substr(text, F.locate("://", text) + 3)).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substr(rest, F.char_length(host) + 1)
    return F.translate(host, UPPER, LOWER), F.substring_index(F.substring_index(tail, "?", 1), "#", 1)


def count_of(text: Column, character: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))


def expression(host: Column, path: Column) -> Column:
    """A host without a slash and a path from its first slash on are told apart in their concatenation."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_HEX), 16, 10).cast("bigint")


def rule_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


class RuleList:
    """Hashed rules, written once: ``folders`` and ``rules`` have a row for each short prefix (key) with the entries under it.

    A folder's entry is its digest and the lengths of the rests that follow there, a rule's its digest and action. A
    key holds one entry but for the rare pairs of expressions that share four bytes.
    """

    def __init__(self, rules: DataFrame) -> None:
        if rules.filter(F.coalesce(~F.col("action").isin(ALLOW, BLOCK), F.lit(True)) | F.col("host").isNull() | F.col("path").isNull()).limit(1).count():
            raise ValueError(f"rules need a host, a path and {ALLOW} or {BLOCK}")
        one = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").groupBy("host", "path").agg(F.max("action").alias("action"))  # block sorts after allow
        folder = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
        cut = one.withColumn("folder", folder)
        rests = cut.groupBy("host", "folder").agg(F.collect_set((F.char_length("path") - F.char_length("folder")).cast("int")).alias("rests"))
        self.folders = _entries(rests, "folder", "rests")
        self.rules = _entries(cut, "path", "action")
        deepest = cut.agg(F.max(count_of(F.col("host"), ".") + 1), F.max(count_of(F.col("folder"), "/"))).first()
        self.labels, self.slashes = (x or 0 for x in deepest)


def _entries(rules: DataFrame, path: str, value: str) -> DataFrame:
    """key and the entries (digest, value) under it."""
    hashed = rules.select(expression(F.col("host"), F.col(path)).alias("digest"), F.col(value).alias("value"))
    return materialise(hashed.groupBy(short(F.col("digest")).alias("key")).agg(F.collect_list(F.struct("digest", "value")).alias("entries")), "url-rules")


def _confirmed(urls: DataFrame, stored: DataFrame, host: Column, path: Column) -> DataFrame:
    """Rows of ``urls`` whose expression is stored, with its value: joined by the short prefix, confirmed by the digest."""
    keyed = urls.withColumn("key", short(expression(host, path)))
    same = F.filter("entries", lambda e: e["digest"] == expression(host, path))
    return keyed.join(stored, "key").withColumn("entry", same).filter(F.size("entry") > 0).withColumn("value", F.get("entry", F.lit(0))["value"]).drop("key", "entries", "entry")


def fitting_rules(urls: DataFrame, listed: RuleList) -> DataFrame:
    """host, path, rule, action: the rule that decides, for the distinct (host, path) of ``urls`` that any rule fits."""
    targets = urls.select("host", "path").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(listed.labels, 1)), count_of(F.col("host"), ".") + 1)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    depth = F.least(F.lit(listed.slashes), count_of(F.col("path"), "/"))
    folders = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, "").otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), i), F.lit("/"))))
    expanded = targets.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
    near = _confirmed(expanded, listed.folders, F.col("suffix"), F.col("folder"))
    whole = near.withColumn("rest", F.explode("value")).withColumn("end", F.char_length("folder") + F.col("rest")).filter(F.col("end") <= F.char_length("path")).drop("value")
    hits = _confirmed(whole.withColumn("start", F.substr("path", F.lit(1), F.col("end"))), listed.rules, F.col("suffix"), F.col("start"))
    order = F.struct(F.char_length("suffix") + F.col("end"), F.char_length("suffix"))
    return hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "start").alias("rule"), F.col("value").alias("action")), order).alias("r")).select("host", "path", "r.rule", "r.action")


def judge_urls(pages: DataFrame, listed: RuleList, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule (NULL: none fits), verdict for every page."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = fitting_rules(urls, listed)
    return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, listed: RuleList, default: str = ALLOW) -> DataFrame:
    """The pages that aren't blocked, with all their columns."""
    host, path = url_parts(F.col("url"))
    packed = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    blocked = packed.join(fitting_rules(packed, listed), ["host", "path"], "left")
    return blocked.filter(F.coalesce("action", F.lit(default)) == ALLOW).select("row.*")


#: DuckDB SQL for the query over pages.
ORACLE = f"""
with rules(host, path, action) as (values {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)}),
u as (select row_number() over () as r, page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end as rest from pages),
v as (select r, page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from u),
w as (select r, page_id, translate(h, '{UPPER}', '{LOWER}') as host, regexp_extract(rest[length(h) + 1:], '^[^?#]*') as path from v),
f as (select w.*, x.host || x.path as rule, x.action, row_number() over (partition by r order by length(x.host || x.path) desc, length(x.host) desc, x.action desc) as k
  from w left join rules x on (w.host = x.host or ends_with(w.host, '.' || x.host)) and starts_with(w.path, x.path))
select page_id, host, path, rule, coalesce(action, '{ALLOW}') as verdict from f where k = 1"""

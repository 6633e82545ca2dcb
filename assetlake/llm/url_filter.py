"""URL filtering: listed rules decide first, association rules mined from labelled pages decide the rest.

A URL is a set of tokens: words of its scheme, host, path and what follows, marked by the part they
stand in. FP-growth mines token combinations over labelled pages, each with the label as one more
item. A combination found among blocked pages at least ``support`` of the time is a rule if the lower end of the
95 % interval of its confidence (blocked among all labelled pages that have it) reaches
``confidence``: few pages prove little, at every size. A rule that a shorter, at least
as sure one implies is pruned. Rules match by inverted index: each stands in the bucket of its
rarest token, so a URL looks at the few rules that its own tokens point to.

Tokens that the same labelled pages have are one item: rules cannot tell them apart, and
itemsets of a long URL that many pages share would otherwise double with every token. A rule then asks for all of them.
Tokens of every labelled page say nothing and are left out.

Everything is DataFrame functions. URLs are never shuffled after mining: the index is a value that
Spark computes once and hands to the scan. It is as large as the rules, of which ``support`` limits
the tokens to (tokens of a URL) / support; if there are more than BLOCK rules, they are matched block by block.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written

#: Fixed values: (verdict, host, path) of the listed rules.
LISTED = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

SUPPORT, CONFIDENCE = 0.002, 0.6
BLOCK = 20_000  # rules in one index
LABEL = "!blocked"  # no token is like this
_Z2 = 1.96**2


def _folded(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty for null and without ``://``."""
    return _folded(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct words of a URL, marked s:, h:, p: or q: by their part, A-Z as a-z. Empty for null; without ``://`` all is path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, _after_scheme(url)).otherwise(url)
    parts = {
        "s": F.when(at > 0, F.substring(url, F.lit(1), at - 1)),
        "h": F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*", 0)),
        "p": F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(rest, "^[^?#]*", 0)),
        "q": F.regexp_extract(rest, "^[^?#]*([\\s\\S]*)", 1),
    }

    def marked(mark: str, text: Column) -> Column:
        words = F.filter(F.split(_folded(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(mark + ":"), w))

    return F.array_distinct(F.concat(*(marked(m, x) for m, x in parts.items())))


def listed_rule(own_host: Column, own_path: Column, rules: Sequence[tuple[str, str, str]] = LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host is the URL's or one above it, and the URL's path starts with its path; null without one."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((own_host == h) | F.endswith(own_host, F.lit("." + h))) & F.startswith(own_path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def page_labels(labels: DataFrame) -> DataFrame:
    """(page_id, blocked) of labels(doc_id, quality, toxic): blocked if a row of that id is of quality 0 or toxic; ids without a label or with null are left out."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("blocked")).filter("blocked IS NOT NULL")


def sure(hits: Column, n: Column) -> Column:
    """Lower end of the 95 % interval of hits / n (Wilson)."""
    hits, n = hits.cast("double"), n.cast("double")
    share = hits / n
    return (share + _Z2 / (2 * n) - F.sqrt(_Z2 * (share * (1 - share) / n + _Z2 / (4 * n * n)))) / (1 + _Z2 / n)


def _token_classes(rows: DataFrame, least: float, n: int) -> DataFrame:
    """(item, members, pages): tokens of at least ``least`` and fewer than all n rows, by the set of rows that have them."""
    own = F.xxhash64("page_id", "url")
    each = rows.select(F.explode("tokens").alias("token"), own.bitwiseAND(0xFFFFFFFF).alias("low"), F.shiftrightunsigned(own, 32).alias("high"))
    by = each.groupBy("token").agg(F.count("*").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    # Equal sums over equally many rows: the same rows, but for a collision of 64 bits.
    alike = by.filter((F.col("pages") >= least) & (F.col("pages") < n)).groupBy("pages", "low", "high")
    return alike.agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("members")).select("item", "members", "pages")


def mine(pages: DataFrame, labels: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, anchor, hits, pages, sure): rules from pages(page_id, url) with labels(page_id, blocked), stored.

    tokens: all of what a URL must have, in order; anchor: the rarest of them; pages: labelled pages that have
    them, hits: the blocked among these. Repeated pages count as often as they occur; no labels, no rules.
    """
    rows = written(pages.select("page_id", "url").join(labels.select("page_id", "blocked"), "page_id").withColumn("tokens", tokens(F.col("url"))), "labelled")
    n = rows.count()
    classes = written(_token_classes(rows, support * n, n), "classes")
    # As many as (tokens of a URL) / support at most, which FP-growth itself keeps in the driver.
    items = F.array(*(F.lit(r["item"]) for r in classes.select("item").orderBy("item").collect())).cast("array<string>")
    own = F.array_intersect("tokens", items)
    baskets = rows.select(F.when(F.col("blocked"), F.array_append(own, F.lit(LABEL))).otherwise(own).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    found = written(found.select(F.array_sort(F.array_remove("items", LABEL)).alias("items"), F.array_contains("items", LABEL).alias("of_blocked"), "freq"), "itemsets")
    hits = found.filter("of_blocked AND size(items) > 0").select("items", F.col("freq").alias("hits"))
    rules = hits.join(found.filter("NOT of_blocked").select("items", F.col("freq").alias("pages")), "items").withColumn("sure", sure(F.col("hits"), F.col("pages"))).filter(F.col("sure") >= confidence)
    one = rules.select("items", F.explode("items").alias("item")).join(classes.select("item", "members", F.col("pages").alias("of_item")), "item")
    whole = one.groupBy("items").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"), F.min(F.struct("of_item", "item"))["item"].alias("anchor"))
    rules = written(rules.join(whole, "items"), "rules")
    longer, shorter = rules.select("items", "sure", F.explode("items").alias("anchor")).alias("l"), rules.alias("s")
    implied = (F.size("s.items") < F.size("l.items")) & (F.col("s.sure") >= F.col("l.sure")) & F.forall("s.items", lambda x: F.array_contains("l.items", x))
    implied = longer.join(shorter, (F.col("s.anchor") == F.col("l.anchor")) & implied).select("l.items").distinct()
    kept = written(rules.join(implied, "items", "left_anti").select("tokens", "anchor", "hits", "pages", "sure"), "kept")
    dropped(rows, classes, found, rules)
    return kept


def _index(rules: DataFrame, buckets: int) -> DataFrame:
    """(index): one array of ``buckets`` arrays of (anchor, tokens), by the hash of the anchor."""
    filled = rules.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("id")).agg(F.collect_list(F.struct("anchor", "tokens")).alias("rules"))
    every = rules.sparkSession.range(buckets).join(filled, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "rules"))), lambda b: b["rules"]).alias("index"))


def matches(df: DataFrame, rules: DataFrame, column: str, *, block: int = BLOCK) -> DataFrame:
    """df(tokens, ...) with a boolean column: whether some rule's tokens are all among tokens."""
    n, found = rules.count(), F.lit(False)
    blocks = max(1, -(-n // block))
    for b in range(blocks if n else 0):
        some = rules if blocks == 1 else rules.filter(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == b)
        size = max(1, n // blocks)
        df = df.withColumn(f"_index {b}", _index(some, size).scalar())
        bucket = lambda t, b=b, size=size: F.get(f"_index {b}", F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
        fits = lambda t, r: (r["anchor"] == t) & F.forall(r["tokens"], lambda x: F.array_contains("tokens", x))
        own = F.exists("tokens", lambda t: F.coalesce(F.exists(bucket(t), lambda r: fits(t, r)), F.lit(False)))  # noqa: B023
        found = found | own
    return df.withColumn(column, found).drop(*(f"_index {b}" for b in range(blocks)))


def filter_urls(pages: DataFrame, labels: DataFrame, *, listed: Sequence[tuple[str, str, str]] = LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """A row for each of pages(page_id, url, ...): page_id, host, path, rule, verdict, mined.

    rule: the listed rule that fits, as host and path, or null; verdict: allow or block, the listed
    rule's, else block if a mined rule matches; mined: whether one does, listed or not. labels(page_id, blocked) teach. A null URL, an
    empty one and one without ``://`` have an empty host and path; no listed rule fits them, and mined
    ones may. Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    pages = pages.select("page_id", "url")
    rules = mine(pages, labels, support=support, confidence=confidence)
    judged = matches(pages.withColumn("tokens", F.coalesce(tokens(F.col("url")), F.array().cast("array<string>"))), rules, "mined")
    judged = judged.withColumns({"host": F.coalesce(host(F.col("url")), F.lit("")), "path": F.coalesce(path(F.col("url")), F.lit(""))})
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")


def op12_url_filter(spark, sf_dir):
    """The verdict on each page's URL, learning from the labels of the pages' ids."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


_FOLD = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = "list_transform(list_filter(string_split_regex(" + _FOLD.format("coalesce({text}, '')") + ", '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != ''), lambda w: '{mark}:' || w)"
_FITS = "\n    ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in sorted(LISTED, key=lambda r: -len(r[1] + r[2])))

#: The same by enumeration: every subset of every labelled page's items.
OP12_SQL = f"""WITH RECURSIVE
cut AS (SELECT page_id, url, strpos(url, '://') AS colon, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS page, page_id, colon, coalesce({_FOLD.format("regexp_extract(rest, '^[^/?#]*', 0)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  CASE WHEN colon > 0 THEN substr(url, 1, colon - 1) END AS scheme, coalesce(rest, url) AS rest FROM cut),
tokened AS (SELECT page, page_id, host, path, list_distinct(list_concat({_WORDS.format(text="scheme", mark="s")}, {_WORDS.format(text="host", mark="h")},
  {_WORDS.format(text="CASE WHEN colon > 0 THEN path ELSE regexp_extract(rest, '^[^?#]*', 0) END", mark="p")}, {_WORDS.format(text="regexp_extract(rest, '(?s)^[^?#]*(.*)', 1)", mark="q")})) AS tokens FROM parts),
labelled AS (SELECT page, tokens, blocked FROM tokened JOIN (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS blocked FROM labels GROUP BY doc_id) l ON page_id = doc_id WHERE blocked IS NOT NULL),
total AS (SELECT count(*) AS n, {SUPPORT} * count(*) AS least FROM labelled),
having_it AS (SELECT token, list(page ORDER BY page) AS having_pages FROM (SELECT page, unnest(tokens) AS token FROM labelled) GROUP BY token),
classes AS (SELECT having_pages, list(token ORDER BY token) AS members, min(token) AS item FROM having_it, total WHERE len(having_pages) >= least AND len(having_pages) < n GROUP BY having_pages),
baskets AS (SELECT page, list(item ORDER BY item) AS items FROM (SELECT unnest(having_pages) AS page, item FROM classes) GROUP BY page),
subsets AS (SELECT page, items, 0 AS i, []::varchar[] AS own FROM baskets
  UNION ALL SELECT page, items, i + 1, CASE WHEN take THEN list_append(own, items[i + 1]) ELSE own END FROM subsets, (VALUES (true), (false)) t(take) WHERE i < len(items)),
counted AS (SELECT own, count(*)::double AS c, count(*) FILTER (blocked)::double AS hits FROM subsets JOIN labelled USING (page) WHERE i = len(items) AND len(own) > 0 GROUP BY own),
rules AS (SELECT row_number() OVER () AS rule_no, own FROM counted, total WHERE hits > 0 AND hits >= least
  AND (hits / c + {_Z2} / (2 * c) - sqrt({_Z2} * (hits / c * (1 - hits / c) / c + {_Z2} / (4 * c * c)))) / (1 + {_Z2} / c) >= {CONFIDENCE}),
whole AS (SELECT rule_no, flatten(list(members)) AS needed FROM (SELECT rule_no, unnest(own) AS item FROM rules) JOIN classes USING (item) GROUP BY rule_no),
hit AS (SELECT DISTINCT page FROM tokened, whole WHERE list_has_all(tokens, needed)),
judged AS (SELECT page_id, host, path, page IN (SELECT page FROM hit) AS mined, CASE {_FITS.format(*(h + p for _, h, p in sorted(LISTED, key=lambda r: -len(r[1] + r[2]))))} END AS rule,
  CASE {_FITS.format(*(k for k, h, p in sorted(LISTED, key=lambda r: -len(r[1] + r[2]))))} END AS listed FROM tokened)
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN mined THEN 'block' ELSE 'allow' END) AS verdict, mined FROM judged"""

"""URL filter: fixed host rules first, then association rules mined from labelled pages.

A URL's items are its scheme, host and host suffixes, first host label, path segments (digits masked)
and query names. Items that are frequent on bad pages form the vocabulary, whether or not they are
telling by themselves. Those that occur on the same labelled pages are one class: a page with any of
them has the class, which gives the same verdicts as rules on the items and far fewer sets.

A class that is confident by itself is a rule; larger sets with it block nothing more, so it is not
mined further. Neither is a class that all labelled pages have: without it a set has the same
pages. Of the other classes Spark's FP-growth mines all frequent sets of the bad pages; their good
pages are counted, and rules "items -> block" are pruned by confidence. Verdicts are those of all
confident sets. The number of sets grows with the powers of two of the classes that are not telling
alone and that many bad pages share, not with the vocabulary.

To count and to match, pages are reduced to their distinct patterns (sets of vocabulary items).
Each set stands once in an inverted index, under its rarest item; a pattern meets only the sets
under its items, and a set fits if the pattern has all of its items.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.scratch import cut_lineage

#: Fixed rules (verdict, host, path): a rule fits its host and all subdomains.
FIXED_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
MIN_SUPPORT = 0.005
MIN_ROWS = 10
MIN_CONFIDENCE = 0.7
#: The longest legal host name. Longer suffixes of a host are no items; the whole host always is one.
HOST_CHARS = 253

_BLOCK = "verdict:block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=None) -> Column:
    """Struct of rule text and verdict of the longest fixed rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules or FIXED_RULES, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def items(url: Column) -> Column:
    """Distinct items of a URL; empty without ``://``."""
    whole = host(url)

    def suffixes_of(h: Column) -> Column:
        # A legal name has at most 127 labels; so a long host takes memory in proportion, not by the square.
        dots = F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))
        counted = F.sequence(F.lit(1), F.least(dots + 1, F.lit(HOST_CHARS // 2 + 1)))
        ends = F.transform(counted, lambda i: F.right(F.call_function("substring_index", h, F.lit("."), -i), F.lit(HOST_CHARS + 1)))
        return F.transform(F.concat(F.array(h), F.filter(ends, lambda e: F.length(e) <= HOST_CHARS)), lambda e: F.concat(F.lit("host:"), e))

    # The host is found once, not once for each suffix.
    suffixes = F.get(F.transform(F.array(whole), suffixes_of), F.lit(0))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    query = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    names = F.filter(F.transform(F.split(query, "&"), lambda s: F.split(s, "=")[0]), lambda s: s != "")
    mask = lambda s: F.regexp_replace(s, "[0-9]+", "#")
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)), F.concat(F.lit("label:"), F.substring_index(whole, ".", 1))),
        suffixes,
        F.transform(segments, lambda s: F.concat(F.lit("path:"), mask(s))),
        F.transform(names, lambda s: F.concat(F.lit("query:"), mask(s))),
    )
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.array_distinct(every)).otherwise(
        F.array().cast("array<string>")
    )


def _mine(
    pages: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_rows: int = MIN_ROWS,
) -> tuple[DataFrame, DataFrame] | None:
    """Vocabulary ``(item, n, b, class)`` and rules ``(needs, confidence)``; None if nothing is frequent.

    Items that occur on the same labelled pages are one class, named by its least item; rules
    need classes. ``n`` and ``b`` count an item's labelled and its bad pages.
    """
    bad = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = cut_lineage(pages.join(bad, pages["page_id"] == bad["doc_id"]).select("items", "bad"), "labelled")
    total, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    least = max(min_rows, min_support * total)
    if blocked < least:
        return None
    counts = rows.select(F.explode("items").alias("item"), "bad").groupBy("item").agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    counts = cut_lineage(counts.filter(F.col("b") >= least), "items")
    words = [r["item"] for r in counts.collect()]
    if not words:
        return None
    baskets = rows.select(_known("items", words).alias("pattern"), "bad")
    patterns = cut_lineage(baskets.groupBy("pattern").agg(F.count("*").alias("rows"), F.sum("bad").alias("bad")), "baskets")
    vocabulary = cut_lineage(_classes(patterns, counts), "classes")
    classes = cut_lineage(vocabulary.groupBy("class").agg(F.any_value("n").alias("n"), F.any_value("b").alias("b")), "kinds")
    telling = F.col("b") >= min_confidence * F.col("n")
    alone = classes.filter(telling).select(F.array("class").alias("needs"), (F.col("b") / F.col("n")).alias("confidence"))
    names = [r["class"] for r in classes.filter(~telling & (F.col("n") < total)).select("class").collect()]
    if not names:
        return vocabulary, cut_lineage(alone, "rules")

    frequent = baskets.filter("bad = 1").select(_known("pattern", names).alias("items"))
    # Half a row less, so that rounding cannot raise the least count.
    model = FPGrowth(itemsCol="items", minSupport=(math.ceil(least) - 0.5) / blocked).fit(frequent)
    sets = cut_lineage(model.freqItemsets.select(F.array_sort("items").alias("needs"), F.col("freq").alias("b")), "sets")
    good = patterns.filter("rows > bad").select(_known("pattern", names).alias("pattern"), (F.col("rows") - F.col("bad")).alias("good"))
    against = _fitting(good, sets.select("needs"), vocabulary).groupBy("needs").agg(F.sum("good").alias("good"))
    confidence = F.col("b") / (F.col("b") + F.coalesce("good", F.lit(0)))
    rules = sets.join(against, "needs", "left").select("needs", confidence.alias("confidence"))
    return vocabulary, cut_lineage(alone.union(rules.filter(F.col("confidence") >= min_confidence)), "rules")


def _known(items: str, words: list[str]) -> Column:
    return F.array_sort(F.filter(items, lambda i: i.isin(words)))


def _classes(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` with the least item that occurs in the same rows of ``patterns``."""
    other = counts.select(F.col("item").alias("class"), F.col("n").alias("others"))
    pairs = patterns.select("rows", "pattern", F.explode("pattern").alias("item"))
    pairs = pairs.select("rows", "item", F.explode("pattern").alias("class")).filter("class <= item")
    together = pairs.groupBy("item", "class").agg(F.sum("rows").alias("both"))
    same = together.join(counts, "item").join(other, "class").filter("both = n AND both = others")
    return same.groupBy("item", "n", "b").agg(F.min("class").alias("class"))


def _fitting(patterns: DataFrame, sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``patterns`` with each of the ``sets`` whose ``needs`` they have: each is looked up under its rarest item."""
    rarest = sets.withColumn("item", F.explode("needs")).join(counts.select("item", "n"), "item")
    rarest = rarest.groupBy(*sets.columns).agg(F.min(F.struct("n", "item"))["item"].alias("item"))
    met = patterns.withColumn("item", F.explode("pattern")).join(rarest, "item").drop("item")
    return met.filter(F.size(F.array_except("needs", "pattern")) == 0)


def mine_rules(pages: DataFrame, labels: DataFrame, **limits) -> tuple[list[str], DataFrame | None]:
    """Names of the classes of items, and rules ``(needs, confidence)`` on them that lead to block; None if nothing is frequent.

    The rules block what all confident sets would block: every other confident set has a rule in it.

    ``pages`` has ``page_id, items``, ``labels`` has ``doc_id, bad``. Support counts labelled pages
    with the items and a bad label, as a share of all labelled pages, and at least ``min_rows``.
    """
    mined = _mine(pages, labels, **limits)
    if mined is None:
        return [], None
    return sorted(r["class"] for r in mined[0].select("class").distinct().collect()), mined[1]


def match_rules(patterns: DataFrame, rules: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Best rule of each pattern of items that has one: ``(items, method_rule)``, told in the pattern's own items."""
    own = patterns.select("items", F.explode("items").alias("item")).join(vocabulary, "item")
    own = own.groupBy("items", "class").agg(F.min("item").alias("item")).groupBy("items")
    own = own.agg(F.array_sort(F.collect_list("class")).alias("pattern"), F.map_from_entries(F.collect_list(F.struct("class", "item"))).alias("own"))
    best = F.max(F.struct("confidence", "needs"))["needs"]
    best = _fitting(own, rules, vocabulary).groupBy("items").agg(best.alias("needs"), F.any_value("own").alias("own"))
    return best.select("items", F.array_join(F.transform("needs", lambda c: F.col("own")[c]), " & ").alias("method_rule"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url", **limits) -> DataFrame:
    """Every page's ``page_id, host, path, rule, verdict, method_rule``.

    Where a fixed rule fits, the longest decides. Otherwise the mined rules do: block if one
    fits, else allow. A page is bad if its label has ``quality`` 0 or ``toxic`` 1 (null counts as
    good); page ids are looked up as document ids. Null URLs and URLs without ``://`` have an empty
    host and path and no items, so they are allowed. URLs are read whole, however long; a host
    beyond ``HOST_CHARS`` has itself and its legal suffixes as items. Pages that repeat, or have no id, each keep a
    row; with no labels, or none that are bad, only the fixed rules block.
    """
    url = F.col(url_column).cast("string")
    source = pages.select(
        F.col(id_column).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), items(url).alias("items")
    )
    is_bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    mined = _mine(source, labels.select("doc_id", is_bad.alias("bad")), **limits)
    source = source.withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
    if mined is None:
        judged = source.withColumn("method_rule", F.lit(None).cast("string"))
    else:
        vocabulary, rules = mined
        words = [r["item"] for r in vocabulary.select("item").collect()]
        source = cut_lineage(source.withColumn("items", _known("items", words)), "patterns")
        matched = match_rules(source.select("items").distinct(), rules, vocabulary)
        judged = source.join(matched, "items", "left")
    method = F.when(F.col("method_rule").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", method).alias("verdict"),
        "method_rule",
    )

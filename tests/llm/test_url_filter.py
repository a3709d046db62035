"""URL verdicts against plain Python, and mined rules against all item sets."""

import random
from collections import Counter
from itertools import combinations

import pytest

from sensorloom.llm import url_filter as u
from sensorloom.llm.queries import QUERIES

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def fixed(host, path):
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


ODD = [None, "", "no scheme.org/es/", "http://EXAMPLE.org/es/x", "x://a.example.org/en/1?q", "s://org", "s://org/#", "s://notorg/",
       "http://a.com/de/", "http://a.com/fr/?x://b.org/", "://", "a://b://c/d", "http://É.com\n/de/\nx", "http://com/fr", "http://x.comm/de/"]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, x, "y") for i, x in enumerate(ODD)] + [(None, ODD[3], "y"), (3, ODD[3], "y")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = u.judge_urls(pages, labels).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        url = ODD[3] if r.page_id is None else ODD[r.page_id]
        host, path = parts(url)
        rule = fixed(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1], rule[0] if rule else "allow"), url
    assert u.judge_urls(pages.limit(0), labels).collect() == []


def brute_rules(baskets, least, confidence):
    sets = Counter()
    bad = Counter()
    for items, is_bad in baskets:
        for k in range(1, len(items) + 1):
            for some in combinations(sorted(items), k):
                sets[some] += 1
                bad[some] += is_bad
    return {s for s in sets if bad[s] >= least and bad[s] >= confidence * sets[s]}


def test_rules_equal_all_item_sets(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        sub, seg, name = rng.choice(["m", "www", "ads"]), rng.choice(["fr", "win", "x"]), rng.choice(["page", "id"])
        bad = rng.random() < (0.95 if sub == "ads" and seg == "win" else 0.1)
        rows.append((i, f"http://{sub}.site.net/{seg}/{i}?{name}=1", int(bad)))
    rows += [(i, None, 1) for i in range(600, 605)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], 1 - r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    split = pages.select("page_id", u.items(u.F.col("url")).alias("items"))
    words, rules = u.mine_rules(split, labels.select("doc_id", (u.F.col("quality") == 0).alias("bad")))
    baskets = [([w for w in r["items"] if w in words], rows[r.page_id][2]) for r in split.collect()]
    want = brute_rules(baskets, max(u.MIN_ROWS, u.MIN_SUPPORT * len(rows)), u.MIN_CONFIDENCE)
    got = {tuple(r.needs) for r in rules.collect()}
    # Confident sets, one inside each of all of them; with items that are on all pages left out.
    assert got <= want and want
    assert all(any(set(mine) <= set(rule) for mine in got) for rule in want)
    by_page = {r["page_id"]: set(r["items"]) for r in split.collect()}
    for r in u.judge_urls(pages, labels).collect():
        hit = any(set(rule) <= by_page[r.page_id] for rule in want)
        assert r.verdict == ("block" if hit else "allow") and (r.method_rule is not None) == hit


def judged(spark, urls, bad):
    """Pages, split pages and labels of these URLs; those beyond the labels have none."""
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    return pages, labels


def test_every_bad_host_is_found(spark):
    bad = [f"http://w{h}x.bad{h}y.net/h{h}z/{i}" for h in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN" for i in range(12)]
    good = [f"http://www.good.net/p/{i}" for i in range(1500)]
    # Without labels: each has one item of the many that always occur together.
    more = ["http://new.badqy.net/", "http://wqx.other.net/", "http://new.org/hqz", "http://new.org/h"]
    pages, labels = judged(spark, bad + good + more, [1] * len(bad) + [0] * len(good))
    got = {r.page_id: r for r in u.judge_urls(pages, labels).select("page_id", "rule", "method_rule").collect()}
    assert all(got[i].method_rule for i in range(len(bad)))
    assert not any(got[i].method_rule for i in range(len(bad), len(bad) + len(good)))
    last = [got[len(bad) + len(good) + i].method_rule for i in range(4)]
    assert [rule and rule.split(" & ")[0] for rule in last] == ["host:badqy.net", "label:wqx", "path:hqz", None]


def test_items_that_are_bad_only_together(spark):
    kinds = [("ads", "win", 100, 100), ("ads", "x", 400, 0), ("m", "win", 400, 0), ("m", "y", 600, 260)]
    urls, bad = [], []
    for sub, seg, n, b in kinds:
        urls += [f"http://{sub}.site.net/{seg}/{i}" for i in range(n)]
        bad += [int(i < b) for i in range(n)]
    pages, labels = judged(spark, urls, bad)
    for r in u.judge_urls(pages, labels).collect():
        assert (r.verdict == "block") == ("//ads" in urls[r.page_id] and "/win/" in urls[r.page_id])


def test_rules_over_all_items(spark):
    rng = random.Random(8)
    urls, bad = [], []
    for i in range(900):
        k = rng.randrange(30)
        urls.append(f"http://{rng.choice(['m', 'www'])}.site{chr(97 + k % 26)}{k // 26 * 'x'}.net/{rng.choice(['win', 'x'])}/{i}?{rng.choice(['page', 'id'])}=1")
        bad.append(int(rng.random() < (0.9 if k < 20 else 0.05)))
    pages, labels = judged(spark, urls, bad)
    split = {r["page_id"]: set(r["items"]) for r in pages.select("page_id", u.items(u.F.col("url")).alias("items")).collect()}
    want = brute_rules([(split[i], bad[i]) for i in range(900)], u.MIN_ROWS, u.MIN_CONFIDENCE)
    assert len({w for rule in want for w in rule}) > 24
    for r in u.judge_urls(pages, labels).collect():
        assert (r.method_rule is not None) == any(set(rule) <= split[r.page_id] for rule in want)
        assert r.method_rule is None or tuple(sorted(r.method_rule.split(" & "))) in want


def test_many_telling_items_on_the_same_pages(spark):
    """Each bad page has most of 25 names, no two of which are on the same pages."""
    rng = random.Random(9)
    urls, bad = [], []
    for i in range(800):
        bad.append(int(i % 2))
        some = [f"n{chr(97 + k)}" for k in range(25) if rng.random() < 0.95] if bad[-1] else [rng.choice(["page", "id"])]
        urls.append(f"http://www.site.net/{rng.choice(['win', 'x'])}/{i}?" + "&".join(f"{n}=1" for n in some))
    pages, labels = judged(spark, urls, bad)
    for r in u.judge_urls(pages, labels).collect():
        assert r.verdict == ("block" if bad[r.page_id] else "allow")


def test_very_long_urls(spark):
    label = "a" * 60
    long_host = ".".join([label] * 17_000) + ".bad.net"
    urls = [f"http://w{i}.bad.net/p" for i in range(20)] + [f"http://w{i}.good.net/p" for i in range(40)]
    urls += [f"http://{long_host}/p", "http://" + "b" * 1_000_000, "http://good.net/" + "c/" * 500_000, "http://good.net/?" + "d=1&" * 250_000]
    pages, labels = judged(spark, urls, [1] * 20 + [0] * 40)
    got = {r.page_id: r for r in u.judge_urls(pages, labels).collect()}
    assert [got[i].verdict for i in range(60, 64)] == ["block", "allow", "allow", "allow"]
    assert got[60].host == long_host and len(got[61].host) == 1_000_000 and len(got[62].path) == 1_000_001
    held = pages.filter("page_id = 60").select(u.F.col("url"), u.items(u.F.col("url")).alias("i")).first()["i"]
    assert f"host:{long_host}" in held and "host:bad.net" in held and sum(map(len, held)) < 3 * len(long_host)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").collect()}
    got = QUERIES["op3_url_filter"](spark, f"/root/testdata/sf{sf}").collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path = parts(pages[r.page_id])
        rule = fixed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        assert r.verdict == (rule[0] if rule else "block" if r.method_rule else "allow")

"""Personal data: base spans against plain patterns, and what the trees add on planted cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from sensorloom.llm.private_data import _FEATURES, KINDS, _labelled, _weights_from, fit, personal_data, scan
from sensorloom.scratch import cut_lineage

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for n, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in sorted(out))


def check_base(rows, got):
    """Base columns of all rows, and that base spans stay."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want = []
    for i, text in rows:
        told = brute(text)
        kinds = [s.split(":")[0] for s in told.split(",")]
        want.append((i, *[kinds.count(k) for k in KINDS], hashlib.sha256(told.encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    by_hash = {hashlib.sha256(brute(t).encode()).hexdigest(): set(brute(t).split(",")) - {""} for _, t in rows}
    for r in got:
        assert by_hash[r.base_sha256] <= set(r.spans.split(","))
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def card(rng):
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + d for d in "0123456789" if luhn(head + d))


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = "the of and thing stead hein où être größe mañana".split()
    rows = []
    for i in range(n):
        spans = [
            f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com",
            ".".join(str(rng.randint(0, 300)) for _ in range(4)),
            card(rng) if rng.random() < 0.5 else "".join(rng.choice("0123456789") for _ in range(16)),
            f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
            f"{rng.choice(words)} at {rng.choice(words)}.{rng.choice(words)}",
        ]
        body = [rng.choice(words) for _ in range(12)]
        for s in rng.sample(spans, 2):
            body.insert(rng.randint(0, 10), s + " " + rng.choice(words))
        rows.append((i, " ".join(body)))
    return rows


def test_random_marks(spark):
    rng = random.Random(9)
    alphabet = "0123456789" * 2 + "..--++ @()ab\né漢😀"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(9_000 + i, "".join(rng.choice("12.@ -+") for _ in range(40))) for i in range(1500)]
    check_base(rows, personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_adds_what_the_plain_patterns_lose(spark):
    rng = random.Random(4)
    one, two = card(rng), card(rng)
    rows = corpus(2) + [(1000, f"the {one} {two} of"), (1001, "and +1 (826) 555-4081 190.137.223.204 the"), (1002, "nothing of the kind, or 12 34 at all")]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_base(rows, got)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1000] == "card:4:20,card:21:37"
    assert spans[1001] == "phone:4:21,ip:22:37"
    assert spans[1002] == ""


def test_held_out_precision(spark):
    """Trees of one corpus tell base spans from failing look-alikes in another one."""
    model = fit(cut_lineage(_labelled(scan(spark.createDataFrame(corpus(5), "doc_id long, text string")))))
    other = cut_lineage(_labelled(scan(spark.createDataFrame(corpus(6), "doc_id long, text string"))))
    chosen = model.chosen(other).filter("label IS NOT NULL").collect()
    assert len(chosen) > 100 and sum(r.label for r in chosen) >= 0.95 * len(chosen)


def test_odd_rows(spark):
    many = " ".join(f"a{i}@b.cc" for i in range(3_000))
    rows = [(1, None), (1, ""), (None, "a@b.c"), (None, "a@b.c"), (2, "1" * 4_000), (3, "a" * 4_000 + "@b"), (4, "1 " * 2_000), (5, many),
            (6, "a@b.c.@x.y"), (7, "+1 " + " " * 4_000), (8, "1.2.3.4.5.6.7.8"), (9, "漢 a@b.c 😀 1.2.3.4")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, kind int")
    check_base(rows, personal_data(df).collect())
    assert personal_data(df.limit(0)).collect() == []
    assert [r.spans for r in personal_data(df.filter("doc_id = 9")).collect()] == ["email:2:7,ip:10:17"]


def test_long_runs_take_linear_time(spark):
    long = ["1" * 300_000, "a" * 300_000 + "@b", "1 " * 150_000, "+1 " + " " * 300_000, "1." * 150_000 + "x", "a@" * 150_000]
    got = personal_data(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_email, r.n_card, r.n_phone) for r in got} == {i: (0, 0, 0) for i in range(6)}
    assert [r.n_ip for r in got if r.doc_id == 4] == [37_500]


def test_plan_has_no_python(spark):
    plan = personal_data(spark.createDataFrame(corpus(7, 80), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rare_patterns_take_part_however_many_there_are(spark):
    """51,000 frequent patterns of one kind do not keep 300 rare ones of another kind from a threshold."""
    n = F.col("id")
    often = spark.range(102_000).select((n % 51_000).alias("id"), F.lit(0).alias("kind"))
    rare = spark.range(51_000, 51_300).select("id", F.lit(3).alias("kind"))
    rows = often.unionByName(rare).withColumns({f: F.lit(0) for f in _FEATURES if f != "kind"})
    rows = rows.withColumns({"digits": n % 25, "groups": F.floor(n / 25) % 9, "marks": F.floor(n / 225), "plus": n % 2, "label": (n % 2).cast("int")})
    assert set(fit(rows, rounds=2, depth=3).thresholds) == {0, 3}


def test_weights_from_each_score_on(spark):
    rng = random.Random(11)
    rows = [(rng.randint(0, 3), round(rng.random(), 2) if i % 2 else rng.random(), float(rng.randint(1, 9)), rng.randint(0, 1)) for i in range(800)]
    rows += [(0, 1.0, 2.0, 1), (1, 0.0, 3.0, 0)]
    got = _weights_from(spark.createDataFrame(rows, "kind int, score double, weight double, label int")).collect()
    assert sorted({(r[0], r[1]) for r in rows}) == sorted((r["kind"], r["score"]) for r in got)
    for r in got:
        mine = [x for x in rows if x[0] == r["kind"] and x[1] >= r["score"]]
        assert (r["right"], r["all"]) == (sum(x[2] * x[3] for x in mine), sum(x[2] for x in mine))

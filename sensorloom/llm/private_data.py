"""Personal data by candidate spans and boosted trees, in DataFrame operations only.

Fixed patterns find the base spans: e-mail addresses, IP addresses, card and phone numbers. Wider
generators propose further spans, which may overlap the base ones and each other: obfuscated
addresses, numbers that stand next to other numbers, phone numbers without a country code. Each
candidate gets features of its form (digits, groups, checksum, signs) and its context (the
characters around it, words that announce such data, how much base data the document holds).

Boosted trees learn from all candidates whose case is clear: those that are a base span, and those
that fail their kind's check. Equal feature rows are counted first, so training works on patterns
with weights. A kind's threshold is the lowest score from which on, of patterns that the trees
have not seen, at least ``PRECISION`` by weight are base spans; without enough of them nothing of
that kind is added. Of added spans that overlap, the most probable one stays, and none overlaps a
base span.

Texts are read once where they are scanned, and only positions and features leave that task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sensorloom.scratch import cut_lineage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
#: Weight of unseen base patterns that a kind's threshold needs at least.
LEAST_WEIGHT = 10
#: No threshold is below this score: unseen patterns may happen to hold no failing case.
LEAST_SCORE = 0.5
#: Slices of the scores in which a kind's running weights are added up.
SLICES = 1024
ROUNDS = 20
DEPTH = 4

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Each base pattern finds what the plain one in the comment finds. Possessive loops keep the stack
# flat, and a start only where the plain pattern's leftmost match can start keeps the time linear.
_BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20|\.)"
_WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: A short pattern that a text with a match has to match as well.
_NEEDS = {f"b_{k}": "[0-9]" for k in KINDS} | {f"w_{k}": "[0-9]" for k in KINDS}
_NEEDS |= {"b_email": "@", "w_email": r"@|[\x20(\[{](?:at|AT)[\x20)\]}]", "b_phone": r"\+[0-9]", "w_ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:"}
_CUES = {
    "email": "mail|contact|write|kontakt|courriel|correo|schreib",
    "ip": r"\bip\b|host|server|address|adresse|direcci",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|anruf|appel|llama",
}
_OTHER_CUES = r"token|hash|sha|key|version|isbn|order|\bid\b|\bno\b"
_FEATURES = (
    "kind", "digits", "groups", "letters", "marks", "checksum", "large_part", "plus", "brackets", "joined",
    "before", "after", "cue", "other_cue", "base_spans", "alone",
)

_BLOCK = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, where the optimizer would put it into a loop of ``f``."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _part(values: Column, start: Column, n: Column) -> Column:
    """Sum of ``n`` numbers from ``start`` on; by position, as a slice would copy the array."""
    at = F.sequence(start, start + n - 1)
    return F.when(n > 0, F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.get(values, i), F.lit(0)))).otherwise(0)


def _blocks(values: Column) -> Column:
    """Sums of blocks of ``_BLOCK`` numbers."""
    n = F.size(values)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda b: _part(values, b * _BLOCK, F.lit(_BLOCK)))


def _earlier(values: Column, base: Column | None) -> Column:
    """Sum of all numbers before each one; with the sums before its block, only the block is added up."""
    if base is None:
        return F.transform(values, lambda _, i: _part(values, F.lit(0), i))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    return _let(base, lambda b: F.transform(values, lambda _, i: F.get(b, block(i)) + _part(values, block(i) * _BLOCK, i % _BLOCK)))


def _with_starts(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds, for each array of (gap, hit, ...), the array of the hits' starts as ``<name>_at``.

    Running sums in three levels of blocks, so a text of a million hits costs tens of numbers for each.
    """
    each = lambda f: {f"_{n}_{f.__name__}": f(n) for n in names}

    def steps(n):
        hit = lambda all_, i: F.when(i > 0, F.coalesce(F.length(F.get(all_, i - 1)["hit"]), F.lit(0))).otherwise(0)
        return _let(F.col(n), lambda all_: F.transform(all_, lambda x, i: x["gap"] + hit(all_, i)))

    def mid(n):
        return _blocks(F.col(f"_{n}_steps"))

    def top(n):
        return _blocks(F.col(f"_{n}_mid"))

    def top_base(n):
        return _earlier(F.col(f"_{n}_top"), None)

    def mid_base(n):
        return _earlier(F.col(f"_{n}_mid"), F.col(f"_{n}_top_base"))

    def at(n):
        return _earlier(F.col(f"_{n}_steps"), F.col(f"_{n}_mid_base"))

    for level in (steps, mid, top, top_base, mid_base, at):
        df = df.withColumns(each(level))
    return df.select("*", *[F.zip_with(f"_{n}_at", f"_{n}_steps", lambda a, s: a + s).alias(f"{n}_at") for n in names])


def _cut(pattern: str, needs: str) -> Column:
    """Text around and in each match: ``gap, hit, head, tail`` of every piece between matches, the last one without a hit.

    Null where nothing matches: most texts lack what the pattern ``needs`` and are searched for that alone.
    """
    text = F.col("text")
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(
        F.arrays_zip(pieces.alias("piece"), hits.alias("hit")),
        lambda x: F.struct(
            F.length(x["piece"]).cast("long").alias("gap"),
            x["hit"].alias("hit"),
            F.substring(x["piece"], 1, 2).alias("head"),
            F.right(x["piece"], F.lit(40)).alias("tail"),
        ),
    )
    return F.when(text.rlike(needs) & text.rlike(pattern), found)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def checksum_holds(digits: Column) -> Column:
    """Luhn's checksum of at most 20 digits."""
    each = F.transform(
        F.split(F.lpad(digits, 20, "0"), ""),
        lambda c, i: F.when(i % 2 == 0, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("long"),
    )
    return _sum(each) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """Whether a match of a kind's pattern passes the kind's check."""
    n = F.length(_digits(hit))
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(14, 19) & checksum_holds(_digits(hit))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _char_class(c: Column) -> Column:
    """0 for none or a blank, 1 a letter, 2 a digit, 3 a mark."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 1).otherwise(3)


def _base(kind: str, name: str) -> Column:
    number = F.lit(KINDS.index(kind)).alias("kind")
    spans = F.zip_with(name, f"{name}_at", lambda x, at: F.struct(at.alias("start"), x["hit"].alias("hit")))
    kept = F.filter(spans, lambda x: x["hit"].isNotNull() & _valid(kind, x["hit"]))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), number, (x["start"] + F.length(x["hit"])).alias("end")))


def _candidates(kind: str, name: str) -> Column:
    """Proposed spans with their features and, where the case is clear, a label."""
    number = KINDS.index(kind)
    pieces = F.zip_with(name, f"{name}_at", lambda x, at: F.struct(at.alias("start"), x["hit"].alias("hit"), x["tail"].alias("tail"), x["head"].alias("head")))
    spans = _let(
        pieces,
        lambda all_: F.transform(
            all_,
            lambda x, i: F.struct(
                x["start"].alias("start"),
                (x["start"] + F.length(x["hit"])).alias("end"),
                x["hit"].alias("hit"),
                _digits(x["hit"]).alias("number"),
                x["tail"].alias("tail"),
                F.coalesce(F.get(all_, i + 1)["head"], F.lit("")).alias("head"),
            ),
        ),
    )

    def describe(x: Column) -> Column:
        hit, n = x["hit"], F.length(x["number"])
        flag = lambda c: c.cast("int")
        word_at = F.when(hit.contains("@") & ~hit.contains(" "), 0).when(hit.rlike(r"[(\[{@]"), 1).otherwise(2) if kind == "email" else F.lit(0)
        large = flag(~_valid("ip", hit)) if kind == "ip" else F.lit(0)
        sums = flag(F.when(n <= 20, checksum_holds(x["number"])).otherwise(False)) if kind == "card" else F.lit(0)
        failed = {"email": word_at == 2, "ip": hit.contains(".") & (large == 1), "card": sums == 0, "phone": ~n.between(10, 15)}[kind]
        before, after = F.right(x["tail"], F.lit(1)), F.substring(x["head"], 1, 1)
        tail = F.lower(x["tail"])
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.lit(number).alias("kind"),
            F.least(n, F.lit(25)).alias("digits"),
            F.least(F.size(F.split(hit, "[0-9]+", -1)) - 1, F.lit(9)).alias("groups"),
            flag(hit.rlike("[A-Za-z]")).alias("letters"),
            F.least(F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), F.lit(9)).alias("marks"),
            sums.alias("checksum"),
            large.alias("large_part"),
            flag(hit.startswith("+")).alias("plus"),
            flag(hit.contains("(")).alias("brackets"),
            word_at.alias("joined"),
            _char_class(before).alias("before"),
            _char_class(after).alias("after"),
            flag(tail.rlike(_CUES[kind])).alias("cue"),
            flag(tail.rlike(_OTHER_CUES)).alias("other_cue"),
            flag(before.isin("", "\n") & after.isin("", "\n")).alias("alone"),
            failed.alias("failed"),
        )

    return F.transform(F.filter(spans, lambda x: x["hit"].isNotNull()), describe)


def _together(lists: list[Column]) -> Column:
    return F.flatten(F.filter(F.array(*lists), lambda one: one.isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, candidates`` for every row of ``doc_id, text``; a written table without the texts."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    cuts = {f"b_{k}": p for k, p in _BASE.items()} | {f"w_{k}": p for k, p in _WIDE.items()}
    rows = rows.select("row", "doc_id", *[_cut(p, _NEEDS[n]).alias(n) for n, p in cuts.items()])
    rows = _with_starts(rows, list(cuts))
    found = rows.select(
        "row",
        "doc_id",
        F.array_sort(_together([_base(k, f"b_{k}") for k in KINDS])).alias("base"),
        _together([_candidates(k, f"w_{k}") for k in KINDS]).alias("candidates"),
    )
    return cut_lineage(found, "spans")


@dataclass
class SpanModel:
    """Fitted trees and the score from which on a kind's candidates are added; a kind may have none."""

    trees: object
    thresholds: dict[int, float]

    def chosen(self, candidates: DataFrame) -> DataFrame:
        """The candidates that reach their kind's threshold, with ``score``."""
        least = F.lit(None).cast("double")
        for kind, score in self.thresholds.items():
            least = F.when(F.col("kind") == kind, score).otherwise(least)
        return _scored(self.trees, candidates).filter(F.col("score") >= least)


def _scored(trees, rows: DataFrame) -> DataFrame:
    features = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(rows)
    scored = trees.transform(features).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(*rows.columns, "score")


def _weights_from(scored: DataFrame) -> DataFrame:
    """``kind, score, right, all``: the weight of base patterns and of all patterns from each score on.

    Weights are added up within slices of the scores, then those of the slices above, so that no
    task takes all patterns of a kind.
    """
    each = scored.groupBy("kind", "score").agg(F.sum(F.col("weight") * F.col("label")).alias("right"), F.sum("weight").alias("all"))
    each = cut_lineage(each.withColumn("slice", F.floor(F.col("score") * SLICES)), "scores")
    # A row per kind and slice.
    above = W.partitionBy("kind").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    slices = each.groupBy("kind", "slice").agg(F.sum("right").alias("_right"), F.sum("all").alias("_all"))
    slices = slices.select("kind", "slice", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0.0)).alias(f"{c}_above") for c in ("right", "all")])
    down = W.partitionBy("kind", "slice").orderBy(F.desc("score"))
    return each.join(slices, ["kind", "slice"]).select(
        "kind", "score", *[(F.sum(c).over(down) + F.col(f"{c}_above")).alias(c) for c in ("right", "all")]
    )


def fit(candidates: DataFrame, precision: float = PRECISION, rounds: int = ROUNDS, depth: int = DEPTH) -> SpanModel | None:
    """Trees and thresholds from rows of features and ``label`` (0, 1 or null); nothing without both labels."""
    known = candidates.filter("label IS NOT NULL").groupBy(*_FEATURES, "label").agg(F.count("*").cast("double").alias("weight"))
    counted = cut_lineage(known, "patterns")
    if counted.select("label").distinct().count() < 2:
        return None
    counted = counted.withColumn("unseen", F.pmod(F.xxhash64(*_FEATURES, "label"), F.lit(3)) == 0)
    vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features")
    seen = counted.filter("NOT unseen")
    if seen.select("label").distinct().count() < 2:
        seen = counted
    gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=1)
    trees = gbt.fit(vectors.transform(seen.withColumn("label", F.col("label").cast("double"))))
    held = _weights_from(_scored(trees, counted.filter("unseen")))
    enough = (F.col("right") >= precision * F.col("all")) & (F.col("right") >= LEAST_WEIGHT)
    good = held.filter(enough & (F.col("score") >= LEAST_SCORE))
    return SpanModel(trees, {r["kind"]: r["least"] for r in good.groupBy("kind").agg(F.min("score").alias("least")).collect()})


def _labelled(spans: DataFrame) -> DataFrame:
    """A row per candidate: features, whether it is a base span (label 1) or fails its check (label 0)."""
    shown = spans.withColumn("base_spans", F.least(F.size("base"), F.lit(5))).filter(F.size("candidates") > 0)
    each = shown.select("row", "base_spans", F.explode("candidates").alias("c")).select("row", "base_spans", "c.*")
    base = spans.select("row", F.explode("base").alias("b")).select("row", "b.*", F.lit(True).alias("is_base"))
    met = each.join(base, ["row", "kind", "start", "end"], "left")
    # A base span counts itself no context.
    return met.select(
        "row", "start", "end", *[f for f in _FEATURES if f != "base_spans"],
        (F.col("base_spans") - F.when(F.col("is_base"), 1).otherwise(0)).alias("base_spans"),
        F.when(F.col("is_base"), 1).when(F.col("failed"), 0).alias("label"),
    )


def _added(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """``row, added``: chosen candidates that overlap no base span, the most probable of those that overlap each other."""
    base = spans.select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", "b.kind", F.lit(2.0).alias("score"))
    both = base.unionByName(chosen.select("row", "start", "end", "kind", "score"))
    order = W.partitionBy("row").orderBy("start", F.desc("end"), "kind", F.desc("score"))
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    grouped = both.withColumn("opens", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    grouped = grouped.withColumn("together", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    best = W.partitionBy("row", "together").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "kind", "start")
    first = grouped.withColumn("place", F.row_number().over(best)).filter("place = 1 AND score <= 1")
    return first.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(number: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == number))


def personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Spans of personal data in every row of ``doc_id, text``.

    Returns ``doc_id``, the numbers of base spans ``n_email, n_ip, n_card, n_phone``,
    ``base_sha256`` over the base spans as ``kind:start:end`` (code points, end exclusive, by start
    and kind, comma-joined), and ``spans``, the same text of base and added spans.

    Null texts are empty; a text without spans has an empty ``spans``. Rows that repeat an id, or
    have a null one, are documents of their own. An empty table gives no rows. Without clear
    cases of both kinds nothing is added. Further columns, of whatever name, are not read.
    """
    spans = scan(docs.select("doc_id", "text"))
    candidates = cut_lineage(_labelled(spans), "candidates")
    model = fit(candidates, precision)
    counts = [_of_kind(n).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    nothing = F.slice("base", 1, 0)
    if model is None or not model.thresholds:
        joined = spans.withColumn("added", nothing)
    else:
        joined = spans.join(_added(spans, model.chosen(candidates)), "row", "left")
    everything = F.array_sort(F.concat("base", F.coalesce("added", nothing)))
    return joined.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(everything).alias("spans"))

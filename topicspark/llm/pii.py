"""Personal data by candidate gradient boosting, in DataFrame expressions and Spark's own boosted trees.

1. Base spans: emails, IP addresses, card and phone numbers by one pattern each and a test of what it finds (parts of at
   most 255, Luhn, number of digits). They are all redacted.
2. Generators of high recall propose more spans, which may overlap: the same kinds in looser forms (`at` and `dot` spelled
   out, marks in brackets, other separators, no plus sign).
3. Boosted trees score each candidate by its format (digits, runs, separators, Luhn, parts) and its context (neighbouring
   characters, key words, share of digits around). They learn from all texts: base spans, and the same spans rewritten in looser forms
   inside their own texts, are positive; all else that the generators propose there is negative. The learned trees are
   then one expression, so texts are scored without leaving the plan.
4. For each kind the threshold is calibrated on left-out documents: it lies below the least margin from which on the share
   of true candidates is at least `precision`, halfway to the next one. A kind without such a margin adds nothing.
5. Candidates that overlap a base span go; of those that overlap each other the best stays.

Matches of a pattern are cut out together with the pieces between them; their places are running sums over the pieces,
one small row per match, so a text with very many of them costs no more than their number. Rows get a number of their
own, so `docs` must give the same rows in the same order whenever it is read, as a table does.

Null texts are empty; texts without any span have no spans and the digest of nothing; null and repeated doc_ids are
rows like others; ties of score go to the longer span, then to the kind listed first. An empty table gives no rows, and
texts without any candidate add nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, PRECISION, LEAST_EVIDENCE = 20, 3, 0.99, 10
CONTEXT = 24

# Quantifiers that never give back and looks behind: what these patterns find is what the plain ones find, in one pass.
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SIGN, _MARK = r"(?:@| ?[\[(] ?(?:at|@) ?[\])] ?)", r"(?:\.| ?[\[(] ?(?:dot|\.) ?[\])] ?| dot )"
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:{_SIGN}{_HOST}++(?:{_MARK}{_HOST}++)++| at {_HOST}++(?: dot {_HOST}++)++)",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:{_MARK}| ?, ?|:)[0-9]{{1,3}}+){{3}}+(?![0-9])",
    "card": r"[0-9](?:[ ._/-]{0,2}+[0-9]){12,18}+",
    "phone": r"(?:\+|00)?+\(?+[0-9](?:[ ().\/-]{0,3}+[0-9]){8,14}+",
}
#: Looser forms of base spans, to learn from: pattern and replacement.
REWRITES = {
    "email": [(rf"({_LOCAL}++)@({_HOST}++)\.({_HOST}++)\.({_HOST}++)", "$1 at $2 dot $3 dot $4"), (rf"({_LOCAL}++)@({_HOST}++)\.({_HOST}++)", "$1 [at] $2 [dot] $3")],
    "ip": [(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)", "$1[.]$2[.]$3[.]$4")],
    "card": [(r"(?<![0-9])([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})(?![0-9])", "$1.$2.$3.$4")],
    "phone": [(r"\+([0-9]{1,3}) \(([0-9]{2,4})\) ([0-9]{3,4})-([0-9]{3,4})", "$1 $2 $3 $4")],
}
WORDS = {
    "call": r"(?i)\b(?:tel|phone|call|fax|mobile?|handy|telefon[oe]?|appel)", "pay": r"(?i)\b(?:card|visa|credit|carte|tarjeta|karte|pay)",
    "net": r"(?i)\b(?:ip|host|server|addr|node|adresse)", "mail": r"(?i)(?:mail|contact|kontakt|correo|write)",
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes; only looked at for 13 to 19 digits."""
    figures = F.split(F.reverse(number), "")
    doubled = F.transform(figures, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def card_like(text: Column) -> Column:
    number = digits(text)
    return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)


def small_parts(text: Column) -> Column:
    """Four parts, none above 255."""
    return text.rlike(r"^" + r"[^0-9]++".join([r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"] * 4) + "$")


def holds(kind: Column, text: Column) -> Column:
    """The test of a base match."""
    number = F.length(digits(text))
    return F.when(kind == "ip", small_parts(text)).when(kind == "card", card_like(text)).when(kind == "phone", number.between(9, 15)).otherwise(True)


def _matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """An array of the matches: kind, base, place, step (from the end of the match before to this one's start, plus that
    match), match, and the text on both sides."""

    def of(found: Column, pieces: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap = F.get(pieces, i)
            step = F.length(gap) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("place"), step.cast("long").alias("step"), m.alias("match"),
                F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(pieces, i + 1), 1, CONTEXT).alias("after"),
            )

        return F.transform(found, one)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: of(m, p))))


def matches(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, keep..., kind, base, start, end, match, before, after) of all base matches that pass and all candidates.

    A text without any match has a row of nulls, and so has each match that fails. All of a text lie in one partition, by `row`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    every = [_matches(F.col("_t"), k, p, base) for base, patterns in ((True, BASE), (False, LOOSE)) for k, p in patterns.items()]
    none = F.array().cast("array<struct<kind:string,base:boolean,place:int,step:bigint,match:string,before:string,after:string>>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, text.alias("_t"))
    rows = rows.select("row", *keep, F.explode_outer(F.concat(*(F.coalesce(e, none) for e in every))).alias("m")).select("row", *keep, "m.*")
    along = Window.partitionBy("row", "kind", "base").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.repartition("row").withColumn("start", F.sum("step").over(along))
    # a match that does not pass stays as a row of nulls: its text may have no other
    placed = placed.withColumn("end", F.col("start") + F.length("match"))
    passed = ~F.col("base") | holds(F.col("kind"), F.col("match"))
    columns = ("kind", "base", "start", "end", "match", "before", "after")
    return placed.withColumn("_ok", passed).select("row", *keep, *(F.when(F.col("_ok"), F.col(c)).alias(c) for c in columns))


def _with_overlap(found: DataFrame) -> DataFrame:
    """Each row with `hit`: whether it overlaps a base span of its text."""
    spans = F.col("base")
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    covered = F.max(F.when(spans, F.col("end"))).over(upto) > F.col("start")
    meets = F.min(F.when(spans, F.col("start"))).over(onward) < F.col("end")
    return found.withColumn("hit", F.coalesce(covered, F.lit(False)) | F.coalesce(meets, F.lit(False)))


# features


def features() -> dict[str, Column]:
    """Numbers about a candidate, from its kind, match and context."""
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    number = digits(m)
    runs = F.array_remove(F.split(m, "[^0-9]+"), "")
    count = lambda mark: F.length(m) - F.length(F.replace(m, F.lit(mark), F.lit("")))
    last, next_ = F.substring(before, -1, 1), F.substring(after, 1, 1)
    share = lambda x: F.length(digits(x)) / F.greatest(F.length(x), F.lit(1))
    out = {f"is_{k}": F.col("kind") == k for k in KINDS}
    out |= {
        "size": F.length(m), "digits": F.length(number), "runs": F.size(runs), "longest": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)),
        "head": F.coalesce(F.length(F.get(runs, 0)), F.lit(0)), "tail": F.coalesce(F.length(F.element_at(F.when(F.size(runs) > 0, runs), -1)), F.lit(0)),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "dots": count("."), "dashes": count("-"), "blanks": count(" "), "brackets": count("(") + count("["),
        "at": m.contains("@"), "luhn": card_like(m), "parts": small_parts(m), "first": F.coalesce(F.substring(number, 1, 1).try_cast("int"), F.lit(-1)),
        "spelled": m.rlike(r"(?:\bat\b|[\[(]at[\])]).*(?:\bdot\b|[\[(]dot[\])])"),
        "after_letter": last.rlike("[\\p{L}_]"), "after_digit": last.rlike("[0-9]"), "after_mark": last.rlike("[^\\p{L}0-9\\s]"),
        "to_letter": next_.rlike("[\\p{L}_]"), "to_digit": next_.rlike("[0-9]"), "to_mark": next_.rlike("[^\\p{L}0-9\\s]"),
        "digits_before": share(before), "digits_after": share(after),
    }
    out |= {f"word_{k}": before.rlike(p) for k, p in WORDS.items()}
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def canonical(kind: Column, text: Column) -> Column:
    """What a span says, in whatever form."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), rf"{_SIGN}| at ", "@"), _MARK, ".")
    return F.concat(kind, F.lit(":"), F.when(kind == "email", plain).when(kind == "ip", F.regexp_replace(text, "[^0-9]+", ".")).otherwise(digits(text)))


# the model


@dataclass(frozen=True)
class Redactor:
    """trees: (weight, tree); a tree is a leaf's value or (feature, threshold, left, right). thresholds: margin by kind."""

    trees: tuple = ()
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, columns: dict[str, Column]) -> Column:
        def value(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, cut, left, right = tree
            return F.when(columns[name] <= F.lit(cut), value(left)).otherwise(value(right))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * value(tree)
        return total

    def passes(self, margin: Column) -> Column:
        out = F.lit(False)
        for kind, cut in self.thresholds.items():
            out = out | ((F.col("kind") == kind) & (margin >= F.lit(cut)))
        return out


def examples(docs: DataFrame) -> DataFrame:
    """Candidates of all texts and of these texts rewritten: fold, kind, label and the features.

    All texts are matched once; a rewritten text that differs is matched beside its own, and one that does not counts twice.
    """
    draw = F.xxhash64(F.lit(23), "doc_id", "text")
    apart = F.pmod(draw, F.lit(1 << 40)) % 3 == 0
    rows = docs.where(F.col("text").isNotNull()).select("text", draw.alias("_draw"), apart.alias("apart"))
    loose = F.col("text")
    for pattern, form in (r for k in KINDS for r in REWRITES[k]):
        loose = F.regexp_replace(loose, pattern, form)

    def version(text: Column, times: int, plain: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(times).alias("times"), F.lit(plain).alias("plain"))

    own = F.col("text")
    versions = let(loose, lambda t: F.when(t == own, F.array(version(own, 2, True))).otherwise(F.array(version(own, 1, True), version(t, 1, False))))
    read = rows.select("_draw", "apart", F.explode_outer(versions).alias("_version")).select("_draw", "apart", "_version.*")
    keep = ("_draw", "apart", "times", "plain")
    found = stored(matches(read, *keep).where("kind IS NOT NULL").drop("row", "start", "end"), "pii-found")
    known = found.where("base AND plain").groupBy("_draw").agg(F.collect_set(canonical(F.col("kind"), F.col("match"))).alias("known"))
    both = found.where("NOT base").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times")))).join(known, "_draw", "left")
    label = F.coalesce(F.array_contains("known", canonical(F.col("kind"), F.col("match"))), F.lit(False))
    return both.select("apart", "kind", label.cast("double").alias("label"), *(c.alias(n) for n, c in features().items()))


def fit(docs: DataFrame, precision: float = PRECISION, least: int = LEAST_EVIDENCE) -> Redactor:
    """Trees and thresholds from all texts; a third of them is left out of the trees and calibrates."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = stored(examples(docs), "pii-examples")
    names = list(features())
    learn = VectorAssembler(inputCols=names, outputCol="features").transform(rows.where("NOT apart")).select("label", "features")
    kinds = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Redactor()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(learn)

    def tree(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        split = node.split()
        return names[split.featureIndex()], split.threshold(), tree(node.leftChild()), tree(node.rightChild())

    trees = tuple((float(w), tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees))
    scorer = Redactor(trees)
    margins = rows.where("apart").select("kind", "label", F.round(scorer.margin({n: F.col(n) for n in names}), 2).alias("margin"))
    bins = margins.groupBy("kind", "margin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # few: rounded
    cuts = {}
    for kind in KINDS:
        good = n = 0
        held = sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["margin"])
        for r, below in zip(held, [*(x["margin"] for x in held[1:]), 0.0]):
            good, n = good + r["good"], n + r["n"]
            if n >= least and good >= precision * n:
                # halfway to what comes next, or to an even chance
                cuts[kind] = (r["margin"] + min(max(below, 0.0), r["margin"])) / 2
    return Redactor(trees, cuts)


# results


def spans(docs: DataFrame, model: Redactor) -> DataFrame:
    """(row, doc_id, kind, base, start, end, score) of every redaction; a text has rows of nulls besides, one at least if it has none."""
    found = _with_overlap(matches(docs, "doc_id"))
    margin = F.when(~F.col("base") & ~F.col("hit"), model.margin(features()))
    scored = found.withColumn("score", margin)
    taken = scored.withColumn("taken", F.col("base") | F.coalesce(model.passes(F.col("score")), F.lit(False)))
    added = F.col("taken") & ~F.col("base")
    along = Window.partitionBy("row").orderBy("start", "end", "kind", F.desc("base"))
    reach = F.max(F.when(added, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    taken = taken.withColumn("_new", F.when(added & (F.coalesce(reach, F.lit(-1)) <= F.col("start")), 1).otherwise(0))
    taken = taken.withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = Window.partitionBy("row", "_island", "base").orderBy(
        F.desc("taken"), F.desc("score"), F.desc(F.col("end") - F.col("start")), order, "start"
    )
    taken = taken.withColumn("_rank", F.when(~F.col("base"), F.row_number().over(best)))
    keep = F.col("taken") & (F.col("base") | (F.col("_rank") == 1))
    blank = lambda c: F.when(keep, F.col(c)).alias(c)
    return taken.select("row", "doc_id", *(blank(c) for c in ("kind", "base", "start", "end", "score")))


def report(docs: DataFrame, model: Redactor) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.when(F.col("kind").isNotNull(), F.struct(order.alias("order"), "start", "end", "kind", "base"))
    held = spans(docs, model).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_set(entry)).alias("spans"))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return held.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: Redactor, mask: str = "<{}>") -> DataFrame:
    """(doc_id, text) of every row with each span replaced by its kind; overlapping spans become one, named by the first."""
    rows = docs.select("doc_id", "text")
    told = spans(rows, model).where("kind IS NOT NULL").select("row", "kind", "start", "end")
    along = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("_new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    told = told.withColumn("_part", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    part = told.groupBy("row", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"))).alias("kind"))
    held = part.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).join(held, "row", "left")
    prefix, suffix = mask.split("{}")

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.get(F.col("spans"), i - 1)["end"]).otherwise(0).cast("int")
        return F.concat(F.substring(F.col("text"), begin + 1, s["start"].cast("int") - begin), F.lit(prefix), s["kind"], F.lit(suffix))

    rest = F.substring(F.col("text"), F.element_at("spans", -1)["end"].cast("int") + 1, F.length("text"))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), rest))
    return numbered.select("doc_id", text.alias("text"))

"""Near-duplicate lines, by an exact set-similarity join in DataFrame expressions only.

The lines of a text stand between newlines. A line's words stand between spaces, after lower-casing A-Z; its tokens are
its distinct words, or with `size` above 1 its distinct runs of so many words (all its words as one token if they are
fewer). Of two lines whose token sets have a Jaccard similarity of at least `percent` the later one goes; lines are
ordered by doc_id (null first), row and place in the text. So a line stays if no earlier line is similar to it. Lines
without words always stay.

1. Equal lines are told by 128 bits; all but the first go. From here on they are one line.
2. A count over all words, in hashed bins, gives the tokens' rarity: one order of all tokens, the rarest first. It is a
   table of fixed size that each task holds.
3. Prefix and length filter: two similar lines share a token among the first few of each, by that order, and their sizes
   are of one class or of neighbouring ones. Each line's first tokens go to the place of token and size class.
4. There a semi join keeps the rows that have any partner within the length filter, the positional filter (so many tokens
   as they need to share must be left from the shared one on) and the parity filter (the parities of the tokens' counts
   in 64 hashed bins, 128 or 256 for longer lines, differ in at most as many bins as the lines may differ in tokens; with 64
   alone nearly all lines of over 100 words would stay). It stops at the first partner it
   finds and puts out no pairs. All that follows is on what is left, which is little more than the similar lines.
5. Verification on the words themselves: first with the earliest line at each place, which settles most lines; then what
   is unsettled with all earlier lines of its places.

Copies are left out before step 3 by a broadcast of the lines that have some, up to WANTED of them; if there are more, of
the hot ones: those seen in over 1 / HOT_SHARE of all places, at most HOT_SHARE many. The words of lines to be verified
are fetched by a broadcast of their hashes, up to WANTED of them, beyond that by a join.

A null text stays null and an empty one empty. Rows of the same doc_id and text are one document, and are treated
alike. A text whose lines all go becomes empty. Very long lines are sets like others. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import ascii_lower_word, release, stored, written

SIZE, PERCENT = 1, 80
BINS, CLASSES = 1 << 17, 128
FINE, FINER = 64, 128  # lines of more tokens have parities in 128, in 256 bins
HOT_SHARE, HOT_LEAST = 10_000, 100
WANTED = 500_000
PARITIES = "bits", "half", "third", "fourth"
ROW = ("r1", "r2")
LINE = ("m1", "m2")


def words_of(line: Column) -> Column:
    """The words as they stand; those who compare them lower-case them."""
    return F.array_remove(F.split(line, " "), "")


def lowered(words: Column) -> Column:
    return F.transform(words, ascii_lower_word)


def runs_of(words: Column, size: int) -> Column:
    """The runs of `size` words, joined by blanks; all words as one run if they are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(n >= size, runs).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def with_row(docs: DataFrame, *names: str) -> DataFrame:
    """With two hashes of 64 bits that tell a document by its doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({names[0]: F.xxhash64("doc_id", text), names[1]: F.xxhash64(F.lit(1), text, F.col("doc_id"))})


def place(*prefix: str) -> Column:
    return F.struct(*(F.col(".".join([*prefix, c])).alias(c) for c in ("doc_id", *ROW, "line_no")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, r1, r2, line_no, line, m1, m2) of every line that has a word; m1 and m2 tell lines, to the letter."""
    rows = with_row(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), *ROW)
    lines = rows.select("doc_id", *ROW, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.trim("line") != "")
    return lines.withColumns({"m1": F.xxhash64("line"), "m2": F.xxhash64(F.lit(1), "line")})


def token(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 8)  # room for the rank


def rarity(docs: DataFrame, lines: DataFrame, size: int) -> Column:
    """For each bin of tokens its class by the tokens counted in it, 0 the rarest: an array of fixed length."""
    spark = docs.sparkSession
    if size == 1:  # the words of a whole text at once; all that is lower-cased here beyond A-Z only changes a rarity, not a token
        text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
        words = docs.select(F.explode(F.split(text, " ")).alias("w")).where("w != ''")
    else:
        words = lines.select(lowered(words_of(F.col("line"))).alias("_words")).select(F.explode(runs_of(F.col("_words"), size)).alias("w"))
    counted = words.groupBy((token(F.col("w")) % BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.union(spark.range(BINS).select(F.col("id").alias("bin"), F.lit(0).cast("long").alias("n")))
    sums = whole.groupBy("bin").agg(F.sum("n").alias("n"))
    ranks = sums.select("bin", (F.ntile(CLASSES).over(Window.orderBy("n", "bin")) - 1).alias("rank"))  # BINS rows
    # a constant array, made from one short string
    return F.split(F.lit(",".join(str(r["rank"]) for r in ranks.orderBy("bin").collect())), ",").cast("array<tinyint>")


def ordered_tokens(tokens: Column, ranks: Column) -> Column:
    """Distinct tokens, the rarest first: each with its rank in the high bits."""
    return F.sort_array(F.transform(tokens, lambda t: F.shiftleft(F.get(ranks, t.bitwiseAND(F.lit(BINS - 1)).cast("int")).cast("long"), 56).bitwiseOR(t)))


def _bit(t: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftright(t, 20) % 64).cast("int"))


def prefixes(lines: DataFrame, size: int, percent: int, ranks: Column) -> DataFrame:
    """(key, m1, meta, bits, half, third, fourth) of the first tokens of each line, by token and size class.

    kind 0: at the line's own class, so many tokens as a partner of any size may need. kind 1: at the class above, for
    larger partners only. meta holds size, place of the token and kind. Keys are hashes: more may meet there, none is lost.
    The tokens are dealt to four parts. bits are the parities of all of them; half those of the second and the fourth part, for lines of
    over FINE tokens; third and fourth those of one part, for lines of over FINER: with these, lines of any two lengths can be compared.
    """
    width = math.log(104 / percent)  # sizes of similar lines are at most one class apart, whatever the rounding

    def need(n: Column, m: Column) -> Column:
        return F.ceil((n + m) * percent / (100 + percent)).cast("int")

    if size == 1:
        plain = F.array_distinct(F.transform(words_of(F.col("line")), lambda w: token(ascii_lower_word(w))))
    else:
        lines = lines.withColumn("words", lowered(words_of(F.col("line"))))
        plain = F.array_distinct(F.transform(runs_of(F.col("words"), size), token))
    sets = lines.select("m1", plain.alias("plain"))
    parity = F.aggregate("plain", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(_bit(t)))

    def parity_of(mask: int, part: int) -> Column:
        held = F.filter("plain", lambda t: F.shiftright(t, 30).bitwiseAND(F.lit(mask)) == part)
        return F.aggregate(held, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(_bit(t)))

    finer = [(FINE, 1, 1, "half"), (FINER, 3, 2, "third"), (FINER, 3, 3, "fourth")]
    finer = [F.when(F.size("plain") > least, parity_of(mask, part)).alias(name) for least, mask, part, name in finer]
    sets = sets.select("m1", ordered_tokens(F.col("plain"), ranks).alias("tokens"), F.size("plain").alias("n"), parity.alias("bits"), *finer)
    n = F.col("n")
    sets = sets.withColumn("class", F.floor(F.log(n.cast("double")) / width).cast("int"))
    bound = lambda c: F.floor(F.exp(c * width) - 0.001).cast("int")  # noqa: E731  no size of the class is smaller
    above = F.greatest(bound(F.col("class") + 1), n)
    own = n - F.ceil(n * percent / 100).cast("int") + 1
    beyond = F.when(100 * n >= percent * above, F.greatest(n - need(n, above) + 1, F.lit(0))).otherwise(0)
    sets = sets.withColumns({"own": own, "beyond": beyond, "head": F.shiftleft(n.cast("long"), 32)})
    sets = sets.withColumns({f"salt{k}": F.xxhash64(F.col("class") + k) for k in (0, 1)})

    def spots(length: str, kind: int) -> Column:
        def one(t: Column, i: Column) -> Column:
            return F.struct(t.bitwiseXOR(F.col(f"salt{kind}")).alias("key"), (F.col("head") + (i * 2 + kind)).alias("meta"))

        return F.transform(F.slice("tokens", F.lit(1), F.col(length)), one)

    spotted = sets.select("m1", *PARITIES, F.explode(F.concat(spots("own", 0), spots("beyond", 1))).alias("s"))
    return spotted.select("s.key", "m1", "s.meta", *PARITIES)


def partners(percent: int) -> Column:
    """Whether rows x and y at one key may be similar lines: length, position and parity, last in the most bins that both have."""
    part = {}
    for side in ("x", "y"):
        meta = F.col(f"{side}.meta")
        part[side] = F.shiftright(meta, 32), F.shiftright(meta, 1).bitwiseAND(F.lit(0x7FFFFFFF)), meta.bitwiseAND(F.lit(1))
    (nx, ix, kx), (ny, iy, ky) = part["x"], part["y"]
    need = F.ceil((nx + ny) * percent / (100 + percent))
    fits = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (F.least(nx - ix, ny - iy) >= need)
    bits, half, third, fourth = (F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in PARITIES)
    rest, allowed = bits.bitwiseXOR(half), nx + ny - 2 * need  # rest: of the first and the third part
    quarters = F.bit_count(third) + F.bit_count(rest.bitwiseXOR(third)) + F.bit_count(fourth) + F.bit_count(half.bitwiseXOR(fourth))
    apart = F.coalesce(quarters, F.bit_count(half) + F.bit_count(rest), F.bit_count(bits))
    # coalesce keeps Spark from a filter on the parities below the explode, for which it would make all tokens twice
    near = F.coalesce(F.bit_count(bits) <= allowed, F.lit(False)) & (apart <= allowed)
    return (F.col("x.key") == F.col("y.key")) & (F.col("x.m1") != F.col("y.m1")) & (kx + ky < 2) & fits & near


def with_partner(first: DataFrame, percent: int) -> DataFrame:
    """The rows of `prefixes` that may have a similar line at their key, each once."""
    return first.alias("x").join(first.alias("y"), partners(percent), "left_semi").distinct()


def similar_lines(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(r1, r2, line_no) of the lines that go."""
    spark, mark = docs.sparkSession, written()
    lines = lines_of(docs)
    marks = stored(lines.select("doc_id", *ROW, "line_no", *LINE), "lines")
    total = marks.count()
    copied = marks.groupBy(*LINE).agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = stored(copied, "copied")
    hot = copied.where((F.col("n") >= HOT_LEAST) & (F.col("n") * HOT_SHARE >= total)) if copied.count() > WANTED else copied

    ranks = rarity(docs, lines, size)
    once = lines.join(F.broadcast(hot.select(*LINE, "first")), list(LINE), "left")  # at most WANTED rows
    once = once.where(F.col("first").isNull() | (place() == F.col("first")))
    first = prefixes(once, size, percent, ranks)
    met = stored(with_partner(first, percent), "met")
    release(spark, mark, marks, copied, met)  # the prefixes are the largest shuffle
    sets = _sets(marks, lines, met.select("m1").distinct(), size)
    order = sets.groupBy("m1").agg(F.coalesce(F.min("first.doc_id"), F.lit(-(2**63))).alias("doc"))
    met = stored(met.join(order, "m1"), "ordered")

    # the earliest line at each place, then all earlier ones for the lines that it leaves unsettled
    lead = met.groupBy("key").agg(F.min(F.struct("doc", "m1", "meta", *PARITIES)).alias("y")).select("key", "y.*")
    earlier = F.col("y.doc") <= F.col("x.doc")
    pair = [F.col("x.m1").alias("x"), F.col("y.m1").alias("y")]
    alike = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))
    first_tries = met.alias("x").join(lead.alias("y"), partners(percent) & earlier).select(*pair, F.struct(alike.alias("apart"), F.col("y.m1").alias("y")).alias("best"))
    tried = stored(first_tries.groupBy("x").agg(F.min("best").alias("best")).select("x", "best.y"), "tried")
    easy = stored(_verified(sets, tried, percent), "easy")
    left = met.join(easy.select("m1"), "m1", "left_anti")
    rest = left.alias("x").join(met.alias("y"), partners(percent) & earlier).select(*pair).distinct()
    release(spark, mark, marks, copied, sets, met, tried, easy)
    near = stored(easy.union(_verified(sets, rest.join(tried, ["x", "y"], "left_anti"), percent)).distinct(), "near")
    told = copied.select(*LINE, "first", F.lit(False).alias("near")).unionByName(near.select(*LINE, F.lit(True).alias("near")), True)
    told = told.groupBy(*LINE).agg(F.max("first").alias("first"), F.max("near").alias("near"))
    gone = marks.join(told, list(LINE)).where(F.col("near") | (place() > F.col("first")))
    return gone.select(*ROW, "line_no").distinct()


def _sets(marks: DataFrame, lines: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(m1, m2, first, words) of the lines of these m1: where each is first, and its distinct tokens, one below the other."""
    wanted = stored(wanted, "wanted")
    asked = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    firsts = marks.join(asked, "m1", "left_semi").groupBy(*LINE).agg(F.min(place()).alias("first"))
    found = lines.join(asked, "m1", "left_semi").select(*LINE, "line").dropDuplicates(list(LINE))
    found = found.join(firsts, list(LINE)).select(*LINE, "first", lowered(words_of(F.col("line"))).alias("words"))
    found = found.withColumn("words", F.array_distinct("words" if size == 1 else runs_of(F.col("words"), size)))
    return stored(found.select(*LINE, "first", F.array_join("words", "\n").alias("words")), "sets")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(m1, m2) of the lines x that are similar to the line y of a pair (x, y) and later."""
    joined = pairs.join(sets.alias("a"), F.col("x") == F.col("a.m1")).join(sets.alias("b"), F.col("y") == F.col("b.m1"))
    joined = joined.where(F.col("b.first") < F.col("a.first"))
    told = joined.select("a.m1", "a.m2", F.split("a.words", "\n").alias("p"), F.split("b.words", "\n").alias("q"))
    told = told.select(*LINE, F.size("p").alias("n"), F.size("q").alias("m"), F.size(F.array_intersect("p", "q")).alias("both"))
    return told.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select(*LINE).distinct()


def removed_lines(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(r1, r2, removed): the places, from 0, of the lines that go, for each document of which some line goes."""
    mark = written()
    gone = similar_lines(docs, size, percent)
    removed = stored(gone.groupBy(*ROW).agg(F.sort_array(F.collect_list("line_no")).alias("removed")), "removed")
    release(docs.sparkSession, mark, removed)
    return removed


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row."""
    gone = removed_lines(docs, **options)
    # the number of newlines plus one, without the text's lines as an array
    n = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    rows = with_row(docs.select("doc_id", "text"), *ROW).select("doc_id", *ROW, n.cast("long").alias("n_lines")).join(gone, list(ROW), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_similar_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows with all their columns; text without the lines that go, n_chars (if there is one) its length."""
    own = [f"_{uuid.uuid4().hex}" for _ in range(3)]  # no column of the rows has these names
    gone = removed_lines(docs, **options).toDF(*own)
    rows = with_row(docs, *own[:2]).join(gone, own[:2], "left")
    removed = F.col(own[2])
    lines = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(removed, i))
    rows = rows.withColumn("text", F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        count = F.when(removed.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        rows = rows.withColumn("n_chars", count)
    return rows.select(*docs.columns)

"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

1. Each text becomes its set of word shingles, a key that names the set, and its minwise tokens, one per coordinate.
   Texts of the same set are one class from here on, so copies cost one row.
2. In each of `trees` independent trees, the path of a node chooses coordinates: one always, a second one in the share
   of nodes that makes 1 / similarity on average. A class goes to the child that its token at a chosen coordinate
   names. Two classes of that similarity so share a child with a chance of about 84 %, in each tree anew.
3. First the easy links: in each node every class is compared, by sketches of one byte per coordinate, with a few
   leaders of the node. Of what looks alike, each class's most promising pair is confirmed on the full sets of both
   texts, then the best pair between each two components, then, twice, the best partner of each class that is not in
   a node's largest component. That joins nearly all groups with few comparisons.
4. Then the rest: a node whose classes are all in one component is done. In a small node, those outside its largest
   component are compared exhaustively with all that are not in their own component. In a larger node with few
   outsiders these are sent to all others, row by row. Any other node branches on. All candidates are confirmed.
   After the last level the classes that were in nodes too deep for the trees there are get more trees of their own, as
   many as bring the miss chance at the depth reached under `MISS`; these go through step 4 too.
5. The components of the confirmed links, over classes, are contracted in rounds.

No pairs inside a component are put out in step 4, so a group of many alike texts costs little more than its size.

Recall: a pair at the threshold itself shares no node of the first level in any of ten trees with a chance of 1e-8; at the
depth that is reached, whatever it is, the trees miss it with at most 1e-3 (`miss_chance`); the sketches miss it with 1e-3, and a pair of similarity 0.85 with 1e-6. Most duplicates have more
than one path in their component. No pair is linked that is not confirmed.

The empty set is linked with nothing. A null doc_id takes part like others; a component's id is the least id that is
not null. Rows that repeat a doc_id and text are one document: they are kept or dropped together. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import release, stored, written
from topicspark.llm.components import components
from topicspark.llm.shingles import COORDINATES, U, chunks, enough, may_reach, minwise, mixed, parity, set_key, shingle_sets

TREES, LEADERS, LEAST_ESTIMATE, SURE, MAX_DEPTH = 10, 4, 0.69, 0.84, 64
BEST_ROUNDS, MISS = 2, 1e-3
SMALL, WORK, PACKED = 4096, 1 << 22, 64  # classes of a small node, comparisons in it, outsiders sent around
SETS = "doc_id long, n_shingles long, key binary, tokens binary, parity binary"


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """SETS of each row; the tokens are 32-bit integers; key, tokens and parity are null for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([minwise(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                     pa.array([parity(s) if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "key", "tokens", "parity"],
                )
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    width = COORDINATES * np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, COORDINATES) if len(column) else np.zeros((0, width), dtype)


def children(node: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each row's node: what the path chooses depends on the node alone."""
    rows = np.arange(len(node))
    first = (mixed(node ^ U(0x51ED270B)) % U(COORDINATES)).astype(np.int64)
    step = (mixed(node ^ U(0x2545F491)) % U(COORDINATES - 1)).astype(np.int64)
    second = (first + 1 + step) % COORDINATES
    two = (mixed(node ^ U(0x6C62272E)) >> U(11)).astype(float) / 2.0**53 < 1 / similarity - 1

    def child(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mixed(mixed(node[rows] + at.astype(np.uint64) * U(0x9E3779B97F4A7C15)) ^ tokens[rows, at].astype(np.uint64))

    more = np.flatnonzero(two)
    return np.concatenate([rows, more]), np.concatenate([child(rows, first), child(more, second[more])])


def miss_chance(depth: int, similarity: float) -> float:
    """Chance that two classes of that similarity share no node of a tree at that depth."""
    two, lost = 1 / similarity - 1, 0.0
    for _ in range(depth):
        kept = 1 - similarity + similarity * lost
        lost = (1 - two) * kept + two * kept * kept
    return lost


def trees_for(depth: int, similarity: float, miss: float) -> int:
    """The least number of trees of that depth that all miss such a pair with a chance of at most `miss`."""
    lost = miss_chance(depth, similarity)
    return int(np.ceil(np.log(miss) / np.log(lost))) if lost > 0 else 1


def _descend(classes: DataFrame, trees: range | None, similarity: float) -> DataFrame:
    """(node, key): the children of each row's node, or of the roots of the trees of these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, keys = _matrix(batch.column("tokens"), "<u4"), batch.column("key")
            if trees is None:
                starts = [batch.column("node").to_numpy().view(np.uint64)]
            else:
                starts = [np.full(len(keys), mixed(np.array([t + 1], U))[0]) for t in trees]
            for node in starts:
                row, child = children(node, tokens, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), keys.take(pa.array(row))], ["node", "key"])

    return classes.mapInArrow(run, "node long, key binary")


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches; equal bytes by chance are allowed for."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _may_link(odd: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Those of the numbers `at` of pairs (u, v) whose parities allow a link."""
    differ = np.bitwise_count(odd[u[at]] ^ odd[v[at]]).sum(axis=1, dtype=np.int64)
    return at[may_reach(differ, size[u[at]], size[v[at]], percent)]


PAIRS = "a binary, b binary, likeness double"


def _pair_batch(left: list, right: list, likeness) -> pa.RecordBatch:
    low, high = [min(x, y) for x, y in zip(left, right)], [max(x, y) for x, y in zip(left, right)]
    return pa.RecordBatch.from_arrays(
        [pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.array(np.asarray(likeness, float))], ["a", "b", "likeness"]
    )


def _with_some(rows: DataFrame, some: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """Alike pairs of each row's class with those of its node in `some` (node, key, root, out); never inside a root.

    The `out` of a node lie in rows of about PACKED, which the join brings to each class of the node: a node of any size is
    spread, whatever the number of them.
    """
    entry = F.struct("key", "root", "n_shingles", "sketch")
    part = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("out") / PACKED)).alias("part")
    packed = some.join(classes.select("key", "n_shingles", "sketch"), "key").groupBy("node", part).agg(F.collect_list(entry).alias("some"))
    packed = stored(packed.drop("part"), "some")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("some")
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), count)
            mine = _matrix(batch.column("sketch"), "u1")
            theirs = _matrix(flat.field("sketch"), "u1")
            n, m = batch.column("n_shingles").to_numpy()[row], flat.field("n_shingles").to_numpy()
            likeness = np.concatenate([_likeness(mine[row[i : i + 65536]], theirs[i : i + 65536]) for i in range(0, len(row), 65536)])
            good = np.flatnonzero((likeness >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            keys, roots = batch.column("key").take(pa.array(row[good])).to_pylist(), batch.column("root").take(pa.array(row[good])).to_pylist()
            other, other_roots = flat.field("key").take(pa.array(good)).to_pylist(), flat.field("root").take(pa.array(good)).to_pylist()
            apart = [i for i, (x, y) in enumerate(zip(roots, other_roots)) if x != y]
            yield _pair_batch([keys[i] for i in apart], [other[i] for i in apart], likeness[good[apart]] if apart else [])

    return rows.select("node", "key", "root", "n_shingles", "sketch").join(packed, "node").mapInArrow(run, PAIRS)


def _exhaustive(rows: DataFrame, least: float, percent: int, best: bool) -> DataFrame:
    """Alike pairs between different roots in each node, one of them outside the node's largest root (top_root).

    `best`: only the most alike partner of each outsider.
    """
    names = ["node", "key", "root", "top_root", "n_shingles", "sketch", *(["parity"] if "parity" in rows.columns else [])]

    def found(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        keys, roots, tops = (table.column(c).to_pylist() for c in ("key", "root", "top_root"))
        size, sketch = table.column("n_shingles").to_numpy(), _matrix(table.column("sketch"), "u1")
        odd = np.frombuffer(b"".join(table.column("parity").to_pylist()), "<u8").reshape(len(keys), -1) if "parity" in names else None
        left, right, likeness = [], [], []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            numbers = {}
            root = np.array([numbers.setdefault(r, len(numbers)) for r in roots[a:b]])
            out = np.flatnonzero(root != numbers.get(tops[a], -1))
            at = np.arange(b - a)
            inside = root == numbers.get(tops[a], -1)
            if best:
                for i in out.tolist():
                    j = np.flatnonzero((root != root[i]) & (100 * np.minimum(size[a + i], size[a:b]) >= percent * np.maximum(size[a + i], size[a:b])))
                    if len(j):
                        like = _likeness(sketch[a + i], sketch[a + j])
                        top = int(like.argmax())
                        if like[top] >= least:
                            left.append(keys[a + i])
                            right.append(keys[a + j[top]])
                            likeness.append(float(like[top]))
                continue
            for i in range(0, len(out), 64):
                x = out[i : i + 64]
                # two outsiders meet once
                meet = (root[x, None] != root) & (inside | (at > x[:, None]))
                meet &= 100 * np.minimum(size[a + x, None], size[a:b]) >= percent * np.maximum(size[a + x, None], size[a:b])
                p, q = np.nonzero(meet)
                for j in range(0, len(p), 65536):
                    u, v = x[p[j : j + 65536]], q[j : j + 65536]
                    like = _likeness(sketch[a + u], sketch[a + v])
                    good = np.flatnonzero(like >= least)
                    if odd is not None:
                        good = np.concatenate([good[:0], *(_may_link(odd, size, a + u, a + v, good[k : k + 4096], percent) for k in range(0, len(good), 4096))])
                    left += [keys[a + k] for k in u[good]]
                    right += [keys[a + k] for k in v[good]]
                    likeness += like[good].tolist()
        yield _pair_batch(left, right, likeness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch.select(names)])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            node = table.column("node").to_numpy()
            cuts = np.flatnonzero(np.diff(node)) + 1
            whole = int(cuts[-1]) if len(cuts) else 0
            yield from found(table.slice(0, whole), cuts[:-1])
            rest = table.slice(whole)
        if rest is not None:
            yield from found(rest, np.zeros(0, np.int64))

    return rows.select(*names).repartition("node").sortWithinPartitions("node").mapInArrow(run, PAIRS)


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def _easy_pairs(nodes: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """Alike pairs of each class with a few leaders of each of its nodes."""
    part = F.pmod(F.xxhash64("key", "node"), F.lit(LEADERS)).alias("part")
    sums = nodes.groupBy("node", part).agg(F.min("key").alias("key"), F.count("*").alias("n"))
    shared = F.sum("n").over(Window.partitionBy("node"))  # LEADERS rows per node
    leaders = stored(sums.withColumn("all", shared).where(F.col("all") > 1).select("node", "key", F.col("key").alias("root"), F.lit(LEADERS).alias("out")), "leaders")
    held = nodes.join(leaders.select("node").distinct(), "node", "left_semi").join(classes, "key")
    return stored(_distinct(_with_some(held.withColumn("root", F.col("key")), leaders, classes, least, percent)), "pairs")


def _rest_pairs(
    nodes: DataFrame, classes: DataFrame, roots: DataFrame, least: float, percent: int, best: bool = False, parities: DataFrame | None = None,
    last: bool = False,
):
    """(alike pairs between roots, (node, key) of the nodes that branch on, whether there are any).

    `best`: of the exhaustively compared nodes only, and there each outsider's most alike partner. Else pairs in such nodes
    also pass the `parities` (key, parity), which leave little more than links. `last`: no node branches on; all are compared.
    """
    rooted = nodes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = stored(rooted, "rooted")
    per = rooted.groupBy("node", "root").agg(F.count("*").alias("n"))
    sums = per.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
    sums = sums.where(F.col("n") > F.col("top.n")).select(
        "node", "n", (F.col("n") - F.col("top.n")).alias("out"), F.col("top.root").alias("top_root")
    )
    small = (F.col("n") <= SMALL) & (F.col("n") * F.col("out") <= WORK)
    way = F.when(small, 0).when((F.col("out") <= PACKED) | F.lit(last), 1).otherwise(2)
    sums = stored(sums.select("node", "top_root", "out", way.alias("way")), "sums")
    rows = rooted.join(sums, "node").join(classes.select("key", "n_shingles", "sketch"), "key")
    rows = stored(rows, "rows")
    near = rows.where("way = 0")
    pairs = _exhaustive(near if best else near.join(parities, "key"), least, percent, best)
    if best:
        return stored(_distinct(pairs), "pairs"), None, False
    few = rows.where("way = 1 AND root != top_root").select("node", "key", "root", "out")
    pairs = pairs.unionByName(_with_some(rows.where("way = 1"), few, classes, least, percent))
    onward = rows.where("way = 2").select("node", "key")
    return stored(_distinct(pairs), "pairs"), onward, bool(onward.limit(1).count())


def _texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, text), one text per wanted class (key, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist()):
                part = batch.slice(at, len(texts))
                keys = [set_key(s) if len(s) else None for s in shingle_sets(texts, size)]
                asked = part.column("key").to_pylist()
                keep = pa.array([k is not None and (k == a or a is None) for k, a in zip(keys, asked)], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column("text")], ["key", "text"]).filter(keep)
                at += len(texts)

    text = docs.select("doc_id", "text")
    named = text.join(wanted.where("doc_id IS NOT NULL"), "doc_id").select("key", "text")
    found = named.mapInArrow(run, "key binary, text string")
    lost = wanted.where("doc_id IS NULL").select("key")
    if lost.limit(1).count():  # classes all of whose documents have no id
        blank = text.where("doc_id IS NULL").select(F.lit(None).cast("binary").alias("key"), "text").mapInArrow(run, "key binary, text string")
        found = found.unionByName(blank.join(lost, "key", "left_semi"))
    return found.groupBy("key").agg(F.min("text").alias("text"))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            step = max(1, int(batch.num_rows * (1 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                x, y = shingle_sets(left[at : at + step], size), shingle_sets(right[at : at + step], size)
                keep = pa.array([enough(p, q, percent) for p, q in zip(x, y)], pa.bool_())
                yield batch.slice(at, step).select(["a", "b"]).filter(keep)

    # the second join brings the one text of a hot partner to the rows, which can be split
    joined = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b")
    joined = joined.join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of classes in different components, with their roots."""
    for side in ("a", "b"):
        root = roots.select(F.col("key").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(root, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a != root_b")


def linked_classes(
    docs: DataFrame, sets: DataFrame, size: int, percent: int, trees: int = TREES, least: float = LEAST_ESTIMATE,
    max_depth: int = MAX_DEPTH, miss: float = MISS,
) -> tuple[DataFrame, DataFrame]:
    """((key, doc_id) of every class, (key, root) of the classes that are linked with others)."""
    similarity = percent / 100
    known = sets.where("key IS NOT NULL")
    named = stored(known.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "classes")
    one = known.select("key", "n_shingles", "tokens", "parity").dropDuplicates(["key"])
    classes = stored(_sketched(one), "tokens")
    sketches, parities = classes.select("key", "n_shingles", "sketch"), classes.select("key", "parity")
    nodes = stored(_descend(classes.select("key", "tokens"), range(trees), similarity), "nodes")

    def confirmed(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        texts = stored(_texts(docs, named.join(keys, "key", "left_semi"), size), "texts")
        return stored(_confirmed(pairs.select("a", "b"), texts, size, percent), "links")

    easy = _easy_pairs(nodes, sketches, least, percent)
    both = easy.select(F.col("a").alias("key"), F.col("b").alias("other"), "likeness").union(easy.select("b", "a", "likeness"))
    # a sure partner before an unsure one, the least key of the sure ones: that makes few and large components
    unsure = F.when(F.col("likeness") >= SURE, F.lit(0.0)).otherwise(-F.col("likeness"))
    best = both.groupBy("key").agg(F.min(F.struct(unsure.alias("rank"), "other")).alias("best"))
    first = best.select(F.least("key", "best.other").alias("a"), F.greatest("key", "best.other").alias("b")).distinct()
    links = confirmed(stored(first, "first"))
    roots = components(links)
    apart = _between(easy, roots)
    low, high = F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")
    second = apart.groupBy(low, high).agg(F.max(F.struct("likeness", "a", "b")).alias("best")).select("best.a", "best.b")
    second = stored(second, "second")
    if second.limit(1).count():
        links = links.union(confirmed(second))
        roots = components(links)

    # the best partner of each class that is still outside: what is left after that has few alike partners
    for _ in range(BEST_ROUNDS):
        found, _, _ = _rest_pairs(nodes, sketches, roots, least, percent, best=True)
        apart = stored(_between(found, roots).select("a", "b"), "best")
        if not apart.limit(1).count():
            break
        links = links.union(confirmed(apart))
        roots = components(links)

    deepest, grown, deep = 1, trees, None
    while True:
        pool, depth, more = None, 1, True
        while more:
            found, nodes, more = _rest_pairs(nodes, sketches, roots, least, percent, parities=parities, last=depth >= max_depth)
            pool = found if pool is None else pool.union(found)
            if more:
                live = nodes.join(classes.select("key", "tokens"), "key").select("node", "key", "tokens")
                nodes, depth = stored(_descend(live, None, similarity), "nodes"), depth + 1
                if grown == trees and trees_for(depth, similarity, miss) > trees:  # classes too deep for these trees
                    here = nodes.select("key")
                    deep = here if deep is None else deep.union(here)
        rest = stored(pool.select("a", "b").distinct(), "rest")
        if rest.limit(1).count():
            links = links.union(confirmed(rest))
            roots = components(links)
        deepest = max(deepest, depth)
        need = trees_for(deepest, similarity, miss)
        if deep is None or need <= grown:
            break
        if grown == trees:
            deep = stored(deep.distinct().join(classes.select("key", "tokens"), "key"), "deep")
        nodes, grown = stored(_descend(deep, range(grown, need), similarity), "nodes"), need
    return named, roots


def _sketched(one: DataFrame) -> DataFrame:
    """`one` with the low byte of each token as a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.ascontiguousarray(_matrix(batch.column("tokens"), "<u4").astype(np.uint8))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in low], pa.binary())], [*batch.schema.names, "sketch"])

    return one.mapInArrow(run, "key binary, n_shingles long, tokens binary, parity binary, sketch binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    mark = written()
    sets = stored(shingled(docs, size), "sets")
    named, roots = linked_classes(docs, sets, size, percent, **options)
    joined = named.join(roots, "key").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(joined, "root").select("key", "component_id")
    every = named.join(linked, "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id"))
    every = stored(every, "members")
    release(docs.sparkSession, mark, sets, every)
    found = sets.select("doc_id", "n_shingles", "key").join(every, "key", "left")
    ident = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", ident.alias("component_id"), F.col("doc_id").eqNullSafe(ident).alias("kept"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows, with all their columns, of one document per group of near-duplicates: the one of the least doc_id.

    Documents without words have no group and stay. Of rows that repeat a doc_id and text one stays.
    """
    found = near_duplicates(docs, size, percent, **options)
    kept = found.where("kept").select("doc_id").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]) if _repeats(found) else docs.join(kept, same, "left_semi")


def _repeats(found: DataFrame) -> bool:
    """Whether some doc_id comes more than once among the kept rows."""
    return bool(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())

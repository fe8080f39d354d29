"""Exact, near and line dedup and the pipeline, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.llm import components, exact_dedup, line_dedup, near_dedup, shingles
from topicspark.llm.common import ascii_lower_word, fresh_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact


def brute_exact(rows):
    norm = [(i, (t or "").translate(LOW)) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    top = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
    return sorted(str((i, top(groups[t]), len(groups[t]), i == top(groups[t]))) for i, t in norm)


def written(df, spark):
    path = fresh_path(spark, "source")
    df.repartition(3).write.parquet(path)
    return path


def results(df):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in df.collect())


SOME = [(1, "Same"), (2, "sAME"), (9, "same"), (4, "É"), (5, "é"), (6, None), (7, ""), (8, "x" * 200_000), (8, "x" * 200_000), (None, "same"), (None, "alone")]


def test_exact_duplicates(spark, docs):
    assert results(exact_dedup.exact_duplicates(spark, written(docs(SOME), spark))) == brute_exact(SOME)


def test_equal_digests_of_different_texts_are_told_apart(spark, docs):
    """A digest of three values: everything collides, and the full bytes decide."""
    weak = lambda text: F.unhex(F.hex(F.length(text) % 3)).cast("binary")
    assert results(exact_dedup.exact_duplicates(spark, written(docs(SOME), spark), digest=weak)) == brute_exact(SOME)


def test_state_outlives_a_run(spark, docs):
    path, folder = written(docs([(1, "a"), (2, "b")]), spark), fresh_path(spark, "state")
    assert exact_dedup.update_state(spark, path, folder).count() == 2
    docs([(3, "A"), (4, "c")]).write.mode("append").parquet(path)
    state = {r["keep_id"]: r["n"] for r in exact_dedup.update_state(spark, path, folder).collect()}
    assert state == {3: 2, 2: 1, 4: 1}
    row = exact_dedup.current_state(spark, folder).filter("keep_id = 3").first()
    assert row["locator"]["file"].endswith(".parquet") and row["locator"]["row"] >= 0


def test_an_old_file_that_comes_late_is_read(spark, docs):
    """A file whose time lies years before the others'."""
    import glob
    import os

    path, folder = written(docs([(1, "a"), (2, "b")]), spark), fresh_path(spark, "state")
    exact_dedup.update_state(spark, path, folder)
    before = set(glob.glob(f"{path}/*.parquet"))
    docs([(3, "A"), (4, "c")]).write.mode("append").parquet(path)
    for name in set(glob.glob(f"{path}/*.parquet")) - before:
        os.utime(name, (10**9, 10**9))
    got = results(exact_dedup.exact_duplicates(spark, path, folder))
    assert got == brute_exact([(1, "a"), (2, "b"), (3, "A"), (4, "c")])


def test_exact_of_nothing(spark, nothing):
    path = fresh_path(spark, "source")
    nothing.write.parquet(path)
    assert exact_dedup.exact_duplicates(spark, path).count() == 0


# near


def brute_sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_near(rows, size, percent):
    """doc_id -> (set size, component) for rows of distinct ids."""
    sets = {i: brute_sets(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def planted(seed, groups=12, copies=12, words=120):
    """Texts in groups of more and less alike copies, all with a passage in common."""
    rng = random.Random(seed)
    passage = [f"common{i}" for i in range(25)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 4, 6, 9))):
                w[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w + passage)))
    return rows


@pytest.mark.parametrize("size, percent", [(4, 80), (5, 80)])
def test_near_duplicates_are_brute_force(docs, size, percent):
    rows = planted(1) + [(900, None), (901, ""), (902, " \t\n"), (903, "two words"), (904, "TWO  words"), (905, "w" * 50_000)]
    want = brute_near(rows, size, percent)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(rows).repartition(4), size, percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_large_nodes_branch_and_send_outsiders(monkeypatch, docs):
    """Tiny limits, so that nodes branch on, or send their outsiders around."""
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "PACKED", 3)
    rows = planted(2, groups=6, copies=20, words=90)
    got = near_dedup.near_duplicates(docs(rows), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near(rows, 4, 80)


def test_deep_nodes_get_more_trees(monkeypatch, docs):
    """A template that all texts share makes deep nodes; the pairs in it are found from one tree on."""
    monkeypatch.setattr(near_dedup, "SMALL", 30)
    monkeypatch.setattr(near_dedup, "PACKED", 1)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    monkeypatch.setattr(near_dedup, "BEST_ROUNDS", 0)
    rng = random.Random(5)
    rows = []
    for g in range(30):
        own = [f"g{g}w{rng.randrange(900)}" for _ in range(50)]
        for k in range(2):
            tail = [f"n{g}k{k}x{i}" for i in range(14)]
            rows.append((len(rows), " ".join([*(f"common{i}" for i in range(90)), *own, *tail])))
    want = brute_near(rows, 4, 80)
    got = near_dedup.near_duplicates(docs(rows), 4, 80, trees=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) == 30


def test_nodes_that_never_get_small_are_compared(monkeypatch, docs):
    """At the last level outsiders are sent to all classes of their node, in parts."""
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "PACKED", 2)
    monkeypatch.setattr(near_dedup, "BEST_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    rows = planted(4, groups=5, copies=16, words=90)
    got = near_dedup.near_duplicates(docs(rows), 4, 80, max_depth=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near(rows, 4, 80)


def test_half_alike_texts_put_out_few_pairs(spark, docs, monkeypatch):
    """Texts of one template just below the threshold: next to no pair passes, the links among them all do."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(420)]
    rows = []
    for i in range(120):
        own = [f"t{i // 2 if i < 20 else i}x{j}" for j in range(60)]
        own = own[: 55] + [f"z{i}y{j}" for j in range(5)] if i < 20 else own
        rows.append((i, " ".join(common[:360] + own)))
    want = brute_near(rows, 4, 80)
    sets = [shingles.shingle_sets([t], 4)[0] for _, t in rows]
    odd = np.array([np.frombuffer(shingles.parity(s), "<u8") for s in sets])
    size = np.array([len(s) for s in sets])
    passed = linked = 0
    for i in range(120):
        for j in range(i):
            may = bool(shingles.may_reach(np.bitwise_count(odd[i] ^ odd[j]).sum(dtype=np.int64), size[i], size[j], 80))
            is_link = shingles.enough(sets[i], sets[j], 80)
            assert may or not is_link
            passed, linked = passed + may, linked + is_link
    assert linked <= passed <= linked + 70
    got = near_dedup.near_duplicates(docs(rows), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_trees_for_a_depth():
    assert near_dedup.miss_chance(1, 0.8) == pytest.approx(0.16) and near_dedup.trees_for(1, 0.8, 1e-3) <= 4
    for depth in (5, 10, 20, 40):
        n, lost = near_dedup.trees_for(depth, 0.8, 1e-3), near_dedup.miss_chance(depth, 0.8)
        assert lost**n <= 1e-3 < lost ** (n - 1)
    assert near_dedup.trees_for(5, 0.8, 1e-3) <= near_dedup.TREES < near_dedup.trees_for(10, 0.8, 1e-3)


def test_near_duplicates_of_odd_rows(spark, odd, nothing, docs):
    got = near_dedup.near_duplicates(odd, 4, 80).collect()
    assert len(got) == 8
    for r in got:
        assert r["kept"] and r["component_id"] == r["doc_id"]
    kept = near_dedup.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == 7  # of the repeated row one stays
    twin = docs([(None, "the same few words here"), (5, "the same few words here"), (7, "The same few words here")])
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(twin).collect()} == {
        (None, 5, False), (5, 5, True), (7, 5, False)
    }
    assert near_dedup.near_duplicates(nothing).count() == 0 and near_dedup.representatives(nothing).count() == 0


def test_hashed_sets_are_the_sets():
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB é\t\n\x0b\x1c\xa0.") for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None, ""]
    for size in (1, 4, 5):
        hashed = shingles.shingle_sets(texts, size)
        plain = [brute_sets(t, size) for t in texts]
        assert [len(s) for s in hashed] == [len(s) for s in plain]
        for i in range(0, 600, 7):
            for j in range(i, 600, 31):
                assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["key"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# lines


def brute_lines(rows, size=1, percent=80):
    """(doc_id, place) of lines that go, for rows of distinct ids."""
    lines = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            w = [x for x in line.translate(LOW).split(" ") if x]
            if w:
                s = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}
                lines.append(((i, k), s))
    gone = set()
    for n, (at, s) in enumerate(lines):
        if any(100 * len(s & e) >= percent * len(s | e) for _, e in lines[:n]):
            gone.add(at)
    return gone


def near_lines(seed):
    rng = random.Random(seed)
    bases = [[f"b{b}x{i}" for i in range(rng.choice((3, 8, 40, 80)))] for b in range(8)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                w[rng.randrange(len(w))] = rng.choice(("The", "zq", f"n{rng.randrange(99)}"))
            text.append(rng.choice((" ", "  ")).join(w))
        rows.append((d, "\n".join(text)))
    return rows + [(200, None), (201, ""), (202, "\n \n"), (203, "HOT line of some more words\n" * 150)]


def test_lines_are_brute_force(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 20)
    rows = near_lines(1)
    want = brute_lines(rows)
    got = line_dedup.line_report(docs(rows).repartition(3)).collect()
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == want and len(want) > 150
    assert {r["doc_id"]: r["n_lines"] for r in got}[203] == 151 and {r["doc_id"]: r["n_lines"] for r in got}[200] == 0


def test_lines_by_runs_are_brute_force(docs, monkeypatch):
    """With runs of five words as tokens a short line with one changed word stays."""
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 20)
    monkeypatch.setattr(line_dedup, "WANTED", 3)
    base = [f"w{i}" for i in range(27)]
    rows = near_lines(3) + [(300, " ".join(base)), (301, " ".join([*base[:13], "other", *base[14:]]))]
    want = brute_lines(rows, size=5)
    got = line_dedup.line_report(docs(rows).repartition(3), size=5).collect()
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == want
    assert (301, 0) not in want and (301, 0) in brute_lines(rows) and len(want) < len(brute_lines(rows))


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_lines_of_all_sizes_are_brute_force(docs, percent):
    """Sizes around the borders of the size classes, similarities around the threshold, frequent words everywhere."""
    rng = random.Random(percent)
    rows = []
    for d in range(60):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice((1, 2, 4, 5, 9, 10, 11, 25, 26, 60)))]
        text = []
        for _ in range(5):
            w = [x if rng.random() > 0.08 else f"v{rng.randrange(30)}" for x in base if rng.random() > 0.06]
            rng.shuffle(w)
            text.append(" ".join(w))
        rows.append((d, "\n".join(text)))
    rows += [(300, "É a b c d"), (301, "é a b c d"), (302, "É A b c D"), (303, "ⅷ a b c d e f"), (304, "Ⅷ a b c d e f")]
    got = line_dedup.line_report(docs(rows), percent=percent).collect()
    want = brute_lines(rows, percent=percent)
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == want and len(want) > 50


@pytest.mark.parametrize("percent", [60, 80])
def test_the_longest_prefixes_are_looked_at(docs, percent):
    """Of each size a line, and the same line with as many rarer words as the threshold allows: the shared ones come last."""
    rows = []
    for n in range(2, 90):
        base = [f"s{n}w{i}" for i in range(n)]
        more = n * 100 // percent - n
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + [f"only{n}w{i}" for i in range(more)]))]
    rows += [(1000 + i, " ".join(f"s{n}w{j}" for n in range(2, 90, 3) for j in range(0, n, 2))) for i in range(2)]
    got = line_dedup.line_report(docs(rows), percent=percent).collect()
    want = brute_lines(rows, percent=percent)
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == want and len(want) == 89


def test_long_lines_without_partner_go_no_further(docs):
    """Lines of 100 to 250 words that share some rare ones with others: with parities in 64 bins nearly all of them stay."""
    rng = random.Random(5)
    rows = [(d, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(100, 250)))) for d in range(120)]
    rows += [(500 + d, rows[d][1] + " one more") for d in range(6)]
    lines = line_dedup.lines_of(docs(rows))
    first = line_dedup.prefixes(lines, 1, 80, line_dedup.rarity(docs(rows), lines, 1)).localCheckpoint()
    met = line_dedup.with_partner(first, 80)
    assert met.select("m1").distinct().count() == 12
    coarse = first.select(*(F.when(F.lit(c not in ("half", "third", "fourth")), F.col(c)).alias(c) for c in first.columns))
    assert line_dedup.with_partner(coarse, 80).select("m1").distinct().count() > 60
    got = line_dedup.line_report(docs(rows)).collect()
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == brute_lines(rows) == {(500 + d, 0) for d in range(6)}


def test_tokens_are_made_once(docs):
    """A filter below the explode of the first tokens would make all of them again for each line."""
    lines = line_dedup.lines_of(docs([(1, "a b c"), (2, "a b d")]))
    met = line_dedup.with_partner(line_dedup.prefixes(lines, 1, 80, line_dedup.rarity(docs([]), lines, 1)), 80)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("aggregate(" in line or "array_distinct" in line)]


def test_columns_of_any_name_come_back(spark):
    """Names that the operator used itself once."""
    given = spark.createDataFrame(
        [(1, "a b c\nd", 5, "x", 1), (2, "A b c\ne", 6, "y", 2)], "doc_id bigint, text string, _row bigint, _removed string, m1 int"
    )
    got = {tuple(r) for r in line_dedup.without_similar_lines(given).collect()}
    assert got == {(1, "a b c\nd", 5, "x", 1), (2, "e", 6, "y", 2)}


def test_lower_casing_is_of_a_to_z_only(spark):
    """Every character, alone and beside a capital letter."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [c + "Q" for c in chars if c.lower() != c or c.upper() != c or ord(c) % 97 == 0] + ["".join(chars[i : i + 500]) for i in range(0, 0x3000, 500)] + ["ΑΣ", "AΣ ", "İI", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_lower_word(F.col("t")).alias("low")).collect()
    assert all(r["low"] == (None if r["t"] is None else r["t"].translate(LOW)) for r in rows)


def test_texts_without_similar_lines(docs, odd, nothing):
    given = docs([(1, "a b c d e f\nkeep"), (2, "other\nA b c d e f\n\nmore"), (None, None), (3, "a b c d e f"), (4, "a b c d e f\na b c d e f")])
    got = line_dedup.without_similar_lines(given)
    assert got.columns == given.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"], r["kept"]) for r in got.collect()}
    assert texts == {
        1: ("a b c d e f\nkeep", 16, "mine"), 2: ("other\n\nmore", 11, "mine"), None: (None, 0, "mine"), 3: ("", 0, "mine"), 4: ("", 0, "mine")
    }
    assert {(r["doc_id"], r["n_removed"]) for r in line_dedup.line_report(odd).collect()} >= {(1, 0), (3, 0), (4, 0)}
    assert line_dedup.without_similar_lines(nothing).count() == 0 and line_dedup.line_report(nothing).count() == 0


def test_the_main_path_is_expressions_only(docs):
    plan = line_dedup.without_similar_lines(docs([(1, "a b"), (2, "a b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

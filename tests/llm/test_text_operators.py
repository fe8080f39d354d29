"""Token files, decontamination, language ID, BPE, chat, URLs, quality: against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from topicspark.llm import bpe, chat, decontaminate, langid, quality, queries, token_files, urls
from topicspark.llm.common import bounded_sample, fresh_path

WORD_FILE, BYTE_FILE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD_CHARS = "abcdeABthinger  \n\t'.,!01²½éß日本　\xa0\x1c\x85\u0301😀|<>ΣİK"


def odd_strings(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        x = "".join(rng.choice(ODD_CHARS) for _ in range(rng.randint(0, 40)))
        yield x[:10] + rng.choice(("<|endoftext|>", "<|startoftext|>", ", ", ". ")) + x[10:] if rng.random() < 0.3 else x


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# token files


def test_words_encode_like_the_library():
    tool, lib = token_files.WordEncoder(WORD_FILE), library(WORD_FILE)
    texts = [*odd_strings(3000, 1), "a|b | c", "don't can't I'LL", "end.", "x, y. z"]
    for text, got in zip(texts, tool.encode(texts)):
        assert np.frombuffer(got, tool.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 3)
    tool, lib = token_files.WordEncoder(WORD_FILE), library(WORD_FILE)
    texts = ["one two three four", "five six", "one six " + "y" * 100]
    for _ in range(2):
        for text, got in zip(texts, tool.encode(texts)):
            assert np.frombuffer(got, tool.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 5])
def test_token_files_round_trip(spark, odd, parts):
    folder = fresh_path(spark, "files")
    made = token_files.write_token_files(odd, folder, WORD_FILE, parts=parts).collect()
    assert sum(r["docs"] for r in made) == 8
    lib = library(WORD_FILE)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    want = {r["doc_id"]: lib.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in odd.collect()}
    at = 0
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (at, len(want[r["doc_id"]]))
        at += r["n_tokens"]


def test_token_files_of_nothing(spark, nothing):
    folder = fresh_path(spark, "files")
    assert token_files.write_token_files(nothing, folder, WORD_FILE).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


# byte-level BPE


def test_bpe_is_the_library():
    tool, lib = bpe.Codec(BYTE_FILE), library(BYTE_FILE)
    texts = [*odd_strings(4000, 2), "a" * 3000, "ab" * 1500, " " * 50 + "x", "the" * 900, "x \n \n  y", "\n a  b   c"]
    for text in texts:
        ids = tool.encode(text)
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert tool.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_bpe_of_odd_rows(odd, nothing):
    got = {(r["doc_id"], r["n_tokens"]) for r in bpe.encode_and_decode(odd, BYTE_FILE).collect()}
    assert (1, 0) in got and (2, 0) in got and len(got) == 7
    assert all(r["decoded"] == (r["text"] or "") for r in bpe.encode_and_decode(odd, BYTE_FILE).join(odd, "doc_id").select("decoded", "text").collect())
    assert bpe.encode_and_decode(nothing, BYTE_FILE).count() == 0


# decontamination

_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def brute_contamination(text, items, window=13):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = _WORD.findall((text or "").translate(low))
    hit, names = set(), set()
    for name, item in items:
        w = _WORD.findall((item or "").translate(low))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(name)
    return len(words), len(hit), sorted(str(n) for n in names if n is not None)


def test_contamination_is_brute_force(spark, docs):
    rng = random.Random(3)
    vocabulary = ["a", "B", "é", "c3", "dd", "Zoo"]
    say = lambda n: rng.choice((" ", ", ", "\n-")).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice((1, 4, 12, 13, 14, 30)))) for i in range(12)] + [(20, "?!"), (21, None), (None, say(5)), (3, say(5))]
    texts = [(i, say(rng.randint(0, 60))) for i in range(80)] + [(200, None), (201, ""), (202, "..."), (203, items[5][1].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for r in decontaminate.contamination(docs(texts), bench).collect():
        n, hit, names = brute_contamination(dict(texts)[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, names)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        text = dict(texts)[r["doc_id"]] or ""
        assert sum(len(_WORD.findall(text[s["start"] : s["stop"]].lower())) for s in r["spans"]) == hit


def test_many_automata_find_what_one_finds(spark, docs, odd, monkeypatch):
    """A benchmark of many parts, and an item that is cut: rows as from one automaton; clashing names, repeated and null rows stay."""
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(9)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = say(120)
    items = [(i, say(rng.choice((2, 13, 14, 40)))) for i in range(10)] + [(None, say(20)), (3, say(20)), (11, long), (12, "!"), (13, None)]
    texts = [(i, " ".join(rng.choice([say(9), x or "", long[50:200]]) for _, x in rng.sample(items, 3))) for i in range(60)]
    texts += [(200, None), (201, ""), (1, texts[1][1]), (202, long)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = docs(texts)
    assert decontaminate._parts(table, bench, 13, None, 100)[0] > 5
    rows = lambda **more: sorted(map(str, decontaminate.contamination(table, bench, **more).collect()))
    assert rows(part_chars=100) == rows()
    for r in decontaminate.contamination(table.limit(30), bench, part_chars=100).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_contamination(dict(texts)[r["doc_id"]], items)
    clash = odd.withColumn("_found", F.lit("mine"))
    small = spark.createDataFrame([(1, "one TWO three"), (2, "four"), (3, "five six")], "item_id bigint, text string")
    kept = decontaminate.decontaminated(clash, small, part_chars=6)
    one = decontaminate.decontaminated(clash, small)
    assert kept.columns == clash.columns and sorted(map(str, kept.collect())) == sorted(map(str, one.collect()))
    assert decontaminate.contamination(table.limit(0), bench, part_chars=100).count() == 0


def test_clean_documents_stay(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "one TWO three")], "item_id bigint, text string")
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "6", "None"]
    none = bench.filter("false")
    assert decontaminate.decontaminated(odd, none).count() == 8 and decontaminate.contamination(nothing, bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contamination(odd, bench, max_chars=3)


# language ID and quality: held-out accuracy


def test_a_hot_text_has_its_share_of_a_sample(spark):
    """Copies of a text are drawn apart; repeated rows are one; no more than the sample reaches the driver."""
    rows = [(i, ("en", "de")[i % 2], f"hot {i % 3}" if i % 6 else f"text {i}") for i in range(12_000)] + [(None, "en", "no id")] * 6_000
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = bounded_sample(table, "lang", "text", 200, "doc_id")
    assert sorted(r["lang"] for r in got) == ["de"] * 200 + ["en"] * 200
    texts = Counter(r["text"] for r in got)
    assert all(40 < texts[f"hot {i}"] < 200 for i in range(3)) and texts["no id"] <= 1 and [tuple(r) for r in got] == [
        tuple(r) for r in bounded_sample(table.repartition(5), "lang", "text", 200, "doc_id")
    ]
    assert len(bounded_sample(table, "lang", "text", 20_000, "doc_id")) == 12_001
    assert bounded_sample(table.where("false"), "lang", "text", 5, "doc_id") == []


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    apart = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(apart) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in apart]) > 0.97
    assert np.mean([r["accepted"] for r in found]) > 0.98


def test_language_of_odd_rows(spark, odd, nothing, docs):
    model = langid.fit(docs([(i, "the cat sat on the mat " * 9) for i in range(20)]))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[5]["lang_pred"] == "und" and not got[1]["accepted"]
    assert got[3]["lang_pred"] == "en" and got[3]["accepted"] and got[3]["score"] == 1.0
    kept = langid.identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, None, 4, 6}
    blank = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.predict(odd, blank).collect()} == {"und"} and langid.identified(nothing, blank).count() == 0


def test_an_unknown_language_is_rejected(spark):
    """A language that the model has never seen goes, the others stay, whatever their length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    for left_out in ("de", "fr"):
        model = langid.fit(docs.where(F.col("lang") != left_out))
        found = langid.predict(docs, model).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
        strange = [r["accepted"] for r in found if r["lang"] == left_out and r["n"] > 300]
        known = [r["accepted"] for r in found if r["lang"] != left_out]
        assert len(strange) > 50 and np.mean(strange) < 0.2 and np.mean(known) > 0.97


def test_number_signs_are_no_letters(docs):
    model = langid.fit(docs([(i, "the cat sat on the mat " * 9) for i in range(20)]))
    rows = [(1, "½ ² Ⅷ"), (2, "12 ٣ _ !"), (3, "½ a ²"), (4, "日本")]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(rows), model).collect()} == {1: "und", 2: "und", 3: "en", 4: "en"}


def test_equal_sizes_go_to_the_first_name():
    model = langid.LanguageModel(("aa", "bb"), (b"the same words", b"the same words"), (0.0,) * 5)
    assert langid.Compressors(model).judge("the same words")[:3] == ("aa", 0.5, 0.0)


def test_a_language_is_not_guessed_from_other_columns(docs):
    """Rows of the held-out fold and rows without a language teach nothing."""
    apart = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    model = langid.fit(docs([(i, "some text in a language") for i in apart]))
    assert model.languages == ()


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels)
    found = quality.score(docs.join(labels, "doc_id").select("doc_id", "text"), model).join(labels, "doc_id").collect()
    apart = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(apart) > 1000 and np.mean([r["quality"] == r["predicted"] for r in apart]) > 0.97


def test_positives_alone_give_a_model(spark):
    """Without any label of 0 the prior is estimated, and held-out documents are still told apart."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels.filter("quality = 1"))
    share = labels.agg(F.avg("quality")).first()[0]
    assert model.weights is not None and abs(model.prior - share) < 0.15
    found = quality.score(docs.join(labels, "doc_id").select("doc_id", "text"), model).join(labels, "doc_id").collect()
    apart = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["quality"] == r["predicted"] for r in apart]) > 0.9


def test_the_prior_is_estimated():
    """A mixture of known share, with overlap."""
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        good, bad = rng.normal(2, 1, 20_000), rng.normal(-2, 1, 20_000)
        mixed = np.where(rng.random(20_000) < share, good, bad)
        assert quality.estimated_prior(rng.normal(2, 1, 4_000), mixed) == pytest.approx(share, abs=0.05)


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    blank = quality.fit(nothing, labels.filter("false"))
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.5} and quality.score(nothing, blank).count() == 0


def test_the_risk_goes_down():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (400, 3))
    one = np.ones((400, 1))
    w = quality.pu_weights(np.hstack([good[:200], one[:200]]), np.hstack([np.vstack([good[200:], bad[:100]]), one[:300]]), 2 / 3)
    assert (np.hstack([good, one]) @ w > 0).mean() > 0.85 and (np.hstack([bad, one]) @ w < 0).mean() > 0.85


# chat


def by_hand(rows):
    text = "".join(f"{r}\n{t or ''}\n" for _, r, t in rows)
    learned = "".join(t or "" for _, r, t in rows if r == "assistant")
    return text, learned


def test_chats_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "␛", "<␛|", "<|says|>", "<", "␛␛<s>", "[", "", None, "a\nb</s", "s>", "|next|>", "<<s>"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(("user", "assistant", "assistant", "sy</s>stem")), rng.choice(nasty)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, 0, "user", "tie"), (100, 0, "user", "tie"), (None, 0, "assistant", "no id"), (101, None, "user", "x"), (102, 0, None, "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    made = chat.format_chats(turns.repartition(5))
    for r in chat.read_chats(made, "formatted", "loss_mask").collect():
        mine = sorted([(t if t is not None else -1, ro or "", x or "") for c, t, ro, x in rows if c == r["conv_id"]])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(ro, x) for _, ro, x in mine]
        assert r["learned"] == [x for _, ro, x in mine if ro == "assistant"]
        spans = [r["formatted"][s["start"] : s["start"] + s["size"]] for s in r["loss_mask"]]
        assert len(spans) == len(r["learned"]) and not any("<s>" in s or "</s>" in s for s in spans)
        blocks = sum(a[1] != b[1] for a, b in zip(mine, mine[1:])) + 1
        assert r["formatted"].count("<|says|>") == blocks  # neighbouring turns of a role are one block
    assert chat.format_chats(turns.filter("false")).count() == 0


# URLs


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def test_urls_and_rules(spark):
    given = [
        "http://A.Net/x", "https://net", "http://net/", "http://example.net/en/1?x#y", "http://sub.EXAMPLE.net/en/", "http://example.net/en",
        "ftp://example.com/de/#", "http://x.org/fr/a", "http://org/fr", "http://notnet/", "no scheme", "", None, "a://b://c/d", "http://?q", "http://h\n.net/p",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, queries.URL_RULES).collect()}
    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"),
             "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    for i, u in enumerate(given):
        host, path = plain_url(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        fits = [n for n, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=len, default=None)
        assert got[i]["rule"] == best, u
        assert got[i]["verdict"] in ("allow", "block") and (best is None or got[i]["verdict"] == rules[best][2])
    assert urls.filter_urls(pages.filter("false"), queries.URL_RULES).count() == 0


def test_markov_probabilities_sum_to_one_over_the_known_alphabet():
    model = urls.Markov.learn(["abcab", "abd", "acab"] * 5, 3, 2)
    for context in ("", "a", "ab", "zz"):
        texts = [context + c for c in "abcd"]
        points, _ = urls.codes(texts, 3)
        last = np.cumsum([3 + len(t) for t in texts]) - 1
        p = np.exp(model.logs(points))[last]
        assert 0.9 < p.sum() <= 1.0 + 1e-9
    seen, unseen = (np.exp(model.logs(urls.codes([t], 3)[0]))[-1] for t in ("ab", "ad"))
    assert seen > 5 * unseen


def test_models_tell_urls_apart(spark):
    rng = random.Random(5)
    good = [(i, f"http://{rng.choice(('news', 'wiki', 'blog'))}.example.com/ok/{i}") for i in range(300)]
    bad = [(1000 + i, f"http://{rng.choice(('casino', 'bets', 'pills'))}.example.com/no/{i}") for i in range(300)]
    rules = [urls.Rule("example.com", "/ok/", "allow"), urls.Rule("example.com", "/no/", "block")]
    judged = urls.judged_by_rules(spark.createDataFrame(good + bad, "page_id bigint, url string"), rules)
    model = urls.fit(judged)
    found = model.scores(["wiki.example.org/ok/77", "casino.example.org/no/77"])
    assert found[0] > model.threshold > found[1]


def test_url_models_count_all_labelled_rows(spark):
    """More rows per class than a sample would hold; the same counts as of all texts at once; a repeated row counts once."""
    rows = [(i, f"{'ok' if i % 2 else 'no'}.org", f"/{i % 977}/é") for i in range(44_000)]
    made = spark.createDataFrame(rows + rows[:50], "page_id bigint, host string, path string").repartition(5)
    judged = made.withColumn("verdict", F.when(F.col("host") == "ok.org", "allow").otherwise("block"))
    model = urls.fit(judged)
    apart = F.pmod(F.xxhash64(F.lit(17), F.concat("host", "path"), "page_id"), F.lit(3)) == 0
    learn = judged.where(~apart).select("page_id", "verdict", F.concat("host", "path").alias("text")).distinct().collect()
    for found, verdict in ((model.accepted, "allow"), (model.rejected, "block")):
        want = urls.Markov.learn([r["text"] for r in learn if r["verdict"] == verdict], urls.ORDER, urls.LEAST_SEEN)
        assert found.alphabet == want.alphabet
        for a, b in zip(found.seen + found.after, want.seen + want.after):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))
    assert model.accepted.seen[0][1].sum() > 130_000
    assert model.scores(["ok.org/5/é"])[0] > model.threshold > model.scores(["no.org/5/é"])[0]


def test_url_models_know_rare_contexts_of_large_classes(spark):
    """A context that was seen three times is known, however many characters its class has."""
    rows = [(i, f"{'ok' if i % 2 else 'no'}.org", f"/{'a' * 60}/{i % 7}") for i in range(60_000)]
    rows += [(100_000 + i, "ok.org", "/qxyzw") for i in range(7)]
    judged = spark.createDataFrame(rows, "page_id bigint, host string, path string").withColumn(
        "verdict", F.when(F.col("host") == "ok.org", "allow").otherwise("block")
    )
    model = urls.fit(judged)
    apart = F.pmod(F.xxhash64(F.lit(17), F.concat("host", "path"), "page_id"), F.lit(3)) == 0
    learn = [r["text"] for r in judged.where(~apart & (F.col("verdict") == "allow")).select(F.concat("host", "path").alias("text")).collect()]
    assert 3 <= learn.count("ok.org/qxyzw") <= 5 and sum(map(len, learn)) > 1_200_000
    want = urls.Markov.learn(learn, urls.ORDER, urls.LEAST_SEEN)
    assert all(np.array_equal(x, y) for a, b in zip(model.accepted.seen + model.accepted.after, want.seen + want.after) for x, y in zip(a, b))


def test_url_models_too_large_to_hold_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé/\x02.") for _ in range(rng.randrange(12))) for _ in range(600)]
    rows = [(i % 500, f"http://{rng.choice(('net', 'x.example.net', 'a.org', 'nete', 'x.exnet'))}/{rng.choice(('en/', 'fr/', ''))}{t}") for i, t in enumerate(texts)]
    pages = spark.createDataFrame([*rows, *rows[:20], (None, None), (7, ""), (7, "http://")], "page_id bigint, url string")
    whole = urls.filter_urls(pages, queries.URL_RULES).collect()
    monkeypatch.setattr(urls, "MOST", 10)
    model = urls.fit(urls.judged_by_rules(pages, queries.URL_RULES))
    assert model.accepted is None and model.counts.entries > 10
    parts = urls.filter_urls(pages, queries.URL_RULES).collect()

    def listed(found):
        return sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"], r["score"]) for r in found)

    assert len(whole) == len(parts) == 623 and len({r["verdict"] for r in whole if r["rule"] is None}) == 2
    for a, b in zip(listed(whole), listed(parts)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9


def test_digests_of_the_queries(spark):
    """The queries' digests are those of the operators' outputs."""
    found = queries.op9_chat(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert found["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (found["n_turns"], found["loss_chars"], found["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())

"""Quality classifier, personal data, language model and languages."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import lowered
from pyspark.sql import functions as F

from emberline.llm import hpylm, langid, nbsvm, pii
from emberline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def larger(sf):
    return sf.replace("sf0.001", "sf0.01")


def test_quality_of_held_out_documents(spark, larger):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = QUERIES["op2_naive_bayes_svm"](spark, larger).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    told = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s, _ in told if y == 1], [s for y, s, _ in told if y == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(p for y, _, p in told if y == 1) >= 0.97 * len(good)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    label = np.where([r[0] % 3 == 0 or rng.random() < 0.1 for r in rows], 1.0, -1.0)
    ratio = rng.normal(size=30)
    old = nbsvm.PASSES
    nbsvm.PASSES = 400
    try:
        weight, bias = nbsvm.descend(rows, label, ratio)
    finally:
        nbsvm.PASSES = old
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 30] = 1.0

    def loss(w):
        return 0.5 * w @ w + nbsvm.COST * (np.maximum(0, 1 - label * (x @ w)) ** 2).sum()

    w = np.append(weight, bias)
    gradient = w - 2 * nbsvm.COST * x.T @ (label * np.maximum(0, 1 - label * (x @ w)))
    assert np.abs(gradient).max() < 0.05 and all(loss(w) <= loss(w + rng.normal(size=31) * 0.01) for _ in range(50))


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0), (8, 1), (9, None), (99, 1), (None, 1)], "doc_id long, quality int")
    for given in (labels, labels.where("quality = 1"), labels.where("false")):
        model = nbsvm.learn(odd_docs, given)
        rows = nbsvm.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == 0.5
    assert nbsvm.score(no_docs, nbsvm.learn(no_docs, labels)).count() == 0


def spec(text):
    """The base matches as the patterns state them."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.SemiMarkov().fit(pii.made_zones())


def test_base_matches_equal_the_patterns(many):
    rng = random.Random(2)
    texts = [r["text"] for r in many.select("text").collect()]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for letters in ("0123456789.", "01 -+()", "a@.b-_%+1", "+1 2(3)4.5-", "4 1-") for _ in range(300)]
    for text in texts:
        assert pii.base(text) == spec(text), text


def test_field_finds_held_out_zones_and_leaves_others(field):
    zones = pii.made_zones(300, seed=99)
    right = wrong = whole = 0
    for text, start, end, truth in zones:
        found = set(field.decode(text, start, end))
        right, wrong, whole = right + len(found & set(truth)), wrong + len(found - set(truth)), whole + len(truth)
    assert right >= 0.95 * whole and wrong <= 0.01 * whole


def test_field_adds_what_the_patterns_lose(field):
    text = "é +1 (269) 555-3296 4524132264652876 y"
    base, every = pii.find_all(text, field)
    assert base == [] and [(text[a:b], pii.KINDS[k]) for a, k, b in every] == [("+1 (269) 555-3296", "phone"), ("4524132264652876", "card")]
    assert pii.mask(text, every) == "é [PHONE] [CARD] y"
    text = "call +33 (0)6 12 34 56 78 4524132264652876 now"  # more tokens than any fixed small number would allow
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in pii.find_all(text, field)[1]] == [("+33 (0)6 12 34 56 78", "phone"), ("4524132264652876", "card")]
    for text in ("in 2024-05-06 at 12:30, v1.2.3", "4524132264652877", ""):
        assert pii.find_all(text, field) == ([], [])


def test_field_finds_secrets_by_what_names_them(field):
    value = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    for before, after in (('token = "', '"'), ("password=", ""), ("API_KEY: ", " then"), ("token = '", "'### x"), ("Bearer ", ".")):
        text = f"ciónado {before}{value}{after}"
        base, every = pii.find_all(text, field)
        assert base == [] and [(text[a:b], pii.KINDS[k]) for a, k, b in every] == [(value, "secret")], text
    for text in (f"commit {value}", f"sha1={value}", f"see {value} there", "token = 5", "key 2024-05-06", f"/data/{value}.txt"):
        assert pii.find_all(text, field) == ([], []), text


def test_planted_secrets_and_numbers_are_caught(spark, field):
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(300):
        words = [rng.choice(("ereser", "ciónado", "ungen", "the", "éaiou.", "12", "v1.2", "2024-05-06")) for _ in range(60)]
        kind = i % 3  # secret, phone beside a card, nothing
        value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((20, 32, 40)))) + "a1"
        planted = [f'{rng.choice(("token", "secret", "api_key"))} = "{value}"', f"+44 (0)20 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} 4524132264652876", "ende"][kind]
        at = rng.randrange(60)
        rows.append((i, " ".join([*words[:at], planted, *words[at:]])))
        truth[i] = [{"secret"}, {"phone", "card"}, set()][kind]
    made = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()
    found = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in made}
    some = [i for i in truth if truth[i]]
    assert sum(truth[i] <= found[i] for i in some) >= 0.9 * len(some)
    assert all(r["spans"] == r["base_spans"] for r in made if not truth[r["doc_id"]])  # dates side by side may pass as a base card


def test_sums_and_best_path_equal_enumeration(field):
    text = "a@b.co 10.0.0.1"
    n, some = pii.segments(text, 0, len(text))
    score = field.scores(some)

    def paths(place, before):
        if place == n:
            yield 0.0, []
            return
        for total, path in paths(place + 1, 0):
            yield field.pair[before, 0] + total, path
        for s, seg in enumerate(some):
            if seg.first == place:
                for t in range(1, len(pii.KINDS) + 1):
                    for total, path in paths(seg.last, t):
                        yield field.pair[before, t] + score[s, t - 1] + total, [(s, t), *path]

    every = list(paths(0, 0))
    totals = np.array([t for t, _ in every])
    assert abs(field.sums(n, some, score)[-1] - np.log(np.exp(totals - totals.max()).sum()) - totals.max()) < 1e-6
    assert field.best(n, some, score) == every[int(totals.argmax())][1]


def test_personal_data_of_odd_rows(spark, odd_docs, no_docs):
    model = pii.learn(odd_docs)
    rows = pii.find(odd_docs, model, redacted="masked").collect()
    assert len(rows) == odd_docs.count() and all(r["masked"] == r["text"] for r in rows if r["doc_id"] != 9)
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert [s["kind"] for s in nine["base_spans"]] == ["email", "ip"] and nine["masked"] == "[EMAIL] [IP] and [PHONE] [CARD]"
    assert pii.find(no_docs, pii.learn(no_docs)).count() == 0


def test_spans_in_linear_time(field):
    for text in ("a" * 200_000 + " 1 @", "1" * 200_000, "1." * 50_000, "+1" + " " * 100_000, "a@" * 5_000):
        pii.base(text)
        list(pii.zones(text))


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), "</s>"]


def test_language_model_base_and_held_out(spark, larger):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, t in texts.items() if not held[i] for w in words_of(t))
    n, v = sum(count.values()), len(count)
    rows = QUERIES["op7_pitman_yor"](spark, larger).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    ours = base = 0.0
    for r in rows:
        words = words_of(texts[r["doc_id"]])
        expected = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(w in count for w in words), n)
        assert abs(r["base_score"] - expected) < 1e-6 * abs(expected)
        if r["held_out"]:
            ours, base = ours + r["score"], base + r["base_score"]
    assert ours > base


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "CLASSES", 3)
    monkeypatch.setattr(hpylm, "LOOKUP", 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c d", "a a b", "b e f f", "a", "", None, "g h a b"])], "doc_id long, text string")
    model, rare = hpylm.learn(docs)
    assert np.allclose((10.0 ** model.log_p).sum(axis=1), 1, atol=1e-5)
    within = sum(10 ** r["log_rare"] for r in rare.collect()) + 10 ** model.log_unknown * (1 + model.v - rare.count())
    assert abs(within - 1) < 1e-9
    known = "a b c d e f g h".split()
    one = spark.createDataFrame([(w, w) for w in [*known, "unknown"]] + [("", "")], "doc_id string, text string")
    scores = {r["doc_id"]: r["score"] for r in hpylm.score(one, model, rare, ["doc_id"]).collect()}
    k, words = len(model.classes), dict(zip(model.classes.tolist(), range(3)))
    end = words[int(hpylm.END)]
    for word in known:  # by hand: class after an end, then the token in its class, then the end
        key = int(hpylm.tokens(pa.array([word]))[0][0])
        c = words.get(key, k)
        log = 0.0 if c < k else next(r["log_rare"] for r in rare.collect() if np.uint64(r["word"] % 2 ** 64) == key)
        assert abs(scores[word] - (model.log_p[end, c] + log + model.log_p[c, end])) < 1e-5
    assert abs(scores[""] - model.log_p[end, end]) < 1e-6
    assert abs(scores["unknown"] - (model.log_p[end, k] + model.log_unknown + model.log_p[k, end])) < 1e-5


def test_gibbs_agrees_with_the_exact_posterior():
    """Tables of one dish with c customers: p(t) is proportional to the ways to seat them times the weight of t new tables."""
    c, d, parent, strength = 6, 0.5, 0.3, 1.0
    ways = np.zeros((c + 1, c + 1))
    ways[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 1):
            ways[n + 1, t] += (n - d * t) * ways[n, t]
            ways[n + 1, t + 1] += ways[n, t]
    exact = np.array([ways[c, t] * np.prod([(strength + d * i) for i in range(1, t)]) * parent ** t for t in range(c + 1)])
    exact[0] = 0
    exact /= exact.sum()
    rng = np.random.default_rng(3)
    copies = 4_000  # restaurants of one dish each
    seating = hpylm.Seating.even(np.full(copies, c), np.ones(copies, np.int64))
    for _ in range(15):
        seating = seating.sweep(np.arange(copies), seating.tables, np.full(copies, parent), d, rng, strength=strength)
        assert (np.bincount(np.repeat(np.arange(copies), seating.tables), seating.sizes) == c).all()
    found = np.bincount(seating.tables, minlength=c + 1) / copies
    assert np.abs(found - exact).max() < 0.04


def exact_tables(c, d, strength, parent):
    """Probability of each number of tables of ``c`` customers of one dish."""
    ways = np.zeros((c + 1, c + 2))
    ways[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 1):
            ways[n + 1, t] += (n - d * t) * ways[n, t]
            ways[n + 1, t + 1] += ways[n, t]
    exact = np.array([ways[c, t] * np.prod([(strength + d * i) for i in range(1, t)]) * parent ** t for t in range(c + 1)])
    exact[0] = 0
    return exact / exact.sum()


def test_a_parent_goes_on_from_its_seating_as_customers_come_and_go():
    """Swept on, table numbers have their exact distribution, whatever the count was before; untouched dishes keep their tables."""
    d, strength, parent, copies = 0.4, 1.0, 0.3, 4_000
    rng, rooms, p = np.random.default_rng(5), np.arange(4_000), np.full(4_000, 0.3)
    seating = hpylm.Seating.even(np.full(copies, 1), np.ones(copies, np.int64))
    for c in (7, 3, 9):
        seating = seating.follow(np.full(copies, c), rooms, seating.tables, p, d, rng, strength)
        assert (np.bincount(np.repeat(rooms, seating.tables), seating.sizes, copies) == c).all() and (seating.sizes > 0).all()
        for _ in range(15):
            seating = seating.sweep(rooms, seating.tables, p, d, rng, strength=strength)
        assert np.abs(np.bincount(seating.tables, minlength=c + 1) / copies - exact_tables(c, d, strength, parent)).max() < 0.04
    same = seating.follow(seating.counts, rooms, seating.tables, p, d, rng, strength)
    assert same.sizes.tolist() == seating.sizes.tolist() and same.first.tolist() == seating.first.tolist()
    mixed = hpylm.Seating(np.array([5, 3, 2, 1]), np.array([3, 2, 3, 1, 1, 1]), np.array([0, 2, 3, 5, 6]))
    want = np.array([5, 6, 0, 4])
    after = mixed.follow(want, np.zeros(4, np.int64), np.array([6]), np.full(4, 0.2), d, rng)
    assert [int(after.sizes[a:b].sum()) for a, b in zip(after.first, after.first[1:])] == want.tolist()
    assert after.sizes[:2].tolist() == [3, 2] and after.first[3] == after.first[2]
    lists = hpylm.seating_lists(after)
    again = hpylm.lists_seating(lists)
    assert again.counts.tolist() == want.tolist() and again.sizes.tolist() == after.sizes.tolist() and again.first.tolist() == after.first.tolist()


def test_tables_of_a_dish_are_drawn_as_a_whole():
    """One draw has the exact distribution, wherever the dish stood; of many dishes, the others' tables weigh on it."""
    d, parent, rng, copies = 0.4, 0.3, np.random.default_rng(7), 20_000
    for c in (1, 2, 6, hpylm.DRAWN):
        found = hpylm.draw_tables(np.full(copies, c), np.zeros(copies), np.full(copies, parent), d, hpylm.table_ratios(d), rng)
        assert np.abs(np.bincount(found, minlength=c + 1) / copies - exact_tables(c, d, 1.0, parent)[:c + 1]).max() < 0.02
    mixed = hpylm.draw_tables(np.tile([2, 2], copies), np.tile([0.0, 50.0], copies), np.full(2 * copies, parent), d, hpylm.table_ratios(d), rng)
    for at, others in enumerate((0, 50)):
        odds = (1 + d * (others + 1)) * parent / (1 - d)
        assert abs((mixed[at::2] == 2).mean() - odds / (1 + odds)) < 0.02


def test_tokens_are_told_apart_as_words_are():
    texts = ["", None, " ", "A b\tC", "x" * 20_000 + " y", "a\0", "a", "abcdefgh abcdefghi", "ABCDEFGHI", "é 🎉 don't", " lead trail ", "q" * 256 + " " + "q" * 257, "Q" * 257, "x"]
    found, first = hpylm.tokens(pa.array(texts))
    expected = [w for t in texts for w in [*[x for x in re.split("[ \t-\r]+", "".join(c.lower() if c < "\x7f" else c for c in t or "")) if x], None]]
    assert len(found) == len(expected) == first[-1] and (found[first[1:] - 1] == hpylm.END).all()
    assert len(set(zip(found.tolist(), expected))) == len(set(found.tolist())) == len(set(expected))


def test_pairs_reach_their_parts_as_arrays(spark):
    """What is shuffled are a few rows for each task and part, however many pairs there are; a shard is told of what it can't know."""
    texts = spark.range(400).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.hash(F.col("id"), i).cast("string")), " ").alias("text"),
                                    F.lit(True).alias("learned"), F.lit(0).alias("shard")).coalesce(1)
    places = hpylm.pair_places(texts, np.array([hpylm.END]), 8)
    rows = places.collect()
    assert len(rows) == 8 + hpylm.CELL_PARTS and sum(len(r["home"]) for r in rows if r["part"] < 8) == 8 * 400 * 51
    first, key, n, cell, shard = hpylm.told_cells(np.array([7, 5, 7, 5, 9, 7, 9], np.uint64), np.array([1, 3, 3, 2, 5, 1, 5], np.int64))
    assert key.tolist() == [5, 7, 9] and n.tolist() == [1, 3, 2] and sorted(zip(cell.tolist(), shard.tolist())) == [(0, 1), (1, 0), (1, 1), (2, 2)]


def test_language_model_of_odd_rows(spark, odd_docs, no_docs):
    model, rare = hpylm.learn(odd_docs)
    rows = hpylm.score(odd_docs, model, rare, odd_docs.columns).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0 for r in rows)
    assert hpylm.score(no_docs, model, rare, ["doc_id"]).count() == 0
    model, rare = hpylm.learn(no_docs)
    assert all(r["base_score"] == 0 and r["score"] == 0 for r in hpylm.score(odd_docs, model, rare, ["doc_id"]).collect())


def test_languages_by_hand(spark, many):
    """The fused posterior against the same sums in plain Python."""
    known = langid.learn(many)
    assert known.names == ["de", "en", "es", "fr"]
    pages = spark.createDataFrame([
        (1, "http://a.x.com/1", '<html lang="en"><p>the and that with which there'), (2, "http://a.x.com/2", '<html lang="en"><p>the and of that'),
        (3, "http://b.x.com/1", '<html lang="de">'), (4, "http://c.y.org/", None), (5, None, '<HTML LANG=fr-CA><p>que les dans pour'), (6, "http://b.x.com/1", "<p>der die und")],
        "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in langid.identify(pages, known).collect()}
    assert {i: r["declared"] for i, r in rows.items()} == {1: "en", 2: "en", 3: "de", 4: "-", 5: "fr", 6: "-"}
    plain = {1: "the and that with which there", 2: "the and of that", 3: "", 4: "", 5: "que les dans pour", 6: "der die und"}
    places = {1: ("a.x.com", "x.com", "com"), 2: ("a.x.com", "x.com", "com"), 3: ("b.x.com", "x.com", "com"), 4: ("c.y.org", "y.org", "org"), 5: ("", "", ""), 6: ("b.x.com", "x.com", "com")}

    def shares(log):
        e = np.exp(log - log.max())
        return e / e.sum()

    html = {1: '  the and that with which there', 2: '  the and of that', 3: ' ', 4: '', 5: '  que les dans pour', 6: ' der die und'}
    assert {i: t.strip() for i, t in html.items()} == plain
    log = {i: known.likelihoods(pa.array([html[i]]))[0] for i in html}
    text = {i: shares(x) for i, x in log.items()}

    def evidence(value):
        groups = {}
        for i in html:
            groups[value(i)] = groups.get(value(i), 0) + text[i]
        every = sum(groups.values())
        return {k: np.log((g + 1) / (every + len(groups))) for k, g in groups.items()}

    said, suffix = evidence(lambda i: rows[i]["declared"]), evidence(lambda i: places[i][2])
    mine = {i: shares(log[i] + said[rows[i]["declared"]]) for i in html}
    for i in html:
        prior = np.full(4, 0.25)
        for group in (lambda j: True, lambda j: places[j][1] == places[i][1], lambda j: places[j][0] == places[i][0]):
            rest = np.maximum(sum(mine[j] for j in html if group(j)) - mine[i], 0)
            prior = (rest + langid.STRENGTH * prior) / (rest.sum() + langid.STRENGTH)
        posterior = shares(log[i] + said[rows[i]["declared"]] + suffix[places[i][2]] + np.log(prior))
        assert rows[i]["language"] == known.names[int(posterior.argmax())] and abs(rows[i]["confidence"] - posterior.max()) < 1e-9


def test_languages_of_documents_and_empty_tables(spark, sf, many):
    known = langid.learn(many)
    texts = many.select("text", "lang").collect()
    found = known.likelihoods(pa.array([r["text"] for r in texts])).argmax(axis=1)
    assert np.mean([known.names[f] == r["lang"] for f, r in zip(found, texts)]) > 0.97
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert langid.identify(pages, known).count() == pages.count() and langid.identify(pages.where("false"), known).count() == 0
    assert langid.identify(pages, langid.learn(many.where("false"))).where("language IS NOT NULL").count() == 0


def test_pairs_of_rare_words_have_their_own_customers(spark, monkeypatch):
    """Beyond the classes too, a context tells its words apart; and every context's probabilities sum to one."""
    monkeypatch.setattr(hpylm, "CLASSES", 3)
    monkeypatch.setattr(hpylm, "LOOKUP", 2)
    monkeypatch.setattr(hpylm, "PAIRS", 1)
    texts = ["a x y b"] * 6 + ["a z q b"] * 6 + ["a b a b", "", None, "b e f f", "a a b x q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, rare, pairs = hpylm.learn_whole(docs)
    known = "a b e f q x y z".split()
    asked = [(f"{u} {w}", f"{u} {w}") for u in ["", *known, "new"] for w in [*known, "new"]] + [(u, u) for u in ["", *known, "new"]]
    one = spark.createDataFrame(asked, "doc_id string, text string")
    log = {r["doc_id"]: r["score"] for r in hpylm.score(one, model, rare, ["doc_id"], pairs=pairs).collect()}
    assert log["x y"] - log["x q"] > log["z y"] - log["z q"] + 0.5
    pair = {r["key"]: r["log_add"] for r in pairs.collect()}
    at = {w: hpylm.tokens(pa.array([w]))[0][:1] for w in [*known, "new"]}
    at["end"] = np.array([hpylm.END])
    classes, k = {int(h): i for i, h in enumerate(model.classes)}, len(model.classes)
    words = {r["word"] % 2 ** 64: r for r in rare.collect()}

    def p(u, w):
        a, c = classes.get(int(at[u][0]), k), classes.get(int(at[w][0]), k)
        out = float(model.log_p[a, c])
        if c == k:
            out += words[int(at[w][0])]["log_rare"] if int(at[w][0]) in words else model.log_unknown
        if a < k and c == k:
            out += model.back[a]
        if a == k and int(at[u][0]) in words:
            out += words[int(at[u][0])]["log_back"]
        key = int(hpylm.pair_keys(at[u], at[w]).view(np.int64)[0])
        return out + (pair.get(key, 0.0) if a == k or c == k else 0.0)

    for u in [*known, "new", "end"]:
        every = sum(10 ** p(u, w) for w in [*known, "end"]) + 10 ** p(u, "new") * (1 + model.v - len(words))
        assert abs(every - 1) < 1e-5, u
    for u in known:
        for w in known:
            assert abs(log[f"{u} {w}"] - p("end", u) - p(u, w) - p(w, "end")) < 1e-5


def test_texts_are_scored_in_shards_as_by_the_table_of_all_pairs(spark, monkeypatch):
    """Pairs seen once are in no table; scratch tables of a sweep and of the shards go when the next are there."""
    monkeypatch.setattr(hpylm, "CLASSES", 3)
    monkeypatch.setattr(hpylm, "LOOKUP", 2)
    monkeypatch.setattr(hpylm, "PAIRS", 1)
    monkeypatch.setattr(hpylm, "SHARD_BYTES", 200)
    texts = ["a x y b"] * 6 + ["a z q b"] * 6 + ["a b a b", "", None, "b e f f", "a a b x q", "g h a i j", "", None, "a x q f", "e f new g h", "i j", "a x y b"]
    docs = spark.createDataFrame([(i if i != 12 else None, t, i < 18) for i, t in enumerate(texts)], "doc_id long, text string, own boolean")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    scored, n = hpylm.learn_and_score(docs, F.col("own"), ["doc_id", "own", "text"])
    assert len(set(os.listdir(folder)) - before) == 1
    found = {(r["doc_id"], r["text"]): r for r in scored.collect()}
    assert len(found) == len(texts) and n == sum(len((t or "").split()) + 1 for t in texts[:18])
    model, rare, pairs = hpylm.learn_whole(docs.where("own"))
    for r in hpylm.score(docs, model, rare, ["doc_id", "own", "text"], pairs=pairs).collect():
        own = found[r["doc_id"], r["text"]]
        assert (own["n_tokens"], own["n_known"]) == (r["n_tokens"], r["n_known"]) and abs(own["base_score"] - r["base_score"]) < 1e-9
        assert abs(own["score"] - r["score"]) < 0.1 * r["n_tokens"], r
    none, n = hpylm.learn_and_score(docs, F.lit(False), ["doc_id"])
    assert n == 0 and all(r["base_score"] == r["score"] == r["n_known"] == 0 for r in none.collect())
    assert hpylm.learn_and_score(docs.where("false"), F.col("own"), ["doc_id"])[0].count() == 0


def test_a_language_of_one_document_in_a_large_table_is_learned(spark):
    ids = spark.range(21_000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("hash"))
    last = ids.orderBy(F.desc("hash")).first()["doc_id"]  # no sample of the lowest hashes holds it
    docs = ids.select("doc_id", F.when(F.col("doc_id") == last, "zaza zezo zuzu").otherwise("the and of that").alias("text"),
                      F.when(F.col("doc_id") == last, "zz").otherwise("en").alias("lang"))
    known = langid.learn(docs)
    assert known.names == ["en", "zz"]
    assert known.likelihoods(pa.array(["zuzu zaza", "that and"])).argmax(axis=1).tolist() == [1, 0]


def test_a_rare_class_of_a_large_table_is_fitted(spark, monkeypatch):
    monkeypatch.setattr(nbsvm, "FIT_ROWS", 60)
    ids = spark.range(3_000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("hash"))
    rare = [r["doc_id"] for r in ids.orderBy(F.desc("hash")).limit(12).collect()]  # no sample of the lowest hashes holds them
    docs = ids.select("doc_id", F.when(F.col("doc_id").isin(rare), F.concat(F.lit("bad spam words "), F.col("doc_id"))).otherwise(
        F.concat(F.lit("good plain text "), F.col("doc_id"))).alias("text"))
    labels = ids.select("doc_id", (~F.col("doc_id").isin(rare)).cast("int").alias("quality"))
    scores = {r["doc_id"]: r["score"] for r in nbsvm.score(docs, nbsvm.learn(docs, labels)).collect()}
    assert max(scores[i] for i in rare) < min(s for i, s in scores.items() if i not in rare)

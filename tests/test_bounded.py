"""Seen-key filters and bounded token counts give what their exact forms give."""

import random

from pyspark.sql import functions as F

from emberline.operators import board as bd, features as ft, heavy, seen
from emberline import plans
from emberline.plans import views as v

KEYS = ["a", "b"]


def test_unseen_equals_anti_join_at_any_size_of_filter(spark):
    rng = random.Random(2)
    frame = lambda n, lo, hi: spark.createDataFrame([(rng.randrange(lo, hi), rng.choice(["x", "y", "z", None]), i) for i in range(n)], "a int, b string, i int")
    history, rows = frame(900, 0, 400).withColumn("day", F.col("i") % 3), frame(500, 200, 700)
    want = sorted(r["i"] for r in rows.join(history.select(*KEYS), KEYS, "left_anti").collect())
    for bits in (4, 12, 30):
        filters = seen.key_filters(history, KEYS, "day", bits=bits)
        assert sorted(r["i"] for r in seen.unseen(rows, history, filters, KEYS, bits).collect()) == want
        maybe = seen.possible_hits(rows, KEYS, filters, bits)
        assert rows.join(history.select(*KEYS).distinct(), KEYS, "left_semi").select("i").exceptAll(maybe.select("i")).count() == 0
    assert maybe.count() < rows.count() and 0 < len(want) < 500
    empty = history.limit(0)
    assert seen.unseen(rows, empty, seen.key_filters(empty, KEYS, "day"), KEYS).count() == 500


def test_history_is_scanned_and_not_shuffled(spark, sf):
    rows = v.board(spark, sf)
    history = rows.where("arrival % 2 = 0")
    found = bd.new_incidents_filtered(rows, history, bd.incident_filters(history))
    assert sorted(r["arrival"] for r in found.collect()) == sorted(r["arrival"] for r in bd.new_incidents(rows, history).collect())
    maybe = spark.createDataFrame([(1, "x")], "a int, b string")
    many = spark.range(100).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b"))
    seen_rows = many.select(*KEYS).join(F.broadcast(maybe), KEYS, "left_semi")
    assert "Exchange hashpartitioning" not in seen_rows._jdf.queryExecution().executedPlan().toString()


def test_frequent_tokens_equal_the_vocabulary(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(30_000)]
    df = spark.createDataFrame([(" ".join(words[i:i + 30]),) for i in range(0, len(words), 30)] + [(None,), ("",)], "message string").repartition(5)
    for size, kept in ((20, 100), (20, 5), (50, 100_000), (100_000, 50), (3, 1)):
        want = [tuple(r) for r in ft.build_vocabulary(df, size=size).orderBy("idx").collect()]
        assert [tuple(r) for r in heavy.frequent_tokens(df, size=size, kept=kept).orderBy("idx").collect()] == want
    assert heavy.frequent_tokens(df.limit(0)).count() == 0


def test_summaries_stay_small_and_within_their_error(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    df = spark.createDataFrame([([w],) for w in words], "t array<string>").repartition(3)
    rows = df.mapInArrow(heavy._summaries(40), "token string, n long").collect()
    lost = sum(r["n"] for r in rows if r["token"] is None)
    low = {}
    for r in rows:
        if r["token"] is not None:
            low[r["token"]] = low.get(r["token"], 0) + r["n"]
    assert len(rows) <= 3 * 81 and lost > 0
    for word in set(words):
        assert low.get(word, 0) <= words.count(word) <= low.get(word, 0) + lost


def test_a_board_is_made_once(spark, sf, monkeypatch):
    """Filters, possible hits and incidents are of one stored board; each used to make the board's windows again."""
    seen_plans = []
    real = bd.new_incidents_filtered

    def watched(board, history, filters):
        seen_plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in (board, history))
        return real(board, history, filters)

    monkeypatch.setattr(bd, "new_incidents_filtered", watched)
    found = plans.QUERIES["new_incidents_filtered"](spark, sf)
    assert len(seen_plans) == 2 and not any("Scan parquet" in p or "MapInArrow" in p for p in seen_plans)
    want = plans.QUERIES["new_incidents"](spark, sf)
    assert found.exceptAll(want).count() == 0 and found.count() == want.count() > 0

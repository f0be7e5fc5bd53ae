"""Compaction beside writers and readers: no row is lost, repeated or out of sight at any moment."""

from collections import Counter
from urllib.parse import unquote

import pytest

from emberline.plans import views as v
from emberline.schemas import ENRICHED_SCHEMA
from emberline.sinks import lake as sink
from emberline.sources import lake
from emberline.sources.files import delete_path, list_paths, write_new

BEFORE = "2024-01-20"


@pytest.fixture(scope="module")
def rows(spark, sf):
    return v.enriched(spark, sf).where("event_id < 400").cache()


def held(spark, root):
    return Counter(map(tuple, lake.scan_lake(spark, root).collect()))


def wanted(df):
    return Counter(map(tuple, df.select(*ENRICHED_SCHEMA.names).collect()))


def land(rows, root, *batches):
    for n in batches:
        sink.write_lake(rows.where(f"event_id % 5 = {n}"), root, n)


def data_files(spark, root):
    return list_paths(spark, f"{root}/source=*/*/*/*/*/*.parquet") + list_paths(spark, f"{root}/_compacted/*/*/*/*/*/*.parquet")


def test_batch_that_lands_during_compaction_stays(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    land(rows, root, 0, 1)
    made = sink.prepare_compaction(spark, root, BEFORE)
    assert held(spark, root) == wanted(rows.where("event_id % 5 < 2"))  # what is prepared isn't seen
    land(rows, root, 2)
    assert sink.commit_compaction(spark, root, made)
    assert held(spark, root) == wanted(rows.where("event_id % 5 < 3"))
    land(rows, root, 3)
    assert sink.compact(spark, root, BEFORE)  # takes the first one's files and the late batches
    assert held(spark, root) == wanted(rows.where("event_id % 5 < 4"))
    assert not sink.compact(spark, root, BEFORE)  # every day lies in one file now
    per_day = Counter(f.rsplit("/", 1)[0].split("source=", 1)[1] for f in
                      {r["file"] for r in lake.scan_lake(spark, root, positions=True).where("make_date(year, month, day) < '2024-01-20'").select("file").collect()})
    assert per_day and set(per_day.values()) == {1}


def test_stop_between_the_phases_then_a_batch_then_again(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    land(rows, root, 0, 1)
    sink.prepare_compaction(spark, root, BEFORE)  # never committed
    land(rows, root, 2)
    assert sink.compact(spark, root, BEFORE)
    land(rows, root, 3, 4)
    assert held(spark, root) == wanted(rows)
    before = len(data_files(spark, root))
    sink.sweep(spark, root, keep=0)
    assert held(spark, root) == wanted(rows)
    assert len(data_files(spark, root)) < before and len(list((tmp_path / "lake" / "_compacted").glob("compaction=*"))) == 1


def test_replays_of_compacted_batches_add_nothing(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    land(rows, root, 0, 1, 2)
    assert sink.compact(spark, root, BEFORE)
    land(rows, root, 1, 2)  # days before and after the date
    sink.write_lake(rows.where("event_id % 5 = 3"), root, "evening")
    sink.write_lake(rows.where("event_id % 5 = 3"), root, "evening")
    assert held(spark, root) == wanted(rows.where("event_id % 5 < 4"))


def test_replay_during_compaction_makes_it_give_up(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    land(rows, root, 0, 1)
    made = sink.prepare_compaction(spark, root, BEFORE)
    land(rows, root, 1)
    assert not sink.commit_compaction(spark, root, made)
    assert held(spark, root) == wanted(rows.where("event_id % 5 < 2")) and not list((tmp_path / "lake").glob("_compacted/*"))


def test_of_two_compactions_one_takes_effect(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    land(rows, root, 0, 1)
    first, second = (sink.prepare_compaction(spark, root, BEFORE) for _ in range(2))
    assert sink.commit_compaction(spark, root, second) and not sink.commit_compaction(spark, root, first)
    assert held(spark, root) == wanted(rows.where("event_id % 5 < 2"))


def test_names_of_sources_are_escaped(spark, rows, tmp_path):
    root = str(tmp_path / "lake äö %41")
    odd = rows.replace({"linux": "a b/c=%d+é", "ssh": "100%25"}, subset="source")
    land(odd, root, 0, 1)
    assert sink.compact(spark, root, BEFORE)
    land(odd, root, 1)
    sink.sweep(spark, root, keep=0)
    assert held(spark, root) == wanted(odd.where("event_id % 5 < 2"))


def test_files_passed_over_are_not_opened(spark, rows, tmp_path):
    root = str(tmp_path / "lake")
    land(rows, root, 0, 1)
    assert sink.compact(spark, root, "2030-01-01")
    removed = lake.commits(spark, root)[0].removed
    for file in removed:
        path = f"{root}/{unquote(file)}"
        delete_path(spark, path)  # with its checksum
        with open(path, "w") as f:
            f.write("no parquet")
    assert removed and held(spark, root) == wanted(rows.where("event_id % 5 < 2"))


def test_a_name_is_given_once(spark, tmp_path):
    assert write_new(spark, str(tmp_path / "c" / "1.json"), "a") and not write_new(spark, str(tmp_path / "c" / "1.json"), "b")
    assert (tmp_path / "c" / "1.json").read_text() == "a" and len(list((tmp_path / "c").iterdir())) <= 2  # and its checksum

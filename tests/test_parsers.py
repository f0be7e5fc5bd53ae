"""Line formats, keyword levels and file scans."""

import json
import os

import pytest
from pyspark.sql import functions as F

from emberline.functions import levels, text, times
from emberline.schemas import ENTRY_FIELDS
from emberline.sinks import topics as sink
from emberline.sources import files, formats

YEAR = 2024


def lines(spark, *values, host="h"):
    return spark.createDataFrame([(host, v) for v in values], "host string, value string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("line,want", [
    ("Jun  9 06:06:20 combo kernel: message", ("2024-06-09T06:06:20", "combo", "INFO", "kernel", "message")),
    ("Jun  9 06:06:20 combo sshd(pam_unix)[19939]: authentication failure; x: y",
     ("2024-06-09T06:06:20", "combo", "ERROR", "sshd(pam_unix)", "authentication failure; x: y")),
    ("Feb 29 06:06:20 combo kernel: a warning\t ", ("2024-02-29T06:06:20", "combo", "WARN", "kernel", "a warning")),
    ("Foo  9 06:06:20 combo kernel: debug on", ("Foo  9 06:06:20", "combo", "DEBUG", "kernel", "debug on")),
    ("Jun 99 06:06:20 combo kernel: critical", ("Jun 99 06:06:20", "combo", "FATAL", "kernel", "critical")),
    ("Jun  9 06:06:20 combo kernel: grüße ﬂow", ("2024-06-09T06:06:20", "combo", "INFO", "kernel", "grüße ﬂow")),
])
def test_linux(spark, line, want):
    r = one(formats.parse_linux(lines(spark, line), YEAR))
    assert (r["timestamp"], r["host"], r["level"], r["component"], r["message"]) == want
    assert r["source"] == "linux" and r["raw"] == line.rstrip()


def test_blank_and_foreign_lines_are_dropped(spark):
    df = lines(spark, "", "   ", "java.lang.Exception: boom", "\t\x1c")
    for parse in (lambda d: formats.parse_linux(d, YEAR), lambda d: formats.parse_ssh(d, YEAR), formats.parse_hadoop,
                  formats.parse_bgl, lambda d: formats.parse_android(d, YEAR)):
        assert parse(df).count() == 0
    assert [r["line"] for r in formats.unparsed(df, formats.LINUX_PATTERN).collect()] == ["java.lang.Exception: boom"]


def test_ssh(spark):
    r = one(formats.parse_ssh(lines(spark, "Dec 10 06:55:46 LabSZ sshd[24200]: Invalid user webmaster from 173.234.31.186"), YEAR))
    assert (r["component"], r["level"], r["host"]) == ("sshd[24200]", "WARN", "LabSZ")


@pytest.mark.parametrize("message,level", [
    ("error: invalid user x", "WARN"), ("Possible BREAK-IN ATTEMPT! fatal", "ERROR"), ("fatal: no", "FATAL"), ("Disconnecting", "INFO"), ("x", "INFO")])
def test_ssh_keyword_order(spark, message, level):
    assert one(lines(spark, message).select(levels.ssh_level(F.col("value")).alias("x")))["x"] == level


def test_hadoop_and_spark_share_the_pattern(spark):
    line = "2015-10-17 15:37:56,547 INFO [main] org.apache.hadoop.App: All: systems nominal"
    for parse, source in ((formats.parse_hadoop, "hadoop"), (formats.parse_spark_app, "spark")):
        r = one(parse(lines(spark, line, host="app_1")))
        assert (r["timestamp"], r["source"], r["host"], r["level"]) == ("2015-10-17T15:37:56.547", source, "app_1", "INFO")
        assert (r["component"], r["message"]) == ("org.apache.hadoop.App", "All: systems nominal")
    assert formats.parse_hadoop(lines(spark, line.replace("INFO", "TRACE"))).count() == 0


BGL = "{} 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02-M1-N0-C:J12-U11 RAS KERNEL {} message here"


def test_bgl(spark):
    r = one(formats.parse_bgl(lines(spark, BGL.format("-", "severe"))))
    assert (r["timestamp"], r["host"], r["level"], r["component"], r["message"]) == (
        "2005-06-03T15:42:50.363779", "R02-M1-N0-C:J12-U11", "ERROR", "RAS_KERNEL", "message here")
    alert = lines(spark, BGL.format("APPREAD", "FATAL"))
    assert formats.parse_bgl(alert).count() == 0
    assert one(formats.parse_bgl(alert, include_alerts=True))["level"] == "FATAL"


def test_android(spark):
    r = one(formats.parse_android(lines(spark, "01-01 00:00:00.000  1234  5678 I ActivityManager: message"), YEAR))
    assert (r["timestamp"], r["level"], r["component"], r["host"]) == ("2024-01-01T00:00:00", "INFO", "ActivityManager", "android-device")
    r = one(formats.parse_android(lines(spark, "12-31 23:59:59.120  1  2 V tag : m"), YEAR))
    assert (r["timestamp"], r["level"], r["component"]) == ("2024-12-31T23:59:59.120000", "DEBUG", "tag")
    r = one(formats.parse_android(lines(spark, "13-31 23:59:59.1234567  1  2 F tag: m"), YEAR))
    assert (r["timestamp"], r["level"]) == ("13-31 23:59:59.1234567", "FATAL")


def test_trace_summary(spark):
    names = ["E1", "E2", "E3", "E4", "E5", "E6", "E7"]
    df = spark.createDataFrame([
        ("t1", "0", "2.0", "1", "0", "0", "0", "0"), ("t2", "0", "0", "", None, "0", "0", "0"),
        ("t3", "1", "2", "3", "4", "5", "6", "7"), ("t4", "0.5", "abc", "0", "0", "0", "0", "1e2")], ["TaskID", *names])
    got = {r["component"]: r for r in formats.parse_hdfs_trace(df, "TaskID", names, "now", F.lit(True)).collect()}
    assert got["task:t1"]["message"] == "E2=2; E3=1" and got["task:t2"]["message"] == "empty trace"
    assert got["task:t3"]["message"] == "E1=1; E2=2; E3=3; E4=4; E5=5" and got["task:t4"]["message"] == "E1=0; E7=100"
    assert got["task:t1"]["raw"] == "t1,0,2.0,1,0,0,0,0" and got["task:t1"]["level"] == "ERROR"


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content.encode() if isinstance(content, str) else content)


@pytest.fixture
def data_dir(tmp_path):
    d = str(tmp_path / "logs dir")
    put(f"{d}/Linux.log", b"Jun  9 06:06:20 combo kernel: bad \xff byte\r\n\nJun 10 06:06:20 combo su(pam)[1]: error\n")
    put(f"{d}/SSH.log", "Dec 10 06:55:46 LabSZ sshd[1]: Failed password\n")
    java = "2015-10-17 15:37:56,547 WARN [main] a.B: m\n  at trace\n"
    put(f"{d}/hadoop/app 1+x%20/sub.log", java)
    put(f"{d}/hadoop/deep/er/other.log", java * 2)
    put(f"{d}/hadoop/deep/skip.txt", java)
    put(f"{d}/spark/container_01", java)
    put(f"{d}/spark/b.log", java)
    put(f"{d}/spark/nested/no.log", java)
    put(f"{d}/supercomputer/BGL.log", BGL.format("-", "info") + "\n" + BGL.format("KERNDTLB", "FATAL") + "\n")
    put(f"{d}/HDFS TraceBench/preprocessed/normal_trace.csv", "TaskID,a,b\nt1,1,0\n")
    put(f"{d}/HDFS TraceBench/preprocessed/failure_trace.csv", "TaskID,a,c\nt2,0,3\n")
    put(f"{d}/Android/z.log", "01-01 00:00:00.000  1  2 E tag: from z\n")
    put(f"{d}/Android/b.log", "01-01 00:00:00.000  1  2 E tag: from b\n")
    return d


def test_all_sources(spark, data_dir):
    df = files.read_all_sources(spark, data_dir, [*files.SCANS, "nonsense"], reference_year=YEAR, batch_time="2024-02-01T00:00:00")
    assert df.columns == ENTRY_FIELDS
    got = {}
    for r in df.collect():
        got.setdefault(r["source"], []).append(r)
    assert {s: len(x) for s, x in got.items()} == {
        "linux": 2, "ssh": 1, "hadoop": 3, "spark": 2, "supercomputer": 1, "hdfs": 2, "android": 1}
    assert {r["message"] for r in got["linux"]} == {"bad � byte", "error"}
    assert sorted(r["host"] for r in got["hadoop"]) == ["app 1+x%20", "er", "er"]
    assert sorted(r["host"] for r in got["spark"]) == ["b.log", "container_01"]
    assert {(r["component"], r["level"], r["message"]) for r in got["hdfs"]} == {("task:t1", "INFO", "a=1"), ("task:t2", "ERROR", "c=3")}
    assert got["android"][0]["message"] == "from b"
    assert all(r["level"] in {"DEBUG", "INFO", "WARN", "ERROR", "FATAL"} for rows in got.values() for r in rows)


def test_android_file_order(spark, data_dir):
    put(f"{data_dir}/Android/Android.log", "x")
    assert files.android_path(spark, data_dir).endswith("Android/Android.log")
    put(f"{data_dir}/Android.log", "x")
    assert files.android_path(spark, data_dir).endswith("dir/Android.log")


def test_missing_files_give_no_rows_and_unknown_names_fail(spark, tmp_path):
    args = {"reference_year": YEAR, "batch_time": "x"}
    assert files.read_all_sources(spark, str(tmp_path), list(files.SCANS), **args).count() == 0
    with pytest.raises(ValueError):
        files.read_all_sources(spark, str(tmp_path), ["nonsense"], **args)


def test_registered_format(spark, tmp_path):
    files.register_format("mine", lambda spark, d, **_: formats.parse_ssh(
        lines(spark, "Dec 10 06:55:46 L sshd[1]: x"), YEAR).select(*ENTRY_FIELDS))
    try:
        assert files.read_all_sources(spark, str(tmp_path), ["mine"]).count() == 1
    finally:
        del files.SCANS["mine"]


def test_entry_json_has_seven_keys_and_keeps_nulls(spark):
    df = spark.createDataFrame([("t", "linux", None, "l", "c", "m", "r")], ", ".join(f"{n} string" for n in ENTRY_FIELDS))
    r = one(sink.raw_messages(df))
    assert r["key"] == "linux" and list(json.loads(r["value"])) == ENTRY_FIELDS and json.loads(r["value"])["host"] is None


@pytest.mark.parametrize("stamp,want", [
    ("2015-10-17T15:37:56.547", "2015-10-17T15:37:56.547000"), ("2015-10-17T15:37:56", "2015-10-17T15:37:56.000000"),
    ("2015-10-17T15:37:56Z", "2015-10-17T15:37:56.000000"), ("2015-1-7t5:3:6.5z", "2015-01-07T05:03:06.500000"),
    ("2015-10-17T15:37:56+02:00", None), ("2015-10-17", None), ("2015-02-30T00:00:00", None), ("", None), (None, None),
    ("0000-01-01T00:00:00", None), ("2015-10-17T15:37:56\n", None), ("2015-10-17T15:37:60", None)])
def test_parse_iso(spark, stamp, want):
    df = spark.createDataFrame([(stamp,)], "t string")
    assert one(df.select(F.date_format(times.parse_iso(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("x")))["x"] == want


def test_rendered_time_reads_back_with_offsets_accepted(spark):
    df = spark.createDataFrame([("2015-10-17T15:37:56.547Z",)], "t string")
    text_of = df.select(times.iso_utc(times.parse_iso(F.col("t"))).alias("t"))
    assert one(text_of)["t"] == "2015-10-17T15:37:56.547000+00:00"
    both = text_of.select(times.parse_iso(F.col("t")).alias("a"), times.iso_utc(times.parse_iso(F.col("t"), True)).alias("b"))
    assert one(both)["a"] is None and one(both)["b"] == one(text_of)["t"]


def test_right_trim_takes_all_white_space(spark):
    df = spark.createDataFrame([("a b \t \x1f ",)], "v string")
    assert one(df.select(text.right_trimmed(F.col("v")).alias("x")))["x"] == "a b"

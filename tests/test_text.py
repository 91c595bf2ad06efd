import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import text as T
from tessera.operators import markdown

DIR = "/root/testdata/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_tokens(spark):
    got = one(spark, T.tokens, "Cider 埋点平台", "", None, "字", "K8S-12 的 café", "ＡＢＣ１ ﬁle")
    assert got == [["cider", "埋点", "点平", "平台"], [], [], [], ["k8s-12", "caf"], ["abc1", "file"]]


@pytest.mark.parametrize(("text", "want"), [("99%分位", "p99"), ("P99", "p99"), ("九九分位", "p99"), ("p99.90", "p99.9"), ("p05", "p5"), ("xp99", "xp99")])
def test_percentiles(spark, text, want):
    assert one(spark, T.canonical_percentiles, text)[0].strip() == want


def test_identifiers(spark):
    assert one(spark, T.is_identifier, "adb", "99", "the", "k", "埋点") == [True, False, False, False, False]


def test_numeric_noise(spark):
    assert one(spark, T.numeric_noise, "1,2;3.4" * 10, "word " * 20, "1" * 49, None) == [True, False, False, False]


def test_line_noise(spark):
    assert one(spark, T.line_noise, "#a #b/c", "https://x.example/a", "---", "text é", "") == [True, True, True, False, True]


def noise(line):
    tag, url = r"(?:#[\w/-]+\s*)+", r"(?:https?://[^\s一-鿿，。！？；：、]+[.。]?\s*)+"
    return any(re.fullmatch(p, line.strip(" ")) for p in (tag, url, r"[\W_]*"))


def test_line_noise_of_every_script_against_brute_force(spark):
    texts = ["#标签 #c端\n这是正文\n#标签 正文\n。。。！？\n", "café\n—…—\n❤️ 👩‍💻\n①②\n½\nStraße", "https://x.example/文\nhttps://x.example/a，详见说明\nhttps://x.example/a。\n　", "plain\n#a #b/c\n---\nhttps://x.example/a https://y.example", None, ""]
    lines = [x for t in texts if t is not None for x in t.split("\n")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [noise(x) for x in lines] == one(spark, T.line_noise, *lines)
    assert {r["noise"]: r["lines"] for r in markdown.line_noise(df).collect()} == dict(Counter(map(noise, lines)))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_line_noise_of_the_documents_against_brute_force(spark):
    texts = [r[0] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect() if r[0] is not None]
    got = {r["noise"]: r["lines"] for r in entry.queries()["line_noise_all"](spark, DIR).collect()}
    assert got == dict(Counter(noise(x) for t in texts for x in t.split("\n")))
    assert sum(got.values()) > sum(r["lines"] for r in entry.queries()["line_noise"](spark, DIR).collect())


def test_urls(spark):
    got = one(spark, T.web_url, "HTTPS://Ex.COM//a//b/?utm_source=x&q=1&ref=2#f", "http://a.example:8080", "no url", "http://a.example/?b")
    assert got == ["https://ex.com/a/b?q=1", "http://a.example:8080/", "no url", "http://a.example/?b="]


def test_catalog(spark):
    assert one(spark, T.catalog_text, "  Ａb \t C ", None) == ["ab c", ""]
    assert one(spark, T.catalog_tokens, "记忆系统 ab-1 字") == [["ab-1", "记忆", "忆系", "系统", "记忆系", "忆系统", "字"]]


def test_headings(spark):
    assert one(spark, T.heading_parent, "A > B > C", "A", "") == ["A > B", "", ""]


def test_snippet_and_redaction(spark):
    text = "x" * 100 + " needle " + "y" * 100
    got = one(spark, lambda c: T.snippet(c, ["needle"], 40), text, "short needle")
    assert got[0].startswith("…") and got[0].endswith("…") and "needle" in got[0] and got[1] == "short needle"
    assert one(spark, lambda c: T.redacted(c, {"Ann": "A", "Anna": "B"}), "Anna, Ann") == ["B, A"]

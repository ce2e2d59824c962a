import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, records, score, url


def features(spark, *urls):
    rows = url.lexical_features(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    return {r["url"]: r.asDict() for r in rows}


def test_lexical_goldens(spark):
    f = features(spark, "https://google.com", "http://127.0.0.1:8000/admin", "https://console.aws.amazon.com/s3", "chrome-extension://xyz123/background.js", "https://www.notion.so/workspace/page", "https://UP.example.com/x", "http://a.com:99999/", None, "no host", "https://e.com/?a=1&b=&a=2&c=%20")
    assert f["https://google.com"]["url_entropy"] == pytest.approx(3.5724312513221195)
    local = f["http://127.0.0.1:8000/admin"]
    assert (local["ip_category"], local["is_ip_address"], local["port"], local["is_unknown_port"], local["domain_quality"]) == ("private", 1, 8000, 1, "no_tld")
    aws = f["https://console.aws.amazon.com/s3"]
    assert (aws["num_subdomains"], aws["subdomain_length"], aws["tld_length"]) == (2, 10, 3)
    assert f["chrome-extension://xyz123/background.js"]["file_type"] == "script"
    assert f["https://UP.example.com/x"]["has_double_slash_redirect"] == 1
    assert f["https://e.com/?a=1&b=&a=2&c=%20"]["num_query_params"] == 2
    assert not {"http://a.com:99999/", None, "no host"} & f.keys()


def test_validate(spark):
    cases = {"http://" + "a" * 3000: "too long", "http": "too short", "javascript:alert(1)": "blocked pattern javascript:", "gopher://example.com": "scheme not allowed", "https://ok.example": None, None: "not a string"}
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", url.validate(F.col("url")).alias("v"))
    assert {r["url"]: r["v"]["reason"] for r in df.collect()} == cases


def test_versions_and_labels(spark):
    df = spark.createDataFrame([("url_catboost_v1.2.3.pkl", " PHISH "), ("x", "1.0"), (None, None)], "name string, label string")
    rows = df.select(url.semantic_version(F.col("name")).alias("v"), labels.strict_label(F.col("label")).alias("s"), labels.loose_label(F.col("label")).alias("l")).collect()
    assert [(r.v, r.s, r.l) for r in rows[:2]] == [("v1.2.3", 1, 0), ("v1.0.0", None, 0)]
    assert rows[2].l == 0


def test_list_size(spark):
    texts = ["['15169', '15169']", "[]", "['MarkMonitor', \"O'Neil\"]", None, "x", "[1, 2, 3]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(labels.list_size(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [2, 0, 2, 0, 0, 3]


def test_scores(spark):
    df = spark.createDataFrame([(0.9, None, 0.3), (None, None, None)], "a double, b double, c double")
    p = score.weighted([(F.col("a"), 0.6), (F.col("b"), 0.15), (F.col("c"), 0.25)])
    got = [r.p for r in df.select(p.alias("p")).collect()]
    assert got == [pytest.approx((0.9 * 0.6 + 0.3 * 0.25) / 0.85), 0.5]


def test_registration_dates(spark):
    df = spark.createDataFrame([(["2020-01-02T03:04:05Z"],), (["2020-01-02 03:04:05+00:00", "x"],), (["junk"],), ([],), (None,)], "d array<string>")
    got = [r.t for r in df.select(records.parse_date(F.col("d")).alias("t")).collect()]
    assert got == [dt.datetime(2020, 1, 2, 3, 4, 5)] * 2 + [None] * 3

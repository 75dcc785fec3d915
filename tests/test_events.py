"""Event sanitising in batch and as a file-source stream; publish gate; compaction."""

import json
import re

import pytest
from pyspark.sql import functions as F

from postmill.plans import publish
from postmill.sources import pages, postings
from postmill.streaming import events

PAYLOAD = {"apiKey": "x", "user-Email": "a", "resumeURL": "u", "count": 2, "ok": True, "long": "t" * 300, "list": list(range(40)), "gone": None,
           "inner": {"token": 1, "deep": [{"phone": "1", "note": "n", "step": 3}]}}


def test_payload(spark):
    deep = json.dumps({"a": [[[[[[1]]]]]]})
    texts = [json.dumps(PAYLOAD), None, "", "not json", "[1]", deep, json.dumps({"q\"u": 'é " \\ {', "list": ["x" * 300, None, {"sessionToken": [1]}]})]
    df = spark.createDataFrame([(i, "weekly_return", "web", t) for i, t in enumerate(texts)], "id int, event_type string, source string, payload string")
    clean = events.sanitize_events(df)
    assert "Python" not in clean._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: json.loads(r["payload"]) for r in clean.collect()}
    out = got[0]
    assert out["apiKey"] == out["user-Email"] == out["resumeURL"] == "[redacted]"
    assert (out["count"], out["ok"], len(out["long"]), len(out["list"])) == (2, True, 256, 25)
    assert "gone" not in out and out["inner"] == {"token": "[redacted]", "deep": [{"phone": "[redacted]", "note": "[redacted]", "step": 3}]}
    assert got[1] == got[2] == {} and got[6] == {"q\"u": 'é " \\ {', "list": ["x" * 256, None, {"sessionToken": "[redacted]"}]}
    reasons = {r["id"]: r["reason"] for r in events.rejected_events(df).collect()}
    assert reasons == {3: "payload is not JSON", 4: "payload is not an object"}
    assert got[5] == json.loads(deep)


def test_deep_payloads_are_cleaned(spark):
    def nested(value, levels):
        for i in range(levels):
            value = {"a b": value, "userToken" if i % 2 else "myToken": i} if i % 3 else [value, None, "y" * 300]
        return value

    def cleaned(key, value):  # items that are NULL stay so
        if re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", key).lower() in ("my_token", "user_token"):
            return "[redacted]"
        if isinstance(value, dict):
            return {k: cleaned(k, v) for k, v in sorted(value.items()) if v is not None}
        if isinstance(value, list):
            return [cleaned(key, v) for v in value[:25]]
        return value[:256] if isinstance(value, str) else value

    hard = {"q\"u:": 'é " \\ {[,:', "": [], "e": {}, "n": None, "f": [1.5, -2, 1e30, True, [None, {"x": None, "y": "a:"}]], "z": "t" * 20000, "wide": [[{"k": i}] for i in range(40)]}
    payloads = [nested(hard, n) for n in (7, 8, 60)] + [
        {"keep": 1, "myToken": nested([1], 9)}, {"list": list(range(25)) + [nested({"x": 1}, 9)], "after": [2]}, {"a": [[[[[[1]]]]]]},
    ]
    payloads = [{"top": p} for p in payloads]
    rows = [(i, "weekly_return", "web", json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "id int, event_type string, source string, payload string")
    clean = events.sanitize_events(df)
    assert "Python" not in clean._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: json.loads(r["payload"]) for r in clean.collect()} == {i: cleaned("", p) for i, p in enumerate(payloads)}
    assert events.rejected_events(df).count() == 0
    chain = spark.createDataFrame([("weekly_return", "web", '{"a":' * 900 + "1" + "}" * 900)], "event_type string, source string, payload string")
    assert events.sanitize_events(chain).first()["payload"] == chain.first()["payload"] and events.rejected_events(chain).count() == 0


def test_odd_payloads_keep_their_values(spark):
    texts = ['{"s": "/\u00e9\u2028\\t<\\"", "l": [[], {}], "n": 1e30, "z": -0.5, "t": true}', "{}", " ", '{"": {"": [null]}}', '{"a:": "b:", "c": "x,:[]{}"}']
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = [json.loads(r["payload"]) for r in events.sanitize_metadata(df).collect()]
    assert got == [json.loads(t) if t.strip() else {} for t in texts]


def test_contract_has_54_names():
    assert len(set(events.EVENT_NAMES)) == 54


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, [" Weekly_Return", "hacked", "vacancy_saved"][i % 3], ["WEB", "fax", None][i % 3], json.dumps({"email": "a", "n": i})) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, event_type string, source string, payload string")
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = events.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "event_type", "source", "payload").collect())
    want = sorted(tuple(r) for r in events.sanitize_events(df).select("id", "event_type", "source", "payload").collect())
    assert got == want and len(got) == 20 and got[0][1:3] == ("weekly_return", "web")


def test_one_stream_writes_clean_and_rejected_events(spark, tmp_path):
    rows = [(i, ["weekly_return", "hacked", "vacancy_saved"][i % 3], "web", ["{}", "[1]", "no"][i % 5 % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, event_type string, source string, payload string")
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        assert events.write_judged_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    for status, want in (("accepted", events.sanitize_events(df)), ("rejected", events.rejected_events(df))):
        got = sorted(tuple(r) for r in out.where(F.col("status") == status).select("id", "event_type", "payload").collect())
        assert got == sorted(tuple(r) for r in want.select("id", "event_type", "payload").collect()) and got


def test_pointer_moves_only_when_gates_pass(spark, tmp_path):
    root = str(tmp_path)
    good = spark.createDataFrame([("a", True)], "name string, passed boolean")
    bad = spark.createDataFrame([("a", True), ("min_rows", False)], "name string, passed boolean")
    publish.write_run({"t": spark.range(3)}, root, "r1")
    publish.publish_run(spark, root, "r1", good)
    publish.write_run({"t": spark.range(5)}, root, "r2")
    with pytest.raises(publish.GateFailed, match="min_rows"):
        publish.publish_run(spark, root, "r2", bad)
    assert publish.latest_run(spark, root) == "r1" and publish.read_latest(spark, root, "t").count() == 3


def test_compaction(spark, tmp_path):
    src, dst = str(tmp_path / "d"), str(tmp_path / "m")
    for day in ("2026-01-30", "2026-01-31", "2026-02-01"):
        df = spark.createDataFrame([(1, "a"), (2, "b")], "vacancy_id int, title string")
        postings.write_daily_snapshot(df, src, day)
    assert postings.compact_monthly(spark, src, dst) == ["2026-01", "2026-02"]
    assert spark.read.parquet(dst).count() == 6 and postings.compact_monthly(spark, src, dst) == []
    types = postings.unified_schema([spark.createDataFrame([], "a string, b string").schema, spark.createDataFrame([], "a string, b string, c string").schema])
    assert list(types) == ["a", "b", "c"]
    wide = postings.union_with_schema([spark.createDataFrame([("1", "2")], "a string, b string"), spark.createDataFrame([("1", "2", "five")], "a string, b string, c string")], types)
    assert [r["c"] for r in wide.collect()] == [None, "five"]


def test_posting_page(spark):
    html = """<html><body><h1 data-qa="vacancy-title">Senior <b>Data</b> Analyst</h1><div data-qa="vacancy-salary">от 100&nbsp;000 до 200&nbsp;000 ₽ на руки</div>
    <a data-qa="vacancy-company-name" href="/employer/1">ООО &amp; Co</a><span data-qa="vacancy-view-raw-address">Казань, метро Кремлёвская</span>
    <span data-qa="vacancy-experience">3–6 лет</span><p>Полная занятость</p><p>Формат работы: удалённо</p>
    <div data-qa="vacancy-description"><div><p>Требования</p><ul><li>- python</li><li>- SQL и clickhouse</li></ul></div><p>Будет плюсом</p><p>spark</p></div>
    <span data-qa="bloko-tag__text">SQL</span><span data-qa="bloko-tag__text">sql</span><script>var x="<p>";</script>
    <p>Вакансия опубликована 3 февраля 2026 в Казани</p></body></html>"""
    df = spark.createDataFrame([("https://x/vacancy/77?a=1", html), ("https://x/other", None)], "url string, html string")
    out = pages.extract_page_fields(df, F.lit("2026-02-10").cast("timestamp")).orderBy(F.desc("vacancy_id")).collect()
    r = out[0]
    assert (r["vacancy_id"], r["title"], r["company"], r["city"]) == ("77", "SeniorDataAnalyst", "ООО & Co", "Казань")
    assert (r["salary_from"], r["salary_to"], r["salary_mid"], r["currency"], r["salary_gross"]) == (100000, 200000, 150000.0, "RUB", False)
    assert (r["exp_min_years"], r["work_format"], r["employment_type"], r["published_at_iso"]) == (3, "remote", "Полная занятость", "2026-02-03")
    assert r["skill_sql"] and r["has_python"] and r["skills"] == "SQL" and r["requirements_count"] == 2
    assert (r["must_have_skills_count"], r["optional_skills_count"], r["metro_primary"]) == (3, 1, "Кремлёвская")
    assert out[1]["vacancy_id"] == ""


def test_listing(spark):
    html = '<a data-qa="serp-item__title" href="/vacancy/1?q=x">a</a><a href="/no">b</a><a href="https://y/vacancy/2" data-qa="serp-item__title">c</a>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert [r["link"] for r in pages.extract_listing_links(df, F.lit("https://x")).orderBy("position").collect()] == ["https://x/vacancy/1", "https://y/vacancy/2"]

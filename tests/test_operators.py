"""Micro-fixtures: the edges that tables don't show."""

import base64
import datetime as dt
import io
import math
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, special
from tidemark.operators import classify, events, portfolio, relational, sections, stats, text, timeseries
from tidemark.sources import readers
from tidemark.streaming import streams

D = dt.date


def column(df, c, order):
    return [r[c] for r in df.orderBy(order).collect()]


def test_gap_pairs(spark):
    df = spark.createDataFrame([(1, y, t) for y, t in ((2015, "aa bb"), (2016, "aa bb"), (2017, ""), (2018, "cc dd"))], "e long, y int, t string")
    out = text.adjacent_similarity(df, "e", "y", "t", min_df=1, max_df=1.0)
    assert [(r["y_prev"], r["y_curr"], r["cosine_similarity"]) for r in out.orderBy("y_curr").collect()] == [(2015, 2016, 1.0), (2016, 2018, 0.0)]


def test_vocabulary_bounds(spark):
    rows = [(i, " ".join(t for t, n in (("one", 1), ("two", 2), ("edge", 17), ("all", 18)) if i < n) or "pad") for i in range(20)]
    counts = text.term_counts(spark.createDataFrame(rows, "d long, t string"), ["d"], "t")
    assert sorted(r["term"] for r in text.vocabulary(counts, 20).collect()) == ["edge", "pad", "two"]


def test_normalize(spark):
    df = spark.createDataFrame([("  A 1.234,5%  b ",)], "t string")
    assert df.select(text.normalize(F.col("t"))).first()[0] == "a NUM b"


def test_terms_in_one_pass(spark):
    rows = [("A 1.234,5% b2b x_y ab12cd ... ½x Ⅷ٣ ÀÉ a.b",), ("",), (None,), ("12",), ("日本 ab\tcd\u00a0ef",)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select(text.terms(F.col("t")).alias("a"), text.tokens(text.normalize(F.col("t"))).alias("b")).collect():
        assert r["a"] == r["b"]


@pytest.mark.parametrize("values,want", [([1, 2, 2, 2, 3, 4, 5, 6], [0, 0, 0, 0, 1, 2, 2, 2]), ([1, 1, 1, 1, 1, 9], None)])
def test_qcut(spark, values, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    out = portfolio.qcut(df, [], "v", 3)
    assert out.count() == 0 if want is None else column(out, "bucket", "i") == want


def test_month_clamp(spark):
    df = spark.createDataFrame([(D(2020, 1, 31),)], "entry date")
    assert column(portfolio.active_positions(df, "entry", 3, "2020-01-01", "2020-12-31"), "month", "month") == [D(2020, 1, 31), D(2020, 2, 29), D(2020, 3, 31), D(2020, 4, 30)]


def test_entry_month(spark):
    df = spark.createDataFrame([(D(2020, 3, 15),), (D(2020, 4, 1),), (D(2020, 3, 31),)], "d date")
    assert [r[0] for r in df.select(scalars.entry_month(F.col("d"))).collect()] == [D(2020, 4, 30), D(2020, 5, 31), D(2020, 4, 30)]


def test_nth_observation(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1) + dt.timedelta(i), float(i)) for i in range(253)], "k long, d date, p double")
    assert timeseries.nth_following(df, "k", "d", "p", 252).where("p_n is not null").count() == 1
    assert timeseries.nth_following(df.where("p < 252"), "k", "d", "p", 252).where("p_n is not null").count() == 0


def test_bracket_edges(spark):
    day = D(2020, 1, 1)
    est = [(1, day, 10.0), (1, day + dt.timedelta(140), 11.0), (2, day, 0.01), (2, day + dt.timedelta(141), 1.0), (3, day, 0.01), (3, day + dt.timedelta(3), 0.02)]
    ev = spark.createDataFrame([(k, day) for k in (1, 2, 3, 4)], "k long, d date")
    out = events.bracket_revision(ev, spark.createDataFrame(est, "k long, d date, v double"), "k", "d", "v").orderBy("k").collect()
    assert [(r["pre"], r["post"]) for r in out] == [(10.0, 11.0), (None, None), (0.01, 0.02), (None, None)]
    assert out[0]["revision_pct"] == pytest.approx(0.1) and out[2]["revision_pct"] is None


def test_coalesced_cells_and_priority(spark):
    a = spark.createDataFrame([(1, None, 2.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, 5.0, 9.0), (2, 7.0, None)], "k long, x double, y double")
    assert sorted(map(tuple, relational.coalesce_outer(a, b, ["k"]).collect())) == [(1, 5.0, 2.0), (2, 7.0, None)]
    assert {r["k"]: r["y"] for r in relational.union_by_priority([a, b], ["k"]).collect()} == {1: 2.0, 2: None}


def test_row_sum(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert [tuple(r) for r in df.select(relational.row_sum(["a", "b"]), relational.row_sum(["a", "b"], 1)).collect()] == [(1, 1), (0, None)]


def test_tiers(spark):
    rows = [(1, "notes", 5), (1, "statement", 9), (2, "opaque", 5), (2, "release", 9), (3, "release", 4), (3, "release2", 6)]
    df = spark.createDataFrame(rows, "f long, name string, size long")
    out = classify.tiered_select(df, "f", "size", [F.col("name") == "notes", F.col("name") == "statement"], F.col("name").startswith("release"), "name")
    assert sorted((r["f"], r["name"], r["match_tier"]) for r in out.collect()) == [(1, "notes", 1), (2, "opaque", 3), (3, "release2", 3)]


DEBT = sections.Topic(("loan", "debt"), ("debt",), ("and", "of"))


def line(no, t, size=10.0, bold=False, page=1):
    return (7, no, page, t, size, bold)


@pytest.mark.parametrize("extra,want", [
    ([line(3, "LOANS AND DEBT", 12.0, True), line(4, "body of it"), line(5, "OTHER THINGS", 12.0, True)], ("font_heading", "LOANS AND DEBT", 3, 4)),
    ([line(3, "12", 10.0, True), line(4, "DEBT NOTE", 10.0, True), line(5, "text"), line(6, "13", 10.0, True)], ("font_heading", "12", 3, 5)),
    ([line(3, "the debt was paid")], ("regex_only", "the debt was paid", 3, 3)),
    ([line(3, "nothing here")], ("not_found", None, None, None)),
])
def test_locator(spark, extra, want):
    rows = [line(0, "ordinary text"), line(1, "more text"), line(2, "and more"), *extra]
    df = spark.createDataFrame(rows, "doc long, line_no int, page int, text string, size double, bold boolean")
    r = sections.locate_section(df, "doc", DEBT).first()
    assert (r["diagnostic"], r["heading"], r["start_line"], r["end_line"]) == want


def test_bookmarks(spark):
    df = spark.createDataFrame([(1, 0, "Intro", 1), (1, 1, "Debt", 4), (1, 2, "Sub", 4), (1, 3, "Next", 9)], "doc long, seq int, title string, page int")
    assert tuple(sections.by_bookmark(df, "doc", DEBT).first()) == (1, "Debt", 4, 8)


def test_span_limits(spark):
    df = spark.createDataFrame([(1, 199, "START"), (1, 900, "tail"), (2, 200, "START")], "d long, line_no int, line string")
    assert [tuple(r) for r in text.between_patterns(df, ["d"], "^START", "^END").collect()] == [(1, 199, 799)]


def test_tail_probabilities():
    assert special.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-9) and special.chi2_upper(4.0, 2) == pytest.approx(math.exp(-2))
    assert special.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)


def test_fixed_effects(spark):
    rows = [(e, t, 2.0 * ((e * 7 + t * t) % 5) + e + 3 * t, float((e * 7 + t * t) % 5)) for e in range(8) for t in range(6) if (e + t) % 7]
    found = stats.two_way_fe(spark.createDataFrame(rows, "e long, t long, y double, x double"), "y", ["x"], "e", "t")
    assert found["terms"][0]["coef"] == pytest.approx(2.0) and not found["degenerate"]
    flat = spark.createDataFrame([(e, t, float(e), x) for e, t, _, x in rows], "e long, t long, y double, x double")
    assert stats.two_way_fe(flat, "y", ["x"], "e", "t")["degenerate"]


def test_gates(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), i % 4, i % 2) for i in range(30)], "y double, x double, g long, h int")
    few = [r["test"] for r in stats.battery(df.limit(9), "l", "y", "x", "g")]
    assert few == ["coverage_too_low"]
    tests = [r["test"] for r in stats.battery(df.where("y < 19"), "l", "y", "x", "g", ["h"], "h")]
    assert "clustered_ols_with_controls" not in tests and "group_mann_whitney" in tests
    low = stats.specifications({"a": df.where("g < 3"), "b": df.where("y < 10")}, "y", "x", {"none": []}, "g", 20, 4)
    assert [(r["coef"], r["p_value"]) for r in low] == [(None, None)] * 2


def test_locator_branches(spark):
    """A contents list, a bookmark, merged numbered sections, running lines, lettered markers."""
    kind = "doc long, line_no int, page int, text string, size double, bold boolean"
    body = [line(i, f"plain words {i}", page=i // 4 % 10) for i in range(40)]

    def locate(extra, bookmarks=None):
        df = spark.createDataFrame(body + extra, kind)
        marks = None if bookmarks is None else spark.createDataFrame(bookmarks, "doc long, seq int, title string, page int")
        return sections.locate_section(df, "doc", DEBT, marks).first()

    toc = [line(50 + 2 * i + k, t, bold=True) for i in range(3) for k, t in enumerate((str(i + 1), ("CASH", "DEBT", "TAXES")[i]))]
    real, at = [line(69 - i, "between") for i in range(8)], 70
    for number, title in (("2", "DEBT"), ("3", "LOANS AND DEBT"), ("4", "TAXES")):
        real += [line(at, number, 12.0, True), line(at + 1, title, 12.0, True), *(line(at + 2 + i, f"{title.lower()} text {i}") for i in range(8))]
        at += 10
    r = locate(toc + real)
    assert (r["diagnostic"], r["start_line"], r["end_line"], r["heading"]) == ("font_heading", 70, 89, "2")
    lines = r["text"].split("\n")
    assert len(lines) == 20 and lines[:3] == ["2", "DEBT", "debt text 0"] and lines[-1] == "loans and debt text 7"
    r = locate(toc)
    assert (r["diagnostic"], r["heading"], r["start_line"]) == ("regex_only", "DEBT", 53)
    r = locate([line(50, "(o) debt", 12.0, True), line(51, "Debt", 12.0, True), line(52, "owed"), line(53, "Other matters", 12.0, True)])
    assert (r["heading"], r["end_line"]) == ("Debt", 52)
    r = locate([line(50, "DEBT OF", 12.0, True), line(51, "LONG TERM", 12.0, True)] + [line(52 + i, t, page=i) for i, t in enumerate(("Example Inc", "owed") * 5)] + [line(70, "OTHER MATTERS", 12.0, True)])
    assert (r["start_line"], r["end_line"]) == (50, 61) and "Example Inc" not in r["text"] and r["text"].startswith("DEBT OF\nLONG TERM")
    r = locate(real, [(7, 0, "Intro", 1), (7, 1, "Our debt", 3), (7, 2, "Sub", 3), (7, 3, "End", 5)])
    assert (r["diagnostic"], r["heading"], r["start_line"]) == ("font_heading", "Our debt", None) and r["text"].split("\n")[0] == "plain words 12" and len(r["text"].split("\n")) == 8
    assert locate([], [(7, 0, "Intro", 1)])["diagnostic"] == "not_found"


def test_plans_without_one_task(spark):
    """Ranks and sections need no Python, and ranks no single task over all rows."""
    df = spark.createDataFrame([(float(i % 50), float(i % 7)) for i in range(500)], "x double, y double").repartition(4)
    plan = stats.average_ranks(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    lines = spark.createDataFrame([line(0, "DEBT")], "doc long, line_no int, page int, text string, size double, bold boolean")
    assert "Python" not in sections.locate_section(lines, "doc", DEBT)._jdf.queryExecution().executedPlan().toString()


def test_archives_and_attachments(spark, tmp_path):
    inner = base64.b64encode(b"PDF!").decode()
    xml = f"<?xml version='1.0' encoding='utf-8'?><r xmlns='u'><a><n>one.pdf</n><c>{inner}</c></a><a><n>none</n><c/></a></r>"
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("d.xml", xml), z.writestr("t_2020.csv", "K;V\n1;x\n2;é\n".encode("latin-1"))
    nested = io.BytesIO()
    with zipfile.ZipFile(nested, "w") as z:
        z.writestr("attachments.xml", xml.replace("one", "two"))
    with zipfile.ZipFile(tmp_path / "old.zip", "w") as z:
        z.writestr("x.zip", nested.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = readers.read_attachments(spark, str(tmp_path), "a", "n", "c").collect()
    assert sorted((r["filename"] or "", bytes(r["content"] or b""), r["error"] or "") for r in rows) == [("", b"", "BadZipFile"), ("one.pdf", b"PDF!", ""), ("two.pdf", b"PDF!", "")]
    table = readers.read_zip_member(spark, str(tmp_path), r"t_\d+\.csv", ["K", "V"])
    assert sorted((r["K"], r["V"]) for r in table.collect()) == [("1", "x"), ("2", "é")]
    assert readers.zip_errors(spark, str(tmp_path)).count() == 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,AB BS Equity,CD BS Equity\nfield,PX,PX\n01/31/2020,1.5,#N/A\n")
    wide = readers.read_with_unit_row(spark, str(tmp_path / "p.csv"), "date", "MM/dd/yyyy")
    long = readers.to_long(wide, "date", " BS Equity", "ticker", "px")
    assert sorted(map(tuple, long.collect()), key=str) == [(D(2020, 1, 31), "AB", 1.5), (D(2020, 1, 31), "CD", None)]
    (tmp_path / "l.csv").write_bytes("a;b\nx;ação\n".encode("latin-1"))
    assert readers.read_delimited(spark, str(tmp_path / "l.csv")).first()["b"] == "ação"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/000123_2019.json").write_text('{"text": "t"}')
    r = readers.read_json_documents(spark, str(tmp_path / "docs"), "text string", r"(\d+)_(\d+)\.json", ["id", "year"]).first()
    assert (r["text"], r["id"], r["year"]) == ("t", "000123", "2019")
    df = spark.createDataFrame([(1,)], "a int")
    for _ in range(2):
        readers.append_run(df, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    assert readers.literal_map(spark, {1: "a", 2: "b"}, {2: "c"}).orderBy("entity_id").collect()[1]["name"] == "c"


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1.0), (1, dt.datetime(2024, 1, 1), 2.0), (2, dt.datetime(2024, 1, 2), 3.0)], "k long, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    streams.first_within(stream, ["k"], "ts", "1 day").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 2
    query = streams.vintages(stream, ["k"], "ts", "v", "2 days", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("wins")
    query.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("wins").count() == 4


def test_accents_of_every_character(spark):
    """Compatibility decomposition without marks, for all code points, in texts of many."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c]
    texts = ["|".join(chars[i : i + 256]) for i in range(0, len(chars), 256)] + ["plain", "", "Å\u0301\u0327ﬁ½한국 ﷺ"]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", scalars.fold_accents(F.col("t")).alias("t")).collect())
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(scalars.fold_accents(F.col("t"))).first()[0] is None


def test_terms_are_counted_inside_rows(spark, monkeypatch):
    """Only keys are shuffled for counts; repeated keys are put together; terms beyond those broadcast are not lost."""
    rows = [(1, 1, "ab cd ab 12 ef"), (1, 2, "ab cd é 3,4 gh gh"), (1, 3, "zz ab gh cd"), (2, 1, "cd ef"), (2, 2, ""), (2, 3, None)]
    df = spark.createDataFrame(rows, "e int, p int, t string")
    counts = text.term_counts(df, ["e", "p"], "t")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r["term"], r["tf"]) for r in counts.where("e = 1 and p = 1").collect()} == {("ab", 2), ("cd", 1), ("ef", 1), ("num", 1)}
    again = text.term_counts(df.select(F.lit(1).alias("k"), "t"), ["k"], "t")
    assert {(r["term"], r["tf"]) for r in again.collect()} == {("ab", 4), ("cd", 4), ("ef", 2), ("num", 2), ("gh", 3), ("zz", 1)}
    run = lambda: sorted(tuple(r) for r in text.adjacent_similarity(df, "e", "p", "t", min_chars=-1, max_df=1.0).collect())
    weigh = lambda: sorted((*r[:3], round(r[3], 9)) for r in text.tfidf(counts, ["e", "p"], 6, min_df=1).collect())
    whole = run(), weigh()
    assert [r[-1] > 0 for r in whole[0]] == [True, True, False]
    monkeypatch.setattr(text, "BROADCAST_TERMS", 2)
    assert (run(), weigh()) == whole


def test_trailing_return_sorts_no_days(spark):
    """Days are only added up; what is ordered in a window is a row per key and year."""
    days = [(1, dt.date(2000, 12, 15), 2.0), (1, dt.date(2000, 12, 16), 4.0), (1, dt.date(2001, 12, 31), 6.0), (2, dt.date(2000, 3, 1), 5.0), (2, dt.date(2000, 4, 1), 0.0), (3, dt.date(2002, 1, 1), 0.0), (3, dt.date(2002, 1, 2), 1.0)]
    df = spark.createDataFrame(days, "k int, day date, p double")
    out = timeseries.trailing_return(df, "k", "day", "p", F.year("day"), min_obs=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "_event" not in plan
    # 2000-12-16 is the first of 380 days before the end of 2001, 2000-12-15 is not
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2000, 1.0), (1, 2001, 0.5), (1, 2002, 0.0), (2, 2000, -1.0), (3, 2002, math.inf)]
    assert timeseries.trailing_return(df.where("false"), "k", "day", "p", F.year("day")).count() == 0


def test_spreads_count_months_without_gathering_them(spark):
    """Events of one name and entry go into one row with their number; spreads stay what they are of all positions."""
    rows = [(k, dt.date(2000, 1 + (k + j) % 4, 28), float(k * 7 % 11 + j), k * 10 + j) for k in range(9) for j in range(3)]
    events = spark.createDataFrame([(1, *r) for r in rows], "one int, k int, entry date, score double, id int").withColumn("entry", F.last_day("entry"))
    returns = spark.createDataFrame([(k, m, 0.01 * k) for k in range(9) for m in (1, 2, 3, 4)], "k int, m int, ret double").select("k", F.last_day(F.make_date(F.lit(2000), "m", F.lit(1))).alias("month"), "ret")
    hold = lambda e: portfolio.active_positions(e, "entry", 2, "2000-01-31", "2000-04-30")
    whole = portfolio.grid_spread(hold(events), returns, "k", "score", (2, 3), 3, ["id", "score"])
    few = portfolio.latest_events(events, ["k", "entry"], ["id", "score"])
    assert sorted(map(tuple, few.select("k", "weight").collect())) == [(k, 1) for k in range(9) for _ in range(3)]
    double = portfolio.latest_events(events.unionByName(events), ["k", "entry"], ["id", "score"])
    assert {r["weight"] for r in double.collect()} == {2} and double.count() == 27
    want = sorted(map(tuple, whole.collect()))
    assert want and sorted(map(tuple, portfolio.grid_spread(hold(few), returns, "k", "score", (2, 3), 3, ["id", "score"], weight="weight").collect())) == want
    assert "windowspecdefinition(month#" not in whole._jdf.queryExecution().analyzed().toString()

"""Ordered line diff against the standard library's."""

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import diff
from tidemark.plans import catalog


def unified(a, b):
    """Hunks of the library, header first, without file names."""
    out = []
    for line in list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=0))[2:]:
        if line.startswith("@@ ") and line.endswith(" @@"):
            out.append([line])
        else:
            out[-1].append(line)
    return ["\n".join(h) for h in out]


def got(spark, rows):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k long, a string, b string")
    found = {k: [] for k in range(len(rows))}
    for r in diff.unified(diff.line_diff(df, ["k"], "a", "b")).orderBy("k", "hunk").collect():
        assert (r["before_n"], r["after_n"]) == (len(r["removed"]), len(r["added"]))
        found[r["k"]].append(r["text"])
    return found


ODD = [
    (None, None), (None, ""), ("", "a"), ("a", None), ("a", "a"), ("a\n", "a"), ("\n", ""), ("\n\n", "\n"), ("a\r\nb\rc", "a\nb\nc"), ("a b\x0cc\x85d", "a\nc"),
    ("x\ny\nz", "z\ny\nx"), ("a\na\na", "a\na"), ("a\nb\na\nb", "b\na\nb\na"), ("1\n2\n3\n4\n5", "1\n3\n9\n5\n2"), ("@@ x @@\n-a", "-a\n@@ x @@"), ("é\n日本", "日本\né"),
]


def test_odd_pairs(spark):
    found = got(spark, ODD)
    for k, (a, b) in enumerate(ODD):
        assert found[k] == unified(a, b), (a, b)


def series(draw, n, kinds):
    now = [f"line {draw.randrange(kinds)}" for _ in range(n)]
    before = list(now)
    for _ in range(max(1, n // 6)):
        i = draw.randrange(len(now)) if now else 0
        step = draw.choice("idrm")
        if step == "i":
            now.insert(i, f"line {draw.randrange(2 * kinds)}")
        elif now and step == "d":
            del now[i]
        elif now and step == "r":
            now[i] = f"line {draw.randrange(2 * kinds)}"
        elif now:
            now.insert(draw.randrange(len(now)), now.pop(i))
    return "\n".join(before), "\n".join(now)


def test_edits_moves_and_repeats(spark):
    """Short and long texts, few and many kinds of lines, popular ones among them."""
    draw = random.Random(5)
    rows = [series(draw, draw.choice([3, 12, 60, 199, 200, 450]), draw.choice([2, 5, 40, 2000])) for _ in range(150)]
    found = got(spark, rows)
    for k, (a, b) in enumerate(rows):
        assert found[k] == unified(a, b)


def test_points_in_slices(monkeypatch):
    draw = random.Random(6)
    a, b = (np.array([draw.randrange(12) for _ in range(150)]) for _ in range(2))
    whole = diff.matches(a, b)
    monkeypatch.setattr(diff, "POINTS", 40)
    assert diff.matches(a, b) == whole
    want = [tuple(m) for m in difflib.SequenceMatcher(None, a.tolist(), b.tolist()).get_matching_blocks()[:-1]]
    assert whole == want


def test_query_equals_the_library(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by_source, want = {}, {}
    for doc in sorted(docs):
        by_source.setdefault(docs[doc]["source"], []).append(doc)
    for ids in by_source.values():
        want |= {(p, c): unified(docs[p]["text"], docs[c]["text"]) for p, c in zip(ids, ids[1:])}
    found = {k: [] for k in want}
    for r in catalog.queries()["line_diff_sources"](spark, sf_dir).orderBy("doc_id_curr", "hunk").collect():
        found[r["doc_id_prev"], r["doc_id_curr"]].append(r["text"])
    assert found == want


def test_keys_of_any_type_and_no_rows(spark):
    df = spark.createDataFrame([("x", "a", "b"), ("x", "a", "b")], "key string, one string, two string")
    rows = diff.line_diff(df, ["key"], "one", "two")
    assert rows.count() == 2 and diff.diff_summary(rows, ["key"]).first()["lines_added"] == 2
    assert diff.line_diff(df.where(F.lit(False)), ["key"], "one", "two").count() == 0

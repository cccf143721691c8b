"""Sources and sinks: filing items, yearly indexes, second passes, caches, web services, PDF lines."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, web

MODERN = ("fre", "Risks", "Description")
LEGACY = (".fre", "Attached.xml", "Attached", "Box", "805")


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def xml(body):
    return f"<?xml version='1.0' encoding='utf-8'?><r xmlns='u'>{body}</r>".encode("latin-1")


def file(text):
    return f"<File>{base64.b64encode(text).decode()}</File>"


def test_items(spark, tmp_path):
    new = archive(a1FREv3__xml=xml(f"<Risks><Title>ação</Title><Description>{file(b'new')}</Description></Risks>"))
    blank = xml("<Risks><Description><File> </File></Description></Risks>")
    old = xml(f"<Attached><Box>804</Box>{file(b'other')}</Attached><Attached><Box>805</Box>{file(b'old')}</Attached>")
    both = archive(x_fre__xml=blank, y__fre=archive(Attached__xml=old))
    none = archive(x_fre__xml=blank, y__fre=b"no archive")
    for name, data in (("new", new), ("both", both), ("none", none), ("bad", b"PK no archive"), ("empty", archive(z__txt=b""))):
        (tmp_path / f"{name}.zip").write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: (r["content"] and bytes(r["content"]), r["error"]) for r in readers.read_items(spark, str(tmp_path), "File", MODERN, LEGACY).collect()}
    assert rows == {"new.zip": (b"new", None), "both.zip": (b"old", None), "none.zip": (None, None), "bad.zip": (None, "BadZipFile"), "empty.zip": (None, None)}

    def mended(failed):
        assert [r[0].rsplit("/", 1)[1] for r in failed.collect()] == ["bad.zip"]
        return failed.select("path", F.lit(b"read again").alias("content"), F.lit(None).cast("string").alias("error"))

    again = readers.second_pass(readers.read_items(spark, str(tmp_path), "File", MODERN, LEGACY), ["path"], mended)
    assert again.count() == 5 and again.where("error is not null").count() == 0


def test_yearly_index(spark, tmp_path):
    for year in (2019, 2020):
        (tmp_path / f"index_{year}.zip").write_bytes(archive(**{f"index_{year}__csv": f"K;V\n{year % 100};é\n".encode("latin-1")}))
    rows = readers.read_yearly(spark, str(tmp_path), r"index_\d+\.csv", ["K", "V"])
    assert sorted((r["K"], r["V"], r["year"]) for r in rows.collect()) == [("19", "é", 2019), ("20", "é", 2020)]


def test_sinks_and_materialized(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, g int")
    for _ in range(2):
        readers.write_table(df, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 9
    readers.write_keyed_json(df, str(tmp_path / "j"), ["g"])
    assert spark.read.json(str(tmp_path / "j")).groupBy("g").count().count() == 3
    made = []

    def make(work):
        made.append(sorted(r["id"] for r in work.collect()))
        return work.withColumn("twice", F.col("id") * 2)

    first = readers.materialized(spark, str(tmp_path / "m"), df.where("id < 4"), ["id"], make)
    assert first.count() == 4
    for force, count in ((False, 9), (False, 9), (True, 9)):
        assert readers.materialized(spark, str(tmp_path / "m"), df, ["id"], make, force).count() == count
    assert made == [[0, 1, 2, 3], [4, 5, 6, 7, 8], list(range(9))]


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def __call__(self):
        return self.now


def test_fetcher(tmp_path):
    clock, answers = Clock(), [OSError("down"), b"bad", b"PK1", b"PK2"]

    def transport(url, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    f = web.Fetcher(transport, lambda d: d[:2] == b"PK", wait=8.0, interval=2.0, sleep=clock.sleep, clock=clock)
    cache = str(tmp_path / "c" / "x")
    assert f.get("u", "k", cache) == b"PK1" and clock.slept == [8.0, 16.0]
    assert f.get("u", "k", cache) == b"PK1" and len(answers) == 1  # from the cache
    assert f.get("u", "k", cache, force=True) == b"PK2" and clock.slept[2:] == [2.0]
    answers[:] = [OSError("down")] * 5
    with pytest.raises(RuntimeError):
        f.get("v", "other")


def test_pages_and_table(spark):
    def listing(url):
        page = json.loads(base64.b64decode(url.rsplit("/", 1)[1]))["pageNumber"]
        return json.dumps({"page": {"totalPages": 3}, "results": [{"n": page}]}).encode()

    assert [r["n"] for r in web.pages(listing, "http://x/list", {"pageSize": 20})] == [1, 2, 3]

    def make():
        def transport(url, timeout):
            if url.endswith("9"):
                raise OSError("down")
            return url.encode()

        return web.Fetcher(transport, tries=2, wait=0.0)

    requests = spark.createDataFrame([(f"u{i}", i % 2) for i in range(10)], "url string, host int")
    got = {r["url"]: (r["content"] and bytes(r["content"]), r["error"]) for r in web.fetch_table(requests, "url", "host", make).collect()}
    assert got["u3"] == (b"u3", None) and got["u9"][0] is None and "2 tries" in got["u9"][1] and len(got) == 10


def test_pdf_lines():
    class Page:
        def __init__(self, lines):
            self.lines = lines

        def get_text(self, kind):
            assert kind == "dict"
            return {"blocks": [{"lines": [{"spans": spans} for spans in self.lines]}, {"image": b""}]}

    span = lambda t, size=10.04, font="Times", flags=0: {"text": t, "size": size, "font": font, "flags": flags}
    pages = [Page([[span("Note "), span("12", 12.06, "Times-Bold")], [span("  ")]]), Page([[span("text", flags=16)]])]
    assert readers.pdf_lines(pages) == [(0, 0, "Note 12", 12.1, True), (1, 1, "text", 10.0, True)]


def element(name, content, more=""):
    return f"<u:Box><u:Name>{name}</u:Name><u:Data>{content}</u:Data>{more}</u:Box>"


def test_xml_attachments_equal_the_parser(spark, tmp_path):
    """Sound files by Spark's source, odd ones by the parser: the same rows, and errors of those that can't be read."""
    b64 = lambda t: base64.b64encode(t).decode()
    top = lambda body, code="utf-8": f"<?xml version='1.0' encoding='{code}'?><u:r xmlns:u='x'>{body}</u:r>"
    files = {
        "many": top("".join(element(f"n{i}", b64(b"d%d" % i), "<u:Other>7</u:Other>") for i in range(50))).encode(),
        "plain": top(element("ação", b64(b"one")) + element("empty", "") + element("bad", "!!!") + "<u:Else/>").encode(),
        "latin": top(element("ação", b64(b"two"))).encode("latin-1"),
        "none": top("<u:Else/>").encode(),
        "broken": b"<u:r><u:Box>",
    }
    for n, raw in files.items():
        (tmp_path / f"{n}.xml").write_bytes(raw)
    got = readers.read_xml_attachments(spark, str(tmp_path / "*.xml"), "Box", "Name", "Data").collect()
    rows = sorted((r["path"].rsplit("/", 1)[-1][:-4], r["filename"], bytes(r["content"])) for r in got if r["error"] is None)
    assert rows == sorted((n, *a) for n in ("many", "plain", "latin", "none") for a in readers.xml_attachments(files[n], "Box", "Name", "Data"))
    assert [(r["path"].rsplit("/", 1)[-1], r["error"]) for r in got if r["error"]] == [("broken.xml", "ParseError")]


def test_xml_rows_are_pruned(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><b><n>x</n><k>1</k></b><b><n>y</n><k>no</k></b></r>")
    rows = readers.read_xml_rows(spark, str(tmp_path / "a.xml"), "b", "n string, k int")
    assert sorted((r["n"], r["k"], r["_broken"] is None) for r in rows.collect()) == [("x", 1, True), ("y", None, False)]
    plan = rows.select("n")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n:string>" in plan

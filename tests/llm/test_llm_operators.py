"""The ten operators on odd rows, against brute force or the libraries."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, components, htmltext, langid, lines, media, nearcopies, packing, quality, rules, simhash, tokens, vocab, webpwrite
from tidemark.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(df):
    return {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}


# 1 -------------------------------------------------------------------------------------------------
def brute_print(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, ids, most=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                root[find(i)] = find(j)
    low = {}
    for i, doc in enumerate(ids):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for doc, text in texts(odd):
        if doc is not None:
            assert got[doc]["fingerprint"] == f"{brute_print(text):016x}"
    assert got[2]["component_id"] == got[1]["component_id"] == 1
    assert got[3]["component_id"] == got[4]["component_id"] == got[5]["component_id"] == 3
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [2, 64])
def test_simhash_links(spark, limit):
    """Families of near fingerprints in small and in crowded buckets."""
    draw = np.random.default_rng(3)
    prints = []
    for _ in range(25):
        base = int(draw.integers(0, 1 << 63))
        prints += [base ^ sum(1 << int(b) for b in draw.choice(64, k, replace=False)) for k in (0, 1, 1, 2, 2, 3, 4, 5)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), limit)
    labels = {r["node"]: r["component"] for r in components.component_labels(edges).collect()}
    got = [labels.get(p, p) for p in signed]
    want = groups(prints, signed)
    assert got == want


def test_simhash_links_of_one_segment(spark):
    """A family that shares a segment, a key that a third of all variants would have, beside others."""
    draw = np.random.default_rng(4)
    family = [int(draw.integers(0, 1 << 32)) << 32 | 0x0F0F1234 for _ in range(200)]
    near = [p ^ (1 << int(draw.integers(32, 64))) ^ (1 << int(draw.integers(0, 64))) for p in family[::3]]
    prints = list(dict.fromkeys([*family, *near, *(int(p) for p in draw.integers(0, 1 << 63, 200))]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    labels = {r["node"]: r["component"] for r in components.component_labels(edges).collect()}
    assert [labels.get(p, p) for p in signed] == groups(prints, signed)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    out = dict(components.component_labels(spark.createDataFrame(chain, "u long, v long")).collect())
    assert out == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_keep_one(odd):
    kept = [r["doc_id"] for r in nearcopies.keep_one(odd).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 in kept and 4 not in kept and None in kept


# 2 -------------------------------------------------------------------------------------------------
def test_media(odd, empty):
    """Every row, null and repeated ids included: values of its own text, equal for equal texts."""
    rows = media.media_round_trip(odd).collect()
    want = {}
    for doc, text in ((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()):
        read = media.payload((text or "").encode())
        stored = webpwrite.encode_payloads([read])[0]
        samples = np.frombuffer(read, np.uint8)
        want.setdefault(doc, []).append((
            doc, len((text or "").encode()), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(stored), hashlib.sha256(stored).hexdigest(),
            media.feature(samples, len(read) // 576, 192),
        ))
    assert len(rows) == odd.count() and all(len(r["payload_sha256"]) == 64 and r["payload_bytes"] % 576 == 0 for r in rows)
    for r in rows:
        assert tuple(r) in want[r["doc_id"]]
    got = {r["doc_id"]: tuple(r)[2:] for r in rows}
    assert got[1] == got[2] and got[3] == got[4]
    assert media.media_round_trip(empty).count() == 0


def test_pixel_arrays(odd):
    for r in media.pixels(media.store(odd)).collect():
        assert r["width"] == 192 and len(bytes(r["pixels"])) == 576 * r["height"]
    stored = media.store(odd)
    assert by_id(media.describe(media.pixels(stored))) == by_id(media.media_round_trip(odd))


# 3 -------------------------------------------------------------------------------------------------
def brute_lines(rows, least):
    sites, first = {}, {}
    for doc, text, site in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            t = line.strip(" ")
            if t:
                sites.setdefault(t, set()).add(site)
                first.setdefault(t, (doc, pos))
    bad = {t for t, s in sites.items() if len(s - {None}) >= least}
    return {
        doc: "\n".join(x for i, x in enumerate(text.split("\n")) if x.strip(" ") not in bad or first[x.strip(" ")] == (doc, i))
        for doc, text, _ in rows if text is not None
    }


def test_lines(spark):
    draw = np.random.default_rng(5)
    pool = ["All rights reserved.", " Share this page ", "Menu", "", "unique"]
    rows = []
    for i in range(300):
        own = [pool[int(k)] if k < 4 else f"line {draw.integers(0, 500)}" for k in draw.integers(0, 12, 6)]
        rows.append((i, None if i == 7 else "\n".join(own), None if i % 50 == 0 else f"s{draw.integers(0, 30)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (3, 12, 28):
        got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, min_sites=least).collect()}
        want = brute_lines(rows, least)
        assert {k: v for k, v in got.items() if v is not None} == want and got[7] is None


def test_lines_odd(odd, empty):
    out = lines.dedup_lines(odd, min_sites=2)
    assert out.count() == odd.count() and lines.dedup_lines(empty).count() == 0
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] == "" and got[2]["n_removed"] == 1 and got[1]["n_removed"] == 0
    assert got[3]["text"] is None and got[3]["n_lines"] == 0


# 4, 6, 7: ids --------------------------------------------------------------------------------------
TRICKY = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\n \nb", "x y 　z", "don't I'LL ²", "é" * 90, "ab" * 400, "日本語 😀😀 <|endoftext|>", "<|startoftext|>A<|endoftext|><|endoftext|> b \n<|endoftext|>\n c<|endoftext", "\x1c \x1cq", "é Σίσυφος ΑΣ İ"]


def many_texts():
    draw = np.random.default_rng(2)
    return TRICKY + ["".join(draw.choice(list(" \n\t ab'sé1!😀Σ"), int(draw.integers(0, 40)))) for _ in range(400)]


def test_byte_ids_equal_the_library():
    coder, encoder = bpe.byte_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    import pyarrow as pa

    ts = many_texts()
    ids, counts = encoder.encode(pa.array(ts))
    ends = np.cumsum(counts)
    for t, i, j in zip(ts, ends - counts, ends):
        assert ids[i:j].tolist() == library.encode_ordinary(t), t
        assert coder.decode(ids[i:j].tolist()) == t.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_merge_ids_equal_the_library(name):
    library = tokenizers.Tokenizer.from_file(P.path(name))
    import pyarrow as pa

    ts = many_texts()
    ids, counts = vocab.merge_encoder(P.path(name)).encode(pa.array(ts))
    ends = np.cumsum(counts)
    for t, i, j in zip(ts, ends - counts, ends):
        assert ids[i:j].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_segment_trees_agree():
    coder, _ = bpe.byte_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    words = [b"internationalization", b"zzzzzzzz", b"a", b"thethethethethe", "überschwänglich".encode()]
    for w in words:
        symbols = coder.start[np.frombuffer(w, np.uint8)]
        wide, _ = bpe.merge(symbols, np.array([len(w)]), coder.table)
        assert wide.tolist() == bpe._merge_long(symbols.tolist(), coder.table)


def test_forgotten_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.ByteCoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    small = bpe.ChunkEncoder(coder)
    for _ in range(3):
        ids, counts = small.encode(pa.array(["one two three four five six", "six five nine"]))
    _, whole = bpe.byte_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert ids.tolist() == whole.encode(pa.array(["one two three four five six", "six five nine"]))[0].tolist()


def test_round_trip(odd, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    known = {doc: text for doc, text in texts(odd)}
    for r in bpe.round_trip(odd, path, P.PATTERN).collect():
        assert r["decoded_sha256"] == hashlib.sha256((known[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.round_trip(empty, path, P.PATTERN).count() == 0 == bpe.encode(empty, path, P.PATTERN).count()


# 5 -------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a = "</p><p>not this";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A  title</h1><p>First &amp; best, with <b>bold</b>
 words.<p>Second&nbsp;one<br>goes on.</p><div class="ad">Buy now.</div>
<section class="comments"><h3>Comments</h3><p>I like it a lot.</p></section></article>
<aside><p>Related things.</p></aside><form><label>Mail</label><input></form><footer>&copy; me</footer>"""


def test_page():
    assert htmltext.extract(PAGE) == "A title\nFirst & best, with bold words.\nSecond one goes on."
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<nav><a href=x>y</a></nav>") == ""


def test_pages_held_out():
    """Every third page has no names: there notices, forms and comments are told by structure alone."""
    model, wrong, seen = htmltext.default_model(), [0, 0], [0, 0]
    for k, page in enumerate(htmltext.labelled_pages(60, 5)):
        bare = int(k % 3 == 0)
        tree = htmltext.parse(page)
        label = []
        for i, node in enumerate(tree.nodes):
            label.append(int(node.attrs.get("data-y", label[node.parent] if i else 0)))
        content = model.marginals(tree) > 0.5
        for _, node, t, _ in tree.runs:
            if t.strip():
                seen[bare], wrong[bare] = seen[bare] + 1, wrong[bare] + (content[node] != label[node])
    assert wrong[0] <= 0.015 * seen[0] and wrong[1] <= 0.06 * seen[1]


def test_marginals_against_enumeration():
    model, tree = htmltext.default_model(), htmltext.parse("<div><p>One two.</p><ul><li>x</li></ul></div>")
    (unary, g), n = model.unary(tree), len(tree.nodes)
    total, on = 0.0, np.zeros(n)
    for k in range(1 << n):
        y = [k >> i & 1 for i in range(n)]
        e = np.exp(sum(u for u, v in zip(unary, y) if v) + sum(model.pair[g[i], y[tree.nodes[i].parent], y[i]] for i in range(1, n)))
        total += e
        on += e * np.array(y)
    assert np.allclose(model.marginals(tree), on / total)


def test_page_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>" + "Long text here. " * 20000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in htmltext.extract_pages(df).collect()}
    assert got[2]["text"] == got[None]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[4]["text"] == ("Long text here. " * 20000).strip()
    twice = htmltext.extract_pages(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(got) and all(tuple(r) == tuple(got[r["page_id"]]) for r in twice)
    assert htmltext.extract_pages(df.where("false")).count() == 0


# 6 -------------------------------------------------------------------------------------------------
def test_packing(odd, empty):
    """Every row's pieces, null and repeated ids included, equal the library's ids, gapless in sequences."""
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    packed = packing.pack_documents(odd, path)
    rows = packed.collect()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    want = []
    for doc, text in ((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        k = -(-len(ids) // 2048)
        cuts = [0, *range(len(ids) - (k - 1) * 2048, len(ids) + 1, 2048)]
        want += [(doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows))) == sorted(map(str, want))
    assert packing.certificate(packed) == {"sequences": len(held), "bound": packing.lower_bound(np.array([r["length"] for r in rows])), "gap": 0}
    assert packing.pack_documents(empty, path).count() == 0


def test_exchange_between_groups(spark):
    draw = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(draw.integers(600, 1500, 400))]
    items = spark.createDataFrame(rows, packing.PIECES)
    few = packing.pack(items, group=40)
    fills = {r[0]: r[1] for r in few.groupBy("sequence_id").agg(F.sum("length")).collect()}
    assert max(fills.values()) <= 2048 and few.count() == 400
    alone = packing.pack(items, group=40, rounds=1).select("sequence_id").distinct().count()
    lengths = np.array([r[3] for r in rows])
    assert packing.lower_bound(lengths) <= len(fills) <= alone


def test_lower_bound():
    assert packing.lower_bound(np.array([1025] * 5)) == 5
    assert packing.lower_bound(np.array([1024] * 4)) == 2
    assert packing.lower_bound(np.array([2048, 1, 1])) == 2
    assert packing.lower_bound(np.array([], int)) == 0


# 7 -------------------------------------------------------------------------------------------------
def test_token_files_of_one_id(spark, tmp_path):
    """Texts under one id are dealt over several tasks and keep their places."""
    texts_of = [(7 if i % 4 else None if i % 8 else i, f"text {i} of many") for i in range(400)]
    docs = spark.createDataFrame(texts_of, "doc_id long, text string")
    path, out = P.path("word_bpe_49k.json"), str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_ids(docs, path, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = [r["count"] for r in tokens.read_ids(spark, out).where("doc_id = 7").selectExpr("shiftright(at, 33) AS task").groupBy("task").count().collect()]
    assert len(per) > 2 and max(per) < 200 and sum(per) == 300
    rows = sorted(tokens.index(tokens.read_ids(spark, out)).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert [r["doc_id"] or -1 for r in rows] == sorted(r["doc_id"] or -1 for r in rows)


def test_token_files(odd, empty, spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = sorted(tokens.token_output(odd, path).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"]))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    for doc, text in texts(odd):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = [r for r in rows if r["doc_id"] == doc]
        assert all((r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in own)
    assert tokens.token_output(empty, path).count() == 0
    tokens.write_ids(odd, path, str(tmp_path / "ids"))
    plan = tokens.read_ids(spark, str(tmp_path / "ids")).where("doc_id = 6").select("n_tokens")
    assert plan.count() == 1 and "ids" not in plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


# 8 -------------------------------------------------------------------------------------------------
def test_language(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in both) >= 0.95 * len(both)
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and 0 <= got[6]["score"] <= 1
    assert got[1]["lang_pred"] == got[2]["lang_pred"] and not got[None]["held_out"]
    assert langid.identify(empty).count() == 0
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().count() == 1


def test_kernel_features_match():
    rows, lettered = langid.presence(["Ab", "ab", "12", ""])
    assert (rows[0] == rows[1]).all() and lettered.tolist() == [True, True, False, False]


# 9 -------------------------------------------------------------------------------------------------
def brute_base(text):
    words = re.findall(WORD, text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    worded = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(worded) - len(set(worded)), len(covered)


def test_rules_base(spark, odd, empty):
    extra = ["a b c d e f g h " * 2, "x " + "p q r s t u v w y " * 3 + "z", "q\x0bw\x0ce\rr\tt", "one\ntwo\none\n\n", "a b c d e f g h"]
    rows = [(100 + i, t) for i, t in enumerate(extra)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    known = {doc: text for doc, text in texts(df)}
    for r in rules.quality(df).collect():
        want = brute_base(known[r["doc_id"]])
        assert tuple(r[c] for c in rules.BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    assert rules.quality(empty).count() == 0 and rules.keep_good(empty).columns == empty.columns
    assert rules.keep_good(odd).columns == odd.columns


def test_rules_posterior():
    k = len(rules.rules())
    good, bad, unsure = (0,) * k, (-1, -1) + (0,) * (k - 2), (-1,) + (0,) * (k - 1)
    p = rules.fit([(good, 900), (bad, 80), (unsure, 5)])
    assert p[good] > 0.9 and p[bad] < 0.1 and rules.fit([]) == {}


def test_rules_are_native(odd):
    plan = rules.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_find_junk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    rows = rules.quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    bad, good = [r["kept"] for r in rows if r["quality"] == 0], [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


# 10 ------------------------------------------------------------------------------------------------
def test_quality_ties(spark, sf_dir):
    """One id with several texts: the order in which rows come doesn't matter to what is learned."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id", "substring(text, 40) as text"))
    found = [
        sorted((r["doc_id"], r["score"]) for r in quality.score(docs.repartition(n).sortWithinPartitions(F.xxhash64("text", F.lit(n))), labels).collect())
        for n in (3, 7)
    ]
    assert found[0] == found[1]


def test_quality_score(spark, sf_dir, odd, empty):
    base = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    none = labels.where("false")
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5} and quality.score(empty, labels).count() == 0
    got = {r["doc_id"]: r["score"] for r in quality.score(odd, labels).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values()) and got[3] == got[4]


def test_column_equals_scores(spark):
    draw = np.random.default_rng(0)
    x = draw.random((300, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(float)
    model = quality.fit(x, y)
    assert model.rules and ((model.scores(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality.FEATURES))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.scores(x))

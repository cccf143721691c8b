"""Fitted methods against plain versions of themselves, and the registered queries on the smallest tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers

import __spark_entry__
from tidemark.llm import langid, quality, queries, rules
from tidemark.llm.common import table

QUERIES = queries.queries()


# 8: the kernel, Nystrom features and ridge regression --------------------------------------------------
def grams(text):
    """Buckets of a text's 1- to 3-grams, one n-gram at a time."""
    letters = re.sub(r"[^\w]|[\d_]", " ", f" {text.lower()} ")
    letters = "".join(c if c.isalpha() else " " for c in letters)
    letters = re.sub(" +", " ", letters)
    out = set()
    for n in range(1, 4):
        for i in range(len(letters) - n + 1):
            h = 0
            for k, c in enumerate(letters[i : i + n]):
                h = (h + ord(c) + k + 1) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out.add(h & (langid.BUCKETS - 1))
    return out


def test_kernel_is_presence_of_blended_grams():
    texts = ["Ab, cd! été", "one two  three 12", "x", "日本語 のテキスト"]
    rows, _ = langid.presence(texts)
    for text, row in zip(texts, rows):
        assert set(np.flatnonzero(row)) == grams(text)


def test_ridge_equals_the_direct_solution():
    draw = np.random.default_rng(3)
    texts, labels = [], []
    for k in range(60):
        pool = ["der die und nicht", "the and of with", "les des une dans"][k % 3].split()
        texts.append(" ".join(draw.choice(pool, 12)) + f" {''.join(draw.choice(list('abcdef'), 6))}")
        labels.append("dex"[k % 3])
    rows, _ = langid.presence(texts)
    model = langid.fit(np.packbits(rows, axis=1), labels, landmarks=12)
    sets = [grams(t) for t in texts]
    marks = sorted(range(60), key=lambda i: (i // 3, labels[i]))[:12]  # a row of each language in turn
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k_mm = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    k_nm = np.array([[kernel(s, sets[j]) for j in marks] for s in sets])
    languages = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    # the minimum of sum (K a - y)^2 + ridge a' K_mm a, in the coefficients of the landmarks
    a = np.linalg.lstsq(k_nm.T @ k_nm + langid.RIDGE * len(texts) / np.linalg.matrix_rank(k_mm, tol=1e-6 * np.linalg.eigvalsh(k_mm).max()) * k_mm, k_nm.T @ y, rcond=None)[0]
    want = np.exp(langid.SHARPNESS * k_nm @ a)
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(model.scores(rows) - want).max() < 0.01
    assert [languages[k] for k in want.argmax(axis=1)] == [model.languages[k] for k in model.scores(rows).argmax(axis=1)]


def test_eighty_languages(spark):
    draw = np.random.default_rng(5)
    alphabets = [[chr(c) for c in draw.choice(np.arange(0x400, 0x2000), 30, replace=False) if chr(c).isalpha()] for _ in range(80)]
    rows = [(k * 40 + i, "".join(draw.choice([*a, " "], 200)), f"l{k:02d}") for k, a in enumerate(alphabets) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    both = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len({r["lang_pred"] for r in both}) == 80 and np.mean([r["lang"] == r["lang_pred"] for r in both]) >= 0.95


def test_one_row_that_is_a_third_of_all(spark):
    rows = [(7, "la casa de la playa es blanca", "es")] * 2000 + [(i, f"the house by the sea number {'abcdefghij'[i % 10] * 3}", "en") for i in range(100, 2100)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got}["en"] >= 1990


# 9: expectation-maximisation ---------------------------------------------------------------------------
def plain_em(votes, rounds=50):
    """The same model document by document, in probabilities."""
    k, n = votes.shape[1], len(votes)
    weight, good = rules.PRIOR_WEIGHT * n + 1, rules.PRIOR
    rate = {c: np.tile(rules.START[c], (k, 1)) for c in (0, 1)}
    for _ in range(rounds):
        like = {c: np.prod(rate[c][np.arange(k), votes + 1], axis=1) for c in (0, 1)}
        post = good * like[1] / (good * like[1] + (1 - good) * like[0])
        good = (post.sum() + weight * rules.PRIOR) / (n + weight)
        for c, p in ((0, 1 - post), (1, post)):
            for r in range(k):
                seen = np.array([weight * rules.START[c][v] * 0.5 + p[votes[:, r] == v - 1].sum() for v in range(3)])
                rate[c][r] = seen / seen.sum()
    return post


def test_expectation_maximisation():
    draw = np.random.default_rng(1)
    k = len(rules.rules())
    bad = draw.random(400) < 0.15
    votes = np.where(draw.random((400, k)) < np.where(bad, 0.4, 0.03)[:, None], -1, np.where(draw.random((400, k)) < 0.3, 1, 0))
    counts = {}
    for v in map(tuple, votes.tolist()):
        counts[v] = counts.get(v, 0) + 1
    found = rules.fit(sorted(counts.items()))
    want = plain_em(votes)
    for v, p in zip(map(tuple, votes.tolist()), want):
        assert found[v] == pytest.approx(p, abs=1e-9)


# 10: the lasso ------------------------------------------------------------------------------------------
def test_weights_meet_the_conditions_of_the_lasso():
    """At the minimum a rule with a weight has a gradient of the penalty's size, one without a smaller one."""
    draw = np.random.default_rng(2)
    x = draw.random((600, len(quality.FEATURES)))
    y = ((x[:, 1] > 0.4) & (x[:, 5] < 0.7) | (draw.random(600) < 0.05)).astype(float)
    penalty = 0.002
    model = quality.fit(x, y, penalty, steps=20_000)
    gap = (model.scores(x) - y) / len(y)
    assert abs(gap.sum()) < 1e-5
    for w, rule in model.rules:
        assert (gap * quality._holds(x, rule)).sum() == pytest.approx(-math.copysign(penalty, w), abs=2e-4)
    used = {tuple(r) for _, r in model.rules}
    loose = [((j, True, c),) for j in (1, 5) for c in (0.2, 0.4, 0.7)]
    assert used and all(abs((gap * quality._holds(x, r)).sum()) <= 0.06 for r in loose)


# the registered queries -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_op1(spark, sf_dir, docs):
    from test_llm_operators import brute_print, groups

    rows = {r["doc_id"]: r for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    ids = sorted(docs)
    prints = [brute_print(docs[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in ids] == groups(prints, ids)


def test_op2(spark, sf_dir, docs):
    for r in QUERIES["op2_media"](spark, sf_dir).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def test_op4(spark, sf_dir, docs):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op4_byte_bpe"](spark, sf_dir).collect():
        text = docs[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_op5(spark, sf_dir):
    """The test tables' pages keep their text in the article; its blocks are known from its markup."""
    import html

    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    rows = QUERIES["op5_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", "\n", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_op6_and_op7(spark, sf_dir, docs):
    byte, word = (tokenizers.Tokenizer.from_file(P.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = QUERIES["op6_packing"](spark, sf_dir).collect()
    ids = {i: byte.encode(t or "", add_special_tokens=False).ids + [0] for i, t in docs.items()}
    assert {(r["doc_id"], r["piece"]) for r in rows} == {(i, k) for i, v in ids.items() for k in range(-(-len(v) // 2048))}
    assert all(r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in rows)
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    least = -(-sum(map(len, ids.values())) // 2048)
    assert max(fill.values()) <= 2048 and len(fill) <= least + 1
    start = 0
    for r in sorted(QUERIES["op7_token_files"](spark, sf_dir).collect(), key=lambda r: r["doc_id"]):
        own = word.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), crc(own))
        start += len(own)


def test_op8_op9_op10(spark, sf_dir, docs):
    from test_llm_operators import brute_base

    langs = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op8_language"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"] and langs[r["doc_id"]]]) > 0.9
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        base = brute_base(docs[r["doc_id"]])
        assert tuple(r[c] for c in rules.BASE) == base and r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
    for r in QUERIES["op10_quality_score"](spark, sf_dir).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_op3_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op3_line_dedup"])
    df = QUERIES["op3_line_dedup"](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())

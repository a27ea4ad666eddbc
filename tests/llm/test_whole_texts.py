"""Fingerprints, filling in the middle and periodic runs against plain versions, and on odd rows."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapework.llm import fill_middle, fingerprints, periodic_runs

SCHEMA = "doc_id long, text string, lang string"
LONG = "one two three four five six. " * 30_000
ROWS = [
    (3, "the last quarter of this text gives way to what the next one begins with, as long as it is", "en"), (1, "A b c d e f g h i j k l m n o p", "en"), (2, None, None), (5, "", "en"),
    (6, "ein schöner Tag, été, 日本語 \U0001f600 ja nein ja nein ja nein ja nein", "de"), (8, "holds <S> a mark", "en"), (9, "<", "en"), (10, "x<x>S<P", "en"), (7, LONG, "en"), (11, LONG, "en"),
    (12, "same text of seven words here now", "en"), (13, "same text of seven words here now", "en"), (13, "same text of seven words here now", "en"), (None, "no id here at all", "en"), (14, " \n\t ", "en"), (15, "go " * 9, "en"),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- fingerprints

def kept_by_hand(text, shingle, scale):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
    c = fingerprints.multipliers(shingle)
    every = {sum(a * b for a, b in zip(h[i : i + shingle], c, strict=False)) % 2**64 for i in range(max(len(h) - shingle + 1, min(1, len(h))))}
    low = {x for x in every if x < 2**64 // scale}
    return low or set(sorted(every)[:1])


def like_by_hand(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize(("shingle", "scale"), [(5, 8), (2, 3)])
def test_edited_fingerprints(docs, shingle, scale):
    got = fingerprints.edited_fingerprints(docs.withColumns({"kind": F.lit("old"), "part": F.lit("old"), "text_hash": F.lit("old"), "following": F.lit("old")}), shingle, scale).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    wanted = []
    for row, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = row[1] or "", after[1] or ""
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, changed, other = (kept_by_hand(t, shingle, scale) for t in (text, edited, following))
        wanted.append((row[0], len(text), sha(edited), *("".join(f"{h:016x}" for h in sorted(x)) for x in (own, changed)), like_by_hand(own, changed), like_by_hand(own, other)))
    assert sorted(((r["doc_id"], r["n_chars"], sha(r["edited_text"]), r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got), key=str) == sorted(wanted, key=str)


def test_fingerprints_of_none_and_one(spark, nothing):
    assert fingerprints.edited_fingerprints(nothing).collect() == []
    (row,) = fingerprints.edited_fingerprints(spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert row["edited_text"] == "a b c d e f a b" and row["near_next"] == 1.0


def test_merging_and_containment(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    long, part = word(20_000), None
    words = long.split()
    part = " ".join(words[5_000:7_000])
    rows = [(long, part, " ".join(words[:12_000]), " ".join(words[11_996:])), ("a b", "", "a b", ""), ("tiny text", "tiny text", "tiny text", "other text")]
    columns = ["whole", "part", "one", "two"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).select(*[fingerprints.fingerprint(F.col(c)).alias(c) for c in columns])
    got = df.select("whole", fingerprints.merged(F.array("one", "two")).alias("merged"), fingerprints.containment(F.col("part"), F.col("whole")).alias("inside"), fingerprints.containment(F.col("whole"), F.col("part")).alias("around"), fingerprints.likeness(F.col("whole"), F.col("part")).alias("like")).collect()
    assert got[0]["merged"] == got[0]["whole"] and got[1]["merged"] == got[1]["whole"]
    assert got[0]["inside"] == 1.0 and abs(got[0]["around"] - 0.1) < 0.02 and got[0]["around"] == pytest.approx(got[0]["like"])
    assert got[2]["like"] == 1.0 and got[1]["like"] == 0.0 and got[1]["inside"] == 1.0


# -- filling in the middle

def cut_by_hand(doc_id, text, seed="1:"):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256((seed + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("seed", ["1:", "2:", "3:", "4:", "5:"])
def test_fill_in_middle(docs, seed):
    cut = fill_middle.fill_in_middle(docs.withColumns({"output": F.lit("old"), "N": F.lit("old"), "_cut": F.lit("own")}), seed=seed)
    assert cut.columns == [*docs.columns, "_cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = cut.withColumn("again", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got), key=str) == sorted((cut_by_hand(*r[:2], seed) for r in ROWS), key=str)
    assert all(r["again"] == (r["text"] or "") for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("abXY<>PSM é日\U0001f600\n1")), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), max_size=6))
def test_transform_of_any_texts(rows):
    texts = pa.array([t for t, _ in rows], pa.string())
    got = fill_middle.transform(texts, np.array([h for _, h in rows], np.int64).reshape(-1, 4).T, 90, 20)
    assert fill_middle.restored(got.field("output"), got.field("form")).equals(texts)
    for (text, h), row in zip(rows, got.to_pylist(), strict=True):
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
        if row["form"] != "plain":
            assert row["output"].endswith("<M>" + "".join(tokens[a:b])) and row["prefix_chars"] == len("".join(tokens[:a]))
        else:
            assert row["output"] == text and (not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90)


def test_restore_refuses_what_was_not_built(spark, nothing):
    assert fill_middle.restored(pa.array([None, "<P>a<S>b<M>c"]), pa.array(["psm", "psm"])).to_pylist() == [None, "acb"]
    for output, form in (("<P>a<S>b", "psm"), ("<P>a<S>b<M>c", "spm"), ("x<P>a<S>b<M>c", "psm"), ("abc", "other")):
        with pytest.raises(ValueError):
            fill_middle.restored(pa.array([output]), pa.array([form]))
    assert fill_middle.fill_in_middle(nothing).collect() == []


# -- periodic runs

def runs_by_hand(words, least_length=6, least_periods=4):
    n, out = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_length, least_periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in out.items())


pieces = st.one_of(st.lists(st.integers(0, 3), max_size=30), st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 8), st.integers(1, 200)).map(lambda x: (x[0] * x[1])[: x[2]]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=4).map(lambda x: sum(x, [])), max_size=4))
def test_runs_of_any_texts(texts):
    bounds = np.cumsum([0, *map(len, texts)])
    got = periodic_runs.find_runs(np.array(sum(texts, []), np.int64), bounds)
    assert got.tolist() == [[a + at, b + at, q] for at, t in zip(bounds.tolist(), texts, strict=False) for a, b, q in runs_by_hand(t)]


def test_long_periods():
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 5, 777), np.tile(rng.integers(0, 9_000, 5_003), 5)[: 4 * 5_003 + 1], rng.integers(0, 5, 99)])
    assert [777, 777 + 4 * 5_003 + 1, 5_003] in periodic_runs.find_runs(words, np.array([0, len(words)])).tolist()
    with pytest.raises(ValueError):
        periodic_runs.find_runs(words, np.array([0, len(words)]), least_periods=3)


def test_periodic_runs(docs, nothing):
    got = periodic_runs.periodic_runs(docs.withColumns({"runs": F.lit("old"), "_found": F.lit("own")})).collect()
    wanted = []
    for doc_id, text, _ in ROWS:
        words = WORD.findall(text or "")
        # Of the long text only the run that it is as a whole; it has no other.
        runs = [(0, len(words), 6)] if text == LONG else runs_by_hand(words)
        gone = {i for a, b, q in runs for i in range(a + q, b)}
        wanted.append((doc_id, len(words), [(a, b - a, q) for a, b, q in runs], " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(wanted, key=str)
    assert periodic_runs.periodic_runs(nothing).collect() == []


def test_query_of_periodic_runs(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 90)) if i % 7 else None) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words)
        gone = {i for a, b, q in runs for i in range(a + q, b)}
        best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
        four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == (
            len(runs), *four, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        )

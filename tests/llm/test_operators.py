"""The ten operators against brute force, and on the rows that break things."""

import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tapework.llm import embedding_dedup, labelled, langid, line_dedup, mixing, packing, quality, simhash, token_shards, topk, toxicity
from tapework.llm.components import connected_components
from tapework.llm.mph import MinimalPerfectHash
from tapework.llm.tokens import TextEncoder, encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word one two three. " * 4000
ROWS = [
    (1, "shared line\nown one", "en", "a", 1), (2, "  SHARED line\t\nown two", "en", "a", 2), (3, "shared line", "en", "b", 3), (4, None, "en", None, None), (5, "", None, "b", 0),
    (6, " \n\n ", "de", "c", 3), (7, LONG, "en", "c", len(LONG)), (7, LONG, "en", "c", len(LONG)), (8, "ein Wort für dich, idiot!", "de", "c", 9), (None, "shared line\nwithout id", "en", "b", 4),
    (9, "tie a b c d", "en", "a", 5), (10, "tie a b c d", "en", "a", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs, *names):
    """docs with extra columns named like an operator's own."""
    return docs.withColumns({n: F.lit("old") for n in names})


# -- line dedup

def lines_by_hand(rows, least):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    seen = {}
    for r in rows:
        for k in set(keys(r[1])):
            seen[k] = seen.get(k, 0) + 1
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, keys(r[1]), strict=True) if not (k and seen[k] >= least)]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 4])
def test_line_dedup(docs, least):
    got = line_dedup.line_dedup(clashing(docs, "kept_text", "n_lines", "line_hits", "hit_doc_id", "hit_text_hash", "line_answer"), min_docs=least)
    assert got.columns == [*docs.columns, "line_hits", "hit_doc_id", "hit_text_hash", "line_answer", "kept_text", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == lines_by_hand(ROWS, least)


def test_line_dedup_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 5)
    rows = [(i, f"everywhere\nline {i}\npair {i // 2}", "en", "s", 1) for i in range(40)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA), min_docs=2).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in got) == [(i, f"line {i}") for i in range(40)]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 2**63, 5000).astype(np.uint64), np.arange(5000, dtype=np.uint64)
    high[:100] = 7
    mph = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(high, low).to_bytes())
    assert sorted(mph.lookup(high, low)) == list(range(5000))
    assert MinimalPerfectHash.build(high[:0], low[:0]).n == 0
    with pytest.raises(ValueError):
        MinimalPerfectHash.build(high[:1].repeat(2), low[:1].repeat(2))


# -- tokens: packing and shards

@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


ODD_TEXTS = ["Don't stop, IT'S you're", "Été ÉCOLE naïve", "a b c\x1cd", "<|endoftext|> x", "a<|startoftext|>b <|ENDOFTEXT|>", "école", "日本語 text", "x" * 300, "ΣΑΣ İ ß", "123 4,5%%% ***", "a \x01 b\x01c", "é…,x» µm", "\n", " a  b "]


@pytest.mark.parametrize("most_pieces", [1_000_000, 5])
def test_encoder_equals_library(ids, most_pieces):
    own = TextEncoder(VOCABULARY, most_pieces)
    texts = [*ODD_TEXTS, *[t[1] or "" for t in ROWS]]
    for _ in range(2):
        flat, starts = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, starts[1:-1])] == [ids(t) for t in texts]
    assert ids("<|endoftext|> x")[0] == 49407


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé'ß.,!-<|>1 \n\x01\u0301ΣİK日…»μ×\xa0")), max_size=5))
def test_encoder_on_any_text(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    flat, starts = encoder(VOCABULARY).encode(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(docs, ids):
    got = packing.pack(clashing(docs, "part", "before", "length", "ids"), VOCABULARY, end_id=2, size=64).toPandas()
    assert (got.groupby(["sequence_id"])["length"].sum() <= 64).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].max() + 1))
    wanted = sorted((str(r[0]), at, crc((ids(r[1]) + [2])[at : at + 64])) for r in ROWS for at in range(0, len(ids(r[1])) + 1, 64))
    assert sorted((str(None if pd.isna(d) else int(d)), s, c) for d, s, c in zip(got["doc_id"], got["start"], got["ids_crc32"], strict=True)) == wanted
    assert got["length"].sum() / (64 * got["sequence_id"].nunique()) > 0.9


def test_pack_lengths_uses_every_piece():
    histogram = {5: 7, 64: 3, 33: 4, 20: 9, 1: 2}
    used = {}
    for pattern, count in packing.pack_lengths(histogram, 64):
        assert sum(pattern) <= 64
        for n in pattern:
            used[n] = used.get(n, 0) + count
    assert used == histogram


def test_token_shards(docs, ids):
    shards = token_shards.write_shards(clashing(docs, "shard", "part", "tie"), VOCABULARY, end_id=1)
    index = token_shards.write_index(shards)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.read_shards(shards, index).collect()]
    start, wanted = 0, []
    for r in sorted(ROWS, key=lambda r: (r[0] is None, r[0])):
        all_ids = ids(r[1]) + [1]
        wanted.append((r[0], start, len(all_ids), crc(all_ids)))
        start += len(all_ids)
    assert sorted(got, key=lambda x: x[1]) == wanted
    with pytest.raises(ValueError):
        token_shards.write_shards(docs.withColumn("doc_id", F.col("doc_id").cast("string")), VOCABULARY)


def test_keys_of_repeated_and_missing_ids(spark, ids):
    """Many rows of one doc_id, and many without one, over many shards: every key is there once and leads to its ids."""
    rows = [(7, f"seven number {k}") for k in range(150)] + [(None, f"no id {k}") for k in range(100)] + [(7, "same"), (7, "same"), (8, "eight"), (-3, "minus")]
    shards = token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, ids_per_shard=50)
    index = token_shards.write_index(shards)
    assert shards.count() > 15 and shards.where("n_ids >= 70").count() == 0
    found = token_shards.read_shards(shards, index).collect()
    keys = sorted((str(r["doc_id"]), r["earlier"]) for r in found)
    assert keys == sorted([("7", k) for k in range(152)] + [("None", k) for k in range(100)] + [("8", 0), ("-3", 0)])
    asked = spark.createDataFrame([(i, k) for i in (7, 8, -3, None, 99) for k in range(160)], "doc_id long, earlier long")
    read = token_shards.lookup(shards, index, asked).collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u2").tolist()) for r in read) == sorted((str(d), ids(t) + [1]) for d, t in rows)
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["earlier"] for r in by_start if r["doc_id"] == 7] == list(range(152))


# -- SimHash

def fingerprint_by_hand(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, radius):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints():
    for text in [*ODD_TEXTS[:6], *(r[1] for r in ROWS)]:
        for n in (3, 5):
            assert simhash.fingerprint((text or "").encode(), n) == fingerprint_by_hand(text, n)


def test_simhash_finds_every_link(spark):
    rng = np.random.default_rng(5)
    prints = {}
    for group in range(30):
        base = int(rng.integers(0, 2**63)) * 2
        for k in range(12):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            prints[group * 100 + k] = base ^ sum(1 << int(b) for b in flips)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    frame = spark.createDataFrame([(signed(v),) for v in prints.values()], "print long")
    nodes = {r["node"]: r["component"] for r in connected_components(simhash.simhash_links(frame), "left", "right").collect()}
    wanted = components_by_hand(prints, 3)
    groups = lambda key: {frozenset(i for i in prints if key(i) == c) for c in set(map(key, prints))}
    assert groups(lambda i: nodes.get(signed(prints[i]), signed(prints[i]))) == groups(lambda i: wanted[i])


def test_simhash_rows(docs, nothing):
    got = simhash.simhash_components(docs, shingle=3).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["component_id"] == by[5]["component_id"] == by[6]["component_id"] == 4 and by[4]["print"] == 0
    assert by[10]["component_id"] == 9
    kept = simhash.simhash_dedup(clashing(docs, "kept", "component_id"), shingle=3)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "7", "8", "9", "None"])
    assert simhash.simhash_components(nothing).count() == 0 and simhash.simhash_dedup(nothing).count() == 0


def met_and_near(a, b, radius):
    """Whether two sketches share a place, and are within radius bits of the first print and 2 * radius + 2 of both."""
    apart = [(int.from_bytes(a[k : k + 8], "little") ^ int.from_bytes(b[k : k + 8], "little")).bit_count() for k in (0, 8)]
    return apart[0] <= radius and sum(apart) <= 2 * radius + 2 and bool(np.intersect1d(*simhash.places([a, b])).size)


def near_copies():
    """Texts of 40 to 300 words, and of each a copy with some words changed; ids of copies are 1,000 higher."""
    rng, rows = np.random.default_rng(5), []
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5_000, int(rng.integers(40, 300)))]
        copy = list(words)
        for at in rng.choice(len(words), max(1, round(len(words) * [0.005, 0.015, 0.022, 0.04][k % 4])), replace=False):
            copy[at] = "changed"
        rows += [(k, " ".join(words)), (1_000 + k, " ".join(copy))]
    return [*rows, (2_000, rows[0][1]), (2_001, rows[0][1].upper()), (2_002, None), (2_003, "  "), (None, "alone")]


@pytest.mark.parametrize("group", [256, 5])
def test_pipeline_finds_copies_of_four_fifths(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rows = near_copies()
    of = [set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w := (t or "").lower().split()) > 5 else {tuple(w)} for _, t in rows]
    root, wide, reached, alike = list(range(len(rows))), 0, 0, 0
    sketches = [simhash.sketch(simhash.shingles((t or "").encode(), 5)) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]):
                bits = [simhash.fingerprint((rows[x][1] or "").encode(), 3) for x in (a, b)]
                wide += (bits[0] ^ bits[1]).bit_count() > 3
                alike += 1
                if not met_and_near(sketches[a], sketches[b], 17):
                    continue
                reached += 1
                root = [root[b] if x == root[a] else x for x in root]
    assert wide > 5 and reached >= 0.95 * alike
    best = {}
    for r, (i, _) in zip(root, rows, strict=True):
        best[r] = min(best.get(r, math.inf), math.inf if i is None else i)
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(math.inf if r["doc_id"] is None else r["doc_id"] for r in got) == sorted(best.values())


@pytest.mark.parametrize("group", [256, 16])
def test_group_of_many_near_copies(spark, monkeypatch, group):
    """A chain of texts, each near the next but not to the first, and a crowd around one: links are followed over all blocks."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 9_000, 200)]
    rows = []
    for k in range(60):  # the chain: four words more are changed each time
        if k:
            words = [*words[: 3 * k], f"c{k}", *words[3 * k + 1 :]]
        rows.append((k, " ".join(words)))
    crowd = [f"v{x}" for x in rng.integers(0, 9_000, 300)]
    for k in range(80):
        rows.append((1_000 + k, " ".join([*crowd[: 2 * k], f"d{k}", *crowd[2 * k + 1 :]])))
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1_000]


@pytest.mark.parametrize("crowd", [8_192, 7])
def test_wide_links_find_all(spark, monkeypatch, crowd):
    """What meets in a key and is near is joined, and nothing else, also where a place is dealt to blocks."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PART", 3)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = np.random.default_rng(7)
    changed = lambda h, part: np.concatenate([h[int(part * len(h)) :], rng.integers(0, 2**63, int(part * len(h))).astype(np.uint64)])
    sets = []
    for k in range(60):
        base = rng.integers(0, 2**63, 300).astype(np.uint64)
        sets += [base, *(changed(base, p) for p in ([0.02, 0.06, 0.12, 0.3] if k else np.linspace(0, 0.2, 80)))]
    sketches = [simhash.sketch(h) for h in sets]
    root = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            if root[x] != root[y] and met_and_near(sketches[x], sketches[y], 17):
                root = [root[y] if r == root[x] else r for r in root]
    rows = [(k, *np.frombuffer(c[:16], np.int64).tolist(), c) for k, c in enumerate(sketches)]
    links = simhash.wide_links(spark.createDataFrame(rows, "text_hash long, print long, second long, sketch binary"), 17)
    nodes = {r["node"]: r["component"] for r in connected_components(links, "left", "right").collect()}
    groups = lambda of: {frozenset(k for k in range(len(sets)) if of[k] == c) for c in set(of)}
    assert groups([nodes.get(k, k) for k in range(len(sets))]) == groups(root) and 60 < len(set(root)) < 200


def test_sketch_by_hand():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300, 70_000):
        hashes = rng.integers(0, 2**63, n).astype(np.uint64)
        ones = simhash.bit_counts(hashes)
        assert ones[:64].tolist() == [int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
        code = simhash.sketch(hashes)
        where = simhash.places([code])[0].view(np.uint32).tolist()
        bits = [2 * c > n for c in ones.tolist()]
        want = set()
        for k in range(9):
            mine = list(range(28 * k, 28 * k + 28))
            doubtful = sorted(mine, key=lambda b: (abs(2 * int(ones[b]) - n), b))[:6]
            for some in itertools.chain(*(itertools.combinations(doubtful, r) for r in range(3))):
                want.add(sum((bits[b] ^ (b in some)) << (b - 28 * k) for b in mine) | k << 28)
        assert sorted(where) == sorted(want) and len(where) == 198


def test_copies_of_four_fifths_meet():
    """Of pairs of texts that share exactly 0.8 of their union nine in ten are found at least, and nearly all at 0.9."""
    rng = np.random.default_rng(1)
    found = {}
    for both, own in ((320, 40), (360, 20)):
        pairs = [(h := rng.integers(0, 2**63, both + 2 * own).astype(np.uint64), h[own:], h[: both + own]) for _ in range(1_500)]
        found[both] = np.mean([met_and_near(simhash.sketch(a), simhash.sketch(b), 17) for _, a, b in pairs])
    assert found[320] >= 0.95 and found[360] >= 0.99


@pytest.mark.parametrize("n", [2_000, 32_000])
def test_chance_meetings_dont_grow(n):
    """Unlike texts hardly share a place, at either size: work for each text stays as it is."""
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    doubtful = rng.random((n, 9, 28)).argsort(axis=2)[:, :, :6].astype(np.uint8).reshape(n, -1)
    where = simhash.places([c.tobytes() for c in np.concatenate([codes, doubtful], axis=1)])
    assert np.unique(where, return_counts=True)[1].max() <= 4


# -- mixing

def test_mixing(docs, nothing):
    got = mixing.mix(clashing(docs, "size", "taken")).toPandas()
    assert len(got) == len(ROWS)
    assert (got["taken"] <= 3 * got["size"]).all() and (got.loc[got["size"] > 0, "taken"] % got.loc[got["size"] > 0, "size"] == 0).all()
    sources = got.drop_duplicates("source")
    assert math.isclose(sources["target"].sum(), got["size"].sum())
    assert (sources["target"] <= 3 * sources["source_size"] + 1e-6).all()
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(docs).toPandas()
    assert sorted(zip(got["doc_id"].astype(str), got["taken"], strict=True)) == sorted(zip(again["doc_id"].astype(str), again["taken"], strict=True))


def test_mixing_tells_rows_apart(spark):
    """Null and empty sources, and a sign that could end a source, don't make two rows one."""
    rows = [(1, "x y", None), (1, "x y", ""), (2, "a b c", "s"), (3, "b", "a\x01"), (3, "\x01b", "a"), (2, "a b c", "s")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_ticket", F.lit("own"))).collect()
    assert sorted((r["doc_id"], r["text"], str(r["source"])) for r in got) == sorted((a, b, str(c)) for a, b, c in rows)
    assert {r["_ticket"] for r in got} == {"own"}


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}" if i % 2 else "s0", 1) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 14 for r in got)


def test_refill(spark):
    """Weights 1, 2, 3 of 60 in all; the third source of size 5 stops at 15, and the others share 45 as 1 to 2."""
    rows = [(1, "w " * 35, "en", "a", 1), (2, "w " * 20, "en", "b", 1), (3, "w " * 5, "en", "c", 1)]
    got = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == pytest.approx({"a": 15.0, "b": 30.0, "c": 15.0})


# -- embeddings

def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = rng.normal(size=16)
        rows.append((i, x.tolist(), int(i % 3)))
        if i % 4 == 0:
            rows.append((1000 + i, (x + rng.normal(size=16) * 0.03).tolist(), int(i % 3)))
        if i % 10 == 0:
            rows.append((2000 + i, x.tolist(), int(i % 3)))
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [0.0] * 16, 1), (5003, [None] + [1.0] * 15, 1), (5004, [float("nan")] + [1.0] * 15, 1), (5005, rows[0][1], None), (5006, rows[0][1][:8], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", 40)
    frame, rows = vectors(spark)
    good = [r for r in rows if r[1] and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows}
    for k, a in enumerate(good):
        for b in good[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(clashing(frame, "rep", "size", "code", "k1", "copies")).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(map(len, links.values()))
    assert got[5001]["n_links"] == 0 and got[5001]["kept"] and got[5005]["n_links"] == 0
    assert got[2000]["component_id"] == 0 and not got[2000]["kept"]
    assert embedding_dedup.embedding_dedup(frame.limit(0)).count() == 0


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.001e200]), (3, [1e-320, 1e-320]), (4, [5.0, 5.0]), (5, [-1.0, 1.0]), (6, [1.7e308, -1.7e308])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), (3, 1)), 5: (0, 5), 6: (0, 6)}


def test_vectors_that_no_direction_splits(spark, monkeypatch):
    """A label of nearly equal vectors is one leaf of many blocks: every link is counted once."""
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "MOST_ROWS", 32)
    monkeypatch.setattr(embedding_dedup, "MOST_LEVELS", 1)
    rng = np.random.default_rng(8)
    rows = [(i, (np.ones(8) + 1e-4 * rng.normal(size=8)).tolist(), 1) for i in range(150)] + [(1000, [-1.0] * 8, 1)]
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i]["n_links"] == 149 and got[i]["component_id"] == 0 for i in range(150)) and got[1000]["n_links"] == 0


def test_recall_of_the_forest(spark, tmp_path):
    """50,000 vectors of one label, clustered, with near copies around the limit: nine links of ten at least, and no wrong one."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(200, 48))
    x = centers[rng.integers(0, 200, 40_000)] + 0.8 * rng.normal(size=(40_000, 48))
    near = x[:10_000] + rng.uniform(0.05, 0.28, (10_000, 1)) * rng.normal(size=(10_000, 48))
    x = np.concatenate([x, near])
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), "label": np.ones(len(x), np.int64)}), tmp_path / "v.parquet", row_group_size=5_000)
    frame = spark.read.parquet(str(tmp_path / "v.parquet"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = []
    for at in range(0, len(x), 2_000):
        links += (((unit[at : at + 2_000] @ unit.T) >= 0.98).sum(axis=1) - 1).tolist()
    got = embedding_dedup.embedding_dedup(frame).select("vec_id", "n_links").toPandas().sort_values("vec_id")["n_links"].to_numpy()
    recall = got.sum() / sum(links)
    print(f"recall of the forest: {recall:.4f} of {sum(links) // 2} links")
    assert (got <= np.array(links)).all() and recall >= 0.9


def best_by_hand(whole, k=10):
    out = []
    for q in (i for i in whole if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q and len(whole[i]) == len(whole[q]))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8_192, 32])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "RANGES", 4)
    frame, rows = vectors(spark)
    whole = {r[0]: [math.floor(1024 * v) for v in r[1]] for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])}
    got = topk.top_k(clashing(frame, "row", "dim", "block", "is_query", "near"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == best_by_hand(whole)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_sends_queries_to_near_blocks(spark, monkeypatch):
    """Clusters far from each other: most blocks never see a query, and the result is whole."""
    monkeypatch.setattr(topk, "BLOCK", 100)
    sent = []
    monkeypatch.setattr(topk, "cut", lambda df, cut=topk.cut: sent.append(cut(df)) or sent[-1])
    rng = np.random.default_rng(12)
    centers = np.linalg.qr(rng.normal(size=(12, 12)))[0] * 40
    rows = [(i, (centers[i % 12] + rng.normal(size=12)).tolist()) for i in range(2_400)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == best_by_hand({i: [math.floor(1024 * v) for v in x] for i, x in rows})
    routed = next(d for d in sent if d.columns == ["row", "query_block", "block"])
    assert routed.count() < 0.3 * 24 * 24


def test_top_k_beyond_64_bits(spark):
    ask = lambda rows: topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    with pytest.raises(Exception, match="fit 64 bits"):
        ask([(0, [4e6] * 64), (1, [4e6] * 64)])
    with pytest.raises(Exception, match="fit 64 bits"):
        ask([(0, [1e300]), (1, [1.0])])
    assert [tuple(r) for r in ask([(0, [1e6] * 4), (1, [-1e6] * 4)])] == [(0, 1, 1, -4 * 1024**2 * 10**12)]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


# -- classifiers

def held(i, fold, remainder):
    return zlib.crc32(str(i).encode()) % fold == remainder


def test_held_out(spark):
    got = spark.range(50).select("id", labelled.held_out("id").alias("h")).collect()
    assert all(r["h"] == held(r["id"], 5, 0) for r in got)


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        words = [str(w) for w in rng.choice(["river", "house", "green", "stone", "light", "walk"], 40)]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[10] = ["blockhead", "nitwit"][i % 2]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(scored, labels, k):
    truth = {r[0]: r[k] for r in labels}
    out = [r["predicted"] == truth[r["doc_id"]] for r in scored.collect() if held(r["doc_id"], 5, 0)]
    return sum(out) / len(out)


def test_quality(graded, docs, nothing):
    texts, labels, rows = graded
    model = quality.fit_quality(texts, labels)
    assert accuracy(quality.score_quality(texts, model), rows, 1) >= 0.95
    odd = quality.score_quality(clashing(docs, "score", "predicted"), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in odd)
    assert quality.score_quality(nothing, quality.fit_quality(nothing, labels)).count() == 0


def test_quality_learns_from_every_labelled_row(spark):
    """More rows of a class than the 8,000 that were once the most; each is in a pair, and borders are those of all rows."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', cast(id % 7 + 1 as int)) || id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 40 != 0).cast("int").alias("quality"))
    rows = quality.learned_rows(docs, labels)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    free = [i for i in range(12_000) if not held(i, 5, 0)]
    assert n == {0: sum(i % 40 == 0 for i in free), 1: sum(i % 40 != 0 for i in free)} and n[1] > 8_000
    ranks = rows.groupBy("label", "part").agg(F.max("number").alias("last"), F.count_distinct("number").alias("n"))
    assert ranks.where("last <> n").count() == 0 and ranks.agg(F.sum("n")).first()[0] == len(free)
    pairs = quality._pairs(rows, n)
    of = lambda c, label: pairs.select(F.col(c).alias("x")).distinct().count() == rows.where(f"label = {label}").select("x").distinct().count()
    assert pairs.count() >= 2 * n[1] and of("good", 1) and of("bad", 0)
    x = np.array([r["x"] for r in rows.collect()])
    edges = quality._edges(rows)
    assert np.array_equal(edges[:, 0], x.min(axis=0)) and (edges[:, -1] >= x.max(axis=0)).all()
    assert np.allclose(edges[:, 1:-1], np.quantile(x, np.linspace(0, 1, 11)[1:-1], axis=0, method="inverted_cdf").T, rtol=0.005)


def test_toxicity(graded, docs, nothing):
    texts, labels, rows = graded
    grammar = toxicity.fit_toxicity(texts, labels)
    assert accuracy(toxicity.score_toxicity(texts, grammar), rows, 2) >= 0.95
    odd = toxicity.score_toxicity(clashing(docs, "score"), grammar).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in odd)
    assert toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing, labels)).count() == 0


def test_composed_machine_is_its_parts_in_a_row():
    """Against the transducers run one after the other over all short clauses and many long ones."""
    rng, parts = np.random.default_rng(9), toxicity.grammar_parts()
    clauses = [list(c) for n in range(4) for c in itertools.product(range(8), repeat=n)] + [rng.integers(0, 8, 20).tolist() for _ in range(500)]
    for clause in clauses:
        paths = [clause]
        for part in parts:
            paths = [out for p in paths for out in part.transduce(p)]
        assert len(paths) == 1
        assert toxicity.MACHINE.read(clause) == [toxicity._EMITTED.get(y, -1) for y in paths[0]]


def outputs_by_hand(text, patterns):
    """Rules on a clause's words, without automata."""
    out = np.zeros(8)
    for clause in re.split(r"[.!?;:\n]", text):
        words = re.findall(r"[^\W\d_]+", clause)
        weight = [max([w for p, w in patterns.items() if word == p or (p.endswith("*") and word.startswith(p[:-1]))], default=0) for word in words]
        kind = ["insult" if w else next((k for k, of in (("before", toxicity.VERBS_BEFORE_TARGET), ("after", toxicity.VERBS_AFTER_TARGET), ("threat", toxicity.VERBS_WITH_TARGET), ("target", toxicity.TARGETS), ("not", toxicity.NEGATIONS), ("said", toxicity.REPORTS)) if word in of), "") for word, w in zip(words, weight, strict=True)]
        aimed, heaviest = any(k in ("target", "threat") for k in kind), 0
        for k, what in enumerate(kind):
            denied, reported = "not" in kind[max(0, k - 3) : k], "said" in kind[:k]
            last = kind[k - 1] if k else ""
            if what == "insult":
                out[2 if denied else 3 if reported else 1 if aimed else 0] += weight[k]
                heaviest = max(heaviest, weight[k])
            elif what == "threat" or (what == "target" and last == "before") or (what == "after" and last == "target"):
                out[5 if denied or reported else 4] += 3
                heaviest = max(heaviest, 3)
        out[6], out[7] = max(out[6], heaviest), out[7] + (heaviest > 0)
    return out


def test_outputs_by_hand():
    rng, patterns = np.random.default_rng(3), {"nitwit": 4.0, "block*": 2.5, "blockhead": 3.0}
    grammar = toxicity.Grammar(patterns)
    words = ["nitwit", "blockhead", "blocks", "unblock", "kill", "you", "te", "tuer", "matarte", "not", "said", "river", ".", "!", "he", "stone,"]
    for _ in range(400):
        text = " ".join(rng.choice(words, 25))
        assert grammar.outputs(text).tolist() == outputs_by_hand(text, patterns).tolist(), text


def test_sample_of_repeated_ids(spark):
    """A doc_id with many texts gives one, so the sample keeps its bound, and reruns agree."""
    docs = spark.createDataFrame([(i % 5 + 1, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 6)], "doc_id long, toxic int")
    got = [sorted(r["text"] for r in labelled.sample_texts(d, labelled.sample_labels(labels, "toxic", {1: 10})).collect()) for d in (docs, docs.orderBy(F.desc("text")))]
    assert len(got[0]) <= 5 and got[0] == got[1]


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar({"nitwit": 4.0, "block*": 4.0})
    score = lambda t: float(grammar.score(grammar.outputs(t)))
    assert score("you are a nitwit") > score("a nitwit") > score("he said it was a nitwit") > score("you are not a nitwit") > score("a fine day")
    assert score("what a blockhead") > score("a fine day") and score("unblock it") == score("a fine day")
    assert score("i will kill you") > score("i will not kill you") > score("you kill time") == score("a fine day")
    assert score("je vais te tuer") > score("a fine day")


def test_languages(spark, docs, nothing):
    rng = np.random.default_rng(4)
    words = {"aa": ["baba", "nana", "gaba", "taga"], "bb": ["bibi", "nini", "gibi", "tigi"]}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang, "s", 1) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    frame = spark.createDataFrame(rows, SCHEMA)
    filters = langid.fit_languages(frame.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame, filters).collect()}
    assert all(got[r[0]] == r[2] for r in rows if r[0] % 3 == 1)
    odd = {r["doc_id"]: r for r in langid.identify(clashing(docs, "score", "lang_pred"), filters).collect()}
    assert [odd[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and odd[4]["score"] == 0
    assert langid.identify(nothing, langid.fit_languages(nothing)).count() == 0


def invented(k, rng, n=60):
    """Words of a made-up language: each has its own syllables."""
    own = np.random.default_rng(k)
    syllables = ["".join(own.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
    return " ".join("".join(rng.choice(syllables, 2)) for _ in range(n))


def test_more_languages_than_a_word_holds(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 100 + k, invented(k, rng), f"l{k:02}") for k in range(70) for i in range(5)]
    filters = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.languages == [f"l{k:02}" for k in range(70)]
    assert filters.decide([invented(k, rng) for k in range(70)])[0] == filters.languages


def test_language_of_many_copies_is_learned(spark):
    rng = np.random.default_rng(4)
    texts = {lang: [invented(k, rng) for _ in range(4)] for k, lang in enumerate(("aa", "bb"))}
    rows = [(i, texts["aa"][i % 4], "aa") for i in range(40_000)] + [(50_000 + i, t, "bb") for i, t in enumerate(texts["bb"])]
    filters = langid.fit_languages(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "lang"])), per_language=3)
    assert all(np.count_nonzero(filters.table[0] & (1 << bit)) for bit in range(2))
    assert filters.decide([invented(k, rng) for k in (0, 1)])[0] == ["aa", "bb"]


def test_empty_tables(nothing):
    assert line_dedup.line_dedup(nothing).count() == 0
    assert packing.pack(nothing, VOCABULARY).count() == 0
    shards = token_shards.write_shards(nothing, VOCABULARY)
    assert token_shards.read_shards(shards, token_shards.write_index(shards)).count() == 0


# -- the pipeline's stages

STAGES = dict(corpus_pipeline.STAGES)
ODD_COLUMNS = ("score", "predicted", "size", "target", "taken", "_time", "_row", "_ticket", "kept_text", "n_lines", "hit_doc_id", "_keep_id", "line_answer", "ids", "before")


@pytest.fixture(scope="module")
def sf_dir(spark, graded, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    graded[1].write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, docs, nothing, sf_dir, name):
    """Nulls, empty and very long texts, ties, repeated rows and other columns' names; and no rows at all."""
    frame = clashing(docs, *ODD_COLUMNS)
    got = STAGES[name](spark, frame, sf_dir)
    rows = got.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS} and sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    else:
        assert got.columns == frame.columns and all(r[c] == "old" for r in rows for c in ODD_COLUMNS)
    if name == "line_dedup":
        assert len(rows) == len(ROWS) and all(r["n_chars"] == len(r["text"]) for r in rows)
    if name == "simhash_near_dedup":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "3", "4", "7", "8", "9", "None"])
    if name == "mix_sources":
        assert not {4, 5, 6} & {r["doc_id"] for r in rows} and max(sum(r["doc_id"] == i for r in rows) for i in (1, 2, 3, 8)) <= 3
    assert STAGES[name](spark, nothing, sf_dir).count() == 0


def test_pipeline_by_hand(spark, graded, sf_dir):
    """The stages over a table, against what each ought to keep."""
    texts, labels, rows = graded
    quality_of = {r[0]: r[1] for r in rows}
    shared = [(1000 + i, f"Copyright notice of all\nown text number {i} with some words of its own {i * 7} {i * 13}", "en", "t", 1) for i in range(12)]
    docs = texts.unionByName(spark.createDataFrame(shared, SCHEMA)).unionByName(texts.where("doc_id = 2").withColumn("doc_id", F.lit(5000).cast("long")))
    kept = STAGES["quality_classifier"](spark, docs, sf_dir)
    good = {r["doc_id"] for r in kept.collect()}
    assert sum((i in good) == bool(q) for i, q in quality_of.items()) >= 0.97 * len(quality_of)
    lines = STAGES["line_dedup"](spark, docs, sf_dir)
    assert all("copyright" not in r["text"].lower() for r in lines.collect()) and lines.count() == docs.count()
    once = STAGES["simhash_near_dedup"](spark, lines, sf_dir)
    left = {r["doc_id"] for r in once.collect()}
    assert 2 in left and 5000 not in left
    docs.write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} <= good and 5000 not in {r["doc_id"] for r in pieces}

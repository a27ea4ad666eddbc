"""Captions: options, lines of least cost, wrapped titles, reflow and script cues against plain versions."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapework.operators import scripts, segmentation
from tapework.operators.scripts import pack_phrases

LAYOUT = segmentation.Layout(available=100.0, half_width=10.0)
SCHEMA = "item_id long, pos long, token_id string, text string, start_us long, end_us long"


def tokens_of(spark, items):
    rows = []
    for item, (words, pauses) in enumerate(items):
        at = 0
        for pos, (word, pause) in enumerate(zip(words, pauses, strict=True)):
            rows.append((item, pos, f"t{pos}", word, at, at + 100_000))
            at += 100_000 + pause
    return spark.createDataFrame(rows, SCHEMA)


def weigh(text):
    shown = re.sub(r"\s", "", text)
    return 0 if not text.strip(" ") else max(1, sum(1 if c.isascii() else 2 for c in shown))


def cost_by_hand(words, pauses, preferred, a, b, layout):
    line = words[a : b + 1]
    width = sum(map(weigh, line)) * layout.half_width + (sum(map(len, line)) - 1) * layout.spacing
    final = b == len(words) - 1
    cost = 8 * (width / max(1.0, layout.comfort) - 0.82) ** 2 + (5 if len(line) <= 2 and not final else 0) + (1000 if width > layout.hard else 0)
    if not final:
        pause = pauses[b]
        cost += -min(5.0, pause / 1e6 * 8) if pause >= 250_000 else 1.2 if pause < 180_000 else 0
        cost -= (3 if re.search("[。！？!?；;，,：:]$", words[b]) else 0) + (4 if b in preferred else 0)
        cost += 1000 if re.fullmatch("[A-Za-z0-9]", words[b]) and re.match("[A-Za-z0-9]", words[b + 1]) else 0
    return width, cost


def ends_by_hand(words, required, forbidden, a, layout):
    """Where a line from a may end: up to the first allowed end that is too wide, and to the first required break."""
    out, last = [], len(words) - 1
    for b in range(a, len(words)):
        if b not in forbidden or b == last or b in required:
            out.append(b)
            width = sum(map(weigh, words[a : b + 1])) * layout.half_width + (sum(map(len, words[a : b + 1])) - 1) * layout.spacing
            if width > layout.hard and b > a:
                break
        if b in required:
            break
    return out


def best_by_hand(words, pauses, required, forbidden, preferred, layout):
    """The least cost over all ways to cut the tokens."""

    def ways(a):
        if a == len(words):
            yield 0.0
            return
        for b in ends_by_hand(words, required, forbidden, a, layout):
            for rest in ways(b + 1):
                yield cost_by_hand(words, pauses, preferred, a, b, layout)[1] + rest

    return min(ways(0))


@pytest.mark.parametrize("spacing", [0.0, 2.0, -3.0])
def test_segment_lines_by_brute_force(spark, spacing):
    layout, rng = segmentation.Layout(100.0, 10.0, spacing), np.random.default_rng(4)
    vocabulary = ["ab", "c", " ", "好", "long,", "字。", "x"]
    items, marks = [], []
    for item in range(30):
        n = int(rng.integers(1, 12))
        items.append(([str(w) for w in rng.choice(vocabulary, n)], rng.choice([0, 200_000, 300_000, 900_000], n).tolist()))
        kinds = {"required": {i for i in range(n - 1) if rng.random() < 0.1}}
        kinds["forbidden"] = {i for i in range(n) if rng.random() < 0.3} - kinds["required"]
        kinds["preferred"] = {i for i in range(n) if rng.random() < 0.2}
        marks.append(kinds)
    breaks = spark.createDataFrame([(k, p, kind) for k, m in enumerate(marks) for kind, ps in m.items() for p in ps] or [(99, 0, "required")], "item_id long, pos long, kind string")
    tokens = tokens_of(spark, items)
    got = {}
    for r in segmentation.segment_lines(tokens, breaks, layout).orderBy("item_id", "line").collect():
        got.setdefault(r["item_id"], []).append((r["first_pos"], r["last_pos"]))
    for k, ((words, pauses), m) in enumerate(zip(items, marks, strict=True)):
        assert [p for a, b in got[k] for p in range(a, b + 1)] == list(range(len(words)))
        assert all(b in ends_by_hand(words, m["required"], m["forbidden"], a, layout) for a, b in got[k])
        spent = sum(cost_by_hand(words, pauses, m["preferred"], a, b, layout)[1] for a, b in got[k])
        assert spent == pytest.approx(best_by_hand(words, pauses, m["required"], m["forbidden"], m["preferred"], layout))


@pytest.mark.parametrize("spacing", [0.0, 1.5, -4.0])
def test_line_options_by_hand(spark, spacing):
    layout, rng = segmentation.Layout(100.0, 10.0, spacing), np.random.default_rng(6)
    words = [str(w) for w in rng.choice(["ab", "c", " ", "好", "wide-word", "字。"], 60)]
    pauses = rng.choice([0, 200_000], 60).tolist()
    required, forbidden, preferred = {20, 41}, {3, 4, 5, 30}, {7, 33}
    breaks = spark.createDataFrame([(0, p, k) for k, ps in (("required", required), ("forbidden", forbidden), ("preferred", preferred)) for p in ps], "item_id long, pos long, kind string")
    wanted = set()
    for a in range(60):
        found = []
        for b in range(a, 60):
            width = sum(map(weigh, words[a : b + 1])) * 10.0 + (sum(map(len, words[a : b + 1])) - 1) * spacing
            if width > layout.hard + 0.5:
                break
            if b not in forbidden or b == 59:
                found.append((b, width, b in preferred or b in required or (b < 59 and pauses[b] >= 180_000)))
            if b in required:
                break
        near = sorted(found, key=lambda f: (abs(float(np.sign(f[1]) * np.floor(abs(f[1]) * 10 + 0.5) / 10) - layout.comfort), f[0]))[:4]
        wanted |= {(a, f[0]) for f in found if f in near or f == found[-1] or f[2]} or {(a, a)}
    got = segmentation.line_options(tokens_of(spark, [(words, pauses)]), breaks, layout).collect()
    assert {(r["start_pos"], r["end_pos"]) for r in got} == wanted and len(got) == len(wanted)


def test_options_of_one_letter_words(spark):
    """Letters with blanks between them: a line holds twice as many tokens as half units."""
    wide = segmentation.Layout(available=1000.0, half_width=16.0)
    words = ["a", " "] * 65
    none = spark.createDataFrame([], "item_id long, pos long, kind string")
    got = segmentation.line_options(tokens_of(spark, [(words, [0] * 130)]), none, wide).where("start_pos = 0")
    assert got.agg(F.max("end_pos"), F.max("width")).collect()[0] == (117, 944.0)


def test_options_that_are_taken_some_at_a_time():
    rng = np.random.default_rng(2)
    n = 500
    t = {"pos": np.arange(n), "units": rng.integers(0, 5, n), "chars": rng.integers(1, 5, n), "preferred": rng.random(n) < 0.1, "required": rng.random(n) < 0.03, "forbidden": rng.random(n) < 0.2, "pause_us": rng.integers(0, 400_000, n)}
    whole, parts = segmentation._options(LAYOUT)(t), segmentation._options(LAYOUT, 7)(t)
    key = lambda o: sorted(zip(*(o[c].tolist() for c in ("start_pos", "end_pos", "width", "natural")), strict=True))
    assert key(whole) == key(parts)


def phrases_by_hand(text):
    """Every phrase is cut by looking at the whole rest again."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        for part in re.split("(?<=[。！？!?；;，,、])", line.strip(" ")):
            part = part.strip(" ")
            if not part:
                continue
            seen = lambda x: len(re.sub(r"\*\*(.+?)\*\*", r"\1", x))
            if seen(part) <= 18:
                out.append(part)
                continue
            tokens = re.findall(r"\*\*.+?\*\*|[A-Za-z0-9][A-Za-z0-9_+\-./#]*|[ \t\r\f\v]+|.", part)
            at = 0
            while at < len(tokens):
                end = at + 1
                while end < len(tokens):
                    size = sum(seen(t) if t.startswith("**") else len(t) for t in tokens[at:end])
                    follows = seen(tokens[end]) if tokens[end].startswith("**") else len(tokens[end])
                    if (size >= 12 or size + follows > 18) and not re.match(r"[A-Za-z0-9_+\-./#]", tokens[end]):
                        break
                    end += 1
                out.append("".join(tokens[at:end]).strip(" "))
                at = end
    return [p for p in out if re.sub(r"\*\*(.+?)\*\*", r"\1", p).strip(" ")]


def test_split_phrases_by_hand(spark):
    rng = np.random.default_rng(5)
    bits = ["今天", "我们", "来讲", "AI", "tool-2", " ", "**重点** ", "，", "。", "\n", "\r\n", "a", "**", "提高工作效率", "!"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 60)))) for _ in range(300)] + [None, "", " ", "x" * 5_000, "字" * 3_000]
    got = {}
    for r in scripts.split_phrases(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "phrase_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["phrase"])
    assert all(got.get(k, []) == phrases_by_hand(t or "") for k, t in enumerate(texts))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="字a1 .*", max_size=80))
def test_phrases_keep_their_text(part):
    assert "".join(pack_phrases(part, 12, 18)).replace(" ", "") == part.replace(" ", "")


def units(text):
    """Visual units, blanks left out, an ASCII sign for a half; a half at the end goes to the even number."""
    return round(sum(1.0 if ord(c) > 127 else 0.5 for c in text if not c.isspace()))


def test_wrap_titles(spark):
    titles = ["almond antique blue chocolate", "aaaaaaaaaa bbbbbbbbbbb", "aaaaaaaaaa bbbbbbbbbbbb", "a+b/c#d.e one-two_three (four) five", "one\nmanual break that is long enough to wrap\r\n\r\nthree", "字字字字字字字字字字字字", "字字字字字字字字字字aa b", "", None, "  ", "a" * 50, "x y z"]
    got = {r["k"]: r["lines"] for r in segmentation.wrap_titles(spark.createDataFrame(list(enumerate(titles)), "k long, title string"), "title").collect()}
    for k, title in enumerate(titles):
        wanted = []
        for line in ((title or "").strip() or "未命名视频").splitlines():
            words = re.findall(r"[A-Za-z0-9_-]+|\s+|.", line.strip())
            # Every line is the longest start of the rest whose every start up to there is within ten units, and one word at least.
            while words:
                n = next((n for n in range(2, len(words) + 1) if units("".join(words[:n])) > 10 and "".join(words[: n - 1])), len(words) + 1) - 1
                wanted.append("".join(words[:n]).strip())
                words = words[n:]
                if words and not words[0].strip():
                    words = words[1:]
        assert got[k] == "\n".join([w for w in wanted if w][:3]), title
    assert got[1] == "aaaaaaaaaa bbbbbbbbbbb" and got[2] == "aaaaaaaaaa\nbbbbbbbbbbbb" and got[7] == "未命名视频"


def test_wrap_title_text(spark):
    """Every line of a title is an item of segment_lines(); breaks hold, own line feeds stay, blank lines go."""
    layout = segmentation.Layout(200.0, 10.0)
    titles = [(1, "one two three four five six\r\n\r\n  seven  "), (2, ""), (3, None), (4, "ab cd")]
    df = spark.createDataFrame(titles, "k long, title string")
    got = {r["k"]: r["lines"] for r in segmentation.wrap_title_text(df, "k", "title", layout).collect()}
    assert got[2] == got[3] == "" and got[4] == "ab cd"
    lines = got[1].split("\n")
    assert lines[-1] == "seven" and " ".join(lines[:-1]) == "one two three four five six" and len(lines) > 2 and all(10 * len(x.replace(" ", "")) <= layout.hard for x in lines)
    must = spark.createDataFrame([("4:1", 1, "required")], "item_id string, pos long, kind string")
    assert {r["k"]: r["lines"] for r in segmentation.wrap_title_text(df, "k", "title", layout, must).collect()}[4] == "ab\ncd"


def test_cues_from_timing_text(spark):
    rows = [(1, 1, 0, 1_000_000, "short"), (1, 2, 1_000_000, 5_000_000, "eins zwei drei vier fünf。sechs"), (1, 3, 5_000_000, 5_000_000, "no time"), (1, 4, 5_000_000, 6_000_000, "  "), (1, 5, 7_990_000, 7_995_000, "late"), (2, 1, 0, 5, "no media")]
    media = spark.createDataFrame([(1, 8_000_000)], "item_id long, duration_us long")
    got = segmentation.cues_from_timing_text(spark.createDataFrame(rows, "item_id long, seq long, start_us long, end_us long, text string"), media, 100_000).orderBy("idx").collect()
    wanted, idx = [], 0
    for _, _, start, end, text in rows[:5]:
        if end <= start or not text.strip():
            continue
        phrases = [p for part in re.split("(?<=。)", text) for p in scripts.pack_phrases(part, 12, 18)]
        s = min(8_000_000, start + 100_000)
        e = max(s + 200_000, min(8_000_000, end + 100_000))
        weights = [max(4, len(p)) for p in phrases]
        for k, p in enumerate(phrases):
            idx += 1
            at = lambda n: s + (e - s) * sum(weights[:n]) // sum(weights)  # noqa: B023, E731
            wanted.append((idx, at(k), at(k + 1), p))
    assert [(r["idx"], r["start_us"], r["end_us"], r["text"]) for r in got] == wanted and len(wanted) > 4


def test_reflow(spark):
    """An edited sentence in the middle stays; what is before and after it is cut anew, and clips keep their outer ends."""
    words = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"] * 2
    tokens = tokens_of(spark, [(words, [0] * 16)])
    rows = [(0, "s1", 1, 0, 3, False, 5), (0, "s2", 2, 4, 7, True, 6), (0, "s3", 3, 8, 11, False, 7), (0, "s4", 4, 12, 15, False, 8)]
    sentences = spark.createDataFrame([(i, s, o, a, b, e, False, False, False, x * 1_000_000, (x + 1) * 1_000_000) for i, s, o, a, b, e, x in rows], "item_id long, sentence_id string, timeline_order long, first_pos long, last_pos long, edited boolean, pending boolean, remove_video boolean, gap boolean, clip_start_us long, clip_end_us long")
    none = spark.createDataFrame([], "item_id long, pos long, kind string")
    got = segmentation.reflow(sentences, tokens, none, LAYOUT).orderBy("timeline_order").collect()
    assert [p for r in got for p in range(r["first_pos"], r["last_pos"] + 1)] == list(range(16))
    kept = next(r for r in got if r["sentence_id"] == "s2")
    assert (kept["first_pos"], kept["last_pos"], kept["clip_start_us"]) == (4, 7, 6_000_000)
    assert got[0]["clip_start_us"] == 5_000_000 and got[-1]["clip_end_us"] == 9_000_000
    assert [r["timeline_order"] for r in got] == list(range(1, len(got) + 1)) and len({r["sentence_id"] for r in got}) == len(got)
    for first, last in ((0, 3), (8, 15)):
        run = [(r["first_pos"] - first, r["last_pos"] - first) for r in got if first <= r["first_pos"] <= last]
        part = words[first : last + 1]
        spent = sum(cost_by_hand(part, [0] * len(part), set(), a, b, LAYOUT)[1] for a, b in run)
        assert spent == pytest.approx(best_by_hand(part, [0] * len(part), set(), set(), set(), LAYOUT))


def test_cues_from_script(spark):
    texts = {1: "第一句话。第二句比较长一些，第三句", 2: "one two three four five six seven", 3: "", 4: "短"}
    rows = [(k, t, 10_000_000) for k, t in texts.items()]
    got = {}
    for r in segmentation.cues_from_script(spark.createDataFrame(rows, "item_id long, text string, duration_us long"), 500_000).orderBy("item_id", "idx").collect():
        got.setdefault(r["item_id"], []).append((r["start_us"], r["end_us"], r["text"]))
    for k, text in texts.items():
        phrases = phrases_by_hand(text)
        weights = [max(4, len(re.sub(r"\*\*(.+?)\*\*", r"\1", p))) for p in phrases]
        spoken, n = 9_500_000.0, len(phrases)
        lengths = [max(min(800_000.0, spoken / n), spoken * w / sum(weights)) for w in weights]
        ends = [500_000 + x / sum(lengths) * spoken for x in itertools.accumulate(lengths)]
        cues = got.get(k, [])
        assert [c[2] for c in cues] == phrases
        assert all(abs(c[1] - e) <= 1 for c, e in zip(cues, ends, strict=True))
        assert all(a[1] == b[0] for a, b in itertools.pairwise(cues)) and (not cues or (cues[0][0], cues[-1][1]) == (500_000, 10_000_000))

"""Spelling variants and benchmark decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shiftlens.llm import decontaminate as D, spelling as S

DOC = "doc_id long, text string, key string, word string, n long, window string"
ITEM = "item_id long, text string, key string, length string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "w", 5, "x") for i, t in rows], DOC)


# ---------------------------------------------------------------- spelling


def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = plain_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(found[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return out


def edited(rng, word, letters):
    k, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    if kind == 0:
        return word[:k] + rng.choice(letters) + word[k:]
    k = min(k, len(word) - 1)
    return word[:k] + (rng.choice(letters) if kind == 1 else "") + word[k + 1 :]


def spelling_rows(rng):
    letters = "abÉéüAB×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(60)]
    words += ["".join(rng.choice("xyz") for _ in range(rng.randint(25, 40))) for _ in range(10)]
    words += [edited(rng, w, letters) for w in words for _ in range(6)]
    words += ["a" * k for k in range(6, 14)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join(rng.choice(words) for _ in range(60)) + "."))
    common = words[:8]
    chain = ["variantaa"] * 1500 + ["variantab"] * 100 + ["variantbb"] * 5 + common * 3
    rows += [(910 + k, " ".join(chain)) for k in range(3)] + [(920, "variantbbc Variantbbc")]
    rows += [(930 + k, " ".join([f"spelled{c}" * 40 for c in "abcdef"] + [f"spelled{c} " * 60 for c in "abcdef"])) for k in range(4)]
    rows += [(940 + k, " ".join(f"spelle{c} speled{c} sspelled{c}" for c in "abcdef")) for k in range(2)]
    rows += [(900, " ".join(chain)), (900, " ".join(chain)), (901, None), (902, ""), (None, " ".join(words[:50] * 2)),
             (903, "9x" + "long" * 3000 + "-" + "long" * 3000 + "x"), (904, " ".join(words * 3))]
    return rows


def test_variants_equal_brute_force(spark):
    rows = spelling_rows(random.Random(7))
    want = plain_variants(rows)
    assert sum(w[1] is not None for w in want) > 5 and any(w[2] != w[1] and w[1] for w in want)
    got = S.spelling_variants(docs_frame(spark, rows)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pairs_do_not_depend_on_the_tiles(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(400)}
    words |= {"prefixes" + a + b + "suffix" for a in "abcdefgh" for b in "abcdefgh"}
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if near(a, b)}
    for tile in (1, 3, 20, S.TILE):
        got = [(r.word, r.near) for r in S.near_words(frame, tile).collect()]
        assert len(got) == len(want) and set(got) == want, tile


def test_one_edit_on_padded_matrices():
    rng = random.Random(9)
    for w in (1, 2, 3, 5):
        left = sorted({"".join(rng.choice("ab") for _ in range(w)) for _ in range(12)})
        for shift in (0, 1):
            right = sorted({"".join(rng.choice("ab") for _ in range(w + shift)) for _ in range(20)})
            hit, prefix = S.one_edit(S.code_points(left, w), S.code_points(right, w + shift), shift)
            for i, a in enumerate(left):
                for j, b in enumerate(right):
                    assert bool(hit[i, j]) == near(a, b)


def test_segments_cover_every_place(spark):
    for m in range(7, 80):
        bounds = S.segment_bounds(m)
        assert bounds[0] == 0 and bounds[-1] == m and all(a < b for a, b in zip(bounds, bounds[1:]))
    rows = S.block_rows(spark.createDataFrame([("abcdefgh", 3)], "word string, n long"))
    assert rows.groupBy("m").count().orderBy("m").collect() == [(7, 3), (8, 3)]


def test_no_words(spark):
    assert S.spelling_variants(docs_frame(spark, [])).count() == 0
    assert S.spelling_variants(docs_frame(spark, [(1, None), (2, "short words only 12345678")])).count() == 0


# ---------------------------------------------------------------- decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain_lower(text or ""))


def plain_hits(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for item_id, item in items:
            v = plain_words(item)
            n = min(len(v), 10)
            if not n:
                continue
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids.add("" if item_id is None else str(item_id))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


def got_hits(spark, docs, items, windows=D.Windows()):
    bench = spark.createDataFrame([(i, t, "k", "x") for i, t in items], ITEM)
    rows = D.decontaminate(docs_frame(spark, docs), bench, windows)
    apart = "forall(sequence(1, size(spans) - 1), i -> spans[i].start > spans[i - 1].end)"
    assert rows.where(f"size(spans) > 1 and not {apart}").count() == 0
    assert rows.where("aggregate(spans, 0L, (n, s) -> n + s.end - s.start) <> n_hit").count() == 0
    out = rows.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated")
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_every_shared_window_is_found(spark):
    rng = random.Random(10)
    vocabulary = ["the", "of", "Maß", "été", "x1", "2024", "naïve", "a", "b", "ÉCOLE"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 30)))) for k in range(25)]
    items += [(30, "one two three"), (31, "Only"), (32, "five words make this item"), (33, "a b"), (34, "seven small words are in this item"),
              (35, None), (36, " .,- "), (None, "no id but ten words or more in this very item here"), (3, "second text of item three goes on for ten words at least"),
              (40, items[0][1]), (41, " ".join(["rep"] * 14))]
    docs = []
    for k in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)[1] or ""
        words = item.split()
        a = rng.randint(0, max(0, len(words) - 10))
        docs.append((k, "; ".join(body[:20] + [w.upper() if w.isascii() else w for w in words[a : a + rng.choice([9, 10, 11, 20])]] + body[20:])))
    docs += [(100, None), (101, ""), (102, "..."), (103, items[0][1]), (103, items[0][1]), (None, items[1][1]), (104, "only"), (105, "rep " * 30)]
    docs += [(200 + k, docs[5][1]) for k in range(30)]  # copies of one text
    docs += [(300, "filler words go here " * 15_000 + items[2][1] + " " + "x" * 300_000 + " one two three")]
    assert got_hits(spark, docs, items) == plain_hits(docs, items)
    long_only = [i for i in items if len(plain_words(i[1])) >= 10]
    assert got_hits(spark, docs, long_only) == plain_hits(docs, long_only)


def test_empty_sides(spark):
    docs, items = [(1, "a b c"), (2, None)], [(1, "a b")]
    assert got_hits(spark, [], items) == []
    assert got_hits(spark, docs, []) == plain_hits(docs, [])
    assert got_hits(spark, docs, [(1, None), (2, "")]) == plain_hits(docs, [])


def test_words_and_hashes_of_many_texts():
    rng = random.Random(11)
    parts = ["Word", "été", "Ünï", "漢字", "😀", "\x7f", " ", "-", "x", "9", "Z_z", "\n", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "q" * (D.BLOCK + 5) + " q"]
    t = D.Texts(texts)
    values = t.hashes()
    by_word = {}
    for i, text in enumerate(texts):
        words = plain_words(text)
        assert t.n_words[i] == len(words) and (not words or t.text_of(i, 0, len(words)) == " ".join(words))
        for k, w in enumerate(words):
            by_word.setdefault(w, set()).add(int(values[t.first_word[i] + k]))
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)


def test_winnowing_guarantee():
    rng = np.random.default_rng(12)
    for k, w in ((5, 6), (5, 1), (2, 1), (3, 4)):
        words = rng.integers(0, 4, 400).astype(np.uint64)
        owner = np.repeat([0, 1, 2], [150, 3, 247])
        t = D.Texts(["x"])
        kept = set(D.winnowed(owner, t.grams(words, k), k, w).tolist())
        for i in range(400 - w - k + 2):
            if owner[i] == owner[i + w + k - 2]:
                assert kept & set(range(i, i + w))
        assert all(owner[p] == owner[p + k - 1] for p in kept)

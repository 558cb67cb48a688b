"""Search, fingerprints, mixing, chat, packing and near copies: brute force and edge rows."""

import collections
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.llm import ann, chat, fingerprint, mixing, neardup, packing
from shiftlens.llm.components import connected_components
from shiftlens.llm.shared import vocabulary_path

DOC = "doc_id long, text string"


def pick(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


# ---------------------------------------------------------------- search


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True) * rng.choice([1.0, 0.7], (600, 1))
    x[7] = x[8]
    rows = [(i, [float(c) for c in v], "z") for i, v in enumerate(x)]
    odd = [(1000, None, "z"), (1001, [0.0] * 24, "z"), (1002, [float("nan")] * 24, "z"), (1003, [float("inf")] + [0.0] * 23, "z"),
           (1004, [1.0, None] + [0.0] * 22, "z"), (1005, [1.0], "z"), (None, rows[0][1], "z"), rows[3], (1006, [], "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    params = ann.AnnParams(k=5)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, params=params).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [f[2] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(f[1] - s[f[0]]) < 1e-12 for f in found)
        assert [f[:1] for f in found] == [f[:1] for f in sorted(found, key=lambda f: (-f[1], f[0]))]
        hits += len({f[0] for f in found} & set(want))
    assert hits / (5 * len(got)) >= 0.9


def test_equal_vectors_come_in_order_of_their_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1050] = x[0]  # 50 copies, dealt over the blocks
    x[1500:1515] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert [i for i, _ in got[0]] == list(range(1000, 1020)) and len({s for _, s in got[0]}) == 1
    assert [i for i, _ in got[1040]] == [0, *range(1000, 1019)]
    assert [i for i, _ in got[20]][:15] == list(range(1500, 1515))
    hits = sum(len({i for i, _ in got[q]} & set(np.lexsort((np.arange(2000), -np.where(np.arange(2000) == q, -9, x @ x[q])))[:20].tolist())) for q in range(100, 1000, 20))
    assert hits / (20 * 45) >= 0.9


def test_neighbours_of_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def by_definition(ids, x, queries, params):
    """Every query's best candidates: rows in a bucket it looks up, each rotation done step by step."""
    width = 1 << int(np.ceil(np.log2(x.shape[1] + 1)))
    longest = np.sqrt((x * x).sum(axis=1)).max()

    def turned(v, flips, axes):
        for f in flips:
            v = ann.hadamard(v * f)
        return np.concatenate([v[:, :axes], -v[:, :axes]], axis=1)

    wide = np.zeros((len(x), width))
    wide[:, : x.shape[1]] = x
    asked = wide[queries]
    wide[:, x.shape[1]] = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    axes = [min(a, width) for a in params.axes]
    near = np.zeros((len(queries), len(x)), dtype=bool)
    for flips in ann.signs(params, width):
        first, second = (turned(wide, f, a).argmax(axis=1) for f, a in zip(flips, axes))
        both = np.add(turned(asked, flips[0], axes[0])[:, :, None], turned(asked, flips[1], axes[1])[:, None, :])
        flat = both.reshape(len(queries), -1)
        near |= both[:, first, second] >= np.sort(flat, axis=1)[:, -min(params.probes, flat.shape[1]), None]
    out = {}
    for q, found in zip(queries, near):
        found[q] = False
        score = (x * x[q]).sum(axis=1)
        best = sorted(np.flatnonzero(found), key=lambda i: (-score[i], ids[i]))[: params.k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in best]
    return out


@pytest.mark.parametrize("probes", [2, 64])
def test_neighbours_are_the_best_of_the_buckets_looked_up(spark, probes):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:360] = x[0]  # equal ones, more than k
    x[400:800] = x[20] + 1e-7 * rng.normal(size=(400, 24))  # closer than single precision tells apart
    x[1200:] *= rng.lognormal(0, 1, (1200, 1))
    x[2000] *= 1e4
    ids = rng.permutation(4800)[:2400]
    params = ann.AnnParams(probes=probes)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, params=params).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {q: best for q, best in by_definition(ids, x, np.flatnonzero(ids % 20 == 0), params).items() if best}


def test_neighbours_cost_little_more_than_all_products():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = x[:512]
    began = time.process_time()
    plain = np.argpartition(-(queries @ x.T), 20, axis=1)[:, :20]
    between = time.process_time()
    hashes = ann.Hashes(64, ann.AnnParams())
    index = ann.BlockIndex(np.arange(20_000), x, 1.0, hashes)
    found = list(index.search(np.arange(512), queries, hashes.least(queries)))
    took = time.process_time() - between
    assert len(plain) == len(found) == 512 and all(len(i) == 20 for i, _ in found)
    assert took < 15 * (between - began)  # 2 to 4 times; 54 when each bucket was gone through


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    h = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(h, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(ann.hadamard(h), x)


# ---------------------------------------------------------------- fingerprints


def paragraphs(text, words=32):
    return collections.Counter(re.findall(r"\S+(?:[^\S\n]+\S+){0,%d}" % (words - 1), text))


def alike(a, b):
    n = sum(a.values()) + sum(b.values())
    return 1.0 if not n else 1 - (sum((a - b).values()) + sum((b - a).values())) / n


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(3)
    texts = {i: "\n".join(pick(rng, WORDS, rng.randint(1, 50)) for _ in range(rng.choice([1, 3, 12, 60]))) for i in range(0, 40, 2)}
    texts |= {100: None, 102: "", 104: "x", 106: "same line\n" * 400, 108: texts[4], 109: texts[4]}
    rows = [(i, t, "f") for i, t in texts.items()]
    got = {r.doc_id: r for r in fingerprint.compare_versions(
        spark.createDataFrame(rows, DOC + ", fingerprint string")).collect()}
    ids = sorted(texts, reverse=True)
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[i]
        assert r.edited == edited and r.to_edited.ok and r.to_next.ok
        assert r.near_edited == pytest.approx(alike(paragraphs(text), paragraphs(edited)))
        assert r.near_next == pytest.approx(alike(paragraphs(text), paragraphs(after)))
    assert got[108].fingerprint == got[109].fingerprint == got[4].fingerprint
    assert got[108].fingerprint != got[106].fingerprint


def test_cuts_by_content_move_with_the_text(spark):
    rng = random.Random(4)
    short = [pick(rng, WORDS, 30) for _ in range(20)]
    long = " ".join(pick(rng, WORDS, 1) for _ in range(400))
    params = fingerprint.SketchParams(cut=4)
    rows = [(i, t) for i, t in enumerate(short)] + [(100, long), (99, "put " + long)]
    got = {r.doc_id: r for r in fingerprint.compare_versions(spark.createDataFrame(rows, DOC), params).collect()}
    assert np.mean([got[i].near_edited for i in range(20)]) > 0.4 and sum(got[i].near_edited == 0 for i in range(20)) <= 1
    assert got[100].near_next > 0.9
    for text in (short[0], long, "same\n\n \tline  \n" * 5, "", None):
        found = spark.createDataFrame([(text,)], "text string").select(fingerprint.paragraphs(F.col("text"), params)).first()[0]
        assert " ".join(found).split() == (text or "").split() and all(len(p.split()) <= 32 for p in found)
    assert len(spark.createDataFrame([(long,)], "t string").select(fingerprint.paragraphs(F.col("t"), params)).first()[0]) > 60


def test_peeling_recovers_the_digests(spark):
    params = fingerprint.SketchParams()
    a, b = list(range(1, 700)), list(range(300, 720))
    df = spark.createDataFrame([(a, b), ([], [5]), ([], [])], "own array<long>, other array<long>")
    for n in ("own", "other"):
        df = df.withColumn(f"{n}_sketch", fingerprint.sketch(F.col(n), params.width, 0))
    rows = fingerprint.with_difference(df, "d", "own", "other", params).select("d").collect()
    for r, (left, right) in zip(rows, [(a, b), ([], [5]), ([], [])]):
        assert r.d.ok
        assert sorted(r.d.left) == sorted(set(left) - set(right)) and sorted(r.d.right) == sorted(set(right) - set(left))


def test_difference_is_exact_where_peeling_sticks(spark):
    params = fingerprint.SketchParams(retries=0)
    df = spark.createDataFrame([(list(range(300)), list(range(200, 450)))], "own array<long>, other array<long>")
    for n in ("own", "other"):
        df = df.withColumn(f"{n}_sketch", fingerprint.sketch(F.col(n), params.width, 0))
    d = fingerprint.with_difference(df, "d", "own", "other", params).first().d
    assert not d.ok and sorted(d.left) == list(range(200)) and sorted(d.right) == list(range(300, 450))


def test_fingerprint_edge_tables(spark):
    one = fingerprint.compare_versions(spark.createDataFrame([(5, "abc")], DOC)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited == "aba"
    assert fingerprint.compare_versions(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "n1"), (None, "n2"), (3, "c"), (3, "b"), (3, "b"), (9, "z")]
    got = fingerprint.with_next(spark.createDataFrame(rows, DOC), "text").collect()
    assert sorted((r.doc_id or -1, r.text, r.next_text) for r in got) == [
        (-1, "n1", "n2"), (-1, "n2", "z"), (3, "b", "b"), (3, "b", "c"), (3, "c", "n1"), (9, "z", "b")]


def test_next_over_many_ranges(spark, monkeypatch):
    ids = list(range(0, 3000, 3)) + [10**12, -5]
    random.Random(1).shuffle(ids)
    monkeypatch.setattr(fingerprint.range_bounds, "__defaults__", (7,))
    df = spark.createDataFrame([(i, str(i)) for i in ids], DOC)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, "text").collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: str(b) for a, b in zip(order, order[1:] + order[:1])}


# ---------------------------------------------------------------- mixing


def test_raking_meets_the_margins(spark):
    rng = random.Random(6)
    rows = [(i, pick(rng, WORDS, rng.randint(5, 60)), rng.choice(["a", "b", "c", None]), rng.choice(["en", "de"]), rng.choice(["x", "y"]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {m: spark.createDataFrame(v, "value string, target double") for m, v in
               {"source": [("a", 1.0), ("b", 1.0), ("c", 1.0), ("(none)", 1.0), ("never", 9.0)],
                "lang": [("en", 0.2), ("de", 0.8)], "topic": [("x", 3.0), ("y", 1.0)]}.items()}
    params = mixing.MixParams(rate=0.3)
    got = mixing.mix(df, params, targets).collect()
    assert len(got) == 400 and {len(r.text.split()) == r._tokens for r in got} == {True}
    total = sum(r._tokens for r in got)

    def share(column, value):
        return sum(r._tokens * r._weight for r in got if r[column] == value) / total

    assert share("_source", "(none)") == pytest.approx(0.25, abs=1e-4) and share("_lang", "de") == pytest.approx(0.8, abs=1e-4)
    assert share("_topic", "x") == pytest.approx(0.75, abs=1e-4)
    # The same with plain loops.
    cells = collections.Counter()
    for r in got:
        cells[r._source, r._lang, r._topic] += r._tokens
    w = dict(cells)
    goal = [{"a": 0.25, "b": 0.25, "c": 0.25, "(none)": 0.25}, {"en": 0.2, "de": 0.8}, {"x": 0.75, "y": 0.25}]
    for _ in range(20):
        for k in range(3):
            for value, want in goal[k].items():
                have = sum(x for c, x in w.items() if c[k] == value)
                for c in w:
                    if c[k] == value:
                        w[c] *= want * total / have
    for r in got:
        c = (r._source, r._lang, r._topic)
        assert r._weight == pytest.approx(w[c] / cells[c], rel=1e-3)
    assert sum(r._probability * r._tokens for r in got) == pytest.approx(0.3 * total, rel=1e-6)
    assert 0.2 * total < sum(r._tokens for r in got if r._kept) < 0.4 * total


def test_mixing_edge_tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(None, "a b", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, "x y", "en", "s"), (3, "x y", "en", "s")]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5
    assert len({r._kept for r in got if r.doc_id == 3}) == 1
    assert all(r._kept for r in got if r.doc_id == 1)  # a cell without tokens
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0


# ---------------------------------------------------------------- chat


def test_round_trip_of_awkward_turns(spark):
    rng = random.Random(7)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "[\\INST]", "<\\\\/s>", "[", "<", "]", "\\", "\n", "a", "é", "INST]", "s>", "\\n", "\x00", ""]
    roles = ["user", "assistant", "system", "", "we\nird", "a\\nb", "[INST]", "assistant\n", None]
    said = []
    for conv in range(150):
        for turn in range(rng.randint(1, 5)):
            text = rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))])
            said.append((conv, turn, rng.choice(roles), text, "f"))
    said += [said[0], (None, 1, "user", "q", "f"), (200, None, None, None, "f")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chats(df).collect()
    want = collections.defaultdict(list)
    for conv, turn, role, text, _ in said:
        want[conv].append((turn if turn is not None else -1, role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert r.level >= 0
        assert [(t.role, t.text) for t in r.turns] == [w[1:] for w in sorted(want[r.conv_id])]
        assert [t.learned for t in r.turns] == [t.role == "assistant" for t in r.turns]
    assert {r.level for r in got} == {0, 1, 2}
    digest = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    for conv, turns in want.items():
        turns = sorted(turns)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        d = digest[conv]
        assert (d.n_turns, d.loss_chars) == (len(turns), len(loss))
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def test_every_token_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(8)
    texts = {i: pick(rng, WORDS, rng.choice([1, 20, 300, 3000])) for i in range(80)}
    texts |= {200: None, 201: "", 202: " ", 203: "a  b\t\n\nc ", 204: "it's 12 o'clock\nI'll <|endoftext|>", 205: "\n", 206: "x \ny"}
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()] + [(200, None, 5), (None, "no id", 5)], DOC + ", offset int")
    params = packing.PackParams(open_windows=4, merged_partitions=2)
    pieces = packing.pack(df.repartition(5), path, params).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in texts.items():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(by_doc[i], key=lambda p: p.start)
        if i == 200:
            assert [(p.start, p.length) for p in got] == [(0, 1), (0, 1)]
            continue
        assert [p.start for p in got] == list(itertools.accumulate([0] + [p.length for p in got][:-1]))
        assert b"".join(bytes(p.ids) for p in got) == np.array(ids, "<u4").tobytes()
        assert {p.doc_tokens for p in got} == {len(ids)}
    padding = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(itertools.accumulate([0] + [p.length for p in own][:-1]))
        used = sum(p.length for p in own)
        assert used <= 1024
        total += used
        padding += 0 if used & (used - 1) == 0 else 1024 - used
    assert padding < 0.02 * total
    assert packing.pack(df.limit(0), path).count() == 0


def test_ids_of_words_are_those_of_the_whole_text():
    tokens = packing.CachedTokenizer(vocabulary_path("byte_bpe_50k.json"), most=400)
    rng = random.Random(9)
    parts = ["a", "b", "word", "\xa0", "\t", " ", "  ", "\n", "\n\n", "\u3000", "\x1f", "\x1c", "\x85", "'s", "don't", ".", "!?", "12", "\u00e9",
             "\u00df", "\u6f22", "<|endoftext|>", "</s>", "\r\n", "\u2009", " \n", "x\ny", "[INST]", "-", "_", "\u0120", "\u010a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(30_000)]
    texts += ["a\n\xa0\nb\xa0c", "q" * 3_000_000 + " q", "w " * 50_000 + "end", None, ""]
    got = [ids for _, some in packing.chunked(texts, texts, 20_000, 300) for ids in tokens.many(some)]
    assert got == [ids + packing.END for ids in tokens.whole([t or "" for t in texts])]


def test_a_word_is_learnt_once_whatever_mark_follows():
    marks = [chr(k) for k in range(33, 127) if not chr(k).isalnum()]
    tokens = packing.CachedTokenizer(vocabulary_path("byte_bpe_50k.json"))
    texts = [f"so {word}{mark} then {word}{mark}{word}{mark}{mark}{end}" for word in ("wordy", "caf\u00e9", "x2", "don't")
             for mark in marks for end in ("", "s", "9", " s", "\u00e9")]
    assert tokens.many(texts) == [ids + packing.END for ids in tokens.whole(texts)]
    tokens.forget()
    tokens.many([f"wordy{mark} wordy{mark}" for mark in marks])
    assert len(tokens.known) <= 2 + len(marks)  # with each mark: over twice as many


def test_white_space_in_bytes():
    rng = random.Random(5)
    odd = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    others = "a \n\u00c2\u0085\u00e2\u180e\u200b\u2010\u20a0\u2060\u3001\uff00\U0001f600"
    for _ in range(200):
        text = "".join(rng.choice(rng.choice([odd, others])) for _ in range(rng.randint(1, 30)))
        data = np.frombuffer(text.encode(), np.uint8)
        want = [len(text[:k].encode()) for k, c in enumerate(text) if c in odd]
        assert sorted(packing.odd_places(data, packing.KIND[data]).tolist()) == want
    keys = np.array([7, 5, 7, 1 << 63, 5], np.uint64)
    distinct, example, which = packing.told_apart(keys)
    assert distinct[which].tolist() == keys.tolist() and example.tolist() == [0, 1, 3]


def test_best_fit_and_fullest():
    packer = packing.Packer(packing.PackParams(capacity=16, open_windows=2, least_cut=3))
    ids = lambda n: b"\x01\x00\x00\x00" * n
    assert packer.add(1, ids(10)) == [] and packer.add(2, ids(13)) == []
    (w,) = packer.add(3, ids(3))  # fits best into the window with 3 free
    assert (w[0], [p[0] for p in w[2]]) == (1, [2, 3])
    assert packer.add(4, ids(12)) == []
    (w,) = packer.add(5, ids(9))  # fits none: tops up the fullest, the rest opens a window
    assert [(p[0], p[1], p[2]) for p in w[2]] == [(4, 0, 12), (5, 0, 4)]
    assert [(p[0], p[1], p[2], p[5]) for w in packer.leftovers() for p in w[2]] == [(1, 0, 10, 0), (5, 4, 5, 0)]
    assert packing.lengths_of(1024 * 2 + 11, 1024) == [1024, 1024, 8, 2, 1]


# ---------------------------------------------------------------- near copies


def brute_components(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    low = {i: i for i in texts}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize(("words", "percent", "bands", "rows"), [(3, 85, 36, 7), (5, 80, 40, 6)])
def test_near_copies_against_brute_force(spark, words, percent, bands, rows):
    rng = random.Random(9)
    texts = {}
    for i in range(60):
        texts[i] = pick(rng, WORDS, rng.choice([1, 2, 4, 30, 200, 600]))
    base = pick(rng, WORDS, 300).split()
    for i in range(100, 190):  # a family whose members differ from each other more than from the base
        w = list(base)
        for _ in range(rng.randint(0, 16)):
            w[rng.randrange(300)] = rng.choice(WORDS)
        texts[i] = " ".join(w)
    passage = pick(rng, WORDS, 70)
    for i in range(200, 260):  # a shared passage that is most of the text
        texts[i] = pick(rng, WORDS, rng.randint(3, 40)) + " " + passage
    chain = pick(rng, WORDS, 150).split()
    for i in range(300, 330):  # each is near the one before
        chain = chain[2:] + [rng.choice(WORDS), rng.choice(WORDS)]
        texts[i] = " ".join(chain)
    texts |= {400: texts[3], 401: (texts[5] or "").upper(), 402: None, 403: "", 404: " \n", 405: texts[3]}
    params = neardup.NearParams(words, percent, bands, rows, block=16)
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], DOC + ", component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, params).collect()}
    assert got == brute_components(texts, words, percent)


def test_near_copy_edge_rows(spark):
    rows = [(None, "a b c d e f g"), (None, None), (1, "a b c d e f g"), (2, "A b c d e f g"), (2, "x"), (3, None), (3, None), (4, "q")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1)
                 for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(-1, 0, -1), (-1, 3, -1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 1, 4)]
    assert neardup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_sketch_estimates_likeness():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    for n in (5, 40, 900):
        x, y = np.unique(a[:n]), np.unique(np.r_[a[: n * 4 // 5], rng.integers(0, 1 << 62, n // 5).astype(np.uint64)])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        same = (neardup.sketch(x, 2000) == neardup.sketch(y, 2000)).mean()
        assert abs(same - true) < 0.06


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(500, 560)] + [(7, 9), (9, 7), (9, 9), (8, 9)]
    rng.shuffle(links)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 1 for k in range(500, 560)} | {1: 1, 7: 7, 8: 7, 9: 7}
    assert got == want


def test_a_cell_compares_the_place_of_its_own_row_only(spark):
    import re

    from pyspark.sql import functions as F

    cells = fingerprint.sketch(F.col("own"), 8, 1)
    peeled = fingerprint.peel(F.col("cells"), 8, 1, 3)
    for column in (cells, peeled):
        assert not re.search(r"p0.{0,80}\bOR\b.{0,80}p1", column._jc.toString(), re.S | re.I)
    df = spark.createDataFrame([([11, 12, 13, -5],), ([],)], "own array<long>")
    for r in df.select("own", cells.alias("cells")).collect():
        for j in range(fingerprint.ROWS):
            assert sum(c.n for c in r.cells[8 * j : 8 * j + 8]) == len(r.own)
            key = 0
            for c in r.cells[8 * j : 8 * j + 8]:
                key ^= c.key
            want = 0
            for h in r.own:
                want ^= h
            assert key == want


def test_cells_in_use_are_those_of_the_whole_sketch(spark):
    rng = random.Random(8)
    some = lambda n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    pairs = [([], []), ([1], [1]), ([1], [2])]
    for n in range(1, 14):
        both = some(rng.randint(0, 20))
        pairs.append((both + some(n), both + some(rng.randint(0, n))))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, own array<long>, other array<long>")
    entries = F.concat(fingerprint.entries_of(F.col("own"), 8, 1, 1), fingerprint.entries_of(F.col("other"), 8, 1, -1))
    dense = fingerprint.subtract(fingerprint.sketch(F.col("own"), 8, 1), fingerprint.sketch(F.col("other"), 8, 1))
    start = fingerprint.unpeeled(fingerprint.filled_rows(entries))
    rows = df.select("k", "own", "other", dense.alias("cells"), start.alias("start"))
    rows = rows.withColumn("of_start", fingerprint.peeled(F.col("start"), 8, 1, 12))
    rows = rows.withColumn("of_cells", fingerprint.peel(F.col("cells"), 8, 1, 12))
    rows = rows.withColumn("tried", fingerprint.shard_difference(F.col("own"), F.col("other"), fingerprint.SketchParams()))
    peels = 0
    for r in rows.collect():
        used = {(i, *c) for i, c in enumerate(r.cells) if c.n or c.key}
        assert used == {tuple(c) for row in (r.start.c0, r.start.c1, r.start.c2) for c in row}
        assert r.of_start.ok == r.of_cells.ok and sorted(r.of_start.left) == sorted(r.of_cells.left)
        assert r.tried.ok and set(r.tried.left) == set(r.own) - set(r.other) and set(r.tried.right) == set(r.other) - set(r.own)
        assert len(r.tried.left) == len(set(r.tried.left)) and len(r.tried.right) == len(set(r.tried.right))
        if r.of_start.ok:
            peels += 1
            assert set(r.of_start.left) == set(r.own) - set(r.other) and set(r.of_start.right) == set(r.other) - set(r.own)
    assert peels > 5


def test_a_shard_is_peeled_row_by_row(spark):
    rng = random.Random(11)
    some = lambda n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    pairs = [([], []), ([1], [1]), ([1], [2]), ([], [0]), ([3, 4, 5], [4])]
    for n in range(1, 14):
        both = some(rng.randint(0, 20))
        pairs.append((both + some(n), both + some(rng.randint(0, n))))
    pairs.append((some(200), []))  # 24 cells cannot give 200 digests away
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, own array<long>, other array<long>")
    dense = fingerprint.subtract(fingerprint.sketch(F.col("own"), 8, 1), fingerprint.sketch(F.col("other"), 8, 1))
    rows = df.withColumn("cells", dense).withColumn("of_cells", fingerprint.peel(F.col("cells"), 8, 1, 12))
    rows = rows.withColumn("by_rows", fingerprint.peeled_by_rows(F.col("own"), F.col("other"), 8, 1, 12))
    got = {r.k: r for r in rows.collect()}
    for k, (a, b) in enumerate(pairs):
        assert (got[k].by_rows is not None) == got[k].of_cells.ok
        if got[k].by_rows:
            assert sorted(got[k].by_rows.left) == sorted(set(a) - set(b))
            assert sorted(got[k].by_rows.right) == sorted(set(b) - set(a))
    assert got[len(pairs) - 1].by_rows is None and sum(r.by_rows is not None for r in got.values()) > 10


def test_digests_are_made_after_the_shuffle_of_the_texts(spark):
    df = spark.createDataFrame([(k, f"text {k} of some words") for k in range(20)], DOC)
    plan = fingerprint.compare_versions(df)._jdf.queryExecution().optimizedPlan().toString()
    shuffled = plan[plan.index("RepartitionByExpression"):]
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in shuffled

"""Periodic runs, packing and collocations against brute force; nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from skewlens.llm import collocations, packing, periodic_runs
from skewlens.llm.queries import WORD_PIECES, op11_periodic_runs, op12_packing, op13_collocations
from skewlens.llm.shingles import WordHashes

SCHEMA = "doc_id bigint, text string, lang string, source string, length bigint, runs string, piece string, rank string"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """(id, text, lang) rows with extra columns whose names clash with result columns."""
    return spark.createDataFrame([(*r, "s", 7, "x", "x", "x") for r in rows], SCHEMA)


def brute_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            long = j + q - i
            if j > i and long >= max(least, times * q) and not any(
                    q % d == 0 and all(w[x] == w[x + d] for x in range(i, i + long - d)) for d in range(1, q)):
                out.append((i, long, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    r = random.Random(5)
    for _ in range(400):
        w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(3)):
            at, p = r.randrange(len(w) + 1), r.randrange(1, 15)
            w[at:at] = w[at:at + p] * r.randrange(2, 6)
        least, times = r.choice([(24, 3), (6, 2), (3, 3), (10, 4)])
        want = brute_runs(w, least, times)
        assert periodic_runs.runs_of([x + 1 for x in w], least, times) == want
        assert periodic_runs.document_runs([b"%d" % x for x in w], WordHashes(), least, times) == want


def test_lce_of_all_pairs():
    r = random.Random(6)
    w = [r.randrange(1, 4) for _ in range(60)]
    tour = periodic_runs.Tour(periodic_runs.suffix_tree([*w, 0], 4), 61, 4)
    x, y = (np.array(v) for v in zip(*[(i, j) for i in range(61) for j in range(61) if i != j]))
    for i, j, got in zip(x.tolist(), y.tolist(), tour.lce(x, y).tolist()):
        n = 0
        while max(i, j) + n < 60 and w[i + n] == w[j + n]:
            n += 1
        assert got == n


@pytest.fixture(scope="module")
def odd_rows():
    loop = " ".join(f"w{i}" for i in range(9))
    return [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "a " * 24, "en"), (5, "a " * 23, "en"), (6, (loop + "\n") * 5, "de"),
            (6, (loop + "\n") * 5, "de"), (None, "x y z " * 9 + "x q", "en"), (8, " ".join(str(i % 701) for i in range(60_000)), "en"),
            (9, "A a. " * 40, None), (10, "ein Wort 日本語 Ünï " * 3, "de"), (11, "one", "en")]


def test_periodic_runs(spark, odd_rows):
    got = periodic_runs.periodic_runs(frame(spark, odd_rows)).collect()
    assert sorted(map(str, [r.doc_id for r in got])) == sorted(str(r[0]) for r in odd_rows)
    text = dict((r[0], r[1]) for r in odd_rows)
    for row in got:
        w = (text[row.doc_id] or "").split()
        runs = [tuple(x) for x in row.runs]
        assert row.n_words == len(w)
        if len(w) < 1000:
            assert runs == brute_runs(w)
        else:
            assert runs == [(0, 60_000, 701)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0


def looped_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_op11_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got, found = op11_periodic_runs(spark, SF).collect(), 0
    assert len(got) == len(docs)
    for r in got:
        w = looped_words(r.doc_id, docs[r.doc_id])
        if len(w) > 3000:
            continue                                    # the brute force takes the square of the length
        runs = brute_runs(w)
        found += len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert found > 10


@pytest.fixture(scope="module")
def model():
    with open(f"/opt/tokenizers/{WORD_PIECES}", encoding="utf-8") as f:
        return f.read()


def placed(rows, capacity=2048):
    """Gapless places, and the sequences in use."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(by)


def test_word_ids_are_those_of_the_whole_text(model):
    r = random.Random(3)
    signs = " \t\n\x0b\x0c\r\x1c\x85 　sSΣσİıſabé́̀日本1２<|endoftext|>!.,'\"(-"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += ["a <|endoftext|> b<|startoftext|>c it's don't, I'll.", "x" * 500, "word " * 10, "Über, ÑANDÚ!! (naïve) 12th.", "semi-colon;a.b a's! x!'s ...y <|ENDOFTEXT|> été, Été."]
    known, whole = packing.WordIds(model), Tokenizer.from_str(model)
    for text in texts:
        words = known.words(text.encode())
        known.learn(set(words))
        got = b"".join(map(known.__getitem__, words))
        assert got == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_op12_query(spark, model):
    whole = Tokenizer.from_str(model)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_packing(spark, SF).collect()
    want = {}
    for i, text in docs.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used, least = placed(rows), -(-sum(x[1] for x in want.values()) // 2048)
    assert least <= used <= least + 2


def test_packing_of_odd_rows(spark, odd_rows, model):
    pieces = packing.tokenised(frame(spark, odd_rows), model, capacity=50)
    packed = packing.pack(pieces, capacity=50)
    rows = packed.collect()
    assert len(rows) == pieces.count() and sum(r.length == 1 for r in rows if r.doc_id in (1, 2, 3)) == 3
    used = placed(rows, 50)
    whole = packing.sequences(packed).collect()
    assert len(whole) == used and all(len(r.ids) // 4 == sum(x.length for x in rows if x.sequence_id == r.sequence_id) for r in whole[:40])
    one = next(r for r in whole if len(r.starts) > 1)
    for r in rows:
        if r.sequence_id == one.sequence_id:
            assert bytes(one.ids[4 * r.offset:4 * (r.offset + r.length)]) == bytes(r.ids)
    assert packing.pack(packing.tokenised(frame(spark, []), model)).count() == 0


def test_best_two_fit():
    # Greedy leaves 5 of 20 free (9, 6); 6 gives way to 7 and 4, which fill it.
    assert packing.fillings({9: 1, 6: 1, 7: 1, 4: 1}, 20)[0][0] == {9: 1, 7: 1, 4: 1}
    r = random.Random(2)
    for _ in range(300):
        capacity = r.choice([5, 10, 30, 100])
        counts = {r.randrange(1, capacity + 1): r.randrange(1, 40) for _ in range(r.randrange(25))}
        plan, got = packing.fillings(counts, capacity), collections.Counter()
        for used, times in plan:
            assert sum(k * v for k, v in used.items()) <= capacity and times > 0
            got.update({k: v * times for k, v in used.items()})
        assert got == collections.Counter(counts)
    with pytest.raises(ValueError):
        packing.fillings({11: 1}, 10)


def test_hot_length_is_numbered_in_buckets(spark):
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 700L, 1 + id % 2048) as length", "7 as sequence")
    packed = packing.pack(rows).collect()
    assert len(packed) == 30_000 and len({r.id for r in packed}) == 30_000
    placed(packed)


def brute_counts(rows, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang, text = lang or "und", text or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute_collocations(rows, threshold, top=2000, share=100):
    f, n = brute_counts(rows)
    f = {k: v for k, v in f.items() if v >= threshold}
    out = collections.defaultdict(list)
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2 or any(y[0] == lang and len(y[1].split(" ")) > len(w) and f" {phrase} " in f" {y[1]} " and 100 * b >= share * a
                             for y, b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return {(lang, i + 1): (p.decode(), -a, one, two, n[lang], -s)
            for lang, rows in out.items() for i, (s, a, p, one, two) in enumerate(sorted(rows)[:top])}


@pytest.fixture(scope="module")
def phrase_rows(odd_rows):
    r = random.Random(9)
    usual = ["New York", "the", "of the", "big. red", "a b c d e f", "x\ty", "Ünï code", "été", "stop!", "go; on"]
    rows = [(100 + i, " ".join(r.choice(usual) for _ in range(r.randrange(60))), r.choice(["en", "de", None])) for i in range(60)]
    return odd_rows + rows


def test_collocations(spark, phrase_rows):
    rows = [r for r in phrase_rows if r[0] != 8]
    for threshold, top, sizes in ((8, 2000, {}), (8, 5, {"mass": 300}), (20, 2000, {"mass": 300, "map_bytes": 1 << 12})):
        got = collocations.collocations(frame(spark, rows), threshold=threshold, top=top, **sizes).collect()
        want = brute_collocations(rows, threshold, top)
        assert {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want and len(got) == len(want)
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_every_frequent_phrase_survives(spark):
    r = random.Random(4)
    truth, summary, capacity = collections.Counter(), (np.empty(0, np.uint32), np.empty(0, np.int64), 0), 40
    for _ in range(50):
        part = collections.Counter(int(r.paretovariate(0.6)) % 5000 for _ in range(200))
        truth.update(part)
        keys = np.array(sorted(part), np.uint32)
        summary = collocations.merged(summary, keys, np.array([part[int(k)] for k in keys]), capacity)
        assert len(summary[0]) <= capacity
    kept, taken = dict(zip(summary[0].tolist(), summary[1].tolist())), summary[2]
    assert taken <= sum(truth.values()) / (capacity + 1)
    for k, n in truth.items():
        assert kept.get(k, 0) <= n <= kept.get(k, 0) + taken


def test_phrases_are_told_apart_by_both_hashes():
    for one, two in (([3, 1, 3, 1, 3], [1, 2, 1, 2, 1]), ([3, 1, 3, 1, 3], [1, 2, 1, 3, 1]), ([7], [7])):
        first, n = collocations._groups(np.array(one, np.uint64), np.array(two, np.uint64))
        got = {(one[i], two[i]): count for i, count in zip(first.tolist(), n.tolist())}
        assert got == collections.Counter(zip(one, two)) and len(got) == len(first)


def test_summaries_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2 ** 32, 1000, dtype=np.uint32))
    assert (collocations._unpack(collocations._pack(keys)) == keys).all()


def test_scores_beyond_64_bits(spark):
    """Counts as large as a corpus of 100 TB has: the score's products pass 64 bits and stay exact."""
    a, n, l, r = 999_999_999_989, 99_999_999_999_971, 1_234_567_890_123, 1_999_999_999_993
    df = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    assert df.select(collocations.score("a", "n", "l", "r").alias("s")).first().s == 1000 * a * n // (l * r)


def test_op13_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = op13_collocations(spark, SF).collect()
    assert {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute_collocations(rows, 100)

"""Substring dedup, SimHash, components and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from xylem.llm import decontaminate as dc
from xylem.llm.common import span_hashes, span_ids, string_buffers, word_bounds
from xylem.llm.components import components
from xylem.llm.jaccard import folded, may_be_similar, one_of_each, parity, similar_documents
from xylem.llm.rlz import Reference, Windows, factorise, substring_dedup
from xylem.llm.simhash import forest, hamming_links, near_duplicates


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")


def cut(rows, k):
    """Brute force of substring dedup."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - k + 1):
                g = tuple(w[p : p + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def test_substrings(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, "  ".join(rng.choices("a b c".split(), k=rng.randint(0, 9)) + passage[(s := rng.randint(0, 20)) : s + rng.randint(0, 20)] + rng.choices("d e\nf".split(), k=3))) for i in range(60)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[3][1]), (61, None), (62, ""), (63, " \n"), (64, rows[0][1]), (65, "é " * 30), (66, "é " * 30)]
    df = frame(spark, rows)
    for k in (4, 13):
        out = substring_dedup(df, window=k)
        assert out.columns == ["doc_id", "text", "source", "kept_text", "n_words", "n_removed", "factors"]
        got = out.collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == cut(rows, k)
        text = {i: (t or "").split() for i, t in rows if i != 7}
        for r in got:
            for f in r.factors:
                assert f.length >= k
                if f.source_id != 7 and r.doc_id != 7:
                    assert text[r.doc_id][f.start : f.start + f.length] == text[f.source_id][f.source_start : f.source_start + f.length]
    assert substring_dedup(df.filter("doc_id < 0")).count() == 0


def thue_morse(order):
    """A word of ``2 ** order`` letters and its complement: one value for many a rolling hash."""
    t = "a"
    for _ in range(order):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("order", [10, 11])
def test_substrings_of_twin_words(spark, order):
    x, y = thue_morse(order)
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {y}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_factors_compare_words():
    """Windows that share a hash are told apart by their words, and the next of the index is tried."""
    def windows(*rows):
        raw, offsets = string_buffers(pa.array(rows))
        return Windows(raw, offsets, 3)

    w = windows("a b c d e")
    w.hashes[:] = 7
    parts = ["x y z", "a b c", "c d e f"]
    ref = Reference(np.array([1, 2, 3]), np.array([5, 6, 7]), np.array([len(p) for p in parts]), np.frombuffer("".join(parts).encode(), np.uint8), 3)
    ref.keys[:] = 7
    ref.w.hashes[:] = 7
    ref.order = np.lexsort((ref.place[ref.w.row], ref.doc[ref.w.row], ref.w.hashes))
    assert factorise(w, np.array([9]), ref).tolist() == [[0, 0, 3, 1, 0], [0, 2, 3, 2, 0]]
    assert factorise(w, np.array([3]), ref).tolist() == [[0, 0, 3, 1, 0]]


def test_span_ids_tell_bytes_apart():
    raw, offsets = string_buffers(pa.array(["one two one three threefold threefolk threefold"]))
    starts, ends, _ = word_bounds(raw, offsets)
    ids = span_ids(raw, starts, ends, np.where(ends - starts > 8, np.uint64(5), span_hashes(raw, starts, ends))).tolist()
    assert [[ids[i] == ids[j] for j in range(7)] for i in range(7)] == [[a == b for b in (0, 1, 0, 2, 3, 4, 3)] for a in (0, 1, 0, 2, 3, 4, 3)]
    x, y = thue_morse(10)
    raw, offsets = string_buffers(pa.array([x, y, x, x[:64], y[:64], x[:63]]))
    h = span_hashes(raw, offsets[:-1], offsets[1:])
    assert len(set(h.tolist())) == 5 and h[0] == h[2]


def fingerprint(t, size=3):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(100 + i, " ".join(base[: 250 + i] + ([rng.choice("xyz")] if i % 3 else []))) for i in range(40)]
    rows += [(i, t) for i, t in enumerate([None, "", " ", "One", "ONE", "two words", "a b c d", "a b c d", "É e", "é e"])]
    got = {r.doc_id: r for r in near_duplicates(frame(spark, [*rows, (None, "q")])).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    assert all(got[i].fp & (1 << 64) - 1 == fps[i] for i in fps)
    ids = sorted(fps)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = smallest(ids, links)
    assert {i: got[i].component_id for i in ids} == want
    assert len(set(want.values())) < len(set(fps.values()))
    assert got[None].component_id is None


@pytest.mark.parametrize("chunk", [4, 2048])
def test_links_of_hot_keys(spark, chunk):
    """A dense group of fingerprints: chunks keep every component."""
    rng = random.Random(5)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 120:
        x = center
        for b in rng.sample(range(64), rng.randint(1, 7)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = hamming_links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long"), 3, chunk)
    links = [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    got = [(r.a, r.b) for r in edges.collect()]
    assert smallest(range(len(fps)), got) == smallest(range(len(fps)), links)


def test_forest():
    assert forest(np.array([[0], [1], [255]], np.uint64), 1) == [(0, 1)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    good = [(a, b) for a, b in edges if a is not None and a != b]
    want = smallest({x for e in good for x in e}, good)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.filter("a > 1000")).count() == 0


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_by_one_task_or_in_rounds(spark, one_task):
    rng = random.Random(8)
    chain = [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(60)]
    star = [(-5, -i) for i in range(10, 30)]
    edges = chain + star + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)] + [(-(1 << 63), (1 << 63) - 1)]
    df = spark.createDataFrame([*edges, *edges[:9], (None, 1), (4, 4)], "a long, b long").repartition(7)
    good = [e for e in edges if e[0] != e[1]]
    assert {r.node: r.component for r in components(df, one_task=one_task).collect()} == smallest({x for e in good for x in e}, good)
    assert components(df.filter("a is null"), one_task=one_task).count() == 0


def test_few_links_take_few_jobs(spark):
    """The driver's memory goes by the jobs it plans: small components must not take rounds of them."""
    words = [f"w{i}" for i in range(40)]
    df = frame(spark, [(i, " ".join([*words, *[f"x{k}" for k in range(i)]])) for i in range(12)])
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert {r.component_id for r in similar_documents(df).collect()} == {0}
    assert jobs() - before < 120, jobs() - before


def test_similar_documents(spark):
    rng = random.Random(7)
    text = [rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(400)]
    near = list(text)
    near[100] = "changed"
    far = [w if rng.random() < 0.5 else "z" + w for w in text]
    rows = [(5, " ".join(text)), (2, " ".join(near)), (3, " ".join(far)), (9, " ".join(text).upper()), (10, "x"), (11, None), (12, "")]
    got = {r.doc_id: r.component_id for r in similar_documents(frame(spark, rows)).collect()}
    assert got == {5: 2, 2: 2, 3: 3, 9: 2, 10: 10, 11: 11, 12: 11}


def shingles(t, size=5):
    w = t.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


@pytest.mark.parametrize("chunk", [3, 2048])
def test_similar_documents_finds_every_pair(spark, chunk):
    """Brute force: short texts, similarities about 0.8, and a key that many texts hold."""
    rng = random.Random(11)
    texts = []
    for n in [*range(8, 21)] * 4 + [104, 104, 300]:
        base = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
        texts.append(base)
        for same in (0.8, 0.85, 0.9):
            s = n - 4
            k = s - max(1, int(s * (1 - same)))  # shingles kept at the front
            texts.append(base[: k + 4] + [f"x{rng.randint(0, 9999)}" for _ in range(rng.randint(0, s - k))])
    hot = [f"h{i}" for i in range(12)]
    texts += [hot + [f"y{i % 5}", f"z{i}"][: 1 + i % 2] for i in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if alike(sets[a], sets[b])]
    assert len(links) > 150
    got = {r.doc_id: r.component_id for r in similar_documents(frame(spark, rows), chunk=chunk).collect()}
    assert got == smallest(range(len(sets)), links)


def test_similar_documents_keeps_what_is_below(spark):
    """Distinct templates of 10 to 12 words with another end word: 0.71 to 0.78 are no duplicates."""
    rng = random.Random(13)
    rows = []
    for n in [10, 11, 12] * 20:
        base = [f"t{rng.randint(0, 99999)}" for _ in range(n)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-1], "other"]))]
    got = {r.doc_id: r.component_id for r in similar_documents(frame(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows}


def test_parities_lose_nothing():
    rng = np.random.default_rng(12)
    for n, m, k in [(0, 0, 0), (1, 1, 0), (300, 300, 250), (255, 520, 200), (2000, 90, 90)]:
        h = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        x, y = h[:n], np.concatenate([h[:k], h[n : n + m - k]])
        alike = len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y)))
        for size in (64, min(len(parity(x)), len(parity(y)))):
            p, q = (folded(parity(s), size)[None] for s in (x, y))
            assert may_be_similar(p, q, np.array([len(x) + len(y)]), alike)[0]


def test_one_of_each_loses_no_text(spark):
    long = " ".join(f"w{i}" for i in range(30))
    x, y = thue_morse(10)
    rows = [(3, long), (7, long), (7, "another text of some words here"), (9, "same row"), (9, "same row"), (8, f"a b c d {x}"), (5, f"a b c d {y}"), (None, long), (None, long), (20, None), (21, ""), (22, long + " x")]
    df = frame(spark, rows)
    out = one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(3, long), (7, rows[2][1]), (9, "same row"), (8, rows[5][1]), (5, rows[6][1]), (None, long), (None, long), (20, None)], key=repr)
    assert one_of_each(df.filter("doc_id < 0")).count() == 0


def test_passage_distance():
    a = lambda *x: np.array(x, np.uint64)
    assert dc.passage_distance(a(1, 2, 3), a(9, 1, 2, 3, 9)) == (0, 1, 4)
    assert dc.passage_distance(a(1, 2, 3), a(9, 1, 8, 3, 9)) == (1, 1, 4)
    assert dc.passage_distance(a(1, 2, 3), a())[0] == 3

    def slow(x, y):
        best = len(x)
        for i in range(len(y) + 1):
            row = list(range(len(x) + 1))
            for w in y[i:]:
                new = [0] * (len(x) + 1)
                new[0] = row[0] + 1
                for j in range(1, len(x) + 1):
                    new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x[j - 1]))
                row = new
                best = min(best, row[-1])
        return best

    rng = random.Random(8)
    for _ in range(200):
        x, y = rng.choices(range(4), k=rng.randint(1, 6)), rng.choices(range(4), k=rng.randint(0, 9))
        assert dc.passage_distance(a(*x), a(*y))[0] == slow(x, y)


def test_leaks(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(6, 60)))) for i in range(30)] + [(90, "too few words"), (91, None)]
    rows, want = [], set()
    for n in range(150):
        i, t = rng.choice(items[:30])
        w = t.split()
        edits = rng.randint(0, dc.allowed(len(w)))
        for _ in range(edits):
            p = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[p] = "new"
            else:
                del w[p]
        rows.append((n, " ".join(rng.choices(vocab, k=rng.randint(0, 50)) + [x.upper() + "," for x in w] + rng.choices(vocab, k=20))))
        want.add((n, i))
    rows += [(500 + n, " ".join(rng.choices(vocab, k=100))) for n in range(50)] + [(600, None), (601, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(df, bench).collect()}
    assert len(want & got) >= 0.98 * len(want)
    assert not {d for d, _ in got} & set(range(500, 602))
    assert {(r.doc_id, r.item_id) for r in dc.leaks(df, bench, item_bytes=2000).collect()} == got
    clean = dc.drop_leaks(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    assert dc.leaks(df, bench.filter("item_id < 0")).count() == 0


def brute_leaks(rows, items):
    """Every document against every item by the exact distance, words taken by Python's own rules."""
    import regex

    number = {}

    def words(t):
        return np.array([number.setdefault(w, len(number) + 1) for w in regex.findall(r"[\p{L}\p{N}\p{M}]+", (t or "").lower())], np.int64)

    got = {}
    for d, t in rows:
        for i, u in items:
            x, y = words(u), words(t)
            if len(x) >= dc.LEAST_WORDS and (e := dc.passage_distance(x, y)[0]) <= dc.allowed(len(x)):
                got[d, i] = e
    return got


def mangled(rng, words, edits, vocab):
    w = list(words)
    for _ in range(edits):
        p = rng.randrange(len(w))
        what = rng.random()
        if what < 0.4:
            w[p] = f"new{rng.randint(0, 999)}"
        elif what < 0.7:
            del w[p]
        else:
            w.insert(p, rng.choice(vocab))
    return w


def test_leaks_against_brute_force(spark):
    """The whole set: nothing but leaks, and at least the recall asked for at each share of edits."""
    rng = random.Random(19)
    vocab = [f"v{i}" for i in range(600)] + ["Élan", "naïve", "ÄÖ"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 7, 10, 15, 22, 35, 60])))) for i in range(40)]
    rows = []
    for n in range(240):
        t = rng.choice(items)[1].split()
        w = mangled(rng, t, rng.randint(0, dc.allowed(len(t)) + 2), vocab)
        rows.append((n, "; ".join(rng.choices(vocab, k=rng.randint(0, 30)) + [x.upper() for x in w] + rng.choices(vocab, k=rng.randint(0, 30)))))
    rows += [(1000, None), (1001, ""), (1002, items[0][1]), (1002, items[0][1])]
    want = brute_leaks(rows, items)
    found = dc.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    assert len(found) == len(got) + 1  # the repeated row has its row each
    assert all(want[k] <= d for k, d in got.items())
    for part in (0.0, 0.5, 1.0):
        some = [k for k, e in want.items() if abs(e / max(1, dc.allowed(len(dict(items)[k[1]].split()))) - part) < 0.26]
        assert sum(k in got for k in some) >= (1 if part == 0.0 else 0.97) * len(some)
    assert len(want) > 150


@pytest.mark.parametrize("recall", [0.6, 0.9, 0.99])
def test_recall_follows_the_parameter(recall):
    """Items with all edits that are allowed."""
    rng = random.Random(23)
    vocab = [f"v{i}" for i in range(3000)]
    items = [rng.choices(vocab, k=n) for n in (5, 10, 15, 25, 40, 60) for _ in range(40)]
    known = dc.Items(list(range(len(items))), [" ".join(w) for w in items], recall=recall)
    docs = [" ".join(rng.choices(vocab, k=15) + mangled(rng, w, dc.allowed(len(w)), vocab) + rng.choices(vocab, k=15)) for w in items]
    found = {(r[0], r[1]) for r in dc.find_leaks(known, *string_buffers(pa.array(docs)))}
    assert sum((i, i) in found for i in range(len(items))) >= (recall - 0.02) * len(items)


def test_leaks_of_twin_words():
    pairs = [tuple(f"{a}{c}" for a in thue_morse(10)) for c in "abcde"]
    known = dc.Items([1], [" ".join(x for x, _ in pairs)])
    docs = [" ".join(y for _, y in pairs), " ".join(x for x, _ in pairs)]
    assert [r[0] for r in dc.find_leaks(known, *string_buffers(pa.array(docs)))] == [1]


def test_leaks_in_scripts_without_blanks():
    known = dc.Items([None, 2], ["東京は日本の首都です。", "one two three four five"])
    docs = ["昨日、東京は日本の首都です、と言った", "京は日本の首都だ", "“One–Two”… THREE—four, FIVE", "東 京 は"]
    assert [(r[0], r[1]) for r in dc.find_leaks(known, *string_buffers(pa.array(docs)))] == [(0, 0), (2, 1)]


def test_long_items_take_little_memory():
    import tracemalloc

    rng = random.Random(29)
    vocab = [f"v{i}" for i in range(3000)]
    long = rng.choices(vocab, k=3000)
    tracemalloc.start()
    known = dc.Items(list(range(501)), [" ".join(rng.choices(vocab, k=30)) for _ in range(500)] + [" ".join(long)])
    doc = " ".join(rng.choices(vocab, k=100) + mangled(rng, long, 300, vocab))
    found = dc.find_leaks(known, *string_buffers(pa.array([doc])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[1] for r in found] == [500]
    assert peak < 150 << 20


def test_empty_items(spark):
    df = frame(spark, [(1, "one two three four five"), (2, None)])
    items = spark.createDataFrame([(None, "One two, three four five"), (3, None), (4, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in dc.leaks(df, items).collect()] == [(1, None)]
    assert [r.doc_id for r in dc.drop_leaks(df, items).collect()] == [2]
    assert dc.drop_leaks(df, items.limit(0)).count() == 2
    assert dc.leaks(df.limit(0), items).count() == 0
    with pytest.raises(TypeError):
        dc.leaks(df.select(df.doc_id.cast("string"), "text"), items)


def test_string_buffers_of_nulls():
    assert string_buffers(pa.array([None, "a"]))[1].tolist() == [0, 0, 1]


def test_empty_and_clashing(spark):
    none = frame(spark, [(1, "x")]).filter("doc_id < 0")
    assert near_duplicates(none).count() == 0
    assert similar_documents(none).count() == 0
    assert hamming_links(spark.createDataFrame([], "fp long, rep long")).count() == 0
    clash = spark.createDataFrame([(1, "a b", "k", "n", "f")], "doc_id long, text string, kept_text string, n_words string, fp string")
    (row,) = substring_dedup(clash).collect()
    assert (row.kept_text, row.n_words, row.fp) == ("a b", 2, "f")
    assert near_duplicates(clash).columns == ["doc_id", "fp", "component_id"]
    with pytest.raises(ValueError):
        substring_dedup(clash, keep=["gone"])
    with pytest.raises(TypeError):
        near_duplicates(clash.select(clash.doc_id.cast("string"), "text"))

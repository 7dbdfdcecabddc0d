"""Substring dedup, centroid clustering and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chimerant.llm import clusters, spelling, substrings

DOCS = "doc_id long, text string, extra string"


def gone_by_force(rows, window):
    """Words that go, for each (doc, text), by comparing all windows."""
    first = {}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - window + 1) if doc is not None else ():
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1) if doc is not None else ():
            if first[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shared_texts(seed, n, vocabulary, width):
    """Texts that share passages of many lengths, in many contexts, with edits; rows that repeat; junk."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    passages = [[word() for _ in range(rnd.randrange(width, 4 * width))] for _ in range(12)]
    rows = []
    for doc in range(n):
        words = [word() for _ in range(rnd.randrange(3 * width))]
        for _ in range(rnd.randrange(4)):
            p = list(rnd.choice(passages[:3] if rnd.random() < 0.6 else passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = word()
            a = rnd.randrange(len(p))
            p = p[a:] if rnd.random() < 0.3 else p
            at = rnd.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((doc, rnd.choice([" ", "\n", "\t "]).join(words), None))
    rows += [(5, rows[7][1], "x"), (5, rows[5][1], "y"), (None, rows[3][1], "z"), (n, None, None), (n + 1, "", None), (n + 2, "a " * 500, None), (n + 3, "a " * 300, None), (n + 4, "a b " * 200, None), (-4, rows[9][1], None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,gram,crowd,block,vocabulary", [(50, 16, 1_000, 2_500, 5_000), (20, 8, 1_000, 20, 3), (20, 8, 3, 50, 40), (12, 4, 0, 50, 5)])
def test_substrings_equal_brute_force(spark, window, gram, crowd, block, vocabulary):
    rows = shared_texts(vocabulary, 80, vocabulary, window)
    found = substrings.dedup_substrings(spark.createDataFrame(rows, DOCS), window, gram, crowd, block).collect()
    some = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=some) == sorted(gone_by_force(rows, window), key=some)
    assert sum(r.n_removed for r in found) > 500
    for r in found:
        assert sum(b - a for a, b in r.spans) == r.n_removed


def test_factors_are_longest_matches_and_windows_have_one_boundary():
    rnd = random.Random(3)
    parts = [np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 90))], np.uint64) for _ in range(40)]
    docs = np.array([rnd.randrange(30) for _ in parts])
    ref = substrings.Reference(parts, docs)
    texts = [p.tolist() for p in parts]

    def longest(k, i):
        most = 0
        for j, t in enumerate(texts):
            for a in range(len(t)) if docs[j] < docs[k] else ():
                n = 0
                while i + n < len(texts[k]) and a + n < len(t) and texts[k][i + n] == t[a + n]:
                    n += 1
                most = max(most, n)
        return min(most, 63)

    for k in range(0, 40, 7):
        places = np.arange(len(texts[k]))
        assert ref.longest(places + ref.starts[k]).tolist() == [longest(k, i) for i in places]
    seg, start, end = substrings.factors(ref)
    assert (end[:-1][seg[:-1] == seg[1:]] == start[1:][seg[:-1] == seg[1:]]).all()
    assert (end > start).all() and sum(end - start) == sum(map(len, parts))
    for k, a, b in zip(seg.tolist(), start.tolist(), end.tolist(), strict=True):
        assert b - a == max(1, longest(k, a - int(ref.starts[k])))


def test_substrings_filter_keeps_columns_and_drops_emptied_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (2, text, "b"), (3, f"x  y\n{text} z", "c"), (4, None, "d"), (None, text, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("doc_id", "text", "ids", "doc_id AS gone", "ids AS c0")
    left = substrings.filter_documents(docs)
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text, r.ids, r.c0) for r in left.collect()} == {(1, text, "a", "a"), (3, "x y z", "c", "c"), (4, None, "d", "d"), (None, text, "e", "e")}
    assert substrings.filter_documents(docs.limit(0)).count() == 0
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rnd = random.Random(1)
    long = " ".join(str(rnd.randrange(50_000)) for _ in range(200_000))
    rows = [(1, long, None), (2, "start " + long, None), (3, long[:500_000] + " end", None)]
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    n3 = len(rows[2][1].split())
    assert found[1] == (200_000, 0) and found[2] == (200_001, 200_000) and found[3][0] == n3 and n3 - found[3][1] <= 2


def clusters_by_force(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        own = [best(v) for _, v in kept]
        for j in range(len(centroids)):
            some = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if some:
                centroids[j] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out = [(i, best(v), far(v, centroids[best(v)])) for i, v in kept]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted((i, j, d, inertia[j], sum(inertia.values()), digest(centroids[j])) for i, j, d in out)


@pytest.mark.parametrize("seed,spread", [(1, 0.5), (2, 0.03), (3, 1e5)])
def test_clusters_equal_brute_force(spark, seed, spread):
    rnd = np.random.default_rng(seed)
    dim = 8
    vectors = [(int(i), [float(np.float32(x)) for x in rnd.normal(0, spread, dim)]) for i in range(300)]
    vectors += [(400 + i, vectors[0][1]) for i in range(150)]  # one vector has a third of all rows
    vectors += [(900, None), (901, vectors[0][1][:7]), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (904, [None] * dim), (905, []), (7, vectors[8][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS cluster", "2 AS distance")
    found = clusters.cluster(df, 5, 3, 1, dim, 64).collect()
    assert sorted(tuple(r)[:6] for r in found) == clusters_by_force(vectors, 5, 3, dim, 64, 1)


def test_screening_never_loses_the_nearest_and_ties_take_the_lowest():
    rnd = np.random.default_rng(5)
    for size in (3, 1 << 10, 1 << 20, 1 << 26):
        c = rnd.integers(-size, size + 1, (16, 64))
        c[9], c[12] = c[4], c[4]
        c[13] = c[2] + (rnd.integers(0, 2, 64) if size > 3 else 1)  # all but equal: 32 bits can't tell them apart
        v = np.concatenate([c + rnd.integers(-1, 2, c.shape), rnd.integers(-size, size + 1, (200, 64))])
        far = ((v[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(2)
        own, exact = clusters.nearest(v, c)
        assert own.tolist() == [min(range(16), key=lambda j: (row[j], j)) for row in far.tolist()]
        assert exact < len(v) or size < 8


def test_clusters_of_few_far_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [9.0, 9.0]), (3, [1e30, 0.0])], "vec_id long, embedding array<double>")
    found = sorted((r.vec_id or 0, r.cluster, r.distance, r.cluster_size) for r in clusters.cluster(few, 16, 3, 1, 2).collect())
    assert [f[0] for f in found] == [0, 1, 2, 3] and found[3][1:] == (None, None, None) and found[1][1] == found[2][1] == 1  # the third vector has moved centroid 0 away
    assert clusters.cluster(few.limit(0), 16, 3, 1, 2).count() == 0


def variants_by_force(rows, least_letters=7, least_count=2, times=10, typo=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            if doc is not None:
                h = zlib.crc32(f"{doc}:{run}".encode())
                if h % typo == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_letters and c >= least_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, c in n.items():
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * c else None
        out[w] = (form[w], c, len(others), n[form[w]] if form[w] else None)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, f or "", root(w), c, k, fn or 0) for w, (f, c, k, fn) in out.items())


def spelled(seed, letters, size, docs):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(size, size + 4))) for _ in range(25)]
    weights = [rnd.random() ** 6 + 0.001 for _ in base]

    def word():
        w = rnd.choices(base, weights)[0]
        if rnd.random() < 0.15:
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]])
        return w.capitalize() if rnd.random() < 0.2 else w

    rows = [(d, rnd.choice([" ", "-", "\n", "1", " ×÷ "]).join(word() for _ in range(rnd.randrange(60)))) for d in range(docs)]
    return [*rows, rows[0], (None, rows[1][1]), (None, None), (docs, ""), (docs + 1, "z" * 20_000 + " " + "z" * 20_000 + " " + "z" * 19_999 + " " + "z" * 19_999)]


@pytest.mark.parametrize("seed,letters,size,crowd,typo", [(1, "abcdeé", 7, 128, 31), (2, "ab", 7, 4, 5), (3, "aÿ", 8, 0, 31), (4, "abcdefghij", 10, 2, 7)])
def test_spelling_equals_brute_force(spark, seed, letters, size, crowd, typo):
    rows = spelled(seed, letters, size, 250)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    found = spelling.group_variants(df, typo=typo, crowd=crowd, part=50)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())
    want = variants_by_force(rows, typo=typo)
    assert got == want
    assert sum(1 for w in want if w[1]) > 5


def test_spelling_of_nothing_and_chains(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(empty).count() == 0
    chain = spark.createDataFrame([("aaaaaab", "aaaaaabb"), ("aaaaaabb", "aaaaaabbb"), ("aaaaaabbb", "aaaabbbb"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(chain).collect()} == {("aaaaaab", "aaaabbbb"), ("aaaaaabb", "aaaabbbb"), ("aaaaaabbb", "aaaabbbb"), *((x, "g") for x in "bcdef")}


def test_f8_f9_the_basis_comes_from_all_passages(spark, monkeypatch):
    """More documents than any sample had: each is a row of the fit; and the basis is that of the plain product over all passages."""
    import numpy as np

    from chimerant.llm import decontam

    seen = []
    monkeypatch.setattr(decontam, "fit_basis", lambda rows, *a, plain=decontam.fit_basis, **k: seen.append(rows.count()) or plain(rows, *a, **k))
    bench = spark.createDataFrame([(1, "alpha beta gamma delta eps zeta eta theta. It is iota."), (2, "one two three four five six seven. It is eight.")], "item_id long, text string")
    docs = spark.range(1_500).selectExpr("id AS doc_id", "concat('w', id, ' alpha beta v', id % 50) AS text")
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench).collect()) and seen == [1_502]

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(19, int(x))}" for x in rng.exponential(5, n)) for n in (0, 5, 64, 65, 500, 131) * 20]
    weight, column = rng.random(decontam.SLOTS).astype(np.float32) + 0.1, np.full(decontam.SLOTS, -1, np.int32)
    known = np.unique(decontam.slots_of([f"w{i}".encode() for i in range(12)]))
    column[known] = np.arange(len(known))
    total = np.zeros((len(known), len(known)))
    for t in texts:
        words = decontam.slots_of(decontam.words_of(t))
        for at in range(0, len(words), decontam.PASSAGE):
            row, part = np.zeros(len(known)), words[at : at + decontam.PASSAGE]
            np.add.at(row, column[part[column[part] >= 0]], weight[part[column[part] >= 0]])
            row /= np.sqrt((weight[part].astype(float) ** 2).sum())
            total += np.outer(row, row)
    want = np.linalg.eigh(total)[1][:, ::-1][:, :5]
    table = decontam.slots_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).selectExpr("slots", "1D AS scale")
    got = decontam.fit_basis(table, column, weight, len(known), 5)
    assert got.shape == want.shape and np.allclose(got @ got.T, want @ want.T, atol=1e-3)


def test_f7_repeats_are_looked_for_on_all_pages_of_a_host(spark):
    """A page without an article finds what it shares with the outside of articles, and keeps what it shares with their text."""
    from chimerant.llm import html

    foot, share = (" ".join(f"{k}{i}" for i in range(12)) for k in ("foot", "text"))
    pages = [
        (1, "http://h/1", f"<article><p>{share}</p><p>one</p></article><div>{foot}</div>"),
        (2, "http://h/2", f"<p>{share}</p><p>own words</p><div>{foot}</div>"),
        (3, "http://other/3", f"<p>elsewhere</p><div>{foot}</div>"),
        (4, "http://third/4", f"<article>a</article><footer>{foot}</footer>"),
        (2, "http://h/2", f"<p>{share}</p><p>own words</p><div>{foot}</div>"),
    ]
    got = Counter((r.page_id, r.text, r.n_dropped) for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got == Counter({(1, f"{share}\n\none", 0): 1, (2, f"{share}\n\nown words", 1): 2, (3, f"elsewhere\n\n{foot}", 0): 1, (4, "a", 0): 1})


def test_lines_emit_variants_only_where_their_surroundings_are_shared(spark, monkeypatch):
    """Lines that share a half with others and nothing near emit none; every place and kind of edit is found (F1 of r03)."""
    from chimerant.llm import linededup

    rnd, seen = random.Random(5), []
    word = lambda: f"w{rnd.randrange(10**6)}"
    monkeypatch.setattr(linededup, "_variant_rows", lambda lines, plain=linededup._variant_rows: seen.append(plain(lines).count()) or plain(lines))
    head = [word() for _ in range(32)]
    far = [(i, " ".join(head + [word() for _ in range(28)])) for i in range(50)]
    assert not any(r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(far, "doc_id long, text string")).collect()) and seen == [0]

    rows, gone = [], set()
    for n in (9, 10, 11, 15, 16, 17, 31, 32, 33, 64, 200):
        for p in sorted({*range(min(n, 18)), n // 2, n - 2, n - 1}):
            for kind in range(5):
                a = [word() for _ in range(n)] if kind < 4 else [f"a{len(rows)}"] * (p + 1) + [word() for _ in range(n - p - 1)]
                b = [a[:p] + [word()] + a[p + 1 :], a[:p] + a[p + 1 :], a[:p] + [word()] + a[p:], a[: n - 1 - p] + [word(), word()] + a[n + 1 - p :], a[:p] + a[p + 1 :]][kind]
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
                if min(len(a), len(b)) >= linededup.MIN_WORDS and linededup.within_one(a, b):
                    gone.add(len(rows) - 1)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got if r.n_removed} == gone and len(gone) > 500


def test_words_are_hashed_by_columns_and_only_candidates_are_split(monkeypatch):
    """Slots of whole columns equal those of split words; a text that no item can be in is not split (F2 of r03)."""
    import pyarrow as pa

    from chimerant.llm import decontam

    rnd = random.Random(2)
    texts = [None, "", " ", "a", "b ", " c\x0bD\x0c\r\n", "Ä É\xa0x y\x1cz\x85q", "x" * 32, "y" * 33 + " " + "Z" * 500, "\x00 \x7f", "😀 " * 3, "t", "u"]
    texts += ["".join(rnd.choice("aBé \t\n\x0b\x1f,") for _ in range(rnd.randrange(60))) for _ in range(700)]
    for column in (pa.array(texts), pa.array(["left out", *texts]).slice(1), pa.array(texts, pa.large_string()), pa.array(texts[:0], pa.string()), pa.array([None, ""], pa.string())):
        got = list(decontam.text_slots(column))
        want = [decontam.slots_of(decontam.words_of(t)) for t in column.to_pylist()]
        assert len(got) == len(want) and all(g.dtype == np.int32 and np.array_equal(g, w) for g, w in zip(got, want, strict=True))

    item = "what is the capital of the far country. It is a small town."
    used = np.unique(decontam.slots_of(decontam.words_of(item)))
    column, weight = np.full(decontam.SLOTS, -1, np.int32), np.ones(decontam.SLOTS, np.float32)
    column[used] = np.arange(len(used))
    finder = decontam.Searcher([(7, 0, item)], column, weight, np.eye(len(used), dtype=np.float32), 0.25, 0.8, 0.6)
    split, plain = [], decontam.words_of
    monkeypatch.setattr(decontam, "words_of", lambda t: split.append(t) or plain(t))
    docs = pa.array(["the town is of a kind", f"so {item} yes", None])
    found = [finder.best(t, s) for t, s in zip(docs, decontam.text_slots(docs), strict=True)]
    assert found[0] is found[2] is None and found[1][0] == 7 and split == [docs[1].as_py()]
    few, enough = "the is a of what far", "the is a of what far the is"  # 8 of the item's 13 words with its repeats, 6 without
    assert not finder.candidates(decontam.slots_of(few.encode().split())) and finder.candidates(decontam.slots_of(enough.encode().split()))

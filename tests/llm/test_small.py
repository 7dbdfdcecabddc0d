"""The corpus operators on small tables against brute force, with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
llm = pytest.importorskip("chimerant.llm")
from chimerant.llm import bpe, common, decontam, html, linededup, lm, ngram_join, pii, quality, queries, tokencount, warc  # noqa: E402

PROSE = " ".join(f"word{i % 97} other{i % 89} thing{i % 83}." for i in range(60))
TEXTS = [(0, PROSE), (1, PROSE + " and one more."), (2, PROSE), (3, None), (4, ""), (5, "Short text, é ß 😀."), (6, "x" * 30_000), (7, "a  b\n\n c\td " * 900), (8, "Mail a.b@mail1.example.com or +1 (269) 555-3296, 55.63.178.142 and 4111 1111 1111 1111."), (8, "again 8"), (None, "no id here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in TEXTS], "doc_id long, text string, n_tokens string, row int").repartition(3).cache()


def by_text(df):
    return Counter(tuple(r) for r in df.collect())


def test_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := ref.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in TEXTS)
    assert by_text(bpe.encode_decode(docs, path, P.PATTERN)) == want
    assert bpe.encode_decode(docs.limit(0), path, P.PATTERN).count() == 0


def test_token_counts(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in TEXTS)
    assert by_text(tokencount.count_tokens(docs, path)) == want
    assert by_text(tokencount.count_tokens(docs, path, chunk=64, overlap=4)) == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(docs, order, monkeypatch):
    monkeypatch.setattr(lm, "LOOKUP", 100)
    spark = docs.sparkSession
    rows = [(i, t) for i, t in TEXTS] + [(i, f"word{i % 7} other{i % 5} word{i % 3} other{i % 2} word1") for i in range(20, 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS score", "1 AS held_out", "2 AS block")
    got = lm.score_documents(table, order=order, block_bytes=2_000, range_bytes=1_000).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    grams = [Counter() for _ in range(order + 1)]  # of each order, with their histories
    seen = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if not held(i):
            w = [b"\t", *words(t)]
            for k in range(1, order + 1):
                for at in range(1, len(w)):
                    if at - k + 1 >= 0:
                        grams[k][tuple(w[at - k + 1 : at + 1])] += 1
                        seen[k][tuple(w[at - k + 1 : at])] += 1
    c = Counter({g[0]: k for g, k in grams[1].items()})
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    mus = [None, None]
    for k in range(2, order + 1):
        bins = Counter()
        for x in grams[k - 1].values():
            bins[int(math.log2(x))] += x
        mus.append(lm.fit_mu(sum(x == 1 for x in grams[k].values()), bins))

    def p(w, at, k):
        """Probability of w[at] after up to k - 1 words, w[0] being the beginning."""
        if k == 1:
            return (c[w[at]] + 1) / (n + v + 1)
        lower = p(w, at, k - 1)
        if at - k + 1 < 0:
            return lower
        return (grams[k][tuple(w[at - k + 1 : at + 1])] + mus[k] * lower) / (seen[k][tuple(w[at - k + 1 : at])] + mus[k])

    score = lambda t: sum(math.log10(p([b"\t", *words(t)], at, order)) for at in range(1, len(words(t)) + 1))
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == Counter((i, round(score(t), 5)) for i, t in rows)
    assert order == 1 or sum(r.score - r.base_score for r in got if r.held_out) > 0
    assert lm.score_documents(table.limit(0), order=order).count() == 0


def test_lm_automaton():
    """Failure arcs are taken only where a state has no arc, and the state carried is the longest history seen."""
    block = lm.Block(["a b a b c", "b c"], [False, False], 3)
    model = lm.Automaton(block, 9, 4, [0.5, 0.5], 2)
    model.load(0, len(block.words))
    end, a, b, c = range(4)
    arc = lambda state, w: model.arcs.get(state * model.width + w)
    ab = model.dest[arc(1 + a, b)]
    assert model.fail[ab] == 1 + b and model.fail[1 + b] == 0 and model.dest[arc(ab, a)] != ab
    assert arc(ab, end) is None and arc(1 + b, end) is None  # two failures, then the word's own arc
    weight = lambda state, w: model.weight[arc(state, w)]
    first = weight(model.begin, a)
    start = model.dest[arc(model.begin, a)]
    state = model.dest[arc(start, b)]
    want = first + weight(start, b) + model.fail_weight[state] + model.fail_weight[model.fail[state]] + model.word_weights[end]
    assert abs(model.score([a, b, end]) - want) < 1e-12


def test_quality(docs):
    got = {(r.doc_id, r.n_words): r for r in quality.score_quality(docs).collect()}
    assert len(got) == len({(i, len((t or "").split())) for i, t in TEXTS})
    for i, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        r = got[(i, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and quality.filter_documents(docs.limit(0)).count() == 0


def test_html(spark):
    nav = "<nav><a href='/'>Home</a></nav>"
    foot = "one two three four five six seven eight nine ten"
    pages = [(1, "http://a.x/1", f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{nav}<div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>First\n  para<b>graph</b><br>x&nbsp;y</p><p>second<div class='comments'>reader</div></article><footer>f</footer></body></html>"), (2, "http://a.x/2", None), (3, None, ""), (4, "http://b.x/1", f"<body><p>unique one here</p><div>{foot}</div>"), (5, "http://b.x/2", f"<body><p>another text</p><div>{foot}</div>"), (5, "http://b.x/2", f"<body><p>another text</p><div>{foot}</div>"), (6, "u", "a < b <")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & more\n\nFirst paragraph x y\n\nsecond" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "unique one here", "another text")


def test_line_dedup(spark):
    base = "a b c d e f g h i j k"
    rows = [(1, f"{base}\nshort line\n\n{base}"), (2, "short line\na b c d X f g h i j k\nnew"), (3, "a b c d e f g h i j k l\nkeep me"), (4, None), (None, base), (5, ""), (5, "keep me")]
    got = Counter((r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, f"{base}\nshort line\n"), (2, "new"), (3, "keep me"), (4, None), (None, base), (5, ""), (5, "")])
    assert linededup.within_one([1, 2, 3], [1, 3]) and not linededup.within_one([1, 2], [2, 1]) and linededup.within_one([1], [2])


def test_jaccard(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:200] + [f"z{i}"] + words[200 : 200 + 3 * (i % 4)])) for i in range(10, 40)]
    rows += [(1, "One two"), (2, "one TWO"), (3, "one two three"), (4, None), (5, " "), (6, " ".join(words[250:390])), (7, " ".join(words[250:388])), (7, "again")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[root(k)] = min(i, smallest.get(root(k), i))
    assert got == Counter((i, len(sets[k]), smallest[root(k)]) for k, (i, _) in enumerate(rows))
    kept = {r.doc_id for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {1, 3, 4, 5, 6}.issubset(kept) and 2 not in kept and len([k for k in kept if k >= 10]) == len({smallest[root(k)] for k, (i, _) in enumerate(rows) if i >= 10})


def test_token_counts_of_spliced_texts():
    """Random texts with characters of several bytes, runs and ends of spaces, and none at all, spliced from tiny chunks."""
    import random

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(3)
    small, real = tokencount.Counter(path, chunk=40, overlap=4), tokencount.Counter(path)
    bits = ["a", "xy", "the", "é", "🧿", "漢字", " ", "  ", "\n", "\u2581", "\u00a0", "<s>", "1234", "...", "𐍈𐍈"]
    for _ in range(1500):
        text = "".join(r.choices(bits, k=r.randrange(5, 120))) + r.choice(["", " ", "   ", "🧿"])
        assert small.count(text) == len(model.encode(text)), text
    for lead in range(6):
        for body in ("ab🧿🧿 c " * 3000, "漢字🧿" * 2000, "word " * 5000 + " ", "a" * 20_000):
            text = "x" * lead + " " + body
            assert real.count(text) == len(model.encode(text))


def _linked(rows, percent=80):
    """(doc_id, set size, component) by brute force."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[root(k)] = min(i, smallest.get(root(k), i))
    return Counter((i, len(sets[k]), smallest[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("part,crowd", [(1_500_000, 8_192), (400, 3)])
def test_jaccard_of_families(spark, monkeypatch, part, crowd):
    """Families whose members drift apart, so that many pairs at a pivot are near the bound; in one piece and in many."""
    import random

    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    r, rows = random.Random(5), []
    for f in range(4):
        bases = [[f"f{f}w{r.randrange(300)}" for _ in range(60 + 40 * f)]]
        for _ in range(30):
            w = list(r.choice(bases))
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            bases.append(w)
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(bases)]
    r.shuffle(rows)
    want = _linked(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS cls", "1 AS n", "2 AS component_id")
    assert Counter(tuple(x) for x in ngram_join.link(table).collect()) == want
    assert 4 < len({c for _, _, c in want}) < len(rows) / 2
    assert ngram_join.link(table.limit(0)).count() == 0 and ngram_join.keep_one(table).columns == table.columns


def test_decontamination(spark):
    bench = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i} theta{i} iota{i} kappa{i}. The answer{i} is {i}.") for i in range(5)] + [(9, None), (10, " ")]
    rows = [(k, PROSE.replace("word", f"k{k}w")) for k in range(20)] + [(100, PROSE + " " + bench[2][1] + " " + PROSE), (101, "alpha3 beta3 gamma3 delta3 eps3 other eta3 theta3 iota3 kappa3. The answer3 is 3."), (102, None), (103, "")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(d, b).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {100, 101} and (got[100].item_id, got[101].item_id) == (2, 3)
    assert decontam.filter_documents(d, b).count() == len(rows) - 2 and decontam.filter_documents(d, b.limit(0)).count() == len(rows)
    assert decontam.lcs_length([1, 2, 3, 4], [2, 9, 4]) == 2


def test_pii(docs):
    got = {(r.doc_id, r.spans): r for r in pii.report(pii.find_personal_data(docs)).collect()}
    t = TEXTS[8][1]
    want = ",".join(f"{k}:{t.index(v)}:{t.index(v) + len(v)}" for k, v in (("email", "a.b@mail1.example.com"), ("phone", "+1 (269) 555-3296"), ("ip", "55.63.178.142"), ("card", "4111 1111 1111 1111")))
    assert (8, want) in got and got[(8, want)].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) == 4
    clean = [r.text for r in pii.sanitise(docs).filter("doc_id = 8").collect()]
    assert "Mail [EMAIL] or [PHONE], [IP] and [CARD]." in clean and "again 8" in clean


def test_warc(spark):
    big = "<p>" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\n"
    pages = [(3, "http://b/1", big), (1, "http://a/1?q", big), (2, "http://a/1", big), (4, None, None), (5, "http://c/", "tiny"), (6, "http://c/", "tiny")]
    got = warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == {(i, len(b := (h or "").encode()), hashlib.sha256(b).hexdigest(), "revisit" if i in (2, 3) else "response", 1 if i in (2, 3) else None) for i, _, h in pages}
    assert [r.url_key for r in got] == sorted(r.url_key for r in got)
    assert len({(r.archive, r.offset) for r in got}) == len(pages)
    assert warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string").limit(0)).count() == 0
    hot = [(i, "http://hot/", f"{i % 3}" * 300) for i in range(2_000)] + [(7, "http://hot/", "1" * 300), (9_000, "http://long/", "é" * 3_000_000)]
    table = spark.createDataFrame(hot, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS origin", "2 AS size")
    found = warc.archive_and_index(table.repartition(4)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in found) == Counter((i, "response" if i in (0, 1, 2, 9_000) else "revisit", None if i in (0, 1, 2, 9_000) else int(h[0])) for i, _, h in hot)
    assert list(warc.LoserTree([[1, 4], [], [2, 3, 9]], lambda x: x)) == [1, 2, 3, 4, 9]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8)], "a long, b long")
    assert {(r.node, r.comp) for r in common.components(e).collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (8, 7)}


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster())


def test_decontamination_of_a_common_item(spark):
    item = "alpha beta gamma delta eps zeta eta theta iota kappa. The answer is mu."
    own = lambda k, a, b: " ".join(f"d{k}x{i}" for i in range(a, b))
    rows = [(k, f"{own(k, 0, 25)} {item} {own(k, 25, 50)}" if k % 3 == 0 else own(k, 0, 50)) for k in range(300)]
    rows.append((300, f"{own(300, 0, 25)} {item.replace('beta', 'x').replace('zeta', 'y z').replace('iota', 'w')} {own(300, 25, 50)}"))
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.contaminated} == {k for k in range(301) if k % 3 == 0}


def test_html_repeats_of_a_large_host(spark):
    pad = "<script>" + "x" * 200_000 + "</script>"
    foot = lambda k: " ".join(f"foot{k}w{i}" for i in range(12))
    pages = [(i, f"http://h.x/{i}", f"<body>{pad}<p>own text {i}</p><div>{foot(i // 2)}</div>") for i in range(60)]
    copy = f"<body>{pad}<p>{foot('copy')}</p><p>more of it</p>"
    pages += [(100 + i, f"http://h.x/c{i}", copy) for i in range(6)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all((got[i].text, got[i].n_dropped) == (f"own text {i}", 1) for i in range(60))
    assert all((got[100 + i].text, got[100 + i].n_dropped) == (f"{foot('copy')}\n\nmore of it", 0) for i in range(6))


def _filler(r, n):
    return " ".join(f"filler{r.randrange(400):03}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


def test_pii_terms_in_whole_texts(spark):
    r = random.Random(1)
    rows = [(k, f"Write to bob@mail.example.com now. {_filler(r, 40)} Zanzibar, {_filler(r, 40)} zanzibar") for k in range(3)] + [(3, f"{_filler(r, 30)}\n only  (Zanzibar) here")]
    rows += [(10 + k, _filler(r, 40)) for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii.report(pii.find_personal_data(table)).collect()}
    texts = dict(rows)
    for i in range(4):
        want = [m.span() for m in re.finditer(r"Zanzibar,|zanzibar|\(Zanzibar\)", texts[i])]
        assert [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("term") and texts[i][slice(*map(int, s.split(":")[1:]))].strip(",()").lower() == "zanzibar"] == want
    assert all(got[10 + k].n_term == 0 for k in range(100))
    many = [(200 + k, f"Call +1 (269) 555-3296 {_filler(r, 20)}, " + "Quagga\n quagga " * 4_000) for k in range(4)] + [(300, None), (300, ""), (None, "quagga Quagga")]
    many = spark.createDataFrame(many + [(400 + k, _filler(r, 40)) for k in range(200)], "doc_id long, text string").selectExpr("*", "'x' AS uid", "1 AS base", "2 AS terms")
    report = {r.doc_id: r for r in pii.report(pii.find_personal_data(many)).collect()}
    assert {i: r.n_term for i, r in report.items() if r.n_term} == {None: 2} | {200 + k: 8_001 for k in range(4)}  # Call, and the words behind it
    assert report[300].spans == "" and pii.report(pii.find_personal_data(many.limit(0))).count() == 0
    assert not any("anzibar" in r.text for r in pii.sanitise(table).collect())


def _disclosed(texts, support=3, disclosure=0.5, bits=4.0):
    """Terms, the texts that hold them and the entities that they disclose, by counting all pairs."""
    import math

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    entities, terms = [], []
    for t in texts:
        entities.append({m.lower() for m in email.findall(t)})
        words = {w.strip(pii.PUNCTUATION).lower() for w in t.split()}
        terms.append({w for w in words if len(w) > 1 and not re.search("[0-9@]", w)})
    n_e, n_t = Counter(e for x in entities for e in x), Counter(w for x in terms for w in x)
    both = Counter((w, e) for x, y in zip(entities, terms, strict=True) for e in x for w in y)
    found = {}
    for (w, e), n in both.items():
        if n >= support and n / n_t[w] >= disclosure and math.log2(n * len(texts) / (n_t[w] * n_e[e])) >= bits:
            found[w] = (n_t[w], found.get(w, (0, 0))[1] + 1)
    return found


def test_pii_terms_equal_brute_force_whatever_the_copies(spark):
    r = random.Random(7)
    people = [(f"p{k}@mail.example.com", [f"name{chr(97 + k)}", f"town{chr(97 + k)}"]) for k in range(8)]
    texts = []
    for k in range(400):
        words = _filler(r, r.randrange(30, 120)).split()
        if k % 4 == 0:
            for _ in range(r.randrange(1, 3)):
                mail, own = r.choice(people)
                words[r.randrange(len(words))] = f"<{mail.upper() if r.random() < 0.3 else mail}>"
                for w in own:
                    if r.random() < 0.8:
                        words[r.randrange(len(words))] = f"{w.capitalize()},"
        if k % 50 == 1:
            words.append(r.choice(people)[1][0])
        texts.append(" ".join(words))
    want = _disclosed(texts)
    assert 4 < len(want) < 40

    def terms_of(corpus):
        docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(5)
        located = pii.cut(pii._located(pii._keyed(docs)), "test-pii")
        return {x.term: (x.n_t, x.entities) for x in pii.disclosing(located, pii.representatives(located)).collect()}

    assert terms_of(texts) == want
    copies = texts + texts[:200] * 3
    assert terms_of(copies) == want  # exact copies are no evidence
    near = []
    for t in texts[:100]:
        for _ in range(4):
            words = t.split()
            words[r.randrange(len(words))] = f"edit{r.randrange(26)}".translate(str.maketrans("0123456789", "abcdefghij"))
            near.append(" ".join(words))
    found = terms_of(texts + near)
    assert len(set(found) ^ set(want)) <= 1, (set(found) ^ set(want))  # nor are near copies, of which a sketch may miss a few


def test_pii_page_of_many_addresses(spark):
    """Words and addresses of one page are one pair of classes, and not their product."""
    r = random.Random(9)
    words = [*(f"a{i}@dir.example.com" for i in range(300)), *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))]
    pages = [" ".join(r.sample(words, len(words)) + _filler(r, 300).split()) for _ in range(4)]  # no copies: each in an order of its own
    docs = spark.createDataFrame(list(enumerate(pages + [_filler(r, 60) for _ in range(100)])), "doc_id long, text string")
    found = {x.doc_id: x for x in pii.report(pii.find_personal_data(docs)).collect()}
    assert all(found[i].n_email == 300 and found[i].n_term >= 600 for i in range(4)) and not found[50].n_term

def test_html_zones(spark):
    """Inside an article only what the contract names is left out; page parts outside are told by more names."""
    body = "<div class='related'>outside</div><article><header><h1>Title</h1></header><p>one</p><div class='related-work'>two</div><math><mi>x</mi></math><div class='comments'>no</div><form>no</form><p>three<select><option>no</select></p></article><div class='widget'>no</div>"
    pages = [(1, "http://h/1", body), (2, "http://h/2", "<body>" + "<p>word</p>" * 20_000), (None, "http://h/3", "<p>kept</p>"), (4, None, "x" * 500_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS uid", "'h' AS host", "'t' AS text")
    got = {r.page_id: r for r in html.extract(table).collect()}
    assert got[1].text == "Title\n\none\n\ntwo\n\nx\n\nthree".replace("two\n\nx", "two\n\nx") and got[None].text == "kept"
    assert got[2].n_blocks == 20_000 and got[4].n_chars == 500_000
    assert html.extract(table.limit(0)).count() == 0


def test_quality_em():
    """Documents drawn from classes: the kinds of defect are told from good ones, though one rule alone sees each defect."""
    import random

    r, names = random.Random(1), list(quality.RULES)
    counts, truth = Counter(), Counter()
    for _ in range(20_000):
        kind = r.choices(["good", "symbols", "same_words"], [0.85, 0.08, 0.07])[0]
        votes = [-1 if (n == kind or (kind == "same_words" and n == "few_words" and r.random() < 0.9) or r.random() < 0.002) else r.choice([0, 1, 1, 1]) for n in names]
        pattern = 0
        for v in votes:
            pattern = 3 * pattern + v + 1
        counts[pattern] += 1
        truth[pattern, kind == "good"] += 1
    shares, bad = quality.fit(counts)
    right = sum(n for (p, good), n in truth.items() if (quality.posterior(quality.votes_of(p), shares, bad) >= 0.5) == good)
    assert abs(shares[0] - 0.85) < 0.06 and right > 0.97 * 20_000
    v = [1, -1, 0, 1, 1, 1, 1, 1]
    each = [s * math.prod(b[j] if x < 0 else 1 - b[j] for j, x in enumerate(v) if x) for s, b in zip(shares, bad)]
    assert abs(quality.posterior(v, shares, bad) - each[0] / sum(each)) < 1e-9
    assert quality.fit({})[0].sum() == pytest.approx(1)


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01/labels.parquet"), reason="no labelled documents here")
def test_quality_on_labels(spark):
    folder = "/root/testdata/sf0.01/"
    both = quality.score_quality(spark.read.parquet(folder + "documents.parquet")).join(spark.read.parquet(folder + "labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r.n for r in both.filter("NOT base_failed").groupBy("quality", "kept").agg(__import__("pyspark").sql.functions.count("*").alias("n")).collect()}
    assert n.get((0, True), 0) <= 0.1 * (n.get((0, True), 0) + n.get((0, False), 0)) and n.get((1, False), 0) <= 0.02 * n[1, True]


def _leaks(docs, bench):
    """Documents with a stretch of two item lengths whose alignment an item accepts: all stretches, no search."""
    out = {}
    for i, text in docs:
        w = decontam.words_of(text)
        for item, t in bench:
            b, answer = decontam.words_of(t), decontam.answer_of(t or "")
            for at in range(0, max(1, len(w))):
                part = w[at : at + 2 * len(b)]
                share = decontam.lcs_length(b, part) / len(b) if b else 0
                if share >= decontam.MIN_LCS or (share >= decontam.PARAPHRASE and decontam.holds(part, answer)):
                    out.setdefault(i, set()).add(item)
                    break
    return out


@pytest.mark.parametrize("block,rounds", [(256, 4), (3, 1)])
def test_decontamination_recall(spark, monkeypatch, block, rounds):
    """Paraphrases against brute force, in one round and in many: the latent search finds nine of ten at least, and nothing else; without it nothing is found."""
    import random

    monkeypatch.setattr(decontam, "BLOCK_PASSAGES", block)
    monkeypatch.setattr(decontam, "ROUND", rounds)
    r = random.Random(7)
    words = [f"v{i}" for i in range(400)]
    some = lambda n: [words[min(399, int(r.expovariate(0.012)))] for _ in range(n)]
    bench = [(i, " ".join(some(14)) + f". The answer is a{i} b{i}.") for i in range(12)]
    docs = []
    for k in range(120):
        text = some(150)
        if k % 2:
            item = bench[k % 12][1].split()
            for _ in range(r.randrange(0, 7)):
                item[r.randrange(len(item) - 5)] = r.choice(words)
            at = r.randrange(150)
            text[at:at] = item
        docs.append((k, " ".join(text)))
    docs += [(500, None), (501, ""), (502, " ".join(some(30_000))), (503, bench[3][1]), (503, bench[3][1])]
    want = _leaks([d for d in docs if d[0] != 502], bench)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1L AS item", "'x' AS answer", "2 AS lcs")
    got = decontam.decontaminate(table, spark.createDataFrame(bench, "item_id long, text string")).collect()
    hit = {x.doc_id for x in got if x.contaminated} - {502}
    assert len(got) == len(docs) and hit <= want.keys() and len(hit) >= 0.9 * len(want)
    assert all(x.item_id in want[x.doc_id] for x in got if x.contaminated and x.doc_id != 502)
    hits = [x for x in got if x.contaminated]
    assert all(x.cosine >= decontam.MIN_COSINE for x in hits) and len(hits) > 30
    assert not any(x.contaminated for x in decontam.decontaminate(table, spark.createDataFrame(bench, "item_id long, text string"), min_cosine=9.0).collect())
    empty = decontam.decontaminate(table.limit(0), spark.createDataFrame(bench, "item_id long, text string"))
    assert empty.count() == 0
    kept = decontam.filter_documents(table, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == table.columns and kept.count() == len(docs) - len(hits)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    rows = by_text(got)
    assert rows and rows == Counter(want.fetchall())

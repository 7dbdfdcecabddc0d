"""The whole pipeline on a small corpus against its stages by brute force, and line dedup on edge cases."""

import base64
import random
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("chimerant.llm")
import corpus_pipeline  # noqa: E402
from chimerant.llm import decontam, linededup, quality  # noqa: E402


def _lines_by_force(docs):
    """Texts without lines that an earlier line (by doc_id, then place) equals, or is within one word edit of."""
    seen, out = [], []
    for i, text in sorted(docs):
        kept, had = [], False
        for line in text.split("\n"):
            w = line.encode().split()
            near = w and any(w == o or (min(len(w), len(o)) >= linededup.MIN_WORDS and linededup.within_one(w, o)) for o in seen)
            if w:
                seen.append(w)
            had |= bool(near)
            if not near:
                kept.append(line)
        left = "\n".join(kept)
        if not had or left.split():
            out.append((i, left))
    return out


def _groups_by_force(docs):
    """The smallest document of each group of linked ones."""
    sets = []
    for _, t in docs:
        w = t.lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    up = list(range(len(docs)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(i, least.get(root(k), i))
    return [(i, t) for k, (i, t) in enumerate(docs) if i == least[root(k)]]


def test_pipeline(spark, tmp_path):
    import tiktoken

    r = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "zu") for c in ("n", "s", "r", "d", "l")]
    prose = lambda n: " ".join(r.choice(words) + (f"{r.randrange(40)}" if r.random() < 0.5 else "") for _ in range(n)) + "."
    bench = [(k, prose(14) + f" The answer is a{k} b{k}.") for k in range(3)]
    texts = [" ".join(prose(12) for _ in range(6)) for _ in range(12)] + ["\n".join(prose(15) for _ in range(5)) for _ in range(12)]
    texts += [texts[0], texts[1].replace(texts[1].split()[30], "other"), texts[14] + "\n" + texts[15].split("\n")[2], texts[16].replace(" ", "\n", 1)]
    texts += [prose(40) + " " + bench[1][1] + " " + prose(40), "# | % " * 60 + prose(60), "short", "", None, "same words here " * 50]
    edited = texts[2].split()
    edited[20], edited[50] = "x1", "x2"
    texts.append(" ".join(edited))
    docs = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    measures = {i: quality.measure(t or "") for i, t in docs}
    shares, bad = quality.fit(dict(Counter(quality.pattern_of(m) for m in measures.values())))
    good = [(i, t) for i, t in docs if not quality.base_failed(measures[i]) and quality.posterior(quality.votes_of(quality.pattern_of(measures[i])), shares, bad) >= 0.5]
    left = _groups_by_force(_lines_by_force(good))
    clean = []
    for i, t in left:
        w = decontam.words_of(t)
        hit = False
        for _, item in bench:
            b = decontam.words_of(item)
            for at in range(max(1, len(w))):
                share = decontam.lcs_length(b, part := w[at : at + 2 * len(b)]) / len(b)
                hit |= share >= decontam.MIN_LCS or (share >= decontam.PARAPHRASE and decontam.holds(part, decontam.answer_of(item)))
        if not hit:
            clean.append((i, t))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, list(x.ids)) for x in got) == sorted((i, ref.encode_ordinary(t)) for i, t in clean)
    assert len(docs) > len(good) > len(left) > len(clean) > 10 and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage.limit(0), str(tmp_path))
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"] and stage.count() == 0


def test_line_dedup_edges(spark):
    """Clashing columns, an empty table, a text of very many lines, repeated rows and ties, against brute force."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(14)]
    rows = []
    for k in range(30):
        lines = []
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(14)] = r.choice("xyz")
            if r.random() < 0.3:
                del w[r.randrange(len(w))]
            lines.append(" ".join(w[: r.choice([9, 13, 14])]))
        rows.append((k, "\n".join(lines)))
    rows.append((100, "\n".join(f"line {i} of a long text" for i in range(30_000))))
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS gone", "2 AS lines", "3 AS doc", "4 AS n_chars")
    kept = {x.doc_id: x.text for x in linededup.filter_documents(table).collect()}
    assert kept.pop(100) == rows[-1][1]
    assert sorted(kept.items()) == _lines_by_force(rows[:-1])
    assert linededup.filter_documents(table.limit(0)).columns == table.columns and linededup.dedup_lines(table.limit(0)).count() == 0

"""Substring dedup by relative Lempel-Ziv parsing of what documents share.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it occurs in a document with a
smaller doc_id too. The steps:

1. Of each window, the smallest hash among its runs of GRAM words (the leftmost, if equal) is its anchor. Equal windows
   have equal anchors. Consecutive windows with one anchor make a segment: their words, 2 * WINDOW - GRAM at most. So a
   document becomes one row for some 18 words: anchor, digest of the segment, doc_id.
2. Anchors of a single document need no more work. Segments that a smaller doc_id has as well are duplicates whole.
   What is left is the first document of each of several different segments under one anchor.
3. Those segments are dealt by anchor into reference blocks. A block is indexed by a suffix array (ranks by prefix
   doubling, and least doc_ids over ranges of it), and each of its segments is factored greedily against all segments of
   smaller doc_ids there: a factor is the longest match at its start.
4. A factor of WINDOW words or more is a duplicate span. A window that lies in no factor, but is a duplicate, has exactly one
   factor boundary inside: the factor that begins there reaches at least to the end of the window. So windows with one
   boundary inside are looked up in the index, and no others need to be.
5. Anchors of more than CROWD different segments (a passage in very many contexts) are dealt further, by the digest of each
   window; of these the least doc_id is an aggregate, whatever their number.

Each document meets every reference block that can hold one of its windows, and no other. Words are told apart by 64 bits;
segments by 128 (anchor and digest).

Defined results: null and empty texts have no words; rows without doc_id stay whole and remove nothing; rows that share a
doc_id are one document of several texts, so they remove nothing from each other; windows don't reach from one text into
another; a text shorter than a window stays; an empty table gives an empty table. The columns of the input stay, whatever
their names, in filter_documents(), which sets the text of the rows that lose words (kept words joined by one space).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerant.llm.common import cut, drop_table, join_hot
from chimerant.llm.ngram_join import Hashes

WINDOW, GRAM = 50, 16
#: Different segments of an anchor that one reference block may hold, and segments that a block holds on average.
CROWD, BLOCK = 1_000, 2_500
#: Longest match that the index tells: the sum of the powers of two that it ranks.
LEVELS = (1, 2, 4, 8, 16, 32)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BACK = np.uint64(pow(int(_A), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, digest, first word, windows) of each segment of a text's word hashes; gram is a power of two."""
    count = len(h) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    g, width = _mix(h), 1
    while width < gram:
        g = _mix(g[:-width] * _A + g[width:])
        width *= 2
    span, width, at = window - gram + 1, 1, np.arange(len(g))
    while width * 2 <= span:  # the leftmost smallest of each `width` grams
        a, b = at[:-width], at[width:]
        at, width = np.where(g[b] < g[a], b, a), width * 2
    a, b = at[:count], at[span - width : span - width + count]
    at = np.where(g[b] < g[a], b, a)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, count))
    sums = np.zeros(len(h) + 1, np.uint64)
    sums[1:] = np.cumsum(h * _powers(_A, len(h)))
    own = (sums[first + n - 1 + window] - sums[first]) * _powers(_BACK, len(h))[first]
    digest = _mix(_mix(own + (at[first] - first).astype(np.uint64) * _C) + n.astype(np.uint64))
    return g[at[first]].view(np.int64), digest.view(np.int64), first, n


def window_digests(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Digests of all windows of some word hashes."""
    sums = np.zeros(len(h) + 1, np.uint64)
    sums[1:] = np.cumsum(h * _powers(_A, len(h)))
    return _mix((sums[window:] - sums[:-window]) * _powers(_BACK, len(h))[: len(h) - window + 1]).view(np.int64)


class Reference:
    """The index of a reference block: a suffix array over the words of all its segments, each with its doc_id.

    longest() tells the longest match of the words at a place with words of a smaller doc_id, up to sum(LEVELS)."""

    def __init__(self, parts: list[np.ndarray], docs: np.ndarray):
        sizes = np.array([len(p) for p in parts])
        self.ends = np.cumsum(sizes + 1) - 1  # a separator of its own behind each segment
        self.starts = self.ends - sizes
        n = int(self.ends[-1]) + 1
        own = np.ones(n, bool)
        own[self.ends] = False
        words, ranks = np.unique(np.concatenate(parts), return_inverse=True)
        rank = np.empty(n, np.int64)
        rank[own], rank[self.ends] = ranks, len(words) + np.arange(len(parts))
        self.doc = np.full(n, np.iinfo(np.int64).max)
        self.doc[own] = np.repeat(docs, sizes)
        self.ranks = {}
        for width in LEVELS:
            self.ranks[width] = np.append(rank, -1)  # a place behind all words
            behind = np.full(n, -1)
            behind[: n - width] = rank[width:]
            rank = np.unique(rank * (n + 1) + behind + 1, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")
        self.order, self.place = order, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.least = [self.doc[order]]  # least doc_id of 1, 2, 4, ... entries of the suffix array from each on
        while 2 ** len(self.least) <= n:
            half = 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at, last = np.zeros(len(i), np.int64), len(self.doc)
        for width in reversed(LEVELS):
            rank = self.ranks[width]
            at += width * (rank[np.minimum(i + at, last)] == rank[np.minimum(j + at, last)])
        return at

    def longest(self, i: np.ndarray) -> np.ndarray:
        """Suffixes share the most words with their nearest neighbours in the array, so the nearest of smaller doc_ids will do."""
        doc, n, out = self.doc[i], len(self.doc), np.zeros(len(i), np.int64)
        low = self.place[i].copy()  # entries low .. place - 1 have no smaller doc_id
        high = self.place[i] + 1
        for level in range(len(self.least) - 1, -1, -1):
            step, least = 1 << level, self.least[level]
            ok = (low >= step) & (least[np.maximum(low - step, 0).clip(max=len(least) - 1)] >= doc)
            low -= step * ok
            ok = (high + step <= n) & (least[np.minimum(high, len(least) - 1)] >= doc)
            high += step * ok
        for near, there in ((low - 1, low > 0), (high, high < n)):
            out[there] = np.maximum(out[there], self._common(i[there], self.order[near[there]]))
        return out


def factors(ref: Reference) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the greedy factors of all segments; a word without a match is a factor of its own."""
    seg, at, found = np.arange(len(ref.starts)), ref.starts.copy(), []
    while len(seg):
        size = np.minimum(np.maximum(ref.longest(at), 1), ref.ends[seg] - at)
        found.append((seg, at, at + size))
        at = at + size
        more = at < ref.ends[seg]
        seg, at = seg[more], at[more]
    seg, start, end = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(start)
    return seg[order], start[order], end[order]


def duplicate_spans(parts: list[np.ndarray], docs: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, end) of the spans of words that windows of smaller doc_ids cover; spans may overlap."""
    if window > sum(LEVELS):
        raise ValueError("the index tells no matches of that length")
    ref = Reference(parts, docs)
    seg, start, end = factors(ref)
    whole = (end - start >= window) & (ref.longest(start) >= window)
    # Windows with one boundary inside: from a factor into the one that follows it.
    low, high = np.maximum(start[:-1], end[:-1] - window + 1), np.minimum(end[:-1] - 1, end[1:] - window)
    n = np.where(seg[:-1] == seg[1:], np.maximum(high - low + 1, 0), 0)
    begin = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner = np.repeat(seg[:-1], n)
    good = ref.longest(begin) >= window
    owner, begin = owner[good], begin[good]
    new = np.flatnonzero(np.concatenate([[True], (begin[1:] != begin[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(begin) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(begin)) - 1 if len(new) else new
    s = np.concatenate([seg[whole], owner[new]])
    return s, np.concatenate([start[whole], begin[new]]) - ref.starts[s], np.concatenate([end[whole], begin[last] + window]) - ref.starts[s]


def _anchors(plain: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, id, doc): the different segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key, digest, _, _ = segments(word_hashes((text.as_py() or "").encode().split(), known), window, gram)
                if len(key):
                    _, once = np.unique(digest, return_index=True)
                    out.append((key[once], digest[once], np.full(len(once), doc)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "id", "doc"])

    return plain.filter("doc IS NOT NULL").mapInArrow(run, "key long, id long, doc long")


_CONTENT = "key long, id long, doc long, at int, w long, words binary"


def _content(plain: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """The words of the segments in `wanted` (doc, ids, crowded): one row each, or for crowded ones a row for each window."""
    target = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("w", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            for doc, text, ids, crowded in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                h = word_hashes((text.as_py() or "").encode().split(), known)
                key, digest, first, n = segments(h, window, gram)
                rows: list[list] = [[] for _ in target]
                often = set(crowded.as_py())
                put = lambda *x: [c.append(v) for c, v in zip(rows, x, strict=True)]
                sought = np.array(ids.as_py(), np.int64)
                held, seen = np.isin(digest, sought), set()
                for i in np.flatnonzero(held).tolist():
                    d = int(digest[i])
                    if d in seen:
                        continue
                    seen.add(d)
                    own = h[first[i] : first[i] + n[i] - 1 + window]
                    if d in often:
                        for at, w in enumerate(window_digests(own, window).tolist()):
                            put(int(key[i]), d, doc, at, w, None)
                    else:
                        put(int(key[i]), d, doc, -1, 0, own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, target, strict=True)], schema=target)

    return plain.join(wanted.hint("merge"), "doc").select("doc", "text", "ids", "crowded").mapInArrow(run, _CONTENT)


def _parse(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, docs = table.column("id").to_numpy(), table.column("doc").to_numpy()
        parts = [np.frombuffer(w.as_py(), np.uint64) for w in table.column("words")]
        seg, low, high = duplicate_spans(parts, docs, window)
        return pa.table([pa.array(docs[seg]), pa.array(ids[seg]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["doc", "id", "lo", "hi"])

    return run


def duplicate_segments(plain: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, id, lo, hi): words lo .. hi - 1 (hi null: all) of the document's segments with that digest go; and the tables that this reads.

    plain has doc and text."""
    anchors = cut(_anchors(plain, window, gram), "substring-anchors")
    keys = anchors.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("last"), F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("k"))
    keys = cut(keys.filter("lo < last").select("key", "lo", (F.col("a") != F.col("b")).alias("mixed"), "k"), "substring-keys")
    shared = cut(join_hot(anchors, keys, "key", "k").select("key", "id", "doc", "lo", "mixed"), "substring-shared")
    drop_table(anchors)
    drop_table(keys)
    nothing = F.lit(None).cast("int")
    whole = lambda rows: rows.select("doc", "id", F.lit(0).alias("lo"), nothing.alias("hi"))
    plainly = whole(shared.filter("NOT mixed AND doc > lo"))

    several = shared.filter("mixed").select("key", "id", "doc")
    classes = cut(several.groupBy("key", "id").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("k")), "substring-classes")
    repeated = whole(join_hot(several, classes.filter("k > 1"), ["key", "id"], "k").filter("doc > first"))
    sizes = cut(classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "substring-sizes")
    firsts = join_hot(classes.select("key", "id", F.col("first").alias("doc")), sizes, "key", "c")
    wanted = firsts.groupBy("doc").agg(F.collect_list("id").alias("ids"), F.collect_list(F.when(F.col("c") > crowd, F.col("id"))).alias("crowded"))
    content = cut(_content(plain, wanted, window, gram), "substring-content")
    parts = 1 + content.filter("at < 0").count() // block
    dealt = content.filter("at < 0").select("key", "id", "doc", "words", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    parsed = cut(dealt.groupBy("part").applyInArrow(_parse(window), "doc long, id long, lo int, hi int"), "substring-parsed")

    crowded = content.filter("at >= 0").select("key", "id", "doc", "at", "w")
    least = cut(crowded.groupBy("key", "w").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("k")).filter("first < last"), "substring-windows")
    split = join_hot(crowded, least, ["key", "w"], "k").filter("doc > first").select("doc", "id", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    drop_table(sizes)
    return plainly.union(repeated).union(parsed).union(split), [shared, classes, content, parsed, least]


def _gone(text: str, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: Hashes, window: int, gram: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and which of them go."""
    words = text.encode().split()
    _, digest, first, n = segments(word_hashes(words, known), window, gram)
    order = np.argsort(digest, kind="stable")
    begin, end = (np.searchsorted(digest[order], ids, side) for side in ("left", "right"))
    many = end - begin  # places of each segment in this text
    at = order[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    low, high = np.repeat(lo, many), np.repeat(hi, many)
    high = np.where(high < 0, n[at] - 1 + window, high)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, first[at] + low, 1)
    np.add.at(edges, first[at] + high, -1)
    return words, np.cumsum(edges[:-1]) > 0


def _marked(docs: DataFrame, doc_id: str, text: str, window: int, gram: int, crowd: int = CROWD, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """The rows of docs with the columns c0, c1, ... for their own and `ids`, `lo`, `hi` of the spans that go."""
    names = list(docs.columns)
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    d, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    keyed = own.withColumn("doc", F.col(d).cast("long"))
    spans, tables = duplicate_segments(keyed.select("doc", F.col(t).cast("string").alias("text")), window, gram, crowd, block)
    lists = spans.groupBy("doc").agg(F.collect_list("id").alias("ids"), F.collect_list("lo").alias("lo"), F.collect_list(F.coalesce("hi", F.lit(-1))).alias("hi"))
    lists = cut(lists, "substring-spans")
    for table in tables:
        drop_table(table)
    return keyed.join(lists.hint("merge"), "doc", "left"), names


def _mask(row: tuple, known: Hashes, window: int, gram: int) -> tuple[list[bytes], np.ndarray]:
    text, ids, lo, hi = (x.as_py() for x in row)
    if not ids:
        words = (text or "").encode().split()
        return words, np.zeros(len(words), bool)
    return _gone(text or "", *(np.array(x, np.int64) for x in (ids, lo, hi)), known, window, gram)


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the duplicate spans taken out of their texts, without the documents that lose all their words by that."""
    rows, names = _marked(docs, doc_id, text, window, gram)
    t = names.index(text)
    schema = T.StructType([*(rows.schema[f"c{i}"] for i in range(len(names))), T.StructField("gone", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            columns, texts, gone = list(batch.columns[: len(names)]), [], []
            for row in zip(columns[t], *batch.columns[len(names) :], strict=True):
                words, out = _mask(row, known, window, gram)
                texts.append(b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x).decode() if out.any() else row[0].as_py())
                gone.append(-1 if len(words) and out.all() else int(out.sum()))
            columns[t] = pa.array(texts, columns[t].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], schema.names)

    left = rows.select(*[f"c{i}" for i in range(len(names))], "ids", "lo", "hi").mapInArrow(run, schema)
    return left.filter("gone >= 0").drop("gone").toDF(*names)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and spans (from word, to word) of what goes."""
    rows, _ = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text", window, gram, crowd, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known = Hashes()
        for batch in batches:
            sizes, removed, digests, spans = [], [], [], []
            for row in zip(*batch.columns[1:], strict=True):
                words, out = _mask(row, known, window, gram)
                sizes.append(len(words))
                removed.append(int(out.sum()))
                kept = [w for w, x in zip(words, out.tolist(), strict=True) if not x] if removed[-1] else words
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                spans.append(edges.reshape(-1, 2).tolist())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return rows.select("c0", "c1", "ids", "lo", "hi").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>")

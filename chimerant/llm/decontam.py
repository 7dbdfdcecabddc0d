"""Benchmark decontamination by latent semantic retrieval, then longest common subsequence and answer checks.

1. Words (lower case, hashed into SLOTS) get the weight ln(1 + N / (1 + df)) from the document frequencies of the whole corpus.
2. Randomised SVD: the rows are all passages of PASSAGE words, the benchmark's and those of all documents, the columns the
   benchmark's words, since no other word moves a cosine's numerator. One pass, a sum over distributed rows, gives a random
   sketch of their Gram matrix, and Nystroem's method from that one latent basis, whose rank stays below half the number of passages: words that stand in the same
   passages share dimensions. The benchmark's rows are scaled to weigh as much together as the documents', or the few would
   have no dimensions beside the many. Words are hashed once, into a stored table that the frequencies and the fit read.
3. Every window of WINDOW words, half of it apart, is projected, and the items that have a latent cosine of MIN_COSINE or
   more with it in a passage are candidates there. The cosine is taken over the words that the benchmark knows, so neither
   the words around a passage nor the passage's own frequency in the corpus keep it from being found. No other search finds any: what the basis doesn't bring near is not found
   (tests hold the recall against a search of all stretches of all documents). Items of which a document
   or the region around its windows holds fewer words than any accepted alignment has are not compared with it, which loses nothing.
4. For candidates, the words around are aligned with the item's: a document is contaminated if the longest common
   subsequence has MIN_LCS of the item's words, or if it has PARAPHRASE of them and the answer (the item's last
   sentence) stands there word for word.

Words are hashed from the bytes of whole Arrow columns; only texts with candidates are split into words.

The benchmark is read in blocks of about BLOCK_PASSAGES passages, ROUND blocks at a time, so what is sent to executors is
bounded whatever its size; more than one round means a pass over the documents for each.

Defined results: null and empty texts are clean; an item without words finds nothing; repeated rows give repeated
results; an empty benchmark leaves all clean; an empty table gives an empty table. filter_documents() keeps the columns
of the input, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerant.llm.common import cut, drop_table

SLOTS, SLICES = 1 << 18, 64
WINDOW, PASSAGE = 32, 64
RANK, EXTRA = 192, 16
BLOCK_PASSAGES, ROUND = 256, 4
#: Passages of which the fit makes one matrix, and bytes of all partial sums of it.
TOGETHER, PARTIAL_BYTES = 256, 4 << 30
MIN_COSINE, MIN_LCS, PARAPHRASE = 0.25, 0.8, 0.6


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def slots_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (SLOTS - 1)


#: Bytes as words are told apart by: lower case, all white space a blank; the CRC-32 of each last byte; longer words go one by one.
FOLDED = bytes(0x20 if bytes([i]).isspace() else bytes([i]).lower()[0] for i in range(256))
CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.int64)
LONG_WORD, TEXTS = 32, 128


def _joined_slots(texts: pa.Array) -> list[np.ndarray]:
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return [np.zeros(0, np.int32)] * len(texts)
    data = np.frombuffer(bytes(texts.buffers()[2][int(ends[0]) : int(ends[-1])]).translate(FOLDED), np.uint8)
    ends = ends - ends[0]
    word = data != 0x20
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    bounds = np.flatnonzero(edge)
    inner = ends[(ends > 0) & (ends < len(data))]
    if len(touch := np.unique(inner[word[inner] & word[inner - 1]])):  # a text ends with a word and the next begins with one
        bounds = np.sort(np.concatenate([bounds, touch, touch]))
    begins, sizes = bounds[::2], bounds[1::2] - bounds[::2]
    short = np.minimum(sizes, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    at, upto = begins[order], np.cumsum(np.bincount(short, minlength=LONG_WORD + 1))
    crc = np.full(len(at), 0xFFFFFFFF, np.int64)
    for j in range(int(short.max(initial=0))):
        left = crc[upto[j] :]  # of the words with more than j bytes
        last = (left ^ data[at[upto[j] :] + j]) & 0xFF
        left >>= 8
        left ^= CRC[last]
    slots = np.empty(len(at), np.int32)
    slots[order] = ~crc & (SLOTS - 1)
    for i in np.flatnonzero(sizes > LONG_WORD):
        slots[i] = zlib.crc32(data[begins[i] : begins[i] + sizes[i]]) & (SLOTS - 1)
    cuts = np.searchsorted(begins, ends)
    return [slots[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def text_slots(texts: pa.Array) -> Iterator[np.ndarray]:
    """slots_of(words_of(text)) as int32 for each text of the column, made from the bytes of TEXTS texts at a time."""
    for at in range(0, len(texts), TEXTS):
        yield from _joined_slots(texts.slice(at, TEXTS).cast(pa.large_string()).fill_null(""))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for p in filter(None, map(places.get, b)):
        u = row & p
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return words_of(parts[-1]) if parts else []


def least_of(share: float, n: int) -> int:
    """The smallest k, 1 at least, with k / n of `share` or more."""
    return next(k for k in range(max(1, int(share * n) - 1), n + 3) if k >= share * n or k / max(1, n) >= share)


def holds(words: list, part: list) -> bool:
    n = len(part)
    return bool(n) and any(words[i : i + n] == part for i in range(len(words) - n + 1) if words[i] == part[0])


def _packed_sum(df: DataFrame, size: int) -> np.ndarray:
    """The sum of packed float64 vectors (slice, v) by slice; `size` entries reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py(), np.float64) for v in table.column("v")], axis=0)
        return pa.table([[table.column("slice")[0].as_py()], [total.tobytes()]], schema=pa.schema([("slice", pa.int32()), ("v", pa.binary())]))

    out = np.zeros(size)
    width = -(-size // SLICES)
    for r in df.groupBy("slice").applyInArrow(add, "slice int, v binary").collect():
        v = np.frombuffer(r["v"], np.float64)
        out[r["slice"] * width : r["slice"] * width + len(v)] = v
    return out


def _slices(v: np.ndarray) -> pa.RecordBatch:
    width = -(-len(v) // SLICES)
    parts = [v[i * width : (i + 1) * width].astype(np.float64).tobytes() for i in range(SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "v"])


def slots_table(texts: DataFrame) -> DataFrame:
    """(text) to (slots): the slots of each text's words, packed as int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in text_slots(batch.column(0))], pa.binary())], ["slots"])

    return texts.select("text").mapInArrow(run, "slots binary")


def document_frequencies(slots: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold a word of each slot, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, last = np.zeros(SLOTS + 1), 0, np.zeros(SLOTS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                slots = np.frombuffer(value.as_buffer(), np.int32)
                place = np.arange(len(slots))
                last[slots] = place  # the last place of each slot, so every slot is counted there alone
                df[slots[last[slots] == place]] += 1
                n += 1
        df[SLOTS] = n
        yield _slices(df)

    sums = _packed_sum(slots.mapInArrow(run, "slice int, v binary"), SLOTS + 1)
    return sums[:SLOTS], int(sums[SLOTS])


def passage_rows(batch: pa.RecordBatch, column: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, scale) to (columns, rows): weighted passages, of length `scale`, TOGETHER at a time, over the columns that stand in them."""
    texts, scale = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
    sizes = np.array([len(t) // 4 for t in texts], np.int64)
    slots = np.frombuffer(b"".join(texts), np.int32)
    n = -(-sizes // PASSAGE)
    place = np.arange(len(slots)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.cumsum(n) - n, sizes) + place // PASSAGE
    w = weight[slots]
    length = np.sqrt(np.bincount(row, w * w, int(n.sum())))
    known = (column[slots] >= 0) & (w > 0)
    row, used, w = row[known], column[slots[known]], w[known]
    x = (w / length[row] * np.repeat(scale, n)[row]).astype(np.float32)
    ends = np.searchsorted(row, np.arange(0, int(n.sum()) + TOGETHER, TOGETHER))
    place = np.zeros(int(column.max(initial=-1)) + 1, np.int64)
    for k, (begin, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if begin < end:
            held = np.zeros(len(place), bool)
            held[used[begin:end]] = True
            columns = np.flatnonzero(held)
            place[columns] = np.arange(len(columns))
            at = place[used[begin:end]]
            rows = np.zeros(TOGETHER * len(columns), np.float32)
            np.add.at(rows, (row[begin:end] - k * TOGETHER) * len(columns) + at, x[begin:end])
            yield columns, rows.reshape(TOGETHER, -1)


def fit_basis(slots: DataFrame, column: np.ndarray, weight: np.ndarray, n_columns: int, rank: int = RANK) -> np.ndarray:
    """Latent basis of all passages of the texts (slots, scale) over the columns that `column` gives each slot (-1: none): columns x rank.

    G being the product of the transposed passages with themselves and W random, one pass gives Y = G W, and the leading
    eigenvectors of Y inv(W' Y) Y', Nystroem's approximation of G, are the basis; where r is n_columns it is G itself."""
    r = min(rank + EXTRA, n_columns)
    sc = slots.sparkSession.sparkContext
    sketch = np.linalg.qr(np.random.default_rng(0).standard_normal((n_columns, r)))[0].astype(np.float32)
    shared = sc.broadcast((column, weight, sketch))
    dealt = slots.coalesce(max(1, PARTIAL_BYTES // (8 * n_columns * r)))  # each task sends a partial sum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (col, w, b), total = shared.value, np.zeros((n_columns, r))
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                for columns, rows in passage_rows(batch.slice(at, 1_024), col, w):
                    total[columns] += rows.T @ (rows @ b[columns])
        yield _slices(total.ravel())

    y = _packed_sum(dealt.mapInArrow(run, "slice int, v binary"), n_columns * r).reshape(n_columns, r)
    shared.destroy()
    inner = sketch.T.astype(float) @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * max(values.max(), 1e-9)  # what is left below comes from rounding
    left, sizes, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank][:, sizes[:rank] ** 2 > 1e-9].astype(np.float32)


class Searcher:
    """Finds the items of one block in texts. Rows of the block are (item, place, passage)."""

    def __init__(self, block: list[tuple[int, int, str]], column: np.ndarray, weight: np.ndarray, basis: np.ndarray, min_cosine: float, min_lcs: float, paraphrase: float):
        self.column, self.weight = column, weight
        self.min_cosine, self.min_lcs, self.paraphrase = min_cosine, min_lcs, paraphrase
        texts: dict[int, list[str]] = {}
        for item, _, passage in sorted(block):
            texts.setdefault(item, []).append(passage)
        self.ids = list(texts)
        self.words = [words_of(" ".join(texts[i])) for i in self.ids]
        self.answers = [answer_of("\n".join(texts[i])) for i in self.ids]
        at = {i: k for k, i in enumerate(self.ids)}
        self.item_of = np.array([at[i] for i, _, _ in sorted(block)], np.int64)
        rows = []
        for _, _, passage in sorted(block):
            s = slots_of(words_of(passage))
            v = weight[s] @ basis[column[s]]
            rows.append(v / max(1e-9, np.linalg.norm(v)))
        #: Latent cosines are linear in a window's words: what each word adds to the product with each passage.
        self.adds = (basis @ np.array(rows, np.float32).T) if rows else np.zeros((len(basis), 0), np.float32)
        #: How often each item holds each word, and how many of its words an accepted alignment has at least.
        self.counts = np.zeros((len(basis), len(self.ids)), np.int32)
        for k, item in enumerate(self.words):
            np.add.at(self.counts[:, k], column[slots_of(item)], 1)
        self.need = np.array([least_of(min(paraphrase, min_lcs), len(item)) for item in self.words], np.int64)

    def common(self, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        """How many words of each item stand among these, repeats included: no alignment with them is longer."""
        own = np.bincount(rows, minlength=len(self.counts))
        held = np.flatnonzero(own)
        return np.minimum(own[held, None], self.counts[np.ix_(held, items)]).sum(axis=0)

    def candidates(self, slots: np.ndarray) -> dict[int, tuple[float, list[tuple[int, int]]]]:
        """Item to its best cosine and the regions (begin, end) to align, for all items that the document of these slots may hold."""
        rows = self.column[slots]
        used = np.flatnonzero(rows >= 0)
        held = np.zeros(len(self.counts), bool)
        held[rows[used]] = True
        able = self.counts.take(np.flatnonzero(held), axis=0).sum(axis=0, dtype=np.int32) >= self.need
        if able.any():
            items = np.flatnonzero(able)
            able[items] = self.common(rows[used], items) >= self.need[items]
        if not able.any():
            return {}
        w = self.weight[slots]
        n = len(slots)
        starts = np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)
        ends = np.minimum(starts + WINDOW, n)
        energy = np.zeros(n + 1)  # of the words that the block knows
        np.cumsum(np.where(rows >= 0, w * w, 0.0), dtype=float, out=energy[1:])
        whole = np.maximum(energy[ends] - energy[starts], 1e-18)
        first, last = np.searchsorted(used, starts), np.searchsorted(used, ends)
        columns = np.flatnonzero(able[self.item_of])
        cosines, near = dict.fromkeys(np.flatnonzero(able).tolist(), 0.0), {}
        for at in range(0, len(starts), 128):
            own = slice(at, at + 128)
            low, high = int(first[own][0]), int(last[own][-1])
            part = used[low:high]
            sums = np.zeros((len(part) + 1, len(columns)), np.float32)
            np.cumsum(self.adds[np.ix_(rows[part], columns)] * w[part][:, None], axis=0, out=sums[1:])
            cosine = (sums[last[own] - low] - sums[first[own] - low]) / np.sqrt(whole[own])[:, None]
            for k, best in enumerate(cosine.max(axis=0)):
                i = int(self.item_of[columns[k]])
                cosines[i] = max(cosines[i], float(best))
            hits = cosine >= self.min_cosine
            for k in np.flatnonzero(hits.any(axis=0)):
                j = np.flatnonzero(hits[:, k])
                i, begin, end = int(self.item_of[columns[k]]), int(starts[at + j[0]]), int(ends[at + j[-1]])
                a, b = near.get(i, (begin, end))
                near[i] = (min(a, begin), max(b, end))
        out = {}
        for i, (begin, end) in near.items():
            begin, end = max(0, begin - len(self.words[i])), end + len(self.words[i])
            if self.common(rows[begin:end][rows[begin:end] >= 0], np.array([i]))[0] >= self.need[i]:
                out[i] = (cosines[i], [(begin, end)])
        return out

    def best(self, text: pa.StringScalar, slots: np.ndarray) -> tuple[int, float, float, bool] | None:
        """(item, share of its words aligned, cosine, answer found) of the best contamination, or None; slots are the text's."""
        if not len(slots) or not self.ids or not (found := self.candidates(slots)):
            return None
        words, out = words_of(text.as_py()), None
        for i, (cosine, regions) in found.items():
            item = self.words[i]
            for begin, end in regions:
                region = words[begin:end]
                share = lcs_length(item, region) / len(item)
                if share < min(self.paraphrase, self.min_lcs):
                    continue
                answer = holds(region, self.answers[i])
                if (share >= self.min_lcs or (share >= self.paraphrase and answer)) and (out is None or (share, -self.ids[i]) > (out[1], -out[0])):
                    out = (self.ids[i], share, cosine, answer)
        return out


def _passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, place, text): items in passages of PASSAGE words, line ends kept between sentences' lines."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND trim(coalesce(text, '')) <> ''")
    words = F.split(F.regexp_replace("text", r"\s*\n\s*", "\n "), r"[ \t]+")
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / PASSAGE).cast("int")), lambda i: F.array_join(F.slice(words, i * PASSAGE + 1, PASSAGE), " "))
    return items.select("item_id", F.posexplode(steps).alias("place", "text"))


def search(docs: DataFrame, doc_id: str, text: str, benchmark: DataFrame, min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, paraphrase: float = PARAPHRASE) -> DataFrame:
    """docs with four more columns: item, lcs, cosine, answer (null where clean)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    passages = _passages(benchmark)
    count = passages.count()
    n_blocks = -(-count // BLOCK_PASSAGES)
    if count:
        corpus, bench = cut(slots_table(plain), "leak-slots"), slots_table(passages)
        df, n_docs = document_frequencies(corpus)
        weight = np.log1p(n_docs / (1.0 + df)).astype(np.float32)
        known = np.flatnonzero(document_frequencies(bench)[0])
        columns = np.full(SLOTS, -1, np.int32)
        columns[known] = np.arange(len(known))
        n_passages = corpus.agg(F.sum(F.ceil(F.length("slots") / (4 * PASSAGE)))).first()[0] or 0
        even = float(np.sqrt(max(1, int(n_passages)) / count))
        rows = corpus.withColumn("scale", F.lit(1.0)).union(bench.withColumn("scale", F.lit(even)))
        basis = fit_basis(rows, columns, weight, len(known), min(RANK, max(1, (count + int(n_passages)) // 2)))
        drop_table(corpus)
    at, names = docs.columns.index(text), ["item", "lcs", "cosine", "answer"]
    out = docs.withColumns({n: F.lit(None).cast(t) for n, t in zip(names, ("long", "double", "double", "boolean"), strict=True)})
    schema = T.StructType([*docs.schema.fields, T.StructField("item", T.LongType()), T.StructField("lcs", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("answer", T.BooleanType())])

    def pass_over(table: DataFrame, sent: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finders = [Searcher(*b.value, min_cosine, min_lcs, paraphrase) for b in sent]
            for batch in batches:
                best = []
                for value, slots, *before in zip(batch.column(at), text_slots(batch.column(at)), *(c.to_pylist() for c in batch.columns[-4:]), strict=True):
                    found = [x for f in finders if (x := f.best(value, slots))] + ([tuple(before)] if before[0] is not None else [])
                    best.append(max(found, key=lambda x: (x[1], -x[0])) if found else (None,) * 4)
                columns = list(zip(*best, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], schema.names)

        return table.mapInArrow(run, schema)

    for begin in range(0, n_blocks, ROUND):
        sent = []
        for k in range(begin, min(n_blocks, begin + ROUND)):
            own = passages.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
            block = sorted((r["item_id"], r["place"], r["text"]) for r in own.collect())
            if not block:
                continue
            used = np.unique(slots_of([w for _, _, t in block for w in words_of(t)]))
            column = np.full(SLOTS, -1, np.int32)
            column[used] = np.arange(len(used))
            sent.append(spark.sparkContext.broadcast((block, column, weight, basis[columns[used]])))
        done = pass_over(out, sent)
        out = done if begin + ROUND >= n_blocks else cut(done, "leaks")  # the next round's blocks take the place of these
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **thresholds: float) -> DataFrame:
    """Per document: doc_id, contaminated, item_id, lcs, cosine, answer_found."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = search(plain, "doc_id", "text", benchmark, **thresholds)
    return found.select("doc_id", F.col("item").isNotNull().alias("contaminated"), F.col("item").alias("item_id"), "lcs", "cosine", F.col("answer").alias("answer_found"))


def filter_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds: float) -> DataFrame:
    """The clean rows of docs, with all their columns."""
    marked = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = search(marked, f"c{docs.columns.index(doc_id)}", f"c{docs.columns.index(text)}", benchmark, **thresholds)
    return found.filter("item IS NULL").select(*marked.columns).toDF(*docs.columns)

"""Line dedup over a whole corpus by a deletion-neighbourhood join.

Lines are compared as sequences of words. Equal lines, and lines of MIN_WORDS words or more that are within one word
edit (a word put in, left out or replaced), are duplicates; a line goes if any earlier line (by doc_id, then place)
is a duplicate of it. The steps:

1. Equal lines meet by a 128-bit hash; the earliest place stays.
2. Every distinct long line emits the hashes of its first and last 2^k words, 2^(k+1) being at most its length: an edit
   leaves one of the two whole. Only lines that share such a half with another line can have a near duplicate. (Lines
   whose length is a power of two, or one less, emit the halves of the neighbouring class as well.) This is a lossless
   filter, without which every line would emit as many variants as it has words.
3. These lines emit the hashes of themselves without each of GAPS stretches of words, once for the length of the longer
   line of a pair being their own and once for its being one more: an edit lies in one of the stretches, and all around
   it is equal. Only lines that share such a hash stay, and only a stretch that is shared can hold the edit (lossless too).
4. What is left emits the variants within the bound as hashed keys: the line, and the line without each one word of its
   shared stretches. Equal variants meet by aggregation, whatever their number: per key the earliest whole line, and per
   key and place of the deletion the earliest line. A line's partners are the earliest of those that the bound allows.
5. The edit distance of each line and its partner is verified on the words. If hashes have collided, the line stays.

Defined results: lines without words stay as they are and are duplicates of nothing; null texts stay null; rows without
doc_id stay as they are and remove nothing; rows that share a doc_id are one document with several texts, ordered by
text; a document that loses all its lines has the empty text, and filter_documents() leaves it out; an empty table gives an empty table. The columns of the
input stay, whatever their names; filter_documents() sets the text and, where the table has it, n_chars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chimerant.llm.common import cut, drop_table

MIN_WORDS = 10
GAPS = 8
#: Variants in one Arrow batch, but for those of the last line.
TOGETHER = 1 << 16
MULTIPLIER = 0x9E3779B97F4A7C15


def within_one(a: list, b: list) -> bool:
    """Whether two word sequences are at most one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def halves(words: list[bytes]) -> list[int]:
    """Hashes of first and last halves, for each class of lengths that a line one edit away can have."""
    import xxhash

    n, out = len(words), []
    for k in {(m.bit_length() - 1) for m in (n - 1, n, n + 1)}:
        h = 1 << (k - 1)
        if h <= n:
            out += [_signed(xxhash.xxh3_64_intdigest(b"%d<" % h + b" ".join(words[:h]))), _signed(xxhash.xxh3_64_intdigest(b"%d>" % h + b" ".join(words[-h:])))]
    return out


def gaps(n: int) -> list[tuple[int, int]]:
    """The stretches (begin, end) that n words are cut in."""
    cuts = [n * j // GAPS for j in range(GAPS + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def gap_keys(words: list[bytes]) -> list[tuple[int, int]]:
    """(gap, hash of the words around it): of the line's own stretches, then, as gap -1, of those of a line with one word more."""
    import xxhash

    n, whole = len(words), b" ".join(words)
    begins = [0, *accumulate(len(w) + 1 for w in words)]
    out = []
    for m in (n, n + 1):
        for j, (a, b) in enumerate(gaps(m)):
            around = whole[: begins[a]] + b"\n" + whole[begins[n - m + b] :]
            out.append((j if m == n else -1, _signed(xxhash.xxh3_64_intdigest(around, m * GAPS + j))))
    return out


def variants(words: list[bytes]) -> np.ndarray:
    """Keys of the line and of the line without word 0, 1, ...: polynomial hashes, all in time linear in the words."""
    import xxhash

    n = len(words)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, n)
    power = np.ones(n + 1, np.uint64)
    power[1:] = np.cumprod(np.full(n, MULTIPLIER, np.uint64))
    left = np.zeros(n + 1, np.uint64)  # of the first i words, each times the power of its place
    left[1:] = np.cumsum(h * power[:n])
    right = np.zeros(n + 1, np.uint64)  # of the words from i on, each times the power of the place before its own
    right[1:n] = (np.cumsum((h[1:] * power[: n - 1])[::-1])[::-1]) if n > 1 else right[1:n]
    gone = left[:n] + np.concatenate([right[1:n], np.zeros(1, np.uint64)])
    keys = np.concatenate([left[n:], gone])
    sizes = np.full(n + 1, n - 1, np.uint64)
    sizes[0] = n
    return (keys ^ (sizes * np.uint64(0xC2B2AE3D27D4EB4F))).view(np.int64)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with words: doc, row (of the document's texts), line, hash, n words, halves."""
    schema = "doc long, row int, line int, hash binary, n int, halves array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        target = pa.schema([("doc", pa.int64()), ("row", pa.int32()), ("line", pa.int32()), ("hash", pa.binary()), ("n", pa.int32()), ("halves", pa.list_(pa.int64()))])
        for batch in batches:
            out: list[list] = [[] for _ in target]
            docs_out, rows_out, places, hashes, sizes, both = out
            for doc, row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, line in enumerate((value.as_py() or "").encode().split(b"\n")):
                    if words := line.split():
                        n = len(words)
                        docs_out.append(doc)
                        rows_out.append(row)
                        places.append(i)
                        hashes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        sizes.append(n)
                        both.append(halves(words) if n >= MIN_WORDS else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return docs.mapInArrow(run, schema)


def _wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, row, line, words) of the places in wanted: doc, row, wanted array of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, row, value, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                lines = value.as_py().split("\n")
                rows += [(doc, row, i, lines[i]) for i in places]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc", "row", "line", "words"])

    return docs.join(wanted.hint("merge"), ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(run, "doc long, row int, line int, words string")


def _gap_rows(lines: DataFrame) -> DataFrame:
    """(doc, row, line, gap, key): what gap_keys gives for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gap_keys(value.as_py().encode().split()) for value in batch.column(3)]
            own = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            flat = [pa.array([x[k] for rows in found for x in rows], t) for k, t in ((0, pa.int32()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in range(3)), *flat], ["doc", "row", "line", "gap", "key"])

    return lines.select("doc", "row", "line", "words").mapInArrow(run, "doc long, row int, line int, gap int, key long")


def _variant_rows(lines: DataFrame) -> DataFrame:
    """Variants of lines: the key of the whole line (at -1) and of the line without the word `at`, for the words in its gaps."""

    def packed(rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(r[3]) for r in rows]
        places = [pa.array(np.repeat(np.array([r[k] for r in rows], t), sizes)) for k, t in enumerate((np.int64, np.int32, np.int32))]
        return pa.RecordBatch.from_arrays([*places, *(pa.array(np.concatenate([r[k] for r in rows])) for k in (3, 4))], ["doc", "row", "line", "at", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n = [], 0
            for doc, row, line, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                keys, parts = variants(words), gaps(len(words))
                at = np.concatenate([[-1], *(np.arange(*parts[g]) for g in own if g >= 0)]).astype(np.int32)
                rows.append((doc, row, line, at, keys[at + 1]))
                n += len(at)
                if n >= TOGETHER:
                    yield packed(rows)
                    rows, n = [], 0
            if rows:
                yield packed(rows)

    return lines.select("doc", "row", "line", "words", "gaps").mapInArrow(run, "doc long, row int, line int, at int, key long")


def removed_lines(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, row, line, near) of the lines to be removed, and the tables that this reads; docs has doc (not null), row and text."""
    lines = cut(_lines(docs), "lines")
    place = F.struct("doc", "row", "line")
    first = cut(lines.groupBy("hash").agg(F.min(place).alias("p"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("copies")), "lines-first")
    equal = lines.join(first.filter("copies > 1").select("hash", "p"), "hash").filter(place != F.col("p")).select("doc", "row", "line", F.lit(False).alias("near"))

    half = first.select("p.*", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    wanted = half.join(shared, "half", "left_semi").groupBy("doc", "row").agg(F.collect_set("line").alias("wanted"))
    texts = cut(_wanted_lines(docs, wanted), "lines-texts")
    around = cut(_gap_rows(texts), "lines-gaps")
    met = around.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    own = around.join(met, "key", "left_semi").groupBy("doc", "row", "line").agg(F.collect_set("gap").alias("gaps"))
    keys = cut(_variant_rows(texts.join(own, ["doc", "row", "line"])), "lines-variants")
    drop_table(around)

    # Whole lines (at = -1) meet deletions of any place; deletions meet those of the same place, which is a replaced word.
    by_place = keys.groupBy("key", "at").agg(F.min(place).alias("e"), F.count(F.lit(1)).alias("k")).filter("k > 1 AND at >= 0")
    whole = keys.filter("at < 0").groupBy("key").agg(F.min(place).alias("e"))
    shorter = keys.filter("at >= 0").groupBy("key").agg(F.min(place).alias("e"))
    pairs = (
        keys.join(by_place.select("key", "at", "e"), ["key", "at"]).select("doc", "row", "line", "e")
        .union(keys.filter("at >= 0").join(whole, "key").select("doc", "row", "line", "e"))
        .union(keys.filter("at < 0").join(shorter, "key").select("doc", "row", "line", "e"))
        .filter(F.col("e") < place).distinct()
    )
    pairs = pairs.select("doc", "row", "line", F.col("e.doc").alias("edoc"), F.col("e.row").alias("erow"), F.col("e.line").alias("eline"))
    earlier = texts.select(F.col("doc").alias("edoc"), F.col("row").alias("erow"), F.col("line").alias("eline"), F.col("words").alias("ewords"))
    both = pairs.join(texts, ["doc", "row", "line"]).join(earlier, ["edoc", "erow", "eline"]).select("doc", "row", "line", F.lit(True).alias("near"), "words", "ewords")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a.as_py().encode().split(), b.as_py().encode().split()) for a, b in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    near = both.mapInArrow(verify, "doc long, row int, line int, near boolean").distinct()
    # All copies of a near duplicate go: its first one here, the others as equal lines.
    return equal.union(near), [lines, first, texts, keys]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows of docs with the columns c0, c1, ... for their own, `lines` and `gone` (line places), and the names."""
    names = list(docs.columns)
    marked = docs.toDF(*[f"c{i}" for i in range(len(names))])
    d, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    keyed = marked.withColumn("doc", F.col(d).cast("long"))
    repeats = keyed.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    numbered = keyed.withColumn("row", F.lit(0)) if repeats.isEmpty() else keyed.withColumn("row", (F.row_number().over(Window.partitionBy("doc").orderBy(t)) - 1).cast("int"))
    removed, tables = removed_lines(numbered.filter("doc IS NOT NULL").select("doc", "row", F.col(t).cast("string").alias("text")))
    gone = cut(removed.groupBy("doc", "row").agg(F.collect_set("line").alias("gone"), F.count_if("near").alias("n_near")), "lines-gone")
    for table in tables:
        drop_table(table)
    return numbered.join(gone.hint("merge"), ["doc", "row"], "left"), names


def _without(rows: DataFrame, names: list[str], text: str, n_chars: str) -> DataFrame:
    """The rows' own columns with the lines in `gone` taken out of the text, then n_lines, n_removed and n_near."""
    t, n = names.index(text), names.index(n_chars) if n_chars in names else None
    count = len(names)
    own = [f"c{i}" for i in range(count)]
    schema = T.StructType([*(rows.schema[c] for c in own), *(T.StructField(x, T.LongType()) for x in ("n_lines", "n_removed", "n_near"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, lines, removed = [], batch.column(n).to_pylist() if n is not None else None, [], []
            for i, (value, places) in enumerate(zip(batch.column(t), batch.column(count), strict=True)):
                x = value.as_py()
                every = x.split("\n") if x is not None else []
                if gone := set(places.as_py() or ()):
                    x = "\n".join(line for k, line in enumerate(every) if k not in gone)
                    if sizes is not None:
                        sizes[i] = len(x)
                texts.append(x)
                lines.append(len(every))
                removed.append(len(gone))
            columns = list(batch.columns[:count])
            columns[t] = pa.array(texts, columns[t].type)
            if sizes is not None:
                columns[n] = pa.array(sizes, columns[n].type)
            near = [x or 0 for x in batch.column(count + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (lines, removed, near))], schema.names)

    return rows.select(*own, "gone", "n_near").mapInArrow(run, schema)


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with the duplicate lines taken out of their texts, without the documents that lose all their words by that."""
    rows, names = dedup(docs, doc_id, text)
    left = F.col(f"c{names.index(text)}").rlike(r"[^\x20\x09-\x0D]")
    return _without(rows, names, text, n_chars).filter((F.col("n_removed") == 0) | left).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text, n_lines, n_removed, n_near (removed as near duplicates)."""
    rows, names = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return _without(rows, names, "text", "n_chars").toDF("doc_id", "text", "n_lines", "n_removed", "n_near")

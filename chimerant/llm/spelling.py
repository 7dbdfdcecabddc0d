"""Spelling variants: words one edit from a much more frequent word, by sorted dictionaries of halves.

1. Runs of letters are counted, most of the way in the tasks that read the texts. (Of each document's runs, a share by hash
   loses a letter, so that there are variants to be found.)
2. Two words one edit apart, the shorter (or either, if equally long) of m letters, share their first ceil(m / 2) or their
   last floor(m / 2) letters: one edit leaves a half intact. So each word is put, as one of m letters and as one of m + 1, into
   a block of the forward dictionary (words of equal first halves, a range of the sorted words) and one of the reversed
   dictionary (equal last halves, a range of the words sorted from behind).
3. Blocks of over CROWD words are subdivided: the letters that the words of a block don't share yet are halved in the same
   way, and again, until blocks are small or one letter is open, where the alphabet bounds a block. So no block grows with
   the data, and none is cut short.
4. Blocks are dealt into parts, sorted, and scanned: each word is compared with the words behind it in its range, all at
   once, and pairs of exactly one edit are counted. A pair may meet in several blocks; it counts in the first: where a
   block was reached by a last half, pairs that also share the first half there are left to the block of that.
5. What a part has found of a word is sent on as one row; a word's form is the nearest of the largest count. Counts grow
   tenfold from form to form, so roots need few steps, by pointer jumping.

Defined results: null and empty texts have no runs; runs of rows without doc_id are counted as they are; repeated rows count
again; runs of any length are words; an empty table gives an empty table; other columns are not looked at. Equal counts are
decided by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chimerant.llm.common import cut, drop_table

# The letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TIMES, TYPO = 7, 2, 10, 31
CROWD, PART, HELD = 128, 40_000, 200_000


def words_of(doc: int | None, text: str | None, runs: re.Pattern, typo: int = TYPO) -> Counter:
    """The runs of a text, A-Z lower-cased; where typo divides the hash of document and run, a letter is left out."""
    plain: Counter = Counter()
    for run, n in Counter(runs.findall(text or "")).items():
        plain[run.encode().lower()] += n
    if doc is None:
        return plain
    out: Counter = Counter()
    seed = zlib.crc32(b"%d:" % doc)
    for run, n in plain.items():
        h = zlib.crc32(run, seed)
        if h % typo == 0:
            letters = run.decode()
            i = h % len(letters)
            run = (letters[:i] + letters[i + 1 :]).encode()
        out[run] += n
    return out


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) over all texts; tasks send a row for each word of some HELD that they hold at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(f"[{LETTERS}]{{{least_letters},}}"), Counter()  # a shorter run gets no longer by losing a letter

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update(words_of(doc, text.as_py(), runs, typo))
                if len(held) > HELD:
                    yield rows()
        yield rows()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.length("word") >= least_letters) & (F.col("n") >= least_count))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks that share a half of what was open, of m - lo - hi letters, in its block."""
    open_ = F.col("m") - F.col("lo") - F.col("hi")
    f, g = F.ceil(open_ / 2).cast("int"), F.floor(open_ / 2).cast("int")
    first = rows.withColumn("lo", F.col("lo") + f)
    last = rows.withColumns({"cap": F.least("cap", F.col("lo") + f), "hi": F.col("hi") + g})
    return first.unionByName(last)


def _block() -> Column:
    """A hash of what the words of a block share."""
    return F.xxhash64("m", "lo", "hi", "cap", F.expr("left(word, lo)"), F.expr("right(word, hi)")).alias("block")


def blocks(words: DataFrame, least_letters: int = LEAST_LETTERS, crowd: int = CROWD) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, m, longer, lo, hi, cap, block): the words of each block; and the tables that this reads.

    m: letters of the shorter word of a pair; longer: 1 for words of m + 1; lo, hi: letters shared in front and behind;
    cap: pairs that share as many letters in front, or more, belong to another block."""
    size = F.length("word")
    both = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", size - F.col("longer")).filter(F.col("m") >= least_letters)
    rows = _halved(both.withColumns({"lo": F.lit(0), "hi": F.lit(0), "cap": F.col("m") + 1}).select("word", "n", "m", "longer", "lo", "hi", "cap"))
    done, tables = [], []
    while True:
        rows = cut(rows.withColumn("block", _block()), "spelling-blocks")
        sizes = cut(rows.groupBy("block", "m", "lo", "hi").agg(F.count(F.lit(1)).alias("k"), F.min("longer").alias("least")).filter("k > 1 AND least = 0"), "spelling-sizes")
        tables += [rows, sizes]
        large = (F.col("k") > crowd) & (F.col("m") - F.col("lo") - F.col("hi") > 1)
        done.append(rows.join(sizes.filter(~large).select("block"), "block", "left_semi"))
        if sizes.filter(large).isEmpty():
            break
        rows = _halved(rows.join(sizes.filter(large).select("block"), "block", "left_semi").drop("block"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, tables


def _pairs(short: np.ndarray, long: np.ndarray, lo: int, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each row of `short` the later rows of `short`, and the rows of `long`, that are one edit away and share under `cap` letters in front.

    The matrices hold the open letters of a block's words: r of the short ones, r + 1 of the long ones."""
    r = short.shape[1]
    for i, one in enumerate(short):
        other = short[i + 1 :] != one
        same = np.flatnonzero((other.sum(1) == 1) & (lo + other.argmax(1) < cap)) + i + 1 if r and len(other) else np.zeros(0, int)
        if len(long):
            front = (np.cumprod(long[:, :r] == one, 1).sum(1)) if r else np.zeros(len(long), int)
            back = (np.cumprod((long[:, 1:] == one)[:, ::-1], 1).sum(1)) if r else np.zeros(len(long), int)
            more = np.flatnonzero((front + back >= r) & (lo + front < cap))
        else:
            more = np.zeros(0, int)
        yield i, same, more


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _scan(table: pa.Table) -> pa.Table:
    """What a part tells of its words: how many near words, and the most frequent of them."""
    table = table.combine_chunks()
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n, m, longer, lo, hi, cap = (table.column(c).to_pylist() for c in ("n", "m", "longer", "lo", "hi", "cap"))
    keys = [(m[i], lo[i], hi[i], cap[i], w[: lo[i]], w[len(w) - hi[i] :]) for i, w in enumerate(words)]
    order = sorted(range(len(words)), key=lambda i: (keys[i], longer[i], words[i]))
    count: Counter = Counter()
    best: dict[int, tuple[int, bytes]] = {}

    def met(i: int, others: list[int]) -> None:
        count[i] += len(others)
        best[i] = min([best.get(i, (1, b""))] + [(-n[j], words[j]) for j in others])

    begin = 0
    while begin < len(order):
        end, key = begin, keys[order[begin]]
        while end < len(order) and keys[order[end]] == key:
            end += 1
        own = order[begin:end]
        split = sum(1 for i in own if not longer[i])
        if split and len(own) > 1:
            inner = lambda i: np.frombuffer(words[i], np.uint8)[lo[i] : len(words[i]) - hi[i]]  # noqa: B023, E731
            r = m[own[0]] - lo[own[0]] - hi[own[0]]
            short, long = (np.array([inner(i) for i in some], np.uint8).reshape(len(some), width) for some, width in ((own[:split], r), (own[split:], r + 1)))
            for i, same, more in _pairs(short, long, lo[own[0]], cap[own[0]]):
                others = [own[j] for j in same.tolist()] + [own[split + j] for j in more.tolist()]
                if others:
                    met(own[i], others)
                    for j in others:
                        met(j, [own[i]])
        begin = end
    found = sorted(count)
    return pa.table([[words[i].decode("latin-1") for i in found], [count[i] for i in found], [best[i][1].decode("latin-1") for i in found], [-best[i][0] for i in found]], schema=_NEAR)


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, crowd: int = CROWD, part: int = PART) -> DataFrame:
    """(word, n_near, form, form_n): near words of each word that has any, and the most frequent of them. words is a stored (word, n)."""
    rows, tables = blocks(words, least_letters, crowd)
    parts = 1 + rows.count() // part
    met = rows.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_scan, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    out = cut(met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.m")).alias("form_n")), "spelling-near")
    for table in tables:
        drop_table(table)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms (word, form) are followed to the last, doubling the step each round."""
    links = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_table(links)
        links = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return links


def group_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, typo: int = TYPO, crowd: int = CROWD, part: int = PART) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n, from (doc_id, text)."""
    words = cut(count_words(docs, least_letters, least_count, typo), "spelling-words")
    near = near_words(words, least_letters, crowd, part)
    formed = F.col("form_n") >= times * F.col("n")
    rows = cut(words.join(near, "word", "left").select("word", F.when(formed, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n")), "spelling-forms")
    drop_table(near)
    drop_table(words)
    return rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Exact n-gram Jaccard join: every pair of documents whose shingle sets overlap by 80 percent is linked.

1. Each text becomes its set of hashed 5-word shingles, the hash of that set, and a count vector: shingles are hashed
   into GROUPS groups, the counts per group are a point. Documents with equal sets are one class, whatever their number.
2. Two sets A and B of Jaccard t or more share one of the first |A| - ceil(t|A|) + 1 shingles of A and of B, in any order
   common to all (prefix filter); the order is by hash, with shingles last that are frequent in a bounded sample, which
   shapes the work but not the result. Prefix shingles are dealt by hash into ranges in packed arrays.
3. In a range, the classes of like size under one shingle form a star around the smallest of them, the pivot: an edge
   (pivot, class). Copies share most of their shingles, so their stars are mostly the same edges, and of these each is
   kept once. Every pair that may be a link lies in the star of one pivot.
4. Edges that the points don't rule out are verified on the sets (the overlap of two points is at most the sum of
   coordinate minima). Verified links connect classes to components. Of two linked classes of a star, at least one is
   then not connected with the pivot, or they are already connected with each other.
5. So only stars of several components are looked at again: their classes are indexed by a count-vector R-tree (packed
   by size, then by a coordinate; boxes of coordinate maxima) and searched with the classes not connected with the
   pivot. Surviving pairs of two components are verified, and each link found spares the pairs that it connects.
   Only links that connect are made, never the pairs of a group. Stars are dealt in pieces of PART shingles or CROWD
   classes, whatever their size.
6. Components over links between classes give the components of documents.

The R-tree alone can't deal the work to many machines (count vectors of long texts all lie near each other, so boxes
would all meet), hence the prefix filter in front of it; together they lose nothing.

Defined results: texts without words (null, empty) have 0 shingles, are linked with nothing and are components of their
own; repeated rows are linked like any copies (rows of one doc_id are one component); a row without doc_id is linked, but
can't name a component; an empty table gives an empty table; other columns are not looked at. keep_one() keeps, of each
component, the row with the smallest doc_id, and all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.llm.common import blocks_for, components, cut, drop_table, join_hot

SHINGLE, PERCENT = 5, 80
#: Coordinates of a point: GROUPS, and for sets of many shingles twice as many as often as there are more than FILL of them in a group.
GROUPS, FILL, MOST_GROUPS = 256, 16, 1 << 16
RANGE = 8 << 20
SAMPLE_DOCS, SAMPLE_SEEN = 4_000, 3
LEAF, FANOUT = 16, 8
PART, CROWD = 1_500_000, 8_192
CACHE_SIZE = 400_000
_NO_ID = -(1 << 63)

_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL[1]
    x = (x ^ (x >> np.uint64(27))) * _MUL[2]
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_SIZE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, known: Hashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashed shingles; fewer words than `width` are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _MUL[0] + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest intersection that links sets of sizes a and b: 100 * i >= percent * (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


def point(s: np.ndarray) -> bytes:
    """Counts of the shingles by groups, packed; the number of groups is a power of two that grows with the set."""
    groups = GROUPS
    while groups < MOST_GROUPS and len(s) > FILL * groups:
        groups *= 2
    counts = np.bincount((_mix(s ^ _MUL[0]) % np.uint64(groups)).astype(np.int64), minlength=groups)
    width = np.min_scalar_type(int(counts.max()))
    return bytes([width.itemsize]) + counts.astype(width).tobytes()


def _point(packed: bytes) -> np.ndarray:
    """The counts in a packed point."""
    return np.frombuffer(packed[1:], f"u{packed[0]}")


def _coarse(p: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The point over fewer groups, which are unions of its own."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.uint32)


def most_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """No two sets with these points share more shingles: the sum of the smaller coordinates, over the groups of both."""
    groups = min(len(a), len(b))
    return int(np.minimum(_coarse(a, groups), _coarse(b, groups)).sum(dtype=np.int64))


class RTree:
    """Packed R-tree over count vectors; boxes keep the largest count per coordinate and the span of sizes."""

    def __init__(self, sizes: np.ndarray, fine: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.fine = percent, fine
        points = np.array([_coarse(p) for p in fine])
        self.order = np.lexsort((points[:, 0].astype(np.int64) - points[:, -1].astype(np.int64), (np.log(np.maximum(sizes, 1)) * 8).astype(int)))
        self.sizes, self.points = sizes[self.order].astype(np.int64), points[self.order]
        self.levels = []  # from leaves up: largest counts, smallest and largest size of each box
        tops, low, high, span = self.points, self.sizes, self.sizes, LEAF
        while len(tops) > 1:
            starts = np.arange(0, len(tops), span)
            tops, low, high = np.maximum.reduceat(tops, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((tops, low, high, span))
            span = FANOUT

    def near(self, n: int, one: np.ndarray) -> np.ndarray:
        """The places, in ascending order, of the points that may be linked with a set of n shingles and this point."""
        boxes, fine, one = np.arange(len(self.levels[-1][0]) if self.levels else len(self.sizes)), one, _coarse(one)
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high, span = self.levels[depth]
            boxes = boxes[_may(n, one, tops[boxes], low[boxes], high[boxes], self.percent)]
            boxes = (boxes[:, None] * span + np.arange(span)).ravel()
            boxes = boxes[boxes < (len(self.sizes) if depth == 0 else len(self.levels[depth - 1][0]))]
        boxes = boxes[_may(n, one, self.points[boxes], self.sizes[boxes], self.sizes[boxes], self.percent)]
        found = np.sort(self.order[boxes])
        if len(fine) > GROUPS:
            size = dict(zip(self.order[boxes].tolist(), self.sizes[boxes].tolist(), strict=True))
            found = np.array([k for k in found.tolist() if most_overlap(self.fine[k], fine) >= least_overlap(size[k], n, self.percent)], np.int64)
        return found


def _may(n, one: np.ndarray, tops: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Which boxes may hold a set linked with one of n shingles: by sizes, and by the sum of the smaller coordinates."""
    fits = (100 * high >= percent * n) & (100 * n >= percent * low)
    return fits & (np.minimum(tops, one).sum(1, dtype=np.int64) >= least_overlap(n, np.maximum(low, -(-percent * n // 100)), percent))


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that SAMPLE_SEEN or more of a bounded sample of documents have: at most a few hundred a document."""
    sample = docs.select(F.xxhash64("doc_id", F.lit(3)).alias("h"), "text").orderBy("h").limit(SAMPLE_DOCS).select(F.substring("text", 1, 20_000).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            sets = [shingles(v.as_py(), known) for v in batch.column(0)]
            all_of = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(all_of.view(np.int64))], ["s"])

    rows = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SAMPLE_SEEN).orderBy(F.desc("n"), "s").limit(500_000)
    return np.sort(rows.select("s").toArrow().column("s").to_numpy().view(np.uint64))


def signatures(docs: DataFrame, frequent: np.ndarray, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), n, cls (hash of the set), points and prefix (packed) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, last = Hashes(), shared.value
        for batch in batches:
            n, hashes, points, prefixes = [], [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py(), known, width)
                n.append(len(s))
                hashes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                points.append(point(s))
                common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                prefixes.append(np.concatenate([s[~common], s[common]])[: prefix_length(len(s), percent) if len(s) else 0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hashes, pa.int64()), pa.array(points, pa.binary()), pa.array(prefixes, pa.binary())], ["doc_id", "th", "n", "cls", "points", "prefix"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n long, cls long, points binary, prefix binary")


def _deal(sigs: DataFrame, parts: int) -> DataFrame:
    """Prefix shingles by range: part, keys, classes, sizes, packed in 13 bytes a shingle.

    A key is cut to 32 bits, since it only has to tell shingles of one range apart: two that fall together make more
    candidates, never fewer. A size becomes its octave in steps of a sixteenth. Of a class, a task deals out one copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            classes, sizes, keys = [], [], []
            for c, n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if c in seen:
                    continue
                if len(seen) >= CACHE_SIZE:
                    seen.clear()
                seen.add(c)
                classes.append(c)
                sizes.append(n)
                keys.append(np.frombuffer(p.as_py(), np.uint64))
            lengths = [len(k) for k in keys]
            key = _mix((np.concatenate(keys) if keys else np.zeros(0, np.uint64)) + _MUL[0])
            cls = np.repeat(np.array(classes, np.int64), lengths)
            size = np.repeat(_octaves(np.array(sizes, np.int64)), lengths)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            here, begins = np.unique(part[order], return_index=True)
            split = np.split(order, begins[1:]) if len(order) else []
            short = (key >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), *(pa.array([v[o].tobytes() for o in split], pa.binary()) for v in (short, cls, size))], ["part", "keys", "classes", "sizes"])

    return sigs.select("cls", "n", "prefix").mapInArrow(run, "part int, keys binary, classes binary, sizes binary")


def _octaves(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)


def _meet(percent: int):
    """Classes that share a prefix shingle with another of like size: (p, x), p being the smallest of those that share it."""

    reach = int(np.ceil(8 * np.log2(100 / percent))) + 1

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
        key, cls, size = join("keys", np.uint32), join("classes", np.int64), join("sizes", np.uint8).astype(np.int64)
        if not len(key):
            return _PAIRS.empty_table()
        order = np.lexsort((size, key))
        key, cls, size = key[order], cls[order], size[order]
        # Of the classes of a key, runs without a gap in size wider than a link can bridge are groups of their own.
        begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (size[1:] - size[:-1] > reach)])
        pivot = np.repeat(np.minimum.reduceat(cls, begins), np.diff(np.r_[begins, len(key)]))
        other = pivot != cls
        pairs = np.stack([pivot[other], cls[other]], 1)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        fresh = np.r_[True, (pairs[1:] != pairs[:-1]).any(1)][: len(pairs)]
        return pa.table([pairs[fresh, 0], pairs[fresh, 1]], schema=_PAIRS)

    return run


_PAIRS = pa.schema([("p", pa.int64()), ("x", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bounded(percent: int):
    """Rows whose two points (columns n, points, pn, ppoints) don't rule a link out, without the points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, pn = batch.column("n").to_numpy(), batch.column("pn").to_numpy()
            both = np.array([most_overlap(_point(a), _point(b)) for a, b in zip(*(batch.column(c).to_pylist() for c in ("points", "ppoints")), strict=True)])
            yield batch.select(["p", "x", "n"]).filter(pa.array(both >= least_overlap(n, pn, percent)))

    return run


def _groups(table: pa.Table, names: list[str]) -> Iterator[np.ndarray]:
    """Places of the rows of each group of equal values."""
    keys = [table.column(c).to_numpy() for c in names]
    order = np.lexsort(keys[::-1])
    changes = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        changes |= k[order][1:] != k[order][:-1]
    yield from np.split(order, np.flatnonzero(changes) + 1) if len(order) else ()


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the other sets, none empty, shares with one."""
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0] + [len(o) for o in others[:-1]]))


def _verify_stars(percent: int):
    """Of the pivot (side 0) and the classes (side 1) of each piece of a star, the verified links."""

    def run(table: pa.Table) -> pa.Table:
        cls, side, sets = table.column("cls").to_numpy(), table.column("side").to_numpy(), table.column("set")
        out_a, out_b = [], []
        for own in _groups(table, ["p", "piece"]):
            pivots, others = own[side[own] == 0], own[side[own] == 1]
            if not len(pivots) or not len(others):
                continue
            one, rest = np.frombuffer(sets[int(pivots[0])].as_py(), np.uint64), [np.frombuffer(sets[int(i)].as_py(), np.uint64) for i in others]
            both = _overlaps(one, rest)
            good = others[100 * both >= percent * (len(one) + np.array([len(r) for r in rest]) - both)]
            out_a.append(np.full(len(good), cls[pivots[0]]))
            out_b.append(cls[good])
        none = np.zeros(0, np.int64)
        return pa.table([np.concatenate(out_a or [none]), np.concatenate(out_b or [none])], schema=_EDGES)

    return run


_MEETING = "p long, i int, j int, cls long, comp long, side int"


def _search(percent: int):
    """Of the classes of a piece (side 0) and those not yet linked with the pivot (side 1), the ones with a pair that may be a link."""

    def run(table: pa.Table) -> pa.Table:
        n, comp, side = (table.column(c).to_numpy() for c in ("n", "comp", "side"))
        points, keep = [_point(v) for v in table.column("points").to_pylist()], np.zeros(table.num_rows, bool)
        for own in _groups(table, ["p", "i", "j"]):
            members, loose = own[side[own] == 0], own[side[own] == 1]
            if not len(members) or not len(loose):
                continue
            tree = RTree(n[members], [points[k] for k in members], percent)
            for w in loose:
                found = members[tree.near(n[w], points[w])]
                found = found[comp[found] != comp[w]]
                if len(found):
                    keep[w] = keep[found] = True
        return table.select(["p", "i", "j", "cls", "comp", "side"]).filter(pa.array(keep))

    return run


def _verify_loose(percent: int):
    """Links between side 1 and side 0 of each piece. Pairs that links already connect are skipped, so dense pieces stay cheap."""

    def run(table: pa.Table) -> pa.Table:
        cls, comp, side = (table.column(c).to_numpy().copy() for c in ("cls", "comp", "side"))
        sets, found = table.column("set"), []
        for own in _groups(table, ["p", "i", "j"]):
            members, loose = own[side[own] == 0], own[side[own] == 1]
            if not len(members) or not len(loose):
                continue
            held = [np.frombuffer(sets[int(k)].as_py(), np.uint64) for k in members]
            sizes = np.array([len(h) for h in held])
            tree = RTree(sizes, [_point(point(h)) for h in held], percent)
            at = comp[members]
            for w in loose:
                one = np.frombuffer(sets[int(w)].as_py(), np.uint64)
                near = tree.near(len(one), _point(point(one)))
                for k in near[at[near] != comp[w]]:
                    if at[k] == comp[w]:
                        continue
                    both = int(_overlaps(one, [held[k]])[0])
                    if 100 * both >= percent * (len(one) + sizes[k] - both):
                        found.append((int(cls[w]), int(cls[members[k]])))
                        comp[loose[comp[loose] == at[k]]] = comp[w]
                        at[at == at[k]] = comp[w]
        columns = list(zip(*found, strict=True)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_EDGES)

    return run


def _in_pieces(rows: DataFrame, name: str, pieces: str) -> DataFrame:
    """The place of each row's class among `pieces` pieces."""
    return rows.withColumn(name, F.pmod(F.xxhash64("x"), F.col(pieces)).cast("int"))


def _links(edges: DataFrame, chosen: DataFrame, plain: DataFrame, parts: int, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect all that links connect. edges: (p, x), stored; chosen: cls, doc_id, th, n, points, stored.

    The sets of the classes to verify are made from their texts, twice; no others are kept or sent."""
    x_side = edges.join(chosen.select(F.col("cls").alias("x"), "n", "points"), "x")
    counts = cut(edges.groupBy("p").agg(F.count(F.lit(1)).alias("k")).join(chosen.select(F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("points").alias("ppoints")), "p"), "join-pivots")
    able = cut(join_hot(x_side, counts, "p", "k").mapInArrow(_bounded(percent), "p long, x long, n long"), "join-able")
    drop_table(counts)
    totals = cut(able.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).select("p", "k", F.ceil(F.col("total") / PART).cast("int").alias("pieces")), "join-totals")
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts)).cast("int").alias("part")
    star = _in_pieces(join_hot(able.select("p", "x"), totals, "p", "k"), "piece", "pieces").select("p", "piece", F.col("x").alias("cls"), F.lit(1).alias("side"))
    heads = totals.select("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("p").alias("cls"), F.lit(0).alias("side"))
    rows = cut(star.union(heads), "join-star-rows")
    sets = _sets(plain, chosen, rows, width)
    rows = rows.join(sets, "cls").select(part("p", "piece"), "p", "piece", "cls", "side", "set")
    links = cut(rows.groupBy("part").applyInArrow(_verify_stars(percent), "a long, b long"), "join-stars")
    for table in (able, totals, sets):
        drop_table(table)

    # Of two linked classes that meet at a pivot, one at least is not connected with the pivot yet, or both are with each other.
    comps = components(links, "join-stars")
    whole = edges.union(edges.select("p", F.col("p").alias("x")).distinct()).join(comps.select(F.col("node").alias("x"), "comp"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    mixed = whole.groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("x") == F.col("p"), F.col("comp"))).alias("pc"), F.count(F.lit(1)).alias("k")).filter("lo <> hi").select("p", "pc", "k")
    mixed = cut(mixed, "join-mixed")
    if mixed.isEmpty():
        return links
    loose = cut(join_hot(whole, mixed, "p", "k").join(chosen.select(F.col("cls").alias("x"), "n"), "x"), "join-loose")
    apart = F.col("comp") != F.col("pc")
    pieces = loose.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.count_if(apart).alias("kw"), F.sum(F.when(apart, F.col("n"))).alias("wtotal"))
    size = lambda k, total: F.ceil(F.greatest(F.col(k) / CROWD, F.col(total) / PART, F.lit(1))).cast("int")
    pieces = cut(pieces.select("p", "k", size("k", "total").alias("s"), size("kw", "wtotal").alias("t")), "join-pieces")
    dealt = join_hot(loose.select("p", "x", "n", "comp", "pc"), pieces, "p", "k").join(chosen.select(F.col("cls").alias("x"), "points"), "x")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = _in_pieces(dealt, "i", "s").withColumn("j", every("t")).withColumn("side", F.lit(0))
    guests = _in_pieces(dealt.filter(apart), "j", "t").withColumn("i", every("s")).withColumn("side", F.lit(1))
    columns = ["p", "i", "j", F.col("x").alias("cls"), "n", "comp", "side"]
    met = own.select(part("p", "i", "j"), *columns, "points").union(guests.select(part("p", "i", "j"), *columns, "points"))
    met = cut(met.groupBy("part").applyInArrow(_search(percent), _MEETING), "join-met")
    sets = _sets(plain, chosen, met, width)
    rows = met.join(sets, "cls").select(part("p", "i", "j"), "p", "i", "j", "cls", "comp", "side", "set")
    more = cut(links.union(rows.groupBy("part").applyInArrow(_verify_loose(percent), "a long, b long")), "join-links")
    for table in (links, mixed, loose, pieces, met, sets, comps):
        drop_table(table)
    return more


def _sets(plain: DataFrame, chosen: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, set), stored: the shingles of the classes in `wanted`, from the texts of the rows that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), known, width).tobytes() for t in batch.column(1)], pa.binary())], ["cls", "set"])

    texts = plain.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")
    keys = chosen.join(wanted.select("cls").distinct(), "cls").select("cls", F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "th")
    found = keys.hint("merge").join(texts, ["d", "th"])
    return cut((found.dropDuplicates(["cls"]) if _repeats(plain) else found).select("cls", "text").mapInArrow(run, "cls long, set binary"), "join-sets")


def link(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = blocks_for(plain, "text", RANGE, 8)
    sigs = cut(signatures(plain, _frequent(plain), width, percent), "join-signatures")
    # One row of each class stands for it; a row is told by doc_id and the hash of its text, as doc_id may repeat.
    chosen = cut(sigs.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("n").alias("n"), F.first("points").alias("points")).select("cls", "r.doc_id", "r.th", "n", "points"), "join-classes")
    edges = cut(_deal(sigs.filter("n > 0"), parts).groupBy("part").applyInArrow(_meet(percent), "p long, x long").distinct(), "join-edges")
    wide, sigs = sigs, cut(sigs.select("doc_id", "n", "cls"), "join-rows")
    drop_table(wide)
    links = _links(edges, chosen, plain, parts, width, percent)
    for table in (edges, chosen):
        drop_table(table)

    named = components(links, "join-components")
    drop_table(links)
    ids = sigs.filter("n > 0").select("doc_id", "cls").join(named.select(F.col("node").alias("cls"), "comp"), "cls", "left").select("doc_id", "cls", F.coalesce("comp", "cls").alias("comp"))
    smallest = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = ids.select("cls", "comp").distinct().join(smallest, "comp").select("cls", "component_id")
    rows = sigs.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(by_class, "cls", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _repeats(plain: DataFrame) -> bool:
    return not plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the rows of its smallest doc_id, with all their columns; rows without words or doc_id stay."""
    marked = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    d = f"c{docs.columns.index(doc_id)}"
    found = link(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(d)).distinct()
    return marked.join(gone, d, "left_anti").select(*marked.columns).toDF(*docs.columns)

"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model over words with Dirichlet smoothing: with history h, its count C(h) and its n-gram's count
c(h, w), P(w | h) = (c(h, w) + mu * P(w | shorter h)) / (C(h) + mu); the last P is the add-one unigram model that the base
score uses as well. As an automaton: every counted history is a state; every counted n-gram is an arc of its history's
state, with the logarithm of P as its weight, and leads to the state of the longest history that it ends with; the
failure arc of a state, with weight mu / (C(h) + mu), leads to the state of the shorter history. The state without
history has an arc for every word. One traversal from left to right carries the state: where it has no arc for the next
word, failure arcs are taken until one has; all weights are added up. mu is set for each order such that the expected
mass of failure arcs on the training text is the share of n-grams that occur once (Good and Turing).

The whole model grows with the corpus and never has to fit anywhere. Documents are packed into blocks of about BLOCK
bytes where they are read; texts are moved once, compressed. A block counts its own n-grams and sends one array of
ascending keys per key range; each key range adds up the counts of all blocks and sends a block the totals in the order
of its keys, so no key travels back. A block's automaton then holds all states and arcs that its documents can reach, with the counts of the whole
corpus. No count is cut off, sampled or capped. Words are keyed by 128 bits, n-grams by 40 bits inside a key range; the
ranges grow in number with the data, so the chance that two n-grams of a range fall together (one in a million) doesn't.

Defined results: a null or empty text is the end token alone; repeated rows are scored alike and count as often as they
occur when trained on; rows without doc_id are held out, since crc32 has no value for them; without training rows N and V are 0
and every base probability is 1; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chimerant.llm.common import blocks_for, cut

ORDER = 2
BLOCK = 8 << 20
#: Bytes of text per key range: ranges grow in number with the data, so that each stays small.
RANGE = 4 << 20
#: Tokens whose arcs are looked up together.
LOOKUP = 100_000
FOLDS, HELD_OUT = 7, 2
END, BEGIN = b"\n", b"\t"  # no word holds white space

_LOW, _TAIL = np.uint64((1 << 24) - 1), np.uint64((1 << 40) - 1)
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mix(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram from those of its history and of its last word."""
    x = history * _MIX[0] + word
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of one block's documents, as numbers of its own, and their counts in its training documents."""

    def __init__(self, texts: list[str], held: list[bool], order: int):
        import xxhash

        number: dict[bytes, int] = {END: 0}
        parts = []
        for t in texts:
            raw = (t or "").encode().lower().split()
            raw.append(END)
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in raw), np.int64, len(raw)))
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        trained = np.repeat(~np.array(held, bool), self.lengths)
        digests = [xxhash.xxh3_128_intdigest(w) for w in number]
        low = np.fromiter((d & 0xFFFFFFFFFFFFFFFF for d in digests), np.uint64, len(digests))
        high = np.fromiter((d >> 64 for d in digests), np.uint64, len(digests))
        self.n_words = len(number)
        #: For each order: the keys of its n-grams, the number of the n-gram at each token, and their counts here.
        self.keys, self.at, self.counts = [low], [self.words], [np.bincount(self.words[trained], minlength=self.n_words)]
        self.high = high
        #: Number of the history of each n-gram, by order; histories of order 1 are words, BEGIN after all words.
        self.history: list[np.ndarray] = [np.zeros(0, np.int64)]
        #: Number of the last word of each n-gram, and of the n-gram of the order below that it ends with.
        self.last, self.suffix = [np.arange(self.n_words)], [np.zeros(0, np.int64)]
        begin_key = np.uint64(xxhash.xxh3_128_intdigest(BEGIN) & 0xFFFFFFFFFFFFFFFF)
        state, state_keys = self.words, np.append(low, begin_key)
        first = np.zeros(len(self.words), bool)
        first[self.starts[self.lengths > 0]] = True
        for k in range(2, order + 1):
            before = np.empty_like(self.words)
            before[1:] = state[:-1]
            before[first] = self.n_words if k == 2 else -1  # a text's first token has no longer history than its beginning
            full = np.flatnonzero(before >= 0)
            found, own = np.unique(before[full] * self.n_words + self.words[full], return_inverse=True)
            history, last = found // self.n_words, found % self.n_words
            keys = mix(state_keys[history], low[last])
            at = np.full(len(self.words), -1)
            at[full] = own
            suffix = np.zeros(len(found), np.int64)
            suffix[own] = state[full]
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(own[trained[full]], minlength=len(found)))
            self.history.append(history)
            self.last.append(last)
            self.suffix.append(suffix)
            state, state_keys = at, keys
        self.n_train_texts = int((~np.array(held, bool)).sum())

    def codes(self, kind: int, parts: int) -> np.ndarray:
        """Key range, then the 40 bits that tell the n-grams of a range apart; words keep half of their key."""
        key = self.keys[kind - 1]
        return key if kind == 1 else (key & _LOW) % np.uint64(parts) << np.uint64(40) | key >> np.uint64(24)


class Automaton:
    """The states and arcs that the texts of a block can reach; the counts in the block are those of the whole corpus.

    State 0 has no history; words are states from 1 on, then come the beginning of a text and n-grams by order. A history
    that was never seen has no arcs and a failure arc of weight 0, so it needs no case of its own. Arcs are looked up by
    state and word; the lookup holds those of the texts that load() was given, a few at a time."""

    def __init__(self, block: Block, total: int, distinct: int, mus: list[float], n_texts: int):
        n, order = block.n_words, len(mus) + 1
        self.block, self.width, self.begin = block, n, n + 1 if mus else 0
        p = (block.counts[0] + 1.0) / (total + 1.0 * (distinct + 1))
        self.word_weight = np.log10(p)
        self.word_weights = self.word_weight.tolist()
        base = [0, 1, n + 2]  # the first state of each order
        for keys in block.keys[1 : order - 1]:
            base.append(base[-1] + len(keys))
        self.table: list[tuple[np.ndarray, ...]] = []  # of each order: arc or not, state and word, weight, destination
        self.fail, self.fail_weight = [0] * (n + 2), [0.0]
        seen = np.append(block.counts[0], n_texts).astype(float)
        for k, mu in enumerate(mus, start=2):
            count, history, suffix = block.counts[k - 1], block.history[k - 1], block.suffix[k - 1]
            self.fail_weight += np.log10(mu / (seen + mu)).tolist()
            p = (count + mu * p[suffix]) / (seen[history] + mu)
            self.table.append((count > 0, (base[k - 1] + history) * n + block.last[k - 1], np.log10(p), base[k] + np.arange(len(count)) if k < order else base[k - 1] + suffix))
            if k < order:
                self.fail += (base[k - 1] + suffix).tolist()
            seen = count.astype(float)
        self.load(0, 0)

    def load(self, begin: int, end: int) -> None:
        """Look-ups for the arcs that the tokens from begin to end can take."""
        self.arcs: dict[int, int] = {}
        self.weight: list[float] = []
        self.dest: list[int] = []
        for at, (real, codes, weights, dests) in zip(self.block.at[1:], self.table, strict=True):
            own = np.unique(at[begin:end])
            own = own[own >= 0]
            own = own[real[own]]
            self.arcs.update(zip(codes[own].tolist(), range(len(self.arcs), len(self.arcs) + len(own)), strict=True))
            self.weight += weights[own].tolist()
            self.dest += dests[own].tolist()

    def score(self, words: list[int]) -> float:
        """The log10 probability of a text, its words given by their numbers in the block."""
        arc, weight, dest, fail, fail_weight, width, known = self.arcs.get, self.weight, self.dest, self.fail, self.fail_weight, self.width, self.word_weights
        state, total, step = self.begin, 0.0, bool(self.begin)
        for w in words:
            while state:
                a = arc(state * width + w)
                if a is not None:
                    total += weight[a]
                    state = dest[a]
                    break
                total += fail_weight[state]
                state = fail[state]
            else:
                total += known[w]
                state = step and 1 + w
        return total

    def scores(self) -> np.ndarray:
        """Of all texts of the block."""
        out, starts, ends = [], self.block.starts.tolist(), (self.block.starts + self.block.lengths).tolist()
        loaded = 0
        for i, (begin, end) in enumerate(zip(starts, ends, strict=True)):
            if end > loaded:
                loaded = next((e for e in ends[i:] if e - begin >= LOOKUP), ends[-1])
                self.load(begin, loaded)
            out.append(self.score(self.block.words[begin:end].tolist()))
        return np.array(out, float)


def score_block(block: Block, total: int, distinct: int, mus: list[float], n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base score, model score and known tokens of each text."""
    model = Automaton(block, total, distinct, mus, n_texts)
    return _sums(model.word_weight[block.words], block), model.scores(), _sums((block.counts[0] > 0)[block.words].astype(np.int64), block)


def _sums(values: np.ndarray, block: Block) -> np.ndarray:
    return np.add.reduceat(values, block.starts) if len(block.starts) else values


def fit_mu(singles: float, by_history: dict[int, float]) -> float:
    """mu such that the failure arcs get the mass `singles`; by_history: n-grams by log2 of their history's count."""
    low, high = 1e-3, 1e9
    total = sum(by_history.values())
    if not total or singles <= 0:
        return 1.0
    for _ in range(200):
        mid = (low * high) ** 0.5
        mass = sum(n * mid / (1.5 * 2.0**b + mid) for b, n in by_history.items())
        low, high = (mid, high) if mass < singles else (low, mid)
    return mid


_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_DDL = "part int, block long, kind int, keys binary, counts binary"


def _bytes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of whole numbers, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def _numbers(raw: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _pack_keys(codes: np.ndarray, high: np.ndarray | None) -> bytes:
    """Ascending keys: words whole, n-grams as the steps between the 40 bits inside their key range."""
    if high is not None:
        return codes.tobytes() + high.tobytes()
    return _bytes(np.diff(codes & _TAIL, prepend=np.uint64(0)), 5)


def _unpack_keys(raw: bytes, kind: int) -> tuple[np.ndarray, np.ndarray | None]:
    if kind == 1:
        both = np.frombuffer(raw, np.uint64)
        return both[: len(both) // 2], both[len(both) // 2 :]
    return np.cumsum(_numbers(raw, 5), dtype=np.uint64), None


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more follow."""
    large = counts[counts >= 255]
    return len(large).to_bytes(8, "little") + large.astype("<i8").tobytes() + _bytes(np.minimum(counts, 255), 1)


def _unpack_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    out = _numbers(raw[8 + 8 * n :], 1).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[8 : 8 + 8 * n], "<i8")
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT) if rows else _SENT.empty_table()


def _dealt(block: Block, kind: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each key range that the block has n-grams of this order in: their numbers, by ascending keys."""
    codes = block.codes(kind, parts)
    if kind == 1:
        part = codes % np.uint64(parts)
        order = np.lexsort((block.high, codes, part))
    else:
        part = codes >> np.uint64(40)
        order = np.argsort(codes, kind="stable")
    here, begins = np.unique(part[order], return_index=True)
    yield from zip(here.tolist(), np.split(order, begins[1:]), strict=True)


def _send(block: Block, number: int, parts: int) -> pa.Table:
    """The block's counts by key range, packed: kind k is order k, words with both halves of their keys; kind 0 counts training texts."""
    rows: list[tuple] = [(0, number, 0, np.array([block.n_train_texts], np.int64).tobytes(), b"")]
    for kind in range(1, len(block.keys) + 1):
        codes, counts = block.codes(kind, parts), block.counts[kind - 1]
        rows += [(i, number, kind, _pack_keys(codes[own], block.high[own] if kind == 1 else None), _pack_counts(counts[own])) for i, own in _dealt(block, kind, parts)]
    return _table(rows)


def _add_up(table: pa.Table) -> pa.Table:
    """For one key range and order: totals over blocks, sent back to each block in the order of its keys; block -1 has statistics."""
    part, kind = table.column("part")[0].as_py(), table.column("kind")[0].as_py()
    if kind == 0:
        n = sum(int(np.frombuffer(k.as_py(), np.int64)[0]) for k in table.column("keys"))
        return _table([(part, -1, 0, np.array([n, 0, 0], np.int64).tobytes(), np.zeros(64).tobytes())])
    keys, highs, counts = [], [], []
    for k, c in zip(table.column("keys"), table.column("counts"), strict=True):
        own, high = _unpack_keys(k.as_py(), kind)
        keys.append(own)
        highs.append(high)
        counts.append(_unpack_counts(c.as_py()))
    key, count = np.concatenate(keys), np.concatenate(counts)
    if kind == 1:
        high = np.concatenate(highs)
        order = np.lexsort((high, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (high[order][1:] != high[order][:-1])]
    else:
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(count[order], starts)
    count[order] = np.repeat(sums, np.diff(np.r_[starts, len(order)]))
    ends = np.cumsum([len(k) for k in keys])
    rows = [(part, b, kind, b"", _pack_counts(own)) for b, own in zip(table.column("block").to_pylist(), np.split(count, ends[:-1]), strict=True)]
    bins = np.bincount(np.log2(sums[sums > 0]).astype(int), weights=sums[sums > 0], minlength=64)
    rows.append((part, -1, kind, np.array([sums.sum(), (sums > 0).sum(), (sums == 1).sum()], np.int64).tobytes(), bins.tobytes()))
    return _table(rows)


def _take_in(block: Block, answers: dict[tuple[int, int], bytes], parts: int) -> None:
    """Put the corpus's counts, by order and key range, in the place of the block's own."""
    for kind in range(1, len(block.keys) + 1):
        block.counts[kind - 1] = np.zeros(len(block.keys[kind - 1]), np.int64)
        for part, own in _dealt(block, kind, parts):
            block.counts[kind - 1][own] = _unpack_counts(answers[kind, part])


def _blocks(size: int):
    """Rows (doc_id, held, text) packed into blocks of about `size` bytes, where they are read: one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        rows: list[tuple] = []
        total = 0

        def block() -> pa.RecordBatch:
            ids, held, texts = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.large_string()), strict=True))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type), ("held", held.type), ("text", texts.type)])) as writer:
                writer.write(pa.record_batch([ids, held, texts], ["doc_id", "held", "text"]))
            name = uuid.uuid4().int >> 65
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())], pa.binary())], ["block", "rows"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                total += len(row[2] or "")
                if total >= size:
                    yield block()
                    rows, total = [], 0
        if rows:
            yield block()

    return run


def _opened(packed: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()


def score_documents(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, held_out: int = HELD_OUT, block_bytes: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of (doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_parts = blocks_for(base, "text", range_bytes)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(True))
    blocks = cut(base.select("doc_id", held.alias("held"), "text").mapInArrow(_blocks(block_bytes), "block long, rows binary"), "lm-blocks")

    def opened(packed: bytes) -> tuple[pa.Table, Block]:
        rows = _opened(packed)
        return rows, Block(rows.column("text").to_pylist(), rows.column("held").to_pylist(), order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _send(opened(packed.as_py())[1], name, n_parts).to_batches()

    sent = blocks.mapInArrow(count, _SENT_DDL)
    back = cut(sent.groupBy("part", "kind").applyInArrow(_add_up, _SENT_DDL), "lm-counts")

    # Three sums and 64 bins for each order: all that reaches the driver, whatever the corpus.
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sums[kind] = sums.get(kind, 0) + np.r_[np.frombuffer(a.as_py(), np.int64).astype(float), np.frombuffer(b.as_py(), float)]
        rows = [(kind, i, float(x)) for kind, v in sums.items() for i, x in enumerate(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["kind", "i", "x"])

    stats: dict[int, dict[int, float]] = {}
    for r in back.filter("block = -1").select("kind", "keys", "counts").mapInArrow(unpacked, "kind int, i int, x double").groupBy("kind", "i").agg(F.sum("x").alias("x")).collect():
        stats.setdefault(r["kind"], {})[r["i"]] = r["x"]
    total, distinct = (int(stats.get(1, {}).get(i, 0)) for i in (0, 1))
    mus = [fit_mu(stats.get(k, {}).get(2, 0.0), {i - 3: x for i, x in stats.get(k - 1, {}).items() if i >= 3 and x}) for k in range(2, order + 1)]
    n_train = int(stats.get(0, {}).get(0, 0))

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        rows, block = opened(left.column("rows")[0].as_py())
        _take_in(block, {(kind, part): c.as_py() for kind, part, c in zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("counts"), strict=True)}, n_parts)
        base_score, model_score, known = score_block(block, total, distinct, mus, n_train)
        return pa.table([rows.column("doc_id"), rows.column("held"), block.lengths, known, np.full(rows.num_rows, total), base_score, model_score], schema=schema)

    return blocks.groupBy("block").cogroup(back.filter("block >= 0").groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

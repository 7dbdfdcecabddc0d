"""Token counts of whole texts by a sentencepiece model, huge texts by overlapping chunks that are spliced again.

A position is a proven stable boundary when a space mark follows a character that is none: no piece of the vocabulary
holds a space mark after another character (checked when the model is loaded), so no merge ever crosses it and both
sides are encoded alone as they are together. A text is the sum of its units between such boundaries. Texts longer than
CHUNK characters are encoded in overlapping chunks with offsets: neighbours are spliced at the last stable boundary of
their overlap that both encodings share; if the overlap has none, it is widened to twice its size, up to the whole rest.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK, OVERLAP = 8_192, 512
CACHE_SIZE = 400_000


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether boundaries before space marks are proven, and the model adds a mark in front and keeps all spaces.
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode_as_pieces("a  b ")[0].startswith(MARK) and "".join(self.model.encode_as_pieces("a  b ")) == f"{MARK}a{MARK}{MARK}b{MARK}"
        self.byte = {p for i, p in enumerate(pieces) if self.model.is_byte(i)}
        #: Tokens of a space mark alone, which the model puts in front of no text: seen at the end of one.
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.units = re.compile(f"{MARK}+[^{MARK}]*")
        self.chunk, self.overlap = chunk, overlap
        outer = self

        class Known(dict):
            def __missing__(self, unit: str) -> int:
                if len(self) >= CACHE_SIZE:
                    self.clear()
                out = self[unit] = len(outer.model.encode(unit[1:])) if len(unit) > 1 else outer.lone
                return out

        self.known = Known()

    def boundaries(self, marked: str, at: int) -> tuple[list[str], list[int]]:
        """Pieces of a chunk and the character offset at which each begins (inside a character for its later bytes: -1)."""
        pieces = self.model.encode_as_pieces(marked[1:]) if len(marked) > 1 else [MARK] * self.lone
        starts, pos, left = [], at, 0
        for p in pieces:
            if p in self.byte:
                starts.append(-1 if left else pos)
                if not left:
                    left = len(marked[pos - at].encode("utf-8", "surrogatepass"))
                left -= 1
                pos += not left
            else:
                starts.append(pos)
                pos += len(p)
        return pieces, starts

    def stable_at(self, marked: str, i: int) -> bool:
        return marked[i] == MARK and marked[i - 1] != MARK

    def spliced(self, marked: str) -> int:
        """The number of tokens of a huge text (its spaces as marks, one in front) by overlapping chunks."""
        n, total, begin, end = len(marked), 0, 0, min(len(marked), self.chunk)
        pieces, starts = self.boundaries(marked[begin:end], begin)
        overlap = self.overlap
        while end < n:
            # The next chunk begins at a stable boundary, so the mark that the model puts in front is the text's own.
            head = next((i for i in range(max(begin + 1, end - overlap), end) if self.stable_at(marked, i)), None)
            if head is not None:
                stop = min(n, max(head + self.chunk, end + 1))
                next_pieces, next_starts = self.boundaries(marked[head:stop], head)
                common = set(next_starts)
                last = next((i for i in range(len(starts) - 1, 0, -1) if starts[i] >= 0 and starts[i] in common and self.stable_at(marked, starts[i])), None)
                if last is not None:
                    total += last
                    skip = next_starts.index(starts[last])
                    begin, end, pieces, starts = starts[last], stop, next_pieces[skip:], next_starts[skip:]
                    overlap = self.overlap
                    continue
            if end - overlap > begin:
                overlap *= 2
            else:  # all of the chunk overlaps and has no stable boundary: the chunk itself is made longer
                end, overlap = min(n, begin + 2 * (end - begin)), self.overlap
                pieces, starts = self.boundaries(marked[begin:end], begin)
        return total + len(pieces)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.stable:
            return len(self.model.encode(text))
        marked = MARK + text.replace(" ", MARK)
        if len(marked) > self.chunk:
            return self.spliced(marked)
        return sum(map(self.known.__getitem__, self.units.findall(marked)))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, chunk, overlap)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

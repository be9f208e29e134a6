"""Token counts of whole texts, huge ones by overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stable_bpe import as_text, proven, shared_encoder, slices

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048


class ChunkCounter:
    """Tokens of one huge text without encoding it in one piece.

    Chunks overlap.  Two neighbours are spliced at a place where both have a
    token boundary and which is stable: a space after a non-space (see
    ``stable_bpe``) or, without one, a boundary with the merge list's sufficient
    ``lookahead`` to its right in the left chunk.  That one is a boundary of the whole
    text, and as no token of the right chunk crosses it, what follows it there does not
    depend on what precedes it.  Where nothing fits the overlap is widened, twice as far each time.
    """

    def __init__(self, library, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
                 lookahead: int | None = None):
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than the chunk")
        self.library, self.chunk, self.overlap, self.lookahead = library, chunk, overlap, lookahead

    def _bounds(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        code = self.library.encode(part, add_special_tokens=False)
        spans = np.array(code.offsets, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    @staticmethod
    def _boundary(spans, at: int) -> int:
        """Tokens before ``at``, or -1 if a token crosses it."""
        k = int(np.searchsorted(spans[0], at))
        return -1 if k and spans[1][k - 1] > at else k

    def count(self, text: str) -> int:
        left, total, done = 0, 0, 0  # the left chunk's place, tokens counted, and up to where
        size = self.chunk
        spans = self._bounds(text[:size])
        while left + size < len(text):
            overlap = self.overlap
            while True:
                right = left + size - overlap
                ahead = self._bounds(text[right:right + self.chunk])
                cut = self._common(text, left, spans, right, ahead, right, left + size)
                if cut is not None:
                    break
                size = size + overlap  # widen: more of the text in the left chunk
                overlap *= 2
                spans = self._bounds(text[left:left + size])
                if left + size >= len(text):
                    cut = len(text)
                    break
                overlap = min(overlap, size - 1)
            if cut == len(text):
                break
            total += self._boundary(spans, cut - left) - self._boundary(spans, done - left)
            left, done, spans, size = right, cut, ahead, self.chunk
        return total + len(spans[0]) - self._boundary(spans, done - left)

    def _common(self, text, left, spans, right, ahead, low, high):
        """The last stable place in ``(low, high)`` that bounds tokens on both sides."""
        at = text.rfind(" ", low + 1, high)
        while at > low:
            if (not text[at - 1].isspace() and self._boundary(spans, at - left) >= 0
                    and self._boundary(ahead, at - right) >= 0):
                return at
            at = text.rfind(" ", low + 1, at)
        if self.lookahead is None:
            return None
        both = np.intersect1d(spans[0] + left, ahead[0] + right)
        for at in both[(both > low) & (both < high)][::-1].tolist():
            if (proven(text, at, high, self.lookahead) and self._boundary(spans, at - left) >= 0
                    and self._boundary(ahead, at - right) >= 0):
                return at
        return None


def count_tokens(texts: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id",
                 text: str = "text", chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Tokens of every text, to plan which ones a span finder can take whole.

    ``texts`` are the texts to scrub, ``(doc_id, text)``.  ``tokenizer`` is the
    path of a tokenizers file, readable on every executor.  Texts of more than
    ``chunk`` characters are counted over chunks that overlap by ``overlap``.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, one row per input row.  A
    null text counts as empty: no bytes, no tokens.  Repeated rows and null keys
    stay as they are; other columns are ignored; an empty table gives no rows.
    No shuffle; a task holds one Arrow batch.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        encoder = shared_encoder(tokenizer)
        counter = ChunkCounter(encoder.library, chunk, overlap, encoder.lookahead)
        for batch in batches:
            column, keys = as_text(batch.column(1)), batch.column(0)
            for row, part in slices(column):
                ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset:part.offset + len(part) + 1]
                size = np.diff(ends).astype(np.int64)
                huge = [i for i in np.flatnonzero(size > chunk) if len(part[int(i)].as_py()) > chunk]
                rest = part
                if huge:
                    rest = pa.array(["" if i in set(huge) else t
                                     for i, t in enumerate(part.to_pylist())], pa.string())
                found = encoder.counts(rest)
                for i in huge:
                    found[i] = counter.count(part[int(i)].as_py())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, len(part)), pa.array(size), pa.array(found),
                     pa.array(found > limit)],
                    names=[key, "n_bytes", "n_tokens", "over_limit"])

    return texts.select(key, text).mapInArrow(run, schema)

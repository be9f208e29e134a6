"""Streaming BPE encoding and decoding with bounded lookahead."""

from __future__ import annotations

import codecs
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stable_bpe import SLICE_BYTES, StableEncoder, as_text, byte_letters, shared_encoder

BLOCK_CHARS = 65_536


class Transducer:
    """Encodes texts that arrive in pieces; emits ids as soon as they are stable.

    What is kept of a stream is the part after its last stable cut: a word.  A run
    without such a cut is emitted up to its last boundary that has the merge list's
    sufficient lookahead behind it, as soon as a window of it has come in, so
    what is kept does not grow with the run.
    """

    def __init__(self, encoder: StableEncoder):
        self.encoder = encoder
        self.rest, self.hold = "", encoder.window

    def feed(self, text: str) -> list[str | list[int]]:
        """Pieces whose ids are final now; of a part of a run, its ids."""
        seen, done = len(self.rest), []
        self.rest += text
        at = self.rest.rfind(" ", max(seen - 1, 0))
        while at > 0 and self.rest[at - 1].isspace():
            at = self.rest.rfind(" ", max(seen - 1, 0), at)
        if at > 0:
            done, self.rest, self.hold = [self.rest[:at]], self.rest[at:], self.encoder.window
        while len(self.rest) > self.hold:
            cut, ids = self.encoder.inner_cut(self.rest[:self.hold])
            if cut:
                done.append(ids)
                self.rest, self.hold = self.rest[cut:], self.encoder.window
            else:
                self.hold *= 2
        return done

    def finish(self) -> list[str]:
        done, self.rest, self.hold = self.rest, "", self.encoder.window
        return [done] if done else []

    def encode(self, pieces: list[str | list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the first id of each piece (one more at the end)."""
        ids, first = self.encoder.encode(pa.array([p if isinstance(p, str) else "" for p in pieces], pa.string()))
        if all(isinstance(p, str) for p in pieces):
            return ids, first
        parts = [ids[first[k]:first[k + 1]] if isinstance(p, str) else np.array(p, np.int32)
                 for k, p in enumerate(pieces)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def blocks(text: str, encoder: StableEncoder, size: int = BLOCK_CHARS):
    """One text through a transducer, ``size`` characters at a time."""
    if len(text) <= size:
        yield text
        return
    stream = Transducer(encoder)
    for at in range(0, len(text), size):
        yield from stream.feed(text[at:at + size])
    yield from stream.finish()


class Decoder:
    """Ids to text, a few at a time; bytes of a cut character wait for the rest."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = (json.load(f).get("decoder") or {}).get("type")
        size = library.get_vocab_size(with_added_tokens=True)
        tokens = [library.id_to_token(i) or "" for i in range(size)]
        if kind is None:  # tokens are joined by spaces
            self.joined, table = True, [(" " + t).encode() for t in tokens]
        elif kind == "ByteLevel":
            self.joined, place = False, byte_letters()
            table = [bytes(place[c] for c in t) if all(c in place for c in t) else t.encode()
                     for t in tokens]
        else:
            raise ValueError(f"decoder {kind} is not supported")
        self.table = pa.array(table, pa.binary())
        self.reset()

    def reset(self) -> None:
        self.first = True
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        raw = joined_bytes(self.table.take(pa.array(ids)))
        if self.joined and self.first and len(ids):
            raw, self.first = raw[1:], False
        return self.text.decode(raw, last)


def joined_bytes(values: pa.Array) -> bytes:
    if not len(values):
        return b""
    ends = np.frombuffer(values.buffers()[1], np.int32)
    data = values.buffers()[2]
    low, high = int(ends[values.offset]), int(ends[values.offset + len(values)])
    return data[low:high].to_pybytes() if data is not None and high > low else b""


def transduce(texts: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
              block: int = BLOCK_CHARS, with_text: bool = False) -> DataFrame:
    """Every text to token ids and back.

    ``texts`` are the texts to scrub or restore, ``(doc_id, text)``; a restored
    delta stream can be fed to :class:`Transducer` block by block in the same
    way.  Returns one row per input row: ``doc_id``, ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by one space), ``decoded_sha256`` and,
    with ``with_text``, the ``ids`` and the ``decoded`` text.

    Ids equal those of the tokenizers library for the whole text without added
    special tokens, truncation or padding; the text equals its ``decode(ids,
    skip_special_tokens=False)``.  A null text is empty: no ids, the digest of
    nothing.  Repeated rows and null keys stay; other columns are ignored.
    Without ``with_text`` memory does not grow with the length of a text beyond
    the text itself.  No shuffle.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_text else ""
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_text

    def run(batches):
        encoder = shared_encoder(tokenizer)
        stream = Transducer(encoder)
        decoder = Decoder(tokenizer)
        numbers = pa.array([f" {i}" for i in range(len(decoder.table))], pa.string())

        def flush(pieces, owners, rows):
            """Encode and decode the pieces; add to what their rows have so far."""
            if not pieces:
                return
            ids, firsts = stream.encode(pieces)
            spelled = numbers.take(pa.array(ids))
            ends = np.frombuffer(spelled.buffers()[1], np.int32) if len(ids) else np.zeros(1, np.int32)
            raw = memoryview(spelled.buffers()[2]) if len(ids) else memoryview(b"")
            for k, owner in enumerate(owners):
                low, high = int(firsts[k]), int(firsts[k + 1])
                if low == high:
                    continue
                row = rows[owner]
                skip = 1 if row["n"] == 0 else 0
                row["ids"].update(raw[int(ends[low]) + skip:int(ends[high])])
                row["n"] += high - low
                decoder.first, decoder.text = row["first"], row["text"]
                out = decoder.feed(ids[low:high])
                row["first"] = decoder.first
                row["sha"].update(out.encode("utf-8"))
                if with_text:
                    row["all"].append(ids[low:high])
                    row["out"].append(out)

        for batch in batches:
            keys, column = batch.column(0), as_text(batch.column(1))
            rows, pieces, owners, held = [], [], [], 0
            for i, value in enumerate(column):
                decoder.reset()
                rows.append({"n": 0, "ids": hashlib.sha256(), "sha": hashlib.sha256(),
                             "first": True, "text": decoder.text, "all": [], "out": []})
                for piece in blocks(value.as_py(), encoder, block):
                    pieces.append(piece)
                    owners.append(i)
                    held += len(piece)
                    if held >= SLICE_BYTES // 2:
                        flush(pieces, owners, rows)
                        pieces, owners, held = [], [], 0
            flush(pieces, owners, rows)
            for row in rows:
                tail = row["text"].decode(b"", True)
                row["sha"].update(tail.encode("utf-8"))
                row["out"].append(tail)
            columns = [
                keys, pa.array([r["n"] for r in rows], pa.int64()),
                pa.array([r["ids"].hexdigest() for r in rows], pa.string()),
                pa.array([r["sha"].hexdigest() for r in rows], pa.string())]
            if with_text:
                columns += [
                    pa.array([[int(x) for a in r["all"] for x in a] for r in rows], pa.list_(pa.int32())),
                    pa.array(["".join(r["out"]) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.select(key, text).mapInArrow(run, schema)

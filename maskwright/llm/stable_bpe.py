"""Exact BPE encoding of texts in pieces that cannot influence each other.

A *stable cut* is a place where no tokenizer rule looks from one side to the
other, so that ``encode(left) + encode(right) == encode(left + right)``:

* before an ASCII space that follows a character which is no white space.  The
  split patterns of the supported files never run from a non-space into white
  space, look ahead only over white space, and never look back; special tokens
  hold no space; an ASCII space never composes with its neighbours.
* inside a run without spaces, at a token end that has at least the merge
  list's *sufficient lookahead* to its right (see :func:`sufficient_lookahead`).

Texts are cut into segments by the first rule with array operations; every
distinct segment is encoded by the tokenizers library once per task and looked
up afterwards.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

SLICE_BYTES = 6_000_000
# Rows of an Arrow batch where texts are encoded; a batch and its copies lie in memory whole.
ROWS_PER_BATCH = 2_000
MEMO_ENTRIES = 600_000
MEMO_CHARS = 24_000_000

_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]


def sufficient_lookahead(merges: list[tuple[str, str]], end_mark: str = "") -> int:
    """Bytes to the right of a token boundary after which it is final.

    A boundary vanishes when a rule ``(u, v)`` joins its two sides.  Whether
    ``v`` stands to its right depends on ``v`` itself and on its right end not
    having vanished earlier, by a rule of smaller rank whose left part is one of
    the tokens that end there while ``v`` is being built.  Ranks fall along such
    a chain, so one pass in rank order finds the longest one.

    >>> sufficient_lookahead([("a", "b"), ("b", "c"), ("x", "bc")])
    2
    """
    best: dict[str, int] = {}
    right_part: dict[str, str] = {}
    longest = 0
    for left, right in merges:
        after, token = 0, right
        while token is not None:
            after = max(after, best.get(token, 0))
            token = right_part.get(token)
        need = len(right.replace(end_mark, "") if end_mark else right) + after
        longest, best[left] = max(longest, need), max(best.get(left, 0), need)
        right_part[left + right] = right
    return longest


def _parts_first(merges: list[tuple[str, str]]) -> bool:
    """Every rule joins single symbols or results of earlier rules, each once."""
    made: set[str] = set()
    later = {a + b for a, b in merges}
    for left, right in merges:
        if any(x in later and x not in made for x in (left, right)) or left + right in made:
            return False
        made.add(left + right)
    return True


def as_text(column: pa.Array) -> pa.Array:
    """The column as strings, null as empty text."""
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """``(first row, rows)`` of consecutive parts of about ``limit`` bytes."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, int(ends[row]) + limit, "right")) - 1)
        yield row, column.slice(row, stop - row)
        row = stop


def stable_cuts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of all texts in order, and the first segment of each text."""
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    low, high = int(ends[0]), int(ends[-1])
    if low == high:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[low:high]
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    before = data[at - 1]
    plain = np.ones(256, bool)
    plain[_SPACES] = False
    keep = plain[before]
    # White space beyond ASCII ends in one of these byte pairs.
    wide = np.flatnonzero(before >= 128)
    lead = data[np.maximum(at[wide] - 2, 0)]
    third = data[np.maximum(at[wide] - 3, 0)]
    white = (lead == 0xC2) & np.isin(before[wide], (0x85, 0xA0))
    white |= np.isin(third, (0xE1, 0xE2, 0xE3)) & np.isin(lead, (0x80, 0x81, 0x9A))
    keep[wide[white]] = False
    mark = np.zeros(high - low + 1, bool)
    mark[at[keep]] = True
    mark[ends - low] = True
    starts = np.flatnonzero(mark).astype(np.int32)
    segments = pa.Array.from_buffers(
        pa.string(), len(starts) - 1,
        [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))])
    return segments, np.searchsorted(starts, ends - low)


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, least rank first, leftmost first."""
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), 1 << 40))
        if (symbols[best], symbols[best + 1]) not in rank:
            break
        symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols


class PieceEncoder:
    """Ids of pieces of the split pattern, by a rank table.

    A rank table merges whatever neighbours form a token, a merge list only its own
    pairs.  Both agree if every token of the table comes out of its own letters: the
    part of a text that becomes a token goes through the same steps as the token
    alone.  Tokens that do not come out never occur, and are left out.

    Only plain segments are taken, of characters whose classes are the same in all
    libraries; the others are left to the tokenizers library.
    """

    PLAIN = re.compile("[\t-\r -~\xa1-\u012f\u0131-\u024f]*")
    END = b"\xff"  # no byte of UTF-8; marks the end of a word

    def __init__(self, spec: dict, merges: list[tuple[str, str]]):
        import regex
        import tiktoken

        model, steps = spec["model"], [spec.get("pre_tokenizer") or {}]
        steps += steps[0].get("pretokenizers", [])
        patterns = [s["pattern"]["Regex"] for s in steps if s.get("type") == "Split"]
        levels = [s for s in steps if s.get("type") == "ByteLevel"]
        norm = spec.get("normalizer") or {}
        names = [n["type"] for n in norm.get("normalizers", [norm])] if norm else []
        self.mark = model.get("end_of_word_suffix") or ""
        if len(levels) != 1 or levels[0].get("add_prefix_space") or not set(names) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError("unknown steps")
        self.normal = "NFC" in names
        self.lower = "Lowercase" in names
        self.split = regex.compile(patterns[0] if patterns else GPT_SPLIT)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            end = bool(self.mark) and token.endswith(self.mark)
            token = token[:-len(self.mark)] if end else token
            return bytes(letters[c] for c in token) + (self.END if end else b"")

        vocab, rank = model["vocab"], {m: i for i, m in enumerate(merges)}
        ids = [vocab[a + b] for a, b in merges]
        singles = [c for c in letters if c in vocab] + [c + self.mark for c in letters if self.mark and c + self.mark in vocab]
        if ids != sorted(set(ids)) or max(vocab[c] for c in singles) > ids[0] or len(singles) < 256:
            raise ValueError("ids are not in merge order")
        table = {raw(c): vocab[c] for c in singles}
        for a, b in merges:
            token = a + b
            body = list(token[:-len(self.mark)] if self.mark and token.endswith(self.mark) else token)
            if len(body) < len(token):
                body[-1] += self.mark
            if _joined(body, rank) == [token]:
                table[raw(token)] = vocab[token]
        if self.mark:
            table[self.END] = max(vocab.values()) + 1_000_000
        self.core = tiktoken.Encoding("pieces", pat_str="", mergeable_ranks=table, special_tokens={})

    def encode(self, segments: list[str]):
        """The plain segments, their ids in order and sizes, and the other segments."""
        plain, findall, normalize = self.PLAIN.fullmatch, self.split.findall, unicodedata.normalize
        one, end = self.core._core_bpe.encode_single_piece, self.END if self.mark else b""
        taken, ids, sizes, rest = [], [], [], []
        for segment in segments:
            if not plain(segment) or "<|" in segment:
                rest.append(segment)
                continue
            taken.append(segment)
            if self.normal and not segment.isascii():
                segment = normalize("NFC", segment)
            if self.lower:
                segment = segment.lower()
            before = len(ids)
            for piece in findall(segment):
                ids += one(piece.encode() + end)
            sizes.append(len(ids) - before)
        return taken, ids, sizes, rest


# Fixed value: the split of byte-level files that name no pattern.
GPT_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shared_encoder(path: str) -> "StableEncoder":
    """One encoder per file and process.

    Functions come to executors by value, with new module globals for each task;
    what should outlast a task is kept beside the library it wraps.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_stable_encoders", {})
    if path not in kept:
        kept[path] = StableEncoder(path)
    return kept[path]


class StableEncoder:
    """Token ids of whole texts, as the tokenizers library gives them.

    The memo is emptied when it holds ``MEMO_ENTRIES`` segments or ``MEMO_CHARS`` characters; memory is bounded by it, one slice of the input
    and ``window`` characters of a run without spaces.
    """

    def __init__(self, path: str, window: int = 8192):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("a BPE file without dropout is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if not _parts_first(merges):
            raise ValueError("a rule of the merge list comes before the parts it joins")
        mark = model.get("end_of_word_suffix") or ""
        self.lookahead = sufficient_lookahead(merges, mark)
        self.window = max(window, 4 * self.lookahead)
        # With word ends and white space dropped, a leading space changes nothing.
        steps = [spec.get("pre_tokenizer") or {}]
        steps += steps[0].get("pretokenizers", [])
        self.drops_space = any(
            s.get("behavior") == "Removed" and s.get("invert")
            and "[^\\s" in (s.get("pattern") or {}).get("Regex", "")
            for s in steps)
        try:
            self.pieces = PieceEncoder(spec, merges)
        except (ValueError, KeyError):
            self.pieces = None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.first, self.size, self.store = array("q"), array("q"), array("i")

    def full(self) -> bool:
        return len(self.known) > MEMO_ENTRIES or self.chars > MEMO_CHARS

    def _learn(self, segments: list[str]) -> None:
        rest = segments
        if self.pieces is not None:
            short = [s for s in segments if len(s) <= self.window]
            taken, ids, sizes, rest = self.pieces.encode(short)
            self._add(taken, ids, sizes)
            rest += [s for s in segments if len(s) > self.window]
        short = [s for s in rest if len(s) <= self.window]
        for at in range(0, len(short), 4096):
            some = short[at:at + 4096]
            found = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, [i for ids in found for i in ids], [len(ids) for ids in found])
        for s in rest:
            if len(s) > self.window:
                ids = [i for ids in self._stream(s) for i in ids]
                self._add([s], ids, [len(ids)])

    def _add(self, segments: list[str], ids: list[int], sizes: list[int]) -> None:
        start = len(self.first)
        self.known.update(zip(segments, range(start, start + len(segments))))
        ends = np.cumsum(np.array([len(self.store), *sizes], np.int64))
        self.first.frombytes(ends[:-1].tobytes())
        self.size.frombytes(np.array(sizes, np.int64).tobytes())
        self.store.extend(ids)

    def inner_cut(self, part: str) -> tuple[int, list[int]]:
        """The last proven boundary within a run whose end is not known yet, as a place in
        ``part``, and the ids up to it; 0 if there is none."""
        code = self.library.encode(part, add_special_tokens=False)
        spans, ids = code.offsets, code.ids
        for k in range(len(spans) - 1, 0, -1):
            end = spans[k - 1][1]
            if end > 0 and spans[k][0] == end and proven(part, end, len(part), self.lookahead):
                return end, ids[:k]
        return 0, []

    def _stream(self, text: str):
        """Ids of a long run without stable cuts, window by window."""
        at, size = 0, self.window
        while at + size < len(text):
            cut, ids = self.inner_cut(text[at:at + size])
            if cut:
                yield ids
                at, size = at + cut, self.window
            else:
                size *= 2
        yield self.library.encode(text[at:], add_special_tokens=False).ids

    def _places(self, uniques: pa.Array) -> np.ndarray:
        words = uniques.to_pylist()
        if self.drops_space:
            words = [w.strip(" ") for w in words]
        if self.full():
            self._forget()
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            self.chars += sum(map(len, new))
            self._learn(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _codes(self, texts: pa.Array):
        segments, firsts = stable_cuts(texts)
        coded = segments.dictionary_encode()
        places = self._places(coded.dictionary)
        size = np.array(self.size, np.int64)[places]
        return coded.indices.to_numpy(zero_copy_only=False), places, size, firsts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of every text."""
        codes, _, size, firsts = self._codes(texts)
        return np.diff(np.concatenate([[0], np.cumsum(size[codes])])[firsts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the first id of each text (one more at the end)."""
        codes, places, size, firsts = self._codes(texts)
        store, first = np.array(self.store, np.int32), np.array(self.first, np.int64)[places]
        lengths = size[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        index = np.repeat(first[codes] - before[:-1], lengths)
        index += np.arange(len(index))
        return store[index], before[firsts]


def proven(text: str, at: int, stop: int, lookahead: int) -> bool:
    """Whether a token boundary at ``at``, found with the text up to ``stop``, is final: the
    merge list's lookahead lies between, the character after it joins nothing to its left,
    and no special token may lie across."""
    return (at <= stop - lookahead - 32 and _starts_anew(text[at])
            and "<" not in text[max(0, at - 32):at + 32])


def _starts_anew(char: str) -> bool:
    """Whether a text may be cut before ``char``: it joins nothing to its left."""
    return (char != "'" and unicodedata.category(char)[0] in "LNPSZ"
            and not unicodedata.combining(char) and not "ᄀ" <= char <= "ᇿ")

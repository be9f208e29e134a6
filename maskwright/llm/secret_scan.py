"""Secrets in texts: fixed patterns and a character network over candidates."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..storage import cut_lineage, own_cuts
from .stable_bpe import as_text, slices

KINDS = ("assign", "access", "hex", "learned")

# Patterns, and the least length of what they must hold.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Searches by automaton over whole columns, to leave alone texts without a hit.
MAY_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
MAY_ACCESS = r"AKIA[A-Z0-9]{12}"
MAY_HEX = r"[0-9a-f]{32}"
MAY_CANDIDATE = r"[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]"

# Characters shown before a token, of it, and after it; of a longer token its first and last ones.
BEFORE, INSIDE, AFTER, TAIL = 24, 48, 8, 16
WIDTH = BEFORE + INSIDE + AFTER
POSITIVES, NEGATIVES, MADE = 2_000, 6_000, 2_000


def base_spans(text: str, assign: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the patterns find, leftmost and disjoint per kind."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST["access"]]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long tokens of letters and digits that overlap no span of ``taken``."""
    found, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
            continue
        while k < len(taken) and taken[k][0] < m.end():
            reach, k = max(reach, taken[k][2]), k + 1
        if reach <= m.start():
            found.append(m.span())
    return found


_CLASS = np.full(128, 1, np.int8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 =:\"'/+-_.,;()[]{}<>@#&\n"):
    _CLASS[ord(_c)] = _i + 2
ALPHABET = int(_CLASS.max()) + 1


def windows(texts: list[tuple[str, int, int]]) -> np.ndarray:
    """Character codes before, in and after each candidate; 0 is no character.

    A candidate of more than ``INSIDE`` characters is shown by its first ones and its
    last ``TAIL``.
    """
    out = np.zeros((len(texts), WIDTH), np.int8)
    for row, (text, start, end) in zip(out, texts):
        token = text[start:end]
        if len(token) > INSIDE:
            token = token[:INSIDE - TAIL] + token[-TAIL:]
        for place, part in ((BEFORE - min(BEFORE, start), text[max(0, start - BEFORE):start]),
                            (BEFORE, token),
                            (BEFORE + INSIDE, text[end:end + AFTER])):
            codes = np.frombuffer(part.encode("ascii", "replace"), np.uint8)
            row[place:place + len(codes)] = _CLASS[codes & 127]
    return out


@dataclass
class Network:
    """Embedding, one convolution, maximum over three zones, one linear layer."""

    embed: np.ndarray   # ALPHABET x E
    filters: np.ndarray  # (5 E) x H
    bias: np.ndarray
    out: np.ndarray     # 3 H
    offset: float
    scale: float = 1.0  # calibration of the logit
    threshold: float = 0.5
    report: dict | None = None  # recall and precision on what was held out

    ZONES = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, WIDTH))

    def _forward(self, codes):
        e = self.embed[np.pad(codes, ((0, 0), (2, 2)))]
        stacked = np.concatenate([e[:, k:k + WIDTH] for k in range(5)], axis=2)
        h = np.maximum(stacked @ self.filters + self.bias, 0)
        top = [h[:, a:b].argmax(axis=1) + a for a, b in self.ZONES]
        pooled = np.concatenate([np.take_along_axis(h, t[:, None], 1)[:, 0] for t in top], axis=1)
        return stacked, top, pooled, pooled @ self.out + self.offset

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0)] + [
            self._forward(codes[i:i + 512])[3] for i in range(0, len(codes), 512)])

    def score(self, codes: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.scale * self.logits(codes)))


def train_network(codes: np.ndarray, labels: np.ndarray, judged: np.ndarray | None = None,
                  groups: np.ndarray | None = None,
                  recall: float = 0.98, epochs: int = 6, embed: int = 12, hidden: int = 24, seed: int = 7) -> Network | None:
    """A network from labelled findings; no network without both labels.

    A fifth is held out, by ``groups``: findings made from one are of its group, and a
    group is held out as a whole.  On those ``judged`` (all, if not given or if no
    held out negative is) the logit is scaled to give probabilities, and the
    threshold is the highest that keeps ``recall``; ``report`` says what recall and precision it has there.
    """
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    groups = np.arange(len(labels)) if groups is None else np.asarray(groups)
    out_of = np.zeros(len(labels), bool)
    for side in (0, 1):  # some groups of either label
        own = np.unique(groups[labels == side])
        out_of |= np.isin(groups, rng.permutation(own)[::5]) if len(own) > 1 else False
    order = rng.permutation(len(labels))
    held, used = order[out_of[order]], order[~out_of[order]]
    if labels[used].min() == labels[used].max():
        return None
    net = Network(rng.normal(0, 0.3, (ALPHABET, embed)), rng.normal(0, (5 * embed) ** -0.5, (5 * embed, hidden)),
                  np.zeros(hidden), rng.normal(0, 0.2, 3 * hidden), 0.0)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    names = ("embed", "filters", "bias", "out")
    m = {n: np.zeros_like(getattr(net, n)) for n in names}
    v = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 128):
            at = used[i:i + 128]
            x, y = codes[at], labels[at]
            stacked, top, pooled, z = net._forward(x)
            slope = (0.5 * (1 + np.tanh(0.5 * z)) - y) * weight[at] / len(at)
            grad = {"out": pooled.T @ slope, "filters": np.zeros_like(net.filters),
                    "bias": np.zeros_like(net.bias), "embed": np.zeros_like(net.embed)}
            back = (slope[:, None] * net.out) * (pooled > 0)
            padded = np.pad(x, ((0, 0), (2, 2)))
            hidden_n = len(net.bias)
            for zone, t in enumerate(top):
                g = back[:, zone * hidden_n:(zone + 1) * hidden_n]
                picked = stacked[np.arange(len(at))[:, None], t]         # rows x H x 5E
                grad["filters"] += np.einsum("rh,rhe->eh", g, picked)
                grad["bias"] += g.sum(0)
                down = (g[:, :, None] * net.filters.T[None]).reshape(len(at), hidden_n, 5, -1)
                for k in range(5):
                    np.add.at(grad["embed"], padded[np.arange(len(at))[:, None], t + k], down[:, :, k])
            net.offset -= 0.01 * slope.sum()
            step += 1
            for n in names:
                m[n] = 0.9 * m[n] + 0.1 * grad[n]
                v[n] = 0.999 * v[n] + 0.001 * grad[n] ** 2
                setattr(net, n, getattr(net, n) - 0.005 * (m[n] / (1 - 0.9 ** step))
                        / (np.sqrt(v[n] / (1 - 0.999 ** step)) + 1e-8))
    if judged is not None and (labels[held[judged[held]]] == 0).any():
        held = held[judged[held]]
    z, y = net.logits(codes[held]), labels[held]
    if y.min() != y.max():
        scales = np.geomspace(0.05, 5, 60)
        loss = [np.mean(np.logaddexp(0, -s * z * (2 * y - 1))) for s in scales]
        net.scale = float(scales[int(np.argmin(loss))])
        scores = np.sort(net.score(codes[held[y == 1]]))
        # The highest threshold that keeps the recall; the gap below it goes to the negatives.
        low = float(scores[int((1 - recall) * len(scores))])
        rest = net.score(codes[held[y == 0]])
        under = rest[rest < low]
        net.threshold = (low + float(under.max())) / 2 if len(under) else low
        marked = net.score(codes[held]) >= net.threshold
        net.report = {"n_secret": int(y.sum()), "n_clean": int((1 - y).sum()),
                      "recall": float(marked[y == 1].mean()), "precision": float(y[marked].mean()) if marked.any() else 1.0}
    return net


def made_clean(words: list[str], n: int, seed: int = 13) -> list[str]:
    """Clean candidate tokens made of clean words: build and branch names, numbered items,
    time stamps, UUIDs and short commit names."""
    rng = np.random.default_rng(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["release", "candidate"]

    def digits(k):
        return "".join(rng.choice(list("0123456789"), k))

    def hexes(k):
        return "".join(rng.choice(list("0123456789abcdef"), k))

    out = []
    while len(out) < n:
        one, two = (words[int(i)][:int(rng.integers(4, 12))] for i in rng.integers(0, len(words), 2))
        join = "-_/"[int(rng.integers(3))]
        token = (
            f"{one}{join}{digits(int(rng.integers(1, 6)))}{join}{two}",
            f"{one}{join}{two}{digits(int(rng.integers(1, 4)))}",
            f"{hexes(8)}-{hexes(4)}-4{hexes(3)}-a{hexes(3)}-{hexes(12)}",
            f"{one}{join}{hexes(int(rng.integers(7, 13)))}",
            f"20{digits(2)}{digits(4)}T{digits(6)}Z{join}{one}",
            f"{one.upper()}{join}{digits(int(rng.integers(4, 9)))}{join}{two}",
            f"{one}{two.capitalize()}{digits(2)}{join}x64",
        )[len(out) % 7]
        while len(token) < 16:
            token += join + two
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            out.append(token)
    return out


def labelled_findings(texts: DataFrame, text: str = "text", positives: int = POSITIVES,
                      negatives: int = NEGATIVES, made: int = MADE,
                      ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels, whether to judge by them, and groups, from a bounded sample of
    texts: values that the patterns find are secrets; candidate tokens outside them, long
    words and long numbers are none.

    Secrets are also shown away from their own context, behind that of a word, and
    with their characters in other orders, so that shape and context both count; all
    that is made from one is of its group.  At most ``positives`` and ``negatives``
    findings, those of least hash over all matches, are used; words and numbers only
    fill what candidates leave, and are not judged by.  ``made`` clean
    candidates are put together from the words (see :func:`made_clean`) and shown in
    their contexts, so that a table whose texts hold few is judged by some, too.  A
    null text is empty; repeated texts add nothing; an empty table gives no findings.
    """
    word = re.compile(r"[A-Za-z][a-z]{11,}(?:[-_/.][A-Za-z]+)*|[0-9][0-9./-]{9,}"
                      r"|(?<![A-Za-z])[A-Za-z]+(?:[-_/][A-Za-z]+)+")

    def shown_in(t, a, b):
        return t[max(0, a - BEFORE):a] + "\0" + t[a:b] + "\0" + t[b:b + AFTER]

    def run(batches):
        for batch in batches:
            column = as_text(batch.column(0))
            for _, part in slices(column):
                lines, labels, clean = [], [], {0: set(), -1: set()}
                rows = _maybe_rows(part)
                for t, (assign, hexes, may, _) in zip(part.to_pylist(), rows):
                    found = base_spans(t, assign, hexes)
                    for start, kind, end in found:
                        if kind == 0:
                            start += re.search(r"[:=]\x20*[\"']?", t[start:end]).end()
                        lines.append(shown_in(t, start, end))
                        labels.append(1)
                    if may:
                        clean[0].update(shown_in(t, a, b) for a, b in candidates(t, found))
                    for m in word.finditer(t):
                        a, b = m.span()
                        if all(b <= s or a >= e for s, _, e in found):
                            clean[-1].add(shown_in(t, a, b))
                # The least of all are among the least of each slice.
                for label, some in clean.items():
                    some = sorted(some, key=lambda f: (zlib.crc32(f.encode()), f))[:negatives]
                    lines += some
                    labels += [label] * len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines, pa.string()), pa.array(labels, pa.int32())], names=["finding", "secret"])

    with own_cuts(texts.sparkSession):
        found = cut_lineage(texts.select(text).mapInArrow(run, "finding string, secret int"), "findings")

        def least(label, hash_, most):
            return [r[0] for r in found.where(F.col("secret") == label).select("finding").distinct()
                    .orderBy(hash_("finding"), "finding").limit(most).collect()]

        rows = [least(1, F.xxhash64, positives), least(0, F.crc32, negatives)]
        n_candidates = len(rows[1])
        seen = set(rows[1])
        rows[1] += [f for f in least(-1, F.crc32, negatives) if f not in seen][:negatives - n_candidates]
    rng = np.random.default_rng(11)
    split = [[f.split("\0") for f in side] for side in rows]
    shown, labels, groups = [], [], []

    def show(before, inside, after, label, group):
        shown.append((before + inside + after, len(before), len(before) + len(inside)))
        labels.append(label)
        groups.append(group)

    for k in range(max(len(split[0]), min(600, 20 * len(split[0])))):
        source = k % len(split[0])
        before, inside, after = split[0][source]
        if k >= len(split[0]) or k % 2:
            inside = "".join(rng.permutation(list(inside)))
        if k % 3 == 1 and split[1]:
            before, _, after = split[1][int(rng.integers(len(split[1])))]
        show(before, inside, after, 1, source)
    for k, finding in enumerate(split[1]):
        show(*finding, 0, len(split[0]) + k)
    spare = split[1][n_candidates:]
    words = [w for _, inside, _ in spare for w in re.findall("[A-Za-z]{3,}", inside)]
    for k, token in enumerate(made_clean(words, made) if spare and split[0] else []):
        before, _, after = spare[int(rng.integers(len(spare)))]
        show(before, token, after, 0, len(split[0]) + len(split[1]) + k)
    labels = np.array(labels)
    place = np.cumsum(labels == 0)
    judged = (labels == 1) | (place <= n_candidates) | (place > len(split[1]))
    return windows(shown), labels, judged, np.array(groups)


def _maybe_rows(part: pa.Array):
    masks = [pc.match_substring_regex(part, p).to_pylist() for p in (MAY_ASSIGN, MAY_HEX, MAY_CANDIDATE, MAY_ACCESS)]
    return zip(*masks)


def _scan(column: pa.Array, network: Network | None):
    """Sorted ``(start, kind, end)`` of every text of a column, in order."""
    for _, part in slices(as_text(column)):
        spans, shown, owners = [], [], []
        for i, (value, (assign, hexes, may, access)) in enumerate(zip(part, _maybe_rows(part))):
            spans.append([])
            if not (assign or hexes or may or access):
                continue
            t = value.as_py()
            spans[i] = base_spans(t, assign, hexes)
            if may and network is not None:
                for a, b in candidates(t, spans[i]):
                    before = min(a, BEFORE)
                    shown.append((t[a - before:b + AFTER], before, before + b - a))
                    owners.append((i, a, b))
        if shown:
            for (i, a, b), score in zip(owners, network.score(windows(shown))):
                if score >= network.threshold:
                    spans[i].append((a, 3, b))
        yield from map(sorted, spans)


def find_secrets(texts: DataFrame, network: Network | None, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Secrets of every whole text, as places; :func:`secret_values` gives them as a
    scrub's spans.

    ``texts`` are the texts to scrub, ``(doc_id, text)``.  The patterns' spans always
    stay; the network scores every candidate token with its context and adds those at
    or above its threshold, as kind ``learned``.

    Returns ``doc_id`` and ``spans``, an array of ``(start, end, kind)`` by start, then
    kind in the order of ``KINDS``; code points, end exclusive.  A null or empty text
    has none; repeated rows and null keys stay; other columns are ignored; an empty
    table gives no rows.  No shuffle.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, spans array<struct<start:int,end:int,kind:string>>"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans]
                     for spans in _scan(batch.column(1), network)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, spans_type)], names=[key, "spans"])

    return texts.select(key, text).mapInArrow(run, schema)


def secret_values(found: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The secrets as values to bind: ``(scope, real, kind, ord)``, distinct per text.

    ``found`` is the result of :func:`find_secrets` over ``texts``.  ``kind`` is
    ``api_key``, as of a scrub's own findings, ``ord`` the place of first sight; so
    ``bind_values`` and ``rewrite`` take them.  Null keys and texts without secrets
    give no rows; texts with equal keys share a scope.
    """
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        found.where(F.size("spans") > 0), F.col("_key") == F.col(key))
    rows = rows.select(F.col("_key").cast("string").alias("scope"), "_text", F.explode("spans").alias("s"))
    value = F.substring("_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select("scope", value.alias("real"), F.col("s.start").alias("at")).groupBy("scope", "real").agg(
        F.lit("api_key").alias("kind"), F.min("at").alias("ord"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    out, done = [], 0
    for start, end in sorted(spans):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out + [text[done:]])


def redact_secrets(texts: DataFrame, network: Network | None, text: str = "text",
                   mark: str = "[secret]") -> DataFrame:
    """The rows of ``texts``, all columns, with the secrets in ``text`` replaced.

    A null text stays null; repeated rows are redacted alike; an empty table gives no rows.
    """
    place = texts.columns.index(text)

    def run(batches):
        for batch in batches:
            whole = as_text(batch.column(place))
            out = [redact(t, [(s, e) for s, _, e in spans], mark) if spans else t
                   for t, spans in zip(whole.to_pylist(), _scan(whole, network))]
            new = pa.array([None if not v.is_valid else o for v, o in zip(batch.column(place), out)], pa.string())
            columns = [new if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return texts.mapInArrow(run, texts.schema)

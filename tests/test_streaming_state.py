"""The processor's state calls and its decisions over many deltas, without a stream."""

import json
import random
import re

import pandas as pd

from maskwright.streaming import restore as streams
from maskwright.streaming.restore import _Restorer, compile_mapping, decide_all


class Handle:
    """State of one group in memory; counts the calls that would go to the state server."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, []

    def getMapState(self, name, key, value, ttl=None):
        held, handle = self.states.setdefault(name, {}), self

        class State:
            def getValue(self, k):
                handle.calls += 1
                return held.get(k)

            def containsKey(self, k):
                handle.calls += 1
                return k in held

            def updateValue(self, k, v):
                handle.calls += 1
                held[k] = v

            def removeKey(self, k):
                handle.calls += 1
                held.pop(k, None)

            def iterator(self):
                handle.calls += 1
                return iter(list(held.items()))

        return State()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


COLUMNS = ["scope", "stream_id", "lane", "block", "seq", "kind", "delta", "payload"]


def taken(handle, rows, now=0, per_event=False, maps=None, idle_ms=1000):
    restorer = _Restorer(idle_ms, per_event)
    restorer.init(handle)
    if maps:
        restorer.handleInitialState((0,), pd.DataFrame(maps, columns=["scope", "mapping"]), Now(now))
    frames = restorer.handleInputRows((0,), iter([pd.DataFrame(rows, columns=COLUMNS)]), Now(now))
    return [row for pdf in frames for row in pdf.itertuples(index=False)]


def block(scope, *texts, at=0, stop=True):
    rows = [(scope, scope, 0, 0, at + k, "text", t, None) for k, t in enumerate(texts)]
    return rows + [(scope, scope, 0, 0, at + len(texts), "stop", None, None)] * stop


def test_state_calls_do_not_grow_with_scopes():
    for per_event in (False, True):
        calls = []
        for n in (200, 2000):
            handle = Handle()
            rows, maps = [], []
            for s in map(str, range(n)):
                rows += block(s, "Ask Ave", "ry n", "ow")
                maps.append((s, json.dumps({"Avery": f"Noora{s}"})))
            if per_event:
                rows = [(*r[:-1], json.dumps({"type": "content_block_delta", "index": 0, "delta": {
                    "type": "text_delta", "text": r[6]}}, separators=(",", ":")) if r[6] else "{}") for r in rows]
            out = taken(handle, rows, per_event=per_event, maps=maps)
            if not per_event:
                assert {r.stream_id: r.text for r in out} == {str(s): f"Ask Noora{s} now" for s in range(n)}
            calls.append(handle.calls)
        assert calls[0] == calls[1] <= 6 * streams.PAGES


def test_scopes_of_a_page_over_batches():
    """Open lanes, ended ones, what waits and idle times of scopes of one page stay apart."""
    handle, names = Handle(), [s for s in map(str, range(1000)) if streams.page_of(s) == 0][:4]
    a, b, c, d = names
    maps = [(s, json.dumps({"Avery": f"Noora{s}"})) for s in (a, b, c)]
    out = taken(handle, block(a, "Ave", stop=False) + block(b, "Avery") + block(c, "hole", at=1, stop=False),
                now=0, maps=maps)
    assert [(r.stream_id, r.text) for r in out] == [(b, f"Noora{b}")]
    out = taken(handle, block(a, "ry", at=1) + block(b, "again") + block(d, "Avery"), now=600)
    assert {(r.stream_id, r.text) for r in out} == {(a, f"Noora{a}"), (d, "Avery")}
    restorer = _Restorer(1000, False)
    restorer.init(handle)
    out = [r for pdf in restorer.handleExpiredTimer((0,), Now(1000), None) for r in pdf.itertuples(index=False)]
    assert [(r.stream_id, r.text, r.is_stop, r.complete) for r in out] == [(c, "hole", True, False)]
    assert not handle.states["scopes"] and not handle.states["early"]
    # Rows behind the end of a lane are dropped for the idle time, and only so long.
    out = taken(handle, block(b, "Avery") + block(c, "Avery"), now=1100)
    assert [(r.stream_id, r.text) for r in out] == [(b, f"Noora{b}")]


def test_deltas_decided_together_as_one_by_one(monkeypatch):
    """Every delta gives what it gave when each was decided with a pattern as it came."""
    chance = random.Random(11)
    for _ in range(300):
        fakes = {"".join(chance.choices("ab", k=chance.randint(1, 5))): chance.choice(["x", "yy", "a", ""])
                 for _ in range(chance.randint(0, 6))}
        deltas = ["".join(chance.choices("ab ", k=chance.randint(0, 6))) for _ in range(chance.randint(1, 8))]
        pattern = re.compile("|".join(sorted(fakes, key=lambda f: -len(f)))) if fakes else None
        longest, raw, want = max(map(len, fakes), default=0), "", []
        for k, delta in enumerate(deltas, 1):
            raw, out, at = raw + delta, "", 0
            last = len(raw) if k == len(deltas) else len(raw) - longest
            for m in pattern.finditer(raw) if pattern else ():
                if m.start() > last:
                    break
                out, at = out + raw[at:m.start()] + fakes[m.group()], m.end()
            upto = len(raw) if k == len(deltas) else max(at, last + 1, 0)
            want.append(out + raw[at:upto])
            raw = raw[upto:]
        ends = [sum(map(len, deltas[:k + 1])) for k in range(len(deltas))]
        mapping, finder, longest = compile_mapping(json.dumps(fakes))
        assert decide_all("".join(deltas), ends, mapping, finder, longest, True) == (want, "")
        if finder:
            text = "".join(deltas)
            plain = finder.spans(text)
            monkeypatch.setattr(streams, "SEARCHED", -1)
            assert finder.spans(text) == plain
            monkeypatch.undo()

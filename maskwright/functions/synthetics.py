"""Deterministic, format-preserving replacement values.

``fake_contextual`` and ``fake_hard`` are native expressions: one candidate per
(kind, real, nudge).  ``candidate`` is the same rule for a single Python value;
the row-level binder needs it because it tries further nudges only when a
candidate is taken.  The tests hold the two equal.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .hashing import (
    TWO32,
    fnv1a64,
    generated_digits,
    hex_digits,
    let,
    low48_hex,
    times_fnv_prime,
    unsigned_mod,
)

MASK64 = (1 << 64) - 1
KEY_SCHEMES = r"^(?:(?i:sk-ant)|(?i:sk-)|(?i:ghp_)|AKIA|(?i:xox)..?|[a-z]{2}_(?:live|test)_|[a-z]{2,6}_)"
HOST_SUFFIX = r"\.(?:internal|corp|local|lan|intranet)(?:\.[a-z]{2,})?$"

CONTEXT_POOLS = {
    "organization": fv.COMPANIES,
    "location": fv.CITIES,
    "job_title": fv.TITLES,
    "project_or_product": fv.PROJECTS,
    "relationship": fv.RELATIONSHIPS,
}


def _pool(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def pick_hashed(pool: list[str], h: Column) -> Column:
    return F.element_at(_pool(pool), (unsigned_mod(h, len(pool)) + 1).cast("int"))


def pick(pool: list[str], real: Column, nudge: Column | int = 0) -> Column:
    """Pool entry chosen by the hash of ``real`` salted with ``nudge``."""
    return pick_hashed(pool, fnv1a64(real, nudge))


def fake_contextual(kind: Column, real: Column, nudge: Column | int = 0) -> Column:
    """Candidate for one of the seven contextual kinds."""
    nudge = F.lit(nudge) if isinstance(nudge, int) else nudge

    def by_kind(h: Column) -> Column:
        full = F.concat_ws(
            " ", pick_hashed(fv.FIRST_NAMES, h), pick(fv.LAST_NAMES, real, nudge + 1)
        )
        out = F.when(
            kind == "person_name",
            F.when(real.contains(" "), full).otherwise(pick_hashed(fv.FIRST_NAMES, h)),
        )
        for name, pool in CONTEXT_POOLS.items():
            out = out.when(kind == name, pick_hashed(pool, h))
        redacted = F.concat(
            F.lit("[redacted-"), unsigned_mod(h, fv.REDACTED_MODULUS).cast("string"), F.lit("]")
        )
        return out.otherwise(redacted)

    return let(fnv1a64(real, nudge), by_kind)


def _card(h: Column) -> Column:
    def finish(body: Column) -> Column:
        def value(c: Column, i: Column) -> Column:
            d = c.cast("int")
            doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return F.when(i % 2 == 0, doubled).otherwise(d)

        backwards = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
        total = F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, v: a + v)
        number = F.concat(body, ((10 - total % 10) % 10).cast("string"))
        return F.concat_ws(" ", *(number.substr(i, 4) for i in (1, 5, 9, 13)))

    return let(generated_digits(h, 15), finish)


def _key_prefix(real: Column) -> Column:
    lower = F.lower(real)
    live = F.regexp_extract(real, r"^[a-z]{2}_(?:live|test)_", 0)
    short = F.regexp_extract(real, r"^[a-z]{2,6}_", 0)
    return (
        F.when(lower.startswith("sk-ant"), F.lit("sk-ant-"))
        .when(lower.startswith("sk-"), F.lit("sk-"))
        .when(lower.startswith("ghp_"), F.lit("ghp_"))
        .when(real.startswith("AKIA"), F.lit("AKIA"))
        .when(lower.startswith("xox"), F.concat(real.substr(1, 5), F.lit("-")))
        .when(live != "", live)
        .when(short != "", short)
        .otherwise("key-")
    )


def fake_hard(kind: Column, real: Column, nudge: Column | int = 0) -> Column:
    """Candidate for one of the eight hard-identifier kinds."""

    def number(value: Column) -> Column:
        return value.cast("string")

    def by_kind(h: Column) -> Column:
        lo = h["lo"]
        email = F.concat(
            F.lower(pick_hashed(fv.FIRST_NAMES, h)), number(unsigned_mod(h, 100)),
            F.lit("@example.com"),
        )
        phone = let(
            generated_digits(h, 7),
            lambda d: F.concat(F.lit("(555) "), d.substr(1, 3), F.lit("-"), d.substr(4, 4)),
        )
        ssn = let(
            generated_digits(h, 9),
            lambda d: F.concat_ws("-", d.substr(1, 3), d.substr(4, 2), d.substr(6, 4)),
        )
        octets = (number(F.shiftright(lo, s) % 256) for s in (0, 8, 16))
        ipv6 = F.concat(
            F.lit("fd00::"), F.lower(F.hex(lo % 65536)), F.lit(":"),
            F.lower(F.hex(F.shiftright(lo, 16))),
        )
        api_key = F.concat(
            _key_prefix(real), low48_hex(h), F.lit("-"), low48_hex(times_fnv_prime(h))
        )
        suffix = F.regexp_extract(real, HOST_SUFFIX, 0)
        host = F.concat(
            F.lit("host-"), hex_digits(lo, 8),
            F.when(suffix == "", F.lit(".internal")).otherwise(suffix),
        )
        return (
            F.when(kind == "email", email)
            .when(kind == "phone", phone)
            .when(kind == "ssn", ssn)
            .when(kind == "credit_card", _card(h))
            .when(kind == "ip_address", F.concat_ws(".", F.lit("10"), *octets))
            .when(kind == "ipv6", ipv6)
            .when(kind == "api_key", api_key)
            .when(kind == "internal_host", host)
        )

    return let(fnv1a64(real, nudge), by_kind)


def is_hard_kind(kind: Column) -> Column:
    return kind.isin(fv.HARD_ID_KINDS)


def fake(kind: Column, real: Column, nudge: Column | int = 0) -> Column:
    """Candidate for any kind."""
    return F.when(is_hard_kind(kind), fake_hard(kind, real, nudge)).otherwise(
        fake_contextual(kind, real, nudge)
    )


def suffix_joiner(kind: Column) -> Column:
    """What stands between a fake and the number that makes it unique."""
    return F.when(is_hard_kind(kind), F.lit("")).otherwise(F.lit(" "))


def fake_space(kind: Column, real: Column) -> Column:
    """Name of the set of candidates a value draws from; sets never overlap."""
    return F.when(
        (kind == "person_name") & real.contains(" "), F.lit("full_name")
    ).otherwise(kind)


# Number of different candidates of the small sets. E-mail: the name needs the
# hash modulo 16 and the number modulo 100, so modulo 400 decides both.
SPACE_SIZES = {
    "person_name": len(fv.FIRST_NAMES),
    "full_name": len(fv.FIRST_NAMES) * len(fv.LAST_NAMES),
    "organization": len(fv.COMPANIES),
    "location": len(fv.CITIES),
    "job_title": len(fv.TITLES),
    "project_or_product": len(fv.PROJECTS),
    "relationship": len(fv.RELATIONSHIPS),
    "other_sensitive": fv.REDACTED_MODULUS,
    "email": 400,
}


# --- The same rule for single Python values -----------------------------------


def stable_hash(text: str, salt: int = 0) -> int:
    h = ((fv.FNV_OFFSET_HI << 32) + fv.FNV_OFFSET_LO + salt) & MASK64
    for byte in text.encode("utf-8"):
        h = ((h ^ byte) * fv.FNV_PRIME) & MASK64
    return h


def _digits(seed: int, n: int) -> str:
    x, out = seed | 1, []
    for _ in range(n):
        x = (x * fv.LCG_MULTIPLIER + fv.LCG_INCREMENT) & MASK64
        out.append(str((x >> 33) % 10))
    return "".join(out)


def _hard_candidate(kind: str, real: str, h: int) -> str:
    if kind == "email":
        return f"{fv.FIRST_NAMES[h % 16].lower()}{h % 100}@example.com"
    if kind == "phone":
        d = _digits(h, 7)
        return f"(555) {d[:3]}-{d[3:]}"
    if kind == "ssn":
        d = _digits(h, 9)
        return f"{d[:3]}-{d[3:5]}-{d[5:]}"
    if kind == "credit_card":
        body = _digits(h, 15)
        doubled = [sum(divmod(2 * int(c), 10)) for c in body[::-2]]
        check = -(sum(doubled) + sum(map(int, body[-2::-2]))) % 10
        number = f"{body}{check}"
        return " ".join(number[i:i + 4] for i in (0, 4, 8, 12))
    if kind == "ip_address":
        return f"10.{h % 256}.{(h >> 8) % 256}.{(h >> 16) % 256}"
    if kind == "ipv6":
        return f"fd00::{h % 65536:x}:{(h >> 16) % 65536:x}"
    if kind == "internal_host":
        suffix = re.search(HOST_SUFFIX, real)
        return f"host-{h % TWO32:08x}{suffix.group() if suffix else '.internal'}"
    scheme = re.match(KEY_SCHEMES, real)
    found = scheme.group() if scheme else "key-"
    prefix = {"sk-ant": "sk-ant-", "sk-": "sk-", "ghp_": "ghp_"}.get(found.lower(), found)
    if found.lower().startswith("xox"):
        prefix = found + "-"
    low48 = (1 << 48) - 1
    return f"{prefix}{h & low48:012x}-{(h * fv.FNV_PRIME) & low48:012x}"


def candidate(kind: str, real: str, nudge: int) -> str:
    h = stable_hash(real, nudge)
    if kind in fv.HARD_ID_KINDS:
        return _hard_candidate(kind, real, h)
    if kind == "person_name":
        first = fv.FIRST_NAMES[h % len(fv.FIRST_NAMES)]
        if " " not in real:
            return first
        last = fv.LAST_NAMES[stable_hash(real, nudge + 1) % len(fv.LAST_NAMES)]
        return f"{first} {last}"
    if kind in CONTEXT_POOLS:
        pool = CONTEXT_POOLS[kind]
        return pool[h % len(pool)]
    return f"[redacted-{h % fv.REDACTED_MODULUS}]"


def _hash_table(texts: list[bytes], salts: np.ndarray) -> np.ndarray:
    """``stable_hash`` of every text, shortest first, with every salt."""
    sizes = np.array([len(t) for t in texts])
    basis = np.uint64((fv.FNV_OFFSET_HI << 32) + fv.FNV_OFFSET_LO) + salts.astype(np.uint64)
    h = np.repeat(basis[None, :], len(texts), axis=0)
    width = int(sizes[-1])
    codes = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8)
    codes = codes.reshape(len(texts), width).astype(np.uint64)
    for i in range(width):
        longer = np.searchsorted(sizes, i, side="right")
        h[longer:] = (h[longer:] ^ codes[longer:, i, None]) * np.uint64(fv.FNV_PRIME)
    return h


def space_tries(space: str, reals: list[str], tries: int):
    """Numbers, within a small set, of the first ``tries`` candidates of values.

    Yields ``(places of values, values x tries)`` in blocks, values of like length together.
    """
    salts = np.arange(tries) * fv.NUDGE_STEP
    texts = [r.encode("utf-8") for r in reals]
    order = np.array(sorted(range(len(texts)), key=lambda i: len(texts[i])))
    for start in range(0, len(order), 512):
        at = order[start:start + 512]
        block = [texts[i] for i in at]
        h = _hash_table(block, salts)
        if space == "full_name":
            last = _hash_table(block, salts + 1) % np.uint64(len(fv.LAST_NAMES))
            numbers = h % np.uint64(len(fv.FIRST_NAMES)) * np.uint64(len(fv.LAST_NAMES)) + last
        else:
            numbers = h % np.uint64(SPACE_SIZES[space])
        yield at, numbers.astype(np.int64)

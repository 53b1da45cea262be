"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions only near its hits, embedded checksums last.

A document's lower-cased text runs once through an Aho-Corasick automaton of keywords. Only where a keyword starts is the
anchored expression of its kind tried. Kinds without a keyword (runs of hex digits, card numbers) are found by a vectorised
run-length test over the bytes of a whole batch, and their expressions are tried in those documents alone. Formats that carry
a checksum (CRC-32 in base 62, Luhn, modulo 97) must satisfy it.

Null and empty texts have no spans. A document of any length is scanned whole; no row depends on another, so the plan is one
scan without a shuffle. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The keywords of each kind, lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
    "iban": ("iban",),
}
#: Base kinds in the order in which ties are listed.
BASE = ("assign", "access", "hex")
ANCHORED = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    "iban": re.compile(r"[Ii][Bb][Aa][Nn][:=\x20]{1,3}([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])"),
}
_HEX = re.compile(r"[0-9a-f]{32,}")
_CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
#: The digits of base 62.
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(97, 103)]] = True


def crc_ok(body: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those before them."""
    n, out = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _B62[d] + out
    return out == body[-6:]


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0 and len(set(digits)) > 1


def iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


_VALID = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: m.end() - m.start() >= 16,
    "github": lambda m: crc_ok(m[1]),
    "npm": lambda m: crc_ok(m[1]),
    "jwt": lambda m: True,
    "pem": lambda m: True,
    "iban": lambda m: iban_ok(m[1]),
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(text: str, auto, run: bool = True) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text by start, base kinds first among equals. run: it may hold a long hex run."""
    found: list[tuple[int, int, str]] = []
    over: dict[str, int] = {}
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    hits = sorted((end - n + 1, kind) for end, (kind, n) in auto.iter(low))
    for at, kind in hits:
        if at >= over.get(kind, 0) and (m := ANCHORED[kind].match(text, at)):
            over[kind] = m.end()  # a match that fails its check still uses up its characters
            if _VALID[kind](m):
                found.append((at, m.end(), kind))
    if run:
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if luhn_ok(m[0])]
    order = {k: i for i, k in enumerate((*BASE, *sorted({*KEYWORDS, "card"} - {*BASE})))}
    return sorted(found, key=lambda x: (x[0], order[x[2]], x[1]))


def long_runs(data: np.ndarray, offsets: np.ndarray, least: int = 13) -> np.ndarray:
    """Whether each document may hold a run of `least` hex digits or more."""
    other = np.flatnonzero(~_RUN[data])
    edges = np.concatenate(([-1], other, [len(data)]))
    gaps = np.flatnonzero(np.diff(edges) > least)
    out = np.zeros(len(offsets) - 1, bool)
    for g in gaps:  # a run over several documents concerns each of them
        lo, hi = np.searchsorted(offsets, (edges[g] + 1, edges[g + 1] - 1), side="right") - 1
        out[lo : hi + 1] = True
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_other long"


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans and all spans as kind:start:end."""

    def run(batches):
        auto = automaton()
        for batch in batches:
            for part in common.slices(batch):
                may = long_runs(*common.buffers(part.column(1)))
                rows = []
                for i, text in enumerate(common.texts(part.column(1))):
                    spans = scan(text, auto, bool(may[i]))
                    kinds = [k for _, _, k in spans]
                    base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE)
                    n = [kinds.count(k) for k in BASE]
                    rows.append((*n, common.sha_hex(base.encode()), ",".join(f"{k}:{a}:{b}" for a, b, k in spans), len(kinds) - sum(n)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4]), pa.array(cols[5], pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), SCHEMA)

"""URL filtering by a bit-parallel wildcard automaton.

A rule is a glob over the canonical URL ``host/path`` (host lower-cased): ``com/en/`` means the host and its subdomains,
paths that begin with ``/en/``. All rules are packed into one bit vector of several 64-bit words, one bit per pattern
character. For each character class a mask tells the bits that may consume it; one step of the automaton for all rules
is ``state = ((state << 1) | start) & mask[c] | (state & loop & mask_any)`` word by word with carries, and a column of
URLs takes each step together, a NumPy lane per URL. ``*`` is a loop bit, ``#`` marks the start of the host or of one of
its labels. The verdict is that of the longest rule that matches; without one the default holds.

Cases: a null URL and one without ``://`` have an empty host and path, match no rule and get the default; repeated rows
and very long URLs are judged like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST_END = "\x01"  # stands between host and path; never part of either
LABEL = "\x02"  # a start of the host or of a label


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def length(self) -> int:
        return len(self.name)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return host.translate(lower), rest[:end]


class Automaton:
    """Shift-And over all globs at once. A glob is (host suffix, path prefix); ``*`` inside is any run, ``?`` any
    one character. The host part begins at a label."""

    def __init__(self, globs: list[tuple[str, str]]):
        bits: list[tuple[str, bool]] = []  # character or None for any, loops
        self.last: list[int] = []
        starts = []
        for host, path in globs:
            starts.append(len(bits))
            bits.append((LABEL, False))
            for c in f"{host}{HOST_END}{path}":
                if c == "*":
                    bits[-1] = (bits[-1][0], True)
                else:
                    bits.append(("" if c == "?" else c, False))
            self.last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        pack = lambda on: np.array([sum(1 << (i % 64) for i in on if i // 64 == w) for w in range(self.words)], np.uint64)
        self.start = pack(starts)
        self.loop = pack([i for i, b in enumerate(bits) if b[1]])
        chars = sorted({c for c, _ in bits if c})
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        wild = [i for i, b in enumerate(bits) if b[0] == ""]
        self.mask = np.stack([pack(wild), *(pack([i for i, b in enumerate(bits) if b[0] == c or (b[0] == "" and c not in (LABEL, HOST_END))]) for c in chars)])
        self.inside = np.array([*[True], *(c not in (LABEL, HOST_END) for c in chars)])
        self.final = pack(self.last)

    def match(self, urls: list[tuple[str, str]]) -> np.ndarray:
        """(URLs, globs) booleans: does the glob fit the URL up to some point of its path."""
        clean = lambda x: x.replace(LABEL, "\x03").replace(HOST_END, "\x03")
        lanes = [LABEL + clean(h).replace(".", "." + LABEL) + HOST_END + clean(p) if h or p else "" for h, p in urls]
        order = np.argsort([-len(s) for s in lanes], kind="stable")
        n = len(lanes)
        state, seen = np.zeros((n, self.words), np.uint64), np.zeros((n, self.words), np.uint64)
        lens = np.array([len(lanes[k]) for k in order])
        longest = int(lens[0]) if n else 0
        get = self.code.get
        codes = np.fromiter((get(c, 0) for k in order for c in lanes[k]), np.int32, int(lens.sum()))
        first = np.cumsum(lens) - lens
        one, top = np.uint64(1), np.uint64(63)
        for t in range(longest):
            live = int(np.searchsorted(-lens, -t, side="left"))  # lanes longer than t come first
            c = codes[first[:live] + t]
            s = state[:live]
            # a label mark inside the host is no character of it: the automaton only opens new matches there
            mark = c == self.code.get(LABEL, -1)
            up = s << one
            up[:, 1:] |= s[:, :-1] >> top
            stay = s & self.loop & np.where(self.inside[c], np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
            new = (up & self.mask[c] & ~self.start) | stay
            new = np.where(mark[:, None], s | self.start, new)
            state[:live] = new
            seen[:live] |= new & self.final
        out = np.zeros((n, len(self.last)), bool)
        for g, bit in enumerate(self.last):
            out[order, g] = (seen[:, bit // 64] >> np.uint64(bit % 64)) & one == one
        return out


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (null without one), verdict."""
    ranked = sorted(rules, key=lambda r: (-r.length, r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([(r.host, r.path) for r in ranked])
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                urls = [split_url(u) for u in part.column(1).to_pylist()]
                hits = automaton.match(urls)
                best = np.where(hits.any(axis=1), hits.argmax(axis=1), -1).tolist()
                cols = [part.column(0), [h for h, _ in urls], [p for _, p in urls], [ranked[k].name if k >= 0 else None for k in best], [ranked[k].verdict if k >= 0 else default for k in best]]
                yield pa.RecordBatch.from_arrays([cols[0], *(pa.array(c, pa.string()) for c in cols[1:])], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")

"""Byte-level BPE ids of whole texts with a memo of pieces.

In a byte-level BPE vocabulary a space belongs to the word after it and a single line break stands alone, so between
two characters that are no white space each of them is a boundary of pre-tokens: the ids of a text are those of its
pieces, put together. Texts are split, and their distinct pieces found, by Arrow for many texts at once; a worker looks
up each distinct piece once, and the tokenizers library encodes those that it hasn't met lately, many in one call: as
only their first ids start with a space or are a line break, the result is cut there. Runs of white space, with the
pieces on either side, are encoded as they stand.

Of a piece that ends in ASCII marks after a letter or digit, the marks are a pre-token of their own, so that its ids are
those of its stem and of the marks. Stems of Latin letters alone are one pre-token, and go to the library's model directly.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of Unicode and what Python counts as such besides, as a class of RE2.
_WHITE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PLAIN = rf"(?s)^\n?[^{_WHITE}](?:.*[^{_WHITE}])?$"
_LEADING = rf"^[{_WHITE}]"
#: ASCII marks but the apostrophe, which may start a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_STEM_END = re.compile(f"[0-9{_LATIN}]").match
_WORD = re.compile(f"\n?[{_LATIN}]+").fullmatch


def _visible() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary; for zero, which no word holds, a space."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u2")
    out[shown] = shown
    out[[c for c in range(256) if c not in shown]] = 256 + np.arange(256 - len(shown))
    out[0] = 32
    return out


_VISIBLE = _visible()


class PieceEncoder:
    """ids(texts): the ids of whole texts as the library gives them for each.

    ``keep`` bounds the memo: two generations of at most that many short pieces each. A piece is held with the white
    space before it: a line break as it is, a space left out.
    """

    def __init__(self, path: str, keep: int = 350_000, longest: int = 64):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 65_536:
            raise ValueError("ids beyond 16 bits")
        self.keep, self.longest = keep, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.model = Tokenizer.from_file(path).model
        self.model._resize_cache(0)  # words are met once
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        (self.newline,) = self._encode(["\n"])
        self.first = np.zeros(65_536, bool)  # ids that start a piece
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.first[i] = token.startswith("Ġ")
        self.first[self.newline] = True

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(parts), 500):
            out += [np.array(e.ids, np.uint16) for e in self.tok.encode_batch_fast(parts[i : i + 500], add_special_tokens=False)]
        return out

    def _encode_plain(self, pieces: list[str]) -> list[bytes]:
        """Ids of plain pieces, many in one call."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 5000):
            part = [p if p[0] == "\n" else " " + p for p in pieces[i : i + 5000]]
            (ids,) = self._encode(["".join(part)])
            at = np.flatnonzero(self.first[ids])
            if len(at) != len(part):
                raise ValueError("this vocabulary's pieces cross white space")
            raw, ends = ids.tobytes(), [*(2 * at[1:]).tolist(), 2 * len(ids)]
            out += [raw[a:b] for a, b in zip((2 * at).tolist(), ends, strict=True)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces of Latin letters."""
        text = "\0".join([w[1:] if w[0] == "\n" else " " + w for w in words])
        shown = _VISIBLE[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le").split(" ")
        newline, out = self.newline.tobytes(), []
        for w, c in zip(words, shown, strict=True):
            b = array("H", [t.id for t in self.model.tokenize(c)]).tobytes()
            out.append(newline + b if w[0] == "\n" else b)
        return out

    def _encode_marks(self, marks: str) -> bytes:
        b = self.marks.get(marks)
        if b is None:
            b = self._encode([marks])[0].tobytes()
            if len(marks) <= self.longest and len(self.marks) < 20_000:
                self.marks[marks] = b
        return b

    def _encode_fresh(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces that the memo lacks, None for those that are not plain; the memo takes the plain ones."""
        out: list[bytes | None] = [None] * len(pieces)
        words, others = [], []
        for k, p in enumerate(pieces):
            (words if _WORD(p) else others).append(k)
        # the memo holds plain pieces only
        plain = pc.match_substring_regex(pa.array([pieces[k] for k in others], pa.large_string()), _PLAIN).to_pylist()
        others = [k for k, yes in zip(others, plain, strict=True) if yes]
        for which, encode in ((words, self._encode_words), (others, self._encode_plain)):
            if which:
                for k, b in zip(which, encode([pieces[k] for k in which]), strict=True):
                    out[k] = b
                    if len(pieces[k]) <= self.longest:
                        self.new[pieces[k]] = b
        return out

    def _look_up(self, distinct: pa.Array) -> tuple[list[str], list[bytes], np.ndarray]:
        """The distinct pieces, their ids (none if odd) and which of them are odd."""
        pieces = distinct.to_numpy(zero_copy_only=False).tolist()
        new, old = self.new, self.old
        got = list(map(new.get, pieces))
        fresh: dict[str, bytes | None] = {}
        waiting = []  # place, what is to be encoded, and the marks after it
        for k in [k for k, b in enumerate(got) if b is None]:
            p, marks = pieces[k], ""
            b = old.get(p)
            if b is None:
                stem = p.rstrip(_MARKS)
                if len(stem) < len(p) and stem and _STEM_END(stem[-1]):
                    p, marks = stem, p[len(stem) :]
                    b = new.get(p)
                    if b is None:
                        b = old.get(p)
                        if b is not None:
                            new[p] = b
            else:
                new[p] = b
            if b is None:
                fresh[p] = None
                waiting.append((k, p, marks))
            else:
                got[k] = b + self._encode_marks(marks) if marks else b
        odd = np.zeros(len(pieces), bool)
        if fresh:
            fresh = dict(zip(fresh, self._encode_fresh(list(fresh)), strict=True))
            for k, p, marks in waiting:
                b = fresh[p]
                if b is None:
                    odd[k] = True
                    got[k] = b""
                else:
                    got[k] = b + self._encode_marks(marks) if marks else b
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {}
        return pieces, got, odd

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids u16 of all texts, n + 1 offsets). The empty text has none."""
        n = len(texts)
        odd_text = pc.match_substring_regex(texts, _LEADING)
        for s in self.special:  # special strings may span pieces
            odd_text = pc.or_(odd_text, pc.match_substring(texts, s))
        odd_text = odd_text.to_numpy(zero_copy_only=False)
        plain_text = ~odd_text & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        chosen = np.flatnonzero(plain_text)
        got, sizes = self._split_ids(texts.take(pa.array(chosen)).cast(pa.large_string()))
        if not odd_text.any():
            lens = np.zeros(n, np.int64)
            lens[chosen] = sizes
            return got, np.concatenate([[0], np.cumsum(lens)])
        parts: list[np.ndarray] = [np.zeros(0, np.uint16)] * n
        ends = np.cumsum(sizes)
        for k, a, b in zip(chosen.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            parts[k] = got[a:b]
        whole = np.flatnonzero(odd_text)
        for k, ids in zip(whole.tolist(), self._encode(texts.take(pa.array(whole)).to_pylist()), strict=True):
            parts[k] = ids
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _split_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that start with no white space and are not empty."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        # a text is taken as the rest of a line, whose break is dropped in the end
        empty = pa.scalar("", pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(empty, texts, pa.scalar("\n", pa.large_string())), "\n", " \n"), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        del lists
        at = coded.indices.to_numpy(zero_copy_only=False)
        pieces, values, is_odd = self._look_up(coded.dictionary)
        odd = is_odd[at]
        odd[ends[:-1]] = False  # the empty piece before a text
        if odd.any():
            at = self._stretches(at, odd, ends, pieces, values)
        lens = np.fromiter(map(len, values), np.int32, len(values)) // 2
        pool = np.frombuffer(b"".join(values), np.uint16)
        size = lens[at]
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        small = np.int32 if max(before[-1], len(pool)) < 2**31 else np.int64
        place = np.repeat((np.cumsum(lens, dtype=small) - lens)[at] - before[:-1].astype(small), size)
        place += np.arange(before[-1], dtype=small)
        ids = pool.take(place, mode="clip")
        del place, size
        starts = before[ends]
        keep = np.ones(len(ids), bool)
        keep[starts[:-1]] = False
        return ids[keep], np.diff(starts) - 1

    def _stretches(self, at: np.ndarray, odd: np.ndarray, ends: np.ndarray, pieces: list[str], values: list[bytes]) -> np.ndarray:
        """Encodes odd pieces with their neighbours: the first piece of a stretch stands for all of it in the result,
        the others for nothing. Adds to ``values``."""
        inside = np.ones(len(at), bool)  # whether a piece and the one before it are of one text
        inside[ends[:-1]] = False
        inside[np.minimum(ends[:-1] + 1, len(at) - 1)] &= False  # a text's first piece starts anew
        joined = inside & (odd | np.concatenate([[False], odd[:-1]]))
        after = np.concatenate([joined[1:], [False]])
        begin = np.flatnonzero(~joined & after)
        stop = np.flatnonzero(joined & ~after) + 1
        texts = []
        for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
            texts.append("".join(p if p[:1] == "\n" else " " + p for p in map(pieces.__getitem__, at[a:b].tolist())))
        # a text of one odd piece has no neighbour
        alone = np.flatnonzero(odd & ~joined & ~after)
        texts += [pieces[k] if pieces[k][:1] == "\n" else " " + pieces[k] for k in at[alone].tolist()]
        out = at.astype(np.int64)
        out[joined] = len(values)
        values.append(b"")
        begin = np.concatenate([begin, alone])
        out[begin] = len(values) + np.arange(len(begin))
        distinct = list(dict.fromkeys(texts))
        coded = dict(zip(distinct, self._encode(distinct), strict=True))
        values += [coded[t].tobytes() for t in texts]
        return out


def slices(batch: pa.RecordBatch, column: int, size: int = 4_000_000):
    """Parts of ``batch`` whose texts have about ``size`` bytes."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary; it outlives a task."""
    held = sys.modules[__name__].__dict__.setdefault("_held", {})
    if path not in held:
        held[path] = PieceEncoder(path)
    return held[path]


def vocabulary(name_or_path: str) -> str:
    """A vocabulary file by its public name, or by path; resolved where it is used, so each machine finds its own."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)

"""Whole-text encoding with a ready-made tokenizer, in one Python worker at a time.

The two kinds of file that the operators use split a text where a single space stands between
two characters that are not white space, so the pieces between such spaces can be encoded apart and
their ids joined.  A batch is cut and its distinct pieces are found in Arrow; only those not seen before are encoded, and
the ids of all texts are then gathered with numpy.  Texts with any other white space beside a space are encoded as a whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tidy

ENCODERS: dict[tuple, "Encoder"] = {}


def plain(word: str) -> bool:
    """Letters only, also once a file's normaliser has composed and lower-cased them."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Encoder:
    """``spaced``: a space belongs to the piece that follows it (byte-level files); otherwise white space has no ids.

    Pieces seen before, at most ``memory`` of at most ``longest`` bytes, are an Arrow array beside an array of all their ids.
    """

    def __init__(self, path: str, spaced: bool, memory: int = 500_000, longest: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.memory, self.longest = spaced, memory, longest
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = pa.array([], pa.string())
        self.ids, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int32)
        self.stops = dict(zip(",.", self.whole([",", "."]), strict=True))
        self.line = self.whole(["\n"])[0]

    @classmethod
    def of(cls, path: str, spaced: bool, memory: int = 500_000) -> "Encoder":
        """One encoder for each file in a worker process."""
        if (path, spaced) not in ENCODERS:
            ENCODERS[path, spaced] = cls(path, spaced, memory)
        return ENCODERS[path, spaced]

    def whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.kind).tobytes() for x in done]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        ends, values = self.encode_column(pa.array(texts, pa.string()))
        return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, ``end_id`` appended to each; null counts as empty."""
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, "<u4")
        texts = texts.cast(pa.string()).fill_null("")
        if not self.spaced:  # white space has no ids, so a line's end may as well be a space
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        flat = lists.flatten()
        found = pc.index_in(flat, value_set=self.known)
        unknown = pc.is_null(found)
        which = found.fill_null(0).to_numpy().copy()
        fresh = flat.filter(unknown).dictionary_encode()
        base = len(self.known)
        which[unknown.to_numpy(zero_copy_only=False)] = base + fresh.indices.to_numpy()
        words = fresh.dictionary.to_pylist()
        pieces, bad = self._ids_of(words)
        n_words = len(pieces)
        if self.spaced:
            heads = [x.partition(" ")[0] for x in texts.to_pylist()]
            wrong = np.zeros(base + n_words + len(heads), dtype=bool)
            wrong[base + np.array(bad, dtype=np.int64)] = True
            wrong[base + n_words :] = [bool(w) and (w[0].isspace() or w[-1].isspace()) for w in heads]
            which[at[:-1]] = base + n_words + np.arange(len(heads), dtype=np.int32)
            pieces += self.whole(heads)
            odd = np.maximum.reduceat(wrong[which], at[:-1])
            if odd.any():
                rows = np.flatnonzero(odd)
                which[at[:-1][rows]] = base + len(pieces) + np.arange(len(rows), dtype=np.int32)
                pieces += self.whole([texts[int(k)].as_py() for k in rows])
                use = np.repeat(~odd, np.diff(at))
                use[at[:-1]] = True
                which, at = which[use], np.concatenate([[0], np.cumsum(np.add.reduceat(use.astype(np.int64), at[:-1]))])
        if end_id is not None:
            which = np.insert(which, at[1:], base + len(pieces))
            pieces.append(np.array([end_id], dtype=self.kind).tobytes())
            at = at + np.arange(len(at))
        width = self.kind.itemsize
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, pieces), np.int32, len(pieces)) // width])
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(pieces), dtype=self.kind)])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        take = np.repeat((starts[which] - ends[:-1]).astype(np.int32 if ends[-1] + len(ids) < 1 << 31 else np.int64), n)
        take += np.arange(len(take), dtype=take.dtype)
        self._remember(fresh.dictionary, pieces[:n_words], bad)
        return ends[at], ids[take].astype("<u4")

    def _remember(self, words: pa.Array, pieces: list[bytes], bad: list[int]) -> None:
        room = self.memory - len(self.known)
        if room <= 0 or not len(words):
            return
        fit = pc.less_equal(pc.binary_length(words), self.longest).to_numpy(zero_copy_only=False).copy()
        fit[bad] = False
        rows = np.flatnonzero(fit)[:room]
        self.known = pa.concat_arrays([self.known, words.take(pa.array(rows))])
        some = [pieces[i] for i in rows.tolist()]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(some), dtype=self.kind)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, some), np.int32, len(some)) // self.kind.itemsize])

    def _ids_of(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of distinct pieces, each after a space if ``spaced``; and the places of those that cannot stand alone."""
        out: list[bytes] = [b""] * len(words)
        bad: list[int] = []
        plan: list[tuple[int, str, bytes, str]] = []  # place, letters, ids that follow, letters after a line's end
        rest: list[int] = []
        need_heads: set[str] = set()
        for i, w in enumerate(words):
            if plain(w):
                plan.append((i, w, b"", ""))
                continue
            if self.spaced and (not w or w[0].isspace() or w[-1].isspace()):
                bad.append(i)
                continue
            first, end, tail = w.partition("\n")
            base, stop = (first[:-1], self.stops[first[-1]]) if first[-1:] in self.stops else (first, b"")
            if not plain(base) or end and not plain(tail):
                rest.append(i)
                continue
            if end:
                stop += self.line
                need_heads.add(tail)
            plan.append((i, base, stop, tail))
        bases = self._letters(list({x[1] for x in plan}), " " if self.spaced else "")
        heads = self._letters(list(need_heads), "")
        for i, base, stop, tail in plan:
            out[i] = bases[base] + stop + heads[tail] if tail else bases[base] + stop
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for i, x in zip(some, self.whole([" " * self.spaced + words[i] for i in some]), strict=True):
                out[i] = x
        return out, bad

    def _letters(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of words that are letters only, each after ``lead``; many are encoded at once where each is one unit of the file."""
        got: dict[str, bytes] = {}
        if self.spaced and not lead:
            return dict(zip(words, self.whole(words), strict=True))
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            done = self.tokenizer.encode(lead + " ".join(some), add_special_tokens=False)
            of = np.array(done.word_ids)
            if len(of) and of[-1] + 1 == len(some):
                cuts = (of.searchsorted(np.arange(len(some) + 1)) * self.kind.itemsize).tolist()
                data = np.array(done.ids, dtype=self.kind).tobytes()
                got.update(zip(some, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:  # a letter that the file splits further
                got.update(zip(some, self.whole([lead + w for w in some]), strict=True))
        return got


def slices(texts: pa.Array, size: int = 5_000_000) -> list[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def gather(batches, size: int = 5_000_000):
    """Record batches of about ``size`` bytes of their column 1, from batches of any size, in the same order."""
    held: list[pa.RecordBatch] = []
    total = given = 0
    for batch in batches:
        for a, b in slices(batch.column(1), size):
            part = batch.slice(a, b - a)
            n = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if held and total + n > size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total, given = [], 0, given + 1
                if given % 8 == 0:
                    tidy()
            held.append(part)
            total += n
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield rows.combine_chunks().to_batches()[0]




"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into words by the vocabulary's pattern, from the classes of all characters at once. The words of a batch that were not met before lie in
one flat array of symbols; in each round every word finds its neighbouring pair of lowest rank by binary search
over the sorted pair keys and merges that pair wherever it stands, all words at once, until no word has a pair
left. A word's tokens are remembered up to a bounded number of words.

Null and empty texts have no tokens. Rows are judged each on its own, so repeated ids make no difference.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.shared import as_bytes, concat_ranges, steps

#: Words remembered by one Python worker before it starts anew (some 100 MB at most).
REMEMBERED = 150_000
#: Fixed value: the pattern of byte-level vocabularies, which word_starts() follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = range(4)


def character_classes() -> np.ndarray:
    """The pattern's class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, like in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(like, every):
            out[run.start() : run.end()] = kind
    return out


def word_starts(points: np.ndarray, classes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Whether a word of PATTERN starts at each code point; text_starts: where each (non-empty) text starts."""
    n = len(points)
    kind = classes[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last of some white space goes with what follows if it is a blank, and stands alone if not
    leads = np.zeros(n, bool)
    leads[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= leads
    joined = np.flatnonzero(leads & (points == 32)) + 1
    start[joined] = False
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    if len(quote):
        after = np.append(points, [0, 0])
        bound = np.append(first, True)
        one, two = after[quote + 1], after[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & ~first[quote + 1]
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        double &= ~first[quote + 1] & ~bound[quote + 2]
        start[quote[single | double] + 1] = False
        for at in (quote[single & ~double] + 2, quote[double] + 3):
            start[at[at < n]] = True
    return start


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary file's merges and tokens as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        tokens = [b""] * self.size
        for token, k in vocab.items():
            tokens[k] = bytes(back[c] for c in token)
        for token, k in self.special.items():
            tokens[k] = token.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.classes = character_classes()
        self.special_bytes = {t.encode(): k for t, k in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def rank_of(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The merge rank of each pair (at, at + 1); len(merged) if there is none or its symbols are of two words."""
        pair = symbols[at] * self.size + symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        fits = (self.keys[found] == pair) & (word[at] == word[at + 1])
        return np.where(fits, self.ranks[found], len(self.merged))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and how many each word has."""
        count = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), count)
        done_word, done_symbols = [], []
        none = len(self.merged)
        rank = np.append(self.rank_of(symbols, word, np.arange(max(0, len(symbols) - 1))), none)[: len(symbols)]
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = best == none
            if over.any():
                done_word.append(word[over])
                done_symbols.append(symbols[over])
                live = ~over
                word, symbols, rank, best = word[live], symbols[live], rank[live], best[live]
                if not len(word):
                    break
            spots = np.flatnonzero(rank == best)
            fresh = np.diff(spots, prepend=-2) > 1  # in a run such as aaaa only every second pair merges
            run_start = spots[np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))]
            spots = spots[(spots - run_start) % 2 == 0]
            symbols[spots] = self.merged[rank[spots]]
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            moved = spots - np.arange(len(spots))
            renewed = np.concatenate([moved, moved - 1])
            rank[moved] = none
            renewed = renewed[(renewed >= 0) & (renewed < len(symbols) - 1)]
            rank[renewed] = self.rank_of(symbols, word, renewed)
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def cut(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The words of all texts, one after the other, and how many each text has."""
        if self.split is not None and any(s in t for t in texts for s in self.special):
            pieces, counts = [], []
            for text in texts:
                before = len(pieces)
                for part in self.split.split(text):
                    pieces += [part.encode()] if part in self.special else self.cut([part])[0]
                counts.append(len(pieces) - before)
            return pieces, np.array(counts, np.int64)
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        start = np.flatnonzero(word_starts(points, self.classes, begins[lengths > 0]))
        data = whole.encode("utf-8", "surrogatepass")
        if len(data) == len(points):
            at = np.append(start, len(data))
        else:
            wide = np.cumsum((points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)
            at = np.append(start + np.where(start > 0, wide[start - 1], 0), len(data))
        at = at.tolist()
        counts = np.diff(np.append(np.searchsorted(start, begins), len(start)))
        return [data[a:b] for a, b in zip(at, at[1:])], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after the other, and how many each text has."""
        if len(self.known) > REMEMBERED or len(self.held) > 16 * REMEMBERED:
            self.forget()
        pieces, per_text = self.cut(texts)
        known = self.known
        word = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(word < 0).tolist()
        if missing:
            size = len(known)
            for k in missing:
                known.setdefault(pieces[k], len(known))
            new = list(islice(known, size, None))
            special = {k: self.special_bytes[w] for k, w in enumerate(new) if w in self.special_bytes}
            ids, counts = self.merge([w if k not in special else w[:1] for k, w in enumerate(new)])
            at = np.concatenate([[0], np.cumsum(counts)])
            for k, token in special.items():
                ids[at[k]] = token
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.held = np.concatenate([self.held, ids])
            word[missing] = np.fromiter((known[pieces[k]] for k in missing), np.int64, len(missing))
        starts, counts = self.at[word], self.at[word + 1] - self.at[word]
        out = self.held[concat_ranges(starts, counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of tokens; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        data = self.data[concat_ranges(self.starts[ids], self.lengths[ids])].tobytes()
        size = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        ends = size[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_loaded: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """The vocabulary at a path, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """(id, ids, decoded) of each row: its token ids, and the text that they decode to; with carry_text, also its bytes.

    path: a vocabulary file that every executor has (it comes with an installed package).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in steps(batches, most=1 << 20):
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            ids, counts = bpe.encode(texts)
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            found = [batch.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(ids, pa.int32())), pa.array(bpe.decode(ids, counts), pa.string())]
            yield pa.record_batch([*found, batch.column("text")][: len(names)], names=names)

    names = ["id", "ids", "decoded", "text"][: 4 if carry_text else 3]
    return docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text")).mapInArrow(
        run, "id long, ids array<int>, decoded string" + (", text binary" if carry_text else "")
    )

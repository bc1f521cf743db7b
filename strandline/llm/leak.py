"""Evaluation texts leaking into training text.

The test items are an inverted index with BM25 weights whose postings lie in blocks of items, with
the largest weight of each term in each block. Every passage of ``run`` words of every training
text is a query. A passage that equals ``run`` words of an item has all its words in that item's
postings and scores on it what that window of the item scores; so

1. the pivot of a passage is the last of its words, and blocks that lack a posting of any word
   before it are passed over. Which blocks have them all is one AND over the words' block maps;
2. blocks whose bound, the sum of the words' block maxima, stays below what their items require
   are passed over;
3. the items of the other blocks are scored in full from the postings, words counted as often as
   they occur, and dropped below their threshold, the score of their weakest window;
4. what is left is verified word by word, and the question of the item against the whole text.

No step loses a passage that holds ``run`` words of an item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 15
#: Postings in one index at most, which bounds its memory; more items make more indexes, all probed in one pass over the texts.
POSTINGS_PER_INDEX = 1_500_000
#: Items in a block of postings at least, and blocks at most: block maps have a bit for each.
BLOCK, BLOCKS = 2, 4_096
#: Characters, and words, that are looked at together; longer texts are cut into slices, of words that overlap by a run.
SLICE = 500_000
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in one letter case."""
    return _WORD.findall(text.upper().lower())


class Index:
    """Postings of test items by term, with block maps and maxima, thresholds, and the runs that verify a hit."""

    def __init__(self, items: list[tuple[int, str, str]], run: int = RUN, block: int = BLOCK, blocks: int = BLOCKS) -> None:
        self.run = run
        held = [(i, w, q) for i, t, q in items if len(w := words_of(t or "")) >= run]
        # items that begin alike in a block: bounds are tighter where items share words
        held.sort(key=lambda x: (x[1], x[0]))
        self.ids = np.array([i for i, *_ in held], np.int64)
        self.questions = [frozenset(words_of(q or "")) for *_, q in held]
        # a term is the hash of a word; words that share one are one term, which loses nothing
        hashed = [Words([" ".join(w)]).hashes for _, w, _ in held]
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        code = [np.searchsorted(self.hashes, h) for h in hashed]
        n, m = len(held), len(self.hashes)
        self.per_block = max(block, -(-n // blocks))
        self.blocks = max(1, -(-n // self.per_block))
        # postings (term, item) in order, each with its weight
        size = np.array([len(c) for c in code], np.int64)
        pair, tf = np.unique(np.concatenate(code or [np.zeros(0, np.int64)]) * max(1, n) + np.repeat(np.arange(n), size), return_counts=True)
        term, item = pair // max(1, n), pair % max(1, n)
        df = np.bincount(term, minlength=m)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * size[item] / max(1.0, size.mean() if n else 1.0))
        self.pair, self.weight = pair, (idf[term] * tf * (K1 + 1) / norm).astype(np.float64)
        # block postings (term, block) in order, each with its largest weight
        at = term * self.blocks + item // self.per_block
        self.block_pair, first = np.unique(at, return_index=True)
        self.block_weight = np.maximum.reduceat(self.weight, first) if len(at) else np.zeros(0)
        # a bit for each block that has a posting of the term; the last row is a word no item has
        self.maps = np.zeros((-(-self.blocks // 64), m + 1), np.uint64)
        t, b = self.block_pair // self.blocks, self.block_pair % self.blocks
        np.bitwise_or.at(self.maps, (b // 64, t), np.uint64(1) << (b % 64).astype(np.uint64))
        self.need = np.full(self.blocks * self.per_block, np.inf)
        self.runs: dict[str, list[int]] = {}
        for k, (_, w, _) in enumerate(held):
            total = np.r_[0.0, np.cumsum(self.score(code[k], np.full(len(w), k)))]
            self.need[k] = (total[run:] - total[:-run]).min() * (1 - 1e-9)  # above rounding
            for i in range(len(w) - run + 1):
                hits = self.runs.setdefault(" ".join(w[i : i + run]), [])
                if k not in hits:
                    hits.append(k)
        self.block_need = self.need.reshape(self.blocks, self.per_block).min(axis=1)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The terms of hashed words; the number of terms for a word that no item has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, len(self.hashes))

    def score(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The weights of the postings (term, item); 0 where there is none."""
        want = term * max(1, len(self.ids)) + item
        at = np.minimum(np.searchsorted(self.pair, want), max(0, len(self.pair) - 1))
        return np.where(self.pair[at] == want, self.weight[at], 0.0)

    def passages(self, code: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where a passage begins, block) of all passages whose words all have postings in the block; ``whole`` tells which beginnings are of a passage in one text."""
        starts, blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, column in enumerate(self.maps):
            held = column[code]
            # the AND of each run of words, by doubling
            width = 1
            while width * 2 <= self.run:
                held = held[:-width] & held[width:]
                width *= 2
            if width < self.run:
                held = held[: -(self.run - width)] & held[self.run - width :]
            at = np.flatnonzero((held != 0) & whole)
            bits = np.unpackbits(held[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            starts.append(at[row])
            blocks.append(bit + 64 * j)
        return np.concatenate(starts), np.concatenate(blocks)

    def above(self, words: np.ndarray, row: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the passages (rows of ``words``) and blocks whose bound and whose score reach what is required."""
        bound = self.block_weight[np.searchsorted(self.block_pair, words[row] * self.blocks + block[:, None])].sum(axis=1)
        live = bound >= self.block_need[block]
        row, block = np.repeat(row[live], self.per_block), block[live]
        item = (block[:, None] * self.per_block + np.arange(self.per_block)).reshape(-1)
        real = item < len(self.ids)
        row, item = row[real], item[real]
        good = self.score(words[row], item[:, None]).sum(axis=1) >= self.need[item]
        return row[good], item[good]


class Words:
    """The words of several texts, one after the other, as 64-bit hashes, with where they stand.

    Words are cut and hashed as arrays over all characters. Equal words have equal hashes; that
    different ones may share one is left to the verification of hits.
    """

    def __init__(self, texts: list[str]) -> None:
        self.parts: list[tuple[int, str, np.ndarray, np.ndarray]] = []
        hashes, owners, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for first, part in _parts(texts):
            folded = part.upper().lower()
            chars = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = _in_words(chars)
            edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
            start, end = edge[::2], edge[1::2]
            hashes.append(_hashes(chars, start, end))
            owners.append(first + np.searchsorted(np.flatnonzero(chars == 0), start))
            self.parts.append((n, folded, start, end))
            n += len(start)
        self.hashes, self.owners = np.concatenate(hashes), np.concatenate(owners)
        self._at = np.array([p[0] for p in self.parts])

    def words(self, i: int, n: int) -> list[str]:
        """n words from the i-th on."""
        out: list[str] = []
        k = int(np.searchsorted(self._at, i, side="right")) - 1
        while len(out) < n and k < len(self.parts):
            at, folded, start, end = self.parts[k]
            out += [folded[a:b] for a, b in zip(start[i - at + len(out) :][: n - len(out)].tolist(), end[i - at + len(out) :][: n - len(out)].tolist())]
            k += 1
        return out


def _parts(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(number of the first text, texts joined by NUL) in parts of about ``SLICE`` characters; a longer text is cut between words."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.replace("\x00", " ")
        if len(t) > SLICE:
            if held:
                yield first, "\x00".join(held)
            a = 0
            while a < len(t):
                b = min(len(t), a + SLICE)
                while b < len(t) and (t[b].isalnum() or t[b - 1].isalnum()):
                    b += 1
                yield i, t[a:b]
                a = b
            held, size, first = [], 0, i + 1
            continue
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield first, "\x00".join(held)
            held, size, first = [], 0, i + 1
    if held:
        yield first, "\x00".join(held)


_KINDS = np.full(0x110000, 2, np.uint8)  # of a character: in words, not, not yet known
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _in_words(chars: np.ndarray) -> np.ndarray:
    kinds = _KINDS[chars]
    if (kinds == 2).any():
        for c in np.unique(chars[kinds == 2]).tolist():
            _KINDS[c] = bool(_WORD.match(chr(c)))
        kinds = _KINDS[chars]
    return kinds.view(bool)


def _hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of character times power of its place in the word, modulo 2^64, from running sums over all characters."""
    n = len(chars)
    if len(_POWERS[0]) < n:
        back = pow(int(_ODD), -1, 1 << 64)
        for k, base in enumerate((_ODD, np.uint64(back))):
            _POWERS[k] = np.cumprod(np.full(n, base, np.uint64))
    mixed = chars.astype(np.uint64)
    mixed = (mixed ^ (mixed << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * _POWERS[0][:n], out=total[1:])
    return (total[end] - total[start]) * _POWERS[1][start] if len(start) else np.zeros(0, np.uint64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, so many together as have about ``SLICE`` characters."""
    keys, texts, size = [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= SLICE:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _probe(index: Index, keys: list[int], text: Words) -> list[tuple]:
    """(doc, item, passages, question) for a group of texts. Equal passages are looked up once."""
    run, owners = index.run, text.owners
    found: dict[tuple[int, int], set[str]] = {}
    for c in range(0, len(owners) - run + 1 if len(index.ids) else 0, SLICE):
        own = owners[c : c + SLICE + run - 1]
        code = index.codes(text.hashes[c : c + SLICE + run - 1])
        start, block = index.passages(code, own[: len(own) - run + 1] == own[run - 1 :])
        if not len(start):
            continue
        at = np.unique(start)
        words, first, which = np.unique(code[at[:, None] + np.arange(run)], axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        pair = np.unique(which[np.searchsorted(at, start)] * index.blocks + block)
        row, item = index.above(words, pair // index.blocks, pair % index.blocks)
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(len(words) + 1))
        for r, k in zip(row.tolist(), item.tolist()):
            passage = " ".join(text.words(int(at[first[r]]) + c, run))
            if k in index.runs.get(passage, ()):
                for t in np.unique(own[at[order[ends[r] : ends[r + 1]]]]).tolist():
                    found.setdefault((t, k), set()).add(passage)
    out = []
    for t, k in sorted(found):
        q, (a, b) = index.questions[k], np.searchsorted(owners, [t, t + 1]).tolist()
        share = len(q & set(text.words(a, b - a))) / len(q) if q else None
        out.append((keys[t], int(index.ids[k]), len(found[t, k]), share))
    return out


def leaks(texts: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, run: int = RUN, question: str | None = None, postings_per_index: int = POSTINGS_PER_INDEX) -> DataFrame:
    """doc, item, passages, question: every text that holds ``run`` or more consecutive words of a test item.

    ``passages`` counts the different runs of the item that the text holds, ``question`` is the
    share of the different words of the item's question (a column of ``items``) that the text has,
    null without one. Words are compared without regard to letter case and to what stands between
    them. Null and empty texts and items of fewer than ``run`` words give nothing; repeated rows
    and items give one row. The texts are read once, in slices, whatever their length and the
    number of items: each index has a bounded number of postings, a task holds one at a time, and
    nothing is shuffled but what is found.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where("text is not null")
    sent = []
    held: list[tuple[int, str, str]] = []
    size = 0
    asked = F.lit(None).cast("string") if question is None else F.col(f"`{question}`")
    for r in items.select(F.col(f"`{item}`").cast("long"), F.col(f"`{item_text}`"), asked).where(F.col(f"`{item_text}`").isNotNull()).toLocalIterator():
        held.append((r[0], r[1], r[2]))
        size += len(r[1]) // 4
        if size >= postings_per_index:
            sent.append(spark.sparkContext.broadcast(Index(held, run)))
            held, size = [], 0
    if held or not sent:
        sent.append(spark.sparkContext.broadcast(Index(held, run)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _groups(batches):
            words = Words(texts)
            out: list[tuple] = []
            for s in sent:
                out += _probe(s.value, keys, words)
                if len(sent) > 1:
                    s.__dict__.pop("_value", None)  # read again from disk when its turn comes
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], t) for k, t in enumerate(kinds)], ["doc", "item", "passages", "question"])

    found = rows.mapInArrow(probe, "doc long, item long, passages long, question double")
    return found.groupBy("doc", "item").agg(F.max("passages").alias("passages"), F.max("question").alias("question"))

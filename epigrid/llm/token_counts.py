"""Token counts that follow edits.

A document's pre-tokens stand in leaves of a segment tree whose nodes hold the characters
and tokens below. An edit re-encodes the pre-tokens that it touches, those before it
that look as far ahead as its place, and those after it until the old boundaries are met
again; only the sums above the leaves concerned change.

Trees are kept as rows of a table. Of a tree read back, an edit unpacks the leaves it
touches and no others, so a later batch of edits never reads or encodes a whole text.
"""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches
from .tokens import PRE_TOKEN, encoding

LEAF = 64  # pre-tokens of a leaf; one of four times as many is split
TREE = "n_pieces long, chars array<int>, tokens array<int>, leaves array<binary>"


@functools.lru_cache(maxsize=4)
def pre_tokens(vocabulary: str) -> tuple[regex.Pattern, int]:
    """The pattern of pre-tokens, the strings of special tokens among them, and how many
    characters after its end a pre-token may depend on."""
    special = sorted(encoding(vocabulary).special_tokens_set, key=len, reverse=True)
    if not special:
        return regex.compile(PRE_TOKEN), 3
    if any(regex.match(r"[\s\p{L}\p{N}']", s) for s in special):
        raise ValueError("a special token must begin with a symbol")
    one = "|".join(map(regex.escape, special))
    symbols, spaces = r"[^\s\p{L}\p{N}]+", r"\s+(?!\S)"
    # What comes before a special token ends there, as at the end of a text.
    pattern = PRE_TOKEN.replace(symbols, rf"(?:(?!{one})[^\s\p{{L}}\p{{N}}])+").replace(spaces, rf"\s+(?={one})|{spaces}")
    return regex.compile(f"{one}|{pattern}"), 3 + max(map(len, special))


class PieceCounts(dict):
    """Tokens of each pre-token, remembered."""

    def __init__(self, vocabulary: str, most: int = 300_000):
        super().__init__()
        self.encode, self.most = encoding(vocabulary).encode_ordinary, most
        self.special = encoding(vocabulary).special_tokens_set
        self.pattern, self.ahead = pre_tokens(vocabulary)

    def __missing__(self, piece: str) -> int:
        if len(self) > self.most:
            self.clear()
        n = 1 if piece in self.special else len(self.encode(piece))
        if len(piece) < 64:
            self[piece] = n
        return n


def packed(pieces: list[str]) -> bytes:
    """A leaf: how many pre-tokens, their lengths in characters, and their text."""
    return np.array([len(pieces), *map(len, pieces)], "<u4").tobytes() + "".join(pieces).encode()


def unpacked(leaf: bytes) -> list[str]:
    n = int.from_bytes(leaf[:4], "little")
    ends = np.cumsum(np.frombuffer(leaf, "<u4", n, 4)).tolist()
    text = leaf[4 + 4 * n :].decode()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class CountTree:
    """Leaves are lists of pre-tokens, or packed (bytes, or what gives them by number)."""

    def __init__(self, text: str, counts: PieceCounts, leaf: int = LEAF):
        self.counts, self.leaf, pieces = counts, leaf, counts.pattern.findall(text)
        leaves = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self.n_pieces, self.reencoded, self.unpacked = len(pieces), 0, 0
        self._plant(leaves, [sum(map(len, x)) for x in leaves], [sum(map(counts.__getitem__, x)) for x in leaves])

    @classmethod
    def kept(cls, counts: PieceCounts, n_pieces: int, chars, tokens, leaves, leaf: int = LEAF) -> CountTree:
        """The tree of a row of the table."""
        self = cls.__new__(cls)
        self.counts, self.leaf, self.n_pieces, self.reencoded, self.unpacked = counts, leaf, n_pieces, 0, 0
        self.chars, self.tokens, self.leaves = [int(x) for x in chars], [int(x) for x in tokens], list(leaves)
        self.size = len(self.chars) // 2
        return self

    def row(self) -> tuple:
        return self.n_pieces, self.chars, self.tokens, [x if isinstance(x, bytes) else packed(x) if isinstance(x, list) else x.as_py() for x in self.leaves]

    def _plant(self, leaves: list, chars: list[int], tokens: list[int]) -> None:
        self.leaves, n = leaves, len(leaves)
        self.size = 1 << (n - 1).bit_length()
        empty = [0] * (self.size - n)
        self.chars, self.tokens = [0] * self.size + chars + empty, [0] * self.size + tokens + empty
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def pieces(self, leaf: int) -> list[str]:
        x = self.leaves[leaf]
        if not isinstance(x, list):
            x = self.leaves[leaf] = unpacked(x if isinstance(x, bytes) else x.as_py())
            self.unpacked += 1
        return x

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.n_pieces += len(pieces) - len(self.pieces(leaf))
        self.leaves[leaf] = pieces
        i = self.size + leaf
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(map(self.counts.__getitem__, pieces))
        while i > 1:
            i //= 2
            self._sum(i)

    def _split(self, leaf: int) -> None:
        """A leaf that has grown becomes several; no other is unpacked."""
        whole = self.pieces(leaf)
        new = [whole[i : i + self.leaf] for i in range(0, len(whole), self.leaf)]
        at, n = self.size, len(self.leaves)
        chars, tokens = self.chars[at : at + n], self.tokens[at : at + n]
        chars[leaf : leaf + 1] = [sum(map(len, x)) for x in new]
        tokens[leaf : leaf + 1] = [sum(map(self.counts.__getitem__, x)) for x in new]
        self._plant(self.leaves[:leaf] + new + self.leaves[leaf + 1 :], chars, tokens)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a place in the text, and where that leaf begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if at >= begin + self.chars[i] and i - self.size < len(self.leaves):
                begin += self.chars[i]
                i += 1
        leaf = i - self.size
        while leaf >= len(self.leaves) or (not self.chars[self.size + leaf] and leaf):
            leaf -= 1
            begin -= self.chars[self.size + leaf]
        return leaf, begin

    def text(self) -> str:
        return "".join("".join(self.pieces(i)) for i in range(len(self.leaves)))

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``start`` on; both stop at the text's end."""
        ahead = self.counts.ahead
        start = max(0, min(start, self.chars[1]))
        removed = max(0, min(removed, self.chars[1] - start))
        first, begin = self.find(max(0, start - ahead))
        last, old = first, list(self.pieces(first))
        span = self.chars[self.size + first]
        while True:
            while last + 1 < len(self.leaves) and begin + span < start + removed + ahead:
                last += 1
                old += self.pieces(last)
                span += self.chars[self.size + last]
            ends = list(accumulate(map(len, old), initial=0))
            stay = 0  # pieces that end early enough not to see the edit
            while stay < len(old) and begin + ends[stay + 1] + ahead <= start:
                stay += 1
            text = "".join(old[stay:])
            offset = start - begin - ends[stay]
            text = text[:offset] + inserted + text[offset + removed :]
            moved, bounds = len(inserted) - removed, {e: k for k, e in enumerate(ends)}
            done, fresh, met = 0, [], None
            for piece in self.counts.pattern.findall(text):
                was = done + ends[stay] - moved  # this place before the edit
                if done >= offset + len(inserted) and was in bounds and bounds[was] >= stay:
                    met = bounds[was]
                    break
                fresh.append(piece)
                done += len(piece)
            # What comes close to the end of what was read may look beyond it.
            if last + 1 == len(self.leaves) or (met is not None and done + ahead <= len(text)):
                break
            last += 1
            old += self.pieces(last)
            span += self.chars[self.size + last]
        self.reencoded += len(fresh)
        self._set(first, old[:stay] + fresh + (old[met:] if met is not None else []))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, [])
        if len(self.pieces(first)) > 4 * self.leaf:
            self._split(first)


def _schema(docs: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)


def count_trees(docs: DataFrame, vocabulary: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A tree a row of docs (doc_id, text): doc_id, the columns in ``carry``, and the tree's own:
    n_pieces (pre-tokens), chars, tokens, leaves. Null text is empty; repeated rows and null
    doc_ids are rows like others. Tokens are those of `tokenizers`: the string of a special
    token in a text is one token."""
    keep = ["doc_id", *carry]

    def build(batches):
        import pyarrow as pa

        counts = PieceCounts(vocabulary)
        types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):  # trees outweigh their texts
                part = batch.slice(lo, 200)
                rows = [CountTree(text or "", counts).row() for text in part.column(0).to_pylist()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keep, "n_pieces", "chars", "tokens", "leaves"])

    bounded_batches(docs.sparkSession)
    return docs.select("text", *keep).mapInArrow(build, f"{_schema(docs, keep)}, {TREE}")


def apply_edits(trees: DataFrame, vocabulary: str, keep_trees: bool = True) -> DataFrame:
    """The trees after their edits, one after the other, with what they counted.

    trees: doc_id, the columns of ``count_trees``, and edits (array of start int, removed int,
    inserted string, in characters of the text as it then is; null: none). Edits beyond the
    end stop there. Returns doc_id, n_tokens and n_pieces before, n_tokens_edited, n_reencoded
    (pre-tokens encoded for the edits), n_unpacked (leaves read for them) and, with
    ``keep_trees``, the tree's columns for the next batch (n_pieces_edited among them is
    then called n_pieces of that table by ``next_trees``).
    """
    names = ["n_tokens", "n_pieces", "n_tokens_edited", "n_reencoded", "n_unpacked"]
    tree = ["n_pieces_edited", "chars", "tokens", "leaves"] if keep_trees else []

    def work(batches):
        import pyarrow as pa

        counts = PieceCounts(vocabulary)
        types = (*[pa.int64()] * 5, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, rows = batch.slice(lo, 200), []
                pieces, chars, tokens, edits = (part.column(i).to_pylist() for i in (1, 2, 3, 5))
                for n, c, t, e, i in zip(pieces, chars, tokens, edits, range(part.num_rows), strict=True):
                    own = CountTree.kept(counts, n, c, t, part.column(4)[i].values)  # leaves stay packed in Arrow
                    before = own.total
                    for x in e or ():
                        own.edit(x["start"] or 0, x["removed"] or 0, x["inserted"] or "")
                    rows.append((before, n, own.total, own.reencoded, own.unpacked, *(own.row() if keep_trees else ())))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=["doc_id", *names, *tree])

    bounded_batches(trees.sparkSession)
    more = ", n_pieces_edited long, chars array<int>, tokens array<int>, leaves array<binary>" if keep_trees else ""
    return trees.select("doc_id", "n_pieces", "chars", "tokens", "leaves", "edits").mapInArrow(work, f"{_schema(trees, ['doc_id'])}, {', '.join(n + ' long' for n in names)}{more}")


def next_trees(applied: DataFrame) -> DataFrame:
    """The table of trees that ``apply_edits`` leaves."""
    return applied.select("doc_id", F.col("n_pieces_edited").alias("n_pieces"), "chars", "tokens", "leaves")


def count_edited(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token counts of every row's text before and after its edits.

    docs: doc_id, text, edits (see ``apply_edits``). Trees are built and written to the shared
    folder first, and the edits then work on that table. Returns doc_id, n_tokens, n_pieces
    (pre-tokens before), n_tokens_edited, n_reencoded, n_unpacked. Other columns are ignored.
    """
    trees = Workspace(docs.sparkSession, "trees").result(count_trees(docs, vocabulary, carry=("edits",)))
    return apply_edits(trees, vocabulary, keep_trees=False)


def sample_edits(text):
    """A column of three edits made of the text itself: its third quarter's first twelve
    characters go, its first ten come in after a third, and a word is replaced."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda start, removed, inserted: F.struct(start.cast("int").alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))
    return F.array(edit(F.floor(n / 2), 12, F.lit("")), edit(F.floor(n / 3), 0, F.substring(F.coalesce(text, F.lit("")), 1, 10)), edit(F.floor(n / 5), 5, F.lit(" they'll see 42 ")))

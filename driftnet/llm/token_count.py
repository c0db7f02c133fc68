"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one flat numpy array with the start of each sequence beside it. In every round each
sequence finds its pair of lowest rank and all places of that pair merge at once, in all sequences; a sequence
that has no pair left leaves the array. What survives of a sequence is its number of tokens.

A round costs as much as its array is long, so long sequences go one by one, by the same rounds: their places lie in a list for each
rank, and a round touches only the places of the lowest rank and their neighbours. The time is then near linear in the length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import living, text_bytes

VOCABULARY = "byte_bpe_50k.json"
#: Characters of pieces whose counts a worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 8_000_000
#: Texts whose new pieces are merged together.
GROUP = 512
#: Bytes of a sequence beyond which it is merged by itself.
LONG = 512
NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts the tokens of byte sequences under a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.start = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.pairs = {(int(k) >> 20, int(k) & 0xFFFFF): (r, int(self.merged[r])) for k, r in zip(self.keys, self.ranks.tolist(), strict=True)}
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)

    def long_count(self, sequence: bytes) -> int:
        """Tokens of one sequence; symbols form a linked list, and each rank that can merge has a list of its places."""
        symbols = self.start[np.frombuffer(sequence, dtype=np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        waiting: list[int] = []

        def post(k: int) -> None:
            if k >= 0 and after[k] < len(symbols) and (found := self.pairs.get((symbols[k], symbols[after[k]]))):
                if found[0] not in places:
                    places[found[0]] = []
                    heappush(waiting, found[0])
                places[found[0]].append(k)

        for k in range(n - 1):
            post(k)
        while waiting:
            rank = heappop(waiting)
            for k in sorted(places.pop(rank)):
                right = after[k]
                # a place may have merged since, or its right neighbour
                if symbols[k] < 0 or right >= len(symbols):
                    continue
                found = self.pairs.get((symbols[k], symbols[right]))
                if found is None or found[0] != rank:
                    continue
                symbols[k], symbols[right] = found[1], -1
                after[k] = after[right]
                if after[k] < len(symbols):
                    before[after[k]] = k
                n -= 1
                post(before[k])
                post(k)
        return n

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        out = np.zeros(len(sequences), dtype=np.int64)
        sizes = np.array([len(s) for s in sequences], dtype=np.int64)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self.long_count(sequences[k])
        alive = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        symbols = self.start[np.frombuffer(b"".join([sequences[k] for k in alive.tolist()]), dtype=np.uint8)]
        sizes = sizes[alive]
        while len(alive):
            starts = np.cumsum(sizes) - sizes
            key = np.full(len(symbols), -1, dtype=np.int64)
            key[:-1] = (symbols[:-1] << 20) | symbols[1:]
            key[starts + sizes - 1] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank < NO_RANK))
            if len(hit):  # in a run such as "aaa" every second place merges, from the left
                first = np.ones(len(hit), dtype=bool)
                first[1:] = np.diff(hit) != 1
                run = hit[first][np.cumsum(first) - 1]
                hit = hit[(hit - run) % 2 == 0]
                symbols[hit] = self.merged[rank[hit]]
                stays = np.ones(len(symbols), dtype=bool)
                stays[hit + 1] = False
                sizes = np.add.reduceat(stays, starts)
                owner_done = np.repeat(lowest == NO_RANK, np.diff(np.append(starts, len(symbols))))
            else:
                stays = np.ones(len(symbols), dtype=bool)
                owner_done = stays
            done = lowest == NO_RANK
            out[alive[done]] = sizes[done]
            symbols = symbols[stays & ~owner_done]
            alive, sizes = alive[~done], sizes[~done]
        return out


#: A pre-token never reaches over a space that a non-space follows, so a text may be cut before each of those.
#: Where spaces run together the cut is left out.
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def pieces(text: str) -> list[str]:
    """Cuts text before single spaces; every piece but the first has lost the space that it began with."""
    return text.split(" ") if not LOOSE_SPACE.search(text) else re.split(r" (?=\S)", text)


class PieceCounts:
    """Tokens of text pieces, remembered while a worker lives: `spaced` by pieces that follow a space, `bare` by the others."""

    def __init__(self, path: str, pattern: str) -> None:
        self.merger = RankMerger(path)
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merger.specials)) or r"(?!)")
        self.marks = [m[:2] for m in self.merger.specials]
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.held = 0

    def learn(self, into: dict[str, int], lead: str, new: list[str]) -> None:
        tokens = [self.split(lead + p) for p in new]
        distinct = list({w for t in tokens for w in t})
        sizes = dict(zip(distinct, self.merger.counts([w.encode("utf-8", "surrogatepass") for w in distinct]).tolist(), strict=True))
        into.update((p, sum([sizes[w] for w in t])) for p, t in zip(new, tokens, strict=True))
        self.held += sum(map(len, new))

    def totals(self, texts: list[str | None]) -> list[int]:
        if self.held > REMEMBERED:
            self.spaced, self.bare, self.held = {}, {}, 0
        later, first, extra = [], [], []
        for text in texts:
            parts = self.special.split(text) if text and any(m in text for m in self.marks) else [text or ""]
            cut = [pieces(p) for p in parts]
            extra.append(len(parts) - 1)
            first.append([c.pop(0) for c in cut])
            later.append(cut[0] if len(cut) == 1 else [w for c in cut for w in c])
        for into, lead, found in ((self.spaced, " ", later), (self.bare, "", first)):
            new = set().union(*found).difference(into)
            if new:
                self.learn(into, lead, list(new))
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        return [sum(map(spaced, p)) + sum(map(bare, f)) + e for p, f, e in zip(later, first, extra, strict=True)]


def piece_counts(path: str, pattern: str) -> PieceCounts:
    """The worker's own PieceCounts, kept from task to task."""
    return living(("piece counts", path, pattern), lambda: PieceCounts(path, pattern))


def counting(path: str, pattern: str):
    """A mapInArrow function from (text, ...) batches to the same batches with n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path, pattern)
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            total = [n for a in range(0, len(texts), GROUP) for n in counts.totals(texts[a : a + GROUP])]
            rest = [n for n in names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(total, pa.int64())], names=[*rest, "n_tokens"])

    return run


def count_tokens(docs: DataFrame, limit: int, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty: 0
    bytes, 0 tokens. A null doc_id stays null and repeated rows stay repeated. Special strings inside a text are one token each, as the
    library has it by default. Texts of any length are counted whole.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    narrow = docs.select("doc_id", text_bytes(F.col("text")).alias("n_bytes"), "text")
    kind = dict(narrow.dtypes)["doc_id"]
    counted = narrow.mapInArrow(counting(path, pattern), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

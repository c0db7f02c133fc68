"""Quality rules: word-level base rules and tokeniser fertility.

A public sentence-piece vocabulary with byte fallback encodes each whole text, line breaks, tabs and runs of spaces included, to the same pieces as
its library gives for the text in one go. Characters per token, the share of
tokens that are fallback bytes and the entropy of the token distribution must lie within bands that belong to the
language or, where that is unknown, to the script that most letters have.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame

from driftnet.llm.common import listed, living, ragged, trimmed

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


@dataclass(frozen=True)
class Band:
    """Limits for a text to stay within, both ends included; the entropy floor holds from `entropy_tokens` tokens on."""

    min_chars: float
    max_chars: float
    max_bytes: float
    min_entropy: float
    entropy_tokens: int = 100


#: White space is left out of the characters. Alphabetic text has 1.7 to 6 characters a token under this vocabulary;
#: syllabic and ideographic scripts come near 1 and lean on fallback bytes. Junk shows as few characters a token
#: (symbols, capitals) or little entropy (repeats). Line breaks and tabs are fallback bytes under this vocabulary, so alphabetic text has a few of them too.
#: The limits lie outside the range of all but the most extreme hundredth of the labelled good documents that pass the base rules, in each measure.
LANGUAGE_BANDS = {
    "en": Band(2.04, 6.0, 0.05, 5.2), "de": Band(2.06, 6.0, 0.05, 5.2), "fr": Band(1.80, 6.0, 0.05, 5.2), "es": Band(1.78, 6.0, 0.05, 5.2),
}
SCRIPT_BANDS = {
    "Latin": Band(1.6, 6.0, 0.08, 4.0), "Cyrillic": Band(1.3, 6.0, 0.15, 4.0), "Greek": Band(0.8, 5.0, 0.30, 3.5), "Arabic": Band(0.8, 5.0, 0.30, 3.5),
    "Hebrew": Band(0.8, 5.0, 0.30, 3.5), "Devanagari": Band(0.6, 5.0, 0.50, 3.0), "Han": Band(0.3, 3.0, 0.75, 3.0), "Hiragana": Band(0.3, 3.0, 0.75, 3.0),
    "Katakana": Band(0.3, 3.0, 0.75, 3.0), "Hangul": Band(0.3, 3.0, 0.75, 3.0), "Thai": Band(0.3, 4.0, 0.75, 3.0), "other": Band(0.2, 6.0, 0.90, 3.0),
}
LETTERS = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPT_BANDS if s != "other"]


def script_of(text: str) -> str:
    """The script with the most letters; ties go to the first in the order of the table, texts without letters to `other`."""
    if text.isascii():
        return "Latin" if any(c.isalpha() for c in text) else "other"
    counts = [(len(p.findall(text)), -k, s) for k, (s, p) in enumerate(LETTERS)]
    best = max(counts)
    return best[2] if best[0] else "other"


#: Distinct parts of texts whose pieces a worker remembers; beyond that it forgets all and starts anew. Bytes of text and texts that are worked at a time.
REMEMBERED = 300_000
GROUP, GROUP_BYTES = 2048, 4 << 20
#: What a space is for the vocabulary, in a text as well.
SPACE_MARK = "\u2581"
#: A text with a space put before it falls into these parts, each with the spaces before it and, at the end, those behind it.
PARTS = re.compile(r" *[^ ]+(?: +\Z)?| +\Z")


class WordPieces:
    """The vocabulary's pieces of whole texts.

    No piece has a space behind another character, so texts may be cut before each run of spaces and every part be encoded by itself; line
    breaks, tabs and all else stay inside the parts. Pieces of parts are kept as ragged arrays.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_pieces = self.model.get_piece_size()
        if any(SPACE_MARK in self.model.id_to_piece(i).lstrip(SPACE_MARK) for i in range(self.n_pieces)):
            raise ValueError("the vocabulary has pieces that reach over a space")
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.n_pieces)])
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        pieces = self.model.encode(new, num_threads=1)
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, pieces), np.int64, len(pieces))])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(pieces), np.int32)])

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts one after the other, and how many each has; equal to the library's on each whole text."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        cut = parts_of(pc.replace_substring(texts, SPACE_MARK, " "))
        coded = cut.flatten().dictionary_encode()
        own = listed(coded.dictionary)
        new = [p for p in own if p not in self.ids]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.ids.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]
        sizes = self.sizes[number]
        tokens = self.flat[ragged((np.cumsum(self.sizes) - self.sizes)[number], sizes)]
        return tokens, sums(sizes, cut.offsets.to_numpy())

    def fertility(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: n_tokens, the share of byte pieces and the entropy of the pieces, 0 without pieces."""
        tokens, n = self.pieces(texts)
        own = np.repeat(np.arange(len(n)), n)
        at = np.sort(own * self.n_pieces + tokens)
        ends = np.flatnonzero(np.diff(at, append=-1))
        share = np.diff(ends, prepend=-1) / n[at[ends] // self.n_pieces]
        entropy = np.bincount(at[ends] // self.n_pieces, weights=-share * np.log2(share), minlength=len(n))
        return n, np.bincount(own, weights=self.is_byte[tokens], minlength=len(n)) / np.maximum(n, 1), entropy


def parts_of(texts: pa.Array) -> pa.ListArray:
    """Cuts texts before each run of spaces and takes one space away there."""
    loose = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)
    turns = [0, *(np.flatnonzero(loose[1:] != loose[:-1]) + 1).tolist(), len(loose)]
    kind = pa.list_(pa.string())
    runs = []
    for a, b in itertools.pairwise(turns):
        if b > a and loose[a]:
            runs.append(pa.array([[p[1:] for p in PARTS.findall(" " + t)] for t in listed(texts[a:b])], kind))
        else:
            runs.append(pc.split_pattern(texts[a:b], " ").cast(kind))
    return pa.concat_arrays(runs)


def sums(sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of sizes from each offset to the next."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]])


def base_counts(texts: pa.Array) -> list[np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    cut = pc.ascii_split_whitespace(texts)
    flat, offsets = cut.flatten(), cut.offsets.to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    n_words = sums(real, offsets)
    chars = sums(pc.utf8_length(flat).to_numpy(), offsets)
    numbers = flat.filter(pa.array(real)).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum(n_words)
    repeats = np.array([repeat_words(numbers[a:b]) for a, b in zip((ends - n_words).tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    symbols = sums(IS_SYMBOL[raw[at[0] : at[-1]]], at)
    rows = pc.split_pattern(texts, "\n")
    lines, owner = rows.flatten(), pc.list_parent_indices(rows).to_numpy()
    worded = pc.not_equal(pc.utf8_trim(lines, SPACES), "").to_numpy(zero_copy_only=False)
    kinds = lines.dictionary_encode().indices.to_numpy()[worded].astype(np.int64)
    once = np.unique((owner[worded].astype(np.int64) << 32) | kinds) >> 32
    doubled = np.bincount(owner[worded], minlength=len(texts)) - np.bincount(once, minlength=len(texts))
    return [n_words, chars, symbols, doubled, repeats]


def repeat_words(a: np.ndarray) -> int:
    """Words, given by number, that stand in a three-word window found twice or more in the text."""
    n = len(a)
    if n < 4:
        return 0
    if a.max() >= 1 << 21:
        a = np.unique(a, return_inverse=True)[1]
    if a.max() < 1 << 21:
        key = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    else:
        key = np.unique(a[:-1] * (int(a.max()) + 1) + a[1:], return_inverse=True)[1][:-1] * (int(a.max()) + 1) + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[order[1:][same] + k] = True
        covered[order[:-1][same] + k] = True
    return int(covered.sum())


def word_pieces(path: str) -> WordPieces:
    """The worker's own WordPieces, kept from task to task."""
    return living(("word pieces", path), lambda: WordPieces(path))


def within(band: Band, n_tokens: int, chars: float, byte_share: float, entropy: float) -> bool:
    return n_tokens > 0 and band.min_chars <= chars <= band.max_chars and byte_share <= band.max_bytes and (n_tokens < band.entropy_tokens or entropy >= band.min_entropy)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string"


def groups(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of some megabytes, each with the place where it begins."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, min(a + GROUP, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GROUP_BYTES))))
        yield a, texts[a:b]
        a = b


def measuring(path: str, languages: dict[str, Band], scripts: dict[str, Band]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(path)
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3 + [pa.string()]
        for batch in batches:
            langs = batch.column(batch.schema.names.index("lang")).to_pylist()
            rows = []
            for a, texts in groups(batch.column(batch.schema.names.index("text")).fill_null("")):
                base = base_counts(texts)
                n, byte_share, entropy = pieces.fertility(texts)
                told = zip(*(c.tolist() for c in (*base, n, base[1] / np.maximum(n, 1), byte_share, entropy)), strict=True)
                for text, lang, own in zip(listed(texts), langs[a : a + len(texts)], told, strict=True):
                    failed = own[0] < MIN_WORDS or 100 * own[4] > MAX_REPEAT_PERCENT * own[0]
                    name = lang if lang in languages else script_of(text)
                    band = languages.get(name) or scripts[name]
                    rows.append((*own[:5], failed, not failed and within(band, *own[5:]), *own[5:], name))
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            rest = [n for n in batch.schema.names if n not in ("text", "lang")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *added], names=[*rest, *names])

    return run


def judge(docs: DataFrame, vocabulary: str | None = None, languages: dict[str, Band] = LANGUAGE_BANDS, scripts: dict[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, kept, and the fertility figures behind the verdict.

    docs needs doc_id, text and lang; other columns are ignored, whatever their names. A null text counts as empty: no words, so it fails the
    base rules and is not kept. A null or unlisted language takes the band of the text's script. Texts of any length
    are measured whole; repeated rows and null ids are judged like any others.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    narrow = docs.select("doc_id", "text", "lang")
    return narrow.mapInArrow(trimmed(measuring(path, languages, scripts)), f"doc_id {dict(narrow.dtypes)['doc_id']}, {FIELDS}")


def keep_good(docs: DataFrame, vocabulary: str | None = None, languages: dict[str, Band] = LANGUAGE_BANDS, scripts: dict[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; no join, the verdict is made beside the row."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    verdict = measuring(path, languages, scripts)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in ("text", "lang")], names=["text", "lang"])
            for told in verdict(iter([pair])):
                yield batch.filter(told.column(told.schema.names.index("kept")))

    return docs.mapInArrow(trimmed(run), schema)

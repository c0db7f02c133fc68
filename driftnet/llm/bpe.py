"""BPE encoding and decoding through a table of distinct words.

1. Texts are cut once. Each run of texts (a chunk) becomes one line of word numbers for all its texts and its list of distinct words. Both are
   dealt by chunk, and both steps that follow read this one exchange.
2. Distinct words of all chunks are dealt by their hash; where they meet, each is encoded once, and its ids go back
   to the chunks that asked, under the number that the word has there.
3. Lines and ids meet by chunk: ids are put in by position, and pieces by a join of the ids to the vocabulary's table of ids and pieces.

A chunk is named by its content. Should a lost task be run again over other rows than before (which only docs without a fixed order of rows
allow), lines and ids do not meet and the job fails instead of giving wrong ids.

No word table is held in the driver or sent to all executors, and every key is a chunk or a hash bucket of words, so that
neither common words nor copies of a text make a large group: a word is sent once for a chunk, however often it stands there.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from driftnet.llm.common import listed, living, ragged
from driftnet.llm.token_count import byte_symbols

VOCABULARY = "word_bpe_49k.json"
#: UTF-8 bytes of text after which a chunk is closed; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Buckets by which a chunk's words are dealt, for each shuffle partition; distinct words that a task remembers.
BUCKETS_A_PARTITION, HELD_WORDS = 4, 400_000


#: Kinds of code points.
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)


class Splitter:
    """Cuts texts into normalised words as the vocabulary file says: NFC, lower case, white space dropped; special strings stay whole.

    All texts of a chunk are cut at once, as one array of code points. Surrogates, which no text holds, part the texts and stand for special strings.
    """

    END, FIRST_SPECIAL = 0xD800, 0xD801

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        self.specials = self.special_ids(path)
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
        self.marks = {s: chr(self.FIRST_SPECIAL + k) for k, s in enumerate(self.specials)}
        self.endings = self.checked(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        every = "".join(map(chr, range(self.END))) + "".join(map(chr, range(0xE000, 0x110000)))
        points = np.array([*range(self.END), *range(0xE000, 0x110000)])
        self.kind = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            self.kind[points[[m.start() for m in regex.finditer(pattern, every)]]] = kind
        self.kind[self.END] = SPACE
        self.kind[self.FIRST_SPECIAL : self.FIRST_SPECIAL + len(self.specials)] = SPECIAL

    @staticmethod
    def special_ids(path: str) -> dict[str, int]:
        return {t["content"]: t["id"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}

    @staticmethod
    def checked(pattern: str) -> list[str]:
        """The endings behind an apostrophe that the pattern has; it must otherwise ask for runs of letters, single digits and runs of the rest."""
        *endings, letters, number, rest = pattern.split("|")
        if (letters, number, rest) != (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or not all(e[0] == "'" and len(e) in (2, 3) for e in endings):
            raise ValueError(f"not a pattern of words, digits and other runs: {pattern}")
        return [e[1:] for e in endings]

    def words(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The words of all texts, text after text, special strings as their marks; and how many each text has."""
        text = chr(self.END).join(texts) + chr(self.END)
        if "<|" in text:
            text = self.special.sub(lambda m: self.marks[m[0]], text)
        # lower case letter by letter, without a final form
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        del text
        kind = self.kind[points]
        begins = np.empty(len(kind), dtype=bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= (kind == NUMBER) | (kind == SPECIAL)
        self.part_endings(points, begins)
        solid = kind != SPACE
        begins &= solid
        counts = np.diff(np.searchsorted(np.flatnonzero(begins), np.flatnonzero(points == self.END)), prepend=0)
        points, begins = points[solid], begins[solid]
        behind = np.cumsum(np.int8(1) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int32 if len(points) < 1 << 29 else np.int64)
        first = np.flatnonzero(begins)
        offsets = np.concatenate([[0], behind[first[1:] - 1], behind[-1:]]).astype(np.int64) if len(first) else np.zeros(1, dtype=np.int64)
        raw = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), counts

    def part_endings(self, points: np.ndarray, begins: np.ndarray) -> None:
        """An apostrophe that begins a run takes an ending such as re or s with it; what follows that begins anew."""
        at = np.flatnonzero((points == ord("'")) & begins)
        follow = [points[np.minimum(at + k, len(points) - 1)] for k in (1, 2)]
        for ending in self.endings:
            own = follow[0] == ord(ending[0])
            if len(ending) == 2:
                own = own & (follow[1] == ord(ending[1]))
            found = at[own]
            begins[found + 1] = False
            begins[found + 1 + len(ending)] = True  # the last point parts texts, so there is one


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**28 in one to four bytes of seven bits, the lowest first; the last byte has no high bit."""
    size = 1 + (numbers >= 1 << 7).astype(np.int8) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[at] = (numbers & 127) | ((size > 1) << 7)
    for k in range(1, 4):
        own = np.flatnonzero(size > k)
        out[at[own] + k] = ((numbers[own] >> (7 * k)) & 127) | ((size[own] > k + 1) << 7)
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = (raw[starts] & 127).astype(np.int64)
    for k in (1, 2, 3):
        own = np.flatnonzero(ends - starts >= k)
        out[own] |= (raw[starts[own] + k] & 127).astype(np.int64) << (7 * k)
    return out


def numbered(splitter: Splitter, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the commonest first; the number of the word at each place, text after text; words of each text."""
    words, sizes = splitter.words(texts)
    coded = words.dictionary_encode()
    places = coded.indices.to_numpy()
    counts = np.bincount(places, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    names = {mark.encode("utf-8", "surrogatepass"): s.encode() for s, mark in splitter.marks.items()}
    return [names.get(w, w) for w in listed(coded.dictionary.take(order))], rank[places], sizes


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows as one batch for each chunk; column 0 is the text."""
    held, n = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(lengths, (lengths[a - 1] if a else 0) + size - n)) + 1
            held.append(batch[a:b])
            if b <= batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            else:
                n += int(lengths[-1] - (lengths[a - 1] if a else 0))
            a = b
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


CUT = "chunk long, bucket int, words binary, numbers binary, sizes array<int>, ids array<{}>"


def cutting(path: str, size: int, buckets: int):
    """(text, doc_id) to one row with the line of each chunk, and a row with words and their numbers for each of its buckets, all packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, squeeze = living(("splitter", path), lambda: Splitter(path)), zstandard.ZstdCompressor(level=1).compress
        for k, chunk in enumerate(chunks(batches, size)):
            ids = chunk.column(1)
            words, places, sizes = numbered(splitter, listed(chunk.column(0).fill_null("")))
            bucket = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int32)
            order = np.argsort(bucket, kind="stable")
            ends = [*(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)] if len(order) else []
            runs = [order[a:b] for a, b in itertools.pairwise([0, *ends])]
            n, line = len(runs), pack(places)
            named = hashlib.blake2b(f"{TaskContext.get().partitionId()} {k} {sizes.tolist()}".encode(), digest_size=8)
            for part in (line, *words):
                named.update(part)
            columns = {
                "chunk": pa.array([int.from_bytes(named.digest(), "little", signed=True)] * (n + 1), pa.int64()),
                "bucket": pa.array([None, *(int(bucket[r[0]]) for r in runs)], pa.int32()),
                "words": pa.array([None, *(squeeze(b"\n".join([words[i] for i in r.tolist()])) for r in runs)], pa.binary()),
                "numbers": pa.array([squeeze(line), *(pack(np.diff(r, prepend=0)) for r in runs)], pa.binary()),
                "sizes": pa.array([sizes.astype(np.int32), *[None] * n], pa.list_(pa.int32())),
                "ids": pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (n + 1), pa.int32()), ids),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with words. Done here, as a filter would be pushed below the exchange, which then would not be shared."""
    for batch in batches:
        yield batch.select(["chunk", "bucket", "words", "numbers"]).filter(pc.is_valid(batch.column("bucket")))


def encoding(path: str):
    """(chunk, bucket, words, numbers) to (chunk, numbers, sizes, ids): each distinct word is encoded when it comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, symbols = Tokenizer.from_file(path).model, dict(enumerate(byte_symbols()))
        specials = {s.encode(): i for s, i in Splitter.special_ids(path).items()}
        squeeze, unsqueeze = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        known: dict[bytes, int] = {}
        flat, sizes = array("H"), array("H")
        for batch in batches:
            if len(known) > HELD_WORDS:
                known, flat, sizes = {}, array("H"), array("H")
            cut = [unsqueeze(w).split(b"\n") for w in listed(batch.column(2))]
            for w in set().union(*cut).difference(known):
                ids = [specials[w]] if w in specials else [t.id for t in model.tokenize(w.decode("latin-1").translate(symbols))]
                known[w] = len(known)
                flat.extend(ids)
                sizes.append(len(ids))
            size, ids = np.array(sizes, dtype=np.int64), np.array(flat, dtype="<u2")
            starts = np.cumsum(size) - size
            told = []
            for words in cut:
                own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                told.append((pack(size[own]), squeeze(ids[ragged(starts[own], size[own])].tobytes())))
            columns = [pa.array(c, pa.binary()) for c in (zip(*told, strict=True) if told else ([], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *columns], names=["chunk", "numbers", "sizes", "ids"])

    return run


def piece_table(path: str) -> pa.Table:
    """id, piece of the vocabulary."""
    spec = json.load(open(path, encoding="utf-8"))
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.table({"id": pa.array(list(pieces), pa.int64()), "piece": list(pieces.values())})


def decoded_words(ids: np.ndarray, sizes: np.ndarray, vocabulary: pa.Table) -> pa.StringArray:
    """The pieces of each word, by a join of its ids to the vocabulary."""
    met = pa.table({"id": ids, "at": np.arange(len(ids))}).join(vocabulary, "id", join_type="inner")
    order = np.argsort(met.column("at").to_numpy())
    return joined(met.column("piece").combine_chunks().take(order), sizes)


def joined(pieces: pa.Array | pa.ChunkedArray, sizes: np.ndarray) -> pa.StringArray:
    """Runs of pieces, a space between two."""
    pieces = pa.concat_arrays(pieces.chunks) if isinstance(pieces, pa.ChunkedArray) else pieces
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), pieces), " ")


def joining(path: str, digests: bool, names: list[str]):
    """Lines and encoded words of one chunk to the results of its texts."""

    def run(key, lines: pa.Table, words: pa.Table) -> pa.Table:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        lines = lines.filter(pc.is_null(lines.column("bucket")))
        if lines.num_rows != 1:
            raise ValueError("a chunk has ids but no line: docs gave other rows when a lost task was run again; write docs to a table first")
        rows = [(np.cumsum(unpack(n)), unpack(s), np.frombuffer(unsqueeze(i), dtype="<u2")) for n, s, i in zip(*(listed(words.column(c)) for c in ("numbers", "sizes", "ids")), strict=True)]
        none = np.zeros(0, dtype=np.int64)
        number, size, ids = (np.concatenate([none, *c]) for c in (zip(*rows, strict=True) if rows else [()] * 3))
        order = np.argsort(number)  # the numbers of a chunk are 0, 1, 2, ...
        ids = ids[ragged((np.cumsum(size) - size)[order], size[order])]
        size = size[order]
        starts = np.cumsum(size) - size
        places = unpack(unsqueeze(lines.column("numbers")[0].as_py()))
        if len(places) and places.max() >= len(size):
            raise ValueError("a chunk has a line but no ids: docs gave other rows when a lost task was run again; write docs to a table first")
        own = size[places]
        flat = ids[ragged(starts[places], own)]
        n_words = lines.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum(n_words)]
        n_tokens = np.diff(ends, prepend=0)
        texts = joined(decoded_words(ids, size, piece_table(path)).take(pa.array(places)), n_words)
        if digests:
            packed = memoryview(flat.astype("<u4").tobytes())
            told = [pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip((ends - n_tokens).tolist(), ends.tolist(), strict=True)], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in listed(texts)], pa.string())]
        else:
            told = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat)), texts]
        return pa.Table.from_arrays([lines.column("ids").combine_chunks().flatten(), pa.array(n_tokens), *told], names=["doc_id", "n_tokens", *names])

    return run


def encode_decode(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, digests: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids_sha256, decoded_sha256 (digests) or ids, decoded, for every row of docs.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty: no ids, decoded to "". Special
    strings inside a text become their special tokens. Whole texts of any length are encoded; repeated rows and null ids
    are kept as they are. chunk, the bytes of text that share a list of words, changes no result.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    buckets = BUCKETS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    cut = docs.select("text", "doc_id").mapInArrow(cutting(path, chunk, buckets), CUT.format(kind)).repartition("chunk")
    dealt = cut.mapInArrow(word_lists, "chunk long, bucket int, words binary, numbers binary").repartition("bucket")
    words = dealt.mapInArrow(encoding(path), "chunk long, numbers binary, sizes binary, ids binary")
    made = {"ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<long>", "decoded": "string"}
    told = ", ".join(f"{n} {k}" for n, k in made.items())
    return cut.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(joining(path, digests, list(made)), f"doc_id {kind}, n_tokens long, {told}")

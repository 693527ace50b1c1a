"""Token ids in directly addressable codes.

A code file is a Parquet table of segments, written through Spark's committer
so that a lost executor leaves no half-written file and no path is local. A
segment's payload holds the ids of whole documents: each id is cut into 8-bit
chunks by level; a level stores its chunks, a bitmap of ids that continue on
the next level, and a rank directory (set bits before every 512th entry).
``Segment.access`` reads any id with one rank step per level and decodes
nothing else.

Payload layout, little-endian: ``DAC1``, count u64, levels u8, then per level
entries u64, chunks, and but for the last level bitmap and directory (u32).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import shuffle_parts, stored, texts
from .blobs import gathered, slices, tidied

END_ID = 2
STEP = 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT_TOKENS = 1 << 20
#: Pieces of words remembered by a worker; the memory is emptied when full.
MEMORY_WORDS = 1 << 18


def encode_segment(ids: np.ndarray) -> bytes:
    rest = np.asarray(ids, dtype=np.uint32)
    levels = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    out = [b"DAC1", np.uint64(len(rest)).tobytes(), bytes([levels])]
    for level in range(levels):
        out += [np.uint64(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes()]
        if level + 1 < levels:
            more = rest > 0xFF
            before = np.concatenate([[0], np.cumsum(more)])[:-1:STEP] if len(rest) else np.zeros(0)
            out += [np.packbits(more, bitorder="little").tobytes(), before.astype("<u4").tobytes()]
            rest = rest[more] >> np.uint32(8)
    return b"".join(out)


class Segment:
    """Reader of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a code segment")
        self.n = int(np.frombuffer(payload, "<u8", 1, 4)[0])
        self.levels, at = [], 13
        for level in range(payload[12]):
            n = int(np.frombuffer(payload, "<u8", 1, at)[0])
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if level + 1 < payload[12]:
                bits = np.frombuffer(payload, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(payload, "<u4", -(-n // STEP), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def access(self, i: int) -> int:
        """The id at place i, by rank steps alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STEP
            before = np.unpackbits(bits[block * STEP // 8 : (i >> 3) + 1], bitorder="little")[: i - block * STEP]
            i, shift = int(ranks[block]) + int(before.sum()), shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n, dtype=np.uint32)
        where = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            value = chunks.astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= value
            else:
                out[where] |= value
            if bits is not None:
                more = np.flatnonzero(np.unpackbits(bits, bitorder="little")[: len(chunks)])
                where = more if where is None else where[more]
        return out


#: Letters that are their own NFC form and whose small form is one such letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Signs that end a word without joining its letters: all of ASCII's but the
#: apostrophe, which the tokenizer takes together with some letters.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
ALL_LETTERS = "".join(c for c in map(chr, range(256)) if re.fullmatch(f"[{LETTERS}]", c))
#: Words of letters that are encoded in one call.
JOINED = 4096


class WordTokenizer:
    """Whole-text encoding through the tokenizers library, once per distinct
    word; the ids are those of ``Tokenizer.encode`` with its defaults, special
    tokens in a text included.

    Fit for tokenizers whose tokens never span ASCII white space and drop it
    (as ``word_bpe_49k.json`` does): a text's ids are then its words' ids in
    order. A word of LETTERS and closing signs has the ids of both, as
    neither changes the other; every other word is encoded as it stands.
    Words of letters are encoded many at a time; each is one piece, so it ends
    at the only token that carries the end-of-word suffix. Where that count is
    off, they are encoded singly. Such words need no normal form but lower
    case, which they are given beforehand, so the same vocabulary and merges
    run behind a plain split at spaces; where a probe shows another result, the
    whole tokenizer takes them. Other tokenizers take ``whole=True``.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads of their own would contend
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.whole = whole
        self.parts: dict[str, bytes] = {"": b""}
        suffix = json.loads(self.model.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.model.get_vocab_size(), dtype=bool)
        if suffix:
            self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith(suffix)]] = True
        small = [c for c in map(chr, range(97, 256)) if c.islower() and re.fullmatch(f"[{LETTERS}]", c)]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters, self.bytes_of = Tokenizer(self.model.model), {c: level.pre_tokenize_str(c)[0][0] for c in small if not c.isascii()}
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = " ".join("".join(small[i : i + n]) for n in (1, 2, 3, 5, 9) for i in range(len(small)))
        if self._joined(probe) != self.model.encode(probe, add_special_tokens=False).ids:
            self.letters, self.bytes_of = self.model, {}

    def _joined(self, words: str) -> list[int]:
        for letter, as_bytes in self.bytes_of.items():  # no letter's bytes hold another letter
            words = words.replace(letter, as_bytes)
        return self.letters.encode_batch_fast([words], add_special_tokens=False)[0].ids

    def _single(self, parts: list[str]) -> None:
        for part, e in zip(parts, self.model.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.parts[part] = array("I", e.ids).tobytes()

    def _letters(self, parts: list[str]) -> None:
        for at in range(0, len(parts), JOINED):
            own = parts[at : at + JOINED]
            ids = np.array(self._joined(" ".join(own)), dtype=np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(own) or (len(ids) and last[-1] != len(ids)):
                self._single(own)
                continue
            data, ends = ids.tobytes(), (4 * last).tolist()
            self.parts.update(zip(own, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _pieces(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of the distinct pieces of the words, and each word's two
        pieces: its letters and its closing signs, or all of it and nothing."""
        cores = pc.utf8_rtrim(words, characters=TAIL)
        letters = pc.match_substring_regex(cores, pattern=f"^[{LETTERS}]+$")
        first = pc.if_else(letters, pc.utf8_lower(cores), words)
        tails = pc.if_else(letters, pc.utf8_ltrim(words, characters=ALL_LETTERS), "")
        coded = pa.concat_arrays([first, tails]).dictionary_encode()
        pieces, which = listed(coded.dictionary), coded.indices.to_numpy()
        if len(self.parts) > MEMORY_WORDS:
            self.parts = {"": b""}
        found = list(map(self.parts.get, pieces))
        if None in found:
            alpha = np.zeros(len(pieces), dtype=bool)
            alpha[which[: len(words)][letters.to_numpy(zero_copy_only=False)]] = True
            new = [i for i, p in enumerate(found) if p is None]
            self._letters([pieces[i] for i in new if alpha[i]])
            self._single([pieces[i] for i in new if not alpha[i]])
            found = list(map(self.parts.__getitem__, pieces))
        return found, which.reshape(2, -1).T

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's number.
        Words and their pieces are told apart in Arrow; Python sees each
        distinct piece once."""
        if self.whole:
            found = self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return np.array([i for e in found for i in e.ids], dtype=np.uint32), np.array([len(e.ids) for e in found], dtype=np.int64)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        parts, two = self._pieces(coded.dictionary)
        each = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        ids, _ = gathered(np.frombuffer(b"".join(parts), dtype=np.uint32), each, two.reshape(-1))
        sizes = each[two].sum(axis=1) if len(two) else np.zeros(0, np.int64)
        out, ends = gathered(ids, sizes, coded.indices.to_numpy())
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])]
        return out, np.diff(upto)


def listed(words: pa.Array) -> list[str]:
    """The words, none of which holds a space, as one string cut apart: far
    quicker than value by value."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


_tokenizers: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer_of(path: str, whole: bool) -> WordTokenizer:
    """One per worker process, so that its tasks share the words it knows."""
    if (path, whole) not in _tokenizers:
        _tokenizers[path, whole] = WordTokenizer(path, whole)
    return _tokenizers[path, whole]


def _encode(path: str, end_id: int, segment_tokens: int, whole: bool):
    def run(batches):
        model, part = tokenizer_of(path, whole), TaskContext.get().partitionId()
        docs, lens, ids, held, seg, before = [], [], [], 0, 0, 0

        def segment():
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seg": [seg], "before": [before], "n_tokens": [held], "doc_ids": [docs], "doc_lens": [lens], "payload": [encode_segment(np.concatenate(ids))]},
                schema=SEGMENTS_ARROW,
            )

        for batch in batches:
            for own in slices(batch, "text"):
                found, sizes = model.encode(own.column("text"))
                # each document's ids with the end id behind them
                found, ends = np.insert(found, np.cumsum(sizes), end_id), np.cumsum(sizes + 1).tolist()
                begin = 0
                for doc, end in zip(own.column("doc_id").to_pylist(), ends, strict=True):
                    docs.append(doc)
                    lens.append(end - begin)
                    ids.append(found[begin:end])
                    held, begin = held + end - begin, end
                    if held >= segment_tokens:
                        yield segment()
                        docs, lens, ids, seg, before, held = [], [], [], seg + 1, before + held, 0
        if docs:
            yield segment()

    return run


SEGMENTS = "part int, seg int, before long, n_tokens long, doc_ids array<long>, doc_lens array<long>, payload binary"
SEGMENTS_ARROW = pa.schema(
    [("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def write_codes(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, ``end_id`` after each, in ascending doc_id order
    (null first, rows of one doc_id by text), and write the segments. Returns
    the written table, one row per segment, in the order of (part, seg)."""
    rows = texts(docs, id_col, text_col)
    rows = rows.repartitionByRange(shuffle_parts(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(tidied(_encode(tokenizer, end_id, segment_tokens, whole)), SEGMENTS), "codes")


def _decode(starts: dict[int, int]):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Segment(row["payload"]).all().astype("<u4")
                ends = np.cumsum(row["doc_lens"])
                begin = ends - row["doc_lens"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": begin + row["before"] + starts[row["part"]],
                        "n_tokens": pa.array(row["doc_lens"], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin, ends, strict=True)], pa.int64()),
                    }
                )

    return run


def read_index(codes: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32.

    Only the token totals of the write's partitions, one number each, come to
    the driver; starts within a partition are in its segments.
    """
    totals = {r["part"]: r["n"] for r in codes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]
    return codes.mapInArrow(tidied(_decode(starts)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(codes: DataFrame, place: int) -> int:
    """The id at one place of the whole output: one segment is read and one
    id taken from it."""
    for part, total in sorted((r["part"], r["n"]) for r in codes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        if place < total:
            row = codes.where((F.col("part") == part) & (F.col("before") <= place) & (F.col("before") + F.col("n_tokens") > place)).select("before", "payload").first()
            return Segment(bytes(row["payload"])).access(place - row["before"])
        place -= total
    raise IndexError(place)

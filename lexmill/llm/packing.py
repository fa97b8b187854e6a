"""Packing: documents concatenated in scan order and cut into windows of a fixed number of tokens.

Two passes. The first tokenizes every partition once and writes its token ids with each document's running start
inside the partition. Partition totals (one number a partition) are summed in partition order, which gives each
partition its global offset; the second pass cuts windows at multiples of the window size. Nothing is shuffled.

Null text is an empty text, whose only id is the end id. Null ids, repeated ids and repeated rows are rows of their
own; an empty table gives no pieces. Columns other than the two named are ignored.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import arrow_rows, by_bytes, cut, give_back

WINDOW = 2048
#: The id put after every document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces remembered with their ids in one task, and bytes of text that are split at a time.
PIECES, BYTES = 500_000, 8 << 20

#: How the vocabulary file splits text before merging, less the runs of letters between: a blank on either side of each
#: match leaves pieces apart by white space. Only texts of code points below U+0250 are split here; there composition does
#: nothing and lower-casing has no context (U+0130 aside); the four separators below the blank are left out, as languages
#: differ on whether they are white space. All other texts go to the library whole.
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|\pN|[^\x09-\x0D\x20\pL\pN]+"
_OTHER = r"[^\x00-\x1B\x20-\x{12F}\x{131}-\x{24F}]|<\|"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in the vocabulary: itself if it is printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + i for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as little-endian 16-bit bytes, with the pieces met so far remembered.

    No piece spans white space or depends on its neighbours, so Arrow splits the texts of a batch and numbers their
    distinct pieces, the library merges each new piece once, and Arrow puts the ids of the pieces in place of their
    numbers. Of a full memory of pieces the older half stays: the first met, among them all frequent ones.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size()
        if sys.byteorder != "little" or size > 1 << 16:
            raise ValueError("ids are kept in 16 bits, low byte first")
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        # merging alone, for pieces that are split and lower-cased already
        self.merges = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        suffix = parts["model"]["end_of_word_suffix"]
        self.last = np.zeros(size, bool)
        self.last[[i for token, i in self.merges.get_vocab().items() if token.endswith(suffix)]] = True
        self.characters = {b: c for b, c in _byte_characters().items() if b != 10}
        self.pieces: dict[str, bytes] = {"": b""}

    def _learn(self, fresh: list[str]) -> None:
        """Merges new pieces, a thousand at a time; each one's last token is the only one to carry the end mark."""
        spelt = "\n".join(fresh).encode().decode("latin-1").translate(self.characters).split("\n")
        groups = [spelt[i : i + 1000] for i in range(0, len(spelt), 1000)]
        found = self.merges.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint16) for x in found])
        ends = (2 * np.flatnonzero(self.last[ids]) + 2).tolist()
        data = ids.tobytes()
        self.pieces.update(zip(fresh, (data[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))

    def _split(self, texts: pa.Array) -> list[bytes]:
        texts = pc.utf8_lower(texts)
        for blank in ("\x85", "\xa0"):  # Arrow's own split at these leaves some blanks at ends of texts
            texts = pc.replace_substring(texts, blank, " ")
        apart = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _APART, r" \0 "))
        numbered = apart.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        fresh = [p for p in distinct if p not in self.pieces]
        if fresh:
            if len(self.pieces) + len(fresh) > PIECES:
                self.pieces = dict(islice(self.pieces.items(), PIECES // 2))
                fresh = [p for p in distinct if p not in self.pieces]
            self._learn(fresh)
        ids = pa.array([self.pieces[p] for p in distinct], pa.large_binary()).take(numbered.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[np.asarray(apart.offsets)].tolist()
        data = memoryview(ids.buffers()[2]) if bounds[-1] else b""
        return [bytes(data[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).cast(pa.large_string()).fill_null("")
        out: list = [None] * len(texts)
        other = np.asarray(pc.match_substring_regex(texts, _OTHER))
        whole = np.flatnonzero(other)
        for i, found in zip(whole, self.whole.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, np.uint16).tobytes()
        plain = np.flatnonzero(~other)
        sizes = np.asarray(pc.binary_length(texts))[plain].cumsum()
        for rows in np.split(plain, np.flatnonzero(np.diff(sizes // BYTES)) + 1):
            for i, ids in zip(rows, self._split(texts.take(pa.array(rows))), strict=True) if len(rows) else ():
                out[i] = ids
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """First pass: per document its ids, their number, the partition, and the tokens before it in that partition."""
    path = path or tokenizer_path()
    tail = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part, before = Encoder(path), TaskContext.get().partitionId(), 0
        for batch in it:
            ids = [x + tail for x in tokens(batch.column(1))]
            for a, b in by_bytes(map(len, ids)):
                n = np.array([len(x) // 2 for x in ids[a:b]], np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.full(b - a, part, np.int64)), pa.array(ends - n), pa.array(n), pa.array(ids[a:b], pa.binary())], ["key", "part", "before", "n", "ids"])
                before = int(ends[-1])
        del tokens
        give_back()

    picked = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("words"))
    return picked.mapInArrow(run, f"key {picked.schema['key'].dataType.simpleString()}, part long, before long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces: ``doc_id, start, length, doc_tokens, sequence_id, offset, boundary, ids``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers; ``boundary`` marks a piece of a document
    that a window's edge cuts. Only the last window is not full. The totals brought to the driver are one number
    a partition.
    """
    with arrow_rows(docs.sparkSession):
        tokens = cut(encode(docs, id_col, text_col, path), "pack")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()
    bases, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        bases[row["part"]] = at
        at += row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(bases)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, bases, cols = batch.column(0), shared.value, [[] for _ in range(7)]
            rows, ids = [], []
            for i, (part, before, n, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                begin = bases[part] + before
                wide = np.frombuffer(data, "<u2").astype("<u4").tobytes()
                at = begin
                while at < begin + n:
                    end = min(begin + n, (at // window + 1) * window)
                    rows.append(i)
                    ids.append(wide[4 * (at - begin) : 4 * (end - begin)])
                    for col, x in zip(cols, (at - begin, end - at, n, at // window, at % window, end - at < n), strict=False):
                        col.append(x)
                    at = end
            for a, b in by_bytes(map(len, ids)):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[a:b], pa.int64())), *(pa.array(c[a:b], pa.int64()) for c in cols[:5]), pa.array(cols[5][a:b], pa.bool_()), pa.array(ids[a:b], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", "ids"])

    return tokens.mapInArrow(run, f"doc_id {tokens.schema['key'].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per window: its pieces in order with their ids. A window holds at most its size, so a group is small."""
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("pieces"), F.sum("length").alias("tokens"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

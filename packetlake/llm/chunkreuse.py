"""Encoding in which text chunks shared by documents are encoded once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding

from packetlake.llm.common import maybe_member, slices, stored
from packetlake.llm.textarrays import as_bytes, prefix_sums, span_hashes
from packetlake.llm.wordpieces import WordPieces, pack, word_pieces

#: Bytes of the rolling window, mean distance of cuts, and least size of a chunk worth sharing.
WINDOW = 32
MEAN_CHUNK = 256
LEAST_CHUNK = 64
#: Least bytes of a join on either side, longer than any added token, and ids that have to agree there.
REACH = 24
AGREE = 2
NO_ID = -(1 << 63)

OCCURRENCES = "doc long, text_hash long, start long, length long, h1 long, h2 long"
ENCODED = "h1 long, h2 long, length long, enter array<int>, leave array<int>, body binary"


def cuts(data: np.ndarray, begins: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Cut positions of all texts: their ends, and each place whose last WINDOW bytes
    hash to zero modulo MEAN_CHUNK, if a character begins there."""
    ends = np.arange(WINDOW, len(data))
    found = ends[:0]
    if len(ends):
        value = span_hashes(sums, ends - WINDOW, ends)
        found = ends[(value % np.uint64(MEAN_CHUNK) == 0) & (data[ends] & 0xC0 != 0x80)]
        text = np.searchsorted(begins, found, "right") - 1
        found = found[found - begins[text] >= WINDOW]
    return np.unique(np.concatenate([found, begins]))


def chunk_occurrences(docs: DataFrame) -> DataFrame:
    """Chunks of at least LEAST_CHUNK bytes of ``docs`` (doc, text_hash, text)."""

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for low, high in slices(texts):
                data, begins = as_bytes(texts.slice(low, high - low))
                sums = prefix_sums(data)
                at = cuts(data, begins, sums)
                starts, ends = at[:-1], at[1:]
                large = ends - starts >= LEAST_CHUNK
                starts, ends = starts[large], ends[large]
                text = np.searchsorted(begins, starts, "right") - 1
                # The rolling hash only finds cuts; a chunk is known by a digest of its bytes.
                raw = data.tobytes()
                digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist()))
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                rows = pa.array(low + text)
                columns = [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(starts - begins[text]),
                    pa.array(ends - starts),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "text_hash", "start", "length", "h1", "h2"])

    return docs.select("doc", "text_hash", "text").mapInArrow(occur, OCCURRENCES)


def anchors(text: str, encoding: Encoding) -> tuple[list[int], list[int]]:
    """Where the ids of a chunk may be entered and left: flat (ids before, bytes before) of
    pieces at least REACH bytes from both its ends, from its begin on and from its end back
    (the 1st, 2nd, 4th ... of them). Nearer to an end, what stands beyond it may change a piece."""
    pieces, spans = encoding.word_ids, encoding.offsets
    at = [i for i in range(1, len(pieces)) if pieces[i] != pieces[i - 1] and spans[i][0] >= spans[i - 1][1]]
    size = len(text.encode())
    if size == len(text):
        found = [(i, spans[i][0]) for i in at]
    else:
        width = np.frombuffer(text.encode("utf-32-le"), "<u4")
        before = np.concatenate([[0], np.cumsum(1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF))])
        found = [(i, int(before[spans[i][0]])) for i in at]
    inner = [f for f in found if REACH <= f[1] <= size - REACH]

    def spread(places: list[tuple[int, int]]) -> list[int]:
        steps = [2**n - 1 for n in range(len(places).bit_length())]
        return [n for step in steps for n in places[step]]

    return spread(inner), spread(inner[::-1])


def encode_chunks(owners: DataFrame, tokenizer: str) -> DataFrame:
    """Ids and anchors of each chunk that ``owners`` (text, chunks) lists, encoded by itself."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = word_pieces(tokenizer).tokenizer
        for batch in batches:
            rows = []
            for text, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                for chunk in chunks:
                    part = raw[chunk["start"] : chunk["start"] + chunk["length"]].decode()
                    encoding = library.encode(part, add_special_tokens=False)
                    rows.append((chunk["h1"], chunk["h2"], chunk["length"], *anchors(part, encoding), narrow(pack(encoding.ids))))
            if rows:
                places = pa.list_(pa.int32())
                types = (pa.int64(), pa.int64(), pa.int64(), places, places, pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "length", "enter", "leave", "body"])

    return owners.mapInArrow(encode, ENCODED)


def narrow(ids: bytes) -> bytes:
    """Ids in 16 bits if they fit, with the width in the first byte."""
    values = np.frombuffer(ids, "<u4")
    if len(values) and int(values.max()) >= 1 << 16:
        return b"\x04" + ids
    return b"\x02" + values.astype("<u2").tobytes()


def widen(packed: bytes) -> bytes:
    if packed[:1] == b"\x04":
        return packed[1:]
    return np.frombuffer(packed, "<u2", offset=1).astype("<u4").tobytes()


def pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


class Joiner:
    """The ids of one text from those of its shared chunks, in order.

    A join is the text between two chunks with some of the ids on both sides. It
    is encoded again, first from the nearest anchors. Its first ids have to be
    those of the chunk before it from that anchor on, and its last ids those of
    the chunk behind it up to that anchor; a side that disagrees moves to its next
    anchor, further inside its chunk. A chunk whose anchors all disagree is
    encoded again as part of the join.
    """

    def __init__(self, raw: bytes, encode: Callable[[str], bytes]):
        self.raw, self.encode = raw, encode
        self.parts: list[bytes] = []
        # The chunk before the join: its ids, how many are replaced at its begin, the place behind those, and its anchors.
        self.ids, self.used, self.used_at, self.leave = b"", 0, 0, []
        self.end = 0

    def window(self, side: int, until: int) -> tuple[bytes, bool]:
        """The join's ids from an anchor of the chunk before it, and whether they agree with that chunk."""
        if side == len(self.leave):  # where that chunk was entered: settled already
            return self.encode(self.raw[self.used_at : until].decode()), True
        index, at = self.leave[side]
        ids = self.encode(self.raw[at:until].decode())
        expected = self.ids[4 * index : 4 * (index + AGREE)]
        return ids, ids[: len(expected)] == expected

    def settle(self, side: int, ids: bytes) -> None:
        index = self.used if side == len(self.leave) else self.leave[side][0]
        self.parts += [self.ids[4 * self.used : 4 * index], ids]

    def add(self, chunk: dict) -> None:
        if chunk["start"] < self.end:
            return
        body, enter = widen(chunk["body"]), pairs(chunk["enter"])
        before = after = 0
        while after < len(enter):
            index, at = enter[after]
            ids, agrees = self.window(before, chunk["start"] + at)
            expected = body[4 * max(0, index - AGREE) : 4 * index]
            if agrees and ids.endswith(expected):
                break
            after += not ids.endswith(expected)
            before += not agrees
        else:
            return  # its text becomes part of the next join
        self.settle(before, ids)
        self.ids, self.used, self.used_at = body, index, chunk["start"] + at
        self.leave = [(i, chunk["start"] + p) for i, p in pairs(chunk["leave"]) if i > index]
        self.end = chunk["start"] + chunk["length"]

    def finish(self) -> bytes:
        for side in range(len(self.leave) + 1):
            ids, agrees = self.window(side, len(self.raw))
            if agrees:
                self.settle(side, ids)
                break
        return b"".join(self.parts)


def joined(raw: bytes, chunks: list[dict], encode: Callable[[str], bytes]) -> bytes:
    """Packed ids of a text of which ``chunks`` (start, length, enter, leave, body) are known."""
    joiner = Joiner(raw, encode)
    for chunk in sorted(chunks, key=lambda c: c["start"]):
        joiner.add(chunk)
    return joiner.finish()


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): packed unsigned 32-bit ids.

    Chunks end where a rolling hash of the text says so, so equal passages give
    equal chunks wherever they stand. A chunk met more than once is encoded in
    the document that holds it first and sent to the others; joins of chunks are
    encoded again until their ids agree with the chunks on both sides, and the
    rest of each text is encoded in its own task. Only documents that may hold a shared chunk
    leave their task. Null text is empty; repeated rows stay rows; other columns
    are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    found = chunk_occurrences(rows)
    often = stored(found.groupBy(F.col("h1").alias("key")).count().filter("count > 1").select("key"), "keys")
    shared = stored(maybe_member(found, often, F.col("h1"), "maybe").filter("maybe").drop("maybe"), "occurrences")
    owner = F.min(F.struct("doc", "text_hash", "start")).alias("owner")
    once = stored(shared.groupBy("h1", "h2", "length").agg(F.count("*").alias("n"), owner).filter("n > 1"), "chunks")

    def with_lists(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that may have a list, joined with it, and the others."""
        flagged = maybe_member(rows, lists.select(F.xxhash64("doc", "text_hash").alias("key")), F.xxhash64("doc", "text_hash"), "maybe")
        return flagged.filter("maybe").drop("maybe").join(lists, ["doc", "text_hash"], "left"), flagged.filter("NOT maybe")

    listed = (
        once.select("owner.*", "h1", "h2", "length")
        .groupBy("doc", "text_hash")
        .agg(F.collect_list(F.struct("start", "length", "h1", "h2")).alias("chunks"))
    )
    owners, _ = with_lists(stored(listed, "owners"))
    owned = owners.filter("chunks IS NOT NULL").dropDuplicates(["doc", "text_hash"]).select("text", "chunks")
    encoded = stored(encode_chunks(owned, tokenizer), "encoded")

    places = (
        shared.distinct()
        .join(encoded, ["h1", "h2", "length"])
        .groupBy("doc", "text_hash")
        .agg(F.collect_list(F.struct("start", "length", "enter", "leave", "body")).alias("chunks"))
    )
    some, others = with_lists(stored(places, "places"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder: WordPieces = word_pieces(tokenizer)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                texts, lists = part.column(1).to_pylist(), part.column(2).to_pylist()
                fresh = iter(encoder.encode([text for text, chunks in zip(texts, lists) if not chunks]))
                ids = [joined(text.encode(), chunks, lambda t: encoder.encode([t])[0]) if chunks else next(fresh) for text, chunks in zip(texts, lists)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    empty = F.array().cast("array<struct<start:bigint,length:bigint,enter:array<int>,leave:array<int>,body:binary>>").alias("chunks")
    everything = some.select("doc_id", "text", "chunks").unionByName(others.select("doc_id", "text", empty))
    return everything.mapInArrow(assemble, "doc_id long, ids binary")


class PieceTexts:
    """Texts of ids, as the library's ``decode(ids, skip_special_tokens=False)`` without a decoder step."""

    def __init__(self, path: str):
        tokenizer = word_pieces(path).tokenizer
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies without a decoder step")
        size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.pieces = [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.numbers = [str(i).encode() for i in range(size)]

    def decode(self, ids: list[int]) -> bytes:
        """The text in UTF-8: pieces joined by one space."""
        return b" ".join(map(self.pieces.__getitem__, ids))

    def decimal(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.numbers.__getitem__, ids))

"""Encoding of whole texts with a public byte-level vocabulary, in overlapping chunks that are stitched where pre-token boundaries agree."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, on every executor.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters of a chunk that it owns, and how far it reads into the next one to find the boundary where that one begins.
CHUNK, OVERLAP = 1 << 16, 1 << 10
# Fixed value: the published pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places at which every pre-tokenisation of the text has a boundary, whatever stands before: white space after something else, or a change between
#: letters, numbers and other signs (an apostrophe before letters may begin a contraction, so it is no such place).
SURE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The vocabulary as an encoder without special tokens; read once per worker."""
    import tiktoken

    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, first: bool, last: bool, own: int) -> tuple[str, str, str]:
    """(head, body, tail) of a chunk that owns ``own`` characters and reads on. body begins and ends at sure boundaries.

    head is what stands before the first such place and belongs to the pre-token of the chunk before; tail is what must be joined with the next
    chunk's head. If the chunks agree on a boundary in the overlap, the body goes on to there, and the next one's head, which is then in this body,
    is dropped by its length; the tail is empty.
    """
    if first:
        begin = 0
    else:
        m = SURE.search(text, 1)  # text[0] is the character before the chunk
        begin = m.start() if m else len(text)
    if last:
        return text[(0 if first else 1) : begin], text[begin:], ""
    end = own + (0 if first else 1)  # where the next chunk begins
    if begin >= end:  # no boundary of its own: all it owns is head
        return text[1:end], "", ""
    if m := SURE.search(text, end):
        return text[(0 if first else 1) : begin], text[begin : m.start()], ""
    at = begin
    for m in SURE.finditer(text, begin + 1):
        if m.start() > end:
            break
        at = m.start()
    return text[(0 if first else 1) : begin], text[begin:at], text[at:end]


def encode_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) of every row: the ids of its text without special tokens; a text that looks like a special token is plain text.

    An empty and a null text give an empty list; repeated rows stay repeated; a null id stays null. Texts of up to ``chunk`` characters are encoded where they were read, without
    a shuffle. Longer ones are cut into chunks that many tasks encode; then the chunks of a document meet again, by a key of the row, and
    only what lies between two boundaries that chunks could not agree on is encoded there. ``ids`` decode to the text's bytes.
    """
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for b in batches:
            ids = [encode(t) if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for b in batches:
            heads, ids, tails, agreed = [], [], [], []
            for t, k, n in zip(*(b.column(c).to_pylist() for c in ("text", "k", "n")), strict=True):
                first, last = k == 0, k == n - 1
                head, body, tail = cut(t, first, last, chunk)
                heads.append(head)
                ids.append(encode(body) if body else [])
                tails.append(tail)
                agreed.append(not last and bool(body) and not tail and SURE.search(t, chunk + (0 if first else 1)) is not None)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("k"), b.column("n"), pa.array(heads, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(tails, pa.string()), pa.array(agreed, pa.bool_())],
                ["row", "doc_id", "k", "n", "head", "ids", "tail", "agreed"],
            )

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                ids, open_text, covered = [], "", False
                for p in parts:
                    if not covered:
                        open_text += p["head"]
                    if p["ids"]:
                        if open_text:
                            ids += encode(open_text)
                        ids += p["ids"]
                        open_text = p["tail"]
                        covered = p["agreed"]
                    else:
                        open_text, covered = open_text + p["tail"], False
                out.append(ids + (encode(open_text) if open_text else []))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = dict(d.dtypes)["doc_id"]
    short = d.filter(~long).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    cut_up = d.filter(long).select("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("l")).alias("row"), F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0)).alias("c"))
    near = lambda c, k: F.concat(F.coalesce(F.right(F.get("c", k - 1), F.lit(1)), F.lit("")), c, F.coalesce(F.left(F.get("c", k + 1), F.lit(overlap)), F.lit("")))
    chunked = cut_up.select("doc_id", "row", F.size("c").alias("n"), F.posexplode(F.transform("c", near)).alias("k", "text")).repartition(F.col("row"), F.col("k"))
    row = f"struct<doc_id:{kind},h:bigint,l:int>"
    parts = chunked.mapInArrow(pieces, f"row {row}, doc_id {kind}, k int, n int, head string, ids array<int>, tail string, agreed boolean")
    together = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set(F.struct("k", "head", "ids", "tail", "agreed"))).alias("parts"), (F.count(F.lit(1)) / F.first("n")).cast("int").alias("times"))
    stitched = together.select(F.explode(F.array_repeat("doc_id", F.col("times"))).alias("doc_id"), "parts").mapInArrow(stitch, f"doc_id {kind}, ids array<int>")
    return short.unionByName(stitched)


def decode(ids: list[int], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes one after another."""
    return encoding(folder, vocabulary).decode_bytes(ids).decode("utf-8")

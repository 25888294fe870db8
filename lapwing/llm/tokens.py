"""Token-ID output: whole texts to ids of a public tokenizer, packed with Simple-8b into shards, and read back.

A shard file is Parquet written by Spark, so any store that Spark writes to will do. Each row is a chunk
of consecutive documents: their ids and counts, the packed words, the first word of each block, the escapes.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm import simple8b
from lapwing.llm.common import shared_dir, table, text_of
from lapwing.llm.spans import Table, names

END_ID = 0
#: Bytes of text after which a chunk is closed.
CHUNK_BYTES = 8_000_000
#: Pieces that a worker remembers with their ids.
CACHE = 1_500_000
CHUNKS = "shard int, chunk int, doc_ids array<bigint>, counts array<bigint>, n bigint, words binary, offsets array<int>, escapes binary"
_loaded: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """A tokenizers file, with the ids of pieces remembered.

    Byte-level pre-tokenization never joins a character other than white space with a space or a newline after it, so a
    text cut before its single spaces and before its lone newlines gives, piece by piece, the ids of the whole; and so
    does a cut between a letter and a comma or full stop that ends a piece. Texts with other white space, with a space
    beside another or beside a newline, or with an added token's string go to the library whole, and so does every text
    if the file says anything else than byte-level BPE without normalizer or prefix space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piecewise = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = ["  ", " \n", "\n ", *self.added, *_OTHER_SPACES]
        # what byte-level pre-tokenization writes for each byte: printable ones as they are, the others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.bytewise = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.marks = {mark: self.coded(mark) for mark in (",", ".", "\n")} | {"": b""}
        self.forget()

    def forget(self) -> None:
        """Start anew: pieces are remembered up to a bound."""
        self.known, self.at, self.size = Table(CACHE), np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64)
        self.ids, self.end = np.zeros(4 * CACHE, np.uint32), 0

    def coded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        kept = [k for k, t in enumerate(texts) if self.piecewise and not any(a in t for a in self.apart)]
        plain = set(kept)
        odd = [k for k in range(len(texts)) if k not in plain]
        for k, ids in zip(odd, self.whole([texts[k] for k in odd])):
            out[k] = np.array(ids, np.uint32)
        if kept:
            raw = [texts[k].encode() for k in kept]
            lengths = np.array([len(x) for x in raw])
            ends = np.cumsum(lengths)
            data = b"".join(raw)
            of = np.frombuffer(data, np.uint8)
            cuts = of == 32
            line = of == 10
            cuts[1:-1] |= line[1:-1] & ~line[:-2] & ~line[2:]
            cuts[(ends - lengths)[lengths > 0]] = True
            starts = np.flatnonzero(cuts)
            sizes = np.diff(starts, append=len(data))
            every, counts = self.pieces(data, starts, sizes)
            first = np.searchsorted(starts, np.append(ends - lengths, len(data)))
            bounds = np.concatenate(([0], np.cumsum(counts)))[first].tolist()
            for k, a, b in zip(kept, bounds, bounds[1:]):
                out[k] = every[a:b]
        return out

    def pieces(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces of data, ids of each). Pieces unknown so far are encoded once and remembered."""
        one, two = names(data, starts, sizes)
        code = self.known.find(one, two)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            _, new = np.unique(one[missing], return_index=True)
            new = missing[new]
            if self.known.n + len(new) > CACHE:
                self.forget()
                _, new = np.unique(one, return_index=True)
                missing = np.arange(len(one))
            if len(new) > CACHE:  # more than is ever remembered: in two halves, cut at a piece
                half = len(starts) // 2
                parts = [self.pieces(data, starts[part], sizes[part]) for part in (slice(None, half), slice(half, None))]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            self.learn([data[a : a + n].decode() for a, n in zip(starts[new].tolist(), sizes[new].tolist())])
            self.known.add(one[new], two[new])
            code[missing] = self.known.find(one[missing], two[missing])
        size = self.size[code]
        ends = np.cumsum(size)
        place = np.repeat(self.at[code] - (ends - size), size)
        place += np.arange(len(place))
        return self.ids[place], size

    def learn(self, new: list[str]) -> None:
        """Encode pieces, each with the space or newline that it begins with, and keep their ids."""
        found: list = [None] * len(new)
        rest = []
        for k, text in enumerate(new):
            lead = text[:1] if text[:1] in (" ", "\n") else ""
            mark = text[-1:] if text[-1:] in (",", ".") else ""
            core = text[len(lead) : len(text) - len(mark)]
            if core.isalpha():
                found[k] = (self.marks["\n"] if lead == "\n" else b"") + self.word(core, " " if lead == " " else "") + self.marks[mark]
            else:
                rest.append(k)
        for k, ids in zip(rest, self.whole([new[k] for k in rest])):
            found[k] = array("I", ids).tobytes()
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        here = slice(self.known.n, self.known.n + len(new))
        self.size[here], self.at[here] = sizes, self.end + np.cumsum(sizes) - sizes
        if self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.end], np.zeros(max(len(flat), len(self.ids)), np.uint32)))
        self.ids[self.end : self.end + len(flat)] = flat
        self.end += len(flat)

    def word(self, letters: str, before: str) -> bytes:
        """The ids of letters with a space or nothing before them: one pre-token, which the library's model takes as it is."""
        text = (self.bytewise[32] if before else "") + letters if letters.isascii() else (before + letters).encode().decode("latin-1").translate(self.bytewise)
        return array("I", [x.id for x in self.tokenizer.model.tokenize(text)]).tobytes()


def cuts_at_spaces(file: dict) -> bool:
    """Whether a tokenizers file is one that Encoder may cut for: byte-level BPE, nothing before or behind it."""
    cut, model, last = file.get("pre_tokenizer") or {}, file["model"], file.get("post_processor") or {"type": "ByteLevel"}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and last["type"] == "ByteLevel"
    bare = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    free = not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in file.get("added_tokens", ()))
    return plain and bare and free and not file.get("normalizer") and not file.get("truncation") and not file.get("padding")


#: White space other than the space and the newline.
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, order_by: tuple[str, ...] = ("doc_id",)) -> None:
    """Encode every text (null: empty), append end_id, and write the ids in ascending order of order_by.

    Shards are ranges of these columns, and inside a shard ties of them are set in order by text, so reruns write the
    same. tokenizer is the path of a tokenizers file on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk = encoder(tokenizer), 0
        ids: list = []
        texts: list[str] = []
        size = 0

        def closed() -> pa.RecordBatch:
            tokens = [np.append(x, np.uint32(end_id)) for x in encode(texts)]
            every = np.concatenate(tokens)
            words, offsets, escapes = simple8b.encode(every)
            row = {"chunk": chunk, "doc_ids": ids, "counts": [len(x) for x in tokens], "n": len(every), "words": words, "offsets": offsets, "escapes": escapes}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("words", pa.binary()), ("offsets", pa.list_(pa.int32())), ("escapes", pa.binary())])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield closed()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield closed()

    keys = [F.col(c).alias(f"_order{k}") for k, c in enumerate(order_by)]
    rows = docs.select("doc_id", text_of().alias("text"), *keys)
    names = [f"_order{k}" for k in range(len(keys))]
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names, "text").select("doc_id", "text")
    chunks = rows.mapInArrow(run, CHUNKS.split(", ", 1)[1])
    chunks.withColumn("shard", F.spark_partition_id()).write.option("compression", "zstd").parquet(path)


def chunk_ids(row: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, ids before it in the chunk, its ids) of a chunk's documents, from the packed words."""
    ids, at = simple8b.decode(row["words"], row["n"], row["offsets"], row["escapes"]), 0
    for doc_id, count in zip(row["doc_ids"], row["counts"]):
        yield doc_id, at, ids[at : at + count]
        at += count


def read_token_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row for each document in the shards: doc_id, start (ids before it), n_tokens, ids_crc32, and ids if asked for.

    Starts are running sums in two levels, chunks within a shard and shards, over one small row for each chunk.
    """
    fields = [("shard", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a chunk at a time
                row = batch.slice(k, 1).to_pylist()[0]
                docs = list(chunk_ids(row))
                columns = [[row["shard"]] * len(docs), [row["chunk"]] * len(docs), [d for d, _, _ in docs], [a for _, a, _ in docs], [len(x) for _, _, x in docs], [zlib.crc32(x.astype("<u4").tobytes()) for _, _, x in docs]]
                columns += [[x.astype(np.int64) for _, _, x in docs]] * with_ids
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    chunks = spark.read.schema(CHUNKS).parquet(path)
    shards = chunks.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    earlier = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("shard", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("chunk_start")).join(shards, "shard")
    docs = chunks.mapInArrow(run, "shard int, chunk int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)
    docs = docs.join(starts, ["shard", "chunk"]).withColumn("start", F.col("shard_start") + F.col("chunk_start") + F.col("within"))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_shards(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_shards(spark, path, with_ids=False)

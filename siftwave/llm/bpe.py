"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it into chunks whose borders depend on content alone, so
documents that share passages share chunks. Digests of chunks are counted over all documents (the only large
shuffle, about 32 bytes a chunk); the text of each chunk that two or more documents hold is encoded once, and
its ids are broadcast. The inside of a shared chunk, between its first and last sure token border, takes those
ids; what lies between two such insides is encoded in one go from sure border to sure border. Where a chunk has
no two borders it counts as not shared, so the ids always agree with those of the whole text.

A border is sure before a white-space character that follows a character that is not white space: no
pre-token and no special token of the vocabulary has such a pair inside, and pre-tokenising starts anew
there. Vocabulary and pattern are those of the public byte-level tokenizer; `<|endoftext|>` in a text is
the special token, as in the tokenizers library's encode().

The broadcast holds at most `max_shared` bytes of chunks, those of most documents first; other shared chunks
are encoded in place, with the same ids. `docs` is read three times, so it should be a table.

Defined cases: a null text is encoded as the empty text (no ids); repeated rows, null ids and an empty
table need no care; very long texts are cut like others; other columns are kept, of the same name replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwave.llm.common import scratch_table

SPECIAL = {"<|endoftext|>": 50256}
#: Chunks have about this many bytes, and the broadcast ones this many together.
CHUNK = 256
MAX_SHARED = 32 << 20
#: No white space, then ASCII white space: a sure token border lies between them.
BORDER = re.compile(r"\S(?=[ \t\n\r\f\v])")
_MIX = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """One vocabulary a process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def borders(data: np.ndarray, size: int = CHUNK, width: int = 8) -> np.ndarray:
    """Places where the hash of the last `width` bytes is 0 modulo `size`, at character starts."""
    mixed, h = _MIX[data], np.zeros(len(data), np.uint32)
    for i in range(width):
        h[width:] += mixed[width - i : len(data) - i] << np.uint32(i)
    at = np.flatnonzero((h >> np.uint32(7)) % np.uint32(size) == 0)
    return at[(at >= width) & ((data[at] & 0xC0) != 0x80)]


def chunks(texts: list[bytes], size: int = CHUNK, width: int = 8, together: int = 4 << 20) -> Iterator[list[int]]:
    """The borders of each text, from 0 to its length, at least size / 4 bytes apart; hashes are taken over many texts at once."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= together):
            total += len(texts[end])
            end += 1
        starts = np.cumsum([0, *map(len, texts[at:end])])
        found = borders(np.frombuffer(b"".join(texts[at:end]), np.uint8), size, width) if total > width else np.zeros(0, np.int64)
        cut = np.searchsorted(found, starts)
        for k in range(end - at):
            start, last, keep = starts[k], 0, [0]
            for x in (found[cut[k] : cut[k + 1]] - start).tolist():
                if x >= width and x - last >= size // 4:
                    keep.append(x)
                    last = x
            n = int(starts[k + 1] - start)
            yield [*keep, n] if n > last else keep
        at = end


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Encoder:
    """Encodes and decodes texts, with the ids of shared chunks at hand: first and last border and the ids between, by digest."""

    def __init__(self, ranks_path: str, pattern: str, shared: dict[bytes, tuple[int, int, bytes]] | None = None):
        self.enc, self.shared, self.reused = encoding(ranks_path, pattern), shared or {}, 0

    def plain(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)

    def inside(self, chunk: bytes) -> tuple[int, int, bytes] | None:
        """First and last sure border in the chunk (bytes) and the ids between; None without two of them."""
        text = chunk.decode()
        first = BORDER.search(text)
        if first is None:
            return None
        a = first.end()
        stripped = text.rstrip()
        # The last border is before the white space that ends the chunk, or before its last word.
        tail = len(stripped) if len(stripped) < len(text) else max((i for i in map(stripped.rfind, " \n\t")), default=-1)
        while tail > a and stripped[tail - 1].isspace():
            tail -= 1
        if tail <= a or not BORDER.match(text, tail - 1):
            return None
        return len(text[:a].encode()), len(text[:tail].encode()), self.plain(text[a:tail]).astype("<u4").tobytes()

    def encode(self, data: bytes, at: list[int]) -> np.ndarray:
        """The ids of a text with chunk borders `at`."""
        out, done = [], 0
        for a, b in zip(at, at[1:], strict=False):
            found = self.shared.get(digest(data[a:b])) if self.shared else None
            if found:
                first, last, ids = found
                if done < a + first:
                    out.append(self.plain(data[done : a + first].decode()))
                out.append(np.frombuffer(ids, "<u4"))
                done = a + last
                self.reused += 1
        if done < len(data) or not out:
            out.append(self.plain(data[done:].decode()))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.enc.decode_bytes(ids).decode("utf-8", errors="replace")


def text_bytes(part: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in part.column("text").cast(pa.large_binary()).to_pylist()]


def count_chunks(size: int, held: int = 300_000):
    """digest, n (documents) and size of the chunks of a partition, summed over about `held` chunks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.binary()), "n": pa.array([c[0] for c in counts.values()], pa.int64()), "size": pa.array([c[1] for c in counts.values()], pa.int64())})

        counts: dict[bytes, list[int]] = {}
        for part in parts:
            texts = text_bytes(part)
            for data, at in zip(texts, chunks(texts, size), strict=True):
                own = {data[a:b] for a, b in zip(at, at[1:], strict=False)}
                for chunk in own:
                    counts.setdefault(digest(chunk), [0, len(chunk)])[0] += 1
                if len(counts) >= held:
                    yield flush()
                    counts = {}
        if counts:
            yield flush()

    return run


def shared_texts(size: int, wanted):
    """digest and text of the wanted chunks of a partition, each once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted.value)
        for part in parts:
            texts, found = text_bytes(part), {}
            for data, at in zip(texts, chunks(texts, size), strict=True):
                for a, b in zip(at, at[1:], strict=False):
                    if (name := digest(data[a:b])) in left:
                        left.discard(name)
                        found[name] = data[a:b]
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(found), pa.binary()), "chunk": pa.array(list(found.values()), pa.binary())})

    return run


def shared_chunks(docs: DataFrame, vocabulary: str, size: int = CHUNK, max_shared: int = MAX_SHARED) -> dict[bytes, tuple[int, int, bytes]]:
    """Digest, borders and ids of the chunks that two or more documents hold, of most documents first, at most `max_shared` bytes of them."""
    spark, texts = docs.sparkSession, docs.select(F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(count_chunks(size), "digest binary, n long, size long").groupBy("digest").agg(F.sum("n").alias("n"), F.max("size").alias("size")).filter("n > 1 and size > 24")
    counts = scratch_table(counts.withColumn("level", F.floor(F.log2("n")).cast("int")), "chunk-counts")
    part, room = {}, max_shared
    for level, total in sorted(((r["level"], r["total"]) for r in counts.groupBy("level").agg(F.sum("size").alias("total")).collect()), reverse=True):
        part[level] = min(1.0, room / total)
        room -= min(room, total)
    if not part:
        return {}
    take = F.coalesce(*[F.when(F.col("level") == k, F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < int(v * 1_000_000)) for k, v in part.items()])
    wanted = spark.sparkContext.broadcast({bytes(r[0]) for r in counts.filter(take).select("digest").collect()})
    once = texts.mapInArrow(shared_texts(size, wanted), "digest binary, chunk binary").groupBy("digest").agg(F.min("chunk").alias("chunk"))
    paths = _paths(vocabulary)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(*paths)
        for p in parts:
            rows = [(d, *f) for d, c in zip(p.column("digest").to_pylist(), p.column("chunk").to_pylist(), strict=True) if (f := coder.inside(c))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["digest", "first", "last", "ids"])

    return {bytes(r[0]): (r[1], r[2], bytes(r[3])) for r in once.mapInArrow(encode, "digest binary, first long, last long, ids binary").collect()}


def _paths(vocabulary: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(vocabulary), public_tokenizers.PATTERN


def with_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", size: int = CHUNK, max_shared: int = MAX_SHARED, ids: bool = True, digests: bool = False) -> DataFrame:
    """`docs` with n_tokens and, as asked for, ids, or ids_sha256 and decoded_sha256 (of the text decoded from the ids)."""
    added = [("n_tokens", T.LongType())] + [("ids", T.ArrayType(T.LongType()))] * ids + [(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] * digests
    kept = docs.drop(*[c for c, _ in added])
    columns = kept.columns
    schema = T.StructType([*kept.schema.fields, *[T.StructField(*x) for x in added]])
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(kept, vocabulary, size, max_shared))
    paths = _paths(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(*paths, shared.value)
        for part in parts:
            n, all_ids, sha, back, texts = [], [], [], [], text_bytes(part)
            for data, at in zip(texts, chunks(texts, size), strict=True):
                own = coder.encode(data, at)
                n.append(len(own))
                if ids:
                    all_ids.append(own.astype(np.int64))
                if digests:
                    sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(coder.decode(own).encode()).hexdigest())
            new = [pa.array(n, pa.int64())] + [pa.array(all_ids, pa.list_(pa.int64()))] * ids + [pa.array(x, pa.string()) for x in (sha, back)] * digests
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *new], names=[*columns, *[c for c, _ in added]])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """`df` with decoded, the text of its ids; null for null ids."""
    shared = _paths(vocabulary)

    @F.pandas_udf("string")
    def text_of(ids):
        coder = Encoder(*shared)
        return ids.map(lambda x: None if x is None else coder.decode(np.asarray(x, np.uint32)))

    return df.withColumn("decoded", text_of("ids"))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_tokens(docs, ids=False, digests=True).drop("text")

"""Token ids in Simple-8b words: tokenized shards in document order, and their vectorised reader."""

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from driftpool.llm.bounds import Grown, Numbered, measured, worker_store

# how many values of how many bits a 64-bit word holds under selectors 0, 1, ...; the upper four bits select
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
# a word with this selector names a place in the list of values that need more than 60 bits
ESCAPE = 15
BLOCK = 128
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQQQQQ")
CHUNK_IDS = 1 << 20
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END = 2


def pack(ids: np.ndarray, sizes: np.ndarray, before: int = 0) -> bytes:
    """One chunk: header, ids of each document, id at which each block of words begins, escapes, words.

    ``ids`` are unsigned 64-bit values of consecutive documents, ``before`` the number of ids ahead of them in
    their shard. A word takes the most values that fit; blocks of BLOCK words can be decoded alone.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    large = ids >= np.uint64(1 << 60)
    escapes = ids[large]
    values = ids.copy()
    values[large] = np.arange(len(escapes), dtype=np.uint64)
    starts, chosen = _choose(values, large)
    words = np.zeros(len(starts), np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        at = np.flatnonzero(chosen == s)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo:lo + (1 << 16)]
            shifts = (np.arange(count) * width).astype(np.uint64)
            laid = values[starts[part][:, None] + np.arange(count)] << shifts
            words[part] = np.bitwise_or.reduce(laid, axis=1) | np.uint64(s << 60)
    at = np.flatnonzero(chosen == ESCAPE)
    words[at] = values[starts[at]] | np.uint64(ESCAPE << 60)
    offsets = starts[::BLOCK].astype("<u8")
    head = HEADER.pack(MAGIC, BLOCK, len(sizes), n, before, len(escapes), len(words))
    return b"".join([head, sizes.astype("<u8").tobytes(), offsets.tobytes(), escapes.astype("<u8").tobytes(),
                     words.astype("<u8").tobytes()])


def _choose(values, large):
    """(first value of each word, selector): from left to right the selector that takes most values."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = np.zeros(n, np.uint8)
    for limit in WIDTHS[:-1]:
        need += values >= np.uint64(1 << int(limit))   # index of the narrowest width that holds the value
    need[large] = len(COUNTS)
    pick = np.full(n, len(COUNTS) - 1, np.uint8)
    tops = {1: need}
    size = 1
    while 2 * size <= min(n, COUNTS[0]):
        tops[2 * size] = np.maximum(tops[size][:-size], tops[size][size:])
        size *= 2
    for s in range(len(COUNTS) - 2, -1, -1):
        count = int(COUNTS[s])
        if count > n:
            break
        size = 1 << (count.bit_length() - 1)
        top = tops[size]
        most = top[:n - count + 1] if size == count else np.maximum(
            top[:n - count + 1], top[count - size:n - size + 1])
        pick[:n - count + 1][most <= s] = s
    pick[large] = ESCAPE
    step = np.append(COUNTS, [1, 1])[pick]
    jump, starts, i = step.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts, np.int64)
    return starts, pick[starts].astype(np.int64)


def unpack(data: bytes, first_block: int = 0, blocks: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, sizes of the documents, ids before the chunk); of some blocks only, if asked, with the same sizes."""
    magic, block, docs, n, before, large, count = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a chunk of Simple-8b words")
    at = HEADER.size
    sizes = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", -(-count // block), at + 8 * docs).astype(np.int64)
    at += 8 * docs + 8 * len(offsets)
    escapes = np.frombuffer(data, "<u8", large, at)
    words = np.frombuffer(data, "<u8", count, at + 8 * large)
    last = len(offsets) if blocks is None else min(len(offsets), first_block + blocks)
    words = words[first_block * block:last * block]
    begin = int(offsets[first_block]) if first_block < len(offsets) else n
    end = int(offsets[last]) if last < len(offsets) else n
    chosen = (words >> np.uint64(60)).astype(np.int64)
    held = np.append(COUNTS, [1, 1])[chosen]
    places = np.cumsum(held) - held
    out = np.zeros(end - begin, np.uint64)
    for s, (c, width) in enumerate(zip(COUNTS, WIDTHS)):
        own = np.flatnonzero(chosen == s)
        for lo in range(0, len(own), 1 << 16):
            part = own[lo:lo + (1 << 16)]
            shifts = (np.arange(c) * width).astype(np.uint64)
            out[places[part][:, None] + np.arange(c)] = (words[part][:, None] >> shifts) & np.uint64((1 << int(width)) - 1)
    own = np.flatnonzero(chosen == ESCAPE)
    out[places[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out, sizes, before


class WordEncoder:
    """Ids of texts by a tokenizer whose tokens never span a space or a line end; words met before are kept.

    Where the tokenizer's rules allow it, a point or comma is cut from the letter or digit before it, and text of
    Latin letters is lower-cased first: fewer different words, the same ids.
    """

    KEPT_BYTES = 192 << 20
    # the rule by which letters, digits and other signs never share a token
    CLASSES = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    POINT = re.compile("(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])[.,](?=[ \\n])")

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.clear()
        marks = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.marks, self.mark = [m for _, m in marks], marks[0] if marks else None
        rules = json.loads(definition)
        self.cuts = self.CLASSES in json.dumps(rules["pre_tokenizer"]).replace("\\\\", "\\")
        self.lowers = '"Lowercase"' in json.dumps(rules["normalizer"])

    def _split(self, text):
        if self.cuts:
            text = self.POINT.sub(r" \g<0>", text)
        if self.lowers and not any(m[:2] in text for m in self.marks):
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def _words(self, words):
        """(word, ids in bytes): many words in one call, a special token between them."""
        alone = []
        if self.mark is None:
            alone = words
        elif any(m in " ".join(words) for m in self.marks):
            alone = [w for w in words if any(m in w for m in self.marks)]
        for w in alone:
            yield w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        rest = list(set(words) - set(alone)) if alone else words
        for at in range(0, len(rest), 256):
            part = rest[at:at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[1].join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            raw, last = ids.tobytes(), 0
            for w, cut in zip(part, (4 * cuts).tolist()):
                yield w, raw[last:cut]
                last = cut + 4

    def clear(self):
        self.numbers, self.at, self.size, self.ids, self.bytes = Numbered(), Grown(np.int64), Grown(np.int64), Grown(np.uint32), 0

    def _learn(self, words):
        found = dict(self._words(words))
        each = [found[w] for w in words]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        self.at.add(self.ids.size + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.ids.add(np.frombuffer(b"".join(each), "<u4"))
        self.bytes += sum(map(len, words)) + 180 * len(words) + 4 * int(sizes.sum())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.bytes > self.KEPT_BYTES:
            self.clear()
        split = [self._split(t or "") for t in texts]
        words = [w for part in split for w in part]
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            self._learn(fresh)
        size = self.size.data[number]
        total = np.append(0, np.cumsum(size))
        where = np.arange(total[-1]) + np.repeat(self.at.data[number] - total[:-1], size)
        cuts = total[np.cumsum([len(part) for part in split])]
        return np.split(self.ids.data[where], cuts[:-1]) if split else []


def _encoder(definition):
    store = worker_store("simple8b")
    if definition not in store:
        store[definition] = WordEncoder(definition)
    return store[definition]


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
          end: int = END) -> None:
    """Tokenize every text, append ``end`` and write shards of chunks in ascending order of id, equal ids by a hash of the text.

    A row of the files is a chunk: ``shard`` and ``chunk`` in order, the ids of its documents (a null id comes
    first) and ``data`` as ``pack`` makes it. Null and empty texts have the end id alone. The tokenizer file is
    read by the driver and handed to the tasks; it has to cut at white space.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    names = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tied = names.withColumn("tie", F.xxhash64("text"))
    ordered = tied.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches):
        encoder, shard = _encoder(definition), TaskContext.get().partitionId()
        keys, parts, held, chunk, before = [], [], 0, 0, 0

        def out():
            sizes = np.array([len(p) for p in parts], np.int64)
            data = pack(np.concatenate(parts), sizes, before)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.concat_arrays(keys_arrays(keys))),
                 pa.array([held], pa.int64()), pa.array([data], pa.binary())],
                names=["shard", "chunk", "ids", "n_tokens", "data"])

        def keys_arrays(found):
            return [pa.array([k.as_py() for k in found], found[0].type)]

        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                some = texts.slice(lo, 512).to_pylist()
                for k, ids in enumerate(encoder.encode(some)):
                    keys.append(batch.column(0)[lo + k])
                    parts.append(np.append(ids, np.uint32(end)))
                    held += len(parts[-1])
                    if held >= CHUNK_IDS:
                        yield out()
                        chunk, before = chunk + 1, before + held
                        keys, parts, held = [], [], 0
        if keys:
            yield out()

    ordered.mapInArrow(run, f"shard int, chunk int, ids array<{kind}>, n_tokens bigint, data binary").write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, tokens) of every document: ``start`` counts the ids of all documents before it.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``tokens`` are the ids themselves.
    """
    files = spark.read.parquet(folder)
    kind = files.schema["ids"].dataType.elementType.simpleString()
    # one row a shard
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = measured(totals.select("shard", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead")))
    rows = files.join(totals, "shard").select("ids", "data", "ahead")

    def run(batches):
        for batch in batches:
            for ids, data, ahead in zip(batch.column(0), batch.column(1), batch.column(2)):
                values, sizes, before = unpack(data.as_py())
                ends = np.cumsum(sizes)
                small = values.astype("<u4")
                sums = [zlib.crc32(small[b - s:b].tobytes()) for b, s in zip(ends.tolist(), sizes.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                                 pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(ends - sizes + before + ahead.as_py()), pa.array(sizes), pa.array(sums, pa.int64()),
                     lists], names=["id", "start", "n_tokens", "ids_crc32", "tokens"])

    return rows.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, tokens array<bigint>")

"""Token ids as wavelet-matrix shards.

Documents are ordered by id, encoded with a given tokenizer, closed with an end
id and written as shards. A shard is one file: the doc ids and lengths, and per
bit of the ids a plane of n bits in which the ids appear stably partitioned by
the higher bits. Planes are compressed block by block with the number of ones
before each block, so one token, a count or the place of an occurrence is found
by reading a few blocks of each plane.

Defined results: null or empty text holds only the end id; documents of equal id
keep one entry each, ordered by text; a null id sorts first; an empty table
writes no shard and gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import Counter64, documents, extended, gather, scratch_path

MAGIC = b"WVMX0001"
BLOCK = 1 << 16  # bytes of a plane in one compressed block
SHARD_TOKENS = 1 << 21
#: Words of letters that no normalizer composes and no pre-tokenizer splits, and the marks behind them.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)").fullmatch


class Words(Counter64):
    """Numbers words; ``seen`` has the latest."""

    def __init__(self):
        self.seen = []

    def __missing__(self, word):
        self.seen.append(word)
        return super().__missing__(word)


class CachedEncoder:
    """Ids of whole texts; each distinct white-space-separated word is encoded once.

    Right for tokenizers whose pre-tokenizer never joins characters across ASCII white space.
    """

    def __init__(self, tokenizer_json: str, memory: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker on every core
        from tokenizers import Tokenizer
        self.tok, self.memory = Tokenizer.from_str(tokenizer_json), memory
        suffix = json.loads(tokenizer_json)["model"].get("end_of_word_suffix")
        self.closing = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.lower = False
        if suffix:
            # lower-casing first halves the distinct words; only right where the tokenizer does it itself
            self.lower = '"Lowercase"' in json.dumps(json.loads(tokenizer_json)["normalizer"])
            for piece, k in self.tok.get_vocab(with_added_tokens=False).items():
                self.closing[k] = piece.endswith(suffix)
        self.closes = bool(self.closing.any())
        self.clear()

    def clear(self):
        self.rows, self.starts, self.sizes = Words(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.held, self.apart = np.zeros(0, np.uint32), 0, {}

    def _encode(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start and number of ids of each word, all ids). ``plain`` words, of letters alone, go to the tokenizer
        joined by blanks: each ends with one closing id, so the closing ids show where a word ends. Other words
        go one by one."""
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at, flat, held = np.flatnonzero(plain), [], 0
        for a in range(0, len(at), 1000):
            part = at[a:a + 1000]
            ids = np.array(self._ids([" ".join([words[k] for k in part])])[0], np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not close each pre-token once")
            sizes[part] = np.diff(ends, prepend=0)
            starts[part] = held + ends - sizes[part]
            flat.append(ids)
            held += len(ids)
        rest = np.flatnonzero(~plain)
        for a in range(0, len(rest), 1000):
            part = rest[a:a + 1000]
            found = self._ids([words[k] for k in part])
            sizes[part] = np.fromiter(map(len, found), np.int64, len(part))
            starts[part] = held + np.cumsum(sizes[part]) - sizes[part]
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[part].sum())))
            held += len(flat[-1])
        return starts, sizes, np.concatenate(flat)

    def _apart(self, marks: str) -> bool:
        """Whether the tokenizer takes these marks behind a letter as if they stood alone; asked once."""
        if marks not in self.apart:
            whole, letter, alone = self._ids(["a" + marks, "a", marks])
            self.apart[marks] = whole == letter + alone
        return self.apart[marks]

    def _learn(self, known: int):
        """Ids of the words seen since ``known``. Letters with marks behind them have the ids of both, so
        the letters are encoded once, whatever marks follow them."""
        seen, words, plain, alone, joined, halves = self.rows.seen, [], [], [], [], []
        for k, b in enumerate(seen, known):  # ``seen`` grows by letters and marks that are new themselves
            w = b.decode("utf-8", "surrogatepass")
            m = PLAIN(w) if self.closes else None
            if m and m[2] and self._apart(m[2]):
                joined.append(k)
                halves += self.rows[m[1].encode()], self.rows[m[2].encode()]
            else:
                words.append(w)
                plain.append(bool(m and not m[2]))
                alone.append(k - known)
        starts, sizes = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        starts[alone], sizes[alone], flat = self._encode(words, np.array(plain))
        self.starts = extended(self.starts, known, self.held + starts)
        self.sizes = extended(self.sizes, known, sizes)
        self.flat = extended(self.flat, self.held, flat)
        self.held += len(flat)
        if joined:
            flat, sizes = gather(self.starts, self.sizes, self.flat, np.array(halves))
            sizes = sizes.reshape(-1, 2).sum(1)
            self.starts[joined], self.sizes[joined] = self.held + np.cumsum(sizes) - sizes, sizes
            self.flat = extended(self.flat, self.held, flat)
            self.held += len(flat)
        seen.clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids alone: places in the text are not followed."""
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.rows) > self.memory:
            self.clear()
        known, words = len(self.rows), []
        for t in texts:
            b = t.encode("utf-8", "surrogatepass")
            words.append((b if b"<|" in b else b.lower()).split() if self.lower else b.split())
        counts = np.cumsum([0, *map(len, words)])
        numbers = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64, counts[-1])
        if len(self.rows) > known:
            self._learn(known)
        flat, sizes = gather(self.starts, self.sizes, self.flat, numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[counts].tolist()
        return [flat[a:z] for a, z in zip(ends, ends[1:])]


_encoders: dict[int, CachedEncoder] = {}


def worker_encoder(tokenizer_json: str) -> CachedEncoder:
    """The encoder of this Python worker: what it has learned serves the next task too."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = CachedEncoder(tokenizer_json)
    return _encoders[key]


def pack(values: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    """The bytes of one shard file."""
    z = zstandard.ZstdCompressor(level=1)
    bits = max(1, int(values.max(initial=0)).bit_length())
    head = pa.BufferOutputStream()
    table = pa.record_batch([doc_ids, pa.array(lengths, pa.int64())], ["doc_id", "n"])
    with pa.ipc.new_stream(head, table.schema) as w:
        w.write_batch(table)
    parts, planes = [z.compress(head.getvalue().to_pybytes())], []
    seq = values.astype(np.uint16 if bits <= 16 else np.uint32)
    for bit in range(bits - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << bit)) != 0
        packed = np.packbits(one, bitorder="little")
        blocks, ones, before = [], [], 0
        for a in range(0, len(packed), BLOCK):
            piece = packed[a:a + BLOCK]
            blocks.append(z.compress(piece.tobytes()))
            ones.append(before)
            before += int(np.bitwise_count(piece).sum())
        planes.append({"sizes": [len(b) for b in blocks], "ones": ones, "zeros": len(seq) - before})
        parts += blocks
        seq = np.concatenate([np.compress(~one, seq), np.compress(one, seq)])
    meta = json.dumps({"n": len(values), "head": len(parts[0]), "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(meta)), meta, *parts])


class Shard:
    """Reads a shard; blocks are decompressed when first touched."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        size, = struct.unpack_from("<I", data, 8)
        meta = json.loads(data[12:12 + size])
        self.data, self.n, self.planes = data, meta["n"], meta["planes"]
        self._z, self._blocks, at = zstandard.ZstdDecompressor(), {}, 12 + size
        head = pa.ipc.open_stream(self._z.decompress(data[at:at + meta["head"]])).read_all()
        self.doc_ids, self.lengths = head.column("doc_id"), head.column("n").to_numpy()
        at += meta["head"]
        for p in self.planes:
            p["at"] = at + np.cumsum([0, *p["sizes"]])
            at = int(p["at"][-1])

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._blocks:
            at = self.planes[level]["at"]
            self._blocks[level, k] = np.frombuffer(self._z.decompress(self.data[at[k]:at[k + 1]]), np.uint8)
        return self._blocks[level, k]

    def _bit(self, level: int, i: int) -> int:
        byte = i >> 3
        return int(self._block(level, byte // BLOCK)[byte % BLOCK] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, byte = (i >> 3) // BLOCK, (i >> 3) % BLOCK
        p = self.planes[level]
        if k == len(p["sizes"]):
            return self.n - p["zeros"]
        b = self._block(level, k)
        rest = int(b[byte] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0
        return p["ones"][k] + int(np.bitwise_count(b[:byte]).sum()) + rest

    def access(self, i: int) -> int:
        """Token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level, p in enumerate(self.planes):
            b, ones = self._bit(level, i), self._ones(level, i)
            i = p["zeros"] + ones if b else i - ones
            v = v << 1 | b
        return v

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> len(self.planes):
            return 0, 0
        for level, p in enumerate(self.planes):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = token >> (len(self.planes) - 1 - level) & 1
            lo, hi = (p["zeros"] + a, p["zeros"] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first i tokens."""
        lo, hi = self._range(token, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        lo, hi = 0, self.n
        while lo < hi:  # smallest prefix with more than k occurrences
            mid = (lo + hi) // 2
            if self.rank(token, mid + 1) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def tokens(self) -> np.ndarray:
        """All tokens: the partitions of the planes undone from the lowest bit up."""
        out = np.zeros(self.n, np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            p = self.planes[level]
            packed = np.concatenate([self._block(level, k) for k in range(len(p["sizes"]))]) if self.n else np.zeros(0, np.uint8)
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            before = np.empty_like(out)
            before[np.flatnonzero(~one)] = out[:p["zeros"]]
            before[np.flatnonzero(one)] = out[p["zeros"]:] | np.uint32(1 << (len(self.planes) - 1 - level))
            out = before
        return out


def _store(folder: str):
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
        else (pafs.LocalFileSystem(), folder)


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write below ``folder`` under an attempt's own name, then move: readers see whole files only."""
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)
    ctx = TaskContext.get()
    mine = f"{root}/_{name}.{ctx.taskAttemptId() if ctx else 0}"
    with fs.open_output_stream(mine) as f:
        f.write(data)
    fs.move(mine, f"{root}/{name}")
    return name


def read_shard(folder: str, name: str) -> Shard:
    fs, root = _store(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return Shard(f.read())


def write_tokens(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = 1,
                 shard_tokens: int = SHARD_TOKENS) -> list[tuple[str, int]]:
    """Encode ``docs`` and write its shards; returns (file, tokens) in order, one entry a shard."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        encode, part, made = worker_encoder(shared.value), TaskContext.get().partitionId(), 0
        ids, held, docs_held, end = [], 0, [], np.array([end_id], np.uint32)

        def flush():
            nonlocal made, ids, held, docs_held
            lengths = np.array([len(x) + 1 for x in ids])
            data = pack(np.concatenate([x for text in ids for x in (text, end)]), pa.concat_arrays(docs_held), lengths)
            name = write_file(folder, f"part-{part:06d}-{made:05d}.wvm", data)
            row = pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([held], pa.int64())})
            made, ids, held, docs_held = made + 1, [], 0, []
            return row

        for b in batches:
            doc_ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for a in range(0, len(texts), 512):
                docs_held.append(doc_ids.slice(a, 512))
                for x in encode(texts[a:a + 512]):
                    ids.append(x)
                    held += len(x) + 1
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return sorted((r.file, r.n) for r in ordered.mapInArrow(run, "file string, n long").collect())


def read_tokens(spark, folder: str, shards: list[tuple[str, int]], id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shard files."""
    before = np.cumsum([0, *[n for _, n in shards]])
    rows = [(f, int(s)) for (f, _), s in zip(shards, before)]

    def run(batches):
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                s = read_shard(folder, name)
                data, ends = memoryview(s.tokens().astype("<u4").tobytes()), np.cumsum(s.lengths)
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), s.lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [s.doc_ids.combine_chunks(), pa.array(base + ends - s.lengths, pa.int64()),
                     pa.array(s.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the shards of ``docs`` below the shared folder and give each document's digest from them."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-shards")
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary of bounded size, read by the driver
        shards = write_tokens(docs, f.read(), folder, end_id)
    return read_tokens(spark, folder, shards, docs.schema["doc_id"].dataType.simpleString())

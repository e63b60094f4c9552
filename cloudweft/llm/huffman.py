"""Token ids in a compressed binary form: canonical, length-limited Huffman codes in independent blocks.

``write_ids`` tokenises every text once into a staging table, adds up the count of every id over all documents, builds a
canonical code of at most ``max_bits`` bits by package-merge, deals the documents out by ranges of their id, and writes

* ``<path>/code``    symbol, bits - the lengths that define the canonical code, at most one row per vocabulary entry;
* ``<path>/blocks``  part, block, first (ids of the part before the block), ids and lengths of its documents,
  ``payload`` (the bits, high bit first) and ``checkpoints`` (bits in each run of 64 symbols, little-endian 16 bit).

A block holds whole documents and about ``block_symbols`` ids (or one longer document). Parts are in ascending order of the document id, and so
are blocks and documents in them. Every run of 64 symbols starts at a known bit, so a block is decoded with one table
look-up per symbol for all its runs at a time; any block, or any run, can be read alone.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batches, written

RUN = 64
#: Characters that the tokenizer's pattern never joins to a word before them.
_TAIL = ".,!?;:|$%&*#()[]-"
_encoders: dict[str, "Encoder"] = {}


#: The pattern whose tokens never hold a blank, and what stands before and after it in such a tokenizer.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies name bytes: printable Latin-1 as it is, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """What is missing is learnt by itself, so a text with a new piece is walked once."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, x: str) -> bytes:
        return self.learn(x)


class Encoder:
    """Ids of texts as bytes (16 bit each, or 32 for larger vocabularies).

    With the tokenizer described above blanks always end a token, so the pieces between blanks are encoded once and kept, up
    to ``keep`` of them; words in lower case go to its model directly. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        conf = json.loads(self.tokenizer.to_str())
        steps = [x for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (conf[part] or {}).get(inner, [])]
        self.by_piece = [x["type"] for x in steps] == _STEPS and steps[3]["pattern"].get("Regex") == _PATTERN and steps[3]["invert"] and steps[3]["behavior"] == "Removed"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.pieces = _Known(self._learn)
        self.pieces[""] = b""
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.names = [array(self.kind, [k]).tobytes() for k in range(self.tokenizer.get_vocab_size())]

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, x: str) -> bytes:
        """The ids of an unknown piece, from now on known: a word in lower case and the marks after it, or whatever else the tokenizer makes of it."""
        known, words = self.pieces, self.words
        if len(known) >= self.keep:
            known.clear()
            known[""] = b""
        core = x.rstrip(_TAIL)
        # up to U+024F a text is in form NFC and lower case goes letter by letter
        word = core.lower() if core.isascii() or core and max(core) < "\u0250" else core
        got = words.get(word)
        if got is None:
            if not word.isalpha() or not word.isascii() and not (word.islower() and is_normalized("NFC", word)):
                known[x] = got = self._whole(x)
                return got
            if len(words) >= self.keep:
                words.clear()
            named = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            names = self.names
            got = words[word] = b"".join([names[t.id] for t in self.model.tokenize(named)])
        if len(core) < len(x):
            tail = x[len(core) :]
            after = self.marks.get(tail)
            if after is None:
                after = self._whole(tail)
                if len(self.marks) < 10_000:
                    self.marks[tail] = after
            got += after
        known[x] = got
        return got

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


def token_ids(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(id, n, ids): whole texts (null: empty) as ids, with ``end_id`` after each; ``ids`` is compressed."""

    def run(it):
        import zstandard

        pack, encoder = zstandard.ZstdCompressor(level=1).compress, Encoder.of(tokenizer_path)
        tail, width = array(encoder.kind, [] if end_id is None else [end_id]).tobytes(), array(encoder.kind).itemsize
        for ids, texts in batches(it, "id", "text"):
            n, out = [], []
            for t in texts:
                got = encoder.encode(t or "") + tail
                n.append(len(got) // width)
                out.append(pack(got))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, ids binary")


def _width(tokenizer_path: str) -> str:
    return f"<u{array(Encoder.of(tokenizer_path).kind).itemsize}"


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code for positive ``counts`` by package-merge: at most ``max_bits`` bits, or as many as their number needs."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    w = counts[order].astype(np.float64)
    row, levels = w, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        m = len(row) // 2
        both = np.concatenate([w, row[0 : 2 * m : 2] + row[1 : 2 * m : 2]])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        row = both[by]
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for own in reversed(levels):
        s = int(own[:need].sum())
        lengths[:s] += 1
        need = 2 * (need - s)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes of symbols in ascending order with the given lengths: shorter first, then by symbol."""
    order = np.lexsort((np.arange(len(bits)), bits))
    codes, code, last = np.zeros(len(bits), np.uint64), 0, 0
    for k in order:
        code <<= int(bits[k]) - last
        codes[k], last = code, int(bits[k])
        code += 1
    return codes


class Code:
    """Tables of a canonical code: by symbol for writing, by the next bits for reading."""

    def __init__(self, symbols: np.ndarray, bits: np.ndarray):
        order = np.argsort(symbols)
        symbols, bits = symbols[order], bits[order]
        codes, size = canonical(bits), int(symbols.max(initial=-1)) + 1
        self.top = int(bits.max(initial=1))
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[symbols], self.bits[symbols] = codes, bits
        self.next = np.zeros(1 << self.top, np.int64)  # symbol * 32 + bits
        by = np.lexsort((symbols, bits))
        spans = 1 << (self.top - bits[by])
        self.next[: int(spans.sum())] = np.repeat(symbols[by] * 32 + bits[by], spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, checkpoints) of at least one id."""
        bits, code = self.bits[ids], self.code[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, at = starts >> 6, starts & 63
        room = 64 - at - bits
        fits = room >= 0
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        high = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.bitwise_or.reduceat(high, heads)
        over = np.flatnonzero(~fits)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        runs = np.diff(starts[::RUN], append=ends[-1]).astype("<u2")
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) >> 3], runs.tobytes()

    def unpack(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        b = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        runs = np.frombuffer(checkpoints, "<u2").astype(np.int64)
        at = np.cumsum(runs) - runs
        out = np.zeros((RUN, len(runs)), np.int64)
        last, shift = n - (len(runs) - 1) * RUN, np.uint32(32 - self.top)
        for k in range(RUN):
            if k == last:
                at = at[:-1]
            got = self.next[(window[at >> 3] << (at & 7).astype(np.uint32)) >> shift]
            out[k, : len(at)] = got >> 5
            at = at + (got & 31)
        return out.T.ravel()[:n]


BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("checkpoints", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 18, block_symbols: int = 262_144) -> None:
    """Writes the ids of all ``docs`` below ``path``. Document ids are integers (cast to long); a null id comes first; repeated ids keep all their rows."""
    spark = docs.sparkSession
    kind = _width(tokenizer_path)
    staged = written(token_ids(docs, id_col, text_col, tokenizer_path, end_id), "token-ids")

    def count(it):
        import zstandard

        unpack, sums = zstandard.ZstdDecompressor().decompress, np.zeros(1, np.int64)
        for (packed,) in batches(it, "ids"):
            for lo in range(0, len(packed), 500):
                got = np.bincount(np.frombuffer(b"".join([unpack(x) for x in packed[lo : lo + 500]]), kind), minlength=len(sums))
                got[: len(sums)] += sums
                sums = got
        s = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(s, pa.int64()), pa.array(sums[s], pa.int64())], names=["symbol", "n"])

    counts = staged.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas().sort_values("symbol")
    symbols, bits = counts.symbol.to_numpy(np.int64), code_lengths(counts.n.to_numpy(np.int64), max_bits)
    spark.createDataFrame(list(zip(symbols.tolist(), bits.tolist())), "symbol long, bits long").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast(Code(symbols, bits))

    def encode(it):
        import zstandard
        from pyspark import TaskContext

        part, unpack, code = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress, sent.value
        block, first, size, ids, lengths, held = 0, 0, 0, [], [], []

        def out():
            payload, runs = code.pack(np.frombuffer(b"".join(held), kind).astype(np.int64)) if size else (b"", b"")
            row = {"part": part, "block": block, "first": first, "n": size, "doc_ids": ids, "lengths": lengths, "checkpoints": runs, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])
        for keys, ns, packed in batches(it, "id", "n", "ids"):
            for key, n, x in zip(keys, ns, packed):
                ids.append(key)
                lengths.append(n)
                held.append(unpack(x))
                size += n
                if size >= block_symbols:
                    yield out()
                    block, first, size, ids, lengths, held = block + 1, first + size, 0, [], [], []
        if ids:
            yield out()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged.repartitionByRange(parts, "id").sortWithinPartitions("id", "n", "ids")
    dealt.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.schema("symbol long, bits long").parquet(f"{path}/code").toPandas()
    return Code(rows.symbol.to_numpy(np.int64), rows.bits.to_numpy(np.int64))


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files; ``start`` counts the ids of all documents before it.

    With ``digest`` the ids are replaced by ``ids_crc32``, the CRC-32 of the ids as little-endian 32-bit integers.
    """
    sent = spark.sparkContext.broadcast(_code(spark, path))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row a part: as many as there are write tasks
    bases = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    bases = bases.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def decode(it):
        code = sent.value
        for part, first, ns, keys, lengths, runs, payloads in batches(it, "part", "first", "n", "doc_ids", "lengths", "checkpoints", "payload"):
            for p, f, n, k, ln, r, x in zip(part, first, ns, keys, lengths, runs, payloads):
                ids = code.unpack(x, r, n).astype("<u4") if n else np.zeros(0, "<u4")
                ends = np.cumsum(ln)
                starts = ends - ln
                whole = memoryview(ids.tobytes())
                cols = [pa.array(np.full(len(k), p, np.int32)), pa.array(k, pa.int64()), pa.array(f + starts, pa.int64()), pa.array(ln, pa.int64())]
                spans = list(zip((starts * 4).tolist(), (ends * 4).tolist()))
                if digest:
                    cols.append(pa.array([zlib.crc32(whole[a:b]) for a, b in spans], pa.int64()))
                else:
                    cols.append(pa.array([ids[a // 4 : b // 4].tolist() for a, b in spans], pa.list_(pa.int64())))
                yield pa.record_batch(cols, names=["part", "doc_id", "start", "n_tokens", last])

    last = "ids_crc32" if digest else "ids"
    rows = blocks.select("part", "first", "n", "doc_ids", "lengths", "checkpoints", "payload").mapInArrow(decode, f"part int, doc_id long, start long, n_tokens long, {last} {'long' if digest else 'array<long>'}")
    return rows.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", last)

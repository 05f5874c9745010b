"""Token ids in a binary format: tokenizer, shared-table rANS blocks, checksums, parallel reading.

Format: a folder with `blocks` and `table`, both Parquet as a container.
A row of `blocks` is an independent rANS block: shard and block number, the
position of its first id among all ids, its number of ids, the lanes' states
(the checkpoint from which its decoder starts), its words, a checksum, and an
index of the document parts in it. `table` holds the frequencies that all blocks
share. Ids follow ascending doc_id; shards are ranges of it.

Null, empty and blank texts give the end id alone. A null doc_id comes first. Repeated
rows are encoded as often as they occur; rows with the same doc_id follow one another by the hash of their texts, so that
a doc_id with many rows may span shards. doc_id keeps its type. An empty table gives an empty folder of blocks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import rans
from keyloom.llm.session import folder, parallelism, remove, ship
from keyloom.llm.text import LOWER, Words, slices, within, words

END = 1
#: Pieces of words that a worker keeps the ids of, some 30 bytes each.
CACHE_WORDS = 1_000_000
#: Bytes of text that are encoded at a time.
SLICE = 2 << 20
_PUNCT = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_kept: dict[str, WordEncoder] = {}
#: The normalizer and the pre-tokenizer for which WordEncoder's cuts are exact.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of words, by the tokenizers library; each distinct piece of a word is encoded once as long as the cache has room.

    by_words tells whether the tokenizer's file meets what follows; texts are encoded whole where it doesn't. Exact for tokenizers whose pre-tokenizer never joins what ASCII white space parts and drops it,
    whose added tokens hold no white space, and that lower-case: then the ids of a
    text are those of its white-space-separated words in a row. Lower-casing ASCII first changes no ids
    either, nor does cutting off a tail of ASCII punctuation that follows an ASCII letter or digit, where a run of
    symbols always begins; after anything else (a symbol, a mark, a control character) the tail may continue a run, and the
    word stays whole. Both are skipped where a word may hold an added token (`<|`) or a combining accent.

    The cache is arrays: sorted hashes of pieces, and where the ids of each lie. Only pieces that it lacks
    become Python objects.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_words = _cuts_words(self.tok)
        self.width = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.width)

    def whole(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), 256):
            out += [e.ids for e in self.tok.encode_batch_fast([t or "" for t in texts[i : i + 256]], add_special_tokens=False)]
        return out

    @classmethod
    def get(cls, path: str) -> WordEncoder:
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def pieces(self, P: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces that aren't empty: where the ids of each begin, how many they are, and the ids."""
        code, uniq = pd.factorize(P.hashes())
        place = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        known[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == uniq[place < len(self.keys)]
        at, size = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int32)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return at[code], size[code], self.ids
        first = first_places(code, len(uniq))[new]
        fresh = []
        for i in range(0, len(new), 4096):
            part = [P.word(k).decode() for k in first[i : i + 4096].tolist()]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            size[new[i : i + 4096]] = [len(x) for x in ids]
            fresh.append(np.fromiter(chain.from_iterable(ids), self.width))
        at[new] = len(self.ids) + np.cumsum(size[new], dtype=np.int64) - size[new]
        everything = np.concatenate((self.ids, *fresh))
        if len(self.keys) + len(new) <= CACHE_WORDS:
            order = new[np.argsort(uniq[new])]
            into = place[order]
            self.keys, self.at, self.size = np.insert(self.keys, into, uniq[order]), np.insert(self.at, into, at[order]), np.insert(self.size, into, size[order])
            self.ids = everything
        return at[code], size[code], everything


def _cuts_words(tok) -> bool:
    """Whether a tokenizer's parts are those for which its words can be encoded one by one."""
    normalizer, pre = (json.loads(x.__getstate__()) if x else {} for x in (tok.normalizer, tok.pre_tokenizer))
    pre = pre.get("pretokenizers", [])
    byte_level = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    added = all(t.content.startswith("<|") and not any(c.isspace() for c in t.content) and not (t.lstrip or t.rstrip or t.single_word) for t in tok.get_added_tokens_decoder().values())
    return normalizer == _NORMALIZER and byte_level and pre[0] == _SPLIT and added and not tok.model.dropout


def first_places(code: np.ndarray, n: int) -> np.ndarray:
    """Where each of the codes 0..n-1 occurs first."""
    out = np.empty(n, np.int64)
    out[code[::-1]] = np.arange(len(code))[::-1]
    return out


def _split(W: Words, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the distinct words, lower-cased, and where the punctuation after an ASCII letter or digit that ends each begins; odd words are left as they are."""
    data, start, end = LOWER[W.data], W.start[first], W.end[first]
    mark = (W.data == 0xCC) | (W.data == 0xCD)
    mark[:-1] |= (W.data[:-1] == ord("<")) & (W.data[1:] == ord("|"))
    odd = np.zeros(len(first), bool)
    odd[code[np.searchsorted(W.start, np.flatnonzero(mark), "right") - 1]] = True
    for i in np.flatnonzero(odd).tolist():
        data[start[i] : end[i]] = W.data[start[i] : end[i]]
    cut, live = end.copy(), np.flatnonzero(~odd)
    while len(live):
        live = live[_PUNCT[data[cut[live] - 1]]]
        cut[live] -= 1
        live = live[cut[live] > start[live]]
    # after any other byte the punctuation may be the rest of a longer run of symbols
    joined = (cut > start) & ~_ALNUM[data[cut - 1]]
    cut[joined] = end[joined]
    return data, cut, end


def encode_texts(col: pa.Array, enc: WordEncoder, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, an end id after each text's, and how many each text has."""
    if not enc.by_words:
        found = enc.whole(col.to_pylist())
        n = np.array([len(x) + 1 for x in found], np.int64)
        return np.fromiter(chain.from_iterable((*x, end) for x in found), enc.width, int(n.sum())), n
    W = words(col)
    code, uniq = pd.factorize(W.hashes())
    first = first_places(code, len(uniq))
    data, cut, last = _split(W, code, first)
    # two pieces of each distinct word, in their order; either may be empty
    a, b = np.stack((W.start[first], cut), 1).reshape(-1), np.stack((cut, last), 1).reshape(-1)
    full = np.flatnonzero(b > a)
    at, size = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    at[full], size[full], ids = enc.pieces(Words(data, W.off, a[full], b[full], np.zeros(0, np.int64)))
    flat = np.concatenate((ids[np.repeat(at, size) + within(size)], np.array([end], enc.width)))
    size = size.reshape(-1, 2).sum(1)
    at = np.concatenate((np.cumsum(size) - size, [int(size.sum())]))
    # the end id follows as one more word of every text
    stop = np.cumsum(W.count)
    code = np.insert(code, stop, len(uniq))
    size = np.concatenate((size, [1]))
    n = size[code]
    tokens = flat[np.repeat(at[code], n) + within(n)]
    ends = np.cumsum(n)[stop + np.arange(len(stop))] if len(stop) else np.zeros(0, np.int64)
    return tokens, np.diff(np.concatenate(([0], ends)))


_INDEX = "doc_id ARRAY<{kind}>, seq ARRAY<BIGINT>, part ARRAY<BIGINT>, n ARRAY<BIGINT>, total ARRAY<BIGINT>"
STAGED = "shard INT, block BIGINT, at BIGINT, ids BINARY, " + _INDEX
BLOCKS = "shard INT, block BIGINT, start BIGINT, n_ids INT, states BINARY, words BINARY, crc32 BIGINT, " + _INDEX


def _cut(path: str, end: int):
    """Batches (doc_id, text) of a shard in order, as staged blocks of rans.BLOCK ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = WordEncoder.get(path)
        state = {"block": 0, "seq": 0, "kind": pa.int64()}
        held: list[np.ndarray] = []
        index: list[tuple] = []  # doc_id, seq, part, n, total; n ids of held
        size = 0

        def blocks(last: bool):
            nonlocal held, index, size
            if not size:
                return
            ids = np.concatenate(held)
            n = len(ids) if last else len(ids) // rans.BLOCK * rans.BLOCK
            rows, i = [], 0
            for a in range(0, n, rans.BLOCK):
                b = min(a + rans.BLOCK, n)
                room, parts = b - a, []
                while room:
                    d, q, p, m, t = index[i]
                    take = min(m, room)
                    parts.append((d, q, p, take, t))
                    room -= take
                    if take == m:
                        i += 1
                    else:
                        index[i] = (d, q, p + take, m - take, t)
                rows.append((shard, state["block"], state["block"] * rans.BLOCK, ids[a:b].tobytes(), *map(list, zip(*parts))))
                state["block"] += 1
            held, index, size = [ids[n:]], index[i:], len(ids) - n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _staged_types(state["kind"]))], _staged_names())

        for b in slices(batches, limit=SLICE):
            state["kind"] = b.column("doc_id").type
            tokens, n = encode_texts(b.column("text"), enc, end)
            held.append(tokens)
            size += len(tokens)
            for d, m in zip(b.column("doc_id").to_pylist(), n.tolist()):
                index.append((d, state["seq"], 0, m, m))
                state["seq"] += 1
            if size >= rans.SIDE * rans.BLOCK:
                yield from blocks(False)
        yield from blocks(True)

    return run


def _staged_names() -> list[str]:
    return [c.split()[0] for c in STAGED.split(", ")]


def _staged_types(kind: pa.DataType) -> list[pa.DataType]:
    return [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(kind), *[pa.list_(pa.int64())] * 4]


def _count(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in b.column("ids"):
                c = np.bincount(np.frombuffer(ids.as_buffer(), width))
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "count"])

    return run


def _encode(freq: bytes, base: dict[int, int], width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.of(np.frombuffer(freq, "<u8"))
        for b in batches:
            ids = [np.frombuffer(x.as_buffer(), width) for x in b.column("ids")]
            done = rans.encode(ids, table)
            shard, at = b.column("shard").to_pylist(), b.column("at").to_pylist()
            head = [pa.array(shard, pa.int32()), b.column("block"), pa.array([base[s] + a for s, a in zip(shard, at)], pa.int64()), pa.array([len(i) for i in ids], pa.int32())]
            body = [pa.array([s for s, _ in done], pa.binary()), pa.array([w for _, w in done], pa.binary()), pa.array([rans.checksum(s, w, len(i)) for (s, w), i in zip(done, ids)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*head, *body, *(b.column(c) for c in ("doc_id", "seq", "part", "n", "total"))], [c.split()[0] for c in BLOCKS.split(", ")])

    return run


def write(docs: DataFrame, out: str, path: str | None = None, end: int = END) -> None:
    """Encodes docs (doc_id, text) into the folder `out`.

    The texts are shuffled once, by ranges of doc_id. Their ids are staged compressed, for the
    frequency table must have counted all of them before the first is coded.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_path()
    width = WordEncoder.get(path).width
    text, kind = F.col("text").cast("string"), dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    dealt = rows.repartitionByRange(parallelism(spark, docs), "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    stage, schema = folder(spark, "ids"), STAGED.format(kind=kind)
    dealt.mapInArrow(_cut(path, end), schema).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.schema(schema).parquet(stage)
    # one number for each shard and one for each id of the vocabulary come to the driver
    sizes = {r[0]: r[1] for r in staged.groupBy("shard").agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x))).collect()}
    base, done = {}, 0
    for s in sorted(sizes):
        base[s], done = done, done + sizes[s]
    counts = staged.select("ids").mapInArrow(_count(width), "id BIGINT, count BIGINT").groupBy("id").agg(F.sum("count")).collect()
    full = np.zeros(max((r[0] for r in counts), default=0) + 1, np.int64)
    for i, c in counts:
        full[i] = c
    freq = rans.frequencies(full)
    spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(freq) if f], "id INT, freq INT").coalesce(1).write.parquet(f"{out}/table")
    staged.mapInArrow(_encode(freq.astype("<u8").tobytes(), base, width), BLOCKS.format(kind=kind)).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    remove(spark, stage)


def _decode(freq: bytes, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.of(np.frombuffer(freq, "<u8"), decode=True)
        for b in batches:
            r = b.to_pydict()
            blocks = list(zip(r["n_ids"], r["states"], r["words"]))
            for (n, s, w), want, shard, k in zip(blocks, r["crc32"], r["shard"], r["block"]):
                if rans.checksum(s, w, n) != want:
                    raise ValueError(f"block {k} of shard {shard} is damaged")
            rows = []
            for i, ids in enumerate(rans.decode(blocks, table) if blocks else []):
                raw, a = ids.astype("<u4").tobytes(), 0
                for d, q, p, n, t in zip(*(r[c][i] for c in ("doc_id", "seq", "part", "n", "total"))):
                    piece = raw[4 * a : 4 * (a + n)]
                    rows.append((r["shard"][i], q, d, p, n, t, r["start"][i] + a, zlib.crc32(piece) if digest else piece))
                    a += n
            cols = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.int32(), pa.int64(), b.column("doc_id").type.value_type, *[pa.int64()] * 4, pa.int64() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["shard", "seq", "doc_id", "part", "n", "total", "start", "value"])

    return run


def _parts(spark: SparkSession, out: str, digest: bool) -> DataFrame:
    """A row for each document's part in a block; value: its ids or their crc32."""
    ship(spark)
    table = spark.read.schema("id INT, freq INT").parquet(f"{out}/table").collect()  # as many rows as the vocabulary at most
    freq = np.zeros(max((r[0] for r in table), default=0) + 1, "<u8")
    for i, f in table:
        freq[i] = f
    blocks = spark.read.parquet(f"{out}/blocks")
    ids = blocks.schema["doc_id"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_decode(freq.tobytes(), digest), f"shard INT, seq BIGINT, doc_id {ids}, part BIGINT, n BIGINT, total BIGINT, start BIGINT, value {'BIGINT' if digest else 'BINARY'}")


def _gathered(parts: DataFrame) -> DataFrame:
    g = parts.groupBy("shard", "seq").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.first("total").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "value"))).alias("parts"))
    return g


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, ids BINARY of little-endian unsigned 32-bit integers) of every document."""
    g = _gathered(_parts(spark, out, False))
    return g.select("doc_id", "start", "n_tokens", F.expr("array_join(transform(parts, p -> hex(p.value)), '')").alias("h")).select("doc_id", "start", "n_tokens", F.unhex("h").alias("ids"))


def digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; only parts cut by a block's end are joined up."""

    @F.pandas_udf("bigint")
    def joined(parts: pd.Series) -> pd.Series:
        def one(ps):
            crc = 0
            for p in ps:
                crc = rans.crc_join(crc, p["value"], 4 * p["n"])
            return crc

        return parts.map(one, na_action="ignore")

    g = _gathered(_parts(spark, out, True))
    # a list of one part needs no Python: it is null for the function
    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["value"]).otherwise(joined(F.when(F.size("parts") > 1, F.col("parts"))))
    return g.select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return digests(spark, out)

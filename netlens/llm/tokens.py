"""Token ids as Arrow files of fixed-size-list batches: equal sequences and masks with random access."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.llm.common import filesystem, give_back, materialise, mixed, new_folder

#: Sequences in a record batch; every batch of a file but the last has as many, so sequence k is in batch k // ROWS.
ROWS = 256
#: Places of a worker's table of remembered words (a power of two), and ids that they may have; all are forgotten beyond.
PLACES, IDS = 1 << 21, 12_000_000
#: Bytes of the longest word that is remembered.
LONGEST = 64
#: New words encoded at a time.
LEARNT = 20_000
#: Tasks that read files back, at most.
READERS = 10_000
#: Characters split into words at a time.
CHARS = 1_000_000
#: Fixed value: how the vocabulary of a byte-level BPE writes a space.
SPACE = "\u0120"
#: Blanks that are not one byte.
RARE_BLANKS = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isspace()) + "]")
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file: its words are remembered until the task has written its file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """The worker goes on to other stages, which need the memory of the words."""
    _encoders.clear()
    give_back()


class Words:
    """Remembered words: ids by the 128-bit hash of a word's bytes, in flat arrays of a bounded size.

    A place holds both halves of the hash and where the ids are; a word is looked for
    from its own place on until it or an empty place is found.
    """

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        numbers = mixed(np.arange(2 * LONGEST * 256, dtype=np.uint64), 61)
        self.tables = numbers[:LONGEST * 256], numbers[LONGEST * 256:]
        self.forget()

    def forget(self) -> None:
        self.first, self.second = np.zeros(PLACES, dtype=np.uint64), np.zeros(PLACES, dtype=np.uint64)
        self.at, self.count = np.zeros(PLACES, dtype=np.int32), np.zeros(PLACES, dtype=np.uint16)
        self.ids = np.zeros(1 << 16, dtype=self.dtype)
        self.n_words = self.n_ids = 0

    def hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves for words of at most LONGEST bytes that lie one after the other; never zero."""
        place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
        cells = (place << 8) + data
        with np.errstate(over="ignore"):
            return tuple(mixed(np.add.reduceat(t[cells], starts) + sizes.astype(np.uint64), 7 + k) | np.uint64(1) for k, t in enumerate(self.tables))

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids begin or -1, how many) of every word."""
        at, count = np.full(len(first), -1, dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        place = (first >> np.uint64(20)).astype(np.int64) & (PLACES - 1)
        left = np.arange(len(first))
        while len(left):
            here, p = self.first[place], place
            hit = (here == first[left]) & (self.second[p] == second[left])
            at[left[hit]], count[left[hit]] = self.at[p[hit]], self.count[p[hit]]
            on = ~hit & (here != 0)
            left, place = left[on], (place[on] + 1) & (PLACES - 1)
        return at, count

    def keep(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Add ids to the flat array; (where they begin, how many)."""
        new = np.frombuffer(b"".join(ids), dtype=self.dtype)
        count = np.array([len(x) for x in ids], dtype=np.int64) // self.dtype.itemsize
        if self.n_ids + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.n_ids], np.zeros(max(len(new), self.n_ids), dtype=self.dtype)])
        self.ids[self.n_ids:self.n_ids + len(new)] = new
        at = self.n_ids + np.cumsum(count) - count
        self.n_ids += len(new)
        return at, count

    def add(self, first: np.ndarray, second: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Remember distinct new words; too many of them for the table are not, and then all are forgotten soon."""
        self.n_words += len(first)
        if self.n_words > PLACES * 9 // 10:
            return
        place = (first >> np.uint64(20)).astype(np.int64) & (PLACES - 1)
        left = np.arange(len(first))
        while len(left):
            free = np.flatnonzero(self.first[place] == 0)
            _, one = np.unique(place[free], return_index=True)
            put = free[one]
            p, w = place[put], left[put]
            self.first[p], self.second[p], self.at[p], self.count[p] = first[w], second[w], at[w], count[w]
            on = np.ones(len(left), dtype=bool)
            on[put] = False
            left, place = left[on], (place[on] + 1) & (PLACES - 1)

    def full(self) -> bool:
        return self.n_words > PLACES * 7 // 10 or self.n_ids > IDS


class Encoder:
    """Texts to little-endian ids with a byte-level BPE file of the tokenizers library.

    Such a tokenizer never merges across the space between two words, so the words
    of a text are encoded once and remembered: the ids are those of the whole text.
    A tokenizer of another kind gets whole texts.
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        by_word = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is None and isinstance(by_word, pre_tokenizers.ByteLevel) and not by_word.add_prefix_space:
            self.words: Words | None = Words(self.dtype)
        else:
            self.words = None
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit; those of a space and a word go as one text, in which a unit begins at each id that begins with a space."""
        out: list[bytes] = [b""] * len(units)
        single = [k for k, u in enumerate(units) if u.rfind(" ") == 0 and not u.isspace()]
        for low in range(0, len(single), LEARNT):
            part = single[low:low + LEARNT]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([units[k] for k in part])], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part):
                buffer, cuts = ids.tobytes(), (np.append(starts, len(ids)) * self.dtype.itemsize).tolist()
                found = [buffer[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                found = self._plain([units[k] for k in part])
            for k, x in zip(part, found):
                out[k] = x
        done = set(single)
        others = [k for k in range(len(units)) if k not in done]
        for k, x in zip(others, self._plain([units[k] for k in others])):
            out[k] = x
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of one text after the other; a few texts are split into words at a time."""
        at = 0
        while at < len(texts):
            if self.words and len(texts[at]) > 2 * CHARS:
                yield b"".join(self._encode([" " + piece if k else piece])[0] for k, piece in enumerate(pieces(texts[at])))
                at += 1
                continue
            end, chars = at, 0
            while end < len(texts) and (chars < CHARS or end == at) and not (self.words and len(texts[end]) > 2 * CHARS):
                chars += len(texts[end])
                end += 1
            yield from self._encode(texts[at:end])
            at = end

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.words is None:
            return self._plain(texts)
        whole = [k for k, t in enumerate(texts) if not t or (not t.isascii() and RARE_BLANKS.search(t))]
        if whole:  # blanks of several bytes are not looked for below
            out: list[bytes] = [b""] * len(texts)
            rest = sorted(set(range(len(texts))).difference(whole))
            for k, x in [*zip(whole, self._plain([texts[k] for k in whole])), *zip(rest, self._encode([texts[k] for k in rest]) if rest else ())]:
                out[k] = x
            return out
        words = self.words
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        opens = np.cumsum([0, *map(len, raw)])[:-1]
        blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31)), [True]])
        splits = (data == 32) & ~blank[:-2] & ~blank[2:]
        splits[opens[1:] - 1] = False  # a space at the end of a text
        splits[opens] = True
        starts = np.flatnonzero(splits)
        sizes = np.diff(starts, append=len(data))
        short = sizes <= LONGEST
        at, count = np.full(len(starts), -1, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        if short.all():
            first, second = words.hashes(data, starts, sizes)
        else:
            own = np.cumsum(sizes[short]) - sizes[short]
            first, second = words.hashes(data[np.repeat(short, sizes)], own, sizes[short]) if len(own) else (np.zeros(0, np.uint64),) * 2
        at[short], count[short] = words.find(first, second)
        missing = np.flatnonzero(at[short] < 0)
        _, one = np.unique(first[missing], return_index=True)
        new = np.flatnonzero(short)[missing[one]]
        long = np.flatnonzero(~short)
        buffer, ends = data.tobytes(), starts + sizes
        ids = self._units([buffer[a:b].decode() for a, b in zip(starts[new].tolist() + starts[long].tolist(), ends[new].tolist() + ends[long].tolist())])
        where, n = words.keep(ids)
        words.add(first[missing[one]], second[missing[one]], where[:len(new)], n[:len(new)])
        found = np.searchsorted(first[missing[one]], first[missing])
        at[np.flatnonzero(short)[missing]], count[np.flatnonzero(short)[missing]] = where[:len(new)][found], n[:len(new)][found]
        at[long], count[long] = where[len(new):], n[len(new):]
        before = np.cumsum(count) - count
        out_ids = words.ids[np.repeat(at - before, count) + np.arange(int(count.sum()))].tobytes()
        cuts = np.append(before[np.searchsorted(starts, opens)], count.sum()) * self.dtype.itemsize
        if words.full():
            words.forget()
        return [out_ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def pieces(text: str) -> Iterator[str]:
    """A long text cut at spaces between two words; the spaces are left out."""
    at = 0
    while len(text) - at > 2 * CHARS:
        cut = text.find(" ", at + CHARS)
        while cut != -1 and cut + 1 < len(text) and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 >= len(text):
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def schema_of(dtype: np.dtype, length: int) -> pa.Schema:
    """ids, whether a place holds an id (else it is padding), and whether a document ends there."""
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("ends", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Packs documents into sequences of one length, a record batch of ROWS sequences at a time."""

    def __init__(self, sink, index_sink, dtype: np.dtype, length: int):
        self.dtype, self.length = dtype, length
        self.writer = pa.ipc.new_file(sink, schema_of(dtype, length))
        self.index = pa.ipc.new_file(index_sink, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.parts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.held = self.total = self.docs = 0

    def add(self, doc_ids: pa.Array, encoded: list[bytes], end_id: int) -> None:
        tail = np.array([end_id], dtype=self.dtype).tobytes()
        ids = np.frombuffer(b"".join(x for e in encoded for x in (e, tail)), dtype=self.dtype)
        sizes = np.array([len(e) // self.dtype.itemsize + 1 for e in encoded], dtype=np.int64)
        ends = np.zeros(len(ids), dtype=bool)
        last = np.cumsum(sizes)
        ends[last - 1] = True
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(self.total + last - sizes), pa.array(sizes)],
                                                          schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])))
        self.parts.append(ids)
        self.ends.append(ends)
        self.held += len(ids)
        self.total += len(ids)
        self.docs += len(encoded)
        if self.held >= ROWS * self.length:
            self._flush(self.held - self.held % (ROWS * self.length))

    def _flush(self, n: int) -> None:
        ids, ends = np.concatenate(self.parts or [np.zeros(0, self.dtype)]), np.concatenate(self.ends or [np.zeros(0, bool)])
        for a in range(0, n, ROWS * self.length):
            b = min(n, a + ROWS * self.length)
            pad = -(b - a) % self.length
            block = [np.pad(ids[a:b], (0, pad)), np.pad(np.ones(b - a, bool), (0, pad)), np.pad(ends[a:b], (0, pad))]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in block]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema_of(self.dtype, self.length)))
        self.parts, self.ends, self.held = [ids[n:]], [ends[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        self.writer.close()
        self.index.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Write ids in ascending doc_id order; (shard, folder, file, index_file, n_docs, n_ids, base) per file.

    Rows are range-partitioned by (doc_id, hash of the text), so a repeated doc_id is
    split too; a task encodes its rows as they stream by and writes one sequence file
    and one index file under names of its own attempt.  Only files named in the
    result count, so a repeated or lost task leaves no trace in it.  ``base`` is the
    number of ids in all files before.

    Null text is the empty text (just the end id).  Rows with a null doc_id come
    first; ties of doc_id are ordered by their text, repeated rows follow each other.  An
    empty input gives no files.  Long texts are encoded in pieces that end between two words.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode = encoder(tokenizer_path)
                fs, path = filesystem(folder)
                fs.create_dir(path, recursive=True)
                shard = TaskContext.get().partitionId()
                names = [f"{kind}-{shard:06d}-{uuid.uuid4().hex}.arrow" for kind in ("ids", "docs")]
                sinks = [fs.open_output_stream(f"{path}/{n}") for n in names]
                writer = ShardWriter(*sinks, encode.dtype, length)
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            writer.add(batch.column(0), list(encode.encode(texts)), end_id)
        if writer is not None:
            writer.close()
            for s in sinks:
                s.close()
            encode = texts = batch = None
            forget_encoders()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [names[0]], "index_file": [names[1]],
                                              "n_docs": [writer.docs], "n_ids": [writer.total]},
                                             schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("index_file", pa.string()),
                                                               ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
    files = materialise(rows.select("doc_id", "text").mapInArrow(run, "shard long, file string, index_file string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.select("shard", F.lit(folder).alias("folder"), "file", "index_file", "n_docs", "n_ids",
                        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def open_sequences(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A reader of one file; a local file is mapped, not read."""
    fs, path = filesystem(uri)
    local = fs.type_name == "local"
    return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """ids (a view on the file), mask and ends of sequence k."""
    row = reader.get_batch(k // ROWS).slice(k % ROWS, 1)
    return row.column("ids").flatten().to_numpy(), row.column("mask").flatten(), row.column("ends").flatten()


def documents_of(folder: str, file: str, index_file: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, start in the file, n_tokens, crc32 of the ids as 32-bit little-endian numbers), read from the files.

    Borders come from the ``ends`` of the sequences, ids of documents from the index.
    """
    index = open_sequences(f"{folder}/{index_file}")
    owners = (x for i in range(index.num_record_batches) for x in index.get_batch(i).column(0).to_pylist())
    reader = open_sequences(f"{folder}/{file}")
    crc = size = start = 0
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
        ids = batch.column("ids").flatten().to_numpy().astype("<u4")[mask]
        ends = np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False)[mask]) + 1
        view, a = memoryview(ids).cast("B"), 0
        for b in ends.tolist():
            crc = zlib.crc32(view[4 * a:4 * b], crc)
            size += b - a
            yield next(owners), start, size, crc
            start, crc, size, a = start + size, 0, 0, b
        crc = zlib.crc32(view[4 * a:], crc)
        size += len(ids) - a


def read_token_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document in the files of ``write_token_files``.

    A task reads its files batch by batch; ``start`` counts the ids of all documents before.
    There are as many tasks as files, up to ``READERS``.  No files give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = list(documents_of(r["folder"], r["file"], r["index_file"]))
                ids, start, size, crc = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.array(start, np.int64) + r["base"]), pa.array(size, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array([r["shard"]] * len(rows), pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
        rows = ids = start = size = crc = None
        give_back()
    columns = files.select("shard", "folder", "file", "index_file", "base")
    readers = min(READERS, max(1, 1 + (files.agg(F.max("shard")).first()[0] or 0)))
    return columns.repartitionById(readers, F.pmod("shard", F.lit(readers)).cast("int")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")

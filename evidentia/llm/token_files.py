"""Token-ID / binary output: Simple-8b word-aligned coding of token ids in sharded binary files.

File format (all integers little-endian). A file is a sequence of records, each followed by one newline byte:

    magic "S8B1" | u32 body length | body
    body: u32 n_docs | u32 n_ids | u32 n_words | u32 n_escapes
          i64 doc_id[n_docs] | u8 has_id[n_docs] | u32 n_tokens[n_docs]
          u32 block_word_offset[ceil(n_ids / 128)] | u64 word[n_words] | u64 escape[n_escapes]

Ids are cut into blocks of 128. A block's words start at its offset, so that blocks are decoded independently and all
at once. A word's upper 4 bits select how many ids of how many bits the lower 60 hold; selector 0 is the escape: the
lower 60 bits index the escape list, which holds ids of more than 60 bits. The last word of a block may be partly used.

Files are written with Spark's own committed text writer as raw bytes, so a lost executor's partial output never shows
and any file system that Spark writes to will do; they are read with its binary reader. Files hold a bounded number of
records of bounded size (a longer document makes one record by itself).

Edge cases: a null text is an empty one (only the end id); a null document id sorts first and comes back null; repeated
ids are kept as separate documents, in any order among themselves; an empty table gives no documents; extra columns are
ignored. The string of an added token in a text is that token's id, as the library has it.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, new_path, slices, table, texts

# Fixed values of the Simple-8b layout: ids per word and bits per id of each selector (0: escape, 15: a run of zeros).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120], dtype=np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], dtype=np.int64)
BLOCK = 128
MAGIC = b"S8B1"
#: Selectors from the most ids a word to the fewest.
_PACKING = [15, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block offsets, words and escapes of the ids (uint64). The selector that a word would have is found for every place at
    once; then all blocks go from word to word together."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    big = ids >= np.uint64(1 << 60)
    # a float holds the exponent of an id below 2**53 exactly; larger ones get the 60-bit selector anyway
    width = np.frexp(np.minimum(ids, np.uint64(1 << 52)).astype(np.float64))[1].astype(np.int8)
    width[ids >= np.uint64(1 << 52)] = 60
    width[big] = 99
    where = np.arange(n, dtype=np.int32)
    stop = np.minimum((where // BLOCK + 1) * BLOCK, n).astype(np.int32)
    choice = np.full(n, 14, np.int8)
    narrow = np.cumsum(np.bincount(width, minlength=100)) / n  # share of ids of so many bits at most
    for s in _PACKING[::-1]:
        # a selector that would hardly ever be filled is not tried: any choice that fits decodes to the same ids
        if COUNTS[s] > 1 and narrow[BITS[s]] ** int(COUNTS[s]) > 1e-3:
            full = np.minimum(where + np.int32(COUNTS[s]), stop)
            if narrow[BITS[s]] < 1:
                next_bad = np.minimum.accumulate(np.where(width > BITS[s], where, np.int32(n))[::-1])[::-1]
                choice[next_bad >= full] = s
            else:
                choice[:] = s
    choice[big] = 0
    after = np.minimum(where + COUNTS[choice], stop)
    starts = np.arange(0, n, BLOCK)
    begins = np.zeros(n, bool)
    cursor, end = starts, stop[starts]
    while len(cursor):
        begins[cursor] = True
        cursor = after[cursor]
        cursor, end = cursor[cursor < end], end[cursor < end]
    at = np.nonzero(begins)[0]
    chosen = choice[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.nonzero(chosen == s)[0]
        if s == 0:
            words[rows] |= (np.cumsum(big) - 1)[at[rows]].astype(np.uint64)
        elif BITS[s]:
            place = at[rows][:, None] + np.arange(COUNTS[s])
            value = np.where(place < stop[at[rows]][:, None], ids[np.minimum(place, n - 1)], np.uint64(0))
            words[rows] |= np.bitwise_or.reduce(value << (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64), axis=1)
    return np.searchsorted(at, starts).astype(np.uint32), words, ids[big]


def unpack(n: int, offsets: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The n ids again. Each word's place follows from its block's offset, so words of a selector are decoded at once."""
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[sel]
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    before = np.cumsum(held) - held
    first = before[offsets.astype(np.int64)]
    place = block * BLOCK + before - first[block]
    end = np.minimum((block + 1) * BLOCK, n)
    low = words & np.uint64((1 << 60) - 1)
    for s in np.unique(sel):
        rows = np.nonzero(sel == s)[0]
        if s == 0:
            out[place[rows]] = escapes[low[rows].astype(np.int64)]
        elif BITS[s]:
            whole = place[rows] + COUNTS[s] <= end[rows]
            for k in range(int(COUNTS[s])):  # a block's last word may be partly used
                here = rows if k == 0 else rows[whole | (place[rows] + k < end[rows])]
                out[place[here] + k] = (low[here] >> np.uint64(k * int(BITS[s]))) & np.uint64((1 << int(BITS[s])) - 1)
    return out


def record(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    offsets, words, escapes = pack(ids)
    body = b"".join((
        struct.pack("<4I", len(doc_ids), len(ids), len(words), len(escapes)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], "u1").tobytes(),
        counts.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
    ))
    return MAGIC + struct.pack("<I", len(body)) + body


def records(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of each record of a file: document ids, tokens of each, and the ids themselves."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no record at byte {at}")
        (length,) = struct.unpack_from("<I", content, at + 4)
        at += 8
        n_docs, n_ids, n_words, n_escapes = struct.unpack_from("<4I", content, at)
        p = at + 16
        doc = np.frombuffer(content, "<i8", n_docs, p)
        p += 8 * n_docs
        known = np.frombuffer(content, "u1", n_docs, p)
        p += n_docs
        counts = np.frombuffer(content, "<u4", n_docs, p)
        p += 4 * n_docs
        n_blocks = -(-n_ids // BLOCK)
        offsets = np.frombuffer(content, "<u4", n_blocks, p)
        p += 4 * n_blocks
        words = np.frombuffer(content, "<u8", n_words, p)
        escapes = np.frombuffer(content, "<u8", n_escapes, p + 8 * n_words)
        yield [int(x) if k else None for x, k in zip(doc, known)], counts, unpack(n_ids, offsets, words, escapes)
        at += length + 1


def _byte_alphabet() -> dict[int, str]:
    """How a byte-level tokenizer writes each byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()
#: Characters below U+0250, whose classes no Unicode version moves, by class of the byte-level cutting rule.
_LATIN = [chr(c) for c in range(33, 0x250) if chr(c) not in "'\x7f" and not chr(c).isspace()]
_LETTERS = "".join(c for c in _LATIN if c.isalpha())
_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_OTHERS = "".join(c for c in _LATIN if c not in _LETTERS and c not in _NUMBERS)
#: A chunk of such characters, where single newlines may stand between others, and a pre-token of one. No apostrophes.
_PLAIN = f"[{re.escape(''.join(_LATIN))}]+(?:\\n[{re.escape(''.join(_LATIN))}]+)*"
_PIECE = f" ?[{_LETTERS}]+| ?[{re.escape(_NUMBERS)}]+| ?[{re.escape(_OTHERS)}]+|\\n"


class _Memo:
    """Keeps what make() gave for a key, in two generations of `limit` keys: a key that is asked for again moves to the newer
    one, the others go with the older one. Nothing that is forgotten is lost, it is made anew."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.new, self.old = make, limit, {}, {}

    def many(self, keys: list[str]) -> list:
        """The values of distinct keys."""
        new, old, make = self.new, self.old, self.make
        found = list(map(new.get, keys))
        for i in [i for i, v in enumerate(found) if v is None]:
            key = keys[i]
            value = old.get(key)
            found[i] = new[key] = make(key) if value is None else value
            if len(new) >= self.limit:
                self.old, self.new = old, new = new, {}
        return found


def _byte_level(path: str) -> tuple[bool, list[str]]:
    """Whether a tokenizer file has the byte-level cutting rule alone, so that texts may be cut at lone spaces, and the
    strings that it takes out of a text before."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    rule = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    merges = model.get("type") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    whole = spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding")
    return bool(rule and merges and whole), [x["content"] for x in spec.get("added_tokens", [])]


def _ragged(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the items of each list named by which, one list after another."""
    n = sizes[which]
    ends = np.cumsum(n)
    out = np.repeat((starts[which] - (ends - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


class TextEncoder:
    """Ids of whole texts as the library gives them without added special tokens.

    With a byte-level tokenizer of the rule that _byte_level() checks, a token never spans a lone space that follows and
    precedes other than white space, and what is left of it has no say in what is right of it; so a text's ids are those
    of its chunks, one after another. A batch's distinct chunks are found first; plain ones are cut into their pre-tokens,
    and the distinct ones of these go straight to the library's merge model, once while they are held; any other chunk is
    encoded whole. Where the tokenizer is not of that kind, or a text holds the string of an added token, the library
    encodes the whole text at once.
    """

    WORDS = 350_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts, added = _byte_level(path)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.tokenizer.model
        self.words = _Memo(self._word, self.WORDS)

    def __call__(self, text: str) -> bytes:
        return self.encode_many([text])[0].tobytes()

    def encode_many(self, batch: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another and each followed by end_id if there is one, and each text's number of them."""
        alone: dict[int, bytes] = {i: self._whole(x) for i, x in enumerate(batch) if x and (not self.cuts or (self.added and self.added.search(x)))}
        rows = [i for i, x in enumerate(batch) if x and i not in alone]
        cut = pc.split_pattern(pa.array([batch[i] for i in rows], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        chunks, code, ends = coded.dictionary, coded.indices.to_numpy(), cut.offsets.to_numpy()
        plain = pc.match_substring_regex(chunks, f"^(?:{_PLAIN})$").to_numpy(zero_copy_only=False).astype(bool)
        # lists of pieces by chunk: of a plain chunk its pre-tokens behind a space, of any other one piece, the whole
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), chunks.filter(pa.array(plain)), pa.scalar("", pa.large_string()))
        marked = pc.replace_substring_regex(spaced, _PIECE, "\\0\x01")
        parts = pc.split_pattern(pc.utf8_slice_codeunits(marked, 0, -1), "\x01")
        pieces = parts.values.dictionary_encode()
        ids = self.words.many(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        bad = np.zeros(len(chunks), bool)
        first, size = np.zeros(len(chunks), np.int64), np.ones(len(chunks), np.int64)
        spread = parts.offsets.to_numpy()
        first[plain], size[plain] = spread[:-1], np.diff(spread)
        extra: list[int] = []

        def piece(value: bytes) -> int:
            """Where a list of one more piece begins."""
            ids.append(value)
            extra.append(len(ids) - 1)
            return len(parts.values) + len(extra) - 1

        for k in np.nonzero(~plain)[0].tolist():
            x = chunks[k].as_py()
            bad[k] = not x or x[0].isspace() or x[-1].isspace()
            first[k] = piece(b"" if bad[k] else self._whole(" " + x))
        # the first chunk has no space before it; texts with lists of their own are lists of one piece, the end is one
        lists, sizes = [first], [size]
        head = np.zeros(len(rows), np.int64)
        careful = np.zeros(len(rows), bool)
        tail = np.add.reduceat(np.append(bad[code], False), ends[:-1]) - bad[code[ends[:-1]]] if len(rows) else np.zeros(0)
        for j, i in enumerate(rows):
            x = batch[i][: batch[i].find(" ")] if ends[j + 1] - ends[j] > 1 else batch[i]
            careful[j] = tail[j] > 0 or not x or x[-1].isspace()
            head[j] = piece(self._careful(batch[i]) if careful[j] else self._ids(x, ""))
        own = {i: piece(x) for i, x in alone.items()}
        end = piece(b"" if end_id is None else np.array([end_id], "<u4").tobytes())
        # every text as places in lists: its first, its other chunks, its end
        n_chunks = np.zeros(len(batch), np.int64)
        n_chunks[rows] = np.where(careful, 1, np.diff(ends))
        n_chunks[list(own)] = 1
        stop = np.cumsum(n_chunks + 1)
        start = stop - n_chunks - 1
        of_list = np.full(int(stop[-1]) if len(stop) else 0, len(chunks), np.int64)
        at = np.array(rows, np.int64)
        inner = _ragged(start[at] + 1, np.maximum(n_chunks[at] - 1, 0), np.arange(len(at)))
        of_list[inner] = code[_ragged(ends[:-1] + 1, np.maximum(n_chunks[at] - 1, 0), np.arange(len(at)))]
        single = np.concatenate([[end], head, np.array(list(own.values()), np.int64)])
        of_list[start[at]] = len(chunks) + 1 + np.arange(len(at))
        of_list[start[np.array(list(own), np.int64)]] = len(chunks) + 1 + len(at) + np.arange(len(own))
        lists, sizes = np.concatenate([*lists, single]), np.concatenate([*sizes, np.ones(len(single), np.int64)])
        of_piece = np.concatenate([pieces.indices.to_numpy(), np.array(extra, np.int64)]).astype(np.int64)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        met = of_piece[_ragged(lists, sizes, of_list)]
        so_far = np.concatenate([[0], np.cumsum(lengths[of_piece])])
        per_list = so_far[lists + sizes] - so_far[lists]
        counts = np.add.reduceat(per_list[of_list], start) if len(start) else np.zeros(0, np.int64)
        return flat[_ragged(np.cumsum(lengths) - lengths, lengths, met)], counts

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_ALPHABET)
        elif piece[0] <= " ":
            piece = _ALPHABET[ord(piece[0])] + piece[1:]
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def _ids(self, chunk: str, lead: str) -> bytes:
        """Ids of a chunk behind `lead`, a space or nothing."""
        if re.fullmatch(_PLAIN, chunk):
            return b"".join(self.words.many(re.findall(_PIECE, lead + chunk)))
        return self._whole(lead + chunk)

    def _careful(self, text: str) -> bytes:
        """Cut only at lone spaces between other than white space; the first and last piece may have white space outside."""
        pieces = re.split(r"(?<=\S) (?=\S)", text)
        if len(pieces) == 1:
            return self._whole(text)
        return self._whole(pieces[0]) + b"".join(self._ids(x, " ") for x in pieces[1:-1]) + self._whole(" " + pieces[-1])


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process and tokenizer file: later tasks find its memo filled."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", record_bytes: int = 1 << 20, records_per_file: int = 16) -> str:
    """Encode docs, append end_id to each, and write files whose names ascend with id_col. Returns path."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for wide in slices(batches, "text", max(record_bytes, 5 << 20)):
            ids, counts = enc.encode_many(texts(wide, "text"), end_id)
            row = at = 0
            for batch in slices(iter([wide]), "text", record_bytes):
                own = counts[row : row + batch.num_rows]
                stop = at + int(own.sum())
                yield pa.RecordBatch.from_arrays([pa.array([record(batch.column(0).to_pylist(), own, ids[at:stop])], pa.binary())], ["value"])
                row, at = row + batch.num_rows, stop

    spread = narrow.repartitionByRange("id").sortWithinPartitions("id")
    raw = spread.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids array is not kept;
    ids_crc32 covers all its ids as little-endian unsigned 32-bit integers."""
    # the last -c<number> is the writer's count of files; the job's UUID before it may hold the like
    names = r"part-(\d+)-[^/]*-c(\d+)[^/]*$"
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", names, 0).alias("path"), "content")
    order = [F.regexp_extract("path", names, k).cast("long").alias(n) for k, n in ((1, "part"), (2, "piece"))]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, start = batch.column(0)[k].as_py(), 0
                for docs, counts, ids in records(batch.column(1)[k].as_buffer().to_pybytes()):
                    raw, n = memoryview(ids.astype("<u4").tobytes()), counts.astype(np.int64)
                    ends = np.cumsum(n)
                    crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs)), pa.array(docs, pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["path", "doc_id", "local_start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1]) if len(ends) else 0

    # narrow rows, kept: the files are read once, and their totals come of what was read
    rows = materialise(files.mapInArrow(decode, "path string, doc_id long, local_start long, n_tokens long, ids_crc32 long"), "read")
    per_file = rows.groupBy("path").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total")).select("path", "total", *order)
    per_part = per_file.groupBy("part").agg(F.sum("total").alias("total"))  # one row a task of the writer
    earlier = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_part = per_part.select("part", earlier.alias("part_start"))
    inside = F.coalesce(F.sum("total").over(W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_file = per_file.withColumn("inside", inside).join(per_part, "part").select("path", (F.col("part_start") + F.col("inside")).alias("file_start"))
    return rows.join(per_file, "path").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)

"""SentencePiece encoding and decoding with seeded merge-dropout.

Merge-type (BPE) segmentation with a SentencePiece model's pieces and scores: a chunk's characters are symbols; an agenda
holds every pair of neighbours whose join is a piece, best score first, leftmost of equals first; taking a pair joins it and
adds the pairs that the join makes. With dropout, each candidate that comes up is skipped if a keyed hash of seed, document,
place of the chunk, place in the chunk and piece falls below the rate: no state, so that a retried task gives the same ids.
What is memoised has no hash in it: a tree for each chunk, whose nodes are its segmentations after given skips with the
candidates that come up there. Every occurrence hashes its own candidates and goes down the tree by the first one skipped.
Without dropout (rate 0) the segmentation is the model's own.

Chunks are runs of spaces with the word behind them: no piece spans a space inside. Characters without a piece become byte
pieces. A literal U+2581 in a text is written as its three byte pieces, which keeps decoding lossless for every text.

Edge cases: null and empty texts give no ids and decode to the empty text; a null id counts as the key 0; very long texts
are encoded chunk by chunk, never cut; rows that repeat come out alike; an empty table gives no rows; input columns named as
outputs are replaced.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, texts

SPACE = "▁"
#: Segmentations that a worker holds; what is forgotten is made anew, with the same ids.
HOLD = 500_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(key: int, piece: int, place: int) -> int:
    """32 bits by which a candidate merge is skipped or not."""
    h = ((key ^ (piece * 0x85EBCA77) ^ (place * 0xC2B2AE3D)) * 0x9E3779B1) & 0xFFFFFFFF
    h ^= h >> 15
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    return h ^ (h >> 13)


def salted(piece: int, place: int) -> int:
    """What of a candidate enters keyed(), as 32 bits."""
    return ((piece * 0x85EBCA77) ^ (place * 0xC2B2AE3D)) & 0xFFFFFFFF


def keyed_salted(x: np.ndarray) -> np.ndarray:
    """keyed() over uint32, of key ^ salted()."""
    h = x * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def keyed_many(key: np.ndarray, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
    """keyed(), elementwise over uint64."""
    low = np.uint64(0xFFFFFFFF)
    h = ((key ^ (piece * np.uint64(0x85EBCA77)) ^ (place * np.uint64(0xC2B2AE3D))) * np.uint64(0x9E3779B1)) & low
    h ^= h >> np.uint64(15)
    h = (h * np.uint64(0x85EBCA6B)) & low
    return h ^ (h >> np.uint64(13))


class _PairTable:
    """Pieces by pairs of pieces: slots by hash, in levels. What finds its slot taken goes to the next level, so an empty slot
    ends a search, and nearly all searches end at the first level."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(10, int(len(keys)).bit_length() + 2)
            slot = self._slot(keys, bits, len(self.levels))
            _, first = np.unique(slot, return_index=True)
            held, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            held[slot[first]], value[slot[first]] = keys[first], values[first]
            self.levels.append((bits, held, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for level, (bits, held, value) in enumerate(self.levels):
            slot = self._slot(keys, bits, level)
            there = held[slot]
            hit = there == keys
            out[open_[hit]] = value[slot[hit]]
            more = ~hit & (there >= 0)
            open_, keys = open_[more], keys[more]
        return out


class Pieces:
    """A model's pieces: ids and merge priorities by text, byte pieces, and the bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.rank[piece] = i, -model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        # for segment_many(): ids of single characters, and every pair of pieces whose join is a piece
        top = max((ord(c) for c in self.ids if len(c) == 1), default=0)
        self.of_char = np.full(top + 2, -1, np.int32)
        for c in self.ids:
            if len(c) == 1:
                self.of_char[ord(c)] = self.ids[c]
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pairs = _PairTable(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        order = np.full(len(self.raw), np.inf, np.float32)
        for piece, i in self.ids.items():
            order[i] = self.rank[piece]
        self.order = order
        self.raw_array = pa.array(self.raw, pa.large_binary())

    def fallback(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode("utf-8", "surrogatepass")]

    def _candidates(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Joined piece and priority of pairs of neighbours; infinite where there is none or the hash skips it."""
        both = np.nonzero((left >= 0) & (right >= 0))[0]
        found = self.pairs.find(left[both].astype(np.int64) << 32 | right[both])
        both, found = both[found >= 0], found[found >= 0]
        if limit:
            go = keyed_many(key[both], found.astype(np.uint64), place[both].astype(np.uint64)) >= limit
            both, found = both[go], found[go]
        joined, cost = np.zeros(len(left), np.int32), np.full(len(left), np.inf, np.float32)
        joined[both], cost[both] = found, self.order[found]
        return joined, cost

    def segment_many(self, chunks: list[str], rate: float, keys: np.ndarray, taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[bytes]:
        """segment() of many chunks at once (ids as bytes): all agendas advance together, a merge of each chunk a step, over
        symbols that are linked to their neighbours. A candidate's hash does not depend on when it comes up, so it is
        skipped when it would enter the agenda. taken gets the candidates taken: numbers of chunks and salts, those of a
        chunk in order."""
        out: list[bytes] = [b""] * len(chunks)
        lengths = np.array([len(c) for c in chunks])
        limit = int(rate * 2**32)
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.searchsorted(lengths[order], [5, 7, 9, 11, 13, 16, 20, 28, 41])):
            if not len(rows):
                continue
            width = int(lengths[rows].max())
            if width > 40:
                for r in rows.tolist():
                    own: list[int] = []
                    out[r] = np.array(self.segment(chunks[r], rate, int(keys[r]), taken=own), "<u4").tobytes()
                    if taken is not None:
                        taken.append((np.full(len(own), r), np.array(own, np.uint32)))
                continue
            # flat arrays of width + 1 places a chunk; the last is no symbol. Symbols: a piece; -1 for none, below: a character
            wide = width + 1
            code = np.array([chunks[r] for r in rows.tolist()], f"<U{width}").view("<u4").reshape(len(rows), width)
            sym = np.full((len(rows), wide), -1, np.int32)
            sym[:, :width] = self.of_char[np.minimum(code, len(self.of_char) - 1)]
            alive = np.arange(wide) < lengths[rows][:, None]
            odd = alive & (sym < 0)
            sym[~alive] = -1
            sym[odd] = -2 - code[odd[:, :width]].astype(np.int32)
            sym, alive = sym.ravel(), alive.ravel()
            at = np.arange(len(sym))
            column = np.tile(np.arange(wide), len(rows))
            after, before = at + (column < width), at - 1
            key = keys[rows]
            joined, cost = self._candidates(sym, sym[after], np.repeat(key, wide), column, limit)
            live = np.arange(len(rows))
            table_ = cost.reshape(len(rows), wide)
            while len(live):
                best = table_[live].argmin(1)
                spot = live * wide + best
                going = np.isfinite(cost[spot])
                live, best, spot = live[going], best[going], spot[going]
                if not len(live):
                    break
                new, gone = joined[spot], after[spot]
                if taken is not None:
                    taken.append((rows[live], (new.astype(np.uint32) * np.uint32(0x85EBCA77)) ^ (best.astype(np.uint32) * np.uint32(0xC2B2AE3D))))
                behind = after[gone]
                sym[spot], after[spot], before[behind] = new, behind, spot
                alive[gone], cost[gone] = False, np.inf
                joined[spot], cost[spot] = self._candidates(new, sym[behind], key[live], best, limit)
                has = best > 0
                ahead = before[spot[has]]
                joined[ahead], cost[ahead] = self._candidates(sym[ahead], new[has], key[live[has]], column[ahead], limit)
            size = alive.reshape(len(rows), wide).sum(1)
            ends = np.cumsum(size)
            raw = sym[alive].astype("<i4").tobytes()
            for r, a, b in zip(rows.tolist(), (4 * (ends - size)).tolist(), (4 * ends).tolist()):
                out[r] = raw[a:b]
            for k in np.nonzero(odd.any(1))[0].tolist():
                ids = []
                for x in np.frombuffer(out[rows[k]], "<i4").tolist():
                    ids.extend([x] if x >= 0 else self.fallback(chr(-2 - x)))
                out[rows[k]] = np.array(ids, "<u4").tobytes()
        return out

    def segment(self, chunk: str, rate: float = 0.0, key: int = 0, skips: tuple[int, ...] = (), taken: list[int] | None = None) -> list[int]:
        """Ids of a chunk; key: what the dropout's hashes are keyed with; skips: salts of candidates skipped besides, in the
        order in which they come up; taken gets the salts of those taken after the last of skips has come up."""
        last = skips[-1] if skips else None
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        rank, ids = self.rank, self.ids
        agenda = []
        for i in range(n - 1):
            joined = chunk[i : i + 2]
            if joined in rank:
                agenda.append((rank[joined], i, joined))
        heapq.heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        limit = int(rate * 2**32)
        while agenda:
            cost, i, joined = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or len(left) >= len(joined):
                continue
            j = after[i]
            if j >= n or left + symbols[j] != joined:
                continue
            if limit:
                if keyed(key, ids[joined], i) < limit:
                    continue
            if taken is not None:
                salt = salted(ids[joined], i)
                if salt in skips:
                    if salt == last:
                        last = None
                        taken.clear()
                    continue
                taken.append(salt)
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = joined + symbols[k]
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], i, wider))
            p = before[i]
            if p >= 0:
                wider = symbols[p] + joined
                if wider in rank:
                    heapq.heappush(agenda, (rank[wider], p, wider))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if s in ids:
                    out.append(ids[s])
                else:
                    out.extend(self.fallback(s))
        return out


class _Trees:
    """Segmentations by chunk and candidates skipped. A node's candidates lie side by side in salt and child; child: the node
    where that candidate is the next one skipped, or -1."""

    def __init__(self, pieces: Pieces, limit: int):
        self.pieces, self.limit = pieces, limit
        self.clear()

    def clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.of: list[str | tuple[str, tuple[int, ...]]] = []  # a root's chunk; of other nodes, the candidates skipped too
        self.start, self.count, self.salt, self.child = array("i"), array("i"), array("I"), array("i")

    def learn(self, chunks: set[str]) -> None:
        """Roots of chunks that are not held yet, all at once."""
        new = list(chunks)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        found = self.pieces.segment_many(new, 0.0, np.zeros(len(new), np.uint64), taken)
        row = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in taken)])
        order = np.argsort(row, kind="stable")
        salts = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in taken)])[order]
        ends = np.searchsorted(row[order], np.arange(len(new) + 1)).astype(np.int64)
        self.roots.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.ids.extend(found)
        self.of.extend(new)
        self.start.frombytes((ends[:-1] + len(self.salt)).astype(np.int32).tobytes())
        self.count.frombytes(np.diff(ends).astype(np.int32).tobytes())
        self.salt.frombytes(salts.tobytes())
        self.child.frombytes(np.full(len(salts), -1, np.int32).tobytes())

    def grow(self, node: int, candidate: int) -> int:
        chunk, skips = (self.of[node], ()) if isinstance(self.of[node], str) else self.of[node]
        skips = (*skips, self.salt[candidate])
        taken: list[int] = []
        ids = np.array(self.pieces.segment(chunk, skips=skips, taken=taken), "<u4").tobytes()
        self.child[candidate] = made = len(self.ids)
        self.ids.append(ids)
        self.of.append((chunk, skips))
        self.start.append(len(self.salt))
        self.count.append(len(taken))
        self.salt.extend(taken)
        self.child.extend([-1] * len(taken))
        return made

    def arrays(self) -> list[np.ndarray]:
        return [np.array(a) for a in (self.start, self.count, self.salt, self.child)]


class PieceCoder:
    def __init__(self, path: str, rate: float = 0.1, seed: int = 4, hold: int = HOLD):
        self.pieces, self.rate, self.seed = Pieces(path), rate, seed
        self.trees = _Trees(self.pieces, hold)

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def encode_many(self, batch: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text. A chunk's key comes of the seed, its document and its place there."""
        plain = [i for i, x in enumerate(batch) if x and SPACE not in x and "  " not in x and x[0] != " " and x[-1] != " "]
        cut = pc.split_pattern(pa.array([batch[i] for i in plain], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        chunks = [SPACE + x for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        code, ends = coded.indices.to_numpy(), cut.offsets.to_numpy()
        plain_at = dict(zip(plain, zip(ends.tolist(), ends[1:].tolist())))
        number = None
        codes: list[np.ndarray] = []
        starts: list[int] = []
        plans: list[list[tuple[int, int]]] = []
        at = 0
        for i, (text, key) in enumerate(zip(batch, keys)):
            parts = []
            if i in plain_at:
                a, b = plain_at[i]
                parts.append(code[a:b])
            elif text:
                number = number if number is not None else {c: k for k, c in enumerate(chunks)}
                for k, part in enumerate(text.split(SPACE)):
                    own = self._chunks((" " + part if not k else part).replace(" ", SPACE))
                    parts.append(np.array([number.setdefault(c, len(number)) for c in own], np.int64))
            plan = []
            for k, part in enumerate(parts):
                starts.append(((key & _M64) * 0x9E3779B97F4A7C15 + self.seed * 1_000_003 + k) & _M64)
                plan.append((at, at + len(part)))
                at += len(part)
            codes.extend(parts)
            plans.append(plan)
        if number is not None:
            chunks = list(number)
        sizes = np.array([len(x) for x in codes], np.int64)
        inside = np.arange(at) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own_keys = (mix(inside.astype(np.uint64) + np.repeat(mix(np.array(starts, np.uint64)), sizes)) >> np.uint64(32)).astype(np.uint32)
        found = self._coded(chunks, np.concatenate([np.zeros(0, np.int64), *codes]), own_keys)
        mark = np.array(self.pieces.fallback(SPACE), "<u4").tobytes()
        return [np.frombuffer(mark.join(b"".join(found[a:b]) for a, b in plan), "<u4") for plan in plans]

    def _coded(self, chunks: list[str], code: np.ndarray, keys: np.ndarray) -> list[bytes]:
        """Ids of every occurrence, given by its chunk's number, by its own key."""
        trees = self.trees
        if len(trees.ids) > trees.limit:
            trees.clear()
        trees.learn({c for c in chunks if c not in trees.roots and len(c) < 64})
        node = np.fromiter(map(trees.roots.get, chunks, repeat(-1)), np.int64, len(chunks))[code]
        alone = [np.nonzero(node < 0)[0]]
        live = np.nonzero(node >= 0)[0] if self.rate else np.zeros(0, np.int64)
        limit = int(self.rate * 2**32)
        while len(live):
            start, count, salt, child = trees.arrays()
            live = live[count[node[live]] > 0]
            n = count[node[live]]
            ends = np.cumsum(n)
            at = np.arange(n.sum()) + np.repeat(start[node[live]] - (ends - n), n)
            skipped = np.nonzero(keyed_salted(np.repeat(keys[live], n) ^ salt[at]) < limit)[0]
            owner = np.searchsorted(ends, skipped, side="right")
            first = np.ones(len(owner), bool)
            first[1:] = owner[1:] != owner[:-1]
            live, at = live[owner[first]], at[skipped[first]]
            down = child[at]
            new, where, back, times = np.unique(np.where(down < 0, at, -1), return_index=True, return_inverse=True, return_counts=True)
            # a node for what comes up twice; a single occurrence is segmented by itself, with the same ids
            made = np.array([trees.grow(int(node[live[w]]), c) if c >= 0 and k > 1 else -1 for c, w, k in zip(new.tolist(), where.tolist(), times.tolist())], np.int64)
            down = np.where(down < 0, made[back], down) if len(new) else down
            alone.append(live[down < 0])
            live, down = live[down >= 0], down[down >= 0]
            node[live] = down
        out = [trees.ids[k] if k >= 0 else b"" for k in node.tolist()]
        rest = np.concatenate(alone)
        found = self.pieces.segment_many([chunks[i] for i in code[rest].tolist()], self.rate, keys[rest].astype(np.uint64))
        for i, ids in zip(rest.tolist(), found):
            out[i] = ids
        return out

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if SPACE + SPACE in text or text.endswith(SPACE):
            return _CHUNK.findall(text)
        head, *rest = text.split(SPACE)  # single spaces: every chunk but the first begins with one
        return ([head] if head else []) + [SPACE + x for x in rest]

    def decode(self, ids) -> str:
        return self.decode_many([np.asarray(ids, np.int64)])[0].decode("utf-8", "surrogatepass")

    def decode_many(self, coded: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 bytes of each text: its pieces side by side, less the space put before the first."""
        flat = np.concatenate([np.zeros(0, np.int64), *coded])
        raw = self.pieces.raw_array.take(pa.array(flat))
        data = raw.buffers()[2]
        data = data.to_pybytes() if data is not None else b""
        at = np.frombuffer(raw.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)].tolist()
        return [data[a + 1 : b] for a, b in zip(at, at[1:])]


_CODERS: dict[tuple, PieceCoder] = {}


def coder(*args) -> PieceCoder:
    """One coder a worker process and set of parameters."""
    if args not in _CODERS:
        _CODERS[args] = PieceCoder(*args)
    return _CODERS[args]


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", hold: int = HOLD) -> DataFrame:
    """docs with ids (array<int>), n_pieces and lossless (its ids decode to the text itself)."""
    kept = docs.drop("ids", "n_pieces", "lossless")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model, rate, seed, hold)
        for batch in slices(batches, text_col, 2 << 20):
            keys = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            whole = texts(batch, text_col)
            found = c.encode_many(whole, [int(k or 0) for k in keys])
            same = [back == text.encode() for back, text in zip(c.decode_many(found), whole)]
            n = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate(found).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(n), pa.array(same)], names)

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """coded with text_decoded."""
    kept = coded.drop("text_decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("text_decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model, 0.0)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.decode(x or []) for x in ids], pa.string())], [f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, model_path()).select("doc_id", "n_pieces", "lossless", F.crc32(F.concat_ws(",", "ids").cast("binary")).alias("ids_crc32"), "ids")

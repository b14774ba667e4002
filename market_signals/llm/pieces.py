"""SentencePiece BPE encoding and decoding with the byte span of every piece."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, read, tidy

SPACE = "▁"
#: A chunk: marks of spaces, then other characters. Pieces never join two chunks (checked for the vocabulary).
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: The last character of a chunk and the first one of the next.
BORDER = re.compile(f"[^{SPACE}]{SPACE}")
#: Chunks whose pieces a worker remembers in each of two generations, and the longest such chunk.
REMEMBERED, SHORT = 70_000, 32
#: Characters of a text that are cut into chunks at once, and chunks that are resolved at once.
SEGMENT, LOAD = 500_000, 100_000
#: Chunks of more characters are merged one by one with a heap.
LONG = 128


#: The level of what isn't a piece.
NEVER = np.iinfo(np.int32).max


@dataclass
class CharMap:
    """The compiled character map of a model: a double-array trie of prefixes, and the texts that replace them."""

    units: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    texts: bytes = b""

    @classmethod
    def parse(cls, blob: bytes) -> CharMap:
        """Layout: trie size (uint32, little endian), trie units, then zero-ended replacement texts."""
        if not blob:
            return cls()
        (n,) = struct.unpack_from("<I", blob)
        return cls(np.frombuffer(blob[4 : 4 + n], "<u4"), blob[4 + n :])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        units, best = self.units, None
        if not len(units):
            return None
        node = 0
        unit = int(units[0])
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & ((1 << 31) | 0xFF) != c:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value = int(units[node]) & ((1 << 31) - 1)
                best = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return best


class Tokenizer:
    """Encodes and decodes like the library whose model file it reads, and keeps the origin of every piece."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with spaces before words are read")
        self.map = CharMap.parse(spec.precompiled_charsmap)
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else " "
        self.names = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces) or any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.score):
            raise ValueError("the vocabulary has pieces that this encoder doesn't split apart")
        self.unknown, self.begin, self.end = proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.unknown_text = proto.trainer_spec.unk_surface
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.low = min(self.byte_of, default=0)
        self.high = max(self.byte_of, default=-1)
        self.surface = ["" if k == kinds.CONTROL else n.replace(SPACE, " ") for n, k in zip(self.names, self.kind, strict=True)]
        if 0 <= self.unknown < len(self.surface):
            self.surface[self.unknown] = self.unknown_text
        self.norm_bytes = np.array([0 if i in self.control else 1 if i in self.byte_of else len(n.encode()) for i, n in enumerate(self.names)], np.int64)
        self.source_bytes = self.norm_bytes - np.array([0 if i in self.byte_of else n.count(SPACE) * (len(SPACE.encode()) - 1) for i, n in enumerate(self.names)], np.int64)
        self.controls = np.isin(np.arange(len(self.names)), list(self.control))
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.prepare()

    def normalize(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its bytes (and its end) the byte of `text` that it stems from.

        The alignment is None where it is plain: byte i stems from byte i, behind the added space.
        """
        if not len(self.map.units) and not self.trim:
            plain = text.replace(" ", self.space)
            return (self.space + plain if self.prefix and text else plain), None
        data, out, origin = text.encode("utf-8", "replace"), bytearray(), []
        at, space, last_space = 0, self.space.encode(), self.trim
        if self.trim:
            while at < len(data) and data[at] == 32:
                at += 1
        if self.prefix and at < len(data):
            out += space
            origin += [at] * len(space)
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = n, data[at : at + n]
            n, new = found
            for b in [new[i : i + 1] for i in range(len(new))]:
                if b == b" ":
                    if self.trim and last_space:
                        continue
                    out += space
                    origin += [at] * len(space)
                else:
                    out += b
                    origin.append(at)
                last_space = b == b" "
            at += n
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                del origin[len(out) :]
        origin.append(len(data))
        return out.decode("utf-8", "replace"), np.array(origin, np.int64)

    def prepare(self) -> None:
        """Symbols are the pieces' ids, then numbers for characters that only stand inside pieces; pairs of them that make a piece."""
        names = sorted(self.score, key=lambda x: (-self.score[x], self.ids[x]))
        levels = {x: i for i, x in enumerate(sorted({-v for v in self.score.values()}))}
        symbol = {x: self.ids[x] for x in names}
        for x in names:
            for c in x:
                symbol.setdefault(c, len(self.names) + len(symbol))
        self.none = len(self.names) + len(symbol)
        self.scored = np.zeros(self.none + 1, bool)
        self.scored[[self.ids[x] for x in names]] = True
        self.level = np.full(self.none + 2, NEVER, np.int32)
        self.level[[self.ids[x] for x in names]] = [levels[-self.score[x]] for x in names]
        self.of_char = np.full(0x110000, self.none, np.int32)
        for x, i in symbol.items():
            if len(x) == 1:
                self.of_char[ord(x)] = i
        pairs = {(symbol[x[:i]], symbol[x[i:]]): self.ids[x] for x in names for i in range(1, len(x)) if x[:i] in symbol and x[i:] in symbol}
        self.pairs = Pairs(np.array(list(pairs), np.int64).reshape(-1, 2), np.array(list(pairs.values()), np.int32))

    def merge_all(self, chunks: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of the pieces of every chunk.

        In each chunk the best-scored pair of neighbours merges first, the leftmost among equals; one merge of every
        chunk is done at once, until no chunk has a pair that makes a piece. Pieces don't join chunks, so this is the
        order of the whole text.
        """
        if not chunks:
            return []
        long = [i for i, x in enumerate(chunks) if len(x) > LONG]
        if long:
            out = [b""] * len(chunks)
            rest = [i for i, x in enumerate(chunks) if len(x) <= LONG]
            for i, x in zip(rest, self.merge_all([chunks[i] for i in rest]), strict=True):
                out[i] = x
            for i in long:
                out[i] = np.array([j for p in self.merge_long(list(chunks[i])) for j in self.of_part(p)], "<u4").tobytes()
            return out
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "replace"), "<u4")
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at, chunk, sym = np.arange(len(chars)), np.repeat(np.arange(len(chunks)), sizes), self.of_char[chars]
        joint = self.joint(sym, chunk)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            level = self.level[joint]
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            lengths = np.diff(np.append(first, len(chunk)))
            best = np.minimum.reduceat(level, first)
            best = np.repeat(best, lengths)
            over = best == NEVER
            if over.any():
                done.append((at[over], sym[over]))
                at, chunk, sym, joint, level, best = (x[~over] for x in (at, chunk, sym, joint, level, best))
                if not len(sym):
                    break
            place = np.flatnonzero(level == best)
            owner = chunk[place]
            place = place[np.concatenate([[True], owner[1:] != owner[:-1]])]
            sym[place] = joint[place]
            stay = np.ones(len(sym), bool)
            stay[place + 1] = False
            moved = place - np.arange(len(place))
            at, chunk, sym, joint = at[stay], chunk[stay], sym[stay], joint[stay]
            # the new piece's pairs with its neighbours
            for i in (moved, moved[moved > 0] - 1):
                i = i[i + 1 < len(sym)]
                joint[i] = np.where(chunk[i] == chunk[i + 1], self.pairs.find(sym[i], sym[i + 1]), -1)
            if len(sym):
                joint[-1] = -1
        where, what = (np.concatenate([d[i] for d in done]) for i in range(2))
        order = np.argsort(where, kind="stable")
        where, what = where[order], what[order]
        counts = np.ones(len(what), np.int64)
        odd = np.flatnonzero(~self.scored[what])
        spelled = [self.of_part(chr(c)) for c in chars[where[odd]].tolist()]
        counts[odd] = [len(x) for x in spelled]
        ids = np.repeat(what, counts).astype("<u4")
        ends = np.cumsum(counts)
        for i, x in zip(odd.tolist(), spelled, strict=True):
            ids[ends[i] - len(x) : ends[i]] = x
        data = ids.tobytes()
        last = np.cumsum(np.bincount(np.repeat(np.arange(len(chunks)), sizes)[where], weights=counts, minlength=len(chunks)).astype(np.int64)) * 4
        return [data[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]

    def joint(self, sym: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """For each symbol the piece that it makes with the next one of its chunk, or -1."""
        out = np.full(len(sym), -1, np.int32)
        out[:-1] = np.where(chunk[1:] == chunk[:-1], self.pairs.find(sym[:-1], sym[1:]), -1)
        return out

    def of_part(self, part: str) -> list[int]:
        """Ids of one part that no longer merges."""
        if part in self.score:
            return [self.ids[part]]
        return [self.bytes[b] for b in part.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs over a linked list, for long chunks."""
        n, score = len(parts), self.score
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(parts[i] + parts[j])) is not None:
                heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heappop(heap)
            if not parts[i] or not parts[j] or parts[i] + parts[j] != both or after[i] != j:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end (little-endian, 32 bits) of every text."""
        parts: list[list[bytes]] = [[struct.pack("<I", self.begin)] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            norm, _ = self.normalize(text)
            at = 0
            while at < len(norm):
                border = BORDER.search(norm, at + SEGMENT) if len(norm) > at + SEGMENT else None
                end = border.start() + 1 if border else len(norm)
                held.append((i, CHUNK.findall(norm[at:end] if at or border else norm)))
                n += len(held[-1][1])
                at = end
                if n >= LOAD:
                    self.resolve(held, parts)
                    held, n = [], 0
        self.resolve(held, parts)
        last = struct.pack("<I", self.end)
        return [b"".join([*x, last]) for x in parts]

    def resolve(self, held: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        """Append the pieces of chunks to their texts' parts. A generation of remembered chunks that is full becomes the old one."""
        if len(self.seen) >= REMEMBERED:
            self.old, self.seen = self.seen, {}
        seen, old = self.seen, self.old
        distinct: set[str] = set().union(*[chunks for _, chunks in held])
        new = [x for x in distinct if x not in seen]
        missing = [x for x in new if x not in old]
        for x in new:
            if x in old:
                seen[x] = old[x]
        seen.update(zip(missing, self.merge_all(missing), strict=True))
        for i, chunks in held:
            parts[i].append(b"".join(map(seen.__getitem__, chunks)))
        for x in missing:
            if len(x) > SHORT:
                del seen[x]

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; a run of byte pieces is read as UTF-8, each byte that isn't becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        surface = self.surface
        if not ((ids >= self.low) & (ids <= self.high)).any():
            text = "".join(map(surface.__getitem__, ids.tolist()))
        else:
            parts, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(utf8(bytes(run)))
                    run.clear()
                parts.append(surface[i])
            parts.append(utf8(bytes(run)))
            text = "".join(parts)
        plain = np.flatnonzero(~self.controls[ids])
        if not self.prefix or not len(plain):
            return text
        first = int(ids[plain[0]])
        return text[1:] if surface[first].startswith(" ") and first not in self.byte_of else text

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end bytes of `text` from which each id stems; begin, end and the added space are empty."""
        given = np.asarray(ids, np.int64)
        norm, origin = self.normalize(text)
        if origin is None and SPACE not in text:
            # identity map: a piece covers its bytes, a space mark one byte, the added mark none
            ends = np.cumsum(self.source_bytes[given])
            if self.prefix and text:
                ends[1:] -= 1
            return np.concatenate([[0], ends[:-1]]), ends
        if origin is None:
            origin = self.align(text)
        ends = origin[np.minimum(np.cumsum(self.norm_bytes[given]), len(origin) - 1)]
        return np.concatenate([origin[:1], ends[:-1]]), ends

    def align(self, text: str) -> np.ndarray:
        """Source byte of every byte of the normalised text under the identity map."""
        mark = len(self.space.encode())
        out = [0] * mark if self.prefix and text else []
        at = 0
        for c in text:
            n = len(c.encode("utf-8", "replace"))
            out += [at] * mark if c == " " else range(at, at + n)
            at += n
        return np.array([*out, at], np.int64)


class Pairs:
    """A table from pairs of symbols to the pieces that they make: each pair lies in one of two places (cuckoo hashing)."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        keys = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1].astype(np.uint64)
        bits = max(4, int(len(keys) * 1.5).bit_length())
        while not self.fill(keys, made, bits):
            bits += 1

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [((keys * np.uint64(f)) >> self.shift).astype(np.int64) for f in self.FACTORS]

    def fill(self, keys: np.ndarray, made: np.ndarray, bits: int) -> bool:
        self.shift = np.uint64(64 - bits)
        held = np.full((2, 1 << bits), -1, np.int64)
        places = self.places(keys)
        side, moving = 0, np.arange(len(keys))
        for _ in range(200):
            # whoever comes last stays; the one that was there, and the others, go to their other place
            spot = places[side][moving]
            gone = held[side][spot]
            held[side][spot] = moving
            lost = moving[held[side][spot] != moving]
            moving = np.unique(np.concatenate([gone[gone >= 0], lost]))
            if not len(moving):
                break
            side = 1 - side
        else:
            return False
        self.keys = [np.where(h >= 0, keys[h], np.uint64(2**64 - 1)) for h in held]
        self.made = [np.where(h >= 0, made[h], -1).astype(np.int32) for h in held]
        return True

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        a, b = self.places(keys)
        return np.where(self.keys[0][a] == keys, self.made[0][a], np.where(self.keys[1][b] == keys, self.made[1][b], np.int32(-1)))


def utf8(run: bytes) -> str:
    """UTF-8 text of byte pieces: every byte outside a valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Tokenizer:
    """The tokenizer of a model file that Spark has sent to every executor; one for each worker."""
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = Tokenizer(f.read())
    return _LOADED[name]


def encode_documents(docs: DataFrame, model: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int> (with begin and end), decoded string, and with `offsets` begins and ends array<int> (bytes).

    `model` is a path on the driver. A null text counts as empty (begin and end alone); rows that repeat, null ids and
    empty tables pass through; further columns are ignored. One long text is one row of one task: memory follows it.
    """
    docs.sparkSession.sparkContext.addFile(model)
    name = model.rsplit("/", 1)[-1]
    schema = "doc_id bigint, ids array<int>, decoded string" + (", begins array<int>, ends array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name)
        for block in blocks(batches, 1_000_000):
            texts = [x or "" for x in block.column(1).to_pylist()]
            ids = [np.frombuffer(x, "<u4") for x in tok.encode_all(texts)]
            cols = [block.column(0).cast(pa.int64()), lists(ids), pa.array([tok.decode(x) for x in ids], pa.string())]
            if offsets:
                spans = [tok.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                cols += [lists([a for a, _ in spans]), lists([b for _, b in spans])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded", "begins", "ends"][: len(cols)])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def lists(rows: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_sha256 over the end bytes of all pieces (int64), made in the encoding task.

    A null text counts as empty (begin and end alone); rows that repeat and null ids pass through, each with its row; an
    empty table gives none; further columns are ignored. A long text is cut into chunks segment by segment.
    """
    docs.sparkSession.sparkContext.addFile(model)
    name = model.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name)
        for block in blocks(batches, 1_000_000):
            n, a, b, c = [], [], [], []
            texts = [x or "" for x in block.column(1).to_pylist()]
            for text, data in zip(texts, tok.encode_all(texts), strict=True):
                ids = np.frombuffer(data, "<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(data).hexdigest())
                b.append(hashlib.sha256(tok.decode(ids).encode("utf-8", "replace")).hexdigest())
                c.append(hashlib.sha256(tok.spans(text, ids)[1].astype("<i8").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), default_model())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, end bytes of the pieces and n_tokens of every document.

    A null or empty text has the begin and end ids alone; null ids and rows that repeat pass through, each with its row;
    an empty table gives none; further columns are left out, as this stage comes last.
    """
    coded = encode_documents(docs, default_model(), offsets=True)
    return coded.select("doc_id", "ids", "ends", F.size("ids").cast("long").alias("n_tokens"))

"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has a node for each position and an edge for each piece
that spans two positions.  For a unigram model the best path to a position is
the one of the largest sum of scores.  For a model of merges (BPE) a path is
allowed if each two neighbouring pieces are compatible, that is, if no merge
that the model prefers would have joined parts of them; exactly one path to
each position is allowed.  Either way each position keeps one backpointer, and
the path ends with the ids that the model gives.  The search keeps a window of
positions no longer than the longest piece, since no later piece can start
before it, and commits ids as soon as the surviving paths, read backwards from
all positions of the window, meet at one boundary.

Where no piece of the vocabulary holds two given characters side by side, all
paths meet, whatever surrounds them.  These boundaries are known without a
search, so the stream of a task's texts commits there and starts anew; a stretch
between two of them that the task has met before is not searched again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import wordscan as ws
from strata.llm.idpool import IdPool
from strata.llm.shared import keyed_text, table

SPACE = "▁"
_NONE = -1


def _fields(raw: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number: integers, or bytes."""
    at, out = 0, {}

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = raw[at : at + size], at + size
        out.setdefault(number, []).append(value)
    return out


def model_kind(proto: bytes) -> str:
    """``unigram`` or ``bpe``; a ValueError for a model that the search does not follow.

    It follows models with bytes for unknown characters, the identity
    normaliser, and a space sign put before the text and for each space.
    """
    model = _fields(proto)
    trainer, normal = (_fields(model.get(k, [b""])[-1]) for k in (2, 3))
    kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, [1])[-1])
    if not kind:
        raise ValueError("only unigram and BPE models are supported")
    if not trainer.get(35, [0])[-1]:
        raise ValueError("the model has no bytes for unknown characters")
    if trainer.get(24, [0])[-1]:
        raise ValueError("models with the space sign after a word are not supported")
    if any(normal.get(2, [b""])) or any(normal.get(6, [b""])) or not normal.get(3, [1])[-1] or normal.get(4, [1])[-1] or not normal.get(5, [1])[-1]:
        raise ValueError("only the identity normaliser with a space before the text and all white space kept is supported")
    if any(_fields(p).get(3, [1])[-1] == 4 for p in model.get(1, [])):
        raise ValueError("user-defined pieces are not supported")
    return kind


@dataclass
class PieceModel:
    """What coding needs of a model; small and of fixed size, so it can be broadcast."""

    pieces: list[str]
    rank: dict[str, int]
    ids: dict[str, int]
    byte_ids: list[int]
    parts: dict[int, tuple[int, int]] = field(default_factory=dict)
    longest: int = 1
    kind: str = "bpe"
    scores: dict[int, float] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = model_kind(sp.serialized_model_proto())
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
        if kind == "unigram":
            return cls.unigram(pieces, {i: sp.get_score(i) for i in plain}, byte_ids)
        scores = sorted({sp.get_score(i) for i in plain if len(pieces[i]) > 1}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        rank = {pieces[i]: place[sp.get_score(i)] for i in plain if len(pieces[i]) > 1}
        model = cls(pieces, rank, {pieces[i]: i for i in plain}, byte_ids)
        for i in plain:
            if len(pieces[i]) > 1:
                last = model._last_merge(pieces[i])
                if last is None:
                    del model.ids[pieces[i]]  # merges never arrive at it
                else:
                    model.parts[i] = (model.ids[last[0]], model.ids[last[1]])
        model.longest = max(map(len, model.ids))
        return model

    @classmethod
    def unigram(cls, pieces: list[str], scores: dict[int, float], byte_ids: list[int]) -> PieceModel:
        """A model of scored pieces; the best path has the largest sum."""
        ids = {pieces[i]: i for i in scores}
        return cls(pieces, {}, ids, byte_ids, longest=max(map(len, ids)), kind="unigram", scores=scores)

    @property
    def byte_score(self) -> float:
        """Of a character that no piece has: below all pieces by the penalty for unknown ones."""
        return min(self.scores.values(), default=0.0) - 10.0

    def merge(self, text: str) -> list[str]:
        """All merges of a short text, the best and leftmost first."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        found, last = list(text), None
        while len(found) > 1:
            options = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(found, found[1:])) if a + b in self.rank]
            if not options:
                break
            _, k = min(options)
            last = (found[k], found[k + 1])
            found[k : k + 2] = [found[k] + found[k + 1]]
        return found, last

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        found, last = self._merge(piece)
        return last if len(found) == 1 and all(x in self.ids for x in last) else None

    def joined_bytes(self) -> np.ndarray:
        """For two bytes side by side (a space stands for the space sign): whether a piece may span them."""
        may = np.zeros((256, 256), dtype=bool)
        for p in self.ids:
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), dtype=np.uint8)
            may[raw[:-1], raw[1:]] = True
        may[:, 0x80:0xC0] = True
        return may


class StreamingEncoder:
    """Ids of a text that comes in parts; see the module's text."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.fits: dict[int, bool] = {}  # by both ids in one integer
        self.start()

    def start(self) -> None:
        self.tail = ""  # characters of the window
        self.base = 0  # position of the window's first character
        self.back: dict[int, tuple[int, int]] = {0: (_NONE, _NONE)}  # position -> (id, position before it)
        self.total: dict[int, float] = {0: 0.0}  # of the best path to a position, for scored pieces
        self.done = 0  # position up to which ids are committed
        self.mark: dict[int, int] = {0: 0}  # the position that the path to a position had in the window of the last meeting

    def compatible(self, a: int, b: int) -> bool:
        """Whether merges leave piece a beside piece b."""
        known = self.fits.get(a << 32 | b)
        if known is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            known = self.fits[a << 32 | b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        m = self.model
        rank = lambda i: m.rank[m.pieces[i]] if i in m.parts else -1
        # Undo the merges inside a and b from the last one on; before each, was joining the two sides preferred?
        before = None  # merges of a rank below this one (or equal to it, if left of it) came first
        while True:
            joined = m.rank.get(m.pieces[a] + m.pieces[b])
            if joined is not None and (before is None or (joined, 1) < before):
                return False
            ra, rb = rank(a), rank(b)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the merge inside a was the later one and stands left of the border
                before = (ra, 1)
                a = m.parts[a][1]
            else:
                before = (rb, 2)
                b = m.parts[b][0]

    def feed(self, text: str) -> list[int]:
        """Take more text; return the ids that no further text can change."""
        out = self._search(text)
        return out + self._commit(self.base + len(self.tail))

    def _search(self, text: str) -> list[int]:
        step = self._scored if self.model.kind == "unigram" else self._merged
        longest, out = self.model.longest, []
        # A long text comes in parts, so that the window is all that is kept of it.
        for lo in range(0, len(text), 2 * longest):
            part = text[lo : lo + 2 * longest]
            window = self.tail + part
            step(window, len(self.tail), self.base)
            at = self.base + len(window)
            if at - self.done > longest:
                out += self._commit(at)
            keep = min(len(window), longest)
            self.tail, self.base = window[len(window) - keep :], at - keep
        return out

    def _merged(self, window: str, first: int, base: int) -> None:
        """The backpointers of the window's positions after ``first``: the piece that is compatible with the path before it."""
        ids, back, fits, longest = self.model.ids, self.back, self.fits, self.model.longest
        for i in range(first + 1, len(window) + 1):
            for length in range(min(longest, i), 0, -1):
                piece = ids.get(window[i - length : i])
                if piece is None:
                    if length > 1:
                        continue
                    piece = -2 - ord(window[i - 1])  # no piece: bytes, which merge with nothing
                before = back.get(base + i - length)
                if before is None:
                    continue
                last = before[0]
                if last >= 0 and piece >= 0:
                    known = fits.get(last << 32 | piece)
                    if not (self.compatible(last, piece) if known is None else known):
                        continue
                back[base + i] = (piece, base + i - length)
                self.mark[base + i] = self.mark[base + i - length]
                break

    def _scored(self, window: str, first: int, base: int) -> None:
        """The same for scored pieces: the best sum; of equal sums the longer piece."""
        m, back, total = self.model, self.back, self.total
        for i in range(first + 1, len(window) + 1):
            best = None
            for length in range(min(m.longest, i), 0, -1):
                piece = m.ids.get(window[i - length : i])
                if piece is None:
                    if length > 1:
                        continue
                    piece = -2 - ord(window[i - 1])
                if base + i - length not in back:
                    continue
                own = total[base + i - length] + (m.scores[piece] if piece >= 0 else m.byte_score)
                if best is None or own > best[0]:
                    best = (own, piece, base + i - length)
            total[base + i], back[base + i] = best[0], best[1:]
            self.mark[base + i] = self.mark[best[2]]

    def _path(self, at: int) -> list[int]:
        path = [at]
        while path[-1] > self.done:
            path.append(self.back[path[-1]][1])
        return path

    def _commit(self, at: int) -> list[int]:
        """Ids up to the boundary on which the paths to all positions of the window have met, if they have.

        Each position knows through which position of an earlier window its path
        went, so a look costs a window, however far back the paths meet.  Once
        they do, the positions of this window are the next ones to look for.
        """
        alive = [p for p in range(max(self.done, at - self.model.longest), at + 1) if p in self.back]
        met = {self.mark[p] for p in alive}
        if len(met) > 1:
            return []
        before, (meeting,) = self.done, met
        out = self._ids(meeting) if meeting > before else []
        for p in range(before, self.done):
            self.back.pop(p, None)
            self.total.pop(p, None)
            self.mark.pop(p, None)
        self.mark.update((p, p) for p in alive)
        return out

    def _ids(self, at: int) -> list[int]:
        path = self._path(at)
        out: list[int] = []
        for p in reversed(path[:-1]):
            piece = self.back[p][0]
            out += [piece] if piece >= 0 else [self.model.byte_ids[x] for x in chr(-2 - piece).encode("utf-8", "surrogatepass")]
        self.done = at
        return out

    def finish(self) -> list[int]:
        out = self._ids(self.base + len(self.tail))
        self.start()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self._search(text) + self.finish()


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """The text of ids: pieces, with bytes put together, without the space put before the text."""
    value = {i: k for k, i in enumerate(model.byte_ids)}
    raw = b"".join(bytes([value[i]]) if i in value else model.pieces[i].encode() for i in ids.tolist())
    return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


class _Decoder:
    """Decoding of many id lists: the bytes of each id in one pool."""

    def __init__(self, model: PieceModel):
        value = {i: bytes([k]) for k, i in enumerate(model.byte_ids)}
        raw = [value.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(model.pieces)]
        self.size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def texts(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        raw = self.data[np.repeat(self.begin[ids], size) + step].tobytes()
        cut = ends[at].tolist()
        return [raw[s + 1 : e] for s, e in zip(cut[:-1], cut[1:])]


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = StreamingEncoder(shared.value)
        # The stretches that this task has met; an idle worker process keeps none of them.
        pool = IdPool(lambda spans: [encoder.encode(s.decode("utf-8", "replace").replace(" ", SPACE)) for s in spans])
        joined = shared.value.joined_bytes()
        value, second = ws.byte_values(lower=False), ws.byte_values(lower=False, seed=29)
        for b in batches:
            for row, part, edge in ws.slices(b.column("normal")):
                cut = np.ones(len(part), dtype=bool)
                if len(part):
                    cut[1:] = ~joined[part[:-1], part[1:]]
                    cut[edge[:-1][edge[:-1] < len(part)]] = True
                start = np.flatnonzero(cut)
                end = np.append(start[1:], len(part)) if len(start) else start
                ids, count = pool.ids_of(ws.span_hashes(part, start, end, value), ws.span_hashes(part, start, end, second), start, end, part)
                at = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, edge)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(edge) - 1), lists], names=["doc_id", "ids"])

    return run


def _decode(shared, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(shared.value)
        for b in batches:
            lists = b.column("ids")
            if lists.null_count:
                lists = lists.fill_null([])
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            at -= at[0]
            for lo in range(0, len(at) - 1, 256):
                hi = min(lo + 256, len(at) - 1)
                texts = decoder.texts(ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                out = [b.column("doc_id").slice(lo, hi - lo)]
                if digest:
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist())]
                    out += [pa.array(np.diff(at[lo : hi + 1])), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])
                else:
                    out += [b.column("ids").slice(lo, hi - lo), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"])

    return run


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as the search takes them: a space before the text, the space sign as a space."""
    normal = F.when(F.length("text") > 0, F.concat(F.lit(" "), F.replace(F.col("text"), F.lit(SPACE), F.lit(" ")))).otherwise("")
    return keyed_text(docs, id_col, text_col).select("doc_id", normal.alias("normal"))


def encode_pieces(docs: DataFrame, model: str | PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; a null or empty text has no ids.

    The model's space sign inside a text counts as a space.  Characters that
    the model lacks become the ids of their bytes.  ``model`` is a path or a
    loaded model; see :func:`model_kind` for those that can be used.  Rows with
    a null id keep it, and every row gives one row.
    """
    return _normal(docs, id_col, text_col).mapInArrow(_encode(_shared(docs.sparkSession, model)), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | PieceModel) -> DataFrame:
    """(doc_id, ids, decoded) of encoded documents."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_shared(encoded.sparkSession, model), False), "doc_id long, ids array<int>, decoded string")


def _shared(spark: SparkSession, model: str | PieceModel):
    return spark.sparkContext.broadcast(PieceModel.load(model) if isinstance(model, str) else model)


def _code(shared, digest: bool):
    """Encoding and then decoding in one worker process."""
    encode, decode_ = _encode(shared), _decode(shared, digest)
    return lambda batches: decode_(encode(batches))


def code_pieces(docs: DataFrame, model: str | PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): :func:`encode_pieces` and :func:`decode_pieces` in one pass."""
    return _normal(docs, id_col, text_col).mapInArrow(_code(_shared(docs.sparkSession, model), False), "doc_id long, ids array<int>, decoded string")


def code_digests(docs: DataFrame, model: str | PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32 (ids as little-endian 32-bit integers), decoded_sha256."""
    return _normal(docs, id_col, text_col).mapInArrow(_code(_shared(docs.sparkSession, model), True), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")


def op9_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return code_digests(table(spark, sf_dir, "documents"), PieceModel.load(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op9_piece_coding": op9_piece_coding}
ORACLES: dict[str, str] = {}

"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

One pass over a text gives, at each position, every piece that ends there: the automaton's state and its output links. A unigram model relaxes the best score of each position over them (Viterbi). In a BPE model scores order merges and don't add up, so the best sum isn't what the model's own library encodes; there the same pass relaxes validity: a position's last piece is the one piece ending there whose pair with the last piece before it is left alone by the merges. Such a piece is unique, and the pairs' validity is kept in a table. BPE texts fall into chunks that no piece crosses, so chunks are encoded once and remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bounds of what an encoder remembers: chunks, their length, and pairs.
CHUNKS, CHUNK_CHARS, PAIRS = 200_000, 48, 500_000
UNKNOWN_PENALTY = 10.0


_SINGLE = struct.Struct("<f")


def single(x: float) -> float:
    """x in single precision."""
    return _SINGLE.unpack(_SINGLE.pack(x))[0]


def _fields(b: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    out, i = [], 0

    def varint(i):
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return value, i

    while i < len(b):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[kind]
            v, i = b[i : i + n], i + n
        out.append((tag >> 3, v))
    return out


class Pieces:
    """Encoder and decoder of one model file (unigram or BPE, identity normaliser, no user-defined pieces)."""

    def __init__(self, model: bytes, model_type: int | None = None):
        import ahocorasick

        self.text: list[str] = []
        self.score: list[float] = []
        kinds: list[int] = []
        trainer, normaliser = {}, {}
        for f, v in _fields(model):
            if f == 1:
                p = dict(_fields(v))
                self.text.append(p[1].decode())
                self.score.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                normaliser = dict(_fields(v))
        if USER in kinds or normaliser.get(2):
            raise ValueError("models with user-defined pieces or a normalisation table aren't supported")
        self.type = model_type or trainer.get(3, UNIGRAM)
        self.prefix, self.squeeze = normaliser.get(3, 1), normaliser.get(4, 1)
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kinds, strict=True)]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        letters = "".join(re.escape(c) for c in {c for t in self.id for c in t})
        self.parts = re.compile(f"[{letters}]+|[^{letters}]")
        self.known = frozenset(c for t in self.id for c in t)
        inner = [t for t in self.id if SPACE in t[1:]]
        runs = [t for t in inner if not t.strip(SPACE)]
        others = min((self.score[i] for t, i in self.id.items() if len(t) > 1 and t.strip(SPACE)), default=0.0)
        #: Whether pieces have the space mark at their start only, but for runs of it that merge after everything else.
        self.splits = len(runs) == len(inner) and all(self.score[self.id[t]] < others for t in runs)
        self.lowest = min((self.score[i] for i in self.id.values()), default=0.0)
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}

    def forget(self) -> None:
        """Drop the remembered chunks."""
        self._chunks.clear()

    # encoding
    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return []
        s = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.type == UNIGRAM:
            return self._viterbi(s)
        if not self.splits:
            return self._segments(s)
        out: list[int] = []
        seen = self._chunks
        for c in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", s):
            ids = seen.get(c)
            if ids is None:
                ids = tuple(self._chunk(c))
                if len(c) <= CHUNK_CHARS:
                    if len(seen) >= CHUNKS:
                        seen.clear()
                    seen[c] = ids
            out += ids
        return out

    def _chunk(self, c: str) -> list[int]:
        if not c.startswith(SPACE * 2):
            return self._segments(c)
        word = c.lstrip(SPACE)
        marks = len(c) - len(word)
        if not word:
            return self.merge(c)
        ids = self._segments(SPACE + word)
        if ids[0] == self.id.get(SPACE):
            return self.merge(SPACE * marks) + ids[1:]
        return self.merge(SPACE * (marks - 1)) + ids

    def _segments(self, s: str) -> list[int]:
        if self.known.issuperset(s):
            return self._valid(s)
        out: list[int] = []
        for part in self.parts.findall(s):
            if part[0] in self.known:
                out += self._valid(part)
            elif self.bytes:
                out += [self.bytes[x] for x in part.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _viterbi(self, s: str) -> list[int]:
        """The segmentation of the best sum of scores, in single precision as the model's own library adds them up, so that ties and near-ties fall alike."""
        worst = float("-inf")
        best, last = [0.0] + [worst] * len(s), [-1] * (len(s) + 1)
        score, size = self.score, [1] * (len(s) + 1)
        at = 0

        def fill(upto):  # characters that are no piece themselves
            for e in range(at + 1, upto + 1):
                if last[e] < 0 or size[e] > 1:
                    x = single(best[e - 1] + single(self.lowest - UNKNOWN_PENALTY))
                    if s[e - 1] not in self.id and x > best[e]:
                        best[e], last[e], size[e] = x, self.unknown, 1

        for end, (t, n) in self.automaton.iter(s):
            e = end + 1
            if e - 1 > at:
                fill(e - 1)
                at = e - 1
            x = single(best[e - n] + score[t])
            if x > best[e]:
                best[e], last[e], size[e] = x, t, n
        fill(len(s))
        out, e = [], len(s)
        while e:
            if last[e] != self.unknown:
                out.append(last[e])
            elif self.bytes or not out or out[-1] != self.unknown:  # a run of unknown characters is one
                out += self._spell(s[e - 1])[::-1]
            e -= size[e]
        return out[::-1]

    def _spell(self, c: str) -> list[int]:
        return [self.id[c]] if c in self.id else [self.bytes[x] for x in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _valid(self, s: str) -> list[int]:
        """The one segmentation whose neighbours all stay apart under the merges."""
        last = [-1] + [-2] * len(s)  # -1: the start, -2: no piece yet
        pairs = self._pairs
        for end, (t, n) in self.automaton.iter(s):
            e = end + 1
            if last[e] == -2:
                p = last[e - n]
                if p == -1:
                    last[e] = t
                elif p >= 0:
                    k = p << 32 | t
                    ok = pairs.get(k)
                    if ok is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        ok = pairs[k] = self.merge(self.text[p] + self.text[t]) == [p, t]
                    if ok:
                        last[e] = t
        out, e = [], len(s)
        while e:
            t = last[e]
            if t < 0:  # a letter that is no piece itself
                return self.merge(s)
            out.append(t)
            e -= len(self.text[t])
        return out[::-1]

    def merge(self, s: str) -> list[int]:
        """BPE by its definition: the best-scored pair first, of equals the leftmost. For pairs, runs of spaces and as the measure in tests."""
        parts: list[str] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a, b):
            if a >= 0 and b < len(s):
                both = parts[a] + parts[b]
                if both in self.id:
                    heapq.heappush(heap, (-self.score[self.id[both]], a, b, both))

        for k in range(len(s) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or not parts[b] or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[a] < len(s):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [i for p in parts if p for i in ([self.id[p]] if p in self.id else self._spell(p))]

    # decoding
    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and raw[:1] == b" " and ids and self.text[ids[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_loaded: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """The encoder of a model, once for each Python process."""
    tag = hashlib.sha256(model).digest()
    if tag not in _loaded:
        _loaded[tag] = Pieces(model)
    return _loaded[tag]


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, round_trip) for every row: the whole text's piece ids, and whether they decode to the text.

    Null and empty texts have no ids and round-trip as empty. Texts that hold the space mark itself (U+2581) or bytes that aren't UTF-8 don't round-trip. Null keys and repeated rows stay. Other columns aren't read; an empty table gives no rows. The model file is read on the driver and its bytes go to the executors, so only the driver needs the path.
    """
    with open(model, "rb") as f:
        data = f.read()

    def run(batches):
        import pyarrow as pa

        pieces = load(data)
        try:
            for b in batches:
                texts = [x.decode("utf-8", "replace") if x else "" for x in b.column(1).to_pylist()]
                ids = [pieces.encode(t) for t in texts]
                same = [pieces.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["k", "n_tokens", "ids", "round_trip"])
        finally:  # the worker lives on, for other operators too
            pieces.forget()

    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("k", key)

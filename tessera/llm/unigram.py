"""SentencePiece unigram decoding of texts: streaming Viterbi to ids, and token counts by Aho-Corasick."""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, gather, map_arrow, table
from tessera.llm.tokens import vocabulary

SPACE = "▁"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: What an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Characters between two looks for a boundary where all paths meet.
LOOK = 64
#: Segments that a worker keeps, and characters in them; beyond either the cache starts anew.
CACHE, CACHE_CHARS = 1_000_000, 1 << 24
_loaded: dict[str, "Unigram"] = {}


class Unigram:
    """Pieces and scores of a SentencePiece model, read as a unigram model.

    A text gets the segmentation of the highest sum of scores; of equal ones, the library's: at each end
    the piece that starts first. Sums are exact doubles (the library adds in single precision, which loses
    whole units beyond 2^24). A character in no piece costs the least score less UNKNOWN_PENALTY and is
    spelled in byte pieces. Spaces, a leading one included, are the escape sign.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: (float(p.score), i) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.unknown_score = min(s for s, _ in self.ids.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.trie: dict = {}
        for p, value in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = value
        known = set("".join(self.ids))
        self.singles = {p for p in self.ids if len(p) == 1}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # no piece goes over the start of a run of spaces or a character that is in none
        alone = "".join(re.escape(c) for c in "\n\r\t\x0b\x0c" if c not in known)
        stop = SPACE + alone
        self.segment = re.compile("|".join(x for x in (f"{SPACE}+[^{stop}]*", f"[^{stop}]+", f"[{alone}]" if alone else "") if x), re.S)
        self.known: dict[str, int] = {}
        self.pool, self.starts = array("I"), array("q", [0])
        self.counted: dict[str, int] = {}
        self.known_chars = self.counted_chars = 0
        self.automaton = ahocorasick.Automaton()
        for p, (score, _) in self.ids.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str) -> "Unigram":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def escaped(self, text: str | None) -> str:
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def stream(self, text: str):
        """Yield lists of ids in order, keeping a window of positions only.

        Positions that a piece can still be added to reach back one longest piece. When the paths behind
        them meet in one boundary, the ids before it are settled and the window starts there.
        """
        n, base = len(text), 0
        scores, back, ids = [0.0], [0], [-1]
        none, trie = float("-inf"), self.trie
        for i in range(n):
            here = scores[i - base]
            top = min(n, i + self.longest)
            single = False
            grow = top - base + 1 - len(scores)
            if grow > 0:
                scores += [none] * grow
                back += [0] * grow
                ids += [-1] * grow
            node, end = trie, i
            while end < top:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                found = node.get("")
                if found:
                    if end == i + 1:
                        single = True
                    at = end - base
                    total = here + found[0]
                    if total > scores[at]:
                        scores[at], back[at], ids[at] = total, i, found[1]
            if not single and here + self.unknown_score > scores[i + 1 - base]:
                scores[i + 1 - base], back[i + 1 - base], ids[i + 1 - base] = here + self.unknown_score, i, self.unknown
            if (i + 1 - base) % LOOK == 0 and i + 1 < n:
                live = {p for p in range(i + 1, min(n, i + self.longest) + 1) if scores[p - base] > none}
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(back[last - base])
                meet = live.pop()
                if base < meet <= i + 1:
                    yield self._path(text, back, ids, base, meet)
                    # scores stay sums from the start of the text
                    scores, back, ids = scores[meet - base :], back[meet - base :], ids[meet - base :]
                    base = meet
        if n > base:
            yield self._path(text, back, ids, base, n)

    def _path(self, text: str, back: list, ids: list, base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            start = back[end - base]
            k = ids[end - base]
            if k == self.unknown and self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[start:end].encode("utf-8", "replace"))]
            else:
                out.append(k)
            end = start
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null or empty: none."""
        return [k for part in self.stream(self.escaped(text)) for k in part]

    def encode_batch(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and each text's offset; segments that no piece leaves are settled once each.

        What is kept between batches has at most CACHE segments of CACHE_CHARS characters and one batch's more.
        """
        if len(self.known) > CACHE or self.known_chars > CACHE_CHARS:
            self.known, self.known_chars = {}, 0
            self.pool, self.starts = array("I"), array("q", [0])
        known, pool, starts = self.known, self.pool, self.starts
        at, ends = array("q"), [0]
        for text in texts:
            s = self.escaped(text)
            for part in self.segment.findall(s) if self.cuts else [s] if s else []:
                k = known.get(part)
                if k is None:
                    for ids in self.stream(part):
                        pool.extend(ids)
                    starts.append(len(pool))
                    known[part] = k = len(known)
                    self.known_chars += len(part)
                at.append(k)
            ends.append(len(at))
        bounds, place = np.array(starts, np.int64), np.array(at, np.int64)
        each = bounds[place + 1] - bounds[place]
        return gather(np.array(pool, "<u4"), bounds[place], each), np.concatenate(([0], np.cumsum(each)))[ends]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces join into characters, escape signs are spaces, the leading one goes."""
        out, held = [], bytearray()
        for k in ids:
            k = int(k)
            if k in self.bytes_of:
                held.append(self.bytes_of[k])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[k])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def _count(self, s: str) -> int:
        """Pieces of the best segmentation; only the best score and its count are kept for each end."""
        n = len(s)
        none = float("-inf")
        score, count = [0.0] + [none] * n, [0] * (n + 1)
        if self.singles.issuperset(s):
            # matches at an end come longest first, so a strict comparison keeps the earliest start
            for end, (length, own) in self.automaton.iter(s):
                start = end + 1 - length
                total = score[start] + own
                if total > score[end + 1]:
                    score[end + 1], count[end + 1] = total, count[start] + 1
            return count[n]
        single = bytearray(n + 1)
        found = self.automaton.iter(s)
        match = next(found, None)
        for end in range(1, n + 1):
            best, pieces = none, 0
            while match is not None and match[0] + 1 == end:
                length, own = match[1]
                single[end] |= length == 1
                total = score[end - length] + own
                if total > best:
                    best, pieces = total, count[end - length] + 1
                match = next(found, None)
            if not single[end]:
                total = score[end - 1] + self.unknown_score
                if total > best:
                    best, pieces = total, count[end - 1] + (len(s[end - 1].encode("utf-8", "replace")) if self.byte_ids else 1)
            score[end], count[end] = best, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        if len(self.counted) > CACHE or self.counted_chars > CACHE_CHARS:
            self.counted, self.counted_chars = {}, 0
        s, total = self.escaped(text), 0
        for part in self.segment.findall(s) if self.cuts else [s] if s else []:
            n = self.counted.get(part)
            if n is None:
                n = self.counted[part] = self._count(part)
                self.counted_chars += len(part)
            total += n
        return total


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids array<int> of every whole text. Null texts have no ids; every row counts by itself."""
    bound_batches(docs.sparkSession, 500)

    def run(batch: pa.RecordBatch):
        ids, offsets = Unigram.load(model).encode_batch(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text of ids; a null list is a null text."""
    bound_batches(tokens.sparkSession, 500)

    def run(batch: pa.RecordBatch):
        own = Unigram.load(model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(tokens.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back.

    A null or empty text has no ids, CRC 0 and round_trip true; repeated rows give a row each, an empty table none.
    """
    bound_batches(docs.sparkSession, 500)

    def run(batch: pa.RecordBatch):
        own = Unigram.load(model)
        texts = batch.column(1).to_pylist()
        ids, offsets = own.encode_batch(texts)
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        # an escape sign in a text reads as a space
        same = [own.decode(p.tolist()) == (t or "").replace(SPACE, " ") for p, t in zip(parts, texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")


def counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens of every whole text, without building ids. Null and empty texts count 0."""
    bound_batches(docs.sparkSession, 500)

    def run(batch: pa.RecordBatch):
        own = Unigram.load(model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))

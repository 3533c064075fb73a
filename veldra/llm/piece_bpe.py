"""SentencePiece merge-type encoding by backtracking, and decoding.

A merge-type encoding is the one sequence of pieces of which every two neighbours, merged again from their
characters, come out as those same two. So it is found from left to right: take the longest piece that an
Aho-Corasick automaton finds, check it against the piece before it, else try the longest piece that is a prefix of
it; if none is left, mark the position in a bitfield as failed and take the piece before back. Pieces that merging
can't reach are left out of the automaton. The vocabularies of this kind have no piece with a space inside, so each
run of spaces with the word after it is encoded on its own, and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import pick, table

SPACE = "▁"


class PieceModel:
    """Encoder and decoder for a byte-pair model file with byte fallback and no normalisation."""

    def __init__(self, path: str, cache_words: int = 400_000, longest: int = 64):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models without normalisation, with a dummy prefix, are supported")
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.bos, self.eos = (next(i for i, p in enumerate(model.pieces) if p.piece == x) for x in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p: s for p, (_, s) in normal.items()}
        self.id = {p: i for p, (i, _) in normal.items()}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a space inside: words can't be encoded on their own")
        inside = set("".join(p for p in normal if len(p) > 1))
        self.lines = "\n" not in inside
        self.pair_ok: dict[tuple[str, str], bool] = {}
        reachable = [p for p in normal if len(p) == 1 or self.merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        held = set(reachable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in held), None) for p in reachable}
        alone = sorted(p for p in reachable if len(p) == 1)
        self.known = re.compile("[" + "".join(map(re.escape, alone)) + "]+")
        self.cache: dict[str, bytes] = {}
        self.cache_words, self.longest = cache_words, longest
        self.text_of = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in self.byte_id.items():
            self.text_of[i] = bytes([b])
        for i in self.control:
            self.text_of[i] = b""
        self.text_of[self.unknown] = model.trainer_spec.unk_surface.encode()
        self.bytes = frozenset(self.byte_id.values())

    def merge(self, text: str) -> list[str]:
        """Merging as defined: the best-scored pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self.pair_ok.get((a, b))
        if got is None:
            if len(self.pair_ok) > 2_000_000:
                self.pair_ok.clear()
            got = self.pair_ok[a, b] = self.merge(a + b) == [a, b]
        return got

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        find, shorter, compatible = self.automaton.iter_long, self.shorter, self.compatible
        open_at = bytearray(b"\x01") * (len(text) + 1)
        out: list[str] = []
        at, token = 0, next(find(text, 0))[1]
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + len(token)
                if open_at[end] and (last is None or compatible(last, token)):
                    out.append(token)
                    at = end
                    token = next(find(text, at))[1] if at < len(text) else None
                    break
                if shorter[token] is not None:
                    token = shorter[token]
                    continue
                open_at[at] = 0
                token = out.pop()
                at -= len(token)
                break
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """The ids of a run of characters that no merge leaves: known ones as pieces, others as their bytes."""
        ids: list[int] = []
        at = 0
        for m in self.known.finditer(chunk):
            ids += [self.byte_id[b] for b in chunk[at : m.start()].encode()]
            ids += [self.id[p] for p in self.backtrack(m[0])]
            at = m.end()
        ids += [self.byte_id[b] for b in chunk[at:].encode()]
        return np.array(ids, "<u4").tobytes()

    def words_of(self, text: str) -> list[str]:
        """Chunks without their first space; one that begins with a line end has no space before it."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if self.lines and "\n" in text:
            if "  " in text or " \n" in text or text[-1] == " " or text[0] in " \n":
                return [m[1:] if m[0] == " " else m for m in re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)]
            return text.replace("\n", " \n").split(" ")
        if "  " in text or text[-1] == " " or text[0] == " ":
            return [m[1:] for m in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without begin and end."""
        split = [self.words_of(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.cache) if split else set()
        if len(self.cache) + len(new) > self.cache_words:
            self.cache = {w: self.cache[w] for w in set().union(*split) if w in self.cache}
        for w in new:
            self.cache[w] = self.encode_chunk(w if self.lines and w[:1] == "\n" else (SPACE + w).replace(" ", SPACE))
        look = self.cache.__getitem__
        out = [b"".join(map(look, words)) for words in split]
        for w in new:
            if len(w) > self.longest:
                del self.cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space goes, bytes that are no UTF-8 become U+FFFD."""
        first = next((i for i, x in enumerate(ids) if x not in self.control), None)
        if first is None:
            return ""
        last = next(i for i in range(len(ids), 0, -1) if ids[i - 1] not in self.control)
        ids = ids[first:last]
        if not self.control.isdisjoint(ids):
            return self._decode_slowly(ids)
        data = b"".join(map(self.text_of.__getitem__, ids))
        if ids[0] not in self.bytes and ids[0] != self.unknown and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_slowly(ids)

    def _decode_slowly(self, ids: list[int]) -> str:
        out, run, seen = [], bytearray(), False
        for i in [*ids, self.eos]:
            if i in self.bytes:
                run += self.text_of[i]
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:k]).decode())
                        del run[:k]
                        break
                    except UnicodeDecodeError:
                        if k == 4 or k >= len(run):
                            out.append("�")
                            del run[:1]
                            break
            piece = self.text_of[i].decode()
            if not seen and not any(out) and piece[:1] == " " and i != self.unknown:
                piece, seen = piece[1:], True
            out.append(piece)
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each Python worker and file."""
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        bos, eos = (np.array([i], "<u4").tobytes() for i in (m.bos, m.eos))
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 512):
                n, ids_sha, text_sha = [], [], []
                for ids in m.encode(texts.slice(i, 512).to_pylist()):
                    ids = bos + ids + eos
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(m.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 512), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 512):
                ids = [[m.bos, *np.frombuffer(x, "<u4").tolist(), m.eos] for x in m.encode(texts.slice(i, 512).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 512), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids])], ["doc_id", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, path: str | None = None, *, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (with begin and end) and the text decoded from them; or, with digests,
    doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts have begin and end only; each row of repeated ids is encoded; an empty table gives none.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    path = path or default_path()
    if digests:
        return docs.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.mapInArrow(_ids(path), "doc_id long, ids array<int>, decoded string")


def op6_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), digests=True)

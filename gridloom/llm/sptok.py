"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over the model's pieces reads a text once. At each position it follows the output links, so every piece
that ends there relaxes the best score of the segmentation so far. The segmentation maximises the sum of the model's
piece scores; of equal sums the one whose last piece is longer wins. A character without a piece costs 10 below the
least score and is written as its UTF-8 bytes. No piece of the model goes over from text to a word mark, so the
Viterbi of a text falls into those of its words, and each distinct word is segmented once and kept.

Cases: a null text gives null ids, an empty one no ids. Texts of any length are taken whole. U+2581 in a text, which
the model would read as a blank, is written as bytes, so decode(encode(text)) is the text itself. Repeated rows give
repeated results; an empty table gives an empty one; columns besides id and text are ignored by ``encode``.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import WordIndex, csr_take, map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_PENALTY = 10.0


class Pieces:
    """A piece table with its automaton. ``pieces``: (id, piece, score) of the normal pieces; byte_ids: 256 ids."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, p, s in pieces:
            if any(c == MARK for c in p.lstrip(MARK)):
                raise ValueError(f"piece {p!r} runs over a word mark")
            self.automaton.add_word(p, (i, len(p), s))
        self.automaton.make_automaton()
        self.singles = {p for _, p, _ in pieces if len(p) == 1}
        self.unknown = min((s for *_, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = byte_ids
        self.line_cut = not any("\n" in p for _, p, _ in pieces)
        table = [b""] * size
        for i, p, _ in pieces:
            table[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            table[i] = bytes([b])
        self.out_len = np.array([len(x) for x in table], np.int64)
        self.out_start = np.cumsum(self.out_len) - self.out_len
        self.out_pool = np.frombuffer(b"".join(table), np.uint8)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        normal = [(i, m.id_to_piece(i), m.get_score(i)) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls(normal, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best segmentation of a string in which blanks are marks already."""
        n = len(s)
        low = float("-inf")
        best, back = [0.0] + [low] * n, [None] * (n + 1)
        at = 0  # positions up to it are final

        def settle(upto: int) -> None:
            nonlocal at
            while at < upto:  # the unknown edge comes after all pieces that end here
                at += 1
                if s[at - 1] not in self.singles and best[at - 1] + self.unknown > best[at]:
                    best[at], back[at] = best[at - 1] + self.unknown, (-1, 1)

        for end, (i, size, score) in self.automaton.iter(s):
            settle(end)
            if (x := best[end + 1 - size] + score) > best[end + 1]:
                best[end + 1], back[end + 1] = x, (i, size)
        settle(n)
        out: list[int] = []
        while n:
            i, size = back[n]
            out.extend([i] if i >= 0 else [self.byte_ids[b] for b in reversed(s[n - 1].encode("utf-8", "surrogatepass"))])
            n -= size
        return out[::-1]


class Codec:
    """Encodes and decodes batches; keeps the ids of the words seen."""

    def __init__(self, pieces: Pieces, keep: int = 400_000):
        self.p = pieces
        self.mark_ids = [pieces.byte_ids[b] for b in MARK.encode()]
        self.reset()
        self.words = WordIndex(self._add, self.reset, keep)

    def reset(self) -> None:
        self.pool, self.ends = array("i"), array("q", [0])

    def _add(self, unit: str) -> None:
        self.pool.extend(self.mark_ids if unit == MARK * 2 + "\n" else self.p.viterbi(unit))
        self.ends.append(len(self.pool))

    def units(self, text: str) -> list[str]:
        """Cut a text where no piece can cross."""
        if not text:
            return []
        if MARK in text:  # a literal mark stands for itself; the unit that means it can't come from a text
            out: list[str] = []
            for k, part in enumerate(text.split(MARK)):
                out += [MARK * 2 + "\n"] * (k > 0)
                z = MARK * (k == 0) + part.replace(" ", MARK)
                out += [y for x in _UNITS.findall(z) for y in self._lines(x)]
            return out
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [y for x in _UNITS.findall(MARK + text.replace(" ", MARK)) for y in self._lines(x)]
        z = MARK + text.replace(" ", " " + MARK)
        if self.p.line_cut and "\n" in z:
            z = z.replace("\n", " \n ")
            return [x for x in z.split(" ") if x]
        return z.split(" ")

    def _lines(self, unit: str) -> list[str]:
        return [x for x in re.split("(\n)", unit) if x] if self.p.line_cut and "\n" in unit else [unit]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        units = [self.units(t) if t else [] for t in texts]
        rows = self.words.rows([u for us in units for u in us])
        ends = np.frombuffer(self.ends, np.int64)
        lens = ends[rows + 1] - ends[rows]
        flat = csr_take(np.frombuffer(self.pool, np.int32) if len(self.pool) else np.zeros(0, np.int32), ends[rows], lens)
        cuts = np.cumsum([0] + [len(u) for u in units])
        total = np.concatenate([[0], np.cumsum(lens)])
        return flat, total[cuts[1:]] - total[cuts[:-1]]

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids in a row; the blank that encoding puts first is taken off again."""
        lens = self.p.out_len[flat]
        raw = csr_take(self.p.out_pool, self.p.out_start[flat], lens).tobytes()
        at = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = []
        for a, b in zip(at, at[1:]):
            out.append((raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b]).decode("utf-8", "replace"))
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every row; round_trip tells whether decoding the ids gave the text."""

    def make():
        codec = Codec(Pieces.load(model))

        def work(ids, texts):
            flat, counts = codec.encode(texts)
            back = codec.decode(flat, counts)
            null = np.array([t is None for t in texts])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts.astype(np.int32), mask=null), lists, pa.array([None if t is None else t == u for t, u in zip(texts, back)], pa.bool_())],
                names=["doc_id", "n_tokens", "token_ids", "round_trip"],
            )

        return work

    return map_texts(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], make, "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row of ids. Null ids give a null text; ids outside the table raise."""

    def run(batches):
        codec = Codec(Pieces.load(model))
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            texts = codec.decode(flat, counts) if len(counts) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())], pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("token_ids")).mapInArrow(run, "doc_id long, text string")

"""SentencePiece encoding and decoding.

Encoding finds the segmentation of a text into vocabulary pieces with the best
total score. An Aho-Corasick automaton over the pieces reads the text once; at
each position the pieces that end there (its output links) relax the best
score so far -- a single-pass Viterbi. A character no piece covers costs
``unknown`` and is spelled out as byte pieces.

Scores are log-probabilities. A unigram model has them. The scores of a BPE
model are minus the rank of a merge, and adding ranks would favour many early
pieces; merges are made in the order of their frequency, so a piece of rank r
gets the Zipf-Mandelbrot estimate -ln(``ZIPF`` + r) (nothing is trained).

The text is normalised as the model says. Without a character map or white
space rules that is: one space in front (``add_dummy_prefix``), and spaces
become U+2581; else the library's normaliser does it. In a vocabulary
whose pieces hold U+2581 only in front (or consist of it), no piece crosses
the border before a run of U+2581, so the best segmentation is that of the
words, and words are remembered in a bounded table: each distinct word runs
through the automaton once per worker. Scores are scaled to integers, so the
sums are exact and the same for a word as for a whole
text; ties go to the longer last piece, at every position.

The model file is read on the driver (its path is a parameter) and its pieces
are sent to the tasks: a vocabulary is some 10^5 pieces, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import text_array

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64
#: Offset of the ranks, and the scale of scores as integers.
ZIPF, SCALE = 1000, 1 << 20
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass
class Vocabulary:
    """``scores``: piece -> (id, score); ``byte_ids``: id of each byte piece; ``unknown``: score of a
    character without a piece; ``prefix``: whether a space is put in front; ``normalizer``: the library's processor, where the model has rules of its own."""
    scores: dict[str, tuple[int, int]]
    byte_ids: list[int]
    unknown: int
    unk_id: int = 0
    prefix: bool = True
    normalizer: object = None
    _machine: object = field(default=None, repr=False)
    _words: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None, "_words": {}}

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """From a SentencePiece model file, unigram or BPE. Normal and
        user-defined pieces take part; control, unknown, unused and byte pieces
        are no text. Models of other kinds raise ValueError."""
        with open(path, "rb") as f:
            return Vocabulary.parse(f.read())

    @staticmethod
    def parse(raw: bytes) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(raw)
        kinds, piece, rules = proto.TrainerSpec, proto.ModelProto.SentencePiece, model.normalizer_spec
        kind = model.trainer_spec.model_type
        if kind not in (kinds.UNIGRAM, kinds.BPE) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with white space in front of pieces are supported")
        score = (lambda s: s) if kind == kinds.UNIGRAM else (lambda s: -math.log(ZIPF - min(s, 0.0)))
        normal = [score(p.score) for p in model.pieces if p.type == piece.NORMAL]
        least, most = min(normal, default=0.0), max(normal, default=0.0)
        scores = {p.piece: (i, round((score(p.score) if p.type == piece.NORMAL else len(p.piece) * most - 0.1) * SCALE))
                  for i, p in enumerate(model.pieces) if p.type in (piece.NORMAL, piece.USER_DEFINED)}
        places = {p.piece: i for i, p in enumerate(model.pieces) if p.type == piece.BYTE}
        byte_ids = [places[f"<0x{b:02X}>"] for b in range(256)] if len(places) == 256 else []
        own_rules = rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces
        return Vocabulary(scores, byte_ids, round((least - 10) * SCALE), next((i for i, p in enumerate(model.pieces) if p.type == piece.UNKNOWN), 0),
                          rules.add_dummy_prefix, sentencepiece.SentencePieceProcessor(model_proto=raw) if own_rules else None)

    def normalized(self, text: str) -> str:
        """The text that is cut into pieces, spaces as U+2581."""
        if self.normalizer is not None:
            return self.normalizer.normalize(text)
        return SPACE * self.prefix + text.replace(" ", SPACE) if text else ""

    def plain(self, text: str) -> str:
        """The text that decoding its ids gives back: itself, unless the model's normaliser changes it."""
        if self.normalizer is None:
            return text
        text = self.normalized(text).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def splits_at_spaces(self) -> bool:
        return SPACE in self.scores and all(SPACE not in p.lstrip(SPACE) for p in self.scores)

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for p, (i, s) in self.scores.items():
                self._machine.add_word(p, (len(p), i, s))
            if self.scores:
                self._machine.make_automaton()
        return self._machine

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation, by one pass of the automaton."""
        n = len(text)
        worst = self.unknown * (n + 2) - 1
        best = [worst] * (n + 1)
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        best[0] = 0
        done = 0  # positions up to here are final

        def settle(upto: int) -> None:
            # an unknown character is an edge of its own where no piece did better
            nonlocal done
            while done < upto:
                done += 1
                score = best[done - 1] + self.unknown
                if score > best[done]:
                    best[done], back[done] = score, (1, -1)

        if self.scores:
            for end, (size, i, s) in self.machine().iter(text):
                settle(end)
                score = best[end + 1 - size] + s
                # outputs come longest first, so a later, shorter piece must be better
                if score > best[end + 1]:
                    best[end + 1], back[end + 1] = score, (size, i)
        settle(n)
        out: list[int] = []
        while n:
            size, i = back[n]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "replace")))
            elif not (out and out[-1] == self.unk_id):  # unknown characters in a row are one piece
                out.append(self.unk_id)
            n -= size
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = self.normalized(text)
        if not self.splits_at_spaces_once:
            return self.segment(text)
        out: list[int] = []
        words = self._words
        for word in _WORD.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = self.segment(word)
                if len(word) <= LONGEST:
                    if len(words) >= REMEMBERED:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    @property
    def splits_at_spaces_once(self) -> bool:
        if "_splits" not in self.__dict__:
            self.__dict__["_splits"] = self.splits_at_spaces()
        return self.__dict__["_splits"]

    def decoder(self) -> list[bytes]:
        """Bytes of each id; control and unknown ids are empty."""
        size = 1 + max([self.unk_id, *self.byte_ids, *(i for i, _ in self.scores.values())])
        table = [b""] * size
        for p, (i, _) in self.scores.items():
            table[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            table[i] = bytes([b])
        return table


def decode(ids: list[int], table: list[bytes], prefix: bool = True) -> str:
    """Text of the ids without the space that encoding put in front (``prefix``); bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join([table[i] for i in ids])
    return raw[prefix and raw.startswith(b" "):].decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: id and ``ids`` array<int>. A null text gives null, an empty one no ids."""
    vocabulary = Vocabulary.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [None if t is None else vocabulary.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row of ``encoded``: id and text. Null ids give a null text."""
    vocabulary = Vocabulary.load(model)
    table, prefix = vocabulary.decoder(), vocabulary.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if x is None else decode(x, table, prefix) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Encoding and decoding in one pass: id, n_tokens, n_bytes (byte pieces among them), ids_sha256 (of the ids as
    little-endian 32-bit numbers), round_trip (whether decoding gives the text)
    and, if asked for, ids array<int>.

    Null and empty texts have no tokens and come back as the empty text. A
    model that normalises texts gives back the normalised one. A text that holds U+2581 itself comes back with spaces there (round_trip is
    false), as the format cannot tell them apart. Repeated rows and null ids
    keep a row each; other columns are not read.
    """
    vocabulary = Vocabulary.load(model)
    table = vocabulary.decoder()
    is_byte = np.zeros(len(table), bool)
    is_byte[vocabulary.byte_ids] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, n_bytes, digest, same, every = [], [], [], [], []
                for t in text_array(part.column("text")).to_pylist():
                    ids = vocabulary.encode(t)
                    n.append(len(ids))
                    numbers = np.array(ids, "<i4")
                    every.append(numbers)
                    n_bytes.append(int(is_byte[numbers].sum()))
                    digest.append(hashlib.sha256(numbers.tobytes()).hexdigest())
                    same.append(decode(ids, table, vocabulary.prefix) == vocabulary.plain(t))
                columns = [part.column("id"), pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(every))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "n_bytes", "ids_sha256", "round_trip", "ids"][:len(columns)])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, n_bytes bigint, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

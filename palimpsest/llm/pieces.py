"""Merge-type sentencepiece vocabularies: encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

A text is spaces turned to U+2581 behind one more U+2581. No piece of the vocabulary joins another character to a following
U+2581 (checked when the model is loaded), so no merge crosses that border: each unit - marks and what follows up to the next mark - is
encoded by itself, and a worker remembers the ids of units it has met, in a memo that is bounded in bytes and keeps no long units. Decoding starts
from the ids of the whole text. Of every Arrow batch the first text with anything in it and some of all others, chosen by a hash and of any length, are
also encoded and decoded by the sentencepiece library; a difference raises an error.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import batches, table

MARK = "▁"
MEMO_BYTES, MEMO_CHARS = 80_000_000, 256
SHORT = 24
CHECKED = 64
SCHEMA = "n_tokens long, ids string, decoded string"


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class MergeModel:
    """A sentencepiece model of type BPE with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a dummy prefix is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        if set(self.kinds) - {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}:
            raise ValueError("pieces of user-defined or unused type are not supported")
        self.normal, self.byte, self.unknown = kinds.NORMAL, kinds.BYTE, kinds.UNKNOWN
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.end = self.library.eos_id()
        # without multi-character pieces that hold a line feed, it is a unit of its own
        lone = "" if any("\n" in p and len(p) > 1 for p in self.ids) else "\n"
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.units: Callable[[str], list[str]] = lambda text: [text]
        else:
            self.units = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|{lone}" if lone else "")).findall

    def split(self, text: str) -> list[str]:
        return self.units(MARK + text.replace(" ", MARK)) if text else []

    def encode_unit(self, unit: str) -> list[int]:
        """The best-scored pair of neighbours merges first, the leftmost of several; pairs that have changed meanwhile are stale."""
        if len(unit) <= SHORT:
            return self._told(self._merge_short(list(unit)))
        symbols: list[str] = list(unit)
        n, scores = len(symbols), self.scores
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-s, i, i + 1, 2) for i in range(n - 1) if (s := scores.get(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                if (s := scores.get(symbols[left] + symbols[following])) is not None:
                    heapq.heappush(agenda, (-s, left, following, size + len(symbols[following])))
            if (previous := before[left]) >= 0 and (s := scores.get(symbols[previous] + symbols[left])) is not None:
                heapq.heappush(agenda, (-s, previous, left, size + len(symbols[previous])))
        return self._told(symbols)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """As the agenda of encode_unit does; so few pairs that their scores are a list in the order of the text."""
        of, none = self.scores.get, float("-inf")
        scores = [of(a + b, none) for a, b in pairwise(symbols)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            symbols[i] += symbols.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = of(symbols[i - 1] + symbols[i], none)
            if i < len(scores):
                scores[i] = of(symbols[i] + symbols[i + 1], none)
        return symbols

    def _told(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for symbol in filter(None, symbols):
            if (found := self.ids.get(symbol)) is not None:
                out.append(found)
            else:
                out += [self.bytes[b] for b in symbol.encode()]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.split(text) for i in self.encode_unit(unit)]

    def decode_raw(self, ids: list[int]) -> str:
        """Pieces side by side, runs of byte pieces as UTF-8 (a byte that isn't becomes U+FFFD), marks as spaces; the dummy prefix stays."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == self.byte:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_each_bad_byte(bytes(run)))
                run.clear()
            if i >= 0 and self.kinds[i] == self.normal:
                out.append(self.pieces[i].replace(MARK, " "))
            elif i >= 0 and self.kinds[i] == self.unknown:
                out.append(" ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if text.startswith(" ") else text


def _each_bad_byte(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Memo(dict):
    """What has been made of texts of up to MEMO_CHARS characters. A full memo becomes the old one, and what is still in use comes back from it: frequent texts stay, and two memos of MEMO_BYTES are all there is."""

    def __init__(self, make: Callable[[str], str]) -> None:
        super().__init__()
        self.make, self.old, self.weight = make, {}, 0

    def __missing__(self, text: str) -> str:
        made = self.old.get(text)
        if made is None:
            made = self.make(text)
        if len(text) <= MEMO_CHARS:
            weight = 250 + len(text) + len(made)  # two strings and a place in the table
            if self.weight + weight > MEMO_BYTES:
                self.old, self.weight = dict(self), 0
                self.clear()
            self.weight += weight
            self[text] = made
        return made


class Encoder:
    """Texts to (number of ids, decimal ids joined by spaces, decoded text), with the end id last."""

    def __init__(self, path: str) -> None:
        self.model = MergeModel(path)
        self.coded = _Memo(lambda unit: "".join([f"{i} " for i in self.model.encode_unit(unit)]))
        model = self.model
        #: What a piece says by itself; byte pieces of other characters than ASCII are missing.
        self.plain = {str(i): "" if i == model.end else p.replace(MARK, " ") for i, p in enumerate(model.pieces) if model.kinds[i] == model.normal or i == model.end}
        self.plain |= {str(i): chr(b) for b, i in model.bytes.items() if b < 0x80}
        self.high = {str(i): b for b, i in model.bytes.items() if b >= 0x80}

    def decode(self, ids: list[str]) -> str:
        """As MergeModel.decode, for ids in decimal: only runs of bytes of one character are looked at one by one."""
        said = [*map(self.plain.get, ids), None]  # a last one ends the search
        at = said.index(None)
        while at < len(ids):
            end, run = at, bytearray()
            while end < len(ids) and said[end] is None:
                run.append(self.high[ids[end]])
                end += 1
            said[at:end] = [_each_bad_byte(bytes(run)), *[""] * (end - at - 1)]
            at = said.index(None, end)
        del said[-1]
        return "".join(said).removeprefix(" ")

    def __call__(self, text: str | None) -> tuple[int, str, str]:
        ids = "".join(map(self.coded.__getitem__, self.model.split(text or ""))) + str(self.model.end)
        own = ids.split()
        return len(own), ids, self.decode(own)

    def check(self, text: str, ids: str, decoded: str) -> None:
        own = [int(i) for i in ids.split()]
        if own != [*self.model.library.encode(text), self.model.end] or decoded != self.model.library.decode(own):
            raise ValueError(f"the library encodes or decodes this text in another way: {text[:200]!r}")


def encode_pieces(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: id, n_tokens (the end id included), ids (decimal, joined by one space), decoded.

    Null texts count as empty: only the end id. Texts of any length are encoded whole. Repeated rows and null ids stay; an
    empty table gives an empty result; other columns of `df`, whatever their names, are not read. `model` is a file of the
    sentencepiece library that all executors can open.
    """
    path = model or public_model()
    key = df.schema[id_col]
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
    if key.dataType.typeName() != "long":
        raise TypeError(f"{id_col} must be a long")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)

        def rows() -> Iterator[tuple]:
            for batch in it:
                checked = False
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py()
                    n, ids, decoded = encoder(text)
                    if text and (not checked or zlib.crc32(text.encode()) % CHECKED == 0):
                        encoder.check(text, ids, decoded)
                        checked = True
                    yield i, n, ids, decoded

        yield from batches(rows(), out, weigh=2)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, {SCHEMA}").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded, as digests."""
    return digests(encode_pieces(table(spark, sf_dir, "documents")))

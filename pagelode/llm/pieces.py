"""SentencePiece encoding and decoding of merge-type vocabularies, by backtracking.

The pieces of a merge-type model are the result of merging the adjacent pair with the
best score, the leftmost among equals, until no pair makes a piece. A sequence of pieces
is that result exactly if every two neighbours stay as they are when their joined text is
merged. So the encoder goes through the text once: an Aho-Corasick automaton gives the
longest piece at a position, a piece is taken if it fits the one before, a shorter one is
tried if not, and where none is left the position is marked in a bitfield as failed and
the piece before is taken back. Neighbours are tested by merging their text again; the
answers are kept, in bounded tables, as are the encodings of frequent words.

A text is cut where no piece can cross: before a run of blanks if no piece has a blank
after another character (a property that is read from the vocabulary), and around
characters that the vocabulary lacks, which become pieces of their UTF-8 bytes.

The model file is read by the library; encoding and decoding here use only its pieces,
scores and types. Models that change the text (other than writing blanks as ``▁`` and
adding one in front), other model types and own symbols are refused.

Defined cases: null counts as empty; an empty text has no ids; repeated rows are rows of
their own; texts of any length are encoded whole, and go through the hashes about
``PART`` characters at a time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Entries of a worker's tables of words and of neighbours, longest word kept, characters that are hashed at once.
WORDS, PAIRS, LONGEST_WORD, PART = 400_000, 800_000, 64, 1_000_000
_REPLACED = "�"
#: Texts whose ids show how the library normalises.
_PROBES = ("", " ", "a", " a  b ", "ｆｕｌｌ ﬁ ²", "éé", "\ttab\r\nline x　y", "▁ ▁", "​zero")


class Vocabulary:
    """Pieces of a merge-type model and the codec over them."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.scores = {self.pieces[i]: library.get_score(i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if library.is_byte(i)}
        self.unknown = library.unk_id()
        self._byte_of = {i: b for b, i in self.bytes.items()}
        self._texts = {i: p.replace(BLANK, " ") for p, i in self.ids.items()}
        self._silent = {i for i in range(n) if library.is_control(i)}
        self._fits: dict[tuple[str, str], bool] = {}
        self._words = _Kept(lambda w: self._told(BLANK + w), WORDS)  # with a blank in front
        self._stretches = _Kept(self._told, WORDS // 4)
        self._pieces_end = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if not any(BLANK in p.lstrip(BLANK) for p in self.ids) else None
        lacking = re.escape("".join(p for p in self.ids if len(p) == 1))
        self._lacking = re.compile(f"([^{lacking}])")
        # Pieces that their own text does not merge to never occur.
        self.automaton = ahocorasick.Automaton()
        real = {p for p in self.ids if self.merged(p) == [p]}
        for p in real:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self._shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in real), None) for p in real}
        for probe in _PROBES:
            if self.encode(probe) != library.encode(probe):
                raise ValueError(f"{path} is no plain merge-type model: it normalises or splits {probe!r} otherwise")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first, leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are next to each other."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text whose characters all are in the vocabulary."""
        taken: list[str] = []
        failed, at, end, known, shorter = bytearray(), 0, len(text), self._fits, self._shorter
        matches, expected = self.automaton.iter_long(text), 0  # goes on from match to match while the longest ones are taken
        piece, last = next(matches)[1], None
        expected = len(piece)
        while True:
            while piece is not None:
                if last is not None:
                    ok = known.get((last, piece))
                    if not (self.fits(last, piece) if ok is None else ok):
                        piece = shorter[piece]
                        continue
                if failed and _bit(failed, at + len(piece)):
                    piece = shorter[piece]
                    continue
                break
            if piece is not None:
                taken.append(piece)
                at += len(piece)
                if at == end:
                    return taken
                last = piece
                if at != expected:
                    matches = self.automaton.iter_long(text, at)
                piece = next(matches)[1]
                expected = at + len(piece)
            elif taken:
                failed = failed or bytearray((end >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
                piece, last = shorter[piece], taken[-1] if taken else None
                expected = -1
            else:
                raise ValueError("no sequence of pieces fits")

    def word_ids(self, word: str) -> list[int]:
        """Ids of a stretch that no piece crosses the ends of."""
        found: list[int] = []
        if not self._lacking.search(word):
            return [self.ids[p] for p in self.backtracked(word)]
        for no, part in enumerate(self._lacking.split(word)):
            if no % 2:
                found += [self.bytes.get(b, self.unknown) for b in part.encode()] if self.bytes else [self.unknown]
            elif part:
                found += [self.ids[p] for p in self.backtracked(part)]
        return found

    def words(self, text: str) -> list[str]:
        """The normalised text, cut where no piece crosses."""
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        return self._pieces_end.findall(text) if self._pieces_end else [text]

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in self.word_ids(w)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined to characters, each byte of what is none replaced, a blank that begins the first piece left out."""
        return "".join(self._decoded(ids, True))

    def _decoded(self, ids: list[int], first: bool) -> Iterator[str]:
        held = bytearray()
        for i in ids:
            if i in self._byte_of:
                held.append(self._byte_of[i])
                first = False
                continue
            if held:
                yield _characters(bytes(held))
                held.clear()
            if i == self.unknown:
                yield " ⁇ "
            elif i not in self._silent:
                piece = self.pieces[i]
                yield (piece.removeprefix(BLANK) if first else piece).replace(BLANK, " ")
            else:
                continue
            first = False
        if held:
            yield _characters(bytes(held))

    def _told(self, stretch: str) -> str:
        """Decimal ids of a stretch, joined by commas; what they decode to must be the stretch."""
        ids, texts = self.word_ids(stretch), self._texts
        try:
            text = "".join([texts[i] for i in ids])
        except KeyError:  # bytes
            text = "".join(self._decoded(ids, False))
        if self.bytes and text != stretch.replace(BLANK, " "):
            raise ValueError(f"{stretch!r} decodes to {text!r}")
        return ",".join(map(str, ids))

    def _told_parts(self, text: str) -> Iterator[tuple[str, str]]:
        """Decimal ids and decoded text, part by part.

        With byte pieces every stretch decodes to itself, which is verified when it enters a
        table, so the decoded text is put together from the stretches.
        """
        for no, part in enumerate(_parts(text)):
            body = part[1:] if no else part
            if self._pieces_end and self.bytes and body and not _spaced(body):  # blanks stand alone, between words
                words = body.split(" ")
                yield ",".join(map(self._words.__getitem__, words)), (" " if no else "") + " ".join(words)
                continue
            stretches = self.words(body)
            told = ",".join(map(self._stretches.__getitem__, stretches))
            if self.bytes:
                decoded = "".join(stretches).replace(BLANK, " ")
                yield told, decoded if no else decoded[1:]
            else:
                yield told, "".join(self._decoded(list(map(int, told.split(","))), not no))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and SHA-256 of what they decode to."""
        ids_hash, text_hash, n = sha256(), sha256(), 0
        for ids, decoded in self._told_parts(text):
            ids_hash.update(("," + ids if n else ids).encode())
            text_hash.update(decoded.encode())
            n += ids.count(",") + 1
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


class _Kept(dict):
    """Values that are made once and kept for about the ``most`` to twice the ``most`` keys used last."""

    def __init__(self, make: Callable[[str], str], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> str:
        value = self.older.get(key) or self.make(key)
        if len(key) <= LONGEST_WORD:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _bit(field: bytearray, at: int) -> int:
    return field[at >> 3] >> (at & 7) & 1


def _characters(data: bytes) -> str:
    """UTF-8, every byte that is no part of a character replaced."""
    found, at = [], 0
    while at < len(data):
        try:
            found.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            found += [data[at : at + e.start].decode(), _REPLACED]
            at += e.start + 1
    return "".join(found)


def _parts(text: str, most: int = PART) -> Iterator[str]:
    """The text in parts that begin with a blank after something else, but for the first."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + most) if len(text) - at > most else None
        end = cut.start() + 1 if cut else len(text)
        yield text[at:end]
        at = end


def _spaced(text: str) -> bool:
    """Whether a blank stands at an end or next to another, or the blank's own sign occurs."""
    return text[0] == " " or text[-1] == " " or "  " in text or BLANK in text


_CUT = re.compile(f"[^ {BLANK}](?= )")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker."""
    return Vocabulary(path)


def _model(path: str | None) -> Callable[[], Vocabulary]:
    def load() -> Vocabulary:
        import public_tokenizers

        return vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))

    return load


def with_ids(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of a text column as an array."""
    load = _model(model)

    @F.udf(returnType="array<int>", useArrow=True)
    def encode(value: str | None) -> list[int]:
        return load().encode(value)

    return docs.withColumn(ids, encode(F.col(text)))


def with_text(rows: DataFrame, model: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of an array column of ids; null has none."""
    load = _model(model)

    @F.udf(returnType="string", useArrow=True)
    def decode(value: list[int] | None) -> str | None:
        return None if value is None else load().decode(list(value))

    return rows.withColumn(text, decode(F.col(ids)))


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    load = _model(model)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = load()
        for batch in batches:
            rows = [found.digests(x.as_py() or "") for x in batch.column(1)]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    key = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(digests, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Exact SentencePiece BPE encoding and decoding.

A text is cut where no piece of the vocabulary can reach across: before a run of the space mark
that follows another character, and between marks and letters that no piece joins. Each distinct segment is encoded once for a worker by backtracking:
one Aho-Corasick scan lists the pieces that start at each character; the longest that agrees with its
left neighbour is taken; two neighbours agree if merging their joint text anew yields just these two;
a position from which no way leads on is marked in a bitfield and never tried again.

Characters without a piece stand for themselves until the end and become byte pieces. The vocabulary
is read from the model file through the library; encoding and decoding are done here.

Defined results: a null text is encoded as the empty text (the end id alone); null ids decode to the
empty text; repeated rows give equal results; other columns are kept, and a column with an output's
name is replaced; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import tidy

SPACE = "▁"
ROWS = 200
LETTERS = "A-Za-z\u00c0-\u024f"
KEPT, KEPT_CHARS, KEPT_PAIRS = 120_000, 48, 300_000  # what a worker remembers; only speed and memory depend on it


class Pieces:
    """The vocabulary of a model file and the two directions over it."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.bytes = {i: int(self.texts[i][3:5], 16) for i in special if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.silent = special - set(self.bytes)
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.ids = {t: i for i, t in enumerate(self.texts) if i not in special}
        self.scores = {t: model.get_score(i) for t, i in self.ids.items()}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece reaches across words; segments can't be cut there")
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.last = np.array([self.end], np.int32).tobytes()
        self.pairs: dict[tuple[str, str], bool] = {}
        marks = "".join(map(re.escape, self.apart()))
        clean = f"{SPACE}*[{LETTERS}]++(?=[{marks}{SPACE}]|$)|{SPACE}*[{marks}]++(?=[{LETTERS}{SPACE}]|$)|" if marks else ""
        self.segments = re.compile(f"{clean}{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.plain = [t.replace(SPACE, " ") for t in self.texts]

    def apart(self) -> list[str]:
        """ASCII marks and digits that no piece has next to one of LETTERS."""
        pairs = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        letter = re.compile(f"[{LETTERS}]").match
        joined = {x for a, b in pairs for x, y in ((a, b), (b, a)) if letter(y)}
        return [c for c in map(chr, range(128)) if not c.isalpha() and c not in joined]

    def merge(self, text: str) -> list[str]:
        """Merge by the definition: always the adjacent pair of the best score, the leftmost first."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, left: str, right: str) -> bool:
        """Whether merging two pieces' joint text anew yields just these two; remembered."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return found

    def split(self, segment: str) -> list[str]:
        """The pieces of a segment by backtracking."""
        pairs, n = self.pairs, len(segment)
        longest = [piece for _, piece in self.automaton.iter_long(segment)]
        if sum(map(len, longest)) == n:  # where the longest matches all agree, nothing is tried twice
            for left, piece in zip(longest, longest[1:]):
                fits = pairs.get((left, piece))
                if fits is None:
                    fits = self.agree(left, piece)
                if not fits:
                    break
            else:
                return longest
        starts: list[list[str]] = [[c] for c in segment]  # the pieces from here, shortest first
        for last, piece in self.automaton.iter(segment):
            if len(piece) > 1:
                starts[last - len(piece) + 1].append(piece)
        failed = bytearray(n + 1)
        taken: list[tuple[int, int, str]] = []  # (start, index into starts[start], piece)
        at, left = 0, ""
        choice = len(starts[0]) - 1
        while at < n:
            options = starts[at]
            while choice >= 0:
                piece = options[choice]
                if not failed[at + len(piece)]:
                    fits = pairs.get((left, piece)) if left else True
                    if fits is None:
                        fits = self.agree(left, piece)
                    if fits:
                        break
                choice -= 1
            if choice >= 0:
                taken.append((at, choice, piece))
                at, left = at + len(piece), piece
                choice = len(starts[at]) - 1 if at < n else 0
            else:
                if not taken:
                    raise AssertionError(f"no encoding for {segment[:50]!r}")
                failed[at] = 1
                at, choice, _ = taken.pop()
                left = taken[-1][2] if taken else ""
                choice -= 1
        return [piece for _, _, piece in taken]

    def encode_segment(self, segment: str) -> bytes:
        """The ids of a segment, four bytes each."""
        out: list[int] = []
        for piece in self.split(segment):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text, the end id last."""
        out: list[bytes] = []
        if text:
            known = self.known
            for segment in self.segments(SPACE + text.replace(" ", SPACE)):
                ids = known.get(segment)
                if ids is None:
                    ids = self.older.get(segment) or self.encode_segment(segment)
                    if len(segment) <= KEPT_CHARS:
                        if len(known) >= KEPT:  # what isn't asked for during a generation goes
                            self.older, self.known = known, (known := {})
                        known[segment] = ids
                out.append(ids)
        out.append(self.last)
        return np.frombuffer(b"".join(out), np.int32)

    def forget(self) -> None:
        """Drop what is remembered, so that a worker that goes on to other work holds the vocabulary alone."""
        self.known, self.older = {}, {}
        self.pairs.clear()

    def decode(self, ids) -> str:
        if ids is None or not len(ids):
            return ""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        plain, special, out = self.plain, self.bytes, []
        if self.silent.isdisjoint(ids[:-1]) and special.keys().isdisjoint(ids):
            text = "".join([plain[i] for i in (ids[:-1] if ids[-1] in self.silent else ids)])
        else:
            run = bytearray()
            for i in ids:
                if i in special:
                    run.append(special[i])
                    continue
                if run:
                    out.append(run.decode(errors="replace"))
                    run = bytearray()
                if i == self.unknown:
                    out.append(" ⁇ ")
                elif i not in self.silent:
                    out.append(plain[i])
            if run:
                out.append(run.decode(errors="replace"))
            text = "".join(out)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in special and self.texts[first].startswith(SPACE) else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One vocabulary for a Python worker."""
    return Pieces(path)


def code(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a text's ids, the end id last, and the text decoded from these ids.

    Batches are worked off a few rows at a time, so that a task holds few results beside its batch.
    """
    at = docs.columns.index(text)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    places = [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                made = [vocabulary.encode(x) for x in part.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
                coded = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))
                back = pa.array([vocabulary.decode(x) for x in made], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), coded, back], [*kept, ids, decoded])
        vocabulary.forget()

    return docs.mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, model: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text, the end id last."""

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        vocabulary = pieces(model)
        return pd.Series([vocabulary.encode(x) for x in texts], dtype=object)

    return docs.withColumn(to, encoded(F.col(text)))


def decode(docs: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for."""

    @F.pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        vocabulary = pieces(model)
        return pd.Series([vocabulary.decode(x) for x in rows], dtype=object)

    return docs.withColumn(to, decoded(F.col(ids)))

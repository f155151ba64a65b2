"""Stretches of text that tokenizers never join: numbered, so that each is worked on once.

Texts are cut before single spaces between visible characters. No pretoken of a
byte-level BPE and no piece of a word-piece BPE crosses such a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A single space between visible characters: the only places where stretches begin.
CUT = regex.compile(r"(?<=\S) (?=\S)")


class Stretches:
    """Numbers of the stretches of texts; ``texts`` holds them by number.

    The stretches of an ordinary text lie between its spaces, and Arrow finds and folds
    them. Texts with other white space beside a space, or with a special token, are cut
    one by one.
    """

    def __init__(self, special: regex.Pattern | None = None, names: tuple[str, ...] = ()) -> None:
        self.special, self.names = special, names
        self.forget()

    def forget(self) -> None:
        self.texts: list[str | tuple[str, str]] = []
        self.lone: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.marks: dict[tuple[str, str], int] = {}
        self.odd = np.zeros(0, bool)

    def _number(self, known: dict, key, text) -> int:
        k = known.get(key)
        if k is None:
            k = known[key] = len(self.texts)
            self.texts.append(text)
        return k

    def _odd(self) -> np.ndarray:
        """Which stretches are empty, or have white space at an end that the cut would have to look at."""
        fresh = self.texts[len(self.odd) :]
        if fresh:
            new = [not isinstance(t, tuple) and ((bare := t[1:] if t[:1] == " " else t) == "" or bare[0].isspace() or bare[-1].isspace()) for t in fresh]
            self.odd = np.concatenate((self.odd, np.array(new, bool)))
        return self.odd

    def _by_hand(self, text: str) -> list[int]:
        row: list[int] = []
        tail = ""
        for part in self.special.split(text) if self.special is not None else [text]:
            if part in self.names:  # what is not yet the whole special token belongs to the stretch before it
                row.append(self._number(self.marks, (tail, part), (tail, part)))
                tail = ""
            elif part:
                first, *rest = CUT.split(part)
                row.append(self._number(self.lone, first, first))
                row.extend(self._number(self.spaced, x, " " + x) for x in rest)
                tail = self.texts[row[-1]]
        return row

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts' stretches, how many each text has); an empty or null text has none."""
        column = pc.fill_null(column, "")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        pieces = pc.split_pattern(column.cast(pa.large_string()), " ")
        edge = np.asarray(pieces.offsets)
        edge, flat = edge - edge[0], pieces.flatten()
        folded = flat.dictionary_encode()
        spaced = [self._number(self.spaced, x, " " + x) for x in folded.dictionary.to_pylist()]
        units = np.array(spaced, np.int64)[np.asarray(folded.indices)] if len(spaced) else np.zeros(0, np.int64)
        firsts = edge[:-1]
        units[firsts] = [self._number(self.lone, x, x) for x in flat.take(pa.array(firsts)).to_pylist()]
        per = np.diff(edge)
        hand = np.logical_or.reduceat(self._odd()[units], firsts) if len(firsts) else np.zeros(0, bool)
        for name in self.names:
            hand |= np.asarray(pc.match_substring(column, name))
        if not hand.any():
            return units, per
        rows = np.split(units, edge[1:-1])
        for k in np.flatnonzero(hand).tolist():
            rows[k] = np.array(self._by_hand(column[k].as_py()), np.int64)
        self._odd()
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

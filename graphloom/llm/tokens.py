"""Whole texts to token ids, each distinct stretch between spaces encoded once for many texts."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of texts whose stretches are told apart together, and stretches whose ids are gathered together.
STEP_BYTES, _GATHERED = 32_000_000, 500_000
#: White space other than a blank or a line feed; texts with any of it are left to the tokenizer as they are.
_RARE_SPACES = r"[\t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = r"[ \n][ \n]|\A[ \n]"
#: Letters whose lower case depends on more than the letter.
_CASED = "\u03a3\u0130"
#: Letters that need no normalisation, in both cases and in lower case only.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LOWER = "a-z\u00df-\u00f6\u00f8-\u00ff"


@lru_cache(maxsize=4)
def spaced_encoder(path: str, blank_belongs: bool) -> SpacedEncoder:
    """This worker's encoder for a vocabulary; it keeps nothing of the texts."""
    return SpacedEncoder(path, blank_belongs)


class SpacedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Pre-tokens end before every blank or line feed that follows something else,
    so where white space comes one at a time a text's ids are those of its
    stretches, one after the other. Arrow finds the distinct stretches of many
    texts, and each is encoded once. Stretches of letters are one pre-token each
    and go to the tokenizer's model as words of one text, which their ids tell
    apart; a comma or point after letters is a pre-token of its own. Other
    stretches go to the tokenizer with a lone tilde between them, or with the
    line feed they begin with, whose id parts them; what holds a tilde goes alone.
    ``blank_belongs`` says that a blank is part of the stretch it opens and a
    line feed a token (byte-level vocabularies); otherwise white space has no ids
    and the tokenizer lower-cases letters.
    """

    def __init__(self, path: str, blank_belongs: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.blank_belongs = blank_belongs
        letters = _LETTERS if blank_belongs else _LOWER
        self.word, self.parted = f"^[{letters}]+$", f"^[{letters}]+[,.]$"
        self.whole = f"{_RARE_SPACES}|{_RUNS}" if blank_belongs else _RARE_SPACES
        (self.mark_id,) = self._ids(" ~")
        self.line_id = self._ids("\n")[0] if blank_belongs else -1
        self.point_ids = {mark: self._ids(mark)[0] for mark in ",."}
        # byte-level vocabularies write each byte as a printable character
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.printable = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(128) if b != 32}
        for lead, low, high in ((0xC2, 0x80, 0xC0), (0xC3, 0x80, 0xC0)):
            for b in range(low, high):
                written = level.pre_tokenize_str(bytes([lead, b]).decode())[0][0]
                self.printable[lead], self.printable[b] = written
        for b in range(0xC4, 0xCA):
            self.printable[b] = level.pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0]
        self.blank = level.pre_tokenize_str(" ")[0][0]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith(self.blank) if blank_belongs else token.endswith("</w>")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets

    def _alone(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    @staticmethod
    def _steps(items: list[str], count: int = 4_000) -> Iterator[list[str]]:
        return (items[at : at + count] for at in range(0, len(items), count))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of plain letters, one after the other, and how many each has."""
        found = []
        for some in self._steps(words):
            text = (" " + " ".join(some)).encode().decode("latin-1").translate(self.printable)
            if self.blank_belongs:
                text = text.replace(" ", " " + self.blank)
            found.append(np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate([np.empty(0, "<u4"), *found])
        at = np.flatnonzero(self.opens[ids])
        sizes = np.diff(np.r_[at, len(ids)]) if self.blank_belongs else np.diff(np.r_[-1, at])
        return ids, self._agreed(sizes, words)

    @staticmethod
    def _agreed(sizes: np.ndarray, stretches: list[str]) -> np.ndarray:
        if len(sizes) != len(stretches):
            raise RuntimeError("stretches and ids do not agree")
        return sizes

    def _marked(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of other stretches after a blank; their ids are followed by the mark's, which counts to none of them."""
        ids = np.concatenate([np.empty(0, "<u4"), *[np.array(self._ids("".join([f" {x} ~" for x in some])), "<u4") for some in self._steps(stretches)]])
        marks = ids == self.mark_id
        sizes = np.diff(np.r_[-1, np.flatnonzero(marks)]) - 1
        return ids[~marks], self._agreed(sizes, stretches)

    def _lines(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of stretches that begin with a line feed."""
        ids = np.concatenate([np.empty(0, "<u4"), *[np.array(self._ids("".join(some)), "<u4") for some in self._steps(stretches)]])
        return ids, self._agreed(np.diff(np.r_[np.flatnonzero(ids == self.line_id), len(ids)]), stretches)

    def _distinct(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids; and of each stretch its start in the pool, its number of ids there, and the id of its last point or comma, if it is set apart."""
        n = len(stretches)
        starts, sizes, points = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        word, parted = (pc.match_substring_regex(stretches, p).to_numpy(zero_copy_only=False) for p in (self.word, self.parted))
        at_word, at_parted = np.flatnonzero(word), np.flatnonzero(parted)
        ended = stretches.take(pa.array(at_parted))
        bodies = pa.concat_arrays([stretches.take(pa.array(at_word)), pc.utf8_slice_codeunits(ended, 0, -1)]).dictionary_encode()
        of = bodies.indices.to_numpy()
        pool = [self._words(bodies.dictionary.to_pylist())]
        where = np.cumsum(pool[0][1]) - pool[0][1]
        both = np.r_[at_word, at_parted]
        starts[both], sizes[both] = where[of], pool[0][1][of]
        comma = pc.ends_with(ended, ",").to_numpy(zero_copy_only=False)
        points[at_parted] = np.where(comma, self.point_ids[","], self.point_ids["."]) + 1  # 0: none
        others = np.flatnonzero(~(word | parted))
        listed = stretches.take(pa.array(others)).to_pylist()
        kinds = np.array([0 if "~" in x or len(x) < 1 + (x[:1] == "\n") else 2 if x[0] == "\n" else 1 for x in listed], np.int64)
        used = len(pool[0][0])
        for kind, encode in enumerate((self._singles, self._marked, self._lines)):
            mine = np.flatnonzero(kinds == kind)
            ids, own = encode([listed[k] for k in mine])
            starts[others[mine]], sizes[others[mine]] = used + np.cumsum(own) - own, own
            pool.append((ids, own))
            used += len(ids)
        return np.concatenate([*[p[0] for p in pool], np.zeros(1, "<u4")]), starts, sizes, points

    def _singles(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.frombuffer(self._alone(x if x[:1] == "\n" else " " + x), "<u4") for x in stretches]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)

    def _spaced(self, text: str) -> str:
        """The text with one blank before every stretch but the first."""
        if self.blank_belongs:
            return f"\n{text}".replace("\n", " \n")[1:]
        text = text.replace("\n", " ")
        return text if any(c in text for c in _CASED) else text.lower()

    def _cut(self, texts: list[str | None]) -> tuple[dict[int, str], pa.Array]:
        """Texts that are left to the tokenizer, by place, and the stretches of all others."""
        left = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.whole)
        apart = {k: texts[k] for k in np.flatnonzero(pc.fill_null(left, False).to_numpy(zero_copy_only=False)).tolist()}
        return apart, pc.split_pattern(pa.array([None if not t or k in apart else self._spaced(t) for k, t in enumerate(texts)], pa.large_string()), " ")

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        apart, cut = self._cut(texts)
        found = cut.flatten().dictionary_encode()
        _, _, sizes, points = self._distinct(found.dictionary)
        ends = np.r_[0, np.cumsum((sizes + (points > 0))[found.indices.to_numpy()])]
        stretches = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.cumsum(stretches, dtype=np.int64)]
        out = ends[bounds[1:]] - ends[bounds[:-1]] - int(self.blank_belongs) * (stretches > 0)  # less the line feed put before the text
        for k, text in apart.items():
            out[k] = len(self._ids(text))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        left, cut = self._cut(texts)
        apart = {k: self._alone(t) for k, t in left.items()}
        found = cut.flatten().dictionary_encode()
        pool, starts, sizes, points = self._distinct(found.dictionary)
        at = found.indices.to_numpy()
        sizes = sizes + (points > 0)
        counts = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
        bounds, first, out, k = np.r_[0, np.cumsum(counts, dtype=np.int64)], int(self.blank_belongs), [], 0
        while k < len(texts):  # ids are gathered for some texts at a time
            stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + _GATHERED, side="right")) - 1)
            some = at[bounds[k] : bounds[stop]]
            own, last = sizes[some], points[some]
            ends = np.cumsum(own)
            data = pool[np.repeat(starts[some] - ends + own, own) + np.arange(int(ends[-1]) if len(ends) else 0)]
            marked = np.flatnonzero(last)
            data[ends[marked] - 1] = last[marked] - 1
            data = data.tobytes()
            cuts = (4 * np.r_[0, ends][bounds[k : stop + 1] - bounds[k]]).tolist()
            for j in range(k, stop):  # less the line feed put before the text
                out.append(apart[j] if j in apart else data[cuts[j - k] + 4 * first : cuts[j - k + 1]] if texts[j] else b"")
            k = stop
        return out

"""Byte-pair tokens of a public tokenizer file, in the two ways the operators need them.

:class:`MergeCounter` counts tokens without making ids.  :class:`IdCache` makes
ids with the tokenizers library.  Both work word by word and remember words:
the file's pre-tokenizer drops white space, so no token and no rule reaches
across it, and a text's tokens are those of its words, one after the other.
"""

from __future__ import annotations

import heapq
import json
import os
import string
import unicodedata
from collections.abc import Iterable

import regex

REMEMBERED = 400_000
LONGEST_REMEMBERED = 40
MARKS = "".join(c for c in string.punctuation if c != "'")  # with an apostrophe some letters are a piece
SPECIAL_CASE = {"Σ", "İ"}  # lower-cased in more than one way


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def words(text: str) -> list[str]:
    """The parts between white space.  ``str.split`` also splits at four control characters; they are no white space here."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [w for w in regex.split(r"\s+", text) if w]
    return text.split()


class Recent(dict):
    """A dict of bounded size: entries unused for a whole generation are forgotten."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, word):
        value = self.before.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the file: itself, or the next free one above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        if b in shown:
            letters.append(chr(b))
        else:
            letters.append(chr(free))
            free += 1
    return letters


class MergeCounter:
    """Number of tokens of a text by heap-and-linked-list byte-pair merging.

    A word starts as its bytes, the last one marked as the word's end.  The
    adjacent pair of lowest rank, leftmost among equals, is merged until no pair
    has a rank.  The count is the number of bytes less the number of merges.
    """

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ", 1)): r for r, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.pieces = Recent(self.merged)
        self.whole = Recent(self.of_word)

    def count(self, text: str) -> int:
        return sum(map(self.whole.__getitem__, words(text)))

    def of_word(self, word: str) -> int:
        """Tokens of a part without white space; special strings inside count one each."""
        if "<" not in word:
            return self.of_plain(word)
        return len(self.special.findall(word)) + sum(map(self.of_plain, self.special.split(word)))

    def of_plain(self, word: str) -> int:
        word = unicodedata.normalize("NFC", word)
        # lower-cased letter by letter: str.lower() would pick the final sigma by its neighbours
        low = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)
        return sum(map(self.pieces.__getitem__, self.piece.findall(low)))

    def merged(self, piece: str) -> int:
        symbols = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        n = len(symbols)
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None:
                heap.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = left + right, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((symbols[i], symbols[k]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get((symbols[h], symbols[i]))
                if rank is not None:
                    heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
        return n - merges


class IdCache:
    """Token ids of texts as little-endian unsigned 32-bit bytes, new words tokenized together.

    Most words are letters with some marks behind.  The letters are a piece of
    their own to the file's pre-tokenizer, whatever stands behind them, so they are
    looked up in lower case and without the marks, and new ones are joined to one
    text: each gives ids up to the next token that ends a word.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(tokenizer_json)["model"]
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {"": b""}

    def _ids(self, parts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are lower-case letters only."""
        import numpy as np

        if not pieces:
            return []
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(pieces):
            return self._ids(pieces)
        held, ends = ids.tobytes(), ends.tolist()
        return [held[a:b] for a, b in zip([0, *ends], ends)]

    def ids_of(self, new: list[str]) -> list[bytes]:
        """Ids of words, which are not remembered as a whole."""
        if len(self.letters) > REMEMBERED:
            self.letters = {"": b""}
        letters, cores, marks, whole, fresh = self.letters, [], [], [], {}
        for word in new:
            core, mark = word, ""
            if not word.isalpha():
                core = word.rstrip(MARKS)
                mark = word[len(core) :]
                if not core.isalpha():
                    core = None
            if core is not None and (word.isascii() or (unicodedata.is_normalized("NFC", word) and SPECIAL_CASE.isdisjoint(word))):
                core = core.lower()
                if core not in letters:
                    fresh[core] = None
            else:
                core, mark = None, ""
                whole.append(word)
            cores.append(core)
            marks.append(mark)
        pieces = list(fresh)
        letters.update(zip(pieces, self._joined(pieces)))
        ends = list(set(marks).difference(letters))
        letters.update(zip(ends, self._ids(ends)))
        others = iter(self._ids(whole))
        found = [next(others) if c is None else letters[c] + letters[m] if m else letters[c] for c, m in zip(cores, marks)]
        for long in [x for x in (*pieces, *ends) if len(x) > LONGEST_REMEMBERED]:
            del letters[long]
        return found

    def _learn(self, new: Iterable[str]) -> dict[str, bytes]:
        new = list(new)
        return dict(zip(new, self.ids_of(new)))

    def batch(self, batch: list[str]) -> list[bytes]:
        """Words are kept for the next batches, long ones are not; those unused for a generation are forgotten."""
        split = [words(text) for text in batch]
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known = self.known
        new = set().union(*split).difference(known)
        again = new & self.before.keys()
        known.update((word, self.before[word]) for word in again)
        new -= again  # not the words known: Python would go through all of these
        known.update(self._learn(new))
        found = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for word in [w for w in new if len(w) > LONGEST_REMEMBERED]:
            del known[word]
        return found

"""Tables of distinct chunks: a tokenizer runs once on each distinct chunk, ids are joined back by position.

A chunk is a stretch of text over whose edges no token reaches, so that ids of the chunks, one after the other, are the ids
of the text. Tables live in a Python worker for as long as it does and are emptied at a fixed number of entries, which
bounds memory; what they hold never changes a result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

import numpy as np

from .common import KEPT

ENTRIES = 400_000
LATIN = "\u024f"


class PieceTable:
    """SentencePiece models none of whose pieces holds a whitespace marker after another character.

    Chunks are a run of markers and what follows up to the next one. The dummy prefix is the first chunk's marker.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        if m.encode(" a") == m.encode("a") or m.encode("a  b") == m.encode("a b") or m.encode("a")[0] == m.piece_to_id("a"):
            raise ValueError("a model with a dummy prefix that keeps all white space is needed")
        self.edge = next(i for i, p in enumerate(pieces) if p == "a")
        self.begin, self.end = (int(x).to_bytes(4, "little") for x in (m.bos_id(), m.eos_id()))
        self.table: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # chunks that are decoded to something else

    def _learn(self, new: list[str]) -> None:
        ids = [x or [self.model.piece_to_id("▁")] for x in self.model.encode(new, num_threads=1)]
        out = self.model.decode([[self.edge, *x] for x in ids], num_threads=1)
        flat = np.fromiter((i for x in ids for i in x), "<u4").tobytes()
        at = 0
        for part, x, text in zip(new, ids, out, strict=True):
            self.table[part] = flat[at : (at := at + 4 * len(x))]
            if text[2:] != part or text[1:2] != " ":
                self.odd[part] = text[1:]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, begin and end included, and the decoded text."""
        table = self.table
        if len(table) > ENTRIES:
            table.clear()
            self.odd.clear()
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif "  " in text or "▁" in text or text[0] == " ":
                marked = "▁" + text.replace(" ", "▁")
                split.append([x[1:].replace("▁", " ") for x in re.findall("▁+[^▁]*", marked)])
            else:
                split.append(text.split(" "))
        if new := list(set().union(*split).difference(table)):
            self._learn(new)
        result = []
        for text, parts in zip(texts, split, strict=True):
            ids = b"".join([self.begin, *map(table.__getitem__, parts), self.end])
            if self.odd and not self.odd.keys().isdisjoint(parts):
                text = "".join([self.odd.get(p, " " + p) for p in parts]).removeprefix(" ")
            elif "▁" in text:
                text = text.replace("▁", " ")
            result.append((ids, text))
        return result


class BytePairTable:
    """The byte-level BPE of a tokenizers file. Chunks begin at a space after a character that isn't white space.

    The file's merges as ranks, run by tiktoken, give the same ids; chunks beyond Latin letters, where tables of character
    classes may be of another Unicode version, and texts that hold a special token go to the tokenizers library itself.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.later: dict[str, bytes] = {}
        self.breaks = re.compile(r"\s ")
        self.sizes = np.array([len(k) for k, _ in sorted(ranks.items(), key=lambda x: x[1])], np.int64)
        self.ranks = np.array(sorted(ranks.values()), np.int64)

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode chunks in one run and cut its ids where chunks end."""
        joined = "".join([" " + p for p in new])
        if max(joined) > LATIN:
            for p in new:
                if max(p, default="") > LATIN:
                    self.later[p] = self._slow(" " + p)
            new = [p for p in new if max(p, default="") <= LATIN]
            joined = "".join([" " + p for p in new])
        ids = np.array(self.fast.encode_ordinary(joined), "<u4")
        ends = np.cumsum(self.sizes[np.searchsorted(self.ranks, ids)])
        cuts = np.searchsorted(ends, np.cumsum(np.array([len(p.encode()) + 1 for p in new], np.int64)), "left") + 1
        flat, at = ids.tobytes(), 0
        for p, stop in zip(new, (4 * cuts).tolist(), strict=True):
            self.later[p] = flat[at:stop]
            at = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers, without special tokens of the library's own."""
        later = self.later
        if len(later) > ENTRIES:
            later.clear()
        split: list[list[str] | None] = []
        for text in texts:
            plain = not self.breaks.search(text) and not any(s in text for s in self.special)
            split.append(text.split(" ") if plain else None)
        if new := list(set().union(*[parts[1:] for parts in split if parts]).difference(later)):
            self._learn(new)
        result = []
        for text, parts in zip(texts, split, strict=True):
            if parts is None:
                result.append(self._slow(text))
            else:
                first = parts[0]
                head = np.array(self.fast.encode_ordinary(first), "<u4").tobytes() if max(first, default="") <= LATIN else self._slow(first)
                result.append(b"".join([head, *map(later.__getitem__, parts[1:])]))
        return result


def table(kind, *args):
    """This worker's table of a kind for these files."""
    if (kind, args) not in KEPT:
        KEPT[kind, args] = kind(*args)
    return KEPT[kind, args]


def groups(texts: list[str | None], most: int = 1_000_000) -> Iterable[tuple[int, list[str]]]:
    """Runs of texts of about that many characters, each with the place of its first; null is empty."""
    begin, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > most:
            yield begin, run
            begin, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield begin, run

"""Ids of public tokenizers for whole texts."""

import re
from array import array
from collections.abc import Iterator

import numpy as np

from sourcemart.llm.common import runs

MOST_BYTES = 16 << 20   # kept entries of a worker, estimated
MOST_WORDS = 1 << 19    # short words kept in arrays
TOGETHER = 1 << 19      # characters of texts whose words are looked up together
LONG_KEY = 64           # characters; longer keys are not kept


class Kept(dict):
    """What ``make`` gives for keys, made once while it is kept. Of bounded size: entries not asked for since it was last
    half full are the ones that go."""

    def __init__(self, make, most: int = MOST_BYTES):
        super().__init__()
        self.make, self.most, self.held, self.old = make, most, 0, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_KEY:
            self[key] = value
            self.held += 220 + 2 * len(key)
            if 2 * self.held > self.most:
                self.old = dict(self)
                self.clear()
                self.held = 0
        return value

    def forget(self) -> None:
        self.clear()
        self.held, self.old = 0, {}


class ShortWords:
    """Ids of words of up to eight UTF-8 bytes, which are their own keys, in sorted arrays of bounded size: those not asked for
    since the arrays were last full are the ones that go."""

    def __init__(self, make, most: int = MOST_WORDS):
        self.make, self.most = make, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used, self.ids = np.empty(0, bool), np.empty(0, "<u4")

    def trim(self) -> None:
        stay = np.flatnonzero(self.used)
        if 2 * len(stay) > self.most:
            stay = stay[:0]
        size = self.size[stay]
        first = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.first[stay] - first, size) + np.arange(int(size.sum()))]
        self.keys, self.first, self.size, self.used = self.keys[stay], first, size, np.zeros(len(stay), dtype=bool)

    def find(self, keys: np.ndarray, wanted: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """((first, number), ids) for sorted keys; none for those not wanted."""
        if len(self.keys) > self.most:
            self.trim()
        at = np.searchsorted(self.keys, keys)
        new = wanted.copy()
        inside = np.flatnonzero(at < len(self.keys))
        new[inside] &= self.keys[at[inside]] != keys[inside]
        if new.any():
            made = [self.make(word.rstrip(b"\0").decode()) for word in keys[new].astype("<u8").view("S8").tolist()]
            size = np.array([len(ids) // 4 for ids in made], dtype=np.int64)
            self.first = np.insert(self.first, at[new], len(self.ids) + np.cumsum(size) - size)
            self.keys, self.size = np.insert(self.keys, at[new], keys[new]), np.insert(self.size, at[new], size)
            self.used = np.insert(self.used, at[new], False)
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), dtype="<u4")])
            at = np.searchsorted(self.keys, keys)
        first, size = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        first[wanted], size[wanted] = self.first[at[wanted]], self.size[at[wanted]]
        self.used[at[wanted & ~new]] = True
        return (first, size), self.ids


# ---- byte-level BPE and sentence pieces side by side ----------------------------------------------------------------

class TwoCodecs:
    """Ids by a byte-level BPE (of space + text) and by a sentence-piece BPE (of text, to which it adds the space)."""

    def __init__(self, bpe="byte_bpe_50k.tiktoken", pieces="piece_bpe_32k.model"):
        import base64
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(public_tokenizers.path(bpe), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece_bytes(i) for i in range(self.model.get_piece_size())]
        self.size_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(A, B) of a text; both empty where the bytes of either differ from space + text."""
        none = np.empty(0, dtype=np.int32)
        if not text:
            return none, none
        a, b = self.bpe(" " + text), self.model.encode(text)
        plain = b" " + text.encode()
        # The byte-level BPE spells any text; sentence pieces spell some (U+2581 itself) as others.
        if b"".join([self.bytes_b[i] for i in b]) != plain:
            return none, none
        a = np.array(a, dtype=np.int32)
        return (a, np.array(b, dtype=np.int32)) if int(self.size_a[a].sum()) == len(plain) else (none, none)


# ---- lower-case BPE with word ends ----------------------------------------------------------------------------------

class WordCodec:
    """Ids of ``tokenizers`` for a vocabulary that lowers case, drops white space and splits words from other signs.

    Texts of Latin letters, digits and ASCII signs are split here, many at once and as by the tokenizer's pattern, so that only
    new words reach its merges; others, and those that hold special tokens, go through the tokenizer as they are.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # Letters here have no other composed form and become one letter of at most two bytes each in lower case, as in the
    # tokenizer; all of them from ß on are letters but ÷.
    PLAIN, LETTERS, NUMBERS = r"[ \n\x21-\x7E¡-¬®-įı-ȹȻ-Ƚȿ-ɏ]*", "a-zªµºß-öø-ʯ", "0-9²³¹¼-¾"

    def __init__(self, name="word_bpe_49k.json"):
        import json
        import public_tokenizers
        from tokenizers import Tokenizer
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.special = [t["content"] for t in made["added_tokens"]]
        known = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == self.PATTERN
        self.plain = re.compile(self.PLAIN if known else "").fullmatch
        self.merge = self.tokenizer.model.tokenize
        self.letters = self._byte_letters()
        self.known = Kept(self._word, 2 * MOST_BYTES)
        kind = [[self.kind(chr(c)) for c in range(a, b)] for a, b in ((0, 0x80), (0, 0x800))]
        self.kinds, self.wide = np.array(kind[0] + [0] * 0x80, dtype=np.uint8), np.array(kind[1], dtype=np.uint8)
        self.short = ShortWords(self._word)

    @staticmethod
    def _byte_letters() -> list[str]:
        """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    def _word(self, word: str) -> bytes:
        raw = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.merge(raw)]).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        return self._together([text])[0]

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; a word is asked for once in a run of texts."""
        for a, b in runs(texts, TOGETHER):
            yield from self._together(texts[a:b])

    def kind(self, char: str) -> int:
        """0 for white space, 1 for a letter, 2 for a number, 3 for another sign."""
        return 0 if char.isspace() else 1 if re.match(f"[{self.LETTERS}]", char) else 2 if re.match(f"[{self.NUMBERS}]", char) else 3

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words that PATTERN finds in UTF-8 bytes of plain texts, which end in spaces."""
        kind, lead = self.kinds[data], np.flatnonzero(data >= 0xC0)
        kind[lead] = kind[lead + 1] = self.wide[(data[lead] & 31).astype(np.int32) << 6 | data[lead + 1] & 63]
        start = np.ones(len(data), dtype=bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= kind == 2
        start[lead + 1] = False
        space = kind == 0
        start &= ~space
        mark = np.flatnonzero((data == ord("'")) & start)
        one, two = data[mark + 1], data[mark + 2]
        size = np.isin(one, list(b"stmd")) + 2 * ((np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False                      # 's, 't, 're, 've, 'm, 'll, 'd are words
        after = mark + 1 + size
        start[after] = kind[after] != 0
        starts, stops = np.flatnonzero(start), np.flatnonzero(start | space)
        return starts, stops[np.searchsorted(stops, starts, side="right")]

    def _together(self, texts: list[str]) -> list[bytes]:
        lower, whole = [], {}
        for i, text in enumerate(texts):
            if not self.plain(text) or any(s in text for s in self.special):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            lower.append(b"" if i in whole else text.lower().encode())
        blob = b" ".join(lower) + b" " * 8
        starts, ends = self.words(np.frombuffer(blob, dtype=np.uint8))
        length = ends - starts
        long = np.flatnonzero(length > 8)
        others = [self.known[blob[a:b].decode()] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        eight = np.ndarray(len(blob) - 7, "<u8", blob, strides=(1,))[starts]
        keys, again = np.unique(eight & (~np.uint64(0) >> (np.uint64(64) - (np.minimum(length, 8) * 8).astype(np.uint64))), return_inverse=True)
        place, kept = self.short.find(keys, np.bincount(again[length <= 8], minlength=len(keys)) > 0)
        first, size = place[0][again], place[1][again]
        size[long] = [len(ids) // 4 for ids in others]
        first[long] = len(kept) + np.cumsum(size[long]) - size[long]
        stops = np.concatenate([[0], np.cumsum(size)])
        ids = np.concatenate([kept, np.frombuffer(b"".join(others), dtype="<u4")])[np.repeat(first - stops[:-1], size) + np.arange(stops[-1])]
        cuts = stops[np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in lower]))].tolist()
        return [whole[i] if i in whole else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

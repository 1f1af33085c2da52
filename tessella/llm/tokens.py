"""Token ids with the tokenizers library, chunk by chunk through a bounded cache.

Both vocabularies used here cut a text into pre-tokens before any merge, and no pre-token spans certain blanks.
A text may therefore be cut at those blanks and the ids of the parts joined; repeated parts cost one lookup.
The parts also bound the memory a very long text takes inside the tokenizer.
"""

from __future__ import annotations

import os
import re
from itertools import accumulate, chain, islice
from unicodedata import is_normalized

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct parts that a worker remembers before it starts anew.
CACHE_PARTS = 800_000
#: Parts longer than this are not remembered.
CACHE_CHARS = 40
#: A private-use character, put where a text is cut.
CUT = "\ue001"
#: A stop or comma before a blank is a pre-token of its own, unless another sign stands before it or the text begins with
#: it; the latter is asked apart, as a pattern with a begin in it is tried at every character.
ODD_STOP = re.compile(r"[.,](?<=(?:[^\w \n]|_)[.,])\s")
#: Where a blank belongs to the sign after it, one before the stop counts as well.
ODD_LEAD = re.compile(r"[.,](?<=(?:[^\w\n]|_)[.,])\s")
STOPS = (".", ",")
#: A word, perhaps after a blank, and ASCII signs other than the apostrophe after it.
WORD = re.compile(r"( ?)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
#: Blanks in a row are shared out among pre-tokens in another way.
ODD_BLANK = re.compile(r"\s\s")

#: The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}

_ENCODERS: dict[tuple[str, str, bool], "Encoder"] = {}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids.

    mode "drop": white space is dropped by the tokenizer, any blank is a cut.
    mode "lead": a blank belongs to the part after it; a cut stands before a blank that follows a non-blank.
    The spelling of a special token in a text gives that token's id, as the library does by itself; with special_as_text
    it is ordinary text.
    """

    def __init__(self, path: str, mode: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        added = {} if special_as_text else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.tokenizer.encode_special_tokens = True  # what is left between special tokens is ordinary text, lowered or not
        self.mode = mode
        #: Ids by part; a special token is a part that is its id, and these stand first, so they are never forgotten.
        self.known: dict[str | int, bytes] = {i: i.to_bytes(4, "little") for i in added.values()}
        #: The same merges without normaliser and pattern, for words that need neither.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        (self.line_end,) = self.plain.encode(BYTES[10], add_special_tokens=False).ids

    def parts(self, text: str) -> list[str | int]:
        """A text in parts whose ids follow each other; a special token's spelling is a part of its own, its id."""
        if self.special and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self._parts(text[at : m.start()]), self.added[m[0]]]
                at = m.end()
            return out + self._parts(text[at:])
        return self._parts(text)

    def _parts(self, text: str) -> list[str]:
        if self.mode == "drop":
            text = text.replace("\n", " ")
            if "\u03a3" not in text:  # the one letter whose lower case depends on its place
                text = text.lower()
                if not text.startswith(STOPS) and not ODD_STOP.search(text):
                    text = text.replace(", ", " , ").replace(". ", " . ")
            return text.split(" ")
        if text.startswith(STOPS) or ODD_BLANK.search(text) or ODD_LEAD.search(text) or CUT in text:
            return re.split(r"(?<=\S)(?= )", text)
        text = text.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}")
        return text.replace("," + CUT, f"{CUT},{CUT}").replace("." + CUT, f"{CUT}.{CUT}").split(CUT)

    def plainly(self, part: str) -> str | None:
        """The pre-tokens of a part as bytes with blanks between, if it is a composed word and ASCII signs after it."""
        m = WORD.fullmatch(part)
        if not m or len(part) > CACHE_CHARS:
            return None
        blank, word, signs = m.groups()
        if not word.isalpha() or not word.isascii() and self.mode == "drop" and not is_normalized("NFC", word) or self.mode == "drop" and (blank or word != word.lower()):
            return None
        return (BYTES[32] if blank else "") + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)) + (" " + signs if signs else "")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.parts(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        codes = list(map(self.known.get, flat))
        missed = [i for i, c in enumerate(codes) if c is None]
        if missed:
            new = dict(self._new(list({flat[i] for i in missed})))
            if len(self.known) + len(new) > CACHE_PARTS:  # frequent parts come early, so the first half stays
                self.known = dict(islice(self.known.items(), CACHE_PARTS // 2))
            self.known.update(new if max(map(len, new)) <= CACHE_CHARS else {p: c for p, c in new.items() if len(p) <= CACHE_CHARS})
            for i in missed:
                codes[i] = new[flat[i]]
        ends = list(accumulate(map(len, cut)))
        return [b"".join(codes[i:j]) for i, j in zip([0, *ends], ends)]  # noqa: B905

    def _new(self, parts: list[str]):
        """The ids of parts: words as bytes in one string with line ends between them, the rest one by one."""
        words, alone = [], []
        for p in parts:
            plain = self.plainly(p)
            words.append((p, plain)) if plain else alone.append(p)
        between = f" {BYTES[10]} "
        several = [words[k : k + 256] for k in range(0, len(words), 256)]
        for k in range(0, len(several), 8):
            texts = [between.join([plain for _, plain in x]) for x in several[k : k + 8]]
            for some, code in zip(several[k : k + 8], self.plain.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(code.ids, "<u4")
                at = 4 * np.flatnonzero(ids == self.line_end)
                raw = ids.tobytes()
                yield from zip([p for p, _ in some], [raw[i:j] for i, j in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True)], strict=True)
        for k in range(0, len(alone), 512):
            some = alone[k : k + 512]
            for p, code in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                yield p, np.array(code.ids, "<u4").tobytes()


def encoder(path: str, mode: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder; it lives as long as the worker."""
    key = path, mode, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def groups(texts: list[str | None], chars: int = 1_000_000):
    """Index ranges of texts that hold about so many characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i - start >= 511:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)

"""Public tokenizers on the workers: whole-text ids, exactly as the library gives them, at word-cache speed.

For the white-space-dropping BPE file, the library's pre-tokenizer never joins anything across ASCII white
space and its normaliser does nothing across it either, so the ids of a text are the ids of its
white-space-separated parts, one after the other. Parts repeat, so each worker keeps a bounded table of
parts it has sent to the library; only new parts are encoded. Words of ASCII and Latin-1 letters go to the library's
model without its normaliser and pre-tokenizer, which would only write them in lower case and as bytes. Files of any
other make-up are encoded as whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from searchloom.llm import workers

#: Parts in a worker's table. A full one is set aside and drawn from until the next one is full.
TABLE_ENTRIES = 400_000
#: Longer parts are encoded each time and not kept.
LONGEST_KEPT = 48

# The make-up of a tokenizer file whose texts may be encoded part by part.
SPLITTABLE_NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPLITTABLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: What the byte level makes of the bytes that it does not write as the character of their number.
_moved = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_shown = {b: chr(256 + k) for k, b in enumerate(_moved)}
#: Letters of Latin-1 beyond ASCII as the byte level writes their UTF-8.
BYTES = {c: "".join(_shown.get(b, chr(b)) for b in chr(c).encode()) for c in range(128, 256) if chr(c).isalpha()}


def _latin(word: str) -> bool:
    """Whether a word of letters has those of ASCII and Latin-1 only: they have no marks to compose and one small form each."""
    if word.isascii():
        return True
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _part_from_marks(core: str) -> bool:
    """Whether a mark after these letters is a part by itself: the last letter is one in lower case as well (the
    small form of U+0130 ends in a combining dot, which the library joins to the mark) and in every edition of Unicode."""
    last = core[-1:]
    return core.isalpha() and last.lower().isalpha() and (last < "\u0530" or "\u4e00" <= last <= "\u9fa5")


def resolve(tokenizer: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return str(public_tokenizers.path(tokenizer))


def _splittable(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    parts = (pre.get("pretokenizers") or [{}])[0]
    return (
        [n["type"] for n in norm.get("normalizers", [])] == SPLITTABLE_NORMALISERS
        and parts.get("pattern") == {"Regex": SPLITTABLE_PATTERN}
        and parts.get("behavior") == "Removed"
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )


def _by_model(path: str) -> bool:
    """Whether a word of small Latin letters is one input of the model, as it is but for the byte level."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    later = spec["pre_tokenizer"]["pretokenizers"][1:]
    return later == [BYTE_LEVEL] and spec["model"]["type"] == "BPE" and not any(t["content"].isalpha() for t in spec.get("added_tokens", []))


class Encoder:
    """ids(texts) and counts(texts); null texts are empty."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = resolve(tokenizer)
        self.parts, self.sp, self.model = False, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.tk = Tokenizer.from_file(path)
            self.tk.no_truncation()
            self.tk.no_padding()
            self.parts = _splittable(path)
            self.model = self.tk.model if self.parts and _by_model(path) else None
            size = self.tk.get_vocab_size()
            self.is_end = np.array([str(self.tk.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.table: dict[str, bytes] = {"": b""}
        self.aside: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}

    def _direct(self, texts: list[str]) -> list[list[int]]:
        if self.sp is not None:
            return self.sp.encode(texts, num_threads=1)
        return [e.ids for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters. They go to the library as one text; every word ends with an end-of-word piece."""
        ids = np.array(self._direct([" ".join(words)])[0], "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):  # a letter that the library doesn't take for one: each by itself
            return [np.array(x, "<u4").tobytes() for x in self._direct(words)]
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def _latin_words(self, words: set[str]) -> list[bytes]:
        """Ids of words of small Latin letters."""
        tokenize = self.model.tokenize
        ids: list[int] = []
        ends = [0]
        for w in words:
            ids += [t.id for t in tokenize(w if w.isascii() else w.translate(BYTES))]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[i:j] for i, j in zip(ends, ends[1:])]

    def _learn(self, new: set[str]) -> None:
        """Enter the ids of parts. A word is looked up apart from one mark after it, and in lower case if it is Latin."""
        table, aside, ends = self.table, self.aside, self.ends
        plain, odd, want, latin = [], [], set(), set()
        for p in new:
            core, end = (p[:-1], p[-1]) if p[-1] in ",.;:!?" else (p, "")
            if _part_from_marks(core) if end else core.isalpha():
                if own := _latin(core):
                    core = core.lower()
                plain.append((p, core, end))
                if core not in table:
                    if core in aside:
                        table[core] = aside[core]
                    else:
                        (latin if own and self.model is not None else want).add(core)
            else:
                odd.append(p)
        table.update(zip(latin, self._latin_words(latin)))
        words = list(want)
        for i in range(0, len(words), 5000):
            table.update(zip(words[i : i + 5000], self._words(words[i : i + 5000])))
        if odd:
            table.update(zip(odd, (np.array(x, "<u4").tobytes() for x in self._direct(odd))))
        for p, core, end in plain:
            if end not in ends:
                ends[end] = np.array(self._direct([end])[0], "<u4").tobytes()
            table[p] = table[core] + ends[end]

    def raw(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.parts:
            return np.array(self._direct([text])[0], "<u4").tobytes()
        for c in "\t\n\x0b\x0c\r":
            if c in text:
                text = text.replace(c, " ")
        parts = text.split(" ")
        new = set(parts).difference(self.table)
        if not new:
            return b"".join(map(self.table.__getitem__, parts))
        if len(self.table) > TABLE_ENTRIES:
            self.table, self.aside = {"": b""}, self.table
            new = set(parts).difference(self.table)
        if self.aside and (known := [p for p in new if p in self.aside]):
            self.table.update((p, self.aside[p]) for p in known)
            new.difference_update(known)
        long = {p for p in new if len(p) > LONGEST_KEPT}
        self._learn(new - long)
        if not long:
            return b"".join(map(self.table.__getitem__, parts))
        more = {p: np.array(self._direct([p])[0], "<u4").tobytes() for p in long}
        return b"".join(more[p] if p in more else self.table[p] for p in parts)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")


def encoder(tokenizer: str) -> Encoder:
    """One encoder per worker process and file."""
    return workers.kept("tokenizer", tokenizer, lambda: Encoder(tokenizer))


def version_digest(tokenizer: str) -> str:
    """Digest of a tokenizer file and of its library's version: what a stored count depends on besides the text."""
    import hashlib

    path = resolve(tokenizer)
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + lib.__version__.encode()).hexdigest()

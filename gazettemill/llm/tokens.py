"""Exact tokenisation with the public ``tokenizers`` files, cached by word.

Texts are cut at single spaces and before newlines, where neither tokenizer
can join what stands on both sides: a byte-level piece takes a space with the
word after it, and the word tokenizer drops white space. Each distinct word
(with the space before it) is encoded by the library once per worker, in a
bounded cache, and the ids of a text are the joined ids of its words. What
the cut can't serve goes through plain ``encode`` as a whole: texts with
other runs of white space under the byte-level tokenizer, and texts that
spell out an added token (``<|endoftext|>``). Tests compare the result with
plain ``encode`` over whole tables and over all of Unicode.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from . import common

#: Entries of a cache's generation; two generations are kept, so words in use survive.
_GENERATION = 250_000
#: Marks that may follow a word's letters.
_MARKS = ".,;:!?$%&*#"
#: Runs that the byte-level tokenizer cuts otherwise than word by word.
_RUNS = ("\n\n\n", "\n\n ")


class Generations(dict):
    """A bounded dictionary that makes missing values: what wasn't asked for during a whole generation goes."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > _GENERATION:
            self.old = dict(self)
            self.clear()


class _Letters(dict):
    """How the tokenizer's model spells a letter, by code point."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> str:
        text = self.tokenizer.normalizer.normalize_str(chr(code)) if self.tokenizer.normalizer else chr(code)
        self[code] = "".join(piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return self[code]


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec["added_tokens"]]
        loose = re.I if any(t["normalized"] for t in spec["added_tokens"]) else 0
        self.added = re.compile("|".join(map(re.escape, added)), loose) if added else None
        self.vocab_size = self.tokenizer.get_vocab_size()
        probe = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        #: Whether white space leaves no ids, or stands before the word it belongs to.
        self.spaceless = probe(" a \n b") == probe("a b") == probe("a") + probe("b")
        self.spaced = not self.spaceless and probe("a b,\nc") == probe("a") + probe(" b,") + probe("\nc")
        self.letters = _Letters(self.tokenizer)
        self.words, self.cores, self.others = (Generations(make) for make in (self._word, self._core, self._other))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _core(self, core: str) -> bytes:
        """Ids of letters up to U+02FF, a pre-token that no normalising joins: straight from the tokenizer's model."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(core.translate(self.letters))]).tobytes()

    def _other(self, text: str) -> bytes:
        return self._ids([text])[0]

    def _word(self, word: str) -> bytes | None:
        """Ids of a word and the space before it; None for what a run of white space left.

        Letters and the marks after them are pre-tokens of their own, so they are learned apart.
        """
        core = word.rstrip(_MARKS)
        start = core[:1] == "\n"
        bare = core[1:] if start else core
        if bare.isalpha() and (bare.isascii() or (max(bare) < "\u0300" and bare.lower().isalpha())):
            if self.spaceless:
                ids = self.cores[bare]
            else:
                ids = self.others["\n"] + self.cores[bare] if start else self.cores[" " + bare]
            return ids + self.others[word[len(core) :]] if len(core) < len(word) else ids
        if self.spaceless:
            return self.others[word]
        rest = word[1:] if word[:1] == "\n" else word
        if word != "\n" and (not rest.strip() or rest[0].isspace() or rest[-1].isspace()):
            return None
        return self.others[word if word[0] == "\n" else " " + word]

    def _words(self, text: str) -> list[str] | None:
        """The words of a text; None where it must be encoded as a whole."""
        if self.added and self.added.search(text):
            return None
        if self.spaceless:
            return text.replace("\n", " ").split(" ")
        if text.endswith("\n\n") or any(run in text for run in _RUNS):
            return None
        return text.replace("\n", " \n").split(" ")

    def _joined(self, words: list[str] | None) -> bytes | None:
        if words is None:
            return None
        head = ""
        if self.spaced and (head := words.pop(0)) and (head[0].isspace() or head[-1].isspace()):
            return None
        try:
            return (self.others[head] if head else b"") + b"".join(map(self.words.__getitem__, words))
        except TypeError:  # a None among the words
            return None

    def encode(self, texts: list[str]) -> list[bytes]:
        if not (self.spaceless or self.spaced):
            return self._ids(texts)
        for known in (self.words, self.cores, self.others):
            known.turn()
        out = [self._joined(self._words(t)) for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._ids([texts[i] for i in rest])):
            out[i] = ids
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file, while tasks of its kind follow each other."""
    return common.kept(f"tokens of {path}", lambda: PieceEncoder(path))

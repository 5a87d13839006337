"""Token ids of a public byte-level tokenizer file."""

import json
import re

import numpy as np
import tiktoken

_encoders: dict[str, "Encoder"] = {}
#: Longer runs of white space exhaust the stack of the engine's pattern matcher; their texts take the plain library.
_LONG_BLANK = re.compile(r"\s{1000}")
#: Fixed value: how byte-level tokenizers split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives.

    The file's vocabulary, whose ids rise in merge order, runs in tiktoken's engine: the same ids in a quarter of the
    time; the tests hold them against the tokenizers library. Nothing is added to a text; a text that itself holds the
    string of an added token gets that token's id there, as the library does it, and so takes the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.path, self.library = path, None
        self.odd = re.compile("|".join([_LONG_BLANK.pattern, *map(re.escape, sorted(special))]))
        self.engine = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        encode = self.engine.encode_ordinary
        return [np.asarray(self._plain(t) if self.odd.search(t) else encode(t), dtype="<u4").tobytes() if t else b"" for t in texts]

    def _plain(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    """The process's encoder of a file; Python workers are reused, so it is loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


"""Token ids of texts by the byte-level vocabulary that the installed tokenizers share."""

from __future__ import annotations

import base64
import os
import re
from array import array

from .runtime import latest

#: Fixed value: the pre-tokenising pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on whose class two Unicode versions may differ, and strings that the tokenizer file treats as special.
DOUBTFUL = re.compile("[\x1c-\x1f\x85\xa0ɐ-‏ -⁯℀-\U0010ffff]|<\\|")


def place(name: str) -> str:
    """``name`` if it is a path, else the place of that file among the installed tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def rank_encoder(name: str):
    """A tiktoken encoder for a ``.tiktoken`` file, kept by the Python process."""

    def make():
        import tiktoken

        with open(place(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return latest(f"ranks-{name}", name, make)


def file_encoder(name: str):
    """The tokenizers library's encoder for a ``.json`` file, kept by the Python process."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(place(name))

    return latest(f"file-{name}", name, make)


def token_ids(text: str | None, vocabulary: str, ranks: str | None = None) -> array:
    """Ids of ``text`` by the tokenizer file ``vocabulary``, special tokens not added.

    ``ranks`` may name the same vocabulary as a rank file, whose encoder is
    several times as fast; it does the texts on which the two can't differ.
    """
    if not text:
        return array("I")
    if ranks and not DOUBTFUL.search(text):
        return array("I", rank_encoder(ranks).encode_ordinary(text))
    return array("I", file_encoder(vocabulary).encode(text, add_special_tokens=False).ids)

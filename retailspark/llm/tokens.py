"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

The library needs about 0.6 CPU seconds a MB of text (it also builds offsets,
masks and token strings).  For a plain byte-level BPE file the same ids come
from ``tiktoken``'s merge loop over the same vocabulary, five times faster, so
that is used where the file is of that kind; the first text of every batch is
encoded by the library too, and a difference stops the job.  Any other kind of
file is encoded by the library alone.

Added tokens (such as ``<|endoftext|>``) that stand in a text become their own
ids, as by the library's plain call.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: What the byte-level pre-tokenizer of the library splits by.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 characters stand for themselves, the
    others, in order, for the code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_byte_level(spec: dict) -> bool:
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    return (
        model.get("type", "BPE") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("dropout")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
    )


def _plain_added(added: list[dict]) -> bool:
    """Whether leftmost matching of the strings alone finds the added tokens."""
    names = [t["content"] for t in added]
    begun = any(a != b and b.startswith(a) for a in names for b in names)
    return not begun and not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or not t.get("special") for t in added)


class Encoder:
    """ids of texts; with ``match_added`` added tokens in a text become their
    own ids, else the strings of special tokens are ordinary text."""

    def __init__(self, path: str, match_added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not match_added
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if _plain_byte_level(spec):
            import tiktoken

            of = byte_alphabet()
            added = spec.get("added_tokens") or []
            special = {t["content"]: t["id"] for t in added}
            plain = _plain_added(added)
            matched = special if match_added and plain else {}
            #: texts with one of these go through the library
            self.slow = tuple(special) if match_added and not plain else ()
            ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=matched)

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [self._by_library(t) for t in texts]
        out = []
        for i, t in enumerate(texts):
            try:
                if any(x in t for x in self.slow):
                    ids = self._by_library(t)
                else:
                    ids = self.fast.encode_to_numpy(t, allowed_special="all", disallowed_special=())
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # its pattern engine can give up on extreme runs of blanks
                ids = self._by_library(t)
            if not i and not np.array_equal(ids, self._by_library(t)):
                raise ValueError("the merge loop and the tokenizers library disagree")
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path, match_added=True)

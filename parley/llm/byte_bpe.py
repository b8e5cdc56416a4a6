"""Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

The merges run in tiktoken, built from the same JSON file, since it gives the same ids several times faster: that holds
where the file's vocabulary numbers the bytes first and then the merges in order, and where the text is split by the
usual byte-level pattern. Any other file, and any text that holds one of the file's added tokens or that tiktoken gives
up (its pattern runs out of stack on about a million white-space characters in a row), goes through the tokenizers
library itself.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        model, split, letters = spec["model"], spec.get("pre_tokenizer") or {}, _byte_letters()
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        in_order = [vocab.get(m) for m in merged] == list(range(256, 256 + len(merged)))
        plain = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
                 and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges"))
        self.fast = None
        if in_order and plain and len(vocab) == 256 + len(merged):
            import tiktoken
            ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items()}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))], default=0)

    @cached_property
    def library(self):
        """The tokenizers library's own encoder, loaded when a text needs it: it takes as much memory again."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text as unsigned 32-bit integers, without special tokens."""
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)

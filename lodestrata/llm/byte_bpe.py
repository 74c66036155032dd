"""Byte-level BPE ids from a tokenizers file, with tiktoken's engine where the two are the same.

A file whose merges are ranked as its ids, with the plain byte-level split, means
the same to both libraries; the faster one then runs. Any other file is run by
tokenizers itself, and so are texts that hold the text of an added token, which
tokenizers reads as that token.
"""

from __future__ import annotations

import json
import os
from functools import cached_property, lru_cache

import numpy as np

#: The split of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes and ranks, or None where tiktoken would not mean the same."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
        return None
    bytes_of, special = _byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    if [vocab.get(t) for t in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    return {bytes(bytes_of[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = max(max(spec["model"]["vocab"].values()), max((t["id"] for t in spec.get("added_tokens", [])), default=0)) + 1
        self.path, ranks, self.fast = path, _ranks(spec), None
        # an added token that is found in other text than its own could be missed
        added = spec.get("added_tokens", [])
        self.added = [t["content"] for t in added]
        if ranks and not any(t.get("normalized") or t.get("single_word") for t in added):
            import tiktoken

            self.fast = tiktoken.Encoding(f"own-{os.path.basename(path)}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    def _one(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(t in text for t in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        except ValueError:  # the split's stack does not hold runs of some 10**6 blanks
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast:
            return [self._one(t) for t in texts]
        return [np.array(e.ids, "<u4") for e in self.slow.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)

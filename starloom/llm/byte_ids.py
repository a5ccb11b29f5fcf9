"""Token ids of whole texts under a byte-level BPE file, as numpy arrays."""

from __future__ import annotations

import json

import numpy as np
import tiktoken

from starloom.llm.bpe import byte_alphabet

#: Fixed value: the split pattern that the byte-level pre-tokenizer of these files stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: One in so many texts of a process is encoded by the tokenizers library too and compared.
COMPARED = 512


class ByteIds:
    """Encoder for a byte-level BPE file of the tokenizers library.

    The merges run in tiktoken, whose ids are the same where merges are listed in the order of
    the ids they make, which is checked, and which takes a fifth of the time. A text that its
    pattern engine gives up on (millions of blanks in a row) goes to the tokenizers library.
    One in COMPARED texts is held against the library; a difference is an error.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(made) or not spec["pre_tokenizer"]["use_regex"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a byte-level file whose ids follow its merges")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.library = None
        self.calls = 0

    def by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        try:
            ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        except Exception:
            return self.by_library(text)
        except BaseException as error:
            if type(error).__name__ != "PanicException":  # the pattern engine's, which is no Exception
                raise
            return self.by_library(text)
        self.calls += 1
        if self.calls % COMPARED == 0 and not np.array_equal(ids, self.by_library(text)):
            raise ValueError(f"{self.path}: tiktoken and the tokenizers library differ")
        return ids


ENCODERS: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    if path not in ENCODERS:
        ENCODERS[path] = ByteIds(path)
    return ENCODERS[path]

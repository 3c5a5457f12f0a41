"""Token ids by the tokenizers library, every distinct piece of text encoded once per worker.

A text may be cut where no token and no match of the tokenizer's splitting pattern can reach across;
then the ids of the text are the ids of its pieces, one after the other:

* ``dropped`` (patterns that leave white space out, after NFC and lower-casing): at every white space, and
  between a Latin letter or digit and a closing run of full stops and commas. Lower-casing A-Z first
  changes nothing, as long as no special string is near.
* ``kept`` (byte-level patterns with optional leading spaces): before a single space or new line between two
  characters that are not white space.
* ``whole``: no cut is proven, so texts are encoded as they are. Also texts of the other kinds in
  which a special string or irregular white space appears take this way.
"""

from __future__ import annotations

import json
import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rulelens.llm.common import Words, as_text, ranges, within

MAX_KEPT_PIECES = 1_500_000
_STEP = 20_000
#: White space in the widest sense either pattern engine knows.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_IRREGULAR = rf"{_SPACE}[ \n]|[ \n]{_SPACE}|^[ \n]|[ \n]$|^$"
_CLOSING = r"([a-z0-9à-öø-ÿß])([.,]+)([\x20\x09-\x0D]|$)"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cutting(path: str) -> str:
    """Which cuts the tokenizer's own description proves."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    normalizers = spec.get("normalizer") or {}
    steps = [n.get("type") for n in normalizers.get("normalizers", [normalizers] if normalizers else [])]
    if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not steps:
        return "kept"
    inner = split.get("pretokenizers", [])
    if (
        [p.get("type") for p in inner] == ["Split", "ByteLevel"]
        and inner[0].get("behavior") == "Removed"
        and inner[0].get("invert")
        and inner[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not inner[1].get("use_regex")
        and set(steps) <= {"NFC", "Replace", "Lowercase"}
        and "Lowercase" in steps
    ):
        return "dropped"
    return "whole"


class Encoder:
    """Encodes batches of texts; holds the ids of at most ``MAX_KEPT_PIECES`` pieces besides a batch's own."""

    def __init__(self, path: str):
        self.tokenizer, self.kind = load(path), cutting(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        self.known, self.at, self.lengths, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that must be encoded as a whole."""
        odd = np.full(len(texts), self.kind == "whole")
        for s in self.special:
            odd |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.kind == "kept":
            odd |= pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        return odd

    def _pieces(self, texts: pa.Array) -> Words:
        if self.kind == "dropped":
            return Words(pc.replace_substring_regex(pc.ascii_lower(texts), _CLOSING, r"\1 \2\3"), lower=False)
        return Spaced(texts)

    def _learn(self, pieces: Words) -> np.ndarray:
        """Where the ids of each distinct piece are kept; unknown ones are encoded now."""
        missing = np.flatnonzero(within(self.known, pieces.hashes) < 0)
        if len(missing):
            if len(self.known) + len(missing) > MAX_KEPT_PIECES:
                self._forget()
                missing = np.arange(len(pieces.hashes))
            flat, lengths = [], []
            for i in range(0, len(missing), _STEP):
                found = self.whole([pieces.words[j] for j in missing[i : i + _STEP]])
                lengths += [len(x) for x in found]
                flat.append(np.fromiter((y for x in found for y in x), dtype=np.uint32, count=sum(lengths[i:])))
            lengths = np.array(lengths, dtype=np.int64)
            known = np.concatenate([self.known, pieces.hashes[missing]])
            at = np.concatenate([self.at, len(self.ids) + np.cumsum(lengths) - lengths])
            order = np.argsort(known, kind="stable")
            self.known, self.at, self.lengths = known[order], at[order], np.concatenate([self.lengths, lengths])[order]
            self.ids = np.concatenate([self.ids, *flat])
        return np.searchsorted(self.known, pieces.hashes)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text."""
        texts = as_text(texts)
        odd = self._odd(texts)
        out = np.zeros(len(texts), dtype=np.int64)
        out[odd] = [len(x) for x in self.whole(texts.filter(pa.array(odd)).to_pylist())]
        if not odd.all():
            pieces = self._pieces(texts.filter(pa.array(~odd)))
            places = self._learn(pieces)
            lengths = self.lengths[places]
            sums = np.concatenate([[0], np.cumsum(lengths[pieces.codes])])
            out[~odd] = np.diff(sums[pieces.starts])
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, in one array, and where each text's begin."""
        texts = as_text(texts)
        odd = self._odd(texts)
        lengths = np.zeros(len(texts), dtype=np.int64)
        apart = self.whole(texts.filter(pa.array(odd)).to_pylist())
        lengths[odd] = [len(x) for x in apart]
        joined = np.zeros(0, dtype=np.uint32)
        if not odd.all():
            pieces = self._pieces(texts.filter(pa.array(~odd)))
            if len(pieces.hashes):
                places = self._learn(pieces)[pieces.codes]
                sums = np.concatenate([[0], np.cumsum(self.lengths[places])])
                lengths[~odd] = np.diff(sums[pieces.starts])
                joined = self.ids[ranges(self.at[places], self.lengths[places])]
        extra = int(end is not None)
        bounds = np.concatenate([[0], np.cumsum(lengths + extra)])
        ids = np.full(bounds[-1], end or 0, dtype=np.uint32)
        ids[ranges(bounds[:-1][~odd], lengths[~odd])] = joined
        for t, own in zip(np.flatnonzero(odd), apart, strict=True):
            ids[bounds[t] : bounds[t] + len(own)] = own
        return ids, bounds


class Spaced(Words):
    """Pieces that begin at a single space or new line and keep it."""

    def __init__(self, texts: pa.Array):
        marked = pc.replace_substring(as_text(texts), "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        bare = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = self.starts[:-1]
        # every piece but a text's first one has its space again; first pieces get entries of their own
        heads, back = np.unique(codes[first], return_inverse=True)
        self.words = [w if w.startswith("\n") else " " + w for w in bare] + [bare[h] for h in heads]
        codes[first] = len(bare) + back
        self.codes = codes


def encoder(path: str) -> Encoder:
    """The worker process's encoder for this file; it outlives the task."""
    kept = sys.__dict__.setdefault("_rulelens_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]

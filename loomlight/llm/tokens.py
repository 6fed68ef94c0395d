"""Token ids of whole texts, by the tokenizers library.

A tokenizer that splits at white space and never joins across it gives a text the ids of its
white-space words in order. For such a one, read off its definition, each distinct word of a batch is
encoded once; all others encode whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomlight.llm.common import claim, kept

_ENCODERS: dict[int, WordEncoder] = kept()

#: Words of Latin-1 letters with at most one closing mark: composed characters only, each with a
#: lower case of one character, so normalisation does nothing to them but lower the case.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
_MARKS = [".", ","]

# A normalizer that folds white space and case, and a split that drops white space.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's definition, read on the driver and shipped, so executors need no file."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        return f.read()


def word_level(definition: dict) -> bool:
    """Whether a text's ids are those of its white-space words: the known normalizer and split, and nothing that looks across words."""
    model = definition["model"]
    return (
        definition.get("normalizer") == _NORMALIZER
        and definition.get("pre_tokenizer") == _PRE_TOKENIZER
        and not any(definition.get(k) for k in ("truncation", "padding", "post_processor"))
        and model.get("type") == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1 for t in definition["added_tokens"])
    )


class WordEncoder:
    """Keeps the ids of at most about `most` words; beyond that the memory starts anew with the batch at hand, which costs time only."""

    def __init__(self, definition: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_str(definition), most
        known = json.loads(definition)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.by_word = word_level(known)
        if self.by_word:
            #: The same model for lower-case plain words joined by spaces, ASCII ones and others; each ends in one id of `ends`.
            self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.latin.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(known["model"]["end_of_word_suffix"])]] = True
            self._clear()

    def _clear(self) -> None:
        self.known, self.ids = pa.array([], pa.string()), np.zeros(0, self.dtype)
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._learn(pa.array(_MARKS))

    def _learn(self, new: pa.Array) -> None:
        """Encodes words that are not known and keeps them: plain ones many at once, others each by the whole tokenizer."""
        plain = pc.match_substring_regex(new, _PLAIN).to_numpy(zero_copy_only=False)
        ascii_ = pc.string_is_ascii(new).to_numpy(zero_copy_only=False)
        starts, lens, ids, used = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], len(self.ids)
        for own, tokenizer in ((~plain, None), (plain & ascii_, self.ascii), (plain & ~ascii_, self.latin)):
            at = np.flatnonzero(own)
            if not len(at):
                continue
            words = new.take(pa.array(at))
            if tokenizer is None:
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
                ids.append(np.array([i for x in lists for i in x], self.dtype))
                n = np.array([len(x) for x in lists], np.int64)
            else:
                cut = pa.array([*range(0, len(words), 256), len(words)], pa.int32())
                lines = pc.binary_join(pa.ListArray.from_arrays(cut, words), " ").to_pylist()
                ids.append(np.concatenate([np.array(e.ids, self.dtype) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]))
                last = np.flatnonzero(self.ends[ids[-1]])
                assert len(last) == len(words) and last[-1] == len(ids[-1]) - 1, "a word without its end"
                n = np.diff(last, prepend=-1)
            starts[at], lens[at] = used + np.cumsum(n) - n, n
            used += len(ids[-1])
        self.known, self.ids = pa.concat_arrays([self.known, new]), np.concatenate(ids)
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])

    def _numbers(self, names: pa.Array) -> np.ndarray:
        """The places of distinct words among the known ones, after learning those that are not."""
        for _ in range(2):
            found = pc.index_in(names, value_set=self.known)
            new = names.filter(pc.is_null(found))
            if len(self.known) <= len(_MARKS) or len(self.known) + len(new) <= self.most:
                break
            self._clear()
        number = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            number[number < 0] = len(self.known) + np.arange(len(new))
            self._learn(new)
        return number

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words joined, and each word's start and length there. Plain words are looked up in lower case, without their mark."""
        plain = pc.match_substring_regex(words, _PLAIN)
        names = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, characters="".join(_MARKS))), words).dictionary_encode()
        number = self._numbers(names.dictionary)[names.indices.to_numpy(zero_copy_only=False)]
        lens, starts = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        lens[:, 0], starts[:, 0] = self.lens[number], self.starts[number]
        for i, mark in enumerate(_MARKS):  # the first that are known
            has = pc.and_(plain, pc.ends_with(words, mark)).to_numpy(zero_copy_only=False)
            lens[has, 1], starts[has, 1] = self.lens[i], self.starts[i]
        ids = _joined(self.ids, starts.ravel(), lens.ravel())
        lens = lens.sum(1)
        return ids, np.cumsum(lens) - lens, lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts joined, and how many each has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            lists = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.dtype), *lists]), np.array([len(x) for x in lists], np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        own, starts, lens = self._words(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        many = lens[index]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(counts)])]
        return _joined(own, starts[index], many), np.diff(upto)


def _joined(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start and length, one after the other."""
    total = int(lens.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts - (np.cumsum(lens) - lens)).astype(kind), lens)
    at += np.arange(total, dtype=kind)
    return values[at]


def encoder(definition: str) -> WordEncoder:
    """The Python worker's own encoder, kept between tasks."""
    claim("tokens")
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]

"""Ids of a tokenizers file that drops white space, by word.

Such a tokenizer's normaliser and pattern never join what a blank or line feed parts, so a text's ids are those
of its words one after another; each distinct word is encoded once and kept.
"""

from __future__ import annotations

import json as json_module
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from .common import only_mine
from .id_store import Store


@lru_cache(maxsize=4)
def read_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: A normaliser and pattern for which words of simple characters can be cut here.
KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Below U+0250: no character that NFC changes, letters and digits written out, no white space, and none whose small
#: letter is elsewhere.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
SIMPLE = "^[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x250) if not chr(c).isspace() and c not in range(0x7F, 0xA1) and max(map(ord, chr(c).lower())) < 0x250 and len(chr(c).lower()) == 1) + "]*$"
#: Pieces of words that a line feed ends each.
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|\\n|[^{LETTERS}{DIGITS}\\n]+").findall
#: Bytes of text that are encoded at a time.
SLICE = 8 << 20


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


BYTE_LETTERS = byte_letters()


class WordIds:
    """``encode(texts)``: the ids of all texts one after another, and where each text's end; null is empty.

    With the normaliser and pattern above, new words of simple characters are cut into the pattern's pieces here, and
    only new pieces go through the tokenizer's model; other words, and those that hold the string of a special
    token, go through the whole tokenizer, with the library's default for such strings.
    """

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.pieces = Store(self._words, self.dtype), Store(self._pieces, self.dtype)
        parts = json_module.loads(json)
        normal, split = parts.get("normalizer") or {}, (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        added = parts.get("added_tokens") or []
        self.marks = [t["content"] for t in added]
        self.cuts = (
            normal.get("normalizers") == KNOWN_NORMALIZER and len(split) == 2 and split[0].get("pattern") == {"Regex": KNOWN_PATTERN}
            and split[0].get("behavior") == "Removed" and split[0].get("invert") and split[1].get("type") == "ByteLevel" and not split[1].get("use_regex") and not split[1].get("add_prefix_space")
            and not any(t["normalized"] or re.search(r"\s", t["content"]) for t in added)
        )

    def _pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, tokenize = [], self.tokenizer.model.tokenize
        for piece in names.to_pylist():
            letters = piece if piece.isascii() else "".join(map(BYTE_LETTERS.__getitem__, piece.encode()))
            found.append([] if piece == "\n" else [t.id for t in tokenize(letters)])
        return np.array([i for ids in found for i in ids], self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def _words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        simple = pc.match_substring_regex(names, SIMPLE) if self.cuts else pa.array(np.zeros(len(names), bool))
        for mark in self.marks:
            simple = pc.and_(simple, pc.invert(pc.match_substring(names, mark)))
        plain = simple.to_numpy(zero_copy_only=False)
        numbers, parts = np.zeros(len(names), np.int64), []
        if plain.any():
            cut = pa.array(CUT("\n".join(names.filter(simple).to_pylist()).lower() + "\n"), pa.string()).dictionary_encode()
            lists = self.pieces.of(cut)
            ends = lists.offsets.to_numpy()[np.flatnonzero(cut.indices.to_numpy() == pc.index(cut.dictionary, "\n").as_py()) + 1]
            numbers[plain] = np.diff(ends, prepend=0)
            parts.append((np.flatnonzero(plain), lists.flatten().to_numpy()))
        if not plain.all():
            found = [e.ids for e in self.tokenizer.encode_batch_fast(names.filter(pc.invert(simple)).to_pylist(), add_special_tokens=False)]
            numbers[~plain] = list(map(len, found))
            parts.append((np.flatnonzero(~plain), np.array([i for ids in found for i in ids], self.dtype)))
        if len(parts) == 1:
            return parts[0][1], numbers
        kind, out = np.repeat(plain, numbers), np.empty(numbers.sum(), self.dtype)
        out[kind], out[~kind] = parts[0][1], parts[1][1]
        return out, numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        lists = self.words.of(words.flatten().dictionary_encode())
        if not len(lists):
            return np.empty(0, self.dtype), np.zeros(len(texts), np.int64)
        at = words.offsets.to_numpy()
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[at[1:] - at[0]].astype(np.int64)


def engine(key: str, json: str) -> WordIds:
    """The worker's encoder for the file ``key``; made once a worker."""
    return only_mine(("words", key), lambda: WordIds(json))


def ship(spark: SparkSession, path: str):
    """The file's content as a broadcast; its size is the vocabulary's."""
    return spark.sparkContext.broadcast(read_json(path))

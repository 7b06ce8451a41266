"""Exact word-wise encoding with a public word-BPE tokenizer file.

The tokenizer never joins characters across white space, so a text's ids are those of its
white-space-separated normalised words in turn.  ``split`` makes these words and ``WordEncoder``
encodes distinct words with the tokenizers library.  Ids are held as little-endian unsigned
32-bit integers in a binary column.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Collection, Iterable
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from .common import trim  # noqa: E402

ID_BYTES = 4
#: Characters below this are in composed form, lower-case alone, and white space as Python and
#: Arrow have it but for four separators, so both split such texts as the library does.
_CARE = re.compile("[\x1c-\x1f]|[^\x00-ɏ]|<\\|")


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def load(spark: SparkSession, path: str | None = None):
    """The tokenizer file's text as a broadcast of fixed size (the vocabulary's), so executors need no file."""
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def load_pieces(spark: SparkSession, path: str | None = None):
    """The piece of each id as a broadcast of fixed size; decoding needs no more of the tokenizer."""
    return spark.sparkContext.broadcast(_pieces(Tokenizer.from_file(path or default_path())))


def _pieces(tokenizer: Tokenizer) -> list[str]:
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def _plain(text: str) -> bool:
    """True if Python and Arrow split the text as the library does."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _CARE.search(text)
    return b"<|" not in raw and not any(c in raw for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f"))


#: Words of letters that are encoded as one text.
GROUP = 1_000
#: Marks that the tokenizer always cuts off letters.
MARKS = ".,;:!?"


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if array("I").itemsize == ID_BYTES and sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class WordEncoder:
    """Splits texts into words and encodes words; one for each tokenizer and Python worker."""

    def __init__(self, spec: str):
        self._words = Tokenizer.from_str(spec)
        self._normalizer = self._words.normalizer
        self._words.normalizer = None
        self._words.encode_special_tokens = True
        self._words.no_truncation()
        self._words.no_padding()
        self._special = {t.content: i for i, t in self._words.get_added_tokens_decoder().items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._ends = np.array([p.endswith("</w>") for p in _pieces(self._words)])

    def split(self, text: str) -> list[str]:
        """The normalised words of a text; a special token is its string after a space, which no word has."""
        if _plain(text):
            return text.lower().split()
        out: list[str] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self._special:
                out.append(" " + part)
            elif part:
                normal = self._normalizer.normalize_str(part) if self._normalizer else part
                out += [w for w in normal.split(" ") if w]
        return out

    def encode(self, words: Collection[str]) -> list[bytes]:
        """The ids of each word."""
        found: dict[str, bytes] = {}
        self.learn(words, found)
        return [found[w] for w in words]

    def learn(self, words: Iterable[str], known: dict[str, bytes]) -> None:
        """Add the ids of ``words`` to ``known``; one mark after letters is taken off and its ids appended."""
        wanted, marked = set(MARKS), []
        for w in words:
            if w[-1] in MARKS and (base := w[:-1]).isalpha():
                marked.append((w, base))
                wanted.add(base)
            elif w[0] == " ":
                known[w] = _bytes([self._special[w[1:]]])
            else:
                wanted.add(w)
        letters, rest = [], []
        for w in wanted.difference(known):
            (letters if w.isalpha() else rest).append(w)
        for at in range(0, len(letters), GROUP):
            known.update(zip(letters[at : at + GROUP], self._group(letters[at : at + GROUP])))
        known.update(zip(rest, (_bytes(e.ids) for e in self._words.encode_batch_fast(rest, add_special_tokens=False))))
        for w, base in marked:
            known[w] = known[base] + known[w[-1]]

    def _group(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, encoded as one text and cut after each id that ends a word."""
        ids = np.array(self._words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return [_bytes(e.ids) for e in self._words.encode_batch_fast(words, add_special_tokens=False)]
        data, cuts = ids.tobytes(), (ends * ID_BYTES).tolist()
        return [data[i:j] for i, j in zip([0, *cuts], cuts)]


@lru_cache(maxsize=1)
def encoder(spec: str) -> WordEncoder:
    made = WordEncoder(spec)
    trim()
    return made


class WordIds(dict):
    """Ids by word, filled as words are met; it starts afresh beyond ``limit`` words, so memory stays bounded."""

    def __init__(self, source: WordEncoder, limit: int = 600_000):
        self.source, self.limit = source, limit

    def _split(self, texts: list[str]) -> tuple[list[int], pa.Array, np.ndarray]:
        """The order in which the texts' words are listed, the words, and where each text's words begin and end."""
        plain, other = [], []
        for i, t in enumerate(texts):
            (plain if _plain(t) else other).append(i)
        cut = pc.utf8_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
        words = [self.source.split(texts[i]) for i in other]
        flat = pa.concat_arrays([cut.flatten(), *(pa.array(w, pa.large_string()) for w in words)])
        bounds = np.cumsum([0, *pc.list_value_length(cut).to_pylist(), *map(len, words)])
        return plain + other, flat, bounds

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new words of all of them are encoded together."""
        order, flat, bounds = self._split(texts)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > self.limit:
            self.clear()
            fresh = words
        self[""] = b""  # before and after the white space at a text's ends
        self.source.learn(filter(None, fresh), self)
        placed = pa.array(map(self.__getitem__, words), pa.large_binary()).take(coded.indices)
        _, offsets, data = placed.buffers()
        cuts = np.frombuffer(offsets, np.int64)[bounds].tolist()
        data = data.to_pybytes() if data else b""
        found = dict(zip(order, (data[i:j] for i, j in zip(cuts, cuts[1:]))))
        return [found[i] for i in range(len(texts))]

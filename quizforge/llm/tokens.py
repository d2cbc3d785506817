"""Token ids of whole texts by a public tokenizer file, with a table of words met before."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: The id that ends each document.
END_ID = 2
#: Words that a worker keeps ids of; beyond, it starts anew.
MOST_WORDS = 600_000
#: A space may stand between a letter or digit and these without a change of the ids.
_SPLIT = r"([a-z0-9])([.,!?;:*$%&#]+)"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """encode(): the ids that Tokenizer.encode(text, add_special_tokens=False) gives for whole texts.

    The tokenizer lower-cases, cuts at white space and never joins across it, so each distinct word is
    encoded once per worker. Texts that might hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new words. A word of letters is one piece with one end token, so many go in one text."""
        letters = np.asarray(pc.match_substring_regex(pa.array(words, pa.string()), r"^\p{L}+$"))
        plain, rest = [w for w, x in zip(words, letters, strict=True) if x], [w for w, x in zip(words, letters, strict=True) if not x]
        runs = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([" ".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(run) and ends[-1] == len(ids):
                self._keep(run, ids, np.diff(ends, prepend=0))
            else:
                rest += run
        if rest:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(rest, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths)

    def _keep(self, words: list[str], joined: np.ndarray, lengths: np.ndarray) -> None:
        at, n = len(self.known), len(words)
        while self.used + len(joined) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while at + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.pool[self.used : self.used + len(joined)] = joined
        self.lengths[at : at + n] = lengths
        self.starts[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(joined)
        self.known.update(zip(words, range(at, at + n), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text in them. No end id."""
        texts = texts.cast(pa.string()).fill_null("") if texts.null_count else texts.cast(pa.string())
        if pc.any(pc.match_substring(texts, "<|")).as_py():
            ids = [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _SPLIT, r"\1 \2"))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        if len(self.known) + len(words) > MOST_WORDS:
            self.clear()
        known = self.known
        if new := [w for w in words if w not in known]:
            self._learn(new)
        number = np.fromiter((known[w] for w in words), np.int64, len(words))[np.asarray(flat.indices)] if words else np.zeros(0, np.int64)
        lengths = self.lengths[number]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[number] - (ends - lengths), lengths) + np.arange(total)]
        edges = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
        return ids, np.concatenate([[0], ends])[edges]


@held
@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text, and their offsets."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))

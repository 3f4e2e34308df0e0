"""Token ids of whole texts from public vocabulary files, with a bounded cache of words."""

from __future__ import annotations

import os
from array import array

import numpy as np

# Words in one generation of a worker's cache; the last generation is kept beside the new one.
CACHE_WORDS = 300_000
# Words encoded as one text.
JOINED_WORDS = 2_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Generations:
    """A bounded cache: when a generation is full it becomes the old one, from which words still in use move on."""

    def __init__(self):
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def missing(self, split: list[list[bytes]]) -> list[bytes]:
        """Words of a slice that no generation knows; the known ones are in the new generation afterwards."""
        words = {w for part in split for w in part}
        if len(self.cache) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
        asked = words.difference(self.cache)
        known = asked.intersection(self.old)
        self.cache.update((w, self.old[w]) for w in known)
        return list(asked - known)


class WordBpe(Generations):
    """Ids (as little-endian unsigned 32-bit bytes) of a lower-casing BPE vocabulary that drops white space.

    No token spans white space, so the ids of a text are those of its white-space separated parts, one after the other.
    Parts of plain letters skip the normaliser, which leaves them as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for name, i in self.whole.get_vocab().items() if name.endswith("</w>")]] = True

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _learn_words(self, names: list[bytes], tokenizer) -> None:
        """Learn words of letters, many to a text: each is one pre-token, and its last id alone ends a word."""
        parts = [names[i : i + JOINED_WORDS] for i in range(0, len(names), JOINED_WORDS)]
        for part, coded in zip(parts, tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                self._learn_parts(part)
                continue
            data, at = ids.tobytes(), 0
            for name, end in zip(part, ends):
                self.cache[name] = data[at:end]
                at = end

    def _learn_parts(self, names: list[bytes]) -> None:
        for name, coded in zip(names, self.whole.encode_batch_fast([n.decode() for n in names], add_special_tokens=False)):
            self.cache[name] = self._pack(coded.ids)

    def _learn(self, parts: list[bytes]) -> None:
        cache, ascii_, letters, other, ended = self.cache, {}, {}, {b".", b","}, []
        for part in parts:
            core = part[:-1] if part[-1:] in (b".", b",") and len(part) > 1 else part
            if core.isalpha() and core.isascii():
                ascii_[core] = None
            elif core.decode().lower().isalpha():  # lower-casing U+0130 adds a mark that joins the punctuation
                letters[core] = None
            else:
                other.add(part)
                continue
            if core is not part:
                ended.append(part)
        self._learn_parts(list(other.difference(cache)))
        self._learn_words([w for w in ascii_ if w not in cache], self.letters)
        self._learn_words([w for w in letters if w not in cache], self.whole)
        for part in ended:
            cache[part] = cache[part[:-1]] + cache[part[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.translate(_LOWER).split() for t in texts]
        if missing := self.missing(split):
            self._learn(missing)
        get = self.cache.__getitem__
        # The strings of special tokens are looked for before the text is lower-cased.
        return [
            self._pack(self.whole.encode(t.decode(), add_special_tokens=False).ids) if b"<|" in t else b"".join(map(get, words))
            for t, words in zip(texts, split)
        ]


class Pieces(Generations):
    """Ids (as little-endian unsigned 16-bit bytes) of a sentence-piece vocabulary, word by word."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = [self.model.is_byte(i) for i in range(self.model.get_piece_size())]

    def encode(self, split: list[list[bytes]]) -> list[bytes]:
        if missing := self.missing(split):
            for name, ids in zip(missing, self.model.encode([n.decode() for n in missing], num_threads=1)):
                self.cache[name] = array("H", ids).tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

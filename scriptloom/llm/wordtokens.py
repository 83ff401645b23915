"""Token ids of texts by a tokenizer that lower-cases and drops white space, with each word encoded once per worker."""

from __future__ import annotations

import numpy as np

from scriptloom.llm.textnum import split_words


class WordTokens:
    """No token reaches across white space, nor from a letter to a comma or full stop or back, so a text's ids are its
    words' ids. Words are known by a 64-bit hash of their lower-cased bytes."""

    _shared: dict[str, WordTokens] = {}

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.plain, self.marked = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.mark = "<|endoftext|>"
        self.mark_id = self.marked.token_to_id(self.mark)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.first, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @classmethod
    def shared(cls, path: str) -> WordTokens:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each): a few thousand words at once, with the mark between them."""
        ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 4096):
            got = np.array(self.marked.encode(self.mark.join(words[i : i + 4096]), add_special_tokens=False).ids, "<u4")
            marks = got == self.mark_id
            lengths.append(np.diff(np.flatnonzero(marks), prepend=-1, append=len(got)) - 1)
            ids.append(got[~marks])
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        odd = np.array(["<|" in w for w in words])
        ids, lengths = self._encoded([w for w, o in zip(words, odd, strict=True) if not o] if odd.any() else words)
        for k in np.flatnonzero(odd):
            own = np.array(self.plain.encode(words[k], add_special_tokens=False).ids, "<u4")
            ids, lengths = np.concatenate([ids, own]), np.append(lengths, len(own))
        order = np.argsort(odd, kind="stable")  # of the hashes, as the ids lie
        slots = np.empty(len(words), np.int64)
        slots[order] = len(self.length) + np.arange(len(words))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length, self.ids = np.concatenate([self.length, lengths]), np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, slots)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as little-endian unsigned 32-bit numbers, number of ids of each text)."""
        w = split_words(data, offsets, stops=True)
        if not len(w.hashes):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        distinct, seen, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        for again in (True, False):
            at = np.searchsorted(self.hashes, distinct)
            new = np.ones(len(distinct), bool)
            new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != distinct[at < len(self.hashes)]
            if not new.any() or not again:
                break
            if new.sum() + len(self.hashes) > self.most:
                self.forget()
                new[:] = True
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(w.starts[seen[new]].tolist(), w.ends[seen[new]].tolist(), strict=True)]
            self._learn(distinct[new], words)
        slot = self.slots[at][which]
        lengths = self.length[slot]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.first[slot] - (ends - lengths), lengths) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(w.counts)])]
        return ids, np.diff(upto)

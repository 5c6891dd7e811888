"""Token ids of whole texts by a tokenizer file, each distinct word encoded once per worker."""

from __future__ import annotations

import os

from panelcast.llm.common import worker_cache

#: Words a worker remembers, in two generations of half that number each: about 110 MB at most.
REMEMBERED = 900_000
MAX_WORD = 256  # longer words are not remembered
AT_ONCE = 20_000  # new words handed to the tokenizer together
LEAN = (200_000, 2_000)  # the two for executors short of memory: less of it, more time


#: Signs that end a word as a token of their own after a letter; an apostrophe does not always.
MARKS = frozenset(".,;:!?)")


class WordEncoder:
    """Encodes texts with the tokenizers library, word by word.

    For tokenizers that drop white space and never join across it, as ``word_bpe_49k.json`` does, the ids of a
    text are the ids of its words in order. Words are cut at the six ASCII white-space characters only; what
    else the tokenizer takes for space is left to it. A column's words are split and told apart by Arrow, each
    distinct one is looked up once, and numpy lays their ids out. Words seen before are remembered in a young
    and an old generation, the older one forgotten when the younger is full.
    """

    def __init__(self, path: str, remembered: int | None = None, at_once: int = AT_ONCE):
        self.remembered, self.at_once = remembered or REMEMBERED, at_once
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = "Lowercase" in (self.tokenizer.normalizer.__getstate__().decode() if self.tokenizer.normalizer else "")
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.apart: dict[str, bool] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def splits(self, word: str) -> bool:
        """Whether a word that ends in a mark is encoded as the word and the mark.

        Letters before a mark are; but normalising may turn the last one into a letter and a sign that joins
        the mark, so each last letter is tried once with the tokenizer itself.
        """
        if not (word[-1] in MARKS and word[:-1].isalpha()):
            return False
        end = word[-2:]
        if end not in self.apart:
            self.apart[end] = self._ids(end) == self._ids(end[0]) + self._ids(end[1])
        return self.apart[end]

    def known(self, words: list[str]) -> list[bytes]:
        """Every word's ids; new ones are encoded and remembered, but not a word and a mark together."""
        from array import array

        out = list(map(self.young.get, words))
        miss = [i for i, x in enumerate(out) if x is None]
        bare = {i: w[:-1] for i in miss if self.splits(w := words[i])}
        need = dict.fromkeys(bare.get(i, words[i]) for i in miss)
        need.update(dict.fromkeys(MARKS))
        young, old = self.young, self.old
        unseen = []
        for w in need:
            if w not in young:
                if (seen := old.get(w)) is not None:
                    young[w] = seen
                else:
                    unseen.append(w)
        for i in range(0, len(unseen), self.at_once):
            some = unseen[i : i + self.at_once]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                young[w] = array("I", e.ids).tobytes()
        for i in miss:
            b = bare.get(i)
            out[i] = young[words[i]] if b is None else young[b] + young[words[i][-1]]
        for w in unseen:
            if len(w) > MAX_WORD:
                del young[w]
        if len(young) > self.remembered // 2:
            self.old, self.young = young, {"": b""}
        return out

    def encode(self, column, end_id: int):
        """(ids, bounds): the unsigned 32-bit ids of an Arrow text column, ``end_id`` after each text's own."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(column.cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        if self.lower:  # fewer different words; special tokens keep their case
            plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
            words = pc.if_else(plain, pc.ascii_lower(words), words)
        own = self.known(words.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        table, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        # each text's words, then its end, as one more entry of the table
        texts = len(lists)
        words_of = pc.list_value_length(lists).to_numpy()
        last = np.cumsum(words_of) + np.arange(texts)
        entry = np.full(len(at) + texts, len(own), np.int64)
        entry[np.delete(np.arange(len(entry)), last)] = at
        table, first, size = np.append(table, np.uint32(end_id)), np.append(first, len(table)), np.append(size, 1)
        n = size[entry]
        ends = np.cumsum(n)
        ids = table[np.repeat(first[entry] - ends + n, n) + np.arange(int(ends[-1]) if texts else 0)]
        return ids, np.concatenate([[0], ends[last]])


def word_encoder(path: str, lean: bool = False) -> WordEncoder:
    """The worker's encoder of a tokenizer file; a lean one remembers fewer words."""
    cache = worker_cache("word_encoders")
    if (path, lean) not in cache:
        cache[path, lean] = WordEncoder(path, *LEAN) if lean else WordEncoder(path)
    return cache[path, lean]

"""BPE encoding of whole texts, by words and, in long words, by tree concatenation.

The tokenizer splits at white space, so words between ASCII white space are encoded alone, each distinct one once
per worker.
A word that nothing splits and that is longer than LEAF is cut in halves, the leaves are encoded as one
batch (the library's threads work side by side), and halves are joined upwards: a window around the
join is encoded again, wider each time, until its tokens agree with those of both halves on either
side of the join. A window that covers both halves is their exact encoding, so the search always ends.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa

from faultline.llm.words import Words

#: Characters of an unsplit word that are encoded at once.
LEAF = 512
#: Characters on either side of a join that are encoded again at first.
REACH = 48
#: Words of plain letters that are encoded as one text.
JOINED = 256
#: Distinct words whose ids a worker remembers; then it starts anew. Results don't depend on it.
REMEMBERED = 1_200_000

#: Letters of Latin blocks that are their own composed form, then common marks (no apostrophe): their split is beyond doubt.
_PLAIN = "([a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+)([!-&(-/:-@[-`{-~]*)"
#: A word closed by a line feed: its letters and marks, or it as a whole.
_SPLIT = re.compile(f"{_PLAIN}\n|([^\n]+)\n")


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the lists, and the lists' offsets."""
    ends = np.cumsum([0, *map(len, lists)])
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, ends[-1]), ends


def _numbers(kinds: list[str], words: list[str]) -> np.ndarray:
    return np.fromiter(map(dict(zip(kinds, range(len(kinds)))).__getitem__, words), np.int64, len(words))


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        spec["normalizer"] = None
        spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.short = Tokenizer.from_str(json.dumps(spec))
        suffix, names = spec["model"]["end_of_word_suffix"], self.full.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)  # tokens that end a word
        self.last[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True
        for t in (self.full, self.short):
            t.no_truncation()
            t.no_padding()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the words, sorted
        self.begin = self.length = np.zeros(0, np.int64)  # of their ids
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, raw: bytes) -> None:
        """Encode words not seen before, each closed by a line feed in `raw`: those of letters and marks by parts, each distinct part once."""
        found = _SPLIT.findall(raw.decode("utf-8", "replace"))
        plain = np.fromiter((bool(a) and len(a) + len(b) <= LEAF for a, b, _ in found), bool, len(found))
        split, rest = list(itertools.compress(found, plain)), ["".join(x) for x in itertools.compress(found, ~plain)]
        letters = "\n".join([a for a, _, _ in split]).lower().split("\n") if split else []
        kinds, marks = list(dict.fromkeys(letters)), list(dict.fromkeys(b for _, b, _ in split))
        head, tail = self.lowered(kinds), [e.ids for e in self.full.encode_batch_fast(marks, add_special_tokens=False)]
        brief = [w for w in rest if len(w) <= LEAF]
        others = dict(zip(brief, (e.ids for e in self.full.encode_batch_fast(brief, add_special_tokens=False))))
        whole = [others[w] if len(w) <= LEAF else self.tree(w) for w in rest]
        # a word's ids are those of its letters and of its marks, or of a whole word, all in one list
        flat, ends = _joined([*tail, *whole])
        flat, ends = np.concatenate([head[0], flat]), np.concatenate([head[1], head[1][-1] + ends[1:]])
        number = np.zeros((len(found), 2), np.int64)
        number[plain, 0] = _numbers(kinds, letters)
        number[plain, 1] = len(kinds) + _numbers(marks, [b for _, b, _ in split])
        number[~plain, 0] = len(kinds) + len(marks) + np.arange(len(rest))
        sizes = np.diff(ends)[number]
        sizes[~plain, 1] = 0
        number, size = number.ravel(), sizes.ravel()
        at = np.repeat(ends[number] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        sizes = sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes + len(self.ids)
        here = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.length = (
            np.insert(old, here, new) for old, new in ((self.keys, keys), (self.begin, starts), (self.length, sizes))
        )
        self.ids = np.concatenate([self.ids, flat[at]])

    def lowered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of plain letters in lower case, and the words' offsets: many are encoded as one text and told apart by their last tokens."""
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids, _ = _joined([e.ids for e in self.short.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
        if len(ends) != len(words) + 1 or ends[-1] != len(ids):  # a vocabulary in which some word has no last token
            return _joined([e.ids for e in self.short.encode_batch_fast(words, add_special_tokens=False)])
        return ids, ends

    def tree(self, text: str) -> list[int]:
        """Ids of one unsplit text."""
        cuts = [0, len(text)]
        while cuts[1] - cuts[0] > LEAF:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]))})
        spans = list(zip(cuts, cuts[1:]))
        nodes = [self.spans(e, a) for (a, _), e in zip(spans, self.full.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False))]
        while len(nodes) > 1:
            joined = []
            for i in range(0, len(nodes) - 1, 2):
                (a, m), (_, b) = spans[i], spans[i + 1]
                joined.append((self.join(text, a, m, b, nodes[i], nodes[i + 1]), (a, b)))
            if len(nodes) % 2:
                joined.append((nodes[-1], spans[-1]))
            nodes, spans = [x for x, _ in joined], [s for _, s in joined]
        return [t[2] for t in nodes[0]]

    @staticmethod
    def spans(e, base: int) -> list[tuple[int, int, int]]:
        return [(base + a, base + b, i) for (a, b), i in zip(e.offsets, e.ids)]

    def join(self, text: str, a: int, m: int, b: int, left: list, right: list) -> list:
        reach = REACH
        while True:
            lo, hi = max(a, m - reach), min(b, m + reach)
            mid = self.spans(self.full.encode(text[lo:hi], add_special_tokens=False), lo)
            before = ([], mid) if lo == a else self.agree(left, mid, lo + reach // 4, m - reach // 4)
            if before is not None:
                head, mid = before
                after = (mid, []) if hi == b else self.agree(mid, right, m + reach // 4, hi - reach // 4)
                if after is not None:
                    return head + after[0] + after[1]
            if lo == a and hi == b:
                return mid
            reach *= 2

    @staticmethod
    def agree(one: list, two: list, lo: int, hi: int) -> tuple[list, list] | None:
        """Cut both lists in the middle of [lo, hi) if all their tokens within are the same, three at least."""
        x = [i for i, t in enumerate(one) if lo <= t[0] and t[1] <= hi]
        y = [i for i, t in enumerate(two) if lo <= t[0] and t[1] <= hi]
        if len(x) < 3 or [one[i] for i in x] != [two[i] for i in y] or x[-1] - x[0] + 1 != len(x) or y[-1] - y[0] + 1 != len(y):
            return None
        k = len(x) // 2
        if one[x[k] - 1][1] > one[x[k]][0]:  # bytes of one character: not a place to cut
            return None
        return one[: x[k]], two[y[k] :]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts' ids; a null text is empty. Words are told apart by 64-bit hashes."""
        words = Words(texts)
        keys, at, back = np.unique(words.key, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        starts, size = words.starts[at[new]], words.ends[at[new]] - words.starts[at[new]] + 1
        where = np.repeat(starts - (np.cumsum(size) - size), size)
        where += np.arange(len(where))
        raw = words.data[np.minimum(where, len(words.data) - 1)]
        raw[np.cumsum(size) - 1] = ord("\n")  # which no word holds
        self.learn(keys[new], raw.tobytes())
        pick = np.searchsorted(self.keys, keys)[back]
        lengths = self.length[pick]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(self.begin[pick] - ends[:-1], lengths)
        where += np.arange(len(where))
        return self.ids[where], ends[words.first]

    def decode(self, ids: np.ndarray) -> str:
        return self.full.decode(ids.tolist(), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)

"""Token ids of whole texts by the tokenizers library, with the ids of repeated words kept.

A text is cut at white space where the tokenizer itself always cuts, so the ids of the parts joined are the ids of the
text. Texts for which this isn't certain (other white space than single spaces and line ends, special tokens) are
encoded as a whole. A special token that a text holds literally gets its special id, as in a plain call of the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

#: Words whose ids a worker keeps at most, unless a caller asks for fewer (about 250 bytes each). Half as many make a generation; when it is full, words that the next one
#: doesn't use are dropped with it. Memory is bounded and results don't depend on it.
KEPT_WORDS = 1_200_000
#: New words that are encoded in one run, with a special token between them.
RUN_WORDS = 64
#: Texts whose words are looked up together: few enough for a processor's cache, enough to fill runs of new words.
GROUP_TEXTS = 32

#: White space other than the space and the line feed, and the controls that some libraries count as such.
_OTHER_SPACE = re.compile("[" + "".join(map(chr, (9, 11, 12, 13, *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))) + "]")
#: Letters before a mark that are letters to every version of Unicode, in lower case too.
_SURE = re.compile("[\0-\u012f\u0131-\u04ff]")
#: Marks that may stand for themselves at the end of a word; an apostrophe may belong to the letters.
MARKS = ".,;:!?)]}\"-"
_CONTROL = re.compile("[" + "".join(map(chr, range(28, 32))) + "]")


class WordEncoder:
    """Ids as little-endian unsigned 16-bit or 32-bit integers, by the size of the vocabulary."""

    def __init__(self, path: str, drops_space: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Between two words, a special token ends one and starts the next like the border of a text.
        plain = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.border = plain[0] if plain else None
        suffix = self.tokenizer.model.end_of_word_suffix if drops_space else None
        #: Per id, whether it ends a word; None if ids don't show it.
        self.ending = None
        if suffix:
            self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ending[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        #: Ids of marks that the tokenizer cuts off the letters before them.
        self.marks: dict[str, bytes] = {}
        if suffix:
            letters = self._whole("ab")
            self.marks = {c: self._whole(c) for c in MARKS if self._whole("ab" + c) == letters + self._whole(c)}
        self.limit = KEPT_WORDS
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Where case makes no difference, ASCII words are kept in lower case alone.
        self.lowers = self._whole("AZ") == self._whole("az")
        self.line_end = b"" if drops_space else self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _splits(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        if self.drops_space:
            return not _CONTROL.search(text)
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        return not _OTHER_SPACE.search(text)

    def _words(self, text: str) -> list[str]:
        """With white space kept, a word carries the space or line end before it; a line end stands for the start of the text."""
        if self.drops_space:
            return (text.lower() if self.lowers and text.isascii() else text).split()
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def _learn(self, words: list[str]) -> None:
        """Encode words that no generation holds, many in one run.

        With white space dropped, a word of letters alone is one piece, whose last id shows the end of a word; that
        cuts runs of such words without anything between them. Other words have a special token between them.
        """
        if self.ending is None:
            sources = words if self.drops_space else [w if w[:1] == "\n" else " " + w for w in words]
            self._learn_runs(words, sources, self.border)
            return
        letters, marked, others = [], [], []
        for w in words:
            (letters if w.isalpha() else marked if w[-1] in self.marks and w[:-1].isalpha() and _SURE.match(w[-2]) else others).append(w)
        # A mark after letters is a piece of its own, so only the letters need encoding.
        bare = {w[:-1] for w in marked}.difference(self.kept, letters)
        again = self.older.keys() & bare
        for w in again:
            self.kept[w] = self.older[w]
        others += self._learn_letters(letters + list(bare - again))
        self._learn_runs(others, others, self.border)
        for w in marked:
            self.kept[w] = self.kept[w[:-1]] + self.marks[w[-1]]

    def _learn_letters(self, words: list[str]) -> list[str]:
        """Words of letters; returns those of runs that have not as many ends as words."""
        wrong: list[str] = []
        step = self.dtype.itemsize
        runs = [words[at : at + RUN_WORDS] for at in range(0, len(words), RUN_WORDS)]
        for first in range(0, len(runs), 512):
            members = runs[first : first + 512]
            for run, found in zip(members, self.tokenizer.encode_batch_fast([" ".join(r) for r in members], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, self.dtype)
                ends = ((np.nonzero(self.ending[ids])[0] + 1) * step).tolist()
                if len(ends) != len(run):
                    wrong += run
                    continue
                raw, at = ids.tobytes(), 0
                for word, end in zip(run, ends, strict=True):
                    self.kept[word] = raw[at:end]
                    at = end
        return wrong

    def _learn_runs(self, words: list[str], sources: list[str], border: tuple[int, str] | None) -> None:
        size = RUN_WORDS if border else 1
        mark, text = border or (-1, "")
        step = self.dtype.itemsize
        runs = [text.join(sources[at : at + size]) for at in range(0, len(sources), size)]
        for first in range(0, len(runs), 512):
            for k, found in enumerate(self.tokenizer.encode_batch_fast(runs[first : first + 512], add_special_tokens=False), first):
                members = words[k * size : (k + 1) * size]
                ids = np.array(found.ids, self.dtype)
                raw = ids.tobytes()
                ends = [*(np.nonzero(ids == mark)[0].tolist() if size > 1 else []), len(ids)]
                at = 0
                for word, end in zip(members, ends, strict=True):
                    self.kept[word] = raw[at * step : end * step]
                    at = end + 1

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        return [x for at in range(0, len(texts), GROUP_TEXTS) for x in self._encode(texts[at : at + GROUP_TEXTS])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Every word is looked up once; only those that were missing are looked up again after they are learned."""
        parts = [self._words(t) if self._splits(t) else None for t in texts]
        if len(self.kept) > self.limit // 2:
            self.kept, self.older = {}, self.kept
        words = list(chain.from_iterable(filter(None, parts)))
        found = list(map(self.kept.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = {words[k] for k in missing}
        again = self.older.keys() & new
        for word in again:
            self.kept[word] = self.older[word]
        self._learn(list(new - again))
        for k in missing:
            found[k] = self.kept[words[k]]
        out, at, skip = [], 0, len(self.line_end)
        for text, part in zip(texts, parts, strict=True):
            if part is None:
                out.append(self._whole(text))
            else:
                out.append(b"".join(found[at : at + len(part)])[skip:])
                at += len(part)
        return out


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, drops_space: bool, kept_words: int | None = None) -> WordEncoder:
    """The worker's encoder for this vocabulary file, made once; ``kept_words`` bounds what it keeps from now on."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = WordEncoder(path, drops_space)
    found = _ENCODERS[path, drops_space]
    found.limit = KEPT_WORDS if kept_words is None else kept_words
    return found


def as_u32(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()

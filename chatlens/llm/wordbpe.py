"""Token ids of a word-end BPE vocabulary, with a whole-token shortcut.

A tokenizer file of this kind (NFC, white space folded, lower case, then
pre-tokens: contractions, letter runs, single digits, runs of other signs)
merges inside a pre-token only.  So the ids of a text are those of its
pre-tokens one after another, and many pre-tokens are one vocabulary string.
Here numpy cuts and hashes the pre-tokens of a whole batch; strings proved to
be one token are looked up, and only the distinct rest is merged by the
library.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np

from chatlens.llm.words import BASE, INVERSE, long_spans, mix

SPACE, LETTER, NUMBER, OTHER, UNSURE = 0, 1, 2, 3, 4
#: The white space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Distinct merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 2_000_000

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point; those not assigned are left to the library."""
    if not _CLASSES:
        kind = {"L": LETTER, "N": NUMBER}
        made = np.fromiter((UNSURE if (c := unicodedata.category(chr(i))) in ("Cn", "Cs") else kind.get(c[0], OTHER)
                            for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        made[WHITE] = SPACE
        _CLASSES.append(made)
    return _CLASSES[0]


def prepare(text: str) -> str:
    """The normal form that pre-tokens are cut from."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # lower() would look at the word's end
    return text.lower()


def doubtful(library) -> np.ndarray:
    """Code points that the library treats in another way than ``prepare`` and ``cut``, sorted.

    Its Unicode tables may be older than Python's.  Every assigned code point
    is tried: its normal form alone, decomposed and, for a mark, on both sides
    of a long known mark of each combining class; then its class among pre-tokens.
    """
    kind = classes()
    assigned = np.flatnonzero(kind != UNSURE)
    signs = [chr(c) for c in assigned.tolist() if c != ord("|") and kind[c] != SPACE]
    marks = [c for c in signs if unicodedata.combining(c)]
    of_class = {own: c for c in marks if (own := unicodedata.ucd_3_2_0.combining(c))}
    tried = [("q" + c, c) for c in signs]  # no sign composes with a q
    tried += [("q" + apart, c) for c in signs if not "\uac00" <= c <= "\ud7a3" and (apart := unicodedata.normalize("NFD", c)) != c]
    tried += [(pair, c) for c in marks for other in of_class.values() for pair in ("q" + c + other, "q" + other + c)]
    joined = "|".join(text for text, _ in tried)
    theirs, ours = library.normalizer.normalize_str(joined).split("|"), prepare(joined).split("|")
    odd: set[str] = set()
    for (_, c), x, y in zip(tried, theirs, ours, strict=True):
        if x != y:
            odd |= {c, *(set(y) - set(x))}
    white = [chr(c) for c in WHITE]
    odd |= {c for c in white if library.normalizer.normalize_str(f"a{c}a") != "a a"}

    def differs(block: list[str], own: int) -> bool:
        places = [place for _, place in library.pre_tokenizer.pre_tokenize_str("a" + "".join(block))]
        n = len(block)
        want = {LETTER: [(0, n + 1)], OTHER: [(0, 1), (1, n + 1)], NUMBER: [(0, 1), *((k, k + 1) for k in range(1, n + 1))]}[own]
        return places != want

    for own in (LETTER, NUMBER, OTHER):
        group = [c for c in signs if kind[ord(c)] == own and c != "'"]
        for k in range(0, len(group), 512):
            if differs(group[k: k + 512], own):
                odd |= {c for c in group[k: k + 512] if differs([c], own)}
    return np.array(sorted(map(ord, odd)), np.uint32)


def cut(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every pre-token in an array of code points."""
    kind = classes()[points]
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.r_[np.uint8(SPACE), kind[:-1]]
    start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    mark = np.flatnonzero((points == 39) & (before != OTHER))
    if len(mark):
        ahead = np.r_[points, np.zeros(3, points.dtype)]
        one, two = ahead[mark + 1], ahead[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, width in ((mark[short], 2), (mark[long], 3)):
            start[at + 1] = False
            after = at[at + width < n] + width
            start[after] |= kind[after] == LETTER
    first = np.flatnonzero(start)
    stop = np.r_[first[1:], n]
    gap = np.cumsum(kind == SPACE)
    blank = gap[stop - 1] - gap[first]
    # a pre-token ends at the next start, or where white space begins
    return first, stop - blank


def hashes(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; long inputs go in blocks."""
    out = np.empty(len(first), np.uint64)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (1 << 20))))
        a, z = int(first[lo]), int(end[hi - 1])
        step = np.full(z - a + 1, BASE, np.uint64)
        step[0] = 1
        back = np.full(z - a + 1, INVERSE, np.uint64)
        back[0] = 1
        step, back = np.multiply.accumulate(step), np.multiply.accumulate(back)
        run = np.zeros(z - a + 1, np.uint64)
        np.cumsum(mix(points[a:z].astype(np.uint64) + np.uint64(1)) * step[:-1], out=run[1:])
        f, e = first[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = mix((run[e] - run[f]) * back[f] + (e - f).astype(np.uint64))
        lo = hi
    return long_spans(out, points, first, end)


def whole_tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Offline proof: the strings that alone encode as one token, as (sorted hashes, ids).

    Each vocabulary string with a word end is given to the library and counts
    only if exactly its own id comes back and it is one pre-token here too.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    table = {chr(c): b for b, c in _byte_letters().items()}
    held, ids = [], []
    for name, i in library.get_vocab().items():
        if not name.endswith("</w>") or name in special:
            continue
        try:
            text = bytes(table[c] for c in name[:-4]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and prepare(text) == text:
            held.append(text)
            ids.append(i)
    proved = [k for k, text in enumerate(held) if library.encode(text, add_special_tokens=False).ids == [ids[k]]]
    points = np.frombuffer(" ".join(held[k] for k in proved).encode("utf-32-le"), np.uint32)
    size = np.array([len(held[k]) for k in proved])
    begin = np.cumsum(size + 1) - size - 1
    first, end = cut(points)
    same = np.isin(first, begin) & (end - first == size[np.minimum(np.searchsorted(begin, first), len(size) - 1)])
    keep = np.searchsorted(begin, first[same])
    h = hashes(points, first[same], end[same])
    order = np.argsort(h)
    return h[order], np.array([ids[proved[k]] for k in keep], np.uint32)[order]


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


class Merges:
    """Byte-pair merging of many distinct pre-tokens at once.

    Each round applies, in every pre-token, its pair of lowest rank.  That is
    the library's order as long as no merge is made of a later one, which is
    checked here; pre-tokens over ``LONG`` bytes go to the library, whose time
    grows less with length.
    """

    LONG = 256
    NEVER = np.int32(2**31 - 1)
    SLOTS = 19

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names = model["vocab"]
        letters = _byte_letters()
        self.inner = np.array([names[chr(letters[b])] for b in range(256)], np.int32)
        self.final = np.array([names[chr(letters[b]) + "</w>"] for b in range(256)], np.int32)
        self.width = max(names.values()) + 1
        made: dict[str, int] = {}
        left, right, out = [], [], []
        self.ordered = True
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.ordered &= made.get(x, -1) < rank and made.get(y, -1) < rank and x + y not in made
            made[x + y] = rank
            left.append(names[x])
            right.append(names[y])
            out.append(names[x + y])
        late = [1 for rank, pair in enumerate(model["merges"]) for x in (pair if isinstance(pair, list) else pair.split(" ")) if made.get(x, -1) >= rank]
        self.ordered &= not late
        key = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        self.slot_key = np.full(1 << self.SLOTS, -1, np.int64)
        self.slot = np.zeros(1 << self.SLOTS, np.int32)
        self.out = np.array(out, np.int32)
        rest = np.arange(len(key))
        self.probes = 0
        while len(rest):  # a key lies in the first free slot from its own on
            at = self._slot(key[rest]) + self.probes & (1 << self.SLOTS) - 1
            free = self.slot_key[at] < 0
            self.slot_key[at[free]], self.slot[at[free]] = key[rest][free], rest[free]
            rest = rest[self.slot_key[at] != key[rest]]
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NEVER`` where it does not merge."""
        at = self._slot(key)
        rank = np.full(len(key), self.NEVER)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            held = self.slot_key[at]
            hit = held == key[todo]
            rank[todo[hit]] = self.slot[at[hit]]
            go = ~hit & (held >= 0)
            todo, at = todo[go], at[go] + 1 & (1 << self.SLOTS) - 1
            if not len(todo):
                break
        return rank

    def ids(self, raw: np.ndarray, bound: np.ndarray, library) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words ``raw[bound[i]:bound[i+1]]`` one after another, and where each word's end."""
        size = np.diff(bound)
        hard = size > self.LONG if self.ordered else np.ones(len(size), bool)
        done_own, done = [], []
        for i in np.flatnonzero(hard).tolist():
            ids = library.encode(raw[bound[i]: bound[i + 1]].tobytes().decode(), add_special_tokens=False).ids
            done.append(np.array(ids, np.int32))
            done_own.append(np.full(len(ids), i))
        symbol = self.inner[raw]
        symbol[bound[1:] - 1] = self.final[raw[bound[1:] - 1]]
        own = np.repeat(np.arange(len(size)), size)
        if hard.any():
            symbol, own = symbol[~hard[own]], own[~hard[own]]
        while len(symbol):
            new = np.r_[True, own[1:] != own[:-1]]
            head = np.flatnonzero(new)
            rank = np.full(len(symbol), self.NEVER)
            rank[:-1] = self._ranks(symbol[:-1].astype(np.int64) * self.width + symbol[1:])
            rank[:-1][new[1:]] = self.NEVER
            least = np.minimum.reduceat(rank, head)
            length = np.diff(np.r_[head, len(symbol)])
            over = np.repeat(least == self.NEVER, length)
            done.append(symbol[over])
            done_own.append(own[over])
            join = (rank == np.repeat(least, length)) & ~over
            spot = np.flatnonzero(join)
            if (np.diff(spot) == 1).any():  # of overlapping pairs the first, third, ... merge
                fresh = np.r_[True, np.diff(spot) > 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
                spot = spot[(np.arange(len(spot)) - run) % 2 == 0]
            symbol[spot] = self.out[rank[spot]]
            stay = ~over
            stay[spot + 1] = False
            symbol, own = symbol[stay], own[stay]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        own = np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return np.concatenate(done)[order].astype(np.uint32), np.cumsum(np.bincount(own, minlength=len(size)))


class WordBpe:
    """Ids of whole texts, equal to the library's for every text.

    ``doubt`` holds the code points whose texts are left to the library
    (``doubtful``, found here where it is not given).
    """

    def __init__(self, path: str, whole: tuple[np.ndarray, np.ndarray], doubt: np.ndarray | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.unsure = classes() == UNSURE
        self.unsure[doubtful(self.library) if doubt is None else doubt] = True
        self.merges = Merges(path)
        self.whole = whole
        self.forget()

    def forget(self) -> None:
        """Known pre-tokens: at first the whole tokens; ids lie in ``flat[at:at + many]``."""
        self.known, self.flat = self.whole
        self.at, self.many = np.arange(len(self.known)), np.ones(len(self.known), np.int64)

    def _learn(self, points, first, end, h) -> None:
        size = end - first
        stop = np.cumsum(size)
        point = points[np.arange(int(stop[-1])) - np.repeat(stop - size, size) + np.repeat(first, size)]
        width = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        raw = np.frombuffer(point.tobytes().decode("utf-32-le").encode(), np.uint8)
        ids, last = self.merges.ids(raw, np.r_[0, np.cumsum(width)[stop - 1]], self.library)
        many = np.diff(np.r_[0, last])
        at = len(self.flat) + last - many
        self.flat = np.concatenate([self.flat, ids])
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.many = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.many, many])[order]

    def _places(self, texts: list[str | None]):
        """Where each pre-token's ids lie, which text it is in, and the texts left to the library."""
        alone, ready = {}, []
        for i, text in enumerate(texts):
            text = text or ""
            if any(s in text for s in self.special):
                alone[i] = text
                text = ""
            ready.append(prepare(text))
        points = np.frombuffer("\n".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, ready), np.int64, len(ready))
        begin = np.cumsum(size + 1) - size - 1
        odd = np.flatnonzero(self.unsure[points])
        if len(odd):
            points = points.copy()
            for i in np.unique(np.searchsorted(begin, odd, side="right") - 1).tolist():
                alone[i] = texts[i]
                points[begin[i]: begin[i] + size[i]] = 32
        first, end = cut(points)
        own = np.searchsorted(begin, first, side="right") - 1
        h, one, back = np.unique(hashes(points, first, end), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > REMEMBERED + len(self.whole[0]):
            self.forget()
        where = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        new = self.known[where] != h
        if new.any():
            self._learn(points, first[one[new]], end[one[new]], h[new])
            where = np.searchsorted(self.known, h)
        return where[back], own, alone

    def _batches(self, column):
        """Texts in runs of about 2 MB, so that memory follows no batch's size."""
        run, held = [], 0
        for text in column.to_pylist():
            run.append(text)
            held += len(text or "")
            if held > 1 << 21:
                yield run
                run, held = [], 0
        if run:
            yield run

    def counts(self, column) -> np.ndarray:
        """Number of tokens of each text of an Arrow column."""
        out = [np.zeros(0, np.int64)]
        for texts in self._batches(column):
            where, own, alone = self._places(texts)
            n = np.bincount(own, weights=self.many[where], minlength=len(texts)).astype(np.int64)
            for i, text in alone.items():
                n[i] = len(self.library.encode(text, add_special_tokens=False).ids)
            out.append(n)
        return np.concatenate(out)

    def ids(self, column) -> list[np.ndarray]:
        """Token ids of each text of an Arrow column."""
        out: list[np.ndarray] = []
        for texts in self._batches(column):
            where, own, alone = self._places(texts)
            many = self.many[where]
            stop = np.cumsum(many)
            flat = self.flat[np.arange(int(many.sum())) - np.repeat(stop - many, many) + np.repeat(self.at[where], many)]
            bound = np.r_[0, stop][np.searchsorted(own, np.arange(len(texts) + 1))]
            run = [flat[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            for i, text in alone.items():
                run[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            out += run
        return out


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str, whole: tuple[np.ndarray, np.ndarray], doubt: np.ndarray) -> WordBpe:
    """One tokenizer per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path, whole, doubt)
    return _LOADED[path]


def proofs(path: str) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """What is proved once, on the driver: the whole tokens and the doubtful code points."""
    from tokenizers import Tokenizer

    return whole_tokens(path), doubtful(Tokenizer.from_file(path))

"""BPE encoding by speculation and verification, and decoding.

A word's tokens are proposed by greedy longest match. A proposal equals the result of merging iff
every token encodes to itself and every two neighbours are *compatible*: when the two tokens are
built by merges in rank order, no merge across their border comes before the merges inside. Both
tests are table look-ups over whole arrays of pairs. Only words with a failing pair are merged
exactly, all of them side by side, one merge of each word a step.

Words repeat, so each Python worker keeps the ids of recent words (at most ``CACHE_WORDS`` and a block's; a
full cache is emptied, which changes speed, never results).

Edge cases: null texts count as empty; empty texts have no ids; texts of any length are encoded whole;
repeated rows are encoded alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from weftline.session import prepare

#: Words whose ids a worker keeps, and letters of theirs.
CACHE_WORDS, CACHE_LETTERS = 400_000, 1 << 23
#: Words of more bytes are merged one at a time.
SHORT = 48
#: Classes of letters.
SPACES, LETTER, DIGIT, OTHER = range(4)
#: Stands for "no merge".
NEVER = np.int64(1 << 40)
#: From this letter on, also where lower-casing leads there, texts are split by the library's Unicode tables.
LATIN_END = "\u0250"
#: Unicode White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters
    stand for themselves, the others for code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, token strings and split rules of one tokenizer file (BPE over bytes with word ends)."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        kinds = [x["type"] for x in data["normalizer"]["normalizers"]]
        split = data["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or data["decoder"]:
            raise ValueError("this tokenizer file has parts that the encoder does not know")
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for text, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = text
        self.rule = split["pattern"]["Regex"]
        # letters beyond Latin: their classes differ between Unicode versions, so the tokenizers
        # library's own normalising and splitting decide
        self.clean = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.space = re.compile(f"[{SPACE}]+")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.left, self.right = np.arange(size), np.arange(size)
        self.born = np.full(size, -1, dtype=np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (pair.split(" ") if isinstance(pair, str) else pair)
            a, b, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs.setdefault((a, b), (rank, made))
            if self.born[made] < 0:
                self.left[made], self.right[made], self.born[made] = a, b, rank
        self.size = size
        keys = np.fromiter((a * size + b for a, b in self.pairs), dtype=np.int64, count=len(self.pairs))
        ranks = np.fromiter((r for r, _ in self.pairs.values()), dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.made = np.fromiter((m for _, m in self.pairs.values()), dtype=np.int64, count=len(self.pairs))[order]
        self.sound = self._sound()
        self._build_trie()

    def _build_trie(self) -> None:
        """Token strings by byte. ``inner`` and ``last`` hold the token that ends at a node, before
        the end of a word and at it; -1 is none. Children stand in a table for the first two
        bytes, deeper ones in sorted keys ``node * 256 + byte``."""
        back = {c: b for b, c in self.letters.items()}
        self.byte_ids = np.array([self.ids[self.letters[b]] for b in range(256)])
        self.end_ids = np.array([self.ids[self.letters[b] + self.end] for b in range(256)])
        children: dict[int, int] = {}
        ends: list[tuple[int, int, bool]] = []
        count = 1
        for text, t in self.ids.items():
            at_end = text.endswith(self.end)
            node = 0
            for c in text.removesuffix(self.end) if at_end else text:
                key = node * 256 + back[c]
                if key not in children:
                    children[key] = count
                    count += 1
                node = children[key]
            ends.append((node, t, at_end))
        self.inner, self.last = np.full(count, -1), np.full(count, -1)
        for node, t, at_end in ends:
            (self.last if at_end else self.inner)[node] = t
        keys = np.fromiter(children.keys(), dtype=np.int64, count=len(children))
        nodes = np.fromiter(children.values(), dtype=np.int64, count=len(children))
        order = np.argsort(keys)
        self.trie_keys, self.trie_nodes = keys[order], nodes[order]
        self.first = self._child(np.zeros(256, dtype=np.int64), np.arange(256))
        self.second = self._child(np.repeat(self.first, 256), np.tile(np.arange(256), 256))

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, -1 if there is none."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
        return np.where((self.trie_keys[at] == key) & (node >= 0), self.trie_nodes[at], -1)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def clash(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """Whether a merge across the border of tokens a and b comes before the merges inside.

        Merges are undone from the latest: ``x`` is the last part of a and ``y`` the first part of b
        at that time, and ``x_ends``, ``y_ends`` are the ranks at which they are merged into more.
        Equal merges run from the left, so one on the border beats only an equal one right of it.
        """
        bad = np.zeros(len(a), dtype=bool)
        rows, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        x_ends, y_ends = np.full(len(a), NEVER), np.full(len(a), NEVER)
        top = skip_top
        while len(rows):
            if not top:
                q = self.rank_of(x, y)
                hit = (q < NEVER) & (q < x_ends) & (q <= y_ends)
                bad[rows[hit]] = True
            top = False
            bx, by = self.born[x], self.born[y]
            go = (bx >= 0) | (by >= 0)
            go &= ~bad[rows]
            rows, x, y, x_ends, y_ends, bx, by = (v[go] for v in (rows, x, y, x_ends, y_ends, bx, by))
            undo_x = bx > by
            x_ends, y_ends = np.where(undo_x, bx, x_ends), np.where(undo_x, y_ends, by)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return bad

    def _sound(self) -> np.ndarray:
        """Tokens that encode to themselves."""
        made = np.flatnonzero(self.born >= 0)
        good = np.ones(self.size, dtype=bool)
        good[made] = ~self.clash(self.left[made], self.right[made], skip_top=True)
        for t in made[np.argsort(self.born[made])]:
            good[t] &= good[self.left[t]] and good[self.right[t]]
        return good

    def propose(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for words ``flat[start:end]``, all words a token at a time.
        Returns tokens and the word of each, in order."""
        word, at = np.arange(len(starts)), starts.astype(np.int64)
        tokens, words = [], []
        flat = np.append(flat, [0, 0]).astype(np.int64)
        while len(word):
            stop = ends[word]
            best = np.where(at + 1 == stop, self.end_ids[flat[at]], self.byte_ids[flat[at]])
            reach = at + 1
            live = np.flatnonzero(at + 2 <= stop)
            node = self.second[flat[at[live]] * 256 + flat[at[live] + 1]]
            depth = 2
            while True:
                ok = node >= 0
                live, node = live[ok], node[ok]
                if not len(live):
                    break
                final = at[live] + depth == stop[live]
                t = np.where(final, self.last[node], self.inner[node])
                hit = t >= 0
                best[live[hit]] = t[hit]
                reach[live[hit]] = at[live[hit]] + depth
                live, node = live[~final], node[~final]
                if not len(live):
                    break
                node = self._child(node, flat[at[live] + depth])
                depth += 1
            tokens.append(best)
            words.append(word)
            more = reach < stop
            word, at = word[more], reach[more]
        words = np.concatenate(words)
        order = np.argsort(words, kind="stable")
        return np.concatenate(tokens)[order], words[order]

    def merge_many(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of words side by side. Returns a matrix of ids and their number by row."""
        n, sizes = len(starts), ends - starts
        width = int(sizes.max())
        column = np.arange(width)
        inside = column < sizes[:, None]
        ids = self.byte_ids[flat[np.where(inside, starts[:, None] + column, 0)].astype(np.int64)]
        rows = np.arange(n)
        ids[rows, sizes - 1] = self.end_ids[flat[ends - 1].astype(np.int64)]
        ranks = np.full((n, width), NEVER)
        pair = column[:-1] + 1 < sizes[:, None]
        ranks[:, :-1][pair] = self.rank_of(ids[:, :-1][pair], ids[:, 1:][pair])
        out, left = ids.copy(), sizes.copy()
        while len(rows):
            j = ranks.argmin(axis=1)
            k = np.arange(len(rows))
            go = ranks[k, j] < NEVER
            if not go.all():
                done = ~go
                out[rows[done], : ids.shape[1]], left[rows[done]] = ids[done], sizes[done]
                rows, ids, ranks, sizes, j = rows[go], ids[go], ranks[go], sizes[go], j[go]
                if not len(rows):
                    break
                k = np.arange(len(rows))
            made = self.made_of(ids[k, j], ids[k, j + 1])
            shift = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > j[:, None])
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            sizes = sizes - 1
            ids[k, j] = made
            ranks[k, j] = NEVER
            ranks[:, -1] = NEVER
            has = j + 1 < sizes
            ranks[k[has], j[has]] = self.rank_of(made[has], ids[k[has], j[has] + 1])
            has = j > 0
            ranks[k[has], j[has] - 1] = self.rank_of(ids[k[has], j[has] - 1], made[has])
        return out, left

    def made_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.made[np.searchsorted(self.keys, a * self.size + b)]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, with a heap: for long words."""
        ids = [*self.byte_ids[[*word[:-1]]].tolist(), int(self.end_ids[word[-1]])] if len(word) > 1 else [int(self.end_ids[word[0]])]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.pairs[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.pairs[a, b][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], k, *p))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def encode_flat(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the non-empty words ``flat[start:end]`` and the number of each word's ids: propose
        all, test all pairs at once, merge the failures."""
        sizes = ends - starts
        tokens, owner = self.propose(flat, starts, ends)
        failed = np.zeros(len(starts), dtype=bool)
        failed[owner[~self.sound[tokens]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            keys, back = np.unique(tokens[inside] * self.size + tokens[inside + 1], return_inverse=True)
            failed[owner[inside[self.clash(keys // self.size, keys % self.size)[back]]]] = True
        keep = ~failed[owner]
        tokens, owner = [tokens[keep]], [owner[keep]]
        for i in np.flatnonzero(failed & (sizes > SHORT)):
            tokens.append(np.array(self.merge(flat[starts[i] : ends[i]].tobytes())))
            owner.append(np.full(len(tokens[-1]), i))
        short = np.flatnonzero(failed & (sizes <= SHORT))
        short = short[np.argsort(sizes[short], kind="stable")]
        for part in np.array_split(short, max(1, len(short) // 20_000)):
            if len(part):
                ids, left = self.merge_many(flat, starts[part], ends[part])
                tokens.append(ids[np.arange(ids.shape[1]) < left[:, None]])
                owner.append(np.repeat(part, left))
        tokens, owner = np.concatenate(tokens), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.bincount(owner, minlength=len(starts))

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """``encode_flat`` for a list of words."""
        if not words:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        starts = np.concatenate([[0], ends[:-1]])
        tokens, counts = self.encode_flat(np.frombuffer(b"".join(words), dtype=np.uint8), starts, ends)
        return [part.tolist() for part in np.split(tokens, np.cumsum(counts)[:-1])]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts by their distinct words, which are found and told apart by array operations.

    Texts whose letters, also in lower case, all lie below ``LATIN_END`` and that hold no special
    token are cut by a table of letter classes; a word is looked up by a 64-bit hash and compared with
    the known one letter by letter. Other texts, and those in which two words have one hash, are
    normalised and cut by the tokenizers library and encoded by the same vocabulary.
    """

    #: Letters hashed at a time.
    BLOCK = 1 << 21

    def __init__(self, spec: str) -> None:
        v = self.vocabulary = Vocabulary(spec)
        # the file's rule as runs of a class, a lone digit, and contractions after a run's start
        if v.rule != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("this tokenizer file cuts words by another rule")
        end = ord(LATIN_END)
        self.kind = np.array([SPACES if v.space.match(chr(i)) else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(end)], dtype=np.uint8)
        # letters that lower-casing takes beyond the tables, such as U+018F
        leaving = "".join(c for c in map(chr, range(end)) if any(ord(x) >= end for x in c.lower()))
        self.beyond = re.compile(f"[{leaving}{LATIN_END}-\U0010ffff]|" + ("|".join(map(re.escape, v.special)) or "(?!)"))
        rng = np.random.default_rng(20)
        self.letter = rng.integers(1, 1 << 63, end, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15
        self.powers = np.cumprod(np.full(self.BLOCK + 1, base, dtype=np.uint64))
        self.unpowers = np.cumprod(np.full(self.BLOCK + 1, pow(base, -1, 1 << 64), dtype=np.uint64))
        self.forget()

    def forget(self) -> None:
        self.keys, self.spots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.letters, self.places, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.counts, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _cut(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in an array of lower-case letters that begins and ends with white space."""
        kind = self.kind[code]
        first = kind != SPACES
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        quote = np.flatnonzero((code == ord("'")) & first)
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            a, b = code[quote + 1], code[np.minimum(quote + 2, len(code) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            first[quote[one | two] + 1] = False
            for after in (quote[one] + 2, quote[two] + 3):
                first[after] |= kind[after] == LETTER
        starts = np.flatnonzero(first)
        # a word ends where the next starts or white space begins
        stop = first.copy()
        stop[1:] |= (kind[1:] == SPACES) & (kind[:-1] != SPACES)
        marks = np.flatnonzero(stop)
        ends = marks[np.searchsorted(marks, starts, side="right")]
        return starts, ends

    @staticmethod
    def _same(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> bool:
        """Whether words of one array are, letter by letter, those of another."""
        return bool((sizes == wanted).all() and (code[ragged(starts, sizes)] == other[ragged(places, wanted)]).all())

    def _numbers(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word among the known ones; new words are encoded first."""
        sums = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(self.letter[code] * self.powers[: len(code)], out=sums[1:])
        key = (sums[ends] - sums[starts]) * self.unpowers[starts]
        size = ends - starts
        unique, index, back = np.unique(key, return_index=True, return_inverse=True)
        if not self._same(code, starts, size, code, starts[index][back], size[index][back]):
            raise ArithmeticError("two words have one hash")
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), dtype=bool)
        old = at[~new]
        if not self._same(code, starts[index[~new]], size[index[~new]], self.letters, self.places[old], self.sizes[old]):
            raise ArithmeticError("two words have one hash")
        if new.any():
            index = index[new]
            own = code[ragged(starts[index], size[index])]
            letters = own.astype(np.int64)
            wide = letters >= 128
            spot = np.cumsum(1 + wide) - (1 + wide)
            flat = np.zeros(int((1 + wide).sum()), dtype=np.uint8)
            flat[spot] = np.where(wide, 0xC0 | (letters >> 6), letters)
            flat[spot[wide] + 1] = 0x80 | (letters[wide] & 0x3F)
            cut = np.cumsum(size[index])
            spot = np.append(spot, len(flat))
            tokens, counts = self.vocabulary.encode_flat(flat, spot[cut - size[index]], spot[cut])
            spots = len(self.tokens) + np.cumsum(counts) - counts
            self.tokens = np.concatenate([self.tokens, tokens.astype(np.uint32)])
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            places = len(self.letters) + np.cumsum(size[index]) - size[index]
            self.places = np.concatenate([self.places, places])[order]
            self.sizes = np.concatenate([self.sizes, size[index]])[order]
            self.letters = np.concatenate([self.letters, own])
            self.spots = np.concatenate([self.spots, spots])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            at = np.searchsorted(self.keys, unique)
        return at[back]

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are short together."""
        if len(self.keys) > CACHE_WORDS or len(self.letters) > CACHE_LETTERS:
            self.forget()
        joined = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(joined.lower().encode("utf-16-le"), dtype=np.uint16)
        starts, ends = self._cut(code)
        try:
            at = self._numbers(code, starts, ends)
        except ArithmeticError:
            self.forget()
            return [self._other(t) for t in texts]
        counts = self.counts[at]
        raw = memoryview(self.tokens[ragged(self.spots[at], counts)].astype("<u4").tobytes())
        edges = np.cumsum([1 + len(t) for t in texts])
        cut = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)].tolist()
        return [bytes(raw[4 * a : 4 * b]) for a, b in zip([0, *cut], cut, strict=False)]

    def _other(self, text: str) -> bytes:
        """Ids of a text with letters from anywhere or with special tokens."""
        v, found, at = self.vocabulary, [], 0
        for m in [*v.specials.finditer(text), None]:
            part = v.clean.normalize_str(text[at : m.start() if m else len(text)])
            words = [w for w, _ in v.split.pre_tokenize_str(part)] if part else []
            once = list(set(words))
            known = dict(zip(once, v.encode_words([w.encode() for w in once]), strict=True))
            found += [t for w in words for t in known[w]]
            if m:
                found.append(v.special[m[0]])
                at = m.end()
        return np.array(found, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        found, block, size = [b""] * len(texts), [], 0

        def flush() -> None:
            nonlocal block, size
            if block:
                for i, ids in zip(block, self._block([texts[i] for i in block]), strict=True):
                    found[i] = ids
            block, size = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self.BLOCK - 8 or not text.isascii() and self.beyond.search(text) or "<|" in text and self.beyond.search(text):
                found[i] = self._other(text)
                continue
            if size + len(text) + 1 > self.BLOCK - 8:
                flush()
            block.append(i)
            size += len(text) + 1
        flush()
        return found

    def decode(self, ids: bytes) -> str:
        """The token strings, joined with blanks: what a file without a decoder asks for."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast tokenizer file."""
    spec = shared.value
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def share(spark, path: str):
    """Broadcast a tokenizer file (a few MB whatever the data), so that executors need no copy."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(batch: pa.RecordBatch, name: str, shared) -> list[bytes]:
    return encoder(shared).encode_batch(batch.column(name).to_pylist())


def bpe_encode(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row, in place: the kept columns, ``ids`` (array of int) and ``decoded``.

    No shuffle: one pass over the rows that Spark's readers deal out.
    """
    spark = prepare(docs.sparkSession)
    shared = share(spark, path)
    kept = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def work(batches):
        for batch in batches:
            coded = encode_column(batch, text, shared)
            decode = encoder(shared).decode
            ids = pa.array([np.frombuffer(b, dtype="<i4") for b in coded], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array(map(decode, coded), pa.string())], names=[*keep, "ids", "decoded"])

    return kept.mapInArrow(work, f"{schema}, ids array<int>, decoded string")


def bpe_digest(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Like ``bpe_encode``, with digests in place of the ids and the decoded text."""
    import hashlib

    spark = prepare(docs.sparkSession)
    shared = share(spark, path)
    kept = docs.select(key, text)
    kind = kept.schema[0].dataType.simpleString()

    def work(batches):
        for batch in batches:
            coded = encode_column(batch, text, shared)
            decode = encoder(shared).decode
            columns = {
                key: batch.column(0),
                "n_tokens": pa.array([len(b) // 4 for b in coded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(decode(b).encode()).hexdigest() for b in coded], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return kept.mapInArrow(work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_lengths(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """One ``n_tokens`` per row, in place."""
    spark = prepare(docs.sparkSession)
    shared = share(spark, path)

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array([len(b) // 4 for b in encode_column(batch, text, shared)], pa.int64())})

    return docs.select(text).mapInArrow(work, "n_tokens long")

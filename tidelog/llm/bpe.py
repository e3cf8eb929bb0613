"""Byte-pair tokenizer files: a transducer with bounded lookahead, memories of chunks, and an incremental decoder.

Texts are cut at single spaces; most chunks have been met before, and their ids come from a bounded memo.

Every new word, of any length, goes through `Transducer` (one that ends within its window is settled there, in one
search; a longer one is streamed): the merge list gives M, the length of its longest token.
The tokens of a text's first i symbols are the tokens up to the last one's start, and the last one; and the
tokens of a whole text, cut at a token's end, are the tokens of that part. So the final tokens pass through one
of the last M ends, and what the paths to all of these share is stable: it is emitted, and only the ends since
are kept. Which token is last at i needs nothing but the last ones at earlier ends: the one token that ends at
i and forms a compatible pair (two tokens that, encoded together, stay as they are) with the last one where
it starts.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import regex

MAX_MEMO = 250_000
NONE = 1 << 40


class Memo(dict):
    """What `make` gives for a key, remembered in two generations of at most MAX_MEMO keys each."""

    def __init__(self, make, longest: int = 64):
        super().__init__()
        self.make, self.longest, self.old = make, longest, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= MAX_MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = v
        return v


@cache
def byte_chars() -> list[str]:
    """The visible character that stands for each byte in vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def chunked(texts) -> tuple:
    """A string array cut at single spaces: (the chunks' places in the list of distinct ones, that list, each
    text's first chunk and the end)."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts, " ")
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


class Merges:
    """The merge list over symbols; every symbol and token is an id of the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str | None):
        self.vocab, self.end = vocab, end or ""
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars] if end else self.first
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] << 20 | vocab[b], i)
            self.made.append(vocab[a + b])
        self.text = {i: t for t, i in vocab.items()}
        self._tables = self._transducer = None

    def symbols(self, word: bytes) -> list[int]:
        s = [self.first[b] for b in word]
        if s and self.end:
            s[-1] = self.last[word[-1]]
        return s

    def merged(self, ids: list[int]) -> list[int]:
        """The lowest rank first, leftmost first."""
        get, made = self.rank.get, self.made
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == NONE:
                break
            i = ranks.index(r)
            t = ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | t, NONE)
            if i < len(ranks):
                ranks[i] = get(t << 20 | ids[i + 1], NONE)
        return ids

    def word(self, word: bytes) -> list[int]:
        if self._transducer is None:
            self._transducer = Transducer(self)
        symbols = self.symbols(word)
        return self._transducer.settle(symbols) if len(symbols) <= 2 * self._transducer.lookahead else list(self._transducer.encode(symbols))

    def tables(self):
        """(edges and ends of a trie of tokens' symbols, M, a token's symbols) for tokens that merges make."""
        if self._tables is None:
            parts: dict[int, tuple[int, ...]] = {i: (i,) for i in {*self.first, *self.last}}
            for k, r in sorted(self.rank.items(), key=lambda x: x[1]):
                a, b, t = k >> 20, k & 0xFFFFF, self.made[r]
                if t not in parts and a in parts and b in parts:
                    parts[t] = parts[a] + parts[b]
            edges: dict[int, int] = {}
            ends: dict[int, int] = {}
            for t, p in parts.items():
                node = 0
                for x in p:
                    node = edges.setdefault(node << 20 | x, len(edges) + 1)
                ends[node] = t
            self._tables = edges, ends, max(map(len, parts.values())), parts
        return self._tables


class Transducer:
    """Symbols in, stable tokens out."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.edges, self.tokens, self.lookahead, self.parts = merges.tables()
        self.pairs: dict[int, bool] = {}
        self.stays: dict[int, bool] = {}
        #: a token's last merge: its rank (-1 for symbols), and the two tokens that it joins
        self.split: dict[int, tuple[int, int, int]] = {i: (-1, i, i) for i in {*merges.first, *merges.last}}
        self.most_kept = self.words = 0

    def compatible(self, a: int, b: int) -> bool:
        k = a << 20 | b
        if (ok := self.pairs.get(k)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[k] = self._stay_apart(a, b)
        return ok

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge joins the two. Backwards in time, the later made of the two tokens at the boundary is undone;
        what stands there, x and y, would be joined if their rank comes before both are used up: x by a merge
        on its left, which goes first among equals, y by one on its right."""
        x, y = a, b
        x_used = y_used = NONE
        while True:
            q = self.m.rank.get(x << 20 | y, NONE)
            if q < x_used and q <= y_used and q != NONE:
                return False
            (rx, _, xr), (ry, yl, _) = self._made(x), self._made(y)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, x_used = xr, rx
            else:
                y, y_used = yl, ry

    def _made(self, t: int) -> tuple[int, int, int]:
        if (at := self.split.get(t)) is None:
            ids, rank = [*self.parts[t]], self.m.rank
            while len(ids) > 2:  # all merges but the last
                ranks = [rank.get(u << 20 | v, NONE) for u, v in zip(ids, ids[1:], strict=False)]
                i = ranks.index(min(ranks))
                ids[i : i + 2] = [self.m.made[ranks[i]]]
            at = self.split[t] = rank[ids[0] << 20 | ids[1]], *ids
        return at

    def whole(self, t: int) -> bool:
        """A token's symbols encode to the token."""
        if (ok := self.stays.get(t)) is None:
            ok = self.stays[t] = self.m.merged([*self.parts[t]]) == [t]
        return ok

    def settle(self, symbols: list[int]) -> list[int]:
        """A word that ends within the lookahead's window, which is settled at its end: the one path of compatible
        tokens, the longest tried first. Of each place at most one last token is right, so a place from which no path
        leads on is tried once."""
        self.words += 1
        step, token, pairs, stays, n = self.edges.get, self.tokens.get, self.pairs.get, self.stays.get, len(symbols)
        path: list[tuple[int, int, list]] = []
        dead: set[int] = set()

        def from_(at):
            node, out = 0, []
            for j in range(at, n):
                if (node := step(node << 20 | symbols[j])) is None:
                    break
                if (t := token(node)) is not None and (stays(t) or self.whole(t)):
                    out.append((t, j + 1))
            return out

        before, at, left = None, 0, from_(0)
        while at < n:
            while left:
                t, end = left.pop()
                if end not in dead and (before is None or pairs(before << 20 | t) or self.compatible(before, t)):
                    path.append((t, at, left))
                    before, at, left = t, end, from_(end)
                    break
            else:
                dead.add(at)
                _, at, left = path.pop()
                before = path[-1][0] if path else None
        return [t for t, _, _ in path]

    def encode(self, symbols: Iterable[int]) -> Iterator[int]:
        self.words += 1
        step, token, pairs, stays = self.edges.get, self.tokens.get, self.pairs.get, self.stays.get
        # ends[i]: (last token, its start) at kept ends; base is where emitted tokens stop
        ends: dict[int, tuple[int, int]] = {}
        base, i, before, most = 0, 0, None, 2 * self.lookahead
        active = [(0, 0)]  # ends that tokens may go on from, and where these are in the trie
        for s in symbols:
            i += 1
            going, found = [], None
            for start, node in active:
                if (node := step(node << 20 | s)) is None:
                    continue
                going.append((start, node))
                if found is None and (t := token(node)) is not None and (stays(t) or self.whole(t)):
                    prev = before if start == base else ends[start][0]
                    if prev is None or pairs(prev << 20 | t) or self.compatible(prev, t):
                        found = t, start
            if found:
                ends[i] = found
                going.append((i, 0))
            active = going
            if i - base > most:
                self.most_kept = max(self.most_kept, len(ends))
                for t, at in self._stable(ends, base, i):
                    yield t
                    before, base = t, at
                for e in [e for e in ends if e <= base]:
                    del ends[e]
                active = [x for x in active if x[0] >= base]
        self.most_kept = max(self.most_kept, len(ends))
        path, at = [], i
        while at > base:
            t, at = ends[at]
            path.append(t)
        yield from reversed(path)

    def _stable(self, ends, base, i):
        """The tokens that the paths to all of the last M ends share."""
        live = {e for e in range(i - self.lookahead + 1, i + 1) if e in ends}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(ends[top][1])
        out, at = [], live.pop() if live else base
        while at > base:
            t, start = ends[at]
            out.append((t, at))
            at = start
        return reversed(out)


class Decoder:
    """Incremental: ids in, text out as soon as it is whole; broken bytes become U+FFFD."""

    def __init__(self, merges: Merges, special: dict[int, str] | None = None, byte_level: bool = True):
        self.text, self.special, self.byte_level = merges.text, special or {}, byte_level
        self.byte = {c: b for b, c in enumerate(byte_chars())} if byte_level else {}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def reset(self) -> None:
        self.utf8.reset()
        self.started = False

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        if not self.byte_level:  # no decoder in the file: the tokens' own strings with spaces between
            out = [self.special.get(i) or self.text[i] for i in ids]
            if out and self.started:
                out.insert(0, "")
            self.started = self.started or bool(out)
            return " ".join(out)
        for i in ids:
            t = self.special.get(i) or self.text[i]
            if i in self.special:
                out.append(self.utf8.decode(b"", True) + t)
                self.utf8.reset()
            else:
                out.append(self.utf8.decode(bytes(self.byte[c] for c in t)))
        return "".join(out)

    def end(self) -> str:
        return self.utf8.decode(b"", True) if self.byte_level else ""


class WordTokenizer:
    """A file of the kind: NFC, white space, lower case; letters, single digits, runs of other signs; word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        m = j["model"]
        self.merges = Merges(m["vocab"], m["merges"], m.get("end_of_word_suffix"))
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.decoder = {i: s for s, i in self.special.items()}
        self.machine = Decoder(self.merges, self.decoder, False)
        self.words, self.memo = Memo(self.word_entry), Memo(self.entry)

    def normal(self, s: str) -> str:
        if s.isascii():
            return s.lower()
        s = unicodedata.normalize("NFC", s)
        return "".join(c.lower() for c in s) if "\u03a3" in s else s.lower()  # no rule for a sigma that ends a word

    def pieces(self, chunk: str) -> Iterator[str | int]:
        """The words of a chunk, and ids of special tokens."""
        for part in self.cut.split(chunk) if self.cut and "<|" in chunk else [chunk]:
            if part in self.special:
                yield self.special[part]
            else:
                yield from self.find(self.normal(part))

    def chunk_ids(self, chunk: str) -> list[int]:
        return [i for w in self.pieces(chunk) for i in ([w] if isinstance(w, int) else self.merges.word(w.encode()))]

    def shown(self, ids: list[int]) -> tuple[int, str, str]:
        """(number, decimal ids, decoded): what the decoder says of ids depends on what stands before them only by the space
        between tokens, so that a text's parts can be decoded apart, once each."""
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def word_entry(self, word: str) -> tuple[int, str, str]:
        return self.shown(self.merges.word(word.encode()))

    def entry(self, chunk: str) -> tuple[int, str, str]:
        low = self.normal(chunk)
        if low.isalpha():
            return self.words[low]
        if low and low[-1] in ".," and low[:-1].isalpha():
            got = [self.words[low[:-1]], self.words[low[-1]]]
        else:
            got = [self.shown([w]) if isinstance(w, int) else self.words[w] for w in self.pieces(chunk)]
        return sum(g[0] for g in got), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])

    def encode(self, text: str) -> list[int]:
        return [i for c in text.split(" ") for i in self.chunk_ids(c)]

    def decode(self, ids: Iterable[int]) -> str:
        self.machine.reset()
        return self.machine.feed(ids) + self.machine.end()

    def summaries(self, texts) -> tuple:
        """A string array to (numbers of ids, decimal ids joined, decoded texts). Each distinct chunk of the
        batch is looked up once; the rest is arrays."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, chunks, bounds = chunked(texts)
        starts = bounds
        got = [self.memo[c] for c in chunks]
        n = np.array([g[0] for g in got], dtype=np.int64)[at] if len(at) else np.zeros(0, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(n)])
        if len(n) and not n.all():  # chunks without ids: they get no space, either
            some = n > 0
            bounds = np.concatenate([[0], np.cumsum(some)])[bounds]
            at = at[some]
        totals = np.diff(sums[starts])
        out = []
        for k in (1, 2):
            parts = pa.array([g[k] for g in got], pa.large_string()).take(pa.array(at))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), parts), pa.scalar(" ", pa.large_string())))
        return totals, *out


class ByteTokenizer:
    """A byte-level file; ids as the tokenizers library gives them. Chunks at single spaces are tokenized apart,
    as the file's own pattern never joins a space with what stands before it, unless white space does."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.np = np
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.merges = Merges(j["model"]["vocab"], j["model"]["merges"], None)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u2" if max([*j["model"]["vocab"].values(), *self.special.values()]) < 65536 else "<u4"
        self.find = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
        self.words, self.memo = Memo(self.word_ids), Memo(self.chunk)
        try:
            import tiktoken

            ranks = {bytes(own[c] for c in t): i for t, i in j["model"]["vocab"].items()} if (own := {c: b for b, c in enumerate(byte_chars())}) else {}
            self.piece = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        except ImportError:
            self.piece = self.merges.word

    def word_ids(self, word: str) -> bytes:
        return self.np.array(self.piece(word.encode()), dtype=self.kind).tobytes()

    def chunk(self, c: str) -> bytes | None:
        """The ids of a chunk with the space before it; None: it can't be taken apart from its neighbours."""
        if c.isalpha():
            return self.words[" " + c]
        if not c or c[0].isspace() or c[-1].isspace() or "<|" in c or "|>" in c:
            return None
        if c[-1] in ".," and c[:-1].isalpha():
            return self.words[" " + c[:-1]] + self.words[c[-1]]
        return b"".join([self.words[w] for w in self.find(" " + c)])

    def encode_batch(self, texts) -> list[bytes]:
        """A string array to packed ids. Each distinct chunk of the batch is looked up once."""
        import pyarrow as pa

        np = self.np
        cut = [(t or "").partition(" ") for t in texts.to_pylist()]
        at, chunks, bounds = chunked(pa.array([c if b else None for _, b, c in cut], pa.string()))
        got = [self.memo[c] for c in chunks]
        odd = np.array([g is None for g in got], dtype=bool)
        odd_texts = set(np.searchsorted(bounds, np.flatnonzero(odd[at]), "right") - 1) if odd.any() else set()
        size = np.array([len(g or b"") for g in got], dtype=np.int64) // np.dtype(self.kind).itemsize
        pool, first = np.frombuffer(b"".join([g or b"" for g in got]), dtype=self.kind), np.cumsum(size) - size
        n = size[at] if len(at) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else pool
        out, ends = [], ends[bounds]
        for i, (head, _, _) in enumerate(cut):
            if i in odd_texts or head and self.chunk(head) is None or not head and bounds[i + 1] > bounds[i]:
                out.append(np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=self.kind).tobytes())
            else:
                out.append(b"".join([self.words[w] for w in self.find(head)]) + ids[ends[i] : ends[i + 1]].tobytes())
        return out

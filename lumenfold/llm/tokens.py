"""Token counts and ids from a compiled finite-state tokenizer.

The pre-tokenizer's pattern is compiled into a deterministic transducer over symbol classes of UTF-8 bytes. A text's bytes
are cut into equal chunks; all chunks run side by side, each from every state, and give a map from entry state to exit
state. A parallel prefix scan composes these maps, so each chunk learns its true entry state, and a second run marks the
transitions that close a span. Within a span a second transducer, compiled from the vocabulary's merges, runs over the bytes and counts the tokens that each transition
completes; a lexicon keeps its result for each distinct span, compared byte by byte. The counts of spans are added by prefix sums. Texts that hold a special
token's string go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .hashing import prefix_sums, span_hash
from .textbuf import Texts, narrow, record, steps

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of a chunk whose state map is composed with others'.
CHUNK = 256
#: Distinct spans that a worker's lexicon holds before it starts anew.
LEXICON = 1 << 20

# Symbols: what a byte is to the pre-tokenizer.
END, LETTER, NUMBER, OTHER, SHORT, LONG, LEAD_SPACE, LAST_SPACE, SPACE, INNER = range(10)
# States: fresh; in letters, numbers, other, white space; after a space that joins what follows; one or two letters left of a contraction.
FRESH, IN_L, IN_N, IN_O, IN_W, JOIN, ONE_LEFT, TWO_LEFT = range(8)
#: The rank of a pair that no merge joins.
NEVER = 1 << 40
#: White space of the pattern (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def _classes() -> np.ndarray:
    """Symbol of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, chars):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = symbol  # no run crosses the gap, which lies between other symbols
    table[WHITE] = SPACE
    return table


@lru_cache
def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a span begins, both at 16 * state + symbol."""
    to, opens = np.zeros((8, 16), np.uint8), np.ones((8, 16), np.uint8)
    for s in range(8):
        to[s, LETTER], to[s, NUMBER], to[s, OTHER], to[s, SPACE] = IN_L, IN_N, IN_O, IN_W
        to[s, LEAD_SPACE], to[s, LAST_SPACE], to[s, END] = JOIN, FRESH, FRESH
        to[s, SHORT], to[s, LONG] = (IN_O, IN_O) if s in (IN_O, JOIN) else (ONE_LEFT, TWO_LEFT)
        to[s, INNER], opens[s, INNER] = s, 0
    for s, symbols in ((IN_L, [LETTER]), (IN_N, [NUMBER]), (IN_O, [OTHER, SHORT, LONG]), (IN_W, [SPACE]), (JOIN, [LETTER, NUMBER, OTHER, SHORT, LONG])):
        opens[s, symbols] = 0
    to[TWO_LEFT, LETTER], to[ONE_LEFT, LETTER] = ONE_LEFT, FRESH
    opens[[TWO_LEFT, ONE_LEFT], LETTER] = 0
    return to.ravel(), opens.ravel()


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """table[x] for bytes."""
    return np.frombuffer(x.tobytes().translate(table.tobytes().ljust(256)), np.uint8).reshape(x.shape)


def _symbols(buf: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Symbol of each byte; stops: places of the byte after each text."""
    classes = _classes()
    first = np.full(256, INNER, np.uint8)
    first[:128] = classes[:128]
    out = _through(first, buf).copy()
    wide = np.flatnonzero(buf >= 0xC0)
    at = np.flatnonzero(out == SPACE)
    then = at + 1
    if len(wide):
        padded = np.concatenate([buf, np.zeros(4, np.uint8)])
        lead = buf[wide].astype(np.int32)
        b1, b2, b3 = (padded[wide + k].astype(np.int32) & 63 for k in (1, 2, 3))
        cp = np.where(lead < 0xE0, (lead & 31) << 6 | b1, np.where(lead < 0xF0, (lead & 15) << 12 | b1 << 6 | b2, (lead & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        out[wide] = classes[np.minimum(cp, 0x10FFFF)]
        long_white = wide[out[wide] == SPACE]
        at, then = np.concatenate([at, long_white]), np.concatenate([then, long_white + np.where(buf[long_white] < 0xE0, 2, 3)])
    out[stops] = END
    ends = (out[then] != SPACE) & (out[then] != END)  # the last white space of a run that a text goes on after
    at = at[ends]
    out[at] = np.where(buf[at] == 32, LEAD_SPACE, LAST_SPACE)
    at = np.flatnonzero(buf == 39)
    if len(at):
        padded = np.concatenate([buf, np.zeros(2, np.uint8)])
        b1, b2 = padded[at + 1], padded[at + 2]
        one = np.isin(b1, list(b"stmd"))
        two = ((b1 == ord("r")) | (b1 == ord("v"))) & (b2 == ord("e")) | (b1 == ord("l")) & (b2 == ord("l"))
        out[at[one]] = SHORT
        out[at[two]] = LONG
    return out


def _opens(symbols: np.ndarray) -> np.ndarray:
    """Where spans begin: chunk maps, their prefix scan, and the marking run."""
    to, opens = _transducer()
    n = len(symbols)
    k = -(-n // CHUNK)
    padded = np.full(k * CHUNK, END, np.uint8)
    padded[:n] = symbols
    steps_ = np.ascontiguousarray(padded.reshape(k, CHUNK).T)
    # the map of each chunk: one lane a state, until all lanes of all chunks have met
    lanes = np.repeat(np.arange(8, dtype=np.uint8)[:, None], k, axis=1)
    met = None
    for j in range(CHUNK):
        if met is None:
            lanes = _through(to, (lanes << 4) | steps_[j])
            if j % 8 == 7 and (lanes == lanes[0]).all():
                met = lanes[0]
        else:
            met = _through(to, (met << 4) | steps_[j])
    maps = np.ascontiguousarray(lanes.T) if met is None else np.repeat(met[:, None], 8, axis=1)
    d = 1
    while d < k and met is None:  # constant maps are their own prefix
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), axis=1)
        d *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    marks = np.empty((CHUNK, k), np.uint8)
    for j in range(CHUNK):
        at = (state << 4) | steps_[j]
        marks[j] = at
        state = _through(to, at)
    return np.flatnonzero(_through(opens, marks.T)[:].ravel()[:n])


class Lexicon:
    """Distinct spans, their bytes and ids, found by hash in an open table; bounded: a full one starts anew."""

    def __init__(self, encode, size: int = LEXICON):
        self.encode, self.size = encode, size
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(2 * self.size, np.uint64)
        self.places = np.full(2 * self.size, -1, np.int32)
        self.n, self.used = 0, 0
        self.off = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.at = np.zeros(1024, np.int64)  # where each span's bytes begin and end
        self.bytes = np.zeros(8192, np.uint8)

    def same(self, place: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the spans of `buf` are, byte by byte, those at these places. `buf` and the kept bytes have 8 more bytes than their spans."""
        mine = self.at[place]
        size = end - start
        out = self.at[place + 1] - mine == size
        here, there = (np.ndarray((len(b) - 7,), "<u8", b, 0, (1,)) for b in (buf, self.bytes))
        left = np.flatnonzero(out)
        for k in range(0, int(size.max(initial=0)), 8):
            left = left[size[left] > k]
            short = np.minimum(size[left] - k, 8).astype(np.uint64)
            differ = (here[start[left] + k] ^ there[mine[left] + k]) << (np.uint64(64) - np.uint64(8) * short)
            out[left[differ != 0]] = False
            left = left[differ == 0]
        return out

    def keep(self, spans: list[bytes]) -> np.ndarray:
        """Places of new spans, without entries in the table."""
        ids, off = self.encode(spans)
        size = np.cumsum([0, *map(len, spans)])
        while self.n + len(off) > len(self.off):
            self.off, self.at = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.off, self.at))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        first = int(self.at[self.n])
        while first + size[-1] + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes), np.uint8)])
        self.bytes[first : first + size[-1]] = np.frombuffer(b"".join(spans), np.uint8)
        self.at[self.n + 1 : self.n + len(off)] = first + size[1:]
        self.ids[self.used : self.used + len(ids)] = ids
        self.off[self.n + 1 : self.n + len(off)] = self.used + off[1:]
        places = np.arange(self.n, self.n + len(spans), dtype=np.int32)
        self.n, self.used = self.n + len(spans), self.used + len(ids)
        return places

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        slot = (h & mask).astype(np.int64)
        place = self.places[slot]
        place[(self.slots[slot] != h) & (place >= 0)] = -2
        wrong = np.flatnonzero(place == -2)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & int(mask)
            s = slot[wrong]
            place[wrong] = np.where(self.slots[s] == h[wrong], self.places[s], np.where(self.places[s] < 0, -1, -2))
            wrong = wrong[place[wrong] == -2]
        return place

    def lookup(self, h: np.ndarray, span) -> np.ndarray:
        """Places of hashes; span(i) gives the bytes of the i-th."""
        place = self._find(h)
        missing = np.flatnonzero(place < 0)
        if not len(missing):
            return place
        new, which = np.unique(h[missing], return_index=True)
        if self.n and self.n + len(new) > self.size:
            self.clear()
            return self.lookup(h, span)
        places = self.keep([span(i) for i in missing[which].tolist()])
        if self.n > len(self.slots) // 2:  # one step with more distinct spans than the bound
            old = np.flatnonzero(self.places >= 0)
            new, places = np.concatenate([self.slots[old], new]), np.concatenate([self.places[old], places])
            size = 4 << self.n.bit_length()
            self.slots, self.places = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self._put(new, places)
        return self._find(h)

    def _put(self, new: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (new & np.uint64(mask)).astype(np.int64)
        while len(slot):
            free = np.flatnonzero(self.places[slot] < 0)
            self.places[slot[free]] = places[free]  # of several for one slot, the last stays
            won = free[self.places[slot[free]] == places[free]]
            self.slots[slot[won]] = new[won]
            rest = np.ones(len(slot), bool)
            rest[won] = False
            new, places, slot = new[rest], places[rest], (slot[rest] + 1) & mask


class Merges:
    """A byte-pair vocabulary as a deterministic transducer over a span's bytes.

    Whatever follows, the tokens of a span's beginning end with one token, so the state at a place is the last token before it. A transition reads the bytes of a token that may follow that one and
    counts one token; every place has exactly one. Two tokens may
    stand side by side if no merge across their border would come before the merges that make them; this is read off the merges' ranks once for each pair that is met.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], whole: bool = False):
        import ahocorasick

        self.id, self.whole = vocabulary, whole
        self.names = {i: token for token, i in vocabulary.items()}
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.start = max(self.names) + 1  # the state before a span's first byte
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.spines: dict[str, tuple | None] = {}
        self.beside: dict[int, bool] = {}

    def _spine(self, token: str) -> tuple[list, list] | None:
        """How a token's first and last pieces grow: (piece, rank of the merge that takes it), on the left and on the right side; null if merges don't make the token."""
        if token not in self.spines:
            pieces, sides = list(token), ([(token[0], -1)], [(token[-1], -1)])
            while len(pieces) > 1:
                rank, at = min((self.rank.get(pair, NEVER), k) for k, pair in enumerate(zip(pieces, pieces[1:])))
                if rank == NEVER:
                    break
                new = pieces[at] + pieces[at + 1]
                if at == 0:
                    sides[0].append((new, max(rank, sides[0][-1][1])))
                if at == len(pieces) - 2:
                    sides[1].append((new, max(rank, sides[1][-1][1])))
                pieces[at : at + 2] = [new]
            self.spines[token] = tuple([(p, side[k + 1][1] if k + 1 < len(side) else NEVER) for k, (p, _) in enumerate(side)] for side in sides) if len(pieces) == 1 else None
        return self.spines[token]

    def follows(self, one: str, two: str) -> bool:
        """Whether the merges leave these two side by side: at no time does a merge of the pieces at their border come before the next merge of either. Of equal merges the one further left comes first."""
        left, right, i, j = self._spine(two), self._spine(one), 0, 0
        if left is None or right is None:
            return False
        while True:
            (r, next_r), (l, next_l) = right[1][i], left[0][j]
            rank = self.rank.get((r, l), NEVER)
            if rank < next_r and rank <= next_l and rank != NEVER:
                return False
            if next_r == next_l == NEVER:
                return True
            if next_r <= next_l:
                i += 1
            else:
                j += 1

    def _may_follow(self, before: int, token: int) -> bool:
        ok = self._spine(self.names[token]) is not None if before == self.start else self.follows(self.names[before], self.names[token])
        self.beside[before << 32 | token] = ok
        return ok

    def tokens(self, span: str) -> list[int]:
        """The ids of a span, in the alphabet of the vocabulary."""
        if self.whole and span in self.id:
            return [self.id[span]]
        last, sizes, known = [self.start] + [-1] * len(span), [0] * (len(span) + 1), self.beside.get
        for end, (token, size) in self.automaton.iter(span):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                ok = known(before << 32 | token)
                if ok or ok is None and self._may_follow(before, token):
                    last[end], sizes[end] = token, size
        out, at = [], len(span)
        while at:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return out


@lru_cache
def _alphabet() -> str:
    """The character that a byte-level vocabulary has for each byte: printable ones themselves, the others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


class CompiledTokenizer:
    """Counts and ids of whole texts as the library gives them for a byte-level BPE vocabulary, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, bool(model.get("ignore_merges")))
        self.lexicon = Lexicon(self._annotate)

    def _annotate(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans end to end, and their offsets, from the compiled merges."""
        alphabet = _alphabet()
        parts = [self.merges.tokens(span.decode("latin-1").translate(alphabet)) for span in spans]
        return np.array([i for p in parts for i in p], np.uint32), np.cumsum([0, *map(len, parts)])

    def _spans(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lexicon's place of each span, the first span of each text and which texts go to the library."""
        raw, off = texts.buf.tobytes(), texts.off.tolist()
        whole = [i for i in range(len(texts)) if any(s in raw[off[i] : off[i + 1]] for s in self.special)] if any(s in raw for s in self.special) else []
        pieces = [raw[a:b] for a, b in zip(off, off[1:])]
        for i in whole:
            pieces[i] = b""
        buf = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
        opens = _opens(_symbols(buf, stops))
        last = np.searchsorted(opens, stops)  # each stop opens a span of its own
        start, end = np.delete(opens, last), np.delete(np.concatenate([opens[1:], [len(buf)]]), last)
        sums = prefix_sums(buf)
        place = self.lexicon.lookup(span_hash(sums, start, end), lambda i: buf[start[i] : end[i]].tobytes())
        other = np.flatnonzero(~self.lexicon.same(place, np.concatenate([buf, np.zeros(8, np.uint8)]), start, end))
        if len(other):  # different spans of one hash
            place[other] = self.lexicon.keep([buf[start[i] : end[i]].tobytes() for i in other.tolist()])
        return place, np.concatenate([[0], last - np.arange(len(last))]), np.array(whole, np.int64)

    def counts(self, texts: Texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0, np.int64)
        place, first, whole = self._spans(texts)
        size = np.diff(self.lexicon.off[: self.lexicon.n + 1])
        total = np.concatenate([[0], np.cumsum(size[place])])
        out = total[first[1:]] - total[first[:-1]]
        for i in whole.tolist():
            out[i] = len(self._library_ids(texts.raw(i)))
        return out

    def _library_ids(self, raw: bytes) -> list[int]:
        return self.library.encode_batch_fast([raw.decode("utf-8", "replace")], add_special_tokens=False)[0].ids

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end as uint32, and n + 1 offsets."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        place, first, whole = self._spans(texts)
        lex = self.lexicon
        size = (lex.off[1 : lex.n + 1] - lex.off[: lex.n])[place]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = lex.ids[np.repeat(lex.off[place] - total[:-1], size) + np.arange(total[-1])]
        off = total[first]
        if len(whole):
            parts = [ids[a:b] for a, b in zip(off.tolist(), off[1:].tolist())]
            for i in whole.tolist():
                parts[i] = np.array(self._library_ids(texts.raw(i)), np.uint32)
            ids, off = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, off


class LibraryTokenizer:
    """Any other vocabulary file, asked text by text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda strings: model.encode(strings, num_threads=1)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self.encode = lambda strings: [e.ids for e in library.encode_batch_fast(strings, add_special_tokens=False)]

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(x, np.uint32) for x in self.encode([texts.raw(i).decode("utf-8", "replace") for i in range(len(texts))])]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def counts(self, texts: Texts) -> np.ndarray:
        return np.diff(self.ids(texts)[1])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CompiledTokenizer | LibraryTokenizer:
    """Compiled if the file is a byte-level BPE with the pattern above and no normaliser; kept for a worker's later tasks."""
    if path.endswith(".json"):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE":
            return CompiledTokenizer(path)
    return LibraryTokenizer(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Repeated rows give repeated rows, null doc_ids stay null, other columns
    are ignored, an empty table gives an empty result. Whole texts, nothing is cut.
    """
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            n = tokenizer(path).counts(texts)
            yield record(schema, batch.column(0), np.diff(texts.off), n, n > limit)

    return narrow(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

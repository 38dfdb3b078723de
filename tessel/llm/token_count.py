"""Token counts of a byte-level BPE tokenizer, by a compiled transducer.

The tokenizer first cuts a text into pretokens with a fixed pattern, then encodes each pretoken alone. The pattern is compiled to a
deterministic transducer over classes of characters (CLASSES x STATES): a transition says whether a pretoken begins at this
character, or began at the one before. A text is cut into chunks; each chunk's map from any state to its end state is worked out for all
chunks at once, the maps compose by a parallel prefix scan, and a second run from the now known states emits the cuts.

Inside a pretoken a second transducer runs over bytes, and its transitions are annotated with the number of tokens by which the encoding grows
(which may be below 0). It rests on a property of BPE: a row of tokens is the encoding of its bytes if each two neighbours are that of
theirs, which the merges that lead to the two decide alone. So the last token at a place is the one that fits the last token at its own
start, and a state holds, for every start from which a token could still grow: the node reached in the trie of the vocabulary, the last token
before that start, and the count there. Transitions are compiled from vocabulary and merges as they are first met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import blocks as B

CHUNK = 64
LIMIT = 512
KEEP = 1 << 20  # pretokens whose count a worker keeps
TRANSITIONS = 1 << 19  # compiled transitions that a worker keeps

# Classes of characters: a space; other white space; the letters that contractions need, and all others; numbers; the apostrophe; the rest.
SP, WS, L_STMD, L_R, L_V, L_L, L_E, L, N, APOS, O = range(11)
# States: at the start, or in a run of letters, numbers or others; after white space whose last is a space, or not, alone or not;
# after an apostrophe that may begin a contraction, that and r or v, that and l; after a whole contraction.
START, IN_L, IN_N, IN_O, S_SP, S_WS, M_SP, M_WS, AP, AP_RV, AP_L, CON = range(12)
# What a transition emits: bit 1, a pretoken begins at this character; bit 2, one began at the character before.
HERE, BEFORE = 1, 2


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    to, emit = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)
    letters = (L_STMD, L_R, L_V, L_L, L_E, L)
    run_of = {**{c: IN_L for c in letters}, N: IN_N, APOS: IN_O, O: IN_O}
    for c in range(11):
        for s in range(12):
            white = s in (S_SP, S_WS, M_SP, M_WS)
            if c in (SP, WS):
                # The first white space of a run begins a pretoken; those after it go on, all but the last one (see below).
                to[c, s] = (M_SP if c == SP else M_WS) if white else (S_SP if c == SP else S_WS)
                emit[c, s] = 0 if white else HERE
                continue
            run = run_of[c]
            if s == M_SP:  # "   x": the run up to the last space is one pretoken, the last space goes with x
                to[c, s], emit[c, s] = run, BEFORE
            elif s == S_SP:  # " x": one pretoken
                to[c, s], emit[c, s] = run, 0
            elif s == M_WS:  # the last white space is a pretoken of its own
                to[c, s], emit[c, s] = (AP if c == APOS else run), BEFORE | HERE
            elif s == AP and c in (L_STMD,):
                to[c, s], emit[c, s] = CON, 0
            elif s == AP and c in (L_R, L_V):
                to[c, s], emit[c, s] = AP_RV, HERE  # taken back if e follows
            elif s == AP and c == L_L:
                to[c, s], emit[c, s] = AP_L, HERE  # taken back if l follows
            elif s == AP_RV and c == L_E or s == AP_L and c == L_L:
                to[c, s], emit[c, s] = CON, 4  # bit 4: the cut before the letter before doesn't hold
            elif s == AP and run == IN_O:
                to[c, s], emit[c, s] = IN_O, 0
            elif s in (AP_RV, AP_L) and run == IN_L:
                to[c, s], emit[c, s] = IN_L, 0
            elif run == {IN_L: IN_L, IN_N: IN_N, IN_O: IN_O}.get(s):
                to[c, s], emit[c, s] = run, 0
            else:
                to[c, s], emit[c, s] = (AP if c == APOS else run), HERE
    return to, emit


TO, EMIT = _transitions()


def scan(maps: np.ndarray) -> np.ndarray:
    """maps[i]: state after chunk i for each state before it. Returns the state before each chunk, from START: the maps compose in log2 steps."""
    n = len(maps)
    done = maps.copy()
    step = 1
    while step < n:
        done[step:] = np.take_along_axis(done[step:], done[:-step], 1)
        step *= 2
    return np.concatenate([[START], done[:-1, START]]).astype(np.uint8) if n else np.zeros(0, np.uint8)


def cuts(classes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Where pretokens begin (bool by character). At resets (bool) a new text begins: the state is START whatever came before."""
    n = len(classes)
    if not n:
        return np.zeros(0, bool)
    width = -(-n // CHUNK)
    c = np.full(width * CHUNK, L, np.uint8)
    c[:n] = classes
    r = np.zeros(width * CHUNK, bool)
    r[:n] = resets
    c, r = np.ascontiguousarray(c.reshape(width, CHUNK).T), np.ascontiguousarray(r.reshape(width, CHUNK).T)
    maps = np.tile(np.arange(12, dtype=np.uint8), (width, 1))
    flat = TO.ravel()
    for i in range(CHUNK):
        maps[r[i]] = START
        maps = flat[c[i][:, None].astype(np.int16) * 12 + maps]
    state = scan(maps)
    out = np.empty((CHUNK, width), np.uint8)
    emit = EMIT.ravel()
    for i in range(CHUNK):
        state[r[i]] = START
        k = c[i].astype(np.int16) * 12 + state
        out[i] = emit[k]
        state = flat[k]
    e = out.T.ravel()[:n]
    begins = (e & HERE) != 0
    begins[:-1] |= (e[1:] & BEFORE) != 0
    undo = np.flatnonzero(e & 4)
    begins[undo - 1] = False
    return begins


def _alphabet() -> np.ndarray:
    """Bytes that print as themselves do; the others take the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, np.uint32)
    out[own] = own
    rest = [b for b in range(256) if b not in set(own)]
    out[rest] = 256 + np.arange(len(rest))
    return out


_ALPHABET = _alphabet()


class Merges:
    """The transducer of byte-pair merges: step[state << 8 | byte] is (next state, tokens more)."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte_of = {int(c): b for b, c in enumerate(_ALPHABET.tolist())}
        # Tokens are numbered as they come to be: single bytes, then merges in their order.
        number: dict[str, int] = {chr(c): b for c, b in byte_of.items()}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for m in merges:
            x, y = m.split(" ") if isinstance(m, str) else m
            if x + y in number or x + y not in vocab:
                raise ValueError(f"a token of one merge alone is expected: {x + y}")
            number[x + y] = self.joined[number[x], number[y]] = len(self.parts)
            self.parts.append((number[x], number[y]))
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.grows: set[int] = set()
        for text, k in number.items():
            node = 0
            for ch in text:
                to = self.child.get(node << 8 | byte_of[ord(ch)])
                if to is None:
                    to = self.child[node << 8 | byte_of[ord(ch)]] = len(self.token)
                    self.grows.add(node)
                    self.token.append(-1)
                node = to
            self.token[node] = k
        self.fits: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        first = ((0, -1, 0),)
        self.step: dict[int, tuple[int, int]] = {}
        self.states, self.number_of = [first], {first: 0}

    def pair(self, x: int, y: int) -> bool:
        """Whether the encoding of x's bytes and y's is x, y: no merge across the border comes before those that make x and y."""
        key = x << 32 | y
        known = self.fits.get(key)
        if known is not None:
            return known
        made_x = made_y = len(self.parts)  # the merges that take x and y in: one across the border stands in the way if it comes before both
        good = True
        while True:
            across = self.joined.get((x, y))
            if across is not None and across < made_x and across <= made_y:
                good = False
                break
            # Undo the later of the two merges; of merges of one rank, that on the left came first.
            if x >= 256 and x > y:
                made_x, x = x, self.parts[x][1]
            elif y >= 256:
                made_y, y = y, self.parts[y][0]
            else:
                break
        if len(self.fits) > TRANSITIONS:
            self.fits.clear()
        self.fits[key] = good
        return good

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        live, last, more = [], -1, 0
        for node, before, count in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            live.append((to, before, count))
            t = self.token[to]
            if last < 0 and t >= 0 and (before < 0 or self.pair(before, t)):
                last, more = t, count + 1
        after = (*((n, b, c - more) for n, b, c in live if n in self.grows), (0, last, 0))
        to = self.number_of.get(after)
        if to is None:
            to = self.number_of[after] = len(self.states)
            self.states.append(after)
        self.step[state << 8 | byte] = to, more
        return to, more

    def count(self, data: bytes) -> int:
        """Tokens of one pretoken."""
        if len(self.step) > TRANSITIONS:
            self._clear()
        state = n = 0
        step, longest = self.step, 2 * TRANSITIONS
        for b in data:
            got = step.get(state << 8 | b)
            if got is None:
                if len(step) > longest:  # one pretoken of endless kinds: its state goes on in an empty table
                    now = self.states[state]
                    self._clear()
                    step, state = self.step, len(self.states)
                    self.states.append(now)
                    self.number_of[now] = state
                got = self._compile(state, b)
            state, more = got
            n += more
        return n


class Counts:
    """One process's compiled transducer: classes of the characters seen, and the annotations of the pretokens seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self.pre = self.tok.pre_tokenizer
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.classes = np.full(0x110000, 255, np.uint8)
        for ch, k in ((" ", SP), ("'", APOS), ("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E), *((x, L_STMD) for x in "stmd")):
            self.classes[ord(ch)] = k
        self.keys, self.values = np.zeros(0, B.U), np.zeros(0, np.int32)

    def class_of(self, ch: str) -> int:
        """The library's own opinion of a character: what it makes one pretoken with."""
        one = lambda s: len(self.pre.pre_tokenize_str(s)) == 1
        return L if one("a" + ch) else N if one("1" + ch) else O if one("!" + ch) else WS

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, without special tokens added; special tokens inside a text are found first, as the library does."""
        extra = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            parts = [t]
            for s in self.special:
                if s in t:
                    cut = [p.split(s) for p in parts]
                    extra[i] += sum(len(p) - 1 for p in cut)
                    parts = [x for p in cut for x in p]
            for p in parts:
                if p:
                    pieces.append(p)
                    owner.append(i)
        if not pieces:
            return extra
        return extra + np.bincount(owner, self._plain(pieces), len(texts)).astype(np.int64)

    def _plain(self, texts: list[str]) -> np.ndarray:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        cls = self.classes[code]
        if (cls == 255).any():
            for x in np.unique(code[cls == 255]):
                self.classes[x] = self.class_of(chr(x))
            cls = self.classes[code]
        resets = np.zeros(len(code), bool)
        resets[begin] = True
        starts = np.flatnonzero(cuts(cls, resets) | resets)
        # Hash pretokens on bytes.
        data = np.frombuffer(joined.encode(), np.uint8)
        byte_at = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
        a, e = byte_at[starts], byte_at[np.append(starts[1:], len(code))]
        keys, at, where = np.unique(B.span_hashes(data, a, e), return_index=True, return_inverse=True)
        tokens = self._annotations(keys, [(int(a[i]), int(e[i])) for i in at], data)
        doc = np.searchsorted(begin, starts, "right") - 1
        return np.bincount(doc, tokens[where], len(texts))

    def _annotations(self, keys: np.ndarray, spans: list, data: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[spot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), np.int64)
        out[known] = self.values[spot[known]] if known.any() else 0
        fresh = np.flatnonzero(~known)
        if len(fresh):
            got = [self.merges.count(data[slice(*spans[i])].tobytes()) for i in fresh]
            out[fresh] = got
            if len(self.keys) + len(fresh) > KEEP:
                self.keys, self.values = np.zeros(0, B.U), np.zeros(0, np.int32)
            k = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(k)
            self.keys, self.values = k[order], np.concatenate([self.values, np.array(got, np.int32)])[order]
        return out


_LOADED: dict[str, Counts] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) added; columns of these names are replaced.

    path: a byte-level BPE tokenizer file on every machine. A null or empty text has no tokens; repeated rows count alike."""
    names = ["n_bytes", "n_tokens", "over_limit"]
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean").fields])
    fields = [f.name for f in schema.fields]

    @B.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Counts(path)
        counts = _LOADED[path]
        for batch in batches:
            for part in B.cut(batch, text, 1 << 21):
                col = part.column(text)
                n = counts.count([x or "" for x in col.to_pylist()])
                size = pa.compute.binary_length(col).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, size, pa.array(n), pa.array(n > limit)], fields)

    return docs.mapInArrow(run, schema)

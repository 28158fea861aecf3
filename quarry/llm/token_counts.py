"""Token counts of a byte-level BPE tokenizer by finite-state compilation.

Two deterministic transducers stand for the tokenizer. The first cuts a text into
pre-tokens: 13 states over 12 classes of characters, each transition saying which
of the last characters begins a pre-token. The second counts the merged tokens
inside a pre-token: its states hold what the end of the bytes read so far can
still be merged into (the last tokens at the places where a vocabulary entry may
have begun), and each transition carries the number of tokens that it adds to, or
takes from, the count. Its states are compiled when first met, into arrays that a
worker keeps for all tasks of a job; beyond ``most_states`` they are begun anew.

Texts are cut into chunks of fixed length, and all chunks of a batch run through
the transducers at once. For every chunk the map from each entry state to its exit
state, and for the second transducer the count on the way, is worked out; the maps
compose through a parallel prefix scan. Behind the begin of a pre-token a map of
the second transducer is constant; inside a pre-token that is longer than a chunk
it is worked out for every state that can enter there. A long text, or a long
pre-token, is thus worked on in as many places as it has chunks.

Two adjacent tokens are compatible if merging their joined bytes gives just the
two, that is, if no merge across their border comes before the merges that take the
pieces beside it; a list of tokens is what the merges give if all neighbours are compatible,
so the last token at every place is the one entry that is compatible with the
last token before it.

Defined cases: a null or empty text has no tokens; strings of special tokens
inside a text count as the library's default takes them, one token each; null
ids, repeated rows and ties pass through; a very long text is cut into blocks of
chunks like a batch of texts; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, small_batches

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 512
#: Characters taken together through the first transducer.
BLOCK_CHARS = 2_000_000
#: Bytes of a chunk of the second transducer.
BYTES = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

STATES = "start one_space one_blank spaces blanks letters digits signs quote quote_r quote_v quote_l short".split()
#: "end" stands behind every text.
CLASSES = "stmd r v l e letter digit sign quote space blank end".split()
#: White space of the pattern's \s beyond ASCII and the two Latin-1 ones.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """The class of every code point."""
    c = {name: k for k, name in enumerate(CLASSES)}
    out = np.full(0x110000, c["sign"], np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = c["letter"]
        elif kind == "N":
            out[point] = c["digit"]
    out[SPACES] = c["blank"]
    out[0x20] = c["space"]
    for letter in "stmd":
        out[ord(letter)] = c["stmd"]
    for letter in "rvle":
        out[ord(letter)] = c[letter]
    out[ord("'")] = c["quote"]
    return out


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cuts by state and class; cut bit 0: here, bit 1: one character back."""
    s, c = ({n: k for k, n in enumerate(names)} for names in (STATES, CLASSES))
    kind = {name: "letters" for name in ("stmd", "r", "v", "l", "e", "letter")} | {"digit": "digits", "sign": "signs", "quote": "signs"}
    step = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    cuts = np.zeros_like(step)
    for state in STATES:
        for name in CLASSES:
            if name == "end":
                to, cut = "start", 0
            elif name in ("space", "blank"):
                in_run = state in ("one_space", "one_blank", "spaces", "blanks")
                to, cut = (name + "s" if in_run else "one_" + name), (0 if in_run else 1)
            else:
                fresh = "quote" if name == "quote" else kind[name]
                if state == "one_space":
                    to, cut = kind[name], 0
                elif state == "spaces":
                    to, cut = kind[name], 2
                elif state == "blanks":
                    to, cut = fresh, 3
                elif state in ("letters", "digits", "signs"):
                    to, cut = (state, 0) if kind[name] == state else (fresh, 1)
                elif state == "quote":
                    if name == "stmd":
                        to, cut = "short", 0
                    elif name in ("r", "v", "l"):
                        to, cut = f"quote_{name}", 0
                    elif kind[name] == "signs":
                        to, cut = "signs", 0
                    else:
                        to, cut = fresh, 1
                elif state in ("quote_r", "quote_v", "quote_l"):
                    if name == ("l" if state == "quote_l" else "e"):
                        to, cut = "short", 0
                    elif kind[name] == "letters":
                        to, cut = "letters", 2
                    else:
                        to, cut = fresh, 3
                else:  # start, one_blank, short
                    to, cut = fresh, 1
            if state in ("quote_r", "quote_v", "quote_l") and name in ("space", "blank", "end"):
                cut |= 2
            step[s[state], c[name]], cuts[s[state], c[name]] = s[to], cut
    return step, cuts


class Cutter:
    """The first transducer, run over many chunks at once."""

    def __init__(self) -> None:
        self.classes = character_classes()
        self.step, self.cuts = cutter()

    def begins(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """For each piece of text, as code points, the places where pre-tokens begin."""
        sizes = np.array([len(p) for p in pieces])
        chunks = sizes // CHUNK + 1
        owner = np.repeat(np.arange(len(pieces)), chunks)
        first = np.concatenate([[0], np.cumsum(chunks)[:-1]]).astype(np.int64)
        flat = np.full((int(chunks.sum()), CHUNK), CLASSES.index("end"), np.uint8)
        for p, at in zip(pieces, first):
            if len(p):
                flat[at : at + len(p) // CHUNK + 1].reshape(-1)[: len(p)] = self.classes[p]
        lanes = np.ascontiguousarray(flat.T)
        entry = self._entries(lanes, owner, first)
        state, marks = entry, np.zeros((CHUNK + 1, lanes.shape[1]), np.uint8)
        for k in range(CHUNK):
            cut = self.cuts[state, lanes[k]]
            marks[k + 1] |= cut & 1
            marks[k] |= cut >> 1
            state = self.step[state, lanes[k]]
        here = marks[1:].T.reshape(-1).astype(bool)
        # what a chunk's first character says of the last one of the chunk before
        back = np.flatnonzero(marks[0])
        here[back * CHUNK - 1] |= back > 0
        out = []
        for n, at in zip(sizes.tolist(), (first * CHUNK).tolist()):
            out.append(np.flatnonzero(here[at : at + n]))
        return out

    def _entries(self, lanes: np.ndarray, owner: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The entry state of every chunk: chunk maps, composed by a prefix scan within each piece."""
        m, width = len(STATES), lanes.shape[1]
        maps = np.repeat(np.arange(m, dtype=np.uint8)[:, None], width, axis=1)
        merged, k = False, 0
        while k < CHUNK and not merged:
            for _ in range(8):
                maps = self.step[maps, lanes[k][None, :]]
                k += 1
            merged = bool((maps == maps[0]).all())
        if merged:
            state = maps[0]
            for k in range(k, CHUNK):
                state = self.step[state, lanes[k]]
            maps = np.repeat(state[None, :], m, axis=0)
        # a piece begins in state 0 whatever came before
        maps[:, heads] = maps[0, heads]
        span, columns = 1, np.arange(width)
        while span < width:
            prior = columns[span:]
            joined = (owner[span:] == owner[: width - span])
            composed = maps[maps[:, : width - span], prior[None, :]]
            maps = np.concatenate([maps[:, :span], np.where(joined[None, :], composed, maps[:, span:])], axis=1)
            span *= 2
        entry = np.concatenate([[0], maps[0][:-1]]).astype(np.uint8)
        entry[heads] = 0
        return entry


class Merges:
    """The second transducer: bytes of pre-tokens -> number of tokens, states compiled when met.

    ``counts`` runs it over many chunks at once. Moves lie in arrays, an open hash
    table from (state, byte) to (state, change of the count).
    """

    most_states = 400_000

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.valid = {t: t for t in tokens if len(self._merged(t)) == 1}
        # the pair of which each entry is made, and the rank of that merge
        self.halves = {t: self._merged(t, 2) for t in self.valid if len(t) > 1}
        self.formed = {t: self.rank[tuple(h)] for t, h in self.halves.items()}
        # every entry is made after its halves, so that merges run by rank alone
        if any(self.formed.get(x, -1) >= self.formed[t] for t, h in self.halves.items() for x in h):
            raise ValueError("a merge comes before those of its halves")
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.open = {t[:k]: t[:k] for t in self.valid for k in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._forget()

    def _forget(self) -> None:
        # a state: the places where an entry may have begun, as (bytes since, last token there, count there less the count here)
        start = ((b"", None, 0),)
        self.known, self.places = {start: 0}, [start]
        self._allot(18)

    def _allot(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.adds = np.zeros(1 << bits, np.int16)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        """Puts new, distinct keys into the table: whoever finds a free slot takes it, the others look at the next."""
        if (self.used + len(keys)) * 3 > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            kept = self.keys[old], self.next[old], self.adds[old]
            self._allot(self.bits + 1)
            self._insert(*kept)
            self._insert(keys, to, adds)
            return
        self.used += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.next[at[mine]], self.adds[at[mine]] = to[mine], adds[mine]
            keys, to, adds, at = keys[~mine], to[~mine], adds[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def _moved(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and changes of the count; moves that are not there yet are compiled."""
        key = state.astype(np.int64) << 8 | byte
        at = self._slots(key)
        got = self.keys[at]
        other = np.flatnonzero(got != key)
        new = []
        while len(other):
            there = got[other] >= 0
            new.append(other[~there])
            other = other[there]
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            got[other] = self.keys[at[other]]
            other = other[got[other] != key[other]]
        to, adds = self.next[at], self.adds[at]
        if new and len(new := np.concatenate(new)):
            made, back = np.unique(key[new], return_inverse=True)
            moves = np.array([self._move(k >> 8, bytes([k & 255])) for k in made.tolist()], np.int32)
            self._insert(made, moves[:, 0], moves[:, 1].astype(np.int16))
            to[new], adds[new] = moves[back, 0], moves[back, 1]
        return to, adds

    def _merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The tokens that the merges give, lowest rank first, down to ``least``; the definition, for compilation only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == pair:
                    parts[k : k + 2] = [pair[0] + pair[1]]
                k += 1
        return parts

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The pieces at one end of an entry while it is merged, each with the rank of the merge that takes it."""
        own = self.spines.get((token, side))
        if own is None:
            own, piece, taken = [], token, 1 << 60
            while True:
                own.append((piece, taken))
                if piece not in self.halves:
                    break
                taken, piece = self.formed[piece], self.halves[piece][side]
            self.spines[token, side] = own
        return own

    def _compatible(self, a: bytes | None, b: bytes) -> bool:
        """Whether no merge joins the end of ``a`` with the begin of ``b`` before their own merges take them."""
        if a is None:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.most_states * 4:
                self.pairs.clear()
            known, rank = True, self.rank
            for x, x_taken in self._spine(a, 1):
                for y, y_taken in self._spine(b, 0):
                    # of equal pairs the one further left is merged first
                    if (r := rank.get((x, y))) is not None and r < x_taken and r <= y_taken:
                        known = False
            self.pairs[a, b] = known
        return known

    def _move(self, state: int, byte: bytes) -> tuple[int, int]:
        """The state after one more byte and the change of the count."""
        places = self.places[state]
        last = None
        for since, before, count in places:
            token = self.valid.get(since + byte)
            if token is not None and self._compatible(before, token):
                last, here = token, count + 1
                break
        if last is None:
            raise ValueError(f"no token of the vocabulary ends in byte {byte!r}")
        after = tuple((longer, before, count - here) for since, before, count in places if (longer := self.open.get(since + byte)) is not None)
        after += ((b"", last, 0),)
        to = self.known.get(after)
        if to is None:
            to = self.known[after] = len(self.places)
            self.places.append(after)
        return to, here

    def _walked(self, lanes: np.ndarray, marks: np.ndarray | None, first: np.ndarray, last: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of every chunk (a column of ``lanes``), from byte ``first`` to ``last``; marks go back to the start."""
        state, total = state.astype(np.int32), np.zeros(lanes.shape[1], np.int64)
        for k in range(int(first.min(initial=0)), int(last.max(initial=0))):
            live = np.flatnonzero((first <= k) & (k < last))
            if marks is not None:
                state[marks[k]] = 0
            if len(live) == len(state):
                state, adds = self._moved(state, lanes[k])
                total += adds
            elif len(live):
                state[live], adds = self._moved(state[live], lanes[k][live])
                total[live] += adds
        return state, total

    def counts(self, data: list[bytes], begins: list[np.ndarray]) -> list[int]:
        """Tokens of each piece of text, given the bytes at which its pre-tokens begin.

        A chunk's map leads from each state in which it may be entered to its exit
        state and count. Behind its first pre-token's begin it is constant; before,
        it is worked out for the exit states of the chunk before. A chunk inside a
        long pre-token has no begin: its map is worked out for all states that may
        enter it, the start among them, which what follows soon forgets, so that
        such chunks need not wait for each other. The maps compose, with their
        counts, by a prefix scan.
        """
        if len(self.places) > self.most_states:
            self._forget()
        sizes = np.array([len(d) for d in data], np.int64)
        chunks = np.maximum(-(-sizes // BYTES), 1)
        heads = np.cumsum(chunks) - chunks
        n = int(chunks.sum())
        flat, marks = np.zeros((n, BYTES), np.uint8), np.zeros((n, BYTES), bool)
        for d, b, at in zip(data, begins, heads.tolist()):
            flat.reshape(-1)[at * BYTES : at * BYTES + len(d)] = np.frombuffer(d, np.uint8)
            marks.reshape(-1)[at * BYTES + b] = True
        owner = np.repeat(np.arange(len(data)), chunks)
        last = np.minimum(sizes[owner] - (np.arange(n) - heads[owner]) * BYTES, BYTES)
        lanes, marked = np.ascontiguousarray(flat.T), np.ascontiguousarray(marks.T)
        has = marks.any(axis=1)
        first = np.where(has, marks.argmax(axis=1), last)
        exits, tails = self._walked(lanes, marked, first, last, np.zeros(n, np.int32))
        maps = self._maps(lanes, first, has, exits, owner)
        return self._scanned(maps, tails, has, exits, owner, heads + chunks - 1)

    def _maps(self, lanes: np.ndarray, first: np.ndarray, has: np.ndarray, exits: np.ndarray, owner: np.ndarray) -> list[dict[int, tuple[int, int]]]:
        """For each chunk, the states in which it may be entered, each with (exit state, count) of its head."""
        n = len(first)
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in range(n)]
        inner = np.flatnonzero(first > 0)
        # (chunk, entry) still to be worked out
        after_cut = inner[has[inner - 1]]
        after_none = inner[~has[inner - 1]]
        chunk = np.concatenate([after_cut, after_none])
        entry = np.concatenate([exits[after_cut - 1], np.zeros(len(after_none), np.int32)])
        while len(chunk):
            # equal heads entered in the same state are worked out once
            keys = [(bytes(lanes[: first[c], c]) if not has[c] else c, e) for c, e in zip(chunk.tolist(), entry.tolist())]
            number = {k: j for j, k in enumerate(dict.fromkeys(keys))}
            where = np.array([number[k] for k in keys])
            once = np.zeros(len(number), np.int64)
            once[where] = np.arange(len(where))
            left, total = self._walked(lanes[:, chunk[once]], None, np.zeros(len(once), np.int64), first[chunk[once]], entry[once])
            more: dict[tuple[int, int], None] = {}
            for c, e, to, count in zip(chunk.tolist(), entry.tolist(), left[where].tolist(), total[where].tolist()):
                maps[c][e] = (to, count)
                if not has[c] and c + 1 < n and owner[c + 1] == owner[c]:
                    more[c + 1, to] = None
            todo = [(c, e) for c, e in more if e not in maps[c]]
            chunk, entry = np.array([c for c, _ in todo], np.int64), np.array([e for _, e in todo], np.int32)
        return maps

    def _scanned(self, maps: list[dict], tails: np.ndarray, has: np.ndarray, exits: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> list[int]:
        """The counts up to the chunks ``ends``: maps over numbered entries, composed in log2(chunks) steps."""
        n, width = len(maps), max(1, max(map(len, maps), default=1))
        numbers = [{e: j for j, e in enumerate(m)} or {0: 0} for m in maps]
        to, count = np.zeros((width, n), np.int32), np.repeat(tails[None, :], width, axis=0)
        for c, m in enumerate(maps):
            ahead = numbers[c + 1] if c + 1 < n and owner[c + 1] == owner[c] else {}
            # behind a begin the exit is the same for all entries
            to[:, c] = ahead.get(int(exits[c]), 0) if has[c] else 0
            for j, (out, own) in enumerate(m.values()):
                count[j, c] += own
                if not has[c]:
                    to[j, c] = ahead.get(out, 0)
        span = 1
        while span < n:
            joined = owner[span:] == owner[: n - span]
            before, columns = to[:, : n - span], np.arange(span, n)
            counted = count[:, : n - span] + count[before, columns]
            led = to[before, columns]
            to = np.concatenate([to[:, :span], np.where(joined, led, to[:, span:])], axis=1)
            count = np.concatenate([count[:, :span], np.where(joined, counted, count[:, span:])], axis=1)
            span *= 2
        return count[0, ends].tolist()

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        return self.counts([word.encode("utf-8", "surrogatepass")], [np.zeros(1 if word else 0, np.int64)])[0]


def _byte_of_sign() -> dict[str, int]:
    """The bytes that a byte-level vocabulary writes as printable characters."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Token counts of texts, compiled from the contents of a tokenizer's file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, sign = spec["model"], _byte_of_sign()
        cut = spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer is expected")
        raw = lambda t: bytes(sign[x] for x in t)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.merges = Merges([raw(t) for t in model["vocab"]], [(raw(a), raw(b)) for a, b in pairs])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cutter = Cutter()

    def counts(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        pieces: list[tuple[int, str]] = []
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                totals[k] += len(parts) - 1
                pieces += [(k, p) for p in parts]
            else:
                pieces.append((k, text))
        at = 0
        while at < len(pieces):
            end, held = at, 0
            while end < len(pieces) and (held == 0 or held + len(pieces[end][1]) <= BLOCK_CHARS):
                held += len(pieces[end][1])
                end += 1
            block = pieces[at:end]
            points = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), "<u4") for _, p in block]
            begins = [_bytes_before(x)[b] for x, b in zip(points, self.cutter.begins(points))]
            counted = self.merges.counts([p.encode("utf-8", "surrogatepass") for _, p in block], begins)
            for (k, _), n in zip(block, counted):
                totals[k] += n
            at = end
        return totals


def _bytes_before(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes before each code point."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.cumsum(size) - size


class Compiled:
    """A tokenizer's file, and in each worker the counter compiled from it.

    Sent as a broadcast, of which a worker has one object for all tasks of a job:
    states that one task has met are there for the next.
    """

    def __init__(self, content: str):
        self.content = content

    def __getstate__(self) -> dict:
        return {"content": self.content}

    def counter(self) -> Counter:
        if "own" not in self.__dict__:
            self.own = Counter(self.content)
        return self.own


def _count(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = content.value.counter()
        for batch in rows_of(batches):
            raw = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            counts = own.counts([x.decode("utf-8", "replace") for x in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row; ``path`` is the tokenizer's file, read by the driver."""
    small_batches(df.sparkSession)
    with open(path or tokenizer_path(), encoding="utf-8") as file:
        content = df.sparkSession.sparkContext.broadcast(Compiled(file.read()))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(content), "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counted = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)

"""SentencePiece encoding and decoding: one forward pass over the trie of distinct marked words.

Words keep their leading mark for white space. Sorted, they are the leaves of a trie in
depth-first order, and the pass keeps one forward state for each letter of the path, so a
prefix that words share is worked out once. For unigram models the state is Viterbi's: the
best score and last piece. For models of the byte-pair kind, whose segmentation is by merge
order and not by the sum of scores, it is the last piece of the prefix's encoding: of the
pieces that end there, the one whose neighbour on its left it would not have merged with.
Short words of such models go side by side instead, a letter of each at a time, in arrays.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from chronoreel.llm.common import KEPT
from chronoreel.llm.ragged import Memo, packed

MARK = "▁"
#: Characters worked on at once, words kept for reuse and pairs of pieces whose fit is kept, in each worker.
CHUNK, WORDS, PAIRS = 1_000_000, 200_000, 400_000
#: Steps between states that are kept, and letters up to which words are worked on side by side.
STEPS, SHORT = 1_000_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 2:
            n, i = _varint(b, i)
            yield key >> 3, b[i : i + n]
            i += n
        elif key & 7 == 0:
            value, i = _varint(b, i)
            yield key >> 3, value
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, b[i : i + n]
            i += n


class Endings:
    """Which pieces end at a place: states are beginnings of pieces; steps and a state's pieces are filled in as they are met."""

    def __init__(self, pieces):
        self.pieces = pieces
        self.starts = {p[:k] for p in pieces for k in range(1, len(p) + 1)} | {""}
        self.state = {"": 0}
        self.names, self.steps, self.ends = [""], [{}], [()]

    def step(self, state: int, letter: str) -> int:
        """The longest end of the path so far that begins a piece; ``ends`` of it are all pieces that end here, longest first."""
        name = self.names[state] + letter
        while name not in self.starts:
            name = name[1:]
        found = self.state.get(name)
        if found is None:
            found = self.state[name] = len(self.names)
            self.names.append(name)
            self.steps.append({})
            self.ends.append(tuple((name[k:], len(name) - k) for k in range(len(name)) if name[k:] in self.pieces))
        if len(self.steps[state]) < 4_096:  # beyond it, worked out anew
            self.steps[state][letter] = found
        return found


class Numbers:
    """From an integer to a number below 2 ** 31, for many at once: ``make`` is asked for those not met yet; beyond ``most`` all begin anew."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self._begin(1 << 12)

    def _begin(self, slots: int) -> None:
        self.key, self.value, self.used = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.key).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or, negative, of the free one where it belongs (less one)."""
        at = self._slot(keys)
        held = self.key[at]
        live = np.flatnonzero((held != keys) & (held != -1))
        while len(live):
            at[live] = (at[live] + 1) & (len(self.key) - 1)
            held[live] = self.key[at[live]]
            live = live[(held[live] != keys[live]) & (held[live] != -1)]
        return np.where(held == -1, -1 - at, at)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > len(self.key):
            own = np.flatnonzero(self.key != -1)
            keys, values = np.concatenate([self.key[own], keys]), np.concatenate([self.value[own], values])
            self._begin(1 << (4 * len(keys)).bit_length())
        self.used += len(keys)
        while len(keys):  # of keys that want one slot the last gets it, the others look on
            at = -1 - self._find(keys)
            self.key[at] = keys
            self.value[at] = values
            left = self.key[at] != keys
            keys, values = keys[left], values[left]

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._find(keys)
        out, miss = self.value[np.maximum(at, 0)], np.flatnonzero(at < 0)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            values = np.fromiter(map(self.make, new.tolist()), np.int32, len(new))
            if self.used + len(new) > self.most:
                self._begin(1 << 12)
            self._put(new, values)
            out[miss] = values[back]
        return out


class Side:
    """The forward pass for byte pairs over many words side by side, letter by letter; pieces and states are numbers, letters that are no piece come after the pieces."""

    def __init__(self, model: Model):
        self.model, self.text = model, sorted(model.live)
        number = {p: i for i, p in enumerate(self.text)}
        self.size = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.id = np.fromiter((model.ids[p] for p in self.text), np.int32, len(self.text))
        self.names = sorted({p[:k] for p in self.text for k in range(1, len(p) + 1)} | {""})
        self.state = {name: i for i, name in enumerate(self.names)}
        ends = [[number[name[k:]] for k in range(len(name)) if name[k:] in number] for name in self.names]  # longest first
        self.first = np.concatenate(([0], np.cumsum([len(e) for e in ends])))
        self.ends = np.array([p for e in ends for p in e], np.int64)
        self.steps, self.fits = Numbers(self._step, STEPS), Numbers(self._fits, PAIRS)

    def _step(self, key: int) -> int:
        name = self.names[key >> 21] + chr(key & 0x1FFFFF)
        while name not in self.state:
            name = name[1:]
        return self.state[name]

    def _fits(self, key: int) -> int:
        left = key >> 32
        return self.model._apart(self.text[left] if left < len(self.text) else chr(left - len(self.text)), self.text[key & 0xFFFFFFFF])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after another, and how many each has."""
        letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        begin, stop = (np.cumsum(length) - length)[order], np.cumsum(length)[order]
        longer = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        last, state = len(self.text) + letter, np.zeros(len(words), np.int64)
        for i, n in enumerate(longer.tolist()):
            at = begin[:n] + i
            state = self.steps[state[:n] << 21 | letter[at]].astype(np.int64)
            j, most = self.first[state], self.first[state + 1]
            live = np.flatnonzero(j < most)
            while len(live):
                piece = self.ends[j[live]]
                size = self.size[piece]
                ok = size > i
                rest = np.flatnonzero(~ok)
                ok[rest] = self.fits[last[at[live[rest]] - size[rest]] << 32 | piece[rest]] > 0
                last[at[live[ok]]] = piece[ok]
                live = live[~ok]
                j[live] += 1
                live = live[j[live] < most[live]]
        place, found, live = [], [], np.flatnonzero(stop > begin)
        end = stop.copy()
        while len(live):
            piece = last[end[live] - 1]
            end[live] -= np.where(piece < len(self.text), self.size[np.minimum(piece, len(self.text) - 1)], 1)
            place.append(end[live])
            found.append(piece)
            live = live[end[live] > begin[live]]
        place, found = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (place, found))
        whole = np.full(len(letter), -1)
        whole[place] = found
        place = np.flatnonzero(whole >= 0)
        return self._ids(whole[place], np.searchsorted(place, np.cumsum(length)))

    def _ids(self, piece: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, bytes of those that aren't any, and how many there are in each word, up to so many pieces."""
        odd = np.flatnonzero(piece >= len(self.text))
        n, out = np.ones(len(piece), np.int64), self.id[np.minimum(piece, len(self.text) - 1)]
        if len(odd):
            spelt, back = np.unique(piece[odd], return_inverse=True)
            ids = [self.model.spell(chr(c - len(self.text))) for c in spelt.tolist()]
            n[odd] = np.array([len(x) for x in ids])[back]
            own = np.repeat(piece >= len(self.text), n)
            out = np.repeat(out, n)
            out[own] = [i for k in back.tolist() for i in ids[k]]
        total = np.concatenate(([0], np.cumsum(n)))[upto]
        return out, np.diff(total, prepend=0)


class Model:
    """Pieces, scores and kind of a model file."""

    def __init__(self, path: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = dict(_fields(dict(_fields(f.read())).get(2, b"")))
        self.merges = spec.get(3, 1) == 2  # trainer_spec.model_type: 1 unigram, 2 byte pairs
        n = self.lib.get_piece_size()
        self.unknown = self.lib.unk_id()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.score = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(self.lib.id_to_piece(i)[3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.score.values(), default=0.0) - 10
        # words can be cut at marks if no piece goes on past a letter into a mark
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # and words between letters and others if no piece holds both
        odd = "".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        letter, other = rf"[^\W\d_{odd}]", rf"(?:(?!{MARK})[\W\d_{odd}])"
        apart = all(re.fullmatch(f"{letter}*|{other}*", p.lstrip(MARK)) for p in self.ids)
        self.pattern = re.compile(f"{MARK}*{letter}+|{MARK}*{other}+|{MARK}+") if apart else _WORD
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.score[p], self.ids[p]))
        self.rank = {p: 0 for p in self.ids if len(p) == 1} | {p: i + 1 for i, p in enumerate(order)}
        self._parts: dict[str, tuple[str, str] | None] = {}
        self._fit: dict[tuple[str, str], bool] = {}
        self.live = {p for p in self.ids if len(p) == 1 or self.parts(p)} if self.merges else set(self.ids)
        self.raw = [self._bytes(i) for i in range(n)]

    def _bytes(self, i: int) -> bytes:
        if self.lib.is_byte(i):
            return bytes([int(self.lib.id_to_piece(i)[3:5], 16)])
        if self.lib.is_control(i):
            return b""
        if self.lib.is_unknown(i):
            return " ⁇ ".encode()
        return self.lib.id_to_piece(i).replace(MARK, " ").encode()

    def words(self, text: str) -> list[str]:
        """The normalised text, cut before each run of marks."""
        line = self.lib.normalize(text) if text else ""
        if not line or not self.cut:
            return [line] if line else []
        if line[0] == MARK and MARK + MARK not in line:
            return [MARK + x for x in line.split(MARK)[1:]]
        return _WORD.findall(line)

    def runs(self, word: str) -> list[str]:
        """A word cut further where no piece reaches across, at the edges of runs of letters."""
        return self.pattern.findall(word) if self.cut else [word]

    # --- byte pairs -------------------------------------------------------------------

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The pair that a piece is merged from when it stands alone; None if a letter, or if it never comes about."""
        if piece not in self._parts:
            self._parts[piece] = None
            if len(piece) > 1:
                got = self.merge(piece, self.rank[piece])
                self._parts[piece] = tuple(got) if len(got) == 2 else None
        return self._parts[piece]

    def merge(self, text: str, before: int) -> list[str]:
        """Plain merging: the best pair first, leftmost of equals, with merges ranked before ``before``."""
        line = list(text)
        while len(line) > 1:
            best = min(((self.rank.get(a + b, before), i) for i, (a, b) in enumerate(zip(line, line[1:], strict=False))))
            if best[0] >= before:
                break
            i = best[1]
            line[i : i + 2] = [line[i] + line[i + 1]]
        return line

    def fits(self, a: str, b: str) -> bool:
        """Whether pieces a and b stay apart next to each other: undo merges from the latest, and see whether the edges would have merged earlier."""
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) > PAIRS:
                self._fit.clear()
            known = self._fit[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        rank, limit = self.rank, 1 << 60
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            # the later of the two was merged last; of equal ranks the left one came first
            if ra > rb and (cut := self.parts(a)):
                limit, a = ra, cut[1]
            elif cut := self.parts(b):
                limit, b = rb + 1, cut[0]
            elif cut := self.parts(a):
                limit, a = ra, cut[1]
            else:
                return True

    @cached_property
    def endings(self) -> Endings:
        return Endings(self.live if self.merges else self.ids)

    @cached_property
    def side(self) -> Side:
        return Side(self)

    def spell(self, letters: str) -> list[int]:
        """Ids of what is no piece."""
        return [self.byte[b] for b in letters.encode()] if self.byte else [self.unknown]

    # --- the forward pass -------------------------------------------------------------

    def encode_words(self, words: list[str]):
        """Ids of each word; words are visited in sorted order and share the states of common prefixes."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list = [None] * len(words)
        known, merges, score = self.ids, self.merges, self.score
        last: list[str] = [""]  # the last piece of each prefix's encoding
        best, path = [0.0], [0]
        fit, fits = self._fit, self.fits
        follow, steps, ends = self.endings.step, self.endings.steps, self.endings.ends
        before = ""
        for k in order:
            word = words[k]
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del last[n + 1 :], best[n + 1 :], path[n + 1 :]
            state = path[n]
            for i in range(n, len(word)):
                letter = word[i]
                to = steps[state].get(letter)
                state = follow(state, letter) if to is None else to
                path.append(state)
                if merges:
                    for piece, size in ends[state]:
                        if size <= i:
                            left = last[i + 1 - size]
                            ok = fit.get((left, piece))
                            if not (fits(left, piece) if ok is None else ok):
                                continue
                        last.append(piece)
                        break
                    else:
                        last.append(letter)
                else:
                    top, found = best[i] + self.least, letter
                    for piece, size in ends[state]:
                        value = best[i + 1 - size] + score[piece]
                        if value > top:
                            top, found = value, piece
                    last.append(found)
                    best.append(top)
            i, pieces = len(word), []
            while i:
                pieces.append(last[i])
                i -= len(last[i])
            ids = []
            for p in reversed(pieces):
                if p in known:
                    ids.append(known[p])
                else:
                    ids += self.spell(p)
            out[k] = ids
            before = word
        return out

    def encode_many(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in an order of its own, all their ids, and how many each has: short ones of byte pairs side by side."""
        short = [w for w in words if len(w) <= SHORT] if self.merges and self.live else []
        other = [w for w in words if len(w) > SHORT] if short else words
        flat, n = self.side.encode(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        _, more, m = packed(other, self.encode_words(other))
        return short + other, np.concatenate([flat, more]), np.concatenate([n, m])

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode(errors="replace")
        return text[1:] if text[:1] == " " else text

    @cached_property
    def spelt(self) -> pa.Array:
        return pa.array(self.raw, pa.binary())

    def decode_many(self, column: pa.Array) -> pa.Array:
        """The text of each list of ids, null of null: the bytes of all pieces at once, if they are valid."""
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("null among the ids of a text")
        said = self.spelt.take(flat)
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))))
        _, at, raw = said.buffers()
        at = np.frombuffer(at, np.int32)[said.offset : said.offset + len(said) + 1].astype(np.int64)[upto]
        raw = np.frombuffer(raw, np.uint8)[: at[-1]] if raw else np.zeros(0, np.uint8)
        some = at[:-1][at[:-1] < at[1:]]
        gone = some[raw[some] == 0x20]  # the space that a text begins with
        at -= np.searchsorted(gone, at)
        null = np.append(column.is_null().to_numpy(zero_copy_only=False), False)
        out = pa.Array.from_buffers(pa.string(), len(column), [pa.array(~null[:-1]).buffers()[1], pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.delete(raw, gone))])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([None if x is None else self.decode(x) for x in column.to_pylist()], pa.string())
        return out


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LOADED: dict[str, tuple[Model, Memo]] = {}
KEPT.append(_LOADED)


def load(path: str) -> tuple[Model, Memo]:
    """Once per process."""
    if path not in _LOADED:
        m = Model(path)
        runs = Memo(m.encode_many, WORDS)
        _LOADED[path] = m, Memo(lambda words: (words, *runs.ids([m.runs(x) for x in words])), WORDS)
    return _LOADED[path]


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def _encoded(batches, path: str, text_col: str):
    """Batches with ``ids`` and ``n_tokens``, cut into pieces of bounded text."""
    own, memo = load(path)
    for b in batches:
        column = b.column(b.schema.get_field_index(text_col))
        size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
        i = 0
        while i < len(column):
            j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), CHUNK, side="right")))
            texts = column.slice(i, j - i).to_pylist()
            flat, n = memo.ids([own.words(t) if t else [] for t in texts])
            null = np.array([t is None for t in texts], bool)
            upto = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(upto, mask=np.append(null, False)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, ids, pa.array(n.astype(np.int64))], [*b.schema.names, "ids", "n_tokens"])
            i = j


def _decoded(batches, path: str, ids_col: str, into: str):
    own, _ = load(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, own.decode_many(b.column(b.schema.get_field_index(ids_col)))], [*b.schema.names, into])


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``n_tokens``, replacing columns of these names: the ids of each whole text.

    Null text has null ids and no tokens; empty text has an empty list. ``model`` must be readable on every executor.
    """
    path, plain = model or default_model(), docs.drop("ids", "n_tokens")
    return plain.mapInArrow(lambda batches: _encoded(batches, path, text_col), _schema(plain, "ids array<int>", "n_tokens long"))


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids in ``into``. Null ids give null; an id outside the model fails."""
    path, plain = model or default_model(), rows.drop(into)
    return plain.mapInArrow(lambda batches: _decoded(batches, path, ids_col, into), _schema(plain, f"`{into}` string"))


def round_trip(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """Encoded and decoded again, in one worker: adds ``ids, n_tokens, decoded``, replacing columns of these names."""
    path, plain = model or default_model(), docs.drop("ids", "n_tokens", "decoded")

    def run(batches):
        return _decoded(_encoded(batches, path, text_col), path, "ids", "decoded")

    return plain.mapInArrow(run, _schema(plain, "ids array<int>", "n_tokens long", "decoded string"))

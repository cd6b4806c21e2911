"""Token ids in a compact binary form: adaptive context mixing and a range coder over reset blocks.

Ids are coded in blocks of ``BLOCK``; each block starts from the same model, so it can be read alone, and carries
a checksum of its ids.  A block is cut into lanes, stretches of like length that are coded side by side with one
model, so that a step of the coder is a few array operations and the model learns from all lanes.

Three orders predict an id: the ids that mostly followed the last two ids and the last id (orders 2 and 1, each with
a count of how often it held), and frequencies of the ids that neither foretold (order 0).  Which order holds - 2, 1
or neither - is one decision.  Three adaptive models foretell it, by the counts of both predictions and whether they
agree, by the last two decisions, and by a class of the last id; their probabilities are added up by learned weights.
After "neither" comes the id itself, by its frequency in the block mixed, with a learned weight for each class, with
its frequency behind last ids of the same class; classes are learned from the first ids of a block.  Ids too rare for
these tables are marked and stand before the lanes, in their order, in a fixed form, in which low ids are shorter, as
vocabularies are in order of frequency.

Tables stand still for some steps and learn from these together: the predictions after every few steps, frequencies and
weights at steps ever further apart, since a step then changes them ever less.  All counts are integers, and
what is mixed is divided and multiplied number by number, so that every machine gets the same tables; of lanes that
change the same place in a step, the last one counts.

Defined results: no ids give no bytes; ids lie below ``2 ** bits``, 20 bits at most (larger ones raise); a
damaged block decodes to other ids of the same number, which its checksum shows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
#: Bits of an id, if no vocabulary asks for more, and at most.
ID_BITS, MOST_BITS = 16, 20
#: Ids of a lane at least, lanes of a block at most, and ids of a lane at most, which bounds its words.
_LEAST, _LANES, _MOST = 512, 2048, 16384
#: Units of a decision, of a frequency and of the fixed form: powers of two.
_PICK, _SIGN, _FIXED = 14, 15, 24
#: Least width of a decision.
_ROOM = 10
_CLASSES = 16
#: Ids from which a block learns its classes, at most, and groups of the ids that follow, by which they differ.
_LEARNT, _GROUPS = 1 << 17, 64
_SLOTS = 1 << 16
#: Contexts of a decision: counts of both predictions and whether they agree, the last two decisions, the class.
_HELD, _PAST = 64, 9
#: Steps after which predictions learn, at most.
_TOGETHER = 16
#: Change of the count of a prediction after a (miss, hit) when it had held 0 to 7 times.
_COUNT = np.array([[0, 0, -1, -2, -2, -3, -3, -4], [1, 1, 1, 1, 1, 1, 1, 0]], np.int32).ravel()


@lru_cache(maxsize=4)
def _fixed(bits: int) -> np.ndarray:
    """Bounds of the fixed form: every id keeps a unit, the rest falls with the id."""
    share = np.cumsum((1 << 30) // (np.arange(1 << bits) + 300))
    bounds = np.zeros((1 << bits) + 1, np.int64)
    bounds[1:] = share * ((1 << _FIXED) - (1 << bits)) // share[-1] + np.arange(1, (1 << bits) + 1)
    return bounds.view(np.uint64)


def _stages(steps: int) -> list[list[tuple[int, int]]]:
    """Steps between which frequencies stand still, each cut where predictions learn."""
    out, at = [], 0
    while at < steps:
        end = min(steps, at + max(1, at))
        out.append([(k, min(end, k + _TOGETHER)) for k in range(at, end, _TOGETHER)])
        at = end
    return out


def _lanes_of(n: int) -> tuple[int, int, int]:
    """Lanes of a block of n ids, its steps, and the lanes that reach the last one."""
    lanes = max(1, min(_LANES, n // _LEAST), -(-n // _MOST))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


class _Model:
    """What is known of a block after some of its steps."""

    def __init__(self, bits: int, decode: bool):
        self.decode = decode
        self.next2 = np.zeros(_SLOTS, np.int32)  # id and count: id * 8 + count
        self.next1 = np.zeros(1 << bits, np.int32)
        self.sign = np.zeros(1 << bits, np.int32)  # of an id; 0: none yet
        self.ids = np.zeros(1, np.int32)  # by sign
        self.klass = np.zeros(1 << bits, np.int8)  # of an id
        self.rare = np.zeros(1 << bits, np.int64)  # how often an id without a sign came
        self.classed = 1  # signs that have a class
        self.counts = np.zeros((_CLASSES, 1), np.int64)  # of signs by class
        self.weights = np.zeros((_CLASSES, 1))  # of the frequencies of a class
        self.picks = [np.tile(np.array([2, 1, 7]), (n, 1)) for n in (_HELD, _PAST, _CLASSES)]
        self.trust = np.full((3, _HELD), 1 / 3)
        self._settle_picks()
        self._settle_signs()

    def contexts(self, p2: np.ndarray, p1: np.ndarray) -> tuple:
        """Both predictions with their slots, what is known of them, and the class."""
        slot = p2 * 210077
        slot += p1 * 40503
        slot >>= 3
        slot &= _SLOTS - 1
        klass = self.klass.take(p1).astype(np.int32)
        g2, g1 = self.next2.take(slot), self.next1.take(p1)
        e2, e1 = g2 >> 3, g1 >> 3
        known = (g2 & 7) << 3
        known |= g1 & 6
        known |= e2 == e1
        return (slot, p1, g2, g1, e2, e1), known, klass

    @staticmethod
    def decisions(known: np.ndarray, klass: np.ndarray, past2: np.ndarray, past1: np.ndarray) -> np.ndarray:
        """Places of the decisions in their table."""
        at = known * 3
        at += past2
        at *= 3
        at += past1
        at *= _CLASSES
        at += klass
        at <<= 2
        return at

    def predictions_learn(self, slot, p1, g2, g1, e2, e1, ids) -> None:
        first = ids << 3
        first |= 1
        for table, at, state, guess in ((self.next2, slot, g2, e2), (self.next1, p1, g1, e1)):
            hit = guess == ids
            kept = (hit | ((state & 7) > 1)).nonzero()[0]  # others give way
            was = state.take(kept)
            was += _COUNT.take((was & 7) | (hit.take(kept).view(np.int8) << 3))
            new = first.copy()
            new[kept] = was
            table[at] = new

    def frequencies_learn(self, ids: np.ndarray, picks: np.ndarray, lanes: int, picked: np.ndarray, signed: np.ndarray, rare: np.ndarray, rare_class: np.ndarray) -> None:
        """Learn from all ids so far and their decisions, and, of the last steps, from places of decisions and of signs
        in their tables and from ids without a sign, with their classes."""
        seen = np.bincount(picked, minlength=_HELD * _PAST * _CLASSES * 4).reshape(_HELD * _PAST, _CLASSES * 4)
        sums = [seen.reshape(_HELD, _PAST, _CLASSES, 4).sum(2), seen.sum(0).reshape(_CLASSES, 4)[:, :3]]
        sums[:1] = [sums[0].sum(1)[:, :3], sums[0].sum(0)[:, :3]]
        seen = seen.reshape(_HELD, -1, 4)[..., :3].reshape(_HELD, -1)
        for m, part in enumerate(self.parts):
            fit = part / self.mixed
            fit *= 1024
            own = (fit.astype(np.int64).reshape(_HELD, -1) * seen).sum(1)
            self.trust[m] = (own / 1024 + 16 * self.trust[m]) / (sums[0].sum(1) + 16)
        self.trust /= self.trust[0] + self.trust[1] + self.trust[2]
        for table, s in zip(self.picks, sums):
            table += s * 4
            table -= table >> 3
            table += 1
        self._settle_picks()

        signs = len(self.ids)
        new = np.bincount(signed, minlength=(_CLASSES + 1) * signs)[: _CLASSES * signs].reshape(_CLASSES, signs)
        n = new.sum(1, keepdims=True)
        share = (np.divide(self.mine, self.fit, out=self.mine, where=self.fit > 0) * 1024).astype(np.int64)
        share *= new
        self.weights = (share.sum(1, keepdims=True) / 1024 + 20 * np.maximum(self.weights, 0.3)) / (n + 20)
        early = len(ids) - 2 * lanes <= _LEARNT
        if not early:
            self.counts += new
        if len(rare):
            total = len(ids) if early else int(self.counts.sum())
            self.rare += np.bincount(rare, minlength=len(self.rare))
            often = np.unique(rare)
            often = often[self.rare.take(often) << _SIGN >= total]
            if len(often) and signs + len(often) < 1 << _SIGN - 1:
                self.sign[often] = np.arange(len(often)) + signs
                self.ids = np.append(self.ids, often.astype(np.int32))
                if not early:
                    sign, signs = self.sign.take(rare), len(self.ids)
                    now = np.bincount(rare_class * signs + sign, minlength=_CLASSES * signs).reshape(_CLASSES, signs)
                    now[:, 0] = self.counts[:, 0] - now[:, 1:].sum(1)
                    now[:, 1 : self.counts.shape[1]] = self.counts[:, 1:]
                    self.counts = now
        if early:
            last, now, free = ids[lanes:-lanes], ids[2 * lanes :], picks[2 * lanes :] == 2
            self._classify(last, now)
            signs = len(self.ids)
            self.counts = np.bincount((self.klass.take(last) * np.int64(signs) + self.sign.take(now))[free], minlength=_CLASSES * signs).reshape(_CLASSES, signs)
        self._settle_signs()

    def _classify(self, last: np.ndarray, now: np.ndarray) -> None:
        """Ids go to the class whose followers theirs are likeliest to come from; sums of integers, exact as floats."""
        signs = len(self.ids)
        sign, group = self.sign.take(last), (now * 40503 >> 7) & (_GROUPS - 1)
        own = self.klass.take(self.ids).astype(np.int64)
        own[self.classed :] = np.arange(self.classed, signs) % _CLASSES
        self.classed = signs
        follow = np.bincount(sign * _GROUPS + group, minlength=signs * _GROUPS).reshape(signs, _GROUPS).astype(float)
        sums = np.bincount(own.take(sign) * _GROUPS + group, minlength=_CLASSES * _GROUPS).reshape(_CLASSES, _GROUPS)
        part, power = np.frexp((sums + 0.5) / (sums.sum(1, keepdims=True) + _GROUPS / 2))
        likely = np.rint(64 * (2 * part + power))  # nearly the logarithm
        self.klass[self.ids[1:]] = np.einsum("sg,cg->sc", follow, likely)[1:].argmax(1)

    def _settle_picks(self) -> None:
        """Bounds of the decisions: the probabilities of each model, times its weight, added up."""
        p = [t / t.sum(1, keepdims=True) for t in self.picks]
        w = self.trust[:, :, None, None, None]
        self.parts = [p[0][:, None, None] * w[0], p[1][None, :, None] * w[1], p[2][None, None] * w[2]]
        self.mixed = self.parts[0] + self.parts[1] + self.parts[2]
        width = (self.mixed * ((1 << _PICK) - 3 * _ROOM)).astype(np.uint64) + np.uint64(_ROOM)
        cuts = np.zeros((_HELD * _PAST * _CLASSES, 4), np.uint64)
        cuts[:, 1] = width[..., 0].ravel()
        cuts[:, 2] = cuts[:, 1] + width[..., 1].ravel()
        cuts[:, 3] = 1 << _PICK
        self.cuts = cuts.ravel()
        self.ends, self.seconds = self.cuts[1:], self.cuts[2:]

    def _settle_signs(self) -> None:
        """Bounds of the signs by class; the last row is for ids that were foretold and takes no room."""
        n, all_ = self.counts.sum(1, keepdims=True), self.counts.sum(0)
        signs = len(self.ids)
        self.mine = self.counts * (self.weights / np.maximum(n, 1))
        self.fit = self.mine + all_ * ((1 - self.weights) / max(int(all_.sum()), 1))
        width = (self.fit * ((1 << _SIGN) - signs - 1)).astype(np.int64)
        width += 1
        width[:, 0] += (1 << _SIGN) - width.sum(1)
        bounds = np.zeros((_CLASSES + 1, signs + 1), np.int64)
        np.cumsum(width, axis=1, out=bounds[:-1, 1:])
        bounds[-1, 1:] = 1 << _SIGN
        self.starts, self.widths = bounds[:, :-1].ravel().view(np.uint64), np.diff(bounds, axis=1).ravel()
        if self.decode:
            self.at = np.repeat(np.tile(np.arange(signs, dtype=np.uint16), _CLASSES + 1), self.widths)
        self.widths = self.widths.view(np.uint64)


_WORD, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_P, _S, _F = np.uint64(_PICK), np.uint64(_SIGN), np.uint64(_FIXED)
_BOTH, _ALONE = (_P, _S), (_F,)


class _Writer:
    """Range coder with 64-bit state; words of 32 bits, whose carries are settled at the end."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
        self.words, self.used = np.zeros((lanes, 64 + steps // 2), np.int64), np.zeros(lanes, np.int64)
        self.puts = 0  # a lane gets a word in each, at most

    def put(self, m: int, bits: tuple, *parts: np.ndarray) -> None:
        """In the first ``m`` lanes; ``parts``: starts and widths, in units of ``2 ** -bits``, of each of the things
        that are put together."""
        low, span = self.low[:m], self.span[:m]
        old = low.copy()
        for k, unit in enumerate(bits):
            span >>= unit
            low += span * parts[2 * k]
            span *= parts[2 * k + 1]
        over = (low < old).nonzero()[0]
        if len(over):
            self.words[over, self.used.take(over) - 1] += 1  # low + span stays below 2**64 until the first word
        k = (span <= _MASK).nonzero()[0]
        if len(k):
            used, short = self.used.take(k), low.take(k)
            self.words[k, used] = short >> _WORD
            self.used[k] = used + 1
            low[k] = short << _WORD
            span[k] = span.take(k) << _WORD
        self.puts += 1
        if self.puts % 16 == 0 and self.used.max() + 24 > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)

    def finish(self) -> bytes:
        """Words of each lane, behind their numbers; one last word lies within the span, which is wider."""
        at = np.arange(len(self.low))
        last = self.low + _MASK
        over = (last < self.low).nonzero()[0]
        self.words[over, self.used[over] - 1] += 1
        self.words[at, self.used] = last >> _WORD
        self.used += 1
        for k in range(int(self.used.max()) - 1, 0, -1):  # carries run to the front
            self.words[:, k - 1] += self.words[:, k] >> 32
            self.words[:, k] &= 0xFFFFFFFF
        whole = self.words[np.arange(self.words.shape[1]) < self.used[:, None]]
        return self.used.astype("<u2").tobytes() + whole.astype("<u4").tobytes()


class _Reader:
    def __init__(self, coded: bytes, lanes: int):
        used = np.frombuffer(coded.ljust(2 * lanes, b"\0"), "<u2", lanes).astype(np.int64)
        words = np.frombuffer(coded[2 * lanes :].ljust(4, b"\0"), "<u4", max(4, len(coded) - 2 * lanes) // 4)
        lane = np.repeat(np.arange(lanes), used)[: len(words)]
        self.at = np.cumsum(used) - used + np.arange(lanes)
        self.words = np.zeros(len(words) + lanes + 2, np.uint64)  # a zero behind each lane
        self.words[np.arange(len(lane)) + lane] = words[: len(lane)]
        self.span, self.code = np.full(lanes, _FULL), np.zeros(lanes, np.uint64)
        for _ in range(2):
            self.code = (self.code << _WORD) | self.words.take(self.at, mode="clip")
            self.at += 1

    def refill(self, lanes: np.ndarray) -> None:
        """Another word for these lanes."""
        at = self.at.take(lanes)
        code = self.code.take(lanes)
        code <<= _WORD
        code |= self.words.take(at, mode="clip")
        self.code[lanes] = code
        at += 1
        self.at[lanes] = at
        self.span[lanes] = self.span.take(lanes) << _WORD


def _rare_lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(128, n // 64), -(-n // _MOST))
    return lanes, -(-n // lanes)


def _encode_rare(ids: np.ndarray, bits: int) -> bytes:
    """Ids in the fixed form."""
    lanes, steps = _rare_lanes(len(ids))
    fixed, out = _fixed(bits), _Writer(lanes, steps)
    start = fixed.take(ids)
    width = fixed[1:].take(ids) - start
    for k in range(0, len(ids), lanes):
        out.put(len(ids[k : k + lanes]), _ALONE, start[k : k + lanes], width[k : k + lanes])
    return out.finish()


def _decode_rare(coded: bytes, n: int, bits: int) -> np.ndarray:
    lanes, _ = _rare_lanes(n)
    fixed, src, most = _fixed(bits), _Reader(coded, lanes), np.uint64((1 << _FIXED) - 1)
    out = np.zeros(n, np.int32)
    for k in range(0, n, lanes):
        m = min(lanes, n - k)
        code, span = src.code[:m], src.span[:m]
        span >>= _F
        x = fixed.searchsorted(np.minimum(code // span, most), side="right") - 1
        out[k : k + m] = x
        start = fixed.take(x)
        code -= span * start
        span *= fixed[1:].take(x) - start
        src.refill((span <= _MASK).nonzero()[0])
    return out


def encode_blocks(blocks: list[np.ndarray], bits: int = ID_BITS) -> list[bytes]:
    """Code each block of ids; the result of a block depends on its own ids alone."""
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"ids have 1 to {MOST_BITS} bits")
    return [_encode(np.asarray(b, np.int64), bits) for b in blocks]


def _encode(block: np.ndarray, bits: int) -> bytes:
    n = len(block)
    if not n:
        return b""
    if int(block.max()) >> bits or int(block.min()) < 0:
        raise ValueError(f"ids must lie below {1 << bits}")
    lanes, steps, full = _lanes_of(n)
    ids, picks = np.zeros((2 + steps, lanes), np.int32), np.full((2 + steps, lanes), 2, np.int32)  # behind two steps
    ids[2:, :full] = block[: full * steps].reshape(full, steps).T
    ids[2:-1, full:] = block[full * steps :].reshape(lanes - full, steps - 1).T
    ids, picks = ids.ravel(), picks.ravel()
    model, out = _Model(bits, False), _Writer(lanes, steps)
    rare: list[np.ndarray] = []
    for stage in _stages(steps):
        held: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in stage:
            at = [slice((a + k) * lanes, min(n, b * lanes) + k * lanes) for k in range(3)]
            now, pick = ids[at[2]], picks[at[2]]
            orders, joint, klass = model.contexts(ids[at[0]], ids[at[1]])
            second, first = orders[4] == now, orders[5] == now
            pick -= first
            np.copyto(pick, 0, where=second)
            told = second | first
            picked = model.decisions(joint, klass, picks[at[0]], picks[at[1]])
            picked += pick
            np.maximum(klass, told.view(np.int8) * np.int8(_CLASSES), out=klass)
            sign = model.sign.take(now)
            np.copyto(sign, 0, where=told)
            signed = klass * len(model.ids)
            signed += sign
            start = model.cuts.take(picked)
            parts = (start, model.ends.take(picked) - start, model.starts.take(signed), model.widths.take(signed))
            new = ((sign == 0) & ~told).nonzero()[0]
            for t in range(b - a):
                own = slice(t * lanes, (t + 1) * lanes)
                out.put(len(now[own]), _BOTH, *[p[own] for p in parts])
            model.predictions_learn(*orders, now)
            rare.append(now.take(new))
            for h, v in zip(held, (picked, signed, rare[-1], klass.take(new))):
                h.append(v)
        if stage[-1][1] < steps:
            upto = (stage[-1][1] + 2) * lanes
            model.frequencies_learn(ids[:upto], picks[:upto], lanes, *map(np.concatenate, held))
    apart = _encode_rare(np.concatenate(rare), bits)
    return np.array([sum(map(len, rare)), len(apart)], "<u4").tobytes() + apart + out.finish()


def decode_blocks(coded: list[bytes], sizes: list[int], bits: int = ID_BITS) -> list[np.ndarray]:
    """Ids of each block."""
    return [_decode(c, n, bits) for c, n in zip(coded, sizes)]


def _decode(coded: bytes, n: int, bits: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<u4")
    lanes, steps, full = _lanes_of(n)
    number, length = np.frombuffer(coded.ljust(8, b"\0"), "<u4", 2).tolist()
    rare, at = _decode_rare(coded[8 : 8 + length], min(number, n), bits), 0
    model, src = _Model(bits, True), _Reader(coded[8 + length :], lanes)
    ids, picks = np.zeros((2 + steps, lanes), np.int32), np.full((2 + steps, lanes), 2, np.int32)
    most = np.uint64((1 << _SIGN) - 1)
    for stage in _stages(steps):
        held: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in stage:
            seen: list[tuple] = []
            for t in range(a, b):
                m = full if t == steps - 1 else lanes
                orders, joint, klass = model.contexts(ids[t, :m], ids[t + 1, :m])
                picked = model.decisions(joint, klass, picks[t, :m], picks[t + 1, :m])
                code, span = src.code[:m], src.span[:m]
                span >>= _P
                goal = code // span
                not_second, free = goal >= model.ends.take(picked), goal >= model.seconds.take(picked)
                pick = not_second.view(np.int8) + free.view(np.int8)
                picks[t + 2, :m] = pick
                told = ~free
                picked += pick
                start = model.cuts.take(picked)
                code -= span * start
                span *= model.ends.take(picked) - start
                np.maximum(klass, told.view(np.int8) * np.int8(_CLASSES), out=klass)
                span >>= _S
                goal = np.minimum(code // span, most).view(np.int64)
                goal += klass << _SIGN
                sign = model.at.take(goal)
                signed = klass * len(model.ids)
                signed += sign
                code -= span * model.starts.take(signed)
                span *= model.widths.take(signed)
                src.refill((span <= _MASK).nonzero()[0])
                now = ids[t + 2, :m]
                now[:] = model.ids.take(sign)
                own = told.nonzero()[0]
                now[own] = np.where(not_second.take(own), orders[5].take(own), orders[4].take(own))
                new = ((sign == 0) & free).nonzero()[0]
                if len(new):
                    x = rare[at : at + len(new)]
                    at += len(x)
                    now[new[: len(x)]] = x
                    held[2].append(now.take(new))
                    held[3].append(klass.take(new))
                seen.append(orders)
                held[0].append(picked)
                held[1].append(signed)
            whole = ids[a + 2 : b + 2].ravel()
            model.predictions_learn(*map(np.concatenate, zip(*seen)), whole[: n - a * lanes])
        if stage[-1][1] < steps:
            upto = stage[-1][1] + 2
            model.frequencies_learn(ids[:upto].ravel(), picks[:upto].ravel(), lanes, *[np.concatenate(h) if h else np.zeros(0, np.int32) for h in held])
    out = np.empty(n, "<u4")
    out[: full * steps].reshape(full, steps)[:] = ids[2:, :full].T
    out[full * steps :].reshape(lanes - full, steps - 1)[:] = ids[2:-1, full:].T
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
